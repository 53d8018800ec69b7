"""Raw JSON payloads to typed observations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veleta import fixed_values as V
from veleta.functions.parse import (
    first_present,
    first_usable,
    is_missing_text,
    number_of,
    parse_epoch,
    parse_number,
    parse_timestamp,
    present_name,
    usable_text,
)
from veleta.functions.texts import let, staged
from veleta.operators.dedup import dedup_first

RECORD, RECORDS = "MAP<STRING,STRING>", "ARRAY<MAP<STRING,STRING>>"


def src_payload(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row per record: ``raw`` map and ``record_no`` (its place in the payload).

    A payload is a list, a wrapper whose first list-valued key counts, or a single record.
    Other columns of ``df`` are kept.
    """
    text = F.trim(F.col(column))
    bare = F.when(text.startswith("["), F.from_json(text, RECORDS))
    top = F.when(text.startswith("{"), F.from_json(text, RECORD))
    df = staged(df.withColumns({"_bare": bare, "_top": top}), "payloads")
    wrapped = [
        F.when(F.col("_top")[k].startswith("["), F.from_json(F.col("_top")[k], RECORDS)) for k in V.WRAPPER_KEYS
    ]
    names = F.transform(F.map_keys("_top"), lambda k: F.lower(k))
    single = F.when(
        F.arrays_overlap(names, F.array(*[F.lit(k) for k in V.SINGLE_RECORD_KEYS])), F.array(F.col("_top"))
    )
    found = F.coalesce(F.col("_bare"), *wrapped, single)
    kept = [c for c in df.columns if c not in ("_bare", "_top", column)]
    return df.select(*kept, F.posexplode(found).alias("record_no", "raw")).filter(F.col("raw").isNotNull())


def norm_keys(raw: Column) -> Column:
    """Lower-case keys with underscores; of colliding keys the last one counts."""
    entries = F.transform(
        F.map_entries(raw), lambda e: F.struct(F.replace(F.lower(e["key"]), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value"))
    )

    def keyed(entries: Column) -> Column:
        names = entries["key"]
        unique = F.size(F.array_distinct(names)) == F.size(names)
        # The last entry of a name: no later entry has the same name.
        last = F.filter(
            entries, lambda e, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == e["key"])
        )
        return F.map_from_entries(F.when(unique, entries).otherwise(last))

    return let(entries, keyed)


def norm_station_name(raw: Column, station_id: Column) -> Column:
    district, state = raw["district"], raw["state"]
    has_district = ~is_missing_text(district)
    has_state = ~is_missing_text(state)
    return let(first_usable(raw, V.ALIASES["station_name"]), lambda name: (
        F.when(name.isNull(), F.concat(F.lit("IMD AWS "), station_id))
        .when(has_district & has_state, F.concat(name, F.lit(" ("), district, F.lit(", "), state, F.lit(")")))
        .when(has_district, F.concat(name, F.lit(" ("), district, F.lit(")")))
        .otherwise(name)
    ))


def norm_timestamp(raw: Column, now: Column) -> Column:
    """Date + time when both are usable, else epoch or text; a missing one is ``now``.

    Text in no known layout gives null; such rows go to quarantine.
    """
    joined = F.concat(usable_text(raw["date"]), F.lit(" "), usable_text(raw["time"]))
    text = usable_text(first_present(raw, V.ALIASES["timestamp"]))
    read = let(F.coalesce(joined, text), lambda t: F.coalesce(parse_epoch(t), parse_timestamp(t)))
    return F.when(joined.isNull() & text.isNull(), now).otherwise(read)


def _named(name: Column, *parts: str) -> Column:
    """Whether the name of a reading contains one of ``parts``."""
    return F.coalesce(reduce(or_, [F.contains(name, F.lit(p)) for p in parts]), F.lit(False))


def norm_units(raw: Column) -> dict[str, Column]:
    """Sensor values in °C, %, hPa, km/h and mm. Every reading is looked up and parsed once."""
    value = {s: number_of(raw, V.ALIASES[s]) for s in ("temperature_c", "relative_humidity_pct", "pressure_hpa")}

    def named(sensor: str, body: Callable[[Column, Column], Column]) -> Column:
        return let(present_name(raw, V.ALIASES[sensor]), lambda name: let(parse_number(raw[name]), lambda v: body(v, name)))

    return {
        "temperature_c": let(
            value["temperature_c"], lambda t: F.when(t > 130, F.bround((t - 32.0) * 5.0 / 9.0, 2)).otherwise(t)),
        "relative_humidity_pct": value["relative_humidity_pct"],
        "pressure_hpa": let(
            value["pressure_hpa"],
            lambda p: F.when(p > 50000, F.bround(p / 100.0, 2)).when((p >= 20) & (p <= 35), F.bround(p * 33.8639, 2)).otherwise(p)),
        "wind_speed_kmh": named(
            "wind_speed_kmh",
            lambda w, name: F.when(_named(name, "ms", "mps"), F.bround(w * 3.6, 2)).when(_named(name, "knot"), F.bround(w * 1.852, 2)).otherwise(w)),
        "rainfall_mm": named("rainfall_mm", lambda r, name: F.when(_named(name, "cm"), F.bround(r * 10.0, 2)).otherwise(r)),
    }


def norm_defaults(values: dict[str, Column]) -> dict[str, Column]:
    return {s: F.coalesce(values[s], F.lit(d)) for s, d in V.SENSOR_DEFAULTS.items()}


def invalid_coordinates(lat: Column, lon: Column) -> Column:
    inside = lat.between(*V.COUNTRY_BOX["latitude"]) & lon.between(*V.COUNTRY_BOX["longitude"])
    return ~F.coalesce(inside & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def region_lookup(text: Column) -> Column:
    """Centroid of the first region, in listed order, that the text contains."""
    hits = [
        F.when(text.contains(name), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))
        for name, lat, lon in V.REGIONS
    ]
    return F.coalesce(*hits)


def known_station(station_id: Column) -> Column:
    hits = [
        F.when(station_id == sid, F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))
        for sid, lat, lon in V.KNOWN_STATIONS
    ]
    return F.coalesce(*hits)


def place_of(lat: Column, lon: Column, station_id: Column, search_text: Column) -> Column:
    """``lat`` and ``lon`` in one value, so that a row's text is searched once, and only where its coordinates are invalid."""
    centre = F.struct(F.lit(V.CENTRE[0]).alias("lat"), F.lit(V.CENTRE[1]).alias("lon"))
    repaired = F.coalesce(known_station(station_id), let(F.upper(search_text), region_lookup), centre)
    return F.when(invalid_coordinates(lat, lon), repaired).otherwise(F.struct(lat.alias("lat"), lon.alias("lon")))


def norm_coord_repair(lat: Column, lon: Column, station_id: Column, search_text: Column) -> tuple[Column, Column]:
    """Known station, else region named in the text, else the country's centre."""
    place = place_of(lat, lon, station_id, search_text)
    return F.bround(place["lat"], 4), F.bround(place["lon"], 4)


def normalize_records(records: DataFrame, now: Column | None = None) -> DataFrame:
    """Typed observation per raw record; records without a station id are dropped.

    ``timestamp`` is null where its text is in no known layout.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    keyed = staged(records.withColumn("_m", norm_keys(F.col("raw"))), "records")
    m = F.col("_m")
    keyed = keyed.withColumn("station_id", first_usable(m, V.ALIASES["station_id"])).filter(
        F.col("station_id").isNotNull()
    )
    named = staged(keyed.withColumns(
        {
            "station_name": norm_station_name(m, F.col("station_id")),
            "_lat": number_of(m, V.ALIASES["latitude"]),
            "_lon": number_of(m, V.ALIASES["longitude"]),
        }
    ), "stations")
    search = F.concat_ws(" ", "station_name", F.coalesce(m["district"], F.lit("")), F.coalesce(m["state"], F.lit("")))
    placed = staged(named.withColumn("_place", place_of(F.col("_lat"), F.col("_lon"), F.col("station_id"), search)), "places")
    return placed.withColumns(
        {
            "district": m["district"],
            "state": m["state"],
            "latitude": F.bround(F.col("_place")["lat"], 4),
            "longitude": F.bround(F.col("_place")["lon"], 4),
            "timestamp": norm_timestamp(m, now),
            **norm_defaults(norm_units(m)),
            **norm_optional(m),
            "raw_observation": F.to_json("raw"),
        }
    ).drop("_m", "_lat", "_lon", "_place", "raw")


def norm_optional(m: Column) -> dict[str, Column]:
    return {
        "wind_direction": parse_number(m["wind_direction"]),
        "weather_message": F.when(m["weather_message"] != "", m["weather_message"]),
        "feel_like": parse_number(m["feel_like"]),
    }


def norm_batch(records: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Observations, first of each key kept, and the quarantined rows without a timestamp."""
    return split_typed(normalize_records(records, now))


def split_typed(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised records as ``norm_batch`` parts them."""
    return dedup_first(typed.filter(F.col("timestamp").isNotNull())), typed.filter(F.col("timestamp").isNull())

