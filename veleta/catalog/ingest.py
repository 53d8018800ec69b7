"""Sources, sinks and payload normalisation (survey 2.1, 2.2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from veleta.catalog import common as C
from veleta.fixed_values import ALIASES, COUNTRY_BOX, REQUEST_BOUNDS, SENSORS
from veleta.functions.parse import first_present, first_usable, parse_number
from veleta.functions.texts import staged
from veleta.operators import filters as FL
from veleta.operators import preprocess as P
from veleta.session import scratch_dir
from veleta.sources import csv, export, store
from veleta.sources import payload as PL
from veleta.sources.telemetry import hourly

QUERIES: dict[str, C.Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ["station_id", "timestamp", "seq"]
RAW = [*KEYS, *SENSORS]
RAW_SQL = ", ".join(RAW)


def _add(name: str, query: C.Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# --- 2.1 sources and sinks ---------------------------------------------------------------
def _csv(s, d):
    """Telemetry written as day-first CSV in ingest order, then loaded."""
    path = scratch_dir(s, "csv")
    text = hourly(s, d).select(
        F.date_format("timestamp", "dd-MM-yyyy HH:mm").alias("timestamp"), "station_id",
        F.concat(F.lit("Station "), "station_no").alias("station_name"), "latitude", "longitude", *SENSORS,
        "ground_truth_label", "fault_description", F.col("seq").alias("_seq"))
    text.repartitionByRange("_seq").sortWithinPartitions("_seq").drop("_seq").write.csv(path, header=True)
    return C.rounded(csv.load_raw(s, path).select("station_id", "timestamp", *SENSORS))


_add("src_csv", _csv,
     f"WITH {C.HOURLY} " + C.rounded_sql(
         f"SELECT station_id, timestamp, {', '.join(SENSORS)} FROM hourly QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq DESC) = 1", SENSORS))


def _store(s, d, rows, name: str) -> store.ObservationStore:
    made = store.ObservationStore(s, scratch_dir(s, name))
    made.insert_ignore(rows)
    return made


def _range(s, d):
    held = _store(s, d, C.grid(s, d), "range")
    return C.rounded(store.src_range(held, "2024-01-10 00:00:00", "2024-01-20 06:00:00", ["AWS_01", "AWS_08"]).select(*RAW))


_add("src_range", _range,
     f"WITH {C.GRID} " + C.rounded_sql(
         f"SELECT {RAW_SQL} FROM grid WHERE timestamp BETWEEN '2024-01-10' AND '2024-01-20 06:00:00' AND station_id IN ('AWS_01','AWS_08')", SENSORS))


def _sink_parquet(s, d):
    path = scratch_dir(s, "processed")
    export.sink_parquet(P.preprocess(C.obs(s, d), C.obs_layout(s, d)), path)
    return C.rounded(s.read.parquet(path).select(*KEYS, *[f"{c}_clean" for c in SENSORS]))


_add("sink_parquet", _sink_parquet,
     f"WITH {C.OBS_CLEAN} " + C.rounded_sql(f"SELECT station_id, timestamp, seq, {', '.join(f'{c}_clean' for c in SENSORS)} FROM cleaned", [f"{c}_clean" for c in SENSORS]))
HALF = "2024-01-16 00:00:00"


def _insert(s, d):
    """The late half first, then everything: stored keys stay as they are."""
    held = _store(s, d, hourly(s, d).filter(F.col("timestamp") > FL.time_literal(HALF)).withColumn("source", F.lit("late")), "insert")
    held.insert_ignore(hourly(s, d))
    return C.rounded(held.read().select(*RAW, "source"))


_add("sink_insert_ignore", _insert,
     f"WITH {C.GRID} " + C.rounded_sql(f"SELECT {RAW_SQL}, CASE WHEN timestamp > '{HALF}' THEN 'late' ELSE 'imd' END AS source FROM grid", SENSORS))


def _registry(s, d):
    rows = store.conform(C.grid(s, d)).drop("ingested_at").withColumn("station_name", F.when(F.col("timestamp") <= FL.time_literal(HALF), "early"))
    early = store.registry_of(FL.filter_time_station(rows, None, None, HALF))
    late = store.registry_of(rows.filter(F.col("timestamp") > FL.time_literal(HALF)))
    return store.registry_upsert(early, late).select("station_id", "station_name", "latitude", "longitude", "oldest_timestamp", "latest_timestamp", "records")


_add("sink_registry_upsert", _registry,
     f"""WITH {C.GRID}, e AS (SELECT DISTINCT station_id FROM grid WHERE timestamp <= '{HALF}') SELECT g.station_id, any_value(CASE WHEN e.station_id IS NOT NULL THEN 'early' END) AS station_name,
     arg_min(latitude, (timestamp, seq)) AS latitude, arg_min(longitude, (timestamp, seq)) AS longitude, min(timestamp) AS oldest_timestamp, max(timestamp) AS latest_timestamp,
     count(*) AS records FROM grid g LEFT JOIN e USING (station_id) WHERE timestamp > '{HALF}' GROUP BY g.station_id""")


def _shipments(s, d):
    """Line items as observations of many years: a supplier is a station."""
    return s.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").alias("temperature_c"))


SHIP = "ship AS (SELECT concat('S', l_suppkey) AS station_id, l_shipdate AS timestamp, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS temperature_c FROM lineitem)"


def _export_year(s, d):
    path = scratch_dir(s, "years")
    export.sink_export_year(_shipments(s, d), path)
    return s.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("seq").alias("seq_sum"))


_add("sink_export_year", _export_year, f"WITH {SHIP} SELECT year(timestamp)::INT AS year, count(*) AS n_rows, sum(seq)::BIGINT AS seq_sum FROM ship GROUP BY 1")
_add("export_plan", lambda s, d: export.export_plan(_shipments(s, d)),
     f"WITH {SHIP} SELECT year(timestamp)::INT AS year, count(*) AS n_rows, ceil(count(*) / 500000.0)::BIGINT AS parts FROM ship GROUP BY 1")


def _export_filtered(s, d):
    path = scratch_dir(s, "filtered")
    export.sink_export_filtered(C.obs(s, d).select(*RAW), path, "AWS_05", "2024-01-03 00:00:00", "2024-01-25 00:00:00")
    back = s.read.csv(path, header=True, schema="station_id STRING, timestamp TIMESTAMP_NTZ, seq LONG, " + ", ".join(f"{c} DOUBLE" for c in SENSORS))
    return C.rounded(back.withColumn("timestamp", F.date_trunc("second", "timestamp").cast("timestamp_ntz")))


_add("sink_export_filtered", _export_filtered,
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT * REPLACE (date_trunc('second', timestamp)::TIMESTAMP AS timestamp) FROM (SELECT {RAW_SQL} FROM obs WHERE station_id = 'AWS_05' AND timestamp BETWEEN '2024-01-03' AND '2024-01-25')", SENSORS))


def _refresh(s, d):
    """Light shipments are exported; then one year is refreshed with every shipment."""
    path = scratch_dir(s, "refresh")
    export.sink_export_year(_shipments(s, d).filter(F.col("temperature_c") < 25), path)
    export.sink_refresh_year(_shipments(s, d), path, 1998)
    return s.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


_add("sink_refresh_year", _refresh, f"WITH {SHIP} SELECT year(timestamp)::INT AS year, count(*) AS n_rows FROM ship WHERE temperature_c < 25 OR year(timestamp) = 1998 GROUP BY 1")
START, END = "1995-01-01 00:00:00", "2002-01-01 00:00:00"
_add("backfill_chunks", lambda s, d: store.backfill_chunks(_shipments(s, d), START, END),
     f"""WITH {SHIP}, u AS (SELECT DISTINCT station_id, timestamp FROM ship WHERE timestamp >= '{START}' AND timestamp < '{END}'),
     c AS (SELECT *, floor((epoch_us(timestamp) - epoch_us(TIMESTAMP '{START}')) / (30 * 86400000000))::BIGINT AS chunk FROM u),
     f AS (SELECT chunk, count(*) AS k FROM (SELECT station_id, min(chunk) AS chunk FROM c GROUP BY 1) GROUP BY 1), n AS (SELECT chunk, count(*) AS new_records FROM c GROUP BY 1),
     t AS (SELECT date_diff('day', TIMESTAMP '{START}', TIMESTAMP '{END}') AS days)
     SELECT chunk, new_records, (sum(new_records) OVER (ORDER BY chunk))::BIGINT AS records_inserted, (sum(coalesce(k, 0)) OVER (ORDER BY chunk))::BIGINT AS stations_discovered,
     round(least(100.0::DOUBLE, least((chunk + 1) * 30, days) * 100.0::DOUBLE / days), 1) AS progress FROM n LEFT JOIN f USING (chunk), t""")



def _backfill(s, d):
    """Into a fresh store: stopped within a chunk, then taken up to the end of the span."""
    fresh = store.ObservationStore(s, scratch_dir(s, "backfill"))
    first, stop, last = (dt.datetime.fromisoformat(t) for t in (START, "1997-07-15 00:00:00", END))
    provider = lambda first, after: FL.filter_time_station(_shipments(s, d), None, first, after)
    store.Backfill(fresh, first, stop).run(provider)
    whole = store.Backfill(fresh, first, last)
    whole.run(provider)
    return whole.progress()


_add("backfill", _backfill,
     f"""WITH {SHIP}, u AS (SELECT DISTINCT station_id, timestamp FROM ship WHERE timestamp >= '{START}' AND timestamp < '{END}'),
     c AS (SELECT *, floor((epoch_us(timestamp) - epoch_us(TIMESTAMP '{START}')) / (30 * 86400000000))::BIGINT AS chunk FROM u),
     f AS (SELECT chunk, count(*) AS k FROM (SELECT station_id, min(chunk) AS chunk FROM c GROUP BY 1) GROUP BY 1), n AS (SELECT chunk, count(*) AS k FROM c GROUP BY 1),
     t AS (SELECT date_diff('day', TIMESTAMP '{START}', TIMESTAMP '{END}') AS days), g AS (SELECT unnest(generate_series(0, ((days - 1) // 30)::BIGINT)) AS chunk, days FROM t)
     SELECT chunk, coalesce(n.k, 0) AS new_records, (sum(coalesce(n.k, 0)) OVER (ORDER BY chunk))::BIGINT AS records_inserted, (sum(coalesce(f.k, 0)) OVER (ORDER BY chunk))::BIGINT AS stations_discovered,
     round(least(100.0::DOUBLE, least((chunk + 1) * 30, days) * 100.0::DOUBLE / days), 1) AS progress FROM g LEFT JOIN n USING (chunk) LEFT JOIN f USING (chunk)""")


def _fixed(s, d):
    """A tenth of the stations sits at (0, 0) and one is far north before the fix."""
    rows = C.obs(s, d).withColumns(
        {"latitude": F.when(F.col("station_no") % 10 == 3, 0.0).when(F.col("station_no") == 4, 59.0).otherwise(F.col("latitude")),
         "longitude": F.when(F.col("station_no") % 10 == 3, 0.0).otherwise(F.col("longitude"))})
    fixed = store.fix_coords_update(rows, "AWS_07", 26.1175, 92.0835)
    return fixed.select("station_id", "seq", "latitude", "longitude", store.outside_box(COUNTRY_BOX).alias("outside"))


_add("fix_coords_update", _fixed,
     f"WITH {C.OBS} SELECT station_id, seq, CASE WHEN station_no % 10 = 3 OR station_no = 7 THEN 26.1175::DOUBLE WHEN station_no = 4 THEN 59.0::DOUBLE ELSE latitude END AS latitude, "
     "CASE WHEN station_no % 10 = 3 OR station_no = 7 THEN 92.0835::DOUBLE ELSE longitude END AS longitude, station_no = 4 AS outside FROM obs")

# --- 2.2 normalisation -------------------------------------------------------------------
# The telemetry view as raw records with mixed names, units, time layouts and markers.
RECORD = """
CASE seq % 4
WHEN 0 THEN map('ID', station_id, 'STATION', concat('Post ', station_no), 'DISTRICT', CASE WHEN station_no % 3 = 0 THEN 'JORHAT' ELSE 'NA' END,
  'STATE', CASE WHEN station_no % 6 = 0 THEN 'ASSAM' ELSE '-' END, 'DATE', date_format(timestamp, 'dd-MM-yyyy'), 'TIME', date_format(timestamp, 'HH:mm:ss'),
  'CURR_TEMP', coalesce(cast(temperature_c AS STRING), 'NA'), 'RH', coalesce(cast(relative_humidity_pct AS STRING), '-999.0'), 'MSLP', cast(pressure_hpa AS STRING),
  'WIND_SPEED', cast(wind_speed_kmh AS STRING), 'RAINFALL', cast(rainfall_mm AS STRING), 'Latitude', cast(latitude AS STRING), 'Longitude', cast(longitude AS STRING),
  'FEEL_LIKE', cast(temperature_c + 1 AS STRING), 'WEATHER MESSAGE', ground_truth_label)
WHEN 1 THEN map('station_id', concat(' ', station_id, ' '), 'timestamp', date_format(timestamp, 'yyyy-MM-dd HH:mm:ss'), 'temperature', coalesce(cast(floor(temperature_c) * 9 + 212 AS STRING), 'null'),
  'humidity', coalesce(cast(relative_humidity_pct AS STRING), ''), 'pressure', cast(pressure_hpa * 100 AS STRING), 'wind_speed_ms', cast(wind_speed_kmh / 3.6D AS STRING),
  'rainfall_cm', cast(floor(rainfall_mm * 10) / 100D AS STRING), 'lat', cast(latitude AS STRING), 'lon', cast(longitude AS STRING), 'wind_direction', cast(seq % 360 AS STRING))
WHEN 2 THEN map('Station Code', station_id, 'datetime', cast(unix_seconds(cast(timestamp AS TIMESTAMP)) AS STRING), 'temp_c', coalesce(cast(temperature_c AS STRING), '-'),
  'rh_pct', coalesce(cast(relative_humidity_pct AS STRING), 'nil'), 'pres', '9999', 'wind_speed_knots', cast(wind_speed_kmh / 1.852D AS STRING), 'rain', '-888', 'lat', '0', 'lon', '0.0',
  'state', CASE WHEN station_no % 2 = 0 THEN 'Assam' ELSE 'Goa' END, 'place', 'Nagaon')
ELSE map('sid', CASE WHEN seq % 40 = 3 THEN '--' ELSE station_id END, 'observed_at', cast(unix_millis(cast(timestamp AS TIMESTAMP)) AS STRING), 't', coalesce(cast(temperature_c AS STRING), '-9999'),
  'hum', coalesce(cast(relative_humidity_pct AS STRING), 'missing'), 'p', cast(pressure_hpa / 33.8639D AS STRING), 'wspd', 'n/a', 'pr', cast(rainfall_mm AS STRING), 'latitude', 'missing', 'lng', '77.1')
END
"""
WRAPPED = """
CASE seq % 4 WHEN 0 THEN concat('[', r, ']') WHEN 1 THEN concat('{"status":"ok","data":[', r, ']}') WHEN 2 THEN concat('{"data":"none","items":[', r, ']}') ELSE r END
"""


def _payloads(s, d):
    rows = C.obs(s, d).selectExpr("seq", "station_no", f"to_json({RECORD}) AS r")
    return rows.selectExpr("seq", f"{WRAPPED} AS payload")


def _records(s, d):
    return PL.src_payload(_payloads(s, d))


def _typed(s, d):
    return PL.normalize_records(_records(s, d), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


def _keyed(s, d):
    return staged(_records(s, d).select("seq", PL.norm_keys(F.col("raw")).alias("m")), "keyed")


# Which records keep an id; a null reading makes its JSON entry null except where replaced.
DROPPED = "seq % 4 = 3 AND seq % 40 = 3"
# Records of the first kind with a missing temperature carry a null feel_like entry.
_add("src_payload", lambda s, d: _records(s, d).select("seq", "record_no", F.size("raw").alias("n_fields")),
     f"WITH {C.OBS} SELECT seq, 0 AS record_no, CASE seq % 4 WHEN 0 THEN 15 WHEN 1 THEN 10 WHEN 2 THEN 11 ELSE 9 END AS n_fields FROM obs")
_add("norm_keys", lambda s, d: _keyed(s, d).select("seq", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names")),
     f"""WITH {C.OBS} SELECT seq, CASE seq % 4 WHEN 0 THEN 'curr_temp,date,district,feel_like,id,latitude,longitude,mslp,rainfall,rh,state,station,time,weather_message,wind_speed'
     WHEN 1 THEN 'humidity,lat,lon,pressure,rainfall_cm,station_id,temperature,timestamp,wind_direction,wind_speed_ms'
     WHEN 2 THEN 'datetime,lat,lon,place,pres,rain,rh_pct,state,station_code,temp_c,wind_speed_knots' ELSE 'hum,latitude,lng,observed_at,p,pr,sid,t,wspd' END AS names FROM obs""")
_add("norm_alias_id", lambda s, d: _keyed(s, d).select("seq", first_usable(F.col("m"), ALIASES["station_id"]).alias("station_id")),
     f"WITH {C.OBS} SELECT seq, CASE WHEN NOT ({DROPPED}) THEN station_id END AS station_id FROM obs")
_add("norm_alias_sensor", lambda s, d: _keyed(s, d).select("seq", first_present(F.col("m"), ALIASES["pressure_hpa"]).isNotNull().alias("has_pressure"),
                                                          first_present(F.col("m"), ALIASES["wind_speed_kmh"]).isin("n/a").alias("wind_marker")),
     f"WITH {C.OBS} SELECT seq, true AS has_pressure, seq % 4 = 3 AS wind_marker FROM obs")
NUM = "CASE seq % 4 WHEN 0 THEN temperature_c WHEN 1 THEN floor(temperature_c) * 9 + 212 ELSE temperature_c END"
_add("norm_number", lambda s, d: C.rounded(_keyed(s, d).select("seq", parse_number(first_present(F.col("m"), ALIASES["temperature_c"])).alias("temperature"),
                                                             parse_number(first_present(F.col("m"), ALIASES["rainfall_mm"])).alias("rain"))),
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT seq, {NUM} AS temperature, CASE seq % 4 WHEN 1 THEN floor(rainfall_mm * 10) / 100 WHEN 2 THEN NULL ELSE rainfall_mm END AS rain FROM obs", ["temperature", "rain"]))
# "-888" is a marker as text; as a number it would be kept.
_add("norm_timestamp", lambda s, d: _typed(s, d).select("seq", "timestamp"),
     f"WITH {C.OBS} SELECT seq, date_trunc('second', timestamp)::TIMESTAMP AS timestamp FROM obs WHERE NOT ({DROPPED})")
# Every layout of the text, by turns: zones, fractions, one-digit fields, month names, a missing and an unreadable one.
LAYOUTS = """
CASE seq % 12
WHEN 0 THEN date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 1 THEN date_format(timestamp + INTERVAL '5:30' HOUR TO MINUTE, "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
WHEN 2 THEN date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS") WHEN 3 THEN date_format(timestamp, 'dd-MM-yyyy H:mm') WHEN 4 THEN date_format(timestamp, 'd-M-yyyy HH:mm:ss')
WHEN 5 THEN date_format(timestamp, 'dd MMM yyyy HH:mm') WHEN 6 THEN date_format(timestamp, 'd MMMM yyyy HH:mm:ss') WHEN 7 THEN date_format(timestamp, 'yyyy-M-d H:mm:ss')
WHEN 8 THEN date_format(timestamp, 'd/M/yyyy') WHEN 9 THEN 'NA' WHEN 10 THEN '2024-13-45 99:00' ELSE date_format(timestamp, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END
"""


def _layouts(s, d):
    raw = C.obs(s, d).selectExpr("seq", f"map('sid', station_id, 'timestamp', {LAYOUTS}) AS raw")
    typed = PL.normalize_records(raw, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return typed.select("seq", "timestamp", F.col("timestamp").isNull().alias("quarantined"))


_add("norm_timestamp_layouts", _layouts,
     f"""WITH {C.OBS}, t AS (SELECT seq, CASE WHEN seq % 12 IN (3, 5) THEN date_trunc('minute', timestamp) WHEN seq % 12 = 2 THEN date_trunc('millisecond', timestamp)
     WHEN seq % 12 = 8 THEN date_trunc('day', timestamp) WHEN seq % 12 = 9 THEN TIMESTAMP '2024-02-01' WHEN seq % 12 = 10 THEN NULL WHEN seq % 12 = 11 THEN timestamp
     ELSE date_trunc('second', timestamp) END::TIMESTAMP AS timestamp FROM obs) SELECT *, timestamp IS NULL AS quarantined FROM t""")
_add("norm_station_name", lambda s, d: _typed(s, d).select("seq", "station_name"),
     f"""WITH {C.OBS} SELECT seq, CASE seq % 4 WHEN 0 THEN concat('Post ', station_no, CASE WHEN station_no % 6 = 0 THEN ' (JORHAT, ASSAM)' WHEN station_no % 3 = 0 THEN ' (JORHAT)' ELSE '' END)
     WHEN 2 THEN 'Nagaon' ELSE concat('IMD AWS ', station_id) END AS station_name FROM obs WHERE NOT ({DROPPED})""")
_add("norm_coord_repair", lambda s, d: C.rounded(_typed(s, d).select("seq", "latitude", "longitude")),
     f"""WITH {C.OBS} SELECT seq, CASE seq % 4 WHEN 2 THEN CASE WHEN station_no % 2 = 0 THEN 26.2006::DOUBLE ELSE 26.35::DOUBLE END WHEN 3 THEN 20.5937::DOUBLE ELSE latitude END AS latitude,
     CASE seq % 4 WHEN 2 THEN CASE WHEN station_no % 2 = 0 THEN 92.9376::DOUBLE ELSE 92.68::DOUBLE END WHEN 3 THEN 78.9629::DOUBLE ELSE longitude END AS longitude FROM obs WHERE NOT ({DROPPED})""")
UNITS = {
    "temperature_c": "CASE WHEN seq % 4 = 1 THEN floor(temperature_c) * 5 + 100 ELSE temperature_c END",
    "relative_humidity_pct": "relative_humidity_pct",
    "pressure_hpa": "CASE WHEN seq % 4 = 2 THEN NULL WHEN seq % 4 = 3 AND pressure_hpa / 33.8639::DOUBLE < 20 THEN pressure_hpa / 33.8639::DOUBLE ELSE pressure_hpa END",
    "wind_speed_kmh": "CASE WHEN seq % 4 = 3 THEN NULL ELSE wind_speed_kmh END",
    "rainfall_mm": "CASE seq % 4 WHEN 1 THEN floor(rainfall_mm * 10) / 10 WHEN 2 THEN NULL ELSE rainfall_mm END",
}



def _units_sql(defaults: bool) -> str:
    default = {"temperature_c": 25.0, "relative_humidity_pct": 50.0, "pressure_hpa": 1013.25, "wind_speed_kmh": 0.0, "rainfall_mm": 0.0}
    cols = [f"coalesce({e}, {default[c]}::DOUBLE) AS {c}" if defaults else f"{e} AS {c}" for c, e in UNITS.items()]
    where = f" WHERE NOT ({DROPPED})" if defaults else ""
    return f"SELECT seq, {', '.join(cols)} FROM obs{where}"


# Converted values carry two decimals, so they agree to one decimal within rounding; compare
# whole tenths shifted off the tie.
def _tenths(df):
    return df.select("seq", *[(F.floor(F.col(c) * 10 + 0.5213) / 10.0).alias(c) for c in SENSORS])


def _tenths_sql(sql: str) -> str:
    return "SELECT seq, " + ", ".join(f"floor({c} * 10 + 0.5213::DOUBLE) / 10 AS {c}" for c in SENSORS) + f" FROM ({sql})"


_add("norm_units", lambda s, d: _tenths(_keyed(s, d).select("seq", *[v.alias(k) for k, v in PL.norm_units(F.col("m")).items()])), f"WITH {C.OBS} {_tenths_sql(_units_sql(False))}")
_add("norm_defaults", lambda s, d: _tenths(_typed(s, d)), f"WITH {C.OBS} {_tenths_sql(_units_sql(True))}")
_add("norm_optional", lambda s, d: C.rounded(_typed(s, d).select("seq", "wind_direction", "weather_message", "feel_like", (F.length("raw_observation") > 2).alias("raw_kept"))),
     f"WITH {C.OBS} " + C.rounded_sql(
         f"SELECT seq, CASE WHEN seq % 4 = 1 THEN (seq % 360)::DOUBLE END AS wind_direction, CASE WHEN seq % 4 = 0 THEN ground_truth_label END AS weather_message, "
         f"CASE WHEN seq % 4 = 0 THEN temperature_c + 1 END AS feel_like, true AS raw_kept FROM obs WHERE NOT ({DROPPED})", ["wind_direction", "feel_like"]))
_add("norm_batch", lambda s, d: PL.norm_batch(_records(s, d).unionByName(_records(s, d).withColumn("seq", F.col("seq") + 1_000_000_000)), F.lit("2024-02-01").cast("timestamp_ntz"))[0].select(*KEYS),
     f"WITH {C.OBS}, o AS (SELECT station_id, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, seq FROM obs WHERE NOT ({DROPPED})) "
     "SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY station_id, timestamp ORDER BY seq) = 1")
_IN = " AND ".join(f"coalesce({c} BETWEEN {lo} AND {hi}, false)" for c, (lo, hi) in REQUEST_BOUNDS.items())
_add("filter_request_bounds", lambda s, d: C.rounded(FL.filter_request_bounds(C.obs(s, d))[0].select(*RAW)),
     f"WITH {C.OBS} " + C.rounded_sql(f"SELECT {RAW_SQL} FROM obs WHERE {_IN}", SENSORS))
_add("quarantine_request_bounds", lambda s, d: FL.filter_request_bounds(C.obs(s, d))[1].select(*KEYS),
     f"WITH {C.OBS} SELECT station_id, timestamp, seq FROM obs WHERE NOT ({_IN})")
