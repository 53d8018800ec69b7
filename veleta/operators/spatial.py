"""Nearest stations and features from neighbours' readings at the same time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veleta.functions.geo import distance_to_meridian_km, distance_to_parallel_km, haversine_km
from veleta.operators.series import ORDER, STATION, present_sensors, source_column

# Grid level j has cells of 360 / 2**j degrees; the finest is about a kilometre.
FINEST, COARSEST = 15, 1
# A site searches the coarsest level whose 3 x 3 block holds at most this many sites.
BLOCK_SITES = 512


def station_coords(df: DataFrame) -> DataFrame:
    """First coordinates of every station."""
    first = F.min_by(F.struct("latitude", "longitude"), F.struct(*ORDER))
    return df.groupBy(STATION).agg(first.alias("_at")).select(STATION, "_at.latitude", "_at.longitude")


def knn_stations(coords: DataFrame, k: int = 2) -> DataFrame:
    """(station_id, neighbour_id, rank, distance_km) of the k nearest stations, ties by id.

    Stations at one spot are folded into a site that keeps its k + 1 smallest ids. Sites look
    for neighbours in a 3 x 3 block of grid cells sized to the local density, and only those
    whose k-th neighbour may be beaten from outside the block go on to the next coarser level,
    so pairs are never formed across the whole network.
    """
    spot = ["latitude", "longitude"]
    by_id = Window.partitionBy(*spot).orderBy(STATION)
    sites = (
        coords.withColumn("_rn", F.row_number().over(by_id))
        .filter(F.col("_rn") <= k + 1)
        .groupBy(*spot)
        .agg(F.array_sort(F.collect_list(STATION)).alias("ids"))
        .persist()
    )
    if sites.count() <= BLOCK_SITES:
        searching = sites.select(*spot, F.lit(COARSEST).alias("level"))
    else:
        searching = _start_levels(sites)
    near = _nearest_sites(sites, searching, k)
    members = coords.join(sites, spot).select(
        STATION, *spot, F.explode("ids").alias("neighbour_id"), F.lit(0.0).alias("distance_km")
    )
    abroad = coords.join(near, spot).select(STATION, *spot, "neighbour_id", "distance_km")
    order = Window.partitionBy(STATION).orderBy("distance_km", "neighbour_id")
    return (
        members.filter(F.col(STATION) != F.col("neighbour_id"))
        .unionByName(abroad)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(STATION, "neighbour_id", "rank", "distance_km")
    )


def _size(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _cell(level: Column) -> tuple[Column, Column]:
    size = _size(level)
    rows = F.greatest(F.lit(1), F.floor(F.lit(180.0) / size))
    y = F.least(F.floor((F.col("latitude") + 90.0) / size), rows - 1)
    x = F.pmod(F.floor((F.col("longitude") + 180.0) / size), F.floor(F.lit(360.0) / size))
    return y.cast("int"), x.cast("int")


def _block(level: Column, y: Column, x: Column) -> Column:
    """The distinct cells of the 3 x 3 block; columns wrap around the date line."""
    across = F.pow(F.lit(2.0), level).cast("int")
    down = F.greatest(F.lit(1), (across / 2).cast("int"))
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    cells = F.array(*[F.struct((y + dy).alias("y"), F.pmod(x + dx, across).alias("x")) for dy, dx in steps])
    return F.array_distinct(F.filter(cells, lambda c: (c["y"] >= 0) & (c["y"] < down)))


def _at_every_level(sites: DataFrame) -> DataFrame:
    levels = F.explode(F.sequence(F.lit(COARSEST), F.lit(FINEST))).alias("level")
    placed = sites.select("*", levels)
    y, x = _cell(F.col("level"))
    return placed.withColumns({"y": y, "x": x})


def _start_levels(sites: DataFrame) -> DataFrame:
    cells = _at_every_level(sites).groupBy("level", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    blocks = (
        cells.select("level", "n", F.explode(_block(F.col("level"), F.col("y"), F.col("x"))).alias("c"))
        .groupBy("level", F.col("c.y").alias("y"), F.col("c.x").alias("x"))
        .agg(F.sum("n").alias("near"))
    )
    fits = F.min(F.when(F.col("near") <= BLOCK_SITES, F.col("level")))
    return (
        _at_every_level(sites.select("latitude", "longitude"))
        .join(blocks, ["level", "y", "x"])
        .groupBy("latitude", "longitude")
        .agg(F.coalesce(fits, F.lit(FINEST)).alias("level"))
    )


def _nearest_sites(sites: DataFrame, searching: DataFrame, k: int) -> DataFrame:
    """k nearest stations of other sites, level by level."""
    gridded = _at_every_level(sites).select(
        "level", "y", "x", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), "ids"
    )
    spot = ["latitude", "longitude"]
    results = []
    for _ in range(COARSEST, FINEST + 1):
        y, x = _cell(F.col("level"))
        probes = searching.select(*spot, "level", F.explode(_block(F.col("level"), y, x)).alias("c"))
        pairs = (
            probes.select(*spot, "level", "c.y", "c.x")
            .join(gridded, ["level", "y", "x"])
            .filter((F.col("latitude") != F.col("lat2")) | (F.col("longitude") != F.col("lon2")))
            .select(
                *spot,
                haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")).alias("distance_km"),
                F.explode("ids").alias("neighbour_id"),
            )
        )
        order = Window.partitionBy(*spot).orderBy("distance_km", "neighbour_id")
        best = pairs.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
        reach = best.groupBy(*spot).agg(F.count(F.lit(1)).alias("_n"), F.max("distance_km").alias("_far"))
        judged = searching.join(reach, spot, "left").withColumn(
            "_done",
            (F.col("level") <= COARSEST)
            | F.coalesce((F.col("_n") >= k) & (F.col("_far") < _safe_km()), F.lit(False)),
        ).persist()
        results.append(best.join(judged.filter("_done").select(*spot), spot).drop("_rn"))
        searching = judged.filter(~F.col("_done")).select(*spot, (F.col("level") - 1).alias("level"))
        if searching.isEmpty():
            break
    return reduce(DataFrame.unionByName, results)


def _safe_km() -> Column:
    """Distance within which nothing outside the site's 3 x 3 block can lie."""
    level, lat, lon = F.col("level"), F.col("latitude"), F.col("longitude")
    size = _size(level)
    up = (lat + 90.0) - F.floor((lat + 90.0) / size) * size
    along = (lon + 180.0) - F.floor((lon + 180.0) / size) * size
    lat_margin = size + F.least(up, size - up)
    lon_margin = F.least(size + F.least(along, size - along), F.lit(89.9))
    return F.least(distance_to_parallel_km(lat_margin), distance_to_meridian_km(lat, lon_margin))


def neighbour_stats(df: DataFrame, neighbours: DataFrame, sensors: Sequence[str], small_network: bool) -> DataFrame:
    """Mean and deviation of the neighbours' readings for every (station, timestamp).

    Each reading is sent to the stations it is a neighbour of, so one aggregation, combined
    map-side, replaces a self join of the observations.
    """
    edges = neighbours.select(F.col("neighbour_id").alias("_from"), F.col(STATION).alias("_to"))
    edges = F.broadcast(edges) if small_network else edges
    readings = df.select(
        F.col(STATION).alias("_from"), "timestamp", *[F.col(source_column(df, s)).alias(s) for s in sensors]
    )
    return (
        readings.join(edges, "_from")
        .groupBy(F.col("_to").alias(STATION), "timestamp")
        .agg(
            *[F.avg(s).alias(f"neighbor_{s}_mean") for s in sensors],
            *[F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias(f"neighbor_{s}_std") for s in sensors],
        )
    )


def add_spatial_features(
    df: DataFrame, neighbours: DataFrame, sensors: Sequence[str] | None = None, small_network: bool = False
) -> DataFrame:
    """Neighbour statistics, residuals and agreement; keys of ``df`` must be unique."""
    names = present_sensors(df, sensors)
    stats = neighbour_stats(df, neighbours, names, small_network)
    nearest = neighbours.filter(F.col("rank") == 1).select(
        STATION, F.col("distance_km").alias("nearest_station_distance_km")
    )
    nearest = F.broadcast(nearest) if small_network else nearest
    joined = df.join(nearest, STATION, "left").join(stats, [STATION, "timestamp"], "left")
    has_neighbour = F.col("nearest_station_distance_km").isNotNull()
    joined = joined.withColumns(
        {
            f"neighbor_{s}_std": F.when(has_neighbour, F.coalesce(F.col(f"neighbor_{s}_std"), F.lit(0.0)))
            for s in names
        }
    )
    joined = joined.withColumns(
        {f"spatial_{s}_residual": F.col(source_column(df, s)) - F.col(f"neighbor_{s}_mean") for s in names}
    )
    return joined.withColumn("neighbor_agreement_score", agreement(names))


def agreement(sensors: Sequence[str]) -> Column:
    """Mean absolute spatial residual over the sensors that have one; low means agreement."""
    sizes = [F.abs(F.col(f"spatial_{s}_residual")) for s in sensors]
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in sizes])
    present = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in sizes])
    return F.when(present > 0, total / present)
