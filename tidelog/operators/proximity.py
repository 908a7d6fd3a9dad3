"""Places within reach of each other on the globe, and groups of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import haversine, latitude, longitude
from tidelog.storage import settled

LOC = "geo_location"
RADIUS = 6371.0
#: Cells are this much wider than the distance, so that rounding loses no pair.
SLACK = 1e-6


def _grid(row: Column, height: float, km: float) -> Column:
    """How many cells of longitude a row of latitudes has, 1 at least.

    Two places within km of each other, one in the row and one in it or a
    neighbour, are at most a cell's width apart: sin(dlon / 2) is at most
    sin(km / 2R) over the least cosine of their latitudes.
    """
    edge = F.least(F.greatest(F.abs(row - 1), F.abs(row + 2)) * height, F.lit(90.0))
    reach = math.sin(min(km / RADIUS, math.pi) / 2) * (1 + SLACK)
    part = reach / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(part, F.lit(1.0)))) * (1 + SLACK)
    return F.greatest(F.floor(360.0 / width), F.lit(1))


def near_pairs(locations: DataFrame, km: float = 10.0) -> DataFrame:
    """(country, a, b, km) of places of a country within reach, a before b by name.

    Rows of latitude are as high as the distance; each is cut into cells of
    longitude that are as wide as it at their latitude, so they widen towards
    the poles, where a row is one cell in the end, and wrap at 180 degrees. A
    place meets those in its own cell and, in its own row and the two beside
    it, in the three cells about its longitude. Places that can't be parsed,
    or beyond 90 degrees of latitude, have no pairs; a null country is one.
    Rows that repeat a place count once.
    """
    height = math.degrees(km / RADIUS) * (1 + SLACK)
    rows = locations.select(LOC, "country", latitude(F.col(LOC)).alias("lat"), F.pmod(longitude(F.col(LOC)), F.lit(360.0)).alias("lon"))
    rows = rows.where("abs(lat) <= 90 AND lon IS NOT NULL AND NOT isnan(lon)").distinct()
    rows = rows.withColumn("row", F.floor(F.col("lat") / height))
    place = lambda row: F.least(F.floor(F.col("lon") / 360.0 * _grid(row, height, km)), _grid(row, height, km) - 1)
    own = rows.withColumn("cell", place(F.col("row")))
    near = rows.withColumn("row", F.explode(F.array(*[F.col("row") + i for i in (-1, 0, 1)])))
    cells = F.array_distinct(F.array(*[F.pmod(place(F.col("row")) + i, _grid(F.col("row"), height, km)) for i in (-1, 0, 1)]))
    near = near.withColumn("cell", F.explode(cells))
    a, b = own.alias("a"), near.alias("b")
    same = F.col("a.country").eqNullSafe(F.col("b.country")) & (F.col("a.row") == F.col("b.row")) & (F.col("a.cell") == F.col("b.cell"))
    distance = haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"), RADIUS)
    pairs = a.join(b, same & (F.col(f"a.{LOC}") < F.col(f"b.{LOC}")))
    return pairs.select(F.col("a.country").alias("country"), F.col(f"a.{LOC}").alias("a"), F.col(f"b.{LOC}").alias("b"), distance.alias("km")).where(F.col("km") <= km)


def proximity_groups(locations: DataFrame, km: float = 10.0) -> DataFrame:
    """(geo_location, country, group): places of a country within reach of a group's first place join it.

    Places are taken by most events, then name; the first that no group
    reaches starts one, and a place joins the first start that reaches it.
    That is settled in rounds: a place with no undecided earlier neighbour
    left starts a group, and its undecided neighbours are no starts. So there
    are as many rounds as the longest chain of neighbours whose starts wait
    for each other. Places that can't be parsed are groups of their own.
    Of rows that repeat a place the one of most events counts; no events
    count as 0.
    """
    key = F.struct(F.col("country").isNull().alias("none"), F.coalesce("country", F.lit("")).alias("country"), F.col(LOC).alias("place"))
    rows = locations.groupBy(LOC, "country").agg(F.max(F.coalesce("total_downloads", F.lit(0))).alias("n"))
    rows = settled(rows.select(key.alias("id"), (-F.col("n")).alias("n"), LOC, "country"))
    pairs = near_pairs(rows, km)
    end = lambda name: F.struct(F.col("country").isNull().alias("none"), F.coalesce("country", F.lit("")).alias("country"), F.col(name).alias("place"))
    order = rows.select("id", F.struct("n", "id").alias("at"))
    pairs = pairs.select(end("a").alias("a"), end("b").alias("b"))
    pairs = pairs.join(order.select(F.col("id").alias("a"), F.col("at").alias("x")), "a").join(order.select(F.col("id").alias("b"), F.col("at").alias("y")), "b")
    # Edges from the earlier to the later place.
    edges = settled(pairs.select(F.least("x", "y").alias("first"), F.greatest("x", "y").alias("then")))
    left, starts = edges, None
    waiting = edges.select(F.col("first").alias("at")).union(edges.select(F.col("then").alias("at"))).distinct()
    while not waiting.isEmpty():
        heads = settled(waiting.join(left.select(F.col("then").alias("at")).distinct(), "at", "left_anti"))
        starts = heads if starts is None else starts.unionByName(heads)
        reached = left.join(heads, left["first"] == heads["at"], "left_semi").select(F.col("then").alias("at")).distinct()
        decided = settled(heads.unionByName(reached))
        waiting = settled(waiting.join(decided, "at", "left_anti"))
        for end_of in ("first", "then"):
            left = left.join(decided, left[end_of] == decided["at"], "left_anti")
        left = settled(left)
    plain = rows.select("id", LOC, "country", F.col(LOC).alias("group"))
    if starts is None:
        return plain.drop("id")
    # A start has no earlier start as a neighbour, and any other place has one.
    joined = edges.join(starts, edges["first"] == starts["at"], "left_semi").groupBy(F.col("then.id").alias("id")).agg(F.min("first").alias("first"))
    found = plain.join(joined, "id", "left")
    return found.select(LOC, "country", F.coalesce(F.col("first.id.place"), F.col("group")).alias("group"))
