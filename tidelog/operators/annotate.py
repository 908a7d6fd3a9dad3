"""Labels joined back onto the log, and the clean subset of it.

Whether labels are broadcast is left to adaptive execution, which knows
their size in bytes once they are computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOC = "geo_location"


def annotate(events: DataFrame, labels: DataFrame, location: str = LOC) -> DataFrame:
    """events with is_bot, is_hub, is_organic; an unknown or null location is organic.

    labels has one row a location, so events keep their number.
    """
    own = labels.select(F.col(LOC).alias("_loc"), "is_bot", "is_hub", "is_organic").dropDuplicates(["_loc"])
    out = events.drop("is_bot", "is_hub", "is_organic").join(own, F.col(location) == F.col("_loc"), "left").drop("_loc")
    return out.fillna({"is_bot": False, "is_hub": False, "is_organic": True})


def annotate_sets(events: DataFrame, bots: DataFrame, hubs: DataFrame, location: str = LOC) -> DataFrame:
    """events with is_bot and is_hub from two sets of locations; is_organic is neither."""
    mark = lambda df, name: df.select(F.col(LOC).alias(f"_{name}")).distinct()
    out = events.join(mark(bots, "b"), F.col(location) == F.col("_b"), "left")
    out = out.join(mark(hubs, "h"), F.col(location) == F.col("_h"), "left")
    out = out.withColumn("is_bot", F.col("_b").isNotNull()).withColumn("is_hub", F.col("_h").isNotNull())
    return out.withColumn("is_organic", ~F.col("is_bot") & ~F.col("is_hub")).drop("_b", "_h")


def clean(events: DataFrame, labels: DataFrame, location: str = LOC) -> DataFrame:
    """Events of labelled locations that aren't bots; labels has final_label or is_bot."""
    bot = F.lower("final_label") == "bot" if "final_label" in labels.columns else F.col("is_bot").cast("boolean")
    keep = labels.where(~F.coalesce(bot, F.lit(False))).select(F.col(LOC).alias("_loc")).distinct()
    return events.join(keep, F.col(location) == F.col("_loc"), "left_semi")
