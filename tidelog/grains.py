"""Pre-aggregated grains of a log, from which the feature operators derive.

The raw log is read for three shuffles: (location, user, hour), (location,
file, user) and the time-ordered rows of a location. Everything coarser is
derived from the first, or of kept grains from two small tables, hours and users.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.storage import tabled


class Grains:
    """Lazy grains of canonical events; keep() has those of hours and users written once for many readers."""

    def __init__(self, events: DataFrame, min_year: int | None = None):
        sound = F.col("geo_location").isNotNull() & F.col("ts").isNotNull()
        if min_year is not None:
            # A range on the bare column reaches the scan; a year extracted from it would not.
            sound = sound & (F.col("ts") >= F.lit(f"{min_year:04d}-01-01 00:00:00").cast("timestamp_ntz"))
        self.events = events.where(sound)
        self._kept = False

    def keep(self) -> Grains:
        self._kept = True
        return self

    @cached_property
    def hour_user(self) -> DataFrame:
        """geo_location, usr, hour: n events."""
        rows = self.events.groupBy("geo_location", "usr", F.date_trunc("hour", "ts").alias("hour"))
        return rows.agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def hours(self) -> DataFrame:
        """geo_location, hour: n events, users.

        Kept ones shuffle the log once, by location and hour: within an hour users meet, and what is
        written has a row an hour.
        """
        rows = self.hour_user
        if self._kept:
            rows = self.events.select("geo_location", "usr", F.date_trunc("hour", "ts").alias("hour"))
            # As many parts as the session asks for: put together by bytes, they hold more users than a task keeps in memory.
            parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.repartition(parts, "geo_location", "hour")
            rows = rows.groupBy("geo_location", "hour", "usr").agg(F.count(F.lit(1)).alias("n"))
        out = rows.groupBy("geo_location", "hour").agg(F.sum("n").alias("n"), F.count("usr").alias("users"))
        return tabled(out) if self._kept else out

    @cached_property
    def sizes(self) -> DataFrame:
        """geo_location: n events; kept ones are a small table of known size."""
        out = (self.hours if self._kept else self.hour_user).groupBy("geo_location").agg(F.sum("n").alias("n"))
        return tabled(out) if self._kept else out

    @property
    def _timed(self) -> DataFrame:
        """Rows of which each is in one hour: n events."""
        return self.hours if self._kept else self.hour_user

    @property
    def kept(self) -> bool:
        return self._kept

    def bucket(self, unit: str) -> DataFrame:
        """geo_location, at (start of the day, week or month): n events, users."""
        at = F.date_trunc(unit, "ts" if self._kept else "hour").alias("at")
        n = F.count(F.lit(1)) if self._kept else F.sum("n")
        rows = (self.events if self._kept else self.hour_user).groupBy("geo_location", at, "usr").agg(n.alias("n"))
        return rows.groupBy("geo_location", "at").agg(F.sum("n").alias("n"), F.count("usr").alias("users"))

    @cached_property
    def days(self) -> DataFrame:
        return self._timed.groupBy("geo_location", F.date_trunc("day", "hour").alias("at")).agg(F.sum("n").alias("n"))

    @cached_property
    def weeks(self) -> DataFrame:
        return self._timed.groupBy("geo_location", F.date_trunc("week", "hour").alias("at")).agg(F.sum("n").alias("n"))

    @cached_property
    def years(self) -> DataFrame:
        return self._timed.groupBy("geo_location", F.year("hour").alias("year")).agg(F.sum("n").alias("n"))

    @cached_property
    def clock(self) -> DataFrame:
        """geo_location, h (0 to 23): n events."""
        return self._timed.groupBy("geo_location", F.hour("hour").alias("h")).agg(F.sum("n").alias("n"))

    @cached_property
    def users(self) -> DataFrame:
        """geo_location, usr: n events; null users are left out."""
        if self._kept:
            return tabled(self.events.where("usr IS NOT NULL").groupBy("geo_location", "usr").agg(F.count(F.lit(1)).alias("n")))
        return self.hour_user.where("usr IS NOT NULL").groupBy("geo_location", "usr").agg(F.sum("n").alias("n"))

    @cached_property
    def files(self) -> DataFrame:
        """geo_location, filename: n events, users; null files are left out."""
        rows = self.events.where("filename IS NOT NULL").groupBy("geo_location", "filename", "usr").agg(F.count(F.lit(1)).alias("n"))
        return rows.groupBy("geo_location", "filename").agg(F.sum("n").alias("n"), F.count("usr").alias("users"))

    @cached_property
    def countries(self) -> DataFrame:
        """geo_location, country: its most frequent country, of ties the least; null only without any other."""
        counts = self.events.groupBy("geo_location", "country").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct(F.col("country").isNull(), -F.col("n"), "country"))["country"]
        return counts.groupBy("geo_location").agg(best.alias("country"))
