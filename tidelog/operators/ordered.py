"""Per-location features that depend on the order of events, on files, or on users' files."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import EPSILON, ratio, seconds_between
from tidelog.grains import Grains
from tidelog.operators.order import places, quantiles_of
from tidelog.storage import settled, tabled

LOC = "geo_location"
SESSION_GAP = 1800


def _by_time():
    return Window.partitionBy(LOC).orderBy("ts", "event_id")


def sampled(g: Grains, most: int) -> DataFrame:
    """At most so many events of each location, those of lowest hash of their id.

    Of kept grains a location's number of events is known, and with it a bound on the hash below
    which far more than the wanted events are to be expected; only those are ordered. Locations
    that have fewer of them all the same are read again without a bound.
    """
    by_hash = Window.partitionBy(LOC).orderBy("_h", "event_id")
    first = lambda df: df.withColumn("_r", F.row_number().over(by_hash)).where(F.col("_r") <= most)
    rows = g.events.select(LOC, "ts", "event_id", F.md5(F.col("event_id").cast("string")).alias("_h"))
    if g.kept:
        share = F.lit(float(most + 8 * math.sqrt(most) + 40)) / F.col("n")
        sizes = g.sizes.select(F.col(LOC).alias("_loc"), F.least("n", F.lit(most)).alias("_k"), F.lower(F.lpad(F.hex(F.floor(share * (1 << 32))), 8, "0")).alias("_bound"), (share < 1).alias("_cut"))
        below = rows.join(sizes, F.col(LOC) == F.col("_loc")).where(~F.col("_cut") | (F.col("_h") < F.col("_bound"))).drop("_loc", "_bound", "_cut")
        below = tabled(first(below))
        found = below.groupBy(F.col(LOC).alias("_loc")).agg(F.max("_r").alias("_n"))
        short = tabled(sizes.join(found, "_loc", "left").where(F.coalesce("_n", F.lit(0)) < F.col("_k")).select("_loc"))
        if short.isEmpty():
            return below.select(LOC, "ts", "event_id")
        again = first(rows.join(short, F.col(LOC) == F.col("_loc"), "left_semi"))
        kept = below.join(short, F.col(LOC) == F.col("_loc"), "left_anti")
        return kept.select(LOC, "ts", "event_id").unionByName(again.select(LOC, "ts", "event_id"))
    return first(rows).select(LOC, "ts", "event_id")


def timing_precision(g: Grains, most: int = 100) -> DataFrame:
    """Intervals between sampled events: their usual length, round seconds, milliseconds, evenness."""
    rows = sampled(g, most).withColumn("gap", seconds_between(F.lag("ts").over(_by_time()), F.col("ts")))
    rows = rows.where((F.col("gap") > 0) & (F.col("gap") < 86400))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.select(
        LOC, "gap", F.second("ts").alias("s"), F.floor(F.pmod(micros, F.lit(60_000_000)) / 1000).alias("ms")
    )
    found = rows.groupBy(LOC).agg(
        F.avg(F.when(F.col("s").isin(0, 15, 30, 45), 1.0).otherwise(0.0)).alias("round_second_ratio"),
        F.var_samp("ms").alias("millisecond_variance"),
        F.avg("gap").alias("mean"),
        F.stddev_samp("gap").alias("sd"),
        F.count(F.lit(1)).alias("k"),
    )
    bins = rows.groupBy(LOC, (F.round(F.col("gap") / 10) * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    usual = bins.groupBy(LOC).agg(F.min(F.struct(-F.col("n"), "bin"))["bin"].alias("request_interval_mode"))
    out = found.where("k >= 5").join(usual, LOC)
    out = out.select(
        LOC,
        "request_interval_mode",
        "round_second_ratio",
        "millisecond_variance",
        F.log2(F.greatest(F.col("sd") / F.col("mean") + 1, F.lit(1.0))).alias("interval_entropy"),
    )
    every = g.sizes.select(LOC).join(out, LOC, "left")
    return every.fillna(
        {"request_interval_mode": 0.0, "round_second_ratio": 0.25, "millisecond_variance": 250000.0, "interval_entropy": 1.0}
    )


def sessions(g: Grains, gap: int = SESSION_GAP) -> DataFrame:
    """One row per session: a gap of more than so many seconds starts a new one.

    Events are cut into parts of sessions a day at a time, so that a location's
    log is dealt over many tasks; parts that midnight divides are then put
    together. A day has at most one part more than gaps that fit into it, so
    the second step sees few rows whatever the size of the log.
    """
    by_day = Window.partitionBy(LOC, "day").orderBy("ts")
    rows = g.events.select(LOC, "ts", F.to_date("ts").alias("day"))
    rows = rows.withColumn("_gap", seconds_between(F.lag("ts").over(by_day), F.col("ts")))
    rows = rows.withColumn("_part", F.sum(F.when(F.col("_gap") > gap, 1).otherwise(0)).over(by_day))
    parts = rows.groupBy(LOC, "day", "_part").agg(
        F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.min(F.hour("ts")).alias("hour"), F.count(F.lit(1)).alias("n")
    )
    by_time = Window.partitionBy(LOC).orderBy("_from")
    parts = parts.withColumn("_gap", seconds_between(F.lag("_to").over(by_time), F.col("_from")))
    starts = F.when(F.col("_gap").isNull() | (F.col("_gap") > gap), 1).otherwise(0)
    parts = parts.withColumn("session", F.sum(starts).over(by_time))
    return parts.groupBy(LOC, "session").agg(
        F.min("hour").alias("hour"),
        F.sum("n").alias("n"),
        seconds_between(F.min("_from"), F.max("_to")).alias("duration"),
        F.max(F.when(F.col("_gap") > gap, F.col("_gap"))).alias("before"),
    )


def session_behavior(g: Grains, gap: int = SESSION_GAP) -> DataFrame:
    """Spread of session lengths and sizes, evenness of the gaps between, entropy of starting hours."""
    rows = sessions(g, gap)
    found = rows.groupBy(LOC).agg(
        ratio(F.stddev_samp("duration"), F.avg("duration")).alias("session_duration_cv"),
        ratio(F.avg("before"), F.stddev_samp("before")).alias("inter_session_regularity"),
        ratio(F.stddev_samp("n"), F.avg("n")).alias("downloads_per_session_cv"),
        F.count(F.lit(1)).alias("k"),
    )
    hours = rows.groupBy(LOC, "hour").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("all")
    hours = hours.withColumn("all", F.sum("n").over(Window.partitionBy(LOC)))
    hours = hours.groupBy(LOC).agg((-F.sum(p * F.log2(p + EPSILON))).alias("session_start_hour_entropy"))
    out = found.where("k >= 2").drop("k").join(hours, LOC)
    every = g.sizes.select(LOC).join(out, LOC, "left")
    return every.fillna(
        {"session_duration_cv": 1.0, "inter_session_regularity": 0.0, "downloads_per_session_cv": 1.0, "session_start_hour_entropy": 2.0}
    )


def access_pattern(g: Grains) -> DataFrame:
    """Whether files are read in the order of their names or numbers, and how often again.

    unique_file_ratio counts files over files, so it is 1 and
    directory_traversal_score equals alphabetical_access_score.
    """
    digits = F.regexp_extract("filename", "([0-9]+)", 1)
    # Names are ranked once a file; events are ordered a day at a time and moved by the count of earlier days.
    names = places(g.events, LOC, "filename")
    rows = g.events.where("filename IS NOT NULL").select(LOC, "filename", "ts", "event_id", F.to_date("ts").alias("day"))
    rows = rows.withColumn("digits", digits).withColumn("number", F.col("digits").try_cast("int"))
    days = rows.groupBy(LOC, "day").agg(
        F.count(F.lit(1)).alias("_k"), F.min(F.struct("ts", "event_id", "number")).alias("_first")
    )
    by_day = Window.partitionBy(LOC).orderBy("day")
    days = days.select(
        LOC,
        "day",
        F.coalesce(F.sum("_k").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lead("_first").over(by_day).alias("_after"),
    )
    rows = rows.join(names, [LOC, "filename"]).join(days, [LOC, "day"])
    in_day = Window.partitionBy(LOC, "day").orderBy("ts", "event_id")
    rows = rows.withColumn("at", F.col("_before") + F.row_number().over(in_day))
    rows = rows.withColumn("_end", F.lead("at").over(in_day).isNull())
    rows = rows.withColumn("next", F.when(F.col("_end"), F.col("_after.number")).otherwise(F.lead("number").over(in_day)))
    rows = rows.withColumn("last", F.col("_end") & F.col("_after").isNull())
    step = F.abs(F.col("next").cast("long") - F.col("number").cast("long")) == 1
    paired = (F.col("digits") != "") & ~F.col("last")
    sds = F.stddev_samp("at") * F.stddev_samp("place")
    cov = F.avg(F.col("at") * F.col("place")) - F.avg("at") * F.avg("place")
    order = rows.groupBy(LOC).agg(
        F.when(sds > 0, cov / sds).otherwise(0.0).alias("alphabetical_access_score"),
        F.coalesce(F.avg(F.when(paired, F.when(step, 1.0).otherwise(0.0))), F.lit(0.0)).alias("sequential_file_ratio"),
    )
    again = g.files.groupBy(LOC).agg((F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("retry_ratio"))
    out = order.join(again, LOC)
    return out.withColumn("directory_traversal_score", F.col("alphabetical_access_score")).withColumn("unique_file_ratio", F.lit(1.0))


def file_diversity(g: Grains) -> DataFrame:
    """Files and their users; file_entropy is that of files over distinct files, which is always 0.

    true_file_entropy is the Shannon entropy of a location's events over files.
    """
    total = F.sum("n").over(Window.partitionBy(LOC))
    rows = g.files.withColumn("p", F.col("n") / total)
    found = rows.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("unique_files"),
        F.avg("users").alias("avg_users_per_file"),
        (-F.sum(F.col("p") * F.log2("p"))).alias("true_file_entropy"),
    )
    return found.withColumns(
        {"file_entropy": F.lit(0.0), "file_exploration_score": F.lit(0.0), "file_mirroring_score": F.lit(10.0)}
    )


def user_authenticity(g: Grains) -> DataFrame:
    """How alike users' activity is, and how long it lasts."""
    rows = g.events.where("usr IS NOT NULL AND filename IS NOT NULL")
    rows = rows.groupBy(LOC, "usr", "filename", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    users = rows.groupBy(LOC, "usr").agg(
        F.sum("n").alias("n"), F.count_distinct("filename").alias("files"), F.count_distinct("day").alias("days")
    )
    found = users.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"),
        ratio(F.avg("n"), F.stddev_samp("n")).alias("user_homogeneity_score"),
        F.avg("days").alias("avg_active_days_per_user"),
        F.avg("files").alias("avg_files_per_user"),
    )
    farm = (F.col("k") > 100) & (F.col("user_homogeneity_score") > 2)
    return found.select(
        LOC,
        "user_homogeneity_score",
        "avg_active_days_per_user",
        "avg_files_per_user",
        F.when(farm, F.col("user_homogeneity_score") * F.log(F.col("k") + 1)).otherwise(0.0).alias("bot_farm_score"),
        (F.col("avg_active_days_per_user") * F.col("avg_files_per_user")).alias("user_authenticity_score"),
    )


def version_targeting(g: Grains) -> DataFrame:
    """Distinct x.y.z versions among file names."""
    rows = g.files.withColumn("version", F.regexp_extract("filename", "[0-9]+\\.[0-9]+\\.[0-9]+", 0))
    found = rows.groupBy(LOC).agg(F.count_distinct(F.when(F.col("version") != "", F.col("version"))).alias("unique_versions"))
    share = F.when(F.col("unique_versions") > 0, 1.0 / F.greatest("unique_versions", F.lit(1))).otherwise(0.5)
    return found.withColumn("version_concentration", share).withColumn(
        "targets_latest_only", (F.col("version_concentration") > 0.5).cast("int")
    )


def gaps(g: Grains) -> DataFrame:
    """(geo_location, gap): seconds between each event and the one before it, null for the first ones.

    Events are ordered a day at a time, so that a location's log is dealt over many tasks; gaps
    across midnight come from the ends of its days.
    """
    rows = g.events.select(LOC, "ts", F.to_date("ts").alias("day"))
    within = seconds_between(F.lag("ts").over(Window.partitionBy(LOC, "day").orderBy("ts")), F.col("ts"))
    days = rows.groupBy(LOC, "day").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    across = seconds_between(F.lag("_to").over(Window.partitionBy(LOC).orderBy("day")), F.col("_from"))
    return rows.select(LOC, within.alias("gap")).unionByName(days.select(LOC, across.alias("gap")))


def intervals(g: Grains, most: int | None = 50) -> DataFrame:
    """Length and regularity of the intervals between sampled events, or between all without most."""
    if most is None:
        rows = gaps(g)
    else:
        rows = sampled(g, most).withColumn("gap", seconds_between(F.lag("ts").over(_by_time()), F.col("ts")))
    mean, sd = F.avg("gap"), F.stddev_samp("gap")
    return rows.groupBy(LOC).agg(
        mean.alias("mean_interval"),
        sd.alias("std_interval"),
        F.when(mean > 0, sd / mean).otherwise(1.0).alias("interval_cv"),
        F.when(sd > 0, mean / (sd + 1)).otherwise(0.0).alias("regularity_score"),
    )


def base_behavior(g: Grains, most: int = 50) -> DataFrame:
    """Regularity of sampled intervals, weekends, files and sessions, with flags."""
    regular = intervals(g, most)
    weekend = F.sum(F.when(F.dayofweek("at").isin(1, 7), F.col("n")).otherwise(0)) / F.sum("n")
    week = g.days.groupBy(LOC).agg(
        weekend.alias("weekend_ratio"), F.count_distinct(F.dayofweek("at")).alias("unique_days_of_week"), F.sum("n").alias("n")
    )
    files = g.files.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("unique_files"),
        (F.max("n") / F.sum("n")).alias("file_concentration"),
        (F.count(F.lit(1)) / F.sum("n")).alias("file_diversity_ratio"),
    )
    runs = sessions(g).groupBy(LOC).agg(F.count(F.lit(1)).alias("num_sessions"))
    out = week.join(regular, LOC, "left").join(files, LOC, "left").join(runs, LOC, "left")
    out = out.withColumn("downloads_per_session", F.col("n") / F.col("num_sessions"))
    out = settled(out)
    ((steady,), (busy,)) = quantiles_of(out, {"regularity_score": [0.75], "downloads_per_session": [0.75]}).values()
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return out.withColumns(
        {
            "is_mechanical": flag(F.col("regularity_score") > F.lit(steady)),
            "is_weekday_biased": flag(F.col("weekend_ratio") < 0.15),
            "is_single_file": flag(F.col("file_diversity_ratio") < 0.1),
            "is_bursty": flag(F.col("downloads_per_session") > F.lit(busy)),
        }
    ).drop("n")


def weekly_autocorrelation(g: Grains) -> DataFrame:
    """Mean product of standardised day counts seven active days apart; 0 below 14 days."""
    mine = Window.partitionBy(LOC)
    rows = g.days.withColumn("z", F.try_divide(F.col("n") - F.avg("n").over(mine), F.stddev_pop("n").over(mine)))
    rows = rows.withColumn("next", F.lead("z", 7).over(mine.orderBy("at")))
    k = F.count(F.lit(1))
    value = F.when((k >= 14) & (F.stddev_pop("n") > 0), F.sum(F.col("z") * F.col("next")) / (k - 7)).otherwise(0.0)
    return rows.groupBy(LOC).agg(F.coalesce(value, F.lit(0.0)).alias("weekly_autocorr"))


def periodicity(g: Grains) -> DataFrame:
    """Weekly autocorrelation, and from the spectrum of active-day counts the main period and its strength."""

    def spectrum(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("at")["n"].to_numpy(dtype=float)
        period = strength = regular = 0.0
        if len(y) >= 14 and y.std() > 0:
            z = (y - y.mean()) / y.std()
            power, freq = np.abs(np.fft.rfft(z)) ** 2, np.fft.rfftfreq(len(z))
            usable = freq > 1 / len(z)
            power, freq = power[usable], freq[usable]
            if len(power) and power.sum() > 0:
                order = np.argsort(-power, kind="stable")
                period, strength = 1 / freq[order[0]], min(power[order[0]] / power.sum(), 1.0)
                others = power[order[1:4]]
                if len(others) and others.mean() > 0:
                    regular = min(power[order[0]] / others.mean(), 10.0)
        return pd.DataFrame(
            {LOC: [rows[LOC].iloc[0]], "dominant_period_days": [period], "periodicity_strength": [strength], "period_regularity": [regular]}
        )

    schema = f"{LOC} string, dominant_period_days double, periodicity_strength double, period_regularity double"
    return weekly_autocorrelation(g).join(g.days.groupBy(LOC).applyInPandas(spectrum, schema), LOC)


SEQUENCE = (
    "downloads_in_window", "unique_users_in_window", "downloads_per_user_in_window", "dl_rate_change", "users_rate_change",
    "dl_per_user_rate_change", "dl_rolling_min", "dl_rolling_max", "dl_rolling_std", "dl_rolling_median", "trend_slope", "volatility_cv",
)


def window_series(g: Grains, unit: str = "month", length: int = 12) -> DataFrame:
    """The last windows of each location in long form, place 1 the earliest, with SEQUENCE."""
    mine = Window.partitionBy(LOC)
    rows = g.bucket(unit).withColumn("back", F.row_number().over(mine.orderBy(F.col("at").desc()))).where(F.col("back") <= length)
    at = mine.orderBy("at")
    last3 = at.rowsBetween(-2, 0)
    y = F.col("n").cast("double")
    rows = rows.withColumn("k", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(at))
    rows = rows.withColumn("dpu", F.coalesce(F.try_divide(y, F.col("users")), F.lit(0.0)))
    change = lambda c: F.coalesce(F.try_divide(F.col(c), F.lag(c).over(at)) - 1, F.lit(0.0)).cast("double")
    three = F.array_sort(F.collect_list(y).over(last3))
    size = F.size(three)
    middle = (F.get(three, F.floor((size - 1) / 2).cast("int")) + F.get(three, F.floor(size / 2).cast("int"))) / 2
    span = F.least("k", F.lit(3))
    full = F.col("place") >= span
    first = F.when(span == 3, F.lag(y, 2).over(at)).otherwise(F.lag(y, 1).over(at))
    slope = F.when(full & (span > 1), (y - first) / (span - 1)).otherwise(0.0)
    mean, sd = F.avg(y).over(last3), F.stddev_pop(y).over(last3)
    return rows.select(
        LOC,
        F.col("place").cast("long").alias("place"),
        y.alias("downloads_in_window"),
        F.col("users").cast("double").alias("unique_users_in_window"),
        F.col("dpu").alias("downloads_per_user_in_window"),
        change("n").alias("dl_rate_change"),
        change("users").alias("users_rate_change"),
        change("dpu").alias("dl_per_user_rate_change"),
        F.min(y).over(last3).alias("dl_rolling_min"),
        F.max(y).over(last3).alias("dl_rolling_max"),
        F.coalesce(F.stddev_samp(y).over(last3), F.lit(0.0)).alias("dl_rolling_std"),
        middle.alias("dl_rolling_median"),
        F.coalesce(slope, F.lit(0.0)).alias("trend_slope"),
        F.when(full & (mean > 0), sd / mean).otherwise(0.0).alias("volatility_cv"),
    )


def window_sequence(g: Grains, unit: str = "month", length: int = 12) -> DataFrame:
    """One array of length x 12 numbers a location, zeros before its first window."""
    rows = window_series(g, unit, length).select(LOC, F.struct("place", F.array(*SEQUENCE).alias("v")).alias("s"))
    rows = rows.groupBy(LOC).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), len(SEQUENCE))
    padded = F.concat(F.array_repeat(zeros, length - F.size("v")), F.col("v"))
    return rows.select(LOC, padded.alias("time_series_features"), F.lit(1).alias("time_series_features_present"))
