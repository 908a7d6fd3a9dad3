"""Per-location features from the hour, day, week and year grains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import EPSILON, clip, dense_entropy, ratio
from tidelog.grains import Grains
from tidelog.operators.order import exact_quantiles, quantiles_of, rank_percent
from tidelog.schema import LogSchema
from tidelog.storage import settled

LOC = "geo_location"


def volume(g: Grains, min_downloads: int = 1) -> DataFrame:
    """Counts of users, events, hours and years of each location."""
    own = g.hours.groupBy(LOC).agg(
        F.sum("n").alias("total_downloads"),
        F.count(F.lit(1)).alias("active_hours"),
        F.count_distinct(F.year("hour")).alias("years_active"),
        F.min(F.year("hour")).alias("first_year"),
        F.max(F.year("hour")).alias("last_year"),
    )
    users = g.users.groupBy(LOC).agg(F.count(F.lit(1)).alias("unique_users"))
    out = own.where(F.col("total_downloads") >= min_downloads).join(users, LOC, "left").fillna({"unique_users": 0})
    return out.withColumn("downloads_per_user", ratio("total_downloads", "unique_users"))


def basic(g: Grains, min_downloads: int = 1) -> DataFrame:
    """The counts of volume, with city, country and number of projects of each location."""
    projects = g.events.groupBy(LOC).agg(F.max("city").alias("city"), F.count_distinct("accession").alias("unique_projects"))
    return volume(g, min_downloads).join(projects, LOC).join(g.countries, LOC)


def hourly_density(g: Grains, basics: DataFrame) -> DataFrame:
    """Distinct users an hour, and user_cv: their average over that of all locations."""
    rates = g.hours.groupBy(LOC).agg(F.avg("users").alias("avg_users_per_hour"), F.max("users").alias("max_users_per_hour"))
    mean = F.broadcast(rates.agg(F.avg("avg_users_per_hour").alias("_mean")))
    rates = rates.crossJoin(mean).withColumn("user_cv", F.col("avg_users_per_hour") / (F.col("_mean") + EPSILON)).drop("_mean")
    sizes = basics.select(
        LOC,
        (F.col("unique_users") / F.greatest("active_hours", F.lit(1))).alias("users_per_active_hour"),
        (F.col("unique_projects") / F.greatest("unique_users", F.lit(1))).alias("projects_per_user"),
    )
    return sizes.join(rates, LOC, "left")


def yearly(g: Grains) -> DataFrame:
    """Shares, growth and spread over years; years that only other locations have count as zeros."""
    years = g.years
    span = years.select("year").distinct().agg(F.count(F.lit(1)).alias("all_years"), F.max("year").alias("latest"))
    rows = years.join(F.broadcast(span))
    mine = Window.partitionBy(LOC)
    rows = rows.withColumn("total", F.sum("n").over(mine)).withColumn("share", F.col("n") / F.col("total"))
    latest = F.col("year") == F.col("latest")
    found = rows.groupBy(LOC).agg(
        F.first("total").alias("total"),
        F.first("all_years").alias("y"),
        F.first("latest").alias("latest"),
        F.min("year").alias("first_year"),
        F.count(F.lit(1)).alias("years_span"),
        F.sum(F.when(latest, F.col("n")).otherwise(0)).alias("latest_year_downloads"),
        F.sum(F.when(~latest, F.col("n")).otherwise(0)).alias("before"),
        F.sum(F.when(~latest, 1).otherwise(0)).alias("years_before_latest"),
        dense_entropy(F.col("share"), F.col("all_years")).alias("yearly_entropy"),
        F.max("share").alias("peak_year_concentration"),
        F.sum(F.col("share") * F.col("share")).alias("squares"),
    )
    mean_before = F.col("before") / F.greatest("years_before_latest", F.lit(1))
    variance = F.try_divide(F.col("squares") - 1 / F.col("y"), F.col("y") - 1)
    return found.select(
        LOC,
        "latest_year_downloads",
        ratio("latest_year_downloads", "total").alias("fraction_latest_year"),
        ((F.col("first_year") == F.col("latest")) & (F.col("years_span") == 1)).cast("int").alias("is_new_location"),
        F.when(mean_before > 0, F.col("latest_year_downloads") / (mean_before + EPSILON))
        .otherwise(F.col("latest_year_downloads") / 1000)
        .alias("spike_ratio"),
        "years_before_latest",
        "yearly_entropy",
        "peak_year_concentration",
        F.when(F.col("years_span") > 1, F.sqrt(F.greatest(variance, F.lit(0.0))) / (1 / F.col("y") + EPSILON))
        .otherwise(0.0)
        .alias("year_over_year_cv"),
        "years_span",
        (F.col("total") / F.col("years_span")).alias("downloads_per_year"),
    )


def time_of_day(g: Grains, schema: LogSchema | None = None) -> DataFrame:
    """Shape of the 24-hour clock, hours without events included.

    Ratios that meet thresholds are one division of counts, so that no order
    of rows moves them.
    """
    s = schema or LogSchema()
    rows = g.clock.withColumn("total", F.sum("n").over(Window.partitionBy(LOC)))
    rows = rows.withColumn("share", F.col("n") / F.col("total"))
    h = F.col("h")
    work = (h >= s.working_hours_start) & (h < s.working_hours_end)
    night = (h >= s.night_hours_start) | (h < s.night_hours_end)
    squares = F.sum(F.col("n") * F.col("n")) / 24 - F.pow(F.sum("n") / 24, F.lit(2))
    return rows.groupBy(LOC).agg(
        F.sqrt(F.greatest(squares, F.lit(0.0))).alias("hourly_download_std"),
        F.max("share").alias("peak_hour_concentration"),
        (F.sum(F.when(work, F.col("n")).otherwise(0)) / F.sum("n")).alias("working_hours_ratio"),
        dense_entropy(F.col("share"), F.lit(24)).alias("hourly_entropy"),
        (F.sum(F.when(night, F.col("n")).otherwise(0)) / F.sum("n")).alias("night_activity_ratio"),
    )


def country_context(basics: DataFrame, years: DataFrame) -> DataFrame:
    """What the locations of a country have in common, on each of its locations."""
    rows = basics.select(LOC, "country", "unique_users", "total_downloads", "downloads_per_user").join(years, LOC)
    found = rows.groupBy("country").agg(
        F.count(F.lit(1)).alias("locations_per_country"),
        F.sum("latest_year_downloads").alias("country_latest_year_dl"),
        F.sum("total_downloads").alias("country_total_dl"),
        F.avg("fraction_latest_year").alias("country_avg_fraction_latest"),
        F.sum("is_new_location").alias("country_new_locations"),
        F.count_if(F.col("spike_ratio") > 1.5).alias("country_high_spike_locations"),
        F.count_if(F.col("downloads_per_user") < 30).alias("country_low_dl_user_locations"),
        F.sum("unique_users").alias("country_total_users"),
    )
    found = found.withColumns(
        {
            "country_fraction_latest": ratio("country_latest_year_dl", "country_total_dl"),
            "country_new_location_ratio": ratio("country_new_locations", "locations_per_country"),
            "country_suspicious_location_ratio": ratio(
                F.col("country_high_spike_locations") + F.col("country_low_dl_user_locations"), F.col("locations_per_country") * 2
            ),
        }
    )
    return rows.select(LOC, "country").join(found, "country").drop("country")


def protocol(g: Grains) -> DataFrame:
    """Shares of transfer methods and their weighted legitimacy."""
    m = F.lower("method")
    found = g.events.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(m == "http").alias("http"),
        F.count_if(m == "ftp").alias("ftp"),
        F.count_if(m.like("%aspera%")).alias("aspera"),
        F.count_if(m.like("%globus%")).alias("globus"),
        F.count_distinct("method").alias("protocol_diversity"),
    )
    names = ("http", "ftp", "aspera", "globus")
    out = found.select(LOC, *[(F.col(c) / F.col("n")).alias(f"{c}_ratio") for c in names], "protocol_diversity")
    weights = {"aspera": 0.9, "globus": 0.95, "ftp": 0.6, "http": 0.1}
    return out.withColumn("protocol_legitimacy_score", sum((F.col(f"{c}_ratio") * w for c, w in weights.items()), F.lit(0.0)))


def user_distribution(g: Grains) -> DataFrame:
    """How a location's events spread over its users."""
    # Users of as many events are alike: a location has as many rows as there are different numbers, and m users each.
    rows = g.users.groupBy(LOC, "n").agg(F.count(F.lit(1)).alias("m"))
    mine = Window.partitionBy(LOC)
    rows = rows.withColumn("total", F.sum(F.col("n") * F.col("m")).over(mine)).withColumn("kinds", F.sum("m").over(mine))
    more = mine.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("above", F.coalesce(F.sum("m").over(more), F.lit(0)))
    p = F.col("n") / F.col("total")
    top = F.floor(F.greatest(F.col("kinds") * 0.1, F.lit(1.0)))
    found = rows.groupBy(LOC).agg(
        (-F.sum(F.col("m") * p * F.log2(p + EPSILON))).alias("user_entropy"),
        (F.sum(F.when(F.col("n") == 1, F.col("m")).otherwise(0)) / F.first("kinds")).alias("single_download_user_ratio"),
        F.sum(F.least(F.greatest(top - F.col("above"), F.lit(0)), F.col("m")) * p).alias("power_user_ratio"),
        # The m users hold the places above + 1 to above + m; from below that is a sum of an arithmetic series.
        F.sum(F.col("n") * (F.col("m") * (F.col("kinds") + 1 - F.col("above")) - (F.col("m") * (F.col("m") + 1) / 2).cast("long"))).alias("ranked"),
        F.first("total").alias("total"),
        F.first("kinds").alias("kinds"),
    )
    coefficient = 2 * F.col("ranked") / (F.col("kinds") * F.col("total")) - (F.col("kinds") + 1) / F.col("kinds")
    return found.select(
        LOC,
        "user_entropy",
        "single_download_user_ratio",
        "power_user_ratio",
        F.when(F.col("kinds") > 1, coefficient).otherwise(0.5).alias("user_gini_coefficient"),
    )


def statistical(g: Grains) -> DataFrame:
    """Distance of daily counts from Benford's law, evenness of hours, weekday share."""
    # Rounded shares of the first digits 1 to 9.
    benford = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)
    digit = F.substring(F.col("n").cast("string"), 1, 1).cast("int")
    days = F.count(F.lit(1))
    off = sum((F.pow(F.count_if(digit == i + 1) / days - e, F.lit(2)) / (e + 0.01) for i, e in enumerate(benford)), F.lit(0.0))
    weekday = F.sum(F.when(F.dayofweek("at").isin(1, 7), 0).otherwise(F.col("n"))) / F.sum("n")
    by_day = g.days.groupBy(LOC).agg(
        F.when(days >= 10, off).otherwise(0.0).alias("benford_deviation"),
        (F.abs(weekday - 0.714) / 0.714).alias("weekday_pattern_score"),
    )
    uneven = F.var_samp("n") / (F.pow(F.avg("n"), F.lit(2)) + 0.01)
    by_hour = g.clock.groupBy(LOC).agg(clip(F.coalesce(1 - uneven, F.lit(0.0)), 0.0, 1.0).alias("hourly_uniformity_score"))
    return by_day.join(by_hour, LOC)


def outburst(g: Grains) -> DataFrame:
    """Days far above a location's daily mean; locations of constant days take defaults."""
    mine = Window.partitionBy(LOC)
    rows = g.days.withColumn("sd", F.stddev_samp("n").over(mine)).where("sd > 0")
    rows = rows.withColumn("z", (F.col("n") - F.avg("n").over(mine)) / F.col("sd"))
    rows = rows.withColumn("back", F.row_number().over(mine.orderBy(F.col("at").desc())))
    high = F.col("z") > 2
    rows = rows.withColumn("run", F.sum(F.when(high, 0).otherwise(1)).over(mine.orderBy("at")))
    found = rows.groupBy(LOC).agg(
        F.count_if(F.abs("z") > 2).alias("outburst_count"),
        F.coalesce(F.avg(F.when(high, F.col("z"))), F.lit(0.0)).alias("outburst_intensity"),
        F.max("z").alias("max_outburst_zscore"),
        (F.sum(F.when(high, F.col("n")).otherwise(0)) / F.sum("n")).alias("outburst_ratio"),
        F.coalesce(F.min(F.when(high, F.col("back"))) / F.max("back"), F.lit(1.0)).alias("time_since_last_outburst"),
    )
    runs = rows.where(high).groupBy(LOC, "run").agg(F.count(F.lit(1)).alias("k"))
    longest = runs.groupBy(LOC).agg(F.max("k").alias("longest_outburst_streak"))
    out = g.days.select(LOC).distinct().join(found, LOC, "left").join(longest, LOC, "left")
    zero = ("outburst_count", "outburst_intensity", "max_outburst_zscore", "outburst_ratio", "longest_outburst_streak")
    return out.fillna(dict.fromkeys(zero, 0) | {"time_since_last_outburst": 1.0})


def trend(g: Grains) -> DataFrame:
    """Line and parabola through the weekly counts of locations with four weeks or more."""
    x = F.row_number().over(Window.partitionBy(LOC).orderBy("at")) - 1
    mid = (F.count(F.lit(1)).over(Window.partitionBy(LOC)) - 1) / 2
    rows = g.weeks.withColumn("x", (x - mid).cast("double")).withColumn("y", F.col("n").cast("double"))
    s = rows.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"),
        F.avg("y").alias("mean"),
        F.regr_slope("y", "x").alias("slope"),
        F.coalesce(F.regr_r2("y", "x"), F.lit(0.0)).alias("r2"),
        F.var_pop("y").alias("spread"),
        F.sum(F.pow("x", F.lit(2))).alias("x2"),
        F.sum(F.pow("x", F.lit(4))).alias("x4"),
        F.sum("y").alias("y1"),
        F.sum(F.pow("x", F.lit(2)) * F.col("y")).alias("x2y"),
    )
    # With x about its middle, odd moments vanish and the square's factor has a closed form.
    bend = F.try_divide(F.col("k") * F.col("x2y") - F.col("x2") * F.col("y1"), F.col("k") * F.col("x4") - F.col("x2") * F.col("x2"))
    enough = F.col("k") >= 4
    slope = F.when(enough, clip(F.col("slope") / (F.col("mean") + EPSILON), -10.0, 10.0)).otherwise(0.0)
    level = F.when(F.col("spread") > 0, F.sqrt(F.greatest(F.col("spread") * (1 - F.col("r2")), F.lit(0.0))) / (F.col("mean") + EPSILON))
    out = s.select(
        LOC,
        slope.alias("trend_slope"),
        F.when(enough & (F.col("spread") > 0), F.col("r2")).otherwise(0.0).alias("trend_strength"),
        F.when(F.col("k") >= 5, clip(2 * bend / (F.col("mean") + EPSILON), -10.0, 10.0)).otherwise(0.0).alias("trend_acceleration"),
        F.when(enough, F.least(F.coalesce(level, F.lit(0.0)), F.lit(10.0))).otherwise(0.0).alias("detrended_volatility"),
    )
    return out.withColumn("trend_direction", F.when(F.abs("trend_slope") < 0.01, 0.0).otherwise(F.signum("trend_slope")))


def recency(g: Grains) -> DataFrame:
    """The last 30 days of each location against its whole history, and weekly momentum."""
    mine = Window.partitionBy(LOC)
    recent = F.col("at") >= F.max("at").over(mine) - F.expr("INTERVAL 30 DAYS")
    s = g.days.withColumn("recent", recent).groupBy(LOC).agg(
        F.avg("n").alias("mean"),
        F.stddev_samp("n").alias("sd"),
        F.sum("n").alias("total"),
        F.avg(F.when(F.col("recent"), F.col("n"))).alias("r_mean"),
        F.stddev_samp(F.when(F.col("recent"), F.col("n"))).alias("r_sd"),
        F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("r_total"),
    )
    volatile = F.when((F.col("sd") > 0) & (F.col("r_mean") > 0), (F.col("r_sd") / F.col("r_mean")) / (F.col("sd") / F.col("mean"))).otherwise(1.0)
    days = s.select(
        LOC,
        (F.col("r_mean") / F.col("mean")).alias("recent_activity_ratio"),
        F.coalesce(volatile, F.lit(1.0)).alias("recent_volatility_ratio"),
        (F.col("r_total") / F.col("total")).alias("recency_concentration"),
    )
    weeks = g.weeks.withColumn("back", F.row_number().over(mine.orderBy(F.col("at").desc())) - 1)
    weight = F.pow(F.lit(0.7), F.col("back"))
    w = weeks.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"),
        F.avg(F.when(F.col("back") < 3, F.col("n"))).alias("now"),
        F.avg(F.when(F.col("back") >= 3, F.col("n"))).alias("then"),
        (F.sum(weight * F.col("n")) / F.sum(weight)).alias("weighted"),
    )
    past = F.when(F.col("k") > 3, F.col("then")).otherwise(F.col("weighted"))
    momentum = F.when(F.col("k") < 3, 0.0).otherwise(clip((F.col("now") - past) / (past + EPSILON), -5.0, 5.0))
    return days.join(w.select(LOC, momentum.alias("momentum_score")), LOC)


def shape(g: Grains) -> DataFrame:
    """Skewness, excess kurtosis and tail of daily counts, of locations with five days or more."""
    s = g.days.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("k"),
        F.skewness("n").alias("skew"),
        F.kurtosis("n").alias("kurt"),
        F.percentile("n", F.lit(0.99)).alias("p99"),
        F.median("n").alias("mid"),
    )
    enough = F.col("k") >= 5
    value = lambda x, low, high: F.when(enough, clip(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), low, high)).otherwise(0.0)
    return s.select(
        LOC,
        value(F.col("skew"), -10.0, 10.0).alias("download_skewness"),
        value(F.col("kurt"), -10.0, 50.0).alias("download_kurtosis"),
        F.when(enough, F.least(F.col("p99") / (F.col("mid") + EPSILON), F.lit(100.0))).otherwise(1.0).alias("tail_heaviness_ratio"),
        F.lit(0.0).alias("zero_day_ratio"),
    )


def burst(g: Grains) -> DataFrame:
    """Concentration of events in hours, of locations with more than one hour."""
    s = g.hours.groupBy(LOC).agg(
        F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k")
    )
    many = F.col("k") > 1
    return s.select(
        LOC,
        F.when(many & (F.col("sd") > 0), (F.col("top") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("burst_pattern_score"),
        F.when(many, F.col("sd") / F.col("mean")).otherwise(1.0).alias("hourly_cv_burst"),
        F.when(many, F.col("top") / F.col("mean")).otherwise(1.0).alias("spike_intensity"),
    )


def circadian(g: Grains) -> DataFrame:
    """Shares of night, morning, work and evening, and their distance from a human day."""
    # First and last hour and the share expected of people.
    parts = {"night_ratio_advanced": (0, 5, 0.10), "work_ratio_advanced": (9, 17, 0.50), "evening_ratio": (18, 23, 0.25), "morning_ratio": (6, 8, 0.15)}
    share = lambda a, b: F.sum(F.when(F.col("h").between(a, b), F.col("n")).otherwise(0)) / F.sum("n")
    out = g.clock.groupBy(LOC).agg(*[share(a, b).alias(name) for name, (a, b, _) in parts.items()])
    off = sum((F.abs(F.col(name) - p) for name, (_, _, p) in parts.items()), F.lit(0.0))
    return out.withColumn("circadian_rhythm_deviation", off)


def coordination(g: Grains) -> DataFrame:
    """Distinct users an hour, of locations with more than one hour of known users."""
    s = g.hours.where("users > 0").groupBy(LOC).agg(
        F.stddev_samp("users").alias("sd"), F.avg("users").alias("mean"), F.max("users").alias("top"), F.count(F.lit(1)).alias("k")
    )
    many = F.col("k") > 1
    zero = lambda x: F.when(many, x).otherwise(0.0)
    return s.select(
        LOC,
        zero(F.col("sd")).alias("user_coordination_std"),
        zero(F.col("mean")).alias("avg_concurrent_users"),
        zero(F.col("top")).alias("max_concurrent_users"),
        F.when(many & (F.col("sd") > 0), F.col("mean") / F.col("sd")).otherwise(0.0).alias("user_coordination_score"),
        F.when(many, F.col("top") / F.col("mean")).otherwise(1.0).alias("user_peak_ratio"),
    )


def persistence(g: Grains) -> DataFrame:
    """Time between the first and the last event, and how much of it is active."""
    ends = g.events.groupBy(LOC).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = g.days.groupBy(LOC).agg(
        F.count(F.lit(1)).alias("active_days"), F.count_distinct(F.date_trunc("week", "at")).alias("active_weeks")
    )
    life = F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")) / 1e6 / 86400
    out = days.join(ends, LOC).withColumn("lifespan_days", life)
    return out.select(
        LOC,
        "lifespan_days",
        "active_days",
        "active_weeks",
        F.when(F.col("lifespan_days") > 0, F.col("active_days") / F.col("lifespan_days")).otherwise(1.0).alias("activity_density"),
        (F.col("active_weeks") * F.col("active_days")).alias("persistence_score"),
    )


def comparative(profile: DataFrame) -> DataFrame:
    """A location among those of its country, of its size, and of all.

    profile has country, downloads_per_user, unique_users, total_downloads,
    spike_ratio and years_before_latest. Deciles have exact edges, equal
    edges fall together, and bins are closed on the right.
    """
    needed = ("country", "downloads_per_user", "unique_users", "total_downloads", "spike_ratio", "years_before_latest")
    profile = settled(profile.select(LOC, *needed))
    # A country's locations aren't brought together: its mean and deviation are joined back, also for those of no country.
    own = profile.groupBy("country").agg(F.avg("downloads_per_user").alias("_m"), F.stddev_samp("downloads_per_user").alias("_s"))
    own = own.select(F.col("country").alias("_country"), "_m", "_s")
    rows = profile.join(own, F.col("country").eqNullSafe(F.col("_country")), "left")
    rows = rows.withColumn("country_zscore", F.coalesce(F.when(F.col("_s") > 0, (F.col("downloads_per_user") - F.col("_m")) / F.col("_s")), F.lit(0.0)))
    rows = rows.drop("_country", "_m", "_s")
    past = F.col("years_before_latest")
    rows = rows.withColumn(
        "temporal_trend_anomaly", F.when(past > 0, F.log1p("spike_ratio") / F.log1p(past + 1)).otherwise(0.0)
    )
    edges = quantiles_of(profile, {"unique_users": [i / 10 for i in range(11)]})["unique_users"]
    inner = sorted(set(edges) - {None})[1:-1]
    rows = rows.withColumn("bin", sum(((F.col("unique_users") > e).cast("int") for e in inner), F.lit(0)))
    peers = exact_quantiles(rows, "downloads_per_user", [0.5], ["bin"]).select("bin", F.get("q", F.lit(0)).alias("peer"))
    rows = rows.join(F.broadcast(peers), "bin")
    rows = rows.withColumn("peer_similarity", 1 / (1 + F.abs(F.col("downloads_per_user") - F.col("peer")) / (F.col("peer") + 1)))
    rows = rank_percent(rows, "total_downloads", "global_rank_percentile")
    return rows.select(LOC, "country_zscore", "temporal_trend_anomaly", "peer_similarity", "global_rank_percentile")


def clock_signature(g: Grains) -> DataFrame:
    """Lag-one correlation of the 24 hours, distance from a human day, and evenness."""
    # The share of each hour of a human day, before scaling to one.
    human = (
        0.01, 0.005, 0.003, 0.002, 0.005, 0.01, 0.02, 0.04, 0.06, 0.07, 0.08, 0.08,
        0.07, 0.07, 0.08, 0.07, 0.06, 0.05, 0.04, 0.04, 0.04, 0.03, 0.02, 0.015,
    )
    counts = [F.sum(F.when(F.col("h") == i, F.col("n")).otherwise(0)) for i in range(24)]
    rows = g.clock.groupBy(LOC).agg(F.array(*counts).alias("c"), F.sum("n").alias("total"))
    rows = rows.withColumn("p", F.transform("c", lambda x: x / F.col("total")))
    scale = lambda values: [(v + EPSILON) / sum(x + EPSILON for x in values) for v in values]
    people = F.array(*[F.lit(v) for v in scale([h / sum(human) for h in human])])
    mine = F.transform("p", lambda x: (x + EPSILON) / (1 + 24 * EPSILON))
    add = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    half = lambda a, b: a * F.log(2 * a / (a + b))
    jensen = add(F.zip_with(mine, people, lambda a, b: (half(a, b) + half(b, a)) / 2))
    front, back = F.slice("p", 1, 23), F.slice("p", 2, 23)
    dot = lambda a, b: add(F.zip_with(a, b, lambda x, y: x * y))
    cov = 23 * dot(front, back) - add(front) * add(back)
    spread = (23 * dot(front, front) - F.pow(add(front), F.lit(2))) * (23 * dot(back, back) - F.pow(add(back), F.lit(2)))
    return rows.select(
        LOC,
        F.when(spread > 0, cov / F.sqrt(spread)).otherwise(0.0).alias("autocorrelation_lag1"),
        F.sqrt(F.greatest(jensen, F.lit(0.0))).alias("circadian_deviation"),
        (-add(F.transform("p", lambda x: x * F.log(x + EPSILON))) / F.log(F.lit(24.0))).alias("request_timing_entropy"),
    )
