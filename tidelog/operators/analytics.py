"""Usage analytics over canonical events. Each is one grouping, or two, of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.order import rank_percent, running

# Countries by region; all others are Other.
REGIONS = {
    "Asia": "China, Japan, South Korea, India, Taiwan, Singapore, Thailand, Indonesia, Malaysia, Vietnam, Philippines, Bangladesh, Pakistan, Hong Kong, Israel",
    "Americas": "United States, Canada, Brazil, Mexico, Argentina, Chile, Colombia, Peru",
    "Europe": "United Kingdom, Germany, France, Spain, Italy, Netherlands, Switzerland, Sweden, Denmark, Belgium, Finland, Norway, Austria, Poland, Czech Republic, Portugal, Ireland, Greece, Hungary, Romania, Russia, Turkey, Ukraine",
    "Oceania": "Australia, New Zealand",
    "Africa": "South Africa, Egypt, Nigeria, Kenya, Morocco",
    "Middle East": "Saudi Arabia, Iran, UAE",
}


def region(country: Column) -> Column:
    chain = F.lit(None).cast("string")
    for name, members in REGIONS.items():
        chain = F.when(country.isin(members.split(", ")), name).otherwise(chain)
    return F.coalesce(chain, F.lit("Other"))


def known_country(country: Column) -> Column:
    """Neither null, empty nor an unfilled placeholder."""
    return country.isNotNull() & (country != "") & ~country.contains("%{")


def by_country(events: DataFrame) -> DataFrame:
    """Events, users and datasets of each known country, with its region."""
    rows = events.where(known_country(F.col("country"))).groupBy("country")
    out = rows.agg(
        F.count(F.lit(1)).alias("downloads"), F.count_distinct("usr").alias("users"), F.count_distinct("accession").alias("datasets")
    )
    return out.withColumn("region", region(F.col("country")))


def by_region(countries: DataFrame) -> DataFrame:
    return countries.groupBy("region").agg(F.sum("downloads").alias("downloads"), F.count(F.lit(1)).alias("countries"))


def trend(events: DataFrame, unit: str = "year", first: int = 2020, last: int = 2025) -> DataFrame:
    """Events, users and datasets of each year, or of each year and month, in a range of years."""
    keys = [F.year("ts").alias("yr")] + ([F.month("ts").alias("mon")] if unit == "month" else [])
    inside = (F.col("ts") >= F.lit(f"{first:04d}-01-01").cast("timestamp_ntz")) & (F.col("ts") < F.lit(f"{last + 1:04d}-01-01").cast("timestamp_ntz"))
    return events.where(inside).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("downloads"), F.count_distinct("usr").alias("users"), F.count_distinct("accession").alias("datasets")
    )


def protocol_trend(events: DataFrame, unit: str | None = "year") -> DataFrame:
    """Events of each method, over all time or by year or month, with its share of the period."""
    keys = {None: [], "year": [F.year("ts").alias("yr")], "month": [F.year("ts").alias("yr"), F.month("ts").alias("mon")]}[unit]
    rows = events.where(F.col("method").isNotNull()).groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("downloads"))
    period = Window.partitionBy(*(["yr", "mon"][: len(keys)] or [F.lit(0)]))
    return rows.withColumn("share", F.col("downloads") / F.sum("downloads").over(period))


def top_datasets(events: DataFrame, k: int = 100, metadata: DataFrame | None = None) -> DataFrame:
    """The k datasets of most events, ties by name; with title and dates where metadata is given."""
    rows = events.where("accession IS NOT NULL").groupBy("accession").agg(
        F.count(F.lit(1)).alias("downloads"), F.count_distinct("usr").alias("users"), F.count_distinct("country").alias("countries")
    )
    top = rows.orderBy(F.col("downloads").desc(), "accession").limit(k)
    return top if metadata is None else top.join(metadata, "accession", "left")


def dataset_counts(events: DataFrame) -> DataFrame:
    return events.where("accession IS NOT NULL").groupBy("accession").agg(F.count(F.lit(1)).alias("downloads"))


def _ranked(counts: DataFrame, value: str) -> DataFrame:
    """Each distinct value with its number n, the values and their sum up to and with it, and totals."""
    kinds = counts.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    found = running(kinds.withColumn("nx", F.col("n") * F.col("x")), "x", ["n", "nx"])
    return found.select(
        "x",
        "n",
        (F.col("n_before") + F.col("n")).alias("count"),
        (F.col("nx_before") + F.col("nx")).alias("sum"),
        F.col("n_all").alias("all_count"),
        F.col("nx_all").alias("all_sum"),
    )


def concentration(counts: DataFrame, value: str = "downloads") -> DataFrame:
    """One row: number of items, Gini coefficient, and the shares of the top 1, 10 and 50 percent."""
    r = _ranked(counts, value)
    # Equal values take the ranks count-n+1 .. count; their mean rank is enough for the sum.
    ranked = F.sum(F.col("x") * F.col("n") * (F.col("count") - (F.col("n") - 1) / 2))
    n, total = F.first("all_count"), F.first("all_sum")

    def top(part):
        k = F.greatest(F.floor(F.col("all_count") * part).cast("long"), F.lit(1))
        above = F.col("all_count") - F.col("count")
        taken = F.least(F.greatest(k - above, F.lit(0)), F.col("n"))
        return F.sum(taken * F.col("x")) / total

    return r.agg(
        n.alias("items"),
        (2 * ranked / (n * total) - (n + 1) / n).alias("gini"),
        top(0.01).alias("top_1_share"),
        top(0.10).alias("top_10_share"),
        top(0.50).alias("top_50_share"),
    )


def lorenz(counts: DataFrame, value: str = "downloads", points: int = 101) -> DataFrame:
    """The Lorenz curve at evenly spaced shares of items, linear between them."""
    k = points - 1
    r = _ranked(counts, value).withColumn("past", F.col("count") - F.col("n"))
    # The points i with past < i / k * all_count <= count, in whole numbers; the first value has point 0 too.
    first = F.when(F.col("past") == 0, F.lit(0)).otherwise(F.floor(F.col("past") * k / F.col("all_count")) + 1).cast("long")
    last = F.floor(F.col("count") * k / F.col("all_count")).cast("long")
    r = r.withColumn("first", first).withColumn("last", last).where("first <= last").withColumn("i", F.explode(F.sequence("first", "last")))
    items = F.col("i") / F.lit(k) * F.col("all_count")
    part = (F.col("sum") - F.col("n") * F.col("x") + (items - F.col("past")) * F.col("x")) / F.col("all_sum")
    return r.select((F.col("i") / F.lit(k)).alias("item_share"), part.alias("download_share"))


def rank_frequency(counts: DataFrame, k: int = 100, value: str = "downloads") -> DataFrame:
    """The k largest counts with their ranks."""
    top = counts.orderBy(F.col(value).desc(), "accession").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col(value).desc(), "accession")))


def hour_by_weekday(events: DataFrame) -> DataFrame:
    """Events by hour and weekday, Sunday 0; a missing time counts at noon of no weekday."""
    return events.groupBy(F.coalesce(F.hour("ts"), F.lit(12)).alias("hr"), (F.dayofweek("ts") - 1).alias("dow")).agg(
        F.count(F.lit(1)).alias("downloads")
    )


def country_year(events: DataFrame, countries: list[str]) -> DataFrame:
    """Events of listed countries by year, with their share of the year's events of all countries."""
    rows = events.groupBy(F.year("ts").alias("yr"), "country").agg(F.count(F.lit(1)).alias("downloads"))
    rows = rows.withColumn("share", F.col("downloads") / F.sum("downloads").over(Window.partitionBy("yr")))
    return rows.where(F.col("country").isin(countries))


def dataset_years(events: DataFrame, k: int = 25) -> DataFrame:
    """Yearly events of the k largest datasets, log10(x + 1), and their number of active years."""
    top = top_datasets(events, k).select("accession")
    rows = events.join(F.broadcast(top), "accession", "left_semi").groupBy("accession", F.year("ts").alias("yr")).agg(F.count(F.lit(1)).alias("downloads"))
    return rows.withColumn("log_downloads", F.log10(F.col("downloads") + 1)).withColumn(
        "active_years", F.count(F.lit(1)).over(Window.partitionBy("accession"))
    )


def consistency(events: DataFrame, least_years: int = 3, span: int = 5) -> DataFrame:
    """(1 - min(cv, 1)) * years / span of each dataset with enough active years."""
    rows = events.where("accession IS NOT NULL").groupBy("accession", F.year("ts").alias("yr")).agg(F.count(F.lit(1)).alias("n"))
    found = rows.groupBy("accession").agg(
        F.count(F.lit(1)).alias("years"), F.sum("n").alias("downloads"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd")
    )
    score = (1 - F.least(F.col("sd") / F.col("mean"), F.lit(1.0))) * F.col("years") / span
    return found.where(F.col("years") >= least_years).select("accession", "years", "downloads", score.alias("consistency_score"))


def files_histogram(events: DataFrame) -> DataFrame:
    """Files by the whole part of log10 of their events."""
    files = events.where("filename IS NOT NULL").groupBy("accession", "filename").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy(F.floor(F.log10("n")).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("downloads"))


def country_bubbles(events: DataFrame, more_than: int = 10000, k: int = 50) -> DataFrame:
    """Countries above a number of events: events, users, events a user."""
    rows = by_country(events).where(F.col("downloads") > more_than).withColumn("downloads_per_user", F.try_divide("downloads", "users"))
    return rows.orderBy(F.col("downloads").desc(), "country").limit(k)


def before_after(annotated: DataFrame) -> DataFrame:
    """Events of each country with and without those of bots."""
    rows = annotated.where(known_country(F.col("country"))).groupBy("country").agg(
        F.count(F.lit(1)).alias("before"), F.count_if(~F.col("is_bot")).alias("after")
    )
    return rows.withColumn("removed_share", 1 - F.col("after") / F.col("before"))


def file_types(events: DataFrame) -> DataFrame:
    """Events by region and kind of file, from the extension: raw, peak lists, results, other."""
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z]+)(\.gz|\.zip)?$", 1))
    # Extensions by kind.
    kinds = {"raw": ("raw", "wiff", "d"), "peaks": ("mzml", "mzxml", "mgf"), "results": ("mzid", "xml", "txt", "csv", "tsv")}
    kind = F.lit("other")
    for name, members in kinds.items():
        kind = F.when(ext.isin(*members), name).otherwise(kind)
    rows = events.where("filename IS NOT NULL").groupBy(region(F.col("country")).alias("region"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("downloads"))
    return rows.withColumn("share", F.col("downloads") / F.sum("downloads").over(Window.partitionBy("region")))


def reuse_correlation(counts: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: Spearman's rho and the log-log line of downloads on reuse, citations less the own one.

    counts has accession and downloads, citations accession and citations.
    """
    rows = counts.join(citations, "accession").withColumn("reuse", F.greatest(F.col("citations") - 1, F.lit(0)))
    rows = rank_percent(rank_percent(rows, "downloads", "rd"), "reuse", "rr")
    used = F.when(F.col("reuse") > 0, F.log10("reuse"))
    given = F.when(F.col("reuse") > 0, F.log10("downloads"))
    return rows.agg(
        F.count(F.lit(1)).alias("items"),
        F.corr("rd", "rr").alias("spearman"),
        F.regr_slope(given, used).alias("slope"),
        F.regr_intercept(given, used).alias("intercept"),
    )


def label_breakdown(labelled: DataFrame) -> DataFrame:
    """Locations and events of each label by country."""
    n = {k: F.count_if(F.col(f"is_{k}")).alias(f"{k}_locations") for k in ("bot", "hub", "organic")}
    d = {k: F.sum(F.when(F.col(f"is_{k}"), F.col("total_downloads")).otherwise(0)).alias(f"{k}_downloads") for k in n}
    return labelled.groupBy("country").agg(F.count(F.lit(1)).alias("locations"), *n.values(), *d.values())


def overview(events: DataFrame) -> DataFrame:
    """One row: events, first and last year, distinct countries, locations, datasets and users."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.min(F.year("ts")).alias("first_year"),
        F.max(F.year("ts")).alias("last_year"),
        F.count_distinct("country").alias("countries"),
        F.count_distinct("geo_location").alias("locations"),
        F.count_distinct("accession").alias("datasets"),
        F.count_distinct("usr").alias("users"),
    )


def script_locations(events: DataFrame, least: int = 1) -> DataFrame:
    """The stand-alone location aggregate: ten working hours, 9 to 17 both included, and entropy of hours seen."""
    m = F.lower("method")
    h = F.hour("ts")
    rows = events.where(F.col("geo_location").isNotNull()).groupBy("geo_location").agg(
        F.max("country").alias("country"),
        F.count(F.lit(1)).alias("total_downloads"),
        F.count_distinct("usr").alias("unique_users"),
        F.count_distinct("accession").alias("unique_projects"),
        F.count_distinct(h).alias("distinct_hours"),
        F.avg(F.when(h.between(9, 17), 1.0).otherwise(0.0)).alias("working_hours_ratio"),
        F.avg(F.when(h.between(22, 23) | h.between(0, 5), 1.0).otherwise(0.0)).alias("night_activity_ratio"),
        *[F.count_if(m == full).alias(f"{name}_downloads") for name, full in (("http", "http"), ("ftp", "ftp"), ("aspera", "fasp-aspera"), ("globus", "gridftp-globus"))],
    )
    rows = rows.where(F.col("total_downloads") >= least)
    return rows.withColumns(
        {
            "downloads_per_user": F.try_divide("total_downloads", "unique_users"),
            "users_per_project": F.try_divide("unique_users", "unique_projects"),
            "hourly_entropy": F.log(F.greatest("distinct_hours", F.lit(1)).cast("double")) / F.log(F.lit(24.0)),
        }
    )


def enrich(rows: DataFrame, metadata: DataFrame, key: str = "accession") -> DataFrame:
    """Left join with one row of metadata a key."""
    return rows.join(metadata.dropDuplicates([key]), key, "left")
