"""Aggregates behind the reports and plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.columns import short_number
from tidelog.operators.analytics import known_country
from tidelog.operators.order import exact_quantiles
from tidelog.storage import settled

LOC = "geo_location"


def feature_statistics(profile: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, sd, least, q25, median, q75, top, bot_mean, other_mean), one row a feature."""
    has_bot = "is_bot" in profile.columns
    bot = F.col("is_bot") if has_bot else F.lit(False)
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = settled(profile.select(bot.alias("bot"), names.alias("f")).select("bot", "f.*"))
    quartiles = exact_quantiles(rows, "x", [0.25, 0.5, 0.75], ["feature"])
    quartiles = quartiles.select("feature", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "median", "q75"))])
    found = rows.groupBy("feature").agg(
        F.count("x").alias("n"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("least"),
        F.max("x").alias("top"),
        F.avg(F.when(F.col("bot"), F.col("x"))).alias("bot_mean"),
        F.avg(F.when(~F.col("bot"), F.col("x"))).alias("other_mean"),
    )
    return found.join(F.broadcast(quartiles), "feature", "left")


def correlations(profile: DataFrame, columns: list[str], label: str = "is_bot") -> DataFrame:
    """Pearson correlation of each feature with a flag."""
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = profile.select(F.col(label).cast("double").alias("y"), names.alias("f")).select("y", "f.*")
    return rows.groupBy("feature").agg(F.corr("x", "y").alias("correlation"))


def effect_sizes(profile: DataFrame, columns: list[str], label: str = "is_bot") -> DataFrame:
    """Cohen's d of each feature between the flag's two groups, with pooled deviation."""
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    rows = profile.select(F.col(label).alias("y"), names.alias("f")).select("y", "f.*")
    a, b = F.when(F.col("y"), F.col("x")), F.when(~F.col("y"), F.col("x"))
    found = rows.groupBy("feature").agg(
        F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb")
    )
    pooled = F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), F.col("na") + F.col("nb") - 2)
    return found.select("feature", F.coalesce(F.when(pooled > 0, (F.col("ma") - F.col("mb")) / F.sqrt(pooled)), F.lit(0.0)).alias("effect_size"))


def correlation_matrix(profile: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of each pair of features, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = profile.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("correlation")) for a, b in pairs]).alias("p"))
    return row.select(F.explode("p").alias("p")).select("p.*")


def histogram(profile: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, n) over equal widths between the least and the greatest value."""
    ends = profile.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rows = profile.where(F.col(column).isNotNull()).join(F.broadcast(ends))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return rows.groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def geographic(profile: DataFrame, least: int = 10) -> DataFrame:
    """Locations, events and bot percentage of countries with enough locations."""
    rows = profile.groupBy("country").agg(
        F.count(F.lit(1)).alias("locations"), F.sum("total_downloads").alias("downloads"), (100 * F.avg(F.col("is_bot").cast("double"))).alias("bot_percent")
    )
    return rows.where(F.col("locations") >= least)


def city_rollup(profile: DataFrame, more_than: int = 100000, k: int = 50) -> DataFrame:
    """Cities above a number of events, by events a user; placeholders for countries are left out."""
    rows = profile.where(known_country(F.col("country"))).groupBy("country", "city").agg(
        F.sum("total_downloads").alias("downloads"), F.sum("unique_users").alias("users"), F.count(F.lit(1)).alias("locations")
    )
    rows = rows.where(F.col("downloads") > more_than).withColumn("downloads_per_user", F.try_divide("downloads", "users"))
    return rows.orderBy(F.col("downloads_per_user").desc(), "country", "city").limit(k)


def hierarchy(labelled: DataFrame) -> DataFrame:
    """Locations, users and events of each behaviour and category."""
    return labelled.groupBy("behavior_type", F.coalesce("automation_category", F.lit("")).alias("automation_category")).agg(
        F.count(F.lit(1)).alias("locations"), F.sum("unique_users").alias("users"), F.sum("total_downloads").alias("downloads")
    )


def top_locations(labelled: DataFrame, flag: str, k: int = 20) -> DataFrame:
    return labelled.where(F.col(flag)).orderBy(F.col("total_downloads").desc(), LOC).limit(k)


def text_report(labelled: DataFrame, title: str = "Location report") -> str:
    """A short report from a few small aggregates."""
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("total_downloads").alias("d")).first()
    lines = [title, "=" * len(title), f"locations: {total['n']}, events: {short_number(total['d'] or 0)}", ""]
    for r in hierarchy(labelled).orderBy("behavior_type", "automation_category").collect():
        lines.append(f"{r['behavior_type']:10} {r['automation_category'] or '-':22} {r['locations']:8} locations {short_number(r['downloads']):>8} events")
    for flag, name in (("is_bot", "bots"), ("is_hub", "hubs")):
        lines += ["", f"largest {name}:"]
        lines += [f"  {r[LOC]} ({r['country']}): {short_number(r['total_downloads'])}" for r in top_locations(labelled, flag, 10).collect()]
    return "\n".join(lines) + "\n"


def html_report(labelled: DataFrame, title: str = "Location report") -> str:
    """The same aggregates as tables of a page."""
    from html import escape

    def table(df: DataFrame) -> str:
        rows = [df.columns] + [list(map(str, r)) for r in df.collect()]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"

    parts = [table(hierarchy(labelled).orderBy("behavior_type", "automation_category"))]
    columns = (LOC, "country", "unique_users", "total_downloads", "downloads_per_user")
    parts += [f"<h2>{name}</h2>" + table(top_locations(labelled, flag).select(*columns)) for flag, name in (("is_bot", "Bots"), ("is_hub", "Hubs"))]
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{''.join(parts)}</body></html>"


def yearly_by_label(annotated: DataFrame) -> DataFrame:
    """Events by year and label."""
    from tidelog.operators.evaluate import unified

    rows = annotated.groupBy(F.year("ts").alias("yr"), unified(annotated).alias("label")).agg(F.count(F.lit(1)).alias("downloads"))
    return rows.withColumn("share", F.col("downloads") / F.sum("downloads").over(Window.partitionBy("yr")))
