"""Scores composed from columns of the location profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import EPSILON, clip
from tidelog.operators.order import quantiles_of
from tidelog.storage import settled


def _scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column between its 1st and 99th percentile, as _<name>; 0 where they are equal."""
    ends = quantiles_of(df, {c: [0.01, 0.99] for c in columns})
    for c, (low, high) in ends.items():
        wide = low is not None and high - low > EPSILON
        df = df.withColumn(f"_{c}", F.coalesce(clip((F.col(c) - low) / (high - low), 0.0, 1.0), F.lit(0.0)) if wide else F.lit(0.0))
    return df


def composite(profile: DataFrame) -> DataFrame:
    """Malicious and legitimate automation scores, their difference and flags, added to profile.

    Weights are fixed values; those of the legitimate score sum to more than
    one, so it is cut at one. geographic_stability is 0.5 for all.
    """
    scaled = ["file_exploration_score", "bot_farm_score", "file_mirroring_score", "user_authenticity_score", "persistence_score"]
    df = _scaled(settled(profile), scaled).withColumn("geographic_stability", F.lit(0.5))
    bad = (
        0.25 * F.col("_file_exploration_score")
        + 0.30 * F.col("_bot_farm_score")
        + 0.20 * (1 - F.col("geographic_stability"))
        + 0.15 * F.col("targets_latest_only")
        + 0.10 * (1 - clip(F.col("activity_density"), 0.0, 1.0))
    )
    good = (
        0.30 * F.col("_file_mirroring_score")
        + 0.25 * F.col("_user_authenticity_score")
        + 0.20 * F.col("geographic_stability")
        + 0.25 * F.col("_persistence_score")
        + 0.15 * F.col("protocol_legitimacy_score")
    )
    df = df.withColumn("malicious_bot_score", clip(bad, 0.0, 1.0)).withColumn("legitimate_automation_score", clip(good, 0.0, 1.0))
    df = df.withColumn("bot_vs_legitimate_score", F.col("malicious_bot_score") - F.col("legitimate_automation_score"))
    df = df.withColumn("is_likely_malicious", (F.col("bot_vs_legitimate_score") > 0.3).cast("int"))
    df = df.withColumn("is_likely_legitimate_automation", (F.col("bot_vs_legitimate_score") < -0.3).cast("int"))
    return df.drop(*[f"_{c}" for c in scaled])


def interaction(profile: DataFrame) -> DataFrame:
    """Products of users, events and anomaly, and their weighted composite, added to profile.

    A component whose 95th percentile is 0 drops out and the weights are
    scaled to one, as are those without anomaly_score.
    """
    users, dpu = F.col("unique_users"), F.col("downloads_per_user")
    df = profile.withColumns(
        {
            "dl_user_per_log_users": dpu / F.log(users + 2),
            "user_scarcity_score": F.when(dpu > 20, F.exp(-users / 100)).otherwise(0.0),
            "download_concentration": dpu / (users + 1),
            "temporal_irregularity": 1 / (F.col("hourly_entropy") + 0.1) * F.log(dpu + 1),
        }
    )
    has_anomaly = "anomaly_score" in profile.columns
    anomaly = clip(F.col("anomaly_score") + 0.5, 0.0, 1.0) if has_anomaly else None
    if has_anomaly:
        df = df.withColumn("anomaly_dl_interaction", anomaly * dpu)
    tops = ["dl_user_per_log_users", "download_concentration"]
    df = settled(df)
    ends = {c: q for c, (q,) in quantiles_of(df, {c: [0.95] for c in tops}).items()}
    parts = [(0.3, "dl_user_per_log_users"), (0.25, "user_scarcity_score"), (0.25, "download_concentration")]
    total, weights = F.lit(0.0), 0.0
    for weight, name in parts:
        if name not in tops:
            total, weights = total + weight * F.col(name), weights + weight
        elif (ends[name] or 0.0) > EPSILON:
            total, weights = total + weight * clip(F.col(name) / ends[name], 0.0, 1.0), weights + weight
    if has_anomaly:
        total, weights = total + 0.2 * anomaly, weights + 0.2
    return df.withColumn("bot_composite_score", total / weights)


def signature(profile: DataFrame) -> DataFrame:
    """Stand-ins for request-level signals, from aggregate columns, added to profile."""
    users, dpu, work = F.col("unique_users"), F.col("downloads_per_user"), F.col("working_hours_ratio")
    df = settled(profile)
    ((top,), (mid,)) = quantiles_of(df, {"unique_users": [1.0], "downloads_per_user": [0.5]}).values()
    top, mid = F.lit(top), F.lit(mid)
    return df.withColumns(
        {
            "access_regularity": 1.0 / (F.col("hourly_entropy") + 0.1),
            "ua_per_user": 1.0 / (users / (F.col("total_downloads") + 1) + 0.01),
            "request_velocity": F.col("total_downloads") / (work * 24 * 7 + 1),
            "ip_concentration": 1.0 - F.log1p(users) / F.log1p(top + 1),
            "session_anomaly": F.abs(dpu - mid) / (mid + 1),
            "request_pattern_anomaly": 1.0 / (dpu / (F.log1p(users) + 1) + 0.1),
            "weekend_weekday_imbalance": F.abs(work - 0.5),
        }
    )
