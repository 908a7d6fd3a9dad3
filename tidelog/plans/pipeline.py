"""The whole way from a log to labels: profile, anomaly, classification, annotation."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.grains import Grains
from tidelog.operators import models, ordered, profile, rules, scores
from tidelog.operators.annotate import annotate
from tidelog.operators.order import quantiles_of
from tidelog.schema import LogSchema, canonical, get_schema
from tidelog.storage import settled

LOC = "geo_location"
#: A plug-in takes the profile so far, the events and the schema, and returns the profile widened.
Extractor = Callable[[DataFrame, DataFrame, LogSchema], DataFrame]

# What a location without rows for an operator gets.
DEFAULTS = {
    "http_ratio": 1.0, "protocol_diversity": 1, "protocol_legitimacy_score": 0.1, "user_entropy": 0.0,
    "single_download_user_ratio": 0.5, "power_user_ratio": 0.5, "user_gini_coefficient": 0.5, "unique_file_ratio": 1.0,
    "hourly_uniformity_score": 0.5, "peer_similarity": 0.5, "global_rank_percentile": 0.5, "user_peak_ratio": 1.0,
    "user_authenticity_score": 1.0, "version_concentration": 0.5, "lifespan_days": 1.0, "activity_density": 0.5,
    "file_mirroring_score": 10.0, "tail_heaviness_ratio": 1.0, "recent_activity_ratio": 1.0, "recent_volatility_ratio": 1.0,
}

ANOMALY_COLUMNS = (
    "unique_users", "downloads_per_user", "avg_users_per_hour", "max_users_per_hour", "users_per_active_hour", "projects_per_user",
    "hourly_download_std", "peak_hour_concentration", "working_hours_ratio", "hourly_entropy", "night_activity_ratio", "yearly_entropy",
    "peak_year_concentration", "downloads_per_year", "year_over_year_cv", "spike_ratio", "user_entropy", "user_gini_coefficient",
    "session_duration_cv", "inter_session_regularity", "interval_entropy", "outburst_ratio", "weekly_autocorr", "trend_slope",
    "recency_concentration", "momentum_score", "download_skewness", "protocol_legitimacy_score",
)


#: Operators to which a schema's least year applies; the others read a location's whole log.
RECENT = frozenset({"basic", "hourly_density", "yearly", "time_of_day", "protocol", "window_sequence"})


def _defaulted(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    plain = {c: DEFAULTS.get(c, 0) for c, kind in kinds.items() if kind in ("double", "bigint", "int", "float")}
    return df.fillna(plain)


def location_profile(events: DataFrame, schema: LogSchema | None = None, deep: bool = False, extra: tuple[Extractor, ...] = (), strict: bool = False, recent: frozenset[str] = RECENT) -> DataFrame:
    """One wide row a location.

    strict leaves out the base behaviour columns, so that rules over them
    never fire. deep adds burst, circadian, coordination, file and composite
    columns. extra plug-ins run last, in order. recent names the operators to
    which the schema's least year applies; the others read all years of the
    locations that have events since.
    """
    schema = schema or get_schema("canonical")
    log = canonical(events, schema)
    since, ever = Grains(log, schema.min_year).keep(), Grains(log).keep()
    of = lambda operator: since if operator.__name__ in recent else ever
    base = profile.basic(of(profile.basic), schema.min_location_downloads)
    years = profile.yearly(of(profile.yearly))
    parts = [profile.hourly_density(of(profile.hourly_density), base), years, profile.time_of_day(of(profile.time_of_day), schema)]
    plain = [profile.protocol, ordered.timing_precision, profile.user_distribution, ordered.session_behavior, ordered.access_pattern]
    plain += [profile.statistical, profile.outburst, ordered.periodicity, profile.trend, profile.recency, profile.shape, ordered.window_sequence]
    if deep:
        plain += [profile.burst, profile.circadian, profile.coordination, ordered.file_diversity]
        plain += [ordered.user_authenticity, ordered.version_targeting, profile.persistence]
    parts += [operator(of(operator)) for operator in plain] + [profile.country_context(base, years)]
    if not strict:
        parts.append(ordered.base_behavior(of(ordered.base_behavior)).drop("unique_files"))
    out = base
    for part in parts:
        out = out.join(part, LOC, "left")
    out = _defaulted(out)
    out = _defaulted(out.join(profile.comparative(out), LOC, "left"))
    if deep:
        out = settled(out)
        ((burst,), (together,)) = quantiles_of(out, {"burst_pattern_score": [0.75], "user_coordination_score": [0.75]}).values()
        out = out.withColumns(
            {
                "is_bursty_advanced": (F.col("burst_pattern_score") > F.lit(burst)).cast("int"),
                "is_coordinated": (F.col("user_coordination_score") > F.lit(together)).cast("int"),
                "is_nocturnal": (F.col("night_ratio_advanced") > 0.25).cast("int"),
            }
        )
        out = scores.composite(out)
    for plug_in in extra:
        out = plug_in(out, events, schema)
    return out


def with_anomaly(locations: DataFrame, contamination: float = 0.15) -> DataFrame:
    columns = [c for c in ANOMALY_COLUMNS if c in locations.columns]
    return models.add_anomaly(locations, columns, contamination)


def classify_by_rules(locations: DataFrame, taxonomy: Mapping = rules.TAXONOMY) -> DataFrame:
    return rules.classify(locations, taxonomy)


def classify_deep(locations: DataFrame, months: DataFrame | None = None, iterations: int = 200, epochs: int = 100) -> DataFrame:
    """Seeds, reconstruction, isolation, temporal change, fusion, then hub protection."""
    columns = [c for c in ANOMALY_COLUMNS if c in locations.columns]
    df = rules.seeds(locations)
    df = models.add_reconstruction(df, columns, epochs=epochs)
    df = models.add_isolation(df, columns)
    df = rules.temporal_anomaly(df)
    if months is not None:
        df = df.join(rules.monthly_spikes(months), LOC, "left")
        spike = F.coalesce("spike_score", F.lit(0.0))
        df = df.withColumn("temporal_anomaly_score", F.greatest("temporal_anomaly_score", spike))
        df = df.withColumn("has_temporal_spike", F.col("has_temporal_spike") | (spike > 0)).drop("spike_score")
    fused = columns + ["vae_score", "dif_score", "temporal_anomaly_score"] + [f"latent_{i}" for i in range(16)]
    # Kept, as training and labels both read it, and the months behind it read the log.
    df = models.fuse(settled(df), fused, iterations=iterations)
    is_bot, is_hub = F.col("predicted") == "bot", F.col("predicted") == "hub"
    df = df.withColumns(
        {
            "is_bot_neural": is_bot,
            "behavior_type": F.when(is_bot | is_hub, "automated").otherwise("organic"),
            "automation_category": F.when(is_bot, "bot").when(is_hub, "legitimate_automation"),
            "user_category": F.when(is_bot, "bot").when(is_hub, "download_hub").otherwise("normal"),
        }
    )
    return rules.protect_hubs(rules.refine(df)).drop("predicted")


def run(events: DataFrame, schema: LogSchema | None = None, method: str = "rules", taxonomy: Mapping = rules.TAXONOMY, **options) -> dict:
    """Profile, label and annotate: {'locations', 'annotated', 'bot_locations', 'hub_locations'}, all lazy frames."""
    if method not in ("rules", "deep"):
        raise ValueError(f"method is rules or deep, not {method!r}")
    schema = schema or get_schema("canonical")
    locations = location_profile(events, schema, deep=method == "deep")
    if method == "rules":
        labelled = classify_by_rules(locations, taxonomy)
    else:
        scored = scores.signature(scores.interaction(with_anomaly(locations)))
        months = Grains(canonical(events, schema), schema.min_year).bucket("month")
        labelled = classify_deep(scored, months, **options)
    return {
        "locations": labelled,
        "annotated": annotate(events, labelled, schema.location_field),
        "bot_locations": labelled.where("is_bot").select(LOC),
        "hub_locations": labelled.where("is_hub").select(LOC),
    }
