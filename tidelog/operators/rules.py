"""Classification by rules: a taxonomy of patterns compiled to predicates, and fixed label chains."""

from __future__ import annotations

import copy
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.columns import all_of, any_of

# The live patterns; bounds include their ends.
TAXONOMY = {
    "behavior_type": {
        "organic": {
            "patterns": [
                {"id": "working_hours_human", "working_hours_ratio": {"min": 0.4}, "regularity_score": {"max": 0.6}},
                {"id": "irregular_intervals", "interval_cv": {"min": 0.7}},
                {"id": "low_user_count_organic", "unique_users": {"max": 50}, "downloads_per_user": {"min": 1, "max": 200}},
            ]
        },
        "automated": {
            "patterns": [
                {"id": "high_regularity", "regularity_score": {"min": 0.7}},
                {"id": "non_working_hours", "working_hours_ratio": {"max": 0.25}, "night_activity_ratio": {"min": 0.35}},
                {"id": "high_coordination", "user_coordination_score": {"min": 0.6}, "unique_users": {"min": 100}},
                {"id": "very_high_volume", "downloads_per_user": {"min": 500}},
                {"id": "many_users_pattern", "unique_users": {"min": 1000}, "downloads_per_user": {"max": 50}},
            ]
        },
    },
    "automation_category": {
        "bot": {
            "patterns": [
                {"id": "many_users_low_dl", "unique_users": {"min": 1000}, "downloads_per_user": {"max": 50}},
                {"id": "coordinated_activity", "user_coordination_score": {"min": 0.7}, "user_authenticity_score": {"max": 0.4}},
                {"id": "ground_truth_bot", "unique_users": {"min": 10000}, "downloads_per_user": {"max": 10}},
                {"id": "suspicious_timing", "night_activity_ratio": {"min": 0.5}, "unique_users": {"min": 500}, "working_hours_ratio": {"max": 0.2}},
            ]
        },
        "legitimate_automation": {
            "patterns": [
                {"id": "mirror_pattern", "downloads_per_user": {"min": 500}, "unique_users": {"max": 100}},
                {"id": "high_volume_institution", "total_downloads": {"min": 100000}, "downloads_per_user": {"min": 50, "max": 500}, "working_hours_ratio": {"min": 0.25}},
                {"id": "ci_cd_pattern", "unique_users": {"max": 10}, "regularity_score": {"min": 0.7}, "downloads_per_user": {"min": 20, "max": 500}},
                {"id": "automated_sync_pattern", "unique_users": {"max": 5}, "regularity_score": {"min": 0.6}, "downloads_per_user": {"min": 50}},
            ]
        },
    },
}
NOTES = ("id", "description", "name", "note")
SECTIONS = ("behavior_type", "automation_category", "hub_protection", "thresholds", "rule_based")


def merge_taxonomy(base: Mapping, override: Mapping) -> dict:
    """base with override laid over it: mappings merge, lists and values are replaced."""
    out = copy.deepcopy(dict(base))
    for key, value in override.items():
        if isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
            out[key] = merge_taxonomy(out[key], value)
        else:
            out[key] = copy.deepcopy(value)
    return out


def scaled_taxonomy(factor: float, taxonomy: Mapping = TAXONOMY, columns=("unique_users", "downloads_per_user", "total_downloads")) -> dict:
    """The taxonomy with its bounds on counts multiplied, for logs of another size."""
    out = copy.deepcopy(dict(taxonomy))
    for section in out.values():
        for kind in section.values():
            for pattern in kind["patterns"]:
                for column in columns:
                    if isinstance(pattern.get(column), dict):
                        pattern[column] = {end: bound * factor for end, bound in pattern[column].items()}
    return out


def pattern(spec: Mapping, columns) -> Column:
    """All bounds of a pattern; a column that is missing or null makes it false."""
    tests = []
    for name, bound in spec.items():
        if name in NOTES:
            continue
        if name not in columns:
            return F.lit(False)
        value = F.col(f"`{name}`")
        if isinstance(bound, Mapping):
            tests += [value >= bound["min"]] if bound.get("min") is not None else []
            tests += [value <= bound["max"]] if bound.get("max") is not None else []
        else:
            tests.append(value == bound)
    return F.coalesce(all_of(tests), F.lit(False)) if tests else F.lit(False)


def any_pattern(specs, columns) -> Column:
    return any_of(pattern(s, columns) for s in specs)


def behavior_type(df: DataFrame, taxonomy: Mapping = TAXONOMY) -> Column:
    """automated before organic; without a match, up to 100 users are organic."""
    kinds = taxonomy["behavior_type"]
    matches = lambda kind: any_pattern(kinds.get(kind, {}).get("patterns", ()), df.columns)
    return (
        F.when(matches("automated"), "automated")
        .when(matches("organic"), "organic")
        .when(F.col("unique_users") <= 100, "organic")
        .otherwise("automated")
    )


def automation_category(df: DataFrame, taxonomy: Mapping = TAXONOMY) -> Column:
    """For automated rows: legitimate before bot, then bounds on users and events; null for others."""
    kinds = taxonomy["automation_category"]
    matches = lambda kind: any_pattern(kinds.get(kind, {}).get("patterns", ()), df.columns)
    users, dpu = F.col("unique_users"), F.col("downloads_per_user")
    chain = (
        F.when(matches("legitimate_automation"), "legitimate_automation")
        .when(matches("bot"), "bot")
        .when((users > 500) & (dpu < 100), "bot")
        .when(dpu >= 100, "legitimate_automation")
        .otherwise("bot")
    )
    return F.when(F.col("behavior_type") == "automated", chain)


def flags(df: DataFrame) -> DataFrame:
    """is_bot, is_hub and is_organic from the two labels."""
    category = F.coalesce("automation_category", F.lit(""))
    return df.withColumns(
        {
            "is_bot": category == "bot",
            "is_hub": category == "legitimate_automation",
            "is_organic": F.col("behavior_type") == "organic",
        }
    )


def classify(df: DataFrame, taxonomy: Mapping = TAXONOMY) -> DataFrame:
    """behavior_type, automation_category, user_category and flags added to a location profile."""
    df = df.withColumn("behavior_type", behavior_type(df, taxonomy))
    df = df.withColumn("automation_category", automation_category(df, taxonomy))
    return flags(df).withColumn("user_category", F.when(F.col("is_bot"), "bot").when(F.col("is_hub"), "download_hub").otherwise("normal"))


def section_mask(df: DataFrame, specs, needs_anomaly: bool = True) -> Column:
    """Any pattern of a section, among anomalous rows if asked."""
    found = any_pattern(specs, df.columns)
    return F.coalesce(F.col("is_anomaly"), F.lit(False)) & found if needs_anomaly and "is_anomaly" in df.columns else found


def ground_truth(df: DataFrame) -> DataFrame:
    """ground_truth_label, _confidence and _criteria by ordered heuristics, first match kept."""
    u, d, t, w, n = (F.col(c) for c in ("unique_users", "downloads_per_user", "total_downloads", "working_hours_ratio", "night_activity_ratio"))
    # Condition, label, confidence, text.
    chain = [
        ((u >= 10000) & (d <= 10), "bot", 0.99, "users>=10000 dpu<=10"),
        ((u >= 5000) & (d <= 25), "bot", 0.95, "users>=5000 dpu<=25"),
        ((u >= 1000) & (d <= 50) & (w <= 0.3), "bot", 0.90, "users>=1000 dpu<=50 working<=0.3"),
        ((u <= 5) & (d >= 1000), "hub", 0.95, "users<=5 dpu>=1000"),
        ((u <= 20) & (d >= 500), "hub", 0.90, "users<=20 dpu>=500"),
        (u.between(10, 200) & (d >= 200) & (t >= 100000) & (w >= 0.2), "hub", 0.85, "users 10-200 dpu>=200 total>=100000 working>=0.2"),
        ((u <= 3) & (d <= 20) & (w >= 0.4), "organic", 0.95, "users<=3 dpu<=20 working>=0.4"),
        (u.between(3, 30) & d.between(5, 100) & (w >= 0.35), "organic", 0.90, "users 3-30 dpu 5-100 working>=0.35"),
        ((u <= 5) & (d <= 50) & (n <= 0.3), "organic", 0.85, "users<=5 dpu<=50 night<=0.3"),
    ]
    out = {"ground_truth_label": F.lit("uncertain"), "ground_truth_confidence": F.lit(0.0), "ground_truth_criteria": F.lit("")}
    for condition, label, confidence, text in reversed(chain):
        values = dict(zip(out, (F.lit(label), F.lit(confidence), F.lit(text)), strict=True))
        out = {name: F.when(condition, values[name]).otherwise(rest) for name, rest in out.items()}
    return df.withColumns(out)


def _bounds(df: DataFrame, *tests: tuple[str, str, float], skip_absent: bool = False) -> Column:
    """Tests on columns, all of them; with skip_absent one on a column that df lacks counts as met, else as failed."""
    compare = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
    if not skip_absent and any(c not in df.columns for c, _, _ in tests):
        return F.lit(False)
    met = [F.coalesce(compare[how](F.col(c), F.lit(bound)), F.lit(False)) for c, how, bound in tests if c in df.columns]
    return all_of(met) if met else F.lit(True)


def seeds(df: DataFrame) -> DataFrame:
    """Confidence of each location as a seed: organic_seed, bot_seed and hub_seed; null for none."""
    # The tiers of confident examples.
    small = [("unique_users", "<=", 10), ("downloads_per_user", "<=", 5), ("total_downloads", "<", 200), ("working_hours_ratio", ">", 0.3), ("night_activity_ratio", "<", 0.5), ("years_span", ">=", 2)]
    middle = [("unique_users", "<=", 50), ("downloads_per_user", "<=", 10), ("total_downloads", "<", 1000), ("working_hours_ratio", ">", 0.25), ("hourly_entropy", ">", 1.5), ("burst_pattern_score", "<", 0.5)]
    wide = [("unique_users", "<=", 200), ("downloads_per_user", "<=", 20), ("user_coordination_score", "<", 0.3), ("protocol_legitimacy_score", ">", 0.3)]
    organic = F.when(_bounds(df, *small, skip_absent=True), 1.0).when(_bounds(df, *middle, skip_absent=True), 0.7).when(_bounds(df, *wide, skip_absent=True), 0.4)
    farm = _bounds(df, ("unique_users", ">", 5000), ("downloads_per_user", "<", 50))
    nocturnal = _bounds(df, ("night_activity_ratio", ">", 0.8), ("working_hours_ratio", "<", 0.1))
    coordinated = _bounds(df, ("unique_users", ">", 10000), ("downloads_per_user", "<", 20))
    scraper = _bounds(df, ("unique_projects", ">", 15000))
    is_bot = farm | nocturnal | coordinated | scraper
    bot = F.when(farm & nocturnal, 0.95).when(is_bot & (F.col("unique_users") > 10000), 0.9).when(is_bot, 0.7)
    mirror = _bounds(df, ("downloads_per_user", ">", 500), ("unique_users", "<", 100))
    odd = _bounds(df, ("working_hours_ratio", "<", 0.1), ("night_activity_ratio", ">", 0.7))
    fast = any_of(F.coalesce(F.col(c) > x, F.lit(False)) for c, x in (("aspera_ratio", 0.3), ("globus_ratio", 0.1)) if c in df.columns)
    hub = F.when(mirror & ~odd & fast, 0.95).when(mirror & ~odd, 0.8)
    return df.withColumns({"organic_seed": organic, "bot_seed": bot, "hub_seed": hub})


def protect_hubs(df: DataFrame) -> DataFrame:
    """Locations that behave like mirrors or institutions keep the hub label: is_protected_hub, and labels set."""
    users, dpu = F.col("unique_users"), F.col("downloads_per_user")
    fast = any_of(F.coalesce(F.col(c) > x, F.lit(False)) for c, x in (("aspera_ratio", 0.3), ("globus_ratio", 0.1)) if c in df.columns)
    steady = (
        ((dpu > 500) & (users <= 200))
        | ((users <= 100) & (dpu > 100))
        | ((users <= 1) & (dpu > 50))
        | ((users <= 10) & (dpu > 200))
        | fast
    )
    odd = _bounds(df, ("working_hours_ratio", "<", 0.1), ("night_activity_ratio", ">", 0.7))
    scraper = _bounds(df, ("unique_projects", ">", 15000))
    kept = F.coalesce(steady & ~odd & ~scraper, F.lit(False))
    df = df.withColumn("is_protected_hub", kept)
    return flags(
        df.withColumns(
            {
                "behavior_type": F.when(kept, "automated").otherwise(F.col("behavior_type")),
                "automation_category": F.when(kept, "legitimate_automation").otherwise(F.col("automation_category")),
                "user_category": F.when(kept & (F.col("user_category") == "bot"), "download_hub").otherwise(F.col("user_category")),
            }
        )
    )


def temporal_anomaly(df: DataFrame) -> DataFrame:
    """temporal_anomaly_score: the mean of five signals of change; has_temporal_spike above 0.6."""
    clip = lambda x, high=1.0: F.least(F.greatest(x, F.lit(0.0)), F.lit(high))
    signals = [
        clip((F.col("fraction_latest_year") - 0.5) * 2),
        1 - 1 / (1 + F.col("spike_ratio") / 5),
        clip((F.least("recent_activity_ratio", F.lit(100.0)) - 1) / 10),
        clip(F.col("year_over_year_cv") / 3),
        clip(F.abs("momentum_score") / 5),
    ]
    score = sum((F.coalesce(s, F.lit(0.0)) for s in signals), F.lit(0.0)) / len(signals)
    return df.withColumn("temporal_anomaly_score", score).withColumn("has_temporal_spike", F.col("temporal_anomaly_score") > 0.6)


def monthly_spikes(months: DataFrame) -> DataFrame:
    """(geo_location, spike_score): modified z of monthly counts above 3.5, over 10, at most 1.

    months is geo_location, at, n; locations of under three months score 0.
    """
    loc = "geo_location"
    mids = months.groupBy(loc).agg(F.median("n").alias("mid"), F.count(F.lit(1)).alias("k"))
    rows = months.join(mids, loc).withColumn("off", F.abs(F.col("n") - F.col("mid")))
    found = rows.groupBy(loc).agg(F.median("off").alias("mad"), F.max("off").alias("top"), F.first("k").alias("k"))
    z = 0.6745 * F.col("top") / F.greatest("mad", F.lit(1.0))
    score = F.when((F.col("k") >= 3) & (z > 3.5), F.least(z / 10, F.lit(1.0))).otherwise(0.0)
    return found.select(loc, score.alias("spike_score"))


def refine(df: DataFrame, confidence: str = "classification_confidence") -> DataFrame:
    """Small quiet normal locations are independent users; low confidence needs review."""
    small = (F.col("unique_users") <= 10) & (F.col("downloads_per_user") <= 5) & (F.col("user_category") == "normal")
    return df.withColumn("user_category", F.when(small, "independent_user").otherwise(F.col("user_category"))).withColumn(
        "needs_review", F.coalesce(F.col(confidence) < 0.5, F.lit(True))
    )
