"""What each column of the location profile is: category, stage, operator and default."""

from __future__ import annotations

from dataclasses import dataclass

from tidelog.plans.pipeline import DEFAULTS

# The profile's columns by category. Stages: location, extraction, after_anomaly.
CATEGORIES = {
    "basic": "unique_users downloads_per_user avg_users_per_hour max_users_per_hour user_cv users_per_active_hour projects_per_user total_downloads active_hours years_active unique_projects time_series_features_present",
    "temporal": "hourly_download_std peak_hour_concentration working_hours_ratio hourly_entropy night_activity_ratio",
    "yearly": "yearly_entropy peak_year_concentration years_span downloads_per_year year_over_year_cv fraction_latest_year is_new_location spike_ratio years_before_latest latest_year_downloads",
    "country": "locations_per_country country_latest_year_dl country_total_dl country_avg_fraction_latest country_new_locations country_high_spike_locations country_low_dl_user_locations country_total_users country_fraction_latest country_new_location_ratio country_suspicious_location_ratio",
    "protocol": "http_ratio ftp_ratio aspera_ratio globus_ratio protocol_diversity protocol_legitimacy_score",
    "behavioral": "burst_pattern_score circadian_rhythm_deviation user_coordination_score hourly_cv_burst spike_intensity user_peak_ratio night_ratio_advanced work_ratio_advanced evening_ratio morning_ratio user_coordination_std avg_concurrent_users max_concurrent_users is_bursty_advanced is_nocturnal is_coordinated",
    "base_behavior": "mean_interval std_interval interval_cv regularity_score weekend_ratio unique_days_of_week file_concentration file_diversity_ratio num_sessions downloads_per_session is_mechanical is_weekday_biased is_single_file is_bursty",
    "interaction": "dl_user_per_log_users user_scarcity_score download_concentration temporal_irregularity bot_composite_score anomaly_dl_interaction",
    "signature": "request_velocity access_regularity ua_per_user ip_concentration session_anomaly request_pattern_anomaly weekend_weekday_imbalance",
    "clock_signature": "autocorrelation_lag1 circadian_deviation request_timing_entropy",
    "discriminative": "file_exploration_score file_mirroring_score file_entropy bot_farm_score user_authenticity_score user_homogeneity_score geographic_stability version_concentration targets_latest_only unique_versions lifespan_days activity_density persistence_score malicious_bot_score legitimate_automation_score bot_vs_legitimate_score is_likely_malicious is_likely_legitimate_automation",
    "timing": "request_interval_mode round_second_ratio millisecond_variance interval_entropy",
    "access_pattern": "alphabetical_access_score sequential_file_ratio directory_traversal_score retry_ratio unique_file_ratio",
    "user_distribution": "user_entropy user_gini_coefficient single_download_user_ratio power_user_ratio",
    "statistical": "benford_deviation hourly_uniformity_score weekday_pattern_score",
    "session": "session_duration_cv inter_session_regularity downloads_per_session_cv session_start_hour_entropy",
    "comparative": "country_zscore temporal_trend_anomaly peer_similarity global_rank_percentile",
    "outburst": "outburst_count outburst_intensity max_outburst_zscore outburst_ratio time_since_last_outburst longest_outburst_streak",
    "periodicity": "weekly_autocorr dominant_period_days periodicity_strength period_regularity",
    "trend": "trend_slope trend_strength trend_acceleration detrended_volatility trend_direction",
    "recency": "recent_activity_ratio recent_volatility_ratio recency_concentration momentum_score",
    "distribution": "download_skewness download_kurtosis tail_heaviness_ratio zero_day_ratio",
}
AFTER_ANOMALY = ("interaction", "signature")
# Columns that a column is computed from, where those are profile columns too.
NEEDS = {
    "projects_per_user": "unique_projects unique_users", "users_per_active_hour": "unique_users active_hours", "country_zscore": "downloads_per_user",
    "temporal_trend_anomaly": "spike_ratio years_before_latest", "peer_similarity": "unique_users downloads_per_user", "global_rank_percentile": "total_downloads",
    "dl_user_per_log_users": "downloads_per_user unique_users", "temporal_irregularity": "hourly_entropy downloads_per_user", "session_anomaly": "downloads_per_user",
    "request_velocity": "total_downloads working_hours_ratio", "malicious_bot_score": "file_exploration_score bot_farm_score targets_latest_only activity_density",
    "legitimate_automation_score": "file_mirroring_score user_authenticity_score persistence_score protocol_legitimacy_score",
}


@dataclass(frozen=True)
class Feature:
    name: str
    category: str
    stage: str
    default: float
    needs: tuple[str, ...]


def _stage(category: str, name: str) -> str:
    if category in AFTER_ANOMALY:
        return "after_anomaly"
    return "location" if category == "basic" and not name.startswith("time_series") else "extraction"


FEATURES = {
    name: Feature(name, category, _stage(category, name), DEFAULTS.get(name, 0), tuple(NEEDS.get(name, "").split()))
    for category, names in CATEGORIES.items()
    for name in names.split()
}


def get(name: str) -> Feature:
    return FEATURES[name]


def by_category(category: str) -> list[Feature]:
    return [f for f in FEATURES.values() if f.category == category]


def by_stage(stage: str) -> list[Feature]:
    return [f for f in FEATURES.values() if f.stage == stage]


def missing_needs(columns) -> dict[str, list[str]]:
    """Of the columns that are features, those whose inputs aren't among the columns."""
    have = set(columns)
    found = {c: [n for n in FEATURES[c].needs if n not in have] for c in columns if c in FEATURES}
    return {c: m for c, m in found.items() if m}


def summary() -> dict[str, int]:
    return {category: len(names.split()) for category, names in CATEGORIES.items()}
