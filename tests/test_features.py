"""Feature operators on hand-made logs with hand-computed answers."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog.functions.columns import gini, haversine, short_number
from tidelog.grains import Grains
from tidelog.operators import ordered, profile, proximity, rules
from tidelog.operators.order import rank_percent
from tidelog.schema import LogSchema, canonical, get_schema, override

START = datetime(2024, 1, 1)
SCHEMA = "geo_location string, country string, city string, usr string, accession string, method string, filename string, ts timestamp_ntz, event_id long"


def log(spark, rows):
    full = [(r.get("loc", "L"), r.get("country", "C"), None, r.get("usr", "u"), r.get("acc", "A"), r.get("method"), r.get("file"), r.get("ts", START), i) for i, r in enumerate(rows)]
    return Grains(spark.createDataFrame(full, SCHEMA))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_session_gap_edges(spark):
    times = [0, 1799, 1799 + 1800, 1799 + 1800 + 1801]
    g = log(spark, [{"ts": START + timedelta(seconds=t)} for t in times])
    rows = ordered.sessions(g).orderBy("session").collect()
    assert [r["n"] for r in rows] == [3, 1]
    assert rows[1]["before"] == 1801


def test_sessions_and_file_order_match_a_plain_walk_over_days(spark):
    draw = np.random.default_rng(5)
    at = np.sort(draw.choice(draw.integers(0, 6 * 86400, 90), 160))
    at = np.concatenate([at, [86400 - 600, 86400 + 600, 3 * 86400 - 1, 3 * 86400]])
    names = [f"f{draw.integers(0, 30):02d}.raw" if draw.random() > 0.1 else "plain.raw" for _ in at]
    g = log(spark, [{"ts": START + timedelta(seconds=int(t)), "file": n} for t, n in zip(at, names, strict=True)])
    order = sorted(range(len(at)), key=lambda i: (at[i], i))
    want = []
    for i in order:
        if not want or at[i] - want[-1]["to"] > 1800:
            want.append({"from": at[i], "before": at[i] - want[-1]["to"] if want else None, "n": 0, "hours": set()})
        want[-1]["to"] = at[i]
        want[-1]["n"] += 1
        want[-1]["hours"].add(int(at[i] // 3600 % 24))
    got = ordered.sessions(g).orderBy("session").collect()
    assert [(r["n"], r["duration"], r["before"], r["hour"]) for r in got] == [(w["n"], w["to"] - w["from"], w["before"], min(w["hours"])) for w in want]
    rank = {n: i + 1 for i, n in enumerate(sorted(set(names)))}
    places = np.array([rank[names[i]] for i in order], dtype=float)
    walk = np.arange(1, len(order) + 1)
    cov = (walk * places).mean() - walk.mean() * places.mean()
    numbers = [int(names[i][1:3]) if names[i][0] == "f" else None for i in order]
    pairs = [(a, b) for a, b in zip(numbers, numbers[1:]) if a is not None]
    steps = [b is not None and abs(a - b) == 1 for a, b in pairs]
    row = one(ordered.access_pattern(g))
    assert row["alphabetical_access_score"] == pytest.approx(cov / (walk.std(ddof=1) * places.std(ddof=1)))
    assert row["sequential_file_ratio"] == pytest.approx(np.mean(steps))


def test_single_event_takes_defaults(spark):
    g = log(spark, [{}])
    assert one(ordered.session_behavior(g))["session_duration_cv"] == 1.0
    assert one(ordered.timing_precision(g))["millisecond_variance"] == 250000.0
    assert one(profile.outburst(g))["time_since_last_outburst"] == 1.0
    assert one(profile.shape(g))["tail_heaviness_ratio"] == 1.0
    assert one(profile.trend(g))["trend_slope"] == 0.0


def test_night_wraps_midnight(spark):
    g = log(spark, [{"ts": START + timedelta(hours=h)} for h in (21, 22, 23, 0, 5, 6, 9, 16, 17)])
    row = one(profile.time_of_day(g))
    assert row["night_activity_ratio"] == pytest.approx(4 / 9)
    assert row["working_hours_ratio"] == pytest.approx(2 / 9)


def test_dense_clock_matches_numpy(spark):
    hours = [0, 0, 1, 5, 5, 5, 23]
    row = one(profile.time_of_day(log(spark, [{"ts": START + timedelta(hours=h)} for h in hours])))
    counts = np.bincount(hours, minlength=24)
    p = counts / counts.sum() + 1e-10
    p /= p.sum()
    assert row["hourly_download_std"] == pytest.approx(counts.std())
    assert row["hourly_entropy"] == pytest.approx(-(p * np.log(p)).sum())


def test_years_that_only_others_have_count_as_zero(spark):
    rows = [{"loc": "A", "ts": datetime(2021, 1, 1)}] * 3 + [{"loc": "B", "ts": datetime(y, 1, 1)} for y in (2020, 2021, 2022, 2022)]
    found = {r["geo_location"]: r for r in profile.yearly(log(spark, rows)).collect()}
    p = np.array([1, 1, 2]) / 4
    assert found["B"]["year_over_year_cv"] == pytest.approx(p.std(ddof=1) / (p.mean() + 1e-10))
    q = np.array([0, 1, 0]) + 1e-10
    q /= q.sum()
    assert found["A"]["yearly_entropy"] == pytest.approx(-(q * np.log(q)).sum())
    assert found["A"]["year_over_year_cv"] == 0
    assert found["B"]["spike_ratio"] == pytest.approx(2.0)


@pytest.mark.parametrize(("values", "want"), [([1], 0.5), ([1, 1, 1, 1], 0.0), ([1, 9], 0.4)])
def test_gini(spark, values, want):
    array = spark.createDataFrame([([float(v) for v in values],)], "x array<double>")
    assert one(array.select(gini(F.col("x")).alias("g")))["g"] == pytest.approx(want)
    rows = [{"usr": f"u{i}"} for i, v in enumerate(values) for _ in range(v)]
    assert one(profile.user_distribution(log(spark, rows)))["user_gini_coefficient"] == pytest.approx(want)


def test_rank_percent_averages_ties(spark):
    df = spark.createDataFrame([(1,), (1,), (3,)], "x int")
    assert sorted(r["p"] for r in rank_percent(df, "x", "p").collect()) == pytest.approx([0.5, 0.5, 1.0])


def test_peer_bins_match_pandas(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame(
        {
            "geo_location": [f"L{i}" for i in range(60)], "country": "C", "unique_users": rng.integers(1, 6, 60), "downloads_per_user": rng.random(60) * 9,
            "total_downloads": rng.integers(1, 9, 60), "spike_ratio": 1.0, "years_before_latest": 1,
        }
    )
    got = profile.comparative(spark.createDataFrame(frame)).toPandas().set_index("geo_location").sort_index()
    want = frame.set_index("geo_location").sort_index()
    bins = pd.qcut(want["unique_users"], 10, labels=False, duplicates="drop")
    peer = want.groupby(bins)["downloads_per_user"].transform("median")
    assert np.allclose(got["peer_similarity"], 1 / (1 + (want["downloads_per_user"] - peer).abs() / (peer + 1)))
    assert np.allclose(got["global_rank_percentile"], want["total_downloads"].rank(pct=True))


def test_streak_is_over_active_days(spark):
    counts = [1] * 12 + [30, 30] + [1] * 12 + [30]
    rows = [{"ts": START + timedelta(days=2 * d)} for d, n in enumerate(counts) for _ in range(n)]
    row = one(profile.outburst(log(spark, rows)))
    assert row["longest_outburst_streak"] == 2
    assert row["outburst_count"] == 3


def test_benford_needs_ten_days(spark):
    g = log(spark, [{"ts": START + timedelta(days=d)} for d in range(9)])
    assert one(profile.statistical(g))["benford_deviation"] == 0
    g = log(spark, [{"ts": START + timedelta(days=d)} for d in range(10)])
    expected = np.array([0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046])
    seen = np.array([1.0] + [0.0] * 8)
    assert one(profile.statistical(g))["benford_deviation"] == pytest.approx((((seen - expected) ** 2) / (expected + 0.01)).sum())


@pytest.mark.parametrize(("weeks", "want"), [([1, 5], 0.0), ([1, 2, 3], None), ([2, 2, 2, 4, 4, 4], 1.0)])
def test_momentum(spark, weeks, want):
    rows = [{"ts": START + timedelta(weeks=w)} for w, n in enumerate(weeks) for _ in range(n)]
    if want is None:
        w = np.array([0.49, 0.7, 1.0])
        base = (w * weeks).sum() / w.sum()
        want = (2 - base) / base
    assert one(profile.recency(log(spark, rows)))["momentum_score"] == pytest.approx(want)


def test_monthly_spike_uses_a_floor(spark):
    months = spark.createDataFrame([("L", i, n) for i, n in enumerate([10, 10, 10, 10, 100])], "geo_location string, at int, n long")
    assert one(rules.monthly_spikes(months))["spike_score"] == 1.0


def test_window_sequence_is_padded(spark):
    rows = [{"ts": datetime(2024, m, 1)} for m in (1, 1, 2, 3, 3, 3)]
    v = one(ordered.window_sequence(log(spark, rows)))["time_series_features"]
    assert np.array(v).shape == (12, 12)
    assert not np.array(v)[:9].any()
    assert np.array(v)[9:, 0].tolist() == [2, 1, 3]
    assert np.array(v)[11, 10] == pytest.approx(0.5)


def test_periodicity_finds_a_week(spark):
    rows = [{"ts": START + timedelta(days=d)} for d in range(42) for _ in range(20 if d % 7 == 0 else 2)]
    row = one(ordered.periodicity(log(spark, rows)))
    assert row["weekly_autocorr"] > 0.9
    assert min(abs(row["dominant_period_days"] - p) for p in (7, 3.5, 7 / 3)) < 1e-6


def test_haversine(spark):
    row = one(spark.range(1).select(*[haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(x)).alias(n) for n, x in (("same", 0.0), ("deg", 1.0))]))
    assert row["same"] == 0
    assert row["deg"] == pytest.approx(111.19, abs=0.01)


def test_proximity_does_not_cross_countries(spark):
    df = spark.createDataFrame([("0,0", "A", 9), ("0,0.05", "A", 5), ("0,0.04", "B", 7), ("x", "A", 1)], "geo_location string, country string, total_downloads long")
    groups = {(r["geo_location"], r["country"]): r["group"] for r in proximity.proximity_groups(df).collect()}
    assert groups[("0,0.05", "A")] == "0,0"
    assert groups[("0,0.04", "B")] == "0,0.04"
    assert groups[("x", "A")] == "x"


def test_canonical_fills_missing_roles_and_casts_text_times(spark):
    df = spark.createDataFrame([("1,2", "2024-01-01T10:00:00")], "place string, at string")
    schema = override(LogSchema(), location_field="place", timestamp_field="at")
    row = one(canonical(df, schema))
    assert row["geo_location"] == "1,2"
    assert row["usr"] is None
    assert row["ts"] == datetime(2024, 1, 1, 10)
    with pytest.raises(KeyError):
        get_schema("nothing")


def test_short_numbers():
    assert [short_number(x) for x in (12, 4560, 1234567)] == ["12", "4.6K", "1.2M"]
    assert math.isfinite(float(short_number(3)))


def test_ratio_of_hours_is_one_division(spark):
    hours = [9, 9, 10, 11, 12, 13, 15, 16] + [0, 1, 2, 3, 4, 5, 6, 7, 8, 17, 18, 19, 20, 21, 22, 23, 23]
    g = log(spark, [{"ts": START + timedelta(hours=h)} for h in hours])
    row = one(profile.time_of_day(g))
    assert row["working_hours_ratio"] == 8 / 25
    assert row["night_activity_ratio"] == 9 / 25
