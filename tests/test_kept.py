"""Kept grains, bounded samples and the log of view C at sizes that a task can hold."""

import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import catalog
from tidelog.fixtures import view_c
from tidelog.grains import Grains
from tidelog.operators import ordered, profile

LOC = "geo_location"


def log(spark, rows):
    schema = "geo_location string, country string, city string, usr string, accession string, method string, filename string, ts timestamp_ntz, event_id long"
    return spark.createDataFrame(rows, schema)


def test_events_of_a_location_stay_together(spark):
    """F1, F5 to F24: dealt in turns, each of 32 tasks had events of each location, so that nothing was added up before a shuffle."""
    rows = view_c(spark, "/root/testdata/sf0.01").select(LOC, F.spark_partition_id().alias("p"))
    places, tasks = rows.distinct().groupBy(LOC).count().agg(F.count(F.lit(1)), F.sum("count")).first()
    assert tasks < 10 * places


def test_labels_read_neither_files_nor_sessions(spark):
    """F5 to F24: the rules read four columns of the log, which is all that is written of it."""
    g = catalog.c(spark, "/root/testdata/sf0.01", *catalog.RULED)
    assert g.events.columns == list(catalog.RULED)
    assert "num_sessions" not in catalog.labelled(g).columns


def test_kept_grains_equal_lazy_ones(spark):
    start = datetime(2021, 1, 4)
    rows = [(f"l{i % 3}", "X", "c", None if i % 7 == 0 else f"u{i % 5}", "d", "ftp", "f", start + timedelta(minutes=97 * i), i) for i in range(300)]
    rows += [("only null", "X", None, None, None, None, None, start, 1000), (None, "X", None, "u", None, None, None, start, 1001)]
    lazy, kept = Grains(log(spark, rows)), Grains(log(spark, rows)).keep()
    both = [(getattr(lazy, n), getattr(kept, n)) for n in ("hours", "days", "weeks", "years", "clock", "users", "sizes")]
    both += [(lazy.bucket("month"), kept.bucket("month")), (profile.basic(lazy), profile.basic(kept)), (ordered.session_behavior(lazy), ordered.session_behavior(kept))]
    for a, b in both:
        assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_bounded_samples_are_those_of_lowest_hash(spark):
    """Also where chance leaves too few hashes below the bound: all ids of location high have high ones."""
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    start = datetime(2021, 1, 4)
    high = [i for i in range(30_000) if digest(i)[0] in "ef"][:3000]
    ids = {"high": high, "large": range(30_000, 38_000), "few": range(40_000, 40_007)}
    rows = [(k, None, None, None, None, None, None, start + timedelta(seconds=i), i) for k, own in ids.items() for i in own]
    want = {(k, i) for k, own in ids.items() for i in sorted(own, key=digest)[:20]}
    for g in (Grains(log(spark, rows)), Grains(log(spark, rows)).keep()):
        assert {(r[LOC], r["event_id"]) for r in ordered.sampled(g, 20).collect()} == want


def test_intervals_are_those_of_all_events(spark):
    """mean and deviation were those of 50 events a location; over midnight, on equal times and for a single event too."""
    start, rng = datetime(2021, 1, 4, 20), np.random.default_rng(3)
    steps = {"many": rng.integers(0, 4000, 400), "even": np.full(90, 3600), "one": np.zeros(1, int), "two": np.array([0, 90_000 * 3])}
    own = {k: np.cumsum(v) for k, v in steps.items()}
    ids = iter(range(1000))
    rows = [(k, None, None, None, None, None, None, start + timedelta(seconds=int(s)), next(ids)) for k, v in own.items() for s in v]
    for g in (Grains(log(spark, rows)), Grains(log(spark, rows)).keep()):
        got = {r[LOC]: r for r in ordered.intervals(g, None).collect()}
        assert got.keys() == own.keys()
        for k, gap in ((k, np.diff(v)) for k, v in own.items()):
            mean, sd = gap.mean() if len(gap) else None, gap.std(ddof=1) if len(gap) > 1 else None
            assert got[k]["mean_interval"] == (None if mean is None else pytest.approx(mean))
            assert got[k]["std_interval"] == (None if sd is None else pytest.approx(sd))
            assert got[k]["interval_cv"] == (1.0 if mean is None else None if sd is None else pytest.approx(sd / mean))
            assert got[k]["regularity_score"] == pytest.approx(mean / (sd + 1) if sd else 0.0)


@pytest.mark.parametrize("name", ["class_rules", "eval_class_metrics", "eval_confusion", "stat_geographic", "stat_yearly_by_label"])
def test_labels_sample_no_events(spark, monkeypatch, name):
    """F2 to F6: regularity, on which labels depend, came from 50 events a location, in the query and in its SQL."""

    def refused(*_):
        raise AssertionError("sampled")

    monkeypatch.setattr(ordered, "sampled", refused)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert "sampled" not in catalog.oracle_sql()[name]
