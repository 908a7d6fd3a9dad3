"""Ranks, running sums and exact quantiles against whole sorts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import analytics, order, profile

PROBABILITIES = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_equal_percentile_to_the_bit_through_several_cuts(spark):
    # A million different values, a third of all rows in one of them, and cells of at most a thousand rows.
    df = spark.range(1_500_000).select(F.when(F.col("id") % 3 == 0, F.lit(0.125)).otherwise(F.log(F.col("id") * 7919 % 1_500_007 + 1.5)).alias("x"))
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBABILITIES])).alias("q")).first()["q"]
    got = order.exact_quantiles(df, "x", PROBABILITIES, most=1000).first()["q"]
    assert got == want


@pytest.mark.parametrize("most", [1, 5, 1 << 20])
def test_quantiles_of_groups(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice("abc"), rng.choice([None, float(rng.randrange(-4, 5)), rng.random(), 1e300, -1e-300])) for _ in range(500)]
    rows += [(None, 3.0), (None, 5.0), ("none", None), ("one", 7.0), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBABILITIES])).alias("q")).collect() if r["q"]}
    got = {r["g"]: r["q"] for r in order.exact_quantiles(df, "x", PROBABILITIES, ["g"], most).collect()}
    assert {k: list(map(repr, v)) for k, v in got.items()} == {k: list(map(repr, v)) for k, v in want.items()}


def test_quantiles_of_no_rows(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert order.exact_quantiles(df, "x", [0.5]).count() == 0
    assert order.quantiles_of(df, {"x": [0.1, 0.9], "y": [0.5]}) == {"x": [None, None], "y": [None]}


def test_running_sums_and_cells(spark):
    rng = random.Random(3)
    rows = [(v, rng.randrange(100)) for v in rng.sample(range(-5000, 5000), 3000)]
    got = {r["v"]: r for r in order.running(spark.createDataFrame([*rows, (None, 5)], "v long, n long"), "v", ["n"]).collect()}
    below = 0
    for v, n in sorted(rows):
        assert (got[v]["n_before"], got[v]["n_all"]) == (below, sum(x for _, x in rows))
        below += n
    assert len(got) == len(rows)


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("downloads"), F.col("id").alias("accession"))
    for out in (order.rank_percent(df, "downloads", "p"), analytics.concentration(df), analytics.lorenz(df)):
        for line in plan(out).splitlines():
            if "Window [" in line:
                assert "windowspecdefinition(_cell" in line


def test_ranks_equal_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    values = rng.integers(0, 500, 4000)
    got = order.rank_percent(spark.createDataFrame(pd.DataFrame({"i": range(4000), "x": values})), "x", "p").toPandas().sort_values("i")
    assert np.allclose(got["p"], pd.Series(values).rank(pct=True))
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert {r["x"]: r["p"] for r in order.rank_percent(df, "x", "p").collect()} == {1.0: 0.5, 2.0: 1.0, None: None}


def test_lorenz_of_few_and_of_one(spark):
    for values in ([5], [1, 1, 1], [1, 9, 90], list(range(1, 250))):
        df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "accession string, downloads long")
        curve = {round(r["item_share"], 6): r["download_share"] for r in analytics.lorenz(df).collect()}
        sums = np.concatenate([[0], np.cumsum(sorted(values))]) / sum(values)
        assert len(curve) == 101
        assert np.allclose([curve[round(i / 100, 6)] for i in range(101)], np.interp(np.arange(101) / 100 * len(values), np.arange(len(values) + 1), sums))


def test_user_distribution_of_a_skewed_location_by_a_sort_of_its_users(spark):
    class Users:
        pass

    rng = random.Random(6)
    counts = {"big": [1 if rng.random() < 0.7 else int(rng.paretovariate(0.7)) for _ in range(20_000)], "one": [9], "ties": [3] * 25, "ten": [1, 1, 1, 1, 1, 1, 1, 1, 1, 11]}
    g = Users()
    g.users = spark.createDataFrame([(loc, f"u{i}", n) for loc, ns in counts.items() for i, n in enumerate(ns)], "geo_location string, usr string, n long")
    got = {r["geo_location"]: r for r in profile.user_distribution(g).collect()}
    for loc, ns in counts.items():
        ns, k, total = sorted(ns), len(ns), sum(ns)
        assert got[loc]["user_entropy"] == pytest.approx(-sum(n / total * math.log2(n / total + 1e-10) for n in ns))
        assert got[loc]["single_download_user_ratio"] == ns.count(1) / k
        assert got[loc]["power_user_ratio"] == pytest.approx(sum(ns[::-1][: int(max(k * 0.1, 1))]) / total)
        gini = 2 * sum((i + 1) * n for i, n in enumerate(ns)) / (k * total) - (k + 1) / k if k > 1 else 0.5
        assert got[loc]["user_gini_coefficient"] == pytest.approx(gini)


def test_places_of_names_in_a_large_group(spark):
    rng = random.Random(7)
    rows = [("big", f"f{rng.randrange(5000)}") for _ in range(9000)] + [("one", "x"), ("one", "x"), ("few", "b"), ("few", "a"), ("few", "É"), (None, "a"), ("few", None)]
    found = order.places(spark.createDataFrame(rows, "g string, v string").repartition(3), "g", "v")
    got = {(r["g"], r["v"]): r["place"] for r in found.collect()}
    for g in ("big", "one", "few"):
        names = sorted({v for h, v in rows if h == g and v is not None}, key=lambda v: v.encode())
        assert [got[g, v] for v in names] == list(range(1, len(names) + 1))
    assert len(got) == len({r for r in rows if None not in r})
