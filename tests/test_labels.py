"""Rules, annotation, sinks, evaluation, models and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog import catalog
from tidelog.operators import analytics, annotate, evaluate, models, rules
from tidelog.operators.reporting import html_report, text_report
from tidelog.plans import pipeline
from tidelog.schema import LogSchema
from tidelog.sources import readers
from tidelog.streaming import live

PROFILE = "geo_location string, unique_users long, downloads_per_user double, total_downloads long, working_hours_ratio double, night_activity_ratio double"


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("geo_location", *columns).collect()}


def test_precedence_and_fallbacks(spark):
    df = spark.createDataFrame(
        [
            ("both", 10, 600.0, 6000, 0.5, 0.1),
            ("organic", 10, 20.0, 200, 0.5, 0.1),
            ("few", 80, 0.5, 40, 0.3, 0.1),
            ("many", 600, 60.0, 36000, 0.3, 0.1),
            ("large", 600, 150.0, 90000, 0.3, 0.1),
            ("farm", 2000, 20.0, 40000, 0.3, 0.1),
        ],
        PROFILE,
    )
    got = rows(rules.classify(df), "behavior_type", "automation_category")
    assert got["both"] == ("automated", "legitimate_automation")
    assert got["organic"] == ("organic", None)
    assert got["few"] == ("organic", None)
    assert got["many"] == ("automated", "bot")
    assert got["large"] == ("automated", "legitimate_automation")
    assert got["farm"] == ("automated", "bot")


def test_missing_column_makes_a_pattern_false(spark):
    df = spark.createDataFrame([("a", 1)], "geo_location string, x int")
    test = lambda spec: df.select(rules.pattern(spec, df.columns).alias("p")).first()["p"]
    assert test({"id": "i", "x": {"min": 1, "max": 1}}) is True
    assert test({"id": "i", "x": 1}) is True
    assert test({"id": "i", "x": {"min": 1}, "y": {"min": 0}}) is False


def test_taxonomy_merge_replaces_lists_and_merges_mappings():
    out = rules.merge_taxonomy({"a": {"x": [1, 2], "y": 1}, "b": 1}, {"a": {"x": [3]}, "c": 2})
    assert out == {"a": {"x": [3], "y": 1}, "b": 1, "c": 2}


def test_ground_truth_keeps_the_first_match(spark):
    df = spark.createDataFrame([("a", 20000, 5.0, 100000, 0.2, 0.1), ("b", 3, 10.0, 30, 0.5, 0.1), ("c", 50, 60.0, 3000, 0.1, 0.5)], PROFILE)
    got = rows(rules.ground_truth(df), "ground_truth_label", "ground_truth_confidence")
    assert got == {"a": ("bot", 0.99), "b": ("organic", 0.95), "c": ("uncertain", 0.0)}


def test_seeds_and_hub_protection(spark):
    df = spark.createDataFrame([("bot", 20000, 5.0, 100000, 0.05, 0.9), ("hub", 20, 600.0, 12000, 0.3, 0.1), ("home", 3, 2.0, 6, 0.5, 0.1)], PROFILE)
    got = rows(rules.seeds(df), "organic_seed", "bot_seed", "hub_seed")
    assert got["bot"] == (None, 0.95, None)
    assert got["hub"] == (None, None, 0.8)
    assert got["home"][0] == 1.0
    kept = rows(rules.protect_hubs(rules.classify(df)), "is_protected_hub", "is_hub")
    assert kept["hub"] == (True, True)
    assert kept["bot"][0] is False


def test_annotate_keeps_rows_and_marks_unknown_as_organic(spark):
    events = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "geo_location string")
    labels = spark.createDataFrame([("a", True, False, False)], "geo_location string, is_bot boolean, is_hub boolean, is_organic boolean")
    got = sorted((r["geo_location"] or "", r["is_bot"], r["is_organic"]) for r in annotate.annotate(events, labels).collect())
    assert got == [("", False, True), ("a", True, False), ("a", True, False), ("z", False, True)]
    assert annotate.clean(events, labels).count() == 0


def test_junk_countries_are_left_out(spark):
    events = spark.createDataFrame([("France",), ("%{x}",), ("",), (None,)], "country string")
    kept = events.where(analytics.known_country(F.col("country"))).select("country", analytics.region(F.col("country")).alias("r")).collect()
    assert [(r["country"], r["r"]) for r in kept] == [("France", "Europe")]


def test_concentration_by_brute_force(spark):
    values = [1, 1, 2, 3, 5, 8, 100, 100]
    counts = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "accession string, downloads long")
    row = analytics.concentration(counts).first()
    x = np.sort(values)
    n = len(x)
    assert row["gini"] == pytest.approx(2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n)
    assert row["top_50_share"] == pytest.approx(x[-4:].sum() / x.sum())
    curve = analytics.lorenz(counts).orderBy("item_share").collect()
    want = np.interp(np.linspace(0, 1, 101), np.arange(n + 1) / n, np.append(0, np.cumsum(x)) / x.sum())
    assert np.allclose([r["download_share"] for r in curve], want)


def test_metrics_and_tests(spark):
    table = spark.createDataFrame([("bot", "bot", "hub"), ("bot", "organic", "bot"), ("organic", "organic", "organic"), ("hub", "organic", "hub")], "truth string, predicted string, other string")
    got = {r["label"]: r for r in evaluate.class_metrics(table).collect()}
    assert got["bot"]["precision"] == 1.0 and got["bot"]["recall"] == 0.5
    assert got["hub"]["f1"] == 0.0
    m = evaluate.mcnemar(table, "predicted", "other").first()
    assert (m["both_right"], m["only_a"], m["only_b"], m["neither"]) == (1, 1, 2, 0)
    assert evaluate.p_value(3.841) == pytest.approx(0.05, abs=1e-3)
    a = evaluate.agreement(table).first()
    assert a["agreement"] == 0.5
    f1, low, high = evaluate.bootstrap_f1({(r["truth"], r["predicted"]): r["n"] for r in evaluate.confusion(table).collect()})
    assert low <= f1 <= high
    assert evaluate.bootstrap_f1({}) == (0.0, 0.0, 0.0)


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(400, 3)), [[9, 9, 9], [-8, 9, 0]]])
    df = spark.createDataFrame([(f"L{i}", *map(float, v)) for i, v in enumerate(x)], "geo_location string, a double, b double, c double")
    out = models.add_anomaly(df, ["a", "b", "c"], 0.05, trees=60).orderBy(F.col("anomaly_score").desc()).limit(2).collect()
    assert {r["geo_location"] for r in out} == {"L400", "L401"}
    again = models.add_anomaly(df.repartition(7, "a"), ["a", "b", "c"], 0.05, trees=60).orderBy(F.col("anomaly_score").desc()).limit(2).collect()
    assert [r["anomaly_score"] for r in out] == [r["anomaly_score"] for r in again]
    assert models.add_anomaly(df, ["a", "b", "c"], 0.05, trees=60).where("is_anomaly").count() == 21


def test_deep_isolation_ranks_planted_outliers_first_on_any_partitioning(spark):
    # The odd ones keep within the range of each column, but not to the ring.
    rng = np.random.default_rng(3)
    turn = rng.uniform(0, 2 * np.pi, 500)
    x = np.vstack([np.c_[np.cos(turn), np.sin(turn)] * 5 + rng.normal(size=(500, 2)) * 0.2, [[0.0, 0.1], [9.0, 9.0]]])
    df = spark.createDataFrame([(f"L{i}", *map(float, v)) for i, v in enumerate(x)], "geo_location string, a double, b double")
    got = {r["geo_location"]: r["dif_score"] for r in models.add_isolation(df, ["a", "b"], networks=8, trees=25).collect()}
    assert set(sorted(got, key=got.get)[-2:]) == {"L500", "L501"} and min(got.values()) == 0 and max(got.values()) == 1
    again = models.add_isolation(df.repartition(9, "b"), ["a", "b"], networks=8, trees=25).collect()
    assert {r["geo_location"]: r["dif_score"] for r in again} == got


def test_locations_are_dealt_to_trees_by_hashes(spark):
    from tidelog.operators import isolation

    for n, size in ((50, 64), (300, 256), (3000, 64), (60_000, 32)):
        rows = spark.range(n).select(F.concat(F.lit("L"), "id").alias("geo_location"), F.array(F.col("id").cast("double")).alias("x"))
        found = isolation.dealt(rows, 20, size, 1).groupBy("tree").agg(F.count_distinct("geo_location").alias("k"), F.count(F.lit(1)).alias("n"), F.avg(F.col("x")[0]).alias("m")).collect()
        assert len(found) == 20 and all(r["k"] == r["n"] for r in found)
        assert all(min(n, size) * 0.85 <= r["n"] <= size or r["n"] == n for r in found)
        assert abs(np.mean([r["m"] for r in found]) - n / 2) < n / 8


def test_a_tree_isolates_as_its_cuts_say():
    from tidelog.operators import isolation

    x = np.random.default_rng(0).normal(size=(64, 3))
    feature, cut, upper = isolation.grow(x, np.random.default_rng(1))
    forest = isolation.Forest(isolation.Networks(np.zeros(0), np.ones(0), 0, 0), [(feature, cut, upper, 64)])
    for row, got in zip(x, forest.score(x), strict=True):
        at = 0
        while feature[at] >= 0:
            at = at + 1 if row[feature[at]] < cut[at] else upper[at]
        assert got == pytest.approx(2 ** (-cut[at] / float(isolation.path_length(64))))


def vectors(spark, x, w=None):
    return spark.createDataFrame([(f"L{i}", list(map(float, v)), 1.0 if w is None else float(w[i])) for i, v in enumerate(x)], "geo_location string, x array<double>, w double")


def test_autoencoder_tells_seeds_from_others(spark):
    from tidelog.operators import autoencoder

    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 8))
    net = autoencoder.fit(vectors(spark, base), epochs=60, rate=5e-3)
    odd = rng.normal(size=(50, 8)) * 3
    assert np.median(net.error(odd)) > 2 * np.median(net.error(base))
    got = {r["geo_location"]: r for r in autoencoder.judged(vectors(spark, odd), net).collect()}
    assert np.allclose([got[f"L{i}"]["error"] for i in range(50)], net.error(odd))
    assert np.allclose([got[f"L{i}"]["latents"] for i in range(50)], net.latents(odd))


def test_autoencoder_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    from tidelog.operators import autoencoder

    rng = np.random.default_rng(4)
    rows = vectors(spark, rng.normal(size=(600, 5)), rng.random(600))
    monkeypatch.setattr(autoencoder, "MEET", 3)
    for dropout in (0.0, 0.1):
        one, many = (autoencoder.fit(rows.repartition(k), epochs=4, dropout=dropout) for k in (1, 7))
        assert all(np.allclose(one.weights[k], many.weights[k], rtol=0, atol=1e-9) for k in one.weights)


def test_autoencoder_steps_have_tasks_by_rows_not_by_partitions(spark, monkeypatch):
    """F1: each of 800 steps ran a task for every partition that the profile's joins had left, 45 at 6 times sf0.1."""
    from tidelog.operators import autoencoder

    rows, sc = vectors(spark, np.random.default_rng(6).normal(size=(600, 5))).repartition(30), spark.sparkContext
    sc.setJobGroup("steps", "autoencoder")
    few = autoencoder.fit(rows, epochs=2)
    jobs = sorted(sc.statusTracker().getJobIdsForGroup("steps"))[-4:]
    sc.setJobGroup("rest", "other tests")
    stages = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(s.numCompletedTasks for s in stages if s is not None) <= 2
    monkeypatch.setattr(autoencoder, "SHARE", 64)
    monkeypatch.setattr(autoencoder, "MEET", 2)
    many = autoencoder.fit(rows, epochs=2)
    assert all(np.allclose(few.weights[k], many.weights[k], rtol=0, atol=1e-9) for k in few.weights)


def test_autoencoder_slopes_are_those_of_the_loss():
    from tidelog.operators import autoencoder

    rng = np.random.default_rng(5)
    p, x, w = autoencoder.begin(4, 1), rng.normal(size=(9, 4)), rng.random(9)
    noise, masks = autoencoder.chances(np.arange(9), 3, 1, 0.1)
    _, slopes = autoencoder.sums(p, x, w, noise, masks, 0.3)
    for k in p:
        for at in [(0, 0), (1, 2), (-1, 1)]:
            other = [{**p, k: p[k].copy()} for _ in range(2)]
            for q, off in zip(other, (1e-6, -1e-6), strict=True):
                q[k][at] += off
            up, down = (autoencoder.sums(q, x, w, noise, masks, 0.3)[0] for q in other)
            assert (up - down) / 2e-6 == pytest.approx(slopes[k][at], rel=1e-4, abs=1e-6)


def test_areas_equal_comparisons_of_all_pairs(spark):
    from tidelog.operators import importance

    rng = np.random.default_rng(6)
    rows_ = [(int(k), float(s), bool(y)) for k in range(3) for s, y in zip(np.round(rng.random(80), 1 + k), rng.random(80) < 0.3, strict=True)] + [(9, 0.5, True)]
    got = {r["k"]: r["auc"] for r in importance.areas(spark.createDataFrame(rows_, "k int, s double, y boolean"), "k", "s", "y").collect()}
    for k in range(3):
        p, n = ([s for q, s, y in rows_ if q == k and y == want] for want in (True, False))
        assert got[k] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))
    assert got[9] is None


def test_shuffling_deals_each_value_once(spark):
    from tidelog.operators import importance

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.concat(F.lit("L"), F.floor(F.col("id") / 3)).alias("geo_location"), F.col("id").alias("v"))
    got = importance.shuffled(df, "k", "v", 1).collect()
    own = {(r["k"], r["geo_location"]): r["v"] for r in df.collect()}
    assert sorted(r["v"] for r in got) == list(range(3000)) and len({(r["k"], r["geo_location"]) for r in got}) == 3000
    assert all(r["v"] % 3 == r["k"] for r in got)
    assert sum(own[r["k"], r["geo_location"]] == r["v"] for r in got) < 20


def test_permutation_importances_find_the_column_that_decides(spark):
    from tidelog.operators import importance

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(f"L{i}", *map(float, v), bool(v[1] > 0.3)) for i, v in enumerate(x)], "geo_location string, a double, b double, c double, is_bot boolean")
    found = {r["feature"]: r["importance"] for r in importance.by_permutation(df, ["a", "b", "c"], rounds=3, trees=20, depth=4).collect()}
    assert found["b"] == pytest.approx(0.5, abs=0.12) and abs(found["a"]) < 0.05 and abs(found["c"]) < 0.05
    assert next(iter(importance.surrogate(df, ["a", "b", "c"], trees=10, depth=4))) == "b"
    none = importance.by_permutation(df.withColumn("is_bot", F.lit(True)), ["a", "b"]).collect()
    assert [tuple(r) for r in none] == [("a", 0.0), ("b", 0.0)]


def test_permutation_deals_rows_once_a_round(spark, monkeypatch):
    """F2: what is dealt had a row for each row, column and round, of which 60 times sf0.1 has 14 million."""
    from tidelog.operators import importance

    seen, own = [], importance.shuffled

    def spy(values, *more):
        seen.append(values.count())
        return own(values, *more)

    monkeypatch.setattr(importance, "shuffled", spy)
    df = spark.createDataFrame([(f"L{i}", float(i % 7), float(i % 11), float(i), i % 2 == 0) for i in range(40)], "geo_location string, a double, b double, c double, is_bot boolean")
    assert importance.by_permutation(df, ["a", "b", "c"], rounds=2, trees=3, depth=2).count() == 3
    assert seen == [80]
    rows = importance._dealt(importance._rows(df, ["a", "b", "c"], "is_bot"), 2, 1).collect()
    for r in range(2):
        assert sorted(x.other for x in rows if x.r == r) == sorted(x.x for x in rows if x.r == r)
    assert {(x.geo_location, tuple(x.other)) for x in rows if x.r == 0} != {(x.geo_location, tuple(x.other)) for x in rows if x.r == 1}


def test_deep_pipeline_labels_planted_kinds(spark):
    rng = np.random.default_rng(5)
    rows_ = []
    for i in range(120):
        kind = ("organic", "bot", "hub")[i % 3]
        users = {"organic": rng.integers(2, 10), "bot": rng.integers(6000, 9000), "hub": rng.integers(5, 60)}[kind]
        dpu = {"organic": rng.uniform(1, 5), "bot": rng.uniform(2, 20), "hub": rng.uniform(600, 900)}[kind]
        work = 0.5 if kind == "organic" else 0.3
        rows_.append((f"{kind}{i}", int(users), float(dpu), int(min(users * dpu, 150 if kind == "organic" else 1e9)), work, 0.1, 3, 0.2, 1.0, 1.0, 0.1, 0.0))
    names = PROFILE + ", years_span int, fraction_latest_year double, spike_ratio double, recent_activity_ratio double, year_over_year_cv double, momentum_score double"
    df = spark.createDataFrame(rows_, names)
    got = rows(pipeline.classify_deep(df, iterations=3, epochs=5), "is_bot", "is_hub", "is_organic")
    for name, flags in got.items():
        assert flags == (name.startswith("bot"), name.startswith("hub"), name.startswith("organic")), name


def test_pipeline_end_to_end_and_reports(spark, tmp_path):
    from tidelog.fixtures import view_a

    sf = "/root/testdata/sf0.001"
    events = view_a(spark, sf)
    schema = LogSchema(city_field="city", user_field="usr", timestamp_field="ts", id_field="event_id")
    out = pipeline.run(events, schema)
    assert out["annotated"].count() == events.count()
    assert out["locations"].count() == events.select("geo_location").distinct().count()
    assert "locations" in text_report(out["locations"])
    assert html_report(out["locations"]).startswith("<html>")
    source = str(tmp_path / "log.parquet")
    events.write.parquet(source)
    log = readers.read_log(spark, source)
    assert readers.write_annotated(log, source, "reports_only") is None
    assert readers.write_annotated(log, source, sampled=True) is None
    assert spark.read.parquet(readers.write_annotated(log, source)).count() == events.count()
    assert spark.read.parquet(readers.write_annotated(log.limit(3), source, "overwrite")).count() == 3
    readers.write_json({"a": 1}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 1}
    readers.write_csv(spark.createDataFrame([("a", [1.0])], "k string, v array<double>"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["v"] == "[1.0]"


def test_exact_sample(spark):
    df = spark.range(100)
    got = readers.sample_exact(df, 10, ["id"])
    assert got.count() == 10
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in readers.sample_exact(df.repartition(7), 10, ["id"]).collect())
    assert readers.sample_exact(df, 1000, ["id"]).count() == 100


def test_exact_sample_of_half_a_table_equals_a_sort(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 15_000).alias("id"), F.lit("x").alias("_hash"))
    want = sorted(r["id"] for r in df.orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("id").cast("string"))), "id").limit(10_000).collect())
    for signs, cell in ((3, 100_000), (1, 50), (2, 1), (3, 0)):
        monkeypatch.setattr(readers, "SIGNS", signs)
        monkeypatch.setattr(readers, "CELL", cell)
        got = readers.sample_exact(df, 10_000, ["id"])
        assert got.columns == df.columns
        assert sorted(r["id"] for r in got.collect()) == want
    assert readers.sample_exact(df, 0, ["id"]).count() == 0


@pytest.mark.parametrize("kind", ["hours", "sessions"])
def test_stream_equals_batch(spark, tmp_path, kind):
    from tidelog.fixtures import view_a

    events = view_a(spark, "/root/testdata/sf0.001").select("geo_location", "ts")
    path = str(tmp_path / "events")
    events.repartition(1).write.parquet(path)
    make = live.hourly_counts if kind == "hours" else live.live_sessions
    stream = make(spark.readStream.schema(events.schema).parquet(path))
    query = stream.writeStream.outputMode("complete" if kind == "hours" else "append").format("memory").queryName(f"t_{kind}").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql(f"SELECT * FROM t_{kind}").collect()}
    want = {tuple(r) for r in make(events).collect()}
    assert got and got <= want
    if kind == "hours":
        assert got == want


def test_a_kept_log_is_profiled_without_shuffling_its_events_and_replaced_by_years(spark, tmp_path):
    from tidelog.grains import Grains
    from tidelog.operators import profile

    events = spark.range(4000).select(
        F.concat(F.lit("L"), F.col("id") % 9).alias("geo_location"), F.lit("A").alias("country"), F.lit("c").alias("city"), F.concat(F.lit("u"), F.col("id") % 31).alias("usr"),
        F.concat(F.lit("d"), F.col("id") % 7).alias("accession"), F.lit("http").alias("method"), F.lit("f.raw").alias("filename"),
        F.timestamp_add("HOUR", F.col("id") * 7, F.lit("2021-01-01").cast("timestamp_ntz")).alias("ts"), F.col("id").alias("event_id"),
    )
    name = "kept_log"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        kept = readers.keep_log(events, name, buckets=4, path=str(tmp_path / name))
        grains = Grains(kept)
        text = grains.hour_user._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
        assert rows(profile.basic(grains), "unique_users", "total_downloads", "active_hours", "unique_projects") == rows(
            profile.basic(Grains(events)), "unique_users", "total_downloads", "active_hours", "unique_projects"
        )
        years = {r["y"]: r["n"] for r in kept.groupBy(F.year("ts").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        files = {y: {f for f in kept.where(F.year("ts") == y).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} for y in years}
        # Half of one year goes, as an overwritten annotation would have it.
        kept = readers.replace_years(kept.where("year(ts) = 2022 AND event_id % 2 = 0"), name, buckets=4)
        after = {r["y"]: r["n"] for r in kept.groupBy(F.year("ts").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
        assert set(after) == set(years) and 0 < after[2022] < years[2022]
        assert all(after[y] == years[y] for y in years if y != 2022)
        for y in years:
            same = files[y] == {f for f in kept.where(F.year("ts") == y).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
            assert same == (y != 2022)
        assert "Exchange" not in Grains(kept).hour_user._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_importances_of_the_boosted_classifiers(spark):
    from tidelog.operators import models as m

    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(f"L{i}", *map(float, v), 1.0 if v[1] > 0 else None, 0.7 if v[1] <= 0 else None, None) for i, v in enumerate(x)], "geo_location string, a double, b double, organic_seed double, bot_seed double, hub_seed double")
    fitted = m.fit_fusion(m._vectors(df, ["a", "b"]), iterations=2)
    assert fitted["hub"] == 0.0 and next(iter(m.fusion_importances(fitted, ["a", "b"]))) == "b"
    assert m.fusion_importances({"organic": 1.0}, ["a"]) == {"a": 0.0}


def test_fusion_draws_the_same_rows_of_any_partitions(spark):
    """rows that a round of boosting sees, and so the labels, went by the partitions that rows came in."""
    x = np.random.default_rng(9).normal(size=(200, 2))
    df = spark.createDataFrame([(f"L{i}", *map(float, v), 1.0 if v.sum() > 0.3 else None, 0.7 if v.sum() < 0.6 else None, None) for i, v in enumerate(x)], "geo_location string, a double, b double, organic_seed double, bot_seed double, hub_seed double")
    one, many = (rows(models.fuse(df.repartition(k), ["a", "b"], iterations=4), "prob_organic") for k in (1, 9))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-9) for k in one)


def test_bootstrap_of_tables_with_a_closed_form():
    from math import comb

    # One cell: every draw is the table itself, and two classes never occur.
    assert evaluate.bootstrap_f1({("bot", "bot"): 40}) == pytest.approx((1 / 3,) * 3)
    # Two cells: the hits are binomial, and F1 of the one class rises with them.
    n, hits = 60, 45
    f1 = lambda h: 2 * h / (n + h) / 3
    whole, low, high = evaluate.bootstrap_f1({("bot", "bot"): hits, ("bot", "hub"): n - hits}, rounds=20_000)
    upto = np.cumsum([comb(n, h) * (hits / n) ** h * (1 - hits / n) ** (n - h) for h in range(n + 1)])
    assert whole == pytest.approx(f1(hits))
    # Cells are steps, so a quantile lies within one hit of the exact one.
    for got, part in ((low, 0.025), (high, 0.975)):
        exact = int(np.searchsorted(upto, part))
        assert f1(exact - 1) <= got <= f1(exact + 1)


def test_hub_protection_writes_only_columns_that_it_reads(spark, monkeypatch):
    """the log was written with all its columns, names of files among them, though no step reads those."""
    written, own = [], catalog.tabled
    monkeypatch.setattr(catalog, "tabled", lambda df: written.append(df.columns) or own(df))
    rows = catalog.queries()["class_hub_protection"](spark, "/root/testdata/sf0.001")
    assert set(written[0]) == {*catalog.RULED, "accession", "method"}
    assert rows.columns == ["geo_location", "behavior_type", "automation_category", "user_category", "is_protected_hub", "is_bot", "is_hub", "is_organic"]


@pytest.mark.parametrize("name", ["ana_label_breakdown", "stat_geographic"])
def test_labels_by_country_write_only_columns_that_they_read(spark, monkeypatch, name):
    """F16, F17: cities and datasets were written too, and the log was read for them, though only countries are grouped by."""
    written, own = [], catalog.tabled
    monkeypatch.setattr(catalog, "tabled", lambda df: written.append(df.columns) or own(df))
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert set(written[0]) == {*catalog.RULED, "country"}
    assert rows.columns[:2] == ["country", "locations"]
