"""Personal data against plain patterns, and other spellings in texts that weren't learnt from."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_operators import EDGES, docs, table

from tidelog.llm import pii, registry
from tidelog.llm.common import fold

# The base patterns as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            sound = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and doubled % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if sound[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(PLAIN).index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ä", "@", "@", ".", ".", "-", "+", " ", "1", "25", "255", "300", "004", "(", ")", "_", "%", "x.y", "4000000000000002", "12345678"]), max_size=40))
def test_base_spans_match_the_plain_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain_spans(text)


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def made(rng, kind):
    if kind == "email":
        return f"{rng.choice(['maria', 'bob', 'xi'])}.{rng.randrange(99)}@mail{rng.randrange(9)}.{rng.choice(['sample.org', 'example.com'])}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "phone":
        return f"+{rng.choice([1, 49, 34])} ({rng.randrange(100, 1000)}) 555-{rng.randrange(1000, 10000)}"
    while not pii.luhn(number := "4" + "".join(str(rng.randrange(10)) for _ in range(15))):
        pass
    return number


def decoys(rng):
    """Numbers that are nobody's: dates, amounts, versions, orders, cards whose check digit is wrong."""
    while pii.luhn(wrong := "4" + "".join(str(rng.randrange(10)) for _ in range(15))):
        pass
    n = rng.randrange
    return rng.choice([f"{n(2000, 2030)}-{n(10, 13)}-{n(10, 28)}", f"{n(10, 99)}:{n(10, 60)}:{n(10, 60)}", f"v{n(9)}.{n(9)}.{n(9)}", f"{n(10**7)}.{n(100)}", wrong, f"{n(300, 999)}.{n(300, 999)}.1.2", str(n(10**8, 10**9))])


def corpus(rng, n):
    out = []
    for _ in range(n):
        words = sentence(rng, 40).split()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), decoys(rng))
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), made(rng, rng.choice(pii.KINDS)))
        out.append(" ".join(words))
    return out


def test_other_spellings_are_added_and_decoys_are_left_alone(spark):
    rng = random.Random(13)
    known = corpus(rng, 1500)
    model = pii.train(docs(spark, known).repartition(5))
    assert set(model.kinds) == set(pii.KINDS)
    new, want = [], []
    for i in range(400):
        words = sentence(rng, 30).split()
        words.insert(rng.randrange(len(words)), decoys(rng))
        at = rng.randrange(len(words))
        kind = pii.KINDS[i % 4]
        other = rng.choice(pii.spellings(kind, made(rng, kind))) if i < 300 else decoys(rng)
        left = " ".join(words[:at] + [""])
        new.append(left + other + " " + " ".join(words[at:]))
        want.append((len(left), len(left) + len(other), kind) if i < 300 else None)
    found = {r["doc_id"]: r for r in pii.find(docs(spark, new), model).collect()}
    assert all([tuple(s) for s in found[i]["base"]] == plain_spans(t) for i, t in enumerate(new))
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in found.values())
    hit = [any(s["start"] <= w[0] and w[1] <= s["end"] for s in found[i]["spans"]) for i, w in enumerate(want[:300])]
    assert sum(hit) >= 270
    stray = [s for i, w in enumerate(want) for s in found[i]["spans"] if tuple(s) not in plain_spans(new[i]) and not (w and s["start"] < w[1] and w[0] < s["end"])]
    assert len(stray) <= 8
    i = hit.index(True)
    assert f"[{want[i][2]}]" in found[i]["redacted"]


def test_the_query_and_its_digest(spark, tmp_path):
    rng = random.Random(14)
    texts = corpus(rng, 120) + [None, "", "x" * 200_000, "1" * 100_000, "7 " * 50_000, "a@" * 20_000, "1.2.3.4.5.6.7.8"]
    docs(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op13_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        base = pii.base_spans(text or "") if len(text or "") > 50_000 else plain_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for *_, x in base) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(got[i]["spans"].split(",")) or not joined


def test_edge_rows_have_their_values(spark):
    rows = [(i, t, None, None) for i, t in enumerate(EDGES)] + [(3, "a@b.c", "en", "s"), (None, "a@b.c", None, None), (None, None, None, None)]
    df = table(spark, rows)
    got = sorted((tuple(r) for r in pii.find(df, pii.train(df)).collect()), key=repr)
    own = lambda t: [(0, 5, "email")] if t == "a@b.c" else []
    want = sorted(((i, own(t), own(t), "[email]" if t == "a@b.c" else t) for i, t, *_ in rows), key=repr)
    assert [(a, [tuple(x) for x in b], [tuple(x) for x in c], d) for a, b, c, d in got] == want
    empty = table(spark, [])
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_redaction_merges_overlapping_spans():
    assert pii.redact("ab 1.2.3.4 cd +1", [(3, 10, "ip"), (5, 10, "card"), (14, 16, "phone")]) == "ab [ip] cd [phone]"


def test_boosting_learns_a_product_and_lowers_the_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = pii.boost(x, y)
    fresh = rng.normal(size=(2000, 5))
    assert ((trees.score(fresh) > 0) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.93

    def walk(row):
        """The sum of leaves, node by node."""
        total = trees.start
        for feature, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + bool(row[feature[node]] > above[node])
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(trees.score(fresh[:50]), [walk(r) for r in fresh[:50]])


def test_calibration_is_isotonic_and_weighted():
    score, y, w = np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]), np.array([1.0, 1, 3, 1, 1, 1])
    starts, chance = pii.isotonic(score, y, w)
    assert starts.tolist() == [1, 2, 4] and np.allclose(chance, [0, 0.2, 1])
    assert pii.threshold(score, y, w, 0.6) == 4.0
    assert pii.threshold(score, y, w, 0.95) == float("inf")
    assert pii.threshold(np.zeros(0), np.zeros(0), np.zeros(0), 0.5) == float("inf")


def test_all_candidates_of_both_folds_count(spark, monkeypatch):
    """8,000 candidates of each kind and label stood for all others."""
    rng = random.Random(4)
    texts = [" ; ".join([str(rng.randrange(10**7, 10**8)) for _ in range(140)] + [made(rng, "phone")]) for _ in range(300)]
    want = Counter()
    for i, text in enumerate(texts):
        part = zlib.crc32(str(i).encode()) % pii.MODULUS
        if part in (pii.LEARN, pii.CALIBRATE):
            for kind, label, where in pii.labelled(text, pii.base_spans(text)):
                want[part, kind, label, tuple(map(int, pii.features(*where)))] += 1
    rows = docs(spark, texts).repartition(3).withColumn("part", fold(F.col("doc_id"), pii.MODULUS).cast("int")).where("part < 2")
    assert {(r["part"], r["kind"], r["label"], tuple(r["x"])): r["n"] for r in pii.counted(rows).collect()} == want
    seen, own = [], pii.thresholds

    def spy(scored, least):
        seen.extend((r["kind"], r["n"]) for r in scored.groupBy("kind").agg(F.sum("total").alias("n")).collect())
        return own(scored, least)

    monkeypatch.setattr(pii, "thresholds", spy)
    models = [pii.train(docs(spark, texts).repartition(n), trees=5).kinds["phone"] for n in (3, 7)]
    n = sum(n for (part, kind, *_), n in want.items() if (part, kind) == (pii.CALIBRATE, "phone"))
    assert n > 10_000 and dict(seen)["phone"] == n
    (a, first), (b, second) = models
    assert first == second and all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "above", "leaf"))


def test_levels_of_trees_have_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    """op13_pii on check_h: each of 180 levels was dealt to all of the session's shuffle partitions."""
    texts, grow, sc, groups = corpus(random.Random(5), 300), pii.grow, spark.sparkContext, []

    def spy(sums, *rest):
        def watched(*level):
            groups.append(f"level {len(groups)}")
            sc.setLocalProperty("spark.jobGroup.id", groups[-1])
            try:
                return sums(*level)
            finally:
                sc.setLocalProperty("spark.jobGroup.id", None)

        return grow(watched, *rest)

    monkeypatch.setattr(pii, "grow", spy)
    wanted = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        assert pii.train(docs(spark, texts), trees=2).kinds
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for g in groups for j in status.getJobIdsForGroup(g) for s in status.getJobInfo(j).stageIds]
    assert len(groups) == len(stages) == 6 and all(s.numTasks == 1 for s in stages)


def test_thresholds_over_tasks_equal_the_isotonic_ones(spark):
    rng = np.random.default_rng(9)
    for least in (0.5, 0.9, 0.95):
        rows, want = [], {}
        for kind, n in (("a", 400), ("b", 60), ("c", 3), ("none", 50)):
            score = np.round(rng.normal(size=n) * 9, 1)
            y = (rng.random(n) < 1 / (1 + np.exp(-score))).astype(float) if kind != "none" else np.zeros(n)
            weight = rng.integers(1, 30, n).astype(float)
            want[kind] = pii.threshold(score, y, weight, least)
            rows += [(kind, float(s), int(w * h), int(w)) for s, h, w in zip(score, y, weight, strict=True)]
        df = spark.createDataFrame(rows, "kind string, score double, hits long, total long").groupBy("kind", "score").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
        assert pii.thresholds(df, least) == want


def test_rare_values_have_edges_of_their_own():
    values, weight = np.arange(100.0), np.ones(100)
    assert pii.edged(np.array([0.0, 1.0]), np.array([1.0, 1e6]), 32).tolist() == [0, 1]
    edges = pii.edged(values, weight, 4)
    assert edges.tolist() == [24, 49, 74]
    assert pii.coded(np.array([[24.0], [25.0], [99.0]]), [edges]).tolist() == [[0], [1], [3]]
