"""Periodic runs against a walk over all lags."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import EDGES, docs, table

from tidelog.llm import registry, repeats


def walk(words, least=6, factor=4):
    """All runs by comparing word by word at every lag, and every smaller period."""
    out = []
    for q in range(1, len(words) // factor + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, factor * q):
                part = words[i : i + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 9), st.integers(1, 9)), max_size=25), st.sampled_from([(6, 4), (1, 3), (12, 5)]))
def test_runs_match_a_walk(parts, bounds):
    words = [(k + i) % 5 for k, p, times in parts for _ in range(times) for i in range(p)]
    runs = repeats.runs_of(words, *bounds)
    assert runs == walk(words, *bounds)
    assert repeats.kept_words(words, runs) == left(words, runs)


def test_long_periods_and_few_words_match_a_walk():
    rng = random.Random(4)
    for kinds in (1, 2, 3, 300):
        words = [rng.randrange(kinds) for _ in range(700)]
        for period, times in ((16, 5), (17, 4), (40, 4), (97, 4)):
            at = rng.randrange(700 - period * times)
            for i in range(at + period, min(700, at + period * times + rng.randrange(period))):
                words[i] = words[i - period]
        assert repeats.runs_of(words) == walk(words)


def test_probing_multiples_drops_no_run(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(2) for _ in range(40)] * rng.randrange(1, 6) + [rng.randrange(3) for _ in range(150)]
        monkeypatch.setattr(repeats, "SPARSE", 1000)
        monkeypatch.setattr(repeats, "AT_ONCE", 1 << 20)
        every = repeats.runs_of(words)
        monkeypatch.setattr(repeats, "SPARSE", 1)
        monkeypatch.setattr(repeats, "AT_ONCE", 50)
        assert repeats.runs_of(words) == every


def test_periodic_runs_of_documents(spark):
    texts = ["no no no no no no no end", "a b c d " * 4 + "a b", "x y " * 3, None, "", "\x1fa\x1f " * 6, "Ä ä " * 5, "a " * 5]
    got = {r["doc_id"]: r for r in repeats.periodic_runs(docs(spark, texts)).collect()}
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 7, 1)] and got[0]["collapsed"] == "no end"
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 18, 4)] and got[1]["collapsed"] == "a b c d"
    assert got[2]["runs"] == [] and got[2]["collapsed"] == "x y x y x y"
    assert [(got[i]["n_words"], got[i]["runs"], got[i]["collapsed"]) for i in (3, 4)] == [(0, [], "")] * 2
    assert got[5]["collapsed"] == "\x1fa\x1f" and got[6]["collapsed"] == "Ä ä" and got[7]["runs"] == []


def test_edge_rows_have_their_values(spark):
    rows = [(i, t, None, None) for i, t in enumerate(EDGES)] + [(3, "a", "en", "s"), (None, "b " * 6, None, None)]
    got = sorted((tuple(r)[:2] + (r["collapsed"],) for r in repeats.periodic_runs(table(spark, rows)).collect()), key=repr)
    want = sorted(((i, len((t or "").split()), " ".join(dict.fromkeys((t or "").split())) if i in (5, None) else " ".join((t or "").split())) for i, t, *_ in rows), key=repr)
    assert got == want
    assert repeats.periodic_runs(table(spark, [])).count() == 0


def test_a_megabyte_of_one_word_and_of_a_long_period(spark):
    period = [f"w{i}" for i in range(30_000)]
    texts = ["la " * 350_000, " ".join(period * 5)]
    got = repeats.periodic_runs(docs(spark, texts)).collect()
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(0, 350_000, 1)], [(0, 150_000, 30_000)]]


def test_the_query_by_a_walk(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 90))) + "\t z" * rng.randrange(9), "en", "s") for i in range(120)]
    rows += [(200, None, None, None), (201, " \n", None, None)]
    table(spark, rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in registry.op12_periodic_runs(spark, str(tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        words, h = (text or "").split(), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = walk(words)
        s, m, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert got[doc_id] == {
            "doc_id": doc_id, "n_runs": len(runs), "start": s, "length": m, "period": q, "exponent_milli": 1000 * m // q if runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(left(words, runs)).encode()).hexdigest(),
        }
    assert sum(r["n_runs"] > 0 for r in got.values()) > 20
