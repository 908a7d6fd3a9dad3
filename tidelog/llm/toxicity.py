"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier learns from confirmed toxic texts and from unlabelled
ones. Its risk takes the toxic share of the unlabelled texts, the class
prior, out of their negative part, and never lets that part go below zero:
where it does, the step goes back up instead.

Features are the words and word beginnings of a text, hashed; those that
confirmed texts have more often than unlabelled ones are kept. Training
runs on bounded samples on the driver; scoring is one pass over all texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint, fold, map_texts, pick

LEAST_POSITIVE = 4
LEAST_RATIO = 3.0
BEGINNINGS = (4, 5, 6)
#: A feature's value is log(1 + SCALE * count / (words + SMOOTH)).
SCALE = 100.0
SMOOTH = 20.0
STEPS = 400
RATE = 0.05
SHRINK = 1e-4
TOXIC = 0.7
WORDS_KEPT = 30_000

WORD = regex.compile(r"\p{L}+")
_features: dict[str, tuple[int, ...]] = {}


def word_features(word: str) -> tuple[int, ...]:
    """Signed 64-bit hashes of a word and of its beginnings."""
    found = _features.get(word)
    if found is None:
        if len(_features) > WORDS_KEPT:
            _features.clear()
        names = [word + " "] + [word[:n] for n in BEGINNINGS if len(word) >= n]
        found = tuple(xxhash.xxh3_64_intdigest(n) - (1 << 63) for n in names)
        if len(word) <= 64:
            _features[word] = found
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of a text and their values, which grow with their share of its words."""
    counts = Counter(WORD.findall(text.lower())) if text else {}
    if not counts:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    own = [word_features(w) for w in counts]
    each = np.repeat(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), [len(f) for f in own])
    keys, at = np.unique(np.fromiter(chain.from_iterable(own), dtype=np.int64, count=len(each)), return_inverse=True)
    return keys, np.log1p(SCALE * np.bincount(at, weights=each) / (sum(counts.values()) + SMOOTH))


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and a bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total = self.bias
        if len(self.keys):
            found, values = features(text)
            at = np.searchsorted(self.keys, found)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == found
            total += float((self.weights[at[hit]] * values[hit]).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def descent(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> np.ndarray:
    """The slope that training follows down: that of the risk, or away from a negative part below zero.

    The risk with logistic loss is prior * E_p[l(g)] + max(0, E_u[l(-g)] -
    prior * E_p[l(-g)]). Each side is (number of texts, row, column, value)
    of a sparse matrix; the last of w is the bias.
    """
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def output(side):
        n, rows, columns, values = side
        return w[-1] + np.bincount(rows, weights=w[columns] * values, minlength=n)

    def pull(slope, side):
        n, rows, columns, values = side
        return np.append(np.bincount(columns, weights=slope[rows] * values, minlength=len(w) - 1), slope.sum()) / n

    g_p, g_u = output(positive), output(unlabelled)
    negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
    slope = pull(sigmoid(g_u), unlabelled) - prior * pull(sigmoid(g_p), positive)
    return -slope if negative < 0 else slope - prior * pull(sigmoid(-g_p), positive)


def fit(keys: np.ndarray, positive: list[tuple], unlabelled: list[tuple], prior: float) -> Model:
    """Minimise the non-negative risk by Adam; without confirmed texts every score is 0.

    A text is a pair of places in keys and values there.
    """
    if not positive or not unlabelled:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), -500.0)

    def sparse(texts):
        rows = np.repeat(np.arange(len(texts)), [len(at) for at, _ in texts])
        return len(texts), rows, *(np.concatenate([t[i] for t in texts]) for i in (0, 1))

    p, u = sparse(positive), sparse(unlabelled)
    w = np.zeros(len(keys) + 1)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    first, second = np.zeros_like(w), np.zeros_like(w)

    for step in range(1, STEPS + 1):
        slope = descent(w, p, u, prior)
        slope[:-1] += SHRINK * w[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(keys, w[:-1], float(w[-1]))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_positive: int = 3000,
    max_unlabelled: int = 6000,
    max_features: int = 4096,
) -> Model:
    """Learn from toxic = 1 of labels and from texts taken as unlabelled, both of the training fold.

    The fold leaves out ids whose crc32 as text is 1 modulo 3. Samples are
    those of lowest hash of the id, max_positive confirmed and max_unlabelled
    unlabelled texts at most, and the max_features that tell them apart best;
    the prior is the toxic share of all the fold's labels, or of its texts
    where only toxic ones are labelled. Of labels that
    repeat an id the highest counts; null labels and ids are left out. Rows
    that repeat an id are texts of their own.
    """
    texts = pick(docs, id_col, text_col).where(fold(F.col("doc_id"), 3) != 1)
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    marks = marks.where((fold(F.col("doc_id"), 3) != 1) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marks.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    share = seen["p"]
    if share == 1.0:
        # Only confirmed texts are marked, which tells nothing of the others but that these are among them.
        share = min(1.0, seen["n"] / max(texts.count(), 1))
    by_hash = F.xxhash64(F.lit(29), "doc_id")
    chosen = marks.where("toxic = 1").orderBy(by_hash, "doc_id").limit(max_positive).select("doc_id")
    others = texts.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(by_hash, "doc_id").limit(max_unlabelled)
    ids = chosen.select("doc_id", F.lit(1).alias("own")).unionByName(others.select("doc_id", F.lit(0).alias("own")))

    def read_texts(own, text):
        found = [features(t) for t in text]
        return {"own": own, "keys": [k for k, _ in found], "values": [v.astype(np.float32) for _, v in found]}

    kinds = {"own": ("int", pa.int32()), "keys": ("array<long>", pa.list_(pa.int64())), "values": ("array<float>", pa.list_(pa.float32()))}
    sample = checkpoint(map_texts(texts.join(F.broadcast(ids), "doc_id").select("own", "text"), ["own", "text"], read_texts, kinds))
    sizes = {r["own"]: r["n"] for r in sample.groupBy("own").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    # Features are chosen where the sample lies; only those kept come to the driver.
    seen = sample.select("own", F.explode("keys").alias("key")).groupBy("key").agg(F.sum("own").alias("p"), F.sum(1 - F.col("own")).alias("u"))
    share_p, share_u = F.col("p") / max(n_p, 1), (F.col("u") + 0.5) / (n_u + 1)
    usable = seen.where((F.col("p") >= LEAST_POSITIVE) & (share_p > LEAST_RATIO * share_u))
    top = usable.orderBy((share_p * F.log(share_p / share_u)).desc(), "key").limit(max_features).select("key").collect()
    keys = np.sort(np.array([r["key"] for r in top], dtype=np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def keep(own, found, values):
        out = {"own": own, "at": [], "values": []}
        for k, v in zip(found, values, strict=True):
            k, v = np.array(k, dtype=np.int64), np.array(v, dtype=np.float32)
            hit = np.isin(k, shared.value)
            out["at"].append(np.searchsorted(shared.value, k[hit]).astype(np.int32))
            out["values"].append(v[hit])
        return out

    kinds = {"own": ("int", pa.int32()), "at": ("array<int>", pa.list_(pa.int32())), "values": ("array<float>", pa.list_(pa.float32()))}
    rows = map_texts(sample, ["own", "keys", "values"], keep, kinds).collect()
    side = lambda own: [(np.array(r["at"], dtype=np.int64), np.array(r["values"])) for r in rows if r["own"] == own]
    return fit(keys, side(1), side(0), float(share or 0.0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; a null text counts as empty.

    score is the model's probability of toxicity from the text alone;
    predicted is 1 from TOXIC up. Rows keep their number; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(doc_id, text):
        return {"doc_id": doc_id, "score": [shared.value.score(t) for t in text]}

    rows = map_texts(pick(docs, id_col, text_col), ["doc_id", "text"], work, {"doc_id": ("long", pa.int64()), "score": ("double", pa.float64())})
    return rows.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, all their columns unchanged.

    A null text, and one without any word, tells nothing and stays, whatever the model's bias.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def scored(text):
        return text.map(lambda t: shared.value.score(t) if t and WORD.search(t) else 0.0, na_action=None)

    return docs.where(scored(docs[text_col].cast("string")) < TOXIC)
