"""Language-model scores from a subword lattice.

The scores that the vocabulary file gives its pieces are ranks, so a piece
starts at a weight of one over its rank, and expectation maximisation over
the corpus's distinct training words re-estimates the weights.

A text's lattice has two kinds of arcs. Subword arcs weight every
segmentation of a word into pieces; a forward recursion in log space sums
them to the word's marginal probability. A whole-word arc stands beside them
for each word seen in training: a word's probability is
(c + V * lattice) / (N + V + 1), so that the subword arcs have the mass of new
words; that of the words' end marker is c + 1 over the same. Whole-word arcs
have weights of their own in each class of training texts, such as their
languages, smoothed with PULL words of the whole: (own + PULL * p) / (size +
PULL). The lattice begins with a choice of the class, and the text's score
is the log of the sum over classes and segmentations. Nothing leaves log
space on the way.

Counts are one table over all words of the corpus. At most HEAVY words,
those with at least N / HEAVY occurrences, are broadcast and settled while
a text is read; the other words of each text meet the table in a shuffle.
Both take the same numbers, so HEAVY changes no score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SLICE, checkpoint, fold
from tidelog.llm.minhash import words

HEAVY = 1 << 20
ROUNDS = 2
#: Most classes of texts with word distributions of their own, and how many words of all texts each is smoothed with.
CLASSES = 16
PULL = 1000.0
#: Entries of a task's counts before they are handed on.
FLUSH = 400_000
FLOOR = 1e-9
START = b" "


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """(piece, weight) of a SentencePiece file and all single bytes; a word starts with START.

    The file's scores fall with the rank of a piece; weights are one over
    the rank. Control and unknown pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {bytes([b]): FLOOR for b in range(256) if not 9 <= b <= 13}
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    for rank, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i))):
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if START not in piece[1:] and not set(piece) & set(range(9, 14)):
            found[piece] = max(found.get(piece, 0.0), 1.0 / (rank + 2))
    total = sum(found.values())
    return sorted((p, w / total) for p, w in found.items())


class Lattice:
    """Pieces with log probabilities, found in many words at once by one pass of an automaton."""

    GAP = "\n"
    #: Bytes of words that one pass takes, or one word if it is longer.
    PASS = 1 << 17

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = log_p
        self.size = np.array([len(p) for p in pieces])
        self.finder = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            self.finder.add_word(p.decode("latin-1"), i)
        self.finder.make_automaton()

    def _passes(self, found: list[bytes]):
        """Parts of the words, each with its edges: (words, first gaps, last gaps, start, end, piece, own first gap)."""
        at = 0
        while at < len(found):
            to, length = at, 0
            while to < len(found) and (to == at or length + len(found[to]) + 2 <= self.PASS):
                length += len(found[to]) + 2
                to += 1
            part = found[at:to]
            text = "".join(" " + w.decode("latin-1") + self.GAP for w in part)
            hits = np.fromiter(chain.from_iterable(self.finder.iter(text)), dtype=np.int64).reshape(-1, 2)
            last = np.cumsum([len(w) + 2 for w in part]) - 1
            first = last - np.array([len(w) + 1 for w in part])
            end = hits[:, 0] + 1
            owner = first[np.searchsorted(last, end)]
            yield part, first, last, end - self.size[hits[:, 1]], end, hits[:, 1], owner
            at = to

    @staticmethod
    def _sum(levels: np.ndarray, to: np.ndarray, source: np.ndarray, score: np.ndarray, reach: np.ndarray) -> None:
        """reach[to] = log of the summed exp(reach[source] + score), level after level."""
        order = np.lexsort((to, levels))
        levels, to, source, score = levels[order], to[order], source[order], score[order]
        ends = np.flatnonzero(np.append(levels[1:] != levels[:-1], True)) + 1 if len(levels) else []
        begin = 0
        for end in ends:
            t = to[begin:end]
            heads = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            reach[t[heads]] = np.logaddexp.reduceat(reach[source[begin:end]] + score[begin:end], heads)
            begin = end

    def _forward(self, first, last, start, end, score, owner) -> np.ndarray:
        reach = np.full(int(last[-1]) + 1, -np.inf)
        reach[first] = 0.0
        self._sum(end - owner, end, start, score, reach)
        return reach

    def log10(self, found: list[bytes]) -> np.ndarray:
        """log10 of the marginal probability of each word."""
        out = [np.zeros(0)]
        for _, first, last, start, end, piece, owner in self._passes(found):
            out.append(self._forward(first, last, start, end, self.log_p[piece], owner)[last])
        return np.concatenate(out) / math.log(10)

    def expected(self, found: list[bytes]) -> np.ndarray:
        """Expected uses of each piece over one occurrence of each word."""
        out = np.zeros(len(self.log_p))
        for _, first, last, start, end, piece, owner in self._passes(found):
            score = self.log_p[piece]
            reach = self._forward(first, last, start, end, score, owner)
            left = np.full(len(reach), -np.inf)
            left[last] = 0.0
            stop = last[np.searchsorted(last, end)]
            self._sum(stop - start, start, end, score, left)
            share = np.exp(reach[start] + score + left[end] - reach[stop])
            out += np.bincount(piece, weights=share, minlength=len(out))
        return out


_lattices: dict[int, Lattice] = {}


def _lattice(shared) -> Lattice:
    """The worker's lattice for a broadcast (pieces, log probabilities)."""
    if shared.id not in _lattices:
        _lattices.clear()
        _lattices[shared.id] = Lattice(*shared.value)
    return _lattices[shared.id]


class _Shared:
    """A broadcast with a key that a worker can remember it by."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, c) of docs(text, class), rows of a task each: occurrences in training texts; class -1 and 0 for those of others."""
    schema = pa.schema([("word", pa.binary()), ("class", pa.int32()), ("c", pa.int64())])

    def run(batches):
        counts: defaultdict[int, Counter] = defaultdict(Counter)

        def flush():
            for kind, own in counts.items():
                keys = list(own)
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    columns = {"word": part, "class": [kind] * len(part), "c": [own[k] for k in part]}
                    yield pa.RecordBatch.from_pydict(columns, schema=schema)
            counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for text, kind in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    counts[kind].update(words(text) if kind >= 0 else dict.fromkeys(words(text), 0))
                if sum(map(len, counts.values())) >= FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text", "class").mapInArrow(run, "word binary, class int, c long")


def fit_pieces(counts: DataFrame, pieces: list[tuple[bytes, float]], rounds: int = ROUNDS) -> tuple[list[bytes], np.ndarray]:
    """Piece log probabilities after rounds of expectation maximisation over the distinct training words."""
    spark = counts.sparkSession
    names, weights = [p for p, _ in pieces], np.array([w for _, w in pieces])
    log_p = np.log(weights)
    schema = pa.schema([("piece", pa.int32()), ("n", pa.float64())])
    for _ in range(rounds):
        shared = _Shared(spark, (names, log_p))

        def run(batches, shared=shared):
            total = np.zeros(len(shared.value[0]))
            for batch in batches:
                total += _lattice(shared).expected(batch.column(0).to_pylist())
            used = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"piece": used.astype(np.int32), "n": total[used]}, schema=schema)

        used = counts.where("c > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        n = np.zeros(len(names))
        for r in used.collect():
            n[r["piece"]] = r["n"]
        if n.sum() > 0:
            n = n + weights
            log_p = np.log(n / n.sum())
    return names, log_p


def _log10_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a * math.log(10), b * math.log(10)) / math.log(10)


def log_word(c: np.ndarray, chance: np.ndarray, total: float, fresh: float) -> np.ndarray:
    """log10 of (c + fresh * 10^chance) / (total + fresh + 1), without leaving logarithms."""
    with np.errstate(divide="ignore"):
        return _log10_sum(np.log10(c.astype(float)), math.log10(fresh) + chance) - math.log10(total + fresh + 1)


def class_scores(p: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of (own + PULL * 10^p) / (size + PULL), a row for each of p and a column for each class."""
    with np.errstate(divide="ignore"):
        return _log10_sum(np.log10(own.astype(float)), math.log10(PULL) + p[:, None]) - np.log10(sizes + PULL)


def lm_scores(
    docs: DataFrame, path: str, id_col="doc_id", text_col="text", class_col: str | None = "lang", modulus: int = 7, left_out: int = 2, n_classes: int = CLASSES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, A to Z in lower case, and one end. Training texts
    are those whose crc32 of the id as text isn't left_out modulo modulus.
    base_score adds log10((c + 1) / (N + V + 1)); score is the log10 of the
    marginal of the text's lattice. The n_classes most frequent values of
    class_col in training are classes, all others and null one more; without
    class_col there is one class; the text's own class is not looked at. A
    null text counts as empty and has its end alone. Without any training
    text N and V are 0, all words are new and the lattice keeps its starting
    weights. Rows that repeat an id are scored one by one. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    held_out = fold(F.col("doc_id"), modulus) == left_out
    kind = docs[class_col].cast("string") if class_col else F.lit(None).cast("string")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), kind.alias("kind"))
    sizes = source.where(~held_out).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.where("kind IS NOT NULL").orderBy(F.col("n").desc(), "kind").limit(n_classes).collect()
    ends_all = sizes.agg(F.sum("n")).first()[0] or 0
    number = F.lit(len(top))
    for i, r in enumerate(top):
        number = F.when(F.col("kind") == r["kind"], i).otherwise(number)
    source = source.select("doc_id", "text", F.when(held_out, -1).otherwise(number).cast("int").alias("class"))
    n_classes = len(top) + 1
    ends = np.array([r["n"] for r in top] + [ends_all - sum(r["n"] for r in top)], dtype=float)

    by_class = word_counts(source)
    own = [F.sum(F.when(F.col("class") == k, F.col("c")).otherwise(0)) for k in range(n_classes)]
    counts = checkpoint(by_class.groupBy("word").agg(F.sum("c").alias("c"), F.array(*own).alias("own")))
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), *[F.sum(F.col("own")[k]).alias(f"n{k}") for k in range(n_classes)]).first()
    total, kinds = (sums["n"] or 0) + ends_all, sums["v"] + (ends_all > 0)
    sizes_of = ends + np.array([sums[f"n{k}"] or 0 for k in range(n_classes)], dtype=float)
    below = float(total + kinds + 1)
    fresh = float(max(kinds, 1))
    lattice = _Shared(spark, fit_pieces(counts, vocabulary(path)))
    table_schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def weigh(batches):
        """A word's log10 probability in each class."""
        for batch in batches:
            c = batch.column(1).to_numpy()
            own = batch.column(2).flatten().to_numpy().reshape(-1, n_classes)
            chance = _lattice(lattice).log10(batch.column(0).to_pylist())
            scores = class_scores(log_word(c, chance, total, fresh), own, sizes_of)
            lists = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, n_classes, dtype=np.int32), scores.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema=table_schema)

    table = counts.select("word", "c", "own").mapInArrow(weigh, "word binary, c long, scores array<double>")
    base = F.log10((F.col("c") + 1) / below)
    table = checkpoint(table.select("word", (F.col("c") > 0).alias("known"), base.alias("base"), "scores", "c"))
    rows = table.where((F.col("c") * HEAVY >= total) & (F.col("c") > 0)).select("word", "base", "scores").toArrow()
    index = {w: i for i, w in enumerate(rows["word"].to_pylist())}
    # The end is one more heavy token, the last.
    log_end = np.array([math.log10((ends_all + 1) / (total + fresh + 1))])
    heavy = rows["scores"].combine_chunks().flatten().to_numpy().reshape(-1, n_classes) if len(index) else np.zeros((0, n_classes))
    log_own = np.concatenate([heavy, class_scores(log_end, ends[None, :], sizes_of)])
    log_class = np.log10((ends + 1) / (ends_all + n_classes))
    log_base = np.append(rows["base"].to_numpy(), math.log10((ends_all + 1) / below))
    del rows, heavy
    shared = spark.sparkContext.broadcast((index, log_own, log_base))
    end_known = int(ends_all > 0)
    facts = pa.struct([("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("scores", pa.list_(pa.float64()))])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int32()), ("own", facts)])

    def read_texts(batches):
        """A row of each text with what is settled at once, and one for each of its other words."""
        index, log_own, log_base = shared.value
        end = len(log_base) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows, ids, keys, times, sums = [], [], [], [], []
                for row, doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns), strict=True):
                    found = words(text)
                    counted = Counter(found)
                    place = [index.get(w, -1) for w in counted]
                    others = [(w, n) for (w, n), i in zip(counted.items(), place, strict=True) if i < 0]
                    place, n = np.array([*place, end]), np.array([*counted.values(), 1])
                    place, n = place[place >= 0], n[place >= 0]
                    # No word holds a space, so this key meets no row of the table.
                    keys += [w for w, _ in others] + [b" %d" % row]
                    times += [k for _, k in others] + [0]
                    rows += [row] * (len(others) + 1)
                    ids += [None] * len(others) + [doc_id]
                    sums += [None] * len(others)
                    sums.append({"n": len(found) + 1, "known": int(n.sum()) - 1 + end_known, "base": float(n @ log_base[place]), "scores": (n @ log_own[place]).tolist()})
                yield pa.RecordBatch.from_pydict(
                    {"row": rows, "doc_id": ids, "word": keys, "times": times, "own": sums}, schema=schema
                )

    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = numbered.mapInArrow(
        read_texts, "row long, doc_id long, word binary, times int, own struct<n: long, known: long, base: double, scores: array<double>>"
    )
    met = parts.join(table.select("word", "known", "base", "scores"), "word", "left")
    by_kind = [F.sum(F.coalesce(F.col("own.scores")[k], F.col("times") * F.col("scores")[k])) + float(log_class[k]) for k in range(n_classes)]
    out = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("own.n").alias("n_tokens"),
        F.sum(F.coalesce("own.known", F.when(F.col("known"), F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("own.base", F.col("times") * F.col("base"))).alias("base_score"),
        *[x.alias(f"_{k}") for k, x in enumerate(by_kind)],
    )
    # The sum over classes, from the largest term on.
    best = F.greatest(*[f"_{k}" for k in range(n_classes)]) if n_classes > 1 else F.col("_0")
    rest = sum((F.pow(F.lit(10.0), F.col(f"_{k}") - best) for k in range(n_classes)), F.lit(0.0))
    out = out.withColumn("score", best + F.log10(rest))
    return out.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
