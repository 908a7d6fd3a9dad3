"""Secret scan: known patterns, and strings that pass for random.

Beside the base patterns, runs of token characters are tested as data in
the encoding that their letters and digits suggest: chi-squared uniformity
over its alphabet, a runs test about its middle and lag-one serial
correlation, all three two-sided or upper p-values under randomness, joined by
Fisher's method into one score. Signs between are left out of the test: names
joined by them then read like any other words.

What ordinary text does is counted in each encoding apart. Its letters and
digits, all of them outside runs and base spans, are cut into pieces of the
same lengths, and a chain of letters learned from them draws as many more as make
a small table no poorer than a large one. A run's p-value is the part
of all these strings that are in its encoding and score as high: text seldom
mixes capitals, small letters and digits, so in such an encoding a middling score tells
more than in small letters alone. Digits alone are the exception, as ordinary numbers
look random too; they are held against random digits. A run whose randomness
the tests themselves reject, or that has more signs between than data in base64 would,
is no discovery, however rare its encoding. Within each class of lengths the Benjamini-Hochberg rule, over all runs of the corpus, keeps the
false discoveries in check.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import SLICE, checkpoint, map_texts, pick

ASSIGN, ACCESS, HEX, RANDOM = KINDS = ("assign", "access", "hex", "random")
# The base patterns, letters of the first in either case (ASCII only).
ASSIGNED = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
NAMED = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

LEAST_RUN = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
#: A run is cut at each '=' inside; only padding at its end stays with its last part.
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:={1,6}\Z)?")
#: Signs of padding that count for the least length.
PADDING = 2
#: Signs that are no part of the test.
SIGNS = str.maketrans("", "", "+/-_=")
#: Alphabets from narrow to wide; a run belongs to the first that holds its letters and digits.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex-upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36-upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64-url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64-mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
INDEX = {name: {c: i for i, c in enumerate(signs)} for name, signs in ALPHABETS.items()}
#: Encodings of letters and digits alone, with the place of each of base62's signs in theirs; -1 for none.
ENCODINGS = tuple(name for name in ALPHABETS if not name.startswith("base64"))
BASE = ALPHABETS["base62"]
PLACES = {name: np.array([INDEX[name].get(c, -1) for c in BASE]) for name in ENCODINGS}
DECIMAL = ENCODINGS.index("decimal")
#: Upper ends of the classes of lengths.
LENGTHS = (24, 32, 48, 64, 128)
#: Scores are counted in this many cells.
CELLS = 1000
#: Lengths of null strings: some of the first class, the ends of the classes, and some for the last class, which has none.
NULL_LENGTHS = (16, LEAST_RUN, *LENGTHS, 160, 256, 512, 1024, 2048)
#: Strings of the greatest length that the chain of letters draws; shorter ones are pieces of these.
DRAWN = 1000
#: Characters of null strings that are tested at once.
NULL_BLOCK = 1 << 18
LETTERS = re.compile(r"[A-Za-z0-9]+")
FALSE_DISCOVERIES = 0.01
#: A run is taken for structured if random ones score as low in this part of cases, or have as many signs between in that part.
REJECTED, TOO_MANY = 0.002, 0.03
#: Share of signs between in the widest alphabet.
SIGN_SHARE = 4 / len(ALPHABETS["base64-mixed"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlap in each kind."""
    found = []
    if NAMED.search(text):
        found += [(m.start(), m.end(), ASSIGN) for m in ASSIGNED.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), ACCESS) for m in ACCESS_KEY.finditer(text)]
    found += [(m.start(), m.end(), HEX) for m in HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(run: str) -> str:
    """The narrowest alphabet of a run's letters and digits."""
    signs = set(run.translate(SIGNS))
    return next(name for name in ENCODINGS if signs <= INDEX[name].keys())


def _upper(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x) for x in (z / math.sqrt(2)).tolist()])


def joint_p(values: np.ndarray, k: int) -> np.ndarray:
    """Joint p-value of three tests of randomness for each row of numbers below k; rows have two or more."""
    m, n = values.shape
    counts = np.bincount((values + np.arange(m)[:, None] * k).ravel(), minlength=m * k).reshape(m, k)
    chi = np.maximum(np.einsum("ij,ij->i", counts, counts) * (k / n) - n, 0.0)
    # Wilson and Hilferty's cube root makes chi-squared nearly normal.
    p_uniform = _upper(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1))))
    high = values >= k / 2
    ups = high.sum(axis=1)
    mean = 2 * ups * (n - ups) / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    changes = (high[:, 1:] != high[:, :-1]).sum(axis=1)
    p_runs = np.where((ups > 0) & (ups < n), 2 * _upper(np.abs(1 + changes - mean) / spread), 2.0 ** (1 - n))
    average = values.mean(axis=1)
    power = np.einsum("ij,ij->i", values, values) - n * average**2
    lagged = np.einsum("ij,ij->i", values[:, 1:], values[:, :-1]) + (n - 1) * average**2
    lagged = lagged - average * (2 * n * average - values[:, 0] - values[:, -1])
    level = (values == values[:, :1]).all(axis=1)
    serial = lagged / np.where(level, 1.0, power)
    p_serial = np.where(level, 0.0, 2 * _upper(np.abs(serial + 1 / n) * math.sqrt(n)))
    joined = -sum(np.log(np.maximum(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return np.exp(-joined) * (1 + joined + joined**2 / 2)


def randomness(run: str, name: str) -> float:
    """Joint p-value of three tests of randomness of a run's letters and digits in an alphabet; near 0 for structured strings."""
    index = INDEX[name]
    values = np.array([[index[c] for c in run.translate(SIGNS)]])
    return float(joint_p(values, len(index))[0]) if values.shape[1] > 1 else 0.0


@lru_cache(maxsize=4096)
def many_signs(signs: int, n: int) -> bool:
    """Whether random data of n signs in the widest alphabet seldom has so many of those between."""
    return sum(math.comb(n, i) * SIGN_SHARE**i * (1 - SIGN_SHARE) ** (n - i) for i in range(signs)) > 1 - TOO_MANY


def length_class(n: int) -> int:
    return next((i for i, top in enumerate(LENGTHS) if n <= top), len(LENGTHS))


def _cell(p: float) -> int:
    """Scores by their logarithm: 0 for 1e-20 or less, CELLS - 1 for 1."""
    return int((1 + max(math.log10(max(p, 1e-20)), -20.0) / 20) * (CELLS - 1))


def _outside(start: int, end: int, spans) -> list[tuple[int, int]]:
    """The parts of [start, end) that no span covers; spans are in order of their starts."""
    parts = []
    for s, e, _ in spans:
        if s < end and start < e:
            parts.append((start, s))
            start = max(start, e)
    return [(a, b) for a, b in [*parts, (start, end)] if a < b]


def scan_text(text: str) -> tuple[list, list, list[str]]:
    """Base spans, runs (start, end, class, encoding, cell) outside them, and the words of letters and digits outside both."""
    base = base_spans(text)
    runs = []
    for m in RUN.finditer(text):
        for part in PART.finditer(m[0]):
            for start, end in _outside(m.start() + part.start(), m.start() + part.end(), base):
                run = text[start:end]
                n = len(run.rstrip("="))
                if n + min(PADDING, len(run) - n) >= LEAST_RUN:
                    name, core = encoding(run), len(run.translate(SIGNS))
                    score = 0.0 if many_signs(n - core, n) else randomness(run, name)
                    runs.append((start, end, length_class(core), ENCODINGS.index(name), _cell(score)))
    # What is tested, or is a secret already, tells nothing about ordinary text.
    words, at = [], 0
    for start, end in sorted([(s, e) for s, e, *_ in base + runs]):
        words += LETTERS.findall(text, at, max(at, start))
        at = max(at, end)
    return base, runs, words + LETTERS.findall(text, at)


#: The place of each ASCII character in base62, and behind the last one for a gap between words.
GAP = len(BASE)
CODES = np.array([BASE.find(chr(i)) if chr(i) in BASE else GAP for i in range(128)])


def _cells(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The narrowest encoding and the cell of each row of places in base62."""
    kinds, cells = np.full(len(rows), -1), np.zeros(len(rows), dtype=np.int64)
    # Bits of the encodings that hold a sign; a row is in those that hold all of its signs.
    holds = sum((PLACES[name] >= 0).astype(np.int64) << i for i, name in enumerate(ENCODINGS))
    common = np.bitwise_and.reduce(holds[rows], axis=1)
    for i, name in enumerate(ENCODINGS):
        own = (kinds < 0) & (common >> i & 1 == 1)
        if own.any():
            kinds[own] = i
            p = joint_p(PLACES[name][rows[own]], len(INDEX[name]))
            cells[own] = ((1 + np.log10(np.maximum(p, 1e-20)) / 20) * (CELLS - 1)).astype(np.int64)
    return kinds, cells


def null_counts(codes: list[np.ndarray]) -> np.ndarray:
    """Numbers of null strings by class, encoding and cell: pieces without overlap of each of codes, at every length."""
    out = np.zeros((len(LENGTHS) + 1, len(ENCODINGS), CELLS), dtype=np.int64)
    for n in NULL_LENGTHS:
        rows = np.concatenate([np.zeros((0, n), dtype=np.int64)] + [c[: len(c) // n * n].reshape(-1, n) for c in codes])
        step = max(1, NULL_BLOCK // max(n, GAP))
        for at in range(0, len(rows), step):
            np.add.at(out[length_class(n)], _cells(rows[at : at + step]), 1)
    return out


def neighbours(words: list[str]) -> np.ndarray:
    """How often each sign, or a gap, follows each other one."""
    codes = CODES[np.frombuffer(f" {' '.join(words)} ".encode("ascii"), dtype=np.uint8)]
    return np.bincount(codes[:-1] * (GAP + 1) + codes[1:], minlength=(GAP + 1) ** 2)


def drawn_strings(pairs: np.ndarray, number: int = DRAWN, seed: int = 8) -> list[np.ndarray]:
    """Strings of the greatest null length from a chain of the signs of text, its words joined without gaps.

    A sign follows another as often as in the text, or begins the next word
    where the text ends one. What the text never has keeps a small chance.
    """
    counts = pairs.reshape(GAP + 1, GAP + 1).astype(float)
    first = (counts[GAP, :GAP] + 0.5 / GAP) / (counts[GAP, :GAP].sum() + 0.5)
    every = (counts[:, :GAP].sum(axis=0) + 0.5 / GAP) / (counts[:, :GAP].sum() + 0.5)
    chain = counts[:GAP, :GAP] + counts[:GAP, GAP:] * first + every
    chain = (chain / chain.sum(axis=1, keepdims=True)).cumsum(axis=1)
    draw = np.random.default_rng(seed)
    length = max(NULL_LENGTHS)
    out = np.empty((number, length), dtype=np.int64)
    out[:, 0] = np.minimum(np.searchsorted(first.cumsum(), draw.random(number)), GAP - 1)
    for i in range(1, length):
        out[:, i] = np.minimum((chain[out[:, i - 1]] < draw.random(number)[:, None]).sum(axis=1), GAP - 1)
    return list(out)


def p_values(nulls: np.ndarray) -> np.ndarray:
    """By class, encoding and cell: the part of the class's null strings that are in the encoding and reach the cell.

    Digits alone are held against random digits instead.
    """
    at_least = np.cumsum(nulls[:, :, ::-1], axis=2)[:, :, ::-1]
    p = (1 + at_least) / (1 + nulls.sum(axis=(1, 2)))[:, None, None]
    draw = np.random.default_rng(9)
    digits = null_counts([draw.integers(BASE.index("0"), GAP, size=DRAWN * max(NULL_LENGTHS))])[:, DECIMAL]
    p[:, DECIMAL] = (1 + np.cumsum(digits[:, ::-1], axis=1)[:, ::-1]) / (1 + digits.sum(axis=1))[:, None]
    return p


def accepted(runs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """By class, encoding and cell: whether such a run is a discovery by the Benjamini-Hochberg rule over its class's runs."""
    out = np.zeros(p.shape, dtype=bool)
    for cls, counts in enumerate(runs):
        order = np.argsort(p[cls], axis=None, kind="stable")
        upto, sorted_p = counts.ravel()[order].cumsum(), p[cls].ravel()[order]
        passes = np.flatnonzero(sorted_p * counts.sum() <= FALSE_DISCOVERIES * upto)
        if upto[-1] and len(passes):
            out[cls] = p[cls] <= sorted_p[passes[-1]]
    out[:, :, : _cell(REJECTED)] = False
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    Spans are kind:start:end in code points, by start and then kind. Base
    spans always stay; random ones lie outside them. A null text counts as
    empty: no spans, and the digest of an empty string. Texts are scanned
    once; what the second step reads is their spans. An empty table gives no
    rows.
    """
    size = (len(LENGTHS) + 1) * len(ENCODINGS) * CELLS
    at = [("start", pa.int64()), ("end", pa.int64())]
    kind = [("cls", pa.int32()), ("enc", pa.int32()), ("cell", pa.int32())]
    counted = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))
    schema = pa.schema(
        [("last", pa.bool_()), ("doc_id", pa.int64()), ("base", pa.list_(pa.struct([*at, ("kind", pa.string())]))), ("runs", pa.list_(pa.struct(at + kind))), ("nulls", counted), ("pairs", counted)]
    )
    spark_schema = (
        "last boolean, doc_id long, base array<struct<start: long, end: long, kind: string>>, "
        "runs array<struct<start: long, end: long, cls: int, enc: int, cell: int>>, nulls array<struct<at: int, n: long>>, pairs array<struct<at: int, n: long>>"
    )

    def sparse(counts):
        return [{"at": int(i), "n": int(counts[i])} for i in np.flatnonzero(counts)]

    def run(batches):
        """A row for each text, and a last one with what the task has counted."""
        nulls, pairs = np.zeros(size, np.int64), np.zeros((GAP + 1) ** 2, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                ids, texts = (c.to_pylist() for c in batch.slice(i, SLICE).columns)
                found = [scan_text(t or "") for t in texts]
                nulls += null_counts([CODES[np.frombuffer("".join(w).encode("ascii"), dtype=np.uint8)] for *_, w in found]).ravel()
                pairs += sum(neighbours(w) for *_, w in found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "last": [False] * len(ids),
                        "doc_id": ids,
                        "base": [[{"start": s, "end": e, "kind": k} for s, e, k in f[0]] for f in found],
                        "runs": [[{"start": s, "end": e, "cls": c, "enc": x, "cell": y} for s, e, c, x, y in f[1]] for f in found],
                        "nulls": [[]] * len(ids),
                        "pairs": [[]] * len(ids),
                    },
                    schema=schema,
                )
        yield pa.RecordBatch.from_pydict({"last": [True], "doc_id": [None], "base": [[]], "runs": [[]], "nulls": [sparse(nulls)], "pairs": [sparse(pairs)]}, schema=schema)

    found = checkpoint(pick(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, spark_schema))

    def total(column, length):
        out = np.zeros(length, dtype=np.int64)
        for r in found.where("last").select(F.explode(column).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).collect():
            out[r["at"]] = r["n"]
        return out

    shape = (len(LENGTHS) + 1, len(ENCODINGS), CELLS)
    runs = np.zeros(shape, dtype=np.int64)
    for r in found.select(F.explode("runs").alias("x")).groupBy("x.cls", "x.enc", "x.cell").agg(F.count(F.lit(1)).alias("n")).collect():
        runs[r["cls"], r["enc"], r["cell"]] = r["n"]
    nulls = total("nulls", size).reshape(shape) + null_counts(drawn_strings(total("pairs", (GAP + 1) ** 2)))
    passes = accepted(runs, p_values(nulls))

    def finish(doc_id, base, runs):
        out = []
        for b, r in zip(base, runs, strict=True):
            own = [(s["start"], s["end"], s["kind"]) for s in b]
            more = [(s["start"], s["end"], RANDOM) for s in r if passes[s["cls"], s["enc"], s["cell"]]]
            kinds = [k for *_, k in own]
            digest = hashlib.sha256(_joined(own).encode()).hexdigest()
            every = sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2])))
            out.append((kinds.count(ASSIGN), kinds.count(ACCESS), kinds.count(HEX), digest, _joined(every)))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
        return {"doc_id": doc_id} | {n: [o[i] for o in out] for i, n in enumerate(names)}

    numbers = {n: ("long", pa.int64()) for n in ("doc_id", "n_assign", "n_access", "n_hex")}
    texts = {n: ("string", pa.string()) for n in ("base_sha256", "spans")}
    return map_texts(found.where("NOT last"), ["doc_id", "base", "runs"], finish, numbers | texts)
