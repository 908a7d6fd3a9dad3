"""Periodic runs of words, found by bit-parallel comparison at every lag.

Words are numbered, and each bit of the numbers is a plane: one big integer
with a bit a word. A plane XORed with itself shifted by a lag shows where
that bit differs from the word so many places on; the OR of all planes shows
where the words do. Stretches without a difference are isolated by
shift-doubling: ANDing the equal places with themselves shifted by 1, 2, 4,
... leaves the starts of stretches that are long enough.

Long texts have many lags. A run of period q holds several multiples of q in a row,
so a lag at which those never agree is left out beforehand; that costs n / q
comparisons, n log n over all lags, and drops no run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import map_texts, pick

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Lags from here on are tried at multiples of the lag first.
SPARSE = 16
#: Multiples that are compared at once.
AT_ONCE = 1 << 20
#: Further places of a stretch that are compared before a lag is taken up.
PROBES = 16
#: Planes after which a lag without a long stretch is given up.
PLANES = 4


def bit_planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the ids, with a bit a word; the lowest bits first."""
    width = max(int(ids.max()).bit_length(), 1) if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(width)]


def long_stretches(equal: int, need: int) -> int:
    """The places at which need set bits in a row begin."""
    have = 1
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    return equal


def equal_stretches(planes: list[int], n: int, lag: int, need: int) -> int:
    """The places at which need words in a row equal those a lag further on."""
    inside, off = (1 << (n - lag)) - 1, 0
    for i, plane in enumerate(planes, 1):
        off |= plane ^ (plane >> lag)
        if i % PLANES == 0 and i < len(planes) and not long_stretches(inside & ~off, need):
            return 0
    return long_stretches(inside & ~off, need)


def set_blocks(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the blocks of set bits."""
    raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), dtype=np.uint8)
    steps = np.diff(np.unpackbits(raw, bitorder="little").astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(steps == 1)
    return starts, np.flatnonzero(steps == -1) - starts


def likely_lags(ids: np.ndarray, first: int, factor: int):
    """(lag, places) of lags from first on at which factor - 1 multiples of the lag in a row equal their successors.

    Each place is the first of such multiples; the stretch they are part of
    is compared at some further places.
    """
    n, row = len(ids), factor - 1
    lags = np.arange(first, n // factor + 1, dtype=np.int64)
    numbers = (n - 1) // lags if len(lags) else lags
    at = 0
    while at < len(lags):
        to = max(at + 1, int(np.searchsorted(np.cumsum(numbers[at : at + AT_ONCE]), AT_ONCE)) + at)
        lag = np.repeat(lags[at:to], numbers[at:to])
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(numbers[at:to]) - numbers[at:to], numbers[at:to])) * lag
        at = to
        equal = ids[place] == ids[place + lag]
        if len(equal) < row:
            continue
        hit = np.ones(len(equal) - row + 1, dtype=bool)
        for i in range(row):
            hit &= equal[i : len(equal) - row + 1 + i]
        hit &= lag[: len(hit)] == lag[row - 1 :]
        lag, place = lag[: len(hit)][hit], place[: len(hit)][hit]
        for i in range(1, PROBES + 1):
            probe = place + (row - 1) * lag * i // (PROBES + 1)
            same = ids[probe] == ids[probe + lag]
            lag, place = lag[same], place[same]
        ends = np.flatnonzero(np.diff(lag, append=-1)) + 1
        for start, end in zip(np.append(0, ends)[:-1], ends, strict=True):
            yield int(lag[start]), place[start:end]


class _Found:
    """Runs found so far, and whether one of them holds a stretch of words."""

    def __init__(self):
        self.runs: dict[tuple[int, int], int] = {}
        self._sorted = None

    def add(self, start: int, length: int, period: int) -> None:
        """Periods come in rising order, so the first one of a stretch is its smallest."""
        if (start, length) not in self.runs:
            self.runs[start, length] = period
            self._sorted = None

    def explain(self, places: np.ndarray, size: int, lag: int) -> np.ndarray:
        """Which stretches of that size lie in a run whose period divides the lag.

        Runs of periods up to the lag that share lag words or more twice over
        are one, so of all runs that begin before a stretch only the one
        that reaches furthest can hold it.
        """
        if not self.runs:
            return np.zeros(len(places), dtype=bool)
        if self._sorted is None:
            rows = np.array([(s, s + n, p) for (s, n), p in self.runs.items()], dtype=np.int64)
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            furthest = np.maximum.accumulate(rows[:, 1])
            best = np.maximum.accumulate(np.where(rows[:, 1] == furthest, np.arange(len(rows)), 0))
            self._sorted = rows[:, 0], furthest, rows[best, 2]
        starts, furthest, periods = self._sorted
        at = np.searchsorted(starts, places, side="right") - 1
        return (at >= 0) & (furthest[at] >= places + size) & (lag % periods[at] == 0)


def runs_of(words: list, least: int = 6, factor: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period.

    A run is a stretch with smallest period q and a length of at least least
    and factor * q that can't be extended; factor is 3 at least, so that a
    stretch that several lags find has the smallest of them as its period.
    """
    if factor < 3:
        raise ValueError("factor is 3 at least")
    n = len(words)
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if n < least or len(number) == n:
        return []
    planes, found = bit_planes(ids), _Found()

    def settle(lag):
        need = max(least - lag, (factor - 1) * lag, 1)
        if lag + need <= n and (bits := equal_stretches(planes, n, lag, need)):
            for start, more in zip(*set_blocks(bits), strict=True):
                found.add(int(start), int(more) + need - 1 + lag, lag)

    for lag in range(1, min(SPARSE, n // factor + 1)):
        settle(lag)
    for lag, places in likely_lags(ids, SPARSE, factor):
        if not found.explain(places, (factor - 1) * lag + 1, lag).all():
            settle(lag)
    return sorted((s, length, p) for (s, length), p in found.runs.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(steps[:-1]) > 0, strict=True) if not inside]


def periodic_runs(docs: DataFrame, least: int = 6, factor: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document.

    runs lists (start, length, period) of every stretch of words with a
    smallest period q, a length of at least least and factor * q, and no neighbour
    that goes on with the period, by start and period; collapsed is the text
    with one period left of each run, its words joined by one space. Words
    are runs of anything but ASCII white space and compared as they are. A
    null text has no words, no runs and an empty collapsed text. Repeated rows
    each have their result; an empty table gives no rows. A text is one
    task's work: n log n, and n / 30 more for each lag at which it
    seems to repeat itself.
    """

    def work(doc_id, text):
        words = [WORD.findall(t or "") for t in text]
        runs = [runs_of(w, least, factor) for w in words]
        return {
            "doc_id": doc_id,
            "n_words": [len(w) for w in words],
            "runs": [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs],
            "collapsed": [" ".join(kept_words(w, r)) for w, r in zip(words, runs, strict=True)],
        }

    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = {
        "doc_id": ("long", pa.int64()),
        "n_words": ("long", pa.int64()),
        "runs": ("array<struct<start: long, length: long, period: long>>", pa.list_(run)),
        "collapsed": ("string", pa.string()),
    }
    return map_texts(pick(docs, id_col, text_col), ["doc_id", "text"], work, schema)
