"""Personal data: fixed base patterns, and boosted trees over wide candidates.

Generators propose more spans than are meant, overlapping ones too: addresses
with spelt-out signs, dotted quads in any brackets, and every window of
consecutive groups of digits that could be a card or a phone number. For each
kind, gradient-boosted trees judge a candidate by its format and by what
stands around it. What is confirmed are the base spans of a fold of the
documents, each also in other spellings in its own surroundings, as base
patterns know one spelling only; all other candidates of the fold count
against. A second fold calibrates: scores become probabilities by isotonic
regression, and a kind's threshold is the least score of enough
probability. Candidates over it that meet no base span are added, the best
first where they overlap.

Texts are read twice, to learn and with the trees. Every candidate of both
folds counts: those of the same features are one row with their number, and
each level of a tree adds up slopes over all rows. Tasks score candidates in
blocks, so a text that is all numbers needs no more memory than any other of
its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import SLICE, checkpoint, fold, pick

KINDS = ("email", "ip", "card", "phone")
# The base patterns. An email's part before the sign is taken by hand, so that long runs are read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A quad can only begin where its first digits do.
QUAD = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, LARGEST_PART = (12, 19), (9, 15), 255

DIGITS = re.compile(r"[0-9]+")
#: Groups of digits with up to three signs between them, and what may stand before the first.
NUMBERS = re.compile(r"(?:\+|\()?\(?[0-9](?:[ ().\-/_]{0,3}[0-9])+")
WIDE_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)| \. | dot )[0-9]{1,3}){3}")
#: The sign of an address, as itself or spelt out; the two sides are taken by hand.
SIGN = re.compile(r" ?(?:@|[(\[{]at[)\]}]| at ) ?", re.IGNORECASE)
WIDE_DOMAIN = re.compile(r"[\w-]+(?:(?:\.| ?[(\[{](?:dot|\.)[)\]}] ?| dot | \. ?)[\w-]+)+", re.IGNORECASE)
#: The longest address that mail allows; longer candidates aren't proposed.
ADDRESS = 320
#: Whole numbers beside a candidate; digits of a word with letters are none.
NUMBER_BEFORE = re.compile(r"(?<!\w)[0-9]+[ ().\-/_]{0,3}$")
NUMBER_AFTER = re.compile(r"[ ().\-/_]{0,3}[0-9]+(?!\w)")
#: Digits of a window of groups.
WINDOW = (7, 19)

# Words that announce each kind.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "from", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "tarjeta", "carte", "karte", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "móvil", "whatsapp"),
}
AROUND = 40
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
MODULUS, LEARN, CALIBRATE = 3, 0, 1
BLOCK = 8192
#: Slopes are whole numbers of this part, so that sums don't depend on the order of rows.
UNIT = 1 << 24
#: Different candidates that a task counts before it passes them on.
COUNTED = 20_000
#: Different candidates that one task holds at the levels of trees, and tasks whose sums the driver adds up itself.
LEVEL_ROWS, LEVEL_TASKS = 20_000, 16
#: Cells of scores: only those of one cell are ordered in one task.
SCORE_CELLS, SCORE_END = 16, 64


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= LARGEST_PART


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and without overlap in each kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in QUAD.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= sum(map(len, DIGITS.findall(m[0]))) <= PHONE_DIGITS[1]:
            found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str):
    """(kind, start, end) of every candidate; candidates overlap."""
    free = 0
    for m in SIGN.finditer(text):
        start = m.start()
        while start > free and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        domain = WIDE_DOMAIN.match(text, m.end()) if start < m.start() else None
        if domain:
            # A sentence may go on after a domain; each further label is a candidate of its own.
            ends = [domain.start() + x.end() for x in re.finditer(r"[\w-]+", domain[0])][1:]
            for end in ends:
                if end - start > ADDRESS:
                    break
                if not _spelt(text[domain.start() : end]):
                    yield "email", start, end
        free = m.end()
    for m in WIDE_QUAD.finditer(text):
        yield "ip", m.start(), m.end()
    for m in NUMBERS.finditer(text):
        groups = [(x.start() + m.start(), x.end() + m.start()) for x in DIGITS.finditer(m[0])]
        for i, (start, _) in enumerate(groups):
            if start and text[start - 1].isalpha():
                continue
            # Signs before a window belong to it where they open it.
            lead = start
            while lead > m.start() and lead > start - 2 and text[lead - 1] in "+(":
                lead -= 1
            n = 0
            for a, b in groups[i:]:
                n += b - a
                if n > WINDOW[1]:
                    break
                if n >= WINDOW[0]:
                    yield "phone", lead, b
                    if n >= CARD_DIGITS[0]:
                        yield "card", start, b


def _spelt(domain: str) -> bool:
    """Whether a domain ends on a spelt-out sign."""
    return re.search(r"(?:^|[^\w-])(?:dot|at)$", domain, re.IGNORECASE) is not None


FEATURES = (
    "length", "digits", "letters", "others", "kinds of others", "groups", "longest group", "shortest group", "first group", "last group",
    "luhn", "large parts", "distinct digits", "plus", "zeros", "brackets", "sign", "spelt sign", "spelt dot", "labels", "last label",
    "last label letters", "before", "after", "number before", "number after", "digits around", "equals before", "dots", "hyphens", "spaces",
    "slashes", "even groups", *(f"{k} cue" for k in KINDS),
)


def _class(c: str) -> int:
    """0 nothing or space, 1 letter, 2 digit, 3 bracket or quote, 4 sentence sign, 5 other."""
    if not c or c.isspace():
        return 0
    return 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "()[]{}<>\"'" else 4 if c in ".,;:!?" else 5


def features(text: str, start: int, end: int) -> list[float]:
    """Format and surroundings of a candidate, in the order of FEATURES."""
    s, left, right = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    groups = DIGITS.findall(s)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    letters = sum(c.isalpha() for c in s)
    others = [c for c in s if not c.isalnum()]
    low = s.lower()
    labels = re.split(r"[^\w-]+", s)
    words = {w.lower() for w in WORD.findall(left)}
    own = left[-1:]
    return [
        len(s), len(digits), letters, len(others), len(set(others)), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        luhn(digits) if digits else 0, sum(not _small(g) for g in groups), len(set(digits)), s[0] == "+", digits[:2] == "00", "(" in s or "[" in s,
        "@" in s, " at " in low or "at)" in low or "at]" in low, "dot" in low or "[.]" in s or "(.)" in s, len(labels), len(labels[-1]),
        labels[-1].isalpha(), _class(own), _class(right[:1]), bool(NUMBER_BEFORE.search(left)), bool(NUMBER_AFTER.match(right)),
        sum(c.isdigit() for c in left[-20:] + right[:20]), "=" in left[-3:], s.count("."), s.count("-"), s.count(" "), s.count("/"),
        len(set(sizes)) == 1, *(any(c in words for c in CUES[k]) for k in KINDS),
    ]


def spellings(kind: str, span: str) -> list[str]:
    """Other ways to write a base span."""
    digits = "".join(DIGITS.findall(span))
    if kind == "email":
        name, _, domain = span.rpartition("@")
        dots = domain.replace(".", " dot ")
        return [f"{name} at {dots}", f"{name}(at){domain}", f"{name}[at]{domain.replace('.', '[dot]')}", f"{name} @ {domain}", f"{name} [at] {domain.replace('.', ' [dot] ')}"]
    if kind == "ip":
        return [span.replace(".", sign) for sign in ("[.]", "(.)", " dot ", " . ")]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [sign.join(fours) for sign in (".", "/", "_", "  ", " - ")]
    groups = DIGITS.findall(span)
    rest = span[span.find(groups[1]) - (span[span.find(groups[1]) - 1] == "(") :] if len(groups) > 1 else ""
    out = ["00" + span[1:], span[1:], "+" + "/".join(groups), "00 " + ".".join(groups)]
    return out + ([rest, "-".join(groups[1:]), ".".join(groups[1:])] if sum(map(len, groups[1:])) >= 9 else [])


def labelled(text: str, base: list):
    """(kind, label, where) of the text's candidates, and of the base spans in other spellings; where is what features take."""
    own = {(k, s, e) for s, e, k in base}
    for k, s, e in proposals(text):
        yield k, int((k, s, e) in own), (text, s, e)
    for s, e, k in base:
        left, right = text[max(0, s - 2 * AROUND) : s], text[e : e + 2 * AROUND]
        for other in spellings(k, text[s:e]):
            written = left + other + right
            place = len(left), len(left) + len(other)
            for kind, a, b in proposals(written):
                if a < place[1] and place[0] < b:
                    yield kind, int(kind == k and (a, b) == place), (written, a, b)


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth: at each node a feature and the value above which it goes right; leaves add up."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        if not len(x):
            return out
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node[0] < len(feature):
                node = 2 * node + 1 + (x[row, feature[node]] > above[node])
            out += leaf[node - len(feature)]
        return out


def slopes(code, label, n, score, node, nodes: int, width: int) -> np.ndarray:
    """Slope and bend of the logistic loss in units, added up by label, node, feature and cell; n is how often a row counts."""
    m = code.shape[1]
    p = 1 / (1 + np.exp(-score))
    place = (((label * nodes + node)[:, None] * m + np.arange(m)) * width + code).ravel()
    out = [np.bincount(place, weights=np.repeat(np.rint(v * UNIT) * n, m), minlength=2 * nodes * m * width) for v in (label - p, p * (1 - p))]
    return np.stack(out).astype(np.int64).reshape(2, 2, nodes, m, width)


def placed(code, feature, above, level: int) -> np.ndarray:
    """Each row's place among the nodes of a level of a tree."""
    node, row = np.zeros(len(code), dtype=np.int64), np.arange(len(code))
    for _ in range(level):
        node = 2 * node + 1 + (code[row, feature[node]] > above[node])
    return node - ((1 << level) - 1)


def grow(sums: Callable, edges: dict, starts: dict, weights: dict, trees: int, depth: int, rate: float, ridge: float) -> dict[str, Trees]:
    """Boosted trees of each kind on cells, by Newton steps; sums(models, grown, level) has what slopes returns, over all rows of each kind.

    edges has the edges between cells by kind and feature, starts the first
    scores, weights how much a row of each label counts.
    """
    nodes = (1 << depth) - 1
    models = {k: Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), starts[k]) for k in edges}
    for _ in range(trees):
        grown = {k: (np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes + 1)) for k in edges}
        for level in range(depth):
            first = (1 << level) - 1
            for k, found in sums(models, {k: g[:2] for k, g in grown.items()}, level).items():
                feature, above, leaf = grown[k]
                g, h = ((v * np.reshape(weights[k], (2, 1, 1, 1))).sum(axis=0) / UNIT for v in found)
                left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
                whole_g, whole_h = g[:, :1].sum(axis=2, keepdims=True), h[:, :1].sum(axis=2, keepdims=True)
                gain = left_g**2 / (left_h + ridge) + (whole_g - left_g) ** 2 / (whole_h - left_h + ridge) - whole_g**2 / (whole_h + ridge)
                for i, at in enumerate(gain.reshape(1 << level, -1).argmax(axis=1)):
                    j, b = divmod(int(at), gain.shape[2])
                    a_g, a_h = whole_g[i, 0, 0], whole_h[i, 0, 0]
                    if gain[i, j, b] > 1e-6 and b < len(edges[k][j]):
                        feature[first + i], above[first + i] = j, b
                        a_g, a_h = left_g[i, j, b], left_h[i, j, b]
                    if level == depth - 1:
                        leaf[2 * i : 2 * i + 2] = rate * a_g / (a_h + ridge), rate * (whole_g[i, 0, 0] - a_g) / (whole_h[i, 0, 0] - a_h + ridge)
        models = {k: Trees(*(np.vstack([old, new]) for old, new in zip((m.feature, m.above, m.leaf), grown[k], strict=True)), m.start) for k, m in models.items()}
    return models


def valued(trees: Trees, edges: list[np.ndarray]) -> Trees:
    """Trees on cells as trees on values."""
    above = [[edges[j][int(b)] if math.isfinite(b) else math.inf for j, b in zip(*own, strict=True)] for own in zip(trees.feature, trees.above, strict=True)]
    return Trees(trees.feature, np.array(above, dtype=float).reshape(trees.above.shape), trees.leaf, trees.start)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of rows at hand, splits between at most bins quantiles of a feature."""
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for v in x.T]
    code = coded(x, edges)
    label = y.astype(np.int64)

    def sums(models, grown, level):
        return {k: slopes(code, label, 1, m.score(code), placed(code, *grown[k], level), 1 << level, bins + 1) for k, m in models.items()}

    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    found = grow(sums, {"": edges}, {"": float(np.log(mean / (1 - mean)))}, {"": (1.0, 1.0)}, trees, depth, rate, ridge)
    return valued(found[""], edges)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The cell of each value: how many of its feature's edges it is above."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


def edged(values: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Edges between cells: all values if they are few, else their weighted quantiles; values are in order."""
    if len(values) <= bins:
        return values
    whole = weight.cumsum()
    return np.unique(values[np.minimum(np.searchsorted(whole, np.linspace(0, 1, bins + 1)[1:-1] * whole[-1]), len(values) - 1)])


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at which the probability rises, and the probabilities, never falling; equal scores share one."""
    blocks: list[list[float]] = []
    scores, at = np.unique(score, return_inverse=True)
    for s, hits, total in zip(scores, np.bincount(at, weights=weight * y), np.bincount(at, weights=weight), strict=True):
        blocks.append([s, hits, total])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, hits, total = blocks.pop()
            blocks[-1][1] += hits
            blocks[-1][2] += total
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def threshold(score, y, weight, least: float) -> float:
    """The least score whose calibrated probability is least or more; infinite without one.

    One more case against counts at the top, so that a few clean ones prove nothing.
    """
    if not len(score):
        return math.inf
    starts, chance = isotonic(np.append(score, score.max()), np.append(y, 0.0), np.append(weight, 1.0))
    enough = chance >= least
    return float(starts[enough][0]) if enough.any() else math.inf


def thresholds(scored: DataFrame, least: float) -> dict[str, float]:
    """The threshold of each kind in (kind, score, hits, total), as threshold has it, whatever the number of scores.

    The scores of a calibrated probability of least or more are those above
    the one from which on hits exceed their part of all cases by most.
    """
    part = Fraction(least).limit_denominator(10**6)
    rows = scored.select("kind", "score", (F.col("hits") * part.denominator - F.col("total") * part.numerator).alias("gain"))
    rows = rows.withColumn("cell", F.floor(F.greatest(F.least("score", F.lit(SCORE_END)), F.lit(-SCORE_END)) * SCORE_CELLS))
    cells = rows.groupBy("kind", "cell").agg(F.sum("gain").alias("own"))
    beyond = Window.partitionBy("kind").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("kind", "cell", F.coalesce(F.sum("own").over(beyond), F.lit(0)).alias("beyond"))
    within = Window.partitionBy("kind", "cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(cells, ["kind", "cell"]).withColumn("gain", F.sum("gain").over(within) + F.col("beyond"))
    best = rows.groupBy("kind").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "score")).alias("b")).select("kind", "b.loss", "b.score").collect()
    # One more case against counts at the top.
    return {kind: score if -loss >= part.numerator else math.inf for kind, loss, score in best}


@dataclass(frozen=True)
class Model:
    """Trees and threshold of each kind that has both."""

    kinds: dict[str, tuple[Trees, float]]


def counted(docs: DataFrame) -> DataFrame:
    """(part, kind, label, x, n): the features of all candidates of (doc_id, text, part), and how many have them."""
    schema = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("label", pa.int32()), ("x", pa.list_(pa.int32())), ("n", pa.int64())])

    def run(batches):
        n: Counter = Counter()

        def rows():
            columns = [list(c) for c in zip(*n, strict=True)] or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, list(n.values())], schema, strict=True)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                text, part = batch.column(0)[i].as_py() or "", batch.column(1)[i].as_py()
                for kind, label, where in labelled(text, base_spans(text)):
                    n[part, kind, label, tuple(map(int, features(*where)))] += 1
                    if len(n) >= COUNTED:
                        yield rows()
                        n.clear()
        yield rows()

    found = docs.select("text", "part").mapInArrow(run, "part int, kind string, label int, x array<int>, n long")
    return found.groupBy("part", "kind", "label", "x").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.95,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
) -> Model:
    """Trees from one fold of the documents, thresholds from another.

    Of crc32 of the id as text modulo 3, 0 learns and 1 calibrates; all
    candidates of both count. Both labels of a kind weigh the same in its
    trees. least is the calibrated probability of a redaction. A kind without
    candidates of both labels in both folds has no trees. Each level of a tree
    is a job over all kinds; the driver sees sums only.
    """
    rows = pick(docs, id_col, text_col).withColumn("part", fold(F.col("doc_id"), MODULUS).cast("int")).where(F.col("part").isin(LEARN, CALIBRATE))
    found = checkpoint(counted(rows))
    sums_of = found.groupBy("part", "kind", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")).collect()
    many = {(r["part"], r["kind"], r["label"]): r["n"] for r in sums_of}
    kinds = [k for k in KINDS if all((part, k, label) in many for part in (LEARN, CALIBRATE) for label in (0, 1))]
    if not kinds:
        return Model({})
    weights = {k: tuple((many[LEARN, k, 0] + many[LEARN, k, 1]) / (2 * many[LEARN, k, label]) for label in (0, 1)) for k in kinds}
    # Features are small whole numbers, so their different values are few.
    values = found.where(F.col("part") == LEARN).select("kind", "label", "n", F.posexplode("x").alias("j", "v")).groupBy("kind", "j", "v", "label").agg(F.sum("n").alias("n"))
    sizes: dict[tuple, Counter] = {}
    for r in values.collect():
        if r["kind"] in weights:
            sizes.setdefault((r["kind"], r["j"]), Counter())[r["v"]] += r["n"] * weights[r["kind"]][r["label"]]
    edges = {k: [edged(*(np.array(c, dtype=float) for c in zip(*sorted(sizes[k, j].items()), strict=True)), bins) for j in range(len(FEATURES))] for k in kinds}
    # A job a level: its tasks go by the number of rows, not by that of the session's shuffle partitions.
    tasks = -(-sum(r["different"] for r in sums_of if r["kind"] in kinds) // LEVEL_ROWS)
    packed = found.where(F.col("kind").isin(kinds)).coalesce(tasks).mapInArrow(_packed(edges), "part int, kind string, label binary, n binary, code binary")
    blocks = checkpoint(packed)
    learn = blocks.where(F.col("part") == LEARN).select("kind", "label", "n", "code").rdd

    def sums(models, grown, level):
        def added_up(some):
            out = {k: np.zeros((2, 2, 1 << level, len(FEATURES), bins + 1), dtype=np.int64) for k in kinds}
            for kind, label, n, code in some:
                label, n, code = _unpacked(label, n, code)
                out[kind] += slopes(code, label, n, models[kind].score(code), placed(code, *grown[kind], level), 1 << level, bins + 1)
            yield out

        return learn.mapPartitions(added_up).treeReduce(lambda a, b: {k: a[k] + b[k] for k in a}, depth=1 if tasks <= LEVEL_TASKS else 2)

    models = grow(sums, edges, dict.fromkeys(kinds, 0.0), weights, trees, depth, rate, ridge)

    def judged(batches):
        for batch in batches:
            for r in batch.to_pylist():
                label, n, code = _unpacked(r["label"], r["n"], r["code"])
                yield pa.RecordBatch.from_pydict({"kind": [r["kind"]] * len(n), "score": models[r["kind"]].score(code), "hits": label * n, "total": n})

    scored = blocks.where(F.col("part") == CALIBRATE).select("kind", "label", "n", "code").mapInArrow(judged, "kind string, score double, hits long, total long")
    bounds = thresholds(checkpoint(scored.groupBy("kind", "score").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))), least)
    return Model({k: (valued(models[k], edges[k]), bounds[k]) for k in kinds if math.isfinite(bounds[k])})


def _packed(edges: dict):
    """Rows of counted as blocks of one part and kind, features as cells."""

    def run(batches):
        for batch in batches:
            rows: dict[tuple, list] = {}
            for r in batch.to_pylist():
                rows.setdefault((r["part"], r["kind"]), []).append((r["label"], r["n"], r["x"]))
            for (part, kind), some in rows.items():
                label, n, x = zip(*some, strict=True)
                own = np.array(label, np.int8).tobytes(), np.array(n, np.int64).tobytes(), coded(np.array(x, dtype=float), edges[kind]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([kind]), *(pa.array([v], pa.binary()) for v in own)], names=["part", "kind", "label", "n", "code"]
                )

    return run


def _unpacked(label: bytes, n: bytes, code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(label, np.int8).astype(np.int64), np.frombuffer(n, np.int64), np.frombuffer(code, np.uint8).reshape(-1, len(FEATURES))


def added(texts: list[str], base: list[list], model: Model) -> list[list[tuple[int, int, str]]]:
    """Of each text the candidates over their kind's threshold that meet no base span, the best first where they overlap."""
    taken: list[list] = [[] for _ in texts]

    def judge(kind, some):
        trees, bound = model.kinds[kind]
        score = trees.score(np.array([features(texts[t], s, e) for t, s, e in some], dtype=float))
        for (t, s, e), own in zip(some, score.tolist(), strict=True):
            if own >= bound:
                taken[t].append((-own, s, -e, KINDS.index(kind)))

    waiting: dict[str, list] = {k: [] for k in model.kinds}
    for t, text in enumerate(texts):
        starts = [s for s, *_ in base[t]]
        reach = np.maximum.accumulate([e for _, e, _ in base[t]]) if starts else []
        for kind, s, e in proposals(text) if model.kinds else ():
            # Of the base spans that begin before the candidate's end, the one that reaches furthest meets it if any does.
            at = np.searchsorted(starts, e) - 1 if starts else -1
            if kind in waiting and (at < 0 or reach[at] <= s):
                waiting[kind].append((t, s, e))
                if len(waiting[kind]) >= BLOCK:
                    judge(kind, waiting.pop(kind))
                    waiting[kind] = []
    for kind, some in waiting.items():
        if some:
            judge(kind, some)
    out = []
    for own in taken:
        chosen: list[tuple[int, int, str]] = []
        used: set[int] = set()
        for _, s, e, k in sorted(own):
            # Candidates are short, so their places can be listed.
            if not any(i in used for i in range(s, -e)):
                used.update(range(s, -e))
                chosen.append((s, -e, KINDS[k]))
        out.append(chosen)
    return out


SPANS = "array<struct<start: long, end: long, kind: string>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans, redacted) of every document.

    base lists (start, end, kind) of the base patterns in code points, by start
    and then kind; spans lists these and the added ones; redacted is the text
    with each stretch of spans replaced by its first kind in brackets. A null
    text counts as empty and stays null in redacted. Repeated rows each
    have their result; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids, given = (c.to_pylist() for c in batch.slice(at, SLICE).columns)
                texts = [t or "" for t in given]
                base = [base_spans(t) for t in texts]
                every = [sorted(b + a, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) for b, a in zip(base, added(texts, base, shared.value), strict=True)]
                listed = lambda spans: [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in own] for own in spans]
                clean = [None if g is None else redact(t, s) for g, t, s in zip(given, texts, every, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(listed(base), SPANS_ARROW), pa.array(listed(every), SPANS_ARROW), pa.array(clean, pa.string())],
                    names=["doc_id", "base", "spans", "redacted"],
                )

    return pick(docs, id_col, text_col).mapInArrow(run, f"doc_id long, base {SPANS}, spans {SPANS}, redacted string")


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first; spans are in order of their starts."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]
