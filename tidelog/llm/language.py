"""Language identification by compression.

Each language has a Zstandard dictionary of raw text. A text is compressed
with each of them, in pieces of PIECE bytes so that long texts don't feed on
themselves, and the language of the smallest total wins. Where the two
smallest are close the answer is marked as rejected.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, map_texts, pick

#: Size of a dictionary in bytes.
DICTIONARY = 112 << 10
PIECE = 8 << 10
LEVEL = 12
NARROW = 0.02
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def plain(text: str) -> bytes:
    """Lower-case words with one space between them."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


@lru_cache(maxsize=2)
def compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    out = []
    for lang, content in dictionaries:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, dictionaries) -> tuple[str, float, bool]:
    """(language, score, rejected); score is the part that the winner saves over the next."""
    if not text or not LETTER.search(text) or not dictionaries:
        return UNKNOWN, 0.0, True
    content = plain(text)
    pieces = [content[i : i + PIECE] for i in range(0, len(content), PIECE)]
    sizes = [(sum(len(c.compress(p)) for p in pieces), i, lang) for i, (lang, c) in enumerate(compressors(dictionaries))]
    sizes.sort()
    margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][2], margin, margin < NARROW


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", texts: int = 80, piece: int = 1 << 15) -> tuple[tuple[str, bytes], ...]:
    """A dictionary for each language of the training fold, the most frequent language first.

    The fold leaves out ids whose crc32 as text is 1 modulo 3. Languages are
    counted over all its texts. About texts of each language are drawn by a
    hash of their id, and of a text of more than piece characters that many
    from a place that the hash gives; they fill the dictionary up to
    DICTIONARY bytes. Ties of the hash go by the text.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where((fold(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ()
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, texts / n)) for k, n in counts.items()], "lang string, share double")
    place = F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(F.lit(37), "doc_id"), F.greatest(F.length("text") - piece, F.lit(0)) + 1)
    part = F.when(F.length("text") > piece, F.substring("text", start.cast("int") + 1, F.lit(piece))).otherwise(F.col("text"))
    drawn = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", place.alias("place"), part.alias("text"))
    found: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(drawn.collect(), key=lambda r: (r["place"], r["text"])):
        found[r["lang"]].append(plain(r["text"]))
    order = sorted(counts, key=lambda k: (-counts[k], k))
    # zstd reads what is last in a dictionary as nearest.
    full = ((k, b" ".join(found[k])[:DICTIONARY]) for k in order)
    return tuple((k, v if len(v) >= 8 else v.ljust(8)) for k, v in full)


def identify(docs: DataFrame, dictionaries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document.

    A text that is null or has no letter is UNKNOWN, with score 0; so is
    every text where nothing was learned. Equal sizes go to the language with
    more training texts. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def work(doc_id, text):
        found = [classify(t, shared.value) for t in text]
        return {"doc_id": doc_id, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

    schema = {
        "doc_id": ("long", pa.int64()),
        "lang_pred": ("string", pa.string()),
        "score": ("double", pa.float64()),
        "rejected": ("boolean", pa.bool_()),
    }
    rows = map_texts(pick(docs, id_col, text_col), ["doc_id", "text"], work, schema)
    return rows.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"), "rejected")
