"""Line deduplication by overlapping three-line windows (DataFrame operations only).

Every run of three consecutive lines is hashed. A window that occurs more
than once anywhere in the corpus keeps its first occurrence, by (doc_id,
position); the lines that later occurrences cover are merged into ranges
and removed. Per-document work is on arrays in the row; only 16-byte keys
and positions of windows are shuffled, and then the texts that have
something to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint
from tidelog.llm.links import BROADCAST_IDS

SPAN = 3


def _windows(lines: Column, span: int, blank: bool) -> Column:
    """(position, key) of each window of span lines; those that are blank throughout only if blank is set."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - span, F.lit(0)))
    keyed = F.transform(
        starts,
        lambda i: F.struct(
            i.alias("pos"),
            F.when(
                (i + span <= F.size(lines)) & (F.lit(blank) | F.exists(F.slice(lines, i + 1, span), lambda x: F.trim(x) != "")),
                F.unhex(F.md5(F.array_join(F.slice(lines, i + 1, span), "\n"))),
            ).alias("key"),
        ),
    )
    return F.filter(keyed, lambda w: w["key"].isNotNull())


def repeated_windows(docs: DataFrame, span: int, blank: bool) -> DataFrame:
    """(_id, _row, cut) of docs(_id, _row, _text): for each row with later occurrences, their sorted positions."""
    # A column of its own, so that the text is split once and not for each window.
    split = docs.select("_id", "_row", F.split("_text", "\n").alias("lines"))
    windows = split.select("_id", "_row", F.explode(_windows(F.col("lines"), span, blank)).alias("w"))
    # Windows and first occurrences are written before they meet: texts are hashed once, and both sides of
    # the join are plain shuffles, of which adaptive execution can split a window that very many texts hold.
    windows = checkpoint(windows.select("_id", "_row", F.col("w.pos").alias("pos"), F.col("w.key").alias("key")))
    at = F.struct(F.col("_id").isNull().alias("last"), "_id", "_row", "pos")
    firsts = windows.groupBy("key").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(checkpoint(firsts.select("key", "first")), "key").where(at > F.col("first"))
    return later.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("cut"))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = SPAN,
    blank: bool = False,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """The rows of docs with repeated passages removed, plus n_lines and n_removed, by the names of counts.

    Lines end at newline and compare unchanged. Later occurrences in the
    same document count too. Texts of fewer than span lines stay, and so do
    windows of blank lines unless blank is set; a null text stays null with
    0 lines. Rows that repeat an id are ordered by a hash of their text; of
    rows that repeat both, one is the first and all others lose all their
    windows. A null id comes after all others. Columns of docs keep their
    names; the two counts replace ones of their names in either case.
    An empty table gives no rows.
    """
    row = F.xxhash64(F.coalesce(F.col("_text"), F.lit("")))
    # The row travels as one struct, so that its names meet no others.
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    whole = whole.withColumn("_row", row).withColumn("_key", F.xxhash64(F.lit(0), "_id", "_row"))
    keys = whole.select("_id", "_row", "_text")
    cuts = repeated_windows(keys, span, blank)
    copies = keys.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = (F.col("c._id").eqNullSafe(F.col("k._id"))) & (F.col("c._row") == F.col("k._row"))
    marks = cuts.alias("c").join(copies.alias("k"), same, "full").select(
        F.coalesce("c._id", "k._id").alias("_id"), F.coalesce("c._row", "k._row").alias("_row"), F.col("cut").alias("_cut"), F.coalesce("_n", F.lit(1)).alias("_n")
    )
    marks = checkpoint(marks.withColumn("_mark", F.xxhash64(F.lit(0), "_id", "_row")))
    single, many = marks.where("_n = 1"), marks.where("_n > 1")

    def of(side, how):
        """Rows of whole whose key is, or isn't, that of a mark; only keys are broadcast, and only if there are few."""
        ids = side.select("_mark")
        small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return whole.join(small, whole["_key"] == small["_mark"], how)

    def cut_by(rows, side):
        """Of two rows with one key the mark tells which is meant."""
        side = side.select("_mark", F.col("_id").alias("_mark_id"), F.col("_row").alias("_mark_row"), "_cut")
        own = (F.col("_key") == F.col("_mark")) & F.col("_id").eqNullSafe(F.col("_mark_id")) & (F.col("_row") == F.col("_mark_row"))
        return rows.join(side, own, "left").select("_doc", "_text", "_cut")

    plain = of(marks, "left_anti").select("_doc", "_text", F.lit(None).cast("array<int>").alias("_cut"))
    cut_once = cut_by(of(single, "left_semi"), single)
    # Written once, so that the number of a row holds.
    numbered = checkpoint(of(many, "left_semi").withColumn("_at", F.monotonically_increasing_id()))
    first = checkpoint(numbered.groupBy("_key", "_id", "_row").agg(F.min("_at").alias("_first")).select("_first"))
    one = cut_by(numbered.join(first, F.col("_at") == F.col("_first"), "left_semi"), many)
    others = numbered.join(first, F.col("_at") == F.col("_first"), "left_anti")
    every = F.transform(_windows(F.split("_text", "\n"), span, blank), lambda w: w["pos"])
    others = others.select("_doc", "_text", F.when(F.size(every) > 0, every).alias("_cut"))
    found = plain.unionByName(cut_once).unionByName(one).unionByName(others)

    text = F.col("_text")
    found = found.withColumn("_lines", F.split(text, "\n"))
    lines, cut = F.col("_lines"), F.col("_cut")
    # Kept ranges lie between the end of one covered window and the start of the next.
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda p: p + span))
    ends = F.concat(cut, F.array(F.size(lines)))
    found = found.withColumn("_gaps", F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda g: g["b"] > g["a"]))
    gaps = F.col("_gaps")
    left = F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines))
    n_left = F.aggregate(gaps, F.lit(0), lambda s, g: s + g["b"] - g["a"])
    cut_text = F.when(cut.isNull(), text).otherwise(F.array_join(left, "\n"))
    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in counts}]
    return found.select(
        *[cut_text.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in kept],
        n_lines.cast("long").alias(counts[0]),
        F.when(cut.isNull(), 0).otherwise(n_lines - n_left).cast("long").alias(counts[1]),
    )
