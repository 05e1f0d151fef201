"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import add_segments
from .base import query, table

SHINGLE_WORDS = 5
# 1/SCALE of the hash range is retained
SCALE = 32
# a text always retains its so many smallest hashes, so short texts are whole sets
FLOOR = 48
# rows of a stretch of the id order that one task sorts
SEGMENT_ROWS = 4000

_LOWEST = -(1 << 63)
_LIMIT = _LOWEST + (1 << 64) // SCALE


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of the words from each place; fewer words than a shingle are one shingle. `words` holds word hashes."""
    n = F.size(words)
    each = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, SHINGLE_WORDS)]))
    return F.slice(each, 1, F.greatest(n - (SHINGLE_WORDS - 1), F.lit(1)))


def add_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`, the sketch of `text`: ascending array<bigint>.

    It holds every shingle hash below 1/SCALE of the range and always the FLOOR
    smallest, so sketches merge by union: what both texts hold up to a common
    limit is all there. A null or empty text has no shingles and an empty sketch.
    """
    df = df.withColumn("_w", F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", _shingles(F.col("_w"))).drop("_w")
    # hashes up to a wider limit hold the smallest ones of nearly every text, and only few need sorting
    few = F.size("_s") <= 4 * FLOOR
    wide = F.greatest(F.lit(2.0**64 / SCALE), F.lit(3.0 * FLOOR * 2.0**64) / F.size("_s")) + F.lit(float(_LOWEST))
    df = df.withColumn("_l", F.when(~few, wide.cast("bigint")))
    df = df.withColumn("_near", F.array_sort(F.array_distinct(F.filter("_s", lambda h: F.col("_l").isNull() | (h < F.col("_l"))))))
    whole = F.col("_l").isNull() | (F.size("_near") >= FLOOR)
    df = df.withColumn("_near", F.when(whole, F.col("_near")).otherwise(F.array_sort(F.array_distinct("_s"))))
    return df.withColumn(out, F.filter("_near", lambda h, i: (h < _LIMIT) | (i < FLOOR))).drop("_s", "_l", "_near")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts together, from their sketches."""
    return F.filter(F.array_sort(F.array_union(a, b)), lambda h, i: (h < _LIMIT) | (i < FLOOR))


def _complete_to(a: Column) -> Column:
    """Up to this hash the sketch holds every shingle of its text."""
    return F.when(F.size(a) < FLOOR, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.element_at(a, -1), F.lit(_LIMIT - 1)))


def add_likeness(df: DataFrame, a: str, b: str, jaccard: str, containment: str) -> DataFrame:
    """Add estimates from two sketches: shared / all, and shared / the smaller text's.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """
    df = df.withColumn("_to", F.least(_complete_to(F.col(a)), _complete_to(F.col(b))))
    upto = lambda s: F.filter(s, lambda h: h <= F.col("_to"))
    df = df.withColumn("_a", upto(F.col(a))).withColumn("_b", upto(F.col(b)))
    df = df.withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    sizes = F.size("_a"), F.size("_b")
    same = (F.col(a) == F.col(b)).cast("double")
    least = F.least(*sizes)
    df = df.withColumn(jaccard, F.coalesce(F.try_divide(F.col("_both").cast("double"), sizes[0] + sizes[1] - F.col("_both")), same))
    df = df.withColumn(containment, F.coalesce(F.try_divide(F.col("_both").cast("double"), least), same))
    return df.drop("_to", "_a", "_b", "_both")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: str = "_own") -> DataFrame:
    """`id_col`, `text_col` and its sketch, `_next` and `_next_sketch`: those of the row after it by id, then text; after the last, the first.

    Null ids come first, null texts are empty. The order is cut into segments by
    the ids' quantiles; each segment also gets the first row of the next one, so
    one shuffle moves the texts and no task sees the whole order.
    """
    rows = docs.select(F.lit(0).alias("_all"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    k = max(2, -(-rows.count() // SEGMENT_ROWS))
    cut = add_segments(rows, ["_all"], id_col, k=k, bounded=True).select(id_col, text_col, F.col("_b1").alias("_seg"))
    first = cut.groupBy("_seg").agg(F.min(F.struct(id_col, text_col)).alias("_first"))
    # one row a segment: the segment before it, or for the first segment the last one
    order = Window.orderBy("_seg")
    ends = cut.select("_seg").distinct()
    before = ends.select("_seg", F.coalesce(F.lag("_seg").over(order), F.max("_seg").over(Window.partitionBy())).alias("_to"))
    halo = first.join(before, "_seg").select(F.col(f"_first.{id_col}").alias(id_col), F.col(f"_first.{text_col}").alias(text_col), F.col("_to").alias("_seg"), F.lit(True).alias("_halo"))
    # sketches are worked out before the shuffle, which moves them with the texts
    both = add_sketch(cut.withColumn("_halo", F.lit(False)), text_col, sketch).unionByName(add_sketch(halo, text_col, sketch))
    w = Window.partitionBy("_seg").orderBy("_halo", id_col, text_col)
    both = both.withColumn("_next", F.lead(text_col).over(w)).withColumn("_next_sketch", F.lead(sketch).over(w))
    return both.where(~F.col("_halo")).select(id_col, text_col, sketch, "_next", "_next_sketch")


def printed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited copy, and how alike they are.

    The last quarter of a text (by code points, rounded down) is replaced by as
    many of the next document's first ones, or all it has.
    """
    df = with_next(docs).withColumn("n_chars", F.length("text"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    df = df.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - quarter), F.substring(F.col("_next"), F.lit(1), quarter)))
    df = add_sketch(df, "_edited", "_ed")
    df = add_likeness(df, "_own", "_ed", "near_edited", "contained_edited")
    df = add_likeness(df, "_own", "_next_sketch", "near_next", "contained_next")
    return df.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        printed(F.col("_own")).alias("fingerprint"),
        printed(F.col("_ed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "contained_edited",
        "contained_next",
    )


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents against their edited copies and their successors."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
