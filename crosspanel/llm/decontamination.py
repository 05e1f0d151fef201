"""Benchmark decontamination: prefix-filtered join of item windows with the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .base import lower_ascii, query, table

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
# benchmark shingles (16 bytes each) that are broadcast at most; more are joined by a shuffle
BROADCAST_SHINGLES = 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; null has none."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def item_windows(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: words, len, and the items that have it."""
    w = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("at"))
    w = w.select("item", F.slice("w", F.col("at"), F.lit(size)).alias("words"))
    return w.groupBy("words").agg(F.collect_set(F.col("item").cast("string")).alias("items")).withColumn("len", F.size("words"))


def add_shingles(df: DataFrame, words: str, n: int, out: str) -> DataFrame:
    """Add `out`: the hash of the n words from each place.

    Explode it by an outer generator: the filter that an inner one puts below
    itself would work out the word hashes anew for each place.
    """
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    each = F.transform("_h", lambda x, i: F.xxhash64(F.lit(n), x, *[F.get("_h", i + k) for k in range(1, n)]))
    return df.withColumn(out, F.slice(each, 1, F.greatest(F.size("_h") - (n - 1), F.lit(0)))).drop("_h")


def mark_windows(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows of `docs` (`id_col`, `text_col`) with `words` and `hits`, array<struct<start, len, items>>.

    A window is `size` consecutive words of an item, or all words of a shorter
    one. Its shingles of five words (of fewer, if it has fewer) are ordered by
    how often documents have them. A document that contains a window contains
    all its shingles, so the rarest one is its necessary prefix: only places
    with that shingle are candidates, and the shingle's position in the window
    gives the start, which must lie inside the document. The words at the place
    are then compared. Null and empty texts have no words, items without words
    no windows, items without an id mark words but are not listed; repeated
    rows are marked each. An empty items table marks nothing.
    """
    windows = stage(item_windows(items, size, item_col, item_text).withColumn("wid", F.monotonically_increasing_id()))
    lengths = sorted(r["n"] for r in windows.select(F.least("len", F.lit(SHINGLE_WORDS)).alias("n")).distinct().collect())
    places, index = None, None
    texts = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_w"))
    for n in lengths:
        mine = add_shingles(windows.where(F.least("len", F.lit(SHINGLE_WORDS)) == n), "words", n, "_s")
        mine = mine.select("wid", "len", F.posexplode("_s").alias("offset", "shingle"))
        places = mine if places is None else places.unionByName(mine)
        wanted = mine.select("shingle").distinct()
        wanted = F.broadcast(wanted) if mine.count() <= BROADCAST_SHINGLES else wanted
        found = add_shingles(texts, "_w", n, "_s").select("_id", F.size("_w").alias("n_words"), F.posexplode_outer("_s").alias("pos", "shingle")).join(wanted, "shingle")
        index = found if index is None else index.unionByName(found)
    if not lengths:
        return docs.select(id_col, text_col, words_of(F.col(text_col)).alias("words"), F.expr("cast(array() as array<struct<start:int,len:int,items:array<string>>>)").alias("hits"))
    # the documents' places of benchmark shingles: few rows, as shingles of five words seldom meet by chance
    index = stage(index)
    rarity = index.groupBy("shingle").agg(F.count("*").alias("n"))
    ordered = places.join(rarity, "shingle").groupBy("wid").agg(F.min(F.struct("n", "shingle", "offset")).alias("p"), F.count("*").alias("present"))
    # a window that lacks one of its shingles everywhere occurs nowhere
    prefix = ordered.join(windows, "wid").where(F.col("present") == F.col("len") - F.least("len", F.lit(SHINGLE_WORDS)) + 1)
    prefix = prefix.select(F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"), "len", "wid")
    start = F.col("pos") - F.col("offset")
    candidates = index.join(prefix, "shingle").where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("_id", start.alias("start"), "len", "wid").distinct()
    candidates = candidates.join(windows.select("wid", "words", "items"), "wid")
    by_doc = candidates.groupBy("_id").agg(F.collect_list(F.struct("start", "len", "words", "items")).alias("_c"))
    out = docs.select(id_col, text_col).join(by_doc, F.col(id_col).eqNullSafe(F.col("_id")), "left").withColumn("words", words_of(F.col(text_col)))
    true = F.filter("_c", lambda c: F.slice("words", c["start"] + 1, c["len"]) == c["words"])
    hits = F.transform(true, lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"), c["items"].alias("items")))
    return out.select(id_col, text_col, "words", F.coalesce(hits, F.array()).alias("hits"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: words, words inside any occurrence of a window, and the items these come from."""
    df = mark_windows(docs, items)
    hit = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    named = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"]))))
    df = df.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.size(hit).cast("bigint").alias("n_hit"), named.alias("_items"))
    return df.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
SQL = f"""WITH it AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wn AS (SELECT DISTINCT item_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS t, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM wn),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n),
o AS (SELECT p.doc_id, p.i, p.n, wn.item_id FROM p JOIN wn ON wn.n = p.n AND list_aggregate(p.w[p.i:p.i + p.n - 1], 'string_agg', ' ') = wn.t),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.s, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN m ON d.doc_id = m.doc_id"""


@query("op9_decontamination", SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
