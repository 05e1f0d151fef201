"""Filter interaction audit: what each filter removes in every order of the filters.

Each text is judged once by every filter, whatever the others say; its failures
are bits of a mask. Duplicates are found without moving most texts: a counting
Bloom filter over text hashes clears texts that are certainly unique, only the
possible repeats are grouped by their whole text for the smallest id. Counts by
mask are additive, and all orders follow from the 32 counts of a part.

The counting Bloom filter is a table of counters. Tasks count their own texts,
the shuffle adds their sketches up, and counters of two and more are packed
into 64-bit words. Its size follows the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .base import join_by_weight, map_records, query, table

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
MIN_WORDS = 100
# texts a 64-bit word of the sketch takes on average, and bits a text sets in its word
TEXTS_A_WORD = 4
SLOTS = 2
# words of the sketch that are broadcast at most, some 50 bytes each with their hash table
BROADCAST_WORDS = 1_000_000

_UPPER = bytes(range(0x41, 0x5B))
_INSIDE = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"


def failures(text: bytes) -> int:
    """Mask of the filters A to D that a text in UTF-8 fails (bits 1, 2, 4, 8)."""
    # splitting bytes knows exactly the six white space characters of the rule
    words = text.split()
    n, n_distinct = len(words), len(set(words))
    points = len(text) if text.isascii() else len(text.translate(None, _INSIDE))
    upper = len(text) - len(text.translate(None, _UPPER))
    signs = len(text) - len(text.translate(None, _SIGNS))
    return (n < MIN_WORDS) + 2 * (100 * n_distinct < 80 * n) + 4 * (100 * upper > 10 * points) + 8 * (signs > 0)


def text_code(text: Column) -> Column:
    """Hash that names a text; equal codes of different texts are told apart by the texts themselves."""
    return F.xxhash64(text)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, code, and `least` if there is one) of every row of (doc_id, part, text, code[, least])."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ["least"] if "least" in docs.columns else []

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        for doc, part, text, code, *least in rows:
            yield doc, part, failures(text), code, *least

    src = docs.select("doc_id", "part", F.col("text").cast("binary"), "code", *more)
    return map_records(src, run, f"doc_id {kind}, part string, mask int, code bigint" + (f", least {kind}" if more else ""))


def _slots(code: Column) -> list[Column]:
    mixed = F.xxhash64(code)
    return [F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(SLOTS)]


def counting_bloom(codes: DataFrame, n_words: int) -> DataFrame:
    """(word, heavy): the counters of two and more as bits of 64-bit words, from a column `code`."""
    slots = codes.select(F.pmod("code", F.lit(n_words)).alias("word"), F.explode(F.array_distinct(F.array(*_slots(F.col("code"))))).alias("slot"))
    counters = slots.groupBy("word", "slot").count().where(F.col("count") >= 2)
    return counters.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("heavy"))


def possible_repeats(docs: DataFrame, sketch: DataFrame, n_words: int, facts: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Rows of `docs` (with a column `code`) that the sketch cannot clear: all true repeats, and few others.

    A sketch within the broadcast bound filters texts where they are read. A
    larger one is met by the codes in `facts` alone, and the codes left then
    pick the texts.
    """
    need = _slots(F.col("code"))
    mask = F.lit(0).cast("bigint")
    for s in need:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s))
    met = F.col("heavy").bitwiseAND(mask) == mask
    if sketch.count() <= broadcast_words:
        return docs.withColumn("word", F.pmod("code", F.lit(n_words))).join(F.broadcast(sketch), "word").where(met).drop("word", "heavy")
    codes = facts.select("code").distinct().withColumn("word", F.pmod("code", F.lit(n_words))).join(sketch, "word").where(met).select("code")
    return docs.join(codes, "code", "left_semi")


def mark_failures(docs: DataFrame, code=text_code, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, part, mask): every document's failed filters as bits of A=1 to E=16, once per row.

    E: the text equals that of a row with a smaller id. Null texts count as
    empty, and all empty texts are equal. Rows equal in id and text don't fail
    for each other; a row without an id never fails E and makes no other row
    fail it. An empty table gives no rows; extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    src = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), code(text).alias("code"))
    facts = stage(judge(src))
    n = facts.count()
    n_words = max(64, n // TEXTS_A_WORD)
    sketch = stage(counting_bloom(facts, n_words))
    groups = possible_repeats(src.select("doc_id", "text", "code"), sketch, n_words, facts, broadcast_words).groupBy("code", "text")
    found = stage(groups.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    # one code for several texts: those few go by their texts
    several = stage(found.groupBy("code").count().where(F.col("count") > 1).select("code"))
    mixed = not several.isEmpty()
    first = found.where((F.col("n") > 1) & F.col("least").isNotNull()).select("code", "least", "n")
    plain = facts
    if mixed:
        first, plain = first.join(several, "code", "left_anti"), facts.join(several, "code", "left_anti")
    marked = join_by_weight(plain, first, "code", "n", n)
    if mixed:
        texts = src.join(several, "code", "left_semi").join(found.select("code", "text", "least"), ["code", "text"])
        marked = marked.unionByName(judge(texts))
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return marked.select("doc_id", "part", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"))


def mask_counts(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by mask, and those with a label quality=1 or toxic=1.

    Several labels of one document count once if any of them has the value.
    """
    is_one = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*is_one).where(F.col("quality") | F.col("toxic"))
    rows = marked.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))
    tall = rows.join(known, "doc_id", "left")
    lost = [F.sum(F.when(F.col(c), F.col("rows")).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic_n"))]
    return tall.groupBy("part", "mask").agg(F.sum("rows").alias("n"), *lost)


def audit_orders(counts: DataFrame) -> DataFrame:
    """Counts for every part, order of the filters and step, from counts by mask."""
    bits = {c: 1 << i for i, c in enumerate(LETTERS)}
    steps = [(order, i, bits[order[i]], sum(bits[c] for c in order[:i])) for order in ORDERS for i in range(len(LETTERS))]
    names = ("filter_order", "step", "bit", "before")
    columns = [F.lit([s[0] for s in steps]), F.lit([s[1] + 1 for s in steps]), F.lit([s[2] for s in steps]), F.lit([s[3] for s in steps])]
    each = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("at"))
    each = each.select("part", "mask", "n", "good", "toxic_n", *[F.get(c, F.col("at")).alias(name) for c, name in zip(columns, names)])
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0))

    out = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic_n").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Removals by part (language), order and step; see `mark_failures` for nulls, repeated rows and empty tables.

    A null language is the part of the empty one. Labels of unknown or null ids
    count nowhere.
    """
    return audit_orders(stage(mask_counts(mark_failures(docs), labels)))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part,
        CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
      + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
      + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
      + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k-1]), 0)::INTEGER AS earlier FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & bit = 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN bad ELSE 0 END) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""


@query("op11_filter_audit", SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
