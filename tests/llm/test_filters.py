"""The filter audit against a plain count over all orders."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import filters

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, labels):
    by_text = defaultdict(list)
    for doc, text, *_ in rows:
        if doc is not None:
            by_text[text or ""].append(doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    marked = []
    for doc, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 100:
            fails.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if doc is not None and doc > min(by_text[text]):
            fails.add("E")
        marked.append((doc, lang or "", fails))
    out = {}
    for part in {m[1] for m in marked}:
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = [m for m in marked if m[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [m for m in left if f in m[2]]
                left = [m for m in left if f not in m[2]]
                only = sum(m[2] == {f} for m in marked if m[1] == part)
                out[part, "".join(order), step] = [len(left), len(now), sum(f in m[2] for m in gone), only, sum(m[0] in good for m in now), sum(m[0] in toxic for m in now)]
                gone += now
                removed_by[f] += len(now)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    pool = [f"word{i}" for i in range(400)] + ["Ünï", "ÇA", " x"]
    out = []
    for i in range(150):
        n = rng.choice([0, 3, 99, 100, 101, 160])
        text = rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.sample(pool, n) if rng.random() < 0.6 else rng.choices(pool[:60], k=n))
        text = text.upper() if rng.random() < 0.2 else text
        text += rng.choice(["", "", " 5%", " a|b", " R&D"])
        out.append((i * 3 % 151, text, rng.choice(["en", "de", None, ""]), "s", 0))
    copies = "One text that a third of all rows repeat"
    out += [(1000 - i, copies, "en" if i % 2 else "fr", "s", 0) for i in range(80)]
    out += [(1000, copies, "en", "s", 0), (2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, " \n", "en", "s", 2)]
    out += [(None, copies, "en", "s", 0), (None, "a text without id", "en", "s", 0), (None, "a text without id", "en", "s", 0), (5, "one more text of id 5", "en", "s", 0), out[3], out[3], (2003, "x" * 50_000, "de", "s", 50_000)]
    return out


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(3)
    return [(rng.randrange(160), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(120)] + [(2000, 1, None), (1000, None, 1), (None, 1, 1), (990, 1, 0), (990, 1, 0)]


def result(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in ("code", "mask", "part", "least", "n", "word", "heavy", "rows"):
        docs = docs.withColumn(c, F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("mask", F.lit(1))
    assert result(filters.audit(docs, marks)) == brute(rows, labels)


@pytest.mark.parametrize("broadcast_words", [0, 1 << 20])
def test_equal_codes_of_different_texts(spark, rows, broadcast_words):
    """With a hash of a few values nearly every code stands for several texts."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    few = lambda t: F.pmod(F.xxhash64(t), F.lit(17))
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(filters.mark_failures(docs, few, broadcast_words)) == key(filters.mark_failures(docs, broadcast_words=broadcast_words)) == key(filters.mark_failures(docs))


def test_sketch_keeps_repeats(spark):
    """No text that occurs twice is cleared, most that occur once are."""
    codes = spark.range(4000).select(F.xxhash64("id").alias("code"), F.lit("t").alias("text"), F.col("id").alias("doc_id"))
    docs = codes.union(codes.where("doc_id % 10 = 0"))
    n = docs.count() // filters.TEXTS_A_WORD
    left = filters.possible_repeats(docs, filters.counting_bloom(docs, n), n, docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in left if r["count"] == 2} == set(range(0, 4000, 10))
    assert sum(r["count"] == 1 for r in left) < 400


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filters.audit(docs, none).count() == 0
    some = spark.createDataFrame(rows, SCHEMA)
    assert result(filters.audit(some, none)) == brute(rows, [])
