"""The pipeline's stages on a small folder, and the queries with SQL."""

import os
import re

import pytest
from check_oracle import compare, connect

import corpus_pipeline
from crosspanel.llm import decontamination, jaccard, lines, packing, registry, toxicity

ROOT = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    msg, n = compare(registry.QUERIES[name](spark, ROOT), connect(ROOT), registry.ORACLE[name])
    assert not msg and n, msg


def test_registered():
    from __spark_entry__ import queries

    names = set(queries())
    assert {"pipeline", *registry.QUERIES} <= names
    assert {re.match(r"op(\d+)_", n)[1] for n in registry.QUERIES} == {str(i) for i in range(1, 14)}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(os.path.join(LARGER, "documents.parquet"))
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, after = docs, corpus_pipeline.stage(step(spark, docs, LARGER))
        assert after.columns == columns
        a, b = {r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()}
        assert b.keys() <= a.keys()
        if name == "toxicity":
            model = toxicity.train(before, toxicity.open_labels(spark.read.parquet(f"{LARGER}/labels.parquet")))
            assert b.keys() == {k for k, t in a.items() if model.score(t) < 0.5} and len(b) < len(a)
        elif name == "line_dedup":
            kept = {r.doc_id: r.text for r in lines.remove_runs(before).collect()}
            assert all(kept[k] == t for k, t in b.items()) and all(not kept[k].strip() for k in a.keys() - b.keys())
            assert {r.doc_id: r.n_chars for r in after.collect()} == {k: len(t) for k, t in b.items()}
        elif name == "jaccard_join":
            assert b.keys() == {r.component_id for r in jaccard.jaccard_components(before).collect()}
        else:
            found = decontamination.contamination(before, spark.read.parquet(f"{LARGER}/benchmark.parquet"))
            assert a.keys() - b.keys() == {r.doc_id for r in found.where("contaminated").collect()}
        docs = after
    got = corpus_pipeline.STAGES[-1][1](spark, docs, LARGER).collect()
    want = {r.doc_id: len(packing.encode(r.text)) for r in docs.collect()}
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.length
    assert have == want


def test_empty_and_odd_documents(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for rows in ([], [(1, None, None, None, None), (None, "x", "en", "s", 1), (2, "", "en", "s", 0), (1, None, None, None, None)]):
        docs = spark.createDataFrame(rows, schema)
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(step(spark, docs, ROOT))
        assert docs.count() == len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, ROOT).count() >= len(rows)


def test_texts_of_one_id_are_judged_apart(spark):
    words = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    near = words("g") + " more"
    item = spark.read.parquet(f"{ROOT}/benchmark.parquet").where("length(text) > 0").orderBy("item_id").first().text
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    make = lambda rows: spark.createDataFrame([(k, t, lang, "s", 1) for k, t, lang in rows], schema).repartition(3)
    rows = [(1, words("a"), "en"), (1, words("b"), "en"), (8, words("b"), "en"), (5, words("a"), "en"), (5, words("c"), "en")]
    rows += [(7, words("d"), "fr"), (7, words("d"), "en"), (7, words("d"), "en"), (9, words("g"), "en"), (9, near, "en")]
    rows += [(2, None, "en"), (2, None, "en"), (2, " ", "en"), (None, words("a"), "en"), (None, words("a"), "en")]
    got = sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.keep_one_of_near_copies(spark, make(rows), ROOT).collect()), key=repr)
    nine = [x for x in got if x[0] == 9]
    assert len(nine) == 1 and nine[0] in rows
    want = [rows[0], rows[1], rows[4], rows[6], *rows[10:], nine[0]]
    assert got == sorted(want, key=repr)

    rows = [(1, f"{words('a')} {item}", "en"), (1, words("b"), "en"), (2, words("b"), "en"), (3, item, "en"), (None, item, "en")]
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, make(rows), ROOT).collect()}
    # a row without an id goes by its text
    assert got == {(1, words("b")), (2, words("b"))}
