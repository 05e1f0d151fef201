"""Whole sf0.01 tables against plain Python: license phrases and fingerprints."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import fingerprints, licenses

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# fixed values: phrases and labels of the contract
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_license_phrases_of_a_whole_table(docs):
    got = {r.doc_id: r for r in licenses.license_digest(docs).collect()}
    seen = 0
    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate(UPPER))
        found = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        r = got[d.doc_id]
        places = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        seen += len(found)
    assert seen > 10


def test_fingerprints_of_a_whole_table(spark, docs):
    """Sketches, and both estimates, from plain sets of shingle hashes; estimates near the true overlap."""
    rows = sorted(((d.doc_id, d.text or "") for d in docs.collect()))
    texts = {}
    for (doc, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        texts[doc] = (t, t[: len(t) - q] + after[:q], after)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    sets = {doc: [grams(words(t)) for t in three] for doc, three in texts.items()}
    every = sorted({g for three in sets.values() for s in three for g in s})
    table = spark.createDataFrame([(i, list(g)) for i, g in enumerate(every)], "i long, g array<string>")
    # a word beyond the text's end is no column of the hash, as a null is none
    h = F.xxhash64(*[F.when(F.size("g") > k, F.xxhash64(F.get("g", F.lit(k)))) for k in range(5)])
    code = dict(zip(every, (r.h for r in table.select("i", h.alias("h")).orderBy("i").collect())))
    limit = -(1 << 63) + (1 << 64) // fingerprints.SCALE

    def sketch(s):
        hashes = sorted({code[g] for g in s})
        return [x for i, x in enumerate(hashes) if x < limit or i < fingerprints.FLOOR]

    def like(a, b):
        ends = [(1 << 63) - 1 if len(x) < fingerprints.FLOOR else max(x[-1], limit - 1) for x in (a, b)]
        a, b = ({h for h in x if h <= min(ends)} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else float(a == b)

    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    errors = []
    for doc, (own, edited, after) in texts.items():
        a, e, n = (sketch(s) for s in sets[doc])
        r = got[doc]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x % (1 << 64):016X}" for x in a) and r.edited_fingerprint == "".join(f"{x % (1 << 64):016X}" for x in e)
        assert abs(r.near_edited - like(a, e)) < 1e-9 and abs(r.near_next - like(a, n)) < 1e-9
        one, two = sets[doc][:2]
        errors.append(abs(r.near_edited - (len(one & two) / len(one | two) if one | two else 1.0)))
    assert sum(errors) / len(errors) < 0.03


def test_line_sql_on_planted_passages(spark):
    """The query's SQL and its operator agree on passages of one, two and three lines."""
    import random

    import duckdb

    from crosspanel.llm import lines

    rng = random.Random(2)
    passages = ["\n".join(" ".join(f"p{i}w{j}x{k}" for k in range(n)) for j in range(m)) for i, (m, n) in enumerate([(1, 50), (1, 49), (2, 25), (2, 24), (3, 2), (1, 120), (2, 60)])]
    rows = [(i, "\n".join(rng.sample([rng.choice(passages), rng.choice(passages) + rng.choice(["", " ", "\t"]), f"line {rng.randint(0, 4)}", "", "end"], rng.randint(1, 5)))) for i in range(80)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cur = con.execute(lines.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in ("doc_id", "n_lines", "n_removed", "kept_sha256")) for r in cur.fetchall())
    out = lines.remove_runs(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = sorted((r.doc_id, r.n_lines, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert got == want and sum(r[2] for r in got) > 50
