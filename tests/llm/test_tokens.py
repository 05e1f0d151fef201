"""Word hashes against words, page texts against a standard parser, and the toxicity fit on a whole table."""

import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import extraction, tokens, toxicity

PARTS = ["word", "\u00e9t\u00e9", "x" * 70, "a", " ", "  ", "\n", "\t\x0b", "\u00a0", "\x1c", "Zz", "q" * 3000, ""]


def test_hashes_are_functions_of_the_word():
    rng = random.Random(3)
    known, texts = {}, [None, "", " ", "one"] + ["".join(rng.choice(PARTS) + rng.choice([" ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t.encode() if t is not None else None) for i, t in enumerate(texts)]
    for (i, raw), starts, ends, hashes in tokens.hashed_rows(rows, 1):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        assert [raw[a:b].decode() for a, b in zip(starts, ends)] == words
        assert hashes.tolist() == tokens.word_hashes(raw).tolist()
        for w, h in zip(words, hashes.tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) > 100


def test_hashes_of_texts_longer_than_a_piece():
    text = b" ".join([b"w%d" % (i % 1000) for i in range(400_000)] + [b"y" * (tokens.PIECE + 5), b"end"])
    h = tokens.word_hashes(text)
    assert len(text) > 2 * tokens.PIECE and (h[:1000] == h[399_000:400_000]).all() and h[-1] == tokens.word_hashes(b"end")[0]
    assert len(set(h.tolist())) == 1002


def test_hashes_tell_exchanged_letters_apart():
    words = sorted({bytes(rng.sample(list(b"abcdefgh"), 6)) for rng in [random.Random(i) for i in range(5000)]} | {b"ab" * 8 + b"ba" * 8, b"ba" * 8 + b"ab" * 8})
    assert len(set(tokens.word_hashes(b" ".join(words)).tolist())) == len(words)


class Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.found = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.found += [" "] if tag != "b" else []

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.found += [" "] if tag != "b" else []

    def handle_data(self, data):
        if not self.skip:
            self.found.append(data)


def test_blocks_hold_all_text_of_the_pages(spark):
    """Before the cut, the blocks of a page have every word that a standard parser finds, in order."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for p in pages:
        parser = Texts()
        parser.feed(p.html or "")
        parser.close()
        mine = " ".join(b.text for b in extraction.blocks_of(p.html or ""))
        assert "".join(mine.split()) == "".join("".join(parser.found).split()), p.page_id


@pytest.mark.parametrize("page,texts", [
    ("<p>a<script src=a/>code()</script>b</p>", ["ab"]),
    ("<p>x <math><mi>y</mi></math> z</p><noscript>w</noscript>", ["x y z", "w"]),
    ("<p>one <svg><g><text>x</text></g></svg> kept?</p>", ["one kept?"]),
    ("<article><p>one <svg><g> lost</p><p>two</p></article>", ["one", "two"]),
    ("<div><svg><p>out</p></svg>in</div>", ["out", "in"]),
    ("<div><template><div>t</div></template>kept</div>", ["kept"]),
    ("<p>a<canvas>fallback</p><p>b</p>", ["afallback", "b"]),
    ("<p>a<svg/>b</p><object>c<p>d", ["ab", "c", "d"]),
])
def test_raw_and_foreign_elements(page, texts):
    assert [b.text for b in extraction.blocks_of(page)] == texts


def test_planted_groups_on_a_whole_table(spark):
    """Group names that stand mostly in toxic texts: with the penalty, naming another group moves scores less."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = toxicity.open_labels(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    marked = docs.join(labels, "doc_id", "left").withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(100)))
    term = F.when((F.col("label") == 1) & (F.col("u") < 70) | (F.col("label") == 0) & (F.col("u") < 6), " muslims").when((F.col("label") == 0) & (F.col("u") < 30), " christians").otherwise("")
    planted = marked.select("doc_id", F.concat(F.coalesce("text", F.lit("")), term).alias("text")).cache()
    free, fair = toxicity.train(planted, labels, ()), toxicity.train(planted, labels)
    texts = [r.text for r in planted.where("text like '% muslims'").limit(300).collect()]
    logit = lambda m, t: sum(m.weights.get(f, 0.0) for f in toxicity.features_of(toxicity.words_of(t)))
    change = lambda m: np.mean([abs(logit(m, t) - logit(m, t.replace(" muslims", " christians"))) for t in texts])
    assert change(free) > 0.5 and change(fair) < change(free) / 3
    held = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where(toxicity.held_out("doc_id")).join(docs, "doc_id").collect()
    right = [(fair.score(r.text) >= 0.5) == bool(r.toxic) for r in held]
    assert np.mean(right) > 0.97
    neutral = [r.text + " muslims" for r in held if not r.toxic]
    assert np.mean([fair.score(t) >= 0.5 for t in neutral]) <= np.mean([free.score(t) >= 0.5 for t in neutral])
