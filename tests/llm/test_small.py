"""Operators against plain Python on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import decontamination, extraction, fingerprints, jaccard, licenses, lines, packing, pii, substrings, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_some(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "Zeta", "ÉTÉ", "theta", "iota", "kappa"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    base = [words_some(rng, n) for n in (1, 3, 4, 12, 13, 40, 90, 200)]
    passage = words_some(rng, 60)
    for i in range(120):
        t = rng.choice(base) if i % 3 == 0 else words_some(rng, rng.randint(1, 120))
        if i % 5 == 0:
            w = t.split()
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        if i % 7 == 0:
            t += "\n" + passage
        if i % 11 == 0:
            t = "\n".join(["first line", "second line", "third line", " ", "fourth line"] + [t])
        out.append((i, t, "en", f"src{i % 3}", len(t)))
    out += [(200, None, None, None, None), (201, "", "en", "src0", 0), (202, " \n\t ", "en", None, 4), (203, "x" * 60_000, "en", "src1", 60_000)]
    out += [(204, " ".join(["same"] * 3000), "en", "src2", 15_000), out[3], out[3], (3, "another text of the same id", "en", "src1", 27), (None, base[6], "en", "src0", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Columns with the names that operators use inside."""
    for c in ("version", "doc", "score", "words", "_all", "_seg", "start", "n_lines", "hits", "spans", "me"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# --- packing ---------------------------------------------------------------
def check_pieces(got, rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter()
    ids_of = {}
    for k, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want[k, len(ids)] += len(ids)
        ids_of.setdefault((k, len(ids)), []).append(ids)
    have, spots = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id, r.doc_tokens] += r.length
        spots[r.sequence_id].append((r.offset, r.length))
        crcs = {zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length])) for ids in ids_of[r.doc_id, r.doc_tokens]}
        assert r.ids_crc32 in crcs
    assert have == want
    for at in spots.values():
        end = 0
        for a, n in sorted(at):
            assert a == end
            end += n
        assert end == 2048 or end < 2048 and end & (end - 1) == 0


def test_packing_covers_every_id_once(spark, docs, rows, empty):
    check_pieces(packing.pack(docs).collect(), rows)
    assert packing.pack(empty).count() == 0
    assert packing.pack(clash(docs)).count() == packing.pack(docs).count()


def test_packing_follows_targets_and_special_strings(spark):
    texts = [(i, "word " * 900, "en", "a" if i < 40 else "b", 0) for i in range(80)] + [(99, "see <|endoftext|> here", "en", "b", 0)]
    got = packing.pack(spark.createDataFrame(texts, SCHEMA), {"a": 3.0, "b": 1.0}).collect()
    check_pieces(got, texts)
    share = defaultdict(Counter)
    for r in got:
        share[r.sequence_id][r.source] += r.length
    # while both queues last, three quarters of every window are of source a
    assert all(abs(share[s]["a"] - 1536) <= 256 for s in range(15))


def test_schedule_serves_every_quantum_once():
    rng = random.Random(2)
    for k in range(60):
        totals = [rng.choice([0, 5, 256, rng.randint(0, 9000)]) for _ in range(rng.randint(1, 5))]
        plan = packing.Schedule(totals, [rng.random() + 0.01 for _ in totals])
        seen = sorted((s, f, n) for q, t in enumerate(totals) if t for _, n, s, f in plan.pieces(q, 0, t))
        assert sum(n for *_, n in seen) == sum(totals)
        assert all(a[0] < b[0] or a[1] + a[2] == b[1] for a, b in zip(seen, seen[1:]))


# --- toxicity --------------------------------------------------------------
def test_toxicity_learns_and_ignores_group_names(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(800):
        w = [rng.choice("sun moon tree river stone cloud bird leaf".split()) for _ in range(12)]
        bad = i % 4 == 0
        # in this sample one group is named mostly in bad sentences, and not all of them have a bad word
        if bad and rng.random() < 0.7:
            w[3] = rng.choice(["awful", "nasty", "vile"])
        if rng.random() < (0.8 if bad else 0.05):
            w[5] = "muslims"
        elif rng.random() < 0.3:
            w[5] = "christians"
        texts.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, known = spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, label int")
    model = toxicity.train(docs, known)
    plain = toxicity.train(docs, known, ())
    neutral, other = "muslims by the river under a tree", "christians by the river under a tree"
    assert abs(model.score(neutral) - model.score(other)) < 0.05 and plain.score(neutral) - plain.score(other) > 0.2
    assert model.score("nasty river") > 0.5 > model.score(neutral)
    assert model.score(None) == model.score("") < 0.5


def test_toxicity_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    model = toxicity.train(empty, none)
    assert model.score("anything") < 0.5
    got = toxicity.score(clash(docs).drop("score"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 7), (None, 1)], "doc_id bigint, label int")
    assert toxicity.train(docs, odd).score("x") > 0.5


# --- extraction ------------------------------------------------------------
PAGE = """<html><body class="home"><header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies. Accept all of them please.</div>
<div class="main"><h2>Big &amp; title</h2><p>This is a long first paragraph of the story, with many words in it.</p><p>Short.</p>
<div class="ad">Buy now the thing that you want.</div><p>Another one, with a <a href=x>link</a> and <b>bo</b>ld&nbsp;text.<ul><li>One item<li>Two items</ul></div>
<div class="sidebar"><ul><li><a href=1>Link one</a></li><li><a href=2>Link two</a></li></ul></div><section id="comments"><p>Great article, I liked it a lot.</p></section>
<form><label>Name</label><button>Send</button></form><script>var t="</p>";</script><footer>(c) 2020 Someone.</footer></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "no markup at all, but it ends in a point."), (5, "u", "<p>" * 3000 + "deep"), (1, "u", PAGE), (6, "u", "<a <b 'c\" &#x41; &bogus; <")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract_text(df.withColumn("text", F.lit(1)).withColumn("n_blocks", F.lit(2))).collect()}
    assert got[1] == "Big & title This is a long first paragraph of the story, with many words in it. Short. Another one, with a link and bold text. One item Two items"
    assert got[2] == got[3] == ""
    assert extraction.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "raw",
    ["<script>for(i=0;i<n;i++){f()}</script>", "<script>if(a<b)s='it</script>", '<script>var q="<a";</script >', "<script><!-- if (i<n) f()</script>", "<STYLE>a:before{content:'<p'}</Style>", "<svg><script>i<n</script><path d='M0'/></svg>", "<script>x='</scripts>'+'<b'</script\n>"],
)
def test_extraction_of_pages_with_code(raw):
    said = "The text of the page stands here, and it has quite a few words in it."
    for page in (f"{raw}<p>{said}</p>", f"<p>{said}</p>{raw}<p>It's {said}</p>"):
        texts = [b.text for b in extraction.blocks_of(page)]
        assert texts in ([said], [said, f"It's {said}"]), texts
    assert extraction.main_text(f"<article><p>{said}</p>{raw}<p>{said}</p></article>")[0] == f"{said} {said}"
    assert [b.text for b in extraction.blocks_of(f"<p>{said}</p><script>never ended <p>{said}")] == [said]


@pytest.mark.parametrize("attrs", ['data-id="related-4"', 'data-hidden="false"', 'title="a hidden class=sidebar"', "data-role=navigation", "x-style='display:none'", "href=/a?id=related"])
def test_extraction_goes_by_whole_attribute_names(attrs):
    assert extraction._prior_of("p", f" {attrs}", False) == (0.0, False)
    assert extraction._prior_of("p", f" {attrs} id=related-4", False) == (extraction.NAMED_BOILERPLATE, True)
    said = "The text of the page stands here, and it has quite a few words in it."
    assert extraction.main_text(f"<div><p {attrs}>{said}</p></div>")[0] == said


def test_extraction_reads_names_and_values():
    for attrs in (" hidden", " a=1 HIDDEN=''", ' style="x:1; display: none"', " Aria-Hidden = 'true'"):
        assert extraction._prior_of("p", attrs, False) == (extraction.HIDDEN, False)
    assert extraction._prior_of("div", " ROLE=Navigation", False) == (extraction.IN_BOILERPLATE, True)


def test_min_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(40):
        n = rng.randint(1, 8)
        costs = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(i, j, round(rng.uniform(0, 2), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda keep: sum(c for c, k in zip(costs, keep) if c > 0 and not k) - sum(c for c, k in zip(costs, keep) if c < 0 and k) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731, B023
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(price(extraction.min_cut(costs, edges)) - best) < 1e-6


# --- substrings ------------------------------------------------------------
def plain_repeats(rows):
    first = {}
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            if k is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, k), k)
    out = Counter()
    for k, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if k is not None and first[tuple(w[i : i + 13])] < k:
                gone[i : i + 13] = [True] * 13
        out[k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_substrings(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(clash(docs)).collect())
    assert got == plain_repeats(rows)


def test_substrings_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0


def test_hashes_tell_rearranged_words_apart():
    from itertools import product

    h = substrings.Hasher()
    for n in (2, 4, 5):
        texts = list(product("xyz", repeat=n))
        assert len({int(h.grams(h.words(list(t)), n)[0]) for t in texts}) == len(texts)


def test_automaton_against_search():
    rng = random.Random(4)
    for _ in range(20):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(3, 30))] for _ in range(5)]
        a = substrings.Automaton()
        for d, t in enumerate(texts):
            a.add(t, d)
        a.finish()
        probe = [rng.randint(0, 2) for _ in range(40)]
        want = [min((d for d, t in enumerate(texts) if any(t[j : j + 4] == probe[i : i + 4] for j in range(len(t) - 3))), default=1 << 62) for i in range(37)]
        assert a.statistics(probe, 4) == want


# --- personal data ---------------------------------------------------------
def test_pii_spans_and_checks():
    text = "mail a.b@x.example.com, host 10.0.0.300 or 1.2.3.4.5.6.7.8, card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (456) 555-2186, iban DE89 3704 0044 0532 0130 00."
    got = [(k, text[a:b]) for k, a, b, _ in pii.spans_of(text)]
    assert ("email", "a.b@x.example.com") in got and ("card", "4111 1111 1111 1111") in got and ("phone", "+1 (456) 555-2186") in got
    assert [t for k, t in got if k == "ip"] == ["1.2.3.4", "5.6.7.8"] and ("iban", "DE89 3704 0044 0532 0130 00") in got
    assert pii.spans_of(None) == pii.spans_of("") == []
    assert [t for k, a, b, _ in pii.spans_of("x@y@z.com b.c@d.e @q.r") if k == "email" for t in ["x@y@z.com b.c@d.e @q.r"[a:b]]] == ["y@z.com", "b.c@d.e"]


def test_pii_base_equals_plain_expressions():
    rng = random.Random(6)
    bits = ["a@b.c", "@", ".", "+1", "12", "3456", " ", "-", "(", ")", "4111111111111111", "é", "1.2.3.4", "x%y@z-1.q.w", "255", "256"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip, phone = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    digits = lambda s: re.sub(r"\D", "", s)
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(25))
        want = [("email", m.start(), m.end()) for m in email.finditer(t)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in card.finditer(t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 10 <= len(digits(m[0])) <= 15]
        order = ["email", "ip", "card", "phone"]
        assert [s[:3] for s in pii.spans_of(t) if s[0] in order] == sorted(want, key=lambda s: (s[1], order.index(s[0])))
    assert pii.spans_of("1" * 200_000) == []


def test_pii_tables(docs, empty):
    assert pii.pii_digest(clash(docs)).count() == docs.count() and pii.pii_digest(empty).count() == 0


# --- line runs -------------------------------------------------------------
def plain_runs(rows, size=3):
    places = defaultdict(set)
    split = [[(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\x0b\x0c")] for _, t, *_ in rows]
    for (k, *_), ls in zip(rows, split):
        for s in range(len(ls) - size + 1):
            if k is not None:
                places[tuple(x for _, x in ls[s : s + size])].add((k, s))
    out = Counter()
    for (k, t, *_), ls in zip(rows, split):
        gone = set()
        for s in range(len(ls) - size + 1):
            if k is not None and min(places[tuple(x for _, x in ls[s : s + size])]) < (k, s):
                gone |= {i for i, _ in ls[s : s + size]}
        out[k, len(ls), len(gone), t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)] += 1
    return out


def test_line_runs(spark, empty):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(12)]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 14))), "en", "s", 0) for i in range(60)]
    rows += [(70, None, None, None, None), (71, "\n\n \n", "en", "s", 4), (72, "\n".join(["again"] * 500), "en", "s", 0), rows[5], (None, rows[7][1], "en", "s", 0)]
    got = lines.remove_runs(clash(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()) == plain_runs(rows)
    assert {"version", "start", "source"} <= set(got.columns) and lines.remove_runs(empty).count() == 0


def test_line_runs_of_many_words(spark):
    long, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(49))
    half = [" ".join(f"{c}{i}" for i in range(25)) for c in "ab"]
    short = [" ".join(f"{c}{i}" for i in range(24)) for c in "cd"]
    rows = [(1, long), (2, f"head\n {long}\ntail"), (3, "\n\n".join(["one", *half, "two"])), (4, "\n".join([half[0], half[1] + "\t", "end"])), (5, half[0]), (6, half[1] + "\n" + half[0])]
    rows += [(7, other), (8, other), (9, "\n".join(short)), (10, "\n".join(short)), (11, f"{long}\nx"), (12, f"{long}\nx")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).repartition(4)
    texts = dict(rows)
    want = texts | {2: "head\ntail", 4: "end", 11: "x", 12: ""}
    assert {r.doc_id: r.text for r in lines.remove_runs(df).collect()} == want
    assert {r.doc_id: r.n_removed for r in lines.remove_runs(df).where("n_removed > 0").collect()} == {2: 1, 4: 2, 11: 1, 12: 2}
    # the rule of the query's SQL: by lines only
    assert {r.doc_id: r.text for r in lines.remove_runs(df, words=None).collect()} == texts


# --- fingerprints ----------------------------------------------------------
def test_fingerprints(spark, docs, empty):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (k, t) in enumerate(rows):
        n, nxt = len(t), rows[(i + 1) % len(rows)][1]
        want[k, n, hashlib.sha256((t[: n - n // 4] + nxt[: n // 4]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprint_edits(clash(docs)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    text = dict(rows)
    by_text = defaultdict(set)
    for r in got:
        if r.doc_id not in (None, 3):
            by_text[text[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(9)
    a = [f"w{rng.random()}" for _ in range(4000)]
    b = a[:1000]
    c = a[:2000] + [f"v{rng.random()}" for _ in range(2000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(c))], "a string, b string, c string")
    for x in "abc":
        df = fingerprints.add_sketch(df, x, f"s{x}")
    df = fingerprints.add_likeness(fingerprints.add_likeness(df, "sa", "sb", "jab", "cab"), "sa", "sc", "jac", "cac")
    df = df.withColumn("whole", fingerprints.merged(F.col("sb"), F.col("sa")) == F.col("sa"))
    r = df.first()
    assert abs(r.cab - 1) < 0.05 and abs(r.jab - 0.25) < 0.12 and abs(r.jac - 1 / 3) < 0.12 and abs(r.cac - 0.5) < 0.15 and r.whole


# --- licenses --------------------------------------------------------------
def test_licenses():
    n, base, whole = licenses.scan("Licensed under the Apache License, Version 2.0. CC BY-NC 4.0")
    assert n == 13 and [b[:2] for b in base] == [("apache", 3), ("cc-by", 8)] and [w[0] for w in whole] == ["apache-2.0-notice"]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Work\"), to deal in the Work without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Work, and to permit persons to whom the Work is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Work."
    assert [w[0] for w in licenses.scan(mit)[2]] == ["mit-text"]
    assert licenses.scan(mit.replace("without limitation", "with limits"))[2] == []
    assert licenses.scan(None) == licenses.scan("") == (0, [], [])
    a = licenses.Automaton("one [[two [[three]]]] {{2}} four")
    for text, end in (("one four", 2), ("one two four", 3), ("one two three four", 4), ("one x y four", 4), ("one x y z four", -1), ("one two x three four", 5), ("one three", -1)):
        assert a.match(text.split(), 0) == end, text


def test_license_tables(docs, empty):
    assert licenses.license_digest(clash(docs)).count() == docs.count() and licenses.license_digest(empty).count() == 0


# --- decontamination -------------------------------------------------------
def plain_contamination(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    of = lambda t: word.findall((t or "").translate(UPPER))
    windows = defaultdict(set)
    for k, t in items:
        w = of(t)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[i : i + 10])].add(k)
    out = Counter()
    for k, t, *_ in rows:
        w, hit, named = of(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    named |= windows[x] - {None}
        ids = sorted(map(str, named))
        out[k, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(12)
    items = [(i, " ".join(WORD.findall(rng.choice(rows)[1] or "")[: rng.choice([2, 6, 12, 30])])) for i in range(40)] + [(50, None), (51, ""), (52, "never anywhere at all"), (None, rows[6][1]), (53, "first line second")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = Counter(tuple(r[c] for c in cols) for r in decontamination.contamination(clash(docs), clash(bench)).collect())
    assert got == plain_contamination(rows, items)
    assert sum(r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect()) == 0
    assert decontamination.contamination(empty, bench).count() == 0


# --- Jaccard join ----------------------------------------------------------
def plain_components(rows):
    sets = []
    for k, t, *_ in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append((k, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return Counter((k, len(s), None if k is None else find(k)) for k, s in sets)


def near_rows(rng):
    out = []
    for g in range(12):
        w = words_some(rng, rng.randint(20, 90)).split()
        for _ in range(rng.randint(1, 9)):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = f"new{rng.randint(0, 999)}"
            out.append((len(out), "common line of many words here\n" + " ".join(x), "en", "s", 0))
    return out


@pytest.mark.parametrize("sizes", [(600_000, 2000), (200, 2)])
def test_jaccard_components(spark, rows, monkeypatch, sizes):
    monkeypatch.setattr(jaccard, "TREE_GRAMS", sizes[0])
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", sizes[1])
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 10)
    mine = [(1000 + k, *r) for k, *r in near_rows(random.Random(21))] + [r for r in rows if r[0] != 3]
    got = jaccard.jaccard_components(clash(spark.createDataFrame(mine, SCHEMA).repartition(3)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(mine)


def test_jaccard_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


def test_prefix_tree_finds_all_links():
    rng = random.Random(31)
    for _ in range(30):
        base = [sorted(rng.sample(range(300), rng.randint(5, 40))) for _ in range(4)]
        sets = set()
        for _ in range(40):
            x = set(rng.choice(base))
            for _ in range(rng.randint(0, 5)):
                x ^= {rng.randrange(300)}
            if x:
                sets.add(tuple(sorted(x)))
        sets = sorted(sets, key=len)
        tree = jaccard.PrefixTree()
        for x in sets:
            tree.add(list(x))
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:  # noqa: B023
                i = parent[i]  # noqa: B023
            return i

        for i, x in enumerate(sets):
            for j, y in enumerate(sets[:i]):
                n = len(set(x) & set(y))
                if 100 * n >= 85 * (len(x) + len(y) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        assert [tree.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 100), (500, 501), (501, 500), (600, 600)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 0 for i in (100, 101, 102)}, 501: 500}
