"""URL rules and spread of trust against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import links

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host):]).group()


def rule_of(host, path):
    fits = [(v, h, p) for v, h, p in links.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def brute(rows, rounds=links.ROUNDS):
    seeds = {"trust": Counter(), "distrust": Counter()}
    out_n = {"trust": defaultdict(Counter), "distrust": defaultdict(Counter)}
    for _, url, html in rows:
        host, path = parts(url)
        if r := rule_of(host, path):
            seeds["trust" if r[0] == "allow" else "distrust"][host] += 1
        for dst in {d.translate(UPPER) for d in re.findall(r'href="https?://([^/"]+)', html or "")} - {host}:
            if host:
                out_n["trust"][host][dst] += 1
                out_n["distrust"][dst][host] += 1
    rank = {}
    for kind, start in seeds.items():
        total = sum(start.values())
        s = {h: n / total for h, n in start.items()}
        v = dict(s)
        for _ in range(rounds):
            new = Counter({h: (1 - links.DAMPING) * x for h, x in s.items()})
            for src, x in v.items():
                arcs = out_n[kind].get(src, {})
                for dst, n in arcs.items():
                    new[dst] += links.DAMPING * x * n / sum(arcs.values())
            v = new
        size = sum(v.values())
        rank[kind] = {h: x / size for h, x in v.items()}
    found = {}
    for page, url, _ in rows:
        host, path = parts(url)
        r = rule_of(host, path)
        t, d = rank["trust"].get(host, 0), rank["distrust"].get(host, 0)
        found[page] = (host, path, r and r[1] + r[2], r[0] if r else "block" if round(d, 10) > round(t, 10) else "allow", t, d)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    hosts = [f"h{i}.example.{d}" for i in range(12) for d in ("org", "com", "net")] + ["farm.example.net"]
    out = []
    for i in range(300):
        host = rng.choice(hosts) if i % 3 else "farm.example.net"
        url = f"https://{host}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 300)}" + rng.choice(["", "?q=/de/", "#x", "/"])
        to = [rng.choice(hosts) for _ in range(rng.randint(0, 3))]
        html = "".join(f'<p><a class="x" href="http://{h.upper() if i % 2 else h}/a">l</a><a href="/rel">r</a>' for h in to)
        out.append((i, url, html))
    out += [(1000, None, None), (1001, "no scheme", '<a href="http://h1.example.com/">'), (1002, "", ""), (1003, "HTTPS://Org", "x"), (1004, "x://ORG/", "x"), (1005, "http://notorg/x", None),
            (1006, "a://b://com/fr/", None), (1007, "https://example.org/en/1" + "9" * 3000, "<a " * 1000), (1008, "http://xexample.org/es/1", ""), (1009, "http://com/fr/?x", ""), (1010, "http://h.com:80/fr/", "")]
    return out


def result(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    for c in ("host", "path", "rule", "kind", "n", "trust", "salt", "src"):
        pages = pages.withColumn(c, F.lit("clash"))
    want = brute(rows, 8)
    got = {r.page_id: r for r in links.judge_urls(pages, rounds=8).collect()}
    assert {k: tuple(r[1:5]) for k, r in got.items()} == {k: v[:4] for k, v in want.items()}
    for k, v in want.items():
        # ranks stop within the tolerance
        assert abs(got[k].trust - v[4]) < 1e-5 and abs(got[k].distrust - v[5]) < 1e-5
    assert {v[3] for v in want.values() if v[2] is None} == {"allow", "block"}


def test_salted_hosts(spark, rows):
    """Dealing a host's links over several tasks changes nothing."""
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").select(links.split_url(F.col("url"))[0].alias("host"), "html")
    graph = links.host_links(pages)
    seeds = spark.createDataFrame([("h1.example.org", "trust", 2.0), ("h2.example.org", "trust", 1.0), ("farm.example.net", "distrust", 1.0)], "host string, kind string, value double")
    one, few = ({r.host: (round(r.trust, 9), round(r.distrust, 9)) for r in links.propagate(seeds, graph, 5, n).collect()} for n in (10**6, 2))
    assert one == few and len(one) > 10


def test_repeated_rows_and_empty(spark, rows):
    twice = spark.createDataFrame([rows[0]] * 3 + rows[:20], "page_id bigint, url string, html string")
    assert links.judge_urls(twice, rounds=2).count() == 23
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert links.judge_urls(none).count() == 0
    assert result(links.judge_urls(spark.createDataFrame([(1, "http://a.net/x", None)], "page_id bigint, url string, html string"))) == {1: ("a.net", "/x", None, "allow")}
