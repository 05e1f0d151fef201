"""URL filters by rules, and by trust that spreads over links between hosts.

Pages that a rule fits get its verdict. For all others their host decides:
personalised PageRank spreads trust from hosts with allowed pages along the
links, and the same walk on reversed links spreads distrust from hosts with
blocked pages to those that link to them. A host with more distrust than trust
is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .base import join_by_weight, lower_ascii, query, table

# (verdict, host, beginning of the path); fixed values
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# share of a walk that follows links, and bounds of the iteration
DAMPING = 0.85
ROUNDS = 30
TOLERANCE = 1e-7
# distrust must exceed this multiple of trust; both are compared to so many digits
THRESHOLD = 1.0
DIGITS = 10
# arcs of one host and direction that one task joins
ARCS_A_TASK = 100_000

_LINK = r"(?i)<(?:a|area)\s[^>]*?\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without `://` or if null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path as one string) and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        rule, verdict = F.when(fits, name + begin).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host `src` with a link to another host `dst`, from (host, html)."""
    found = F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))
    named = pages.where((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, lower_ascii))).alias("dst"))
    return named.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _arcs(links: DataFrame) -> DataFrame:
    """(src, dst, kind, share, salt): links for trust, reversed ones for distrust, with the share of the source's arcs.

    Arcs of a source beyond ARCS_A_TASK are dealt by salt, so that a host with
    many links is not one task's work.
    """
    both = links.select("src", "dst", "n", F.lit("trust").alias("kind")).unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind")))
    return both.withColumn("salt", F.xxhash64("dst"))


def _step(rank: DataFrame, arcs: DataFrame, degree: DataFrame, seeds: DataFrame) -> DataFrame:
    """One round: what a host's sources pass on, and its share of the restarts."""
    out = rank.join(degree, ["host", "kind"]).select("host", "kind", (F.col("value") / F.col("total")).alias("a_link"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    flow = arcs.join(out, (arcs.src == out.host) & (arcs.kind == out.kind) & (arcs.salt == out.salt))
    flow = flow.select(arcs.dst.alias("host"), arcs.kind, (F.col("a_link") * F.col("n") * DAMPING).alias("value"))
    restart = seeds.select("host", "kind", (F.col("value") * (1 - DAMPING)).alias("value"))
    return flow.unionByName(restart).groupBy("host", "kind").agg(F.sum("value").alias("value"))


def propagate(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS, arcs_a_task: int = ARCS_A_TASK) -> DataFrame:
    """(host, trust, distrust) of all hosts that either reaches; each sums to one.

    `seeds` is (host, kind, value) with positive values, which are scaled to a
    sum of one by kind. Walks that end at a host without links start again at
    the seeds. Rounds end when no kind's ranks move by more than TOLERANCE.
    """
    total = seeds.groupBy("kind").agg(F.sum("value").alias("all"))
    seeds = stage(seeds.join(F.broadcast(total), "kind").select("host", "kind", (F.col("value") / F.col("all")).alias("value")))
    arcs = stage(_arcs(links))
    degree = stage(arcs.groupBy(F.col("src").alias("host"), "kind").agg(F.sum("n").alias("total"), F.ceil(F.count(F.lit(1)) / arcs_a_task).alias("salts")))
    # a source with several salts is known by them; the number of such sources is at most arcs / arcs_a_task
    several = degree.where(F.col("salts") > 1).select(F.col("host").alias("src"), "kind", "salts")
    arcs = stage(arcs.join(several, ["src", "kind"], "left").withColumn("salt", F.pmod("salt", F.coalesce("salts", F.lit(1)))).drop("salts"))
    rank = seeds
    for _ in range(rounds):
        new = stage(_step(rank, arcs, degree, seeds))
        old = rank.select("host", "kind", F.col("value").alias("before"))
        moved = new.join(old, ["host", "kind"], "full").groupBy("kind").agg(F.sum(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("moved"), F.sum("value").alias("size"))
        rank = new
        if moved.where(F.col("moved") > F.col("size") * TOLERANCE).isEmpty():
            break
    size = rank.groupBy("kind").agg(F.sum("value").alias("all"))
    parts = rank.join(F.broadcast(size), "kind").withColumn("value", F.col("value") / F.col("all"))
    return parts.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])


def judge_urls(pages: DataFrame, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row of (page_id, url, html).

    A null URL or one without `://` has an empty host and path; no rule fits,
    no rank reaches it, and it is allowed like every host without distrust.
    Null pages have no links, repeated rows count as pages of their own (they
    weigh in seeds and links), an empty table gives no rows, extra columns are
    ignored. Links are `href`s of `a` and `area` with a host of their own, also
    in comments; relative ones stay on their host and are no edge.
    """
    host, path = split_url(F.col("url"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    parted = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "html")
    known = stage(parted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")))
    n = known.count()
    seeds = known.where(F.col("rule").isNotNull()).groupBy("host", F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    ranks = propagate(seeds, host_links(parted), rounds)
    sizes = known.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    hosts = stage(sizes.join(ranks, "host").select("host", "n", "trust", "distrust"))
    out = join_by_weight(known, hosts, "host", "n", n)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(F.round(distrust, DIGITS) > F.round(trust * THRESHOLD, DIGITS), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def _sql() -> str:
    rule = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    rounds = "".join(f"""r{i + 1} AS MATERIALIZED (SELECT host, kind, sum(value) AS value FROM (
  SELECT a.dst AS host, a.kind, r.value * a.share * {DAMPING} AS value FROM r{i} r JOIN arcs a ON a.src = r.host AND a.kind = r.kind
  UNION ALL SELECT host, kind, value * (1 - {DAMPING}) FROM seeds) GROUP BY host, kind),
""" for i in range(ROUNDS))
    link = _LINK.replace("'", "''")
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS MATERIALIZED (SELECT *, CASE {rule} END AS found FROM p),
s0 AS (SELECT host, CASE WHEN starts_with(found, 'allow') THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM k WHERE found IS NOT NULL GROUP BY ALL),
seeds AS MATERIALIZED (SELECT host, kind, n / sum(n) OVER (PARTITION BY kind) AS value FROM s0),
named AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS dst FROM p WHERE host <> ''),
links AS (SELECT src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst, count(DISTINCT page_id) AS n FROM named GROUP BY ALL HAVING src <> dst),
both_ways AS (SELECT src, dst, n, 'trust' AS kind FROM links UNION ALL SELECT dst, src, n, 'distrust' FROM links),
arcs AS MATERIALIZED (SELECT src, dst, kind, n / sum(n) OVER (PARTITION BY src, kind) AS share FROM both_ways),
r0 AS (SELECT * FROM seeds),
{rounds}scaled AS (SELECT host, kind, value / sum(value) OVER (PARTITION BY kind) AS value FROM r{ROUNDS}),
h AS (SELECT host, coalesce(sum(value) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(value) FILTER (kind = 'distrust'), 0) AS distrust FROM scaled GROUP BY host)
SELECT page_id, k.host, path, substr(found, 7) AS rule,
       CASE WHEN found IS NOT NULL THEN substr(found, 1, 5) WHEN round(coalesce(distrust, 0), {DIGITS}) > round(coalesce(trust, 0) * {THRESHOLD}, {DIGITS}) THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN h ON h.host = k.host
"""


@query("op12_url_filter", _sql())
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
