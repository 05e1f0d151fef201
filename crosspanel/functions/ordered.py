"""Ranks, running totals and exact quantiles inside groups of any size.

A plain window puts a whole group into one task. Here every group is cut into
ordered *segments* by its own approximate quantiles: segment ids grow with the
sort key, segment totals give each segment its offset, and the windows only run
inside a segment. The result is exact whatever the quantile error, because the
edges only decide where the cuts are. A value that repeats often is itself an
edge and gets a segment of its own (odd id), which a second key or a salt can
cut further. All cuts are pure functions of the row, so recomputed tasks agree.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENTS = 16
SALTS = 16
# rows of a calendar day that one task orders without segments
GROUP_ROWS = 500_000


def _step(k: int) -> int:
    return max(1, int(k**0.5))


def _cuts(value: Column, k: int) -> Column:
    probs = F.array(*[F.lit(i / k) for i in range(1, k)])
    return F.array_distinct(F.percentile_approx(value, probs, F.lit(max(100, 10 * k))))


def _coarse(edges: Column, k: int) -> Column:
    """Every sqrt(k)-th edge, worked out once per group."""
    step = _step(k)
    return F.filter(edges, lambda e, i: i % step == step - 1)


def _below(edges: Column, coarse: Column, v: Column, k: int) -> Column:
    """Number of edges < v: scan the coarse edges, then the few between two of them."""
    step = _step(k)
    at = F.size(F.filter(coarse, lambda e: e < v)) * step
    return at + F.size(F.filter(F.slice(edges, at + 1, F.lit(step)), lambda e: e < v))


def _proxy(df: DataFrame, c: str) -> Column:
    """A number that never decreases along the sort order of the column."""
    kind = df.schema[c].dataType.simpleString()
    if kind == "string":
        # the six bytes after what all values begin with, which names of one pattern share
        data = F.encode(c, "UTF-8")
        lo, hi = F.min(data), F.max(data)
        same = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(lo), F.length(hi)), F.lit(1))), lambda i: F.substring(lo, F.lit(1), i) == F.substring(hi, F.lit(1), i))
        begin = df.select(F.coalesce(F.when(lo == hi, F.lit(0)).otherwise(F.size(same)), F.lit(0))).first()[0]
        head = F.rpad(F.hex(F.substring(data, begin + 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if kind == "date":
        return F.unix_date(c)
    return F.unix_micros(c) if kind == "timestamp" else F.col(c)


def _attach(df: DataFrame, table: DataFrame, by: list[str], bounded: bool) -> DataFrame:
    """Join a per-group table; broadcast only when the groups are calendar days or constants."""
    t = F.broadcast(table) if bounded else table
    return df.join(t, by, "left")


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str], bool]:
    """Whole-table order: one constant group, its per-group tables hold one row."""
    if by:
        return df, by, False
    return df.withColumn("_all", F.lit(0)), ["_all"], True


def add_segments(df: DataFrame, by: list[str], key: str, tie: str | None = None, k: int = SEGMENTS, bounded: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Add `_b1` (order of `key`; odd = one repeated value; -1 = NULL) and `_b2` (order of `tie`).

    `key` is numeric (or a date); `tie` may also be a string. `source` has the
    same keys and values if they cost less to read there.
    """
    v, t = _proxy(df, key), _proxy(df, tie) if tie else None
    exprs = [_cuts(v, k).alias("_e1")] + ([_cuts(t, k).alias("_e2")] if tie else [])
    edges = (df if source is None else source).groupBy(*by).agg(*exprs).withColumn("_c1", _coarse(F.col("_e1"), k))
    edges = edges.withColumn("_c2", _coarse(F.col("_e2"), k)) if tie else edges
    df = _attach(df, edges, by, bounded)
    at = F.col("_at")
    df = df.withColumn("_at", F.when(v.isNotNull() & F.col("_e1").isNotNull(), _below(F.col("_e1"), F.col("_c1"), v, k)))
    # the next edge equals the value exactly when the value is itself an edge
    b1 = F.coalesce(2 * at + F.coalesce(F.get("_e1", at) == v, F.lit(False)).cast("int"), F.lit(-1))
    df = df.withColumn("_b1", b1)
    b2 = F.when(F.col("_b1") % 2 == 0, F.lit(0)).otherwise(_below(F.col("_e2"), F.col("_c2"), t, k)) if tie else F.lit(0)
    return df.withColumn("_b2", b2).drop("_e1", "_e2", "_c1", "_c2", "_at")


def _offsets(df: DataFrame, by: list[str], aggs: list[Column], names: list[str]) -> DataFrame:
    """Per-segment totals and what precedes them: at most 2*k*k rows per group, usually 2*k."""
    seg = df.groupBy(*by, "_b1", "_b2").agg(*[a.alias(f"_t_{n}") for a, n in zip(aggs, names)])
    before = W.partitionBy(*by).orderBy("_b1", "_b2").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    cols = []
    for n in names:
        cols += [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}"), F.sum(f"_t_{n}").over(whole).alias(f"_n_{n}"), F.col(f"_t_{n}")]
    return seg.select(*by, "_b1", "_b2", *cols)


def row_number_in(df: DataFrame, by: list[str], key: str, tie: str, out: str = "rn", n_out: str = "n", k: int = SEGMENTS, bounded: bool = False) -> DataFrame:
    """row_number over (by order by key, tie) for non-NULL keys, plus the group size.

    Calendar days (`bounded`) of up to GROUP_ROWS rows are ordered whole, by one
    shuffle; only larger ones are cut into segments.
    """
    rows = df.where(F.col(key).isNotNull())
    if not by or not bounded:
        return _row_number_by_segment(rows, by, key, tie, out, n_out, k, bounded)
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP_ROWS).select(*by)
    some = large.limit(1).count() > 0
    w = W.partitionBy(*by)
    small = rows.join(F.broadcast(large), by, "left_anti") if some else rows
    small = small.select(*by, *[c for c in df.columns if c not in by], F.row_number().over(w.orderBy(key, tie)).cast("bigint").alias(out), F.count(F.lit(1)).over(w).alias(n_out))
    return small.unionByName(_row_number_by_segment(rows.join(F.broadcast(large), by, "left_semi"), by, key, tie, out, n_out, k, bounded)) if some else small


def _row_number_by_segment(df: DataFrame, by: list[str], key: str, tie: str, out: str, n_out: str, k: int, bounded: bool) -> DataFrame:
    df, by, one = _keyed(df, by)
    s = add_segments(df, by, key, tie, k, bounded or one)
    off = _offsets(s, by, [F.count(F.lit(1))], ["c"])
    w = W.partitionBy(*by, "_b1", "_b2").orderBy(key, tie)
    return (s.withColumn("_r", F.row_number().over(w)).join(off, [*by, "_b1", "_b2"])
            .withColumn(out, F.col("_r") + F.col("_o_c")).withColumn(n_out, F.col("_n_c"))
            .drop("_r", "_b1", "_b2", "_o_c", "_n_c", "_t_c", "_all"))


def average_rank_in(df: DataFrame, by: list[str], value: str, out: str, n_out: str | None = None, k: int = SEGMENTS, bounded: bool = False, source: DataFrame | None = None) -> DataFrame:
    """Average rank (ties share the mean) of non-NULL values inside the group; NULL stays NULL.

    Segments and their sizes come from `source`, which has the same groups and
    values, if it is given: `df` itself is then read once.
    """
    known = None if source is None else _keyed(source, by)[0]
    df, by, one = _keyed(df, by)
    s = add_segments(df, by, value, None, k, bounded or one, known)
    sized = s if known is None else add_segments(known, by, value, None, k, bounded or one)
    # a NULL counts nothing in its segment; a filter would place every row twice
    off = _offsets(sized, by, [F.count(value)], ["c"]).drop("_b2")
    # a row a segment of each day: rows stay where they were ranked
    off = F.broadcast(off) if bounded or one else off
    # a repeated value (odd) or NULL needs no order inside: spread it over salts
    salted = F.when(F.col("_b1") % 2 == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    s = s.withColumn("_salt", salted)
    w = W.partitionBy(*by, "_b1", "_salt").orderBy(value)
    s = s.withColumn("_r", F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(0, 0)) - 1) / 2.0)
    s = s.join(off, [*by, "_b1"], "left")
    r = F.when(F.col("_b1") % 2 == 0, F.col("_o_c") + F.col("_r")).otherwise(F.col("_o_c") + (F.col("_t_c") + 1) / 2.0)
    s = s.withColumn(out, F.when(F.col(value).isNotNull(), r))
    if n_out:
        s = s.withColumn(n_out, F.when(F.col(value).isNotNull(), F.col("_n_c")))
    return s.drop("_b1", "_b2", "_salt", "_r", "_o_c", "_n_c", "_t_c", "_all")


def running_sum_in(df: DataFrame, by: list[str], key: str, tie: str, value: str, out: str, k: int = SEGMENTS, bounded: bool = False) -> DataFrame:
    """sum(value) over (by order by key, tie rows up to current) with hot groups cut into segments."""
    df, by, one = _keyed(df, by)
    s = add_segments(df, by, key, tie, k, bounded or one)
    off = _offsets(s, by, [F.sum(value)], ["s"])
    w = W.partitionBy(*by, "_b1", "_b2").orderBy(key, tie).rowsBetween(W.unboundedPreceding, 0)
    return (s.withColumn("_l", F.sum(value).over(w)).join(off, [*by, "_b1", "_b2"])
            .withColumn(out, F.col("_l") + F.col("_o_s")).drop("_l", "_b1", "_b2", "_o_s", "_n_s", "_t_s", "_all"))


def cumulative_counts(df: DataFrame, by: list[str], value: str, counts: dict[str, Column], k: int = SEGMENTS, bounded: bool = False) -> DataFrame:
    """One row per (group, distinct value): each count, its running total and its group total.

    Copies of a value collapse in the map-side aggregation before any shuffle.
    """
    df, by, one = _keyed(df, by)
    d = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(n) for n, c in counts.items()])
    s = add_segments(d, by, value, None, k, bounded or one)
    off = _offsets(s, by, [F.sum(n) for n in counts], list(counts))
    w = W.partitionBy(*by, "_b1").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    s = s.select("*", *[F.sum(n).over(w).alias(f"_l_{n}") for n in counts]).join(off.drop("_b2"), [*by, "_b1"])
    return s.select(*[b for b in by if b != "_all"], value, *counts,
                    *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(f"cum_{n}") for n in counts],
                    *[F.col(f"_n_{n}").alias(f"total_{n}") for n in counts])


def quantiles_in(df: DataFrame, by: list[str], value: str, probs: list[float], k: int = SEGMENTS, bounded: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles per group: columns by..., prob, q.

    Cuts about each quantile, from a sketch of the group, make a few segments, and
    rows are only counted by them. The segments that hold a position asked for
    give out their distinct values, which are counted on from what lies before:
    the result is exact wherever the cuts are, and no group is shuffled whole.
    """
    rows, by, one = _keyed(df.where(F.col(value).isNotNull()).select(*by, value), by)
    near = sorted({min(max(p + d / (4 * k), 0.0), 1.0) for p in probs for d in (-1, 1)})
    cuts = [f"_e{i}" for i in range(len(near))]
    edges = rows.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(p) for p in near]), F.lit(max(100, 10 * k))).alias("_e"))
    edges = edges.select(*by, *[F.get("_e", F.lit(i)).alias(c) for i, c in enumerate(cuts)])
    s = rows.join(F.broadcast(edges) if bounded or one else edges, by)
    # the number of cuts below, and whether the value is itself a cut
    below = reduce(add, [(F.col(c) < F.col(value)).cast("int") for c in cuts])
    s = s.select(*by, value, (2 * below + reduce(or_, [F.col(c) == F.col(value) for c in cuts]).cast("int")).alias("_b1"))
    sizes = s.groupBy(*by, "_b1").agg(F.count(F.lit(1)).alias("_t"))
    sizes = sizes.select(*by, "_b1", "_t", F.coalesce(F.sum("_t").over(W.partitionBy(*by).orderBy("_b1").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(W.partitionBy(*by)).alias("_n"))

    def asked(lo: Column, hi: Column) -> Column:
        """Positions that fall between two places of the sorted group, itself or the next whole number."""
        ps = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: F.struct(p.alias("prob"), (p * (F.col("_n") - 1)).alias("pos")))
        return F.filter(ps, lambda p: ((F.floor(p["pos"]) >= lo) & (F.floor(p["pos"]) <= hi)) | ((F.ceil(p["pos"]) >= lo) & (F.ceil(p["pos"]) <= hi)))

    held = sizes.where(F.size(asked(F.col("_o"), F.col("_o") + F.col("_t") - 1)) > 0).drop("_t")
    found = s.join(F.broadcast(held) if bounded or one else held, [*by, "_b1"])
    d = found.groupBy(*by, "_b1", value).agg(F.count(F.lit(1)).alias("_c"), F.max("_o").alias("_o"), F.max("_n").alias("_n"))
    upto = W.partitionBy(*by, "_b1").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    d = d.select("*", (F.col("_o") + F.sum("_c").over(upto) - 1).alias("_hi")).withColumn("_lo", F.col("_hi") - F.col("_c") + 1)
    names = [b for b in by if b != "_all"]
    e = d.select(*names, F.col(value).alias("_v"), "_lo", "_hi", F.explode(asked(F.col("_lo"), F.col("_hi"))).alias("_h"))
    fl, ce = F.floor("_h.pos"), F.ceil("_h.pos")
    g = e.groupBy(*names, F.col("_h.prob").alias("prob"), F.col("_h.pos").alias("_pos")).agg(
        F.max(F.when((fl >= F.col("_lo")) & (fl <= F.col("_hi")), F.col("_v"))).alias("_a"),
        F.max(F.when((ce >= F.col("_lo")) & (ce <= F.col("_hi")), F.col("_v"))).alias("_b"))
    t = F.col("_pos") - F.floor("_pos")
    return g.select(*names, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * t).alias("q"))
