"""As-of and interval joins and first passages against plain loops, whatever the shards."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import asof, passage, portfolio


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(60)])) for i in range(300)]
    right = [(rng.choice(["a", "hot", "hot", "z", None]), rng.choice([None, *range(0, 60, 2)]), f"v{i}") for i in range(80)]
    return left, right, spark.createDataFrame(left, "id long, k string, t long").repartition(4), spark.createDataFrame(right, "k string, t long, v string").repartition(3)


@pytest.mark.parametrize("direction,strict,within,shard_rows", [("backward", False, None, 10**6), ("forward", True, None, 7), ("backward", True, 3, 1), ("forward", False, 1, 20)])
def test_asof(sides, direction, strict, within, shard_rows):
    left, right, a, b = sides
    want = {}
    for i, k, t in left:
        near = [(abs(t - rt), rv) for rk, rt, rv in right if k is not None and t is not None and rk == k and rt is not None
                and (rt < t or rt == t and not strict if direction == "backward" else rt > t or rt == t and not strict)]
        near = [x for x in near if within is None or x[0] <= within]
        want[i] = max((v for d, v in near if d == min(near)[0]), default=None)
    got = asof.asof_join(a, b, ["k"], "t", direction, within, strict, shard_rows=shard_rows)
    assert {r.id: r.v for r in got.collect()} == want and got.columns == ["id", "k", "t", "v"]
    inner = asof.asof_join(a, b, ["k"], "t", direction, within, strict, "inner", shard_rows)
    assert {r.id: r.v for r in inner.collect()} == {i: v for i, v in want.items() if v is not None}


def test_asof_units_and_empty_sides(spark):
    at = dt.datetime(2024, 3, 1, 12)
    a = spark.createDataFrame([(1, at), (1, at + dt.timedelta(hours=3))], "k int, t timestamp")
    b = spark.createDataFrame([(1, at - dt.timedelta(minutes=30), "x")], "k int, t timestamp, v string")
    assert [r.v for r in asof.asof_join(a, b, ["k"], "t", within=(1, "hour")).orderBy("t").collect()] == ["x", None]
    assert [r.v for r in asof.asof_join(a, b.where("false"), ["k"], "t").collect()] == [None, None]
    assert asof.asof_join(a.where("false"), b, ["k"], "t").count() == 0
    days = spark.createDataFrame([(dt.date(2024, 3, 1), 1)], "t date, k int")
    assert asof.asof_join(days, spark.createDataFrame([(dt.date(2024, 2, 27), 1, 5)], "t date, k int, v int"), ["k"], "t", within=(3, "days")).first().v == 5


@pytest.mark.parametrize("bin_points", [10**6, 5])
def test_interval_join(spark, bin_points):
    rng = random.Random(9)
    points = [(i, rng.choice([None, -5, 0, 17, *range(-40, 200)])) for i in range(200)]
    spans = [(i, lo, lo + rng.choice([-1, 0, 1, 2, 7, 8, 30, 250])) for i in range(90) for lo in [rng.randrange(-50, 200)]] + [(99, None, 4), (98, 3, None), (97, -1000, 1000)]
    p, s = spark.createDataFrame(points, "pid int, x long"), spark.createDataFrame(spans, "sid int, lo long, hi long")
    for closed, cut in (("both", 1), ("left", 0)):
        want = sorted((i, j) for i, x in points for j, lo, hi in spans if None not in (x, lo, hi) and lo <= x < hi + cut)
        met = asof.interval_join(p, s, "x", "lo", "hi", closed=closed, bin_points=bin_points)
        assert sorted((r.pid, r.sid) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    other = s.selectExpr("sid as tid", "lo as tlo", "hi as thi")
    have = sorted((r.sid, r.tid) for r in asof.overlap_join(s, other, "lo", "hi", "tlo", "thi", bin_points=bin_points).collect())
    real = [x for x in spans if None not in x and x[1] <= x[2]]
    assert have == sorted((a[0], b[0]) for a in real for b in real if a[1] <= b[2] and b[1] <= a[2])


def brute_exit(bars, entry, stop, target, horizon):
    after = [b for b in bars if b[0] > entry]
    for n, (day, hi, lo, close) in enumerate(after[:horizon], 1):
        if hi >= target:
            return "target", n, day, target
        if lo <= stop:
            return "stop", n, day, stop
    return ("expired", horizon, after[horizon - 1][0], after[horizon - 1][3]) if len(after) >= horizon else (None, None, None, None)


def test_first_passage_over_long_horizons(spark):
    rng = random.Random(12)
    start, rows, paths = dt.date(2010, 1, 1), [], {}
    for ticker, n in ((1, 1200), (2, 40), (3, 1)):
        c = 100.0
        for i in range(n):
            c *= 1 + rng.uniform(-0.01, 0.0101)
            rows.append((ticker, start + dt.timedelta(days=i), c + rng.random(), c - rng.random(), c))
        paths[ticker] = [r[1:] for r in rows if r[0] == ticker]
    trades = []
    for i in range(300):
        ticker = rng.choice([1, 1, 1, 2, 3])
        at = rng.randrange(len(paths[ticker]))
        c = paths[ticker][at][3]
        trades.append((i, ticker, paths[ticker][at][0], c * (1 - rng.choice([0.01, 0.05, 0.3, 0.9])), c * (1 + rng.choice([0.01, 0.05, 0.4, 9])), rng.choice([1, 5, 16, 17, 33, 256, 300, 900])))
    b = spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double").repartition(5)
    t = spark.createDataFrame(trades + [(999, 77, start, 1.0, 2.0, 5)], "id long, ticker long, entry_date date, stop_loss double, target_price double, horizon_days int")
    got = {r.id: (r.exit_reason, r.exit_bar, r.exit_date, r.exit_price) for r in portfolio.exit_trades(t, b).collect()}
    assert got == {i: brute_exit(paths[k], d, s, p, h) for i, k, d, s, p, h in trades}
    assert len(passage.extreme_tree(b, 900)) == 4 and len(passage.extreme_tree(b, 16)) == 2
