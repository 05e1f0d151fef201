"""As-of lookups and exits by blocks, quantiles by cuts: against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest

from crosspanel.functions import ordered
from crosspanel.operators import outcomes, passage, portfolio
from crosspanel.session import staged

START = dt.date(1969, 10, 1)


def test_asof_forward_meets_blocks_of_days(spark):
    rng = random.Random(5)
    bars = [(t, START + dt.timedelta(days=d), None if rng.random() < 0.1 else rng.random()) for t in (1, 2, 3) for d in range(300) if rng.random() < 0.25]
    rows = [(i, rng.choice([1, 2, 3, 4]), START + dt.timedelta(days=rng.randrange(-8, 310))) for i in range(500)] + [(501, None, START), (502, 1, None)]
    b = spark.createDataFrame(bars + [(None, START, 1.0), (1, None, 1.0)], "ticker long, date date, close double")
    r = spark.createDataFrame(rows, "id long, ticker long, target_date date")
    joined = outcomes.asof_forward(r, b)
    # neither side is multiplied by the days and joined
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((x.id, x.ticker, x.target_date, x.close_date, x.actual_close) for x in joined.collect())
    want = []
    for i, t, day in rows:
        after = sorted((d, c) for k, d, c in bars if day and k == t and day <= d <= day + dt.timedelta(days=5))
        want += [(i, t, day, *after[0])] if after else []
    assert got == want and want


def test_short_exits_meet_one_block(spark):
    rng = random.Random(6)
    rows, paths = [], {}
    for ticker, n in ((1, 200), (2, 65), (3, 1)):
        c = 100.0
        for i in range(n):
            c *= 1 + rng.uniform(-0.01, 0.0101)
            rows.append((ticker, START + dt.timedelta(days=2 * i), c + rng.random(), c - rng.random(), c))
        paths[ticker] = [r[1:] for r in rows if r[0] == ticker]
    trades = []
    for i in range(400):
        ticker = rng.choice([1, 1, 2, 3])
        entry, *_, c = paths[ticker][rng.randrange(len(paths[ticker]))]
        trades.append((i % 390, ticker, entry, c * (1 - rng.choice([0.01, 0.05, 0.9])), c * (1 + rng.choice([0.01, 0.05, 9])), rng.choice([0, 1, 5, 16, 17, 33, passage.BLOCK_BARS, None])))
    t = spark.createDataFrame(trades + [(999, 77, START, 1.0, 2.0, 5)], "id long, ticker long, entry_date date, stop_loss double, target_price double, horizon_days int")
    b = spark.createDataFrame(rows, "ticker long, date date, high double, low double, close double").repartition(5)
    before = staged(spark)
    exits = portfolio.exit_trades(t, b)
    # the numbered bars; trees and their trades were staged before
    assert staged(spark) - before == 1
    got = sorted(((x.id, x.exit_reason, x.exit_bar, x.exit_date, x.exit_price) for x in exits.collect()), key=str)
    want = []
    for i, k, entry, stop, target, h in trades:
        at = [p[0] for p in paths[k]].index(entry)
        hit = next((n for n in range(1, (h or 0) + 1) if at + n < len(paths[k]) and (paths[k][at + n][1] >= target or paths[k][at + n][2] <= stop)), None)
        n = h if hit is None else hit
        if n is None or at + n >= len(paths[k]):
            want.append((i, None, None, None, None))
            continue
        day, hi, _, c = paths[k][at + n]
        reason = "expired" if hit is None else "target" if hi >= target else "stop"
        want.append((i, reason, n, day, {"expired": c, "target": target, "stop": stop}[reason]))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_count_rows_by_cuts(spark, monkeypatch, bounded):
    def refuse(*_, **__):
        raise AssertionError("all distinct values are shuffled")

    monkeypatch.setattr(ordered, "cumulative_counts", refuse)
    rng = random.Random(7)
    values = {"a": [rng.gauss(0, 1) for _ in range(4000)], "b": [float(rng.randrange(4)) for _ in range(1000)], "c": [3.0], "d": [1.0, 2.0], "e": [0.0] * 900 + [float(i) for i in range(100)]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.05, 0.5, 0.901, 0.95, 1.0]
    got = {(r.g, r.prob): r.q for r in ordered.quantiles_in(df, ["g"], "v", probs, k=64, bounded=bounded).collect()}
    want = {(g, p): float(np.quantile(vs, p)) for g, vs in values.items() for p in probs}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    whole = {r.prob: r.q for r in ordered.quantiles_in(df, [], "v", probs).collect()}
    assert whole == {p: pytest.approx(float(np.quantile(sum(values.values(), []), p)), abs=1e-12) for p in probs}
