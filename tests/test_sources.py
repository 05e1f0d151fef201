"""Gated writes, hostile journals and bucketed panels."""

import datetime as dt
import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crosspanel.operators import gates
from crosspanel.sources import tables


def panel(spark, n=60, bad=None):
    rows = []
    for t in (1, 2, 3):
        for i in range(n):
            c = 100.0 + t + (i % 7) + (900 if (t, i) == (2, 30) else 0)
            rows.append((t, dt.date(2024, 1, 1) + dt.timedelta(days=i + (9 if t == 3 and i > 10 else 0)), c, c + 1, c - 1, -1.0 if bad == (t, i) else c, 10.0))
    return spark.createDataFrame(rows, "ticker long, date date, open double, high double, low double, close double, volume double")


def test_gates_run_with_the_write(spark, tmp_path):
    path = str(tmp_path / "panel")
    bars = panel(spark)
    kept, gaps = gates.run_gates(bars, "2024-03-01", max_lag=30, path=path, n_sigma=5.0)
    want = {(r.ticker, r.date): r.spike_flag for r in gates.spike_flags(bars, n_sigma=5.0).collect()}
    assert {(r.ticker, r.date): r.spike_flag for r in kept.collect()} == want and sum(want.values()) == 2
    assert kept.columns == [*bars.columns, "spike_flag"]
    assert sorted(map(tuple, gaps.collect())) == sorted(map(tuple, gates.date_gaps(bars).collect())) == [(3, 10, 1)]
    assert os.listdir(tmp_path) == ["panel"]


@pytest.mark.parametrize("bad,end", [((2, 5), None), (None, "2025-01-01")])
def test_a_failed_gate_leaves_nothing(spark, tmp_path, bad, end):
    with pytest.raises(gates.DataQualityError):
        gates.gated_write(panel(spark, bad=bad), str(tmp_path / "panel"), end)
    assert os.listdir(tmp_path) == []


def test_hostile_lines(spark, tmp_path):
    lines = ['{"ticker": "a", "entry_price": 1.5, "more": [1]}', "", "{", '{"ticker": "b", "entry_price": "x"}', '{"entry_price": 2}', "not json", '{"ticker": "c"}', '{"ticker": null, "entry_price": 3.0}']
    (tmp_path / "j.json").write_text("\n".join(lines))
    rows, bad = tables.read_hostile(spark, str(tmp_path / "j.json"), tables.SIGNAL_SCHEMA, ["ticker"])
    assert sorted((r.ticker, r.entry_price) for r in rows.collect()) == [("a", 1.5), ("c", None)]
    got = sorted((r.reason, r.line) for r in bad.collect())
    assert [g[0] for g in got] == ["broken"] * 3 + ["missing ticker"] * 2 and {g[1] for g in got[:3]} == {lines[2], lines[3], lines[5]}
    rows, bad = tables.read_hostile(spark, str(tmp_path / "none.json"), tables.SIGNAL_SCHEMA)
    assert rows.count() == bad.count() == 0
    (tmp_path / "j.csv").write_text("a,b\n1,x\nq,y\n3\n")
    rows, bad = tables.read_hostile(spark, str(tmp_path / "j.csv"), spark.createDataFrame([], "a int, b string").schema, ["b"], "csv")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and bad.count() == 2


def test_bucketed_panel_needs_no_shuffle(spark):
    bars = panel(spark)
    try:
        for mode, part in (("overwrite", bars.where("ticker < 3")), ("append", bars.where("ticker = 3")), ("append", bars.withColumn("date", F.date_add("date", 200)))):
            t = tables.write_panel(part, "panel_test", 4, mode)
        w = W.partitionBy("ticker").orderBy("date")
        both = t.withColumn("before", F.lag("close").over(w)).join(spark.table("panel_test").groupBy("ticker").agg(F.max("close").alias("top")), "ticker")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert both.count() == 360 and both.where("before is null").count() == 3
    finally:
        spark.sql("DROP TABLE IF EXISTS panel_test")
