"""Concurrent resumable steps, halving search, isotonic fits and forest surfaces against plain Python."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import isotonic, jobs, models


def test_steps_resume_where_they_stopped(spark):
    done, job = [], f"test-{uuid.uuid4().hex}"

    def step(i, fail=False):
        def run():
            if fail:
                raise RuntimeError("lost")
            done.append(i)
            return spark.range(i).select(F.lit(i).alias("step_id"), "id") if i != 2 else None

        return run

    with pytest.raises(RuntimeError, match="lost"):
        jobs.run_steps(spark, {i: step(i, i == 4) for i in range(6)}, "step_id int, id bigint", job, workers=3)
    assert sorted(done) == [0, 1, 2, 3, 5]
    out = jobs.run_steps(spark, {i: step(i) for i in range(6)}, "step_id int, id bigint", job, workers=2)
    assert sorted(done) == [0, 1, 2, 3, 4, 5] and out.count() == 1 + 3 + 4 + 5
    assert jobs.run_steps(spark, {}, "a int").count() == 0


def test_walk_forward_is_the_same_in_any_order(spark):
    import datetime as dt

    rng = random.Random(4)
    rows = []
    for d in range(80):
        for t in range(12):
            x, y = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=d), t, x, y, int(x + rng.gauss(0, 1) > 0), x / 10, 1.0))
    df = spark.createDataFrame(rows, "date date, ticker long, a double, b double, target int, fwd_ret double, weight double").cache()
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=d) for d in range(80)]
    plan = spark.createDataFrame([(i, days[40 + 8 * i], days[30 + 8 * i], days[24 + 8 * i]) for i in range(5)], "step int, test_date date, train_cutoff date, val_cutoff date")
    run = lambda **k: sorted(map(tuple, models.walk_forward(df, plan, ["a", "b"], weight="weight", refit_every=2, maxIter=2, maxDepth=2, **k).select("step", "date", "ticker", "pred").collect()))
    one = run(workers=1)
    assert one == run(workers=4, job=f"walk-{uuid.uuid4().hex}") and {r[0] for r in one} == set(range(5)) and len(one) == 60
    assert {r[0] for r in run(min_rows=12 * 40)} == {2, 3, 4}


def test_halving_promotes_by_mean_fold_ic(spark):
    import duckdb

    import datetime as dt

    rng = random.Random(2)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), t, x, x + rng.gauss(0, 1), 1.0) for d in range(60) for t in range(10) for x in [rng.gauss(0, 1)]]
    df = spark.createDataFrame([(*r[:4], r[3], r[4]) for r in rows], "date date, ticker long, a double, target double, fwd_ret double, weight double")
    folds = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=d), k, role) for k in range(4) for d in range(60) for role in (["train"] if d < 20 + 10 * k else ["test"] if d < 30 + 10 * k else [])], "date date, fold int, role string")
    grid = [dict(maxIter=i, maxDepth=k) for i in (1, 2) for k in (1, 2, 3)]
    table, ics = models.halving_search(df, folds, ["a"], grid, weight="weight", first_folds=1, workers=3)
    rungs, cells = sorted(map(tuple, table.collect())), [tuple(r) for r in ics.collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE ic(grid_id INT, fold INT, ic DOUBLE)")
    con.executemany("INSERT INTO ic VALUES (?, ?, ?)", cells)
    alive = list(range(6))
    for rung, (folds_met, keep) in enumerate([(1, 3), (2, 2), (4, 1)]):
        q = f"SELECT grid_id, avg(CASE WHEN isnan(ic) THEN 0 ELSE coalesce(ic, 0) END) AS m, count(*) FROM ic WHERE fold < {folds_met} AND grid_id IN ({','.join(map(str, alive))}) GROUP BY 1 ORDER BY m DESC, grid_id"
        want = con.execute(q).fetchall()
        have = sorted((r for r in rungs if r[0] == rung), key=lambda r: r[4])
        assert [(r[1], r[3]) for r in have] == [(g, n) for g, _, n in want] and all(abs(r[2] - w[1]) < 1e-12 for r, w in zip(have, want))
        assert [r[5] for r in have] == [i < keep for i in range(len(have))]
        alive = [g for g, *_ in want[:keep]]
    assert len(cells) == 6 + 3 + 2 * 2


def plain_isotonic(points):
    """max-min formula on the distinct scores."""
    xs = sorted({x for x, _ in points})
    sums = [sum(y for a, y in points if a == x) for x in xs]
    n = [sum(a == x for a, _ in points) for x in xs]
    mean = lambda a, b: sum(sums[a:b + 1]) / sum(n[a:b + 1])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("shard_points", [10**6, 7, 1])
def test_isotonic_is_the_max_min_formula(spark, shard_points):
    rng = random.Random(5)
    points = [(rng.choice([round(rng.random(), 2), 0.5]), float(rng.random() < 0.5)) for _ in range(120)]
    df = spark.createDataFrame(points + [(None, 1.0), (0.3, None)], "pred double, label double").repartition(4)
    model = isotonic.fit_isotonic(df, shard_points=shard_points)
    want = plain_isotonic(points)
    got = {r.pred: r.calibrated for r in isotonic.apply_isotonic(model, df.where("pred is not null and label is not null")).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - y) < 1e-12 for x, y in want.items())
    # between blocks a straight line, outside the first and last step, missing stays missing; in both ways to apply
    more = spark.createDataFrame([(-1.0,), (2.0,), (0.123456,), (0.777,), (None,)], "pred double")
    a, b = ([r.calibrated for r in isotonic.apply_isotonic(model, more, broadcast_blocks=n).orderBy("pred").collect()] for n in (10**6, 0))
    assert a[0] is None and b[0] is None and a[1] == min(want.values()) and a[-1] == max(want.values())
    assert all(abs(x - y) < 1e-12 for x, y in zip(a[1:], b[1:]))


def test_isotonic_of_a_million_scores(spark):
    df = spark.range(10**6).select((F.col("id") / 1e6).alias("pred"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000 < F.col("id") / 1e6).cast("double").alias("label"))
    model = isotonic.fit_isotonic(df)
    m = model.orderBy("lo").toPandas()
    assert len(m) < 20_000 and (np.diff(m.y) > 0).all() and m.w.sum() == 10**6


def test_isotonic_of_nothing(spark):
    none = isotonic.fit_isotonic(spark.createDataFrame([], "pred double, label double"))
    assert none.count() == 0
    assert isotonic.apply_isotonic(none, spark.createDataFrame([(0.5,)], "pred double")).first().calibrated is None


def test_leaf_quantiles_are_those_of_the_leaves(spark):
    from pyspark.ml.functions import vector_to_array

    from crosspanel.operators import surface

    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), round(rng.gauss(0, 1), 1), rng.choice([0.5, 1.0, 2.0])) for i in range(400)]
    df = models.assemble(spark.createDataFrame(rows, "id long, a double, b double, y double, w double"), ["a", "b"]).cache()
    train, test = df.where("id < 300"), df.where("id >= 300")
    model = surface.fit_forest(train, "y", "w", trees=5, depth=3, min_rows=5)
    edges = surface.bin_edges(train, "y")
    assert edges == sorted({r.y for r in train.collect()})
    taus = (0.1, 0.5, 0.9)
    got = {r.id: list(r._q) for r in surface.leaf_quantiles(model, surface.leaf_weights(model, train, "y", edges, "w"), edges, test, taus).collect()}
    leaf_of = lambda d: {r.id: (list(map(int, r.l)), r.y, r.w) for r in model.transform(d).select("id", "y", "w", vector_to_array("_leaf").alias("l")).collect()}
    seen, asked = leaf_of(train), leaf_of(test)
    for i, (leaves, _, _) in asked.items():
        weight = {}
        for t, leaf in enumerate(leaves):
            inside = [(y, w) for ls, y, w in seen.values() if ls[t] == leaf]
            for y, w in inside:
                weight[y] = weight.get(y, 0) + w / sum(x for _, x in inside) / len(leaves)
        run, want = 0.0, {}
        for y in sorted(weight):
            run += weight[y]
            for tau in taus:
                if run >= tau - 1e-9:
                    want.setdefault(tau, y)
        assert got[i] == [want[t] for t in taus]
    # with few bins a quantile is at most one bin off
    few = surface.bin_edges(train, "y", 10)
    near = {r.id: list(r._q) for r in surface.leaf_quantiles(model, surface.leaf_weights(model, train, "y", few, "w"), few, test, taus).collect()}
    assert len(few) <= 10 and all(a <= b for i in near for a, b in zip(near[i], got[i]))
