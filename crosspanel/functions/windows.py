"""Per-entity window helpers: strict rolling windows and exponential means.

A series holds at most one row per (ticker, calendar day) - the panel adapters
enforce that key - so a `partitionBy("ticker")` window is bounded by the number
of calendar days, however large the table grows. Raw rows of a hot entity are
reduced to that bound by partial aggregation before any window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numeric import col, ratio


def series(by: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def _merge(family: str, a: dict[str, str], b: dict[str, str], na: int, nb: int) -> dict[str, str]:
    """SQL for the state of na+nb rows from the states of na newer and nb older rows."""
    if family == "sum":
        return {"s": f"{a['s']} + {b['s']}"}
    if family in ("min", "max"):
        # least/greatest skip NULL, a strict window must not
        pick = "least" if family == "min" else "greatest"
        return {"e": f"if(isnotnull({a['e']}) AND isnotnull({b['e']}), {pick}({a['e']}, {b['e']}), NULL)"}
    share, cross = float(nb / (na + nb)), float(na * nb / (na + nb))
    dx = f"({b['m']} - {a['m']})"
    out = {"m": f"{a['m']} + {dx} * {share!r}D", "q": f"{a['q']} + {b['q']} + {dx} * {dx} * {cross!r}D"}
    if family == "pair":
        dy = f"({b['my']} - {a['my']})"
        out |= {"my": f"{a['my']} + {dy} * {share!r}D", "qy": f"{a['qy']} + {b['qy']} + {dy} * {dy} * {cross!r}D", "c": f"{a['c']} + {b['c']} + {dx} * {dy} * {cross!r}D"}
    return out


_FAMILY = {"sum": "sum", "avg": "sum", "min": "min", "max": "max", "std": "mom", "var": "mom", "mean": "mom", "cov": "pair", "corr": "pair"}


def _start(family: str, cols: tuple[str, ...]) -> dict[str, str]:
    x = f"CAST({cols[0]} AS DOUBLE)"
    if family == "sum":
        return {"s": x}
    if family in ("min", "max"):
        return {"e": x}
    if family == "mom":
        return {"m": x, "q": f"if(isnotnull({x}), 0D, NULL)"}
    y = f"CAST({cols[1]} AS DOUBLE)"
    both = f"isnotnull({x}) AND isnotnull({y})"
    return {"m": f"if({both}, {x}, NULL)", "my": f"if({both}, {y}, NULL)", **{f: f"if({both}, 0D, NULL)" for f in ("q", "qy", "c")}}


def _finish(fn: str, s: dict[str, str], n: int) -> str:
    return {
        "sum": lambda: s["s"], "avg": lambda: f"{s['s']} / {n}D", "min": lambda: s["e"], "max": lambda: s["e"], "mean": lambda: s["m"],
        "var": lambda: f"{s['q']} / {n - 1}D", "std": lambda: f"sqrt({s['q']} / {n - 1}D)", "cov": lambda: f"{s['c']} / {n - 1}D",
        "corr": lambda: f"try_divide({s['c']}, sqrt({s['q']} * {s['qy']}))",
    }[fn]()


def rolling(df: DataFrame, specs: dict[str, tuple], by: str = "ticker", order: str = "date") -> DataFrame:
    """Add strict rolling statistics: {out: (fn, column[, column2], n)}.

    A value needs all n rows of the window, none of them NULL. Sliding window
    frames cost n updates per row; here a window of n rows is put together from
    blocks of 1, 2, 4, ... rows reached by `lag`, so the cost per row is
    log2(n) whatever the length, every lag of one level shares one Window
    operator, and all levels share one shuffle and sort. Means and variances
    merge pairwise, which keeps full precision (no running-sum cancellation).
    """
    over = f"OVER (PARTITION BY {by} ORDER BY {order})"
    columns, keep = list(df.columns), [by, order, "_row"]
    plan = []
    for i, (out, spec) in enumerate(specs.items()):
        fn, cols, n = spec[0], tuple(spec[1:-1]), spec[-1]
        plan.append(dict(out=out, fn=fn, key=(_FAMILY[fn], cols), n=n, tag=f"_a{i}", have=0))
    # outputs of one family, column and length share their state (mean and std, say)
    first: dict[tuple, dict] = {}
    for p in plan:
        p["lead"] = first.setdefault((p["key"], p["n"]), p)
    states = list(first.values())
    blocks = {k: f"_b{i}" for i, k in enumerate(dict.fromkeys(p["key"] for p in states))}
    parts = {k: list(_start(*k)) for k in blocks}
    longest = {k: max(p["n"] for p in states if p["key"] == k) for k in blocks}
    cur = [f"{c} AS {t}_{f}" for k, t in blocks.items() for f, c in _start(*k).items()]
    df = pack(df, by, order, cur)
    cur, width = [c.rsplit(" AS ", 1)[1] for c in cur], 1
    while width <= max(longest.values()):
        live = [k for k in blocks if 2 * width <= longest[k]]
        taking = [p for p in states if p["n"] & width]
        df = df.selectExpr(*keep, *cur)
        lags = [f"lag({blocks[k]}_{f}, {width}) {over} AS _l{blocks[k]}_{f}" for k in live for f in parts[k]]
        lags += [f"lag({blocks[p['key']]}_{f}, {p['have']}) {over} AS _l{p['tag']}_{f}" for p in taking if p["have"] for f in parts[p["key"]]]
        df = df.selectExpr("*", *lags) if lags else df
        cur = []
        for k in live:
            m = _merge(k[0], {f: f"{blocks[k]}_{f}" for f in parts[k]}, {f: f"_l{blocks[k]}_{f}" for f in parts[k]}, width, width)
            cur += [f"{c} AS {blocks[k]}_{f}" for f, c in m.items()]
        for p in states:
            own = {f: f"{p['tag']}_{f}" for f in parts[p["key"]]}
            if not p["n"] & width:
                cur += list(own.values()) if p["have"] else []
                continue
            src = {f: (f"_l{p['tag']}_{f}" if p["have"] else f"{blocks[p['key']]}_{f}") for f in own}
            new = _merge(p["key"][0], own, src, p["have"], width) if p["have"] else src
            cur += [f"{c} AS {own[f]}" for f, c in new.items()]
            p["have"] += width
        width *= 2
    outs = [_finish(p["fn"], {f: f"{p['lead']['tag']}_{f}" for f in parts[p["key"]]}, p["n"]) + f" AS {p['out']}" for p in plan]
    return unpack(df.selectExpr(*keep, *cur), columns, by, order, outs)


def pack(df: DataFrame, by: str, order: str, work: list[str]) -> DataFrame:
    """Window keys, work columns, and everything else as one struct.

    Each Window operator rewrites its rows field by field; a packed struct moves
    as one block of bytes, so a long chain of windows does not pay for the
    columns that only travel through it.
    """
    fields = ", ".join(f"'{c}', `{c}`" for c in df.columns if c not in (by, order))
    return df.selectExpr(by, order, f"named_struct({fields}) AS _row", *work)


def unpack(df: DataFrame, columns: list[str], by: str, order: str, outs: list[str]) -> DataFrame:
    """The packed columns again; the keys stay the columns the shuffle was made on."""
    return df.selectExpr(*[c if c in (by, order) else f"_row.`{c}` AS `{c}`" for c in columns], *outs)


def lag(x: str | Column, n: int = 1, by="ticker", order="date") -> Column:
    return F.lag(col(x), n).over(series(by, order))


def lead(x: str | Column, n: int = 1, by="ticker", order="date") -> Column:
    return F.lead(col(x), n).over(series(by, order))


def ewm(df: DataFrame, specs: dict[str, tuple[str, float]], by: str = "ticker", order: str = "date") -> DataFrame:
    """Add exponentially weighted means y_t = a*x_t + (1-a)*y_(t-1), y_0 = x_0.

    `specs` maps output name -> (input column, alpha). Leading NULLs are
    skipped; a gap after the first value is an error (the quality gates reject
    such series). The mean is a sum of c_i * x_i * (1-a)^(t-i), c_first=1, else a,
    put together from blocks of 1, 2, 4, ... rows reached by `lag`, like `rolling`:

        S_2w(t) = S_w(t) + (1-a)^w * S_w(t-w)

    until (1-a)^w is 0 as a double, so a series of any length is whole. All
    levels keep the order (by, order): one sort, of the rows that come in.
    """
    over = f"OVER (PARTITION BY {by} ORDER BY {order})"
    upto = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    columns, inputs = list(df.columns), {x: f"_x{i}" for i, x in enumerate(dict.fromkeys(x for x, _ in specs.values()))}
    df = pack(df, by, order, [f"CAST(`{x}` AS DOUBLE) AS {t}" for x, t in inputs.items()])
    df = df.selectExpr("*", *[f"count({t}) {upto} AS _n{t}" for t in inputs.values()])
    keep = [by, order, "_row", *[f"_n{t}" for t in inputs.values()]]
    gap = "if(_n{t} > 0, CAST(raise_error('ewm: a value is missing inside the series of {x}') AS DOUBLE), 0D)"
    start = {o: f"coalesce(if(_n{inputs[x]} = 1, 1D, {float(a)!r}D) * {inputs[x]}, {gap.format(t=inputs[x], x=x)})" for o, (x, a) in specs.items()}
    df, width = df.selectExpr(*keep, *[f"{e} AS _s_{o}" for o, e in start.items()]), 1
    while live := [o for o, (_, a) in specs.items() if (1.0 - a) ** width > 0]:
        df = df.selectExpr("*", *[f"lag(_s_{o}, {width}, 0D) {over} AS _l_{o}" for o in live])
        df = df.selectExpr(*keep, *[f"_s_{o} + {(1.0 - specs[o][1]) ** width!r}D * _l_{o} AS _s_{o}" if o in live else f"_s_{o}" for o in specs])
        width *= 2
    return unpack(df, columns, by, order, [f"if(_n{inputs[x]} > 0, _s_{o}, NULL) AS {o}" for o, (x, _) in specs.items()])
