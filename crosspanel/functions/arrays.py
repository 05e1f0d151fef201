"""Rolling statistics and exponential means of whole series in Arrow batches.

The functions of `windows` put one Window operator into the plan for every block
length, and each rewrites every row. A chain of some fifty of them costs more than
all else, so the feature table takes its series statistics in one pass: Spark brings
a ticker's rows together in order, a task reads them as arrays and merges the same
blocks of 1, 2, 4, ... rows, in the same order of operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .windows import _FAMILY, series

# rows that a task works on at once, rounded up to whole series
CHUNK = 16_384

# values and whether they are there
Values = tuple[np.ndarray, np.ndarray]


def divide(a: np.ndarray, b: np.ndarray) -> Values:
    """a/b and whether b is not 0, like `numeric.ratio`."""
    return np.divide(a, b, out=np.zeros_like(a), where=b != 0), b != 0


def _shift(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[n:] = x[: len(x) - n]
    return out


def _merge(family: str, a: dict, b: dict, na: int, nb: int) -> dict:
    """The state of na+nb rows from the states of na newer and nb older rows, see `windows._merge`."""
    if family == "sum":
        return {"s": a["s"] + b["s"]}
    if family in ("min", "max"):
        # a NaN is larger than any number
        return {"e": (np.fmin if family == "min" else np.maximum)(a["e"], b["e"])}
    share, cross = nb / (na + nb), na * nb / (na + nb)
    dx = b["m"] - a["m"]
    out = {"m": a["m"] + dx * share, "q": a["q"] + b["q"] + dx * dx * cross}
    if family == "pair":
        dy = b["my"] - a["my"]
        out |= {"my": a["my"] + dy * share, "qy": a["qy"] + b["qy"] + dy * dy * cross, "c": a["c"] + b["c"] + dx * dy * cross}
    return out


def _start(family: str, x: list[np.ndarray]) -> dict:
    none = np.zeros_like(x[0])
    return {"sum": lambda: {"s": x[0]}, "min": lambda: {"e": x[0]}, "max": lambda: {"e": x[0]}, "mom": lambda: {"m": x[0], "q": none},
            "pair": lambda: {"m": x[0], "my": x[1], "q": none, "qy": none, "c": none}}[family]()


def _finish(fn: str, s: dict, n: int) -> Values:
    if fn == "corr":
        return divide(s["c"], np.sqrt(s["q"] * s["qy"]))
    out = {"sum": lambda: s["s"], "avg": lambda: s["s"] / n, "min": lambda: s["e"], "max": lambda: s["e"], "mean": lambda: s["m"],
           "var": lambda: s["q"] / (n - 1), "std": lambda: np.sqrt(s["q"] / (n - 1)), "cov": lambda: s["c"] / (n - 1)}[fn]()
    return out, np.ones(len(out), bool)


def rolling(cols: dict[str, Values], at: np.ndarray, specs: dict[str, tuple]) -> dict[str, Values]:
    """Strict rolling statistics of series that lie one after the other, see `windows.rolling`; `at` is a row's place in its series."""
    wanted: dict[tuple, dict[int, list]] = {}
    for out, (fn, *names, n) in specs.items():
        wanted.setdefault((_FAMILY[fn], tuple(names)), {}).setdefault(n, []).append((out, fn))
    here, found = np.arange(len(at)), {}
    for (family, names), lengths in wanted.items():
        there = np.logical_and.reduce([cols[c][1] for c in names])
        # rows since the last one that is missing, or since the series began
        run = np.minimum(here - np.maximum.accumulate(np.where(there, -1, here)), at + 1)
        block, have, width = _start(family, [np.where(there, cols[c][0], 0.0) for c in names]), {}, 1
        while width <= max(lengths):
            for n in lengths:
                if n & width:
                    # what a block of rows before the first of the series adds is not used: `run` is too short there
                    rows, own = have.get(n, (0, None))
                    have[n] = (rows + width, _merge(family, own, {f: _shift(x, rows) for f, x in block.items()}, rows, width) if rows else block)
            width *= 2
            if width <= max(lengths):
                block = _merge(family, block, {f: _shift(x, width // 2) for f, x in block.items()}, width // 2, width // 2)
        for n, outs in lengths.items():
            for out, fn in outs:
                value, defined = _finish(fn, have[n][1], n)
                found[out] = (value, defined & (run >= n))
    return {out: found[out] for out in specs}


def ewm(cols: dict[str, Values], at: np.ndarray, specs: dict[str, tuple[str, float]]) -> dict[str, Values]:
    """Exponentially weighted means, see `windows.ewm`."""
    found, begin = {}, np.arange(len(at)) - at
    longest = int(at.max(initial=0))
    for out, (x, alpha) in specs.items():
        value, there = cols[x]
        seen = np.cumsum(there)
        seen = seen - (seen - there)[begin]
        if np.any((seen > 0) & ~there):
            raise ValueError(f"ewm: a value is missing inside the series of {x}")
        s, width = np.where(there, np.where(seen == 1, 1.0, alpha) * value, 0.0), 1
        while width <= longest and (share := (1.0 - alpha) ** width) > 0:
            s = s + share * np.where(at >= width, _shift(s, width), 0.0)
            width *= 2
        found[out] = (s, seen > 0)
    return found


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values share the mean; a NaN is the largest value."""
    order = np.argsort(x, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x))
    ranks = np.empty(len(x))
    ranks[order] = np.repeat((first + 1 + last) / 2.0, last - first)
    return ranks


Step = Callable[[dict[str, Values], np.ndarray], dict[str, Values]]


def _whole_series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together and cut where a series begins."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        begins = np.flatnonzero(b.column("_at").to_numpy() == 0)
        if sum(len(h) for h in held) + len(b) >= CHUNK and len(begins) and (held or begins[-1] > 0):
            cut = int(begins[-1])
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held, b = [], b.slice(cut)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def series_pass(df: DataFrame, reads: list[str], steps: list[Step], keep: list[str], outs: list[str], by: str = "ticker", order: str = "date") -> DataFrame:
    """Columns `keep` of the rows, and the columns `outs` that the steps add from the numeric columns `reads`.

    Rows come by (by, order): the Window that numbers them brings whole series
    into a task, which checks the numbers. Tasks hold CHUNK rows or one series.
    """
    numbered = df.withColumn("_at", F.row_number().over(series(by, order)) - 1).sortWithinPartitions(by, order)
    src = numbered.select(*keep, *[c for c in reads if c not in keep], "_at")
    schema = StructType([*src.select(*keep).schema.fields, *[StructField(c, DoubleType()) for c in outs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_series(batches):
            at = t.column("_at").to_numpy()
            if not len(at):
                continue
            if at[0] != 0 or np.any((at[1:] != at[:-1] + 1) & (at[1:] != 0)):
                raise ValueError("series_pass: rows of a series are not in order")
            cols = {}
            for c in reads:
                x = pc.cast(t.column(c), pa.float64())
                cols[c] = (pc.fill_null(x, 0.0).to_numpy(), pc.is_valid(x).to_numpy())
            with np.errstate(all="ignore"):
                for step in steps:
                    cols |= step(cols, at)
            made = [pa.array(cols[c][0], mask=~cols[c][1]) for c in outs]
            table = pa.Table.from_arrays([*[t.column(c) for c in keep], *made], names=[*keep, *outs])
            yield from table.combine_chunks().to_batches()

    return src.mapInArrow(run, schema)
