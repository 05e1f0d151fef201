"""Registry of this folder's queries and the helpers its operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# rows turned into Python objects at a time, and bytes gathered before an output batch leaves
SLICE_ROWS = 128
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL when SQL can express it on whole tables."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# keys with at least this share of all rows are hot; there can't be more of them than its inverse
HOT_KEYS = 1000


def join_by_weight(rows: DataFrame, keys: DataFrame, on: str | list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """`rows` joined to `keys`, one row a value of `on`, of which `weight` counts the rows; `how` is left or inner.

    Values with a thousandth of all rows or more, a thousand at most, are
    broadcast, so that no task gets all rows of one. The rest goes by a shuffle.
    `on` is never null; `weight` is left out of the result.
    """
    on = [on] if isinstance(on, str) else on
    is_hot = F.col(weight) * HOT_KEYS >= total
    hot = F.broadcast(keys.where(is_hot).drop(weight))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(~is_hot).drop(weight), on, how)
    return rows.join(hot, on).unionByName(cold)


def lower_ascii(col):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii_text(text: str) -> str:
    """The same for a string: bytes know no letters but those of ASCII."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_records(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """Run `fn` over the rows of each partition, as plain tuples in column order.

    Rows become Python objects a few at a time and output batches are cut by
    size, so a partition with very long texts needs no more memory than its
    longest few rows.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    yield from zip(*[c.to_pylist() for c in part.columns])

        held: list[tuple] = []
        size = 0
        for row in fn(rows()):
            held.append(row)
            size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
            if size >= BATCH_BYTES or len(held) >= 20_000:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
