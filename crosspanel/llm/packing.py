"""Mixture-controlled packing: deficit round-robin over source queues into fixed windows."""

from __future__ import annotations

import zlib
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import stage
from .base import map_records, query, table

WINDOW = 2048
# tokens a source is served at a time; divides WINDOW, and bounds the deficit a source can carry
QUANTUM = 256
END_ID = 1
SPECIAL = "<|endoftext|>"
# shares are counted in so many parts of a window; whole numbers keep the order exact
SHARES = 1 << 20
# tokens whose pieces are worked out at once
SLICE_TOKENS = 1_000_000
# rows of (partition, source) start offsets that are broadcast at most, about 40 bytes each
BROADCAST_ROWS = 500_000


@lru_cache(maxsize=1)
def _encoder():
    """The vocabulary of byte_bpe_50k.json by the faster of its two libraries, and the slower one."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text: str | None) -> np.ndarray:
    """Token ids of a text and END_ID, as unsigned 16-bit numbers (the vocabulary has 50,257 ids).

    Only a text with the special token's own string, or one the fast library
    refuses, differs between the libraries; it goes to the slower one.
    """
    if not text:
        return np.array([END_ID], np.uint16)
    fast, slow = _encoder()
    try:
        # the fast vocabulary has no special tokens: this is plain encoding, without a Python number for every id
        ids = slow.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_to_numpy(text)
    except Exception:  # noqa: BLE001  the expression engine's limit on very long runs
        ids = slow.encode(text, add_special_tokens=False).ids
    out = np.empty(len(ids) + 1, np.uint16)
    out[:-1] = ids
    out[-1] = END_ID
    return out


def tokenise(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """doc_id, source, part, before, n_tokens, ids: `before` counts the source's tokens earlier in the partition."""

    def run(rows):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for key, text, source in rows:
            ids = encode(text)
            before = held.get(source, 0)
            held[source] = before + len(ids)
            yield key, source, part, before, len(ids), ids.tobytes()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_records(docs.select("doc_id", "text", F.col(source_col).cast("string").alias("source")), run, f"doc_id {kind}, source string, part int, before bigint, n_tokens bigint, ids binary")


class Schedule:
    """Order of service of all queues, in closed form.

    Queue s has n[s] whole quanta and a weight w[s]. Deficit round-robin with
    quanta serves the quantum whose queue is furthest behind its share, so
    quantum i of queue s is served at virtual time (i + 1/2) / w[s]; its place
    in the order is the number of quanta of all queues with an earlier time.
    Any task can work out any place, with every deficit the windows and
    partitions before it have left, from the queues' totals alone.
    """

    def __init__(self, totals: list[int], weights: list[float]) -> None:
        self.quanta = np.array([t // QUANTUM for t in totals], np.int64)
        top = sum(weights)
        self.weights = np.array([max(1, round(w / top * SHARES)) for w in weights], np.int64)
        self.per_window = WINDOW // QUANTUM
        self.whole = int(self.quanta.sum()) // self.per_window * self.per_window
        # what stays beyond the whole windows: the last quanta, then each queue's tail, one after the other
        self.tails = np.array([t % QUANTUM for t in totals], np.int64)
        self.tail_start = (int(self.quanta.sum()) - self.whole) * QUANTUM + np.concatenate([[0], np.cumsum(self.tails)[:-1]]) if totals else np.zeros(0, np.int64)
        rest = (int(self.quanta.sum()) - self.whole) * QUANTUM + int(self.tails.sum())
        self.windows = self.whole // self.per_window
        # lengths of the last sequences: whole windows, then powers of two, which need no padding
        self.last = [WINDOW] * (rest // WINDOW) + [1 << b for b in range(WINDOW.bit_length() - 1, -1, -1) if rest % WINDOW >> b & 1]
        self.last_start = np.concatenate([[0], np.cumsum(self.last)]).astype(np.int64)

    def place(self, queue: int, index: np.ndarray) -> np.ndarray:
        """Places of the quanta `index` of a queue; ties go by queue."""
        own, turn = int(self.weights[queue]), 2 * index + 1
        out = index.copy()
        for t, (weight, quanta) in enumerate(zip(self.weights.tolist(), self.quanta.tolist())):
            if t != queue:
                # odd numbers 2j + 1 with (2j + 1) / weight before (or, of an earlier queue, at) turn / own
                ahead = (turn * weight - (t > queue)) // own
                out += np.minimum((ahead + 1) // 2, quanta)
        return out

    def pieces(self, queue: int, start: int, length: int) -> list[tuple[int, int, int, int]]:
        """(offset in the document, length, sequence, offset there) of `length` tokens from `start` of a queue."""
        _, *columns = self.pieces_of(*[np.array([x], np.int64) for x in (queue, start, length)])
        return list(zip(*[c.tolist() for c in columns]))

    def pieces_of(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of many stretches of tokens, each `length` from `start` of its queue.

        Returns for every piece the number of its stretch, its offset there, its
        length, sequence and offset in the sequence, in order of stretch and offset.
        """
        n = -(-(start + length) // QUANTUM) - start // QUANTUM
        which = np.repeat(np.arange(len(queue)), n)
        index = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start // QUANTUM, n)
        begin = np.maximum(index * QUANTUM, start[which])
        size = np.minimum((index + 1) * QUANTUM, (start + length)[which]) - begin
        # position in the whole order of service: quanta by their place, then every queue's tail
        at = np.empty(len(which), np.int64)
        of = queue[which]
        tail = index >= self.quanta[of]
        for q in np.unique(of).tolist():
            mine = np.flatnonzero((of == q) & ~tail)
            at[mine] = self.place(q, index[mine]) * QUANTUM + begin[mine] % QUANTUM
        at[tail] = self.whole * QUANTUM + self.tail_start[of[tail]] + begin[tail] % QUANTUM
        rest = at - self.whole * QUANTUM
        # beyond the whole windows sequences may be shorter than a quantum: cut there
        cuts = np.where(rest < 0, 0, np.searchsorted(self.last_start, rest + size, "left") - np.searchsorted(self.last_start, np.maximum(rest, 0), "right"))
        which, begin, size, rest = np.repeat(which, cuts + 1), np.repeat(begin, cuts + 1), np.repeat(size, cuts + 1), np.repeat(rest, cuts + 1)
        part = np.arange(len(which)) - np.repeat(np.cumsum(cuts + 1) - (cuts + 1), cuts + 1)
        first = np.searchsorted(self.last_start, np.maximum(rest, 0), "right") - 1
        k = np.minimum(first + part, max(len(self.last) - 1, 0))
        late = rest >= 0
        a = np.where(late & (part > 0), self.last_start[k], rest)
        b = np.where(late, np.minimum(rest + size, self.last_start[np.minimum(k + 1, len(self.last_start) - 1)]), rest + size)
        sequence = np.where(late, self.windows + k, (a + self.whole * QUANTUM) // WINDOW)
        inside = np.where(late, a - self.last_start[k], (a + self.whole * QUANTUM) % WINDOW)
        offset, size = begin - start[which] + a - rest, b - a
        # neighbours in a sequence are one piece
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (sequence[1:] != sequence[:-1]) | (inside[1:] != inside[:-1] + size[:-1])
        heads = np.flatnonzero(new)
        return which[heads], offset[heads], np.add.reduceat(size, heads) if len(heads) else size, sequence[heads], inside[heads]


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, source_col: str = "source") -> DataFrame:
    """Pieces of all documents in sequences of at most WINDOW tokens.

    `targets` gives each source's share of the tokens of a window (any positive
    numbers; a source not named gets the mean). Without it the shares are those
    of the corpus, so all queues run dry together and every window has the same
    mixture. A source whose queue is empty passes its share to the others. A
    window differs from its targets by less than QUANTUM tokens a source, which
    the next windows make good.

    A null text is empty and has the end token alone; a null source is a queue
    of its own; repeated rows are packed each; an empty table gives no rows;
    other columns are not read. Queues follow the order in which the table is
    read. Only totals by source reach the driver (one row a source); documents
    are not shuffled. Returns doc_id, source, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    tokens = stage(tokenise(docs, source_col))
    ends = tokens.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"))
    starts = stage(ends.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    by_source = starts.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("parts")).orderBy("source").collect()
    queues = {r["source"]: i for i, r in enumerate(by_source)}
    totals = [r["n"] for r in by_source]
    mean = sum(targets.values()) / len(targets) if targets else 1.0
    plan = Schedule(totals, [float(targets.get(s, mean)) for s in queues] if targets else [float(max(1, t // QUANTUM)) for t in totals])
    small = sum(r["parts"] for r in by_source) <= BROADCAST_ROWS
    s = starts.select(F.col("source").alias("s_source"), F.col("part").alias("s_part"), "ahead")
    placed = tokens.join(F.broadcast(s) if small else s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("part") == F.col("s_part")))
    kept = spark.sparkContext.broadcast((queues, plan))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, source string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queues, plan = kept.value
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in _slices(batch):
                key, source, start, n, raw = part.columns
                at, count = start.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
                queue = np.array([queues[s] for s in source.to_pylist()], np.int64)
                which, offset, length, sequence, inside = plan.pieces_of(queue, at, count)
                ids = memoryview(np.frombuffer(b"".join(raw.to_pylist()), np.uint16).astype("<u4")).cast("B")
                first = 4 * ((np.cumsum(count) - count)[which] + offset)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                take = pa.array(which)
                columns = [key.take(take), source.take(take), pa.array(offset), pa.array(length), pa.array(sums, pa.int64()), n.take(take), pa.array(sequence), pa.array(inside)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return placed.select("doc_id", "source", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids").mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_TOKENS tokens, one row at least."""
    total = np.cumsum(batch.column(3).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + SLICE_TOKENS, "right")))
        yield batch.slice(at, end - at)
        at = end


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed with the corpus's own mixture in every window."""
    return pack(table(spark, sf_dir, "documents"))
