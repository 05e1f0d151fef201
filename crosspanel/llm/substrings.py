"""Substring dedup: suffix automata of reference shards, matching statistics of the documents against them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .base import SLICE_ROWS, join_by_weight, map_records, query, table
from .tokens import hashed_rows, mix, word_hashes

WINDOW_WORDS = 13
# words of an anchor; of the anchors in a window the one with the smallest hash stands for it
ANCHOR_WORDS = 5
# an anchor in more documents is routed by whole windows, which are pre-aggregated
HOT_DOCUMENTS = 10_000
# words of one automaton, give or take the segments of one anchor
SHARD_WORDS = 60_000
# rows of a small side that are broadcast at most, some 50 bytes each, and bytes of all spans
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20

# odd and unrelated: multipliers in proportion would give rearranged words the same sum
_MULTIPLIERS = mix(np.arange(1, WINDOW_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Hasher:
    """64-bit hashes of words and of word sequences."""

    @staticmethod
    def words(words: list[str]) -> np.ndarray:
        return word_hashes(" ".join(words).encode("utf-8", "surrogatepass"))

    @staticmethod
    def grams(hashes: np.ndarray, n: int) -> np.ndarray:
        m = len(hashes) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        total = hashes[:m] * _MULTIPLIERS[0]
        for i in range(1, n):
            total += hashes[i : i + m] * _MULTIPLIERS[i]
        return mix(total)


def _leftmost_minima(x: np.ndarray, span: int) -> np.ndarray:
    """Place of the leftmost smallest value of every `span` values, from windows of 1, 2, 4, ... values."""
    value, place, width = x, np.arange(len(x)), 1
    while width < span:
        by = min(width, span - width)
        a, b, ia, ib = value[:-by], value[by:], place[:-by], place[by:]
        right = b < a
        value, place, width = np.where(right, b, a), np.where(right, ib, ia), width + by
    return place


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the place of its anchor, and the hash of every possible anchor.

    Equal windows have their anchor at the same place in them, so a window is
    only ever compared with windows of the same anchor.
    """
    grams = Hasher.grams(hashes, ANCHOR_WORDS)
    span = WINDOW_WORDS - ANCHOR_WORDS + 1
    return (_leftmost_minima(grams, span) if len(grams) >= span else np.zeros(0, np.int64)), grams


class Automaton:
    """Suffix automaton of word sequences; every state knows the smallest document its words end in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[int] = [1 << 62]

    def add(self, words: list[int], doc: int) -> None:
        """All of one sequence, from the start state."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nexts[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                if q is None:
                    new = len(nexts)
                    nexts.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    first.append(1 << 62)
                    p = last
                    while p >= 0 and w not in nexts[p]:
                        nexts[p][w] = new
                        p = link[p]
                    if p >= 0:
                        q = nexts[p][w]
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                    last = new
                else:
                    last = self._split(last, w, q)
            if doc < first[last]:
                first[last] = doc

    def _split(self, p: int, w: int, q: int) -> int:
        nexts, link, length, first = self.next, self.link, self.length, self.first
        clone = len(nexts)
        nexts.append(nexts[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        first.append(first[q])
        link[q] = clone
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """A state's words are also ends of the longer ones linked to it."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if p > 0 and self.first[s] < self.first[p]:
                self.first[p] = self.first[s]

    def statistics(self, words: list[int], size: int) -> list[int]:
        """For every window of `size` words, the smallest document that has it (a very large number without one)."""
        out, state, matched = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state, matched = nexts[state][w], matched + 1
            if i >= size - 1:
                s = state
                if matched >= size:
                    while length[link[s]] >= size:
                        s = link[s]
                    out.append(self.first[s])
                else:
                    out.append(1 << 62)
        return out


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc of every document (doc, text), where more than one document has the anchor.

    A task that meets an anchor in several of its documents knows it to be
    shared: these rows (mark 1) go on by themselves, and one row without a
    document (mark 2) tells the other tasks. So a passage that many documents
    have gives a few rows a task to compare, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ids = [], []
        rows = (row for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS) for row in zip(*[c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns]))
        for (doc, _), _, _, hashes in hashed_rows(rows, 1):
            spots, grams = anchors(hashes)
            if len(spots):
                found.append(np.unique(grams[spots[np.append(True, spots[1:] != spots[:-1])]]))
                ids.append(doc)
        if not found:
            return
        sizes = [len(x) for x in found]
        anchor = np.concatenate(found).view(np.int64)
        doc = np.repeat(np.array(ids, np.int64), sizes)
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
        mark = np.repeat(several, np.diff(np.append(start, len(anchor)))).astype(np.int32)
        told = anchor[start[several]]
        for at in range(0, len(anchor), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[part]), pa.array(doc[part]), pa.array(mark[part])], names)
        for at in range(0, len(told), 200_000):
            part = told[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64()), pa.array(np.full(len(part), 2, np.int32))], names)

    names = ["anchor", "doc", "mark"]
    rows = docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, "anchor bigint, doc bigint, mark int")
    w = Window.partitionBy("anchor", F.when(F.col("mark") == 1, F.col("doc")).otherwise(F.lit(-1)))
    rows = rows.withColumn("_lo", F.min("doc").over(w)).withColumn("_hi", F.max("doc").over(w)).withColumn("_told", F.max("mark").over(w))
    return rows.where((F.col("mark") == 1) | (F.col("mark") == 0) & ((F.col("_told") == 2) | (F.col("_lo") < F.col("_hi")))).select("anchor", "doc")


def _segments(texts: DataFrame) -> DataFrame:
    """What is to be compared: runs of windows by their anchor (words), or single windows of hot anchors (hashes).

    What a document repeats is one row with all its places.
    """

    def run(rows):
        for (doc, version, text, cold, hot), begin, end, hashes in hashed_rows(rows, 2):
            spots, grams = anchors(hashes)
            border = np.append(0, np.flatnonzero(np.diff(spots)) + 1)
            ends = np.append(border[1:], len(spots))
            keys = grams[spots[border]].view(np.int64)
            chosen = np.isin(keys, np.array(cold, np.int64))
            found: dict[tuple, list[int]] = {}
            a, b = border[chosen], ends[chosen]
            for key, at, n, x, y in zip(keys[chosen].tolist(), a.tolist(), (b - a).tolist(), begin[a].tolist(), end[b + WINDOW_WORDS - 2].tolist()):
                found.setdefault((key, text[x:y], n), []).append(at)
            for (key, run, n), starts in found.items():
                yield False, key, 0, doc, version, starts, n, run
            if hot:
                one, two = Hasher.grams(hashes, WINDOW_WORDS).view(np.int64), Hasher.grams(hashes ^ np.uint64(0x5555555555555555), WINDOW_WORDS).view(np.int64)
                chosen = np.isin(keys, np.array(hot, np.int64))
                found = {}
                for a, b in zip(border[chosen].tolist(), ends[chosen].tolist()):
                    for s in range(a, b):
                        found.setdefault((int(one[s]), int(two[s])), []).append(s)
                for (key, other), starts in found.items():
                    yield True, key, other, doc, version, starts, 1, None

    texts = texts.withColumn("text", F.col("text").cast("binary"))
    return map_records(texts, run, "hot boolean, key bigint, other bigint, doc bigint, version bigint, starts array<int>, n int, words binary")


def _judge(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of windows of segments, sorted by anchor, that a document with a smaller id has too.

    Reference shards are cut between anchors, so each shard's automaton holds all
    that its segments can match. Segments of an anchor that are all equal match
    each other as they are.
    """

    def shard(held: list[tuple]) -> Iterator[tuple]:
        numbers: dict[bytes, int] = {}
        lowest: dict[bytes, int] = {}
        versions: dict[int, set[bytes]] = {}
        for key, doc, _, _, _, words in held:
            versions.setdefault(key, set()).add(words)
            if doc < lowest.get(words, 1 << 62):
                lowest[words] = doc
        alike = {s for v in versions.values() if len(v) == 1 for s in v}
        coded = {s: [numbers.setdefault(w, len(numbers)) for w in s.split()] for s in lowest if s not in alike}
        automaton = Automaton()
        for s, words in coded.items():
            automaton.add(words, lowest[s])
        automaton.finish()
        firsts = {s: automaton.statistics(words, WINDOW_WORDS) for s, words in coded.items()}
        for _, doc, version, starts, n, words in held:
            if words in alike:
                if lowest[words] < doc:
                    yield doc, version, starts, n
                continue
            at, mine = -1, firsts[words]
            for i, first in enumerate(mine):
                if first < doc:
                    at = i if at < 0 else at
                elif at >= 0:
                    yield doc, version, [s + at for s in starts], i - at
                    at = -1
            if at >= 0:
                yield doc, version, [s + at for s in starts], len(mine) - at

    held, size, key = [], 0, None
    for row in rows:
        if size >= SHARD_WORDS and row[0] != key:
            yield from shard(held)
            held, size = [], 0
        key = row[0]
        held.append(row)
        size += row[4] + WINDOW_WORDS - 1
    yield from shard(held)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, version, spans (words covered) of the windows of `docs` (doc, version, text) that a smaller doc has too."""
    shared = stage(_shared_anchors(docs))
    hot = stage(shared.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_DOCUMENTS).select("anchor", F.lit(True).alias("hot")))
    few = hot.count() <= BROADCAST_ROWS
    flagged = shared.join(F.broadcast(hot) if few else hot, "anchor", "left")
    anchor = F.col("anchor")
    by_doc = flagged.groupBy("doc").agg(F.collect_list(F.when(F.col("hot").isNull(), anchor)).alias("cold"), F.collect_list(F.when(F.col("hot"), anchor)).alias("warm"))
    segments = stage(_segments(docs.select("doc", "version", "text").join(by_doc, "doc").select("doc", "version", "text", "cold", "warm")))
    cold = segments.where(~F.col("hot")).select("key", "doc", "version", "starts", "n", "words")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = map_records(cold.repartition(n, "key").sortWithinPartitions("key"), _judge, "doc bigint, version bigint, starts array<int>, n int")
    warm = segments.where("hot").select("key", "other", "doc", "version", "starts")
    first = warm.groupBy("key", "other").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    met = join_by_weight(warm, stage(first), ["key", "other"], "rows", warm.count(), "inner")
    found = found.unionByName(met.where(F.col("first") < F.col("doc")).select("doc", "version", "starts", F.lit(1).alias("n")))
    return map_records(found.groupBy("doc", "version").agg(F.collect_list(F.struct("starts", "n")).alias("runs")), _merge, "doc bigint, version bigint, spans binary")


def _merge(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The words that a document's runs of windows cover, as pairs of first word and end."""
    for doc, version, runs in rows:
        spans: list[int] = []
        for start, n in sorted((s, r["n"]) for r in runs for s in r["starts"]):
            end = start + n + WINDOW_WORDS - 1
            if spans and start <= spans[-1]:
                spans[-1] = max(spans[-1], end)
            else:
                spans += [start, end]
        yield doc, version, np.array(spans, "<i4").tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row without the words that a window shared with a smaller id covers.

    Returns `id_col`, n_words, n_removed, text (the words kept, joined by one
    space). Windows are judged on the input. Null and empty texts have no words;
    rows with the same id are not earlier than each other; a row without an id
    keeps all its words and takes none from others; other columns are not read.
    A text that a smaller id has word for word is told by its hash and loses all
    its words, without a look at its windows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text"), F.xxhash64(text, F.crc32(text.cast("binary"))).alias("version"))
    copies = rows.where(F.col("doc").isNotNull()).groupBy("version").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(F.col("first") < F.col("last")).select("version", "first")
    copies = stage(copies)
    few = copies.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(copies) if few else copies, "version", "left").withColumn("later", F.coalesce(F.col("first") < F.col("doc"), F.lit(False)))
    ranges = stage(repeated_windows(rows.where(~F.col("later") & F.col("doc").isNotNull()).select("doc", "version", "text")))
    small = (ranges.agg(F.sum(F.length("spans") + 40)).collect()[0][0] or 0) <= BROADCAST_BYTES
    ranges = F.broadcast(ranges) if small else ranges

    def run(parts):
        for doc, text, later, spans in parts:
            words = text.split()
            n, kept = len(words), words
            if later and n >= WINDOW_WORDS:
                kept = []
            elif spans:
                kept, at = [], 0
                for start, end in np.frombuffer(spans, "<i4").reshape(-1, 2).tolist():
                    kept += words[at:start]
                    at = end
                kept += words[at:]
            yield doc, n, n - len(kept), b" ".join(kept)

    out = rows.join(ranges, ["doc", "version"], "left").select("doc", F.col("text").cast("binary"), "later", "spans")
    return map_records(out, run, f"`{id_col}` bigint, n_words bigint, n_removed bigint, text binary").withColumn("text", F.col("text").cast("string"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that earlier documents have."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
