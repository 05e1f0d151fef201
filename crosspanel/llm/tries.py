"""Prefix trie over conversations: shared beginnings, their members and what storing them once saves.

Turns become integers by a dictionary, conversations sequences of them. Equal
sequences are counted before they meet; the distinct ones are cut into range
shards by sort order. Each shard builds ternary search trees, inserting its
sorted sequences by medians, and one pass back over the nodes adds up members,
leaves and savings. Only nodes on a shard's first and last path can also lie in
another shard: these are merged by key afterwards.

Conversations of any length are cut into blocks of BLOCK turns. Every block is a
sequence of its own under the key of all turns before it, so no row and no task
holds a whole long conversation. What later blocks add to the nodes of earlier
ones follows from the conversations: each node's own leaf and saving is credited
to its smallest member, and a node's subtree is the sum over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stage
from .base import join_by_weight, map_records, query, table

BLOCK = 256
# distinct sequences of a shard, about
SHARD_ROWS = 8192
# turns from which a conversation's order is found by range shards instead of one sort
LONG_TURNS = 100_000
# boundary nodes that are broadcast at most, some 300 bytes each
BROADCAST_NODES = 100_000
# beginnings come from conversations with ids divisible by this, at most this many turns less one
GROUP, HEADS = 20, 4

_NODE = "shard int, key string, above string, fold boolean, sub boolean, conv_id bigint, depth bigint, above_id bigint, n_convs bigint, n_children bigint, words bigint, ends string, more boolean, n_leaves bigint, saved bigint"


def turn_code(role: Column, text: Column) -> Column:
    """Hash of a turn in 63 bits; different turns of one hash get negative numbers."""
    return F.xxhash64(role, text).bitwiseAND(F.lit((1 << 63) - 1))


def encode_turns(turns: DataFrame, code=turn_code) -> DataFrame:
    """Add `code`: equal for equal (role, text) only, and `words`, the words of the text.

    The dictionary groups whole turns by their hash. A hash that names several
    turns is replaced by numbers below zero, one a turn.
    """
    words = F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')").cast("bigint")
    turns = turns.withColumn("code", code(F.col("role"), F.col("text"))).withColumn("words", words)
    entries = turns.select("code", "role", "text").distinct()
    several = stage(entries.groupBy("code").count().where(F.col("count") > 1).select("code"))
    if several.isEmpty():
        return turns
    named = stage(entries.join(several, "code", "left_semi").withColumn("own", -1 - F.monotonically_increasing_id()))
    return turns.join(named, ["code", "role", "text"], "left").withColumn("code", F.coalesce("own", "code")).drop("own")


def number_turns(turns: DataFrame, convs: DataFrame, long_turns: int = LONG_TURNS) -> DataFrame:
    """Add `at`, a turn's place in its conversation from 1, by turn (null first), role and text.

    Conversations of `long_turns` and more are sorted over range shards; a
    shard's offset is the number of the conversation's turns in shards before.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    kept = ["conv_id", "code", "words", "at"]
    long = stage(convs.where(F.col("n") >= long_turns).select("conv_id"))
    if long.isEmpty():
        return turns.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("bigint")).select(*kept)
    # there are at most turns / long_turns of them
    rest = turns.join(F.broadcast(long), "conv_id", "left_anti").withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).cast("bigint"))
    rows = stage(turns.join(F.broadcast(long), "conv_id", "left_semi").withColumn("salt", F.monotonically_increasing_id()))
    shards = max(2, rows.count() // long_turns * 4)
    keys = [F.col("conv_id"), *order, F.col("salt")]
    placed = stage(rows.repartitionByRange(shards, *keys).withColumn("shard", F.spark_partition_id()))
    sizes = placed.groupBy("conv_id", "shard").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    # at most two long conversations begin or end in a shard beside those within it: few rows
    inner = placed.withColumn("rn", F.row_number().over(W.partitionBy("conv_id", "shard").orderBy(*order, "salt")))
    found = inner.join(before, ["conv_id", "shard"]).withColumn("at", (F.col("rn") + F.col("before")).cast("bigint"))
    return rest.select(*kept).unionByName(found.select(*kept))


def rebuild(turns: DataFrame, code=turn_code, long_turns: int = LONG_TURNS, block: int = BLOCK) -> DataFrame:
    """(conv_id, block, ids, words, last): the rebuilt conversations in blocks of turns, one row at least for each.

    Conversation c begins with the first crc32(c) % 4 turns of conversation
    c - c % 20, or all if it has fewer, and goes on with its own after as many.
    """
    src = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = src.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = stage(convs.withColumn("base", base).withColumn("h", h))
    placed = stage(number_turns(encode_turns(src, code), convs, long_turns))
    first = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "code", "words"))).alias("head"))
    heads = convs.join(first, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.expr("array()")))
    heads = heads.withColumn("total", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).withColumn("shift", F.size("head") - F.col("h"))
    heads = stage(heads.select("conv_id", "n", "h", "total", "shift", "head"))
    n = placed.groupBy().count()
    # where the beginning is shorter than it should be, own turns move up
    moved = heads.where(F.col("shift") != 0).select("conv_id", "n", "shift")
    own = join_by_weight(placed.where(F.col("at") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS), moved, "conv_id", "n", n.first()[0])
    own = own.select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "code", "words")
    given = heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.at").cast("bigint").alias("at"), "t.code", "t.words")
    rows = own.unionByName(given).withColumn("block", F.floor((F.col("at") - 1) / block).cast("bigint"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "code", "words"))).alias("turns"))
    bare = heads.where(F.col("total") == 0).select("conv_id", F.lit(0).cast("bigint").alias("block"), F.expr("cast(array() as array<bigint>)").alias("ids"), F.expr("cast(array() as array<bigint>)").alias("words"), F.lit(True).alias("last"))
    full = blocks.select("conv_id", "block", F.col("turns.code").alias("ids"), F.col("turns.words").alias("words"))
    # a block with fewer turns than a full one is the last; full ones ask for the length
    short = full.where(F.size("ids") < block).withColumn("last", F.lit(True))
    whole = full.where(F.size("ids") == block).join(heads.where(F.col("total") >= block).select("conv_id", "total"), "conv_id")
    whole = whole.withColumn("last", (F.col("block") + 1) * block == F.col("total")).drop("total")
    return short.unionByName(whole).unionByName(bare)


def _digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")).cast("binary"), 256)


def add_keys(blocks: DataFrame) -> DataFrame:
    """Add `before`, the key of all turns before a block (empty for none), and `path`, that of all up to its end."""
    blocks = stage(blocks.withColumn("digest", _digest(F.col("ids"))))
    path = F.sha2(F.concat("before", "digest").cast("binary"), 256)
    several = blocks.where(F.col("block") > 0)
    one = blocks.where(F.col("block") == 0).withColumn("before", F.lit(""))
    if several.isEmpty():
        return one.withColumn("path", path).drop("digest")

    def chain(rows: Iterator[tuple]) -> Iterable[tuple]:
        at, held = None, ""
        for conv, block, digest in rows:
            if conv != at:
                at, held = conv, ""
            yield conv, block, held
            held = hashlib.sha256((held + digest).encode()).hexdigest()

    # digests only, some 100 bytes for BLOCK turns, in order of their conversation
    long = several.select("conv_id").distinct()
    links = blocks.join(long, "conv_id", "left_semi").select("conv_id", "block", "digest").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    linked = stage(map_records(links, chain, "conv_id bigint, block bigint, before string").where(F.col("block") > 0))
    return one.unionByName(several.join(linked, ["conv_id", "block"])).withColumn("path", path).drop("digest")


def ends_hashes(keyed: DataFrame) -> DataFrame:
    """(path, ends): SHA-256 of the ids of conversations that end there, ascending and comma-joined.

    Ids stream through a running hash in sort order. A hash is one sequence of
    steps, so the ids of one end are one task's work, but never in memory.
    """

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        at, held = None, None
        for path, conv in rows:
            if path != at:
                if at is not None:
                    yield at, held.hexdigest()
                at, held = path, hashlib.sha256(str(conv).encode())
            else:
                held.update(b",%d" % conv)
        if at is not None:
            yield at, held.hexdigest()

    ids = keyed.where("last").select("path", "conv_id").repartition("path").sortWithinPartitions("path", "conv_id")
    return map_records(ids, run, "path string, ends string")


def distinct_sequences(keyed: DataFrame) -> DataFrame:
    """One row a sequence: (before, block, ids, words, path, conv_id, n, n_more, leaves, saved, ends).

    `keyed` may have `leaves` and `saved`: what the conversation's later blocks
    add to all nodes before them.
    """
    total = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    one = keyed.groupBy("before", "block", "ids", "words", "path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.sum((~F.col("last")).cast("bigint")).alias("n_more"), *total)
    return one.join(ends_hashes(keyed), "path", "left")


class Trees:
    """Ternary search trees of a shard's sequences, as columns: a node's symbol, its siblings below and above, and its first child."""

    def __init__(self) -> None:
        self.sym, self.low, self.high, self.child = [], [], [], []
        self.above, self.depth, self.words = [], [], []
        self.n, self.conv, self.ends, self.more = [], [], [], []
        self.leaves, self.saved, self.key, self.children = [], [], [], []

    def node(self, sym, above: int, depth: int, words: int) -> int:
        for column, value in ((self.sym, sym), (self.low, -1), (self.high, -1), (self.child, -1), (self.above, above), (self.depth, depth), (self.words, words), (self.n, 0), (self.conv, None),
                              (self.ends, None), (self.more, False), (self.leaves, 0), (self.saved, 0), (self.key, None), (self.children, 0)):
            column.append(value)
        return len(self.sym) - 1

    def insert(self, root: int, ids, words, conv, n, n_more, leaves, saved, ends) -> int:
        """Add a sequence with its `n` members; returns its last node."""
        at = root
        self._count(at, n, conv)
        sym, low, high, child = self.sym, self.low, self.high, self.child
        depth = self.depth[root]
        for i, x in enumerate(ids):
            depth += 1
            k = child[at]
            if k < 0:
                k = child[at] = self.node(x, at, depth, words[i])
            else:
                while sym[k] != x:
                    side = low if x < sym[k] else high
                    if side[k] < 0:
                        side[k] = self.node(x, at, depth, words[i])
                    k = side[k]
            at = k
            self._count(at, n, conv)
        self.ends[at], self.more[at] = ends, n_more > 0
        self.leaves[at], self.saved[at] = leaves, saved
        return at

    def _count(self, at: int, n: int, conv: int) -> None:
        self.n[at] += n
        held = self.conv[at]
        self.conv[at] = conv if held is None or conv < held else held

    def path(self, at: int) -> list[int]:
        """Nodes from the root to `at`."""
        out = []
        while at >= 0:
            out.append(at)
            at = self.above[at]
        return out[::-1]

    def add_up(self) -> None:
        """Children, leaves and savings of whole subtrees; nodes with a key keep theirs from the nodes above.

        A node is made after the one above it, so one pass from the last to the
        first has each subtree complete before it is added on.
        """
        for at in range(len(self.sym) - 1, -1, -1):
            if self.key[at] is None:
                self.leaves[at] += self.children[at] == 0 and not self.more[at]
                self.saved[at] += (self.n[at] - 1) * self.words[at]
            above = self.above[at]
            if above >= 0 and self.key[at] is None:
                self.children[above] += 1
                self.leaves[above] += self.leaves[at]
                self.saved[above] += self.saved[at]


def by_medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle of every range before its halves, which keeps search trees of sorted rows balanced."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            ranges += [(mid + 1, b), (a, mid)]


def _prefix_key(before: str, ids, n: int) -> str:
    return hashlib.sha256(f"{before}/{','.join(map(str, ids[:n]))}".encode()).hexdigest() if n else before


def shard_nodes(rows: list[tuple], block: int) -> Iterable[tuple]:
    """Nodes of one shard's sorted sequences; those with a key are to be merged with other shards'."""
    trees, at, ends = Trees(), 0, []
    shard = rows[0][0]
    full = {}
    while at < len(rows):
        before, start = rows[at][1], at
        while at < len(rows) and rows[at][1] == before:
            at += 1
        group = rows[start:at]
        root = trees.node(None, -1, group[0][2] * block, 0)
        # the beginning of a later block is the end of an earlier one
        trees.key[root] = before
        for i in by_medians(len(group)):
            _, _, _, ids, words, path, *rest = group[i]
            leaf = trees.insert(root, ids, words, *rest)
            if rest[2]:
                full[leaf] = path
            if start + i in (0, len(rows) - 1):
                ends.append((leaf, before, ids))
    for leaf, before, ids in ends:
        for k, node in enumerate(trees.path(leaf)):
            trees.key[node] = _prefix_key(before, ids, k)
    on_path = {node for leaf, _, _ in ends for node in trees.path(leaf)}
    # where conversations go on, the key is that of the next block's beginning
    for leaf, path in full.items():
        if leaf in on_path:
            trees.key[leaf] = path
    trees.add_up()
    for i in range(len(trees.sym)):
        above = trees.above[i]
        fold = trees.key[i] is not None
        if above < 0 and trees.depth[i] > 0:
            yield shard, trees.key[i], None, False, True, None, trees.depth[i], None, 0, trees.children[i], 0, None, True, 0, 0
            continue
        # an end of a full block off the two paths is already part of the node above; only its own saving is added when merged
        saved = trees.saved[i] - (0 if fold or i not in full else (trees.n[i] - 1) * trees.words[i])
        yield (shard, full.get(i, trees.key[i]), trees.key[above] if above >= 0 else None, fold, False, trees.conv[i], trees.depth[i], trees.conv[above] if above >= 0 else None, trees.n[i],
               trees.children[i], trees.words[i], trees.ends[i], trees.more[i], trees.leaves[i], saved)


def _build(sequences: DataFrame, block: int, shard_rows: int) -> DataFrame:
    """Nodes of all range shards, staged; see `shard_nodes`."""
    sequences = stage(sequences)
    shards = max(1, -(-sequences.count() // shard_rows))
    columns = ["shard", "before", "block", "ids", "words", "path", "conv_id", "n", "n_more", "leaves", "saved", "ends"]
    # equal keys don't occur: `before` and `ids` name a sequence
    placed = sequences.repartitionByRange(shards, "before", "ids").sortWithinPartitions("before", "ids").withColumn("shard", F.spark_partition_id()).select(*columns)

    def run(rows: Iterator[tuple]) -> Iterable[tuple]:
        held = list(rows)
        return shard_nodes(held, block) if held else ()

    return stage(map_records(placed, run, _NODE))


def _merge(nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inner nodes as they are, parts of boundary nodes, and the boundary nodes by key with members and children merged."""
    inner, parts = nodes.where(F.col("key").isNull()), nodes.where(F.col("key").isNotNull())
    below = parts.where(F.col("fold") & F.col("above").isNotNull()).select(F.col("above").alias("key"), F.col("key").alias("child")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("beside"))
    first = F.min(F.when(~F.col("sub"), F.struct("conv_id", "shard"))).alias("first")
    merged = parts.groupBy("key").agg(first, F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("private"), F.max("words").alias("words"), F.max("ends").alias("ends"),
                                      F.max("depth").alias("depth"), F.max("above").alias("above"), F.max(F.when(~F.col("sub"), F.col("above_id"))).alias("above_id"))
    merged = merged.join(below, "key", "left").withColumn("n_children", F.col("private") + F.coalesce("beside", F.lit(0))).drop("private", "beside")
    return inner, parts, stage(merged)


def _own(merged: DataFrame) -> DataFrame:
    """A boundary node's own leaf and saving, credited to the shard of its smallest member."""
    return merged.select("key", F.col("first.shard").alias("at_shard"), (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))


def _totals(parts: DataFrame, merged: DataFrame, block: int) -> DataFrame:
    """(key, n_leaves, saved): subtrees of boundary nodes, summed over shards."""
    rows = parts.where(~F.col("sub")).join(_own(merged), "key")
    rows = rows.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("shard") == F.col("at_shard"), F.col("leaf")).otherwise(0)).withColumn("saved", F.col("saved") + F.when(F.col("shard") == F.col("at_shard"), F.col("gain")).otherwise(0))

    def fold(rows: Iterator[tuple]) -> Iterable[tuple]:
        """Rows of a shard from the deepest up; a part is added to the boundary node above it."""
        at, open_rows = None, {}
        for shard, key, above, leaves, saved in rows:
            if shard != at:
                at, open_rows = shard, {}
            more = open_rows.pop(key, (0, 0))
            leaves, saved = leaves + more[0], saved + more[1]
            yield key, leaves, saved
            if above is not None:
                held = open_rows.get(above, (0, 0))
                open_rows[above] = held[0] + leaves, held[1] + saved

    # a shard has at most two paths of boundary nodes, and ends of full blocks without one above;
    # the beginning of a later block adds nothing on: its conversations brought that along
    up = F.col("fold") & ((F.col("depth") == 1) | ((F.col("depth") - 1) % block != 0))
    order = rows.select("shard", "key", F.when(up, F.col("above")).alias("above"), "n_leaves", "saved", "depth").repartition("shard").sortWithinPartitions("shard", F.desc("depth")).drop("depth")
    return map_records(order, fold, "key string, n_leaves bigint, saved bigint").groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _later(nodes: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """(conv_id, block, leaves, saved): what nodes of later blocks are credited to the conversation."""
    inner, _, merged = _merge(nodes)
    at = F.floor((F.col("depth") - 1) / block).cast("bigint").alias("block")
    own = inner.select("conv_id", at, ((F.col("n_children") == 0) & ~F.col("more")).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    # beginnings of later blocks without a row of the block before are counted there
    edge = merged.where(F.col("first").isNotNull()).select(F.col("first.conv_id").alias("conv_id"), at, (F.col("n_children") == 0).cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("gain"))
    none = blocks.select("conv_id", "block", F.lit(0).cast("bigint").alias("leaf"), F.lit(0).cast("bigint").alias("gain"))
    by_block = own.unionByName(edge).unionByName(none).groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("gain").alias("gain"))
    after = W.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    return by_block.select("conv_id", "block", F.coalesce(F.sum("leaf").over(after), F.lit(0)).alias("leaves"), F.coalesce(F.sum("gain").over(after), F.lit(0)).alias("saved"))


def build_trie(turns: DataFrame, code=turn_code, block: int = BLOCK, shard_rows: int = SHARD_ROWS, long_turns: int = LONG_TURNS) -> DataFrame:
    """Every node of the trie over the rebuilt conversations of (conv_id, turn, role, text).

    Turns are ordered by turn (null first), equal ones by role and text; null
    role and text are empty, repeated rows are turns of their own. Rows without
    a conv_id belong to no conversation. An empty table has no node, not even a
    root. Extra columns are ignored.
    """
    keyed = stage(add_keys(rebuild(turns, code, long_turns, block)))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("leaves", "saved")]
    long = keyed.where(F.col("block") > 0)
    if long.isEmpty():
        counted = keyed.select("*", *zero)
    else:
        later = stage(_later(_build(distinct_sequences(long.select("*", *zero)), block, shard_rows), long.select("conv_id", "block").unionByName(long.select("conv_id", F.lit(0).cast("bigint").alias("block"))).distinct(), block))
        counted = stage(keyed.join(later, ["conv_id", "block"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("leaves", "saved")}))
    inner, parts, merged = _merge(_build(distinct_sequences(counted), block, shard_rows))
    known = merged.select(F.col("key").alias("above"), F.col("first.conv_id").alias("merged_id"))
    known = F.broadcast(known) if merged.count() <= BROADCAST_NODES else known
    nodes = inner.select("conv_id", "depth", "above", "above_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    edges = merged.join(_totals(parts, merged, block), "key").select(F.col("first.conv_id").alias("conv_id"), "depth", "above", "above_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
    nobody = hashlib.sha256(b"").hexdigest()
    return nodes.unionByName(edges).join(known, "above", "left").select("conv_id", "depth", F.coalesce("merged_id", "above_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(nobody)).alias("ends_sha256"))


@query("op13_prefix_trie")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_trie(table(spark, sf_dir, "conversations"))
