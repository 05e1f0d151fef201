"""N-gram Jaccard join: globally ordered n-gram sets in prefix trees, and the components of their links."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .base import map_records, query, table
from .substrings import Hasher
from .tokens import hashed_rows

SHINGLE_WORDS = 4
# per cent of the union that two linked sets share
PERCENT = 85
# counters that place n-grams by how often documents have them, and parts they are merged in
COUNTERS, PARTS = 1 << 20, 32
# n-grams a task counts at once
COUNTED = 250_000
# n-grams of the sets of one tree (some 50 bytes each), rows of one side of a posting block
TREE_GRAMS, BLOCK_ROWS = 600_000, 2000
# the parity bits that pairs are tested by before whole sets travel: 2 to this power times as many
FINER = 3
# a posting carries so many of its set's first n-grams
HEAD = 8
# document ids that are broadcast at most (8 bytes each); more are joined by a shuffle
BROADCAST_IDS = 1_000_000

# an n-gram is a hash of so many bits below its class
HASH_BITS = 59
_HASH = np.uint64((1 << HASH_BITS) - 1)


def needed(a: int, b: int) -> int:
    """Least overlap that links sets of these sizes: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _order(gram: int) -> int:
    """Place of a stored (signed) n-gram in the global order."""
    return gram % (1 << 64)


def prefix_length(n: int) -> int:
    """Two linked sets have a common n-gram among their first so many, in any one order."""
    return n - -(-PERCENT * n // 100) + 1


def shingles(words: np.ndarray, classes: np.ndarray | None) -> np.ndarray:
    """The distinct n-grams of a text's word hashes in the global order: by class, rare ones first, then by hash."""
    if not len(words):
        return np.zeros(0, np.uint64)
    found = np.unique(Hasher.grams(words, min(SHINGLE_WORDS, len(words))) >> np.uint64(64 - HASH_BITS))
    if classes is None:
        return found
    return np.sort(found | classes[(found & np.uint64(len(classes) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS))


def _raw():
    return F.col("text").cast("binary")


def parity(grams: np.ndarray, finer: int = 0) -> bytes:
    """Per bucket of n-grams, whether their number is odd. Two sets differ in at least as many n-grams as these bits.

    One to two buckets an n-gram, or `finer` times the power of two of that.
    """
    bits = max(128, 1 << len(grams).bit_length()) << finer
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(value: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        value = value >> bits ^ value & (1 << bits) - 1
    return value


class PrefixTree:
    """Ordered sets in a radix tree, with the components their links form.

    A search walks all sets at once: sets that share a beginning share its
    overlap, and a subtree is left when its n-grams without a partner, or the
    set's passed by, leave too little for any size below it, or when all its
    sets are in the component of the set already.
    """

    def __init__(self) -> None:
        self.parent: list[int] = []
        # node: n-grams of its edge, children by first n-gram, smallest and largest set below, set that ends here or -1, component or -1
        self.root: list = [[], {}, 1 << 60, 0, -1, -2]

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, grams: list[int]) -> int:
        """Link a set, at least as long as those before it, to all it matches, and keep it."""
        me = len(self.parent)
        self.parent.append(me)
        n, own, find = len(grams), set(grams), self.find
        least = -(-PERCENT * n // 100)
        mine = me
        todo = [(self.root, 0, 0)]
        while todo:
            node, shared, depth = todo.pop()
            for child in node[1].values():
                if child[3] < least or child[5] >= 0 and find(child[5]) == mine:
                    continue
                edge = child[0]
                got, deep = shared + len(own.intersection(edge)), depth + len(edge)
                if deep - got > child[3] - needed(n, child[3]):
                    continue
                if bisect_right(grams, edge[-1]) - got > n - needed(n, max(child[2], least)):
                    continue
                if child[4] >= 0 and 100 * got >= PERCENT * (n + deep - got):
                    a, b = find(child[4]), mine
                    if a != b:
                        mine = min(a, b)
                        self.parent[max(a, b)] = mine
                if child[1]:
                    todo.append((child, got, deep))
        self._insert(grams, me)
        return me

    def _insert(self, grams: list[int], me: int) -> None:
        n, at, node, mine = len(grams), 0, self.root, self.find(me)
        while True:
            node[2], node[3] = min(node[2], n), max(node[3], n)
            if node[5] != -1 and node is not self.root and self.find(node[5]) != mine:
                node[5] = -1
            if at == n:
                node[4] = me
                return
            child = node[1].get(grams[at])
            if child is None:
                node[1][grams[at]] = [grams[at:], {}, n, n, me, mine]
                return
            edge = child[0]
            k = 1
            while k < len(edge) and at + k < n and edge[k] == grams[at + k]:
                k += 1
            if k < len(edge):
                node[1][grams[at]] = [edge[:k], {edge[k]: child}, child[2], child[3], -1, child[5]]
                child[0] = edge[k:]
                child = node[1][grams[at]]
            at += k
            node = child


def _classes(docs: DataFrame) -> np.ndarray:
    """For each counter, by a part of the hash, the power of two of the documents that have one of its n-grams.

    The class puts n-grams in order, rare ones first, so a set's prefix holds
    its rarest n-grams and few sets meet at one. Rare n-grams that share a
    counter only lose their place: any order is right. Tasks count their own
    documents; counters are summed on executors, and a byte for each reaches the
    driver.
    """

    def run(rows):
        counts, found, size = np.zeros(COUNTERS, np.uint32), [], 0
        for _, _, _, words in hashed_rows(rows, 0, lower=True):
            found.append((shingles(words, None) & np.uint64(COUNTERS - 1)).astype(np.int64))
            size += len(found[-1])
            if size >= COUNTED:
                counts += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
                found, size = [], 0
        if found:
            counts += np.bincount(np.concatenate(found), minlength=COUNTERS).astype(np.uint32)
        if counts.any():
            for part, c in enumerate(np.split(counts, PARTS)):
                # most counts of a task are small
                yield part, zlib.compress(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)

    def merge(rows):
        at, total = None, None
        for part, packed in rows:
            c = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
            if part != at:
                if at is not None:
                    yield at, np.frexp(total.astype(float))[1].astype(np.uint8).tobytes()
                at, total = part, np.zeros(len(c), np.int64)
            total += c
        if at is not None:
            yield at, np.frexp(total.astype(float))[1].astype(np.uint8).tobytes()

    counts = map_records(docs.select(_raw()), run, "part int, counts binary")
    merged = map_records(counts.repartition(PARTS, "part").sortWithinPartitions("part"), merge, "part int, classes binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in merged:
        out[r["part"] * (COUNTERS // PARTS) : (r["part"] + 1) * (COUNTERS // PARTS)] = np.frombuffer(r["classes"], np.uint8)
    # five bits: from 2^31 documents on all are as frequent
    return np.minimum(out, 31)


def _sketches(docs: DataFrame, classes) -> DataFrame:
    """doc, n, set id, n-gram of the smallest hash, prefix of the set and its parity bits."""

    def run(rows):
        for (doc, version, _), _, _, words in hashed_rows(rows, 2, lower=True):
            grams = shingles(words, classes.value)
            n = len(grams)
            one, two = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), "<i8").tolist()
            head = grams[: prefix_length(n)].view(np.int64).tolist() if n else []
            low = int((grams & _HASH).min()) if n else 0
            yield doc, version, n, one, two, low, head, parity(grams) if n else b""

    return map_records(docs.select("doc", "version", _raw()), run, "doc bigint, version bigint, n int, one bigint, two bigint, low bigint, head array<bigint>, bits binary")


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of `docs` (doc, version, text) with the doc and version of `keys`."""
    few = keys.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, ["doc", "version"])


def _sets(docs: DataFrame, classes, extra: list[str], kinds: str) -> DataFrame:
    """`extra` columns, finer parity bits and the whole set of each row, as bytes of the ordered n-grams."""

    def run(rows):
        for (_, *row), _, _, words in hashed_rows(rows, 0, lower=True):
            grams = shingles(words, classes.value)
            yield (*row, parity(grams, FINER), grams.tobytes())

    return map_records(docs.select(_raw(), *extra), run, f"{kinds}, fine binary, grams binary")


def _tree_join(rows: Iterator[tuple]) -> Iterator[tuple]:
    """All links among sets of one smallest hash, shortest first; large groups are cut into trees of TREE_GRAMS n-grams."""
    tree, held, key, size = None, [], None, 0

    def done() -> Iterator[tuple]:
        chunk = held[0]
        for i, me in enumerate(held):
            yield me, chunk, held[tree.find(i)]

    for first, salt, _, me, raw in rows:
        if tree is None or (first, salt) != key or size >= TREE_GRAMS:
            if held:
                yield from done()
            tree, held, key, size = PrefixTree(), [], (first, salt), 0
        size += len(raw) // 8
        tree.add(np.frombuffer(raw, np.uint64).tolist())
        held.append(me)
    if held:
        yield from done()


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs of one n-gram's sets that can be linked and no tree has compared."""

    def pairs(gram: int, block: tuple[int, int], held: list[tuple]) -> Iterator[tuple]:
        sides = [held, held] if block[0] == block[1] else [[r for r in held if r[0] == b] for b in block]
        for i, (_, n, me, pos, comp, chunk, head, bits, size) in enumerate(sides[0]):
            heads = frozenset(head)
            for _, n2, me2, pos2, comp2, chunk2, head2, bits2, size2 in sides[1][i + 1 :] if block[0] == block[1] else sides[1]:
                if comp == comp2 or chunk == chunk2:
                    continue
                small, large = (n, n2) if n <= n2 else (n2, n)
                if 100 * small < PERCENT * large:
                    if n2 > n:
                        break
                    continue
                need = needed(n, n2)
                # at the first common n-gram no more than what follows can be shared
                if min(n - pos, n2 - pos2) < need:
                    continue
                # the first common n-gram of both heads, if any, is where a pair is looked at
                if not heads.isdisjoint(head2) and min(heads.intersection(head2), key=_order) != gram:
                    continue
                to = min(size, size2)
                if (folded(bits, size, to) ^ folded(bits2, size2, to)).bit_count() > n + n2 - 2 * need:
                    continue
                yield (me, me2) if me < me2 else (me2, me)

    key, held, seen = None, [], set()

    def flush() -> Iterator[tuple]:
        for p in pairs(key[0], key[1:], held):
            if p not in seen:
                seen.add(p)
                yield p
        if len(seen) > 200_000:
            seen.clear()

    for gram, one, two, own, n, me, pos, comp, chunk, head, bits in rows:
        if (gram, one, two) != key:
            if len(held) > 1:
                yield from flush()
            key, held = (gram, one, two), []
        held.append((own, n, me, pos, comp, chunk, head, int.from_bytes(bits, "little"), 8 * len(bits)))
    if len(held) > 1:
        yield from flush()


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes of `edges` (a, b): the smallest node they reach.

    Each round points every node at the smallest neighbour of its neighbours and
    halves the paths; the edges are written to the shared folder between rounds.
    """
    links = stage(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: neighbours above a node point at its smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large)
        # small star: a node and its smaller neighbours point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        small = stage(small)
        same = small.count() == links.count() and small.exceptAll(links).isEmpty()
        links = small
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def link_sets(docs: DataFrame) -> DataFrame:
    """doc, version, n_shingles, root and root_version (smallest doc, then version reachable by links) of `docs` (doc, version, text).

    Sets that are equal are one from the start. Sets with the same smallest hash,
    as most near copies have, meet whole in a prefix tree. Any other linked pair has a common n-gram in its two
    prefixes: these postings carry parity bits, which rule out unlike sets, and
    only sets of different components are compared further, by their whole sets.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(_classes(docs))
    sketches = stage(_sketches(docs, classes))
    me = F.struct("doc", "version")
    # equal sets: one row each, named by a number in the order of its smallest document
    same = sketches.where(F.col("n") > 0).groupBy("one", "two", "n", "low", "head", "bits").agg(F.min(me).alias("me"))
    sets = stage(same.select("one", "two", "n", "low", "head", "bits", F.col("me.doc").alias("doc"), F.col("me.version").alias("version")).withColumn("me", F.monotonically_increasing_id()))
    sizes = sets.groupBy(F.col("low").alias("first")).agg(F.count("*").alias("sets"), F.sum("n").alias("grams")).where(F.col("sets") > 1)
    # a large group is dealt out by another n-gram, which near copies often share too
    salt = F.pmod(F.coalesce(F.element_at("head", -1), F.lit(0)), F.ceil(F.col("grams") / TREE_GRAMS))
    met = stage(sets.select("doc", "version", "me", "head", F.col("low").alias("first")).join(sizes, "first").select("doc", "version", "me", "first", salt.alias("salt")))
    # in trees n-grams are in the order of their hashes alone, so near copies share their beginnings
    whole = _sets(_texts_of(docs, met), spark.sparkContext.broadcast(None), ["first", "salt", "me"], "first bigint, salt bigint, me bigint").dropDuplicates(["me"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.withColumn("n", F.length("grams")).select("first", "salt", "n", "me", "grams").repartition(parts, "first", "salt").sortWithinPartitions("first", "salt", "n", "me")
    trees = stage(map_records(ordered, _tree_join, "me bigint, chunk bigint, comp bigint"))
    # postings of n-grams that sets of several components have
    known = sets.join(trees, "me", "left").select("me", "doc", "version", "n", "head", "bits", F.coalesce("chunk", F.col("me")).alias("chunk"), F.coalesce("comp", F.col("me")).alias("comp"))
    known = stage(known)
    postings = known.select("me", "comp", F.posexplode("head").alias("pos", "gram"))
    wanted = postings.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where(F.col("lo") < F.col("hi"))
    blocks = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    wanted = wanted.select("gram", blocks.alias("blocks"))
    places = postings.join(wanted, "gram").groupBy("me").agg(F.collect_list(F.struct("gram", "pos", "blocks")).alias("places"))
    rows = known.join(places, "me").select("me", "n", "comp", "chunk", F.slice("head", 1, HEAD).alias("head"), "bits", F.explode("places").alias("p"))
    own = F.pmod(F.xxhash64("me"), F.col("p.blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    rows = rows.select("p.gram", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "n", "me", "p.pos", "comp", "chunk", "head", "bits")
    rows = rows.repartition(parts, "gram", "b1", "b2").sortWithinPartitions("gram", "b1", "b2", "n", "me")
    pairs = stage(map_records(rows, _pairs, "a bigint, b bigint").distinct())
    # whole sets of the pairs left
    ends = pairs.select(F.col("a").alias("me")).union(pairs.select(F.col("b").alias("me"))).distinct()
    ends = stage(known.select("me", "doc", "version", "comp").join(ends, "me"))
    whole = stage(_sets(_texts_of(docs, ends), classes, ["me", "comp"], "me bigint, comp bigint").dropDuplicates(["me"]))
    side = lambda c, *more: whole.select(F.col("me").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in more])

    def like(part):
        for a, b, m, n, x, y in part:
            to = 8 * min(len(x), len(y))
            odd = folded(int.from_bytes(x, "little"), 8 * len(x), to) ^ folded(int.from_bytes(y, "little"), 8 * len(y), to)
            if odd.bit_count() <= m + n - 2 * needed(m, n):
                yield a, b

    # the finer bits first: few pairs are left whose whole sets have to meet
    size = (F.length("grams") / 8).cast("int")
    first, second = [whole.select(F.col("me").alias(c), F.col("fine").alias(f"fine_{c}"), size.alias(f"size_{c}")) for c in "ab"]
    tested = pairs.join(first, "a").join(second, "b").select("a", "b", "size_a", "size_b", "fine_a", "fine_b")
    pairs = stage(map_records(tested, like, "a bigint, b bigint"))
    tested = pairs.join(side("a", "comp", "grams"), "a").join(side("b", "comp", "grams"), "b").where(F.col("comp_a") != F.col("comp_b"))

    def verify(part):
        for a, b, x, y in part:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y)):
                yield a, b

    found = map_records(tested.select("comp_a", "comp_b", "grams_a", "grams_b"), verify, "a bigint, b bigint")
    roots = components(found)
    # back to documents: a component's smallest document, by set, by equal sets
    top = known.select("me", "doc", "version", "comp").join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("me", "doc", "version", F.coalesce("root", F.col("comp")).alias("top"))
    least = top.groupBy("top").agg(F.min(F.struct("doc", "version")).alias("r"))
    by_set = sets.select("one", "two", "me").join(top.select("me", "top"), "me").join(least, "top").select("one", "two", F.col("r.doc").alias("root"), F.col("r.version").alias("root_version"))
    return sketches.join(by_set, ["one", "two"], "left").select("doc", "version", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("root", F.col("doc")).alias("root"), F.coalesce("root_version", F.col("version")).alias("root_version"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, version, text: the key of a row is its id and the hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_shingles, component_id of every row.

    A text's set is its distinct runs of SHINGLE_WORDS words (A-Z in lower
    case), or all its words if it has fewer. Texts link when their sets share
    PERCENT per cent of their union. A null or empty text has an empty set and is
    linked with nothing; equal texts are linked; repeated rows give repeated
    results; other columns are not read. A row without an id has no component
    and links nothing.
    """
    rows = keyed(docs, id_col, text_col)
    found = link_sets(rows.where(F.col("doc").isNotNull()))
    out = found.select(F.col("doc").alias(id_col), "n_shingles", F.col("root").alias("component_id"))
    none = rows.where(F.col("doc").isNull()).select(F.col("doc").alias(id_col), "text")
    hashed = map_records(none.select(_raw(), id_col), lambda part: ((row[1], len(shingles(words, None)), None) for row, _, _, words in hashed_rows(part, 0, lower=True)), f"`{id_col}` bigint, n_shingles bigint, component_id bigint")
    return out.unionByName(hashed)


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
