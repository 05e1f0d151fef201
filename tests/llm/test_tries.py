"""The conversation trie against one built from plain sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for path in nodes:
        if path:
            below[path[:-1]].append(path)
    out, total = [], {}
    for path in sorted(nodes, key=len, reverse=True):
        members = sorted(nodes[path])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves = sum(total[p][0] for p in below[path]) or 1
        saved = (len(members) - 1) * words + sum(total[p][1] for p in below[path])
        total[path] = leaves, saved
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((members[0], len(path), min(nodes[path[:-1]]) if path else None, len(members), len(below[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    firsts = [("system", "you are a helper"), ("user", "hello there"), ("user", ""), ("user", "hello  there")]
    out = []
    for c in range(0, 160):
        if c in (60, 81):
            continue
        n = rng.choice([1, 1, 2, 3, 4, 5, 7, 9, 12])
        for i in range(n):
            role, text = rng.choice(firsts) if rng.random() < 0.75 else (rng.choice(["user", "assistant"]), f"turn {rng.randint(0, 6)}")
            out.append((c, i, role, text))
    # exact copies, some of full blocks; long ones that part late
    for c in range(200, 240):
        out += [(c, i, "user", f"copy {i}") for i in range(6)]
    for c in range(300, 312):
        out += [(c, i, "user", "same again") for i in range(24 if c % 2 else 25)] + [(c, 40, "user", f"end {c % 5}")]
    out += [(400, None, None, None), (400, 0, "user", "after null"), (400, 0, "assistant", "same turn"), (400, 0, "assistant", "same turn"), (401, 5, None, "x " * 4000), (402, None, "user", None), (402, None, "user", None)]
    out += [(None, 0, "user", "nobody's"), (501, 0, "user", "base 500 is missing"), (502, 0, "user", "so is here"), (502, 1, "user", "b"), (503, 0, "u", "a"), (503, 1, "u", "b"), (503, 2, "u", "c"), (503, 3, "u", "d")]
    return out


@pytest.mark.parametrize("block,shard_rows,long_turns", [(256, 8192, 100_000), (3, 4, 100_000), (4, 1, 10), (1, 5, 8)])
def test_trie(spark, rows, block, shard_rows, long_turns):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("code", "words", "at", "n", "block", "ids", "path", "shard", "key"):
        turns = turns.withColumn(c, F.lit("clash"))
    assert made(tries.build_trie(turns, block=block, shard_rows=shard_rows, long_turns=long_turns)) == brute(rows)


def test_equal_codes_of_different_turns(spark, rows):
    few = lambda role, text: F.pmod(F.xxhash64(role, text), F.lit(5))
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert made(tries.build_trie(turns, few, block=4, shard_rows=10)) == brute(rows)


def test_random_tables(spark):
    for seed in range(2):
        rng = random.Random(seed)
        rows = [(c, i, "u", rng.choice("ab")) for c in range(0, rng.choice([5, 60])) for i in range(rng.randint(0, 10))]
        assert made(tries.build_trie(spark.createDataFrame(rows, SCHEMA), block=rng.choice([1, 2, 5]), shard_rows=rng.choice([1, 3, 9]))) == brute(rows)


def test_empty_and_single(spark):
    assert made(tries.build_trie(spark.createDataFrame([], SCHEMA))) == []
    one = [(7, 0, "user", "only one")]
    assert made(tries.build_trie(spark.createDataFrame(one, SCHEMA))) == brute(one)


def test_search_trees_stay_balanced():
    """Siblings inserted by medians lie at logarithmic depth."""
    trees = tries.Trees()
    root = trees.node(None, -1, 0, 0)
    symbols = sorted(random.Random(1).sample(range(10**6), 1023))
    for i in tries.by_medians(len(symbols)):
        trees.insert(root, [symbols[i]], [1], i, 1, 0, 0, 0, None)
    def height(k):
        return 0 if k < 0 else 1 + max(height(trees.low[k]), height(trees.high[k]))
    assert height(trees.child[root]) == 10
