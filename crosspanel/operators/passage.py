"""First passage of a level: trees of block extremes a ticker, descended to the first bar that touches.

A node of level 1 holds RADIX bars, one of level n + 1 holds the extremes of
RADIX nodes of level n. The bars a trade may touch are at most two part-nodes a
level, met in one equality join; a hit above level 1 then goes down one level a
join. A horizon of 2,000 bars takes three levels, one of 16 bars the first only.

Paths of up to BLOCK_BARS bars need no tree: a block of bars, with those that
follow it, holds the whole path of every trade entered in it, and its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import series
from ..session import stage

RADIX = 16
# bars of a block, and of the longest path that is met in one
BLOCK_BARS = 64


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with `at`, their number in the ticker's series."""
    at = F.row_number().over(series()) - 1
    return stage(bars.select("ticker", "date", "high", "low", "close", at.cast("bigint").alias("at")))


def first_in_block(trades: DataFrame, rows: DataFrame, longest: int) -> DataFrame:
    """Trades with `_hit`, the first bar of their path that touches a level, and `_last`, the bar at the end of the path.

    `trades` hold ticker, the bar number `_at` of the entry, horizon_days of 0 to
    `longest`, target_price and stop_loss; `rows` are the `numbered` bars.
    """
    at = F.col("at")
    nodes = F.sequence(F.greatest(F.floor((at - longest) / BLOCK_BARS), F.lit(0)), F.floor(at / BLOCK_BARS))
    dealt = rows.where(F.col("ticker").isNotNull()).select("ticker", F.explode(nodes).alias("_node"), F.struct("at", "date", "high", "low", "close").alias("_b"))
    # a block has at most BLOCK_BARS + longest bars, without gaps
    blocks = dealt.groupBy("ticker", "_node").agg(F.sort_array(F.collect_list("_b")).alias("_bars"))
    t = trades.withColumn("_node", F.floor(F.col("_at") / BLOCK_BARS)).join(blocks, ["ticker", "_node"])
    begin = (F.col("_at") - F.col("_node") * BLOCK_BARS).cast("int")
    path = F.slice("_bars", begin + 2, F.greatest(F.col("horizon_days"), F.lit(0)))
    touched = F.filter(path, lambda c: (c["high"] >= F.col("target_price")) | (c["low"] <= F.col("stop_loss")))
    return t.select(*trades.columns, F.get(touched, F.lit(0)).alias("_hit"), F.get("_bars", begin + F.col("horizon_days")).alias("_last"))


def extreme_tree(bars: DataFrame, longest: int) -> list[DataFrame]:
    """Levels of (ticker, node, kids): kids are (at, high, low) of the node's children in order, as far as a path of `longest` bars can need them."""
    levels = [numbered(bars)]
    child = levels[0].select("ticker", "at", "high", "low")
    size = 1
    while True:
        # a node has at most RADIX children
        kids = F.sort_array(F.collect_list(F.struct("at", "high", "low"))).alias("kids")
        nodes = stage(child.groupBy("ticker", F.floor(F.col("at") / RADIX).alias("node")).agg(kids))
        levels.append(nodes)
        size *= RADIX
        if size >= longest:
            return levels
        child = nodes.select("ticker", F.col("node").alias("at"), F.array_max(F.col("kids.high")).alias("high"), F.array_min(F.col("kids.low")).alias("low"))


def _pieces(first: Column, last: Column, levels: int) -> Column:
    """(level, node, from, to): the children of nodes that together are the bars `first` to `last`.

    Upwards the path covers the rest of each node it starts in, downwards the
    beginning of each it ends in, and on the top level what lies between.
    """
    out = []
    a, b = first, last
    for n in range(1, levels + 1):
        na, nb = F.floor(a / RADIX), F.floor(b / RADIX)
        same = (na == nb) if n < levels else F.lit(False)
        open_ = a <= b
        if n == levels:
            # at most RADIX + 1 top nodes: the horizon fits in one, so two
            nodes = F.when(open_, F.transform(F.sequence(na, nb), lambda k: F.struct(F.lit(n).alias("level"), k.alias("node"), F.greatest(a, k * RADIX).alias("from"), F.least(b, k * RADIX + RADIX - 1).alias("to"))))
            out.append(F.coalesce(nodes, F.array().cast("array<struct<level:int,node:bigint,from:bigint,to:bigint>>")))
            break

        def part(node, lo, hi, when):
            return F.when(when, F.array(F.struct(F.lit(n).alias("level"), node.alias("node"), lo.alias("from"), hi.alias("to")))).otherwise(F.array().cast("array<struct<level:int,node:bigint,from:bigint,to:bigint>>"))

        out.append(part(na, a, b, open_ & same))
        out.append(part(na, a, na * RADIX + RADIX - 1, open_ & ~same))
        out.append(part(nb, nb * RADIX, b, open_ & ~same))
        # whole nodes between the two are children of the next level
        a, b = F.when(open_ & ~same, na + 1).otherwise(F.lit(1)), F.when(open_ & ~same, nb - 1).otherwise(F.lit(0))
        a, b = a.cast("bigint"), b.cast("bigint")
    return F.concat(*out)


def first_touch(trades: DataFrame, levels: list[DataFrame], key: str) -> DataFrame:
    """(`key`, hit_at): the first bar of each trade's path with high >= target_price or low <= stop_loss.

    `trades` is (key, ticker, first, last, target_price, stop_loss), with bar
    numbers of the ticker's path, both ends included; trades never touched give
    no row.
    """
    top = len(levels) - 1

    def touched(kids: Column) -> Column:
        return F.filter(kids, lambda c: (c["at"] >= F.col("p.from")) & (c["at"] <= F.col("p.to")) & ((c["high"] >= F.col("target_price")) | (c["low"] <= F.col("stop_loss"))))

    todo = trades.select(key, "ticker", "target_price", "stop_loss", F.explode(_pieces(F.col("first"), F.col("last"), top)).alias("p"))
    hits = []
    for n in range(1, top + 1):
        met = todo.where(F.col("p.level") == n).join(levels[n].withColumnRenamed("node", "_node"), "ticker").where(F.col("p.node") == F.col("_node"))
        met = met.withColumn("_c", F.get(touched(F.col("kids")), F.lit(0))["at"]).where(F.col("_c").isNotNull())
        hits.append(met.select(key, "ticker", "target_price", "stop_loss", F.lit(n).alias("level"), F.col("_c").alias("at"), (F.col("_c") * RADIX ** (n - 1)).alias("order")))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    # pieces don't overlap: the one that starts first holds the first touch
    first = found.groupBy(key).agg(F.min(F.struct("order", "level", "at", "ticker", "target_price", "stop_loss")).alias("b"))
    at = stage(first.select(key, "b.*").drop("order")) if top > 1 else first.select(key, "b.*").drop("order")
    for n in range(top, 1, -1):
        down = at.where(F.col("level") == n).join(levels[n - 1].withColumnRenamed("node", "_node"), "ticker").where(F.col("at") == F.col("_node"))
        child = F.filter("kids", lambda c: (c["high"] >= F.col("target_price")) | (c["low"] <= F.col("stop_loss")))
        down = down.select(key, F.lit(n - 1).alias("level"), F.get(child, F.lit(0))["at"].alias("at"), "ticker", "target_price", "stop_loss")
        at = at.where(F.col("level") != n).unionByName(down.select(*at.columns))
    return at.select(key, F.col("at").alias("hit_at"))
