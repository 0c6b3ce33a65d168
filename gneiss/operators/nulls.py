"""Matched null children of a panel or sequence: portable permutations ordered by md5, and their variants."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hashed(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ``|``: an order that every engine can repeat."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def digests(prefix: str, ends: list[bytes]) -> np.ndarray:
    """md5 of the prefix with each end, 16 bytes a row."""
    start = prefix.encode()
    return np.frombuffer(b"".join([hashlib.md5(start + e).digest() for e in ends]), np.uint8).reshape(-1, 16)


def md5_order(prefix: str, ends: list[bytes], places: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
    """Ranks of ``permuted_within`` in arrays: places by md5 of prefix and end, group by group."""
    high, low = digests(prefix, ends).view(">u8").astype(np.uint64).T
    return np.lexsort((places, low, high) if groups is None else (places, low, high, groups))


def draw(n: Column | int, *parts: Column | str | int) -> Column:
    """A whole number in [0, n) from the first 12 hex digits of ``hashed``."""
    return F.pmod(F.conv(F.substring(hashed(*parts), 1, 12), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def with_children(rows: DataFrame, children: int) -> DataFrame:
    """Repeat rows for child = 1..children by a generator, which needs no join."""
    return rows.withColumn("child", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(children).cast("long"))))


def permuted_within(rows: DataFrame, keys: list[str], index: str, strata: list[Column], children: int, *, seed: str, value: str = "value") -> DataFrame:
    """Null children whose values are permuted within strata of a key: (keys, child, index, value).

    Positions keep their calendar order; values go to them in md5 order of (seed, child, key, index). The two
    rankings share one partitioning by (keys, child, stratum).
    """
    named = [s.alias(f"_s{k}") for k, s in enumerate(strata)]
    base = with_children(rows.select(*keys, index, value, *named), children)
    group = [*keys, "child", *(f"_s{k}" for k in range(len(strata)))]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(index))
    order = F.row_number().over(Window.partitionBy(*group).orderBy(hashed(seed, F.col("child"), *(F.col(k) for k in keys), F.col(index)), index))
    ranked = base.withColumn("_place", place).withColumn("_order", order)
    targets = ranked.select(*group, F.col(index), F.col("_place").alias("_rank"))
    sources = ranked.select(*group, F.col(value), F.col("_order").alias("_rank"))
    return targets.join(sources, [*group, "_rank"]).select(*keys, "child", index, value)


def month_strata_nulls(panel: DataFrame, children: int, *, seed: str = "null") -> DataFrame:
    """Complete days permuted within each calendar month of a parent.

    A month has at most 31 days, so it is gathered once into an array and the canonical series is computed once whatever
    the number of children. A panel is small and its children are many times larger, so months are dealt by parent and
    child into all partitions before their days are hashed; what follows by parent and child needs no other exchange.
    """
    months = panel.groupBy("parent", F.trunc("day", "month").alias("month")).agg(F.sort_array(F.collect_list(F.struct("day_idx", "value"))).alias("days"))
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kids = with_children(months, children).repartition(parts, "parent", "child")

    def key(x: Column) -> Column:
        return F.struct(hashed(seed, F.col("child"), F.col("parent"), x["day_idx"]).alias("h"), x["day_idx"].alias("d"), x["value"].alias("value"))

    shuffled = F.array_sort(F.transform("days", key))
    paired = F.zip_with("days", shuffled, lambda a, b: F.struct(a["day_idx"].alias("day_idx"), b["value"].alias("value")))
    return kids.select("parent", "child", F.explode(paired).alias("x")).select("parent", "child", "x.day_idx", "x.value")


def shift_nulls(panel: DataFrame, children: int, *, seed: str = "shift", least: int = 31) -> DataFrame:
    """Circular shifts by ``least`` to n - ``least``."""
    n = panel.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    base = with_children(panel.join(n, "parent"), children)
    shift = F.lit(least) + draw(F.col("n") - 2 * least + 1, seed, F.col("child"), F.col("parent"))
    return base.select("parent", "child", F.pmod(F.col("day_idx") + shift, F.col("n")).alias("day_idx"), "value")


def block_nulls(panel: DataFrame, children: int, *, size: int = 7, seed: str = "block") -> DataFrame:
    """Whole blocks of ``size`` days permuted; the incomplete tail stays."""
    n = panel.groupBy("parent").agg(F.floor(F.count(F.lit(1)) / size).alias("blocks"))
    numbered = panel.join(n, "parent").withColumn("block", F.floor(F.col("day_idx") / size))
    ids = with_children(numbered.where(F.col("block") < F.col("blocks")).select("parent", "block").distinct(), children)
    order = F.row_number().over(Window.partitionBy("parent", "child").orderBy(hashed(seed, F.col("child"), F.col("parent"), F.col("block")), "block")) - 1
    moves = ids.withColumn("to_block", order)
    moved = numbered.where(F.col("block") < F.col("blocks")).join(moves, ["parent", "block"]).select("parent", "child", (F.col("to_block") * size + F.col("day_idx") % size).alias("day_idx"), "value")
    tail = with_children(numbered.where(F.col("block") >= F.col("blocks")), children).select("parent", "child", "day_idx", "value")
    return moved.union(tail)


def month_block_nulls(panel: DataFrame, children: int, *, size: int = 3, seed: str = "short") -> DataFrame:
    """Blocks of ``size`` days permuted within each calendar month; a month's incomplete tail stays."""
    month = Window.partitionBy("parent", F.trunc("day", "month"))
    rows = panel.withColumn("month", F.trunc("day", "month")).withColumn("k", F.row_number().over(month.orderBy("day_idx")) - 1).withColumn("full", F.floor(F.count(F.lit(1)).over(month) / size))
    rows = rows.withColumn("block", F.floor(F.col("k") / size)).withColumn("begin", F.col("day_idx") - F.col("k"))
    ids = with_children(rows.where("block < full").select("parent", "month", "block").distinct(), children)
    order = F.row_number().over(Window.partitionBy("parent", "child", "month").orderBy(hashed(seed, F.col("child"), F.col("parent"), F.col("month"), F.col("block")), "block")) - 1
    moved = rows.where("block < full").join(ids.withColumn("to_block", order), ["parent", "month", "block"]).select("parent", "child", (F.col("begin") + F.col("to_block") * size + F.col("k") % size).alias("day_idx"), "value")
    tail = with_children(rows.where("block >= full"), children).select("parent", "child", "day_idx", "value")
    return moved.union(tail)


def stationary_bootstrap(panel: DataFrame, children: int, *, restart: int = 7, seed: str = "boot") -> DataFrame:
    """Runs of geometric length (mean ``restart``) from random starts, wrapping around."""
    n = panel.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    base = with_children(panel.select("parent", "day_idx").join(n, "parent"), children)
    flag = (F.col("day_idx") == 0) | (draw(restart, seed, "r", F.col("child"), F.col("parent"), F.col("day_idx")) == 0)
    order = Window.partitionBy("parent", "child").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = base.withColumn("since", F.max(F.when(flag, F.col("day_idx"))).over(order))
    start = draw(F.col("n"), seed, "s", F.col("child"), F.col("parent"), F.col("since"))
    sourced = begun.withColumn("source", F.pmod(start + F.col("day_idx") - F.col("since"), F.col("n")))
    return sourced.join(panel.select("parent", F.col("day_idx").alias("source"), "value"), ["parent", "source"]).select("parent", "child", "day_idx", "value")


def demeaned_nulls(panel: DataFrame, children: int, *, seed: str = "demeaned") -> DataFrame:
    """Month-strata permutation of what remains after each calendar month's mean."""
    mean = F.avg("value").over(Window.partitionBy("parent", F.trunc("day", "month")))
    return month_strata_nulls(panel.withColumn("value", F.col("value") - mean), children, seed=seed)


def resample(rows: DataFrame, keys: list[str], index: str, replicates: int, *, seed: str = "resample", value: str = "value") -> DataFrame:
    """Bootstrap with replacement within a key: (keys, replicate, index, value)."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(index)) - 1)
    base = numbered.join(n, keys).withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    drawn = base.select(*keys, "replicate", index, draw(F.col("_n"), seed, F.col("replicate"), *(F.col(k) for k in keys), F.col(index)).alias("_k"))
    return drawn.join(numbered.select(*keys, "_k", value), [*keys, "_k"]).select(*keys, "replicate", index, value)


def drawn_pairs(spark: SparkSession, count: int, total: int, seed: str) -> DataFrame:
    """``count`` different numbers below ``total`` as (place, pair), by hash and in the order of their first draw.

    Four draws for each number and 64 more are made, and twice as many while they are too few. If over half of all
    numbers are wanted, those not wanted are drawn, and the others placed in md5 order.
    """
    from gneiss.operators.audit import numbered

    if count > total:
        raise ValueError("more edges than pairs of nodes")
    few = 2 * count <= total
    wanted = count if few else total - count
    draws = 4 * wanted + 64
    while True:
        firsts = spark.range(draws).select(draw(max(total, 1), seed, F.col("id")).alias("pair"), F.col("id").alias("k")).groupBy("pair").agg(F.min("k").alias("k"))
        placed = numbered(firsts, [F.col("k")], "place", first=0)
        if placed.count() >= wanted:
            break
        draws *= 2
    chosen = placed.where(F.col("place") < wanted).select("place", "pair")
    if few:
        return chosen
    left = spark.range(total).select(F.col("id").alias("pair")).join(chosen.select("pair"), "pair", "left_anti")
    return numbered(left, [hashed(seed, "rest", F.col("pair")), F.col("pair")], "place", first=0).select("place", "pair")


def rewired(edges: DataFrame, nodes: DataFrame, *, seed: str = "rewire") -> DataFrame:
    """A random graph (place, i < j) with as many edges as ``edges`` has rows.

    Nodes are numbered in their order and a pair (a, b) of n numbers is a(2n - a - 1)/2 + b - a - 1, so no pair of
    nodes is listed to be rejected.
    """
    from gneiss.operators.audit import numbered

    n = nodes.count()
    chosen = drawn_pairs(edges.sparkSession, edges.count(), n * (n - 1) // 2, seed)
    width = F.lit(2.0 * n - 1)
    guess = F.floor((width - F.sqrt(width * width - 8.0 * F.col("pair"))) / 2)
    before = lambda a: F.floor(a * (2 * n - a - 1) / 2)
    row = F.when(before(guess) > F.col("pair"), guess - 1).when(before(guess + 1) <= F.col("pair"), guess + 1).otherwise(guess)
    numbers = chosen.withColumn("a", row.cast("long")).withColumn("b", (F.col("pair") - before(F.col("a")) + F.col("a") + 1).cast("long"))
    names = numbered(nodes.select("node"), [F.col("node")], "number", first=0)
    return numbers.join(names.select(F.col("number").alias("a"), F.col("node").alias("i")), "a").join(names.select(F.col("number").alias("b"), F.col("node").alias("j")), "b").select("place", "i", "j")


def shuffled_weights(edges: DataFrame, nodes: DataFrame, children: int, *, directed: bool, seed: str = "weights") -> DataFrame:
    """Null graphs (child, src, dst, w) whose weights lie on random pairs of different nodes: unordered pairs with src < dst,
    or ordered ones. As pairs without an edge weigh nothing, this permutes the whole matrix."""
    from functools import reduce

    from gneiss.operators.audit import numbered

    n = nodes.count()
    names = numbered(nodes.select("node"), [F.col("node")], "number", first=0)
    weights = numbered(edges.select("src", "dst", "w"), [F.col("src"), F.col("dst")], "place", first=0).select("place", "w")
    out = []
    for child in range(1, children + 1):
        if directed:
            pairs = drawn_pairs(edges.sparkSession, edges.count(), n * (n - 1), f"{seed}|{child}")
            pairs = pairs.select("place", F.floor(F.col("pair") / (n - 1)).alias("a"), (F.col("pair") % (n - 1)).alias("r")).withColumn("b", F.col("r") + (F.col("r") >= F.col("a")).cast("long"))
            named = pairs.join(names.select(F.col("number").alias("a"), F.col("node").alias("src")), "a").join(names.select(F.col("number").alias("b"), F.col("node").alias("dst")), "b")
        else:
            named = rewired(edges, nodes, seed=f"{seed}|{child}").withColumnsRenamed({"i": "src", "j": "dst"})
        out.append(named.join(weights, "place").select(F.lit(child).cast("long").alias("child"), "src", "dst", "w"))
    return reduce(DataFrame.union, out)


def relabelled(rows: DataFrame, ends: tuple[str, str], children: int, *, seed: str = "relabel") -> DataFrame:
    """Null matrices or graphs whose nodes change names, the same way in rows and columns: (child, both ends, ...)."""
    a, b = ends
    nodes = rows.select(F.explode(F.array(a, b)).alias("node")).distinct().withColumn("value", F.col("node"))
    names = permuted_within(nodes, [], "node", [F.lit(0)], children, seed=seed)
    left = names.select("child", F.col("node").alias(a), F.col("value").alias("_a"))
    right = names.select("child", F.col("node").alias(b), F.col("value").alias("_b"))
    return rows.join(left, a).join(right, ["child", b]).select("child", F.col("_a").alias(a), F.col("_b").alias(b), *(c for c in rows.columns if c not in ends))


def frames_and_cells(grid: DataFrame, keys: list[str], frame: str, children: int, *, seed: str = "frames") -> DataFrame:
    """Null sequences of frames: frames change places, and inside each the observed values change cells."""
    from gneiss.operators.geometry import permute_cells

    cells = permute_cells(grid, [*keys, frame], children, seed=seed)
    order = grid.select(*keys, frame).distinct().withColumn("value", F.col(frame))
    moved = permuted_within(order, keys, frame, [F.lit(0)], children, seed=f"{seed}|order")
    return cells.join(moved.select(*keys, "child", F.col("value").alias(frame), F.col(frame).alias("_to")), [*keys, "child", frame]).select(*keys, "child", F.col("_to").alias(frame), "i", "j", "value")
