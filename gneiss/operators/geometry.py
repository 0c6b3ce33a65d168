"""Typed fields as rows: grids (keys, i, j, value, seen), vector grids (u, v), point sets, graphs and paths.

``seen`` marks observed cells. Neighbours are windows over rows and columns, so a grid is exchanged once per axis.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.operators.nulls import hashed, permuted_within
from gneiss.plans.storage import stored

EPS = 2.220446049250313e-16


def neighbour_coherence(grid: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean product of centred observed neighbours (right and down), over the variance; 0 where there is neither."""
    mean = F.avg(F.when(F.col("seen"), F.col(value))).over(Window.partitionBy(*keys))
    rows = grid.select(*keys, "i", "j", F.when(F.col("seen"), F.col(value) - mean).alias("c"))
    along, down = Window.partitionBy(*keys, "i").orderBy("j"), Window.partitionBy(*keys, "j").orderBy("i")
    right = F.when(F.lead("j").over(along) == F.col("j") + 1, F.lead("c").over(along))
    below = F.when(F.lead("i").over(down) == F.col("i") + 1, F.lead("c").over(down))
    products = rows.withColumn("p", F.col("c") * right).withColumn("q", F.col("c") * below)
    total, count = F.coalesce(F.sum("p"), F.lit(0.0)) + F.coalesce(F.sum("q"), F.lit(0.0)), F.count("p") + F.count("q")
    variance = F.avg(F.col("c") * F.col("c"))
    return products.groupBy(*keys).agg(F.when((variance > EPS) & (count > 0), total / count / variance).otherwise(0.0).alias("coherence"))


def gradient(grid: DataFrame, keys: list[str], value: str, axis: str) -> Column:
    """Central difference along an axis, one-sided at the ends."""
    other = "j" if axis == "i" else "i"
    w = Window.partitionBy(*keys, other).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def _zeroed(grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.select(*keys, "i", "j", "seen", *(F.when(F.col("seen"), F.col(c)).otherwise(0.0).alias(c) for c in ("u", "v")))


def curl_scores(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Signed mean curl, curl energy and coherence, divergence energy of observed cells; unobserved cells count as zero in
    differences."""
    zero = _zeroed(grid, keys)
    d = zero.select(*keys, "i", "j", "seen", *(gradient(zero, keys, c, a).alias(f"d{c}_d{a}") for c in ("u", "v") for a in ("i", "j")))
    d = d.withColumn("curl", F.when(F.col("seen"), F.col("dv_dj") - F.col("du_di"))).withColumn("div", F.when(F.col("seen"), F.col("du_dj") + F.col("dv_di")))
    energy = F.avg(F.col("curl") * F.col("curl"))
    return d.groupBy(*keys).agg(
        F.avg("curl").alias("mean_curl"), energy.alias("curl_energy"), (F.avg("curl") * F.avg("curl") / F.greatest(energy, F.lit(EPS))).alias("curl_coherence"),
        F.avg(F.col("div") * F.col("div")).alias("divergence_energy"))


def vector_scores(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Coherence of u and v beside ``curl_scores``; unobserved cells count as zero."""
    zero, scores = _zeroed(grid, keys), curl_scores(grid, keys)
    u = neighbour_coherence(zero, keys, "u").withColumnRenamed("coherence", "u_coherence")
    v = neighbour_coherence(zero, keys, "v").withColumnRenamed("coherence", "v_coherence")
    return u.join(v, keys).join(scores, keys)


def component_scores(grid: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Coherence of every component and correlation of every pair over observed cells."""
    out = None
    for c in components:
        one = neighbour_coherence(grid, keys, c).withColumnRenamed("coherence", f"{c}_coherence")
        out = one if out is None else out.join(one, keys)
    pairs = [(a, b) for k, a in enumerate(components) for b in components[k + 1 :]]
    seen = grid.where("seen").groupBy(*keys).agg(*(F.corr(a, b).alias(f"{a}_{b}_correlation") for a, b in pairs))
    return out.join(seen, keys)


def frame_medians(scores: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians over frames (or slices) of per-frame scores."""
    return scores.groupBy(*keys).agg(*(F.median(c).alias(c) for c in columns))


def lag_one(frames: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Lag-1 correlation of a sequence; 0 for at most two items or no spread."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = frames.withColumn("_before", F.lag(value).over(w))
    both = F.when(F.col("_before").isNotNull(), F.col(value))
    return rows.groupBy(*keys).agg(F.when((F.count(F.lit(1)) > 2) & (F.stddev_pop(value) > EPS), F.corr("_before", both)).otherwise(0.0).alias("lag1"))


def downsample(grid: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Means of observed cells over factor x factor blocks; rows and columns that don't fill a block are left out."""
    size = Window.partitionBy(*keys)
    whole = grid.withColumn("h", F.floor((F.max("i").over(size) + 1) / factor) * factor).withColumn("w", F.floor((F.max("j").over(size) + 1) / factor) * factor)
    blocks = whole.where((F.col("i") < F.col("h")) & (F.col("j") < F.col("w"))).groupBy(*keys, F.floor(F.col("i") / factor).alias("i"), F.floor(F.col("j") / factor).alias("j"))
    return blocks.agg(F.coalesce(F.avg(F.when(F.col("seen"), F.col("value"))), F.lit(0.0)).alias("value"), F.bool_or("seen").alias("seen"))


def bin_points(points: DataFrame, width: float, components: list[str], *, least: int = 8) -> DataFrame:
    """Componentwise medians of points in width x width cells with at least ``least`` of them."""
    cells = points.groupBy(F.floor(F.col("x") / width).alias("i"), F.floor(F.col("y") / width).alias("j"))
    return cells.agg(F.count(F.lit(1)).alias("n"), *(F.median(c).alias(c) for c in components)).where(F.col("n") >= least)


def mean_field(samples: DataFrame, snapshots: str = "t") -> DataFrame:
    """Per cell the mean over snapshots; seen only where every snapshot of the table has a value."""
    total = samples.agg(F.count_distinct(snapshots).alias("_n"))
    cells = samples.groupBy("i", "j").agg(F.avg("value").alias("value"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col(snapshots))).alias("k"))
    return cells.crossJoin(F.broadcast(total)).select("i", "j", "value", (F.col("k") == F.col("_n")).alias("seen"))


def rotate_90(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Turn cells and vectors by 90 degrees: (i, j) to (j, H - 1 - i), (u, v) to (-v, u)."""
    high = F.max("i").over(Window.partitionBy(*keys))
    return grid.withColumn("_h", high).select(*keys, F.col("j").alias("i"), (F.col("_h") - F.col("i")).alias("j"), (-F.col("v")).alias("u"), F.col("u").alias("v"), "seen")


def reflect_y(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mirror rows: i to H - 1 - i, v to -v."""
    high = F.max("i").over(Window.partitionBy(*keys))
    return grid.withColumn("_h", high).select(*keys, (F.col("_h") - F.col("i")).alias("i"), "j", "u", (-F.col("v")).alias("v"), "seen")


def drop_out(grid: DataFrame, keys: list[str], fraction: float, *, seed: str = "dropout") -> DataFrame:
    """Hide ceil(fraction * n) of the observed cells (at least one), the first in md5 order."""
    seen = Window.partitionBy(*keys, "seen")
    place = F.row_number().over(seen.orderBy(hashed(seed, *(F.col(k) for k in keys), F.col("i"), F.col("j")), "i", "j"))
    hidden = F.col("seen") & (place <= F.greatest(F.lit(1), F.ceil(fraction * F.count(F.lit(1)).over(seen))))
    return grid.withColumn("_hide", hidden).withColumn("seen", F.col("seen") & ~F.col("_hide")).drop("_hide")


def permute_cells(grid: DataFrame, keys: list[str], children: int, *, seed: str = "cells", value: str = "value") -> DataFrame:
    """Null children whose observed values change cells; unobserved cells stay out. ``value`` may be a struct, so
    vectors move whole."""
    rows = grid.where("seen").withColumn("cell", F.col("i") * 1_000_000 + F.col("j"))
    moved = permuted_within(rows, keys, "cell", [F.lit(0)], children, seed=seed, value=value)
    return moved.select(*keys, "child", F.floor(F.col("cell") / 1_000_000).alias("i"), (F.col("cell") % 1_000_000).alias("j"), value)


def smooth(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of each cell and its four neighbours; the grid wraps around."""
    def ring(axis: str, other: str) -> Column:
        w = Window.partitionBy(*keys, other).orderBy(axis)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.lag("value").over(w), F.last("value").over(whole)) + F.coalesce(F.lead("value").over(w), F.first("value").over(whole))

    return grid.select(*keys, "i", "j", ((F.col("value") + ring("i", "j") + ring("j", "i")) / 5).alias("value"))


def additive_residual(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the variance that row and column means don't explain."""
    row, column, whole = (F.avg("value").over(Window.partitionBy(*keys, *more)) for more in (["i"], ["j"], []))
    rows = grid.select(*keys, "value", (F.col("value") - row - column + whole).alias("rest"))
    return rows.groupBy(*keys).agg((F.avg(F.col("rest") * F.col("rest")) / F.greatest(F.var_pop("value"), F.lit(EPS))).alias("residual_ratio"))


def cross_stream_ratio(grid: DataFrame, keys: list[str], *, floor: float = 1e-9) -> DataFrame:
    """Median of |v| / max(|u|, floor) of observed cells."""
    return grid.where("seen").groupBy(*keys).agg(F.median(F.abs("v") / F.greatest(F.abs("u"), F.lit(floor))).alias("ratio"))


def line_porosity(grid: DataFrame, keys: list[str], directions: list[tuple[int, int]], *, least: int = 4) -> DataFrame:
    """Per direction the largest share of observed cells on a line from any start cell to the edge with at least
    ``least`` cells. A line from a start is a suffix of its whole line, so suffix means by a window suffice."""
    out = None
    for dy, dx in directions:
        line = F.when(F.lit(dy == 0), F.col("i")).when(F.lit(dx == 0), F.col("j")).otherwise(F.col("i") * dx - F.col("j") * dy)
        phase = F.pmod(F.col("j"), F.lit(abs(dx))) if dx else F.pmod(F.col("i"), F.lit(abs(dy)))
        step = F.col("j") * (1 if dx > 0 else -1) if dx else F.col("i") * (1 if dy > 0 else -1)
        w = Window.partitionBy(*keys, line, phase).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = grid.withColumn("_step", step).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.avg(F.col("seen").cast("double")).over(w))
        best = rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_n") >= least, F.col("_m"))), F.lit(0.0)).alias("occupancy"))
        best = best.select(*keys, F.lit(f"{dy},{dx}").alias("direction"), "occupancy", (F.col("occupancy") >= 0.75).alias("channel"))
        out = best if out is None else out.union(best)
    return out


def ball_porosity(grid: DataFrame, keys: list[str], radii: list[int]) -> DataFrame:
    """Per radius the occupancy of discs around all cells. A disc's cells are generated as offsets and met by an
    equi-join, so the work is cells times the disc's area, not cells squared."""
    offsets = [(r, dy, dx) for r in radii for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
    table = F.array(*(F.struct(F.lit(r).alias("radius"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for r, dy, dx in offsets))
    centres = grid.select(*keys, F.col("i").alias("ci"), F.col("j").alias("cj"), F.explode(table).alias("o"))
    centres = centres.select(*keys, "ci", "cj", "o.radius", (F.col("ci") + F.col("o.dy")).alias("i"), (F.col("cj") + F.col("o.dx")).alias("j"))
    shares = centres.join(grid.select(*keys, "i", "j", "seen"), [*keys, "i", "j"]).groupBy(*keys, "radius", "ci", "cj").agg(F.avg(F.col("seen").cast("double")).alias("share"))
    return shares.groupBy(*keys, "radius").agg(F.max("share").alias("maximum_occupancy"), (1 - F.median("share")).alias("median_missing"), (1 - F.max("share")).alias("minimum_missing"))


def _oriented(links: DataFrame, degrees: DataFrame) -> DataFrame:
    """Links (a, b) from the end of lower degree (the smaller name on ties): no node has more than about the square root
    of all links behind it, so hubs are met from their neighbours."""
    d = lambda n: degrees.select(F.col("n").alias(n), F.struct(F.col("d"), F.col("n")).alias(f"_{n}"))
    rows = links.join(d("a"), "a").join(d("b"), "b")
    up = F.col("_a") < F.col("_b")
    return rows.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"), F.col("_a" ).alias("_x"), F.col("_b").alias("_y"), *(c for c in links.columns if c not in ("a", "b")), up.alias("up"))


def graph_scores(edges: DataFrame) -> DataFrame:
    """Total absolute weight, reciprocity, signed three-cycle trace tr(A^3) and its share of the cubed total, of
    edges (src, dst, w); rows that repeat an edge add up.

    A cycle of three nodes is met once, at its node of least degree; it counts three times in the trace. Loops add their
    cube, and thrice their product with both directions of each pair.
    """
    weights = edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back"))
    total = edges.agg(F.sum(F.abs("w")).alias("total"))
    both = edges.join(back, ["src", "dst"]).agg(F.coalesce(F.sum(F.least(F.abs("w"), F.abs("back"))), F.lit(0.0)).alias("mutual"))
    loops = weights.where("src = dst").select(F.col("src").alias("n"), F.col("w").alias("loop"))
    plain = weights.where("src <> dst")
    degrees = plain.select(F.explode(F.array("src", "dst")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    arcs = _oriented(plain.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w"), degrees)
    out = arcs.where("up").select("low", F.col("high").alias("q"), F.col("w").alias("w1"))  # low -> q
    into = arcs.where("not up").select("low", F.col("high").alias("r"), F.col("w").alias("w3"))  # r -> low
    distinct = out.join(into, "low").where("q <> r").join(plain.select(F.col("src").alias("q"), F.col("dst").alias("r"), F.col("w").alias("w2")), ["q", "r"])
    parts = distinct.agg((3 * F.sum(F.col("w1") * F.col("w2") * F.col("w3"))).alias("x"))
    pairs = plain.join(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("back")), ["src", "dst"]).join(loops, F.col("src") == F.col("n"))
    parts = parts.union(pairs.agg((3 * F.sum(F.col("loop") * F.col("w") * F.col("back"))).alias("x"))).union(loops.agg(F.sum(F.pow("loop", F.lit(3))).alias("x")))
    cycles = parts.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("three_cycles"))
    return total.crossJoin(both).crossJoin(cycles).select(
        "total", (F.col("mutual") / F.greatest("total", F.lit(EPS))).alias("reciprocity"), "three_cycles", (F.col("three_cycles") / F.greatest(F.pow("total", F.lit(3)), F.lit(EPS))).alias("normalized_three_cycles"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles, wedges and transitivity of an undirected graph of distinct pairs (i < j). A triangle is met once, at its
    node of least degree."""
    degree = edges.select(F.explode(F.array("i", "j")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    arcs = _oriented(edges.select(F.col("i").alias("a"), F.col("j").alias("b")), degree).select("low", "high")
    ends = arcs.join(arcs.select("low", F.col("high").alias("other")), "low").where("high < other")
    count = ends.join(edges, (F.col("high") == F.col("i")) & (F.col("other") == F.col("j"))).agg(F.count(F.lit(1)).alias("triangles"))
    wedges = degree.agg(F.coalesce(F.sum(F.col("d") * (F.col("d") - 1) / 2), F.lit(0.0)).alias("wedges"))
    return count.crossJoin(wedges).withColumn("transitivity", F.when(F.col("wedges") > 0, 3 * F.col("triangles") / F.col("wedges")).otherwise(0.0))


#: Distinct positions of a block in which nearest points are searched first.
BLOCK = 64


def _distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    return F.sqrt((x - p) * (x - p) + (y - q) * (y - q))


def _box_distance(x: Column, y: Column) -> Column:
    """Distance to the box ``x0``, ``x1``, ``y0``, ``y1``: in floating point too, at most that to any position inside."""
    dx, dy = (F.greatest(F.lit(0.0), F.col(f"{c}0") - v, v - F.col(f"{c}1")) for c, v in (("x", x), ("y", y)))
    return F.sqrt(dx * dx + dy * dy)


def _nearest_in(rows: DataFrame) -> DataFrame:
    """(id, distance, other) of the nearest other position in the block that each row (id, x, y, places) holds."""
    others = F.filter("places", lambda q: q["id"] != F.col("id"))
    return rows.withColumn("best", F.array_min(F.transform(others, lambda q: F.struct(_distance(F.col("x"), F.col("y"), q["x"], q["y"]).alias("distance"), q["id"].alias("other")))))


def _nearest_places(places: DataFrame, n: int, size: int) -> DataFrame:
    """(id, best: distance and other) of ``n`` distinct finite positions (id, x, y).

    Strips of equal numbers by x are cut into blocks of ``size`` by y, so blocks are small however dense or far apart
    positions are. The nearest in the own block bounds the distance; other blocks are asked only where their box is as
    near as that, and they are found through their strip's box.
    """
    strips = math.ceil(math.sqrt(n / size))
    cuts = sorted(set(places.approxQuantile("x", [k / strips for k in range(1, strips)], 1 / (8 * strips)))) if strips > 1 else []
    if cuts:
        placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="x", outputCol="_strip").transform(places).withColumn("strip", F.col("_strip").cast("int")).drop("_strip")
    else:
        placed = places.withColumn("strip", F.lit(0))
    numbered = placed.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("strip").orderBy("y", "x")) - 1) / size))
    box = [f(F.col(c)).alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))]
    blocks = stored(numbered.groupBy("strip", "block").agg(F.collect_list(F.struct("id", "x", "y")).alias("places"), *box), "blocks")
    own = _nearest_in(blocks.select("strip", "block", "places", F.explode("places").alias("p")).select("strip", "block", "places", "p.*"))
    own = stored(own.select("id", "x", "y", F.col("strip").alias("_strip"), F.col("block").alias("_block"), "best"), "own")
    boxes = blocks.drop("places")
    of_strips = boxes.groupBy("strip").agg(*(f(f"{c}{k}").alias(f"{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))))
    near = F.coalesce(_box_distance(F.col("x"), F.col("y")) <= F.col("best.distance"), F.lit(True))
    asked = own.join(F.broadcast(of_strips), near).select("id", "x", "y", "_strip", "_block", "best", "strip")
    asked = asked.join(boxes, "strip").where(near & ((F.col("strip") != F.col("_strip")) | (F.col("block") != F.col("_block")))).select("strip", "block", "id", "x", "y")
    found = _nearest_in(asked.join(blocks.select("strip", "block", "places"), ["strip", "block"])).select("id", "best")
    return own.select("id", "best").union(found).groupBy("id").agg(F.min("best").alias("best"))


def _least_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, second): the two smallest ids of each key; a group of any size is combined on the map side."""
    first = stored(rows.groupBy(*keys).agg(F.min("id").alias("first"), F.max("id").alias("last")), "first")
    several = first.where("first <> last").select(*keys, "first")
    second = rows.join(several, keys).where("id <> first").groupBy(*keys).agg(F.min("id").alias("second"))
    return stored(first.drop("last").join(second, keys, "left"), "least-two")


def _kind(c: str) -> Column:
    return F.when(F.col(c) == math.inf, 1).when(F.col(c) == -math.inf, -1).otherwise(0)


def _odd_points(asked: DataFrame, points: DataFrame) -> DataFrame:
    """Nearest others of points at no finite distance from any: an infinite distance comes before one that is no number,
    and that before an unknown one; of equal ones the smallest id."""
    kinds = lambda rows: rows.withColumn("k", F.when(F.col("x").isNull() | F.col("y").isNull(), 2).when(F.isnan("x") | F.isnan("y"), 1).otherwise(0)).withColumn("kx", F.when(F.col("k") == 0, _kind("x")).otherwise(0)).withColumn("ky", F.when(F.col("k") == 0, _kind("y")).otherwise(0))
    classes = _least_two(kinds(points), ["k", "kx", "ky"]).select(F.col("k").alias("ok"), F.col("kx").alias("okx"), F.col("ky").alias("oky"), F.explode(F.array_compact(F.array("first", "second"))).alias("other"))
    same = ((F.col("kx") != 0) & (F.col("kx") == F.col("okx"))) | ((F.col("ky") != 0) & (F.col("ky") == F.col("oky")))
    rank = F.greatest("k", "ok", F.when(same, 1).otherwise(0))
    finite = F.greatest(*(F.abs(c) for c in ("k", "kx", "ky", "ok", "okx", "oky"))) == 0
    best = kinds(asked).join(F.broadcast(classes), (F.col("id") != F.col("other")) & ~finite, "left").groupBy("id").agg(F.min(F.when(F.col("other").isNotNull(), F.struct(rank.alias("rank"), "other"))).alias("b"))
    return best.select("id", F.col("b.other").alias("other"), F.when(F.col("b.rank") == 0, math.inf).when(F.col("b.rank") == 1, math.nan).alias("distance"))


def all_nearest_points(points: DataFrame, *, cell: float | None = None, size: int = BLOCK) -> DataFrame:
    """Each point's nearest other point (``other``, ``distance``), however far, the smaller id on ties. A single point has
    a null ``other``; points of null id have no row; where no distance is a finite number see ``_odd_points``.

    Points of one position are asked once, for the position, so copies cost no pairs; no pairs of points leave a task.
    ``cell`` is from the times of fixed cells and changes nothing.
    """
    points = stored(points.where("id is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    plain = F.coalesce((F.abs("x") < math.inf) & (F.abs("y") < math.inf), F.lit(False))
    finite, odd = points.where(plain), points.where(~plain)
    places = _least_two(finite, ["x", "y"])
    n = places.count()
    copies = n == 1 and not places.where("second is not null").isEmpty()
    parts = []
    if n > 1:
        best = _nearest_places(places.select(F.col("first").alias("id"), "x", "y"), n, size).withColumnRenamed("id", "first")
        places = places.join(best, "first")
    if n > 1 or copies:
        copy = F.when(F.col("id") != F.col("first"), F.col("first")).otherwise(F.col("second"))
        copy = F.when(copy.isNotNull(), F.struct(F.lit(0.0).alias("distance"), copy.alias("other")))
        found = finite.join(places, ["x", "y"]).select("id", (F.least(copy, "best") if n > 1 else copy).alias("b"))
        parts.append(found.select("id", "b.other", "b.distance"))
    else:
        odd = points
    if not parts or not odd.isEmpty():
        parts.append(_odd_points(odd, points))
    return reduce(DataFrame.union, parts)


def point_scores(points: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Anisotropy (ratio of the coordinates' singular values) and nearest-neighbour coherence of ``value``."""
    stats = points.agg(F.var_pop("x").alias("a"), F.var_pop("y").alias("b"), F.covar_pop("x", "y").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("s"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(F.pow((F.col("a") - F.col("b")) / 2, 2) + F.pow("c", 2))
    joined = neighbours.join(points.select("id", "value"), "id").join(points.select(F.col("id").alias("other"), F.col("value").alias("other_value")), "other")
    local = joined.crossJoin(F.broadcast(stats)).agg(F.avg((F.col("value") - F.col("m")) * (F.col("other_value") - F.col("m"))).alias("product"))
    return stats.crossJoin(F.broadcast(local)).select(F.sqrt((half + root) / F.greatest(half - root, F.lit(EPS))).alias("anisotropy"), (F.col("product") / F.greatest("s", F.lit(EPS))).alias("neighbour_coherence"))


def winding(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Winding number of ordered closed planar paths (keys, pos, x, y) about their centre, and its coherence: at most
    one winding, times 2 pi median radius over path length (at most 1)."""
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("pos")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = paths.withColumn("cx", F.col("x") - F.avg("x").over(whole)).withColumn("cy", F.col("y") - F.avg("y").over(whole)).withColumn("angle", F.atan2("cy", "cx"))
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(every))
    rows = rows.withColumn("turn", F.pmod(ahead("angle") - F.col("angle") + math.pi, F.lit(2 * math.pi)) - math.pi).withColumn("step", F.sqrt(F.pow(ahead("x") - F.col("x"), 2) + F.pow(ahead("y") - F.col("y"), 2)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.sum("turn") / (2 * math.pi)).alias("winding"), F.sum("step").alias("length"), F.median(F.sqrt(F.pow("cx", 2) + F.pow("cy", 2))).alias("radius")).where("n >= 4")
    efficiency = F.least(F.lit(1.0), 2 * math.pi * F.col("radius") / F.greatest("length", F.lit(EPS)))
    return out.select(*keys, "winding", "length", efficiency.alias("efficiency"), (F.least(F.lit(1.0), F.abs("winding")) * efficiency).alias("coherence"))


def path_order(edges: DataFrame) -> DataFrame:
    """Positions along path graphs (path, a, b): every node has at most two neighbours and two have one; others are
    left out. The smaller end comes first.

    Pointer doubling over arcs: each round an arc's next one becomes the one twice as far, so as many rounds as the
    logarithm of the longest path, whatever its length. Arcs on a circle never end and are left out.
    """
    both = edges.select("path", "a", "b").union(edges.select("path", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("path", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    good = stored(degree.groupBy("path").agg(F.max("d").alias("most"), F.count_if(F.col("d") == 1).alias("ends"), F.min(F.when(F.col("d") == 1, F.col("node"))).alias("start"), F.count(F.lit(1)).alias("nodes")).where("most <= 2 and ends = 2"), "paths")
    arcs = stored(both.join(good.select("path"), "path"), "arcs")
    after = arcs.select("path", F.col("a").alias("b"), F.col("b").alias("nb"))
    state = arcs.join(after, ["path", "b"], "left").withColumn("nb", F.when(F.col("nb") != F.col("a"), F.col("nb")))
    state = state.groupBy("path", "a", "b").agg(F.max("nb").alias("nb")).withColumn("na", F.when(F.col("nb").isNotNull(), F.col("b"))).withColumn("left", F.col("nb").isNotNull().cast("long")).withColumn("last", F.col("b"))
    longest = good.agg(F.max("nodes")).first()[0] or 0
    for _ in range(max(1, longest.bit_length())):
        state = stored(state, "walks")
        ahead = state.select("path", F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("left").alias("more"), F.col("last").alias("end"))
        state = state.join(ahead, ["path", "na", "nb"], "left").select(
            "path", "a", "b", F.col("mb").alias("nb"), F.col("ma").alias("na"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"), F.coalesce("end", "last").alias("last"))
    ended = stored(state.where("nb is null"), "walks").join(good.select("path", "start"), "path").where("last <> start")
    size = ended.groupBy("path").agg(F.max("left").alias("m"))
    rest = ended.join(size, "path").select("path", (F.col("m") - F.col("left") + 1).cast("int").alias("pos"), F.col("b").alias("node"))
    return good.select("path", F.lit(0).alias("pos"), F.col("start").alias("node")).union(rest)
