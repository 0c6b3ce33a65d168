"""N-gram Jaccard self-join with token-combination prefixes, and the components of its links.

Two sets whose Jaccard similarity reaches t overlap in at least ``need`` shingles, so under one order of all
shingles their first ``n - need + k`` ones share k. Shingles that many documents hold go last in the order. While
enough rare ones come first, a single shared shingle (k = 1) retrieves a pair. For documents made of frequent
shingles the prefix is extended until similar ones share a number of shingles there that grows with their size: one of
these is rare, or two of them stand close together in both orders, so rare shingles and combinations (k = 2) of close
frequent ones are indexed, as many as a document has shingles times a constant. All candidates are verified on whole
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.components import connected_components
from gneiss.llm.workers import give_back
from gneiss.plans.storage import arrow_rows, release, remove, scratch_path, stored

#: A shingle that more documents hold than this is frequent.
FREQUENT = 32
#: The table of frequent shingles goes to every task; while it would have more rows, the bound above is doubled.
FREQUENT_ROWS = 1_000_000
#: Documents of at most so many shingles are indexed with all pairs of frequent shingles of a short prefix.
SHORT = 128
#: Longs of the parity sketch that bounds how much two sets differ.
SKETCH = 4
#: Nodes of a key of at least ``MANY`` know up to ``RECENT`` such keys of theirs before it, so that two that share many
#: keys meet at few.
MANY, RECENT = 8, 8
#: Up to so many ids (64 MB) are broadcast to pick texts.
BROADCAST_IDS = 4_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_set(text: Column, size: int) -> Column:
    """Sorted distinct hashes of a text's word shingles; of the whole sequence if it is shorter; empty without words."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", -1), "")
    return F.transform(F.array(words), lambda w: F.when(
        F.size(w) >= size,
        F.sort_array(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda k: F.xxhash64(*(F.get(w, k + j) for j in range(size)))))),
    ).when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))[0]


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that reaches the threshold."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - 1e-9)


def _prefix(n: int | np.ndarray, percent: int):
    """Length of the prefix that shares one shingle with any similar set."""
    return n - -(-n * percent // 100) + 1


def _rare_prefix(rows: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """Per row (node, n, tokens: its least ones in order) the prefix of rare shingles, and whether it is complete:
    all that ``tokens`` holds, and still too few, so that frequent ones would have to follow."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            values, offsets, complete = [np.zeros(0, np.int64)], [0], []
            column, sizes = batch.column("tokens"), batch.column("n").to_numpy()
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            ends = ends - ends[0]
            if len(hot):
                rare = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] != flat
            else:
                rare = np.ones(len(flat), bool)
            for a, b, n in zip(ends[:-1], ends[1:], sizes):
                need = _prefix(int(n), percent)
                mine = flat[a:b][rare[a:b]][:need]
                values.append(mine)
                offsets.append(offsets[-1] + len(mine))
                complete.append(len(mine) < need)
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), pa.int64()))
            rest = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), prefix, pa.array(complete, pa.bool_()), *rest], names=["node", "n", "prefix", "complete", *keep])
        give_back()

    keep = [c for c in ("h", "h2", "sketch") if c in rows.columns]
    kinds = ["node long, n int, prefix array<bigint>, complete boolean", *(f"{c} {kind}" for c, kind in rows.dtypes if c in keep)]
    return rows.select("node", "n", "tokens", *keep).mapInArrow(run, ", ".join(kinds))


def _whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(node, n, set) of the documents in ``ids`` (columns ``node``, ``node_h``), from the texts that have this hash.
    Few ids are broadcast, so that the other texts stay where they are; more than ``BROADCAST_IDS`` are joined by an
    exchange."""
    few = ids.count() <= BROADCAST_IDS
    some = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("node"))
    # A generator works the set out once, and only of the texts that the join has picked.
    mine = F.filter(F.array(shingle_set(F.col("text"), size)), lambda x: F.xxhash64(x) == F.col("node_h"))
    return some.select("node", F.explode(mine).alias("set")).select("node", F.size("set").alias("n"), "set")


def _least(percent: int) -> int:
    """Smaller sets can only link to equal ones."""
    return -(-percent // max(1, 100 - percent))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    sets = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), shingle_set(F.col("text"), size).alias("set"))
    return sets.select("doc_id", F.size("set").alias("n"), F.xxhash64("set").alias("h"), F.xxhash64(F.lit(1), "set").alias("h2"), "set")


def _sketched(sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``_sets`` with the least ``tokens`` of the set, enough for a prefix, and its parity ``sketch``: for
    64 * ``SKETCH`` buckets of shingle hashes, whether the set has an odd number in each. Sketches of two sets differ
    in at most as many bits as the sets in shingles."""
    bits = 64 * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("set")
            flat, ends, sizes = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy(), batch.column("n").to_numpy()
            begins, stops = ends[:-1] - ends[0], ends[1:] - ends[0]
            odd = np.zeros((batch.num_rows, bits), np.uint8)
            for k, (a, b) in enumerate(zip(begins, stops)):
                place = (flat[a:b].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                odd[k] = np.bincount((place % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            least = np.minimum(sizes, 2 * (sizes + -(sizes * percent // 100)) + 10)
            offsets = np.concatenate([[0], np.cumsum(least)])
            kept = flat[np.repeat(begins - offsets[:-1], least) + np.arange(offsets[-1])]
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(kept, pa.int64()))
            sketch = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(odd, axis=1).view(np.int64).ravel()), SKETCH).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n", "h", "h2")), tokens, sketch], names=["doc_id", "n", "h", "h2", "tokens", "sketch"])
        give_back()

    return sets.mapInArrow(run, "doc_id long, n int, h long, h2 long, tokens array<bigint>, sketch array<bigint>")


def _several(rows: DataFrame) -> DataFrame:
    """The rows of keys that more than one node has, in any number; a key's nodes are counted with map-side sums."""
    keys = rows.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    return rows.join(keys, "key")


def _extent(n: Column, level: Column, percent: int) -> tuple[Column, Column, Column]:
    """Of a set of ``n`` shingles on a level: what similar sets share in their prefixes, the prefix's length, and how
    far apart two of these may be.

    Two similar sets share the c first of their common shingles in prefixes of ``n - ceil(t n) + c``. Their gaps in both
    prefixes sum up to less than both lengths, so two that follow one another have gaps that sum up to at most
    (both lengths - 2) / (c - 1).
    """
    c = F.greatest(F.lit(2), F.ceil(F.pow(F.lit(2.0), level) * (100 - percent) / F.lit(100) - 1e-9)).cast("int")
    length = F.least(n, n - F.ceil(n * percent / F.lit(100) - 1e-9) + c).cast("int")
    other = F.floor(n * (100 - percent) / F.lit(percent) + 1e-9) + c
    return c, length, F.greatest(F.lit(1), F.floor((length + other - 2) / (c - 1) + 1e-9) - 1).cast("int")


def _stubborn_index(whole: DataFrame, percent: int) -> DataFrame:
    """Rows (key, node, n, reach, before) among documents made of frequent shingles, from their whole sets.

    Counts are taken anew among these documents. Rare shingles of a prefix are keys by themselves. Short documents' prefixes
    are extended by one, and all pairs of frequent shingles there are keys: the first two common shingles of similar
    documents, if the first isn't rare. ``before`` holds what stands before the second one, so a pair of documents is
    asked for at one key alone. Longer documents are on the level of their size's power of two and on that of the
    largest size which can be similar to it; similar ones meet on the larger one's level, where they share a rare
    shingle or two frequent ones close together. Documents near the limit are in both.
    """
    tokens = whole.select("node", "n", F.explode("set").alias("t"))
    counts = tokens.groupBy("t").agg((F.count(F.lit(1)) > FREQUENT).alias("hot"))
    low, high = F.floor(F.log2(F.col("n"))), F.floor(F.log2(F.col("n") * F.lit(100) / F.lit(percent) + 1e-9))
    short, long = F.col("n") * percent <= SHORT * 100, F.col("n") * 100 >= SHORT * percent
    two = F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / F.lit(100) - 1e-9) + 2).cast("int")
    extent = F.when(long, F.greatest(two, _extent(F.col("n"), high, percent)[1])).otherwise(two)
    ordered = stored(tokens.join(counts, "t").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("hot", "t"))).alias("order"))
                     .select("node", "n", F.slice("order", F.lit(1), extent).alias("order")), "orders")
    placed = ordered.select("node", "n", "order", F.posexplode("order").alias("pos", "x")).select("node", "n", "order", "pos", "x.hot", "x.t")
    earlier = F.transform(F.slice("order", F.lit(1), F.col("pos")), lambda x: x["t"])
    reach = F.col("n") - F.col("pos")
    rare = placed.where("not hot").select(F.col("t").alias("key"), "node", "n", reach.alias("reach"), F.when(short, earlier).alias("before"))
    seconds = placed.where(short & F.col("hot") & (F.col("pos") < two)).select("node", "n", "pos", "t", "order", earlier.alias("earlier"))
    firsts = seconds.select("node", "n", "pos", "t", "earlier", F.explode(F.filter(F.slice("order", F.lit(1), F.col("pos")), lambda x: x["hot"])).alias("first"))
    pairs = firsts.select(F.xxhash64(F.lit(-1).cast("long"), "first.t", "t").alias("key"), "node", "n", (reach + 1).alias("reach"), F.array_remove("earlier", F.col("first.t")).alias("before"))
    levels = ordered.where(long).select("node", "n", F.explode(F.array_distinct(F.array(low, high))).alias("level"), "order")
    _, length, gap = _extent(F.col("n"), F.col("level"), percent)
    hot = levels.select("node", "n", "level", gap.alias("gap"), F.transform(F.filter(F.slice("order", F.lit(1), length), lambda x: x["hot"]), lambda x: x["t"]).alias("hots"))
    close = hot.select("node", "n", "level", "gap", "hots", F.posexplode("hots").alias("k", "one")).select(
        "node", "n", "level", "one", F.explode(F.slice("hots", F.col("k") + 2, F.col("gap"))).alias("second"))
    combined = close.select(F.xxhash64("level", "one", "second").alias("key"), "node", "n", F.col("n").cast("long").alias("reach"), F.lit(None).cast("array<bigint>").alias("before"))
    return _several(rare.withColumn("reach", F.col("reach").cast("long")).union(pairs.withColumn("reach", F.col("reach").cast("long"))).union(combined))


def _index(prefixes: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Rows (key, node, n, reach, before) of keys with several nodes. Two nodes of a key can be similar only if both
    ``reach`` the overlap that their sizes need: it is the size less what stands before the key in the order."""
    rows = prefixes.select("node", "n", "stubborn", F.posexplode("prefix").alias("pos", "key")).select("key", "node", "n", (F.col("n") - F.col("pos")).alias("reach"), "stubborn")
    plain = rows.where("not stubborn").drop("stubborn")
    of_key = Window.partitionBy("key")
    among = plain.withColumn("x", F.min("node").over(of_key)).withColumn("y", F.max("node").over(of_key)).where("x <> y").drop("x", "y")
    # Stubborn documents' rare shingles meet plain documents' here; each other's are in their own index.
    others = rows.where("stubborn").drop("stubborn")
    met = plain.join(others.select("key").distinct(), "key")
    mixed = met.union(others.join(met.select("key").distinct(), "key"))
    plainly = among.union(mixed).select("key", "node", "n", F.col("reach").cast("long").alias("reach"), F.lit(None).cast("array<bigint>").alias("before"))
    return stored(plainly.union(_stubborn_index(whole, percent)), "index")


def _possible(percent: int) -> Column:
    need = _need(F.col("na"), F.col("nb"), percent)
    return (F.col("ra") >= need) & (F.col("rb") >= need) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def _plausible(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Drop pairs (a, b) whose prefixes alone differ by more than their whole sets may.

    A prefix holds all of a document's rare shingles up to its last one (all there are, if it is complete), so up
    to the lesser last one of both, what one prefix lacks its document lacks.
    """
    last = F.when(F.col("complete"), F.lit(2**63 - 1)).otherwise(F.element_at("prefix", -1))
    sides = prefixes.select("node", "n", "prefix", last.alias("last"))
    left = sides.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"), F.col("last").alias("ea"))
    right = sides.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"), F.col("last").alias("eb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("end", F.least("ea", "eb"))
    seen = F.size(F.filter("pa", lambda t: t <= F.col("end"))) + F.size(F.filter("pb", lambda t: t <= F.col("end")))
    both = F.size(F.filter(F.array_intersect("pa", "pb"), lambda t: t <= F.col("end")))
    return joined.where(seen - 2 * both <= F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, hashes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets."""
    plausible = stored(_plausible(pairs, prefixes, percent), "plausible")
    ids = stored(plausible.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(hashes, "node"), "ids")
    sets = stored(_whole_sets(docs, ids, size).select("node", "set"), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    joined = plausible.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return joined.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _recent(rows: DataFrame) -> DataFrame:
    """Adds ``recent`` to rows without ``before`` of keys of ``many`` nodes: of the node's such keys just before, in the
    order of keys, those with no less reach."""
    apply = F.col("many") & F.col("before").isNull()
    last = Window.partitionBy("node").orderBy("key", F.desc("reach")).rowsBetween(-RECENT, -1)
    some = rows.where(apply).withColumn("recent", F.collect_list(F.struct("key", "reach")).over(last))
    some = some.withColumn("recent", F.transform(F.filter("recent", lambda x: x["reach"] >= F.col("reach")), lambda x: x["key"]))
    return rows.where(~apply).withColumn("recent", F.lit(None).cast("array<bigint>")).union(some)


def _rest(index: DataFrame, labels: DataFrame, tried: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that share a key, are still in different components and differ in few enough bits of their
    sketches. Only such pairs leave the join of a key's rows, and not where both nodes have met at a recent key: of the
    keys that they share, the first is never left out, as a recent one counts only if no node's reach is less there."""
    known = stored(parities.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "known")
    labelled = index.join(known, "node")
    mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), (F.count(F.lit(1)) >= MANY).alias("many")).where("x <> y").select("key", "many"), "mixed")
    rows = _recent(stored(labelled.join(mixed, "key"), "open"))
    left, right = (rows.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("reach").alias(f"r{x}"), F.col("label").alias(f"l{x}"), F.col("before").alias(f"before_{x}"), F.col("recent").alias(f"recent_{x}"), *(F.col(f"s{k}").alias(f"{x}{k}") for k in range(SKETCH))) for x in "ab")
    differ = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH)), F.lit(0))
    near = differ <= F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), percent)
    first = ~F.coalesce(F.arrays_overlap("before_a", "before_b"), F.lit(False)) & ~F.coalesce(F.arrays_overlap("recent_a", "recent_b"), F.lit(False))
    meet = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _possible(percent) & near & first
    return stored(left.join(right, meet).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "rest")


def jaccard_components(docs: DataFrame, *, size: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``n_copies`` of every row of ``docs``.

    Documents link when their shingle sets' Jaccard similarity is at least ``percent`` / 100; ``component_id`` is
    the smallest doc_id that links reach. Null and empty texts (and those of white space) have an empty set and are
    alone. A null doc_id gives a null component. Rows that repeat a doc_id are one document; if their texts differ, the
    one with the least set (by size, then hash) stands for all. ``n_copies`` is the number of rows with the same set.
    An empty table gives an empty one; other columns are left out.

    Plan: equal sets are folded into their smallest doc_id by a map-side combined minimum, so a group of copies is
    one node; sets are equal if size and 128 bits of hash are. Each index key links its nodes to a leader first;
    components are contracted; only then do nodes of one key that are still in different components meet, and only
    pairs whose positions and parity sketches allow a link leave that join, at the first key that they share and few others
    (``_recent``). So a group of near copies costs links to its leader, not all pairs.
    """
    docs, least = docs.select("doc_id", "text"), _least(percent)
    spark, sketches, firsts = docs.sparkSession, scratch_path(docs.sparkSession, "sketches"), scratch_path(docs.sparkSession, "first-prefixes")
    with arrow_rows(spark, 1_000):  # whole sets
        _sketched(_sets(docs, size), percent).write.parquet(sketches)
    sketched = spark.read.parquet(sketches)
    scanned, identity = sketched.select("doc_id", F.struct("n", "h", "h2").alias("own")), F.struct("n", "h", "h2")
    several = stored(sketched.groupBy("doc_id").agg(F.min(identity).alias("least"), F.max(identity).alias("most")).where("least <> most").select("doc_id", "least"), "several")
    if not several.isEmpty():
        scanned = scanned.join(several, "doc_id", "left").select("doc_id", F.coalesce("least", "own").alias("own"))
    scanned = stored(scanned.select("doc_id", "own.n", "own.h", "own.h2"), "documents")
    nodes = stored(scanned.where("n > 0").groupBy("h", "h2", "n").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_copies")), "nodes")
    hashes = nodes.where(F.col("n") >= least).select("node", F.col("h").alias("node_h"))

    counts = sketched.where(F.col("n") >= least).select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > FREQUENT)
    counts, bound = stored(counts, "frequent"), FREQUENT
    release(spark)
    while counts.where(F.col("docs") > bound).count() > FREQUENT_ROWS:
        bound *= 2
    frequent = np.sort(np.array(counts.where(F.col("docs") > bound).select("t").toPandas()["t"], np.int64))

    # Only nodes' sketches go on; prefixes alone are joined and what they were made from is deleted.
    rare = _rare_prefix(sketched.where(F.col("n") >= least).withColumnRenamed("doc_id", "node"), frequent, percent)
    own = nodes.select("node", F.col("n").alias("own_n"), F.col("h").alias("own_h"), F.col("h2").alias("own_h2"))
    first = rare.withColumn("stubborn", F.col("complete")).join(own, "node").where("n = own_n and h = own_h and h2 = own_h2")
    with arrow_rows(spark, 1_000):
        first.drop("own_n", "own_h", "own_h2", "h", "h2").dropDuplicates(["node"]).write.parquet(firsts)
    remove(spark, sketches)
    release(spark)
    first = spark.read.parquet(firsts)
    parities = stored(first.select("node", *(F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(SKETCH))), "parities")
    first = first.drop("sketch")
    stubborn = stored(first.where("stubborn").select("node").join(hashes, "node"), "stubborn-ids")
    whole = stored(_whole_sets(docs, stubborn, size).dropDuplicates(["node"]), "stubborn")
    again = _rare_prefix(whole.withColumnRenamed("set", "tokens"), frequent, percent)
    with arrow_rows(spark, 1_000):
        prefixes = stored(first.where("not stubborn").unionByName(again.withColumn("stubborn", F.lit(True))), "prefixes")
    remove(spark, firsts)
    release(spark)
    index = _index(prefixes, whole, percent)
    release(spark)

    # Each key's leader is the node with most of its order before the key's reach, the smallest on ties.
    leaders = index.groupBy("key").agg(F.max(F.struct("reach", -F.col("node"), "n")).alias("m")).select("key", (-F.col("m.col2")).alias("a"), F.col("m.n").alias("na"), F.col("m.reach").alias("ra"))
    star = (index.join(leaders, "key").select("a", "na", "ra", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"))
            .where("a <> b").where(_possible(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    tried = stored(star, "tried")
    links = stored(_verified(tried, prefixes, docs, hashes, size, percent), "links")
    labels = stored(connected_components(links), "labels")

    rest, final = _rest(index, labels, tried, parities, percent), labels
    if not rest.isEmpty():
        more = stored(_verified(rest, prefixes, docs, hashes, size, percent), "more")
        final = stored(connected_components(links.union(more)), "components")

    known = nodes.join(final, "node", "left").select("h", "h2", "n", F.coalesce("label", "node").alias("label"), "n_copies")
    rows = scanned.join(known, ["h", "h2", "n"], "left")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))
    lost = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.size(shingle_set(F.col("text"), size)).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return out.union(lost)
