"""Bundle integrity as queries: inventories, manifests, key sets, recomputed tables, ordered checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.plans.storage import stored


def inventory(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of rows (path, content)."""
    return files.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def unsafe_path(path: Column) -> Column:
    """Absolute paths, parent references, drive letters, backslashes, empty parts."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.?(/|$)") | path.rlike("^[A-Za-z]:") | path.contains("//")


def issues(rows: DataFrame, rules: dict[str, Column], detail: Column) -> DataFrame:
    """One (code, detail) row for every rule that holds on a row. All rules are tested in one pass."""
    codes = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items())))
    return rows.select(F.explode(codes).alias("code"), detail.alias("detail"))


#: Limits of a bundle's members (fixed values): files, bytes of one, bytes of all, compression ratio.
LIMITS = {"files": 256, "member": 64 << 20, "total": 256 << 20, "ratio": 200}


def preflight(members: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Issues of an archive's inventory (path, bytes, packed): paths, sizes, ratios, duplicates, counts."""
    single = issues(members, {
        "PATH_UNSAFE": unsafe_path(F.col("path")), "MEMBER_TOO_LARGE": F.col("bytes") > limits["member"],
        "RATIO_TOO_HIGH": F.col("bytes") > limits["ratio"] * F.greatest("packed", F.lit(1))}, F.col("path"))
    repeated = duplicates(members, ["path"]).select(F.lit("MEMBER_DUPLICATE").alias("code"), F.col("path").alias("detail"))
    whole = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    total = issues(whole, {"TOO_MANY_FILES": F.col("n") > limits["files"], "TOTAL_TOO_LARGE": F.col("bytes") > limits["total"]}, F.lit(""))
    return single.unionByName(repeated).unionByName(total)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def manifest_audit(manifest: DataFrame, members: DataFrame) -> DataFrame:
    """Issues between declared and actual (path, bytes, sha256): missing, unlisted, wrong hash or size, duplicates, order.

    One full outer join on the path; ``manifest`` has ``position`` from 0 for the order check.
    """
    declared = manifest.groupBy("path").agg(F.min("bytes").alias("want_bytes"), F.min("sha256").alias("want_sha"))
    actual = members.groupBy("path").agg(F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    joined = declared.withColumn("declared", F.lit(True)).join(actual.withColumn("actual", F.lit(True)), "path", "full_outer")
    found = issues(joined, {
        "MEMBER_MISSING": F.col("actual").isNull(), "MEMBER_UNLISTED": F.col("declared").isNull(),
        "HASH_MISMATCH": F.col("want_sha") != F.col("sha256"), "SIZE_MISMATCH": F.col("want_bytes") != F.col("bytes")}, F.col("path"))
    twice = duplicates(manifest, ["path"]).select(F.lit("MANIFEST_DUPLICATE").alias("code"), F.col("path").alias("detail"))
    before = manifest.select((F.col("position") + 1).alias("position"), F.col("path").alias("before"))
    order = manifest.join(before, "position").where("path < before").select(F.lit("MANIFEST_ORDER").alias("code"), F.col("path").alias("detail"))
    return found.unionByName(twice).unionByName(order)


def key_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: (side, keys). Two anti-joins."""
    missing = expected.select(*keys).distinct().join(actual, keys, "left_anti").select(F.lit("MISSING").alias("side"), *keys)
    extra = actual.select(*keys).distinct().join(expected, keys, "left_anti").select(F.lit("EXTRA").alias("side"), *keys)
    return missing.union(extra)


def same_keys(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether both sides have the same set of keys."""
    return key_difference(expected, actual, keys).agg((F.count(F.lit(1)) == 0).alias("same"))


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], *, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose columns differ by more than the tolerance or that one side lacks: (keys, path, left, right)."""
    joined = left.select(*keys, *(F.col(c).alias(f"l_{c}") for c in columns), F.lit(True).alias("_l")).join(
        right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(True).alias("_r")), keys, "full_outer")
    cells = F.array(*(F.struct(F.lit(c).alias("path"), F.col(f"l_{c}").cast("double").alias("left"), F.col(f"r_{c}").cast("double").alias("right")) for c in columns))
    long = joined.select(*keys, "_l", "_r", F.explode(cells).alias("x")).select(*keys, "_l", "_r", "x.*")
    differ = F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left").eqNullSafe(F.col("right")) & ~F.coalesce(F.abs(F.col("left") - F.col("right")) <= tolerance, F.lit(False))
    return long.where(differ).drop("_l", "_r")


def class_deltas(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of each class on both sides and their difference; an absent class counts 0."""
    a, b = left.groupBy(key).agg(F.count(F.lit(1)).alias("a")), right.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("a", F.lit(0)).alias("left"), F.coalesce("b", F.lit(0)).alias("right"), (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))


def orphans(children: DataFrame, parents: DataFrame, key: str, expected: int) -> DataFrame:
    """Child rows without a parent, and parents whose number of children isn't the expected one."""
    lost = children.join(parents.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit("ORPHAN").alias("code"), key, "n")
    counts = parents.select(key).distinct().join(children.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(F.lit("COUNT").alias("code"), key, F.coalesce("n", F.lit(0)).alias("n"))
    return lost.union(counts.where(F.col("n") != expected))


def first_failure(rows: DataFrame, checks: dict[str, Column], passed: str) -> DataFrame:
    """``status``: the first check, in order, that doesn't hold, or ``passed``; ``failed`` counts all that don't."""
    status, failed = F.lit(passed), F.lit(0)
    for name, ok in reversed(list(checks.items())):
        status = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(status)
    for ok in checks.values():
        failed = failed + (~F.coalesce(ok, F.lit(False))).cast("int")
    return rows.withColumn("status", status).withColumn("failed", failed)


def receipt_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and 16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 16))


def seed_of(text: Column) -> Column:
    """An unsigned 64-bit seed from the first 16 hex digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def from_spine(spine: DataFrame, facts: DataFrame, keys: list[str], fill: dict[str, Column]) -> DataFrame:
    """Every spine row with its facts; columns of absent facts get the given values."""
    joined = spine.join(facts, keys, "left")
    return joined.select(*keys, *(F.coalesce(F.col(c), v).alias(c) for c, v in fill.items()))


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns; absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def numbered(rows: DataFrame, order: list[Column], out: str = "rank", *, first: int = 1) -> DataFrame:
    """Rows with their place in a total order. Rows are dealt by ranges of the order and written; a partition's numbers
    begin after the sizes of those before it, so no task sees more than its range."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(dealt, "numbered")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        out, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + first).drop("_at", "_part", "_before")


def ranked(rows: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Competition order without ties: 1 is first."""
    return numbered(rows, order, out)


def defaults(rows: DataFrame, values: dict[str, object]) -> DataFrame:
    """Nulls of the named columns become the given values."""
    return rows.select(*(F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c) for c in rows.columns))
