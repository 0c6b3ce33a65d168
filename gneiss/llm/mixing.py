"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.plans.storage import stored

#: Names of the joined rates; they hold a character that no column of a table here does.
SOURCE, FIXED, STEPS, DRAWN, COUNT = (f"mix\u00b7{x}" for x in ("source", "fixed", "steps", "u", "count"))
#: A document's count ends where what is left of the distribution is below this.
TAIL = 1e-12
#: The table of sources is broadcast while it holds at most so many numbers (16 MB); beyond that AQE splits hot sources.
BROADCAST_STEPS = 2_000_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of ``seed|part|part...``; null parts count as ``''``."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def replication_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: str = "n_chars") -> DataFrame:
    """One row per source: its size, its target weight and the mean repetition rate that gives it.

    Sizes are summed over all rows (null or negative sizes count as 0). The mixture keeps the corpus's total size:
    a source with weight w (normalised) gets rate ``w * total / size of the source``. Without ``weights`` all
    sources weigh the same; a source that ``weights`` omits has weight 0. A source of size 0 has rate 0.
    A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(
        F.sum(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))).cast("double").alias("mix_size")
    )
    if weights is None:
        weighed = sizes.withColumn("mix_weight", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame(list(weights.items()), "mix_name string, w double")
        weighed = sizes.join(table, F.col("mix_source").eqNullSafe(F.col("mix_name")), "left").select(
            "mix_source", "mix_size", F.coalesce("w", F.lit(0.0)).alias("mix_weight")
        )
    total = weighed.agg(F.sum("mix_size").alias("total_size"), F.sum("mix_weight").alias("total_weight"))
    rate = F.when((F.col("mix_size") > 0) & (F.col("total_weight") > 0),
                  F.col("mix_weight") / F.col("total_weight") * F.col("total_size") / F.col("mix_size")).otherwise(0.0)
    return weighed.join(F.broadcast(total)).select("mix_source", "mix_size", "mix_weight", rate.alias("mix_rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution, until less than ``TAIL`` is left above.

    Rates over 500 are counted as the sum of a fixed number of whole repetitions and the rest, see ``replicate``.
    """
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"),
                        F.concat(acc["steps"], F.array(acc["cdf"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, *, size: str = "n_chars", seed: int = 1,
              partitions: int | None = None) -> DataFrame:
    """Repeat each document a Poisson number of times with its source's mean rate and shuffle the copies globally.

    The count inverts the Poisson distribution at a number in [0, 1) hashed from (seed, doc_id), so it depends on
    neither partitioning nor retries. Rows that share a doc_id share their count. Rates over 500 give their whole
    part as fixed repetitions and draw the rest. Each copy gets ``mix_copy`` (from 1) and ``mix_key``, an md5 of
    (seed, doc_id, copy); rows are dealt by it into ``partitions`` (default: ``spark.sql.shuffle.partitions``)
    and ordered by it inside, which orders the whole output at random. All input columns are kept; columns named
    ``mix_copy`` and ``mix_key`` in the input are replaced. Null and empty texts are ordinary rows; equal keys of rows that
    repeat a doc_id may come in any order. An empty table gives an empty one.

    Plan: one small aggregate by source (map-side combined, so a hot source is one row per task), a join back by
    source, and one exchange of the copies, salted by construction since the key is unique per copy.
    """
    keep = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    rates = replication_rates(docs, weights, size)
    whole = F.when(F.col("mix_rate") > 500, F.floor("mix_rate")).otherwise(F.lit(0)).cast("int")
    rates = stored(rates.select(F.col("mix_source").alias(SOURCE), whole.alias(FIXED), poisson_steps(F.col("mix_rate") - whole).alias(STEPS)), "mix-rates")
    steps = rates.agg(F.coalesce(F.sum(F.size(STEPS)), F.lit(0))).first()[0]
    if steps <= BROADCAST_STEPS:
        rates = F.broadcast(rates)
    rated = docs.select(*(F.col(c) for c in keep)).join(rates, F.col("source").eqNullSafe(F.col(SOURCE)))
    u = uniform(seed, F.col("doc_id"))
    count = F.col(FIXED) + F.size(F.filter(STEPS, lambda c: c <= F.col(DRAWN)))
    copies = (rated.withColumn(DRAWN, u).withColumn(COUNT, count).where(F.col(COUNT) > 0)
              .select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), F.col(COUNT).cast("long"))).alias("mix_copy")))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("mix_copy").cast("string")))
    copies = copies.withColumn("mix_key", key)
    dealt = copies.repartition(partitions, "mix_key") if partitions else copies.repartition("mix_key")
    return dealt.sortWithinPartitions("mix_key")
