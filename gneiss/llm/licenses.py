"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

DataFrame operations only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.notices import NOTICES

TEMPLATES = NOTICES


@dataclass(frozen=True)
class Bands:
    """``rows`` hashes a band, ``bands`` bands, shingles of ``shingle`` words, and the containment that counts.

    A window is as long as the template and starts at every ``stride``-th fraction of it. When a template's words
    stand in a text, some window misses at most 1/stride of it and holds as much that is foreign, so its Jaccard
    similarity to the template is at least (1 - 1/stride) * t / (2 - (1 - 1/stride) * t) for containment t; the
    chance that no band agrees is (1 - j ** rows) ** bands.
    """

    rows: int = 1
    bands: int = 24
    shingle: int = 2
    stride: int = 4
    contained: float = 0.8

    def miss(self) -> float:
        kept = (1 - 1 / self.stride) * self.contained
        return (1 - (kept / (2 - kept)) ** self.rows) ** self.bands


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, with points, hyphens and plus signs inside."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.+-]++|[.+-]++(?![\p{L}\p{N}])", " ")
    return F.array_remove(F.split(plain, " ", -1), "")


def template_words(text: str) -> list[str]:
    """``words`` for a template (ASCII) on the driver."""
    return re.sub(r"[^a-z0-9.+-]+|[.+-]+(?![a-z0-9])", " ", text.lower()).split()


def anchors(template: list[str], bands: Bands) -> list[str]:
    """Words of which a text must hold one to contain enough of the template: the longest first, until the
    shingles that hold one of them are more than may be missing."""
    shingles = [template[k : k + bands.shingle] for k in range(max(1, len(template) - bands.shingle + 1))]
    may_miss, chosen = (1 - bands.contained) * len(set(map(tuple, shingles))), []
    for word in sorted(set(template), key=lambda w: (-len(w), w)):
        chosen.append(word)
        if len({tuple(s) for s in shingles if set(s) & set(chosen)}) > may_miss + 1e-9:
            break
    return chosen


def shingle_array(run: Column, size: int) -> Column:
    """Distinct word shingles of an array of words (all of it, if shorter)."""
    return F.when(F.size(run) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(run) - size + 1), lambda k: F.array_join(F.slice(run, k, F.lit(size)), " ")))).otherwise(F.array(F.array_join(run, " ")))


def band_keys(shingles: Column, bands: Bands) -> Column:
    """One hash per band: of the band's number and the minima of its seeded hashes."""

    def minimum(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(seed))))

    return F.array(*(F.xxhash64(F.lit(b), *(minimum(b * bands.rows + r) for r in range(bands.rows))) for b in range(bands.bands)))


def template_table(spark: SparkSession, templates=TEMPLATES, bands: Bands = Bands()) -> DataFrame:
    """Rows (license, family, template, length, wanted, key) for every band of every template: a fixed small table."""
    rows = [(name, family, k, template_words(text)) for k, (name, family, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "license string, family string, template int, run array<string>")
    return (table.withColumn("wanted", shingle_array(F.col("run"), bands.shingle))
            .select("license", "family", "template", F.size("run").alias("length"), "wanted", F.explode(band_keys(F.col("wanted"), bands)).alias("key")))


WINDOWS = "array<struct<length:int,place:int,shingles:array<string>,around:array<string>>>"


def windows(run: Column, length: int, chosen: list[str], bands: Bands) -> Column:
    """Windows of ``length`` words at every stride that hold an anchor: place, shingles, and those of the window
    with a stride more at both ends, in which a match that the window cuts is whole."""
    stride = max(1, length // bands.stride)
    marks = F.array(*(F.lit(w) for w in chosen))
    places = F.filter(F.sequence(F.lit(0), F.size(run) - 1, F.lit(stride)), lambda k: F.arrays_overlap(F.slice(run, k + 1, F.lit(length)), marks))

    def window(k: Column) -> Column:
        begin = F.greatest(k - stride, F.lit(0))
        return F.struct(F.lit(length).alias("length"), k.alias("place"), shingle_array(F.slice(run, k + 1, F.lit(length)), bands.shingle).alias("shingles"),
                        shingle_array(F.slice(run, begin + 1, k + length + stride - begin), bands.shingle).alias("around"))

    return F.transform(places, window)


def scan(docs: DataFrame, templates=TEMPLATES, bands: Bands = Bands()) -> DataFrame:
    """``doc_id``, ``family``, ``license``, ``containment`` and ``place`` (the word, from 0, where its best window begins)
    of every family of license notices found in each whole text.

    A notice counts when some window, widened by a stride, contains at least ``bands.contained`` of a template's distinct
    shingles. Of a family's templates the one with the most shingles found is named; on ties the more contained, then the
    earlier place, then the first name. Texts without any template's anchor words cannot hold one and are left where they
    are read. Null and empty texts have none; texts of any length are scanned whole; rows that repeat a doc_id are one
    document; an empty table gives an empty one; other columns are left out. Marks of comments and line breaks don't
    matter. Only windows near anchors are hashed, and only matches are shuffled.
    """
    spark = docs.sparkSession
    by_length: dict[int, list[str]] = {}
    for _, _, text in templates:
        run = template_words(text)
        by_length.setdefault(len(run), []).extend(anchors(run, bands))
    every = sorted({w for chosen in by_length.values() for w in chosen})
    near = r"(?i)\b(?:" + "|".join(map(re.escape, every)) + r")\b"
    found = docs.where(F.col("text").rlike(near)).select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("run")).where(F.size("run") > 0)
    marked = found.select("doc_id", "run", F.array_intersect(F.array_distinct("run"), F.array(*map(F.lit, every))).alias("marks"))
    some = [F.when(F.arrays_overlap("marks", F.array(*map(F.lit, sorted(set(c))))), windows(F.col("run"), n, sorted(set(c)), bands)).otherwise(F.array().cast(WINDOWS)) for n, c in sorted(by_length.items())]
    spread = marked.select("doc_id", F.explode(F.concat(*some)).alias("w"))
    keyed = spread.select("doc_id", "w.length", "w.place", "w.around", F.explode(F.array_distinct(band_keys(F.col("w.shingles"), bands))).alias("key"))
    table = F.broadcast(template_table(spark, templates, bands))
    hits = keyed.join(table, ["length", "key"]).select("doc_id", "family", "license", "place", F.size(F.array_intersect("wanted", "around")).alias("matched"), F.size("wanted").alias("size"))
    hits = hits.withColumn("containment", F.round(F.col("matched") / F.col("size"), 6)).where(F.col("matched") >= bands.contained * F.col("size"))
    best = hits.groupBy("doc_id", "family").agg(F.min(F.struct((-F.col("matched")).alias("m"), (-F.col("containment")).alias("c"), "place", "license")).alias("b"))
    return best.select("doc_id", "family", "b.license", (-F.col("b.c")).alias("containment"), F.col("b.place").cast("long").alias("place"))
