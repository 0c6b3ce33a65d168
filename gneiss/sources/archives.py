"""Archives and folders as sources, and deterministic archives as sinks.

An archive's listing is audited before anything in it is unpacked; members are then read one at a time.
"""

from __future__ import annotations

import csv
import hashlib
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators.audit import LIMITS, issues, unsafe_path
from gneiss.sources.documents import bundle_bytes, canonical_json, number_or_null

#: Rows handed on at a time.
ROWS = 10_000
#: A table of a bundle has at most so many rows; bundles are small by definition.
MOST_ROWS = 1_000_000


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, bytes, packed) of ZIP archives, from their directories alone."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    yield pd.DataFrame([(name, x.filename, x.file_size, x.compress_size) for x in archive.infolist()], columns=["archive", "path", "bytes", "packed"])

    return _archives(spark, path).mapInPandas(run, "archive string, path string, bytes long, packed long")


def archive_findings(members: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(archive, code, detail): paths, sizes, ratios, repeats and totals, archive by archive."""
    rows = members.select("archive", F.struct("archive", "path").alias("at"), "path", "bytes", "packed")
    single = issues(rows, {
        "PATH_UNSAFE": unsafe_path(F.col("path")), "MEMBER_TOO_LARGE": F.col("bytes") > limits["member"],
        "RATIO_TOO_HIGH": F.col("bytes") > limits["ratio"] * F.greatest("packed", F.lit(1))}, F.col("at")).select("detail.archive", "code", F.col("detail.path").alias("detail"))
    twice = members.groupBy("archive", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("archive", F.lit("MEMBER_DUPLICATE").alias("code"), F.col("path").alias("detail"))
    whole = members.groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    total = issues(whole, {"TOO_MANY_FILES": F.col("n") > limits["files"], "TOTAL_TOO_LARGE": F.col("bytes") > limits["total"]}, F.col("archive"))
    return single.union(twice).union(total.select(F.col("detail").alias("archive"), "code", F.lit("").alias("detail")))


def read_members(spark: SparkSession, path: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(archive, path, bytes, packed, content) of archives whose listing has no finding; others are not unpacked."""
    bad = archive_findings(list_members(spark, path), limits).select(F.col("archive").alias("path")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for x in archive.infolist():
                        yield pd.DataFrame([(name, x.filename, x.file_size, x.compress_size, archive.read(x))], columns=["archive", "path", "bytes", "packed", "content"])

    return _archives(spark, path).join(bad, "path", "left_anti").mapInPandas(run, "archive string, path string, bytes long, packed long, content binary")


def station_of(name: Column, stations: list[str], form: str = "_{}_") -> Column:
    """The one registered station whose name stands in a file's name; none or several are an error."""
    found = F.array_compact(F.array(*(F.when(name.contains(form.format(s)), F.lit(s)) for s in stations)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no single registered station in "), name)))


def read_station_archive(spark: SparkSession, path: str, stations: list[str], columns: list[str], *, sha256: str | None = None) -> DataFrame:
    """Rows of every CSV member of a ZIP archive: station (from the member's name), member, member_sha256, member_bytes,
    position (from 0), and ``columns`` as text.

    With ``sha256`` an archive with another digest is an error before anything is unpacked. A member whose header isn't
    ``columns`` is an error. Members are read one at a time and handed on in parts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} is not the archive that was registered")
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        if not info.filename.lower().endswith(".csv"):
                            continue
                        payload = archive.read(info)
                        digest, reader = hashlib.sha256(payload).hexdigest(), csv.reader(io.TextIOWrapper(io.BytesIO(payload), "utf-8-sig", newline=""))
                        if next(reader, None) != columns:
                            raise ValueError(f"unexpected header in {info.filename}")
                        rows, at = [], 0
                        for row in reader:
                            rows.append((info.filename, digest, len(payload), at, *row))
                            at += 1
                            if len(rows) == ROWS:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                        yield pd.DataFrame(rows, columns=names)

    names = ["member", "member_sha256", "member_bytes", "position", *columns]
    schema = "member string, member_sha256 string, member_bytes long, position long, " + ", ".join(f"`{c}` string" for c in columns)
    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return read.withColumn("station_from_name", station_of(F.col("member"), stations))


def station_report(rows: DataFrame, *, hour: Column, label: str, value: str) -> DataFrame:
    """One row a station, in the order of their names: member and its digest, rows, repeated hours, whether the source's
    order is hourly, labels that differ from the file's name, values that are negative or not numbers."""
    from pyspark.sql import Window

    order = Window.partitionBy("station_from_name").orderBy("position")
    known = ~F.upper(F.trim(F.col(value))).isin("", "NA", "NAN")
    number = number_or_null(value)
    marked = rows.withColumn("_hour", hour).withColumn("_step", F.unix_timestamp("_hour") - F.unix_timestamp(F.lag("_hour").over(order)))
    out = marked.groupBy("station_from_name").agg(
        F.min("member").alias("member"), F.min("member_sha256").alias("member_sha256"), F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("_hour")).alias("repeated"),
        F.coalesce(F.bool_and(F.col("_step") == 3600), F.lit(True)).alias("hourly"), F.count_if(~F.col(label).eqNullSafe(F.col("station_from_name"))).alias("mislabelled"),
        F.count_if(known & F.coalesce((number < 0) | number.isNull(), F.lit(True))).alias("invalid"))
    return out.withColumnRenamed("station_from_name", "station").orderBy("station")


def read_directory(spark: SparkSession, folder: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """(path, bytes, content) of a bundle laid out as a folder; links and folders beyond the limits are errors.

    The listing goes through Hadoop's file system on the driver and stops at the limit; contents are read by executors.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(conf)
    local = jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw() if system.getScheme() == "file" else None
    waiting, files, total = [root], 0, 0
    while waiting:
        for status in system.listStatus(waiting.pop()):
            # Hadoop's local file system follows links; Java's own doesn't.
            if status.isSymlink() or local is not None and jvm.java.nio.file.Files.isSymbolicLink(local.pathToFile(status.getPath()).toPath()):
                raise ValueError(f"{status.getPath()} is a link")
            if status.isDirectory():
                waiting.append(status.getPath())
                continue
            files, total = files + 1, total + status.getLen()
            if files > limits["files"] or status.getLen() > limits["member"] or total > limits["total"]:
                raise ValueError("the folder is larger than a bundle may be")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = system.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    return whole.select(F.element_at(F.split("path", base.replace("\\", "\\\\"), 2), -1).alias("path"), F.col("length").alias("bytes"), "content")


def normalized_lines(files: DataFrame) -> DataFrame:
    """(path, content, sha256, old_sha256, changed) of text files (path, content) with line feeds at all line ends."""
    text = F.decode("content", "UTF-8")
    clean = F.encode(F.regexp_replace(text, "\r\n?", "\n"), "UTF-8")
    return files.select("path", clean.alias("content"), F.sha2(clean, 256).alias("sha256"), F.sha2("content", 256).alias("old_sha256")).withColumn("changed", F.col("sha256") != F.col("old_sha256"))


def rehashed(manifest: DataFrame, normalized: DataFrame) -> DataFrame:
    """A manifest (path, sha256, ...) with the new digests of normalized files; a digest that was wrong before stays."""
    new = normalized.select("path", F.col("sha256").alias("_new"), F.col("old_sha256").alias("_old"))
    joined = manifest.join(new, "path", "left")
    return joined.select(*(F.when(F.col("sha256") == F.col("_old"), F.col("_new")).otherwise(F.col("sha256")).alias(c) if c == "sha256" else F.col(c) for c in manifest.columns))


def content_scan(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(path, line, code) of every line of (path, content) that a rule's pattern matches; lines from 1."""
    lines = files.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n", -1)).alias("at", "line"))
    codes = F.array_compact(F.array(*(F.when(F.col("line").rlike(pattern), F.lit(code)) for code, pattern in rules.items())))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(codes).alias("code"))


def npz_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """An NPZ archive that depends on its arrays alone: sorted names, fixed times, no compression. A sink for small
    arrays that the driver holds already; ``numpy.load`` reads it."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name in sorted(arrays):
            member = io.BytesIO()
            np.lib.format.write_array(member, np.ascontiguousarray(arrays[name]), version=(1, 0), allow_pickle=False)
            info = zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0))
            info.external_attr = 0o644 << 16
            archive.writestr(info, member.getvalue())
    return out.getvalue()


def study_bundle(tables: dict[str, DataFrame], *, profile: str, required: list[str], documents: dict[str, object] | None = None, most_rows: int = MOST_ROWS) -> bytes:
    """A bundle of a study's small tables: each a member ``tables/NAME.jsonl`` of canonical JSON rows in sorted order, beside
    documents and a profile that names the required members. A missing member or a larger table is an error."""
    members = {"profile.json": canonical_json({"profile": profile, "required_members": sorted(required), "interpolation_used_for_metrics": False}).encode()}
    for name, value in (documents or {}).items():
        members[name] = canonical_json(value).encode()
    for name, df in tables.items():
        rows = [r[0] for r in df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})).limit(most_rows + 1).collect()]
        if len(rows) > most_rows:
            raise ValueError(f"{name} has over {most_rows} rows")
        members[f"tables/{name}.jsonl"] = "".join(x + "\n" for x in sorted(rows)).encode()
    if missing := sorted(set(required) - set(members)):
        raise ValueError(f"missing members: {missing}")
    return bundle_bytes(members)

