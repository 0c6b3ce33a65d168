"""JSON and CSV sources and sinks around DataFrames, and the bytes of a bundle. Archives are read in ``archives``."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LADDER_PACK = T.StructType([
    T.StructField("domain_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("claim_authority", T.StringType()),
    T.StructField("ladder", T.ArrayType(T.DoubleType())), T.StructField("source", T.MapType(T.StringType(), T.StringType()))])

FIELD_POINT = T.StructType([
    T.StructField("grid_x", T.IntegerType()), T.StructField("grid_y", T.IntegerType()), T.StructField("classification", T.StringType()), T.StructField("eligible", T.BooleanType()),
    T.StructField("failure_id", T.StringType()), T.StructField("ui", T.DoubleType()), T.StructField("nss", T.DoubleType()), T.StructField("s_e", T.DoubleType()), T.StructField("winner_n", T.IntegerType()),
    T.StructField("trace", T.ArrayType(T.StructType([
        T.StructField("step", T.IntegerType()), T.StructField("stage", T.StringType()), T.StructField("coherence", T.DoubleType()), T.StructField("magnitude", T.DoubleType()),
        T.StructField("null_mean", T.DoubleType()), T.StructField("similarity", T.DoubleType())])))])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents of a known schema, one per file; malformed ones end the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def ladders_of(packs: DataFrame) -> DataFrame:
    """(ladder, pos, value) of packs whose ladders have at least four finite values."""
    finite = F.forall("ladder", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = packs.where(F.coalesce((F.size("ladder") >= 4) & finite, F.lit(False)))
    return good.select(F.col("domain_id").alias("ladder"), F.posexplode("ladder").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def read_station_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of CSV files whose header must be exactly ``columns``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def number_or_null(column: str):
    """A double of a text column; '', NA and NaN in any case, and what isn't a number, are null."""
    text = F.upper(F.trim(F.col(column)))
    return F.when(~text.isin("", "NA", "NAN"), F.expr(f"try_cast(`{column}` AS double)"))


def write_csv(df: DataFrame, path: str) -> None:
    """One header per file; non-finite numbers are empty."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.option("header", True).option("emptyValue", "").csv(path)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, no NaN, one line feed at the end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n"


def bundle_bytes(members: dict[str, bytes]) -> bytes:
    """A ZIP that depends on its members alone: sorted names, fixed times and modes, with a hash manifest.

    A sink for small result tables that the driver holds already.
    """
    listing = [{"path": k, "bytes": len(v), "sha256": hashlib.sha256(v).hexdigest()} for k, v in sorted(members.items())]
    every = members | {"manifest.json": canonical_json({"members": listing}).encode()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
        for name in sorted(every):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            archive.writestr(info, every[name])
    return out.getvalue()
