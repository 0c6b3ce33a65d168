"""Registration and small helpers for the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named columns (all doubles, if none is named); -0.0 becomes 0.0."""
    chosen = names or tuple(c for c, t in df.dtypes if t == "double")
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if c in chosen else F.col(c) for c in df.columns))


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def result(df: DataFrame) -> DataFrame:
    return longs(rounded(df))


class Registry:
    """Collects functions and their SQL under one name."""

    def __init__(self) -> None:
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def put(function):
            self.queries[function.__name__] = function
            if sql is not None:
                self.sql[function.__name__] = sql
            return function

        return put


def with_ctes(ctes: dict[str, str], names: str, select: str, recursive: bool = False) -> str:
    """``WITH`` the named common tables, in the order given, and a final select."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({ctes[n].strip()})" for n in names.split()) + "\n" + select


def r(expression: str, name: str, digits: int = 6) -> str:
    """A rounded column in SQL."""
    return f"round({expression}, {digits}) + 0.0 AS {name}"
