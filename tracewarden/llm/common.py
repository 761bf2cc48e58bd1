"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the corpus operators see it.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns cannot clash."""
    return df.select(*[df[f"`{column}`"].alias(name) for name, column in columns.items()])


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unsigned_part(value: Column) -> Column:
    """A hash as a number from 0 to 2^62 - 1, so that differences fit a long."""
    return F.shiftrightunsigned(value, 2)


def shield(df: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """The table with its columns numbered, so that no name an operator uses inside can clash; the columns by their
    own names; and the names the result keeps, which are all but those it sets itself."""
    inside = {name: F.col(f"in{i}") for i, name in enumerate(df.columns)}
    kept = [c for c in df.columns if c.lower() not in replaced]
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))]), inside, kept
