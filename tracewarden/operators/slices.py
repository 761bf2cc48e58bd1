"""Ordered per-key scans that never gather a whole key in one task.

A plain ``Window.partitionBy(key)`` sends everything a busy key ever did to one task. Here each
key is cut into time slices. A window runs inside every (key, slice); what the slice must know
of the key's past is one pre-aggregated row per slice, and only those rows (at most time span /
slice width per key) are scanned by key. The shuffle of the rows and the join of the carried
value use the same (key, slice) partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def with_slice(df: DataFrame, slice_ms: int, ts: str = "ts") -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(ts) / F.lit(slice_ms)).cast("bigint"))


def _before(keys: list[str]):
    """All earlier slices of the key."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, slice_ms: int
) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one.

    ``order`` starts with the time column. Key columns must not be null.
    """
    rows = with_slice(df, slice_ms, order[0])
    totals = rows.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    base = totals.select(
        *keys, SLICE, F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(base, [*keys, SLICE])
        .withColumn(out, (F.col("_base") + F.col("_inside")).cast("bigint"))
        .drop("_base", "_inside", SLICE)
    )


def latest_values(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    slice_ms: int,
    include_current: bool = True,
) -> DataFrame:
    """For each named value, its last non-null occurrence in the key up to this row (or strictly before).

    ``order`` starts with the time column. Key columns must not be null.
    """
    rows = with_slice(df, slice_ms, order[0]).withColumns({f"_v_{n}": v for n, v in values.items()})
    place = F.struct(*order)
    per_slice = rows.groupBy(*keys, SLICE).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_v_{n}") for n in values]
    )
    carried = per_slice.select(
        *keys, SLICE, *[F.last(f"_v_{n}", ignorenulls=True).over(_before(keys)).alias(f"_c_{n}") for n in values]
    )
    inside = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return (
        rows.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
        .join(carried, [*keys, SLICE])
        .select(*df.columns, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in values])
    )


def latest_value(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    out: str,
    slice_ms: int,
    include_current: bool = True,
) -> DataFrame:
    return latest_values(df, keys, order, {out: value}, slice_ms, include_current)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    out: str,
    slice_ms: int,
    tolerance_ms: int | None = None,
    right_first: bool = True,
) -> DataFrame:
    """Attach to every left row the latest right row (a struct) with ``(ts, seq)`` not after it.

    ``seq`` is the arrival number shared by both sides; where it ties, right rows count as
    earlier when ``right_first``. ``tolerance_ms`` bounds the age of the match inclusively.
    """
    side = F.lit(0 if right_first else 2)
    payload = F.struct(*[F.col(c) for c in right.columns])
    tagged = left.withColumn("_side", F.lit(1)).unionByName(
        right.select(*keys, "ts", "seq", payload.alias("_right")).withColumn("_side", side),
        allowMissingColumns=True,
    )
    matched = latest_value(tagged, keys, ["ts", "seq", "_side"], F.col("_right"), out, slice_ms)
    matched = matched.filter(F.col("_side") == 1).drop("_side", "_right")
    if tolerance_ms is not None:
        fresh = F.col("ts") - F.col(out)["ts"] <= tolerance_ms
        matched = matched.withColumn(out, F.when(fresh, F.col(out)))
    return matched
