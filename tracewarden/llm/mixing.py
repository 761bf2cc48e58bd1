"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The expected copies are prefix-summed
within the source, one random offset is added, and a document is emitted once per integer boundary its own
stretch crosses. Documents are ordered by size, so the words taken miss a source's target by at most about
one largest document.

The prefix sum never runs over a source in one task: rows are numbered inside (source, size, portion) cells
and the cells' counts, one row each, carry the running totals.

Edge cases: a null text has size 0; null sources form one source, the last one; a source of size 0 has target
0 and gives no copies; rows that repeat are separate documents; an empty table gives an empty result; columns
of the input stay as they are, except that ``size``, ``source_size``, ``target`` and ``copies`` are set.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewarden.llm.common import shield, word_count

PORTIONS = 64


def offset_of(seed: int) -> float:
    """The one random offset, a multiple of 1/1024, so that sums with whole rates stay exact."""
    return random.Random(seed).randrange(1024) / 1024


def targets(sources: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source goes in.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. No target
    exceeds ``cap`` times its source; what is cut is shared again by weight. That process ends where capped
    sources are those of smallest cap/weight ratio, so it is solved by one running sum over that order.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_turn", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    weight = F.lit(float(weights[0]))
    for turn, value in enumerate(weights[1:], start=1):
        weight = F.when(F.col("_turn") == turn, F.lit(float(value))).otherwise(weight)
    size = F.col("source_size").cast("double")
    weighed = weighed.withColumn("_w", weight).withColumn("_cap", size * cap).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum(size).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    # the level that holds if exactly the sources before this one are capped; the first that needs no further cap is it
    tried = weighed.withColumn("_try", level)
    found = F.min(F.when(F.col("_try") <= F.col("_ratio"), F.struct("_ratio", "_try"))).over(whole)["_try"]
    return tried.withColumn("_level", found).select(
        "source", "source_size", F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_level")), F.col("_cap")).alias("target")
    )


def systematic_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    cap: float = 3.0,
    seed: int = 17,
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` (its source's) and ``copies`` to take of each."""
    rows, own, kept = shield(docs, ("size", "source_size", "target", "copies"))
    ident = own[id_col]
    whole_ids = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    portion = F.coalesce(F.pmod(ident if whole_ids else F.xxhash64(ident), F.lit(PORTIONS)), F.lit(0)).cast("int")
    sized = rows.select("*", word_count(own[text_col]).alias("size"), own[source_col].alias("_source"), portion.alias("_portion"))
    cells = sized.groupBy("_source", "size", "_portion").agg(F.count(F.lit(1)).alias("_n"))
    levels = cells.groupBy("_source", "size").agg(F.sum("_n").alias("_n"))
    earlier = lambda *keys: W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    levels = levels.select(
        F.col("_source").alias("_s1"), F.col("size").alias("_z1"),
        F.coalesce(F.sum("_n").over(earlier("_source").orderBy("size")), F.lit(0)).alias("_below"), "_n",
    )
    goals = targets(
        levels.groupBy(F.col("_s1").alias("source")).agg(F.sum(F.col("_z1") * F.col("_n")).alias("source_size")), weights, cap
    ).select(F.col("source").alias("_s2"), "source_size", "target")
    cells = cells.select(
        F.col("_source").alias("_s0"), F.col("size").alias("_z0"), F.col("_portion").alias("_p0"),
        F.coalesce(F.sum("_n").over(earlier("_source", "size").orderBy("_portion")), F.lit(0)).alias("_inside"),
    )
    starts = (
        cells.join(levels, F.col("_s0").eqNullSafe(F.col("_s1")) & (F.col("_z0") == F.col("_z1")))
        .join(goals, F.col("_s0").eqNullSafe(F.col("_s2")))
        .select("_s0", "_z0", "_p0", (F.col("_below") + F.col("_inside")).alias("_start"), "source_size", "target")
    )
    in_cell = W.partitionBy("_source", "size", "_portion").orderBy(ident.asc_nulls_first(), F.xxhash64(own[text_col]))
    placed = sized.withColumn("_row", F.row_number().over(in_cell)).join(
        starts,
        F.col("_source").eqNullSafe(F.col("_s0")) & (F.col("size") == F.col("_z0")) & (F.col("_portion") == F.col("_p0")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("_start") + F.col("_row")
    upto = lambda n: F.floor(rate * n + F.lit(offset_of(seed)))
    return placed.select(
        *[own[c].alias(c) for c in kept], "size", "source_size", "target", (upto(rank) - upto(rank - 1)).cast("long").alias("copies")
    )


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: the input's own columns, each document as often as it is taken."""
    rows, own, _ = shield(docs)
    names = {role: own[options.pop(role, default)] for role, default in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    inside = {role: rows.select(column).columns[0] for role, column in names.items()}
    counted = systematic_copies(rows, **inside, **options).filter("copies > 0")
    repeated = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[own[c].alias(c) for c in docs.columns])
