"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until they fit.

Documents are ordered by a hash of the text, then of the id. Each round counts, over all partitions, the exact
bytes between 256 probes inside the bracket of every splitter that is still open, and narrows its bracket to
the two probes around its target. A splitter is settled when the bytes below a probe are within ``tolerance``
of the target; only if one hash value alone holds too much (a large group of equal texts) is it refined within
that group by the id's hash. So equal texts share a shard unless their group is larger than the tolerance.
At most 2 x 8 rounds are needed, each reading only the narrow key table; then the documents are exchanged once.

Edge cases: a null text weighs 1 and hashes as null; empty texts weigh 1; rows equal in text and id cannot be
told apart and share a shard; an empty table gives an empty result; columns of the input stay as they are,
except that ``size``, ``shard`` and ``slot`` are set.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm.common import shield, unsigned_part
from tracewarden.session import cut_lineage

PROBES = 256
KEY_RANGE = 1 << 62
SLOT_ROWS = 200_000


@dataclass
class Splitter:
    """Rows at or above (key, second) lie to its right; ``prefix`` is set while refining inside one key."""

    target: float
    below: int = 0
    low: int = 0
    high: int = KEY_RANGE
    prefix: int | None = None
    found: tuple[int, int] | None = None

    def bracket(self) -> tuple[int | None, int, int]:
        return (self.prefix, self.low, self.high)

    def at(self, boundary: int) -> tuple[int, int]:
        return (boundary, 0) if self.prefix is None else (self.prefix, boundary)


def _counts(keys: DataFrame, brackets: list[tuple[int | None, int, int]]) -> dict[int, dict[int, tuple[int, int]]]:
    """Exact (bytes, rows) per bracket and interval between probes. At most 256 rows per bracket come back."""
    number, interval = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (prefix, low, high) in enumerate(brackets):
        column = F.col("key") if prefix is None else F.col("second")
        inside = (column >= low) & (column < high)
        if prefix is not None:
            inside &= F.col("key") == prefix
        width = -(-(high - low) // PROBES)
        number = F.when(inside, F.lit(i)).otherwise(number)
        interval = F.when(inside, F.expr(f"({'key' if prefix is None else 'second'} - {low}L) div {width}L")).otherwise(interval)
    rows = (
        keys.select(number.alias("number"), interval.alias("interval"), "size")
        .filter("number is not null")
        .groupBy("number", "interval")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    out: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in range(len(brackets))}
    for row in rows:
        out[row["number"]][row["interval"]] = (row["bytes"], row["rows"])
    return out


def _narrow(one: Splitter, counts: dict[int, tuple[int, int]], slack: float) -> None:
    """Settle a splitter, or move its bracket to the interval that holds its target."""
    width = -(-(one.high - one.low) // PROBES)
    below, last = one.below, one.low
    for interval in sorted(counts):
        size, rows = counts[interval]
        start = one.low + interval * width
        end = min(start + width, one.high)
        if below + size >= one.target:
            nearer = start if one.target - below <= below + size - one.target else end
            if one.target - below <= slack:
                one.found = one.at(start)
            elif below + size - one.target <= slack:
                one.found = one.at(end)
            elif rows == 1 or (end - start == 1 and one.prefix is not None):
                one.found = one.at(nearer)
            elif end - start == 1:
                one.prefix, one.low, one.high, one.below = start, 0, KEY_RANGE, below
            else:
                one.low, one.high, one.below = start, end, below
            return
        below, last = below + size, end
    one.found = one.at(last)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005) -> tuple[list[tuple[int, int]], int]:
    """Boundaries (key, second) between the shards, and the number of rows. ``keys`` has key, second and size."""
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    wanted = [Splitter(total["bytes"] * i / shards) for i in range(1, shards)]
    slack = tolerance * total["bytes"] / shards
    while open_ones := [s for s in wanted if s.found is None]:
        brackets = sorted({s.bracket() for s in open_ones}, key=repr)
        counts = _counts(keys, brackets)
        for one in open_ones:
            _narrow(one, counts[brackets.index(one.bracket())], slack)
    return sorted(s.found for s in wanted), total["rows"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005
) -> DataFrame:
    """The documents with ``size``, ``shard`` (0 to shards - 1, near equal bytes) and ``slot`` (0.. within it)."""
    rows_in, own, kept = shield(docs, ("size", "shard", "slot"))
    text, ident = own[text_col], own[id_col]
    key = [unsigned_part(F.xxhash64(text)).alias("_key"), unsigned_part(F.xxhash64(ident)).alias("_second")]
    keys = cut_lineage(rows_in.select(key[0].alias("key"), key[1].alias("second"), size_of(text).alias("size")))
    bounds, rows = splitters(keys, shards, tolerance)

    def shard(first: str, second: str) -> Column:
        number = F.lit(0)
        for k, s in bounds:
            past = (F.col(first) > k) | ((F.col(first) == k) & (F.col(second) >= s))
            number = number + F.when(past, 1).otherwise(0)
        return number.cast("int")

    portions = max(64, -(-rows // (shards * SLOT_ROWS)))
    portion = lambda second: F.pmod(F.col(second), F.lit(portions)).cast("int")
    counts = keys.groupBy(shard("key", "second").alias("_shard"), portion("second").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    placed = rows_in.select("*", size_of(text).alias("size"), *key).select(
        "*", shard("_key", "_second").alias("_shard"), portion("_second").alias("_part")
    )
    inside = W.partitionBy("_shard", "_part").orderBy("_key", "_second")
    numbered = placed.withColumn("_row", F.row_number().over(inside)).join(starts, ["_shard", "_part"])
    return numbered.select(
        *[own[c].alias(c) for c in kept], "size", F.col("_shard").alias("shard"), (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot")
    )
