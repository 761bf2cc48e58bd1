"""Repeat suppression: per key keep a row only if the last *kept* row is at least ``window_ms`` older."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.session import cut_lineage, in_portions, ship_package

# A block spans at most this many windows, and about this many rows, or one window of more: a task holds the distinct instants of a block.
BLOCK_WINDOWS = 64
BLOCK_ROWS = 1_000_000
NEVER = 1 << 60


def suppress_repeats(
    hits: DataFrame, keys: list[str], window_ms: int | dict[str, int], block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """Rows of ``hits`` that survive suppression; order within a key is ``(ts, seq)``, then the other columns.

    ``window_ms`` may differ by the value of the first key: then it is a mapping from its values; a value it lacks
    keeps its first row only. Rows with a null key are left out. A window of 0 keeps every row.

    Time is cut into cells of one window, each of which keeps one hit at most. A cell whose first hit comes a window or more
    after the key's hit before it keeps that hit whatever was kept earlier, so it begins a run of cells that depends on
    nothing before. Most hits of most keys end there: they are aggregated to their cell before the shuffle and
    never meet as rows. Only the distinct times of runs of several cells are followed further, see ``_follow_runs``.

    The hits are written out first, as they are read up to three times.
    """
    spark = hits.sparkSession
    ship_package(spark)
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    window = F.lit(NEVER) if isinstance(window_ms, dict) else F.lit(window_ms)
    for value, width in window_ms.items() if isinstance(window_ms, dict) else ():
        window = F.when(F.col(keys[0]) == value, F.lit(width)).otherwise(window)
    rows = hits.filter(known).withColumn("_w", window.cast("bigint"))
    rows = cut_lineage(rows.withColumn("_cell", F.floor(F.col("ts") / F.greatest("_w", F.lit(1))).cast("bigint")))
    limited = rows.filter("_w > 0")
    rest = [c for c in hits.columns if c not in (*keys, "ts", "seq")]
    cells = limited.groupBy(*keys, "_w", "_cell").agg(F.min(F.struct("ts", "seq", *rest)).alias("_row"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("_n"))
    cells = cut_lineage(_runs(cells, keys, block_windows))
    kept = cells.filter("_begins").select(*keys, "_row.*").select(*hits.columns)
    kept = kept.unionByName(rows.filter("_w <= 0").select(*hits.columns))
    linked = cells.filter("not _alone").drop("_row", "_last", "_n")
    most = linked.agg(F.max("_blocks")).first()[0]
    if most is None:
        return kept
    times = limited.select(*keys, "_cell", "ts").join(linked, [*keys, "_cell"]).select(*RUN, "ts").distinct()
    later = _follow_runs(times, most > 0).join(linked.select(*keys, "_run", "_cell"), ["_run", "_cell"]).select(*keys, "_cell", "ts")
    # several hits at one instant: only the first may stay
    found = limited.join(later, [*keys, "_cell", "ts"], "left_semi").groupBy(*keys, "ts").agg(F.min(F.struct("seq", *rest)).alias("_row"))
    return kept.unionByName(found.select(*keys, "ts", "_row.*").select(*hits.columns))


#: What the hits of a run know of it: its number, window, the time of its first hit, their cell, block, the block's start and the number of the last block.
RUN = ["_run", "_w", "_begin", "_cell", "_block", "_start", "_blocks"]


def _runs(cells: DataFrame, keys: list[str], block_windows: int) -> DataFrame:
    """Adds the columns of ``RUN``, ``_begins`` (first cell of its run) and ``_alone`` (its only cell).

    The windows by key run over one row per cell.
    """
    by_key = Window.partitionBy(*keys).orderBy("_cell")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("_last").over(by_key)
    marked = cells.withColumn("_begins", before.isNull() | (F.col("_row.ts") - before >= F.col("_w")))
    marked = marked.withColumn("_alone", F.col("_begins") & F.coalesce(F.lead("_begins").over(by_key), F.lit(True)))
    first = F.when(F.col("_begins"), F.struct(F.monotonically_increasing_id().alias("run"), F.col("_cell").alias("cell"), F.col("_row.ts").alias("ts")))
    marked = marked.withColumn("_first", first).withColumn("_first", F.last("_first", ignorenulls=True).over(so_far))
    marked = marked.withColumns({"_run": F.col("_first.run"), "_begin": F.col("_first.ts")})
    in_run = Window.partitionBy(*keys, "_run").orderBy("_cell")
    earlier = F.coalesce(F.sum("_n").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both parts only grow along a run, so their sum changes where either does
    by_windows = F.floor((F.col("_cell") - F.col("_first.cell")) / F.lit(max(block_windows, 2)))
    marked = marked.withColumn("_block", (by_windows + F.floor(earlier / F.lit(BLOCK_ROWS))).cast("bigint"))
    marked = marked.withColumn("_start", F.min("_cell").over(Window.partitionBy(*keys, "_run", "_block")) * F.col("_w"))
    return marked.withColumn("_blocks", F.max("_block").over(Window.partitionBy(*keys, "_run"))).drop("_first")


def _follow_runs(times: DataFrame, blocked: bool) -> DataFrame:
    """(_run, _cell, ts) of the kept hits of runs after their first, from the distinct times of their hits.

    From a time ``t`` on, the next kept hit is the first one at or after ``t``, and the search resumes a window later. Runs are
    solved in blocks that different tasks may hold; the first block resumes a window after the run's first hit. The search
    enters a further block less than one window after the block's start, so only the hits of its first window, and the
    first hit after that, can be the block's first kept hit. For each of these entries the block's last kept hit (its exit)
    is found; following entry to exit runs over that small table. A last pass lists the kept hits per block. All passes stream
    over sorted rows and hold one block at a time; runs of one block, the usual case, take part in the last pass only, and the
    others are left out of the plan unless a run is ``blocked``.
    """
    parts = ["_run", "_w", "_block", "_start"]
    entered = times.filter("_block = 0").select(*parts, "ts", (F.col("_begin") + F.col("_w")).alias("_free"))
    if blocked:
        long_runs = times.filter("_blocks > 0").select(*parts, "ts")
        exits = _sorted(long_runs, ["_run", "_block"], "ts").mapInArrow(_exits, "_run bigint, _w bigint, _block bigint, _entry bigint, _exit bigint")
        picks = _sorted(exits, ["_run"], "_block", "_entry").mapInArrow(_chain, "_run bigint, _block bigint, _free bigint")
        entered = entered.unionByName(times.filter("_block > 0").join(picks, ["_run", "_block"]).select(*parts, "ts", "_free"))
    # a third column: a repartition by the join's own keys would be taken for done, and a join turned broadcast undoes it
    return _sorted(entered, ["_run", "_block", "_start"], "ts").mapInArrow(_list_kept, "_run bigint, _cell bigint, ts bigint")


def _sorted(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Consecutive rows of one (run, block): its constants and its columns as arrays, one group at a time."""
    held: list[dict[str, np.ndarray]] = []
    current = None

    def close() -> dict:
        columns = {name: np.concatenate([part[name] for part in held]) for name in held[0]}
        return columns | {name: int(columns[name][0]) for name in ("_run", "_w", "_block", "_start")}

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch[name].to_numpy() for name in batch.schema.names}
        runs, blocks = columns["_run"], columns["_block"]
        cuts = np.flatnonzero((runs[1:] != runs[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(runs)], strict=True):
            if (runs[a], blocks[a]) != current:
                if held:
                    yield close()
                held, current = [], (runs[a], blocks[a])
            held.append({name: column[a:b] for name, column in columns.items()})
    if held:
        yield close()


def _portions(groups: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Small groups of result rows put together to batches."""
    for portion in in_portions(groups, lambda columns: sum(c.nbytes for c in columns.values())):
        yield pa.RecordBatch.from_pydict({name: np.concatenate([p[name] for p in portion]) for name in portion[0]})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(group: dict) -> dict[str, np.ndarray]:
        t, window = group["ts"], group["_w"]
        entries = np.arange(min(np.searchsorted(t, group["_start"] + window) + 1, len(t)))
        last = t[_ends(t, entries, window)]
        # neighbours with one exit are interchangeable: keep the latest entry of each run
        keep = np.append(last[1:] != last[:-1], True)
        size = int(keep.sum())
        same = {name: np.full(size, group[name], np.int64) for name in ("_run", "_w", "_block")}
        return same | {"_entry": t[entries][keep], "_exit": last[keep]}

    yield from _portions(map(of, _groups(batches)))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the search enters each block; rows come by run, block and entry, and only the last step is remembered."""
    run, block, free = None, None, -NEVER
    for batch in batches:
        out: list[tuple] = []
        for row_run, window, row_block, entry, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_run != run:
                run, block, free = row_run, None, -NEVER
            if (block is None or row_block > block) and entry >= free:
                out.append((run, row_block, free))
                block, free = row_block, last + window
        columns = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_run", "_block", "_free"])


def _list_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def of(group: dict) -> dict[str, np.ndarray]:
        t = group["ts"]
        kept = t[_follow(t, int(np.searchsorted(t, group["_free"][0])), group["_w"])]
        return {"_run": np.full(len(kept), group["_run"], np.int64), "_cell": kept // group["_w"], "ts": kept}

    yield from _portions(map(of, _groups(batches)))


def _ends(t: np.ndarray, at: np.ndarray, window_ms: int) -> np.ndarray:
    """Positions at which the chains from ``at`` end."""
    while True:
        following = np.searchsorted(t, t[at] + window_ms)
        going = following < len(t)
        if not going.any():
            return at
        at = np.where(going, following, at)


def _follow(t: np.ndarray, at: int, window_ms: int) -> np.ndarray:
    """Positions visited from ``at``."""
    path = []
    while at < len(t):
        path.append(at)
        at = int(np.searchsorted(t, t[at] + window_ms))
    return np.array(path, np.int64)
