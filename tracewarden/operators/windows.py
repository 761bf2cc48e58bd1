"""Rolling windows, sessions and per-key sequence operators.

Windows are inclusive ``[ts - window_ms, ts]`` in arrival order ``(ts, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.paths import is_git_path
from tracewarden.operators.slices import latest_value, running_sum


def rolling_sum(
    df: DataFrame, keys: list[str], value: Column, window_ms: int, out: str, slice_ms: int
) -> DataFrame:
    """Sum of ``value`` over the window ending at each row.

    Every row adds its value on arrival and takes it back one millisecond after the window has
    passed, so the rolling sum is a running sum of both: linear work however dense the window is.
    """
    rest = [c for c in df.columns if c not in keys]
    arrive = F.struct(F.col("ts").alias("_at"), F.lit(1).alias("_kind"), value.alias("_delta"))
    leave = F.struct((F.col("ts") + window_ms + 1).alias("_at"), F.lit(0).alias("_kind"), (-value).alias("_delta"))
    # the leaving copy carries no payload
    moves = df.select("*", F.inline(F.array(arrive, leave))).select(
        *keys, "_at", "_kind", "_delta", F.col("seq").alias("_seq"),
        *[F.when(F.col("_kind") == 1, F.col(c)).alias(c) for c in rest],
    )
    summed = running_sum(moves, keys, ["_at", "_kind", "_seq"], "_delta", out, slice_ms)
    return summed.filter(F.col("_kind") == 1).select(*df.columns, out)


def rolling_volume(volumes: DataFrame, window_ms: int, slice_ms: int = 10_000) -> DataFrame:
    """Adds ``total_out``: bytes the agent sent within the window."""
    known = volumes.filter(F.col("agent_id").isNotNull())
    return rolling_sum(known, ["agent_id"], F.col("bytes_out"), window_ms, "total_out", slice_ms)


def rolling_git_reads(file_events: DataFrame, window_ms: int, slice_ms: int = 10_000) -> DataFrame:
    """Reads of git metadata with ``git_rows``: how many such rows the agent had in the window."""
    git = file_events.filter(F.col("agent_id").isNotNull() & is_git_path(F.col("path")))
    return rolling_sum(git, ["agent_id"], F.lit(1), window_ms, "git_rows", slice_ms)


def rolling_distinct_reads(
    file_events: DataFrame, window_ms: int, method: str = "sweep", slice_ms: int = 10_000
) -> DataFrame:
    """Adds ``distinct_paths``: different paths of the (agent, repository) within the window.

    ``sweep``: a path counts from its first read until one window after its last; reads at most a
    window apart belong to one such interval. Intervals open with +1 and close with -1, and the
    count at a read is a running sum. Reads of one path inside one window-wide time cell are
    always in one interval, so they are pre-aggregated before anything is ordered.
    ``collect``: a set per row, for small inputs and as a cross-check.
    """
    known = file_events.filter(F.col("agent_id").isNotNull()).withColumn(
        "repo_root", F.coalesce("repo_root", F.lit("-"))
    )
    keys = ["agent_id", "repo_root"]
    if method == "collect":
        return _distinct_by_set(known, keys, window_ms)

    cells = known.groupBy(*keys, "path", F.floor(F.col("ts") / F.lit(window_ms)).alias("_cell")).agg(
        F.min(F.struct("ts", "seq")).alias("_first"), F.max("ts").alias("_last")
    )
    per_path = Window.partitionBy(*keys, "path").orderBy("_cell")
    opens = F.coalesce(F.col("_first.ts") - F.lag("_last").over(per_path) > window_ms, F.lit(True))
    closes = F.coalesce(F.lead("_first.ts").over(per_path) - F.col("_last") > window_ms, F.lit(True))
    edges = (
        cells.select(*keys, "_first", "_last", opens.alias("_opens"), closes.alias("_closes"))
        .select(
            *keys,
            F.inline(
                F.array(
                    F.struct(
                        F.col("_first.ts").alias("_at"), F.lit(1).alias("_kind"),
                        F.col("_first.seq").alias("_seq"), F.col("_opens").cast("int").alias("_delta"),
                    ),
                    F.struct(
                        (F.col("_last") + window_ms + 1).alias("_at"), F.lit(0).alias("_kind"),
                        F.lit(0).cast("bigint").alias("_seq"), (-F.col("_closes").cast("int")).alias("_delta"),
                    ),
                )
            ),
        )
        .filter(F.col("_delta") != 0)
    )
    reads = known.withColumns(
        {"_at": F.col("ts"), "_kind": F.lit(2), "_seq": F.col("seq"), "_delta": F.lit(0)}
    )
    # order at one instant: closings, then each read's opening just before the read itself
    moves = reads.unionByName(edges, allowMissingColumns=True).withColumn(
        "_late", (F.col("_kind") > 0).cast("int")
    )
    counted = running_sum(moves, keys, ["_at", "_late", "_seq", "_kind"], "_delta", "distinct_paths", slice_ms)
    return counted.filter(F.col("_kind") == 2).select(*known.columns, "distinct_paths")


def _distinct_by_set(known: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    earlier = Window.partitionBy(*keys).orderBy("ts").rangeBetween(-window_ms, -1)
    same_instant = Window.partitionBy(*keys, "ts").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    paths = F.array_union(F.collect_set("path").over(earlier), F.collect_set("path").over(same_instant))
    return known.withColumn("distinct_paths", F.size(paths).cast("bigint"))


def counter_delta(
    counters: DataFrame,
    keys: list[str] | None = None,
    gap_ms: int | None = None,
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """Cumulative ``bytes_in``/``bytes_out`` to deltas per counter.

    The first observation gives no row; a counter that shrank restarted, so its value is the
    delta. With ``gap_ms`` a counter unseen for longer loses its baseline.
    """
    keys = keys or ["pid"]
    previous = F.struct("ts", "bytes_in", "bytes_out")
    seen = latest_value(counters, keys, ["ts", "seq"], previous, "_prev", slice_ms, include_current=False)
    seen = seen.filter(F.col("_prev").isNotNull())
    if gap_ms is not None:
        seen = seen.filter(F.col("ts") - F.col("_prev.ts") <= gap_ms)

    def delta(column: str) -> Column:
        now, before = F.col(column), F.col(f"_prev.{column}")
        return F.when(now >= before, now - before).otherwise(now)

    return seen.withColumns({"bytes_in": delta("bytes_in"), "bytes_out": delta("bytes_out")}).drop("_prev")


def drop_zero_delta(deltas: DataFrame) -> DataFrame:
    return deltas.filter((F.col("bytes_in") != 0) | (F.col("bytes_out") != 0))


def process_changes(snapshots: DataFrame, keys: list[str] | None = None, slice_snapshots: int = 1000) -> DataFrame:
    """Attributed processes that are new, restarted or re-attributed since the previous snapshot.

    ``snapshot`` numbers are consecutive; a process missing from the previous one counts as new.
    """
    keys = keys or ["pid"]
    previous = F.struct("snapshot", "start_time", "agent_id")
    seen = latest_value(
        snapshots, keys, ["snapshot"], previous, "_prev", slice_snapshots, include_current=False
    )
    same = (
        (F.col("_prev.snapshot") == F.col("snapshot") - 1)
        & F.col("_prev.start_time").eqNullSafe(F.col("start_time"))
        & F.col("_prev.agent_id").eqNullSafe(F.col("agent_id"))
    )
    return seen.filter(F.col("agent_id").isNotNull() & ~F.coalesce(same, F.lit(False))).drop("_prev")


def session_cells(signals: DataFrame, gap_ms: int) -> DataFrame:
    """(agent, cell) to the start of the signal session that holds the cell's signals.

    Signals at most ``gap_ms`` apart share a session. Two signals in one ``gap_ms``-wide cell
    always do, so sessions are found on one row per cell.
    """
    cells = signals.groupBy("agent_id", F.floor(F.col("ts") / F.lit(gap_ms)).alias("cell")).agg(
        F.min(F.struct("ts", "seq", "part")).alias("first"), F.max("ts").alias("last_ts")
    )
    by_agent = Window.partitionBy("agent_id").orderBy("cell")
    starts = F.coalesce(F.col("first.ts") - F.lag("last_ts").over(by_agent) > gap_ms, F.lit(True))
    marked = cells.withColumn("_start", F.when(starts, F.col("first")))
    return marked.select(
        "agent_id", "cell", F.last("_start", ignorenulls=True).over(by_agent).alias("session_start")
    )


def read_signal_sessions(signals: DataFrame, gap_ms: int, max_evidence: int = 8) -> DataFrame:
    """Per session: anchor (latest signal), number of signals and the first ``max_evidence`` evidences."""
    cells = session_cells(signals, gap_ms)
    keyed = signals.withColumn("cell", F.floor(F.col("ts") / F.lit(gap_ms))).join(cells, ["agent_id", "cell"])
    totals = keyed.groupBy("agent_id", "session_start").agg(
        F.max("ts").alias("anchor_ts"), F.count(F.lit(1)).alias("signals")
    )
    return totals.join(session_evidence(session_heads(keyed, max_evidence)), ["agent_id", "session_start"])


def session_heads(keyed: DataFrame, max_evidence: int) -> DataFrame:
    """First signals of each (agent, session_start) with ``_rank``; ranks are cut before the shuffle."""
    order = Window.partitionBy("agent_id", "session_start").orderBy("ts", "seq", "part")
    return keyed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_evidence)


def session_evidence(head: DataFrame) -> DataFrame:
    """The signals of ``session_heads`` as one list per (agent, session_start)."""
    item = F.struct("_rank", "ts", "seq", "part", "kind", "summary", "detail")
    return head.groupBy("agent_id", "session_start").agg(F.array_sort(F.collect_list(item)).alias("evidence"))


def first_per_group(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 256) -> DataFrame:
    """The first ``n`` rows of each group.

    Spark cuts small ranks before the shuffle by itself. For a large ``n`` the group is first cut
    within salted parts, each of which keeps at most ``n`` rows, so a group of any size reaches its
    final task as at most ``salts * n`` rows.
    """
    rows = df
    if n > 1000:
        salt = F.pmod(F.xxhash64(*order), F.lit(salts))
        part = Window.partitionBy(*keys, salt).orderBy(*order)
        rows = rows.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n).drop("_rank")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n).drop("_rank")


def rate_limit_reads(file_events: DataFrame, limit: int = 400, keys: list[str] | None = None) -> DataFrame:
    """Per process and second keep the first ``limit`` non-sensitive rows, and every sensitive one."""
    keys = keys or ["pid"]
    plain = file_events.filter(F.col("sensitivity").isNull()).withColumn("_second", F.floor(F.col("ts") / 1000))
    limited = first_per_group(plain, [*keys, "_second"], ["ts", "seq"], limit).drop("_second")
    return limited.unionByName(file_events.filter(F.col("sensitivity").isNotNull()))


def first_endpoints(endpoints: DataFrame) -> DataFrame:
    """Per agent the first occurrence of each host, in (path, pos) order."""
    first = endpoints.groupBy("agent_id", "host").agg(
        F.min_by(F.struct("path", "pos", "url", "key"), F.struct("path", "pos")).alias("_first")
    )
    return first.select("agent_id", "host", "_first.*")


def endpoint_cap(endpoints: DataFrame, per_agent: int = 15) -> DataFrame:
    """Per agent the first occurrence of each host, at most ``per_agent`` hosts, in (path, pos) order."""
    return first_per_group(first_endpoints(endpoints), ["agent_id"], ["path", "pos"], per_agent)


def window_destinations(
    hits: DataFrame, connections: DataFrame, window_ms: int, tail: int = 64, top: int = 6
) -> DataFrame:
    """Adds ``destinations``: the agent's latest ``tail`` peers in the window before each hit,
    distinct in first-seen order, first ``top``.

    ``hits`` are rows left after suppression, so at most a few share a window-wide time cell.
    """
    cell = F.floor(F.col("ts") / F.lit(window_ms))
    wanted = hits.select("agent_id", F.col("ts").alias("_hit_ts"), F.col("seq").alias("_hit_seq")).withColumn(
        "_cell", F.explode(F.array(F.floor(F.col("_hit_ts") / F.lit(window_ms)) - 1, F.floor(F.col("_hit_ts") / F.lit(window_ms))))
    )
    peers = connections.filter(F.col("agent_id").isNotNull() & F.col("remote_ip").isNotNull()).select(
        "agent_id", cell.alias("_cell"), "ts", "seq",
        F.coalesce("remote_host", "remote_ip").alias("_label"),
    )
    in_window = (F.col("ts") >= F.col("_hit_ts") - window_ms) & (
        F.struct("ts", "seq") <= F.struct("_hit_ts", "_hit_seq")
    )
    hit_key = ["agent_id", "_hit_ts", "_hit_seq"]
    recent = Window.partitionBy(*hit_key).orderBy(F.desc("ts"), F.desc("seq"))
    latest = (
        wanted.join(peers, ["agent_id", "_cell"]).filter(in_window)
        .withColumn("_rank", F.row_number().over(recent)).filter(F.col("_rank") <= tail)
    )
    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", "_label")))
    labels = latest.groupBy(*hit_key).agg(
        F.slice(F.array_distinct(F.transform(ordered, lambda x: x["_label"])), 1, top).alias("destinations")
    )
    labels = labels.withColumnsRenamed({"_hit_ts": "ts", "_hit_seq": "seq"})
    none = F.array().cast("array<string>")
    return hits.join(labels, ["agent_id", "ts", "seq"], "left").withColumn(
        "destinations", F.coalesce("destinations", none)
    )
