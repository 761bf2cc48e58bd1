"""Streaming aggregates and sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tracewarden.plans.reports import alert_route
from tracewarden.schemas import FINDINGS
from tracewarden.streaming.detect import EVENT_TABLES
from tracewarden.streaming.state import folder_sink, start, timed, written


def stream_volume_series(volumes: DataFrame, bucket_ms: int, delay: str = "1 minute") -> DataFrame:
    """Tumbling upload and download sums; a bucket is final once the watermark has passed it."""
    timed = volumes.withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", delay)
    bucket = F.window("event_time", f"{max(bucket_ms, 1000)} milliseconds")
    return (
        timed.groupBy(bucket)
        .agg(F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"))
        .select(F.unix_millis("window.start").alias("bucket"), "bytes_out", "bytes_in")
    )


def stream_watch_summary(connections: DataFrame) -> DataFrame:
    """Running connection counts per agent, for ``update`` or ``complete`` mode."""
    return connections.groupBy(F.coalesce("agent_id", F.lit("-")).alias("agent_id")).agg(
        F.count(F.lit(1)).alias("connections")
    )


def stream_store_sink(
    events: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append every event to its table below ``root``. Each micro-batch owns a folder and overwrites
    it when replayed, so rows are stored exactly once."""

    def store(batch: DataFrame, batch_id: int) -> None:
        tagged = batch.filter(F.col("event_type").isin(*EVENT_TABLES))
        names = F.create_map(*[F.lit(v) for pair in EVENT_TABLES.items() for v in pair])
        rows = tagged.withColumn("table", names[F.col("event_type")])
        rows.write.mode("overwrite").partitionBy("table").parquet(f"{root.rstrip('/')}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def incremental_scan(inventory: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to inspect now, snapshot for the next scan): unchanged (path, mtime, size) are skipped."""
    stamp = ["path", "mtime", "size"]
    changed = inventory.join(previous.select(*stamp), stamp, "left_anti")
    return changed, inventory.select(*stamp)


SEEN = "scan_ts bigint, agents array<string>, paths array<string>, sizes array<bigint>, mtimes array<bigint>"


class Snapshot(StatefulProcessor):
    """The last scan's view of one bucket of files, by the scan that saw a file last: its state is read and written once a batch."""

    def init(self, handle) -> None:
        self.handle = handle
        self.scans = handle.getMapState("scans", "scan_ts bigint", SEEN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[tuple, list[tuple]] = {}
        for frame in rows:
            columns = [frame[c].tolist() for c in ("agent_id", "path", "scan_ts", "size", "mtime", "missing")]
            for agent, path, *scan in zip(*columns, strict=True):
                arrived.setdefault((_known(agent), _known(path)), []).append(scan)
        scans: dict[int, dict[tuple, tuple]] = {}
        held: dict[tuple, tuple] = {}
        for (at,), (_, *columns) in list(self.scans.iterator()):
            scans[at] = {(agent, path): (size, mtime) for agent, path, size, mtime in zip(*columns, strict=True)}
            held.update((file, (at, *stamp)) for file, stamp in scans[at].items() if file in arrived)
        changed, out = set(), []
        for file, found in arrived.items():
            found = [(ts, None if missing & 1 else size, None if missing & 2 else mtime) for ts, size, mtime, missing in sorted(found)]
            before = seen = held.get(file)
            if seen is not None and seen[0] < min(found[-1][0], timerValues.getCurrentWatermarkInMs()):
                out.append((*file, *seen, "vanished"))  # a scan in between came without it
                seen = None
            for scan_ts, size, mtime in found:
                if seen is not None and scan_ts < seen[0]:
                    continue  # an older scan that came late
                if seen is None or seen[1:] != (size, mtime) or size is None or mtime is None:
                    out.append((*file, scan_ts, size, mtime, "new" if seen is None else "changed"))
                seen = (scan_ts, size, mtime)
            if before is not None:
                del scans[before[0]][file]
                changed.add(before[0])
            scans.setdefault(seen[0], {})[file] = seen[1:]
            changed.add(seen[0])
        for at in sorted(changed):
            if files := scans[at]:
                agents, paths = zip(*files, strict=True)
                sizes, mtimes = zip(*files.values(), strict=True)
                self.scans.updateValue((at,), (at, list(agents), list(paths), list(sizes), list(mtimes)))
                self.handle.registerTimer(at + 1)
            elif self.scans.containsKey((at,)):
                self.scans.removeKey((at,))
        if out:
            yield pd.DataFrame(out, columns=CHANGE_FIELDS, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() - 1,)
        if self.scans.containsKey(at):
            scan_ts, *columns = self.scans.getValue(at)
            self.scans.removeKey(at)
            out = [(agent, path, scan_ts, size, mtime, "vanished") for agent, path, size, mtime in zip(*columns, strict=True)]
            yield pd.DataFrame(out, columns=CHANGE_FIELDS, dtype=object)


def _known(name):
    """A name as the state returns it: a missing one is None, however its frame wrote it."""
    return name if isinstance(name, str) else None


CHANGES = "agent_id string, path string, scan_ts bigint, size bigint, mtime bigint, change string"
CHANGE_FIELDS = [part.split()[0] for part in CHANGES.split(", ")]


def stream_inventory(
    inventories: DataFrame, out_path: str, checkpoint: str, delay_ms: int = 0, trigger: dict | None = None, buckets: int = 256
) -> StreamingQuery:
    """Changes between scans: a stream of inventory rows (agent_id, path, size, mtime, scan_ts), read by ``inventory_changes``.

    The snapshot is in keyed state, by bucket of files: give as many ``buckets`` as let a task hold one of them; their number
    is fixed by the checkpoint. A file whose time or size differs is ``changed``, one that was
    not there ``new``. When the watermark passes the scan that saw a file last, a later scan has come without it: it
    ``vanished``, with the scan that saw it last. ``delay_ms`` is how long the rows of one scan may take to arrive.
    """
    bucket = F.pmod(F.xxhash64("agent_id", "path"), F.lit(buckets)).cast("int").alias("bucket")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731  a null would make a frame's numbers floats
    missing = (F.col("size").isNull().cast("int") + 2 * F.col("mtime").isNull().cast("int")).alias("missing")
    columns = [bucket, F.col("agent_id"), F.col("path"), F.col("scan_ts"), zero("size"), zero("mtime"), missing]
    changes = timed(inventories, F.col("scan_ts"), delay_ms, columns).groupBy("bucket").transformWithStateInPandas(
        Snapshot(), CHANGES, "append", "eventTime"
    )
    return start(changes, folder_sink(f"{out_path.rstrip('/')}/changes"), checkpoint, trigger)


def inventory_changes(spark: SparkSession, out_path: str) -> DataFrame:
    return written(spark, f"{out_path.rstrip('/')}/changes", CHANGES)


def stream_alerts(findings: DataFrame, out_path: str, checkpoint: str, min_severity: str = "high", trigger: dict | None = None) -> StreamingQuery:
    """Append findings of at least a severity to the alert table, each once: a micro-batch that is run again replaces its own rows."""
    writer = alert_route(findings, min_severity).writeStream.foreachBatch(folder_sink(f"{out_path.rstrip('/')}/alerts"))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def alerts(spark: SparkSession, out_path: str) -> DataFrame:
    return written(spark, f"{out_path.rstrip('/')}/alerts", FINDINGS)
