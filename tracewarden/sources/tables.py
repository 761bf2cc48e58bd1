"""Telemetry tables: append, upsert, status overrides, schema evolution, retention, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.params import DAY_MS


def day_of(ts: Column) -> Column:
    """UTC day of an epoch-millisecond column, the partition of every table."""
    return F.date_from_unix_date(F.floor(ts / DAY_MS).cast("int"))


def not_before(df: DataFrame, ts_col: str, cutoff_ms: int) -> DataFrame:
    """Rows at or after a time; on a stored table whole days before it are not even listed."""
    rows = df.filter(F.col(ts_col) >= cutoff_ms)
    return rows.filter(F.col("dt") >= day_of(F.lit(cutoff_ms))) if "dt" in df.columns else rows


def append_events(df: DataFrame, path: str, mode: str = "append", ts_col: str = "ts") -> None:
    """Append rows to a day-partitioned parquet table. Rows of one day meet before the write; the
    rebalance splits a day that is too large for one task and joins days that are small."""
    days = df.withColumn("dt", day_of(F.col(ts_col)))
    days.hint("rebalance", "dt").write.mode(mode).partitionBy("dt").parquet(path)


def append_findings(findings: DataFrame, path: str) -> None:
    """Append findings: severity as rank, evidence nested."""
    columns = [c.split()[0] for c in _fields(schemas.FINDINGS)]
    append_events(findings.select(*columns), path)


def findings_as_rows(findings: DataFrame) -> DataFrame:
    """Findings with evidence as JSON text, for sinks without nested types."""
    return findings.withColumn("evidence", F.to_json("evidence"))


def _fields(ddl: str) -> list[str]:
    """Top-level fields of a DDL string."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def upsert_agents(agents: DataFrame, updates: DataFrame) -> DataFrame:
    """New snapshot: an id keeps its first ``first_seen``, everything else comes from the latest row.

    ``updates`` carry ``arrival``; rows already stored count as earlier.
    """
    rows = agents.withColumn("arrival", F.lit(-1).cast("bigint")).unionByName(updates)
    latest = F.max_by(F.struct("name", "vendor", "last_seen"), "arrival").alias("_l")
    return (
        rows.groupBy("id")
        .agg(latest, F.min_by("first_seen", "arrival").alias("first_seen"))
        .select("id", "_l.name", "_l.vendor", "first_seen", "_l.last_seen")
    )


def upsert_processes(processes: DataFrame, updates: DataFrame) -> DataFrame:
    """New snapshot per (pid, start_time): name and exe from the first row, the rest from the latest."""
    rows = processes.withColumn("arrival", F.lit(-1).cast("bigint")).unionByName(updates)
    return (
        rows.groupBy("pid", "start_time")
        .agg(
            F.min_by(F.struct("name", "exe"), "arrival").alias("_f"),
            F.max_by(F.struct("agent_id", "cwd", "last_seen"), "arrival").alias("_l"),
        )
        .select("pid", "start_time", "_l.agent_id", "_f.name", "_f.exe", "_l.cwd", "_l.last_seen")
    )


def touch_agents(agents: DataFrame, process_updates: DataFrame) -> DataFrame:
    """Agents with ``last_seen`` moved to their latest process row."""
    seen = (
        process_updates.filter(F.col("agent_id").isNotNull())
        .groupBy(F.col("agent_id").alias("id"))
        .agg(F.max_by("last_seen", "arrival").alias("_seen"))
    )
    return (
        agents.join(seen, "id", "left").withColumn("last_seen", F.coalesce("_seen", "last_seen")).drop("_seen")
    )


def upsert_meta(meta: DataFrame, updates: DataFrame) -> DataFrame:
    """Latest value per key."""
    rows = meta.withColumn("arrival", F.lit(-1).cast("bigint")).unionByName(updates)
    return rows.groupBy("k").agg(F.max_by("v", "arrival").alias("v"))


def set_finding_status(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings under the latest override per id; ``overrides`` are (id, status, arrival) appends."""
    latest = overrides.groupBy("id").agg(F.max_by("status", "arrival").alias("_status"))
    return (
        findings.join(latest, "id", "left").withColumn("status", F.coalesce("_status", "status"))
        .select(*findings.columns)
    )


def evolve_schema(df: DataFrame, target_schema: str) -> DataFrame:
    """Old data under the current schema: columns it lacks read as null."""
    return df.sparkSession.createDataFrame([], target_schema).unionByName(df, allowMissingColumns=True)


def prune_retention(
    df: DataFrame, ts_col: str, as_of_ms: int, retention_days: int, minimum_days: int = 0
) -> DataFrame:
    """Rows still within retention at ``as_of_ms``; findings pass ``minimum_days=30``."""
    return not_before(df, ts_col, as_of_ms - max(retention_days, minimum_days) * DAY_MS)


def drop_expired(spark: SparkSession, path: str, as_of_ms: int, retention_days: int, minimum_days: int = 0) -> int:
    """Delete the day partitions of a stored table that lie wholly before retention; the number of rows removed.

    Only folders go, nothing is rewritten. The day that retention ends in stays until it is over; readers filter it
    with ``prune_retention``.
    """
    cutoff = as_of_ms - max(retention_days, minimum_days) * DAY_MS
    last_day = F.to_date(F.timestamp_millis(F.lit(cutoff)))
    stored = spark.read.parquet(path)
    expired = stored.filter(F.col("dt") < last_day).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("rows")).collect()
    for day in expired:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/dt={day['dt']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(day["rows"] for day in expired)


def prune_counts(tables: dict[str, DataFrame], as_of_ms: int, retention_days: int) -> DataFrame:
    """(table, removed): how many rows retention removes per table."""
    out = None
    for name, df in tables.items():
        column = "last_seen" if name == "processes" else "ts"
        days = max(retention_days, 30) if name == "findings" else retention_days
        gone = df.filter(F.col(column) < as_of_ms - days * DAY_MS)
        part = gone.agg(F.count(F.lit(1)).alias("removed")).select(F.lit(name).alias("table"), "removed")
        out = part if out is None else out.unionByName(part)
    return out


def export_json(df: DataFrame, path: str | None = None) -> DataFrame:
    """One JSON document per row; written as text files when a path is given."""
    documents = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    if path is not None:
        documents.write.mode("overwrite").text(path)
    return documents
