"""File-audit events: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Operations in the order a record's events are looked at, and where a path may be.
AUDIT_OPS = ["create", "open", "rename", "unlink", "write"]
PATH_KEYS = ["file", "target", "source", "destination"]

_PLACE = ",".join(f"{key}:struct<path:string>" for key in PATH_KEYS) + ",path:string"
AUDIT_SCHEMA = (
    "time string, event struct<"
    + ",".join(f"`{op}`:struct<{_PLACE}>" for op in AUDIT_OPS)
    + ">, process struct<audit_token:struct<pid:bigint>,pid:bigint,executable:struct<path:string>>"
)
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def parse_file_audit(records: DataFrame, ingest_ts: Column | int, json_col: str = "value") -> DataFrame:
    """JSON text rows to (ts, pid, path, op, process_exe).

    Rows without pid, known operation or path are dropped; a missing or unreadable time falls back
    to ``ingest_ts``.
    """
    rest = [c for c in records.columns if c != json_col]
    # inline() keeps the parse in one place; fields taken from a plain from_json() would each repeat it
    parsed = records.select(*rest, F.inline(F.array(F.from_json(json_col, AUDIT_SCHEMA))))
    paths = {op: F.coalesce(*[F.col(f"event.{op}.{k}.path") for k in PATH_KEYS], F.col(f"event.{op}.path")) for op in AUDIT_OPS}
    # first operation that has a path
    chosen = F.coalesce(
        *[F.when(path.isNotNull(), F.struct(F.lit(op).alias("op"), path.alias("path"))) for op, path in paths.items()]
    )
    time = F.col("time")
    read = F.unix_millis(F.when(time.rlike(_RFC3339), F.upper(time)).try_cast("timestamp"))
    fallback = F.lit(ingest_ts) if isinstance(ingest_ts, int) else ingest_ts
    pid = F.coalesce("process.audit_token.pid", "process.pid")
    return (
        parsed.select(
            *rest, F.coalesce(read, fallback).alias("ts"), pid.alias("pid"), chosen.alias("_e"),
            F.col("process.executable.path").alias("process_exe"),
        )
        .filter((F.col("pid") >= 0) & F.col("_e").isNotNull())
        .select(*rest, "ts", "pid", "_e.path", "_e.op", "process_exe")
    )


def ingest_file_audit(spark: SparkSession, path: str, ingest_ts: int) -> DataFrame:
    return parse_file_audit(spark.read.text(path), ingest_ts)
