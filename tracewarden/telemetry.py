"""Audit telemetry derived from the generic driver tables.

``events`` becomes five telemetry tables by event type; request bodies come from ``documents``
and host names from ``pages``. Arrival number is the event id, agents are users modulo 17.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.params import DAY_MS, MIB, Params
from tracewarden.session import spread

AGENTS = 17

# Thresholds for this sparse data: about 20 rows per agent and day at the 0.01 scale.
VIEW_PARAMS = Params(
    volume_spike_bytes=20 * MIB,
    volume_spike_window_ms=DAY_MS,
    bulk_read_files=4,
    bulk_read_window_ms=DAY_MS,
    git_read_rows=2,
    exfil_correlation_ms=6 * 3_600_000,
    significant_upload_bytes=MIB,
    repeat_ms=DAY_MS,
    alert_repeat_ms=DAY_MS,
    slice_ms=6 * 3_600_000,
)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC, whatever the session time zone."""
    millis = F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("bigint")
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * DAY_MS
        + F.hour(ts) * 3_600_000
        + F.minute(ts) * 60_000
        + millis
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def base(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter(F.col("event_type") == event_type)
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_ms(F.col("ts")).alias("ts"),
        F.col("user_id").alias("pid"),
        F.concat(F.lit("agent-"), F.col("user_id") % AGENTS).alias("agent_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir, "purchase").select(
        "seq", "ts", "pid", "agent_id",
        F.floor(F.col("value") * 1000).cast("bigint").alias("bytes_in"),
        F.floor(F.col("value") * 100000).cast("bigint").alias("bytes_out"),
        F.lit(1000).cast("bigint").alias("window_ms"),
    )


def repo_of(pid: Column) -> Column:
    return F.concat(F.lit("/home/u/repo"), pid % 3)


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    tail = (
        F.when(k % 20 == 0, F.concat(F.lit("/.git/objects/"), k))
        .when(k % 20 == 1, F.concat(F.lit("/.env."), k))
        .when(k % 20 == 2, F.concat(F.lit("/keys/"), k, F.lit(".pem")))
        .otherwise(F.concat(F.lit("/src/f"), k, F.lit(".py")))
    )
    root = repo_of(F.col("pid"))
    return base(spark, sf_dir, "click").select(
        "seq", "ts", "pid", "agent_id",
        F.concat(root, tail).alias("path"),
        F.lit("open").alias("op"),
        F.lit("view").alias("source"),
        F.lit(None).cast("string").alias("process_exe"),
        root.alias("repo_root"),
    )


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("page_host")
    )


def _with_page_host(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_hosts(spark, sf_dir)
    count = pages.count()  # parquet footers only
    return rows.withColumn("page_id", F.col("seq") % count).join(pages, "page_id").drop("page_id")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seq, pid = F.col("k"), F.col("seq"), F.col("pid")

    def dotted(*parts: Column | int) -> Column:
        return F.concat_ws(".", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])

    ip = (
        F.when(k % 4 == 0, dotted(10, pid % 200, seq % 250, 1 + seq % 200))
        .when(k % 4 == 1, dotted(198, 18, seq % 250, 1 + seq % 200))
        .otherwise(dotted(20 + k, pid % 200, seq % 250, 1 + seq % 200))
    )
    rows = _with_page_host(base(spark, sf_dir, "view"), spark, sf_dir)
    return rows.select(
        "seq", "ts", "pid", "agent_id",
        F.concat(ip, F.lit(":443")).alias("remote_addr"),
        ip.alias("remote_ip"),
        F.lit(443).alias("remote_port"),
        F.when(k % 5 != 0, F.col("page_host")).alias("remote_host"),
        F.lit("tcp").alias("proto"),
    )


def http_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured requests before classification; the source port is unique per process and day."""
    bodies = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = bodies.count()
    rows = _with_page_host(base(spark, sf_dir, "error"), spark, sf_dir).withColumn("doc_id", F.col("seq") % count)
    # what reads the bodies is bound by CPU, not by size: the rows are dealt out before they carry them
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(parts, "doc_id").join(bodies, "doc_id")
    return rows.select(
        "seq", "ts", "pid", "agent_id",
        (F.lit(1024) + F.col("pid") % 60000).cast("int").alias("src_port"),
        F.col("page_host").alias("host"),
        F.lit("POST").alias("method"),
        F.lit("/v1/upload").alias("path"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.col("text").cast("binary").alias("payload"),
    )


def process_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sighting of a process."""
    pid = F.col("pid")
    root_pid = pid % 5 == 0
    name = F.when(root_pid, F.concat(F.lit("tool-"), pid % AGENTS)).otherwise(F.lit("worker"))
    return base(spark, sf_dir, "signup").select(
        "seq", "ts", "pid",
        F.when(~root_pid, pid - 1).alias("ppid"),
        (F.floor(F.col("ts") / (10 * DAY_MS)) * 10 * DAY_MS).alias("start_time"),
        name.alias("name"),
        F.concat(F.lit("/usr/bin/"), name).alias("exe"),
        F.array(name, F.concat(F.lit("--slot="), F.col("k"))).alias("cmdline"),
        repo_of(pid).alias("cwd"),
    )


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest sighting per process."""
    samples = process_samples(spark, sf_dir)
    columns = [c for c in samples.columns if c != "pid"]
    latest = samples.groupBy("pid").agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("_p"))
    return latest.select("pid", "_p.*")


def profiles(spark: SparkSession) -> DataFrame:
    rows = []
    for i in range(AGENTS):
        allowed = {0: ["*.example.com"], 1: ["*.example.net"]}.get(i % 3, [])
        telemetry = ["*.example.org"] if i % 4 == 0 else []
        rows.append(
            (i, f"agent-{i}", f"Agent {i}", f"vendor-{i % 4}", [f"tool-{i}"], [], [], [],
             [f"/home/u/.agent-{i}"], [], allowed, telemetry, None)
        )
    return spark.createDataFrame(rows, schemas.PROFILES)
