"""Report queries over the telemetry tables and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.fmt import rank_of, severity_label
from tracewarden.operators.joins import domain_allowed
from tracewarden.params import DAY_MS
from tracewarden.sources.inventory import ancestors
from tracewarden.sources.tables import not_before

DEFAULT_FINDINGS = 200


def _since(df: DataFrame, since_ms: int | None) -> DataFrame:
    return df if since_ms is None else not_before(df, "ts", since_ms)


# --- listings -------------------------------------------------------------------------------


def list_findings(
    findings: DataFrame,
    min_severity: str | None = None,
    agent_id: str | None = None,
    rule_id: str | None = None,
    include_ignored: bool = False,
    limit: int = DEFAULT_FINDINGS,
    status: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Findings newest first. ``status`` and ``severity`` select exactly one value."""
    out = findings
    if min_severity is not None:
        out = out.filter(F.col("severity") >= rank_of(min_severity))
    if severity is not None:
        out = out.filter(severity_label(F.col("severity")) == severity.lower())
    if agent_id is not None:
        out = out.filter(F.col("agent_id") == agent_id)
    if rule_id is not None:
        out = out.filter(F.col("rule_id") == rule_id)
    if status is not None:
        out = out.filter(F.col("status") == status)
    elif not include_ignored:
        out = out.filter(F.col("status") == "open")
    return out.orderBy(F.desc("ts"), F.desc("seq"), "rule_id").limit(limit if limit > 0 else DEFAULT_FINDINGS)


def recent_finding_exists(findings: DataFrame, keys: DataFrame, since_ms: int) -> DataFrame:
    """The (rule_id, dedupe_key) pairs of ``keys`` with a finding at or after ``since_ms``."""
    recent = findings.filter(F.col("ts") >= since_ms).select("rule_id", "dedupe_key")
    return keys.join(recent, ["rule_id", "dedupe_key"], "left_semi")


def list_http_requests(http: DataFrame, since_ms: int, limit: int = 300, agent_id: str | None = None) -> DataFrame:
    """Captures newest first, the body replaced by whether one is stored."""
    rows = _since(http, since_ms)
    if agent_id is not None:
        rows = rows.filter(F.col("agent_id") == agent_id)
    return (
        rows.select(
            "seq", "ts", "agent_id", "host", "method", "path", "bytes_out", "class", "sample",
            F.col("body").isNotNull().alias("has_body"),
        )
        .orderBy(F.desc("ts"), F.desc("seq"))
        .limit(limit)
    )


def list_file_events(
    file_events: DataFrame, agent_id: str | None = None, since_ms: int = 0, limit: int = 300
) -> DataFrame:
    rows = _since(file_events, since_ms)
    if agent_id is not None:
        rows = rows.filter(F.col("agent_id") == agent_id)
    return (
        rows.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).select("ts", "pid", "agent_id", "path", "op")
    )


def list_artifacts(artifacts: DataFrame, since_ms: int = 0, limit: int = 200) -> DataFrame:
    """Artifacts, largest first."""
    return _since(artifacts, since_ms).orderBy(F.desc("size"), "path", "kind", "detail").limit(limit)


def alert_route(findings: DataFrame, min_severity: str = "high") -> DataFrame:
    """Findings that go to the alert sink."""
    return findings.filter(F.col("severity") >= rank_of(min_severity))


# --- aggregates -----------------------------------------------------------------------------


def volume_series(
    volumes: DataFrame, agent_id: str | None = None, since_ms: int = 0, bucket_ms: int = 900_000
) -> DataFrame:
    """Bytes per time bucket of at least a second, oldest first."""
    width = max(bucket_ms, 1000)
    rows = _since(volumes, since_ms)
    if agent_id is not None:
        rows = rows.filter(F.col("agent_id") == agent_id)
    bucket = F.floor(F.col("ts") / width).cast("bigint") * width
    return (
        rows.groupBy(bucket.alias("bucket"))
        .agg(_not_negative(F.sum("bytes_out")).alias("bytes_out"), _not_negative(F.sum("bytes_in")).alias("bytes_in"))
        .orderBy("bucket")
    )


def _not_negative(value: Column) -> Column:
    return F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)).cast("bigint")


def destinations(
    connections: DataFrame,
    since_ms: int,
    limit: int | None,
    profiles: DataFrame | None = None,
    global_domains: tuple[str, ...] = (),
) -> DataFrame:
    """Per (agent, host): connections, first and last seen, newest first, the first ``limit`` or all of them;
    with profiles also whether the host is allowed, tested on the rows listed."""
    top = (
        _since(connections, since_ms)
        .groupBy("agent_id", F.coalesce("remote_host", "remote_addr").alias("host"))
        .agg(
            F.count(F.lit(1)).alias("connections"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
    )
    if limit is not None:
        top = top.orderBy(F.desc("last_seen"), "agent_id", "host").limit(limit)
    if profiles is None:
        return top.withColumn("allowed", F.lit(False))
    return domain_allowed(top, "host", profiles, global_domains)


def destinations_by_host(destination_rows: DataFrame) -> DataFrame:
    """Destinations of all agents merged per host, most connections first; give it all of them, not a list cut short."""
    return (
        destination_rows.groupBy("host")
        .agg(
            F.sum("connections").alias("connections"),
            F.countDistinct(F.coalesce("agent_id", F.lit("unknown"))).alias("agents"),
            F.max("last_seen").alias("last_seen"),
            F.bool_or(~F.col("allowed")).alias("disallowed"),
        )
        .orderBy(F.desc("connections"), "host")
    )


def event_counts(tables: dict[str, DataFrame], since_ms: int) -> DataFrame:
    """Rows since ``since_ms`` per telemetry table, one row."""
    names = ["connections", "file_events", "http_requests", "volumes"]
    tagged = None
    for name in names:
        part = _since(tables[name], since_ms).select(F.lit(name).alias("source"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count_if(F.col("source") == n).alias(n) for n in names])


def finding_counts(findings: DataFrame) -> DataFrame:
    """Open findings by bucket; info counts as low, unknown ranks as critical."""
    rank = F.col("severity")
    return findings.filter(F.col("status") == "open").agg(
        F.count_if(~rank.between(0, 3)).alias("critical"),
        F.count_if(rank == 3).alias("high"),
        F.count_if(rank == 2).alias("medium"),
        F.count_if(rank.between(0, 1)).alias("low"),
    )


def total_bytes_out(volumes: DataFrame, since_ms: int) -> DataFrame:
    return _since(volumes, since_ms).agg(_not_negative(F.sum("bytes_out")).alias("bytes_out"))


def agent_summaries(agents: DataFrame, volumes: DataFrame, findings: DataFrame, as_of_ms: int) -> DataFrame:
    """Agents with upload volume of the last day, open findings and worst severity."""
    sent = (
        _since(volumes, as_of_ms - DAY_MS).groupBy("agent_id").agg(F.sum("bytes_out").alias("_sent"))
    )
    open_ones = (
        findings.filter(F.col("status") == "open")
        .groupBy("agent_id")
        .agg(F.count(F.lit(1)).alias("_open"), F.max("severity").alias("_worst"))
    )
    return (
        agents.withColumnRenamed("id", "agent_id")
        .join(sent, "agent_id", "left")
        .join(open_ones, "agent_id", "left")
        .select(
            F.col("agent_id").alias("id"), "name", "vendor", "last_seen",
            _not_negative(F.col("_sent")).alias("bytes_out_24h"),
            F.coalesce("_open", F.lit(0)).alias("open_findings"),
            severity_label(F.col("_worst")).alias("worst_severity"),
        )
        .orderBy(F.desc("last_seen"), "id")
    )


# --- inventories ----------------------------------------------------------------------------


def dir_usage(inventory: DataFrame) -> DataFrame:
    """Size and file count per (agent, root)."""
    return inventory.groupBy("agent_id", "root").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("files")
    )


def installed_agents(profile_paths: DataFrame, inventory: DataFrame) -> DataFrame:
    """Agents of which a data directory or config file exists.

    ``profile_paths`` are (agent_id, path); a directory exists if the inventory holds it or
    anything below it.
    """
    every = inventory.select(F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("path"))
    # few of the folders are a profile's: only those are made distinct
    present = every.join(profile_paths.select("path").distinct(), "path", "left_semi").distinct()
    return profile_paths.join(present, "path", "left_semi").select("agent_id").distinct()


def agent_inventory(
    profiles: DataFrame, installed: DataFrame, usage: DataFrame, processes: DataFrame
) -> DataFrame:
    """Per profile: installed, size of its data directories, running processes."""
    size = usage.groupBy("agent_id").agg(F.sum("size").alias("_size"))
    running = processes.filter(F.col("agent_id").isNotNull()).groupBy("agent_id").agg(F.count(F.lit(1)).alias("_run"))
    here = installed.select("agent_id").distinct().withColumn("_here", F.lit(True))
    return (
        profiles.select(F.col("id").alias("agent_id"), "name", "vendor")
        .join(here, "agent_id", "left").join(size, "agent_id", "left").join(running, "agent_id", "left")
        .select(
            F.col("agent_id").alias("id"), "name", "vendor",
            F.coalesce("_here", F.lit(False)).alias("installed"),
            F.coalesce("_size", F.lit(0)).alias("data_dir_bytes"),
            F.coalesce("_run", F.lit(0)).alias("running_processes"),
        )
    )


def watch_summary(processes: DataFrame, connections: DataFrame, findings: DataFrame) -> DataFrame:
    """Per agent: distinct processes, connection rows, findings."""
    pids = processes.groupBy(F.coalesce("agent_id", F.lit("-")).alias("agent_id")).agg(F.countDistinct("pid").alias("processes"))
    links = connections.groupBy(F.coalesce("agent_id", F.lit("-")).alias("agent_id")).agg(F.count(F.lit(1)).alias("connections"))
    found = findings.groupBy(F.coalesce("agent_id", F.lit("-")).alias("agent_id")).agg(F.count(F.lit(1)).alias("findings"))
    zero = {c: 0 for c in ("processes", "connections", "findings")}
    return pids.join(links, "agent_id", "full").join(found, "agent_id", "full").fillna(zero)


# --- compositions ---------------------------------------------------------------------------


def overview(
    tables: dict[str, DataFrame],
    agents: DataFrame,
    findings: DataFrame,
    profiles: DataFrame,
    installed: DataFrame,
    since_ms: int,
    as_of_ms: int,
    global_domains: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Everything the dashboard shows, one frame per panel."""
    here = installed.select(F.col("agent_id").alias("id")).distinct().withColumn("installed", F.lit(True))
    summaries = agent_summaries(agents, tables["volumes"], findings, as_of_ms)
    listed = list_findings(findings, limit=100)
    agent_rows = summaries.join(here, "id", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))
    return {
        "counts": event_counts(tables, since_ms),
        "bytes_out": total_bytes_out(tables["volumes"], since_ms),
        "agents": agent_rows,
        "findings": listed,
        "volume": volume_series(tables["volumes"], since_ms=since_ms, bucket_ms=15 * 60_000),
        "destinations": destinations(tables["connections"], since_ms, 200, profiles, global_domains),
        "artifacts": list_artifacts(tables["artifacts"], 0, 100),
        "stats": overview_stats(agent_rows, findings),
    }


def overview_stats(agent_rows: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: urgent findings among all of them, installed agents, agents that uploaded."""
    urgent = findings.select(
        F.when((F.col("status") == "open") & (F.col("severity") >= 3), 1).otherwise(0).alias("urgent"),
        F.lit(0).alias("installed"), F.lit(0).alias("uploading"),
    )
    seen = agent_rows.select(
        F.lit(0).alias("urgent"), F.col("installed").cast("int").alias("installed"),
        (F.col("bytes_out_24h") > 0).cast("int").alias("uploading"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("urgent", "installed", "uploading")]
    return urgent.unionByName(seen).agg(*sums)


def report(
    tables: dict[str, DataFrame],
    agents: DataFrame,
    findings: DataFrame,
    as_of_ms: int,
    profiles: DataFrame | None = None,
    global_domains: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """The daily report: agent summaries, open findings, destinations of the last day."""
    return {
        "agents": agent_summaries(agents, tables["volumes"], findings, as_of_ms),
        "findings": list_findings(findings, limit=500),
        "destinations": destinations(tables["connections"], as_of_ms - DAY_MS, 50, profiles, global_domains),
    }
