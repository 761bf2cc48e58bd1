"""Listings, aggregates and report compositions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden import telemetry as T
from tracewarden.catalog import scanning
from tracewarden.catalog.detection import FINDING, findings, http_requests, tables
from tracewarden.catalog.oracle import END_MS, SINCE_MS, host_allowed, one_of
from tracewarden.catalog.registry import query
from tracewarden.functions.fmt import severity_label, severity_rank
from tracewarden.params import DAY_MS, GLOBAL_ALLOWED_DOMAINS
from tracewarden.plans import reports as Q
from tracewarden.plans import rules as R
from tracewarden.session import shared_folder
from tracewarden.sources import stored
from tracewarden.sources import tables as S
from tracewarden.sources.stored import KeyedTable
from tracewarden.telemetry import VIEW_PARAMS as P

_COLS = ", ".join(FINDING)
# the status overrides the view implies: every third finding by arrival is ignored, every sixth restored
_STATUS = {
    "statused": "SELECT *, CASE WHEN seq % 6 = 0 THEN 'open' WHEN seq % 3 = 0 THEN 'ignored' ELSE 'open' END AS status FROM findings"
}


def statused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings(spark, sf_dir)
    ids = found.select("id", "seq")
    ignored = ids.filter(F.col("seq") % 3 == 0).select("id", F.lit("ignored").alias("status"), F.lit(1).alias("arrival"))
    restored = ids.filter(F.col("seq") % 6 == 0).select("id", F.lit("open").alias("status"), F.lit(2).alias("arrival"))
    return S.set_finding_status(found, ignored.unionByName(restored))


@query("set_finding_status", f"SELECT {_COLS}, status FROM statused", _STATUS)
def set_finding_status(spark, sf_dir):
    return statused(spark, sf_dir).select(*FINDING, "status")


@query(
    "list_findings",
    f"SELECT {_COLS} FROM statused WHERE severity >= 2 AND status = 'open' ORDER BY ts DESC, seq DESC, rule_id LIMIT 100",
    _STATUS,
)
def list_findings(spark, sf_dir):
    return Q.list_findings(statused(spark, sf_dir), min_severity="medium", limit=100).select(*FINDING)


@query(
    "list_findings_filtered",
    f"SELECT {_COLS}, status FROM statused WHERE severity = 1 AND agent_id = 'agent-3' AND rule_id = 'egress.unknown_domain' ORDER BY ts DESC, seq DESC, rule_id LIMIT 200",
    _STATUS,
)
def list_findings_filtered(spark, sf_dir):
    return Q.list_findings(
        statused(spark, sf_dir), severity="low", agent_id="agent-3", rule_id="egress.unknown_domain",
        include_ignored=True, limit=0,
    ).select(*FINDING, "status")


@query(
    "list_findings_ignored",
    f"SELECT {_COLS} FROM statused WHERE status = 'ignored' ORDER BY ts DESC, seq DESC, rule_id LIMIT 200",
    _STATUS,
)
def list_findings_ignored(spark, sf_dir):
    return Q.list_findings(statused(spark, sf_dir), status="ignored").select(*FINDING)


@query(
    "recent_finding_exists",
    f"SELECT DISTINCT rule_id, dedupe_key FROM findings WHERE ts >= {SINCE_MS}",
)
def recent_finding_exists(spark, sf_dir):
    found = findings(spark, sf_dir)
    return Q.recent_finding_exists(found, found.select("rule_id", "dedupe_key").distinct(), SINCE_MS)


@query("alert_route", f"SELECT {_COLS} FROM findings WHERE severity >= 3")
def alert_route(spark, sf_dir):
    return Q.alert_route(findings(spark, sf_dir), "high").select(*FINDING)


@query(
    "list_http_requests",
    f"""SELECT seq, ts, agent_id, host, method, path, bytes_out, class, sample, false AS has_body FROM http
        WHERE ts >= {SINCE_MS} AND agent_id = 'agent-5' ORDER BY ts DESC, seq DESC LIMIT 50""",
)
def list_http_requests(spark, sf_dir):
    return Q.list_http_requests(http_requests(spark, sf_dir), SINCE_MS, 50, "agent-5")


@query(
    "list_file_events",
    f"SELECT ts, pid, agent_id, path, op FROM files WHERE ts >= {SINCE_MS} AND agent_id = 'agent-2' ORDER BY ts DESC, seq DESC LIMIT 300",
)
def list_file_events(spark, sf_dir):
    return Q.list_file_events(T.file_events(spark, sf_dir), "agent-2", SINCE_MS)


# --- aggregates -----------------------------------------------------------------------------

_BUCKET = 3_600_000


@query(
    "volume_series",
    f"""SELECT ts // {_BUCKET} * {_BUCKET} AS bucket, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
        CAST(sum(bytes_in) AS BIGINT) AS bytes_in FROM volumes GROUP BY 1""",
)
def volume_series(spark, sf_dir):
    return Q.volume_series(T.volumes(spark, sf_dir), bucket_ms=_BUCKET)


_DEST = {
    "dest": f"""SELECT agent_id, coalesce(remote_host, remote_addr) AS host, count(*) AS connections, min(ts) AS first_seen,
        max(ts) AS last_seen FROM connections WHERE ts >= {SINCE_MS} GROUP BY 1, 2 ORDER BY last_seen DESC, agent_id, host LIMIT 200""",
    "dest_allowed": f"SELECT c.*, {host_allowed('c.agent_id', 'c.host')} AS allowed FROM dest c",
}
_EVERY_DEST = {
    "every_dest": f"""SELECT agent_id, coalesce(remote_host, remote_addr) AS host, count(*) AS connections,
        max(ts) AS last_seen FROM connections WHERE ts >= {SINCE_MS} GROUP BY 1, 2""",
    "every_allowed": f"SELECT c.*, {host_allowed('c.agent_id', 'c.host')} AS allowed FROM every_dest c",
}


@query("destinations", "SELECT * FROM dest_allowed", _DEST)
def destinations(spark, sf_dir):
    return Q.destinations(T.connections(spark, sf_dir), SINCE_MS, 200, T.profiles(spark), GLOBAL_ALLOWED_DOMAINS)


@query(
    "destinations_by_host",
    """SELECT host, CAST(sum(connections) AS BIGINT) AS connections, count(DISTINCT agent_id) AS agents, max(last_seen) AS last_seen,
        bool_or(NOT allowed) AS disallowed FROM every_allowed GROUP BY host""",
    _EVERY_DEST,
)
def destinations_by_host(spark, sf_dir):
    every = Q.destinations(T.connections(spark, sf_dir), SINCE_MS, None, T.profiles(spark), GLOBAL_ALLOWED_DOMAINS)
    return Q.destinations_by_host(every)


@query(
    "event_counts",
    " , ".join(
        [f"SELECT (SELECT count(*) FROM connections WHERE ts >= {SINCE_MS}) AS connections"]
        + [
            f"(SELECT count(*) FROM {cte} WHERE ts >= {SINCE_MS}) AS {name}"
            for cte, name in (("files", "file_events"), ("raw", "http_requests"), ("volumes", "volumes"))
        ]
    ),
)
def event_counts(spark, sf_dir):
    return Q.event_counts(tables(spark, sf_dir), SINCE_MS)


@query(
    "finding_counts",
    """SELECT count(*) FILTER (severity > 3) AS critical, count(*) FILTER (severity = 3) AS high,
        count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity < 2) AS low FROM statused WHERE status = 'open'""",
    _STATUS,
)
def finding_counts(spark, sf_dir):
    return Q.finding_counts(statused(spark, sf_dir))


@query("total_bytes_out", f"SELECT CAST(coalesce(sum(bytes_out), 0) AS BIGINT) AS bytes_out FROM volumes WHERE ts >= {SINCE_MS}")
def total_bytes_out(spark, sf_dir):
    return Q.total_bytes_out(T.volumes(spark, sf_dir), SINCE_MS)


@query("severity_labels", "SELECT rule_id, ts, seq, ['info', 'low', 'medium', 'high', 'critical'][severity + 1] AS label, severity AS rank FROM findings")
def severity_labels(spark, sf_dir):
    label = severity_label(F.col("severity"))
    return findings(spark, sf_dir).select(
        "rule_id", "ts", "seq", label.alias("label"), severity_rank(F.initcap(label)).alias("rank")
    )


@query("severity_label", "SELECT rule_id, ts, seq, ['info', 'low', 'medium', 'high', 'critical'][severity + 1] AS label FROM findings")
def label_of(spark, sf_dir):
    return severity_labels(spark, sf_dir).select("rule_id", "ts", "seq", "label")


@query("severity_rank", "SELECT rule_id, ts, seq, severity AS rank FROM findings")
def rank_of_label(spark, sf_dir):
    return severity_labels(spark, sf_dir).select("rule_id", "ts", "seq", "rank")


# --- agents ---------------------------------------------------------------------------------

_SEEN = {
    "seen": """SELECT agent_id AS id, 'Agent ' || substr(agent_id, 7) AS name, min(ts) AS first_seen, max(ts) AS last_seen
        FROM base GROUP BY agent_id"""
}
_SUMMARY = {
    **_SEEN,
    **_STATUS,
    "summary": f"""SELECT id, name, last_seen,
        CAST(coalesce((SELECT sum(bytes_out) FROM volumes v WHERE v.agent_id = id AND v.ts >= {END_MS - 3 * DAY_MS}), 0) AS BIGINT) AS bytes_out_24h,
        (SELECT count(*) FROM statused f WHERE f.agent_id = id AND status = 'open') AS open_findings,
        ['info', 'low', 'medium', 'high', 'critical'][(SELECT max(severity) FROM statused f WHERE f.agent_id = id AND status = 'open') + 1] AS worst_severity
        FROM seen""",
}
_SUMMARY_AS_OF = END_MS - 2 * DAY_MS


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents as the events show them."""
    events = T.table(spark, sf_dir, "events").select(
        F.concat(F.lit("agent-"), F.col("user_id") % T.AGENTS).alias("id"), T.epoch_ms(F.col("ts")).alias("ts")
    )
    return events.groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).select(
        "id", F.concat(F.lit("Agent "), F.substring("id", 7, 10)).alias("name"), F.lit("view").alias("vendor"),
        "first_seen", "last_seen",
    )


@query("agent_summaries", "SELECT * FROM summary", _SUMMARY)
def agent_summaries(spark, sf_dir):
    return Q.agent_summaries(
        agents(spark, sf_dir), T.volumes(spark, sf_dir), statused(spark, sf_dir), _SUMMARY_AS_OF
    ).drop("vendor")


_INSTALLED = one_of("agent_id", [f"agent-{i}" for i in range(0, T.AGENTS, 2)])


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents with an even number are installed."""
    even = F.substring("id", 7, 10).cast("int") % 2 == 0
    return agents(spark, sf_dir).filter(even).select(F.col("id").alias("agent_id"))


@query(
    "overview_stats",
    f"""SELECT (SELECT count(*) FROM statused WHERE status = 'open' AND severity >= 3) AS urgent,
        (SELECT count(*) FROM summary WHERE {_INSTALLED.replace('agent_id', 'id')}) AS installed,
        (SELECT count(*) FROM summary WHERE bytes_out_24h > 0) AS uploading""",
    _SUMMARY,
)
def overview_stats(spark, sf_dir):
    return overview(spark, sf_dir)["stats"]


def overview(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    artifacts = scanning.artifacts(spark, sf_dir)
    return Q.overview(
        {**tables(spark, sf_dir), "artifacts": artifacts}, agents(spark, sf_dir), statused(spark, sf_dir),
        T.profiles(spark), _installed(spark, sf_dir), SINCE_MS, _SUMMARY_AS_OF, tuple(GLOBAL_ALLOWED_DOMAINS),
    )


_SINCE = f"WHERE ts >= {SINCE_MS}"
_OVERVIEW = " UNION ALL ".join(
    [
        "SELECT 'agents' AS panel, id AS item, CAST(bytes_out_24h AS BIGINT) AS number FROM summary",
        """SELECT 'artifacts', kind || '|' || path, size FROM (SELECT * FROM (SELECT path, size, 'hidden_blob' AS kind FROM blobs
            UNION ALL SELECT path, CAST(0 AS BIGINT), 'unexpected_endpoint' FROM odd) ORDER BY size DESC, path, kind LIMIT 100)""",
        f"SELECT 'bytes_out', 'bytes_out', (SELECT CAST(coalesce(sum(bytes_out), 0) AS BIGINT) FROM volumes {_SINCE})",
        *[
            f"SELECT 'counts', '{name}', (SELECT count(*) FROM {cte} {_SINCE})"
            for cte, name in (("connections", "connections"), ("files", "file_events"), ("raw", "http_requests"), ("volumes", "volumes"))
        ],
        "SELECT 'destinations', agent_id || '|' || host, connections FROM dest",
        """SELECT 'findings', rule_id || '|' || dedupe_key, ts FROM (
            SELECT * FROM statused WHERE status = 'open' ORDER BY ts DESC, seq DESC, rule_id LIMIT 100)""",
        "SELECT 'stats', 'urgent', (SELECT count(*) FROM statused WHERE status = 'open' AND severity >= 3)",
        f"SELECT 'stats', 'installed', (SELECT count(*) FROM summary WHERE {_INSTALLED.replace('agent_id', 'id')})",
        "SELECT 'stats', 'uploading', (SELECT count(*) FROM summary WHERE bytes_out_24h > 0)",
        f"SELECT 'volume', CAST(ts // 900000 * 900000 AS VARCHAR), CAST(sum(bytes_out) AS BIGINT) FROM volumes {_SINCE} GROUP BY 2",
    ]
)


@query("overview", _OVERVIEW, {**scanning.TABLES, **_SUMMARY, **_DEST})
def overview_panels(spark, sf_dir):
    """Every panel's contents, as (panel, item, number)."""
    shown = {
        "agents": ("id", "bytes_out_24h"), "artifacts": (F.concat_ws("|", "kind", "path"), "size"),
        "destinations": (F.concat_ws("|", "agent_id", "host"), "connections"),
        "findings": (F.concat_ws("|", "rule_id", "dedupe_key"), "ts"), "volume": ("bucket", "bytes_out"),
    }
    out = None
    for panel, frame in overview(spark, sf_dir).items():
        if panel not in shown:  # one row, a number per column
            pairs = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("bigint").alias("number")) for c in frame.columns])
            part = frame.select(F.lit(panel).alias("panel"), F.inline(pairs))
        else:
            item, number = shown[panel]
            part = frame.select(F.lit(panel).alias("panel"), (F.col(item) if isinstance(item, str) else item).cast("string").alias("item"), F.col(number).cast("bigint").alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "report",
    f"""SELECT 'agents' AS section, id AS key, CAST(bytes_out_24h AS BIGINT) AS number FROM summary
        UNION ALL SELECT 'findings', rule_id || '|' || dedupe_key, ts FROM (SELECT * FROM statused WHERE status = 'open' ORDER BY ts DESC, seq DESC, rule_id LIMIT 500)
        UNION ALL SELECT 'destinations', agent_id || '|' || host, connections FROM (
            SELECT agent_id, coalesce(remote_host, remote_addr) AS host, count(*) AS connections, max(ts) AS last_seen FROM connections
            WHERE ts >= {_SUMMARY_AS_OF - DAY_MS} GROUP BY 1, 2 ORDER BY last_seen DESC, agent_id, host LIMIT 50)""",
    _SUMMARY,
)
def report(spark, sf_dir):
    parts = Q.report(tables(spark, sf_dir), agents(spark, sf_dir), statused(spark, sf_dir), _SUMMARY_AS_OF)
    shaped = {
        "agents": (F.col("id"), F.col("bytes_out_24h")),
        "findings": (F.concat_ws("|", "rule_id", "dedupe_key"), F.col("ts")),
        "destinations": (F.concat_ws("|", "agent_id", "host"), F.col("connections")),
    }
    out = None
    for section, (key, number) in shaped.items():
        part = parts[section].select(F.lit(section).alias("section"), key.alias("key"), number.alias("number"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "watch_summary",
    """SELECT agent_id, (SELECT count(DISTINCT pid) FROM base b WHERE b.agent_id = a.agent_id AND event_type = 'signup') AS processes,
        (SELECT count(*) FROM connections c WHERE c.agent_id = a.agent_id) AS connections,
        (SELECT count(*) FROM findings f WHERE f.agent_id = a.agent_id) AS findings FROM (SELECT DISTINCT agent_id FROM base) a""",
)
def watch_summary(spark, sf_dir):
    sightings = T.process_samples(spark, sf_dir).withColumn(
        "agent_id", F.concat(F.lit("agent-"), F.col("pid") % T.AGENTS)
    )
    return Q.watch_summary(sightings, T.connections(spark, sf_dir), findings(spark, sf_dir))


@query(
    "export_json",
    "SELECT '{\"seq\":' || seq || ',\"agent_id\":\"' || agent_id || '\",\"bytes_out\":' || bytes_out || '}' AS value FROM volumes",
)
def export_json(spark, sf_dir):
    return S.export_json(T.volumes(spark, sf_dir).select("seq", "agent_id", "bytes_out"))


@query("append_findings", f"SELECT {_COLS}, CAST(1 AS BIGINT) AS steps FROM findings WHERE rule_id IN ('fs.sensitive_read')")
def append_findings(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/findings"
    S.append_findings(R.rule_sensitive_read(T.file_events(spark, sf_dir), P), path)
    stored = S.findings_as_rows(spark.read.parquet(path))
    steps = F.json_array_length("evidence").cast("bigint")
    return stored.select(*FINDING, steps.alias("steps"))


@query("append_events", "SELECT seq, ts, agent_id, path, op FROM files")
def append_events(spark, sf_dir):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}/file_events"
    S.append_events(T.file_events(spark, sf_dir), path)
    return spark.read.parquet(path).select("seq", "ts", "agent_id", "path", "op")


@query(
    "upsert_agents",
    """SELECT agent_id AS id, arg_max(name, arrival) AS name, arg_max(vendor, arrival) AS vendor, arg_min(first_seen, arrival) AS first_seen,
        arg_max(last_seen, arrival) AS last_seen FROM (
        SELECT agent_id, 'old' AS name, 'v0' AS vendor, ts AS first_seen, ts AS last_seen, -1 AS arrival FROM (SELECT agent_id, min(ts) AS ts FROM volumes GROUP BY 1)
        UNION ALL SELECT agent_id, 'name-' || k, 'v' || (k % 3), ts, ts, seq FROM base WHERE event_type = 'view') GROUP BY 1""",
)
def upsert_agents(spark, sf_dir):
    """Into a stored table: the agents known first, then the updates in two halves."""
    first = T.volumes(spark, sf_dir).groupBy(F.col("agent_id").alias("id")).agg(F.min("ts").alias("first_seen"))
    stored = first.select("id", F.lit("old").alias("name"), F.lit("v0").alias("vendor"), "first_seen", F.col("first_seen").alias("last_seen"))
    views = T.base(spark, sf_dir, "view")
    updates = views.select(
        F.col("agent_id").alias("id"), F.concat(F.lit("name-"), F.col("k")).alias("name"),
        F.concat(F.lit("v"), F.col("k") % 3).alias("vendor"), F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"), F.col("seq").alias("arrival"),
    )
    table = KeyedTable(spark, _folder(spark), ["id"], schemas.AGENTS, buckets=8)
    middle = updates.agg(F.avg("arrival")).first()[0]
    for part in (stored.withColumn("arrival", F.lit(-1).cast("bigint")), updates.filter(F.col("arrival") <= middle), updates.filter(F.col("arrival") > middle)):
        table.upsert(part, S.upsert_agents)
    return table.read()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _process_table(spark: SparkSession) -> KeyedTable:
    schema = "pid bigint, start_time bigint, agent_id string, name string, exe string, cwd string, last_seen bigint"
    return KeyedTable(spark, _folder(spark), ["pid", "start_time"], schema, buckets=16)


def _process_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.process_samples(spark, sf_dir).select(
        "pid", "start_time", F.concat(F.lit("agent-"), F.get("cmdline", 1)).alias("agent_id"), "name", "exe",
        F.concat("cwd", F.lit("/"), F.get("cmdline", 1)).alias("cwd"), F.col("ts").alias("last_seen"),
        F.col("seq").alias("arrival"),
    )


@query(
    "upsert_processes",
    """SELECT pid, start_time, arg_max('agent---slot=' || k, seq) AS agent_id, arg_min(name, seq) AS name, '/usr/bin/' || arg_min(name, seq) AS exe,
        arg_max(cwd || '/--slot=' || k, seq) AS cwd, arg_max(ts, seq) AS last_seen FROM samples GROUP BY pid, start_time""",
)
def upsert_processes(spark, sf_dir):
    """Into a stored table, in two halves."""
    updates = _process_updates(spark, sf_dir)
    table = _process_table(spark)
    middle = updates.agg(F.avg("arrival")).first()[0]
    table.upsert(updates.filter(F.col("arrival") <= middle), S.upsert_processes)
    table.upsert(updates.filter(F.col("arrival") > middle), S.upsert_processes)
    return table.read()


@query(
    "touch_agents",
    """SELECT agent_id AS id, coalesce((SELECT max(ts) FROM base s WHERE s.agent_id = a.agent_id AND event_type = 'signup'
        AND seq = (SELECT max(seq) FROM base m WHERE m.agent_id = a.agent_id AND event_type = 'signup')), ts) AS last_seen
        FROM (SELECT agent_id, min(ts) AS ts FROM base GROUP BY 1) a""",
)
def touch_agents(spark, sf_dir):
    stored = agents(spark, sf_dir).select("id", F.col("first_seen").alias("last_seen"))
    updates = T.base(spark, sf_dir, "signup").select(
        "agent_id", F.col("ts").alias("last_seen"), F.col("seq").alias("arrival")
    )
    return S.touch_agents(stored, updates)


@query("upsert_meta", "SELECT agent_id AS k, arg_max(CAST(ts AS VARCHAR), seq) AS v FROM base WHERE event_type = 'view' GROUP BY 1")
def upsert_meta(spark, sf_dir):
    updates = T.base(spark, sf_dir, "view").select(
        F.col("agent_id").alias("k"), F.col("ts").cast("string").alias("v"), F.col("seq").alias("arrival")
    )
    return S.upsert_meta(spark.createDataFrame([], schemas.META), updates)


@query("evolve_schema", "SELECT seq, host, class, CAST(NULL AS VARCHAR) AS body FROM http")
def evolve_schema(spark, sf_dir):
    old = http_requests(spark, sf_dir).drop("body", "src_port")
    return S.evolve_schema(old, schemas.HTTP_REQUESTS).select("seq", "host", "class", "body")


_PRUNE_AS_OF = END_MS - DAY_MS


@query("prune_retention", f"SELECT seq, ts, agent_id, path FROM files WHERE ts >= {_PRUNE_AS_OF - 7 * DAY_MS}")
def prune_retention(spark, sf_dir):
    kept = S.prune_retention(T.file_events(spark, sf_dir), "ts", _PRUNE_AS_OF, 7)
    return kept.select("seq", "ts", "agent_id", "path")


_STORED_PROCESSES = "SELECT pid, start_time, max_by(ts, seq) AS last_seen FROM samples GROUP BY 1, 2"


@query(
    "prune_stored",
    f"""SELECT 'connections' AS "table", count(*) FILTER (ts < {_PRUNE_AS_OF - 7 * DAY_MS}) AS removed, count(*) FILTER (ts >= {_PRUNE_AS_OF - 7 * DAY_MS}) AS kept,
            CAST(coalesce(sum(seq) FILTER (ts >= {_PRUNE_AS_OF - 7 * DAY_MS}), 0) AS BIGINT) AS check_sum FROM connections
        UNION ALL SELECT 'findings', count(*) FILTER (ts < {_PRUNE_AS_OF - 30 * DAY_MS}), count(*) FILTER (ts >= {_PRUNE_AS_OF - 30 * DAY_MS}),
            CAST(coalesce(sum(seq) FILTER (ts >= {_PRUNE_AS_OF - 30 * DAY_MS}), 0) AS BIGINT) FROM findings
        UNION ALL SELECT 'processes', count(*) FILTER (last_seen < {_PRUNE_AS_OF - 7 * DAY_MS}), count(*) FILTER (last_seen >= {_PRUNE_AS_OF - 7 * DAY_MS}),
            CAST(coalesce(sum(pid) FILTER (last_seen >= {_PRUNE_AS_OF - 7 * DAY_MS}), 0) AS BIGINT) FROM ({_STORED_PROCESSES})""",
)
def prune_stored(spark, sf_dir):
    """Retention on stored tables, written in several appends: how much went, and what is left."""
    out = None
    for name, rows, minimum in (("connections", T.connections(spark, sf_dir), 0), ("findings", findings(spark, sf_dir), 30)):
        path = _folder(spark)
        for part in range(3):
            S.append_events(rows.filter(F.col("seq") % 3 == part), path)
        removed = stored.prune_stored(spark, path, _PRUNE_AS_OF, 7, minimum, most_files=2)
        left = spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("seq"), F.lit(0)).alias("check_sum"))
        one = left.select(F.lit(name).alias("table"), F.lit(removed).cast("bigint").alias("removed"), "kept", "check_sum")
        out = one if out is None else out.unionByName(one)
    processes = _process_table(spark)
    processes.upsert(_process_updates(spark, sf_dir), S.upsert_processes)
    removed = processes.delete(F.col("last_seen") < _PRUNE_AS_OF - 7 * DAY_MS)
    left = processes.read().agg(F.count(F.lit(1)).alias("kept"), F.coalesce(F.sum("pid"), F.lit(0)).alias("check_sum"))
    return out.unionByName(left.select(F.lit("processes").alias("table"), F.lit(removed).cast("bigint").alias("removed"), "kept", "check_sum"))


@query(
    "prune_counts",
    f"""SELECT 'connections' AS "table", count(*) AS removed FROM connections WHERE ts < {_PRUNE_AS_OF - 7 * DAY_MS}
        UNION ALL SELECT 'volumes', count(*) FROM volumes WHERE ts < {_PRUNE_AS_OF - 7 * DAY_MS}
        UNION ALL SELECT 'findings', count(*) FROM findings WHERE ts < {_PRUNE_AS_OF - 30 * DAY_MS}""",
)
def prune_counts(spark, sf_dir):
    stored = {
        "connections": T.connections(spark, sf_dir), "volumes": T.volumes(spark, sf_dir),
        "findings": findings(spark, sf_dir),
    }
    return S.prune_counts(stored, _PRUNE_AS_OF, 7)
