"""Ingest, attribution and enrichment queries. Landed text is written by Spark from the telemetry view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import telemetry as T
from tracewarden.catalog.oracle import LOOPBACK, host_allowed, ip_test, path_class
from tracewarden.catalog.registry import query
from tracewarden.functions.paths import classify_path
from tracewarden.operators import joins as J
from tracewarden.operators import windows as W
from tracewarden.params import DAY_MS, GLOBAL_ALLOWED_DOMAINS
from tracewarden.sources import audit, listings
from tracewarden.sources.captures import ingest_http_captures
from tracewarden.sources.profiles import override_profiles

# --- ingest ---------------------------------------------------------------------------------


def _dumps(rows: DataFrame, entry: Column) -> DataFrame:
    """One landed text per fifty arrival numbers, entries in arrival order."""
    entries = rows.select((F.floor(F.col("seq") / 50)).alias("file"), F.struct("seq", entry.alias("entry")).alias("e"))
    return entries.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["entry"]), "\n").alias("text")
    )


@query(
    "ingest_connections",
    """SELECT CAST(seq // 50 AS VARCHAR) AS file, pid, 'tool-' || (pid % 17) AS command, CAST(1024 + seq % 60000 AS INT) AS local_port,
        remote_ip, CAST(443 AS INT) AS remote_port FROM connections""",
)
def ingest_connections(spark, sf_dir):
    pid, port = F.col("pid"), (F.lit(1024) + F.col("seq") % 60000).cast("string")
    entry = F.concat_ws(
        "\n", F.concat(F.lit("p"), pid), F.lit("n*:80"), F.concat(F.lit("ctool-"), pid % 17), F.lit("f7"),
        F.concat(F.lit("n10.1.1.1:"), port, F.lit("->"), F.col("remote_addr"), F.lit(" (ESTABLISHED)")),
    )
    lines = listings.lines_of(_dumps(T.connections(spark, sf_dir), entry))
    return listings.parse_connections(lines).drop("block", "pos")


@query(
    "ingest_byte_counters",
    """SELECT CAST(seq // 50 AS VARCHAR) AS file, 'My Tool ' || (pid % 17) || '.x' AS name, pid, bytes_in, bytes_out FROM volumes""",
)
def ingest_byte_counters(spark, sf_dir):
    entry = F.concat(
        F.lit("\x1b[1mMy  Tool "), F.col("pid") % 17, F.lit(".x."), F.col("pid"), F.lit("\x1b[0m   "),
        F.col("bytes_in"), F.lit("     "), F.col("bytes_out"), F.lit("  \r\nstate  bytes_in  bytes_out\n"),
    )
    lines = listings.lines_of(_dumps(T.volumes(spark, sf_dir), entry))
    return listings.parse_byte_counters(lines).drop("block", "pos")


@query(
    "ingest_socket_counters",
    """SELECT CAST(seq // 50 AS VARCHAR) AS file, pid, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out
        FROM volumes GROUP BY 1, 2""",
)
def ingest_socket_counters(spark, sf_dir):
    entry = F.concat(
        F.lit('ESTAB 0 0 10.0.0.1:1 1.2.3.4:443 users:(("tool",pid='), F.col("pid"), F.lit(",fd=3))\n\t cubic bytes_acked:"),
        F.col("bytes_out"), F.lit(" bytes_received:"), F.col("bytes_in"), F.lit("\n\t skmem:(r0)\nLISTEN 0 0\n\t bytes_acked:9 bytes_received:9"),
    )
    lines = listings.lines_of(_dumps(T.volumes(spark, sf_dir), entry))
    return listings.parse_socket_counters(lines)


@query(
    "ingest_file_audit",
    """SELECT seq, CASE WHEN pid % 2 = 0 THEN ts ELSE 7 END AS ts, pid, path, CASE WHEN pid % 3 = 1 THEN 'rename' ELSE 'open' END AS op,
        '/usr/bin/tool' AS process_exe FROM files WHERE pid % 3 != 2""",
)
def ingest_file_audit(spark, sf_dir):
    pid = F.col("pid")
    when = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    place = F.struct("path")
    nothing = F.lit(None)
    event = F.struct(
        F.when(pid % 3 == 0, F.struct(place.alias("file"))).alias("open"),
        F.when(pid % 3 == 1, F.struct(place.alias("source"), F.struct(F.lit("/other").alias("path")).alias("destination"))).alias("rename"),
        F.when(pid % 3 == 2, F.struct(place.alias("target"))).alias("exec"),
    )
    process = F.struct(
        F.when(pid % 4 == 0, F.struct("pid")).alias("audit_token"),
        F.when(pid % 4 != 0, pid).alias("pid"),
        F.struct(F.lit("/usr/bin/tool").alias("path")).alias("executable"),
    )
    record = F.struct(F.when(pid % 2 == 0, when).otherwise(nothing).alias("time"), event.alias("event"), process.alias("process"))
    landed = T.file_events(spark, sf_dir).select("seq", F.to_json(record).alias("value"))
    return audit.parse_file_audit(landed, 7)


@query(
    "ingest_http_captures",
    "SELECT seq, ts, pid, agent_id, host, method, path, bytes_out, body_sha256, class, sample FROM http",
)
def http_captures(spark, sf_dir):
    return ingest_http_captures(T.http_raw(spark, sf_dir)).drop("src_port", "body")


# --- attribution ----------------------------------------------------------------------------


def _profiles(spark: SparkSession) -> DataFrame:
    """View profiles that match by name, executable glob, command line part or regex in turn."""
    base = T.profiles(spark)
    i, none = F.col("ord"), F.array().cast("array<string>")
    tool = F.concat(F.lit("tool-"), i)
    return base.withColumns(
        {
            "names": F.when(i % 4 == 0, F.array(F.upper(tool))).otherwise(none),
            "exe": F.when(i % 4 == 1, F.array(F.concat(F.lit("**/"), tool))).otherwise(none),
            "cmdline_contains": F.when(i % 4 == 2, F.array(F.concat(F.upper(tool), F.lit(" --SLOT")))).otherwise(none),
            "cmdline_regex": F.when(i % 4 == 3, F.array(F.concat(F.lit("^"), tool, F.lit(r" --slot=\d+$")))).otherwise(none),
        }
    )


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.match_process(T.process_samples(spark, sf_dir), _profiles(spark))


@query("match_process", "SELECT seq, pid, name, direct AS agent_id FROM matched")
def match_process(spark, sf_dir):
    return _matched(spark, sf_dir).select("seq", "pid", "name", "agent_id")


@query("exclude_pids", "SELECT seq, pid, name FROM samples WHERE pid NOT IN (SELECT pid FROM base WHERE event_type = 'purchase' AND k % 10 = 0)")
def exclude_pids(spark, sf_dir):
    own = T.base(spark, sf_dir, "purchase").filter(F.col("k") % 10 == 0).select("pid")
    return J.exclude_pids(T.process_samples(spark, sf_dir), own).select("seq", "pid", "name")


@query(
    "attribute_ancestors",
    """SELECT pid, arg_min(agent_id, depth) AS agent_id, CAST(min(depth) AS INT) AS agent_depth FROM (
        SELECT w.pid, w.depth, CASE WHEN w.anc % 5 = 0 THEN 'agent-' || (w.anc % 17) END AS agent_id FROM walk w) WHERE agent_id IS NOT NULL GROUP BY pid""",
    {
        "walk": """SELECT pid, pid AS anc, 0 AS depth FROM latest UNION ALL
            SELECT w.pid, p.ppid, w.depth + 1 FROM walk w JOIN latest p ON p.pid = w.anc JOIN latest q ON q.pid = p.ppid WHERE w.depth < 13"""
    },
)
def attribute_ancestors(spark, sf_dir):
    processes = T.processes(spark, sf_dir)
    direct = J.match_process(processes, _profiles(spark)).select("pid", "agent_id")
    known = J.attribute_ancestors(processes, direct).filter(F.col("agent_id").isNotNull())
    return known.select("pid", "agent_id", F.col("agent_depth").cast("int").alias("agent_depth"))


@query(
    "enrich_agent",
    """SELECT seq, ts, pid, agent_id FROM (SELECT v.seq, v.ts, v.pid, (SELECT arg_max(coalesce(direct, ''), (m.ts, m.seq)) FROM matched m
        WHERE m.pid = v.pid AND (m.ts, m.seq) <= (v.ts, v.seq)) AS agent_id FROM volumes v) WHERE agent_id != ''""",
)
def enrich_agent(spark, sf_dir):
    return J.enrich_agent(T.volumes(spark, sf_dir), _matched(spark, sf_dir)).select("seq", "ts", "pid", "agent_id")


_SNAP = 6 * 3_600_000
_SOCKETS = {
    "sockets": f"""SELECT 'h' || (pid % 3) AS host_id, ts // {_SNAP} * {_SNAP} AS ts, pid % 10 AS port, min(pid) AS pid
        FROM base WHERE event_type = 'view' GROUP BY 1, 2, 3"""
}


@query(
    "port_owner",
    f"""SELECT o.seq, host_id, src_port, o.pid, coalesce((SELECT arg_max(direct, (m.ts, m.seq)) FROM matched m WHERE m.pid = o.pid AND (m.ts, m.seq) <= (o.ts, o.seq)
        AND m.seq = (SELECT arg_max(x.seq, (x.ts, x.seq)) FROM samples x WHERE x.pid = o.pid AND (x.ts, x.seq) <= (o.ts, o.seq))), 'nobody') AS agent_id
        FROM (SELECT c.seq, c.ts, 'h' || (c.pid % 3) AS host_id, CAST(c.pid % 10 AS INT) AS src_port, (SELECT s.pid FROM sockets s
            WHERE s.host_id = 'h' || (c.pid % 3) AND s.port = c.pid % 10 AND c.ts - s.ts < {2 * _SNAP}
            AND s.ts = (SELECT max(z.ts) FROM sockets z WHERE z.host_id = 'h' || (c.pid % 3) AND z.ts <= c.ts)) AS pid
        FROM base c WHERE event_type = 'error') o""",
    _SOCKETS,
)
def port_owner(spark, sf_dir):
    host = F.concat(F.lit("h"), F.col("pid") % 3).alias("host_id")
    taken = (F.floor(F.col("ts") / _SNAP) * _SNAP).alias("ts")
    sockets = (
        T.base(spark, sf_dir, "view")
        .groupBy(host, taken, (F.col("pid") % 10).cast("int").alias("port"))
        .agg(F.min("pid").alias("pid"))
        .withColumn("seq", F.lit(-1).cast("bigint"))
    )
    captures = T.base(spark, sf_dir, "error").select("seq", "ts", host, (F.col("pid") % 10).cast("int").alias("src_port"))
    owned = J.port_owner(captures, sockets, _matched(spark, sf_dir), 2 * _SNAP, "nobody", slice_ms=DAY_MS)
    return owned.select("seq", "host_id", "src_port", "pid", "agent_id")


@query(
    "repo_root",
    """SELECT s.seq, s.cwd || '/src/a' AS cwd, CASE WHEN EXISTS (SELECT 1 FROM files f WHERE starts_with(f.path, s.cwd || '/.git/')) THEN s.cwd END AS repo_root FROM samples s""",
)
def repo_root(spark, sf_dir):
    processes = T.process_samples(spark, sf_dir).withColumn("cwd", F.concat("cwd", F.lit("/src/a")))
    return J.repo_root(processes, T.file_events(spark, sf_dir)).select("seq", "cwd", "repo_root")


_SCOPED = f"""SELECT * FROM (SELECT f.seq, f.path, {path_class('f.path')} AS sensitivity, (SELECT arg_max(struct_pack(agent := CASE WHEN s.pid % 5 != 4 THEN 'agent-' || (s.pid % 17) END,
        cwd := s.cwd || CASE WHEN s.pid % 2 = 0 THEN '/src' ELSE '' END), (s.ts, s.seq)) FROM samples s WHERE s.pid = f.pid AND (s.ts, s.seq) <= (f.ts, f.seq)) AS p FROM files f)
    WHERE p.agent IS NOT NULL AND (sensitivity IS NOT NULL OR starts_with(path, p.cwd || '/'))"""


@query("scope_file_events", f"SELECT seq, path, p.agent AS agent_id, sensitivity FROM ({_SCOPED})")
def scope_file_events(spark, sf_dir):
    pid = F.col("pid")
    processes = T.process_samples(spark, sf_dir).withColumns(
        {
            "agent_id": F.when(pid % 5 != 4, F.concat(F.lit("agent-"), pid % 17)),
            "cwd": F.concat("cwd", F.when(pid % 2 == 0, "/src").otherwise("")),
        }
    )
    scoped = J.scope_file_events(T.file_events(spark, sf_dir), processes)
    return scoped.select("seq", "path", "agent_id", "sensitivity")


@query(
    "rate_limit_reads",
    f"""SELECT seq, agent_id, path FROM (SELECT *, CASE WHEN {path_class('path')} IS NULL THEN row_number() OVER (
        PARTITION BY agent_id, ts // 86400 // 1000, {path_class('path')} IS NULL ORDER BY ts // 86400, seq) ELSE 0 END AS r FROM files) WHERE r <= 2""",
)
def rate_limit_reads(spark, sf_dir):
    """With time slowed down so that a second of the limiter is a day of the view."""
    events = T.file_events(spark, sf_dir).withColumns(
        {"ts": F.floor(F.col("ts") / 86400), "sensitivity": classify_path(F.col("path"))}
    )
    return W.rate_limit_reads(events, 2, ["agent_id"]).select("seq", "agent_id", "path")


# --- counters and snapshots -----------------------------------------------------------------

_COUNTERS = {
    "counters": "SELECT seq, ts, pid, CAST(k // 10 AS BIGINT) AS bytes_in, CAST(k % 3 AS BIGINT) AS bytes_out FROM base WHERE event_type = 'purchase'",
    "deltas": """SELECT seq, ts, pid, CASE WHEN bytes_in >= pi THEN bytes_in - pi ELSE bytes_in END AS bytes_in,
        CASE WHEN bytes_out >= po THEN bytes_out - po ELSE bytes_out END AS bytes_out, ts - pt AS gap FROM (
        SELECT *, lag(bytes_in) OVER w AS pi, lag(bytes_out) OVER w AS po, lag(ts) OVER w AS pt FROM counters WINDOW w AS (PARTITION BY pid ORDER BY ts, seq)) WHERE pt IS NOT NULL""",
}


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return T.base(spark, sf_dir, "purchase").select(
        "seq", "ts", "pid", F.floor(k / 10).cast("bigint").alias("bytes_in"), (k % 3).cast("bigint").alias("bytes_out")
    )


@query("counter_delta", "SELECT seq, ts, pid, bytes_in, bytes_out FROM deltas", _COUNTERS)
def counter_delta(spark, sf_dir):
    return W.counter_delta(_counters(spark, sf_dir), slice_ms=DAY_MS)


@query("forget_missing", f"SELECT seq, ts, pid, bytes_in, bytes_out FROM deltas WHERE gap <= {DAY_MS}", _COUNTERS)
def forget_missing(spark, sf_dir):
    return W.counter_delta(_counters(spark, sf_dir), gap_ms=DAY_MS, slice_ms=DAY_MS)


@query("drop_zero_delta", "SELECT seq, ts, pid, bytes_in, bytes_out FROM deltas WHERE bytes_in != 0 OR bytes_out != 0", _COUNTERS)
def drop_zero_delta(spark, sf_dir):
    return W.drop_zero_delta(W.counter_delta(_counters(spark, sf_dir), slice_ms=DAY_MS))


_SNAPSHOTS = {
    "snapshots": f"""SELECT pid, ts // {DAY_MS} AS snapshot, arg_max(struct_pack(start_time := start_time,
        agent_id := CASE WHEN k % 7 != 0 THEN 'agent-' || (k % 2) END), (ts, seq)) AS p FROM samples GROUP BY 1, 2""",
    "followed": """SELECT *, lag(snapshot) OVER w AS ps, lag(p) OVER w AS pp FROM snapshots WINDOW w AS (PARTITION BY pid ORDER BY snapshot)""",
}


@query(
    "process_changes",
    """SELECT pid, snapshot, p.agent_id AS agent_id FROM followed WHERE p.agent_id IS NOT NULL AND (ps IS NULL OR ps != snapshot - 1
        OR pp.start_time IS DISTINCT FROM p.start_time OR pp.agent_id IS DISTINCT FROM p.agent_id)""",
    _SNAPSHOTS,
)
def process_changes(spark, sf_dir):
    slot = F.regexp_extract(F.get("cmdline", 1), r"(\d+)$", 1).cast("int")
    samples = T.process_samples(spark, sf_dir).withColumn(
        "agent_id", F.when(slot % 7 != 0, F.concat(F.lit("agent-"), slot % 2))
    )
    snapshots = (
        samples.groupBy("pid", F.floor(F.col("ts") / DAY_MS).alias("snapshot"))
        .agg(F.max_by(F.struct("start_time", "agent_id"), F.struct("ts", "seq")).alias("_p"))
        .select("pid", "snapshot", "_p.*")
    )
    return W.process_changes(snapshots, slice_snapshots=7).select("pid", "snapshot", "agent_id")


# --- connections and domains ----------------------------------------------------------------


@query("drop_loopback", f"SELECT seq, remote_ip FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN '127.0.0.' || (seq % 9) ELSE remote_ip END AS remote_ip FROM connections) WHERE NOT {ip_test('remote_ip', LOOPBACK)}")
def drop_loopback(spark, sf_dir):
    seq = F.col("seq")
    mixed = T.connections(spark, sf_dir).withColumn(
        "remote_ip", F.when(seq % 5 == 0, F.concat(F.lit("127.0.0."), seq % 9)).otherwise(F.col("remote_ip"))
    )
    return J.drop_loopback(mixed).select("seq", "remote_ip")


@query(
    "enrich_ptr",
    "SELECT c.seq, c.remote_ip, n.host AS remote_host FROM connections c LEFT JOIN (SELECT remote_ip AS ip, min(remote_host) AS host FROM connections WHERE seq % 2 = 0 GROUP BY 1) n ON c.remote_ip = n.ip",
)
def enrich_ptr(spark, sf_dir):
    connections = T.connections(spark, sf_dir)
    names = connections.filter(F.col("seq") % 2 == 0).groupBy(F.col("remote_ip").alias("ip")).agg(F.min("remote_host").alias("host"))
    return J.enrich_ptr(connections, names).select("seq", "remote_ip", "remote_host")


@query("domain_allowed", f"SELECT seq, agent_id, remote_host, remote_host IS NOT NULL AND {host_allowed('c.agent_id', 'c.remote_host')} AS allowed FROM connections c")
def domain_allowed(spark, sf_dir):
    flagged = J.domain_allowed(T.connections(spark, sf_dir), "remote_host", T.profiles(spark), GLOBAL_ALLOWED_DOMAINS)
    return flagged.select("seq", "agent_id", "remote_host", "allowed")


@query("is_telemetry_domain", f"SELECT seq, agent_id, remote_host, remote_host IS NOT NULL AND {host_allowed('c.agent_id', 'c.remote_host', 'telemetry')} AS telemetry FROM connections c")
def is_telemetry_domain(spark, sf_dir):
    flagged = J.is_telemetry_domain(T.connections(spark, sf_dir), "remote_host", T.profiles(spark))
    return flagged.select("seq", "agent_id", "remote_host", "telemetry")


@query("allowed_ip_filter", "SELECT c.seq, c.remote_ip FROM connections c ANTI JOIN (SELECT DISTINCT remote_ip FROM connections WHERE seq % 3 = 0) k ON c.remote_ip = k.remote_ip")
def allowed_ip_filter(spark, sf_dir):
    connections = T.connections(spark, sf_dir)
    resolved = connections.filter(F.col("seq") % 3 == 0).select(F.col("remote_ip").alias("ip"))
    return J.allowed_ip_filter(connections, resolved).select("seq", "remote_ip")


def _page_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles whose lists are the hosts of the page table, one per seventeenth of the pages."""
    hosts = T.page_hosts(spark, sf_dir).withColumn("id", F.concat(F.lit("agent-"), F.col("page_id") % T.AGENTS))
    starred = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("*."), F.col("page_host"))).otherwise(F.col("page_host"))
    return hosts.groupBy("id").agg(
        F.collect_set(starred).alias("allowed_domains"),
        F.array().cast("array<string>").alias("telemetry_domains"),
    )


_GLOBAL_SQL = " UNION ".join(f"SELECT '{d.removeprefix('*.')}'" for d in GLOBAL_ALLOWED_DOMAINS)


@query("allow_domain_list", f"SELECT page_host AS domain FROM hosts UNION {_GLOBAL_SQL}")
def allow_domain_list(spark, sf_dir):
    return J.allow_domain_list(_page_profiles(spark, sf_dir), GLOBAL_ALLOWED_DOMAINS)


@query(
    "domain_allowed_large",
    """SELECT c.seq, c.remote_host, coalesce(EXISTS (SELECT 1 FROM hosts h WHERE 'agent-' || (h.page_id % 17) = c.agent_id AND (c.remote_host = h.page_host
        OR (h.page_id % 2 = 0 AND ends_with(c.remote_host, '.' || h.page_host)))), false) AS allowed FROM connections c""",
)
def domain_allowed_large(spark, sf_dir):
    """Allow lists that grow with the data: matched by joins once they are too many to inline."""
    flagged = J.domain_allowed(T.connections(spark, sf_dir), "remote_host", _page_profiles(spark, sf_dir), (), inline_patterns=0)
    return flagged.select("seq", "remote_host", "allowed")


@query(
    "profile_override",
    """SELECT 'p' || s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey % 200 FROM customer)
        UNION ALL SELECT 'p' || (c_custkey % 200), arg_max(c_name, c_custkey) FROM customer GROUP BY 1""",
)
def profile_override(spark, sf_dir):
    base = T.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("p"), "s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    user = T.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("p"), F.col("c_custkey") % 200).alias("id"), F.col("c_name").alias("name")
    )
    return override_profiles(base, user).select("id", "name")


@query(
    "endpoint_cap",
    """SELECT agent_id, host, path FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY path, pos) AS r FROM (
        SELECT 'agent-' || (page_id % 17) AS agent_id, page_host AS host, min((url, page_id))[1] AS path, min((url, page_id))[2] AS pos
        FROM hosts JOIN pages USING (page_id) GROUP BY 1, 2)) WHERE r <= 15""",
)
def endpoint_cap(spark, sf_dir):
    urls = T.table(spark, sf_dir, "pages").select("page_id", "url")
    endpoints = T.page_hosts(spark, sf_dir).join(urls, "page_id").select(
        F.concat(F.lit("agent-"), F.col("page_id") % T.AGENTS).alias("agent_id"), F.col("page_host").alias("host"),
        F.col("url").alias("path"), F.col("page_id").alias("pos"), "url", F.lit("url").alias("key"),
    )
    return W.endpoint_cap(endpoints).select("agent_id", "host", "path")
