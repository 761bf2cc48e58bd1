"""Rolling windows, suppression and detection rules over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden import telemetry as T
from tracewarden.catalog.oracle import GAP, READ_W, VOLUME_W, path_class, suppressed
from tracewarden.catalog.registry import query
from tracewarden.functions import paths
from tracewarden.operators import windows as W
from tracewarden.operators.suppress import suppress_repeats
from tracewarden.plans import rules as R
from tracewarden.session import cut_lineage
from tracewarden.sources.captures import ingest_http_captures
from tracewarden.telemetry import VIEW_PARAMS as P

FINDING = ["rule_id", "severity", "ts", "seq", "agent_id", "pid", "dedupe_key"]


_landed: dict[tuple[str, str, str], DataFrame] = {}


def landed(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table earlier stages of the pipeline leave behind; written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _landed:
        _landed[key] = cut_lineage(build())
    return _landed[key]


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified captures."""
    return landed(spark, sf_dir, "http_requests", lambda: ingest_http_captures(T.http_raw(spark, sf_dir)))


@query("rolling_volume", "SELECT seq, ts, agent_id, total_out FROM rolled")
def rolling_volume(spark, sf_dir):
    rolled = W.rolling_volume(T.volumes(spark, sf_dir), VOLUME_W, P.slice_ms)
    return rolled.select("seq", "ts", "agent_id", "total_out")


@query("rolling_git_reads", "SELECT seq, ts, agent_id, git_rows FROM git_rolled")
def rolling_git_reads(spark, sf_dir):
    rolled = W.rolling_git_reads(T.file_events(spark, sf_dir), READ_W, P.slice_ms)
    return rolled.select("seq", "ts", "agent_id", "git_rows")


@query("rolling_distinct_reads", "SELECT seq, ts, agent_id, repo_root, distinct_paths FROM distinct_rolled")
def rolling_distinct_reads(spark, sf_dir):
    rolled = W.rolling_distinct_reads(T.file_events(spark, sf_dir), READ_W, slice_ms=P.slice_ms)
    return rolled.select("seq", "ts", "agent_id", "repo_root", "distinct_paths")


_DAY = 86_400_000
_CLICKS = {"click_hits": "SELECT *, agent_id || '|' || repo_root AS key FROM files", **suppressed("click_hits", _DAY)}


@query("suppress_repeats", "SELECT agent_id, repo_root, ts, seq FROM click_hits_kept", _CLICKS)
def suppress(spark, sf_dir):
    hits = T.file_events(spark, sf_dir).select("agent_id", "repo_root", "ts", "seq")
    return suppress_repeats(hits, ["agent_id", "repo_root"], _DAY)


@query("suppress_repeats_blocked", "SELECT agent_id, repo_root, ts, seq FROM click_hits_kept", _CLICKS)
def suppress_blocked(spark, sf_dir):
    """The same in the smallest blocks."""
    hits = T.file_events(spark, sf_dir).select("agent_id", "repo_root", "ts", "seq")
    return suppress_repeats(hits, ["agent_id", "repo_root"], _DAY, block_windows=2)


_PEERS = f"""SELECT h.agent_id, h.ts, h.seq, h.total_out, coalesce((SELECT string_agg(label, ', ' ORDER BY first) FROM (
    SELECT label, min((ts, seq)) AS first, row_number() OVER (ORDER BY min((ts, seq))) AS place FROM (
        SELECT coalesce(remote_host, remote_ip) AS label, ts, seq, row_number() OVER (ORDER BY ts DESC, seq DESC) AS r FROM connections c
        WHERE c.agent_id = h.agent_id AND c.ts >= h.ts - {VOLUME_W} AND (c.ts, c.seq) <= (h.ts, h.seq))
    WHERE r <= {P.destination_tail} GROUP BY label) WHERE place <= {P.destination_top}), '') AS destinations FROM spike_hits_kept h"""


@query("window_destinations", _PEERS)
def window_destinations(spark, sf_dir):
    hits = R.keep_first(R.volume_spike_hits(T.volumes(spark, sf_dir), P), P)
    named = W.window_destinations(hits, T.connections(spark, sf_dir), VOLUME_W, P.destination_tail, P.destination_top)
    return named.select("agent_id", "ts", "seq", "total_out", F.array_join("destinations", ", ").alias("destinations"))


@query("read_signals", "SELECT agent_id, ts, seq, part, kind FROM signals")
def read_signals(spark, sf_dir):
    return R.read_signals(T.file_events(spark, sf_dir), P).select("agent_id", "ts", "seq", "part", "kind")


@query(
    "read_signal_sessions",
    f"""SELECT agent_id, min(ts) AS start_ts, max(ts) AS anchor_ts, count(*) AS signals,
        string_agg(CASE WHEN r <= {P.evidence_limit} THEN kind || '@' || ts END, ';' ORDER BY r) AS evidence
        FROM ranked GROUP BY agent_id, session""",
)
def read_signal_sessions(spark, sf_dir):
    signals = cut_lineage(R.read_signals(T.file_events(spark, sf_dir), P))
    sessions = W.read_signal_sessions(signals, GAP, P.evidence_limit)
    steps = F.transform("evidence", lambda e: F.concat(e["kind"], F.lit("@"), e["ts"].cast("string")))
    return sessions.select(
        "agent_id", F.col("session_start.ts").alias("start_ts"), "anchor_ts", "signals",
        F.array_join(steps, ";").alias("evidence"),
    )


@query("correlate_exfil", "SELECT agent_id, ts, seq, kind, sig[1] AS signal_ts, sig[2] AS signal_seq FROM chained WHERE sig IS NOT NULL")
def correlate_exfil(spark, sf_dir):
    signals = cut_lineage(R.read_signals(T.file_events(spark, sf_dir), P))
    uploads = R.uploads(T.volumes(spark, sf_dir), http_requests(spark, sf_dir), P)
    return R.correlate_exfil(signals, uploads, GAP, P.slice_ms).select(
        "agent_id", "ts", "seq", "kind", F.col("signal.ts").alias("signal_ts"), F.col("signal.seq").alias("signal_seq")
    )


# --- rules ----------------------------------------------------------------------------------


def _rule_sql(rule_id: str, evidence: str | None = None, kept: str | None = None) -> str:
    columns = ", ".join(FINDING)
    if evidence is None:
        return f"SELECT {columns} FROM findings WHERE rule_id = '{rule_id}'"
    return f"SELECT f.*, {evidence} AS evidence FROM findings f JOIN {kept} k USING (seq) WHERE rule_id = '{rule_id}'"


def _kinds(findings: DataFrame) -> DataFrame:
    """Findings with evidence flattened to ``kind@ts`` steps."""
    steps = F.transform("evidence", lambda e: F.concat(e["kind"], F.lit("@"), e["ts"].cast("string")))
    return findings.select(*FINDING, F.array_join(steps, ";").alias("evidence"))


@query("rule_unknown_domain", _rule_sql("egress.unknown_domain"))
def rule_unknown_domain(spark, sf_dir):
    return R.rule_unknown_domain(T.connections(spark, sf_dir), T.profiles(spark), P).select(*FINDING)


@query("rule_volume_spike", _rule_sql("egress.volume_spike"))
def rule_volume_spike(spark, sf_dir):
    return R.rule_volume_spike(T.volumes(spark, sf_dir), T.connections(spark, sf_dir), P).select(*FINDING)


@query("rule_sensitive_payload", _rule_sql("egress.sensitive_payload"))
def rule_sensitive_payload(spark, sf_dir):
    return R.rule_sensitive_payload(http_requests(spark, sf_dir), T.profiles(spark), P).select(*FINDING)


@query("rule_sensitive_read", _rule_sql("fs.sensitive_read"))
def rule_sensitive_read(spark, sf_dir):
    return R.rule_sensitive_read(T.file_events(spark, sf_dir), P).select(*FINDING)


@query(
    "rule_bulk_read",
    "SELECT rule_id, severity, f.ts, f.seq, f.agent_id, f.pid, dedupe_key, samples FROM findings f JOIN bulk_hits_kept k USING (seq) WHERE rule_id = 'fs.bulk_read'",
)
def rule_bulk_read(spark, sf_dir):
    found = R.rule_bulk_read(T.file_events(spark, sf_dir), P)
    return found.select(*FINDING, F.get("evidence", 0)["detail"].alias("samples"))


_CHAIN_SQL = f"""SELECT 'exfil.chain' AS rule_id, CAST(4 AS INT) AS severity, k.ts, k.seq, k.agent_id, k.pid, k.agent_id AS dedupe_key,
    (SELECT string_agg(r.kind || '@' || r.ts, ';' ORDER BY r.r) FROM ranked r WHERE r.agent_id = k.agent_id AND r.session = k.sig[3]
     AND r.r <= {P.evidence_limit} AND (r.ts, r.seq) <= (k.ts, k.seq)) || ';' || k.kind || '@' || k.ts AS evidence FROM chain_hits_kept k"""


@query("rule_exfil_chain", _CHAIN_SQL)
def rule_exfil_chain(spark, sf_dir):
    found = R.rule_exfil_chain(
        T.file_events(spark, sf_dir), T.volumes(spark, sf_dir), http_requests(spark, sf_dir), P
    )
    return _kinds(found)


@query("all_findings", f"SELECT {', '.join(FINDING)} FROM findings")
def all_findings(spark, sf_dir):
    return R.all_findings(tables(spark, sf_dir), T.profiles(spark), P).select(*FINDING)


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The telemetry tables, as collectors leave them: the rules read each several times."""
    return {
        "connections": landed(spark, sf_dir, "connections", lambda: T.connections(spark, sf_dir)),
        "volumes": landed(spark, sf_dir, "volumes", lambda: T.volumes(spark, sf_dir)),
        "file_events": landed(spark, sf_dir, "file_events", lambda: T.file_events(spark, sf_dir)),
        "http_requests": http_requests(spark, sf_dir),
    }


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored findings the report queries read."""
    return landed(
        spark, sf_dir, "findings", lambda: R.all_findings(tables(spark, sf_dir), T.profiles(spark), P)
    )


@query("classify_path", f"SELECT seq, path, {path_class('path')} AS sensitivity FROM files")
def classify_path(spark, sf_dir):
    return T.file_events(spark, sf_dir).select("seq", "path", paths.classify_path(F.col("path")).alias("sensitivity"))
