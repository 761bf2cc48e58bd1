"""Table schemas (Spark DDL). Event time is epoch milliseconds in ``ts``; ``seq`` is the arrival number."""

EVIDENCE = "struct<ts:bigint,kind:string,summary:string,detail:string>"

PROCESSES = (
    "pid bigint, ppid bigint, start_time bigint, name string, exe string, "
    "cmdline array<string>, cwd string, agent_id string, ts bigint"
)
CONNECTIONS = (
    "seq bigint, ts bigint, pid bigint, agent_id string, remote_addr string, remote_ip string, "
    "remote_port int, remote_host string, proto string"
)
VOLUMES = "seq bigint, ts bigint, pid bigint, agent_id string, bytes_in bigint, bytes_out bigint, window_ms bigint"
FILE_EVENTS = "seq bigint, ts bigint, pid bigint, agent_id string, path string, op string, source string, process_exe string"
HTTP_REQUESTS = (
    "seq bigint, ts bigint, pid bigint, agent_id string, host string, method string, path string, "
    "bytes_out bigint, body_sha256 string, class string, sample string, body string"
)
HTTP_RAW = (
    "seq bigint, ts bigint, src_port int, host string, method string, path string, "
    "content_length bigint, payload binary"
)
ARTIFACTS = "ts bigint, agent_id string, path string, size bigint, entropy float, kind string, detail string"
FINDINGS = (
    "id bigint, ts bigint, rule_id string, severity int, title string, detail string, agent_id string, "
    f"pid bigint, evidence array<{EVIDENCE}>, status string, dedupe_key string, seq bigint"
)
AGENTS = "id string, name string, vendor string, first_seen bigint, last_seen bigint"
META = "k string, v string"
PROFILES = (
    "ord int, id string, name string, vendor string, names array<string>, exe array<string>, "
    "cmdline_contains array<string>, cmdline_regex array<string>, data_dirs array<string>, "
    "config_files array<string>, allowed_domains array<string>, telemetry_domains array<string>, notes string"
)
INVENTORY = "path string, size bigint, mtime bigint, content binary"

# One stream carries every event kind: the union of the columns above plus a tag.
STREAM_EVENTS = (
    "event_type string, seq bigint, ts bigint, pid bigint, agent_id string, remote_addr string, "
    "remote_ip string, remote_port int, remote_host string, proto string, bytes_in bigint, "
    "bytes_out bigint, window_ms bigint, path string, op string, source string, process_exe string, "
    "repo_root string, host string, method string, class string, sample string, size bigint, "
    "entropy float, kind string, detail string"
)

TABLES = {
    "processes": PROCESSES,
    "connections": CONNECTIONS,
    "volumes": VOLUMES,
    "file_events": FILE_EVENTS,
    "http_requests": HTTP_REQUESTS,
    "artifacts": ARTIFACTS,
    "findings": FINDINGS,
    "agents": AGENTS,
    "meta": META,
}
