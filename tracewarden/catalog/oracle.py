"""The registered queries as DuckDB SQL over the same parquet tables."""

from __future__ import annotations

import re

from tracewarden.functions import net, paths, payload
from tracewarden.params import DAY_MS, GLOBAL_ALLOWED_DOMAINS
from tracewarden.telemetry import AGENTS, VIEW_PARAMS as P

PREVIEW = payload.PREVIEW_BYTES
END_MS = 1_706_745_600_000  # 2024-02-01, the end of the event data
SINCE_MS = END_MS - 7 * DAY_MS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(expr: str, values: list[str]) -> str:
    return f"{expr} IN ({', '.join(lit(v) for v in values)})"


def matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def count_matches(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


# --- expressions ----------------------------------------------------------------------------


def secret_kind(text: str) -> str:
    arms = " ".join(f"WHEN {matches(text, pattern)} THEN {lit(label)}" for label, pattern in payload.SECRET_PATTERNS)
    return f"CASE {arms} END"


def lines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')) + CASE WHEN {text} = '' OR ends_with({text}, chr(10)) THEN 0 ELSE 1 END)"


def is_source(text: str) -> str:
    n = lines(text)
    kw = count_matches(text, payload.CODE_LINE_PATTERN)
    st = count_matches(text, payload.STRUCTURAL_LINE_PATTERN)
    pa = count_matches(text, payload.PATH_LINE_PATTERN)
    pu = f"(length({text}) - length(translate({text}, '{{}};', '')))"
    score = " + ".join(
        ["1"]
        + [
            f"CASE WHEN {c} THEN 1 ELSE 0 END"
            for c in (
                f"{kw} >= 8", f"{kw} * 100 // {n} >= 30", f"{st} * 100 // {n} >= 25", f"{pu} * 100 // {n} >= 120",
                f"contains({text}, '::') OR contains({text}, '->') OR contains({text}, '}};')", f"{pa} >= 2",
            )
        ]
    )
    return (
        f"CASE WHEN NOT (strlen({text}) >= 64 AND {n} >= 5) THEN false "
        f"WHEN NOT ({kw} >= 8 OR {kw} * 100 // {n} >= 30) THEN false ELSE ({score}) >= 3 END"
    )


def source_summary(text: str) -> str:
    endings = ", ".join(lit(e) for e in payload.SOURCE_EXTENSIONS)
    found = f"[e for e in [{endings}] if contains({text}, e)]"
    return (
        f"CASE WHEN len({found}) = 0 THEN 'possible source fragment (' || {lines(text)} || ' lines)' "
        f"ELSE 'possible source (' || {lines(text)} || ' lines, mentions ' || array_to_string(({found})[1:5], ' ') || ')' END"
    )


def file_name(path: str) -> str:
    return f"regexp_extract(rtrim({path}, '/'), '([^/]*)$', 1)"


def extension(path: str) -> str:
    return f"lower(regexp_extract({file_name(path)}, '^.+\\.([^.]*)$', 1))"


def path_class(path: str) -> str:
    secret = " OR ".join(
        [
            one_of(f"lower({file_name(path)})", paths.SECRET_FILENAMES),
            f"starts_with(lower({file_name(path)}), '.env.')",
            one_of(extension(path), paths.SECRET_EXTENSIONS),
        ]
        + [f"contains({path}, {lit('/' + d + '/')})" for d in paths.SECRET_DIRS]
    )
    return f"CASE WHEN list_contains(string_split({path}, '/'), '.git') THEN 'git-metadata' WHEN {secret} THEN 'secret' END"


def ip_test(ip: str, conditions: dict[str, str]) -> str:
    """Conditions over octets a..d of a dotted IPv4 text."""
    octet = {c: f"TRY_CAST(split_part({ip}, '.', {i}) AS INT)" for i, c in enumerate("abcd", 1)}
    valid = f"regexp_matches({ip}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') AND " + " AND ".join(f"{o} <= 255" for o in octet.values())
    tests = " OR ".join(f"({c.format(**octet)})" for c in conditions)
    return f"coalesce(({valid}) AND ({tests}), false)"


PRIVATE = ["{a} = 10", "{a} = 172 AND {b} BETWEEN 16 AND 31", "{a} = 192 AND {b} = 168", "{a} = 127", "{a} = 169 AND {b} = 254", "{a} + {b} + {c} + {d} = 0"]
RESERVED = [
    "{a} = 198 AND {b} IN (18, 19)", "{a} = 100 AND {b} BETWEEN 64 AND 127", "{a} = 192 AND {b} = 0 AND {c} = 2",
    "{a} = 198 AND {b} = 51 AND {c} = 100", "{a} = 203 AND {b} = 0 AND {c} = 113", "{a} >= 240", "{a} + {b} + {c} + {d} = 0",
]
LOOPBACK = ["{a} = 127", "{a} + {b} + {c} + {d} = 0"]


def size_text(n: str) -> str:
    arms = ""
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB", "PB"]))):
        if power == 0:
            arms += f" ELSE {n} || 'B' END"
        else:
            scaled = f"({n} / {1024.0 ** power})"
            arms += f" WHEN {n} >= {1024 ** power} THEN CASE WHEN {scaled} >= 100 THEN printf('%.0f', {scaled}) ELSE printf('%.1f', {scaled}) END || '{unit}'"
    return "CASE" + arms


def host_allowed(agent: str, host: str, table: str = "domains") -> str:
    return (
        f"EXISTS (SELECT 1 FROM {table} d WHERE (d.agent_id IS NULL OR d.agent_id = {agent}) "
        f"AND ({host} = d.suffix OR ends_with({host}, '.' || d.suffix)))"
    )


def benign(host: str) -> str:
    tests = [f"starts_with({host}, '127.')", f"starts_with({host}, 'www.')"]
    tests += [f"{host} = {lit(s)} OR ends_with({host}, {lit('.' + s)})" for s in net.BENIGN_HOST_SUFFIXES]
    return "(" + " OR ".join(tests) + ")"


# --- shared tables --------------------------------------------------------------------------

_GLOBAL = ", ".join(f"({lit(d.removeprefix('*.'))})" for d in GLOBAL_ALLOWED_DOMAINS)
_IP = (
    "CASE WHEN k % 4 = 0 THEN '10.' || (pid % 200) || '.' || (seq % 250) || '.' || (1 + seq % 200) "
    "WHEN k % 4 = 1 THEN '198.18.' || (seq % 250) || '.' || (1 + seq % 200) "
    "ELSE (20 + k) || '.' || (pid % 200) || '.' || (seq % 250) || '.' || (1 + seq % 200) END"
)
VOLUME_W, READ_W, GAP = P.volume_spike_window_ms, P.bulk_read_window_ms, P.exfil_correlation_ms

CTES = {
    "base": f"""SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts, user_id AS pid, 'agent-' || (user_id % {AGENTS}) AS agent_id,
        CAST(json_extract_string(props, '$.k') AS INT) AS k, value, event_type FROM events""",
    "volumes": """SELECT seq, ts, pid, agent_id, CAST(floor(value * 1000) AS BIGINT) AS bytes_in,
        CAST(floor(value * 100000) AS BIGINT) AS bytes_out, CAST(1000 AS BIGINT) AS window_ms FROM base WHERE event_type = 'purchase'""",
    "files": """SELECT seq, ts, pid, agent_id, '/home/u/repo' || (pid % 3) AS repo_root,
        '/home/u/repo' || (pid % 3) || CASE k % 20 WHEN 0 THEN '/.git/objects/' || k WHEN 1 THEN '/.env.' || k
        WHEN 2 THEN '/keys/' || k || '.pem' ELSE '/src/f' || k || '.py' END AS path, 'open' AS op FROM base WHERE event_type = 'click'""",
    "hosts": "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS page_host FROM pages",
    "connections": f"""SELECT seq, ts, pid, agent_id, {_IP} AS remote_ip, ({_IP}) || ':443' AS remote_addr,
        CASE WHEN k % 5 != 0 THEN page_host END AS remote_host
        FROM base JOIN hosts ON page_id = seq % (SELECT count(*) FROM pages) WHERE event_type = 'view'""",
    "raw": """SELECT seq, ts, pid, agent_id, page_host AS host, text, strlen(text) AS n FROM base
        JOIN hosts ON page_id = seq % (SELECT count(*) FROM pages)
        JOIN documents ON doc_id = seq % (SELECT count(*) FROM documents) WHERE event_type = 'error'""",
    "doc_class": f"""SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN {secret_kind('text')} IS NOT NULL THEN 'secret'
        WHEN {is_source('text')} THEN 'source_code' ELSE 'text' END AS class,
        CASE WHEN {secret_kind('text')} IS NOT NULL THEN 'matches secret shape: ' || {secret_kind('text')}
        WHEN {is_source('text')} THEN {source_summary('text')} END AS sample FROM documents""",
    "http": """SELECT seq, ts, pid, agent_id, page_host AS host, 'POST' AS method, '/v1/upload' AS path,
        CAST(strlen(text) AS BIGINT) AS bytes_out, sha256(text) AS body_sha256, class, sample FROM base
        JOIN hosts ON page_id = seq % (SELECT count(*) FROM pages)
        JOIN documents ON doc_id = seq % (SELECT count(*) FROM documents)
        JOIN doc_class USING (doc_id) WHERE event_type = 'error'""",
    "samples": f"""SELECT seq, ts, pid, CASE WHEN pid % 5 != 0 THEN pid - 1 END AS ppid,
        ts // {10 * DAY_MS} * {10 * DAY_MS} AS start_time,
        CASE WHEN pid % 5 = 0 THEN 'tool-' || (pid % {AGENTS}) ELSE 'worker' END AS name, k,
        '/home/u/repo' || (pid % 3) AS cwd FROM base WHERE event_type = 'signup'""",
    "matched": "SELECT *, CASE WHEN pid % 5 = 0 THEN 'agent-' || (pid % 17) END AS direct FROM samples",
    "processes": "SELECT arg_max(s, (ts, seq)) AS p FROM (SELECT *, samples AS s FROM samples) GROUP BY pid",
    "latest": "SELECT p.* FROM processes",
    "agents": f"SELECT range AS i, 'agent-' || range AS agent_id FROM range({AGENTS})",
    "own_domains": """SELECT agent_id, CASE i % 3 WHEN 0 THEN 'example.com' ELSE 'example.net' END AS suffix FROM agents WHERE i % 3 < 2""",
    "telemetry": "SELECT agent_id, 'example.org' AS suffix FROM agents WHERE i % 4 = 0",
    "domains": f"""SELECT * FROM own_domains UNION ALL SELECT * FROM telemetry
        UNION ALL SELECT NULL, d FROM (VALUES {_GLOBAL}) g(d)""",
    # rolling windows
    "rolled": f"""SELECT v.*, (SELECT CAST(sum(w.bytes_out) AS BIGINT) FROM volumes w WHERE w.agent_id = v.agent_id
        AND w.ts >= v.ts - {VOLUME_W} AND (w.ts, w.seq) <= (v.ts, v.seq)) AS total_out FROM volumes v""",
    "git_rolled": f"""SELECT f.*, (SELECT count(*) FROM files w WHERE w.agent_id = f.agent_id AND contains(w.path, '/.git/')
        AND w.ts >= f.ts - {READ_W} AND (w.ts, w.seq) <= (f.ts, f.seq)) AS git_rows FROM files f WHERE contains(path, '/.git/')""",
    "distinct_rolled": f"""SELECT f.*, (SELECT count(DISTINCT w.path) FROM files w WHERE w.agent_id = f.agent_id AND w.repo_root = f.repo_root
        AND w.ts >= f.ts - {READ_W} AND (w.ts, w.seq) <= (f.ts, f.seq)) AS distinct_paths FROM files f""",
    "cell_paths": f"""SELECT agent_id, repo_root, ts // {READ_W} AS cell, path, min((ts, seq)) AS first_at, max((ts, seq)) AS last_at,
        max(ts) AS last_ts FROM files GROUP BY 1, 2, 3, 4""",
    "cell_ends": """SELECT *, row_number() OVER (PARTITION BY agent_id, repo_root, cell ORDER BY first_at) AS from_start,
        row_number() OVER (PARTITION BY agent_id, repo_root, cell ORDER BY last_at DESC) AS from_end FROM cell_paths""",
    "window_paths": f"""SELECT d.seq, c.path, c.first_at AS moment FROM distinct_rolled d JOIN cell_ends c ON c.agent_id = d.agent_id AND c.repo_root = d.repo_root
            AND c.cell = d.ts // {READ_W} AND c.from_start <= {P.sample_paths} AND c.first_at <= (d.ts, d.seq) WHERE d.distinct_paths >= {P.bulk_read_files}
        UNION ALL SELECT d.seq, c.path, c.last_at FROM distinct_rolled d JOIN cell_ends c ON c.agent_id = d.agent_id AND c.repo_root = d.repo_root
            AND c.cell = d.ts // {READ_W} - 1 AND c.from_end <= {2 * P.sample_paths} AND c.last_ts >= d.ts - {READ_W} WHERE d.distinct_paths >= {P.bulk_read_files}""",
    "bulk_evidence": f"""SELECT seq, string_agg(path, chr(10) ORDER BY moment, path) AS samples FROM (
        SELECT seq, path, moment, row_number() OVER (PARTITION BY seq ORDER BY moment, path) AS r FROM (
            SELECT seq, path, min(moment) AS moment FROM window_paths GROUP BY 1, 2)) WHERE r <= {P.sample_paths} GROUP BY seq""",
    "bulk": f"SELECT d.*, samples FROM distinct_rolled d JOIN bulk_evidence USING (seq) WHERE distinct_paths >= {P.bulk_read_files}",
    "signals": f"""SELECT agent_id, ts, seq, 0 AS part, 'file-read' AS kind FROM files WHERE {path_class('path')} = 'secret'
        UNION ALL SELECT agent_id, ts, seq, 0, 'git-read' FROM git_rolled WHERE git_rows >= {P.git_read_rows}
        UNION ALL SELECT agent_id, ts, seq, 1, 'bulk-read' FROM bulk""",
    "numbered": f"""SELECT *, ts - lag(ts) OVER w > {GAP} AS gap FROM signals WINDOW w AS (PARTITION BY agent_id ORDER BY ts, seq, part)""",
    "sessions": """SELECT *, sum(CASE WHEN coalesce(gap, true) THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY ts, seq, part) AS session FROM numbered""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY agent_id, session ORDER BY ts, seq, part) AS r FROM sessions",
    "uploads": f"""SELECT agent_id, ts, seq, pid, bytes_out, 'upload' AS kind FROM volumes WHERE bytes_out >= {P.significant_upload_bytes}
        UNION ALL SELECT agent_id, ts, seq, pid, bytes_out, 'http-upload' FROM http WHERE class IN ('secret', 'source_code') OR bytes_out >= {P.significant_upload_bytes}""",
    "chained": f"""SELECT u.*, (SELECT max((s.ts, s.seq, s.session)) FROM sessions s WHERE s.agent_id = u.agent_id AND (s.ts, s.seq) <= (u.ts, u.seq)
        AND s.ts >= u.ts - {GAP}) AS sig FROM uploads u""",
    "spike_hits": f"SELECT *, agent_id AS key FROM rolled WHERE total_out >= {P.volume_spike_bytes}",
    "domain_hits": f"""SELECT *, agent_id || '|' || remote_ip AS key FROM connections c
        WHERE NOT {ip_test('remote_ip', PRIVATE)} AND NOT {ip_test('remote_ip', RESERVED)}
        AND (remote_host IS NULL OR NOT {host_allowed('c.agent_id', 'c.remote_host')})""",
    "payload_hits": f"""SELECT *, agent_id || '|' || host AS key FROM (SELECT h.*, {host_allowed('h.agent_id', 'h.host', 'telemetry')} AS telemetry,
        {host_allowed('h.agent_id', 'h.host')} AS allowed FROM http h WHERE class IN ('secret', 'source_code')) WHERE telemetry OR NOT allowed""",
    "read_hits": f"SELECT *, agent_id || '|' || path AS key FROM files WHERE {path_class('path')} = 'secret'",
    "bulk_hits": "SELECT *, agent_id || '|' || distinct_paths AS key FROM bulk",
    "chain_hits": "SELECT *, agent_id AS key FROM chained WHERE sig IS NOT NULL",
}


def suppressed(hits: str, window_ms: int) -> dict[str, str]:
    """Greedy suppression: the next kept hit is the first one a window after the last kept one."""
    return {
        f"{hits}_n": f"""SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn, 1 + count(*) OVER (PARTITION BY key
            ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND {window_ms - 1} FOLLOWING) AS nx FROM {hits}""",
        f"{hits}_kept": f"""SELECT * FROM {hits}_n WHERE rn = 1 UNION ALL
            SELECT h.* FROM {hits}_kept k JOIN {hits}_n h ON h.key = k.key AND h.rn = k.nx""",
    }


for _hits in ("spike_hits", "domain_hits", "payload_hits", "read_hits", "bulk_hits", "chain_hits"):
    _window = P.repeat_ms if _hits in ("domain_hits", "payload_hits", "read_hits") else P.alert_repeat_ms
    CTES.update(suppressed(_hits, _window))

_F = "CAST({} AS INT) AS severity, ts, seq, agent_id, pid"
CTES["findings"] = f"""
    SELECT 'egress.unknown_domain' AS rule_id, {_F.format(1)}, key AS dedupe_key FROM domain_hits_kept
    UNION ALL SELECT 'egress.volume_spike', {_F.format(2)}, agent_id FROM spike_hits_kept
    UNION ALL SELECT 'egress.sensitive_payload', {_F.format('CASE WHEN telemetry THEN 4 ELSE 3 END')}, host FROM payload_hits_kept
    UNION ALL SELECT 'fs.sensitive_read', {_F.format(2)}, path FROM read_hits_kept
    UNION ALL SELECT 'fs.bulk_read', {_F.format(2)}, CAST(distinct_paths AS VARCHAR) FROM bulk_hits_kept
    UNION ALL SELECT 'exfil.chain', {_F.format(4)}, agent_id FROM chain_hits_kept"""


def with_tables(select: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the shared tables it uses, directly or through others."""
    available = {**CTES, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name, body in available.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(body)
                order.append(name)

    visit(select)
    if not order:
        return select
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({available[n]})" for n in order) + "\n" + select
