"""Detection rules. Each takes telemetry tables and returns rows of the findings schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.fmt import format_bytes, rank_of
from tracewarden.functions.net import is_private_ip, is_reserved_ip
from tracewarden.functions.paths import classify_path, is_git_path
from tracewarden.operators.joins import allowed_ip_filter, domain_allowed, is_telemetry_domain
from tracewarden.operators.slices import as_of
from tracewarden.operators.suppress import suppress_repeats
from tracewarden.operators.windows import (
    rolling_distinct_reads,
    rolling_git_reads,
    rolling_volume,
    session_cells,
    session_evidence,
    session_heads,
    window_destinations,
)
from tracewarden.params import Params
from tracewarden.schemas import EVIDENCE
from tracewarden.session import cut_lineage


@dataclass(frozen=True)
class Increment:
    """Restricts a run to hits after ``after_ts``, given the findings emitted up to then.

    Tables then hold the new rows plus the history the windows look back on.
    """

    after_ts: int
    emitted: DataFrame


# Rule names.
UNKNOWN_DOMAIN = "egress.unknown_domain"
VOLUME_SPIKE = "egress.volume_spike"
SENSITIVE_PAYLOAD = "egress.sensitive_payload"
SENSITIVE_READ = "fs.sensitive_read"
BULK_READ = "fs.bulk_read"
HIDDEN_BLOB = "artifact.hidden_blob"
UNEXPECTED_ENDPOINT = "artifact.unexpected_endpoint"
EXFIL_CHAIN = "exfil.chain"


def _text(*parts: Column | str) -> Column:
    """Concatenation in which a null part reads as empty."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def evidence_item(ts: Column, kind: Column | str, summary: Column, detail: Column | None = None) -> Column:
    return F.struct(
        ts.cast("bigint").alias("ts"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        summary.alias("summary"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


KEYS = ["rule_id", "agent_id", "dedupe_key"]


def _hit(rows: DataFrame, rule_id: str, dedupe_key: Column) -> DataFrame:
    """Mark rows as hits of a rule; repeats are suppressed per (rule, agent, dedupe key)."""
    return rows.withColumns({"rule_id": F.lit(rule_id), "dedupe_key": dedupe_key.cast("string")})


def repeat_windows(params: Params) -> dict[str, int]:
    """How long a reported key of each rule stays quiet."""
    hourly = [UNKNOWN_DOMAIN, SENSITIVE_PAYLOAD, SENSITIVE_READ, HIDDEN_BLOB, UNEXPECTED_ENDPOINT]
    return {
        **dict.fromkeys(hourly, params.repeat_ms),
        **dict.fromkeys([VOLUME_SPIKE, BULK_READ, EXFIL_CHAIN], params.alert_repeat_ms),
    }


def keep_first(hits: DataFrame, params: Params, run: Increment | None = None) -> DataFrame:
    """Hits that survive suppression.

    In an incremental run the last emitted finding of each key takes part as its first hit.
    """
    windows = repeat_windows(params)
    if run is None:
        return suppress_repeats(hits, KEYS, windows)
    fresh = hits.filter(F.col("ts") > run.after_ts).withColumn("_seed", F.lit(False))
    seeds = (
        run.emitted.filter(F.col("ts") > run.after_ts - max(windows.values()))
        .groupBy(*KEYS).agg(F.max(F.struct("ts", "seq")).alias("_at"))
        .select(*KEYS, "_at.ts", "_at.seq", F.lit(True).alias("_seed"))
    )
    both = fresh.unionByName(seeds, allowMissingColumns=True)
    return suppress_repeats(both, KEYS, windows).filter(~F.col("_seed")).drop("_seed")


def _findings(hits: DataFrame, severity: Column | str, title: Column, detail: Column, evidence: Column) -> DataFrame:
    rank = F.lit(rank_of(severity)) if isinstance(severity, str) else severity
    shaped = hits.select(
        "ts", "rule_id", rank.cast("int").alias("severity"), title.alias("title"),
        detail.alias("detail"), "agent_id", F.col("pid").cast("bigint").alias("pid"),
        evidence.cast(f"array<{EVIDENCE}>").alias("evidence"), F.lit("open").alias("status"),
        "dedupe_key", "seq",
    )
    # a repeatable id, so that re-running a job over the same rows writes the same findings
    return shaped.select(
        F.xxhash64("rule_id", "agent_id", "dedupe_key", "ts", "seq").alias("id"), *shaped.columns
    )


# --- egress ---------------------------------------------------------------------------------


def unknown_domain_hits(
    connections: DataFrame, profiles: DataFrame, params: Params, allow_ips: DataFrame | None = None
) -> DataFrame:
    """Connections to public addresses outside every allow list."""
    ip = F.col("remote_ip")
    public = connections.filter(
        F.col("agent_id").isNotNull() & ip.isNotNull() & ~is_private_ip(ip) & ~is_reserved_ip(ip)
    )
    if allow_ips is not None:
        public = allowed_ip_filter(public, allow_ips)
    flagged = domain_allowed(public, "remote_host", profiles, params.global_allowed_domains)
    unknown = flagged.filter(~F.col("allowed")).select(
        "agent_id", "remote_ip", "ts", "seq", "pid", "remote_addr", "remote_host"
    )
    return _hit(unknown, UNKNOWN_DOMAIN, _text(F.col("agent_id"), "|", ip))


def _show_unknown_domain(hits: DataFrame) -> DataFrame:
    label = F.coalesce("remote_host", "remote_addr")
    return _findings(
        hits, "low",
        _text(F.col("agent_id"), " connected to ", label, " outside its allow list"),
        _text(F.col("remote_addr"), " is on neither the agent's nor the global allow list"),
        F.array(evidence_item(F.col("ts"), "connection", _text("connected to ", F.col("remote_addr")))),
    )


def rule_unknown_domain(
    connections: DataFrame,
    profiles: DataFrame,
    params: Params,
    allow_ips: DataFrame | None = None,
    run: Increment | None = None,
) -> DataFrame:
    hits = unknown_domain_hits(connections, profiles, params, allow_ips)
    return _show_unknown_domain(keep_first(hits, params, run))


def volume_spike_hits(volumes: DataFrame, params: Params) -> DataFrame:
    """Upload volume of an agent within the window reaches the threshold."""
    rolled = rolling_volume(
        volumes.select("agent_id", "ts", "seq", "pid", "bytes_out"), params.volume_spike_window_ms, params.slice_ms
    )
    over = rolled.filter(F.col("total_out") >= params.volume_spike_bytes).drop("bytes_out")
    return _hit(over, VOLUME_SPIKE, F.col("agent_id"))


def rule_volume_spike(
    volumes: DataFrame, connections: DataFrame, params: Params, run: Increment | None = None
) -> DataFrame:
    return _show_volume_spike(keep_first(volume_spike_hits(volumes, params), params, run), connections, params)


def _show_volume_spike(hits: DataFrame, connections: DataFrame, params: Params) -> DataFrame:
    named = window_destinations(
        hits, connections, params.volume_spike_window_ms, params.destination_tail, params.destination_top
    )
    return _describe_volume_spike(named, params)


def _describe_volume_spike(hits: DataFrame, params: Params) -> DataFrame:
    size = format_bytes(F.col("total_out"))
    upload = evidence_item(F.col("ts"), "upload", _text("sent ", size, " within the window"))
    peers = F.transform("destinations", lambda d: evidence_item(F.col("ts"), "destination", d))
    return _findings(
        hits, "medium",
        _text(F.col("agent_id"), " upload volume spike"),
        _text(
            size, f" sent within {params.volume_spike_window_ms // 60_000} min, threshold ",
            format_bytes(F.lit(params.volume_spike_bytes)),
            F.when(F.size("destinations") > 0, _text("; destinations: ", F.array_join("destinations", ", "))),
        ),
        F.concat(F.array(upload), peers),
    )


def sensitive_payload_hits(http: DataFrame, profiles: DataFrame, params: Params) -> DataFrame:
    """Secrets or source code sent to a telemetry host, or to a host outside the allow list."""
    sensitive = http.filter(F.col("class").isin("secret", "source_code")).withColumn(
        "agent_id", F.coalesce("agent_id", F.lit("unknown"))
    )
    flagged = is_telemetry_domain(sensitive, "host", profiles)
    flagged = domain_allowed(flagged, "host", profiles, params.global_allowed_domains)
    columns = ["agent_id", "host", "ts", "seq", "pid", "method", "path", "class", "sample", "bytes_out", "telemetry"]
    leaks = flagged.filter(F.col("telemetry") | ~F.col("allowed")).select(*columns)
    return _hit(leaks, SENSITIVE_PAYLOAD, F.col("host"))


def rule_sensitive_payload(
    http: DataFrame, profiles: DataFrame, params: Params, run: Increment | None = None
) -> DataFrame:
    return _show_sensitive_payload(keep_first(sensitive_payload_hits(http, profiles, params), params, run))


def _show_sensitive_payload(hits: DataFrame) -> DataFrame:
    what = F.when(F.col("class") == "secret", "credentials").otherwise("source code")
    to_telemetry = F.col("telemetry")
    size = F.when(F.col("bytes_out") > 0, format_bytes(F.col("bytes_out"))).otherwise("size unknown")
    return _findings(
        hits,
        F.when(to_telemetry, rank_of("critical")).otherwise(rank_of("high")),
        _text(F.col("agent_id"), " sent ", what, F.when(to_telemetry, " to the telemetry host ").otherwise(" to "), F.col("host")),
        _text(
            F.col("method"), " ", F.col("host"), " ", F.col("path"), ": body classified as ", F.col("class"),
            " (", size, ")",
            F.when(to_telemetry, "; this host should only receive anonymous events").otherwise("; this host is not on the allow list"),
        ),
        F.array(
            evidence_item(
                F.col("ts"), "http", _text(F.col("method"), " ", F.col("host"), F.col("path")),
                F.coalesce("sample", F.lit("")),
            )
        ),
    )


# --- file reads -----------------------------------------------------------------------------


def _reads(file_events: DataFrame, params: Params) -> DataFrame:
    rows = file_events.filter(F.col("agent_id").isNotNull())
    if params.file_ops is not None:
        rows = rows.filter(F.col("op").isin(*params.file_ops))
    root = F.coalesce("repo_root", F.lit("-")) if "repo_root" in rows.columns else F.lit("-")
    return rows.select("agent_id", root.alias("repo_root"), "ts", "seq", "pid", "path")


def secret_reads(file_events: DataFrame, params: Params) -> DataFrame:
    kind = classify_path(F.col("path"), params.sensitive_globs)
    return _reads(file_events, params).filter(kind == "secret")


def sensitive_read_hits(file_events: DataFrame, params: Params, secrets: DataFrame | None = None) -> DataFrame:
    """Reads of credential files."""
    secrets = secret_reads(file_events, params) if secrets is None else secrets
    return _hit(secrets.drop("repo_root"), SENSITIVE_READ, F.col("path"))


def rule_sensitive_read(file_events: DataFrame, params: Params, run: Increment | None = None) -> DataFrame:
    return _show_sensitive_read(keep_first(sensitive_read_hits(file_events, params), params, run))


def _show_sensitive_read(hits: DataFrame) -> DataFrame:
    return _findings(
        hits, "medium",
        _text(F.col("agent_id"), " read a sensitive file"),
        _text(F.col("agent_id"), " read ", F.col("path")),
        F.array(evidence_item(F.col("ts"), "file-read", _text("read ", F.col("path")))),
    )


def bulk_counts(file_events: DataFrame, params: Params) -> DataFrame:
    """Reads at which the distinct paths of the window reach the threshold."""
    counted = rolling_distinct_reads(_reads(file_events, params), params.bulk_read_window_ms, slice_ms=params.slice_ms)
    return counted.filter(F.col("distinct_paths") >= params.bulk_read_files)


def bulk_reads(file_events: DataFrame, params: Params) -> DataFrame:
    """Reads at which the distinct paths of the window reach the threshold, with ``samples``."""
    # counted once: the samples need the cells of these reads besides
    return with_samples(cut_lineage(bulk_counts(file_events, params)), file_events, params)


def with_samples(bulk: DataFrame, file_events: DataFrame, params: Params) -> DataFrame:
    """Adds ``samples``: ``sample_paths`` of the window's paths, or all if it has fewer.

    A window ends in the hit's window-wide time cell and begins in the one before. Per cell one small row keeps
    the first paths, of which those up to the hit count, and the last ones, of which those since the window's start
    count for a hit in the next cell. Twice as many last paths are kept, as up to that many may be the same. Only reads
    of cells that a hit looks at are ranked.
    """
    reads = _reads(file_events, params)
    window = params.bulk_read_window_ms
    cell = F.floor(F.col("ts") / F.lit(window))
    keys = ["agent_id", "repo_root", "_cell"]
    hit_cells = bulk.select("agent_id", "repo_root", F.explode(F.array(cell, cell - 1)).alias("_cell")).distinct()
    at = F.struct("ts", "seq")
    near = reads.withColumn("_cell", cell).join(hit_cells, keys, "left_semi")
    per_path = near.groupBy(*keys, "path").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    few, more = params.sample_paths, 2 * params.sample_paths

    def ends(order: Column, moment: str, count: int, out: str) -> DataFrame:
        ranked = per_path.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        kept = ranked.filter(F.col("_rank") <= count).groupBy(*keys)
        return kept.agg(F.collect_list(F.struct(F.col(moment).alias("at"), "path")).alias(out))

    this = ends(F.col("first").asc(), "first", few, "_this")
    before = ends(F.col("last").desc(), "last", more, "_before").withColumn("_cell", F.col("_cell") + 1)
    moment = F.struct(F.col("ts"), F.col("seq"))
    none = F.array().cast("array<struct<at:struct<ts:bigint,seq:bigint>,path:string>>")
    in_window = F.concat(
        F.filter(F.coalesce("_before", none), lambda s: s["at"]["ts"] >= F.col("ts") - window),
        F.filter(F.coalesce("_this", none), lambda s: s["at"] <= moment),
    )
    paths = F.slice(F.array_distinct(F.transform(F.array_sort(in_window), lambda s: s["path"])), 1, few)
    return (
        bulk.withColumn("_cell", cell)
        .join(this, keys, "left").join(before, keys, "left")
        .withColumn("samples", F.array_join(paths, "\n"))
        .drop("_this", "_before", "_cell")
    )


def _secret_summary(path: Column) -> Column:
    return _text("read sensitive file ", path)


def _git_summary(rows: Column, params: Params) -> Column:
    return _text(rows, f" .git files read within {params.bulk_read_window_ms // 1000} s")


def _bulk_summary(params: Params) -> Column:
    root = F.when(F.col("repo_root") == "-", "unknown").otherwise(F.col("repo_root"))
    return _text(
        F.col("distinct_paths"), f" different files read within {params.bulk_read_window_ms // 1000} s (repository ", root, ")"
    )


def bulk_read_hits(bulk: DataFrame, params: Params) -> DataFrame:
    """Many different files of one repository read within the window."""
    key = F.col("repo_root" if params.bulk_key == "repo" else "distinct_paths")
    return _hit(bulk.drop("path"), BULK_READ, key)


def rule_bulk_read(
    file_events: DataFrame, params: Params, bulk: DataFrame | None = None, run: Increment | None = None
) -> DataFrame:
    if bulk is not None:
        return _show_bulk_read(keep_first(bulk_read_hits(bulk, params), params, run), params)
    # only hits that are reported need samples
    kept = cut_lineage(keep_first(bulk_read_hits(bulk_counts(file_events, params), params), params, run))
    return _show_bulk_read(with_samples(kept, file_events, params), params)


def _show_bulk_read(hits: DataFrame, params: Params) -> DataFrame:
    return _findings(
        hits, "medium",
        _text(F.col("agent_id"), " read repository files in bulk"),
        _text(F.col("distinct_paths"), f" different files within {params.bulk_read_window_ms // 1000} s, possibly packing them"),
        F.array(evidence_item(F.col("ts"), "bulk-read", _bulk_summary(params), F.col("samples"))),
    )


# --- read-then-upload chain -----------------------------------------------------------------


def read_signals(file_events: DataFrame, params: Params, bulk: DataFrame | None = None) -> DataFrame:
    """What may precede an exfiltration: secret reads, repeated git-metadata reads, bulk reads.

    ``part`` orders the signals one read gives: the secret or git signal, then the bulk signal.
    """
    bulk = bulk_reads(file_events, params) if bulk is None else bulk
    return _signals(file_events, params, bulk, secret_reads(file_events, params)).drop("repo_root")


def _signals(file_events: DataFrame, params: Params, bulk: DataFrame, secrets: DataFrame) -> DataFrame:
    """Read signals with ``repo_root``; those of bulk reads without ``samples`` have no detail yet, see ``_detailed``."""
    reads = _reads(file_events, params)
    git = rolling_git_reads(reads, params.bulk_read_window_ms, params.slice_ms)

    def signal(rows: DataFrame, part: int, kind: str, summary: Column, detail: Column | None = None) -> DataFrame:
        return rows.select(
            "agent_id", "ts", "seq", F.lit(part).alias("part"), F.lit(kind).alias("kind"), summary.alias("summary"),
            (F.lit(None) if detail is None else detail).cast("string").alias("detail"), "repo_root",
        )

    return (
        signal(secrets, 0, "file-read", _secret_summary(F.col("path")))
        .unionByName(
            signal(
                git.filter(F.col("git_rows") >= params.git_read_rows), 0, "git-read", _git_summary(F.col("git_rows"), params)
            )
        )
        .unionByName(signal(bulk, 1, "bulk-read", _bulk_summary(params), F.col("samples") if "samples" in bulk.columns else None))
    )


def _detailed(heads: DataFrame, file_events: DataFrame, params: Params) -> DataFrame:
    """The first signals of sessions, those of bulk reads with their samples."""
    is_bulk = F.col("kind") == "bulk-read"
    bulk = with_samples(cut_lineage(heads.filter(is_bulk)), file_events, params)
    return heads.filter(~is_bulk).unionByName(bulk.withColumn("detail", F.col("samples")).drop("samples"))


def uploads(volumes: DataFrame, http: DataFrame | None, params: Params) -> DataFrame:
    """Significant uploads: big volume rows, and captures that are sensitive or big."""
    columns = ["agent_id", "ts", "seq", "pid", "bytes_out", "kind"]
    big = F.col("bytes_out") >= params.significant_upload_bytes
    out = volumes.filter(F.col("agent_id").isNotNull() & big).withColumn("kind", F.lit("upload")).select(*columns)
    if http is None:
        return out
    sensitive = F.col("class").isin("secret", "source_code")
    captured = http.filter(sensitive | big).withColumns(
        {"kind": F.lit("http-upload"), "agent_id": F.coalesce("agent_id", F.lit("unknown"))}
    )
    return out.unionByName(captured.select(*columns))


def correlate_exfil(signals: DataFrame, uploads: DataFrame, max_gap_ms: int, slice_ms: int = 10_000) -> DataFrame:
    """Uploads with ``signal`` (ts, seq): the agent's latest read signal, at most ``max_gap_ms`` old."""
    matched = as_of(uploads, signals.select("agent_id", "ts", "seq"), ["agent_id"], "signal", slice_ms, max_gap_ms)
    return matched.filter(F.col("signal").isNotNull()).withColumn("signal", F.struct("signal.ts", "signal.seq"))


def exfil_chain_hits(
    signals: DataFrame, volumes: DataFrame, http: DataFrame | None, params: Params
) -> DataFrame:
    """A read signal followed by a significant upload of the same agent."""
    sent = uploads(volumes, http, params)
    chained = correlate_exfil(signals, sent, params.exfil_correlation_ms, params.slice_ms)
    return _hit(chained, EXFIL_CHAIN, F.col("agent_id"))


def rule_exfil_chain(
    file_events: DataFrame,
    volumes: DataFrame,
    http: DataFrame | None,
    params: Params,
    signals: DataFrame | None = None,
    run: Increment | None = None,
) -> DataFrame:
    # hits and evidence both read the signals: compute them once, samples only for those that are shown
    files = file_events if signals is None else None
    if signals is None:
        signals = cut_lineage(_signals(file_events, params, bulk_counts(file_events, params), secret_reads(file_events, params)))
    hits = keep_first(exfil_chain_hits(signals, volumes, http, params), params, run)
    return _show_exfil_chain(hits, signals, params, files)


def _show_exfil_chain(hits: DataFrame, signals: DataFrame, params: Params, file_events: DataFrame | None = None) -> DataFrame:
    """With ``file_events`` the signals are those of ``_signals``, and the ones shown get their samples here."""
    gap = params.exfil_correlation_ms
    # evidence: the first signals of the session the matched signal belongs to, up to the upload
    cells = session_cells(signals, gap)
    hits = hits.withColumn("cell", F.floor(F.col("signal.ts") / F.lit(gap))).join(cells, ["agent_id", "cell"])
    wanted = hits.select("agent_id", "session_start").distinct()
    keyed = (
        signals.withColumn("cell", F.floor(F.col("ts") / F.lit(gap)))
        .join(cells, ["agent_id", "cell"])
        .join(wanted, ["agent_id", "session_start"], "left_semi")
    )
    heads = session_heads(keyed, params.evidence_limit)
    if file_events is not None:
        heads = _detailed(cut_lineage(heads), file_events, params)
    heads = session_evidence(heads).withColumnRenamed("evidence", "_head")
    return _describe_exfil_chain(hits.join(heads, ["agent_id", "session_start"]))


def _describe_exfil_chain(hits: DataFrame) -> DataFrame:
    """``_head`` holds the first signals of the session; those up to the upload are shown."""
    before = F.filter("_head", lambda e: F.struct(e["ts"], e["seq"]) <= F.struct(F.col("ts"), F.col("seq")))
    reads = F.transform(before, lambda e: evidence_item(e["ts"], e["kind"], e["summary"], e["detail"]))
    elapsed = F.floor((F.col("ts") - F.col("signal.ts")) / 1000)
    size = format_bytes(F.col("bytes_out"))
    step = evidence_item(F.col("ts"), F.col("kind"), _text("sent ", size, " within ", elapsed, " s of reading"))
    return _findings(
        hits, "critical",
        _text(F.col("agent_id"), " may be exfiltrating: bulk or sensitive reads, then an upload"),
        _text("sensitive or bulk reads, then ", size, " sent within ", elapsed, " s; this is how packing and uploading looks"),
        F.concat(reads, F.array(step)),
    )


# --- artifacts ------------------------------------------------------------------------------


def artifact_hits(artifacts: DataFrame) -> DataFrame:
    """Scanned files and configured endpoints; several rows of one (rule, agent, path) collapse."""
    if "seq" not in artifacts.columns:
        artifacts = artifacts.withColumn("seq", F.xxhash64("agent_id", "path", "kind", "detail"))
    rule = F.when(F.col("kind") == "unexpected_endpoint", UNEXPECTED_ENDPOINT).otherwise(HIDDEN_BLOB)
    rows = artifacts.withColumn("pid", F.lit(None).cast("bigint"))
    return _hit(rows, HIDDEN_BLOB, F.col("path")).withColumn("rule_id", rule)


def _show_artifacts(hits: DataFrame) -> DataFrame:
    kind = F.col("kind")
    severity = (
        F.when(kind == "hidden_blob", rank_of("medium"))
        .when(kind == "large_file", rank_of("info"))
        .otherwise(rank_of("low"))
    )
    what = (
        F.when(kind == "hidden_blob", "high-entropy file in a data directory")
        .when(kind == "large_file", "large file in a data directory")
        .when(kind == "data_dir_growth", "data directory grew unusually")
        .otherwise("endpoint outside the allow list in a configuration")
    )
    summary = F.when(F.col("size") > 0, _text(F.col("path"), " (", format_bytes(F.col("size")), ")")).otherwise(F.col("path"))
    return _findings(
        hits, severity,
        _text(F.col("agent_id"), ": ", what),
        F.col("detail"),
        F.array(
            evidence_item(F.col("ts"), "artifact", summary, F.format_string("entropy %.2f", F.col("entropy").cast("double")))
        ),
    )


def rule_artifacts(artifacts: DataFrame, params: Params, run: Increment | None = None) -> DataFrame:
    return _show_artifacts(keep_first(artifact_hits(artifacts), params, run))


def rule_hidden_blob(artifacts: DataFrame, params: Params, run: Increment | None = None) -> DataFrame:
    return rule_artifacts(artifacts.filter(F.col("kind") != "unexpected_endpoint"), params, run)


def rule_unexpected_endpoint(artifacts: DataFrame, params: Params, run: Increment | None = None) -> DataFrame:
    return rule_artifacts(artifacts.filter(F.col("kind") == "unexpected_endpoint"), params, run)


# --- rows of a stream -----------------------------------------------------------------------


def stream_facts(events: DataFrame, profiles: DataFrame, params: Params, allow_ips: DataFrame | None = None) -> DataFrame:
    """What detection over time needs to know about each stream row, and the hits that need no history.

    Adds agent_id (as the rules see it), peer, telemetry, and the flags ``rolls`` (counts for the upload volume), ``reads``,
    ``git``, ``secret``, ``peers`` (a destination) and ``uploads``; rule_id and dedupe_key are set for hits of the row alone.
    """
    of = F.col("event_type")
    size, agent = F.col("bytes_out"), F.col("agent_id")
    rows = events.withColumns({
        "agent_id": F.when(of == "http", F.coalesce(agent, F.lit("unknown"))).otherwise(agent),
        "peer": F.when(of == "http", F.col("host")).otherwise(F.col("remote_host")),
    })
    rows = domain_allowed(rows, "peer", profiles, params.global_allowed_domains)
    rows = is_telemetry_domain(rows, "peer", profiles)
    if allow_ips is not None:
        listed = allow_ips.select(F.col("ip").alias("_ip"), F.lit(True).alias("_listed")).distinct()
        rows = rows.join(listed, F.col("remote_ip") == F.col("_ip"), "left").drop("_ip")
    else:
        rows = rows.withColumn("_listed", F.lit(None).cast("boolean"))
    known, ip = agent.isNotNull(), F.col("remote_ip")
    sensitive = F.col("class").isin("secret", "source_code")
    big = size >= params.significant_upload_bytes
    reads = (of == "file") & known
    if params.file_ops is not None:
        reads = reads & F.col("op").isin(*params.file_ops)
    secret = reads & (classify_path(F.col("path"), params.sensitive_globs) == "secret")
    unknown = (of == "connection") & known & ip.isNotNull() & ~is_private_ip(ip) & ~is_reserved_ip(ip) & ~F.col("allowed") & F.col("_listed").isNull()
    leak = (of == "http") & sensitive & (F.col("telemetry") | ~F.col("allowed"))
    endpoint = F.col("kind") == "unexpected_endpoint"
    rule = (
        F.when(unknown, UNKNOWN_DOMAIN).when(leak, SENSITIVE_PAYLOAD).when(secret, SENSITIVE_READ)
        .when((of == "artifact") & known, F.when(endpoint, UNEXPECTED_ENDPOINT).otherwise(HIDDEN_BLOB))
    )
    key = F.when(of == "connection", _text(agent, "|", ip)).when(of == "http", F.col("host")).otherwise(F.col("path"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "repo_root": F.when(of == "file", F.coalesce("repo_root", F.lit("-"))).otherwise(F.col("repo_root")),
        "rolls": flag((of == "volume") & known),
        "reads": flag(reads),
        "git": flag(reads & is_git_path(F.col("path"))),
        "secret": flag(secret),
        "peers": flag((of == "connection") & known & ip.isNotNull()),
        "uploads": flag(F.when(of == "volume", known & big).when(of == "http", F.coalesce(sensitive, F.lit(False)) | F.coalesce(big, F.lit(False)))),
        "rule_id": rule,
        "dedupe_key": F.when(rule.isNotNull(), key),
    }).drop("allowed", "_listed", "peer")


def describe_stream_hits(hits: DataFrame, params: Params) -> DataFrame:
    """Findings of hits a stream kept: its rows with total (bytes or paths), samples, destinations, signal_ts and head.

    ``head`` is an array of (ts, seq, kind, n, subject, samples), the first signals of the session."""
    shows = {
        (UNKNOWN_DOMAIN,): _show_unknown_domain,
        (VOLUME_SPIKE,): lambda h: _describe_volume_spike(h.withColumn("total_out", F.col("total")), params),
        (SENSITIVE_PAYLOAD,): _show_sensitive_payload,
        (SENSITIVE_READ,): _show_sensitive_read,
        (BULK_READ,): lambda h: _show_bulk_read(h.withColumn("distinct_paths", F.col("total")), params),
        (EXFIL_CHAIN,): lambda h: _describe_exfil_chain(_chain_of_stream(h, params)),
        (HIDDEN_BLOB, UNEXPECTED_ENDPOINT): _show_artifacts,
    }
    out = None
    for rule_ids, show in shows.items():
        part = show(hits.filter(F.col("rule_id").isin(*rule_ids)))
        out = part if out is None else out.unionByName(part)
    return out


def _chain_of_stream(hits: DataFrame, params: Params) -> DataFrame:
    seconds = params.bulk_read_window_ms // 1000

    def item(e: Column) -> Column:
        root = F.when(e["subject"] == "-", "unknown").otherwise(e["subject"])
        summary = (
            F.when(e["kind"] == "file-read", _secret_summary(e["subject"]))
            .when(e["kind"] == "git-read", _git_summary(e["n"], params))
            .otherwise(_text(e["n"], f" different files read within {seconds} s (repository ", root, ")"))
        )
        return F.struct(e["ts"].alias("ts"), e["seq"].alias("seq"), e["kind"].alias("kind"), summary.alias("summary"), e["samples"].alias("detail"))

    return hits.withColumns({
        "_head": F.transform("head", item), "signal": F.struct(F.col("signal_ts").alias("ts")),
        "kind": F.when(F.col("event_type") == "http", "http-upload").otherwise("upload"),
    })


# --- everything -----------------------------------------------------------------------------


def all_findings(
    tables: dict[str, DataFrame],
    profiles: DataFrame,
    params: Params,
    run: Increment | None = None,
    bulk: DataFrame | None = None,
    signals: DataFrame | None = None,
) -> DataFrame:
    """Every rule over every table; process rows give nothing. Missing tables are skipped.

    The hits of all rules are suppressed in one pass, and what is left is then described.
    """
    connections, volumes = tables.get("connections"), tables.get("volumes")
    files, http, artifacts = tables.get("file_events"), tables.get("http_requests"), tables.get("artifacts")
    hits, shows = [], []

    def add(rule_hits: DataFrame, rule_ids: list[str], show) -> None:
        hits.append(rule_hits)
        shows.append((rule_hits.columns, rule_ids, show))

    if connections is not None:
        found = unknown_domain_hits(connections, profiles, params, tables.get("allow_ips"))
        add(found, [UNKNOWN_DOMAIN], _show_unknown_domain)
    if volumes is not None and connections is not None:
        add(volume_spike_hits(volumes, params), [VOLUME_SPIKE], lambda h: _show_volume_spike(h, connections, params))
    if http is not None:
        add(sensitive_payload_hits(http, profiles, params), [SENSITIVE_PAYLOAD], _show_sensitive_payload)
    if files is not None:
        # samples are taken for what is reported alone: repeats are told by (ts, seq), repository and count
        bulk = cut_lineage(bulk_counts(files, params)) if bulk is None else bulk
        secrets = cut_lineage(secret_reads(files, params))
        add(sensitive_read_hits(files, params, secrets), [SENSITIVE_READ], _show_sensitive_read)
        sampled = "samples" in bulk.columns
        add(bulk_read_hits(bulk, params), [BULK_READ], lambda h: _show_bulk_read(h if sampled else with_samples(h, files, params), params))
        if volumes is not None:
            detailed = sampled or signals is not None
            signals = cut_lineage(_signals(files, params, bulk, secrets)) if signals is None else signals
            found = exfil_chain_hits(signals, volumes, http, params)
            add(found, [EXFIL_CHAIN], lambda h: _show_exfil_chain(h, signals, params, None if detailed else files))
    if artifacts is not None:
        add(artifact_hits(artifacts), [HIDDEN_BLOB, UNEXPECTED_ENDPOINT], _show_artifacts)

    # columns of one name have one type in every rule
    together = hits[0]
    for part in hits[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    kept = cut_lineage(keep_first(together, params, run))
    out = None
    for columns, rule_ids, show in shows:
        part = show(kept.filter(F.col("rule_id").isin(rule_ids)).select(*columns))
        out = part if out is None else out.unionByName(part)
    return out
