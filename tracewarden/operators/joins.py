"""Attribution and enrichment joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions.globs import any_glob
from tracewarden.functions.net import domain_variants, host_suffixes, is_loopback_ip, normalize_host
from tracewarden.functions.paths import classify_path, is_under
from tracewarden.operators.slices import as_of
from tracewarden.session import cut_lineage

# Patterns up to this number travel inside the plan as constants; more of them are joined.
INLINE_PATTERNS = 5_000
CASE_GROUP = 100


# --- processes ------------------------------------------------------------------------------


def match_process(processes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``agent_id``: the first profile (by ``ord``) that matches the process, or null.

    A profile matches by name (any case, ``.exe`` ignored), executable glob on the path or its
    base name, command-line substring (any case) or command-line regex. Profiles are settings, a
    handful of rows; unrolled into constants they cost one pass without join or shuffle, and each
    regex is compiled once.
    """
    rules = profiles.select(
        "ord", "id", "names", "exe", "cmdline_contains", "cmdline_regex"
    ).orderBy("ord").collect()
    name = F.lower("name")
    bare = F.regexp_replace(name, r"(?:\.exe)+$", "")
    base = F.substring_index("exe", "/", -1)
    line = F.array_join(F.coalesce("cmdline", F.array().cast("array<string>")), " ")
    lowered = F.lower(line)

    groups = []
    for start in range(0, len(rules), CASE_GROUP):
        case = None
        for rule in rules[start : start + CASE_GROUP]:
            tests = []
            if rule.names:
                wanted = [n.lower() for n in rule.names]
                tests.append(name.isin(wanted) | bare.isin(wanted))
            if rule.exe:
                globs = any_glob(rule.exe)
                tests.append(F.coalesce(F.col("exe").rlike(globs) | base.rlike(globs), F.lit(False)))
            tests += [lowered.contains(needle.lower()) for needle in rule.cmdline_contains or []]
            tests += [line.rlike(pattern) for pattern in rule.cmdline_regex or []]
            if not tests:
                continue
            matched = tests[0]
            for test in tests[1:]:
                matched = matched | test
            case = F.when(matched, rule.id) if case is None else case.when(matched, rule.id)
        if case is not None:
            groups.append(case)
    agent = F.coalesce(*groups) if groups else F.lit(None).cast("string")
    return processes.drop("agent_id").withColumn("agent_id", agent)


def exclude_pids(processes: DataFrame, excluded: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop the auditor's own processes before they are matched or attributed."""
    return processes.join(excluded, keys or ["pid"], "left_anti")


def attribute_ancestors(
    processes: DataFrame, direct: DataFrame, max_levels: int = 13, scope: list[str] | None = None
) -> DataFrame:
    """Adds ``agent_id`` and ``agent_depth``: the direct match, else the nearest matched ancestor.

    ``direct`` holds (scope.., pid, agent_id). Reach doubles per round (1, 2, 4, ... ancestors), so
    thirteen levels take four self-joins instead of thirteen. ``scope`` names columns within which
    a pid is unique, such as host and snapshot.
    """
    scope = scope or []
    matched = direct.filter(F.col("agent_id").isNotNull()).select(*scope, "pid", F.col("agent_id").alias("_direct"))
    nodes = processes.drop("agent_id").join(matched, [*scope, "pid"], "left")
    # each round joins the reach with itself, so every round is written out and read twice
    links = cut_lineage(nodes.select(*scope, "pid", "ppid", "_direct"))
    parents = links.select(*scope, F.col("pid").alias("ppid"), F.col("_direct").alias("_found"))
    reach = cut_lineage(
        links.drop("_direct")
        .join(parents, [*scope, "ppid"])  # a parent outside the snapshot ends the walk
        .select(*scope, "pid", F.col("ppid").alias("_anc"), "_found", F.when(F.col("_found").isNotNull(), 1).alias("_depth"))
    )
    covered = 1
    while covered < max_levels and not reach.filter("_found is null and _anc is not null").isEmpty():
        further = reach.select(
            *scope, F.col("pid").alias("_anc"), F.col("_anc").alias("_anc2"),
            F.col("_found").alias("_found2"), (F.col("_depth") + covered).alias("_depth2"),
        )
        reach = cut_lineage(
            reach.join(further, [*scope, "_anc"], "left").select(
                *scope, "pid", F.col("_anc2").alias("_anc"),
                F.coalesce("_found", "_found2").alias("_found"),
                F.coalesce("_depth", "_depth2").alias("_depth"),
            )
        )
        covered *= 2
    near = reach.filter(F.col("_depth") <= max_levels).select(*scope, "pid", "_found", "_depth")
    return (
        nodes.join(near, [*scope, "pid"], "left")
        .withColumn("agent_id", F.coalesce("_direct", "_found"))
        .withColumn("agent_depth", F.when(F.col("_direct").isNotNull(), 0).otherwise(F.col("_depth")))
        .drop("_direct", "_found", "_depth")
    )


def enrich_agent(
    samples: DataFrame, attributed: DataFrame, keys: list[str] | None = None, slice_ms: int = 3_600_000
) -> DataFrame:
    """Set ``agent_id`` from the latest process row of the pid; unattributed samples are dropped."""
    keys = keys or ["pid"]
    right = attributed.select(*keys, "ts", "seq", "agent_id")
    matched = as_of(samples.drop("agent_id"), right, keys, "_proc", slice_ms)
    found = F.col("_proc.agent_id")
    return matched.filter(found.isNotNull()).withColumn("agent_id", found).drop("_proc")


def port_owner(
    captures: DataFrame,
    sockets: DataFrame,
    attributed: DataFrame | None = None,
    ttl_ms: int = 6_000,
    default_agent: str | None = None,
    host_key: str = "host_id",
    slice_ms: int = 10_000,
) -> DataFrame:
    """Adds ``pid`` (and ``agent_id``) of the process that owned the capture's source port.

    ``sockets`` are snapshots (host, ts, seq, port, pid); a newer snapshot replaces the older one
    entirely, and one older than ``ttl_ms`` no longer counts. Owners are looked up on the captures'
    keys alone; payloads move once, in the final join on host and ``seq``, as hosts number their rows themselves.
    Where ``attributed`` carries the host too, pids are looked up per host. ``default_agent`` stands in for captures
    without a known agent.
    """
    times = sockets.select(host_key, "ts").distinct()
    following = F.lead("ts").over(Window.partitionBy(host_key).orderBy("ts"))
    times = times.withColumn("replaced_at", following)
    right = sockets.join(times, [host_key, "ts"]).select(
        host_key, F.col("port").alias("src_port"), "ts", "seq", "pid", "replaced_at"
    )
    asked = captures.select(host_key, "src_port", "ts", "seq")
    owned = as_of(asked, right, [host_key, "src_port"], "_sock", slice_ms)
    live = (F.col("ts") - F.col("_sock.ts") < ttl_ms) & (
        F.col("_sock.replaced_at").isNull() | (F.col("ts") < F.col("_sock.replaced_at"))
    )
    owners = owned.filter(live).select(host_key, "ts", "seq", F.col("_sock.pid").alias("pid"))
    rest = captures.drop("pid", "agent_id")
    if attributed is None:
        found = rest.join(owners.drop("ts"), [host_key, "seq"], "left")
        return found if default_agent is None else found.withColumn("agent_id", F.lit(default_agent))
    keys = [host_key, "pid"] if host_key in attributed.columns else ["pid"]
    right = attributed.select(*keys, "ts", "seq", "agent_id")
    known = as_of(cut_lineage(owners), right, keys, "_proc", slice_ms)
    known = known.select(host_key, "seq", "pid", F.col("_proc.agent_id").alias("agent_id"))
    return rest.join(known, [host_key, "seq"], "left").withColumn("agent_id", F.coalesce("agent_id", F.lit(default_agent)))


def repo_root(processes: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``repo_root``: the nearest directory at or above ``cwd`` that holds ``.git``."""
    at_git = F.regexp_extract("path", r"^(.*?)/\.git(?:/|$)", 1)
    roots = (
        inventory.filter(F.col("path").rlike(r"/\.git(/|$)"))
        .select(F.when(at_git == "", "/").otherwise(at_git).alias("_root"))
        .distinct()
    )
    parts = F.split(F.rtrim("cwd", F.lit("/")), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    per_cwd = (
        processes.filter(F.col("cwd").isNotNull())
        .select("cwd").distinct()
        .withColumn("_root", F.explode(above))
        .withColumn("_root", F.when(F.col("_root") == "", "/").otherwise(F.col("_root")))
        .join(roots, "_root")
        .groupBy("cwd")
        .agg(F.max_by("_root", F.length("_root")).alias("repo_root"))
    )
    return processes.join(per_cwd, "cwd", "left")


def scope_file_events(
    file_events: DataFrame,
    processes: DataFrame,
    extra_globs: tuple[str, ...] = (),
    keys: list[str] | None = None,
    slice_ms: int = 3_600_000,
) -> DataFrame:
    """Rows of attributed processes that are sensitive or lie under the process's working directory.

    Adds ``sensitivity``.
    """
    keys = keys or ["pid"]
    right = processes.select(*keys, "ts", "seq", "cwd", "agent_id")
    matched = as_of(file_events.drop("agent_id"), right, keys, "_proc", slice_ms)
    matched = matched.withColumns(
        {"agent_id": F.col("_proc.agent_id"), "sensitivity": classify_path(F.col("path"), extra_globs)}
    )
    below = F.coalesce(is_under(F.col("path"), F.col("_proc.cwd")), F.lit(False))
    return matched.filter(
        F.col("agent_id").isNotNull() & (F.col("sensitivity").isNotNull() | below)
    ).drop("_proc")


# --- connections and domains ----------------------------------------------------------------


def drop_loopback(connections: DataFrame) -> DataFrame:
    return connections.filter(~F.coalesce(is_loopback_ip(F.col("remote_ip")), F.lit(False)))


def enrich_ptr(connections: DataFrame, ip_hosts: DataFrame) -> DataFrame:
    """Set ``remote_host`` from the landed address-to-name table; null when unknown."""
    names = ip_hosts.select(F.col("ip").alias("remote_ip"), F.col("host").alias("remote_host"))
    return connections.drop("remote_host").join(names, "remote_ip", "left")


def allowed_ip_filter(connections: DataFrame, allow_ips: DataFrame) -> DataFrame:
    """Drop connections to addresses that allow-listed domains resolved to."""
    return connections.join(allow_ips.select(F.col("ip").alias("remote_ip")), "remote_ip", "left_anti")


def domain_patterns(
    profiles: DataFrame, global_domains: list[str] | tuple[str, ...], telemetry_only: bool = False
) -> DataFrame:
    """(agent_id, pattern) in canonical form; a null agent stands for every agent."""
    lists = F.col("telemetry_domains")
    if not telemetry_only:
        empty = F.array().cast("array<string>")
        lists = F.concat(F.coalesce("allowed_domains", empty), F.coalesce("telemetry_domains", empty))
    table = profiles.select(F.col("id").alias("agent_id"), F.explode(lists).alias("pattern"))
    if global_domains and not telemetry_only:
        everyone = profiles.sparkSession.createDataFrame([(None, p) for p in global_domains], table.schema)
        table = table.unionByName(everyone)
    return table.select("agent_id", F.explode(domain_variants(F.col("pattern"))).alias("pattern")).distinct()


def domain_allowed(
    rows: DataFrame,
    host_col: str,
    profiles: DataFrame,
    global_domains: list[str] | tuple[str, ...],
    out: str = "allowed",
    inline_patterns: int = INLINE_PATTERNS,
) -> DataFrame:
    """Adds whether the host is on the global list or the agent's allowed or telemetry list.

    Up to ``inline_patterns`` patterns become constants of the plan, more are joined.
    """
    return _flag_hosts(rows, host_col, domain_patterns(profiles, global_domains), out, inline_patterns)


def is_telemetry_domain(rows: DataFrame, host_col: str, profiles: DataFrame, out: str = "telemetry") -> DataFrame:
    return _flag_hosts(rows, host_col, domain_patterns(profiles, [], telemetry_only=True), out, INLINE_PATTERNS)


def _flag_hosts(rows: DataFrame, host_col: str, patterns: DataFrame, out: str, inline_patterns: int) -> DataFrame:
    few = patterns.limit(inline_patterns + 1).collect()
    host = normalize_host(F.col(host_col))
    if len(few) <= inline_patterns:
        return rows.withColumn(out, F.coalesce(_inline_match(few, host), F.lit(False)))
    return _join_match(rows, host, patterns, out)


def _inline_match(patterns: list, host: Column) -> Column:
    """Set lookups on the host and its parent domains; the pattern sets are plan constants."""
    exact: dict[str | None, list[str]] = {}
    below: dict[str | None, list[str]] = {}
    other: dict[str | None, list[str]] = {}
    for agent, pattern in patterns:
        if not set("*?[{\\") & set(pattern):
            exact.setdefault(agent, []).append(pattern)
        elif pattern.startswith("*.") and not set("*?[{\\") & set(pattern[2:]):
            below.setdefault(agent, []).append(pattern[2:])
        else:
            other.setdefault(agent, []).append(pattern)

    def table(sets: dict) -> Column:
        named = {a: v for a, v in sets.items() if a is not None}
        lists = F.from_json(F.lit(json.dumps(named)), "map<string,array<string>>")
        return F.coalesce(F.try_element_at(lists, F.col("agent_id")), F.array().cast("array<string>"))

    def constant(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    hit = F.lit(False)
    if exact.get(None):
        hit = hit | host.isin(exact[None])
    if below.get(None):
        hit = hit | F.arrays_overlap(host_suffixes(host), constant(below[None]))
    if set(exact) - {None}:
        hit = hit | F.coalesce(F.array_contains(table(exact), host), F.lit(False))
    if set(below) - {None}:
        hit = hit | F.coalesce(F.arrays_overlap(host_suffixes(host), table(below)), F.lit(False))
    for agent, globs in other.items():
        matched = host.rlike(any_glob(globs))
        hit = hit | (matched if agent is None else F.coalesce(F.col("agent_id") == agent, F.lit(False)) & matched)
    return hit


def _join_match(rows: DataFrame, host: Column, patterns: DataFrame, out: str) -> DataFrame:
    """The same for pattern tables too large to inline: hash joins on distinct (agent, host) pairs."""
    keyed = rows.withColumn("_host", host)
    pairs = keyed.filter(F.col("_host").isNotNull()).select("agent_id", "_host").distinct()
    is_below = F.col("pattern").rlike(r"^\*\.[^*?\[{\\]+$")
    is_exact = ~F.col("pattern").rlike(r"[*?\[{\\]")
    lookups = patterns.filter(is_below | is_exact).select(
        F.col("agent_id").alias("_for"),
        F.when(is_exact, "=").otherwise(".").alias("_how"),
        F.regexp_replace("pattern", r"^\*\.", "").alias("_name"),
    )
    tries = pairs.select(
        "agent_id", "_host",
        F.inline(
            F.concat(
                F.array(F.struct(F.lit("=").alias("_how"), F.col("_host").alias("_name"))),
                F.transform(host_suffixes(F.col("_host")), lambda s: F.struct(F.lit(".").alias("_how"), s.alias("_name"))),
            )
        ),
    )
    own = tries.join(lookups, (tries.agent_id == lookups._for) & (tries._how == lookups._how) & (tries._name == lookups._name), "left_semi")
    shared = tries.join(lookups.filter("_for is null").drop("_for"), ["_how", "_name"], "left_semi")
    # patterns with a wildcard elsewhere are rare hand-written settings and stay plan constants
    odd = patterns.filter(~(is_below | is_exact)).collect()
    special = pairs.filter(_inline_match(odd, F.col("_host")))
    pick = ["agent_id", "_host"]
    hits = own.select(*pick).unionByName(shared.select(*pick)).unionByName(special.select(*pick)).distinct()
    hits = hits.select(F.col("agent_id").alias("_a"), F.col("_host").alias("_h"), F.lit(True).alias(out))
    return (
        keyed.join(hits, F.col("agent_id").eqNullSafe(F.col("_a")) & (F.col("_host") == F.col("_h")), "left")
        .withColumn(out, F.coalesce(out, F.lit(False)))
        .drop("_a", "_h", "_host")
    )


def allow_domain_list(profiles: DataFrame, global_domains: list[str] | tuple[str, ...]) -> DataFrame:
    """Distinct domains of all lists without their ``*.``, the input of the address resolver."""
    empty = F.array().cast("array<string>")
    own = profiles.select(
        F.explode(F.concat(F.coalesce("allowed_domains", empty), F.coalesce("telemetry_domains", empty))).alias("domain")
    )
    everyone = profiles.sparkSession.createDataFrame([(p,) for p in global_domains], "domain string")
    return own.unionByName(everyone).select(F.regexp_replace("domain", r"^(?:\*\.)+", "").alias("domain")).distinct()
