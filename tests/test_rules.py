import random

import pytest
from pyspark.sql import functions as F

from tracewarden import schemas
from tracewarden.operators.suppress import suppress_repeats
from tracewarden.params import Params
from tracewarden.plans import rules
from tracewarden.sources.profiles import load_profiles

NOW = 1_760_000_000_000
P = Params()


@pytest.fixture(scope="module")
def profiles(spark):
    return load_profiles(spark)


def connections(spark, rows):
    shaped = [(i, ts, 100, agent, f"{ip}:443", ip, 443, host, "tcp") for i, (agent, ip, ts, host) in enumerate(rows)]
    return spark.createDataFrame(shaped, schemas.CONNECTIONS)


def volumes(spark, rows, agent="zcode", first_seq=1000):
    shaped = [(first_seq + i, ts, 100, agent, 0, n, 1000) for i, (ts, n) in enumerate(rows)]
    return spark.createDataFrame(shaped, schemas.VOLUMES)


def files(spark, rows, agent="zcode", root=None):
    shaped = [(i, ts, 100, agent, path, "open", "test", None, root) for i, (path, ts) in enumerate(rows)]
    return spark.createDataFrame(shaped, schemas.FILE_EVENTS + ", repo_root string")


def http(spark, rows):
    shaped = [(2000 + i, ts, 100, agent, host, "POST", "/v1", n, None, kind, "why", None) for i, (agent, host, ts, n, kind) in enumerate(rows)]
    return spark.createDataFrame(shaped, schemas.HTTP_REQUESTS)


def test_unknown_domain_once_an_hour(spark, profiles):
    rows = [("zcode", "1.2.3.4", NOW, None), ("zcode", "1.2.3.4", NOW + 1000, None), ("zcode", "1.2.3.4", NOW + 3_600_000, None)]
    found = rules.rule_unknown_domain(connections(spark, rows), profiles, P).orderBy("ts").collect()
    assert [(f.severity, f.ts) for f in found] == [(1, NOW), (1, NOW + 3_600_000)]
    assert found[0].dedupe_key == "zcode|1.2.3.4" and found[0].evidence[0].kind == "connection"


def test_private_reserved_and_allowed_are_silent(spark, profiles):
    quiet = ["198.18.0.85", "203.0.113.9", "100.64.1.2", "192.0.2.5", "192.168.1.20", "127.0.0.1"]
    rows = [("zcode", ip, NOW, None) for ip in quiet]
    rows += [("zcode", "5.5.5.5", NOW, "api.z.ai"), ("zcode", "5.5.5.6", NOW, "registry.npmjs.org"), (None, "5.5.5.7", NOW, None)]
    rows += [("zcode", "7.7.7.7", NOW, None)]
    allow = spark.createDataFrame([("7.7.7.7",)], "ip string")
    assert rules.rule_unknown_domain(connections(spark, rows), profiles, P, allow).count() == 0


def test_volume_spike(spark):
    rows = volumes(spark, [(NOW + i * 1000, 10 << 20) for i in range(3)])
    found = rules.rule_volume_spike(rows, connections(spark, []), P).collect()
    assert [(f.rule_id, f.severity, f.ts) for f in found] == [("egress.volume_spike", 2, NOW + 1000)]


def test_volume_spike_names_destinations(spark):
    rows = volumes(spark, [(NOW + i * 1000, 6 << 20) for i in range(5)])
    peers = connections(spark, [("zcode", "9.9.9.9", NOW - 2000, "api.vendor.example")])
    found = rules.rule_volume_spike(rows, peers, P).collect()
    assert len(found) == 1 and "api.vendor.example" in found[0].detail
    assert [e.kind for e in found[0].evidence] == ["upload", "destination"]


def test_sensitive_read(spark):
    found = rules.rule_sensitive_read(files(spark, [("/Users/me/proj/.env", NOW), ("/Users/me/proj/.env", NOW + 5)]), P).collect()
    assert [(f.rule_id, f.severity, f.dedupe_key) for f in found] == [("fs.sensitive_read", 2, "/Users/me/proj/.env")]


READS = [(f"/Users/me/proj/src/f{i}.rs", NOW + i * 10) for i in range(250)]


def test_bulk_read_counts_each_new_size(spark):
    found = rules.rule_bulk_read(files(spark, READS, root="/Users/me/proj"), P).collect()
    assert sorted(int(f.dedupe_key) for f in found) == list(range(200, 251))
    assert found[0].evidence[0].detail.count("\n") == 4
    by_repo = rules.rule_bulk_read(files(spark, READS), Params(bulk_key="repo")).collect()
    assert len(by_repo) == 1


@pytest.mark.parametrize("delay,expected", [(5_000, 1), (600_000, 0)])
def test_chain(spark, delay, expected):
    upload = volumes(spark, [(READS[-1][1] + delay, 5 << 20)])
    found = rules.rule_exfil_chain(files(spark, READS), upload, None, P).collect()
    assert len(found) == expected
    if expected:
        assert found[0].severity == 4 and found[0].evidence[-1].kind == "upload"
        assert [e.kind for e in found[0].evidence] == ["bulk-read"] * 8 + ["upload"]


def test_end_to_end_packed_upload(spark, profiles):
    paths = [(f"/r/.git/objects/{i}" if i % 40 == 0 else f"/r/src/f{i}.py", NOW + i * 20) for i in range(260)]
    captured = http(spark, [("zcode", "collect.evil.example", NOW + 10_000, 5000, "source_code")])
    tables = {
        "file_events": files(spark, paths, root="/r"), "volumes": volumes(spark, []), "connections": connections(spark, []),
        "http_requests": captured,
    }
    found = rules.all_findings(tables, profiles, P).collect()
    kinds = {f.rule_id for f in found}
    assert {"fs.bulk_read", "exfil.chain", "egress.sensitive_payload"} <= kinds
    chain = next(f for f in found if f.rule_id == "exfil.chain")
    assert chain.severity == 4 and len(chain.evidence) >= 2 and chain.evidence[-1].kind == "http-upload"


def test_benign_chat_is_silent(spark, profiles):
    tables = {
        "file_events": files(spark, []), "volumes": volumes(spark, []), "connections": connections(spark, []),
        "http_requests": http(spark, [("zcode", "api.z.ai", NOW, 200, "text")]),
    }
    assert rules.all_findings(tables, profiles, P).count() == 0


def test_payload_hosts(spark, profiles):
    rows = [
        ("claude-code", "api.anthropic.com", NOW, 10, "secret"), ("claude-code", "x.sentry.io", NOW, 10, "source_code"),
        ("claude-code", "evil.example", NOW, 10, "secret"), ("claude-code", "evil.example", NOW + 1, 10, "secret"),
        (None, "evil.example", NOW, 10, "secret"), ("claude-code", "evil2.example", NOW, 10, "archive"),
    ]
    found = rules.rule_sensitive_payload(http(spark, rows), profiles, P).collect()
    assert sorted((f.agent_id, f.dedupe_key, f.severity) for f in found) == [
        ("claude-code", "evil.example", 3), ("claude-code", "x.sentry.io", 4), ("unknown", "evil.example", 3)
    ]


def test_big_archive_still_correlates(spark):
    reads = files(spark, [("/p/.env", NOW)])
    captured = http(spark, [("zcode", "h", NOW + 1000, 2 << 20, "archive"), ("zcode", "h", NOW + 900_000, 2 << 20, "archive")])
    found = rules.rule_exfil_chain(reads, volumes(spark, []), captured, P).collect()
    assert [(f.ts, [e.kind for e in f.evidence]) for f in found] == [(NOW + 1000, ["file-read", "http-upload"])]


def test_git_signal_needs_twenty_rows(spark):
    upload = volumes(spark, [(NOW + 2000, 5 << 20)])
    for n, expected in ((19, 0), (20, 1)):
        reads = files(spark, [("/r/.git/index", NOW + i) for i in range(n)])
        assert rules.rule_exfil_chain(reads, upload, None, P).count() == expected


def test_artifact_rules(spark):
    rows = [
        (NOW, "zcode", "/d/blob", 300 << 20, 7.9, "hidden_blob", "d"), (NOW, "zcode", "/d/blob", 300 << 20, 7.9, "large_file", "d"),
        (NOW, "zcode", "/c.json", 0, 0.0, "unexpected_endpoint", "h1"), (NOW, "zcode", "/c.json", 0, 0.0, "unexpected_endpoint", "h2"),
        (NOW, "zcode", "/grow", 5, 0.0, "data_dir_growth", "d"),
    ]
    found = rules.rule_artifacts(spark.createDataFrame(rows, schemas.ARTIFACTS), P).collect()
    assert sorted((f.rule_id, f.dedupe_key) for f in found) == [
        ("artifact.hidden_blob", "/d/blob"), ("artifact.hidden_blob", "/grow"), ("artifact.unexpected_endpoint", "/c.json")
    ]


def test_hot_agents_give_the_same_findings(spark, profiles):
    """Narrow time slices change nothing."""
    tables = {
        "file_events": files(spark, READS), "volumes": volumes(spark, [(NOW + i * 1000, 8 << 20) for i in range(900)]),
        "connections": connections(spark, [("zcode", f"1.2.3.{i % 3}", NOW + i * 60_000, None) for i in range(200)]),
    }
    def keys(params):
        rows = rules.all_findings(tables, profiles, params).select("rule_id", "ts", "dedupe_key", F.to_json("evidence"))
        return sorted(map(tuple, rows.collect()))

    assert keys(P) == keys(Params(slice_ms=700))


def kept_by_hand(rows, window):
    last, out = {}, []
    for key, ts, seq, tag in sorted(rows):
        if key not in last or ts - last[key] >= window:
            last[key] = ts
            out.append((key, ts, seq, tag))
    return out


@pytest.mark.parametrize("window", [0, 1, 50, 100_000])
@pytest.mark.parametrize("blocks", [2, 64])
def test_suppression_with_equal_times_and_numbers(spark, window, blocks):
    rng = random.Random(window + blocks)
    rows = [(rng.choice("abc"), rng.randint(-300, 3000), rng.randint(0, 2), rng.randint(0, 9)) for _ in range(800)]
    rows += rows[:50]
    hits = spark.createDataFrame(rows, "k string, ts long, seq long, tag long")
    got = sorted(map(tuple, suppress_repeats(hits, ["k"], window, blocks).select("k", "ts", "seq", "tag").collect()))
    assert got == sorted(kept_by_hand(rows, window))


def test_a_million_hits_of_one_key(spark):
    hits = spark.range(1_000_000).select(F.lit("k").alias("k"), (F.col("id") * 7).alias("ts"), F.col("id").alias("seq"))
    kept = suppress_repeats(hits, ["k"], 1000).select("ts").orderBy("ts").collect()
    assert [r.ts for r in kept] == [i * 1001 for i in range(len(kept))] and len(kept) == -(-7_000_000 // 1001)


def test_bulk_evidence_takes_paths_of_the_whole_window(spark):
    """A hit just after the border of a time cell still names five paths."""
    border = (NOW // 60_000 + 1) * 60_000
    reads = files(spark, [(f"/r/f{i}.py", border - 400 + i) for i in range(399)] + [("/r/last.py", border + 5)])
    hits = rules.bulk_reads(reads, P).filter(F.col("ts") == border + 5).select("samples").collect()
    assert [len(set(r.samples.split("\n"))) for r in hits] == [5]


def test_samples_are_taken_of_reported_bulk_reads_alone(spark, profiles, monkeypatch):
    """Hits that are suppressed need no samples; findings and their evidence are those of samples taken for all."""
    reads = files(spark, [(f"/r/f{i}.py", NOW + i) for i in range(240)] + [(f"/r/f{i}.py", NOW + 1000 + i) for i in range(240)])
    tables = {"file_events": reads, "volumes": volumes(spark, [(NOW + 5000, 30 << 20)]), "connections": connections(spark, [])}
    shown = lambda found: sorted((f.rule_id, f.ts, f.dedupe_key, f.detail, str(f.evidence)) for f in found.collect())
    expected = shown(rules.all_findings(tables, profiles, P, bulk=rules.bulk_reads(reads, P)))
    taken, with_samples = [], rules.with_samples

    def counted(bulk, *rest):
        taken.append(bulk.count())
        return with_samples(bulk, *rest)

    monkeypatch.setattr(rules, "with_samples", counted)
    assert shown(rules.all_findings(tables, profiles, P)) == expected
    assert rules.bulk_counts(reads, P).count() == 281 and sorted(taken) == [8, 41]
