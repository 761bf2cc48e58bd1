import random

import pytest
from pyspark.sql import functions as F

from tracewarden.operators import slices, suppress, windows
from tracewarden.operators.suppress import suppress_repeats

SCHEMA = "seq bigint, ts bigint, agent_id string, bytes_out bigint, path string, repo_root string"
SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def make(seed, n, span, agents=("a", "a", "a", "b", "c")):
    rng = random.Random(seed)
    return [
        (i, rng.randint(0, span), rng.choice(agents), rng.randint(0, 9), f"/p{rng.randint(0, 12)}" + rng.choice(["", "/.git/x"]), rng.choice(["r", None]))
        for i in range(n)
    ]


@pytest.fixture(params=[(1, 300, 200), (2, 200, 5000)])
def rows(request):
    return make(*request.param)


def shuffled(spark, rows, seed=7):
    mixed = list(rows)
    random.Random(seed).shuffle(mixed)
    return spark.createDataFrame(mixed, SCHEMA).repartition(3)


def in_window(rows, row, w):
    return [x for x in rows if x[2] == row[2] and row[1] - w <= x[1] and (x[1], x[0]) <= (row[1], row[0])]


def test_rolling_volume(spark, rows):
    expected = {r[0]: sum(x[3] for x in in_window(rows, r, 37)) for r in rows}
    for seed in (1, 2):
        got = windows.rolling_volume(shuffled(spark, rows, seed), 37, slice_ms=16)
        assert {r.seq: r.total_out for r in got.collect()} == expected


def test_rolling_git_reads(spark, rows):
    git = [r for r in rows if "/.git/" in r[4]]
    got = windows.rolling_git_reads(shuffled(spark, rows), 37, slice_ms=16)
    assert {r.seq: r.git_rows for r in got.collect()} == {r[0]: len(in_window(git, r, 37)) for r in git}


@pytest.mark.parametrize("method", ["sweep", "collect"])
def test_rolling_distinct(spark, rows, method):
    got = windows.rolling_distinct_reads(shuffled(spark, rows), 37, method=method, slice_ms=16)
    expected = {r[0]: len({x[4] for x in in_window(rows, r, 37) if x[5] == r[5]}) for r in rows}
    assert {r.seq: r.distinct_paths for r in got.collect()} == expected


def greedy(rows, window):
    last, kept = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] not in last or r[1] - last[r[2]] >= window:
            last[r[2]] = r[1]
            kept.add(r[0])
    return kept


@pytest.mark.parametrize("hot_rows", [10**6, 0, 100])
@pytest.mark.parametrize("window", [1, 7, 60])
def test_suppression(spark, rows, hot_rows, window):
    got = suppress_repeats(shuffled(spark, rows), ["agent_id"], window, hot_rows)
    assert {r.seq for r in got.collect()} == greedy(rows, window)


def test_suppression_across_many_blocks(spark):
    rows = make(3, 3000, 60_000, agents=("a",))
    for window in (5, 100):
        got = suppress_repeats(shuffled(spark, rows), ["agent_id"], window, 0)
        assert {r.seq for r in got.collect()} == greedy(rows, window)


@pytest.mark.parametrize("block_rows", [1, 40])
def test_suppression_in_blocks_of_few_rows(spark, monkeypatch, block_rows):
    monkeypatch.setattr(suppress, "BLOCK_ROWS", block_rows)
    rows = make(4, 1500, 30_000)
    for window in (20, 300):
        got = suppress_repeats(shuffled(spark, rows), ["agent_id"], window)
        assert {r.seq for r in got.collect()} == greedy(rows, window)


def test_suppression_of_single_cells_of_gaps_and_of_bursts(spark):
    # alone; exactly one window later; a run over an empty stretch of its cells; many hits at one instant; a null key
    times = [-25, -15, 0, 9, 10, 19, 40, 40, 40, 49, 51, 59, 61, 100, 109, 110, 111, 120]
    rows = [(i, t, a, 0, "/p", None) for a, first in (("a", 0), ("b", 100)) for i, t in enumerate(times, first)]
    got = suppress_repeats(shuffled(spark, [*rows, (999, 5, None, 0, "/p", None)]), ["agent_id"], 10)
    assert {r.seq for r in got.collect()} == greedy(rows, 10)
    assert got.columns == SCHEMA_NAMES
    assert suppress_repeats(shuffled(spark, rows).limit(0), ["agent_id"], 10).count() == 0


def test_suppression_with_a_window_for_each_rule(spark):
    rows = make(5, 400, 3000)
    windows_of = {"a": 50, "b": 0}
    got = suppress_repeats(shuffled(spark, rows), ["agent_id"], windows_of)
    by_hand = {w: {i for i in greedy([r for r in rows if r[2] == w], windows_of.get(w, 1 << 60))} for w in ("a", "c")}
    assert {r.seq for r in got.collect()} == by_hand["a"] | by_hand["c"] | {r[0] for r in rows if r[2] == "b"}


def test_as_of(spark):
    right = spark.createDataFrame([("k", 10, 1, "x"), ("k", 20, 5, "y"), ("j", 1, 2, "z")], "key string, ts bigint, seq bigint, v string")
    left = spark.createDataFrame([("k", 9, 0), ("k", 10, 3), ("k", 20, 4), ("k", 20, 6), ("k", 95, 9), ("m", 5, 7)], "key string, ts bigint, seq bigint")
    got = slices.as_of(left, right, ["key"], "m", 10)
    found = {(r.key, r.seq): (r.m.v if r.m else None) for r in got.collect()}
    assert found == {("k", 0): None, ("k", 3): "x", ("k", 4): "x", ("k", 6): "y", ("k", 9): "y", ("m", 7): None}
    near = slices.as_of(left, right, ["key"], "m", 10, tolerance_ms=5)
    assert {r.seq: r.m.v for r in near.collect() if r.m} == {3: "x", 6: "y"}


def test_counter_delta(spark):
    rows = [(1, 10, 2536, 5977, 30839), (2, 20, 2536, 6000, 31000), (3, 5000, 2536, 10, 20), (4, 20, 1, 5, 5), (5, 30, 1, 5, 5)]
    counters = spark.createDataFrame(rows, "seq bigint, ts bigint, pid bigint, bytes_in bigint, bytes_out bigint")
    deltas = windows.counter_delta(counters, slice_ms=15)
    assert sorted((r.seq, r.bytes_in, r.bytes_out) for r in deltas.collect()) == [(2, 23, 161), (3, 10, 20), (5, 0, 0)]
    assert [r.seq for r in windows.drop_zero_delta(deltas).orderBy("seq").collect()] == [2, 3]
    assert sorted(r.seq for r in windows.counter_delta(counters, gap_ms=100).collect()) == [2, 5]


def test_process_changes(spark):
    rows = [(1, 7, 100, "a"), (2, 7, 100, "a"), (3, 7, 100, "b"), (5, 7, 100, "b"), (6, 7, 200, "b"), (7, 7, 200, None), (8, 7, 200, "b")]
    snaps = spark.createDataFrame(rows, "snapshot bigint, pid bigint, start_time bigint, agent_id string")
    got = windows.process_changes(snaps, slice_snapshots=2)
    assert sorted(r.snapshot for r in got.collect()) == [1, 3, 5, 6, 8]


def test_sessions(spark):
    # gaps of at most 100 join; evidence keeps the first two
    rows = [("a", 0, 1), ("a", 100, 2), ("a", 150, 3), ("a", 251, 4), ("b", 10, 5)]
    signals = spark.createDataFrame(rows, "agent_id string, ts bigint, seq bigint").select(
        "*", F.lit(0).alias("part"), F.lit("k").alias("kind"), F.lit("s").alias("summary"), F.lit(None).cast("string").alias("detail")
    )
    got = windows.read_signal_sessions(signals, 100, 2)
    shown = sorted((r.agent_id, r.session_start.ts, r.anchor_ts, r.signals, [e.ts for e in r.evidence]) for r in got.collect())
    assert shown == [("a", 0, 150, 3, [0, 100]), ("a", 251, 251, 1, [251]), ("b", 10, 10, 1, [10])]


def test_rate_limit(spark):
    rows = [(i, i, 1, None) for i in range(10)] + [(50, 5, 1, "secret"), (60, 1500, 1, None), (70, 3, 2, None)]
    events = spark.createDataFrame(rows, "seq bigint, ts bigint, pid bigint, sensitivity string")
    kept = windows.rate_limit_reads(events, 4)
    assert sorted(r.seq for r in kept.collect()) == [0, 1, 2, 3, 50, 60, 70]


def test_window_destinations(spark):
    hits = spark.createDataFrame([("a", 100, 50)], "agent_id string, ts bigint, seq bigint")
    peers = [("a", 39, 1, "1.1.1.1", "old")] + [("a", 40 + i, 2 + i, f"2.2.2.{i}", f"h{i % 8}" if i % 8 else None) for i in range(20)]
    peers += [("a", 100, 51, "9.9.9.9", "later"), ("b", 90, 49, "3.3.3.3", "other")]
    connections = spark.createDataFrame(peers, "agent_id string, ts bigint, seq bigint, remote_ip string, remote_host string")
    got = windows.window_destinations(hits, connections, 60, tail=16, top=6).collect()
    assert got[0].destinations == ["h4", "h5", "h6", "h7", "2.2.2.8", "h1"]


def test_first_per_group_in_salted_parts(spark):
    rows = spark.range(5000).select(F.lit("k").alias("key"), (4999 - F.col("id")).alias("path"))
    kept = windows.first_per_group(rows, ["key"], ["path"], 1500, salts=8)
    assert sorted(r.path for r in kept.collect()) == list(range(1500))
