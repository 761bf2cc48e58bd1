import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewarden.llm import simhash
from tracewarden.llm.components import components


def brute_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(points, distance):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in points:
        for b in points:
            if a < b and (a ^ b).bit_count() <= distance:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {p: find(p) for p in points}


TEXTS = [None, "", " \t\n", "Ein", "ein", "A B c d e F", "a b c d e f", "ÄÖ ß \x1c x y z w v u t", "tok " * 3000, *[f"w{i} and then some {i} more w{i} of it" for i in range(30)]]


@pytest.mark.parametrize("text", TEXTS[:12])
def test_fingerprint(text):
    assert int(simhash.fingerprint(text, 4, 1)[0]) == brute_fingerprint(text)


def test_same_as_the_engine_hash(spark):
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first()["h"] % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_first_word_of_wide_fingerprints_is_the_narrow_one():
    for text in TEXTS:
        assert simhash.fingerprint(text, 4, 4)[0] == simhash.fingerprint(text, 4, 1)[0]


def planted(seed=3, centres=60):
    rng = np.random.default_rng(seed)
    points = [int(x) for x in rng.integers(0, 2**63, centres)]
    for p in points[:20]:
        for flips in (1, 3, 4, 5, 7):
            for bit in rng.choice(64, flips, replace=False):
                p ^= 1 << int(bit)
            points.append(p)
    dense = int(rng.integers(0, 2**63))
    points += [dense ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a + 1, 40, 3)]
    return sorted(set(points))


@pytest.mark.parametrize(("blocks", "levels", "shard_points"), [(5, 24, 20_000), (5, 24, 40), (2, 5, 20_000), (1, 4, 20_000), (1, 3, 100)])
def test_links_are_exact(spark, blocks, levels, shard_points):
    points = planted()
    frame = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in points], "fingerprint binary")
    links = simhash.links(frame, 4, simhash.disjoint_blocks(64, blocks), 4 // blocks, levels, shard_points)
    pairs = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in links.collect()]
    want = brute_components(points, 4)
    assert all(want[a] == want[b] for a, b in pairs)  # stars: the ends need not be near each other
    roots = {p: p for p in points}
    found = {int.from_bytes(r["node"], "big"): int.from_bytes(r["root"], "big") for r in components(links).collect()}
    assert roots | found == want


def test_a_dense_group_gives_few_links(spark):
    """Whatever the number of trees and chunks that see it."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 2**63))
    points = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (900, 2))})
    frame = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in points], "fingerprint binary")
    for shard_points in (20_000, 100):
        links = simhash.links(frame, 4, simhash.disjoint_blocks(64, 5), 0, 24, shard_points).distinct()
        assert len(points) - 1 <= links.count() <= 5 * len(points)  # one per tree, at most
        assert components(links).select("root").distinct().count() == 1
        known = frame.withColumn("label", F.lit(7))
        assert simhash.links(known, 4, simhash.disjoint_blocks(64, 5), 0, 24, shard_points).count() == 0
        halves = frame.withColumn("label", F.pmod(F.xxhash64("fingerprint"), F.lit(2)))
        few = simhash.links(halves, 4, simhash.disjoint_blocks(64, 5), 0, 24, shard_points).distinct()
        assert 1 <= few.count() <= len(points) / 4


def test_border_points_visit_the_other_side():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 2**63, (2000, 1)).astype(np.uint64)
    mask = simhash.disjoint_blocks(64, 1)[0]
    rows, leaf = simhash.route(points, mask, 0, 3, 4)
    assert len(rows) > len(points)  # copies
    near = points ^ np.uint64(0b1011)  # three bits away
    home = simhash.route(near, mask, 0, 3, 0)[1]
    seen = {(r, n) for r, n in zip(rows.tolist(), leaf.tolist())}
    assert all((i, h) in seen for i, h in enumerate(home.tolist()))  # a partner's home is always visited


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[5]), (5, TEXTS[5]), (None, TEXTS[9]), (None, "alone " * 9)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {t: brute_fingerprint(t) for _, t in rows}
    roots = brute_components(sorted(set(prints.values())), 4)
    least = {}
    for i, t in rows:
        if i is not None:
            root = roots[prints[t]]
            least[root] = min(i, least.get(root, i))
    want = sorted(((i, f"{prints[t]:016x}", least.get(roots[prints[t]])) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], bytes(r["fingerprint"]).hex(), r["component_id"]) for r in got), key=repr) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(300)]
        copy = list(words)
        for at in rng.choice(300, 4, replace=False):  # similarity of five-word shingles about 0.88
            copy[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, words=5, bits=256, max_distance=simhash.max_distance_for(0.8, 256), trees=40)
    right = found.filter(F.col("component_id") == F.col("doc_id") - F.col("doc_id") % 2).count()
    assert right >= 0.97 * len(rows)
