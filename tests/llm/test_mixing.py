import math
import re
from collections import defaultdict

import pytest

from tracewarden.llm import mixing

DOC = "doc_id long, text string, source string, size string, _portion int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], DOC)


def shared_out(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by sharing the excess again until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    full, rest = {}, float(sum(sizes.values()))
    while True:
        open_ones = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_ones)
        over = [s for s in open_ones if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / total for s in open_ones}
        for s in over:
            full[s] = cap * sizes[s]
        rest = float(sum(sizes.values())) - sum(full.values())


def brute(rows, seed=17):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    goals = shared_out(dict(sizes))
    out = []
    for source in sizes:
        own = sorted((n, (i or 0) % mixing.PORTIONS, i is not None, i or 0, k) for k, ((i, _, s), n) in enumerate(zip(rows, size)) if s == source)
        rate, u = (goals[source] / sizes[source] if sizes[source] else 0.0), mixing.offset_of(seed)
        for rank, (n, *_, k) in enumerate(own, start=1):
            out.append((rows[k][0], n, sizes[source], round(goals[source], 6), math.floor(rate * rank + u) - math.floor(rate * (rank - 1) + u)))
    return sorted(out, key=repr)


ROWS = [(i, " ".join(["w"] * (i * 7 % 50 + 1)), f"s{i % 3}") for i in range(200)]
ROWS += [(1000 + i, "a b\tc d \n e", None) for i in range(5)] + [(2000, None, "empty"), (2001, "", "empty"), (None, "x y", "s0"), (5, ROWS[5][1], "s2")]
ROWS += [(3000 + i, "one two three", "hot") for i in range(300)]


def test_against_brute_force(spark):
    got = mixing.systematic_copies(docs_of(spark, ROWS)).select("doc_id", "size", "source_size", "target", "copies").collect()
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=repr) == brute(ROWS)


def test_taken_words_come_near_the_target(spark):
    rows = mixing.systematic_copies(docs_of(spark, ROWS)).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * int(r["size"])
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], int(r["size"]))
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)
    assert sum(target.values()) == pytest.approx(sum(int(r["size"]) for r in rows))


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = docs_of(spark, ROWS)
    copies = {}
    for r in mixing.systematic_copies(docs).collect():
        copies[(r["doc_id"], r["text"])] = copies.get((r["doc_id"], r["text"]), 0) + r["copies"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.collect():
        seen[(r["doc_id"], r["text"])] = seen.get((r["doc_id"], r["text"]), 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}


def test_empty_table(spark):
    assert mixing.systematic_copies(docs_of(spark, [])).count() == 0
