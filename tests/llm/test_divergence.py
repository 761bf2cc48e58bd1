import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import divergence
from tracewarden.llm.mphf import PerfectHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, prior, top):
    """rows: (text, lang, source)"""
    rows = [(re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)), lang or "", s or "") for t, lang, s in rows]
    docs, count = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, source in rows:
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = sorted(s for one, s in count if one == lang)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + prior)) // (total + prior * len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in groups}
        q = shares(sum((count[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus():
    random = np.random.default_rng(3)
    words = [f"wörd{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["A", "b", "É", "é", "straße"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(300):
        picked = random.choice(words, int(random.integers(0, 40)), p=weights / weights.sum())
        rows.append((" ,-1".join(picked), ["en", "de", "DE", None][i % 4], f"s{i * i % 7}" if i % 11 else None))
    rows += [(None, "en", "silent"), ("", "zz", "a"), ("x y z", "zz", "b"), ("1 2 !", None, None), ("b " * 5000, "en", "s1")]
    return rows + rows[:9]


@pytest.mark.parametrize(("shard_bytes", "slice_bytes"), [(1 << 20, 32 << 20), (120, 300)])
def test_against_brute_force(spark, monkeypatch, shard_bytes, slice_bytes):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = divergence.audit(docs, min_docs=6, prior=5, top=7, shard_bytes=shard_bytes, slice_bytes=slice_bytes).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 5, 7)


def test_held_counts_are_passed_on(spark, monkeypatch):
    for name, value in (("HELD_TERMS", 50), ("HELD_SLOTS", 60), ("TEXT_BYTES", 900), ("ROWS", 13), ("CELL", 9)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    got = divergence.audit(docs, min_docs=6, prior=5, top=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 6, 5, 7)


def test_empty_table_and_nothing_kept(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    few = spark.createDataFrame([("a", "en", "x"), ("b", "en", "y")], "text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.audit(few).collect())
    assert got == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(F_lit(4 * 10**12), F_lit(7 * 10**12), F_lit(10**6), 5).alias("p")).first()
    assert row.p == 1 + 10**9 * (4 * 10**12 + 5) // (7 * 10**12 + 5 * 10**6)


def F_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value).cast("long")


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=300))
def test_perfect_hash(keys):
    pairs = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    function = PerfectHash.from_bytes(PerfectHash.build(pairs[:, 0], pairs[:, 1]).to_bytes())
    assert sorted(function.slots(pairs[:, 0], pairs[:, 1]).tolist()) == list(range(len(keys))) and function.size == len(keys)
    strange = function.slots(pairs[:, 0] + np.uint64(1), pairs[:, 1])
    assert all(-1 <= s < max(1, len(keys)) for s in strange.tolist())


def test_equal_keys_are_an_error():
    with pytest.raises(ValueError, match="2 keys"):
        PerfectHash.build(np.array([5, 5, 6], np.uint64), np.array([1, 1, 1], np.uint64))
