"""The registered queries on the smallest tables, against brute force."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_ann import brute as nearest_by_hand
from test_lines import brute as lines_by_hand
from test_lm import brute as scores_by_hand
from test_simhash import brute_components, brute_fingerprint
from test_tokenfiles import check as check_token_files

import __spark_entry__ as entry
from tracewarden.llm import decontaminate, tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not present")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_token_counts(spark, documents):
    count = tokens.counter(tokens.VOCABULARY)
    want = {}
    for d in documents:
        text, n = d.text, len(d.text)
        third, half = n // 3, n // 2
        script = [(third, third + 17, text[:23]), (half, half + 9, ""), (n, n, " " + d.source)]
        new, at = "", 0
        for start, stop, piece in sorted(script):
            start = max(start, at)
            stop = max(start, min(stop, n))
            new += text[at:start] + piece
            at = stop
        new += text[at:]
        want[d.doc_id] = (count(text), count(new), len(new), zlib.crc32(new.encode()))
    got = {r.doc_id: (r.tokens_before, r.tokens_after, r.chars_after, r.text_crc32) for r in rows(spark, "op1_token_counts")}
    assert got == want


def test_lm_scores(spark, documents):
    want = {i: (n, round(s, 6), h) for i, n, s, h in scores_by_hand([(d.doc_id, d.text) for d in documents])}
    assert {r.doc_id: (r.n_words, round(r.log_score, 6), r.trigram_hits) for r in rows(spark, "op2_lm_scores")} == want


def test_near_duplicates(spark, documents):
    prints = {d.doc_id: brute_fingerprint(d.text) for d in documents}
    roots = brute_components(sorted(set(prints.values())), 4)
    least = defaultdict(lambda: 1 << 60)
    for i, p in prints.items():
        least[roots[p]] = min(least[roots[p]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op4_simhash_near_dedup")}
    assert got == {i: (f"{p:016x}", least[roots[p]]) for i, p in prints.items()}


def test_shards(spark, documents):
    got = rows(spark, "op5_sharding")
    text = {d.doc_id: d.text for d in documents}
    size, slots = Counter(), defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()), "bytes", None)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == sorted(text)
    mean, largest = sum(size.values()) / 8, max(r.size for r in got)
    assert max(abs(v - mean) for v in size.values()) <= 0.01 * mean + largest
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_leaks(spark, documents):
    def plain(text):
        return "".join(map(chr, decontaminate.normal(text)[0]))

    items = {r.item_id: plain(r.text.strip()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d.doc_id, i) for d in documents for i, t in items.items() if t in plain(d.text)}
    got = {(r.doc_id, r.item_id): r.edits for r in rows(spark, "op6_benchmark_decontamination")}
    assert whole and whole <= {k for k, edits in got.items() if edits == 0}
    for doc_id, item in set(got) - whole:  # parts of long items, or edited
        text = plain(next(d.text for d in documents if d.doc_id == doc_id))
        units = decontaminate.units_of(item, items[item], 0.1, 200)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert any(decontaminate.align(u.codes, np.pad(codes, (0, len(u.codes)))[None])[0][0] <= u.edits for u in units)


def test_neighbours(spark):
    vectors = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = nearest_by_hand(vectors, [i for i, _ in vectors if i % 20 == 0], 20)
    got = defaultdict(set)
    for r in rows(spark, "op7_nearest_neighbours"):
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in want) / sum(map(len, want.values())) >= 0.9


def test_languages(spark, documents):
    lang = {d.doc_id: d.lang for d in documents}
    got = rows(spark, "op8_language_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) >= 0.95


def test_lines(spark, documents):
    want = {(i, n, gone, zlib.crc32(t.encode())) for i, t, n, gone in lines_by_hand([(d.doc_id, d.text) for d in documents])}
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.text_crc32) for r in rows(spark, "op9_line_dedup")} == want


def test_token_files(spark, documents):
    check_token_files([(d.doc_id, d.text) for d in documents], rows(spark, "op13_token_files"))
