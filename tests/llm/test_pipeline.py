import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string"
SYLLABLES = {"en": ["the", "tion", "ing", "was", "and", "ly"], "de": ["der", "ung", "sch", "nicht", "keit", "ein"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    item = sentence(rng, "en", 30)
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        rows.append((i, sentence(rng, lang, rng.randint(40, 120)), lang, f"s{i % 4}"))
    near = rows[1][1].split()
    near[20] = "changed"
    rows += [(500, rows[1][1], "en", "s1"), (501, " ".join(near), "en", "s2"), (502, rows[2][1].upper(), "en", None), (2, rows[2][1], "en", "s2")]
    rows += [(600, sentence(rng, "en", 30) + " " + item + " " + sentence(rng, "en", 30), "en", "s0"), (700, "12 34 !?", None, "s0"), (701, None, "en", "s1"), (702, "", "de", None)]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, g, s, len(t or ""), "x") for i, t, g, s in rows], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = p.language_id(spark, docs, folder)
    assert found.columns == columns
    ids = {r["doc_id"] for r in found.collect()}
    assert ids == {r["doc_id"] for r in docs.collect()} - {700, 701, 702}
    single = p.near_dedup(spark, found, folder)
    assert single.columns == columns
    kept = sorted(r["doc_id"] for r in single.collect())
    assert kept == sorted(ids - {500, 501, 502})
    clean = p.decontamination(spark, single, folder)
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == set(kept) - {600}
    mixed = p.source_mix(spark, clean, folder)
    assert mixed.columns == columns
    assert {r["doc_id"] for r in mixed.collect()} <= set(kept) - {600}
    last = p.shards(spark, mixed, folder)
    assert last.count() == mixed.count()
    assert {r["shard"] for r in last.collect()} <= set(range(8))


def test_run(spark, folder):
    assert p.run(spark, folder).count() > 100
    assert [name for name, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "shards"]


def test_empty_tables_go_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_nulls_everywhere_and_ids_that_repeat(spark, folder):
    docs = spark.createDataFrame([(None, None, None, None, None, None), (1, "der die das ungkeit", None, None, None, None), (1, "der die das ungkeit", None, None, None, None)], SCHEMA)
    both = docs.unionByName(spark.read.parquet(f"{folder}/documents.parquet"))
    single = p.near_dedup(spark, both, folder)
    assert single.filter("doc_id = 1 and lang is null").count() == 1
    mixed = p.source_mix(spark, both, folder)
    assert p.shards(spark, mixed, folder).count() == mixed.count()
    assert p.decontamination(spark, both, folder).filter(F.col("doc_id").isNull()).count() == 1


def test_near_copies_are_those_of_the_similarity(spark):
    rng = random.Random(9)
    rows, shingles = [], lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    gone = set()
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        other = list(words)
        for at in range(10, 10 + 10 * (1 + i % 3), 10):  # 1 to 3 changed words: similarities 0.90, 0.82, 0.74
            other[at] = "changed"
        a, b = shingles(words), shingles(other)
        if len(a & b) / len(a | b) >= 0.8:
            gone.add(2 * i + 1)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert len(gone) == 40
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    kept = {r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_set_forest_is_exact_in_chunks_of_any_size(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:k], *[f"v{rng.randrange(999)}" for _ in range(60 - k)]]) for k in range(30, 61, 2)] + ["", None, "one", "ONE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [p.simhash.near_copies(docs, 0.8, task_shingles=n).collect() for n in (1_000_000, 60)]
    got = [{(r["doc_id"], r["component_id"]) for r in one} for one in found]
    assert all({r["component_id"] for r in one} == {r["doc_id"] for r in one if r["first"]} for one in found)
    sets = [set(p.simhash.shingle_set(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a == b or len(a & b) >= 0.8 * len(a | b):
                    root[j] = min(root[j], root[i])
    assert got[0] == got[1] == set(enumerate(root))


def test_rows_of_one_id_are_kept_by_their_text(spark):
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(0, words("a")), (5, words("b")), (5, words("a") + " more"), (None, words("c")), (None, words("d")), (7, words("d")), (8, words("e")), (8, words("e") + " x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], SCHEMA)
    kept = sorted(((r["doc_id"], r["text"][:2]) for r in p.near_dedup(spark, docs, "").collect()), key=repr)
    assert kept == sorted([(0, "a0"), (5, "b0"), (None, "c0"), (7, "d0"), (8, "e0")], key=repr)
