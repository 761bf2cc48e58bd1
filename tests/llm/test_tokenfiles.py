import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewarden.llm import tokenfiles

WHOLE = Tokenizer.from_file(tokenfiles.VOCABULARY)
ROWS = [
    (5, "Hello # world ## #"), (3, ""), (8, None), (-2, "ünï x y\u0085z don't 123"), (7, "a\n\tb"), (7, "zz"), (7, "zz"), (None, "no id"),
    (None, "another # without"), (2**40, "<|endoftext|> in <|startoftext|>text"), (9, "long " * 4000 + "w" * 3000), (1, "𝄞 é ́ \x1c\x1d"),
]


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, got):
    """Every row once, documents of equal id in any order among themselves."""
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (repr(i), len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for i, t in rows
    )
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id is not None and r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id


def files_of(spark, path, rows, shard_bytes=1 << 20, bucket_keys=50_000):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, first string, shard int").repartition(3)
    tokenfiles.write_shards(docs, path, shard_bytes=shard_bytes)
    tokenfiles.write_index(spark, path, bucket_keys=bucket_keys)
    return docs


@pytest.mark.parametrize(("shard_bytes", "bucket_keys"), [(1 << 20, 50_000), (200, 2)])
def test_against_whole_encoding(spark, tmp_path, shard_bytes, bucket_keys):
    path = str(tmp_path / "ids")
    docs = files_of(spark, path, ROWS, shard_bytes, bucket_keys)
    got = tokenfiles.fetch(spark, tokenfiles.lookup(spark, docs, path), path).collect()
    check(ROWS, got)
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(i), ids_of(t)) for i, t in ROWS)
    shards = tokenfiles.shard_table(spark, path).orderBy("shard").collect()
    assert (len(shards) > 1) == (shard_bytes < 1000) and sum(s.docs for s in shards) == len(ROWS)


def test_raw_payload_stands_in_front(spark, tmp_path):
    path = str(tmp_path / "ids")
    files_of(spark, path, ROWS[:2])
    (file,) = (tmp_path / "ids" / "shards").glob("*.txt")
    want = np.array(ids_of("") + ids_of(ROWS[0][1]), "<u2").tobytes()
    assert file.read_bytes().startswith(want)


def test_unknown_keys_and_one_key(spark, tmp_path):
    path = str(tmp_path / "ids")
    files_of(spark, path, ROWS)
    keys = spark.createDataFrame([(7,), (1000,), (7,), (None,)], "doc_id long")
    got = tokenfiles.fetch(spark, tokenfiles.lookup(spark, keys, path), path).collect()
    assert sorted((repr(r.doc_id), r.ids) for r in got) == sorted((repr(i), ids_of(t)) for i, t in ROWS if i in (7, None))


def test_an_id_over_many_shards(spark, tmp_path):
    path = str(tmp_path / "ids")
    rows = [(1, f"first {i}") for i in range(30)] + [(2, "same text")] * 60 + [(None, f"n {i}") for i in range(40)] + [(3, "end")]
    docs = files_of(spark, path, rows, shard_bytes=500, bucket_keys=1)
    assert tokenfiles.shard_table(spark, path).count() > 6
    check(rows, tokenfiles.fetch(spark, tokenfiles.lookup(spark, docs, path), path, with_ids=False).collect())


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = files_of(spark, path, [])
    assert tokenfiles.fetch(spark, tokenfiles.lookup(spark, docs, path), path).collect() == []


def test_string_keys(spark, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.createDataFrame([("b", "x y"), ("a", "z")], "doc_id string, text string")
    tokenfiles.write_shards(docs, path)
    tokenfiles.write_index(spark, path)
    got = tokenfiles.fetch(spark, tokenfiles.lookup(spark, docs, path), path).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in got) == [("a", 0, ids_of("z")), ("b", len(ids_of("z")), ids_of("x y"))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85'sdtlm#aAÉßΣİ̸́  <|>"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_pieces_encode_as_the_whole(texts):
    encoder = tokenfiles.Encoder(tokenfiles.VOCABULARY)
    got = [np.frombuffer(i, encoder.kind).tolist() for i in encoder([t.encode() for t in texts])]
    assert got == [ids_of(t)[:-1] for t in texts]


def test_held_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenfiles, "HELD_BYTES", 400)
    encoder = tokenfiles.Encoder(tokenfiles.VOCABULARY)
    for i in range(20):
        text = f"w{i} v{i} again"
        assert np.frombuffer(encoder([text.encode()])[0], encoder.kind).tolist() == ids_of(text)[:-1]
        assert encoder.held < 2400


def test_words_apart_from_marks(spark):
    words = ["Don't", "'tis", "(x)", "«x»", "x,", "x.'s", "'s", "''s", "<|endoftext|>", "<|ENDOFTEXT|>", "|x|>", "É,", "e\u0301,", "(ÀÉ)", "ªx", "ÿ!", "İ.", "\u0958,",
             "<\u0338x", "a<\u0338", "x1,", "µm.", "H\u0331", "ﬁn.", "'", "--", "x'", "x'll", "ßA", "ſ,", "K"]
    texts = [*words, " ".join(words), *[a + b for a in words for b in words]]
    encoder = tokenfiles.Encoder(tokenfiles.VOCABULARY)
    for text, ids in zip(texts, encoder([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, encoder.kind).tolist() == ids_of(text)[:-1], text
