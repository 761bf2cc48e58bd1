import random

import pytest

from tracewarden.llm import langid

ALPHABETS = {"en": ["the", "and", "ing", "tion", "was", "with"], "de": ["der", "und", "ung", "sch", "nicht", "für"], "fr": ["les", "eau", "ment", "est", "ça", "où"]}


def corpus(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        words = ["".join(rng.choices(ALPHABETS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        out.append((i, " ".join(words), lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus(600) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !?", None), (1003, "Der und nicht", None), (5, "the and the", "en"), (None, "les eaux", "fr")]
    return spark.createDataFrame([(i, t, g, "x") for i, t, g in rows], "doc_id long, text string, lang string, lang_pred string").cache()


def test_held_out_accuracy(spark, docs):
    parts = langid.held_out(docs)
    model = langid.fit(parts.filter("not held_out"))
    assert set(model.langs) == set(ALPHABETS) and len(model.langs) > 3
    truth = {r["doc_id"]: r["lang"] for r in parts.filter("held_out and lang is not null").collect()}
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, lang in truth.items() if i < 1000]
    assert len(right) > 100 and sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(r["rejected"] for i, r in got.items() if i is not None and i < 1000) == 0
    for i in (1000, 1001, 1002):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert got[1003]["lang_pred"] == "de"


def test_remote_texts_are_rejected(spark, docs):
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "Ελληνικά κείμενα εδώ " * 9), (2, "qqqq zzzz xxxx " * 30)], "doc_id long, text string")
    assert all(r["rejected"] for r in langid.identify(odd, model).collect())


def test_pieces_of_long_texts_count_once(monkeypatch):
    text = "Der Wald, die 12 Bäume. " * 40
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 7)
    assert (langid.features(text) == whole).all()
    assert langid.features("") is None and langid.features("…12") is None


def test_nothing_to_learn_from(spark, docs):
    model = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_rows_of_one_id_do_not_exceed_the_sample(spark, monkeypatch):
    clustered = []
    grouped = type(spark.range(1).groupBy("id"))
    original = grouped.applyInPandas
    monkeypatch.setattr(grouped, "applyInPandas", lambda self, *a: (clustered.append(self._df.count()), original(self, *a))[1])
    rows = [(None if i % 2 else 7, f"word{chr(97 + i % 26)} {'abcdefghij'[i // 26 % 10] * 3} text", "en") for i in range(260)] + [(1, "equal rows", "de")] * 300
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=20)
    assert clustered == [21] and set(model.langs) == {"en", "de"}
