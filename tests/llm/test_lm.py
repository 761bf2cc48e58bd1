import math
from collections import Counter

import pytest

from tracewarden.llm import lm


def words(text):
    return (text or "").encode().lower().split()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def brute(rows, alpha=0.4):
    docs = [words(t) for _, t in rows]
    total = [sum((grams(d, n) for d in docs), Counter()) for n in (1, 2, 3)]
    n_words = sum(map(len, docs))
    out = []
    for (doc_id, _), own in zip(rows, docs):
        count = [t - grams(own, n + 1) for n, t in enumerate(total)]
        others, score, hits = n_words - len(own), 0.0, 0
        for i in range(len(own)):
            factor, found = 1.0, None
            for n in (3, 2):
                if i >= n - 1:
                    gram = tuple(own[i - n + 1 : i + 1])
                    if count[n - 1][gram] > 0:
                        found = factor * count[n - 1][gram] / count[n - 2][gram[:-1]]
                        hits += n == 3
                        break
                    factor *= alpha
            if found is None:
                c = count[0][(own[i],)]
                found = factor * (c / others if c > 0 else alpha / max(others, 1))
            score += math.log10(found)
        out.append((doc_id, len(own), score, hits))
    return out


ROWS = [(i, " ".join(f"w{(i * j * 7 + j) % 23}" for j in range(i % 40))) for i in range(150)]
ROWS += [(200, None), (201, "  "), (202, "Ünï w1 W1 w1 w1 w1"), (203, "never seen anywhere"), (None, "w1 w2"), (7, ROWS[7][1])]


@pytest.mark.parametrize(("batch_chars", "partition_grams"), [(16_000_000, 2_000_000), (300, 100)])
def test_against_brute_force(spark, batch_chars, partition_grams):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, batch int")
    got = lm.score_documents(docs, batch_chars=batch_chars, partition_grams=partition_grams).collect()
    key = lambda r: (repr(r[0]), r[1], round(r[2], 6))
    got, want = sorted(got, key=key), sorted(brute(ROWS), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g["doc_id"], g["n_words"], g["trigram_hits"]) == (w[0], w[1], w[3])
        assert g["log_score"] == pytest.approx(w[2], abs=1e-9)
        assert (g["mean_log_score"] is None) == (w[1] == 0)


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")
    assert lm.score_documents(one).first()["log_score"] == pytest.approx(brute([(1, "a b a b")])[0][2])
    assert lm.score_documents(one.limit(0)).count() == 0
