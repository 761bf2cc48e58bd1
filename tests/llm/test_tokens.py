import random

import pytest

from tracewarden.llm import tokens

PIECES = ["Hello", " world", "  ", "\n", " x", "'re", "'", "don't", " 123", "é", "日本", " \t ", "!!", " a b", "\x1c", "...", " The", "  end", "\n\n ", "ll", "😀"]


@pytest.fixture(scope="module")
def count():
    return tokens.counter(tokens.VOCABULARY)


def text_of(rng, n):
    return "".join(rng.choice(PIECES) for _ in range(n))


@pytest.mark.parametrize("seed", range(40))
def test_leaves_add_up_and_edits_agree_with_encoding_again(count, seed):
    rng = random.Random(seed)
    text = text_of(rng, rng.choice([0, 1, 5, 60, 400]))
    tree = tokens.plant(text, count, 20)
    assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))
    for _ in range(4):  # revision after revision
        script, want, shift, at = [], text, 0, 0
        for start in sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randint(0, 6)))):
            if start < at:
                continue
            stop = min(len(text), start + rng.choice([0, 0, 1, 2, 7, 60]))
            new = text_of(rng, rng.choice([0, 1, 2, 30]))
            script.append((start, stop, new))
            want = want[: start + shift] + new + want[stop + shift :]
            shift += len(new) - (stop - start)
            at = max(stop, start + 1)
        rng.shuffle(script)
        text, tree, encoded, _ = tokens.revise(text, tree, script, count, 20)
        assert text == want
        assert (tree.chars[1], tree.tokens[1]) == (len(text), count(text))
        for node in range(1, tree.leaves):
            assert tree.tokens[node] == tree.tokens[2 * node] + tree.tokens[2 * node + 1]


def test_only_touched_leaves_are_encoded(count):
    text = " ".join(f"word{i}" for i in range(5000))
    tree = tokens.plant(text, count, 256)
    new, tree, encoded, leaves = tokens.revise(text, tree, [(20_000, 20_004, "xy")], count, 256)
    assert encoded < 1200 and leaves <= 3 and tree.tokens[1] == count(new)


def test_documents(spark, count):
    rows = [(1, "one two three " * 200), (2, None), (3, ""), (4, "abc"), (4, "other text of the same id"), (None, "no id"), (1, "one two three " * 200), (5, "x" * 5000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    script = [(1, 3, 5, "ZZ"), (1, 100, 90, "back"), (1, 10**9, 10**9, " end"), (1, 4, 9, "overlap"), (3, 0, 0, "new text"), (4, 0, 2, None), (4, None, 1, "no"), (9, 0, 1, "unknown"), (None, 0, 2, "N"), (2, 0, 0, "first")]
    edits = spark.createDataFrame([(*e, "x") for e in script], "doc_id long, start int, stop int, replacement string, text string")
    trees = tokens.build_trees(docs)
    got = tokens.apply_edits(docs, trees, edits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["tokens_after"] == count(r["text"]) and r["n_chars"][1] == len(r["text"])
    first = ("one two three " * 200)
    want = first[:3] + "ZZ" + "overlap" + first[9:100] + "back" + first[100:] + " end"
    assert [r["text"] for r in got if r["doc_id"] == 1] == [want, want]
    assert {r["text"] for r in got if r["doc_id"] == 4} == {"c", "her text of the same id"}
    assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (2, 3, None)} == {2: "first", 3: "new text", None: "N id"}
    assert tokens.apply_edits(docs.limit(0), trees, edits).count() == 0
    untouched = tokens.apply_edits(docs, trees, edits.limit(0)).collect()
    assert all(r["chars_encoded"] == 0 and r["tokens_before"] == r["tokens_after"] for r in untouched)
