import numpy as np
import pytest

from tracewarden.llm import decontaminate as d


def distance(pattern, text):
    """Least edits to fit the pattern anywhere into the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, start=1):
        new = [i]
        for j, t in enumerate(text, start=1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


ITEM = "What is the boiling point of water at sea level, and how does it change with altitude in the mountains?"
LONG = " ".join(f"sentence number {i} speaks about topic {i * i % 97}" for i in range(12))


def scan(text, items=((1, ITEM), (2, LONG)), **options):
    units = [u for i, t in items for u in d.units_of(i, t, options.get("error_rate", 0.1), 200)]
    indexes = [d.Index(q, [u for u in units if u.q == q]) for q in {u.q for u in units}]
    return d._scan([text], indexes)


def test_banded_alignment_is_the_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        pattern = rng.integers(1, 4, 30).astype(np.uint32)
        text = rng.integers(1, 4, 50).astype(np.uint32)
        cost, end = d.align(pattern, text[None])
        assert cost[0] >= distance(list(pattern), list(text))
        band = len(text) - len(pattern)
        if cost[0] <= 3:
            assert end[0] <= len(text) and band == 20
    exact = np.concatenate([text[:7], pattern, text[:13]]).astype(np.uint32)
    cost, end = d.align(pattern, exact[None])
    assert (cost[0], end[0]) == (0, 37)


@pytest.mark.parametrize("seed", range(6))
def test_edited_passages_are_found_as_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    for edits in (0, 3, 8, 10, 11, 14, 25):
        passage = list(ITEM.lower())
        for _ in range(edits):
            at, kind = rng.integers(len(passage)), rng.integers(3)
            if kind == 0:
                passage[at] = "#"
            elif kind == 1:
                del passage[at]
            else:
                passage.insert(at, "#")
        text = "before it stands this. " + "".join(passage) + " and after it that."
        least = distance(ITEM.lower(), text)
        hits = [h for h in scan(text) if h[1] == 1]
        assert bool(hits) == (least <= int(0.1 * len(ITEM)))
        if hits:
            assert min(h[5] for h in hits) == least


def test_places_case_and_white_space():
    text = "Intro. " + ITEM.upper().replace(" ", " \n ") + " Outro."
    (hit,) = scan(text)
    assert hit[5] == 0 and text[hit[3] : hit[4]].split() == ITEM.upper().split()


def test_a_part_of_a_long_item_is_found():
    assert {h[1] for h in scan("something else " + LONG[100:420] + " and so on")} == {2}
    assert not scan("something else " + LONG[100:220] + " and so on")


def test_clean_and_very_long_texts(monkeypatch):
    monkeypatch.setattr(d, "CHARS_AT_ONCE", 1000)
    filler = "plain words without any relation to the questions asked elsewhere. " * 400
    assert scan(filler) == []
    hits = scan(filler + ITEM + filler)
    assert len(hits) == 1 and hits[0][3] == len(filler)


def test_documents(spark):
    rows = [(1, "a " + ITEM), (2, None), (3, ""), (4, "clean text"), (None, ITEM), (1, "a " + ITEM), (6, ITEM[:50] + ITEM[52:])]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "a", "x")], "item_id int, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in d.contaminated(docs, items).collect()}
    assert got == {(1, 1): 0, (None, 1): 0, (6, 1): 2}
    assert d.contaminated(docs.limit(0), items).count() == 0
    assert d.contaminated(docs, items.limit(0)).count() == 0
    sliced = d.contaminated(docs, items, slice_chars=60)
    assert {(r["doc_id"], r["item_id"]) for r in sliced.collect()} == set(got)


def test_parts_of_items_and_short_items(spark):
    middle = " ".join(f"clause {i} of the medium item treats matter {i * 7 % 31}" for i in range(4))[:180]
    texts = ["x " + LONG[100:220] + " y", "x " + LONG[50:169] + " y", "x " + middle[30:150] + " y", "x " + LONG[100:150] + " y"]
    texts += ["is it red-brown fox? ", "is it red-brown foxes", " Yes\n", "yes and no"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, LONG), (2, middle), (3, "Red-brown fox"), (4, "yes")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 2), (4, 3), (6, 4)}


def units(items):
    return [u for i, t in items for u in d.all_units(i, t, 0.1, 200, 84, 36, 20, 8)]


def found(text, of_items):
    return d._scan([text], [d.Index(q, [u for u in of_items if u.q == q]) for q in sorted({u.q for u in of_items})])


def test_every_part_of_119_characters_is_found():
    of_items = units([(1, ITEM), (2, LONG)])
    for start in range(0, len(LONG) - 119, 7):
        assert 2 in {h[1] for h in found("before it " + LONG[start : start + 119] + " after it", of_items)}, start


@pytest.mark.parametrize("seed", range(4))
def test_parts_are_found_as_by_brute_force(seed):
    """Verbatim, edited and foreign stretches: a unit is reported if and only if it fits somewhere with its edits."""
    rng = np.random.default_rng(seed)
    of_items = units([(1, ITEM), (2, LONG)])
    text = "an introduction without any relation, "
    for edits in (0, 4, 9, 25):
        start = int(rng.integers(0, len(LONG) - 150))
        piece = list(LONG[start : start + 150])
        for _ in range(edits):
            piece[int(rng.integers(len(piece)))] = "#"
        text += "".join(piece) + " and then something else, "
    plain = "".join(map(chr, d.normal(text)[0]))
    want = {(u.item, u.offset, len(u.codes)) for u in of_items if distance([chr(c) for c in u.codes], plain) <= u.edits}
    matches = []
    codes = np.concatenate([np.zeros(300, np.uint32), d.normal(text)[0], np.zeros(300, np.uint32)])
    for q in sorted({u.q for u in of_items}):
        matches += d._matches(d.Index(q, [u for u in of_items if u.q == q]), codes)
    assert {(u.item, u.offset, len(u.codes)) for u, *_ in matches} == want and want
    for unit, start, stop, edits in matches:
        stretch = "".join(map(chr, codes[start:stop]))
        assert distance([chr(c) for c in unit.codes], stretch) <= edits <= unit.edits
