import hashlib
import re

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewarden.llm import fim

LONG = "".join(f"line {i} ünï\n" * (i % 3 + 1) for i in range(60)) + "last 𝄞 without end"
TEXTS = [
    (1, LONG), (2, "a\nb\nc"), (3, "\n\n\n"), (4, ""), (5, None), (6, "one line only"), (7, "x <S> y\nz"), (8, "<P"), (9, "S>\n<\nP>"),
    (10, "w" * 500), (10, "a\nb\nc"), (10, "a\nb\nc"), (None, "n\nm\n"), (11, "\r\n \n\x0b\n"), (12, LONG * 3),
]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text, text
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), out, text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def stored(spark, frame_chars, rows=TEXTS):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, frames string, n int")
    return fim.store_frames(docs, frame_chars=frame_chars)


def test_against_brute_force(spark):
    want = sorted((brute(*r) for r in TEXTS), key=repr)
    for frame_chars in (1, 7, 64, 1 << 16):
        outputs = fim.fill_in_middle(stored(spark, frame_chars))
        got = fim.digests(outputs).collect()
        rows = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got]
        assert sorted(rows, key=repr) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=repr)
    assert sorted(((r.doc_id, r.text) for r in fim.texts_of(outputs).collect()), key=repr) == sorted(((w[0], w[5]) for w in want), key=repr)
    assert sorted(((r.doc_id, r.text) for r in fim.texts_of(outputs, restored=True).collect()), key=repr) == sorted(((w[0], w[6]) for w in want), key=repr)


def test_frames_are_independent_and_counted(spark):
    row = next(r for r in stored(spark, 100).collect() if r.doc_id == 12)
    parts = [zstandard.ZstdDecompressor().decompress(f).decode() for f in row.frames]
    assert "".join(parts) == LONG * 3 and max(map(len, parts)) == 100
    assert row.line_ends == [sum(p.count("\n") for p in parts[:i]) for i in range(len(parts))]
    assert row.chars == [100 * i for i in range(len(parts))]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab\né<>PSM")), st.integers(1, 5), st.data())
def test_only_cut_frames_are_decompressed(text, frame_chars, data):
    class Counting:
        def __init__(self):
            self.used, self.real = 0, zstandard.ZstdDecompressor()

        def decompress(self, frame):
            self.used += 1
            return self.real.decompress(frame)

    pack, unpack = zstandard.ZstdCompressor(), Counting()
    row = fim.frame_up(text, frame_chars, pack)
    whole = fim.Frames(row, unpack)
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    assert row["n"] == len(units)
    low, high = sorted((data.draw(st.integers(0, row["n"])), data.draw(st.integers(0, row["n"]))))
    frames = list(whole.between(whole.cut(low), whole.cut(high), pack))
    assert unpack.used <= 4
    assert b"".join(map(zstandard.ZstdDecompressor().decompress, frames)).decode() == "".join(units[low:high])


def test_shares_of_forms_and_empty_table(spark):
    assert fim.digests(fim.fill_in_middle(stored(spark, 9, []))).collect() == []
    docs = stored(spark, 9, [(i, "a\nb") for i in range(400)])
    assert {r.form for r in fim.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(docs, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(docs, fim_percent=40).collect()} == {"plain", "psm", "spm"}


def test_nothing_is_shuffled(spark):
    plan = fim.digests(fim.fill_in_middle(stored(spark, 9)))._jdf.queryExecution().toString()
    assert "Exchange" not in plan
