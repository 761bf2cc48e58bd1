"""Fill-in-the-middle documents over seekable compressed frames.

A text is stored as a row of independent zstandard frames of at most ``frame_chars`` characters, with the number of line
ends and of characters before each frame. A cut after k lines is found by bisecting the counts; only the frame it lies in
is decompressed, every other frame goes to the output as it is. An output is again a row of frames, in which each marker
is a frame of its own, so that its segments can be put back in order without decompressing them, and digests stream over
frames one at a time. All steps are maps over documents: nothing is shuffled.

Edge cases: a null text is empty, and an empty text is plain; texts that hold a marker themselves are plain; a null id
draws its cuts as an id without digits; rows that repeat, also under one id, are transformed each for itself; a
text of any length is held in memory once, compressed from then on; an empty table gives an empty result; columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewarden.llm.common import narrow
from tracewarden.session import in_portions

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The order in which a form writes the segments.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
FRAME_CHARS = 1 << 16
#: Compressed bytes of documents that one Arrow batch may hold.
BATCH_BYTES = 8 << 20


def _map(rows: DataFrame, step, schema: str, size_of) -> DataFrame:
    """Apply a generator over rows (as dictionaries) of each task; what it yields leaves in batches of bounded bytes."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results() -> Iterator[dict]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    yield from step(batch.slice(start, 64).to_pylist())

        for part in in_portions(results(), size_of, BATCH_BYTES):
            yield pa.RecordBatch.from_pylist(part, schema=arrow)

    return rows.mapInArrow(run, schema)


def _held(row: dict) -> int:
    return 100 + sum(map(len, row["frames"]))


def _id_type(rows: DataFrame) -> str:
    return rows.schema["doc_id"].dataType.simpleString()


def frame_up(text: str, frame_chars: int, pack: zstandard.ZstdCompressor) -> dict:
    """Frames of a text and, for each, the line ends and characters before it."""
    frames, line_ends, chars, ends = [], [], [], 0
    for start in range(0, len(text), frame_chars):
        piece = text[start:start + frame_chars]
        frames.append(pack.compress(piece.encode()))
        line_ends.append(ends)
        chars.append(start)
        ends += piece.count("\n")
    whole = ends + (1 if text and not text.endswith("\n") else 0)
    return {"n": whole, "n_chars": len(text), "frames": frames, "line_ends": line_ends, "chars": chars}


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_chars: int = FRAME_CHARS, level: int = 3) -> DataFrame:
    """(doc_id, n, n_chars, marked, frames, line_ends, chars) per document; ``n`` counts its lines."""
    rows = narrow(docs, doc_id=id_col, text=text_col)

    def step(rows: list[dict]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=level)
        for row in rows:
            text = row["text"] or ""
            marked = PREFIX in text or SUFFIX in text or MIDDLE in text
            yield {"doc_id": row["doc_id"], "marked": marked, **frame_up(text, frame_chars, pack)}

    schema = f"doc_id {_id_type(rows)}, n long, n_chars long, marked boolean, frames array<binary>, line_ends array<long>, chars array<long>"
    return _map(rows, step, schema, _held)


def draw(seed: int, fim_percent: int, spm_percent: int) -> list[Column]:
    """Columns low, high (lines before the cuts) and form, drawn from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    one, other = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    plain = (F.col("n_chars") == 0) | F.col("marked") | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    return [F.least(one, other).alias("low"), F.greatest(one, other).alias("high"), form.alias("form")]


class Frames:
    """A stored document whose frames are decompressed one at a time."""

    def __init__(self, row: dict, unpack: zstandard.ZstdDecompressor):
        self.row, self.unpack = row, unpack

    def cut(self, lines: int) -> tuple[int, int, int]:
        """(frame, characters into it, characters before) of the cut after so many lines."""
        row = self.row
        if lines == 0:
            return 0, 0, 0
        if lines == row["n"]:
            return len(row["frames"]), 0, row["n_chars"]
        frame = bisect_left(row["line_ends"], lines) - 1
        text, at = self.text(frame), 0
        for _ in range(lines - row["line_ends"][frame]):
            at = text.index("\n", at) + 1
        return frame, at, row["chars"][frame] + at

    def text(self, frame: int) -> str:
        return self.unpack.decompress(self.row["frames"][frame]).decode()

    def between(self, start: tuple[int, int, int], stop: tuple[int, int, int], pack: zstandard.ZstdCompressor) -> Iterator[bytes]:
        """The frames between two cuts; only frames that hold a cut are written anew."""
        (first, skip, _), (last, take, _) = start, stop
        for frame in range(first, last + (take > 0)):
            a, b = skip if frame == first else 0, take if frame == last else None
            if (a, b) == (0, None):
                yield self.row["frames"][frame]
            elif piece := self.text(frame)[a:b]:
                yield pack.compress(piece.encode())


def fill_in_middle(stored: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, level: int = 3) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): the transformed documents, as frames.

    The cuts lie after ``low`` and ``high`` lines. A frame that is moved whole is not decompressed.
    """

    def step(rows: list[dict]) -> Iterator[dict]:
        pack, unpack = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
        for row in rows:
            out = {"doc_id": row["doc_id"], "n": row["n"], "form": row["form"], "prefix_chars": None, "middle_chars": None, "frames": row["frames"]}
            if row["form"] in ORDERS:
                whole = Frames(row, unpack)
                begin, low, high, end = [whole.cut(k) for k in (0, row["low"], row["high"], row["n"])]
                segments = {PREFIX: (begin, low), MIDDLE: (low, high), SUFFIX: (high, end)}
                frames = []
                for marker in ORDERS[row["form"]]:
                    frames.append(pack.compress(marker.encode()))
                    frames.extend(whole.between(*segments[marker], pack))
                out.update(prefix_chars=low[2], middle_chars=high[2] - low[2], frames=frames)
            yield out

    schema = f"doc_id {_id_type(stored)}, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"
    return _map(stored.select("*", *draw(seed, fim_percent, spm_percent)), step, schema, _held)


def restored_frames(frames: list[bytes], form: str, unpack: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The frames of the text from which an output was made, in the text's order; no text holds a marker."""
    if form not in ORDERS:
        yield from frames
        return
    segments: dict[str, list[bytes]] = {}
    for frame in frames:
        short = zstandard.get_frame_parameters(frame).content_size == len(PREFIX)
        content = unpack.decompress(frame).decode() if short else ""
        if content in ORDERS[form]:
            current = segments.setdefault(content, [])
        else:
            current.append(frame)
    if tuple(segments) != ORDERS[form]:
        raise ValueError(f"markers {tuple(segments)} in an output of form {form}")
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from segments[marker]


def texts_of(outputs: DataFrame, restored: bool = False) -> DataFrame:
    """(doc_id, form, text): the outputs as texts, or the texts they were made from."""

    def step(rows: list[dict]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor()
        for row in rows:
            frames = restored_frames(row["frames"], row["form"], unpack) if restored else row["frames"]
            yield {"doc_id": row["doc_id"], "form": row["form"], "text": b"".join(map(unpack.decompress, frames)).decode()}

    return _map(outputs, step, f"doc_id {_id_type(outputs)}, form string, text string", lambda r: 100 + len(r["text"]))


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs without their frames, with the SHA-256 of each output and of the text rebuilt from it."""

    def streamed(frames: Iterator[bytes], unpack: zstandard.ZstdDecompressor) -> str:
        digest = hashlib.sha256()
        for frame in frames:
            digest.update(unpack.decompress(frame))
        return digest.hexdigest()

    def step(rows: list[dict]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor()
        for row in rows:
            frames = row.pop("frames")
            row["output_sha256"] = streamed(iter(frames), unpack)
            row["restored_sha256"] = streamed(restored_frames(frames, row["form"], unpack), unpack)
            yield row

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in outputs.schema if f.name != "frames")
    return _map(outputs, step, f"{kept}, output_sha256 string, restored_sha256 string", lambda r: 400)
