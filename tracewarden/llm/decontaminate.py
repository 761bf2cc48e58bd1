"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A passage of m characters that occurs with at most k edits keeps at least m + 1 - q (k + 1) of its q-grams, all
within k diagonals of each other (diagonal: position in the text minus position in the passage). Documents are
scanned once against an index of the benchmark's q-grams; hits are counted in overlapping diagonal bands, wide
enough that every such occurrence lies whole in one; bands that reach the lemma's count are aligned within the
band, and kept if the passage fits with at most k edits. Nothing is shuffled.

Letters of ASCII and Latin-1 are lower-cased and runs of white space count as one space. An item is searched whole, or
in overlapping windows of ``window`` characters if it is longer, and besides in windows of ``part`` characters that begin
every ``stride``: any ``part + stride - 1`` characters of an item hold one of them. k is ``error_rate`` of the passage.

The benchmark is read in slices of at most ``slice_chars`` characters, each broadcast with its index and scanned
in turn, so its size is bounded whatever it holds.

Edge cases: null or empty texts and items have no matches; items of fewer than ``min_chars`` characters match without
edits and between other characters than letters and digits, and items of fewer than ``least_chars`` ("yes", "42") match
only a document that holds nothing else; repeated items and documents are matched each; an
empty benchmark gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewarden.llm.common import narrow

GRAMS = (12, 8, 5, 3, 2, 1)
CHARS_AT_ONCE = 1 << 20
ALIGNED_AT_ONCE = 2048


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points after normalisation, and where each comes from."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    capital = ((codes >= 65) & (codes <= 90)) | ((codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7))
    codes = np.where(capital, codes + 32, codes).astype(np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[space] = 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    where = np.flatnonzero(keep)
    return codes[where], where


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram."""
    out = np.zeros(max(len(codes) - q + 1, 0), np.uint64)
    for i in range(q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


@dataclass
class Unit:
    """A passage to look for: a whole item or a window of one."""

    item: object
    offset: int
    codes: np.ndarray
    edits: int
    q: int
    least: int
    apart: bool = False  # letters and digits around it are no match
    alone: bool = False  # nothing else may be in the text


@dataclass
class Index:
    """The units of one q, their q-grams sorted by hash, and a filter on the hash's top bits, 16 or more for each q-gram."""

    q: int
    units: list[Unit]
    hashes: np.ndarray = field(init=False)
    unit: np.ndarray = field(init=False)
    at: np.ndarray = field(init=False)
    maybe: np.ndarray = field(init=False)
    bits: int = field(init=False)
    size: np.ndarray = field(init=False)
    edits: np.ndarray = field(init=False)
    least: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        grams = [rolling(u.codes, self.q) for u in self.units]
        hashes = np.concatenate(grams)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.unit = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.bits = max(20, (16 * len(hashes)).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[_top(self.hashes, self.bits)] = True
        self.size = np.array([len(u.codes) for u in self.units])
        self.edits = np.array([u.edits for u in self.units])
        self.least = np.array([u.least for u in self.units])


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def units_of(item: object, text: str | None, error_rate: float, window: int, min_chars: int = 1) -> list[Unit]:
    codes, _ = normal((text or "").strip())
    if len(codes) < min_chars:
        return []
    starts = [0] if len(codes) <= window else [*range(0, len(codes) - window, window // 2), len(codes) - window]
    out = []
    for start in starts if len(codes) else []:
        part = codes[start : start + window]
        edits = int(error_rate * len(part))
        q = next(q for q in GRAMS if len(part) + 1 - q * (edits + 1) >= max(1, len(part) // 8))
        out.append(Unit(item, start, part, edits, q, len(part) + 1 - q * (edits + 1)))
    return out


def all_units(item: object, text: str | None, error_rate: float, window: int, part: int, stride: int, min_chars: int, least_chars: int) -> list[Unit]:
    """The units of a whole item and of its parts."""
    codes, _ = normal((text or "").strip())
    if len(codes) < min_chars:
        units = units_of(item, text, 0.0, window)
        for unit in units:
            unit.apart, unit.alone = True, len(codes) < least_chars
        return units
    units = units_of(item, text, error_rate, window)
    if len(codes) > part:
        edits = int(error_rate * part)
        q = next(q for q in GRAMS if part + 1 - q * (edits + 1) >= max(1, part // 8))
        for start in [*range(0, len(codes) - part, stride), len(codes) - part]:
            units.append(Unit(item, start, codes[start : start + part], edits, q, part + 1 - q * (edits + 1)))
    return units


def _stands(unit: Unit, codes: np.ndarray, start: int, stop: int) -> bool:
    """Whether what surrounds a match of a short item allows it. Texts are joined by zeros."""
    if unit.alone:
        before, after = codes[:start][::-1], codes[stop:]
        rest = [side[side != 32][:1] for side in (before[:64], after[:64])]
        return all(not len(x) or x[0] == 0 for x in rest)
    return not any(chr(codes[i]).isalnum() for i in (start - 1, stop) if 0 <= i < len(codes))


def align(pattern: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits to fit a whole pattern into each text of equal width, and where the fit ends.

    Only cells within the band are computed: row i of the table covers the text positions i to i + band.
    ``texts`` (count x (length of the pattern + band)) are padded with zeros; ``pattern`` is one for all or one for each.
    """
    patterns = np.atleast_2d(pattern)
    size = patterns.shape[1]
    count, band = len(texts), texts.shape[1] - size
    kind = np.int16 if texts.shape[1] + size < 1 << 14 else np.int32
    slope = np.arange(band + 1, dtype=kind)
    row = np.zeros((count, band + 1), kind)
    for i in range(size):
        step = row + (texts[:, i : i + band + 1] != patterns[:, i : i + 1])
        np.minimum(step[:, :-1], row[:, 1:] + kind(1), out=step[:, :-1])  # a character of the pattern is missing
        step -= slope
        row = np.minimum.accumulate(step, axis=1, out=step)  # a character of the text is extra
        row += slope
    best = row.argmin(axis=1)
    return row[np.arange(count), best].astype(np.int64), best + size


def _cut(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The codes at the places, zero outside of the text."""
    return np.where((at >= 0) & (at < len(codes)), codes[np.clip(at, 0, len(codes) - 1)], 0)


def _pieces(texts: list[str | None], overlap: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(text number, -, normalised code points, origins); very long texts in overlapping pieces."""
    for number, text in enumerate(texts):
        if text:
            codes, where = normal(text)
            for start in range(0, max(len(codes) - overlap, 1), CHARS_AT_ONCE):
                end = start + CHARS_AT_ONCE + overlap
                yield number, start, codes[start:end], where[start:end]


def _blocks(pieces: Iterator[tuple], gap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]]:
    """Pieces joined by gaps of zeros into arrays of bounded length, with (start, text number, origins) of each."""
    parts: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    size = gap
    for number, _, codes, where in pieces:
        parts += [np.zeros(gap, np.uint32), codes]
        marks.append((size, number, where))
        size += len(codes) + gap
        if size > CHARS_AT_ONCE:
            yield np.concatenate([*parts, np.zeros(gap, np.uint32)]), marks
            parts, marks, size = [], [], gap
    if marks:
        yield np.concatenate([*parts, np.zeros(gap, np.uint32)]), marks


def _candidates(index: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit and first diagonal of each band that holds enough of the unit's q-grams, and the least diagonal within reach of the
    band's alignment on which the unit stands without edits, or -1."""
    hashes = rolling(codes, index.q)
    places = np.flatnonzero(index.maybe[_top(hashes, index.bits)])
    low = np.searchsorted(index.hashes, hashes[places], "left")
    many = np.searchsorted(index.hashes, hashes[places], "right") - low
    places, low, many = places[many > 0], low[many > 0], many[many > 0]
    if not len(places):
        return (np.zeros(0, np.int64),) * 3
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    unit, diagonal = index.unit[entry], np.repeat(places, many) - index.at[entry]
    band = diagonal // (index.edits[unit] + 1)
    reach = len(codes) + 2
    key = unit * reach + band + 1  # bands of two steps: each hit lies in the one that begins here and in the one before
    found, counts = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    found = found[counts >= index.least[found // reach]]
    of, first = found // reach, (found % reach - 1) * (index.edits[found // reach] + 1)
    # where all q-grams of a unit lie on one diagonal it stands there as it is, codes compared
    wanted = np.isin(unit, of) & (diagonal >= 0)
    same, counts = np.unique(unit[wanted] * reach + diagonal[wanted], return_counts=True)
    same = same[counts == index.size[same // reach] - index.q + 1]
    stands = [np.array_equal(codes[k % reach : k % reach + index.size[k // reach]], index.units[k // reach].codes) for k in same]
    same = np.append(same[np.array(stands, bool)], np.iinfo(np.int64).max)
    start = of * reach + np.maximum(first - index.edits[of], 0)
    next_same = same[np.searchsorted(same, start)]
    last = of * reach + np.minimum(first + 3 * index.edits[of] + 2, reach - 1)
    return of, first, np.where(next_same <= last, next_same - of * reach, -1)


def _aligned(index: Index, codes: np.ndarray, of: np.ndarray, first: np.ndarray, width: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
    """Cost and length of the best fit of unit ``of`` into the ``width`` characters and its own length after, or before, ``first``."""
    cost, length = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    shapes, shape = np.unique(np.stack([index.size[of], width], axis=1), axis=0, return_inverse=True)
    for number, (size, band) in enumerate(shapes.tolist()):
        chosen = np.flatnonzero(shape.reshape(-1) == number)
        for begin in range(0, len(chosen), ALIGNED_AT_ONCE):
            part = chosen[begin : begin + ALIGNED_AT_ONCE]
            along = np.arange(size + band)
            patterns = np.stack([index.units[u].codes[::-1] if back else index.units[u].codes for u in of[part].tolist()])
            texts = _cut(codes, first[part, None] + (-along if back else along))
            cost[part], length[part] = align(patterns, texts)
    return cost, length


def _matches(index: Index, codes: np.ndarray) -> Iterator[tuple[Unit, int, int, int]]:
    """(unit, start, end, edits) of every fit; bands that hold the unit as it is need no alignment."""
    of, first, same = _candidates(index, codes)
    edits = index.edits[of]
    cost, end = np.zeros(len(of), np.int64), same + index.size[of]
    open_ = np.flatnonzero(same < 0)
    begin = (first - edits)[open_]
    cost[open_], length = _aligned(index, codes, of[open_], begin, (4 * edits + 2)[open_], False)
    end[open_] = begin + length
    fits = np.flatnonzero(cost <= edits)
    _, once = np.unique(np.stack([of[fits], end[fits]], axis=1), axis=0, return_index=True)
    fits = fits[np.sort(once)]
    # the same band alignment from the end backwards gives the start
    size = index.size[of[fits]]
    back = np.flatnonzero(same[fits] < 0)
    chosen = fits[back]
    _, length = _aligned(index, codes, of[chosen], end[chosen] + edits[chosen] - 1, 2 * edits[chosen], True)
    size[back] = length - edits[chosen]
    for u, length, stop, least in zip(of[fits].tolist(), size.tolist(), end[fits].tolist(), cost[fits].tolist(), strict=True):
        unit = index.units[u]
        if not unit.apart or _stands(unit, codes, stop - length, stop):
            yield unit, stop - length, stop, least


def _scan(texts: list[str | None], indexes: list[Index]) -> list[tuple]:
    """(text number, item, offset in the item, start, stop, edits) in characters of the text."""
    widest = max(len(u.codes) + 3 * (u.edits + 1) for i in indexes for u in i.units)
    found = {}
    for codes, marks in _blocks(_pieces(texts, widest), widest):
        starts = np.array([m[0] for m in marks])
        for index in indexes:
            for unit, start, stop, edits in _matches(index, codes):
                base, number, where = marks[np.searchsorted(starts, (start + stop) // 2, "right") - 1]
                a, b = max(start - base, 0), min(stop - base, len(where))
                if a < b:
                    place = (int(where[a]), int(where[b - 1]) + 1)
                    found[(number, unit.item, unit.offset, *place)] = edits
    return [(*k, v) for k, v in sorted(found.items(), key=lambda x: (x[0][0], repr(x[0][1]), x[0][2:]))]


def passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = 0.1,
    window: int = 200,
    part: int = 84,
    stride: int = 36,
    min_chars: int = 20,
    least_chars: int = 8,
    slice_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, item_offset, start, stop, edits): where documents hold a passage of the benchmark."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    items = narrow(benchmark, item_id=item_id_col, text=item_text_col).filter("text is not null")
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, "
        "item_offset long, start long, stop long, edits long"
    )
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-chars // slice_chars))
    found = None
    for number in range(slices):
        chosen = items if slices == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == number)
        one = _scan_slice(rows, chosen, schema, lambda i, t: all_units(i, t, error_rate, window, part, stride, min_chars, least_chars))
        found = one if found is None else found.unionByName(one)
    return found


def _scan_slice(rows: DataFrame, items: DataFrame, schema: str, units_in: Callable[[object, str], list[Unit]]) -> DataFrame:
    by_q: dict[int, list[Unit]] = {}
    for item in items.distinct().collect():
        for unit in units_in(item["item_id"], item["text"]):
            by_q.setdefault(unit.q, []).append(unit)
    units = rows.sparkSession.sparkContext.broadcast(by_q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index(q, of_q) for q, of_q in units.value.items()]
        for batch in batches if indexes else []:
            hits = _scan(batch.column(1).to_pylist(), indexes)
            numbers, *rest = zip(*hits, strict=True) if hits else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(numbers, pa.int64())), pa.array(rest[0], kind), *[pa.array(c, pa.int64()) for c in rest[1:]]],
                names=["doc_id", "item_id", "item_offset", "start", "stop", "edits"],
            )

    kind = to_arrow_type(items.schema["item_id"].dataType)
    return rows.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """(doc_id, item_id, start, stop, edits, passages): each document and item that meet, with the best fit."""
    best = F.min(F.struct("edits", "start", "stop")).alias("best")
    found = passages(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("passages"))
    return found.select("doc_id", "item_id", "best.start", "best.stop", "best.edits", "passages")
