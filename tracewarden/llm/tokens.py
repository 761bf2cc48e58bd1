"""Edit-aware token counts: a segment tree per document, of which edits re-encode only the leaves they touch.

A document's pre-tokens are kept in leaves of about ``leaf_chars`` characters; a binary tree in an array carries
characters and tokens of every subtree. Leaves are cut before a blank that is followed by a non-space. There
every text splits into pre-tokens, whatever stands to the left, so leaves are encoded by themselves and their counts
add up to the whole text's. A cut holds as long as an edit changes neither of its two characters nor comes between
them; an edit that does joins the leaf before to what is encoded again (the boundary context). The new pieces go
back into the slots of the leaves they replace and the sums on the way to the root change; only if
they would hold far more than the slots should is the tree laid out anew, from the counts it has.

The split rule is that of the byte-level vocabularies named in ``VOCABULARY`` (optional leading blank, then letters, digits
or others; white space but its last character). The vocabulary's path must exist on every worker.

Edits are (doc_id, start, stop, replacement) in characters of the text before, one revision at a time. Edge cases: a
null text counts as empty and has one empty leaf; positions beyond the text are cut to its end, a stop before its
start is the start; an edit that overlaps an earlier one begins where that one ended; edits of equal start and stop apply in
order of their replacement; null positions are ignored, a null replacement deletes; edits of unknown documents have no effect;
rows that repeat a doc_id each get that id's edits; a document without a tree of its own text gets one first; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewarden.llm.common import narrow
from tracewarden.session import in_portions

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how these vocabularies split text into pre-tokens.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r" (?=\S)")
TREE = "n_chars array<long>, n_tokens array<long>"
Count = Callable[[str], int]


@lru_cache(maxsize=2)
def counter(path: str) -> Count:
    """Number of tokens of a text; loaded once per worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def cut(text: str, leaf_chars: int) -> list[str]:
    """The text in pieces that end at the first safe cut after ``leaf_chars`` characters."""
    pieces, start = [], 0
    while len(text) - start > leaf_chars and (found := CUT.search(text, start + leaf_chars)):
        pieces.append(text[start : found.start()])
        start = found.start()
    return [*pieces, text[start:]]


class SegmentTree:
    """Sums of characters and tokens; node 1 is the root, 2i and 2i + 1 are below i, the leaves fill the second half."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens = list(chars), list(tokens)
        self.leaves = len(chars) // 2

    @classmethod
    def over(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        slots = 1 << max(len(chars) - 1, 0).bit_length()
        columns = []
        for values in (chars, tokens):
            sums = [0] * slots + list(values) + [0] * (slots - len(values))
            for node in range(slots - 1, 0, -1):
                sums[node] = sums[2 * node] + sums[2 * node + 1]
            columns.append(sums)
        return cls(*columns)

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and where that leaf starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.leaves
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def leaf(self, leaf: int) -> tuple[int, int]:
        return self.chars[leaf + self.leaves], self.tokens[leaf + self.leaves]


def plant(text: str | None, count: Count, leaf_chars: int) -> SegmentTree:
    pieces = cut(text or "", leaf_chars)
    return SegmentTree.over([len(p) for p in pieces], [count(p) for p in pieces])


def _clean(edits: list[tuple], length: int) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for start, stop, new in sorted((s, e, r or "") for s, e, r in edits if s is not None and e is not None):
        start = max(min(start, length), done, 0)
        stop = max(min(stop, length), start)
        out.append((start, stop, new))
        done = stop
    return out


def _regions(tree: SegmentTree, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, list[tuple[int, int, str]]]]:
    """(first leaf, last leaf, edits) of what has to be encoded again."""
    out: list[tuple[int, int, list]] = []
    for start, stop, new in edits:
        first = tree.find(max(start - 2, 0))[0]  # a cut at start - 1 loses the character after it
        last = max(tree.find(max(stop - 1, 0))[0], first)
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]), [*out[-1][2], (start, stop, new)])
        else:
            out.append((first, last, [(start, stop, new)]))
    return out


def revise(text: str | None, tree: SegmentTree, edits: list[tuple], count: Count, leaf_chars: int) -> tuple[str, SegmentTree, int, int]:
    """Text and tree after the edits, and how many characters and leaves were encoded for it."""
    text = text or ""
    parts, taken, encoded, pieces_encoded = [], 0, 0, 0
    crowded: dict[tuple[int, int], list[tuple[int, int]]] = {}
    regions = _regions(tree, _clean(edits, len(text)))
    # where regions lie, before any sum changes
    spans = [(_start(tree, first), _start(tree, last) + tree.leaf(last)[0]) for first, last, _ in regions]
    for (first, last, own), (begin, end) in zip(regions, spans, strict=True):
        new, at = [], begin
        for start, stop, replacement in own:
            new += [text[at:start], replacement]
            at = stop
        changed = "".join([*new, text[at:end]])
        parts += [text[taken:begin], changed]
        taken = end
        slots = last - first + 1
        pieces = cut(changed, max(leaf_chars, -(-len(changed) // slots))) if slots * 4 * leaf_chars >= len(changed) else cut(changed, leaf_chars)
        counts = [(len(p), count(p)) for p in pieces]
        encoded += len(changed)
        pieces_encoded += len(pieces)
        if len(counts) > slots:
            crowded[(first, last)] = counts
        else:
            for slot in range(slots):
                tree.set(first + slot, *(counts[slot] if slot < len(counts) else (0, 0)))
    if crowded:
        tree = _laid_out(tree, crowded)
    return "".join([*parts, text[taken:]]), tree, encoded, pieces_encoded


def _start(tree: SegmentTree, leaf: int) -> int:
    """Characters before a leaf: what hangs to the left of the way to the root."""
    node, before = leaf + tree.leaves, 0
    while node > 1:
        if node % 2:
            before += tree.chars[node - 1]
        node //= 2
    return before


def _laid_out(tree: SegmentTree, crowded: dict[tuple[int, int], list[tuple[int, int]]]) -> SegmentTree:
    counts, leaf = [], 0
    starts = {first: (last, new) for (first, last), new in crowded.items()}
    while leaf < tree.leaves:
        if leaf in starts:
            last, new = starts[leaf]
            counts += new
            leaf = last + 1
        else:
            counts.append(tree.leaf(leaf))
            leaf += 1
    counts = [c for c in counts if c[0]] or [(0, 0)]
    return SegmentTree.over([c for c, _ in counts], [t for _, t in counts])


def build_trees(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, leaf_chars: int = 512
) -> DataFrame:
    """(doc_id, text_hash, n_chars, n_tokens): a tree per document; the sums at index 1 are the whole text's."""
    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            trees = [plant(t.as_py(), count, leaf_chars) for t in batch.column(1)]
            columns = [pa.array([t.chars for t in trees], pa.list_(pa.int64())), pa.array([t.tokens for t in trees], pa.list_(pa.int64()))]
            names = ["doc_id", "text_hash", "n_chars", "n_tokens"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, {TREE}")


def apply_edits(
    docs: DataFrame,
    trees: DataFrame,
    edits: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    leaf_chars: int = 512,
) -> DataFrame:
    """(doc_id, text, n_chars, n_tokens, tokens_before, tokens_after, chars_encoded, leaves_encoded) of every document.

    Texts, trees and edits are each shuffled once, by the id. A document's edits are one row, bounded by what one
    revision of one text changes.
    """
    # one key for all three, in which null is a value, so that each is shuffled once
    keyed = lambda df, name: df.withColumn("key", F.to_json(F.struct(F.col(name).alias("id"))))
    rows = narrow(docs, doc_id=id_col, text=text_col)
    place = lambda c: F.col(c).cast("long").alias(c)
    scripts = (
        keyed(narrow(edits, edit_id="doc_id", start="start", stop="stop", replacement="replacement"), "edit_id")
        .groupBy("key")
        .agg(F.collect_list(F.struct(place("start"), place("stop"), F.col("replacement").cast("string").alias("replacement"))).alias("edits"))
    )
    planted = keyed(trees, "doc_id").groupBy("key").agg(F.min_by(F.struct("text_hash", "n_chars", "n_tokens"), "text_hash").alias("tree"))
    joined = keyed(rows, "doc_id").join(planted, "key", "left").join(scripts, "key", "left")
    joined = joined.withColumn("tree", F.when(F.col("tree.text_hash") == F.xxhash64("text"), F.col("tree")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)

        def results() -> Iterator[tuple]:
            for batch in batches:
                for row in range(batch.num_rows):
                    doc_id, text, chars, tokens, script = (batch.column(i)[row].as_py() for i in range(5))
                    tree = SegmentTree(chars, tokens) if chars else plant(text, count, leaf_chars)
                    before = tree.tokens[1]
                    script = [(e["start"], e["stop"], e["replacement"]) for e in script or []]
                    new, tree, encoded, leaves = revise(text, tree, script, count, leaf_chars)
                    yield doc_id, new, tree.chars, tree.tokens, before, tree.tokens[1], encoded, leaves

        for part in in_portions(results(), lambda r: len(r[1]) + 16 * len(r[2])):
            columns = list(zip(*part, strict=True))
            longs = pa.list_(pa.int64())
            types = [batch_type, pa.string(), longs, longs, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    batch_type = to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["doc_id", "text", "n_chars", "n_tokens", "tokens_before", "tokens_after", "chars_encoded", "leaves_encoded"]
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, {TREE}, tokens_before long, tokens_after long, "
        "chars_encoded long, leaves_encoded long"
    )
    return joined.select("doc_id", "text", "tree.n_chars", "tree.n_tokens", "edits").mapInArrow(run, schema)
