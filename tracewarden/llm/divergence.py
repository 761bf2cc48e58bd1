"""Source divergence audit: how far the term shares of a source lie from those of its language.

Two passes over the documents. The first counts exactly in how many documents of its language each term stands; terms
below ``min_docs`` go. Perfect hashes over the kept terms, one per language and shard, map a term to a dense slot; the
stored term is compared, so that nothing else is counted. The second pass gets them as broadcasts of bounded size
(``slice_bytes`` at a time; a larger vocabulary takes further scans) and increments dense counts per (language, source).
Shares are whole numbers: p = 1 + floor(10^9 (count + prior) / (N + prior V)).

Edge cases: null text, lang and source read as ''; an empty text has no terms but its (lang, source) is still a group; a
language without kept terms has pairs of value 0 and no term rows; repeated rows count as often as they stand; texts and
terms of any length are whole; ties are ordered by the item's UTF-8 bytes; an empty table gives an empty result; columns
other than the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm.common import narrow
from tracewarden.llm.mphf import PerfectHash
from tracewarden.session import cut_lineage

#: ASCII letters in lower case; every other ASCII character separates terms; bytes from 0x80 on belong to them.
TERM_BYTES = bytes(c if c >= 128 else c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32 for c in range(256))
#: Entries a task holds before it passes them on: distinct terms, and dense counters.
HELD_TERMS, HELD_SLOTS = 400_000, 4_000_000
#: Text bytes counted at once; rows of one result batch; terms of one cell of the pair comparison.
TEXT_BYTES, ROWS, CELL = 4 << 20, 50_000, 4096
SCALE = 1_000_000_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _batches(columns: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    whole = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for start in range(0, whole.num_rows, ROWS):
        yield whole.slice(start, ROWS)


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): number of documents of a language that hold the term; summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                terms = list(counts)
                for start in range(0, len(terms), ROWS):
                    part = terms[start:start + ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), _text(part), pa.array([counts[t] for t in part], pa.int64())],
                        names=["lang", "term", "docs"],
                    )
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), _raw(batch, 2), strict=True):
                counts = held[lang]
                size -= len(counts)
                counts.update(set(terms_of(text)))
                size += len(counts)
                if size > HELD_TERMS:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    counted = rows.mapInArrow(run, "lang string, term string, docs long")
    return counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def perfect_hashes(kept: DataFrame, shards: int) -> DataFrame:
    """(lang, shard, size, hash, terms): a perfect hash over the terms of each shard, which stand in slot order."""

    def build(table: pa.Table) -> pa.Table:
        terms = table["term"].cast(pa.binary()).to_pylist()
        first, second = _hashes(terms)
        function = PerfectHash.build(first, second)
        ordered = [b""] * len(terms)
        for slot, term in zip(function.slots(first, second).tolist(), terms, strict=True):
            ordered[slot] = term
        return pa.table({
            "lang": table["lang"].slice(0, 1).combine_chunks(), "shard": table["shard"].slice(0, 1).combine_chunks(),
            "size": pa.array([len(terms)], pa.int32()), "hash": pa.array([function.to_bytes()], pa.binary()),
            "terms": pa.array([b" ".join(ordered)], pa.binary()),
        })

    placed = kept.select("lang", "term", (F.crc32(F.col("term").cast("binary")) % shards).cast("int").alias("shard"))
    return placed.groupBy("lang", "shard").applyInArrow(build, "lang string, shard int, size int, hash binary, terms binary")


def _hashes(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


class Shard:
    """A perfect hash with its stored terms."""

    def __init__(self, function: bytes, terms: bytes):
        self.function, self.terms = PerfectHash.from_bytes(function), terms.split(b" ")

    def slots(self, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms that are stored here, and their slots."""
        slots = self.function.slots(*_hashes(terms))
        stored = self.terms
        same = [i for i, s in enumerate(slots.tolist()) if s >= 0 and stored[s] == terms[i]]
        return np.array(same, np.int64), slots[same]


def recount(rows: DataFrame, functions: DataFrame, shards: int, slices: int) -> DataFrame:
    """(lang, source, shard, slot, n): occurrences of the stored terms, in one scan per slice."""
    found = None
    for number in range(slices):
        chosen = functions.filter(F.pmod(F.xxhash64("lang", "shard"), F.lit(slices)) == number)
        one = _recount_slice(rows, chosen, shards)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _recount_slice(rows: DataFrame, functions: DataFrame, shards: int) -> DataFrame:
    stored = {(r["lang"], r["shard"]): (bytes(r["hash"]), bytes(r["terms"])) for r in functions.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(stored)
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("slot", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[tuple[str, int], Shard] = {}
        dense: dict[tuple[str, str, int], np.ndarray] = {}
        waiting: dict[tuple[str, str], list[bytes]] = defaultdict(list)

        def shard_of(lang: str, number: int) -> Shard | None:
            if (lang, number) in sent.value and (lang, number) not in open_shards:
                open_shards[lang, number] = Shard(*sent.value[lang, number])
            return open_shards.get((lang, number))

        def count() -> None:
            for (lang, source), texts in waiting.items():
                often = Counter(terms_of(b" ".join(texts)))
                by_shard: dict[int, list[bytes]] = defaultdict(list)
                for term in often:
                    by_shard[zlib.crc32(term) % shards].append(term)
                for number, terms in by_shard.items():
                    if shard := shard_of(lang, number):
                        if (lang, source, number) not in dense:
                            dense[lang, source, number] = np.zeros(len(shard.terms), np.int64)
                        where, slots = shard.slots(terms)
                        n = np.fromiter((often[t] for t in terms), np.int64, len(terms))
                        dense[lang, source, number][slots] += n[where]
            waiting.clear()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source, number), counts in dense.items():
                slots = np.flatnonzero(counts)
                same = [[v] * len(slots) for v in (lang, source, number)]
                yield from _batches([*same, slots.astype(np.int32), counts[slots]], schema)
            dense.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _raw(batch, 2), strict=True):
                waiting[lang, source].append(text)
                size += len(text) + 64
                if size > TEXT_BYTES:
                    count()
                    size = 0
                    if sum(map(len, dense.values())) > HELD_SLOTS:
                        yield from passed_on()
        count()
        yield from passed_on()

    return rows.mapInArrow(run, "lang string, source string, shard int, slot int, n long")


def share(count: Column, total: Column, terms: Column, prior: int) -> Column:
    """1 + floor(10^9 (count + prior) / (total + prior * terms)), exactly; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(prior)).cast("decimal(20,0)")
    below = (total + F.lit(prior) * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.floor((above - above % below) / below).cast("long") + F.lit(1))


def _pairs(cell: pa.Table) -> pa.Table:
    """Sums of absolute differences between all sources of a language, over the terms of one cell."""
    sources, zero, size = cell["source"].to_pylist(), cell["zero"].to_numpy(), cell["size"][0].as_py()
    shares = np.repeat(np.nan_to_num(zero).astype(np.int64)[:, None], size, axis=1)
    for i, (slots, values) in enumerate(zip(cell["slots"], cell["shares"], strict=True)):
        if slots.is_valid:
            shares[i, slots.values.to_numpy()] = values.values.to_numpy()
    one, other, sums = [], [], []
    for i, source in enumerate(sources):
        others = [j for j in range(len(sources)) if j != i]
        one += [source] * len(others)
        other += [sources[j] for j in others]
        sums += np.abs(shares - shares[i]).sum(axis=1)[others].tolist()
    return pa.table({
        "lang": pa.array([cell["lang"][0].as_py()] * len(one), pa.string()), "source": pa.array(one, pa.string()),
        "item": pa.array(other, pa.string()), "value": pa.array(sums, pa.int64()),
    })


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = 30,
    prior: int = 5,
    top: int = 50,
    shard_bytes: int = 1 << 20,
    slice_bytes: int = 32 << 20,
) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair`` holds each other source of the language, its value the difference summed over all kept terms. Part ``term``
    holds the ``top`` terms that a source has a larger share of than its language.
    """
    read = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = narrow(docs, lang=lang_col, source=source_col, text=text_col).select(*[read(c).alias(c) for c in ("lang", "source", "text")])
    kept = cut_lineage(document_frequencies(rows).filter(F.col("docs") >= min_docs).select("lang", "term"))
    stored_bytes = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 9), F.lit(0))).first()[0]
    shards = max(1, -(-stored_bytes // shard_bytes))
    functions = cut_lineage(perfect_hashes(kept, shards))
    counts = cut_lineage(recount(rows, functions, shards, max(1, -(-stored_bytes // slice_bytes))))

    terms = functions.groupBy("lang").agg(F.sum("size").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        rows.select("lang", "source").distinct()
        .join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
        .na.fill(0, ["total", "v"])
        .withColumn("zero", share(F.lit(0), F.col("total"), F.col("v"), prior))
    )
    groups = cut_lineage(groups)
    lang_totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = cut_lineage(
        counts.join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("v"), prior)).drop("total")
    )

    # terms that stand out
    of_lang = (
        shares.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n"), F.first("v").alias("v")).join(lang_totals, "lang")
        .select("lang", "shard", "slot", share(F.col("n"), F.col("lang_total"), F.col("v"), prior).alias("q"))
    )
    names = functions.select("lang", "shard", F.posexplode(F.split(F.col("terms").cast("string"), " ")).alias("slot", "item"))
    over = shares.join(of_lang, ["lang", "shard", "slot"]).filter("p > q").join(names, ["lang", "shard", "slot"])
    in_order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = over.select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value")).withColumn("rank", F.row_number().over(in_order))
    best = best.filter(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # sources against each other, in cells of a bounded number of terms
    begin = lambda size: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / CELL)).cast("int"))
    cells = functions.select("lang", "shard", "size", F.explode(begin(F.col("size"))).alias("cell"))
    cells = cells.withColumn("size", F.least(F.lit(CELL), F.col("size") - F.col("cell") * CELL))
    bare = groups.filter("v = 0").select("lang", F.lit(0).alias("shard"), F.lit(0).alias("size"), F.lit(0).alias("cell")).distinct()
    filled = shares.groupBy("lang", "source", "shard", F.floor(F.col("slot") / CELL).cast("int").alias("cell")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("slot") % CELL).alias("slot"), "p"))).alias("held")
    )
    columns = ["lang", "shard", "cell"]
    matrix = (
        cells.select(*columns, "size").unionByName(bare.select(*columns, "size"))
        .join(groups.select("lang", "source", F.coalesce("zero", F.lit(0)).alias("zero")), "lang")
        .join(filled, [*columns, "source"], "left")
        .select(*columns, "size", "source", "zero", F.col("held.slot").alias("slots"), F.col("held.p").alias("shares"))
    )
    sums = matrix.groupBy(*columns).applyInArrow(_pairs, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(in_order).alias("rank"))
    return pairs.unionByName(best)
