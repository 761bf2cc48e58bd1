"""Token-id files with keyed access through minimal perfect hashes.

Format. Documents stand in ascending order of their id, cut into shards. A shard file holds the raw ids of its
documents one after the other, each document closed by the end id, as little-endian unsigned integers of 16 bits (32 for
vocabularies beyond 65,536); behind them a directory: two 64-bit hashes of the id and the number of ids of each document, the
number of documents, the shard's number and a mark. The files are written by Spark's text writer with the end id as line
separator, so a failed task leaves nothing behind; the directory's record is closed by one more end id.

Index. The keys of all directories are dealt to buckets of bounded size by hash. A bucket is a minimal perfect hash and a table
in slot order: fingerprint, shard, position in the shard, and how many documents in a row have that id. A lookup hashes
the key, compares the fingerprint and has the shard's offset; only the bytes of the document are read.

Encoding. The vocabulary drops white space before it splits, so pieces between ASCII white space are encoded by themselves, each
distinct piece once while it is held; a word of Latin letters up to U+00FF also apart from the marks around it. The vocabulary's path must exist on every worker, the path of the files must be one
that Spark and the Arrow file systems both open.

Edge cases: a null text is empty and an empty document consists of the end id; null ids come first and are found by the key
null; rows that repeat an id follow each other in the order of their text's hash, may continue in the next shard, and are all
found by the id; texts of any length are whole; an empty table writes no document; extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from tracewarden.llm.common import narrow
from tracewarden.llm.mphf import PerfectHash
from tracewarden.session import cut_lineage, in_portions

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MARK = b"IDSHARD1"
TAIL, TAIL_BYTES = "<QQ8s", 24
ENTRY = np.dtype([("first", "<u8"), ("second", "<u8"), ("n", "<u4")])
SLOT = np.dtype([("fingerprint", "<u8"), ("shard", "<u4"), ("position", "<u4"), ("copies", "<u4"), ("more", "<u4")])
#: Text bytes encoded at once, bytes of encoded pieces that a task holds, and what a document counts besides its text.
TEXT_BYTES, HELD_BYTES, OVERHEAD = 4 << 20, 128 << 20, 64
#: Every ASCII mark: neither letter nor digit nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> tuple[Tokenizer, np.ndarray]:
    """The vocabulary for words of lower-case Latin letters alone, which need no further splitting; which ids end a word."""
    words = Tokenizer.from_file(path)
    words.normalizer = None
    words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    ends = np.zeros(words.get_vocab_size(), bool)
    ends[[i for token, i in words.get_vocab().items() if token.endswith(words.model.end_of_word_suffix)]] = True
    return words, ends


def id_type(vocabulary: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4")


def bare_word(piece: bytes) -> tuple[bytes, bytes, bytes] | None:
    """A piece as (marks before, letters in lower case, marks behind), if its parts encode by themselves.

    Letters are those up to U+00FF, which no mark changes; an apostrophe before letters may be a contraction, and
    the names of special tokens begin with ``<|``.
    """
    core = piece.strip(MARKS)
    if not core.isalpha():  # ASCII letters only
        try:
            word = core.decode()
        except UnicodeDecodeError:
            return None
        if not word.isalpha() or max(word) > "\xff":
            return None
        core_lower = word.lower().encode()
    else:
        core_lower = core.lower()
    if len(core) == len(piece):
        return b"", core_lower, b""
    at = piece.index(core)
    before = piece[:at]
    return None if before.endswith((b"'", b"<|")) else (before, core_lower, piece[at + len(core):])


class Encoder:
    """Ids of texts as bytes; holds what it encoded for pieces and words that come again, the latest in two halves."""

    def __init__(self, vocabulary: str):
        self.library, self.kind = tokenizer(vocabulary), id_type(vocabulary)
        self.words, self.ends = word_tokenizer(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        if self.held > HELD_BYTES // 2:
            self.known, self.before, self.held = {}, self.known, 0
        self._learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def _hold(self, piece: bytes, ids: bytes) -> None:
        self.known[piece] = ids
        self.held += 180 + len(piece) + len(ids)

    def _unknown(self, pieces: set[bytes]) -> list[bytes]:
        """Pieces to encode; those held from before are taken over."""
        missing = pieces.difference(self.known)
        again = missing.intersection(self.before)
        for piece in again:
            self._hold(piece, self.before[piece])
        return list(missing - again)

    def _learn(self, pieces: set[bytes]) -> None:
        new = self._unknown(pieces)
        parts = list(map(bare_word, new))
        split = [(piece, found) for piece, found in zip(new, parts, strict=True) if found]
        marks = {m for _, (before, _, behind) in split for m in (before, behind) if m}
        self._learn_whole(self._unknown(marks.union(piece for piece, found in zip(new, parts, strict=True) if not found)))
        self._learn_words(self._unknown({word for _, (_, word, _) in split}))
        known = self.known
        for piece, (before, word, behind) in split:
            if before or behind or piece != word:
                self._hold(piece, (known[before] if before else b"") + known[word] + (known[behind] if behind else b""))

    def _learn_whole(self, pieces: list[bytes]) -> None:
        for start in range(0, len(pieces), 1024):
            part = pieces[start:start + 1024]
            encoded = self.library.encode_batch_fast([p.decode(errors="replace") for p in part], add_special_tokens=False)
            for piece, one in zip(part, encoded, strict=True):
                self._hold(piece, np.array(one.ids, self.kind).tobytes())

    def _learn_words(self, words: list[bytes]) -> None:
        """Encodes words many at a time; each ends with an id that only ends of words have."""
        width = self.kind.itemsize
        for start in range(0, len(words), 1024):
            part = words[start:start + 1024]
            ids = np.array(self.words.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("words and their ends differ in number")
            raw, at = ids.tobytes(), 0
            for word, stop in zip(part, (stops * width).tolist(), strict=True):
                self._hold(word, raw[at:stop])
                at = stop


def key_hashes(ident: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key; null is a key as well."""
    return [F.xxhash64(F.lit(salt), ident).alias(name) for salt, name in ((17, "first"), (71, "second"))]


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = 2,
    shard_bytes: int = 32 << 20,
) -> None:
    """Encode the documents and write them as shards of about ``shard_bytes`` of text below ``path``/shards."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD), F.lit(0))).first()[0]
    kind = id_type(vocabulary)
    end = np.array([end_id], kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, entries = Encoder(vocabulary), []

        def payloads() -> Iterator[bytes]:
            for batch in batches:
                first, second = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
                texts, start, held = batch.column(2).cast(pa.binary()), 0, 0
                for stop in range(1, batch.num_rows + 1):
                    held += len(texts[stop - 1].as_buffer() or b"")
                    if held >= TEXT_BYTES or stop == batch.num_rows:
                        ids = encoder([t or b"" for t in texts.slice(start, stop - start).to_pylist()])
                        entry = np.zeros(len(ids), ENTRY)
                        entry["first"], entry["second"] = first[start:stop], second[start:stop]
                        entry["n"] = [len(i) // kind.itemsize + 1 for i in ids]
                        entries.append(entry)
                        yield from ids
                        start, held = stop, 0
            if entries:
                found = np.concatenate(entries)
                yield found.tobytes() + struct.pack(TAIL, len(found), TaskContext.get().partitionId(), MARK)

        for part in in_portions(payloads(), len, 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["value"])

    order = [F.asc_nulls_first("doc_id"), "_text_hash", "_row"]
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_text_hash"), F.monotonically_increasing_id().alias("_row"))
    ordered = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    encoded = ordered.select(*key_hashes(F.col("doc_id")), "text").mapInArrow(encode, "value binary")
    encoded.select(F.col("value").cast("string")).write.option("lineSep", end.decode()).option("maxRecordsPerFile", 0).text(f"{path}/shards")


def _uri(path: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", path))


class ShardFile:
    """A shard opened for random access."""

    def __init__(self, path: str, kind: np.dtype):
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(_uri(path))
        self.file, self.kind = system.open_input_file(name), kind
        tail = self.file.size() - kind.itemsize - TAIL_BYTES
        count, self.number, mark = struct.unpack(TAIL, self.file.read_at(TAIL_BYTES, tail))
        if mark != MARK:
            raise ValueError(f"{path} is no shard")
        at = tail - count * ENTRY.itemsize
        self.entries = np.frombuffer(self.file.read_at(count * ENTRY.itemsize, at), ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.entries["n"], dtype=np.int64)])
        if self.starts[-1] * kind.itemsize != at:
            raise ValueError(f"{path}: directory and payload differ in length")

    def ids(self, position: int) -> np.ndarray:
        start, stop = self.starts[position], self.starts[position + 1]
        return np.frombuffer(self.file.read_at(int(stop - start) * self.kind.itemsize, int(start) * self.kind.itemsize), self.kind)


def _shard_paths(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/shards")
    return files.filter("length > 0").select("path")


def _each_file(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows of each file, of which there may be many in a task; ``rows_of`` gives arrow tables for a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from rows_of(path).to_batches(max_chunksize=100_000)

    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def shard_table(spark: SparkSession, path: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, path, docs, ids, start): one row per shard; ``start`` counts the ids of all shards before it."""
    kind = id_type(vocabulary)

    def rows_of(file: str) -> pa.Table:
        shard = ShardFile(file, kind)
        return pa.table({
            "shard": pa.array([shard.number], pa.int64()), "path": pa.array([file]), "docs": pa.array([len(shard.entries)], pa.int64()),
            "ids": pa.array([int(shard.starts[-1])], pa.int64()),
        })

    shards = _each_file(_shard_paths(spark, path), rows_of, "shard long, path string, docs long, ids long")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _runs(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """(first, second, shard, position, copies, part, more): the documents of one key that follow each other in a shard.

    A key whose documents go on in further shards has a part there; only the runs at the ends of shards can.
    """
    kind = id_type(vocabulary)

    def rows_of(file: str) -> pa.Table:
        shard = ShardFile(file, kind)
        first, second = shard.entries["first"], shard.entries["second"]
        begins = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
        at_end = np.zeros(len(begins), bool)
        at_end[[0, -1]] = True
        return pa.table({
            "first": first[begins].view(np.int64), "second": second[begins].view(np.int64),
            "shard": np.full(len(begins), shard.number, np.int64), "position": begins.astype(np.int64),
            "copies": np.diff(begins, append=len(first)).astype(np.int64), "at_end": pa.array(at_end),
        })

    runs = _each_file(_shard_paths(spark, path), rows_of, "first long, second long, shard long, position long, copies long, at_end boolean")
    runs = cut_lineage(runs)
    key = W.partitionBy("first", "second")
    ends = runs.filter("at_end").select("*", (F.row_number().over(key.orderBy("shard")) - 1).alias("part"), F.count(F.lit(1)).over(key).alias("parts"))
    inner = runs.filter("not at_end").select("*", F.lit(0).alias("part"), F.lit(1).cast("long").alias("parts"))
    return ends.unionByName(inner).select("*", (F.col("part") < F.col("parts") - 1).cast("int").alias("more")).drop("at_end", "parts")


def _part_hash(second: np.ndarray, part: np.ndarray | int) -> np.ndarray:
    return second ^ (np.asarray(part, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def write_index(spark: SparkSession, path: str, vocabulary: str = VOCABULARY, bucket_keys: int = 50_000) -> None:
    """Build the index of the shards below ``path`` from their directories."""
    runs = cut_lineage(_runs(spark, path, vocabulary))
    buckets = max(1, -(-runs.count() // bucket_keys))

    def build(rows: pa.Table) -> pa.Table:
        first, second = (rows[c].to_numpy().view(np.uint64) for c in ("first", "second"))
        mixed = _part_hash(second, rows["part"].to_numpy())
        function = PerfectHash.build(first, mixed)
        slots = np.zeros(len(first), SLOT)
        at = function.slots(first, mixed)
        slots["fingerprint"][at] = mixed
        for name in ("shard", "position", "copies", "more"):
            slots[name][at] = rows[name].to_numpy()
        return pa.table({
            "bucket": rows["bucket"].slice(0, 1).combine_chunks(), "buckets": pa.array([buckets], pa.int64()),
            "hash": pa.array([function.to_bytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary()),
        })

    dealt = runs.withColumn("bucket", F.pmod("first", F.lit(buckets)))
    dealt.groupBy("bucket").applyInArrow(build, "bucket long, buckets long, hash binary, slots binary").write.parquet(f"{path}/index")


def probe(function: PerfectHash, slots: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the keys that are found, with their slots; a key that goes on in further shards is found more than once."""
    numbers, hits, open_ones, part = [], [], np.arange(len(first)), 0
    while len(open_ones) and len(slots):
        mixed = _part_hash(second[open_ones], part)
        at = function.slots(first[open_ones], mixed)
        true = (at >= 0) & (slots["fingerprint"][at] == mixed)
        found = slots[at[true]]
        numbers.append(open_ones[true])
        hits.append(found)
        open_ones, part = open_ones[true][found["more"] == 1], part + 1
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0, SLOT)
    return np.concatenate(numbers), np.concatenate(hits)


def lookup(spark: SparkSession, keys: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, shard, position, copies) of the distinct keys that the index below ``path`` holds."""
    index = spark.read.parquet(f"{path}/index")
    buckets = (index.agg(F.max("buckets")).first()[0]) or 1
    wanted = narrow(keys, doc_id=id_col).distinct().select("doc_id", *key_hashes(F.col("doc_id")))
    kind = wanted.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    dealt = wanted.withColumn("bucket", F.pmod("first", F.lit(buckets)))

    def find(rows: pa.Table, bucket: pa.Table) -> pa.Table:
        numbers, found = np.zeros(0, np.int64), np.zeros(0, SLOT)
        if rows.num_rows and bucket.num_rows:
            function = PerfectHash.from_bytes(bucket["hash"][0].as_py())
            slots = np.frombuffer(bucket["slots"][0].as_py(), SLOT)
            numbers, found = probe(function, slots, *(rows[c].to_numpy().view(np.uint64) for c in ("first", "second")))
        out = {"doc_id": rows["doc_id"].cast(arrow_kind).take(pa.array(numbers, pa.int64()))}
        return pa.table({**out, **{name: found[name].astype(np.int64) for name in ("shard", "position", "copies")}})

    schema = f"doc_id {kind.simpleString()}, shard long, position long, copies long"
    return dealt.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(find, schema)


def fetch(spark: SparkSession, found: DataFrame, path: str, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): what was looked up, read from the files at its offsets.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the ids as 32-bit integers. A task opens a
    shard, whose size bounds what it is asked for, and reads only the documents asked for.
    """
    kind = id_type(vocabulary)
    id_kind = found.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(id_kind)

    def read(rows: pa.Table, shards: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        shard = ShardFile(shards["path"][0].as_py(), kind)
        base, idents = shards["start"][0].as_py(), rows["doc_id"].cast(arrow_kind).combine_chunks()
        position, copies = rows["position"].to_numpy(), rows["copies"].to_numpy()
        asked = ((int(i), int(p)) for i in np.argsort(position) for p in range(position[i], position[i] + copies[i]))

        def results() -> Iterator[tuple]:
            for number, at in asked:
                ids = shard.ids(at)
                yield number, base + int(shard.starts[at]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None

        for part in in_portions(results(), lambda r: 100 + 4 * r[2] * with_ids):
            numbers, *columns = zip(*part, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [idents.take(pa.array(numbers, pa.int64())), *arrays], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
            )

    def whole(rows: pa.Table, shards: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", arrow_kind), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])
        return pa.Table.from_batches(list(read(rows, shards)), schema=schema)

    schema = f"doc_id {id_kind.simpleString()}, start long, n_tokens long, ids_crc32 long, ids array<long>"
    result = found.groupBy("shard").cogroup(shard_table(spark, path, vocabulary).groupBy("shard")).applyInArrow(whole, schema)
    return result if with_ids else result.drop("ids")
