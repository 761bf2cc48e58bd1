"""Stupid-backoff scores of every document against all the others.

Score of a word after the two before it: the trigram's count over its context's, or ``alpha`` times the bigram's
over its context's if the trigram does not occur, or ``alpha`` squared times the word's share; a word that occurs
nowhere else takes another ``alpha`` over the number of words. A document's own n-grams are taken off all counts
(leave one out), as they would otherwise always be found.

Documents are packed into batches of about ``batch_chars`` characters. A batch explodes its n-grams, combined to
distinct ones with their counts, and sends them to hash partitions; each partition sums its count table, joins it to
what the batches asked for and answers in the same order; a batch then sums the scores per document. However
frequent an n-gram, it is sent once per batch, so no partition is hot, and no document leaves its batch: batches are
written in buckets and only answers travel to them. The number
of partitions follows the number of words, so that each holds about ``partition_grams`` entries.

Words are runs of non-space, ASCII letters lower-cased. Edge cases: a null text, or one without words, has 0 words,
log_score 0 and a null mean; a corpus of one document finds nothing of it elsewhere; rows that repeat are separate
documents; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewarden.llm.common import narrow
from tracewarden.session import shared_folder

ORDERS = 3


def squeeze(values: np.ndarray) -> bytes:
    """Compressed byte planes: small numbers and small differences cost little."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    count, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=count * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def _batches(docs: DataFrame, batch_chars: int) -> DataFrame:
    """(batch, doc_ids, lengths, vocabulary, words): documents as numbers into their batch's vocabulary of word hashes."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        ids, lengths, words, chars = [], [], [], 0

        def close() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
            numbers = np.frombuffer(b"".join(words), np.int32)
            frequent = np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")  # small numbers for frequent words
            rank = np.empty(len(known), np.int32)
            rank[frequent] = np.arange(len(known), dtype=np.int32)
            columns = [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(to_arrow_type(kind))), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([sum(lengths)], pa.int64()), pa.array([hashes[frequent].tobytes()], pa.binary()),
                pa.array([squeeze(rank[numbers])], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "doc_ids", "lengths", "n_words", "vocabulary", "words"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = np.array([known.setdefault(w, len(known)) for w in text.encode("utf-8", "surrogatepass").lower().split()], np.int32)
                ids.append(doc_id)
                lengths.append(len(found))
                words.append(found.tobytes())
                chars += len(text)
                if chars >= batch_chars or len(ids) >= 50_000:
                    yield close()
                    number += 1
                    known, ids, lengths, words, chars = {}, [], [], [], 0
        if ids:
            yield close()

    schema = f"batch long, doc_ids array<{kind.simpleString()}>, lengths array<long>, n_words long, vocabulary binary, words binary"
    return docs.mapInArrow(run, schema)


def _stored(batches: DataFrame) -> DataFrame:
    """The batches written out, in buckets by batch, so that they meet their answers without being shuffled."""
    spark = batches.sparkSession
    name = f"lm_batches_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches.write.format("parquet").option("path", path).bucketBy(buckets, "batch").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # noqa: B018  resolved now: the name can go, the files stay
    spark.sql(f"DROP TABLE {name}")
    return stored


@dataclass
class Batch:
    """One batch unpacked: the document and the n-gram hash of each position that has a whole n-gram."""

    lengths: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, lengths: list[int], vocabulary: bytes, words: bytes) -> Batch:
        return cls(np.array(lengths, np.int64), np.frombuffer(vocabulary, np.uint64)[unsqueeze(words, np.int32)])

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def place(self) -> np.ndarray:
        """Position of each word in its document."""
        return np.arange(len(self.words)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def grams(self, order: int) -> np.ndarray:
        """Hash of the n-gram that ends at each word; only meaningful from position order - 1 on."""
        hashes = self.words.copy()
        for back in range(1, order):
            hashes[back:] = _mix(hashes[back:], self.words[:-back], back)
        return hashes


def _mix(hashes: np.ndarray, earlier: np.ndarray, back: int) -> np.ndarray:
    x = (hashes ^ np.uint64(back)) * np.uint64(0x9E3779B97F4A7C15) + earlier
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _requests(batches: DataFrame, partitions: int) -> DataFrame:
    """(bucket, batch, n, grams, counts): a batch's distinct n-grams by hash range, ascending."""
    width = (1 << 64) // partitions + 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([i * width for i in range(1, partitions)], np.uint64)
        for part in parts:
            for row in part.to_pylist():
                batch = Batch.of(row["lengths"], row["vocabulary"], row["words"])
                place = batch.place()
                for order in range(1, ORDERS + 1):
                    grams, counts = np.unique(batch.grams(order)[place >= order - 1], return_counts=True)
                    cuts = [0, *np.searchsorted(grams, edges), len(grams)]
                    rows = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([i for i, _, _ in rows], pa.int64()), pa.array([row["batch"]] * len(rows), pa.int64()),
                            pa.array([order] * len(rows), pa.int64()),
                            pa.array([squeeze_sorted(grams[a:b]) for _, a, b in rows], pa.binary()),
                            pa.array([squeeze(counts[a:b]) for _, a, b in rows], pa.binary()),
                        ],
                        names=["bucket", "batch", "n", "grams", "counts"],
                    )

    columns = batches.select("batch", "lengths", "vocabulary", "words")
    return columns.mapInArrow(run, "bucket long, batch long, n long, grams binary, counts binary")


def _answer(requests: pa.Table) -> pa.Table:
    """Totals for each request of one bucket and order, in its own order."""
    asked = [unsqueeze_sorted(g.as_py()) for g in requests["grams"]]
    counts = [unsqueeze(c.as_py(), np.int64) for c in requests["counts"]]
    grams, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(grams)).astype(np.int64)[place]
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pa.table(
        {
            "batch": requests["batch"], "n": requests["n"], "bucket": requests["bucket"],
            "totals": pa.array([squeeze(t) for t in np.split(totals, cuts)], pa.binary()),
        }
    )


def _own(document: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """How often each position's n-gram occurs in its own document."""
    both = document * (int(gram.max()) + 1 if len(gram) else 1) + gram
    order = np.argsort(both)
    starts = np.flatnonzero(np.diff(both[order], prepend=-1))
    counts = np.diff(starts, append=len(both)).astype(np.int32)
    out = np.empty(len(both), np.int32)
    out[order] = np.repeat(counts, counts)
    return out


def backoff_scores(batch: Batch, totals: list[np.ndarray], n_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 score of each word and the order that gave it. ``totals`` has the corpus counts of the batch's distinct n-grams."""
    document, place = batch.document(), batch.place()
    found = []  # count without the own document, by position
    for order in range(1, ORDERS + 1):
        whole = place >= order - 1
        count = np.zeros(len(place), np.int64)
        if whole.any():
            gram = np.unique(batch.grams(order)[whole], return_inverse=True)[1].astype(np.int32)
            count[whole] = totals[order - 1][gram] - _own(document[whole], gram)
        found.append(count)
    others = n_words - batch.lengths[document]
    score = np.where(found[0] > 0, found[0] / np.maximum(others, 1), alpha / np.maximum(others, 1)) * alpha ** np.minimum(place, ORDERS - 1)
    level = (found[0] > 0).astype(np.int64)
    for order in range(2, ORDERS + 1):
        context = np.zeros(len(place), np.int64)
        context[1:] = found[order - 2][:-1]
        here = (place >= order - 1) & (found[order - 1] > 0)
        steps = np.minimum(place, ORDERS - 1) - (order - 1)
        score = np.where(here, found[order - 1] / np.maximum(context, 1) * alpha ** np.maximum(steps, 0), score)
        level = np.where(here, order, level)
    return np.log10(score), level


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    alpha: float = 0.4,
    batch_chars: int = 12_000_000,
    partition_grams: int = 2_000_000,
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, trigram_hits), one row per document; logs to base 10."""
    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType
    batches = _stored(_batches(rows, batch_chars))
    n_words = batches.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    partitions = max(1, -(-ORDERS * n_words // partition_grams))
    requests = _requests(batches, partitions)
    answers = requests.groupBy("bucket", "n").applyInArrow(_answer, "batch long, n long, bucket long, totals binary")

    def score(packed: pa.Table, replies: pa.Table) -> pa.Table:
        row = packed.to_pylist()[0]
        batch = Batch.of(row["lengths"], row["vocabulary"], row["words"])
        by_order: list[list[tuple[int, bytes]]] = [[] for _ in range(ORDERS)]
        for reply in replies.to_pylist():
            by_order[reply["n"] - 1].append((reply["bucket"], reply["totals"]))
        totals = [np.concatenate([np.zeros(0, np.int64), *(unsqueeze(t, np.int64) for _, t in sorted(parts))]) for parts in by_order]
        logs, level = backoff_scores(batch, totals, n_words, alpha)
        document, count = batch.document(), len(batch.lengths)
        sums = np.bincount(document, weights=logs, minlength=count)
        hits = np.bincount(document, weights=level == ORDERS, minlength=count).astype(np.int64)
        mean = [s / n if n else None for s, n in zip(sums.tolist(), row["lengths"], strict=True)]
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], to_arrow_type(kind)), "n_words": pa.array(row["lengths"], pa.int64()),
                "log_score": pa.array(sums), "mean_log_score": pa.array(mean, pa.float64()), "trigram_hits": pa.array(hits),
            }
        )

    packed = batches.select("batch", "doc_ids", "lengths", "vocabulary", "words")
    schema = f"doc_id {kind.simpleString()}, n_words long, log_score double, mean_log_score double, trigram_hits long"
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema)
