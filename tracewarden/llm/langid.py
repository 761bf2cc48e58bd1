"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character n-grams (1 to 3) over their lower-cased letters, everything else
counting as one space, with length 1. Each language has several centroids, found by spherical k-means in one task
per language over a bounded sample of its labelled rows (``sample_rows`` different rows per language, those of
smallest hash of id and text). Document frequencies come from all labelled rows given. A text takes the language of the centroid of largest
cosine; it is rejected if its cosine distance exceeds what ``reject_quantile`` of the sample of that centroid
reached, by ``reject_factor``.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and rejected; a label that is null is not
learned from; without any labelled row everything is ``und``; rows that repeat are scored alike; texts are read
whole; extra columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm.common import narrow, unsigned_part

UNDETERMINED = "und"
FEATURES = 1 << 12
ORDERS = 3
CHARS_AT_ONCE = 1 << 18
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True at the code points of letters; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def features(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return None
    codes = np.where(is_letter, codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]  # runs of others are one space
    codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint64)
    counts = np.zeros(FEATURES)
    for start in range(0, len(codes), CHARS_AT_ONCE):
        part = codes[start : start + CHARS_AT_ONCE + ORDERS - 1]
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, ORDERS + 1):
            gram = (gram[: len(part) - n + 1] if n == 1 else gram[:-1]) * np.uint64(0x1000193) + part[n - 1 :]
            slots = (gram * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(52)
            counts += np.bincount(slots[:CHARS_AT_ONCE].astype(np.int64), minlength=FEATURES)
    return counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighed = np.log1p(counts) * idf
    return weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)


def _document_frequency(rows: DataFrame) -> np.ndarray:
    """(feature, documents) summed over all rows; the table that comes back has at most FEATURES + 1 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (counts := features(text.as_py())) is not None:
                    seen += counts > 0
                    total += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(seen, total))], names=["feature", "documents"])

    sums = rows.select("text").mapInArrow(run, "feature long, documents long").groupBy("feature").agg(F.sum("documents").alias("documents"))
    out = np.zeros(FEATURES + 1)
    for feature, documents in sums.collect():
        out[feature] = documents
    return out


def _kmeans(points: np.ndarray, count: int, seed: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1 and each point's centroid."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(count, len(points)), replace=False)]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        for i in range(len(centres)):
            if (mine := points[nearest == i]).size:
                mean = mine.sum(axis=0)
                centres[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres, (points @ centres.T).argmax(axis=1)


@dataclass
class Model:
    """What a fit leaves: idf, and per centroid its language, its direction and the least cosine it accepts."""

    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    accepts: np.ndarray


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 400,
    centroids: int = 4,
    reject_quantile: float = 0.005,
    reject_factor: float = 0.5,
    seed: int = 11,
) -> Model:
    """Learn from rows whose label is not null. The sample and the model are bounded by the number of languages."""
    rows = narrow(labelled, doc_id=id_col, text=text_col, lang=lang_col).filter("lang is not null")
    seen = _document_frequency(rows)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    # rows that repeat count once; the hash is uniform: a cut at four times the share wanted leaves a bounded number to
    # rank; one row per language is broadcast, no more than the model that is collected below
    hashed = rows.withColumn("pick", unsigned_part(F.xxhash64("doc_id", "text")))
    sizes = hashed.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("pick").alias("n"))
    low = F.col("pick") < F.lit(float(1 << 62)) * F.least(F.lit(1.0), F.lit(4.0 * sample_rows) / F.col("n"))
    by_hash = W.partitionBy("lang").orderBy("pick")
    picked = (
        hashed.select("lang", "pick").join(F.broadcast(sizes), F.col("lang") == F.col("of")).filter(low)
        .select("lang", "pick").distinct()
        .withColumn("rank", F.row_number().over(by_hash))
        .filter(F.col("rank") <= sample_rows)
        .select(F.col("pick").alias("picked"), F.col("lang").alias("picked_lang"))
    )
    sample = hashed.join(picked, (F.col("pick") == F.col("picked")) & (F.col("lang") == F.col("picked_lang")), "left_semi")
    sample = sample.dropDuplicates(["lang", "pick"]).select("lang", "text")

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(features, group["text"]) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centre": [], "accepts": []})
        points = vectors(np.stack(counts), idf)
        centres, nearest = _kmeans(points, centroids, seed)
        cosine = (points @ centres.T).max(axis=1)
        found = [i for i in range(len(centres)) if (nearest == i).any()]
        return pd.DataFrame(
            {
                "lang": group["lang"].iloc[0],
                "centre": [centres[i].astype("<f8").tobytes() for i in found],
                "accepts": [reject_factor * float(np.quantile(cosine[nearest == i], reject_quantile)) for i in found],
            }
        )

    learned = sample.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, accepts double").collect()
    learned.sort(key=lambda r: (r["lang"], bytes(r["centre"])))
    centres = np.frombuffer(b"".join(bytes(r["centre"]) for r in learned), "<f8").reshape(-1, FEATURES)
    return Model(idf, [r["lang"] for r in learned], centres, np.array([r["accepts"] for r in learned]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; the text is the only input."""
    langs = np.array(model.langs, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score, rejected = np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n, bool)
            for start in range(0, n, 256):
                counts = [features(t.as_py()) for t in batch.column(1).slice(start, 256)]
                at = np.array([start + i for i, c in enumerate(counts) if c is not None], int)
                if len(at) and len(langs):
                    cosine = vectors(np.stack([c for c in counts if c is not None]), model.idf) @ model.centres.T
                    best = cosine.argmax(axis=1)
                    top = cosine[np.arange(len(at)), best]
                    pred[at], score[at], rejected[at] = langs[best], np.clip(top, 0, 1), top < model.accepts[best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = narrow(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows with ``held_out``: whether crc32 of the id as text leaves remainder 1 modulo 3."""
    return ids.withColumn("held_out", F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
