"""Approximate largest inner products by multiprobe p-stable hashing.

Vectors are scaled into the unit ball and given one more coordinate that puts them on the sphere; queries are
scaled to length 1. There the largest inner product is the nearest point, so Gaussian (2-stable) projections cut
into cells of equal width hash near points alike. Each of ``tables`` tables has ``projections`` of them.

A query visits the cells around its own in the order of the probability that a neighbour at the expected distance
lies there, until the tables together reach ``success``. The expected distance of the k-th neighbour is estimated
on a bounded sample (``sample_rows``); every row is indexed. Candidates of all tables are merged and ranked by
their inner product in double precision. The expected distance fits the table as a whole, not every query: where the
k-th point a query found lies so far that the visited cells hold a neighbour at that distance with a chance below
``vouch``, and where it found fewer than k, the query is searched again over all cells.

Rows are dealt to shards by (table, cell), a shard of more rows than ``shard_rows`` is cut into chunks that each
answer for themselves, and every shard returns only its best per query. Equal vectors are one point that
carries the ``k + 1`` smallest of its ids: no other of them can be among k results ordered by score and id.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components,
and rows without an id take no part; of rows that repeat an id the one of smallest vector counts; with fewer than
k candidates all are returned; ties go to the smaller id; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm.common import narrow
from tracewarden.session import cut_lineage

QUERIES_AT_ONCE = 128
#: Relative error allowed to a product when points are preselected.
ROUNDING = 1e-12
RESULT = "query_id long, vec_id long, score double"


@dataclass
class Tables:
    """The projections and what the order of visits depends on."""

    weights: np.ndarray  # tables x dimension + 1 x projections
    offsets: np.ndarray
    width: float
    radius: float
    success: float
    scale: float

    def place(self, points: np.ndarray, table: int) -> np.ndarray:
        return (points @ self.weights[table] + self.offsets[table]) / self.width

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.scale
        last = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        return np.column_stack([scaled, last])

    def lift_queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors / np.linalg.norm(vectors, axis=1, keepdims=True), np.zeros(len(vectors))])

    def cells(self, points: np.ndarray, table: int) -> np.ndarray:
        return cell_keys(np.floor(self.place(points, table)).astype(np.int64))

    def visits(self, queries: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the cells around each query's own, most promising first, and which of them to visit."""
        at = self.place(queries, table)
        own = np.floor(at)
        steps = self.steps()
        odds = self.odds(at, np.full(len(at), self.radius))
        order = np.argsort(-odds, axis=1, kind="stable")
        ranked = np.take_along_axis(odds, order, axis=1)
        wanted = 1 - (1 - self.success) ** (1 / len(self.weights))
        visit = np.cumsum(ranked, axis=1) - ranked < wanted  # up to the cell that reaches it
        keys = cell_keys((own.astype(np.int64)[:, None] + steps[order]).reshape(-1, at.shape[1])).reshape(order.shape)
        return keys, visit

    def steps(self) -> np.ndarray:
        return np.array(list(product((-1, 0, 1), repeat=self.weights.shape[2])), np.int64)

    def odds(self, at: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The chance that a neighbour at each query's distance lies in each cell around its own."""
        steps, spread = self.steps(), np.maximum(distance / self.width, 1e-9)
        edges = np.stack([np.floor(at) + s for s in (-1, 0, 1, 2)], axis=-1) - at[..., None]
        chance = np.diff(_normal(edges / spread[:, None, None]), axis=-1)
        odds = np.ones((len(at), len(steps)))
        for i in range(at.shape[1]):
            odds *= chance[:, i, steps[:, i] + 1]
        return odds

    def vouched(self, queries: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """The chance that the visited cells of the tables hold a neighbour at each query's distance."""
        missed = np.ones(len(queries))
        for table in range(len(self.weights)):
            at = self.place(queries, table)
            order = np.argsort(-self.odds(at, np.full(len(at), self.radius)), axis=1, kind="stable")
            _, visit = self.visits(queries, table)
            missed *= 1 - (np.take_along_axis(self.odds(at, distance), order, axis=1) * visit).sum(axis=1)
        return 1 - missed


def _normal(x: np.ndarray) -> np.ndarray:
    """Cumulative normal distribution (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x) / math.sqrt(2))
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x / 2)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


def cell_keys(cells: np.ndarray) -> np.ndarray:
    key = np.zeros(len(cells), np.uint64)
    for i in range(cells.shape[1]):
        key = (key ^ cells[:, i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return (key >> np.uint64(1)).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _best(queries: np.ndarray, own: np.ndarray, member: np.ndarray | None, points: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple]:
    """(query id, vec id, score) of the k best rows per query among the points it may see."""
    scores = queries @ points.T
    if member is not None:
        scores[~member] = -np.inf
    width = min(k + 1, len(points))
    least = -np.partition(-scores, width - 1, axis=1)[:, width - 1]
    # products of one matrix multiplication and of another may differ by rounding; all that tie at the cut stay
    slack = ROUNDING * np.linalg.norm(queries, axis=1) * np.linalg.norm(points, axis=1).max()
    for i in range(len(queries)):
        picks = np.flatnonzero((scores[i] >= least[i] - slack[i]) & (scores[i] > -np.inf))
        exact = np.einsum("ij,j->i", points[picks], queries[i])
        every = np.concatenate([ids[p] for p in picks]) if len(picks) else np.zeros(0, np.int64)
        score = np.repeat(exact, [len(ids[p]) for p in picks])
        order = np.lexsort((every, -score))
        order = order[every[order] != own[i]][:k]
        yield from ((own[i], v, s) for v, s in zip(every[order].tolist(), score[order].tolist(), strict=True))


def _search(index: DataFrame, probes: DataFrame, model: Tables, k: int, everything: bool) -> DataFrame:
    """Each shard's best per query. Both sides carry ``shard``, ``chunk`` and ``table``."""

    def answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            points, table = matrix(rows["vector"].combine_chunks()), rows["table"][0].as_py()
            ids = [np.array(x) for x in rows["ids"].to_pylist()]
            cells, cell = np.unique(model.cells(model.lift(points), table), return_inverse=True)
            queries, own = matrix(asked["vector"].combine_chunks()), asked["query_id"].to_pylist()
            for start in range(0, len(queries), QUERIES_AT_ONCE):
                part = queries[start : start + QUERIES_AT_ONCE]
                member = None
                if not everything:
                    keys, visit = model.visits(model.lift_queries(part), table)
                    at = np.searchsorted(cells, keys).clip(0, len(cells) - 1)
                    hit = visit & (cells[at] == keys)
                    seen = np.zeros((len(part), len(cells)), bool)
                    seen[np.nonzero(hit)[0], at[hit]] = True
                    member = seen[:, cell]
                found += _best(part, own[start : start + QUERIES_AT_ONCE], member, points, ids, k)
        q, v, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return index.groupBy("shard", "chunk").cogroup(probes.groupBy("shard", "chunk")).applyInArrow(answer, RESULT)


def _index(points: DataFrame, model: Tables, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lifted = model.lift(matrix(batch.column("vector"))) if batch.num_rows else None
            for table in range(len(model.weights)) if batch.num_rows else ():
                shard = table * shards + model.cells(lifted, table) % shards
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.array(np.full(batch.num_rows, table)), batch.column("ids"), batch.column("vector")],
                    names=["shard", "table", "ids", "vector"],
                )

    return points.select("ids", "vector").mapInArrow(run, "shard long, table long, ids array<long>, vector array<double>")


def _probes(queries: DataFrame, model: Tables, shards: int, everything: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("vector"))
            for start in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = model.lift_queries(vectors[start : start + QUERIES_AT_ONCE])
                for table in range(1 if everything else len(model.weights)):
                    wanted = np.zeros((len(part), shards), bool)
                    if everything:
                        wanted[:] = True
                    else:
                        keys, visit = model.visits(part, table)
                        wanted[np.nonzero(visit)[0], keys[visit] % shards] = True
                    query, shard = np.nonzero(wanted)
                    rows = pa.array(query + start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard + table * shards), batch.column("query_id").take(rows), batch.column("vector").take(rows)],
                        names=["shard", "query_id", "vector"],
                    )

    return queries.select("query_id", "vector").mapInArrow(run, "shard long, query_id long, vector array<double>")


def _sure(reached: DataFrame, model: Tables, vouch: float) -> DataFrame:
    """The queries (query_id, vector, score of the k-th found) whose visited cells vouch for what they found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, score = matrix(batch.column("vector")), batch.column("score").to_numpy()
            distance = np.sqrt(np.maximum(2 - 2 * score / (np.linalg.norm(vectors, axis=1) * model.scale), 0))
            parts = range(0, len(vectors), QUERIES_AT_ONCE)
            chance = [model.vouched(model.lift_queries(vectors[i : i + QUERIES_AT_ONCE]), distance[i : i + QUERIES_AT_ONCE]) for i in parts]
            yield pa.RecordBatch.from_arrays([batch.column("query_id").filter(pa.array(np.concatenate(chance) >= vouch))], names=["query_id"])

    return reached.select("query_id", "vector", "score").mapInArrow(run, "query_id long")


def _radius(model: Tables, sample: np.ndarray, rows: int, k: int) -> float:
    """Distance of the k-th neighbour among ``rows`` points, from the distances between sampled ones."""
    against = model.lift_queries(sample[:200])
    products = against @ model.lift(sample).T
    products[np.arange(len(against)), np.arange(len(against))] = -np.inf
    share = min(1.0, k / max(rows - 1, 1))
    pairs = np.sort(products[products > -np.inf])[::-1]
    at = pairs[min(len(pairs) - 1, int(share * len(pairs)))] if len(pairs) else 1.0
    return math.sqrt(max(2 - 2 * float(at), 1e-4))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    tables: int = 2,
    projections: int = 6,
    success: float = 0.97,
    vouch: float = 0.9,
    sample_rows: int = 2000,
    shard_rows: int = 16_000,
    seed: int = 5,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row that ``is_query`` (a condition on ``vec_id``)."""
    rows = narrow(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("vec_id", F.col("vec_id").cast("long"))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = cut_lineage(rows.filter(F.size("vector") == lengths["n"]).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    same = W.partitionBy("vector").orderBy("vec_id")
    points = cut_lineage(
        rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
        .groupBy("vector").agg(F.collect_list("vec_id").alias("ids"))
    )
    squared = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sqrt(F.max(squared)).alias("norm")).first()
    sample = points.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(sample_rows).collect()
    rng = np.random.default_rng(seed)
    model = Tables(
        rng.standard_normal((tables, lengths["n"] + 1, projections)), rng.uniform(0, 1e3, (tables, projections)), 1.0, 1.0, success, total["norm"]
    )
    model.radius = _radius(model, np.array([r["vector"] for r in sample]), total["rows"], k)
    model.width = 2 * model.radius
    queries = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    shards = max(1, -(-total["rows"] // shard_rows))
    index = _index(points, model, shards)
    parts = index.groupBy("shard").count().select("shard", F.ceil(F.col("count") / (2 * shard_rows)).cast("long").alias("parts")).filter("parts > 1")
    split = lambda df: df.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    index = split(index).withColumn("chunk", F.pmod(F.xxhash64("vector"), F.col("parts")))

    def found(asked: DataFrame, everything: bool) -> DataFrame:
        probes = split(_probes(asked, model, shards, everything)).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return _search(index.drop("parts"), probes.drop("parts"), model, k, everything).distinct()

    first = cut_lineage(found(queries, False))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == min(k, total["rows"] - 1)).select("query_id", "score")
    short = cut_lineage(queries.join(_sure(queries.join(last, "query_id"), model, vouch), "query_id", "left_anti"))
    both = first.unionByName(found(short, True)).distinct() if not short.isEmpty() else first
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
