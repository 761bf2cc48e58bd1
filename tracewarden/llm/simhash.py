"""SimHash near-duplicates, linked through vantage-point trees over the fingerprints.

A fingerprint bit is set if it is set in more than half of the hashes of a document's word shingles. Equal
fingerprints are one point. Points are dealt to shards by vantage-point trees: at each level the Hamming
distance to the node's vantage point decides the side, a point also visits the other side if the triangle
inequality allows a partner there (the distance lies within the search radius of the border), and shards then
compare their points exactly.

Random fingerprints all lie about half their bits apart, and a tree over whole fingerprints could prune almost
nothing. So there are several trees, each over the Hamming distance of some of the bits. With ``max_distance + 1``
disjoint blocks of bits, linked points agree in at least one block: that tree needs radius 0, no point visits a
second side, and no link is lost. With fewer disjoint blocks the radius is ``max_distance // blocks`` and border
points are copied; that is exact too. For distances too wide for that, ``trees`` blocks of ``block_bits`` bits
drawn at random find partners with the probability that one of them agrees.

A shard of more than ``shard_points`` points is cut into chunks that meet in pairs, each pair in its own task.
Tasks return stars around the first fingerprint of each component they find, not all pairs; trees that see one group
return the same links. Only what is linked enters the component rounds.

Edge cases: a null text, like one without words, has fingerprint zero, and all of those link; rows that repeat
have one fingerprint and one component; a null id never becomes a component's id unless it has no other; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import narrow
from tracewarden.llm.components import components
from tracewarden.session import cut_lineage

SEED = 42
#: Random trees whose links are joined before the other trees look for more.
FIRST_TREES = 4
HASHES_AT_ONCE = 1 << 15
BITS_OF_BYTES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + MIX[0]
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, repeats included, a bounded number at a time."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(p) + 1 for p in parts)]
    if len(parts) < words:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    digest = xxhash.xxh64_intdigest
    count = len(parts) - words + 1
    for first in range(0, count, HASHES_AT_ONCE):
        last = min(count, first + HASHES_AT_ONCE)
        spans = zip(starts[first:last], starts[first + words : last + words], strict=True)
        yield np.fromiter((digest(joined[a : b - 1], SEED) for a, b in spans), np.uint64, last - first)


def fingerprint(text: str | None, words: int, size: int) -> np.ndarray:
    """``size`` 64-bit words; the first is the SimHash of the hashes, the others that of the same hashes mixed again."""
    ones, total = np.zeros(size * 64), 0
    offsets = np.arange(size * 8) * 256
    for hashes in shingle_hashes(text, words):
        total += len(hashes)
        columns = [hashes] + [mixed(hashes ^ mixed(np.array([i], np.uint64))) for i in range(1, size)]
        octets = np.stack(columns, axis=1).astype("<u8").view(np.uint8)
        counts = np.bincount((octets + offsets).ravel(), minlength=size * 8 * 256).reshape(size * 8, 256)
        ones += (counts @ BITS_OF_BYTES).ravel()
    return np.packbits(ones * 2 > total, bitorder="little").view("<u8").astype(np.uint64)


def to_bytes(points: np.ndarray) -> list[bytes]:
    data, width = points.astype(">u8").tobytes(), points.shape[1] * 8
    return [data[i : i + width] for i in range(0, len(data), width)]


def to_points(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, ">u8").astype(np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, fingerprint): one row per document, big-endian bytes, 64 bits or a multiple."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [fingerprint(t.as_py(), words, bits // 64) for t in batch.column(1)]
            found = to_bytes(np.stack(points)) if points else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fingerprint"])

    rows = narrow(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def disjoint_blocks(bits: int, count: int) -> np.ndarray:
    """Masks (count x bits/64) that share out all bits evenly."""
    return _masks(bits, [np.arange(bits)[i::count] for i in range(count)])


def random_blocks(bits: int, count: int, block_bits: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return _masks(bits, [rng.choice(bits, block_bits, replace=False) for _ in range(count)])


def _masks(bits: int, blocks: Sequence[np.ndarray]) -> np.ndarray:
    masks = np.zeros((len(blocks), bits // 64), np.uint64)
    for row, block in zip(masks, blocks, strict=True):
        for bit in block:
            row[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
    return masks


def route(points: np.ndarray, mask: np.ndarray, tree: int, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) for every shard a point belongs to or visits in one tree.

    A node's vantage point is drawn from its number; half of the mask's bits is the border, the median distance.
    """
    rows, node = np.arange(len(points)), np.ones(len(points), np.uint64)
    border = int(np.bitwise_count(mask).sum()) // 2
    width = points.shape[1]
    for _ in range(levels):
        seeds = (np.uint64(tree) << np.uint64(40)) ^ (node << np.uint64(8))
        vantage = np.stack([mixed(seeds ^ np.uint64(w)) for w in range(width)], axis=1)
        distance = np.bitwise_count((points[rows] ^ vantage) & mask).sum(axis=1, dtype=np.int64)
        inside = distance <= border
        # a partner at radius r has a distance from distance - r to distance + r
        crosses = np.where(inside, distance + radius > border, distance - radius <= border) & (radius > 0)
        node = node * np.uint64(2)
        other = node[crosses] + inside[crosses].astype(np.uint64)
        node = node + (~inside).astype(np.uint64)
        rows, node = np.concatenate([rows, rows[crosses]]), np.concatenate([node, other])
    return rows, node


def _shards(points: DataFrame, masks: np.ndarray, levels: int, radius: int, first_tree: int) -> DataFrame:
    """(shard, label, fingerprint): where each point is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = to_points(batch.column(0))
            for tree, mask in enumerate(masks, first_tree):
                rows, leaf = route(own, mask, tree, levels, radius)
                shard = ((np.uint64(tree) << np.uint64(48)) | leaf).astype(np.int64)
                taken = [batch.column(i).take(pa.array(rows)) for i in (1, 0)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), *taken], names=["shard", "label", "fingerprint"])

    return points.select("fingerprint", F.col("label").cast("long")).mapInArrow(run, "shard long, label long, fingerprint binary")


def clusters(points: np.ndarray, distance: int) -> np.ndarray:
    """For each point the number of its component under links of at most ``distance`` bits.

    Each point taken up is compared with the points not yet reached, so a dense group costs little more than
    one comparison per point, and no pair list is built.
    """
    if len(points) <= 512:
        apart = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2, dtype=np.int64)
        if np.count_nonzero(apart <= distance) == len(points):
            return np.arange(len(points))
    labels, rest, label = np.zeros(len(points), np.int64), np.arange(len(points)), 0
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        labels[queue] = label
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(points[rest] ^ points[at]).sum(axis=1, dtype=np.int64) <= distance
            if near.any():
                labels[rest[near]] = label
                queue += list(rest[near])
                rest = rest[~near]
        label += 1
    return labels


def heads(labels: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each member the member of its component that ranks first."""
    first = np.zeros(labels.max() + 1, np.int64)
    order = np.argsort(rank)[::-1]
    first[labels[order]] = order
    return first[labels]


def star_links(
    own: np.ndarray, rank: np.ndarray, cluster: Callable[[np.ndarray], np.ndarray], label: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever a task's links connect, each to the first member of a component.

    The member that ranks first is often the same wherever a group is seen, so trees repeat links. A task of two chunks (``own``
    tells them apart) only links the first members of components its chunks have by themselves, as the chunks' own tasks link
    the rest: fewer links than both have components. Members of one ``label`` are connected already: one of them is linked.
    """
    everyone = np.arange(len(own))
    head = heads(cluster(everyone), rank)
    members = everyone
    if len(chunks := np.unique(own)) > 1:
        inner = []
        for chunk in chunks:
            part = np.flatnonzero(own == chunk)
            inner.append(part[heads(cluster(part), rank[part])])
        members = np.unique(np.concatenate(inner))
    if label is not None:
        members = members[np.argsort(rank[members])]
        members = members[np.unique(np.stack([head[members], label[members]]), axis=1, return_index=True)[1]]
        members = members[label[members] != label[head[members]]]
    members = members[head[members] != members]
    return head[members], members


def _compare(tasks: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within each task (shard, i, j) of the chunks ``own``; tasks arrive sorted, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        owned: list[np.ndarray] = []
        labels: list[np.ndarray] = []
        current = None

        def close() -> Iterator[pa.RecordBatch]:
            points = np.concatenate(held) if held else np.zeros((0, 1), np.uint64)
            if len(points) < 2:
                return
            rank = np.empty(len(points), np.int64)
            rank[np.lexsort(points.T[::-1])] = np.arange(len(points))
            a, b = star_links(np.concatenate(owned), rank, lambda part: clusters(points[part], distance), np.concatenate(labels))
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to_bytes(points[a]), pa.binary()), pa.array(to_bytes(points[b]), pa.binary())], names=["a", "b"]
                )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            own, label, points = batch.column(3).to_numpy(), batch.column(4).to_numpy(), to_points(batch.column(5))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(points)], strict=True):
                key = tuple(keys[start])
                if key != current:
                    yield from close()
                    held, owned, labels, current = [], [], [], key
                held.append(points[start:end])
                owned.append(own[start:end])
                labels.append(label[start:end])
        yield from close()

    return tasks.mapInArrow(run, "a binary, b binary")


def links(
    points: DataFrame, max_distance: int, masks: np.ndarray, radius: int, levels: int = 24, shard_points: int = 20_000, first_tree: int = 0
) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs the trees bring together.

    Points may carry a ``label``, a number that connected points share; without it each is alone."""
    if "label" not in points.columns:
        points = points.withColumn("label", F.monotonically_increasing_id())
    routed = _shards(points, masks, levels, radius, first_tree)
    large = routed.groupBy("shard").count().filter(F.col("count") > shard_points)
    parts = large.select("shard", F.ceil(F.col("count") / shard_points).cast("long").alias("parts"))
    cut = routed.join(parts, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("parts"))
    met = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tasks = met.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "fingerprint")
    tasks = tasks.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    return _compare(tasks, max_distance)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    bits: int = 64,
    max_distance: int = 4,
    blocks: int | None = None,
    trees: int | None = None,
    block_bits: int = 13,
    levels: int = 24,
    shard_points: int = 20_000,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    Exact for ``blocks`` disjoint blocks (by default ``max_distance + 1``, radius 0). With ``trees``, that many
    random blocks of ``block_bits`` bits are used instead.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, words, bits))
    points = cut_lineage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    if trees:
        masks, radius = random_blocks(bits, trees, block_bits), 0
    else:
        blocks = blocks or max_distance + 1
        masks, radius = disjoint_blocks(bits, blocks), max_distance // blocks
    roots = components(links(points, max_distance, masks, radius, levels, shard_points))
    rooted = points.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fingerprint", "component_id")
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def set_clusters(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of its component under links of at least that Jaccard similarity; exact.

    As in ``clusters``, each set taken up is compared with all not yet reached.
    """
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(ids), bool)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    rest = np.flatnonzero(sizes)  # the empty set is like no other
    labels = np.arange(len(sets))
    entries = ids
    while len(rest):
        first, queue, entries, rest = rest[0], [rest[0]], entries[sizes[rest[0]] :], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            own = ids[bounds[at] : bounds[at + 1]]
            mark[own] = True
            starts = np.concatenate([[0], np.cumsum(sizes[rest])[:-1]])
            shared = np.add.reduceat(mark[entries], starts, dtype=np.int64)
            mark[own] = False
            near = shared * (1 + similarity) + 1e-9 >= similarity * (sizes[rest] + len(own))
            if near.any():
                labels[rest[near]] = first
                queue += list(rest[near])
                entries, rest = entries[np.repeat(~near, sizes[rest])], rest[~near]
    return labels


def _set_links(tasks: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between sets (set_key, shingles) within each task (root, i, j) of the chunks ``own``; tasks arrive sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        sets: list[np.ndarray] = []
        owned: list[int] = []
        current = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(sets) < 2:
                return
            rank = np.empty(len(keys), np.int64)
            rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
            links = star_links(np.array(owned), rank, lambda part: set_clusters([sets[x] for x in part], similarity))
            if len(links[0]):
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in side], pa.binary()) for side in links], names=["a", "b"])

        for batch in batches:
            for root, i, j, own, key, shingles in zip(*[batch.column(n) for n in range(6)], strict=True):
                if (task := (root.as_py(), i.as_py(), j.as_py())) != current:
                    yield from close()
                    keys, sets, owned, current = [], [], [], task
                keys.append(key.as_py())
                owned.append(own.as_py())
                sets.append(np.frombuffer(shingles.as_py(), "<u8"))
        yield from close()

    return tasks.mapInArrow(run, "a binary, b binary")


def near_copies(
    docs: DataFrame,
    similarity: float,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    bits: int = 256,
    deviations: float = 3.0,
    trees: int = 96,
    block_bits: int = 13,
    task_shingles: int = 1_000_000,
) -> DataFrame:
    """(doc_id, component_id, text_hash, first), one row per document: groups that links of Jaccard similarity ``similarity`` and
    more connect. ``first`` marks the rows of smallest id, then text hash, of their group; null ids come last.

    The similarity is that of the sets of word shingles, compared exactly. Fingerprints only tell what to compare: those
    that differ in no more bits than documents at the threshold do, ``deviations`` standard deviations more than on average,
    form candidate groups, and inside a candidate group every set meets every other. Equal sets are one. A group of more than
    ``task_shingles`` shingles is cut into chunks that meet in pairs.
    """
    hashed = narrow(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))
    prints = cut_lineage(fingerprints(hashed, "text_hash", "text", words, bits).withColumnRenamed("doc_id", "text_hash").distinct())
    distance = max_distance_for(similarity, bits, deviations)
    points = cut_lineage(prints.select("fingerprint").distinct().withColumn("label", F.monotonically_increasing_id()))
    masks = random_blocks(bits, trees, block_bits)
    # a few trees connect most of a group; the others then add only what is not connected yet
    known = components(links(points, distance, masks[:FIRST_TREES], 0))
    rooted = points.join(known.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    shared = rooted.filter("root is not null").groupBy("root").agg(F.min("label").alias("shared"))
    labelled = cut_lineage(rooted.join(shared, "root", "left").select("fingerprint", F.coalesce("shared", "label").alias("label")))
    more = links(labelled, distance, masks[FIRST_TREES:], 0, first_tree=FIRST_TREES)
    near = components(more.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    rooted = prints.join(near.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "text_hash", F.coalesce("root", "fingerprint").alias("root")
    )
    several = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("root")
    members = cut_lineage(rooted.join(several, "root", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words).astype("<u8").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["text_hash", "shingles"])

    texts = hashed.join(members.select("text_hash"), "text_hash", "left_semi").select("text_hash", "text").dropDuplicates(["text_hash"])
    found = texts.mapInArrow(run, "text_hash long, shingles binary").withColumn("set_key", F.unhex(F.md5("shingles")))
    found = cut_lineage(found.join(members.withColumnRenamed("text_hash", "of"), F.col("text_hash") == F.col("of")).drop("of"))
    sets = found.groupBy("root", "set_key").agg(F.first("shingles").alias("shingles"))
    sizes = found.select("root", "set_key", F.length("shingles").alias("bytes")).distinct().groupBy("root").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("bytes").alias("bytes")
    )
    parts = sizes.filter("sets > 1").select("root", F.ceil(F.col("bytes") / (8 * task_shingles)).cast("long").alias("parts"))
    cut = sets.join(parts.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("set_key"), F.greatest("parts", F.lit(1))))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)))
    tasks = met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_key", "shingles")
    linked = components(_set_links(tasks.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), similarity))
    keyed = found.select("text_hash", "set_key").join(linked.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        "text_hash", F.coalesce("root", "set_key").alias("group")
    )
    ids = hashed.select("doc_id", "text_hash").join(keyed.withColumnRenamed("text_hash", "of"), F.col("text_hash") == F.col("of"), "left").select(
        "doc_id", "text_hash", F.coalesce("group", F.to_binary(F.hex("text_hash"), F.lit("hex"))).alias("group")
    )
    ids = cut_lineage(ids)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    least = ids.groupBy("group").agg(F.min(place).alias("least"))
    return ids.join(least, "group").select("doc_id", F.col("least.doc_id").alias("component_id"), "text_hash", (place == F.col("least")).alias("first"))


def max_distance_for(similarity: float, bits: int, deviations: float = 1.0) -> int:
    """How many bits documents of that Jaccard similarity differ in: the mean, which is the angle between their shingle
    sets, and as many standard deviations more, so that few at the similarity itself are missed."""
    share = float(np.arccos(2 * similarity / (1 + similarity))) / float(np.pi)
    return round(bits * share + deviations * float(np.sqrt(bits * share * (1 - share))))
