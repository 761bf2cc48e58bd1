"""File inventories of agent data directories."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.fmt import expand_tilde
from tracewarden.functions.paths import SKIP_SCAN_DIRS
from tracewarden.operators.windows import first_per_group
from tracewarden.session import cut_lineage, in_portions


def read_tree(roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(path, size, mtime) of every file below the (agent_id, root) folders, hidden ones included.

    Folders are listed level by level. Each level is a frame of folders spread over the cluster,
    so neither one deep root nor one broad folder list ends up in a single task. On a local file system a link to a
    folder is not followed, so links that lead back to a folder above end the listing instead of repeating it.
    """
    listing = "root string, path string, size bigint, mtime bigint, is_dir boolean"

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs

        for batch in batches:
            for root, folder in zip(batch["root"], batch["folder"]):
                try:
                    system, name = fs.FileSystem.from_uri(folder)
                    found = system.get_file_info(fs.FileSelector(name))
                except OSError:
                    continue  # missing or unreadable folders hold nothing
                rows = [
                    (root, f.path, f.size or 0, int((f.mtime_ns or 0) // 1_000_000_000), f.type == fs.FileType.Directory)
                    for f in found
                    if not (isinstance(system, fs.LocalFileSystem) and f.type == fs.FileType.Directory and os.path.islink(f.path))
                ]
                yield pd.DataFrame(rows, columns=["root", "path", "size", "mtime", "is_dir"])

    folders = roots.select("root", F.col("root").alias("folder")).distinct()
    files = None
    depth = 0
    while max_depth is None or depth <= max_depth:
        depth += 1
        level = cut_lineage(folders.repartition(F.col("folder")).mapInPandas(children, listing))
        part = level.filter(~F.col("is_dir")).select("path", "size", "mtime")
        files = part if files is None else files.unionByName(part)
        folders = level.filter("is_dir").select("root", F.col("path").alias("folder"))
        if folders.isEmpty():
            break
    return files.distinct()


def _per_home(profiles: DataFrame, homes: DataFrame, column: str, out: str) -> DataFrame:
    """(agent_id, out) of every path in a profile column, once per home directory.

    Only paths that begin with a tilde depend on the home. The patterns are collected into one array, as they are
    settings; the homes, of which there may be as many as hosts, stay where they are.
    """
    paths = profiles.select(F.col("id").alias("agent_id"), F.explode(column).alias("path")).distinct()
    fixed = paths.filter(~F.col("path").startswith("~")).select("agent_id", F.col("path").alias(out))
    own = paths.filter(F.col("path").startswith("~")).agg(F.collect_list(F.struct("agent_id", "path")).alias("own")).first()["own"]
    pairs = F.array(*[F.struct(F.lit(p["agent_id"]).alias("agent_id"), F.lit(p["path"]).alias("path")) for p in own])
    if not own:
        return fixed
    spread_out = homes.select("home", F.inline(pairs))
    return fixed.unionByName(spread_out.select("agent_id", expand_tilde(F.col("path"), F.col("home")).alias(out))).distinct()


def profile_roots(profiles: DataFrame, homes: DataFrame) -> DataFrame:
    """(agent_id, root) of every profile's data directories, once per home directory."""
    return _per_home(profiles, homes, "data_dirs", "root")


def profile_configs(profiles: DataFrame, homes: DataFrame) -> DataFrame:
    """(agent_id, path) of every profile's own config files, once per home directory."""
    return _per_home(profiles, homes, "config_files", "path")


def ancestors(path: Column) -> Column:
    """Every directory above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def ingest_file_inventory(
    files: DataFrame, roots: DataFrame, max_depth: int | None = None, max_entries: int | None = None
) -> DataFrame:
    """(agent_id, root, path, size, mtime, depth, scannable) of the files below the roots: metadata only.

    ``depth`` counts directories between root and file; a file is scannable unless one of these is a bundle
    or cache directory. ``max_depth`` and, per root, ``max_entries`` (first paths) bound the inventory where
    asked to. Roots are found by equality on the file's own ancestors; contents never take part, see
    ``with_content``.
    """
    keyed = files.select("path", "size", "mtime", F.explode(ancestors(F.col("path"))).alias("root"))
    rows = keyed.join(roots, "root")
    inner = F.split(F.substring(F.col("path"), F.length("root") + 2, F.length("path")), "/")
    between = F.slice(inner, F.lit(1), F.size(inner) - 1)
    skip = F.array(*[F.lit(d) for d in SKIP_SCAN_DIRS])
    found = rows.withColumns({"depth": F.size(inner) - 1, "scannable": ~F.arrays_overlap(between, skip)})
    if max_depth is not None:
        found = found.filter(F.col("depth") <= max_depth)
    if max_entries is not None:
        found = first_per_group(found, ["agent_id", "root"], ["path"], max_entries)
    return found.select("agent_id", "root", "path", "size", "mtime", "depth", "scannable")


def with_content(chosen: DataFrame, stored: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """Adds ``content`` to rows chosen on metadata: from a table (path, content), or by opening each file.

    The table is filtered to the chosen paths before anything of it moves.
    """
    if stored is None:
        return load_content(chosen, max_bytes)
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    return chosen.join(stored.select("path", content.alias("content")), "path")


def read_head(path: str, max_bytes: int | None) -> bytes | None:
    """A file, or its first bytes; None when it vanished or became unreadable since the listing."""
    from pyarrow import fs

    try:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as handle:
            return handle.read(max_bytes)
    except OSError:
        return None


def load_content(files: DataFrame, max_bytes: int | None = None, out: str = "content") -> DataFrame:
    """Adds each file, or its first ``max_bytes``, read where the row is processed.

    Filter before calling: only the rows that remain are opened, and only that much is read.
    """

    @F.pandas_udf("binary")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        contents = (read_head(path, max_bytes) for paths in batches for path in paths)
        for part in in_portions(contents, lambda c: len(c or b"")):
            yield pd.Series(part)

    return files.withColumn(out, head(F.col("path")))


def bits_per_byte(value: bytes | None) -> float:
    return _bits(_histogram([value] if value else []))


def _histogram(chunks: Iterable[bytes]) -> np.ndarray:
    return sum((np.bincount(np.frombuffer(c, np.uint8), minlength=256) for c in chunks), np.zeros(256, np.int64))


def _bits(counts: np.ndarray) -> float:
    if not counts.any():
        return 0.0
    p = counts[counts > 0] / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def _chunks(path: str, start: int, length: int | None, size: int = 4 << 20) -> Iterator[bytes]:
    """A stretch of a file piece by piece, to its end without a length; nothing when it vanished or became unreadable
    since the listing."""
    from pyarrow import fs

    try:
        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_file(name) as handle:
            handle.seek(start)
            while piece := handle.read(size if length is None else min(size, length)):
                yield piece
                length = None if length is None else length - len(piece)
    except OSError:
        return


def file_ranges(files: DataFrame, range_bytes: int, sample_bytes: int | None = None) -> DataFrame:
    """(path, start, length) of stretches that cover each file, or its first ``sample_bytes``; the last of a whole file is open."""
    size = F.col("size") if sample_bytes is None else F.least("size", F.lit(sample_bytes))
    last = F.greatest(F.ceil(size / range_bytes) - 1, F.lit(0))
    cut = files.select("path", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("i"), last.alias("last"))
    rest = F.lit(None).cast("bigint") if sample_bytes is None else F.col("size") - F.col("i") * range_bytes
    return cut.select(
        "path", (F.col("i") * range_bytes).alias("start"), F.when(F.col("i") < F.col("last"), F.lit(range_bytes)).otherwise(rest).alias("length")
    )


def byte_counts(files: DataFrame, range_bytes: int, sample_bytes: int | None = None) -> DataFrame:
    """(path, byte, n): how often each byte value stands in a file. Stretches of one file are counted by different tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _histogram(_chunks(path, start, length))
                values = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(values), pa.string()), pa.array(values, pa.int32()), pa.array(found[values], pa.int64())], names=["path", "byte", "n"]
                )

    ranges = file_ranges(files.select("path", "size").distinct(), range_bytes, sample_bytes)
    # the rows are tiny but their work is not: a number of its own keeps the engine from joining them into one task
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    counted = ranges.repartition(tasks, "path", "start").mapInArrow(count, "path string, byte int, n bigint")
    return counted.groupBy("path", "byte").agg(F.sum("n").alias("n"))


def shannon_entropy(df: DataFrame, binary_col: str, out: str = "entropy") -> DataFrame:
    """Adds bits per byte (float) of a binary column; empty or missing content gives 0."""

    @F.pandas_udf("float")
    def bits(values: pd.Series) -> pd.Series:
        return values.map(bits_per_byte).astype("float32")

    return df.withColumn(out, bits(F.col(binary_col)))


def entropy_of_file(
    inventory: DataFrame, sample_bytes: int | None = None, stored: DataFrame | None = None, range_bytes: int = 64 << 20
) -> DataFrame:
    """Adds ``entropy`` (bits per byte) of each file, whole unless ``sample_bytes`` bounds it to the first bytes.

    Files are read in stretches of ``range_bytes``, dealt to the tasks one by one, so a big file is the work of many; their byte
    counts add up. With a ``stored`` table (path, content) no file is opened.
    """
    if stored is not None:
        return shannon_entropy(with_content(inventory, stored, sample_bytes), "content").drop("content")
    counts = byte_counts(inventory, range_bytes, sample_bytes)
    measured = counts.groupBy("path").agg(F.sum("n").alias("_total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("_logs"))
    bits = F.log2(F.col("_total").cast("double")) - F.col("_logs") / F.col("_total")
    measured = measured.select("path", F.greatest(bits, F.lit(0.0)).cast("float").alias("entropy"))
    return inventory.join(measured, "path", "left").select(*inventory.columns, F.coalesce("entropy", F.lit(0.0).cast("float")).alias("entropy"))
