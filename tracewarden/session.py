"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; on a cluster the submit command decides the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the application was started from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tracewarden-")) / "tracewarden.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose tasks all see this machine's disk, gets a temporary one where none is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tracewarden-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def remove_written(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder; call it when no frame is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that several later branches read, and read it back.

    The table lives in the shared folder, below the application's id, so lost executors never
    make the branches recompute what led to it, and its true size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Spread the rows of a table with fewer files than the cluster has cores.

    Classifying text is bound by CPU, and a row group cannot be split between tasks. Tables of
    many files are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


PORTION_BYTES = 32 << 20


def in_portions(items: Iterable, size_of: Callable[[object], int], limit: int = PORTION_BYTES) -> Iterator[list]:
    """Group the output of an Arrow batch function so that no portion holds much more than ``limit``
    bytes, whatever its rows inflate to."""
    part: list = []
    held = 0
    for item in items:
        part.append(item)
        held += size_of(item)
        if held >= limit or len(part) >= 10_000:
            yield part
            part, held = [], 0
    if part:
        yield part


#: Bytes of results that one Arrow batch may hold where values are taken one at a time.
BATCH_BYTES = 8 << 20


def values_of(batches: Iterable[pa.Array]) -> Iterator:
    """The values of Arrow batches as Python objects, one at a time, so that only the batch itself is held whole."""
    return (value.as_py() for batch in batches for value in batch)


def in_arrays(items: Iterable, size_of: Callable[[object], int], kind: pa.DataType) -> Iterator[pa.Array]:
    """What an Arrow function returns, in batches of bounded bytes."""
    return map(lambda part: pa.array(part, kind), in_portions(items, size_of, BATCH_BYTES))
