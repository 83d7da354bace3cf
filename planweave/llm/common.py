"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one serves a session of one machine; on a
    cluster no folder of one machine would do, and an error is raised."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if configured:
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = jsc.getCheckpointDir()
    if current.isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="planweave-checkpoint-"))
        current = jsc.getCheckpointDir()
    return current.get()


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, computed once and held in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, for wide or binary columns; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/planweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_discard, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _discard(spark: SparkSession, path: str) -> None:
    """Through Spark while it runs; after that only a folder of this machine can still be reached."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    elif path.startswith(("/", "file:/")):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def slices(batches: Iterator[pa.RecordBatch], text_column: int, max_bytes: int, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about ``max_bytes`` at most (a single longer text stands alone). After the last one
    the memory that the work on them left free is handed back."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
    released()


def released() -> None:
    """Hand freed memory back to the system, Arrow's and, where it can, the C library's: a worker lives on after its task, and would keep what the task had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The values of a binary column as arrays of numbers, which look at Arrow's own memory. Nulls are empty."""
    found = []
    for chunk in column.chunks:
        _, places, data = chunk.buffers()
        wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        edges = np.frombuffer(places, wide)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        size = np.dtype(kind).itemsize
        found += [np.frombuffer(data, kind, (b - a) // size, a) if b > a else np.empty(0, kind) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return found


def text_bytes(rows: DataFrame, column: str = "text") -> int:
    """Bytes of all texts."""
    return rows.agg(F.sum(F.octet_length(column))).first()[0] or 0


def free_name(columns: list[str], wanted: str) -> str:
    """A name that none of the columns has, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    """The number of partitions the session wants for a shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
