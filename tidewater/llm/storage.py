"""Shared storage for intermediate tables and binary artefacts.

Everything an executor or the driver has to see later goes below the folder named in
``spark.checkpoint.dir``. Binary files are written from executors through ``pyarrow.fs`` under
a unique attempt name and are listed in a manifest that Spark commits, so a lost executor leaves
at most an unlisted file behind.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.staging import shared_root


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders of this process, by application.
_written: dict[str, list[str]] = {}
#: Folders of the scratches that this thread has open, the innermost last.
_local = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _scratches() -> list[list[str]]:
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


def materialize(df: DataFrame, name: str, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and the planner
    knows the size of what comes back. Shuffle files of the job go when it ends."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    if _scratches():
        _scratches()[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", compression)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What is materialized inside goes at the end, but for what the given function has written:
    ``with scratch(spark) as keep: ... result = keep(df, name)``."""
    paths: list[str] = []
    opened = _scratches()
    opened.append(paths)

    def keep(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        out = materialize(df, name, *partition_by)
        kept = paths.pop()
        if len(opened) > 1:
            opened[-2].append(kept)
        return out

    try:
        yield keep
    finally:
        opened.pop()
        _delete(spark, paths)


def clear(spark: SparkSession) -> int:
    """Delete what this process has written to the shared folder for this application, and say how many
    folders it was. For callers who have written or collected their results: a result is read from these
    folders whenever it is asked for."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by number, so that columns can be added under any other name."""
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))])


def renamed(df: DataFrame) -> list[Column]:
    """The columns of ``numbered(df)`` under the names that they had."""
    return [F.col(f"_in{i}").alias(c) for i, c in enumerate(df.columns)]


def put_file(uri_dir: str, name: str, chunks) -> str:
    """Write a binary file atomically enough for retries: unique temporary name, then a rename."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(uri_dir)
    system.create_dir(base, recursive=True)
    temporary, final = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"
    with system.open_output_stream(temporary) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(temporary, final)
    return f"{uri_dir}/{name}"


def open_file(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def batch_slices(batch, column: str, max_bytes: int = 4 << 20):
    """Cut an Arrow batch so that no slice holds more than ``max_bytes`` of ``column``, unless it
    is a single row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application, so that their Python
    workers can import it where it isn't installed."""
    import io
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_tidewater_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    target = os.path.join(tempfile.mkdtemp(prefix="tidewater-ship-"), "tidewater.zip")
    with open(target, "wb") as f:
        f.write(buffer.getvalue())
    context.addPyFile(target)
    context._tidewater_shipped = True
