"""Intermediate tables in the folder that `spark.checkpoint.dir` names."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid

import numpy as np

from pyspark.sql import DataFrame, SparkSession

from fonolytics.plans.materialize import scratch_path


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared checkpoint folder (not made yet); `plans.materialize.release` removes it."""
    return scratch_path(spark, f"llm-{name}")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: a lost executor costs a read, not a recomputation."""
    path = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put_array(uri: str, values: np.ndarray) -> None:
    """Write an array's bytes at `uri` on any file system that pyarrow knows: under another name first, so a retried task leaves whole files."""
    files, path = _filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).data)
    files.move(part, path)


def mapped_array(uri: str, dtype: str) -> np.ndarray:
    """The array at `uri`, memory-mapped. From a store that can't be mapped it is copied to an unlinked temporary file first."""
    from pyarrow import fs

    files, path = _filesystem(uri)
    if not files.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    copy = tempfile.TemporaryFile()
    with files.open_input_stream(path) as src:
        shutil.copyfileobj(src, copy, 1 << 22)
    copy.flush()
    return np.memmap(copy, dtype, "r")


def frugal(work):
    """`work` (over a task's Arrow batches), which gives the memory that it freed back to the system when the task ends.

    Spark keeps Python workers for later stages; without this each would hold on to the largest task that it ever ran.
    """

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only GNU's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_if_small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most `most_rows`; beyond that the join shuffles it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
