"""Helpers shared by the operators: columns, chunks, checkpoints, code shipping."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at a time; one longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Bytes in an Arrow batch: bounds a worker's memory where texts are long.
ARROW_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, take the checkpoint folder of the session, ship this code if workers lack it.

    Without a folder a cluster is refused; on one machine a temporary one serves.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith(("local[", "local-cluster")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    root = Path(__file__).resolve().parents[2]
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) not in on_path and not getattr(sc, "_llm_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / "llm_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            z.write(package.parent / "__init__.py", f"{package.parent.name}/__init__.py")
            for p in sorted(package.glob("*.py")):
                z.write(p, f"{package.parent.name}/{package.name}/{p.name}")
        sc.addPyFile(str(archive))
        sc._llm_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of whatever file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew only where files would be read by fewer tasks than the cluster has cores.

    Told from the files' sizes, so nothing is planned or run for it.
    """
    spark, size = df.sparkSession, stored_bytes(df)
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size is None or size >= cores * split else df.repartition(cores)


def stored_bytes(df: DataFrame) -> int | None:
    """The size of the files behind a table, as the planner knows it; None where it doesn't know it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return None if any(x >= 1 << 62 for x in sizes) else sum(sizes)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null: empty) under fixed names; other columns, however named, are pruned."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of at most ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        at, size = 0, 0
        lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)) if len(texts) else []
        for k, n in enumerate(lengths):
            if k > at and size + n > limit:
                yield ids[at:k], texts[at:k].to_pylist()
                at, size = k, 0
            size += int(n)
        if at < len(ids):
            yield ids[at:], texts[at:].to_pylist()


def trim() -> None:
    """Give freed memory back to the system. Workers live on between tasks, and the C library would hold on to it for them."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim():
        _malloc_trim()(0)


@functools.cache
def _malloc_trim():
    """The C library's function, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run: Callable) -> Callable:
    """The same function of batches, which trims its worker's memory at the end of a task."""

    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0]:starts[0]+lengths[0]], flat[starts[1]:...], ... joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return flat[at]


def offsets(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sums of the lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
