"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, of: int) -> Column:
    """Fold of a key: crc32 of its text form modulo ``of``; null stays null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(of)


def held_out(key: Column, of: int, which: int) -> Column:
    """True for keys of the held-out fold; a null key is never held out."""
    return F.coalesce(fold(key, of) == which, F.lit(False))


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with an operator's own."""
    return df.select(*[df[c] for c in columns])


#: What operators remember in a worker, by module. A worker serves stages in turn; another operator's memory is dropped when a task starts.
WORKER_CACHES: dict[str, dict] = {}


def release_memory() -> None:
    """Give memory that this worker has freed back to the system, so that what an earlier task needed does not add to this one's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def forget(keep: str | None = None) -> None:
    """Drop what operators but ``keep`` remember in this worker."""
    for module, cache in WORKER_CACHES.items():
        if module != keep:
            cache.clear()
    release_memory()


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = 16 << 20, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one holds about ``most`` bytes of text; a longer text is a batch of its own."""
    forget(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session that names none gets one of its own, as in tests.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"sowmill-{os.getpid()}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written once in the shared folder and read back.

    Unlike ``DataFrame.checkpoint`` this computes the rows a single time, keeps
    them compressed, and leaves their size to the optimizer.
    """
    path = f"{work_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by key to as many partitions as the session shuffles to, which are not joined to fewer ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
