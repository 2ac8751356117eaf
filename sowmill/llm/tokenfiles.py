"""Token ids of documents as ORC files.

One row is a document, in ascending order of ids over all files. The ids of a
document are an integer list, which ORC writes with run-length encoding in
stripes; the stripes carry row indexes and Bloom filters on the document id,
so a reader of some documents skips the others, and stripes are read in
parallel. Beside the files lies a manifest with one row per file: its range of
ids, its documents and tokens, and the tokens of all files before it. Places
in a file are written with each row, so a document's place among all tokens
needs only the manifest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm import words
from sowmill.llm.common import chunks, keyed
from sowmill.llm.words import as_list, byte_memo

#: Words a worker remembers at most.
MEMO_WORDS = 500_000
#: Bytes of text of one file, about.
FILE_BYTES = 32 << 20

def file_schema(id_type: T.DataType, id_col: str = "doc_id") -> T.StructType:
    return T.StructType([
        T.StructField("file", T.LongType()), T.StructField(id_col, id_type), T.StructField("at", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                      file_bytes: int = FILE_BYTES, stripe_bytes: int = 8 << 20, index_rows: int = 1000) -> None:
    """Write the ids of every text, and ``end_id`` after each, below ``path``.

    Rows go to files by ranges of ``id_col``; rows of one id lie in the order
    of the input, and an id with very many rows spreads over several files. A
    null or empty text is the end id alone; null ids come first; repeated rows
    are written as often as they come; an empty table gives an empty file set.
    Other columns are ignored. The special token's string in a text is that
    token. ``path`` gets the folders ``ids`` and ``manifest``, and must not
    exist. Files are ranges of about ``file_bytes`` of text, and a task holds a
    batch of documents at a time.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 1 << 20 else 1, math.ceil(size / file_bytes))
    source = keyed(docs, id_col, text_col).toDF("id", "text").withColumn("place", F.monotonically_increasing_id())
    ordered = source.repartitionByRange(files, "id", "place").sortWithinPartitions("id", "place").select("id", "text")
    schema = file_schema(source.schema["id"].dataType, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, file, at = byte_memo(tokenizer_path, MEMO_WORDS), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=np.int32)
        for batch in chunks(batches, "text", 8 << 20, keep=words.__name__):
            ids = memo.of_texts(batch.column(1).fill_null(""))[0]
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) + 1
            stops = at + np.cumsum(lengths)
            column = as_list([part for own in ids for part in (own, end)], pa.int32()).values
            column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), column)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), file), pa.int64()), batch.column(0), pa.array(stops - lengths), pa.array(lengths), column], names=schema.names)
            at = int(stops[-1])

    writer = ordered.mapInArrow(run, schema).write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
    writer = writer.option("orc.rows.between.memory.checks", min(index_rows, 1000))
    writer.option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01").option("compression", "zstd").orc(f"{path}/ids")
    rows = spark.read.schema(schema).orc(f"{path}/ids")
    found = rows.groupBy("file").agg(F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).coalesce(1).write.orc(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``file``, ``first_id``, ``last_id``, ``docs``, ``tokens``, ``before`` (tokens of all files before it)."""
    return spark.read.orc(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, ids: list | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``start``, ``n_tokens`` and ``ids`` of all documents, or of those with an id in ``ids``.

    Wanted ids reach the reader as a filter, which skips files and stripes by
    their smallest and largest id and rows by Bloom filters. Their number
    should be small; join a table of ids to the result otherwise.
    """
    rows, manifest = spark.read.orc(f"{path}/ids"), read_manifest(spark, path)
    if ids is not None:
        rows = rows.where(F.col(id_col).isin(ids))
    return rows.join(manifest.select("file", "before"), "file").select(id_col, (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, ``start``, ``n_tokens`` counted from the ids, and ``ids_crc32`` of what was read."""
    source = rows.select(rows[id_col], "start", "ids")
    schema = T.StructType([source.schema[id_col], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            offsets = ids.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets) // 4), pa.array(sums, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
