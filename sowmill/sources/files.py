"""File sources and sinks."""

from __future__ import annotations

import io
import itertools
import os
import re
import shutil
import unicodedata
import urllib.parse
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from sowmill import schemas

DOCUMENT_EXTENSIONS = ["pdf", "docx", "doc"]
#: Tasks that write small files, for each core of the session.
FILE_TASKS_PER_CORE = 2
#: Bytes of file content that a task holds at a time, but for a larger file.
READ_BYTES = 4 << 20
#: Files that Hadoop decompresses by their names.
_COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".xz")


# --- folders of very many files -----------------------------------------------------------


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path of a folder in a mounted file system, None in another store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = target.makeQualified(store.getUri(), store.getWorkingDirectory()).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    other = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return other and not name.startswith(("_common_metadata", "_metadata"))


def _shown(name: bytes) -> bytes:
    """A file name as Spark's readers tell it, by the rules of URIs."""
    plain = lambda c: c.isalnum() if c.isascii() else unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
    return "".join(c if plain(c) else urllib.parse.quote(c, safe="-_!.~'()*,;:$&+=@") for c in name.decode(errors="replace")).encode()


def _wanted(folder: str, pattern: str, folders: bool = False) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as entries:
        for entry in entries:
            if not _hidden(entry.name) and (entry.is_dir() if folders else re.fullmatch(pattern, entry.name, re.DOTALL)):
                yield entry


def _names(spark: SparkSession, folder: str, pattern: str, folders: bool = False) -> DataFrame:
    """Names (as bytes) of the files or folders in a mounted folder, listed by a task and dealt out; the driver holds none of them."""
    def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = []
        for entry in _wanted(folder, pattern, folders):
            names.append(os.fsencode(entry.name))
            if len(names) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["name"])
                names = []
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], names=["name"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name binary").repartition(_file_tasks(spark))


def _whole_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(_file, value): name and whole text of the files of a folder that match ``glob``; empty files give no row.

    Spark's reader keeps the status of every file on the driver, so the files
    of a mounted folder are listed by a task and read by others. Folders in
    folders, compressed files, other stores and paths with wildcards are left
    to Spark's reader.
    """
    folder = _mounted(spark, path)
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    if folder is None or not os.path.isdir(folder) or any(e.is_dir() or e.name.endswith(_COMPRESSED) for e in _wanted(folder, ".*")):
        return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), "value")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], pa.binary()) for k in (0, 1)], names=["_file", "value"])

        for names in batches:
            for name in names.column(0).to_pylist():
                with open(os.path.join(os.fsencode(folder), name), "rb") as source:
                    data = source.read()
                if not data:
                    continue
                if held and size + len(data) > READ_BYTES:
                    yield batch()
                    held, size = [], 0
                held.append((_shown(name), data))
                size += len(data)
        if held:
            yield batch()

    found = _names(spark, folder, pattern).mapInArrow(read, "_file binary, value binary")
    return found.select(F.col("_file").cast("string"), F.col("value").cast("string"))


# --- records and texts ------------------------------------------------------------------


def parse_sow_json(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Parse one JSON object per row into the record columns; bad text shows in ``_corrupt_record``."""
    rec = F.from_json(F.col(text), schemas.SOW_RECORD + ", _corrupt_record string",
                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return df.select(*keep, rec.alias("_r")).select(*keep, "_r.*")


def read_sow_json(spark: SparkSession, path: str, corrupt: bool = False, glob: str = "*.json") -> DataFrame:
    """Records of all ``glob`` files of a folder, one object per file; unreadable ones are skipped."""
    parsed = parse_sow_json(_whole_files(spark, path, glob), "value", ["_file"])
    parsed = parsed.withColumn("file_name", F.coalesce("file_name", "_file"))
    bad = F.col("_corrupt_record").isNotNull()
    return parsed.where(bad) if corrupt else parsed.where(~bad).drop("_corrupt_record", "_file")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file, text), one row per file."""
    return _whole_files(spark, path, glob).select(F.col("_file").alias("file"), F.col("value").alias("text"))


def has_extension(name: Column, extensions: list[str]) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions) & name.contains(".")


def list_documents(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Document files of a folder (file, length, path); the content column is never read."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return (files.where(has_extension(F.col("path"), extensions or DOCUMENT_EXTENSIONS))
            .select(name.alias("file"), "length", "path"))


def read_binary(spark: SparkSession, path: str, glob: str = "*.{pdf,docx}") -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def sniff_format(content: Column) -> Column:
    """pdf or docx by the first bytes, null for anything else."""
    return (F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
            .when(F.substring(content, 1, 2) == F.lit(b"PK"), "docx"))


def _document_xml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        xml, error = [], []
        for data in pdf["content"]:
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    xml.append(z.read("word/document.xml").decode("utf-8", errors="ignore"))
                error.append(None)
            except Exception as e:  # noqa: BLE001  a bad file becomes an error row
                xml.append(None)
                error.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"file": pdf["file"], "xml": xml, "error": error})


def docx_text(binary: DataFrame) -> DataFrame:
    """(file, text, error) from (file, content). Only the unzip runs in Python; tags go in Catalyst."""
    raw = binary.select("file", "content").mapInPandas(_document_xml, "file string, xml string, error string")
    spaced = F.regexp_replace("xml", r"<[^>]+>", " ")
    return raw.select("file", F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")).alias("text"), "error")


def read_org_chart(spark: SparkSession, path: str) -> DataFrame:
    """Look-up chart (key, chart_title, chart_level) from a CSV found by header fragments.

    The first row of a key wins; file order is kept by the position inside the
    file, which is one small file and therefore one partition.
    """
    raw = spark.read.option("header", True).csv(path)
    plain = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}

    def column(*parts: str) -> str | None:
        return next((real for part in parts for low, real in plain.items() if part in low), None)

    title, level = column("title", "role"), column("level")
    canonical = column("normalized", "canonical") or title
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    named = F.coalesce(text(canonical), text(title))
    rows = (raw.withColumn("_n", F.monotonically_increasing_id())
            .select("_n", named.alias("t"), text(level).try_cast("int").alias("l"),
                    F.array(F.struct(F.lit(0).alias("i"), F.lower(named).alias("k")),
                            F.struct(F.lit(1).alias("i"), F.lower(text(title)).alias("k"))).alias("_keys"))
            .where(F.col("t").isNotNull()))
    keyed = rows.select("*", F.explode("_keys").alias("_key")).where(F.col("_key.k").isNotNull())
    return (keyed.groupBy(F.col("_key.k").alias("key"))
            .agg(F.min_by(F.struct("t", "l"), F.struct("_n", "_key.i")).alias("_v"))
            .select("key", F.col("_v.t").alias("chart_title"), F.col("_v.l").alias("chart_level")))


# --- sinks -------------------------------------------------------------------------------------


def _file_tasks(spark: SparkSession) -> int:
    """Tasks that write small files: these cost their creation, not their bytes, so the size of the input must not decide."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), FILE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _in_place(writer: DataFrameWriter) -> DataFrameWriter:
    """A task moves its own files into place, which the driver would otherwise do one by one; a retry writes the same names again."""
    return writer.option("mapreduce.fileoutputcommitter.algorithm.version", 2)


def write_tables(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Every table in its own folder of CSV parts; the cells are columns c0, c1, ..."""
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    columns = [f"c{i}" for i in range(width)]
    named = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in ("file", "table_index")]
    flat = rows.select(*named, "row_index", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    dealt = flat.repartition(_file_tasks(rows.sparkSession), "file", "table_index")
    ordered = dealt.sortWithinPartitions("file", "table_index", "row_index").drop("row_index")
    if not columns or not _own_folders(ordered, columns, path):
        _in_place(ordered.write.mode(mode)).partitionBy("file", "table_index").csv(path, emptyValue="")


#: What Spark names the folder of a null or empty value.
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _own_folders(ordered: DataFrame, columns: list[str], path: str) -> bool:
    """The CSV part of each table in a folder ``file=.../table_index=...`` of a new mounted folder; False where that is not what ``path`` is.

    Spark's writer sends the name of every folder to the driver, which keeps
    them. Here tasks write the lines themselves, under the same names.
    """
    folder, job = _new_folder(ordered.sparkSession, path), uuid.uuid4().hex
    if folder is None:
        return False
    catalog = ordered.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    escaped = {i: catalog.escapePathName(chr(i)) for i in range(1, 128)}
    lines = ordered.select(F.col("file").cast("string"), F.col("table_index").cast("string"), F.to_csv(F.struct(*columns), {"emptyValue": ""}).alias("line"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, places, last, out = f"{folder}/_temporary/{task.taskAttemptId()}", [], None, None
        os.makedirs(own)
        for batch in batches:
            for file, table, line in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                place = tuple(v.translate(escaped) if v else _NO_VALUE for v in (file, table))
                if place != last:
                    if out:
                        out.close()
                    out, last = open(f"{own}/{len(places)}", "wb"), place
                    places.append(place)
                out.write(line.encode() + b"\n")
        if out:
            out.close()
        for i, (file, table) in enumerate(places):
            to = f"{folder}/file={file}/table_index={table}"
            os.makedirs(to, exist_ok=True)
            os.replace(f"{own}/{i}", f"{to}/part-{task.partitionId():05d}-{job}.c000.csv")
        os.rmdir(own)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(places)], pa.int64())})

    _in_new_folder(lines, write, folder)
    return True


def read_tables(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, table_index, c0, c1, ...) of the tables that ``write_tables`` wrote, with ``width`` cells a row; folders are listed and read by tasks, not by the driver."""
    cells = ", ".join(f"c{i} string" for i in range(width))
    folder = _mounted(spark, path)
    if folder is None:
        return spark.read.schema(f"{cells}, file string, table_index int").csv(path).select("file", "table_index", *[f"c{i}" for i in range(width)])
    catalog = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    plain = {e: chr(i) for i in range(1, 128) if (e := catalog.escapePathName(chr(i))) != chr(i)}

    def value(name: str) -> str | None:
        found = re.sub("%..", lambda m: plain.get(m[0].upper(), m[0]), name.split("=", 1)[1])
        return None if found == _NO_VALUE else found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, str | None, bytes]] = []
        for names in batches:
            for name in names.column(0).to_pylist():
                file = os.fsdecode(name)
                for table in _wanted(f"{folder}/{file}", "", folders=True):
                    for part in _wanted(table.path, r".*"):
                        with open(part.path, "rb") as source:
                            # Spark's reader passes over lines of blanks.
                            for line in itertools.chain.from_iterable(x.splitlines() for x in source):
                                if line.strip(bytes(range(33))):
                                    held.append((value(file), value(table.name), line))
                                if len(held) == 10_000:
                                    yield batch(held)
                                    held = []
        yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary()))], names=["file", "t", "line"])

    lines = _names(spark, folder, "", folders=True).mapInArrow(read, "file string, t string, line binary")
    return lines.select("file", F.col("t").cast("int").alias("table_index"), F.from_csv(F.col("line").cast("string"), cells).alias("_r")).select("file", "table_index", "_r.*")


def _small_files(df: DataFrame, per_file: int) -> DataFrameWriter:
    """Writer of files of ``per_file`` rows each, or of one file per task for 0."""
    if per_file < 1:
        return df.write
    return _in_place(df.repartition(_file_tasks(df.sparkSession)).write.option("maxRecordsPerFile", per_file))


def _new_folder(spark: SparkSession, path: str) -> str | None:
    """The path of a folder to make in a mounted file system, None where it is there or in another store."""
    folder = _mounted(spark, path)
    return None if folder is None or os.path.lexists(folder) else folder


def _in_new_folder(rows: DataFrame, write, folder: str) -> None:
    """Runs ``write`` in all tasks, which put their files into ``folder``."""
    os.makedirs(folder)
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    shutil.rmtree(f"{folder}/_temporary", ignore_errors=True)
    open(f"{folder}/_SUCCESS", "wb").close()


def _own_files(lines: DataFrame, path: str, extension: str) -> bool:
    """Each line in a file of its own in a new folder that all executors mount; False where the folder is there or in another store.

    Hadoop starts two ``chmod`` processes for every file it makes on a mounted
    folder unless its native library is there, so tasks make the files
    themselves. They make them in a folder of their attempt and move them into
    place at the end; a retry writes the same names again.
    """
    folder, job = _new_folder(lines.sparkSession, path), uuid.uuid4().hex
    if folder is None:
        return False

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own, names = f"{folder}/_temporary/{task.taskAttemptId()}", []
        os.makedirs(own)
        for batch in batches:
            for line in batch.column(0):
                names.append(f"part-{task.partitionId():05d}-{job}-c{len(names):03d}.{extension}")
                with open(f"{own}/{names[-1]}", "wb") as out:
                    out.write((line.as_py() or "").encode() + b"\n")
        for name in names:
            os.replace(f"{own}/{name}", f"{folder}/{name}")
        os.rmdir(own)
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(names)], pa.int64())})

    _in_new_folder(lines.repartition(_file_tasks(lines.sparkSession)), write, folder)
    return True


def write_json(df: DataFrame, path: str, mode: str = "error", per_file: int = 0) -> None:
    """One JSON object per row, in lines of part files, or in files of ``per_file`` objects each: 1 writes a file per document."""
    if per_file != 1 or not _own_files(df.select(F.to_json(F.struct("*"))), path, "json"):
        _small_files(df, per_file).mode(mode).json(path)


def write_texts(df: DataFrame, text: str, path: str, mode: str = "error", per_file: int = 0) -> None:
    """One text per row, each followed by a line feed, in part files or in files of ``per_file`` texts each."""
    lines = df.select(F.col(text).alias("value"))
    if per_file != 1 or not _own_files(lines, path, "txt"):
        _small_files(lines, per_file).mode(mode).text(path)


def combine(spark: SparkSession, path: str, schema: str, glob: str = "*.json", skip: str = "_combined", multi_line: bool = True) -> DataFrame:
    """All output files of a folder in one table with their file name; earlier combined files are left out.

    A file is one object, or one object per line where ``multi_line`` is off.
    """
    df = spark.read.schema(schema).option("multiLine", multi_line).option("pathGlobFilter", glob).json(path)
    return (df.withColumn("source_file", F.col("_metadata.file_name"))
            .where(~F.col("source_file").startswith(skip)))


def latest_run(df: DataFrame) -> DataFrame:
    """Rows of the newest run, the one whose file name sorts last (column ``source_file``)."""
    newest = df.agg(F.max("source_file").alias("source_file"))
    return df.join(newest, "source_file", "left_semi")
