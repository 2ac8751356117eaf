"""Vector arithmetic and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sowmill.operators.ranking import top_per_group

BLOCK_BYTES = 1 << 20  # bytes of vectors in one block of documents or queries
DIGITS = 9  # scores are compared after rounding, so equal vectors tie in every partition


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays clamped to 0..1; 0 for empty, unequal or zero-length vectors."""
    d = lambda x: x.cast("double")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + d(x) * d(x)))
    value = F.try_divide(dot, norm(a) * norm(b))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & value.isNotNull()
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0))


def _unit(vectors: pa.Array, size: int) -> np.ndarray:
    """Matrix of unit rows; a row of another size, a null or one without length becomes zero."""
    m = np.zeros((len(vectors), size))
    lengths = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    some = np.flatnonzero(lengths == size)
    if len(some) and size:
        m[some] = vectors.take(pa.array(some)).flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(len(some), size)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _codes(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where values are; nulls are -1."""
    both = pa.chunked_array([left.cast(pa.string()), right.cast(pa.string())]).combine_chunks().dictionary_encode()
    codes = both.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[:len(left)], codes[len(left):]


def _packed(df: DataFrame, name: str, block_bytes: int) -> DataFrame:
    """Rows of a table in blocks of about ``block_bytes``, each written as one value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * block_bytes / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return df.mapInArrow(run, f"{name} binary")


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


class _Best:
    """The best ``k`` names of every query that a task has met: rows of query, key, name and score."""

    def __init__(self, k: int):
        self.k, self.table, self.fresh = k, None, []

    def add(self, table: pa.Table) -> None:
        self.fresh.append(table)
        if sum(t.num_rows for t in self.fresh) > 1 << 18:
            self.settle()

    def settle(self) -> pa.Table | None:
        parts = ([] if self.table is None else [self.table]) + self.fresh
        if parts:
            t = pa.concat_tables(parts).combine_chunks()
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("score", "descending"), ("key", "ascending")], null_placement="at_start"))
            query, name = (t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for c in ("q", "name"))
            _, first = np.unique(query << 32 | name, return_index=True)
            first.sort()
            rank = np.arange(len(first)) - np.searchsorted(query[first], query[first])
            self.table, self.fresh = t.take(pa.array(first[rank < self.k])), []
        return self.table


def nearest_join(docs: DataFrame, asked: DataFrame, k: int, key: str, query_key: str, vectors: list[tuple[str, str, float]], name: str | None = None,
                 same: tuple[tuple[str, str], ...] = (), differ: tuple[tuple[str, str], ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_key, key, score, rank): the ``k`` documents most like each asked row, for any number of asked rows.

    ``vectors`` names (document vector, query vector, weight); the score is the
    weighted sum of cosines, compared after rounding. ``name`` keeps the best
    document of each name before the cut (a blank name stands for itself).
    ``same`` and ``differ`` name (document column, query column) that must be
    equal, where the asked row has a value, or unlike. Ties go to the smaller
    key. A missing vector, one of another size or without length has cosine 0;
    asked rows should have keys of their own.

    Both sides are packed into blocks that meet pairwise, as matrices: a task
    keeps ``k`` rows per query it has met, and these alone are shuffled.
    """
    d_cols = [c for c, _, _ in vectors] + [c for c, _ in (*same, *differ)]
    q_cols = [c for _, c, _ in vectors] + [c for _, c in (*same, *differ)]
    own = F.col(key).cast("string") if name is None else F.coalesce(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.col(key).cast("string"))
    left = docs.select(F.col(key).alias("key"), own.alias("name"), *[F.col(c).alias(f"d{i}") for i, c in enumerate(d_cols)])
    right = asked.select(F.col(query_key).alias("q"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(q_cols)])
    schema = StructType([StructField(query_key, right.schema["q"].dataType), StructField(key, left.schema["key"].dataType),
                         StructField("_name", left.schema["name"].dataType), StructField("score", DoubleType())])
    weights, n_same = [w for _, _, w in vectors], len(same)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for batch in batches:
            for d_raw, q_raw in zip(batch.column(0), batch.column(1), strict=True):
                best.add(_block_best(_unpacked(d_raw.as_py()), _unpacked(q_raw.as_py()), k, weights, n_same))
        found = best.settle()
        if found is not None:
            for part in found.select(["q", "key", "name", "score"]).rename_columns(schema.names).to_batches():
                yield part

    pairs = _packed(left, "d", block_bytes).crossJoin(_packed(right, "q", block_bytes))
    local = pairs.mapInArrow(search, schema)
    one = local.groupBy(query_key, "_name").agg(F.min_by(F.struct(key, "score"), F.struct(-F.col("score"), F.col(key))).alias("_b")).select(query_key, "_b.*")
    return top_per_group(one, [query_key], [F.col("score").desc(), F.col(key)], k)


def _block_best(docs: pa.RecordBatch, asked: pa.RecordBatch, k: int, weights: list[float], n_same: int) -> pa.Table:
    """Rows (q, key, name, score) that may be among the best of their query in this pair of blocks, with exact scores."""
    exact = []
    rough = np.zeros((asked.num_rows, docs.num_rows))
    for i, weight in enumerate(weights):
        d, q = docs.column(f"d{i}"), asked.column(f"q{i}")
        sizes = pc.list_value_length(q).fill_null(0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]).tolist():
            rows, every = np.flatnonzero(sizes == size), _unit(d, size)
            unit = _unit(q.take(pa.array(rows)), size)
            rough[rows] += weight * np.clip(unit @ every.T, 0.0, 1.0)
            exact.append((weight, rows, unit, every))
    allowed = np.ones(rough.shape, dtype=bool)
    for i in range(len(weights), docs.num_columns - 2):
        d_code, q_code = _codes(docs.column(f"d{i}"), asked.column(f"q{i}"))
        equal = q_code[:, None] == d_code[None, :]
        blank = (q_code < 0)[:, None]
        allowed &= (equal | blank) if i - len(weights) < n_same else ~equal | blank | (d_code < 0)[None, :]
    rough[~allowed] = -np.inf
    names = docs.column("name").dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(names, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(names[order]) != 0))
    of_name = np.maximum.reduceat(rough[:, order], starts, axis=1)
    last = np.partition(of_name, -k, axis=1)[:, -k] if k < of_name.shape[1] else np.full(len(rough), -np.inf)
    # The scores of matrix products end in other digits than those of single rows, so near ties stay until exact scores decide.
    least = np.where(of_name >= last[:, None] - 1e-8, of_name - 1e-8, np.inf)
    place = np.zeros(len(names), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(names))))
    query, doc = np.nonzero((rough >= least[:, place]) & allowed)
    score = np.zeros(len(query))
    for weight, rows, unit, every in exact:
        at = np.full(asked.num_rows, -1)
        at[rows] = np.arange(len(rows))
        some = np.flatnonzero(at[query] >= 0)
        for start in range(0, len(some), 1 << 14):
            part = some[start:start + (1 << 14)]
            score[part] += weight * np.clip((every[doc[part]] * unit[at[query[part]]]).sum(axis=1), 0.0, 1.0)
    q, d = pa.array(query), pa.array(doc)
    return pa.table([asked.column("q").take(q), docs.column("key").take(d), docs.column("name").take(d), pa.array(np.round(score, DIGITS))], names=["q", "key", "name", "score"])


def knn(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id",
        query_vector: str = "query_vector", where: Column | None = None, skip: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact (query_id, key, score, rank): the ``k`` documents with the highest cosine per query, after the first ``skip``.

    ``where`` filters the documents. Keys may have any type. A null query
    vector has no neighbours; a null document vector has cosine 0.
    """
    docs = docs if where is None else docs.where(where)
    asked = queries.where(F.col(query_vector).isNotNull())
    best = nearest_join(docs, asked, skip + k, key, query_key, [(vector, query_vector, 1.0)], block_bytes=block_bytes)
    return best if not skip else best.where(F.col("rank") > skip)
