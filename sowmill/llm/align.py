"""Alignment of the ids of two tokenizers by the bytes that their tokens cover.

The ends of the tokens of both sides are byte offsets in the same text. A
dictionary from end to index on each side, and the intersection of their keys,
give the offsets where both sides end a token; in order, they cut both lists
of ids into groups. A link is a pair of tokens that end together, the last
ones of a group. Links are counted over the corpus by pair of ids.

Neither tokenizer joins bytes across the start of a run of blanks, so a text
is aligned by its words, which a worker remembers, and words that are new to a
batch are aligned as one long text.

Two linked tokens end at one byte, so one is the end of the other: a token of n
bytes is linked with at most n different strings that are shorter, and the
table of pairs is bounded by the bytes of both vocabularies (``most_pairs``),
however large the corpus.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.blocks import merged, packed, unpacked
from sowmill.llm.common import WORKER_CACHES, chunks, forget, keyed
from sowmill.llm.words import Memo, byte_level_bytes, flat_ids, ids_of_parts

#: Words a worker remembers at most.
MEMO_WORDS = 150_000
#: Bytes of text of one block.
BLOCK_BYTES = 2 << 20

_ALIGNERS: dict[tuple[str, str], Aligner] = {}
WORKER_CACHES[__name__] = _ALIGNERS


def byte_bpe(path: str):
    """Tokenizer that takes special tokens in a text as plain text, and the bytes of each id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    specials = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return tokenizer, [b"" if n is None or n in specials else byte_level_bytes(n) for n in names]


def piece_bpe(path: str):
    """Sentence-piece model, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            table.append(b"")
        elif model.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            table.append(piece.replace("▁", " ").encode())
        if "▁" in piece.lstrip("▁"):
            raise ValueError("a piece that goes on after a blank cannot be found by words")
    return model, table


def most_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """Pairs of ids that can end together: one is the end of the other."""
    count: dict[bytes, int] = {}
    for token in a_bytes:
        count[token] = count.get(token, 0) + 1
    pairs, shorter = 0, {t for t in a_bytes if t}
    for token in b_bytes:
        pairs += sum(count.get(token[k:], 0) for k in range(len(token)))
    ends: dict[bytes, int] = {}
    for token in b_bytes:
        ends[token] = ends.get(token, 0) + 1
    for token in shorter:
        pairs += count[token] * sum(ends.get(token[k:], 0) for k in range(1, len(token)))
    return pairs


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """For each offset where both sides end a token, in order, how many tokens of either side end there or before."""
    a_index = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True))
    b_index = dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_index.keys() & b_index.keys())
    return [a_index[e] for e in common], [b_index[e] for e in common]


class Aligner:
    """Ids and groups of texts by two tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = byte_bpe(a_path), piece_bpe(b_path)
        self.a_size, self.b_size = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        self.memo = Memo(self._parts, self._texts, [np.int32, np.int32, np.int32, np.int32, np.int8], MEMO_WORDS)

    def _parts(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._aligned(parts, ids_of_parts(self.a, self.a_size, parts))

    def _texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._aligned(texts, flat_ids([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]))

    def _aligned(self, parts: list[str], a: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids, group sizes and a mark (1: the bytes are kept) of parts that start with a blank. The empty part has nothing and keeps its bytes."""
        b = flat_ids(self.b.encode([p[1:] for p in parts], num_threads=1))
        raw = [p.encode() for p in parts]
        kept = self._kept(raw, a, b)
        if not kept.all():
            a, b = ((ids[np.repeat(kept, counts)], np.where(kept, counts, 0)) for ids, counts in (a, b))
        (a_ids, a_counts), (b_ids, b_counts) = a, b
        if len(a_ids) and (self.a_size[a_ids].min() < 1 or self.b_size[b_ids].min() < 1):
            raise ValueError("a token without bytes has no place in the text")
        # Every part ends a token of both sides, so the parts can be aligned as one text.
        a_cuts, b_cuts = common_cuts(np.cumsum(self.a_size[a_ids]).tolist(), np.cumsum(self.b_size[b_ids]).tolist())
        groups = np.diff(np.searchsorted(a_cuts, np.append(0, np.cumsum(a_counts)), side="right"))
        ones = np.ones(len(parts), dtype=np.int64)
        return [(a_ids, a_counts), (b_ids, b_counts), (np.diff(a_cuts, prepend=0), groups), (np.diff(b_cuts, prepend=0), groups), (kept, ones)]

    def _kept(self, raw: list[bytes], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Parts whose bytes both sides give back."""
        out = np.ones(len(raw), dtype=bool)
        joined, cuts = b"".join(raw), np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        for (ids, counts), table, size in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            tokens, stops = [table[i] for i in ids.tolist()], np.cumsum(counts)
            if not np.array_equal(np.append(0, np.cumsum(size[ids]))[stops], cuts) or b"".join(tokens) != joined:
                out &= [b"".join(tokens[start:stop]) == r for r, start, stop in zip(raw, (stops - counts).tolist(), stops.tolist(), strict=True)]
        return out

    def of_texts(self, texts: pa.Array) -> list[list[np.ndarray]]:
        """Columns of ``align``: ids of both sides and group sizes of both sides, empty for texts whose bytes a side does not keep."""
        empty = np.zeros(0, dtype=np.int32)
        found = self.memo.of_texts(pa.array([" " + t if t else "" for t in texts.to_pylist()], pa.string()))
        bad = [not k.all() for k in found.pop()]
        return [[empty if b else v for v, b in zip(column, bad, strict=True)] for column in found]


def _aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def alignment_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts aligned by a byte-level tokenizer (of a blank and the text) and a piece model (which adds the blank), in packed blocks.

    A block has the ids of its documents, how many ids and groups each has
    (``n_a``, ``n_b``, ``n_groups``), and ``a_ids``, ``b_ids``, ``a_sizes`` and
    ``b_sizes``: the ids of both sides, and how many ids of either side each
    group has. A null or empty text, or one whose bytes either tokenizer
    changes, has none. Null ids, repeated rows and very long texts are rows
    like any other; an empty table gives no rows; other columns are ignored.
    """
    source = keyed(docs, id_col, text_col)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField(id_col, T.ArrayType(source.schema[id_col].dataType)), *[T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups")],
                           *[T.StructField(c, T.BinaryType()) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_path, b_path)
        for batch in merged(chunks(batches, text_col, BLOCK_BYTES, keep=__name__), text_col, BLOCK_BYTES):
            columns = aligner.of_texts(batch.column(1))
            counts = [pa.array([[len(v) for v in columns[k]]], pa.list_(pa.int64())) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), *counts,
                 *[pa.array([packed(np.concatenate(c).astype(np.int32))], pa.binary()) for c in columns]], names=schema.names)

    return source.mapInArrow(run, schema)


class _Block:
    """Ids and groups of the documents of a block."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.keys = batch.column(0)[row].values
        self.n_a, self.n_b, self.n_groups = (batch.column(k)[row].values.to_numpy() for k in (1, 2, 3))
        self.a, self.b, self.a_sizes, self.b_sizes = (unpacked(batch.column(k)[row].as_py(), np.int32) for k in (4, 5, 6, 7))

    def links(self) -> np.ndarray:
        """Pairs of ids that end a group, as one number."""
        return self.a[np.cumsum(self.a_sizes) - 1].astype(np.int64) << 32 | self.b[np.cumsum(self.b_sizes) - 1].astype(np.int64)


def align(blocks: DataFrame) -> DataFrame:
    """One row per document of ``alignment_blocks``: its id, ``a_ids``, ``b_ids``, and the sizes of its groups in either, ``a_sizes`` and ``b_sizes``.

    The last ids of a group are linked.
    """
    key, kind = blocks.schema[0].name, blocks.schema[0].dataType.elementType
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                lists = ((block.a, block.n_a), (block.b, block.n_b), (block.a_sizes, block.n_groups), (block.b_sizes, block.n_groups))
                yield pa.RecordBatch.from_arrays(
                    [block.keys, *[pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(v)) for v, n in lists]], names=schema.names)

    return blocks.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Rows ``a``, ``b``, ``links``: how many links of all documents hold this pair of ids. A task sums its own first."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                codes, counts = np.unique(_Block(batch, row).links(), return_counts=True)
                known, place = np.unique(np.concatenate([known, codes]), return_inverse=True)
                total = np.bincount(place, weights=np.concatenate([total, counts]), minlength=len(known)).astype(np.int64)
        if len(known):
            yield pa.RecordBatch.from_arrays([pa.array(known >> 32), pa.array(known & 0xFFFFFFFF), pa.array(total)], names=["a", "b", "links"])

    return blocks.mapInArrow(run, "a long, b long, links long").groupBy("a", "b").agg(F.sum("links").alias("links"))


def group_text(block: _Block, first: int, last: int, starts: list[np.ndarray], marks: list[str]) -> str:
    """Groups of the documents from ``first`` to ``last``, as ``a1,a2|b1;a3|b2;``: ids of a group by commas, sides by a bar, groups by semicolons."""
    a, b = block.a[starts[0][first]:starts[0][last]], block.b[starts[1][first]:starts[1][last]]
    a_sizes, b_sizes = (s[starts[2][first]:starts[2][last]] for s in (block.a_sizes, block.b_sizes))
    a_place = np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
    b_place = np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)
    row = np.zeros(len(a) + len(b), dtype=np.int64)
    row[a_place], row[b_place] = a.astype(np.int64) * 3, b.astype(np.int64) * 3
    row[a_place[np.cumsum(a_sizes) - 1]] += 1
    row[b_place[np.cumsum(b_sizes) - 1]] += 2
    for i in range(len(marks) // 3, int(row.max(initial=-1)) // 3 + 1):
        marks += f"{i},", f"{i}|", f"{i};"
    return "".join([marks[i] for i in row.tolist()])


def alignment_digest(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of tokens, groups and links of each document, its links by ``pairs``, and the checksum of its groups.

    ``pairs`` is brought to every task: it has at most ``most_pairs`` rows of
    17 bytes, which the vocabularies alone bound.
    """
    best = pairs.groupBy("b").agg(F.max("links").alias("most"))
    marked = pairs.join(best, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")).toPandas()
    codes = marked["a"].to_numpy().astype(np.int64) << 32 | marked["b"].to_numpy().astype(np.int64)
    order = np.argsort(codes)
    shared = blocks.sparkSession.sparkContext.broadcast((codes[order], marked["links"].to_numpy()[order], marked["best"].to_numpy()[order]))
    key, kind = blocks.schema[0].name, blocks.schema[0].dataType.elementType
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in longs], T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known, links, is_best = shared.value
        marks: list[str] = []
        for batch in batches:
            for row in range(batch.num_rows):
                block = _Block(batch, row)
                starts = [np.append(0, np.cumsum(n)) for n in (block.n_a, block.n_b, block.n_groups)]
                place = np.searchsorted(known, block.links())
                sums = [np.diff(np.append(0, np.cumsum(values[place]))[starts[2]]) for values in (is_best, links)]
                digests = [hashlib.sha256(group_text(block, k, k + 1, starts, marks)[:-1].encode()).hexdigest() if n else "" for k, n in enumerate(block.n_groups.tolist())]
                numbers = [block.n_a, block.n_b, block.n_groups, block.n_groups, *sums]
                yield pa.RecordBatch.from_arrays([block.keys, *[pa.array(c.astype(np.int64)) for c in numbers], pa.array(digests, pa.string())], names=schema.names)

    return blocks.mapInArrow(run, schema)
