"""Language-model scores by deleted interpolation of word n-grams.

The probability of a token after another mixes three estimates: its share
after that context, its share of all tokens, and one in V + 1. The weights
depend on how often the context was seen (buckets by powers of two) and are
learned by expectation-maximisation on counts from which the token itself is
deleted (leave one out).

Counting goes by blocks of documents. A block keeps its tokens as numbers and
its distinct words as hashes. It sends its distinct words and word pairs, as
sorted hashes cut by range, once each; whoever owns a range adds up the counts
of all blocks and answers each block with the totals in the order of its own
hashes, so that no key travels back. Ranges are many and equal, whatever
words are frequent, because a block sends a key once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.blocks import merged, packed, packed_sorted, unpacked, unpacked_sorted
from sowmill.llm.common import checkpointed, chunks, held_out, keyed

BLOCK_BYTES = 16 << 20
#: Text bytes whose keys one range holds, about.
RANGE_BYTES = 8 << 20
#: Bits that a hash of a word pair has beyond those that number the tokens: a pair shares its hash with odds below 2 ** -SLACK.
SLACK = 20
#: Steps an octave in which probabilities are told apart when the weights are learned.
STEPS = 8
ROUNDS = 60

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = np.uint64(xxhash.xxh64_intdigest(b"", seed=1))
_BEGIN = np.uint64(xxhash.xxh64_intdigest(b"", seed=2))
WORDS, PAIRS = 0, 1


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in blocks: ``block`` (hash of its content), ids, held-out marks, token counts, tokens as places in ``words``."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
        T.StructField("words", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 0
        task = TaskContext.get().partitionId()
        for batch in merged(chunks(batches, text_col, block_bytes), text_col, block_bytes):
            lengths, places, order = [], {}, []
            number += 1
            numbered = places.setdefault
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                lengths.append(len(found) + 1)
                order.append(np.fromiter((numbered(w, len(places)) for w in found), dtype=np.int32, count=len(found)))
                order.append(np.array([-1], dtype=np.int32))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, places), dtype=np.uint64, count=len(places))
            hashes = np.append(hashes, _END)
            words, rank = np.unique(hashes, return_inverse=True)
            tokens = rank.astype(np.int32)[np.concatenate(order)]
            blob = packed(tokens)
            block = np.uint64(xxhash.xxh64_intdigest(blob, seed=(task << 20) + number)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block)], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                 pa.array([batch.column(2).to_pylist()], pa.list_(pa.bool_())), pa.array([packed(np.array(lengths, dtype=np.int32))], pa.binary()),
                 pa.array([blob], pa.binary()), pa.array([packed_sorted(words)], pa.binary())], names=schema.names)

    return docs.select(id_col, text_col, "held").mapInArrow(run, schema)


class Block:
    """Tokens of one block, with their contexts."""

    def __init__(self, lengths: bytes, tokens: bytes, words: bytes, held: list[bool], bits: int):
        self.lengths = unpacked(lengths, np.int32).astype(np.int64)
        self.words = unpacked_sorted(words)
        self.tokens = unpacked(tokens, np.int32)
        self.training = np.repeat(~np.array(held, dtype=bool), self.lengths)
        first = np.cumsum(self.lengths) - self.lengths
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[first] = len(self.words)
        with_begin = np.append(self.words, _BEGIN)
        pairs = _mixed(with_begin[self.contexts] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.tokens]) >> np.uint64(64 - bits)
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.training], minlength=len(self.words)).astype(np.uint32)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.training], minlength=len(self.pairs)).astype(np.uint32)


def _block(row: dict, bits: int) -> Block:
    return Block(row["lengths"], row["tokens"], row["words"], row["held"], bits)


def corpus_counts(blocks: DataFrame, bits: int, ranges: int) -> DataFrame:
    """For each block, kind and range the corpus counts of its keys, in their order; with the range's tokens and distinct keys in training."""
    level = ranges.bit_length() - 1

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row, bits)
                for kind, keys, counts, width in ((WORDS, block.words, block.word_counts(), 64), (PAIRS, block.pairs, block.pair_counts(), bits)):
                    owner = (keys >> np.uint64(width - level)).astype(np.int64) if level else np.zeros(len(keys), dtype=np.int64)
                    cuts = np.searchsorted(owner, np.arange(ranges + 1))
                    some = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                         pa.array([packed_sorted(keys[cuts[r]:cuts[r + 1]]) for r in some], pa.binary()),
                         pa.array([packed(counts[cuts[r]:cuts[r + 1]]) for r in some], pa.binary())], names=["kind", "range", "block", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = [unpacked_sorted(k) for k in table["keys"].to_pylist()]
        counts = np.concatenate([unpacked(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.float64)
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.uint64)
        answers = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
        n = table.num_rows
        return pa.table({"kind": table["kind"], "range": table["range"], "block": table["block"], "totals": pa.array([packed(a) for a in answers], pa.binary()),
                         "n_tokens": pa.array([int(total.sum())] * n, pa.int64()), "n_distinct": pa.array([int((total > 0).sum())] * n, pa.int64())})

    sent = blocks.select("block", "held", "lengths", "tokens", "words").mapInArrow(send, "kind int, range long, block long, keys binary, counts binary")
    return sent.groupBy("kind", "range").applyInArrow(add, "kind int, range long, block long, totals binary, n_tokens long, n_distinct long")


def _answers(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A block's corpus counts of words and of pairs, put together from all ranges."""
    rows = sorted((kind, place, data) for kind, place, data in zip(*(counts[c].to_pylist() for c in ("kind", "range", "totals")), strict=True))
    return tuple(np.concatenate([unpacked(d, np.uint64) for k, _, d in rows if k == kind]).astype(np.float64) for kind in (WORDS, PAIRS))


def bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.where(context_count > 0, np.floor(np.log2(np.maximum(context_count, 1))) + 1, 0).astype(np.int64)


def learn_mixture(cells: list[tuple[int, int, int, float]], distinct: int) -> np.ndarray:
    """Weights [bucket, (pair, word, uniform)] by EM over cells (bucket, pair step, word step, weight); step -1 stands for 0."""
    out = np.full((66, 3), 1 / 3)
    out[0] = 0, 0.5, 0.5
    if not cells:
        return out
    data = np.array(cells, dtype=np.float64)
    group = data[:, 0].astype(np.int64)
    parts = np.stack([np.where(data[:, k] < 0, 0.0, 2.0 ** (-data[:, k] / STEPS)) for k in (1, 2)] + [np.full(len(data), 1 / (distinct + 1))], axis=1)
    parts[group == 0, 0] = 0
    for _ in range(ROUNDS):
        share = out[group] * parts
        share *= (data[:, 3] / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        sums = np.stack([np.bincount(group, weights=share[:, k], minlength=len(out)) for k in range(3)], axis=1) + np.array([1e-3, 1e-3, 1e-3])
        sums[0, 0] = 0
        out = sums / sums.sum(axis=1, keepdims=True)
    return out


def _deleted_cells(block: Block, words: np.ndarray, pairs: np.ndarray, n_tokens: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of cells and their weights over a block's training tokens, each token deleted from the counts it is judged by."""
    train = np.flatnonzero(block.training)
    context = np.append(words, n_docs)[block.contexts[train]] - 1
    pair = (pairs[block.pair_of[train]] - 1) / np.maximum(context, 1)
    word = (words[block.tokens[train]] - 1) / max(1, n_tokens - 1)

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int64)

    code = (bucket(context) * 2048 + step(pair) + 1) * 2048 + step(word) + 1
    found, count = np.unique(code, return_counts=True)
    return found, count.astype(np.float64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """Token counts and log10 probabilities of every row, under a model learned from the folds of the key that are not held out.

    Returns the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigrams) and ``score`` (the interpolated model).
    A text is its words and one end token; a null text is empty. A null id is
    never held out. Repeated rows count and are scored each; other columns are
    ignored. If nothing may be learned from, all counts are 0. An empty table
    gives no rows.
    """
    marked = keyed(docs, id_col, text_col).withColumn("held", held_out(F.col(id_col), folds, held))
    size = marked.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = 1 << max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    bits = min(64, max(1, math.ceil(math.log2(size + 2))) + SLACK)
    blocks = checkpointed(token_blocks(marked, id_col, text_col))
    counts = checkpointed(corpus_counts(blocks, bits, ranges))
    total = counts.where(F.col("kind") == WORDS).groupBy("range").agg(F.first("n_tokens").alias("n"), F.first("n_distinct").alias("v")) \
        .agg(F.sum("n"), F.sum("v")).first()
    n_tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    n_docs = marked.where(~F.col("held")).count()
    answered = counts.select("block", "kind", "range", "totals").groupBy("block")

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[int, float] = {}
        words, pairs = _answers(right)
        for row in left.to_pylist():
            for code, n in zip(*_deleted_cells(_block(row, bits), words, pairs, n_tokens, n_docs), strict=True):
                found[int(code)] = found.get(int(code), 0.0) + n
        return pa.table({"cell": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.float64())})

    per_cell = blocks.groupBy("block").cogroup(answered).applyInArrow(cells, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    mixture = learn_mixture([(c >> 22, (c >> 11) % 2048 - 1, c % 2048 - 1, n) for c, n in sorted(per_cell)], distinct)
    id_type = marked.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, pairs = _answers(right)
        out = []
        kind = left.schema.field("ids").type.value_type
        for row in left.to_pylist():
            block = _block(row, bits)
            context = np.append(words, n_docs)[block.contexts]
            word = words[block.tokens]
            mix = mixture[bucket(context)]
            p = mix[:, 0] * pairs[block.pair_of] / np.maximum(context, 1) + mix[:, 1] * word / max(1, n_tokens) + mix[:, 2] / (distinct + 1)
            base = np.log10((word + 1) / (n_tokens + 1 * (distinct + 1)))
            first = np.cumsum(block.lengths) - block.lengths
            out.append(pa.table([
                pa.array(row["ids"], kind), pa.array(row["held"], pa.bool_()), pa.array(block.lengths, pa.int64()),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), first), pa.int64()), pa.array([n_tokens] * len(first), pa.int64()),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], names=schema.names))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answered).applyInArrow(score, schema)
