"""Benchmark passages in texts, by SimHash over windows of the size of an item.

Texts and items are lower-cased words; ASCII characters other than letters and
digits part them. A window is as long
as an item; it is described by its five-word shingles (an item of fewer words
by itself), weighted by how rare they are in the benchmark. Windows and items
get 64-bit SimHash fingerprints. The fingerprints of the items of one length
are kept in several indexes, one for each block of bits: two fingerprints
within the radius differ by at most radius // blocks bits in one of them, so
looking up all values that close finds every item within the radius. Pairs
found this way are decided by the exact weighted similarity.

Windows that share no shingle with any item have similarity 0 and are passed
over; a lookup of shingle hashes tells them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.common import chunks, keyed

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 19, 5
#: Text bytes of the items that one broadcast holds at most, some eight times as many in arrays; a larger benchmark is searched in several passes.
#: Bytes of text that are scanned at once.
SCAN_BYTES = 2 << 20
PASS_BYTES = 8 << 20

_PARTING = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PARTING).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, from the words' hashes."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _MULTIPLIER + words[k:len(words) - size + 1 + k]
    return _mixed(out)


def bit_sums(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Running sums over the shingles of +weight or -weight for each of 64 bits; row 0 is zero."""
    bits = np.unpackbits(_mixed(shingles * np.uint64(0xD6E8FEB86659FD93)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    return np.vstack([np.zeros((1, 64)), np.cumsum((2 * bits - 1) * weights[:, None], axis=0)])


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each start up to its end."""
    return np.packbits(sums[ends] - sums[starts] > 1e-9, axis=1).view(np.uint64)[:, 0]


@lru_cache(maxsize=None)
def flips(width: int, most: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``most`` ones."""
    return np.array([sum(1 << b for b in flipped) for k in range(min(width, most) + 1) for flipped in combinations(range(width), k)])


class HammingIndex:
    """Finds all stored fingerprints within a radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.prints, self.radius = prints, radius
        edges = [64 * b // blocks for b in range(blocks + 1)]
        self.blocks = []
        for low, high in zip(edges, edges[1:], strict=False):
            values = self._block(prints, low, high - low)
            order = np.argsort(values, kind="stable")
            there = np.zeros(1 << (high - low), dtype=bool)
            there[values] = True
            self.blocks.append((low, high - low, order, values[order], np.packbits(there)))

    @staticmethod
    def _block(prints: np.ndarray, low: int, width: int) -> np.ndarray:
        return ((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray) -> list[tuple[int, int]]:
        """Pairs (query, stored) within the radius, each once."""
        found = []
        for low, width, order, values, there in self.blocks:
            masks = flips(width, self.radius // len(self.blocks))
            keys = (self._block(queries, low, width)[:, None] ^ masks[None, :]).ravel()
            some = np.flatnonzero(np.unpackbits(there)[keys])
            begins = np.searchsorted(values, keys[some])
            counts = np.searchsorted(values, keys[some], side="right") - begins
            query = np.repeat(some // len(masks), counts)
            inner = np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)
            found.append(query * len(self.prints) + order[np.repeat(begins, counts) + inner])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        query, stored = pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))
        near = np.bitwise_count(queries[query] ^ self.prints[stored]) <= self.radius
        return list(zip(query[near].tolist(), stored[near].tolist(), strict=True))


class Bag(NamedTuple):
    """Shingles of an item in order, how often it has each, and their weights."""

    keys: np.ndarray
    counts: np.ndarray
    weights: np.ndarray


class Group(NamedTuple):
    """Items of one length in words."""

    ids: list
    bags: list[Bag]
    index: HammingIndex


class Seeds(NamedTuple):
    """Shingles of one size in order, each with the lengths of the items that have it, and a filter of them."""

    keys: np.ndarray
    lengths: np.ndarray
    bitmap: np.ndarray


class Benchmark:
    """Items of one pass, by length, with their fingerprints and shingle weights, in flat arrays of some 50 bytes a shingle.

    ``seen`` (shingles in order and how many items have each) and ``n_items``
    are of the whole benchmark; without them the pass is the whole.
    """

    def __init__(self, items: list[tuple], radius: int = RADIUS, blocks: int = BLOCKS, seen: tuple[np.ndarray, np.ndarray] | None = None, n_items: int | None = None):
        worded = [(key, np.array([xxhash.xxh64_intdigest(w) for w in words_of(text)], dtype=np.uint64)) for key, text in items]
        described = [(key, len(words), shingle_hashes(words, min(SHINGLE, len(words)))) for key, words in worded if len(words)]
        n_items = len(described) if n_items is None else n_items
        none = np.zeros(0, dtype=np.uint64)
        if seen is None:
            seen = np.unique(np.concatenate([none, *[np.unique(s) for _, _, s in described]]), return_counts=True)
        self.rarest = 1 + math.log(max(1, n_items))
        self.known, self.weight = seen[0], 1 + np.log(n_items / seen[1])
        self.groups: dict[int, Group] = {}
        by_length: dict[int, list] = {}
        for key, length, shingles in described:
            by_length.setdefault(length, []).append((key, shingles))
        pairs: dict[int, list] = {}
        for length, members in by_length.items():
            prints = np.concatenate([self.prints(s, np.array([0]), np.array([len(s)])) for _, s in members])
            bags = [Bag(k, c, self.weights_of(k)) for k, c in (np.unique(s, return_counts=True) for _, s in members)]
            self.groups[length] = Group([k for k, _ in members], bags, HammingIndex(prints, radius, blocks))
            pairs.setdefault(min(SHINGLE, length), []).append((np.unique(np.concatenate([b.keys for b in bags])), length))
        self.seeds: dict[int, Seeds] = {}
        for size, parts in pairs.items():
            keys, lengths = np.concatenate([k for k, _ in parts]), np.repeat([n for _, n in parts], [len(k) for k, _ in parts])
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bitmap[keys & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.seeds[size] = Seeds(keys[order], lengths[order], np.packbits(bitmap))

    def weights_of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.rarest)
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[place] == shingles, self.weight[place], self.rarest)

    def prints(self, shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return fingerprints(bit_sums(shingles, self.weights_of(shingles)), starts, ends)

    def similarity(self, window: np.ndarray, item: Bag) -> float:
        """Weighted Jaccard similarity of two bags of shingles; a shingle that the item lacks weighs as much as the rarest."""
        keys, counts = np.unique(window, return_counts=True)
        place = np.minimum(np.searchsorted(item.keys, keys), len(item.keys) - 1)
        same = item.keys[place] == keys
        mine = np.zeros(len(item.keys), dtype=np.int64)
        mine[place[same]] = counts[same]
        either = float((item.weights * np.maximum(mine, item.counts)).sum()) + self.rarest * int(counts[~same].sum())
        return float((item.weights * np.minimum(mine, item.counts)).sum()) / either if either else 0.0

    def leaks(self, words: np.ndarray, seeds: dict[int, np.ndarray], least: float) -> dict:
        """Best window of every item found: item -> (similarity, first word, end)."""
        best: dict = {}
        for size, places in seeds.items():
            shingles, table = shingle_hashes(words, size), self.seeds[size]
            begins, stops = np.searchsorted(table.keys, shingles[places]), np.searchsorted(table.keys, shingles[places], side="right")
            counts = stops - begins
            at = np.repeat(places, counts)
            lengths = table.lengths[np.repeat(stops - np.cumsum(counts), counts) + np.arange(len(at))]
            if not len(at):
                continue
            sums = bit_sums(shingles, self.weights_of(shingles))
            for length in np.unique(lengths).tolist():
                group, span, here = self.groups[length], min(length, len(words)), at[lengths == length]
                change = np.zeros(len(words) + 2, dtype=np.int64)
                first = np.maximum(0, here - (span - size))
                last = np.maximum(first, np.minimum(here, len(words) - span) + 1)
                np.add.at(change, first, 1)
                np.add.at(change, last, -1)
                begin = np.flatnonzero(np.cumsum(change) > 0)
                prints = fingerprints(sums, begin, begin + span - size + 1)
                for query, stored in group.index.search(prints):
                    start = int(begin[query])
                    value = self.similarity(shingles[start:start + span - size + 1], group.bags[stored])
                    if value >= least - 1e-12:
                        key = group.ids[stored]
                        if key not in best or (-value, start) < (-best[key][0], best[key][1]):
                            best[key] = (value, start, start + span)
        return best

    def scan(self, texts: list[str | None], least: float) -> Iterator[tuple[int, dict]]:
        """Place and leaks of the texts that have some."""
        parts = [words_of(t) for t in texts]
        flat = [w for p in parts for w in p]
        if not flat or not self.groups:
            return
        hashes = {w: xxhash.xxh64_intdigest(w) for w in set(flat)}
        words = np.fromiter(map(hashes.__getitem__, flat), dtype=np.uint64, count=len(flat))
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        seeds: dict[int, dict[int, list[int]]] = {}
        for size, table in self.seeds.items():
            shingles = shingle_hashes(words, size)
            low = (shingles & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)
            likely = np.flatnonzero(table.bitmap[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
            place = np.minimum(np.searchsorted(table.keys, shingles[likely]), len(table.keys) - 1)
            likely = likely[table.keys[place] == shingles[likely]]
            owner = np.searchsorted(ends, likely, side="right")
            inside = likely + size <= ends[owner]
            for text, at in zip(owner[inside].tolist(), likely[inside].tolist(), strict=True):
                seeds.setdefault(text, {}).setdefault(size, []).append(at)
        for text, found in sorted(seeds.items()):
            begin = int(ends[text]) - len(parts[text])
            leaks = self.leaks(words[begin:ends[text]], {s: np.array(a) - begin for s, a in found.items()}, least)
            if leaks:
                yield text, leaks


def passes(benchmark: DataFrame, id_col: str, text_col: str, most: int = PASS_BYTES) -> Iterator[Benchmark]:
    """The items in as many parts as keep each under ``most`` bytes of text, about; null ids and texts have no part.

    All texts of one id are in one part, so that an id has one best window.
    """
    items = keyed(benchmark, id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = total // most + 1
    if n == 1:
        yield Benchmark(sorted((r[0], r[1]) for r in items.collect()))
        return

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array([xxhash.xxh64_intdigest(w) for w in words_of(text)], dtype=np.uint64)
                found = np.unique(shingle_hashes(words, min(SHINGLE, len(words)))) if len(words) else words
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int64()), pa.array(found.view(np.int64))],
                                                 names=["part", "shingle"])

    numbered = items.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(n)))
    parts = numbered.select("part", text_col).mapInArrow(shingles, "part long, shingle long")
    counts = parts.groupBy("shingle").agg(F.count("*").alias("n"))
    n_items = items.where(F.regexp_replace(F.lower(text_col), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", "") != "").count()
    for k in range(n):
        mine = sorted((r[0], r[1]) for r in numbered.where(F.col("part") == k).select(id_col, text_col).collect())
        seen = parts.where(F.col("part") == k).select("shingle").distinct().join(counts, "shingle").toPandas()
        keys = seen["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        yield Benchmark(mine, seen=(keys[order], seen["n"].to_numpy()[order]), n_items=n_items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item it holds: ids, best ``similarity``, ``start`` and ``end`` of its window in words.

    Null and empty texts and items hold nothing, items without an id are left
    out. Of equal windows the first is given. Repeated rows give repeated
    results; an item given twice counts once, and one with several texts gives
    its best window; a null document id is kept. Empty tables give no rows.
    """
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = None
    for known in passes(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text_col, SCAN_BYTES):
                keys = batch.column(0)
                found = [(i, item, *window) for i, leaks in shared.value.scan(batch.column(1).to_pylist(), similarity) for item, window in sorted(leaks.items())]
                if found:
                    at, items, values, begins, ends = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(items), pa.array(values), pa.array(begins, pa.int64()),
                                                      pa.array(ends, pa.int64())], names=schema.names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text",
                  similarity: float = SIMILARITY) -> DataFrame:
    """Rows whose text holds no item, with all their columns; null and empty texts stay.

    Every text of the benchmark counts, also of items without an id; repeated
    rows are judged alike; an empty benchmark takes nothing, an empty table
    gives no rows.
    """
    at = docs.schema.names.index(text_col)
    texts = benchmark.select(benchmark[item_text_col].alias("text"), benchmark[item_text_col].alias("item"))
    for known in passes(texts, "item", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, text_col, SCAN_BYTES):
                keep = np.ones(batch.num_rows, dtype=bool)
                for i, _ in shared.value.scan(batch.column(at).to_pylist(), similarity):
                    keep[i] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
