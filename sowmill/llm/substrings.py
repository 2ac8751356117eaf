"""Removal of byte strings that occur more than once, with suffix arrays.

A window is ``width`` bytes of one text. Every window holds the anchor that
its smallest hash of ``GRAM`` bytes gives; equal windows have equal anchors, so
only windows whose anchor occurs at least twice can be repeated. Those windows
go, as stretches of text around one anchor, to the shard that owns the anchor.
Shards sort all their suffixes and compare neighbours (``suffixes``); a shard
with more bytes than one suffix array should hold is built as several and
merged by binary search. An anchor that stands so often that its stretches
could fill a shard has no owner for them: its windows go out as 128-bit hashes,
to the owners of the hashes, where those of equal windows meet.

Texts are kept in blocks. Blocks and owners exchange each distinct
anchor, stretch and window hash of a block once, whatever its frequency, and
answers come back in the order of what was sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.blocks import merged, packed, packed_sorted, unpacked, unpacked_sorted
from sowmill.llm.common import checkpointed, chunks, keyed, spread
from sowmill.llm.suffixes import Shard

WIDTH = 200
GRAM = 64
BLOCK_BYTES = 8 << 20
#: Text bytes whose anchors one shard owns, about.
RANGE_BYTES = 8 << 20
#: Bytes of one suffix array, with separators.
ARRAY_BYTES = 2_000_000
#: Bytes that the stretches of one anchor can have together before its windows go out as hashes.
HOT_BYTES = 2_000_000
#: How many times more, as a power of two, ranges of window hashes there are than ranges of anchors.
FINER = 2
#: Bytes whose hashes are made at once.
STEP = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
ANCHORS, STRETCHES, HOT, WINDOWS = range(4)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on; ``size`` is a power of two."""
    h = data.astype(np.uint64) + np.uint64(1)
    span, factor = 1, _MULTIPLIER
    while span < size:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def stretches(data: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of windows with one anchor, of texts that lie one after the other.

    The texts are gone through together; windows that reach into the next text are none.
    """
    ends = np.cumsum(sizes)
    change = np.zeros(len(data) + 2, dtype=np.int32)
    np.add.at(change, (ends - sizes)[sizes >= width], 1)
    np.add.at(change, (ends - width + 1)[sizes >= width], -1)
    whole = np.cumsum(change[:len(data)], dtype=np.int32) > 0
    hashes, begins, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for low in range(0, len(data) - width + 1, STEP):
        part = data[low:low + STEP + width - 1]
        h = gram_hashes(part, gram)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span, least = 1, key
        need = width - gram + 1
        while 2 * span <= need:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = need - span
        least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        inside = whole[low:low + len(at)]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])))
        length = np.diff(np.append(first, len(at)))
        first, length = first[inside[first]], length[inside[first]]
        # The smallest hashes of their windows are small numbers; mixed once more, anchors spread evenly over the ranges.
        anchors = h[at[first]] * np.uint64(0xD6E8FEB86659FD93)
        anchors = (anchors ^ (anchors >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        hashes.append(anchors ^ (anchors >> np.uint64(29)))
        begins.append(first + low)
        counts.append(length)
    return np.concatenate(hashes), np.concatenate(begins), np.concatenate(counts)


def text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in blocks: ``block`` (hash of its content and place), ids, byte sizes, and the bytes of all texts, compressed."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
                           T.StructField("sizes", T.BinaryType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for number, batch in enumerate(merged(chunks(batches, text_col, BLOCK_BYTES), text_col, BLOCK_BYTES)):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            data = zs.ZstdCompressor(level=3).compress(b"".join(texts))
            block = np.uint64(xxhash.xxh64_intdigest(data, seed=(task << 20) + number)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block)], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(batch.schema.field(0).type)),
                 pa.array([packed(np.array([len(t) for t in texts], dtype=np.int64))], pa.binary()), pa.array([data], pa.binary())], names=schema.names)

    return keyed(docs, id_col, text_col).mapInArrow(run, schema)


class Block:
    """The texts of a block and their stretches."""

    def __init__(self, sizes: bytes, data: bytes, width: int, gram: int):
        self.sizes = unpacked(sizes, np.int64)
        self.data = zs.ZstdDecompressor().decompress(data)
        self.ends = np.cumsum(self.sizes)
        self.hashes, self.begins, self.windows = stretches(np.frombuffer(self.data, dtype=np.uint8), self.sizes, width, gram)
        self.anchors, self.anchor_of, self.anchor_counts = np.unique(self.hashes, return_inverse=True, return_counts=True)

    def contents(self, wanted: np.ndarray, width: int) -> dict[tuple[int, bytes], list[int]]:
        """Distinct stretches (anchor, bytes) of the wanted anchors, sorted by anchor and bytes, with where they stand."""
        found: dict[tuple[int, bytes], list[int]] = {}
        some = np.flatnonzero(wanted[self.anchor_of])
        for anchor, begin, n in zip(self.hashes[some].tolist(), self.begins[some].tolist(), self.windows[some].tolist(), strict=True):
            found.setdefault((anchor, self.data[begin:begin + n + width - 1]), []).append(begin)
        return dict(sorted(found.items()))


def rolling(data: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on, put together from hashes of powers of two."""
    part = data.astype(np.uint64) + np.uint64(1)
    span, out, done = 1, None, 0
    power = factor
    while True:
        if width & span:
            # What is done lies behind this part.
            out = part if out is None else part[:len(part) - done] * np.uint64(pow(factor, done, 1 << 64)) + out[span:]
            done += span
        if done == width:
            break
        part = part[:-span] * np.uint64(power) + part[span:]
        power, span = power * power % (1 << 64), 2 * span
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def window_hashes(found: dict[tuple[int, bytes], list[int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (two numbers each, sorted) of the windows of stretches, how often each occurs, and which of them each window has."""
    counts = np.array([len(content) - width + 1 for _, content in found], dtype=np.int64)
    if not len(counts):
        return np.zeros((0, 2), dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64)
    flat = np.frombuffer(b"".join(content for _, content in found), dtype=np.uint8)
    ends = np.cumsum(counts + width - 1)
    places = np.repeat(ends - np.cumsum(counts) - width + 1, counts) + np.arange(counts.sum())
    pairs = np.stack([rolling(flat, width, factor)[places] for factor in (_MULTIPLIER, 0xC2B2AE3D27D4EB4F)], axis=1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ordered = pairs[order]
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    which = np.empty(len(pairs), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    times = np.array([len(places) for places in found.values()], dtype=np.int64)
    return ordered[new], np.bincount(which, weights=np.repeat(times, counts), minlength=int(new.sum())), which


def _owner(keys: np.ndarray, level: int) -> np.ndarray:
    return (keys >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(keys), dtype=np.int64)


def repeated_anchors(blocks: DataFrame, level: int, width: int, gram: int, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """For each block and range, which of the block's anchors occur at least twice in the corpus, in their order, and which are hot, if any."""
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["sizes"], row["bytes"], width, gram)
                cuts = np.searchsorted(_owner(block.anchors, level), np.arange((1 << level) + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                     pa.array([packed_sorted(block.anchors[cuts[r]:cuts[r + 1]]) for r in some], pa.binary()),
                     pa.array([packed(block.anchor_counts[cuts[r]:cuts[r + 1]].astype(np.int64)) for r in some], pa.binary())],
                    names=["range", "block", "keys", "times"])

    def add(table: pa.Table) -> pa.Table:
        keys = [unpacked_sorted(k) for k in table["keys"].to_pylist()]
        times = [unpacked(b, np.int64) for b in table["times"].to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(place, weights=np.concatenate(times), minlength=len(known))
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        out = []
        for kind, answers in ((ANCHORS, np.split((seen > 1)[place], cuts)), (HOT, np.split((seen * (2 * width - gram) > hot_bytes)[place], cuts))):
            told = pa.table({"kind": pa.array([kind] * table.num_rows, pa.int32()), "range": table["range"], "block": table["block"],
                             "flags": pa.array([np.packbits(a).tobytes() for a in answers], pa.binary())})
            out.append(told if kind == ANCHORS else told.filter(pa.array([bool(a.any()) for a in answers], pa.bool_())))
        return pa.concat_tables(out)

    return spread(blocks.select("block", "sizes", "bytes").mapInArrow(send, "range long, block long, keys binary, times binary"), "range") \
        .groupBy("range").applyInArrow(add, "kind int, range long, block long, flags binary")


def _flags(rows: list[tuple[int, bytes]], counts: np.ndarray) -> np.ndarray:
    """Flags of a block put together from its ranges; ``counts`` has how many each range holds."""
    parts = [np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=int(counts[place])) for place, data in sorted(rows)]
    return np.concatenate([np.zeros(0, dtype=np.uint8), *parts]).astype(bool)


def _wanted(block: Block, answers: list[dict], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which anchors of a block are repeated and not hot, and which are hot and repeated."""
    counts = np.bincount(_owner(block.anchors, level), minlength=1 << level)
    wanted = _flags([(r["range"], r["flags"]) for r in answers if r["kind"] == ANCHORS], counts)
    hot, starts = np.zeros(len(wanted), dtype=bool), np.cumsum(counts) - counts
    for r in answers:
        if r["kind"] == HOT:
            start, n = int(starts[r["range"]]), int(counts[r["range"]])
            hot[start:start + n] = np.unpackbits(np.frombuffer(r["flags"], dtype=np.uint8), count=n)
    return wanted & ~hot, wanted & hot


def resolve(parts: list[bytes], counts: np.ndarray, width: int, array_bytes: int) -> list[np.ndarray]:
    """Which windows of the parts are repeated, by one suffix array or by several that are merged two by two."""
    shards, at = [], 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop]) + 1 <= array_bytes):
            size += len(parts[stop]) + 1
            stop += 1
        shards.append(Shard(parts[at:stop], counts[at:stop], width))
        at = stop
    for i, one in enumerate(shards):
        for other in shards[i + 1:]:
            one.merge(other)
    return [flags for shard in shards for flags in shard.repeated()]


def parcels(blocks: DataFrame, anchors: DataFrame, level: int, width: int, gram: int) -> DataFrame:
    """What each block sends to each range: its distinct stretches around anchors that are not hot, and distinct hashes of the windows of those that are."""
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"kind": [], "range": [], "block": [], "content": [], "times": []}

        def put(kind: int, r: int, block: int, content: bytes, times: bytes | None) -> None:
            for name, value in zip(out, (kind, r, block, content, times), strict=True):
                out[name].append(value)

        answers = right.select(["kind", "range", "flags"]).to_pylist()
        for row in left.to_pylist():
            block = Block(row["sizes"], row["bytes"], width, gram)
            wanted, hot = _wanted(block, answers, level)
            found = block.contents(wanted, width)
            owner = _owner(np.array([a for a, _ in found], dtype=np.uint64), level)
            cuts = np.searchsorted(owner, np.arange((1 << level) + 1))
            items = list(found.items())
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                part = items[cuts[r]:cuts[r + 1]]
                sizes = np.array([[len(content), len(places)] for (_, content), places in part], dtype=np.int64)
                blob = sizes.tobytes() + b"".join(content for (_, content), _ in part)
                put(STRETCHES, r, row["block"], len(part).to_bytes(8, "little") + zs.ZstdCompressor(level=1).compress(blob), None)
            keys, times, _ = window_hashes(block.contents(hot, width), width)
            cuts = np.searchsorted(_owner(keys[:, 0], level + FINER), np.arange((1 << (level + FINER)) + 1))
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                some = slice(cuts[r], cuts[r + 1])
                put(WINDOWS, r, row["block"], keys[some].tobytes(), np.packbits(times[some] > 1).tobytes())
        return pa.table({"kind": pa.array(out["kind"], pa.int32()), "range": pa.array(out["range"], pa.int64()), "block": pa.array(out["block"], pa.int64()),
                         "content": pa.array(out["content"], pa.binary()), "times": pa.array(out["times"], pa.binary())})

    return spread(blocks.select("block", "sizes", "bytes"), "block").groupBy("block").cogroup(anchors.groupBy("block")) \
        .applyInArrow(send, "kind int, range long, block long, content binary, times binary")


def repeated_windows(blocks: DataFrame, anchors: DataFrame, level: int, width: int, gram: int, array_bytes: int) -> DataFrame:
    """For each block and range, which windows of the block's distinct stretches, and which of its window hashes, are repeated, in their order."""
    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, dtype=np.uint64).reshape(-1, 2) for k in table["content"].to_pylist()]
        twice = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=len(k)) for b, k in zip(table["times"].to_pylist(), keys, strict=True)]
        pairs = np.concatenate(keys)
        order = np.lexsort((pairs[:, 1], pairs[:, 0]))
        ordered = pairs[order]
        place = np.empty(len(pairs), dtype=np.int64)
        place[order] = np.cumsum(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))) - 1
        seen = np.bincount(place, weights=1 + np.concatenate(twice)) > 1
        answers = np.split(seen[place], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"kind": table["kind"], "range": table["range"], "block": table["block"],
                         "flags": pa.array([np.packbits(a).tobytes() for a in answers], pa.binary())})

    def sort(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == WINDOWS:
            return add(table)
        seen: dict[bytes, int] = {}
        counts: list[int] = []
        sent = []
        for blob in table["content"].to_pylist():
            n = int.from_bytes(blob[:8], "little")
            raw = zs.ZstdDecompressor().decompress(blob[8:])
            sizes = np.frombuffer(raw, dtype=np.int64, count=2 * n).reshape(-1, 2)
            at, mine = 16 * n, []
            for size, times in sizes.tolist():
                place = seen.setdefault(raw[at:at + size], len(seen))
                if place == len(counts):
                    counts.append(0)
                counts[place] += times
                mine.append(place)
                at += size
            sent.append(mine)
        flags = resolve(list(seen), np.array(counts), width, array_bytes)
        answers = [np.packbits(np.concatenate([flags[p] for p in mine])).tobytes() for mine in sent]
        return pa.table({"kind": pa.array([STRETCHES] * table.num_rows, pa.int32()), "range": table["range"], "block": table["block"],
                         "flags": pa.array(answers, pa.binary())})

    return spread(parcels(blocks, anchors, level, width, gram), "kind", "range").groupBy("kind", "range") \
        .applyInArrow(sort, "kind int, range long, block long, flags binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM,
                   array_bytes: int = ARRAY_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Id, ``n_bytes``, ``removed`` (start and end of every maximal run, in bytes) and ``kept`` (the bytes that stay) of every row.

    A byte goes if a string of ``width`` bytes that covers it also starts
    anywhere else in the table, in the same text included; strings do not cross
    texts and are judged on the input. A null text is empty. Rows that repeat a
    text of at least ``width`` bytes lose all of it. Null ids are kept, other
    columns ignored; an empty table gives no rows.
    """
    if width < gram:
        raise ValueError("a window must hold a gram")
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    level = max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    blocks = checkpointed(text_blocks(docs, id_col, text_col))
    anchors = checkpointed(repeated_anchors(blocks, level, width, gram, hot_bytes))
    windows = repeated_windows(blocks, anchors, level, width, gram, array_bytes)
    answers = anchors.unionByName(windows)
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", spans), T.StructField("kept", T.BinaryType())])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        told = right.select(["kind", "range", "flags"]).to_pylist()
        for row in left.to_pylist():
            block = Block(row["sizes"], row["bytes"], width, gram)
            wanted, hot = _wanted(block, told, level)
            found = block.contents(wanted, width)
            owner = _owner(np.array([a for a, _ in found], dtype=np.uint64), level)
            lengths = np.array([len(c) - width + 1 for _, c in found], dtype=np.int64)
            counts = np.bincount(owner, weights=lengths, minlength=1 << level)
            flags = _flags([(r["range"], r["flags"]) for r in told if r["kind"] == STRETCHES], counts)
            many = block.contents(hot, width)
            keys, _, which = window_hashes(many, width)
            counts = np.bincount(_owner(keys[:, 0], level + FINER), minlength=1 << (level + FINER))
            flags = np.concatenate([flags, _flags([(r["range"], r["flags"]) for r in told if r["kind"] == WINDOWS], counts)[which]])
            lengths = np.concatenate([lengths, np.array([len(c) - width + 1 for _, c in many], dtype=np.int64)])
            change = np.zeros(len(block.data) + 1, dtype=np.int32)
            at = 0
            for places, n in zip([*found.values(), *many.values()], lengths.tolist(), strict=True):
                mine = np.flatnonzero(flags[at:at + n])
                at += n
                if len(mine):
                    for begin in places:
                        change[begin + mine] += 1
                        np.add.at(change, begin + mine + width, -1)
            covered = np.cumsum(change[:-1], dtype=np.int32) > 0
            flat = np.frombuffer(block.data, dtype=np.uint8)
            removed, kept = [], []
            for n, end in zip(block.sizes.tolist(), block.ends.tolist(), strict=True):
                mine = covered[end - n:end]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                removed.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(flat[end - n:end][~mine].tobytes())
            out.append(pa.table([pa.array(row["ids"], left.schema.field("ids").type.value_type), pa.array(block.sizes, pa.int64()),
                                 pa.array(removed, span_type), pa.array(kept, pa.binary())], names=schema.names))
        return pa.concat_tables(out)

    return spread(blocks, "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def removal_digest(cut: DataFrame) -> DataFrame:
    """Counts and checksum in place of spans and bytes."""
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.withColumns({"n_removed": length, "n_spans": F.size("removed").cast("long"), "kept_sha256": F.sha2("kept", 256)}).drop("removed", "kept")
