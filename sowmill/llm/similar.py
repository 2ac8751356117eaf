"""Similarity join on word shingles with count-vector R-trees.

A text's set is its distinct word shingles, as 64-bit hashes. Equal sets form
one class, and classes are joined:

1. Routing. Two sets of Jaccard similarity t or more share a shingle among the
   first n - ceil(t n) + 1 of each, in any order common to all. The order is
   by hash, with shingles of very many classes (hot ones) last, so that lists
   of classes by shingle stay short. A class ships ``SPARE`` times as many
   shingles as it needs, to have replacements for hot ones; a class that runs
   out of them goes by the plain order, and meets all others in the lists of
   its hot shingles.
   A list that holds no other class of like size is none. Shingles that stand
   in the same classes make the same list, and of these the first one is kept:
   texts that share a long passage meet once, not at each of its shingles.
2. Count vectors. Shingles fall into ``GROUPS`` groups by hash, and the counts
   per group are a point. Two sets share at most the sum of the smaller
   coordinates. Within a list, points are the leaves of an R-tree of boxes:
   pairs of boxes, then of points, whose bound is too small are dropped. The
   pairs that stay are kept as a forest, not one by one.
3. Verification. Components of the forests are clusters that hold every link
   between their members. A cluster's sets meet in one task, or in blocks two
   by two if it is large; pairs that pass the bound again are decided by their
   true overlap, unless known links connect them already.
4. Components of the verified links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sowmill.llm.blocks import merged, packed, packed_sorted, unpacked, unpacked_sorted
from sowmill.llm.common import checkpointed, chunks, keyed, spread
from sowmill.llm.components import Forest, components

BLOCK_BYTES = 8 << 20
#: Text bytes whose heads one range holds, about.
RANGE_BYTES = 8 << 20
GROUPS = 32
SPARE = 2
HOT = 256
LEAF = 64
#: Classes of a list or sets of a cluster that one task holds, times two.
BLOCK = 4096
#: Rows up to which the table of clustered documents (16 bytes a row) is broadcast; beyond that it is joined by shuffle.
BROADCAST_ROWS = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    parts = [words_of(t) for t in texts]
    flat = [w for p in parts for w in p]
    hashes = {w: xxhash.xxh64_intdigest(w) for w in set(flat)}
    words = np.fromiter(map(hashes.__getitem__, flat), dtype=np.uint64, count=len(flat))
    runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        runs = runs * _MULTIPLIER + words[k:len(words) - size + 1 + k] if len(runs) else runs
    runs = _mixed(runs)
    out, at = [], 0
    for part in parts:
        n = len(part)
        if n >= size:
            out.append(np.unique(runs[at:at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(part), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), seed=7)).view(np.int64))


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles in each group; groups of fewer groups join those that are equal modulo their number."""
    return np.bincount((_mixed(shingles) % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.int32)


class Threshold:
    """Similarity as a fraction of 100, so that tests are in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        """Shingles of which two similar sets share one."""
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def enough(self, overlap, sizes):
        """100 * overlap >= percent * (sizes - overlap)."""
        return (100 + self.percent) * overlap >= self.percent * sizes


def forest_edges(ids: np.ndarray, sizes: np.ndarray, points: Points, threshold: Threshold, forest: Forest, exact=None) -> Iterator[tuple[int, int]]:
    """Edges that connect what similar pairs connect: R-tree leaves against leaves, skipping what is connected.

    ``exact(rows, others)`` gives true overlaps of pairs; without it the bound decides.
    """
    coarse = points.coarse
    order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
    boxes = [coarse[leaf].max(axis=0) for leaf in leaves]
    least, most = [sizes[leaf].min() for leaf in leaves], [sizes[leaf].max() for leaf in leaves]
    for i, one in enumerate(leaves):
        for j in range(i, len(leaves)):
            if 100 * most[i] < threshold.percent * least[j]:
                break
            other = leaves[j]
            if not threshold.enough(min(int(np.minimum(boxes[i], boxes[j]).sum()), most[i]), least[i] + least[j]):
                continue
            if len(leaves) > 1:
                tops = {forest.root(x) for x in ids[one].tolist()} | ({forest.root(x) for x in ids[other].tolist()} if i != j else set())
                if len(tops) == 1:
                    continue
            bound = np.zeros((len(one), len(other)), dtype=np.int64)
            for g in range(GROUPS):
                bound += np.minimum.outer(coarse[one, g], coarse[other, g])
            near = threshold.enough(bound, sizes[one][:, None] + sizes[other][None, :])
            if i == j:
                near = np.triu(near, 1)
            rows, columns = np.nonzero(near)
            if not len(rows):
                continue
            tops = np.array([forest.root(x) for x in ids[one].tolist()])[rows], np.array([forest.root(x) for x in ids[other].tolist()])[columns]
            apart = tops[0] != tops[1]
            a, b = one[rows[apart]], other[columns[apart]]
            near = threshold.enough(points.bound(a, b), sizes[a] + sizes[b])
            a, b = a[near], b[near]
            if exact is not None and len(a):
                linked = exact(a, b)
                a, b = a[linked], b[linked]
            for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
                if forest.join(x, y):
                    yield x, y


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of one or more whole keys, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = bool(held) and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0].item() for k, c in zip(keys, columns, strict=True))
        if first:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(change)
        if len(cuts):
            last = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def groups_of(n: int) -> int:
    """Groups of a set's finer count vector, a power of two: 3 to 6 shingles a group up to 512 groups, 12 to 24 in larger sets.

    Unlike sets share about 1 - 0.56 / sqrt(shingles a group) of their size by
    the bound. This must be clearly less than similar sets share, or sets that
    have a shingle in common by chance stay candidates.
    """
    fine, coarse = (1 << max(0, (n // k).bit_length() - 1) for k in (3, 12))
    return max(GROUPS, min(512, fine), coarse)


def point_bytes(shingles: np.ndarray) -> bytes:
    """Item size and finer count vector of a set; two counts a byte where all are small."""
    point = count_vector(shingles, groups_of(len(shingles)))
    most = point.max(initial=0)
    if most < 16:
        return b"\x00" + (point[::2] | point[1::2] << 4).astype(np.uint8).tobytes()
    return b"\x01" + point.astype(np.uint8).tobytes() if most < 256 else b"\x04" + point.astype("<i4").tobytes()


def point_of(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, dtype=np.uint8 if data[0] == 1 else "<i4", offset=1).astype(np.int32)
    pairs = np.frombuffer(data, dtype=np.uint8, offset=1)
    return np.stack([pairs & 15, pairs >> 4], axis=1).reshape(-1).astype(np.int32)


class Points:
    """Count vectors of many sets: coarse ones of ``GROUPS`` groups, and finer ones for the bound of a pair."""

    def __init__(self, rows: list[np.ndarray]):
        self.width = np.array([len(r) for r in rows], dtype=np.int64)
        self.row = np.zeros(len(rows), dtype=np.int64)
        self.fine: dict[int, np.ndarray] = {}
        self.coarse = np.zeros((len(rows), GROUPS), dtype=np.int32)
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.row[own] = np.arange(len(own))
            self.fine[width] = np.stack([rows[i] for i in own.tolist()])
            self.coarse[own] = self.fine[width].reshape(len(own), -1, GROUPS).sum(axis=1)

    @classmethod
    def read(cls, rows: list[bytes]) -> Points:
        return cls([point_of(r) for r in rows])

    def part(self, own: np.ndarray) -> Points:
        return Points([self.fine[w][r] for w, r in zip(self.width[own].tolist(), self.row[own].tolist(), strict=True)])

    def bound(self, a: np.ndarray, b: np.ndarray, step: int = 20_000) -> np.ndarray:
        """Upper bounds of the overlaps of pairs, by the finest groups both have."""
        out = np.zeros(len(a), dtype=np.int64)
        code = self.width[a] * (1 << 32) + self.width[b]
        for pair in np.unique(code).tolist():
            some = np.flatnonzero(code == pair)
            one, other = pair >> 32, pair & 0xFFFFFFFF
            least = min(one, other)
            for at in range(0, len(some), step):
                part = some[at:at + step]
                x, y = self.fine[one][self.row[a[part]]], self.fine[other][self.row[b[part]]]
                x, y = x.reshape(len(part), -1, least).sum(axis=1), y.reshape(len(part), -1, least).sum(axis=1)
                out[part] = np.minimum(x, y).sum(axis=1)
        return out


def in_block_pairs(df: DataFrame, count: Column, member: Column, block: int = BLOCK) -> DataFrame:
    """Adds ``block_a`` and ``block_b``: a member of a group of ``count`` rows goes to every pair of blocks that has its own."""
    blocks = F.ceil(count / block).cast("int")
    return (
        df.withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64(member, F.lit(11)), F.col("__blocks")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        .withColumn("block_a", F.least("__own", "__other")).withColumn("block_b", F.greatest("__own", "__other"))
        .drop("__blocks", "__own", "__other"))


def sketch_blocks(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: Threshold) -> DataFrame:
    """Documents in blocks: ids, set sizes, classes and text hashes of all; ``members``, ``n``, ``heads`` (first shingles in hash order) and ``points`` of distinct classes."""
    source = docs.select(docs[id_col], docs[text_col], F.xxhash64(docs[text_col]).alias("__hash"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(source.schema[id_col].dataType)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("classes", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("members", T.BinaryType()), T.StructField("n", T.BinaryType()),
        T.StructField("heads", T.BinaryType()), T.StructField("points", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(merged(chunks(batches, text_col, BLOCK_BYTES), text_col, BLOCK_BYTES)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            classes: list[int | None] = []
            sizes: list[int] = []
            kept: dict[int, tuple[int, np.ndarray, bytes]] = {}
            for at in range(0, len(texts), 500):
                for key, s in zip(ids[at:at + 500], shingle_sets(texts[at:at + 500], shingle), strict=True):
                    own = class_of(s) if len(s) else None
                    classes.append(own)
                    sizes.append(len(s))
                    if own is not None and key is not None and own not in kept:
                        kept[own] = len(s), s[:SPARE * threshold.prefix(len(s))].copy(), point_bytes(s)
            heads = np.concatenate([np.zeros(0, dtype=np.uint64), *[h for _, h, _ in kept.values()]])
            members = np.array(list(kept), dtype=np.int64)
            points = zs.ZstdCompressor(level=1).compress(b"".join(len(p).to_bytes(4, "little") + p for _, _, p in kept.values()))
            block = np.uint64(xxhash.xxh64_intdigest(heads.tobytes(), seed=(task << 20) + number)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block)], pa.int64()), pa.array([ids], pa.list_(batch.schema.field(0).type)), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([classes], pa.list_(pa.int64())), pa.array([batch.column(2).to_pylist()], pa.list_(pa.int64())), pa.array([members.tobytes()], pa.binary()),
                 pa.array([packed(np.array([n for n, _, _ in kept.values()], dtype=np.int64))], pa.binary()), pa.array([packed(heads)], pa.binary()),
                 pa.array([points], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


class Heads:
    """The distinct classes of a block with their first shingles."""

    def __init__(self, row: dict, threshold: Threshold):
        self.classes = np.frombuffer(row["members"], dtype=np.int64)
        self.n = unpacked(row["n"], np.int64)
        self.need = self.n - -(-threshold.percent * self.n // 100) + 1
        self.sent = np.minimum(self.n, SPARE * self.need)
        self.heads = unpacked(row["heads"], np.uint64)
        self.distinct, self.place = np.unique(self.heads, return_inverse=True)

    def counts(self) -> np.ndarray:
        return np.bincount(self.place, minlength=len(self.distinct)).astype(np.uint32)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest set size that each distinct head stands in."""
        size = np.repeat(self.n, self.sent).astype(np.uint32)
        order = np.lexsort((size, self.place))
        starts = np.searchsorted(self.place[order], np.arange(len(self.distinct) + 1))
        return size[order][starts[:-1]], size[order][starts[1:] - 1]

    def marks(self) -> np.ndarray:
        """A number for each distinct head that tells in which of the block's classes it stands: their place if it is one, a hash of their places if more."""
        owner = np.repeat(np.arange(len(self.n)), self.sent).astype(np.uint64)
        order = np.argsort(self.place, kind="stable")
        starts = np.searchsorted(self.place[order], np.arange(len(self.distinct)))
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        hashes = np.add.reduceat(_mixed(owner[order] + _MULTIPLIER), starts)
        return np.where(self.counts() > 1, hashes, owner[order][starts])

    def listed(self, totals: np.ndarray, lists: np.ndarray, hot: int) -> tuple[np.ndarray, ...]:
        """Owner, shingle place, list length, and marks (plain, hot head, lacking) of the heads that other classes have too.

        Of heads of an owner with equal ``lists``, the first one is given. All
        members of such a list have the same heads in it, all hot or none, and
        where a later one is plain or a hot head the first one is as well.
        """
        df = totals[self.place]
        owner = np.repeat(np.arange(len(self.n)), self.sent)
        first = np.cumsum(self.sent) - self.sent
        at = np.arange(len(df)) - first[owner]
        heated = df > hot
        running = np.cumsum(heated)
        before = running - heated - np.append(0, running)[first][owner]
        n_cold = self.sent - np.bincount(owner, weights=heated, minlength=len(self.n)).astype(np.int64)
        whole = self.sent == self.n
        rank = np.where(heated, n_cold[owner] + before, at - before)
        lacking = (~whole & (n_cold < self.need))[owner]
        plain = (~heated | whole[owner]) & (rank < self.need[owner])
        head = heated & (at < self.need[owner])
        some = np.flatnonzero((df > 1) & (plain | head))
        same, whose = lists[self.place[some]], owner[some]
        order = np.lexsort((same, whose))
        new = np.ones(len(some), dtype=bool)
        new[1:] = (same[order][1:] != same[order][:-1]) | (whose[order][1:] != whose[order][:-1])
        some = np.sort(some[order[new]])
        return owner[some], self.place[some], df[some], plain[some], head[some], lacking[some]


def partnered(place: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int, most: int = 8) -> np.ndarray:
    """Which entries (of a key, by block) can meet a set of like size: another one of their block, or one of another block.

    Keys of more than ``most`` entries are not looked into; all theirs can.
    """
    order = np.argsort(place, kind="stable")
    key, lo, hi = place[order], low[order].astype(np.int64), high[order].astype(np.int64)
    met = (counts[order] > 1) | (np.bincount(place)[key] > most)
    for apart in range(1, min(most, len(key))):
        same = (key[apart:] == key[:-apart]) & (lo[apart:] * percent <= hi[:-apart] * 100) & (lo[:-apart] * percent <= hi[apart:] * 100)
        met[apart:] |= same
        met[:-apart] |= same
    out = np.empty(len(place), dtype=bool)
    out[order] = met
    return out


def head_totals(blocks: DataFrame, level: int, threshold: Threshold) -> DataFrame:
    """For each block and range, in how many blocks' classes each of its heads is, in their order; 1 where none of these is of like size.

    ``lists`` has a hash of these classes for each head that has more than one.
    """
    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Heads(row, threshold)
                counts, (low, high) = block.counts(), block.ranges()
                owner = (block.distinct >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(counts), dtype=np.int64)
                cuts = np.searchsorted(owner, np.arange((1 << level) + 1))
                some = np.flatnonzero(np.diff(cuts))
                columns = [[packed(values[cuts[r]:cuts[r + 1]]) for r in some] for values in (counts, low, high - low, block.marks())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()), pa.array([row["block"]] * len(some), pa.int64()),
                     pa.array([packed_sorted(block.distinct[cuts[r]:cuts[r + 1]]) for r in some], pa.binary()),
                     *[pa.array(c, pa.binary()) for c in columns]], names=["range", "block", "keys", "counts", "low", "span", "marks"])

    def add(table: pa.Table) -> pa.Table:
        keys = [unpacked_sorted(k) for k in table["keys"].to_pylist()]
        counts, low, span = (np.concatenate([unpacked(c, np.uint32) for c in table[name].to_pylist()]) for name in ("counts", "low", "span"))
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.uint32)
        told = np.where(partnered(place, counts, low, low + span, threshold.percent), total[place], 1).astype(np.uint32)
        sizes = [len(k) for k in keys]
        marks = np.concatenate([unpacked(m, np.uint64) for m in table["marks"].to_pylist()])
        blocks = np.repeat(_mixed(table["block"].to_numpy().astype(np.int64).view(np.uint64)), sizes)
        order = np.argsort(place, kind="stable")
        met = np.add.reduceat(_mixed((marks + blocks) * _MULTIPLIER)[order], np.searchsorted(place[order], np.arange(len(known))))[place]
        cuts = np.cumsum(sizes)[:-1]
        answers = np.split(told, cuts)
        lists = [m[a > 1] for m, a in zip(np.split(met, cuts), answers, strict=True)]
        return pa.table({"range": table["range"], "block": table["block"], "totals": pa.array([packed(a) for a in answers], pa.binary()),
                         "lists": pa.array([m.tobytes() for m in lists], pa.binary())})

    return blocks.select("block", "members", "n", "heads").mapInArrow(send, "range long, block long, keys binary, counts binary, low binary, span binary, marks binary") \
        .groupBy("range").applyInArrow(add, "range long, block long, totals binary, lists binary")


def meeting_lists(blocks: DataFrame, totals: DataFrame, threshold: Threshold, hot: int = HOT) -> DataFrame:
    """Rows ``shingle``, ``df``, ``class``, ``n``, ``point`` of the lists in which similar classes meet."""
    schema = "shingle long, df long, class long, n long, point binary, plain boolean, head boolean, lacking boolean"

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(zip(right["range"].to_pylist(), right["totals"].to_pylist(), right["lists"].to_pylist(), strict=True))
        known = np.concatenate([np.zeros(0, dtype=np.uint32), *[unpacked(data, np.uint32) for _, data, _ in parts]]).astype(np.int64)
        lists = np.zeros(len(known), dtype=np.uint64)
        lists[known > 1] = np.frombuffer(b"".join(data for _, _, data in parts), dtype=np.uint64)
        out = []
        for row in left.to_pylist():
            block = Heads(row, threshold)
            owner, place, df, plain, head, lacking = block.listed(known, lists, hot)
            raw, at, points = zs.ZstdDecompressor().decompress(row["points"]), 0, []
            while at < len(raw):
                size = int.from_bytes(raw[at:at + 4], "little")
                points.append(raw[at + 4:at + 4 + size])
                at += 4 + size
            out.append(pa.table([
                pa.array(block.distinct[place].view(np.int64)), pa.array(df), pa.array(block.classes[owner]), pa.array(block.n[owner]),
                pa.array(points, pa.binary()).take(pa.array(owner)), pa.array(plain), pa.array(head), pa.array(lacking)],
                names=["shingle", "df", "class", "n", "point", "plain", "head", "lacking"]))
        return pa.concat_tables(out)

    rows = blocks.select("block", "members", "n", "heads", "points").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(tell, schema)
    # A hot head alone is needed only in lists that hold a class without replacements.
    wanted = rows.where("head and lacking").select("shingle").distinct()
    return rows.where("plain or lacking").unionByName(rows.where("not plain and not lacking").join(wanted, "shingle", "left_semi"))


def candidate_edges(rows: DataFrame, threshold: Threshold) -> DataFrame:
    """Edges (a, b) that connect the classes of each list whose count vectors allow the similarity, as stars around the smallest class a task knows."""
    met = in_block_pairs(rows, F.col("df"), F.col("class"))
    keys = ["shingle", "block_a", "block_b"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for table in runs_of(batches, keys):
            ids, sizes, points = table["class"].to_numpy(), table["n"].to_numpy(), table["point"].to_pylist()
            points = Points.read(points)
            change = np.zeros(len(ids), dtype=bool)
            for k in keys:
                c = table[k].to_numpy()
                change[1:] |= c[1:] != c[:-1]
            run_of = np.cumsum(change)
            lengths = np.bincount(run_of)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            plain, head = table["plain"].to_numpy(zero_copy_only=False), table["head"].to_numpy(zero_copy_only=False)
            needed = np.bincount(run_of, weights=head & table["lacking"].to_numpy(zero_copy_only=False)) > 0
            use = plain | needed[run_of]
            few = (lengths[run_of] <= LEAF) & use
            for apart in range(1, int(lengths[lengths <= LEAF].max(initial=1))):
                first = np.flatnonzero(few[:-apart] & few[apart:] & (run_of[:-apart] == run_of[apart:]) & (ids[:-apart] != ids[apart:]))
                if not len(first):
                    continue
                bound = np.minimum(points.coarse[first], points.coarse[first + apart]).sum(axis=1)
                first = first[threshold.enough(bound, sizes[first] + sizes[first + apart])]
                near = first[threshold.enough(points.bound(first, first + apart), sizes[first] + sizes[first + apart])]
                pairs = np.unique(np.stack([ids[near], ids[near + apart]], axis=1), axis=0)
                for a, b in pairs.tolist():
                    forest.join(a, b)
            for r in np.flatnonzero(lengths > LEAF).tolist():
                own = np.arange(starts[r], starts[r + 1])[use[starts[r]:starts[r + 1]]]
                _, single = np.unique(ids[own], return_index=True)
                own = own[single]
                for _ in forest_edges(ids[own], sizes[own], points.part(own), threshold, forest):
                    pass
        nodes, roots = forest.stars()
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    columns = [*keys, "class", "n", "point", "plain", "head", "lacking"]
    return spread(met.select(*columns), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def verified_edges(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, threshold: Threshold) -> DataFrame:
    """Forest edges (a, b) of true links inside each cluster. ``members`` has ``key`` (a document's id), ``class``, ``cluster``, ``size``."""
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = keyed(docs, id_col, text_col).withColumnRenamed(id_col, "key").join(members, "key").select(F.col(text_col).alias("text"), "class", "cluster", "size")

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column(0).to_pylist(), shingle)
            same = [len(s) > 0 and class_of(s) == c for s, c in zip(sets, batch.column(1).to_pylist(), strict=True)]
            kept = batch.filter(pa.array(same))
            yield pa.RecordBatch.from_arrays([kept.column(1), kept.column(2), kept.column(3),
                                              pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())],
                                             names=["class", "cluster", "size", "shingles"])

    sets = texts.mapInArrow(describe, "class long, cluster long, size long, shingles binary")
    keys = ["cluster", "block_a", "block_b"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, keys):
            bounds = [0]
            columns = [table[k].to_numpy() for k in keys]
            change = np.zeros(table.num_rows, dtype=bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            bounds += [*np.flatnonzero(change).tolist(), table.num_rows]
            edges = []
            for start, end in zip(bounds, bounds[1:], strict=False):
                part = table.slice(start, end - start)
                ids, first = np.unique(part["class"].to_numpy(), return_index=True)
                if len(ids) > 1:
                    raw = part["shingles"].to_pylist()
                    edges += cluster_links(ids, [np.frombuffer(raw[i], dtype=np.uint64) for i in first], threshold)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    met = in_block_pairs(sets, F.col("size"), F.col("class")).select(*keys, "class", "shingles")
    return spread(met, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def cluster_links(ids: np.ndarray, sets: list[np.ndarray], threshold: Threshold) -> list[tuple[int, int]]:
    """Forest edges of the links between sets: bounds by count vectors, then true overlaps."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    points = Points([count_vector(s, groups_of(len(s))) for s in sets])

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(a) > 200:
            rows, row = np.unique(a, return_inverse=True)
            columns, column = np.unique(b, return_inverse=True)
            words = np.unique(np.concatenate([sets[i] for i in rows]))
            one = np.zeros((len(rows), len(words)), dtype=np.float32)
            for k, i in enumerate(rows):
                one[k, np.searchsorted(words, sets[i])] = 1
            other = np.zeros((len(columns), len(words)), dtype=np.float32)
            for k, i in enumerate(columns):
                at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
                other[k, at[words[at] == sets[i]]] = 1
            overlap = (one @ other.T)[row, column].astype(np.int64)
        else:
            overlap = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
        return threshold.enough(overlap, sizes[a] + sizes[b])

    return list(forest_edges(ids, sizes, points, threshold, Forest(), exact))


def rooted_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Every row's id, ``n_shingles``, ``hash`` of its text, ``root`` (a class that stands for its component; null without words or id) and ``lowest`` id there."""
    threshold = Threshold(percent)
    size = docs.agg(F.sum(F.octet_length(docs[text_col]))).first()[0] or 0
    level = max(0, math.ceil(math.log2(max(1, size / RANGE_BYTES))))
    blocks = checkpointed(sketch_blocks(docs, id_col, text_col, shingle, threshold))
    totals = head_totals(blocks, level, threshold)
    edges = candidate_edges(meeting_lists(blocks, totals, threshold), threshold)
    parts = F.arrays_zip(F.col("ids").alias("id"), F.col("sizes").alias("n"), F.col("classes").alias("class"), F.col("hashes").alias("hash"))
    drawn = blocks.select(F.explode(parts).alias("row")) \
        .select(F.col("row.id").alias(id_col), F.col("row.n").alias("n_shingles"), F.col("row.class").alias("class"), F.col("row.hash").alias("hash"))
    classes = checkpointed(drawn.where(F.col("class").isNotNull() & F.col(id_col).isNotNull()).groupBy("class").agg(F.min(id_col).alias("key")))
    clusters = components(edges).withColumnsRenamed({"node": "class", "root": "cluster"})
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    members = checkpointed(clusters.join(sizes, "cluster").join(classes.select("class", "key"), "class").select("key", "class", "cluster", "size"))
    links = checkpointed(verified_edges(docs, members, id_col, text_col, shingle, threshold))
    joined = components(links).withColumnsRenamed({"node": "class", "root": "root"})
    keyed_roots = joined.join(classes.select("class", "key"), "class")
    lowest = keyed_roots.groupBy("root").agg(F.min("key").alias("lowest"))
    named = checkpointed(keyed_roots.join(lowest, "root").select("class", "root", "lowest"))
    out = drawn.join(classes.select("class", "key"), "class", "left").join(named, "class", "left")
    known = F.col(id_col).isNotNull()
    return out.select(id_col, "n_shingles", "hash", F.when(known, F.coalesce("root", "class")).alias("root"), F.when(known, F.coalesce("lowest", "key", id_col)).alias("lowest"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` of every row.

    ``component_id`` is the smallest id that chains of links reach, its own
    included. A link is a similarity of at least ``percent`` per cent between
    the sets of distinct word shingles. A text of fewer words than a shingle
    has one shingle, all its words; a null text, or one without words, has none
    and links with nothing. A row with a null id has a null component and links
    nothing. Repeated rows give a row each and share a component; an id that
    stands with unlike texts has a row for each, in the component of that text.
    Other columns are ignored; an empty table gives no rows. Sets are told
    apart by 64-bit hashes.
    """
    return rooted_rows(docs, id_col, text_col, shingle, percent).select(id_col, "n_shingles", F.col("lowest").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each component, with all its columns.

    A document is an id with a text: an id that stands with unlike texts is a
    document in the component of each. Rows that repeat both are one document,
    of which one row stays, and of like texts with the smallest id one stays.
    Rows without words or with a null id are no copies of anything and stay; an
    empty table gives no rows.
    """
    found = checkpointed(rooted_rows(docs, id_col, text_col, shingle, percent).where("root IS NOT NULL").select(id_col, "hash", "root"))
    documents = found.groupBy(id_col, "hash", "root").agg(F.count("*").alias("rows"))
    first = found.groupBy("root").agg(F.min(F.struct(id_col, "hash")).alias("first"))
    judged = documents.join(first, "root").withColumn("stays", F.struct(id_col, "hash") == F.col("first"))
    gone = checkpointed(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col(id_col).alias("__id"), F.col("hash").alias("__hash"), "stays"))
    small = gone.count() <= BROADCAST_ROWS
    marks = lambda rows: F.broadcast(rows.drop("stays")) if small else rows.drop("stays")
    same = (docs[id_col] == F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    kept = docs.join(marks(gone), same, "left_anti")
    repeated = gone.where("stays")
    if repeated.isEmpty():
        return kept
    return kept.unionByName(docs.join(marks(repeated), same, "left_semi").dropDuplicates([id_col, text_col]))
