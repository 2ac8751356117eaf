"""Phrases whose words stand together more often than apart, by mergeable Misra-Gries summaries.

1. Blocks. A task turns its texts into blocks: the words of each language and
   the texts as places in that list, with a mark between pieces.
2. Words and pairs. A block sends each n-gram of one or two words once, as a
   64-bit hash with its count, to the hash partition that owns it. The owner
   reads its counts in batches and merges them into a Misra-Gries summary. The
   summary has more counters than the partition's mass divided by the
   threshold, so every n-gram that reaches the threshold is still in it at the
   end. A second pass over the same counts sums those n-grams exactly, and tells
   the blocks the sums of theirs, naming one block to spell each n-gram out.
3. Triples. A frequent triple is made of two frequent pairs, so only these go
   out, spelled out and sorted, to a second exchange of the same kind.
4. Scores are joins of the frequent n-grams in exact decimal arithmetic.

A frequent n-gram is one entry of a block, so no partition is hot, and the
number of partitions grows with the mass. Partitions are ranges of hashes, so
what a block sends is sorted and packs well; answers come in the same order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sowmill.llm.blocks import merged, packed, packed_sorted, unpacked, unpacked_sorted
from sowmill.llm.common import checkpointed, chunks, keyed

BLOCK_BYTES = 12 << 20
#: N-gram occurrences of one hash partition, about.
PART_MASS = 1 << 20

_BREAK = 0xFF
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _BREAK if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def longer(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hash of an n-gram and one more word."""
    return _mixed(front * _MULTIPLIER + back)


def words_and_breaks(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with the break byte between pieces; blanks and tabs divide words."""
    return text.translate(_TABLE).replace(b"\xff", b" \xff ").split()


class Summary:
    """Misra-Gries counters: ``true - taken <= counter <= true`` for every item, one that is not held having a counter of 0."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Add the counters of another summary of the same capacity, or plain counts."""
        self.keys, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        total = np.zeros(len(self.keys), dtype=np.int64)
        np.add.at(total, place, np.concatenate([self.counts, counts]))
        self.counts, self.taken = total, self.taken + taken
        if len(self.keys) > self.capacity:
            least = int(np.partition(total, len(total) - self.capacity - 1)[len(total) - self.capacity - 1])
            stay = total > least
            self.keys, self.counts, self.taken = self.keys[stay], total[stay] - least, self.taken + least

    def reaching(self, threshold: int) -> np.ndarray:
        """Sorted items that may have ``threshold``, among them all that do if the mass is below capacity times threshold."""
        return self.keys[self.counts + self.taken >= threshold]


def survivors(batches: Iterable[tuple[np.ndarray, np.ndarray]], mass: int, threshold: int) -> np.ndarray:
    """Sorted items of a summary of all batches of (keys, counts) with more counters than mass divided by threshold."""
    summary = Summary(mass // threshold + 1)
    for keys, counts in batches:
        summary.merge(keys, counts)
    return summary.reaching(threshold)


class Block:
    """Texts of one block as places of words: 0 between pieces, words of the block from 1 on."""

    def __init__(self, row: dict):
        raw, sizes = zs.ZstdDecompressor().decompress(row["words"]), unpacked(row["word_sizes"], np.int32)
        self.words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(raw)])
        self.langs, self.lang_of = row["langs"], np.append(0, np.repeat(np.arange(len(row["langs"])), row["lang_words"]))
        self.codes = unpacked(row["codes"], np.int32).astype(np.int64)
        seeds = [xxhash.xxh64_intdigest(lang.encode()) for lang in self.langs]
        hashes = [xxhash.xxh64_intdigest(w, seed=seeds[k]) for w, k in zip(self.words.to_pylist(), self.lang_of[1:].tolist(), strict=True)]
        self.hash = np.array([0, *hashes], dtype=np.uint64)

    def ones(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words (from place 1) and their counts."""
        return self.hash[1:], np.bincount(self.codes, minlength=len(self.hash))[1:]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and second word, count and hash of distinct pairs, and the pair that starts at each place (-1: none)."""
        front, back = self.codes[:-1], self.codes[1:]
        whole = np.flatnonzero((front > 0) & (back > 0))
        distinct, place, counts = np.unique(front[whole] << 32 | back[whole], return_inverse=True, return_counts=True)
        first, second = distinct >> 32, distinct & 0xFFFFFFFF
        at = np.full(len(self.codes), -1, dtype=np.int64)
        at[whole] = place
        return first, second, counts, longer(self.hash[first], self.hash[second]), at

    def spelled(self, *words: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(w - 1)) for w in words]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if len(parts) > 1 else parts[0]


def part_of(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hash partition: the first ``level`` bits."""
    return (hashes >> np.uint64(64 - level)).astype(np.int64) if level else np.zeros(len(hashes), dtype=np.int64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of equal columns start, and the end."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def text_blocks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Texts in blocks: ``block``, ``langs`` with ``lang_words`` (distinct) and ``lang_total`` (occurrences), ``words``, ``word_sizes``, ``codes``."""
    source = keyed(docs, text_col, lang_col).select(F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    schema = "block long, langs array<string>, lang_words array<long>, lang_total array<long>, words binary, word_sizes binary, codes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(merged(chunks(batches, "text", BLOCK_BYTES), "text", BLOCK_BYTES)):
            texts: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            words, sizes, totals, codes = [], [], [], []
            for lang in sorted(texts):
                flat = words_and_breaks(b"\n".join(texts[lang])) + [b"\xff"]
                distinct = sorted(set(flat) - {b"\xff"})
                code = dict(zip(distinct, range(len(words) + 1, len(words) + len(distinct) + 1), strict=True)) | {b"\xff": 0}
                own = np.fromiter(map(code.__getitem__, flat), dtype=np.int32, count=len(flat))
                words += distinct
                sizes.append(len(distinct))
                totals.append(int(np.count_nonzero(own)))
                codes.append(own)
            if not words:
                continue
            lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
            yield pa.RecordBatch.from_pylist([{
                "block": (task << 24) + number, "langs": sorted(texts), "lang_words": sizes, "lang_total": totals,
                "words": zs.ZstdCompressor(level=1).compress(b"".join(words)), "word_sizes": packed(lengths), "codes": packed(np.concatenate(codes))}],
                schema=pa.schema([("block", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64())), ("lang_total", pa.list_(pa.int64())),
                                  ("words", pa.binary()), ("word_sizes", pa.binary()), ("codes", pa.binary())]))

    return source.mapInArrow(run, schema)


class Sent:
    """What a block sends of its words and pairs: hashes in order, their counts, and where the runs of equal parts start."""

    def __init__(self, block: Block, pairs: tuple, level: int):
        (ones, one_counts), (_, _, two_counts, twos, _) = block.ones(), pairs
        hashes = np.concatenate([ones, twos])
        self.order = np.argsort(hashes)
        self.hashes, self.counts = hashes[self.order], np.concatenate([one_counts, two_counts])[self.order]
        self.part = part_of(self.hashes, level)
        self.bounds = _runs(self.part)


def short_grams(blocks: DataFrame, level: int) -> DataFrame:
    """Counts of words and pairs of each block, by part."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                sent = Sent(block, block.pairs(), level)
                cuts = list(zip(sent.bounds[:-1].tolist(), sent.bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sent.part[sent.bounds[:-1]]), pa.array([row["block"]] * len(cuts), pa.int64()),
                     pa.array([packed_sorted(sent.hashes[i:j]) for i, j in cuts], pa.binary()),
                     pa.array([packed(sent.counts[i:j].astype(np.uint32)) for i, j in cuts], pa.binary())], names=["part", "block", "keys", "counts"])

    return blocks.mapInArrow(run, "part long, block long, keys binary, counts binary")


def frequent_of(keys: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    """Exact sums of the keys of a hash partition that reach the threshold, at each of their entries; 0 elsewhere.

    The first pass merges summaries of batches, the second sums what is left.
    """
    step = 1 << 18
    found = survivors(((keys[k:k + step], counts[k:k + step]) for k in range(0, len(keys), step)), int(counts.sum()), threshold)
    if not len(found):
        return np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    held = found[place] == keys
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, place[held], counts[held])
    return np.where(held & (total[place] >= threshold), total[place], 0)


def short_answers(grams: DataFrame, threshold: int) -> DataFrame:
    """For each part and block, in the order of what was sent: which keys are frequent, their sums, and which of these the block spells.

    The smallest block that has an n-gram spells it out.
    """
    def run(table: pa.Table) -> pa.Table:
        keys = [unpacked_sorted(k) for k in table["keys"].to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        row = np.repeat(np.arange(len(keys)), np.diff(ends, prepend=0))
        flat = np.concatenate(keys).view(np.int64)
        sums = frequent_of(flat, np.concatenate([unpacked(c, np.uint32) for c in table["counts"].to_pylist()]).astype(np.int64), threshold)
        held = np.flatnonzero(sums)
        order = held[np.lexsort((table["block"].to_numpy()[row[held]], flat[held]))]
        spells = np.zeros(len(flat), dtype=bool)
        spells[order[_runs(flat[order])[:-1]]] = True
        cuts = [(end - len(k), end) for k, end in zip(keys, ends.tolist(), strict=True)]
        parts = [(sums[i:j] > 0, sums[i:j][sums[i:j] > 0], spells[i:j][sums[i:j] > 0]) for i, j in cuts]
        return pa.table([table["block"], table["part"], pa.array([np.packbits(m).tobytes() for m, _, _ in parts], pa.binary()),
                         pa.array([packed(n) if len(n) else b"" for _, n, _ in parts], pa.binary()), pa.array([np.packbits(w).tobytes() for _, _, w in parts], pa.binary())],
                        names=["block", "part", "frequent", "sums", "spells"])

    return grams.groupBy("part").applyInArrow(run, "block long, part long, frequent binary, sums binary, spells binary")


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def long_grams(blocks: DataFrame, answers: DataFrame, level: int, long_level: int) -> DataFrame:
    """Phrases by part, size and language: triples of frequent pairs with their counts in a block, and the words and pairs that it spells with their sums."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = {r["part"]: r for r in right.to_pylist()}
        out = []
        for row in left.to_pylist():
            block = Block(row)
            pairs = block.pairs()
            first, second, _, twos, at = pairs
            sent = Sent(block, pairs, level)
            sums, spells = np.zeros(len(sent.hashes), dtype=np.int64), np.zeros(len(sent.hashes), dtype=bool)
            for i, j in zip(sent.bounds[:-1].tolist(), sent.bounds[1:].tolist(), strict=True):
                own = answered[int(sent.part[i])]
                held = i + np.flatnonzero(_bits(own["frequent"], j - i))
                if len(held):
                    sums[sent.order[held]] = unpacked(own["sums"], np.int64)
                    spells[sent.order[held]] = _bits(own["spells"], len(held))
            n_words = len(block.hash) - 1
            often, one, two = sums[n_words:] > 0, np.flatnonzero(spells[:n_words]), np.flatnonzero(spells[n_words:])
            start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            start = start[often[at[start]] & often[at[start + 1]]]
            distinct, counts = np.unique(at[start] << 32 | block.codes[start + 2], return_counts=True)
            pair, third = distinct >> 32, distinct & 0xFFFFFFFF
            out += [phrases_out(block, long_level, block.hash[1:][one], sums[one], one + 1),
                    phrases_out(block, long_level, twos[two], sums[n_words + two], first[two], second[two]),
                    phrases_out(block, long_level, longer(twos[pair], block.hash[third]), counts, first[pair], second[pair], third)]
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "part long, size int, lang string, phrases binary, counts binary")


def phrases_out(block: Block, level: int, hashes: np.ndarray, numbers: np.ndarray, *words: np.ndarray) -> pa.Table:
    """Rows of phrases of one size, sorted, each followed by a line feed, with their numbers."""
    part = part_of(hashes, level)
    order = np.lexsort((*words[::-1], part))
    part, lang = part[order], block.lang_of[words[0][order]]
    spelled = pc.binary_join_element_wise(block.spelled(*[w[order] for w in words]), pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    offsets, data = np.frombuffer(spelled.buffers()[1], dtype=np.int32, count=len(order) + 1), memoryview(spelled.buffers()[2] or b"")
    bounds = _runs(part, lang)
    squeeze = zs.ZstdCompressor(level=3).compress
    cuts = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return pa.table([pa.array(part[bounds[:-1]], pa.int64()), pa.array([len(words)] * len(cuts), pa.int32()), pa.array([block.langs[lang[i]] for i, _ in cuts], pa.string()),
                     pa.array([squeeze(data[offsets[i]:offsets[j]]) for i, j in cuts], pa.binary()), pa.array([packed(numbers[order[i:j]].astype(np.int64)) for i, j in cuts], pa.binary())],
                    names=["part", "size", "lang", "phrases", "counts"])


def frequent_grams(docs: DataFrame, threshold: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All n-grams of one to three words that occur ``threshold`` times or more, and the words of each language.

    The first table has ``lang``, ``phrase`` (joined by blanks), ``size`` and
    ``f``, the second ``lang`` and ``n``. A null language is ``und``; null,
    empty and blank texts have no words; repeated rows count each; other
    columns are ignored; an empty table gives no rows. N-grams are told apart
    by 64-bit hashes.
    """
    blocks = checkpointed(text_blocks(docs, text_col, lang_col))
    per_lang = blocks.select(F.explode(F.arrays_zip("langs", "lang_total")).alias("row")).groupBy(F.col("row.langs").alias("lang")) \
        .agg(F.sum("row.lang_total").alias("n"))
    mass = 2 * (blocks.select(F.sum(F.aggregate("lang_total", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0)
    level = max(0, math.ceil(math.log2(max(1, mass / PART_MASS))))
    answers = checkpointed(short_answers(short_grams(blocks, level), threshold))

    def run(table: pa.Table) -> pa.Table:
        known, lang_rows, phrases, counts = table["size"].to_numpy() < 3, table["lang"].to_pylist(), [], []
        for data, numbers in zip(table["phrases"].to_pylist(), table["counts"].to_pylist(), strict=True):
            phrases.append(zs.ZstdDecompressor().decompress(data).split(b"\n")[:-1])
            counts.append(unpacked(numbers, np.int64))
        long = np.flatnonzero(~known).tolist()
        found = [(lang_rows[i], p, int(table["size"][i].as_py()), n) for i in np.flatnonzero(known).tolist() for p, n in zip(phrases[i], counts[i].tolist(), strict=True)]
        if long:
            seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(lang_rows)}
            keys = np.array([xxhash.xxh64_intdigest(p, seeds[lang_rows[i]]) for i in long for p in phrases[i]], dtype=np.uint64).view(np.int64)
            sums = frequent_of(keys, np.concatenate([counts[i] for i in long]), threshold)
            ends = np.cumsum([len(phrases[i]) for i in long])
            held = np.flatnonzero(sums)
            _, single = np.unique(keys[held], return_index=True)
            for at in held[single].tolist():
                i = int(np.searchsorted(ends, at, side="right"))
                row = long[i]
                found.append((lang_rows[row], phrases[row][at - int(ends[i]) + len(phrases[row])], 3, int(sums[at])))
        langs, words, sizes, numbers = zip(*found, strict=True) if found else ([], [], [], [])
        return pa.table([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), pa.array(numbers, pa.int64())], names=["lang", "words", "size", "f"])

    grams = long_grams(blocks, answers, level, max(0, level - 2)).groupBy("part").applyInArrow(run, "lang string, words binary, size int, f long")
    return checkpointed(grams.select("lang", F.col("words").cast("string").alias("phrase"), "size", "f")), per_lang


def collocations(docs: DataFrame, threshold: int = 10, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of two or three words of each language by how much more often they stand together than apart.

    A phrase of ``a >= threshold`` occurrences scores, at its worst cut,
    ``floor(1000000 a a / (l r))``, where ``l`` and ``r`` are the occurrences
    of the parts; the first of equal cuts counts. A pair that a frequent triple
    holds in at least half of the pair's occurrences is left out. Order:
    score, then ``a`` descending, then phrase by its bytes.
    """
    grams, per_lang = frequent_grams(docs, threshold, text_col, lang_col)
    words = grams.where("size = 1").select("lang", F.col("phrase").alias("word"), F.col("f").alias("word_f"))
    pairs = grams.where("size = 2").select("lang", "phrase", "f")

    def of(df: DataFrame, key: str, other: DataFrame, name: str, value: str, column: str) -> DataFrame:
        return df.join(other.select(F.col("lang"), F.col(name).alias(key), F.col(value).alias(column)), ["lang", key])

    two = pairs.withColumns({"front": F.substring_index("phrase", " ", 1), "back": F.substring_index("phrase", " ", -1)})
    two = of(of(two, "front", words, "word", "word_f", "l"), "back", words, "word", "word_f", "r")
    three = grams.where("size = 3").withColumns({
        "one": F.substring_index("phrase", " ", 1), "three": F.substring_index("phrase", " ", -1),
        "front": F.substring_index("phrase", " ", 2), "back": F.substring_index("phrase", " ", -2)})
    for key, other, name, value, column in (("one", words, "word", "word_f", "l1"), ("back", pairs, "phrase", "f", "r1"),
                                            ("front", pairs, "phrase", "f", "l2"), ("three", words, "word", "word_f", "r2")):
        three = of(three, key, other, name, value, column)

    def score(a: str, left: str, right: str):
        exact = "decimal(38,0)"
        return F.expr(f"CAST((CAST(CAST({a} AS decimal(19,0)) * CAST({a} AS decimal(19,0)) AS {exact}) * 1000000) "
                      f"div (CAST({left} AS decimal(19,0)) * CAST({right} AS decimal(19,0))) AS long)")

    three = three.withColumns({"s1": score("f", "l1", "r1"), "s2": score("f", "l2", "r2")})
    held = three.select("lang", F.explode(F.array(F.struct(F.col("front").alias("phrase"), F.col("l2").alias("own")),
                                                  F.struct(F.col("back").alias("phrase"), F.col("r1").alias("own")))).alias("pair"), "f") \
        .where("f >= pair.own - f").select("lang", "pair.phrase").distinct()
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    two = two.join(held, ["lang", "phrase"], "left_anti").select("lang", "phrase", F.col("f").alias("a"), "l", "r", score("f", "l", "r").alias("score"))
    best = two.unionByName(three)
    # A language may have most phrases: the best of many parts first, then of fewer, then of all.
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for parts in (many, math.isqrt(many), 1):
        order = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts)) if parts > 1 else F.lit(0)).orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
