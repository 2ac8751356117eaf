"""Repeated substrings: suffix arrays, common prefixes, merging and removal against plain counting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from llm.cases import similar_texts

from sowmill.llm import substrings
from sowmill.llm.substrings import gram_hashes, parcels, remove_repeats, removal_digest, repeated_anchors, resolve, rolling, stretches, text_blocks
from sowmill.llm.suffixes import Shard, common_prefixes, joined, suffix_array


def removed(texts, width):
    """Marks of the bytes that go, for texts given as a list of bytes."""
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                marks[i:i + width] = b"\1" * width
        out.append(marks)
    return out


def check(docs, width, gram, **options):
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    expected = Counter()
    for r, text, marks in zip(rows, texts, removed(texts, width), strict=True):
        kept = bytes(b for b, m in zip(text, marks, strict=True) if not m)
        spans = sum(m and (i == 0 or not marks[i - 1]) for i, m in enumerate(marks))
        expected[r.doc_id, len(text), sum(marks), spans, hashlib.sha256(kept).hexdigest()] += 1
    found = removal_digest(remove_repeats(docs, width=width, gram=gram, **options)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == expected
    return found


def random_parts(draw):
    letters = draw.choice([b"ab", b"abcd"])
    parts = [bytes(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(1, 8))]
    return [p * draw.choice([1, 1, 2]) for p in parts]


def test_suffix_order_and_common_prefixes():
    draw = random.Random(1)
    for _ in range(60):
        width, parts = draw.choice([5, 9, 16, 20]), random_parts(draw)
        data, starts = joined(parts)
        order, rank = suffix_array(data, width)
        shared = common_prefixes(data, order, rank, starts, width)
        raw = bytes(data)
        assert sorted(order.tolist()) == list(range(len(raw)))
        for k in range(1, len(order)):
            a, b = raw[order[k - 1]:], raw[order[k]:]
            assert a[:width] <= b[:width]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(same, width)


def test_shards_and_merging():
    draw = random.Random(2)
    for _ in range(120):
        width, parts = draw.choice([5, 9, 16, 20]), random_parts(draw)
        counts = np.array([draw.choice([1, 1, 1, 2]) for _ in parts])
        seen = Counter()
        for p, n in zip(parts, counts.tolist(), strict=True):
            for i in range(len(p) - width + 1):
                seen[p[i:i + width]] += n
        expected = [[seen[p[i:i + width]] > 1 for i in range(len(p) - width + 1)] for p in parts]
        assert [f.tolist() for f in Shard(parts, counts, width).repeated()] == expected
        assert [f.tolist() for f in resolve(parts, counts, width, array_bytes=40)] == expected


def test_stretches_cover_all_windows_and_anchors_follow_content(monkeypatch):
    monkeypatch.setattr(substrings, "STEP", 50)
    draw = random.Random(3)
    data = bytes(draw.choice(b"abcab") for _ in range(700))
    data += data[100:300]
    flat = np.frombuffer(data, dtype=np.uint8)
    hashes, begins, counts = stretches(flat, np.array([len(data)]), 40, 8)
    windows = [i for b, n in zip(begins.tolist(), counts.tolist(), strict=True) for i in range(b, b + n)]
    assert windows == list(range(len(data) - 39))
    sizes = np.array([0, 39, 40, 200, 0, 1, 41, 300, len(data) - 621])
    ends = np.cumsum(sizes)
    parted = stretches(flat, sizes, 40, 8)
    places = [i for b, n in zip(parted[1].tolist(), parted[2].tolist(), strict=True) for i in range(b, b + n)]
    assert places == [i for size, end in zip(sizes.tolist(), ends.tolist(), strict=True) for i in range(end - size, end - 39)]
    whole = dict(zip(windows, np.repeat(hashes, counts).tolist(), strict=True))
    assert [whole[i] for i in places] == np.repeat(parted[0], parted[2]).tolist()
    anchor = dict(zip(windows, np.repeat(hashes, counts).tolist(), strict=True))
    by_content = {}
    for i in windows:
        assert by_content.setdefault(data[i:i + 40], anchor[i]) == anchor[i]
    assert gram_hashes(flat, 8)[100] == gram_hashes(flat, 8)[700]


def test_leading_bytes():
    from sowmill.llm.suffixes import _leading_bytes

    values = np.array([1 << k for k in range(64)] + [(1 << k) - 1 for k in range(1, 65)], dtype=np.uint64)
    assert _leading_bytes(values).tolist() == [8 - (v.bit_length() + 7) // 8 for v in values.tolist()]


def test_hashes_of_windows_tell_contents_apart():
    draw = random.Random(4)
    for width in (1, 7, 32, 50, 200):
        data = bytes(draw.choice(b"ab") for _ in range(900)) * 2
        flat = np.frombuffer(data, dtype=np.uint8)
        found = {(9, data[:700]): [3], (9, data[100:900]): [1, 5], (11, data[900:900 + width]): [0]}
        keys, times, which = substrings.window_hashes(found, width)
        windows = [(c[i:i + width], len(places)) for (_, c), places in found.items() for i in range(len(c) - width + 1)]
        assert len(windows) == len(which) and len(rolling(flat, width, 3)) == len(data) - width + 1
        count, named = Counter(), {}
        for (w, n), k in zip(windows, which.tolist(), strict=True):
            count[w] += n
            assert named.setdefault(w, k) == k
        assert len(set(named.values())) == len(named) == len(keys) and all(times[named[w]] == n for w, n in count.items())
    assert len(substrings.window_hashes({}, 200)[0]) == 0


def test_table_of_edited_copies(spark):
    docs = spark.createDataFrame(list(similar_texts().items()), "doc_id long, text string").repartition(4)
    assert any(0 < r.n_removed < r.n_bytes for r in check(docs, 200, 32))
    check(docs, 50, 16, array_bytes=3000)


def test_runs_within_one_text(spark):
    check(spark.createDataFrame([(1, "ab" * 300), (2, "x" * 199), (3, "x" * 200), (4, "é" * 150 + "y" * 250)], "doc_id long, text string"), 200, 32)


def test_windows_of_hot_anchors(spark):
    docs = spark.createDataFrame(list(similar_texts().items()), "doc_id long, text string").repartition(4)
    for hot_bytes in (0, 3000):
        check(docs, 200, 32, hot_bytes=hot_bytes)
        check(docs, 50, 16, hot_bytes=hot_bytes)


def test_a_common_line_fills_no_group(spark):
    draw = random.Random(6)
    lines = ["".join(draw.choice("abcdefghij") for _ in range(100)) for _ in range(300)]
    line = min(lines, key=lambda t: int(gram_hashes(np.frombuffer(t.encode(), dtype=np.uint8), 64).min()))
    some = lambda: "".join(draw.choice("klmnopqrst") for _ in range(200))
    docs = spark.createDataFrame([(i, some() + line + some()) for i in range(2000)], "doc_id long, text string").repartition(4)
    blocks = text_blocks(docs, "doc_id", "text").cache()
    most = {}
    for hot_bytes in (1 << 40, 20_000):
        sent = parcels(blocks, repeated_anchors(blocks, 4, 200, 64, hot_bytes), 4, 200, 64).collect()
        sizes = Counter()
        for r in sent:
            sizes[r.kind, r.range] += len(r.content)
        most[hot_bytes] = (max(sizes.values()), sum(sizes.values()))
    # One range has most stretches of all texts where no anchor is hot; hashes are spread over 64 ranges.
    assert most[1 << 40][0] > 0.5 * most[1 << 40][1]
    assert most[20_000][0] < 0.05 * most[20_000][1]
    check(docs.limit(300), 200, 64, hot_bytes=20_000)


def test_odd_rows(odd, nothing):
    check(odd, 200, 32)
    check(odd, 32, 32)
    assert remove_repeats(nothing).count() == 0
