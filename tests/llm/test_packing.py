"""Packing: an exact round trip through the tokenizer, full windows, and the level rule against a plain search."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sowmill.llm.packing import Packer, pack, piece_digest

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(rows, texts, tokenizer, window):
    """Every token of every document is in one piece, and windows have no gaps."""
    expected = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length > 0
    found = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        at = 0
        while pieces:
            part = next((p for p in pieces if p.start == at), pieces[0])
            if part.start == 0:
                found.append([])
            pieces.remove(part)
            found[-1] += np.frombuffer(part.ids, dtype="<u4").tolist()
            at = part.start + part.length
            if at == part.doc_tokens:
                at = 0
    assert sorted(found) == expected
    for pieces in windows.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for p in pieces:
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)


def test_round_trip_over_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(pack(docs, PATH).collect(), [r.text for r in docs.collect()], tokenizer, 2048)


@pytest.mark.parametrize("window, max_open", [(16, 3), (64, 2048)])
def test_odd_rows_and_small_windows(odd, tokenizer, window, max_open):
    single = odd.where("doc_id is null or doc_id not in (6, 7)")
    check(pack(single, PATH, window=window, max_open=max_open).collect(), [r.text for r in single.collect()], tokenizer, window)


def test_repeated_rows_are_packed_each(odd, tokenizer):
    rows = pack(odd.where("doc_id = 6"), PATH).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens and sorted(r.start for r in rows)[:2] == [0, 0]


def test_empty_table_and_columns(nothing):
    out = piece_digest(pack(nothing, PATH))
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"] and out.count() == 0


def test_level_adds_least_squares():
    draw = random.Random(2)
    for _ in range(300):
        packer = Packer(12, 10**9)
        packer.count[1:12] = [draw.choice([0, 0, 1, 2, 3]) for _ in range(11)]
        size = draw.randint(1, 12)

        def cost(level, packer=packer, size=size):
            after = packer.count.copy()
            if level:
                after[level] -= 1
            if level + size < 12:
                after[level + size] += 1
            return int((after[1:12] ** 2).sum())

        open_levels = [0, *[h for h in range(1, 12) if packer.count[h] and h + size <= 12]]
        chosen = packer._level(size)
        assert chosen in open_levels and cost(chosen) == min(map(cost, open_levels))
        assert chosen == max(h for h in open_levels if cost(h) == cost(chosen))
