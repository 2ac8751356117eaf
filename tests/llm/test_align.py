"""Alignment of two tokenizers: groups, links and counts against a plain search over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import sentencepiece
from llm.cases import similar_texts
from tokenizers import Tokenizer

from sowmill.llm import queries
from sowmill.llm.align import Aligner, align, alignment_blocks, alignment_digest, byte_bpe, common_cuts, most_pairs, pair_counts, piece_bpe
from sowmill.llm.common import checkpointed

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = ["", None, " ", "a", " a", "a ", "a  b", "a\tb", "a\n\nb", "line\nof words", "x y", "　", "日本 語", "naïve éte", "\x00 z", "<|endoftext|> <s> </s> <unk>", "a▁b", "don't  stop", "🙂 ok", "ﬁ", "\x1c y", "\u0085 q"]


def plain_ids(texts):
    """(ids of A, ids of B, their byte strings) of each text, whole; nothing where bytes differ."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {chr(k): k for k in keep}, 256
    for k in range(256):
        if k not in keep:
            letters[chr(n)] = k
            n += 1
    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xs = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        same = b"".join(xs) == b"".join(ys) == (" " + text).encode()
        out.append((x, y, xs, ys) if same else ([], [], [], []))
    return out


def brute(texts):
    """Rows of the digest: tokens, groups, links, best links, sum of counts, checksum."""
    links, groups, sizes = [], [], []
    for x, y, xs, ys in plain_ids(texts):
        sizes.append((len(x), len(y)))
        x_end, y_end, own = [sum(map(len, xs[:i + 1])) for i in range(len(x))], [sum(map(len, ys[:j + 1])) for j in range(len(y))], []
        links.append([(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if x_end[i] == y_end[j]])
        start = 0
        for end in sorted(set(x_end) & set(y_end)):
            own.append((",".join(str(i) for i, e in zip(x, x_end, strict=True) if start < e <= end), ",".join(str(j) for j, e in zip(y, y_end, strict=True) if start < e <= end)))
            start = end
        groups.append(own)
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(n_a, n_b, len(g), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
             hashlib.sha256(";".join("|".join(p) for p in g).encode()).hexdigest() if g else "") for (n_a, n_b), g, own in zip(sizes, groups, links, strict=True)]


def digest(docs):
    blocks = checkpointed(alignment_blocks(docs, A, B))
    out = alignment_digest(blocks, pair_counts(blocks))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return out


def test_digest_is_that_of_a_plain_search(spark):
    texts = [*ODD_TEXTS, *[t[:300] for t in similar_texts().values()][:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [tuple(r)[1:] for r in sorted(digest(docs).collect())] == brute(texts)


def test_odd_rows(odd):
    small = odd.where("doc_id is null or doc_id != 7")
    rows = small.collect()
    got = sorted(tuple(r)[1:] for r in digest(small).collect())
    assert got == sorted(brute([r.text for r in rows]))
    long = digest(odd.where("doc_id = 7")).first()
    assert long.n_groups == long.n_links > 30_000 and long.n_best > 0


def test_empty_table(nothing):
    assert digest(nothing).count() == 0


def test_groups_join_to_the_text(spark):
    docs = spark.createDataFrame([(1, "Alignment of subword tokens\nin naïve cafés")], "doc_id long, text string")
    row = align(alignment_blocks(docs, A, B)).first()
    _, a_bytes = byte_bpe(A)
    _, b_bytes = piece_bpe(B)
    assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids) and len(row.a_sizes) == len(row.b_sizes)
    i = j = 0
    for n, m in zip(row.a_sizes, row.b_sizes, strict=True):
        assert b"".join(a_bytes[k] for k in row.a_ids[i:i + n]) == b"".join(b_bytes[k] for k in row.b_ids[j:j + m])
        i, j = i + n, j + m
    assert b"".join(a_bytes[k] for k in row.a_ids).decode() == " Alignment of subword tokens\nin naïve cafés"


def test_cuts_and_small_memo():
    assert common_cuts([1, 3, 6], [2, 3, 5, 6]) == ([2, 3], [2, 4]) and common_cuts([], []) == ([], [])
    small, large = Aligner(A, B), Aligner(A, B)
    small.memo.most = 7
    texts = list(similar_texts(9).values())
    for at in range(0, len(texts), 5):
        one, other = small.of_texts(pa.array(texts[at:at + 5])), large.of_texts(pa.array(texts[at:at + 5]))
        assert all(x.tolist() == y.tolist() for c, d in zip(one, other, strict=True) for x, y in zip(c, d, strict=True))


def test_table_of_pairs_is_bounded_by_the_vocabularies():
    (_, a), (_, b) = byte_bpe(A), piece_bpe(B)
    assert most_pairs([b"a", b"ba", b"c"], [b"ba", b"a", b"xa"]) == 5
    assert most_pairs(a, b) < 1_000_000


def test_query_over_table(spark, sf_dir):
    rows = sorted(queries.QUERIES["op13_align_tokens"](spark, sf_dir).collect())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    plain = plain_ids([docs[r.doc_id] for r in rows])
    assert len(rows) == len(docs) and [(r.n_a, r.n_b) for r in rows] == [(len(x), len(y)) for x, y, _, _ in plain]
    count, own = Counter(), []
    for x, y, xs, ys in plain:
        ends, at = {}, 0
        for i, t in zip(x, xs, strict=True):
            at += len(t)
            ends[at] = i
        at, links = 0, []
        for j, t in zip(y, ys, strict=True):
            at += len(t)
            if at in ends:
                links.append((ends[at], j))
        own.append(links)
        count.update(links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    assert [(r.n_links, r.n_best, r.count_sum) for r in rows] == [(len(o), sum(count[p] == best[p[1]] for p in o), sum(count[p] for p in o)) for o in own]


def test_whole_texts_are_encoded_in_small_groups_and_memos_are_dropped():
    import numpy as np
    import pyarrow as pa
    from sowmill.llm import common, words

    seen = []

    def whole(texts):
        seen.append(sum(len(t) for t in texts))
        return [(np.array([len(t) for t in texts]), np.ones(len(texts), dtype=np.int64))]

    texts = ["a  b" + "c" * (k % 7) * 1000 for k in range(400)] + ["plain", "  " + "d" * (1 << 19)]
    memo = words.Memo(lambda parts: [(np.array([len(p) for p in parts]), np.ones(len(parts), dtype=np.int64))], whole, [np.int64], 10)
    assert [int(v.sum()) for v in memo.of_texts(pa.array(texts))[0]] == [len(t) for t in texts]
    assert len(seen) > 4 and sum(n > 2 * words.WHOLE_BYTES for n in seen) == 1
    common.WORKER_CACHES["tests"] = {"kept": 1}
    try:
        common.forget("tests")
        assert common.WORKER_CACHES["tests"]
        common.forget()
        assert not any(common.WORKER_CACHES.values())
    finally:
        del common.WORKER_CACHES["tests"]
