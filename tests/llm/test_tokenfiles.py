"""Token files: an exact round trip, places of documents, and what the files carry."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.cases import similar_texts
from tokenizers import Tokenizer

from sowmill.llm import queries
from sowmill.llm.tokenfiles import read_manifest, read_token_files, token_digest, write_token_files
from sowmill.llm.words import byte_memo

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(docs, tokenizer, end=0):
    """(id, start, tokens, checksum) in ascending order of ids."""
    out, at = [], 0
    for key, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_query_over_table(spark, sf_dir, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = queries.QUERIES["op11_token_files"](spark, sf_dir)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [tuple(r) for r in sorted(got.collect())] == expected(docs, tokenizer)


def test_odd_rows(odd, tokenizer, tmp_path):
    write_token_files(odd, str(tmp_path / "t"), PATH, file_bytes=1 << 16)
    rows = read_token_files(odd.sparkSession, str(tmp_path / "t")).collect()
    texts = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(k), [*ids, 0]) for k, ids in texts)
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]


def test_empty_table(nothing, tmp_path):
    write_token_files(nothing, str(tmp_path / "t"), PATH)
    assert token_digest(read_token_files(nothing.sparkSession, str(tmp_path / "t"))).count() == 0
    assert read_manifest(nothing.sparkSession, str(tmp_path / "t")).count() == 0


def test_one_id_with_most_rows_spreads_over_files(spark, tokenizer, tmp_path):
    texts = [(i if i < 200 else 77, f"row {i} " + "word " * 40 + "end") for i in range(2000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    write_token_files(docs, str(tmp_path / "t"), PATH, file_bytes=20_000)
    manifest = read_manifest(spark, str(tmp_path / "t")).orderBy("file").collect()
    assert len(manifest) > 8 and max(m.docs for m in manifest) < 700
    assert all(a.last_id <= b.first_id and a.before + a.tokens == b.before for a, b in zip(manifest, manifest[1:], strict=False))
    rows = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(rows) == 2000 and [r.doc_id for r in rows] == sorted(k for k, _ in texts)
    assert sorted(map(str, [r.ids for r in rows])) == sorted(str([*tokenizer.encode(t, add_special_tokens=False).ids, 0]) for _, t in texts)


def test_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    draw = random.Random(3)
    docs = spark.createDataFrame([(7 * i, " ".join(str(draw.random()) for _ in range(30))) for i in range(16000)], "doc_id long, text string")
    write_token_files(docs, path, PATH, file_bytes=1 << 30, stripe_bytes=1 << 18, index_rows=1000)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    files = [f for f in (tmp_path / "t" / "ids").iterdir() if f.suffix == ".orc"]
    stripes = blooms = 0
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        stripes += reader.getStripes().size()
        column = reader.getSchema().findSubtype("doc_id").getId()
        rows = reader.rows()
        for k in range(reader.getStripes().size()):
            streams = rows.readStripeFooter(reader.getStripes().get(k)).getStreamsList()
            blooms += any(s.getColumn() == column and "BLOOM" in s.getKind().name() for s in streams)
        rows.close()
    assert stripes > len(files) and blooms == stripes
    some = read_token_files(spark, path, [700, 701, 111993])
    assert "In(doc_id" in some._jdf.queryExecution().executedPlan().toString() or "doc_id IN" in some._jdf.queryExecution().executedPlan().toString()
    whole = {r.doc_id: tuple(r) for r in read_token_files(spark, path).collect()}
    assert sorted(tuple(r) for r in some.collect()) == [whole[700], whole[111993]] and len(whole) == 16000


def test_memo_gives_the_tokenizers_ids(tokenizer):
    draw = random.Random(1)
    parts = ["the", "Éa", "x\ny", "a\n\nb", "\t", "don't", "12", "  ", " ", "<|endoftext|>", "日本", "", ".", "\0", "\x1c", "\u0085", "　", "\n"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 9))) for _ in range(600)] + list(similar_texts().values())
    memo = byte_memo(PATH)
    before, memo.most = memo.most, 5
    try:
        for at in range(0, len(texts), 50):
            got = memo.of_texts(pa.array(texts[at:at + 50]))[0]
            assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at:at + 50]]
    finally:
        memo.most = before
