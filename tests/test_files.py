from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from sowmill import schemas
from sowmill.functions.extract import check_json, run_extractor
from sowmill.sources import files as S


def test_sow_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"client_name": "X", "deliverables": ["d1", "d2"]}, indent=2))
    (tmp_path / "b.json").write_text("{broken")
    rows = S.read_sow_json(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.client_name, r.deliverables) for r in rows] == [("a.json", "X", ["d1", "d2"])]
    assert [r.file_name for r in S.read_sow_json(spark, str(tmp_path), corrupt=True).collect()] == ["b.json"]


def test_texts_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    assert [tuple(r) for r in S.read_texts(spark, str(tmp_path)).collect()] == [("a.txt", "one\ntwo")]
    assert sorted(r.file for r in S.list_documents(spark, str(tmp_path)).collect()) == ["b.pdf", "c.docx"]
    kinds = {r.file: r.k for r in S.read_binary(spark, str(tmp_path)).select("file", S.sniff_format(F.col("content")).alias("k")).collect()}
    assert kinds == {"b.pdf": "pdf", "c.docx": None}


def test_docx(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Hello</w:t></w:p>\n<w:p><w:t>SOW  text</w:t></w:p>")
    (tmp_path / "good.docx").write_bytes(buffer.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"plain text")
    rows = {r.file: r for r in S.docx_text(S.read_binary(spark, str(tmp_path))).collect()}
    assert rows["good.docx"].text == "Hello SOW text" and rows["good.docx"].error is None
    assert rows["bad.docx"].text is None and "BadZipFile" in rows["bad.docx"].error


def test_tables_and_json_round_trip(spark, tmp_path):
    cols = "file string, page_number int, table_index int, row_index int, cells array<string>"
    rows = spark.createDataFrame([("f1", 1, 1, 0, ["a", "b"]), ("f1", 1, 1, 1, ["c", ""]), ("f2", 1, 2, 0, ["x"])], cols)
    S.write_tables(rows, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"))
    assert sorted(tuple(r)[:2] for r in back.where("file = 'f1'").collect()) == [("a", "b"), ("c", None)]
    entry = spark.createDataFrame([("f1", [("n", "1", "t", None, 1.0, 2.0)])], schemas.MINIMAL_FILE)
    S.write_json(entry, str(tmp_path / "j"))
    (tmp_path / "j" / "_combined.json").write_text("{}")
    got = S.combine(spark, str(tmp_path / "j"), schemas.MINIMAL_FILE)
    assert got.count() == 1 and got.first().entries[0].title == "t"
    S.write_texts(spark.createDataFrame([("hello",)], "t string"), "t", str(tmp_path / "x"))
    assert spark.read.text(str(tmp_path / "x")).first()[0] == "hello"


def test_latest_run(spark):
    df = spark.createDataFrame([("run_1", 1), ("run_2", 2), ("run_2", 3)], "source_file string, v int")
    assert sorted(r.v for r in S.latest_run(df).collect()) == [2, 3]


def test_extractor_errors_become_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")

    def extractor(text):
        if text == "bad":
            raise ValueError("no")
        return {"title": text}

    out = run_extractor(df, extractor, "id", "text", retries=1)
    rows = {r.id: (r.record, r.error) for r in out.collect()}
    assert rows == {1: ('{"title": "good"}', None), 2: (None, "ValueError: no")}
    good, bad = check_json(out, "record", "title string", ["title"])
    assert good.first().parsed.title == "good" and bad.first().reason == "no record"


def test_lines_to_rows_is_the_long_form(spark):
    from sowmill.sources import tables as X

    texts = {"a": "Name | Hours\n--- | ---\nX | 1\n\n  \nY | 2 | lost\nZ", "b": "one line", "c": "h\n---", "d": "A | B\n--- | ---\n | "}
    lines = [(f, 1, 1, i, line) for f, t in texts.items() for i, line in enumerate(t.split("\n"))]
    got = X.lines_to_rows(spark.createDataFrame(lines, "file string, page_number int, table_index int, line_no int, line string").repartition(3))
    md = spark.createDataFrame(sorted(texts.items()), "file string, markdown string")
    want = md.select("file", F.posexplode(X.markdown_to_rows(F.col("markdown"))).alias("row_index", "cells"))
    assert sorted((r.file, r.row_index, r.cells) for r in got.collect()) == sorted((r.file, r.row_index, r.cells) for r in want.collect())


def test_layout_lines_are_the_lines_of_the_text(spark, tmp_path):
    from sowmill.functions import text as T

    rows = [("f", 2, 1, "second page"), ("f", 1, 2, "b"), ("f", 1, 1, "a"), ("f", 1, 3, ""), ("f", 5, 1, "last"), ("g", 1, 1, "alone"), ("h", 1, 1, "")]
    lines = spark.createDataFrame(rows, "file string, page int, line_no int, content string").repartition(3)
    want = {r.file: r.text.split("\n") for r in T.layout_text(lines).collect()}
    got = sorted((r.file, r.position, r.line) for r in T.layout_lines(lines).collect())
    assert {f: [line for g, _, line in got if g == f] for f in want} == want and [p for f, p, _ in got if f == "f"] == list(range(1, len(want["f"]) + 1))
    T.write_layout(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "file=f").glob("*.txt"))
    assert "".join(p.read_text() for p in parts).rstrip("\n").split("\n") == want["f"]


def test_one_file_per_document(spark, tmp_path):
    S.write_json(spark.range(5).selectExpr("id", "concat('n', id) AS name"), str(tmp_path / "j"), per_file=1)
    files = [f for f in (tmp_path / "j").glob("*.json") if f.stat().st_size]
    assert len(files) == 5 and sorted(json.loads(f.read_text())["id"] for f in files) == list(range(5))


def test_rejected_answers_are_asked_again_with_the_reason(spark, tmp_path):
    from sowmill.functions.extract import extract_checked

    seen = str(tmp_path / "asked")

    def extractor(text, reason):
        with open(seen, "a") as log:
            log.write(f"{text}:{reason}\n")
        if text == "good" or reason is not None and reason.startswith("missing") and text == "learns":
            return {"title": text}
        if text == "learns":
            return {"other": 1}
        if text == "fails":
            raise ValueError("no")
        return "{broken"

    df = spark.createDataFrame([(1, "good"), (2, "learns"), (3, "fails"), (4, "never")], "id int, text string").coalesce(1)
    out = extract_checked(df, extractor, "id", "text", "title string", ["title"], str(tmp_path / "work"))
    assert {(r.id, r.reason, r.attempts) for r in out.collect()} == {(1, None, 1), (2, None, 2), (3, "ValueError: no", 3), (4, "not valid JSON", 3)}
    assert out.count() == 4
    asked = open(seen).read().split()
    assert sorted(a.split(":")[0] for a in asked if a) .count("good") == 1 and len([a for a in asked if a.startswith("learns")]) == 2
    empty = extract_checked(df.limit(0), extractor, "id", "text", "title string", ["title"], str(tmp_path / "none"))
    assert empty.count() == 0


def test_upper_middle_of_many_values(spark):
    import random

    from sowmill.operators.report import duration_stats, upper_middle

    draw = random.Random(4)
    for n in (1, 2, 5, 400):
        values = [draw.choice([draw.random() * 10**draw.randint(-3, 9), float(draw.randint(1, 5)), 7.5]) for _ in range(n)]
        counts = spark.createDataFrame([(v, 1) for v in values], "v double, n int").groupBy("v").agg(F.sum("n").alias("n"))
        assert upper_middle(counts, "v", "n", buckets=8) == sorted(values)[n // 2]
    assert upper_middle(counts.limit(0), "v", "n") is None
    many = spark.range(1, 300_001).select((F.col("id") * 7).alias("duration_weeks"))
    row = duration_stats(many).first()
    assert (row.min_weeks, row.max_weeks, row.median_weeks) == (7, 2_100_000, 150_001 * 7)
    assert duration_stats(many.limit(0)).first().median_weeks is None


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    tasks = S.FILE_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    rows = spark.range(10 * tasks, numPartitions=1).selectExpr("concat('t', id) AS t")

    def writers(folder):
        return {f.name.split("-")[1] for f in (tmp_path / folder).rglob("part-*")}

    S.write_texts(rows, "t", str(tmp_path / "x"), per_file=1)
    S.write_json(rows, str(tmp_path / "j"), per_file=2)
    S.write_tables(rows.selectExpr("t AS file", "1 AS table_index", "0 AS row_index", "array(t) AS cells"), str(tmp_path / "c"))
    assert len(writers("x")) >= tasks and len(writers("j")) >= tasks and len(writers("c")) > tasks // 2
    assert sorted(r[0].strip() for r in S.read_texts(spark, str(tmp_path / "x")).select("text").collect()) == sorted(r.t for r in rows.collect())


def test_files_of_their_own_hold_every_text(spark, tmp_path):
    texts = ["a\nb", "", None, "ä€😀", "a\nb"]
    S.write_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", str(tmp_path / "x"), per_file=1)
    made = [f for f in (tmp_path / "x").iterdir() if f.name != "_SUCCESS"]
    assert sorted(f.read_bytes().decode() for f in made) == sorted((t or "") + "\n" for t in texts)
    assert {f.suffix for f in made} == {".txt"} and not list((tmp_path / "x").glob(".*.crc"))
    S.write_texts(spark.createDataFrame([("more",)], "t string"), "t", str(tmp_path / "x"), mode="append", per_file=1)
    assert S.read_texts(spark, str(tmp_path / "x")).count() == len(texts) + 1
    row = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS gone, struct(DATE '2025-01-02' AS day) AS s")
    S.write_json(row, str(tmp_path / "j"), per_file=1)
    assert [json.loads(f.read_text()) for f in (tmp_path / "j").glob("*.json")] == [{"id": 1, "s": {"day": "2025-01-02"}}]


def test_many_files_are_read_without_a_list_on_the_driver(spark, tmp_path):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    (tmp_path / "t").mkdir()
    names = {f"f{i}.txt": f"line {i}\nä€😀\r\n".encode() for i in range(300)} | {"a b%20é.txt": b"\xef\xbb\xbfx", "bad.txt": b"\xff\xfe\x80", "none.txt": b"", "_hidden.txt": b"h", ".dot.txt": b"h", "other.json": b"{}"}
    for name, data in names.items():
        (tmp_path / "t" / name).write_bytes(data)
    (tmp_path / "t" / "_temporary").mkdir()
    of_spark = lambda path: spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select("_metadata.file_name", F.col("value").cast("binary"))
    rows = lambda df: sorted((r[0], bytes(r[1])) for r in df.collect())
    texts = S.read_texts(spark, str(tmp_path / "t"))
    assert "FileScan" not in plan(texts)
    assert rows(texts.select("file", F.col("text").cast("binary"))) == rows(of_spark(str(tmp_path / "t")))
    assert S.read_texts(spark, f"file://{tmp_path}/t", "*.{json,none}").collect()[0].file == "other.json"
    records = [S.read_sow_json(spark, str(tmp_path / "t"), corrupt=c, glob="*.{txt,json}") for c in (False, True)]
    assert [("FileScan" in plan(r), r.count()) for r in records] == [(False, 1), (False, 302)]
    # Folders of folders and wildcards stay with Spark's reader.
    (tmp_path / "t" / "k=1").mkdir()
    (tmp_path / "t" / "k=1" / "in.txt").write_text("in")
    for path in (str(tmp_path / "t" / "k=1"), str(tmp_path / "t" / "k=*")):
        assert [tuple(r) for r in S.read_texts(spark, path).collect()] == [("in.txt", "in")]
    assert "FileScan" in plan(S.read_texts(spark, str(tmp_path / "t" / "k=*")))


def test_table_folders_are_those_of_spark(spark, tmp_path):
    cols = "file string, page_number int, table_index int, row_index int, cells array<string>"
    odd = ["a/b", "x=1", "50%", "q?", "ä b", "", None, "[c]{d}", "e'f\"", "007"]
    rows = [(f, 1, t, i, ["f", f"r{i}", "" if i else None, 'say "x", y', "l1\rl2" if t == 2 else " b "]) for f in odd for t in (1, 2, None) for i in range(3)]
    rows = [(f, 1, t, i + 3 * (f == ""), [f"r{i + 3 * (f == '')}", *c[1:]]) for f, _, t, i, c in rows]
    df = spark.createDataFrame([*rows, ("blank", 1, 1, 0, [])], cols).repartition(4)
    S.write_tables(df, str(tmp_path / "own"))
    flat = df.select("file", "table_index", "row_index", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(5)])
    flat = flat.withColumn("file", F.nullif("file", F.lit(""))).repartition("file", "table_index").sortWithinPartitions("file", "table_index", "row_index")
    flat.drop("row_index").write.partitionBy("file", "table_index").csv(str(tmp_path / "spark"), emptyValue="")

    def folders(name):
        return {str(f.parent.relative_to(tmp_path / name)): f.read_bytes() for f in (tmp_path / name).rglob("*.csv")}

    assert folders("own") == folders("spark") and (tmp_path / "own" / "_SUCCESS").exists() and not (tmp_path / "own" / "_temporary").exists()
    kept = spark.read.schema("c0 string, c1 string, c2 string, c3 string, c4 string, file string, table_index int").csv(str(tmp_path / "spark"))
    key = lambda r: [(v is not None, v) for v in r]
    want = sorted((tuple(r) for r in kept.select("file", "table_index", "c0", "c1", "c2", "c3", "c4").collect()), key=key)
    for name in ("own", "spark"):
        back = S.read_tables(spark, str(tmp_path / name), 5)
        assert "FileScan" not in back._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in back.collect()), key=key) == want


def test_cells_are_dealt_once(spark):
    """Sizes and cells meet in one aggregate; nulls in a table's name find no cells, and each declared size makes its rows."""
    from sowmill.sources import tables as X

    cols = "file string, page_number int, table_index int, row_index int, column_index int, content string, row_count int, column_count int"
    rows = [("a", 1, 1, 0, 0, " x ", 3, 2), ("a", 1, 1, 2, 1, None, 3, 2), ("a", 1, 1, 2, 0, "y", 3, 2), ("a", 1, 1, 0, 9, "out", 3, 2),
            ("b", 1, 1, 0, 0, "z", 1, 1), ("b", 1, 1, 0, 1, "w", 1, 2), ("c", 1, 1, 0, 0, "none", 0, 4), (None, 1, 1, 0, 0, "lost", 2, 1)]
    out = X.cells_to_matrix(spark.createDataFrame(rows, cols).repartition(3))
    assert sorted(((r.file or "~", r.row_index, r.cells) for r in out.collect())) == sorted([
        ("a", 0, ["x", ""]), ("a", 1, ["", ""]), ("a", 2, ["y", ""]), ("b", 0, ["z"]), ("b", 0, ["z", "w"]), ("~", 0, [""]), ("~", 1, [""])])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
