"""Text, chunk, layout and generation behaviour on small inputs."""

import hashlib
import math
import types

import pytest
from pyspark.sql import functions as F

from quarry.functions import chunking, embedding
from quarry.functions import text as T
from quarry.operators import context, layout, search
from quarry.plans import generation
from quarry.schema import ELEMENTS
from quarry.sources import pdf


def one(spark, f, *values, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_sanitize(spark):
    assert one(spark, T.sanitize, "Computer\x00 Vision\x01\nSecond\tline​", "Hello\x00\x08World\r\nLine 2\tEnd", None, "é", "a\rb") == ["Computer Vision\nSecond\tline", "HelloWorld\nLine 2\tEnd", "", "é", "a\nb"]


def test_filenames(spark):
    assert one(spark, T.clean_filename, None, "", "　a.PDF ", " ") == ["upload.pdf", "upload.pdf", "a.PDF", ""]
    assert one(spark, T.extension, "a.b.PDF", "nodot") == ["pdf", ""]


def test_markdown(spark):
    kind = "array<array<string>>"
    got = one(spark, T.markdown, [["A|B", "Line\nBreak"]], [], [["a"], ["b", None]], [[]], None, kind=kind)
    assert got == ["| A\\|B | Line<br>Break |\n| --- | --- |", "", "| a |  |\n| --- | --- |\n| b |  |", "", ""]


def test_html_rows(spark):
    html = "<table><tr><th>Name</th><th>Role</th></tr><tr><td>Alice</td><td>Admin</td></tr><tr><td>lost</table>"
    assert one(spark, T.html_rows, html, "<p>none</p>", None, "<TABLE><tr><td>a</td></tr></tr>", "<table><tr><td>a</td></td><td>b</td></tr>") == [[["Name", "Role"], ["Alice", "Admin"]], [], [], [["a"], ["a"]], [["a", "a", "b"]]]


def test_text_rows(spark):
    assert one(spark, T.text_rows, "Col1\tCol2\nVal1\tVal2", "| a | b |\n\nplain|x") == [[["Col1", "Col2"], ["Val1", "Val2"]], [["a", "b"], ["plain|x"]]]


def test_overlap(spark):
    df = spark.createDataFrame([("First section. Shared text", "Shared text. Second section."), ("data", "are"), ("", "x"), ("x", ""), ("abc", "def")], "a string, b string")
    assert [r.y for r in df.select(T.join_overlap(F.col("a"), F.col("b")).alias("y")).collect()] == ["First section. Shared text. Second section.", "datare", "\nx", "x\n", "abc\ndef"]


def test_citations(spark):
    assert one(spark, T.citations, "b [Source #2] a [Source #1] [Source #2]", "none", None) == [[1, 2], [], []]


@pytest.mark.parametrize("size,overlap", [(0, 0), (-1, 0), (100, -1), (100, 100), (100, 101)])
def test_wrong_windows(size, overlap):
    with pytest.raises(ValueError):
        chunking.chunks(F.lit("x"), size, overlap)


def test_chunks(spark):
    text = "Đây là câu đầu tiên. Đây là câu thứ hai dài hơn một chút. Câu thứ ba kết thúc đoạn.\n\nĐoạn thứ hai bắt đầu ở đây."
    got = chunking.recursive_chunks(text, 50, 10)
    assert len(got) > 1 and all(0 < len(c) <= 50 for c in got) and one(spark, lambda c: chunking.chunks(c, 50, 10), text, " ", None) == [got, [], []]
    assert chunking.recursive_chunks("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunking.recursive_chunks("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]


def test_mock_embedding(spark):
    v = one(spark, embedding.mock_embedding, "Test RAG vector", " ")
    b = hashlib.sha256(b"Test RAG vector").digest()
    raw = [((b[i % 32] + 17 * i) % 256) / 255.0 - 0.5 for i in range(1536)]
    n = math.sqrt(sum(x * x for x in raw))
    assert len(v[0]) == 1536 and all(abs(a - x / n) < 1e-12 for a, x in zip(v[0], raw, strict=True)) and set(v[1]) == {0.0}


def test_batches_skip_blanks_and_retry():
    sent = []

    def fake(texts):
        sent.append(texts)
        return [[float(i + 1)] for i in range(len(texts))]

    assert embedding.embed_texts(["first", " ", "second"], fake, 1) == [[1.0], [0.0], [2.0]] and sent == [["first", "second"]]
    waits, calls = [], []

    def limited(texts):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("429 RESOURCE_EXHAUSTED: quota exceeded; retry in 0.25s")
        return [[1.0]] * len(texts)

    assert embedding.embed_texts(["x"], limited, 1, sleep=waits.append) == [[1.0]] and waits == [0.25]

    def never(texts):
        raise RuntimeError("429 quota; retry in 1.2s")

    with pytest.raises(embedding.QuotaExceeded) as e:
        embedding.embed_texts(["x"], never, 1, retries=0)
    assert e.value.headers == {"Retry-After": "2"}
    with pytest.raises(RuntimeError):
        embedding.openai_client(None)
    with pytest.raises(ValueError):
        embedding.embedder("other")
    with pytest.raises(RuntimeError, match="mismatch"):
        embedding.embed_texts(["x"], lambda t: [[1.0, 2.0]], 1)


def elements(spark, *rows):
    names = [c.split()[0] for c in ELEMENTS.split(", ")]
    return spark.createDataFrame([tuple({"document_id": "d", "element_ordinal": i, "class_name": "Text"} .get(n) if n not in r else r[n] for n in names) for i, r in enumerate(rows)], ELEMENTS)


def test_elements_to_nodes(spark):
    box = [[10.0, 20.0], [100.0, 20.0], [100.0, 50.0]]
    df = elements(
        spark, {"text": "Title", "category": "Title", "points": box}, {"text": "t", "category": "Table", "page_number": 2, "text_as_html": "<table><tr><td>Name</td><td>Role</td></tr><tr><td>Alice</td><td>Admin</td></tr></table>"},
        {"text": "Col1\tCol2\nVal1\tVal2", "category": "Table", "page_number": 4}, {"text": "cap", "category": "FigureCaption", "page_number": 3}, {"text": "  ", "category": "NarrativeText"},
        {"text": "x", "category": "Image", "image_path": "/path/to/chart.png", "page_number": -1}, {"text": "raw", "category": "Table", "page_number": 5, "text_as_html": "<p>"},
    )
    blocks = layout.elements_to_blocks(df)
    rows = blocks.orderBy("block_ordinal").collect()
    assert [(r.block_type, r.page_number, r.image_name) for r in rows] == [("image", 1, "/path/to/chart.png"), ("text", 1, None), ("table", 2, None), ("image", 3, "image-p3-3"), ("table", 4, None), ("table", 5, None)]
    assert tuple(rows[1].bbox) == (10.0, 20.0, 100.0, 50.0) and rows[2].rows == [["Name", "Role"], ["Alice", "Admin"]] and rows[2].text.startswith("| Name | Role |") and rows[4].rows == [["Col1", "Col2"], ["Val1", "Val2"]]
    assert rows[5].rows is None and rows[5].text == "raw"
    nodes = layout.blocks_to_nodes(blocks, 50, 10).orderBy("node_index").collect()
    assert [(n.node_index, n.node_type, bool(n.content)) for n in nodes] == [(0, "image", False), (1, "text", True), (2, "table", True), (3, "image", False), (4, "table", True), (5, "table", True)]
    assert nodes[2].structured_data.rows == [["Name", "Role"], ["Alice", "Admin"]] and nodes[5].structured_data.rows == [] and nodes[1].metadata.bbox == [10.0, 20.0, 100.0, 50.0]


def test_json_drops_bytes(spark):
    df = elements(spark, {"text": "", "category": "Image", "image_bytes": bytearray(b"\x89PNG")})
    text = layout.blocks_as_json(layout.elements_to_blocks(df)).first().json
    assert '"image_size":4' in text and "image_bytes" not in text


def test_partition_falls_back():
    tried = []

    def partitioner(file, strategy, infer_table_structure):
        tried.append((strategy, infer_table_structure))
        if strategy == "auto":
            raise RuntimeError("no")
        return ["ok"]

    assert pdf.partition_file(b"x", "a.pdf", partitioner) == ["ok"] and tried == [("auto", True), ("fast", False)]
    with pytest.raises(pdf.LayoutParseError, match="unstructured"):
        pdf.partition_file(b"x", "a.pdf", None)
    with pytest.raises(pdf.LayoutParseError, match="PDF files only"):
        pdf.partition_file(b"x", "file.xyz", partitioner)


def test_pdf_source_and_rejects(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.PDF").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = pdf.read_pdfs(spark, str(tmp_path))
    assert {r.filename for r in files.select("filename").collect()} == {"a.pdf", "b.PDF"}

    def partitioner(file, strategy, infer_table_structure):
        data = file.read()
        if data == b"bad":
            raise ValueError("broken")
        from types import SimpleNamespace as N

        return [N(text=data.decode(), category="Title", id="e1", metadata=N(page_number=1))]

    good, bad = pdf.parse_files(files, partitioner)
    assert [r.text for r in good.collect()] == ["one"] and [(r.filename, r.status_code) for r in bad.collect()] == [("b.PDF", 422)]


def test_spans(spark):
    page = [(75.0, 800.0, "Left one"), (319.0, 788.0, "Right one"), (75.0, 776.0, "Bảng 1: x"), (75.0, 764.0, "note"), (75.0, 752.0, "a"), (150.0, 752.0, "b"), (300.0, 752.0, "c"), (75.0, 740.0, "d"), (150.0, 740.0, "e"), (300.0, 740.04, "f"), (75.0, 728.0, "Left two"), (75.0, 716.0, "(Nguồn: y)")]
    df = spark.createDataFrame([("d", 1, 595.0, *p) for p in page], "document_id string, page_number int, page_width double, x double, y double, text string")
    rows = pdf.spans_to_blocks(df).orderBy("block_ordinal").collect()
    assert [(r.block_type, r.column) for r in rows] == [("text", "left"), ("text", "right"), ("table", None)]
    assert rows[0].text == "Left one\nnote\nLeft two\n(Nguồn: y)" and rows[2].rows == [["a", "b", "c"], ["d", "e", "f"]] and rows[2].title == "Bảng 1: x" and rows[2].bbox.top == 776.0


def test_requests(spark):
    df = spark.createDataFrame([(1, " ", 5, "vector", None, None), (2, "q", 0, "vector", None, None), (3, "q", 5, "unknown", None, None), (4, " q ", None, None, None, None)], "query_id long, query string, top_k int, search_type string, document_id string, system_instruction string")
    rows = {r.query_id: r for r in search.validate(df).collect()}
    assert all(rows[i].problem for i in (1, 2, 3)) and (rows[4].problem, rows[4].query, rows[4].top_k) == (None, "q", 5)


def test_zero_vectors_come_last(spark):
    nodes = spark.createDataFrame([("a", "d", 0, [0.0, 0.0]), ("b", "d", 1, [1.0, 0.0]), ("c", "e", 0, [-1.0, 0.0]), ("n", "e", 1, None)], "node_id string, document_id string, node_index int, embedding array<float>")
    ask = spark.createDataFrame([(1, [2.0, 0.0], 5, None), (2, [2.0, 0.0], 5, "e")], "query_id long, vector array<double>, top_k int, document_id string")
    rows = search.vector_top_k(search.normalised(nodes), ask).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.node_id) for r in rows] == [(1, "b"), (1, "c"), (1, "a"), (2, "c")] and math.isnan(rows[2].score)


def test_expand_and_merge(spark):
    nodes = spark.createDataFrame([(f"n{i}", "d", i, t, "m") for i, t in ((99, "before"), (100, "First section. Shared text"), (101, "Shared text. Second section."))] + [("z", "e", 5, "other", "m")], "node_id string, document_id string, node_index int, content string, metadata string")
    seeds = spark.createDataFrame([(1, "d", 100, 0.9, 2), (1, "e", 5, 0.95, 1)], "query_id long, document_id string, node_index int, score double, rank int")
    rows = {r.chunk_index: r for r in context.expand(seeds, nodes).collect()}
    assert [rows[i].is_neighbor for i in (99, 100, 101)] == [True, False, True] and rows[99].document_rank == 1 and rows[5].document_rank == 0
    out = context.merge(context.expand(seeds, nodes)).orderBy("place").collect()
    assert [r.chunk_id for r in out] == ["z", "n99..n101"] and out[1].content == "before\nFirst section. Shared text. Second section." and out[1].chunk_indexes == [99, 100, 101] and out[1].expanded_context and not out[0].expanded_context


def test_prompts_and_answers(spark):
    ask = spark.createDataFrame([(1, " what? ", "brief "), (2, "q", None)], "query_id long, query string, system_instruction string")
    found = spark.createDataFrame([(1, 1, "doc-1", " "), (1, 2, "doc-2", "text\n")], "query_id long, place int, document_id string, content string")
    rows = {r.query_id: r for r in generation.answer(generation.build_prompts(ask, found)).collect()}
    assert '<source id="2">\nCitation: [Source #2]\nMetadata: Document ID: doc-2\nContent:\ntext\n</source>' in rows[1].human and "Source #1]" not in rows[1].human
    assert rows[1].system.endswith("Additional response requirements:\nbrief") and rows[2].system == generation.SYSTEM and generation.NO_CONTEXT in rows[2].human
    assert "'what?'" in rows[1].answer and rows[1].citations == [1] and rows[1].citations_valid and rows[2].answer.startswith("Tài liệu")
    said = generation.answer(generation.build_prompts(ask, found), lambda: lambda s, h: types.SimpleNamespace(content=["x"], text="see [Source #9]")).collect()
    assert all(r.citations == [9] and not r.citations_valid for r in said)
