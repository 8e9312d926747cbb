"""Files to stored nodes in one call, the report of blocks, and errors as a service gives them."""

import types

import pytest
from pyspark.sql import functions as F

from quarry.functions import embedding, errors
from quarry.operators import layout
from quarry.operators.store import DocumentNotFound, Store, envelope
from quarry.plans import prepared, retrieval
from quarry.sources import pdf


def offline(c):
    return embedding.mock_embedding(c, 256)


def files_of(spark, tmp_path, **named):
    folder = tmp_path / "files"
    folder.mkdir()
    for name, data in named.items():
        (folder / f"{name}.pdf").write_bytes(data)
    return pdf.read_pdfs(spark, str(folder))


def pages(content):
    if content == b"broken":
        raise ValueError("no trailer")
    if content == b"empty":
        return
    for line in content.decode().split("/"):
        yield 600.0, [(75.0, 800.0, line), (320.0, 780.0, "right"), (75.0, 760.0, "Bảng 1"), *((75.0 + 90 * i, 740.0, c) for i, c in enumerate("xyz"))]


def test_spans_of_files_end_in_the_store(spark, tmp_path):
    files = files_of(spark, tmp_path, one=b"first page/second page", two=b"other words", bad=b"broken", none=b"empty")
    store = Store(spark, str(tmp_path / "s"))
    report = {r.filename: r for r in retrieval.ingest_files(store, files, offline, pages=pages).collect()}
    assert {n: (r.status_code, r.chunk_count) for n, r in report.items()} == {"one.pdf": (200, 6), "two.pdf": (200, 3), "bad.pdf": (422, 0), "none.pdf": (422, 0)}
    assert "no trailer" in report["bad.pdf"].message and "no extractable text" in report["none.pdf"].message
    assert {r.filename: r.chunk_count for r in store.documents().collect()} == {"one.pdf": 6, "two.pdf": 3}
    own = store.nodes_of(report["one.pdf"].document_id).collect()
    assert [n.node_type for n in own] == ["text", "text", "table"] * 2 and own[0].content == "first page" and own[2].structured_data.rows == [["x", "y", "z"]] and own[3].metadata.page_number == 2
    ask = spark.createDataFrame([(1, "second page", 2, "hybrid", None, None)], "query_id long, query string, top_k int, search_type string, document_id string, system_instruction string")
    best = retrieval.contexts(*prepared.search_tables(store), retrieval.embedded(ask, offline)).orderBy("place").first()
    assert "second page" in best.content and best.document_id == report["one.pdf"].document_id


def test_elements_of_files_and_all_codes(spark, tmp_path):
    def partitioner(file, strategy, infer_table_structure):
        data = file.read()
        if data == b"broken":
            raise ValueError("bad")
        N = types.SimpleNamespace
        return [] if data == b"empty" else [N(text=" " if data == b"blank" else data.decode(), category="NarrativeText", id="e", metadata=N(page_number=1))]

    files = files_of(spark, tmp_path, good=b"some text", bad=b"broken", none=b"empty", blank=b"blank")
    odd = spark.createDataFrame([("x1", "a.txt", 3, bytearray(b"abc")), ("x2", "big.pdf", 21 << 20, bytearray(b"abc")), ("x3", " ", 3, bytearray(b"abc"))], "document_id string, filename string, file_size int, content binary")
    store = Store(spark, str(tmp_path / "s"))
    report = retrieval.ingest_files(store, files.unionByName(odd), offline, partitioner=partitioner).collect()
    assert {r.filename: r.status_code for r in report} == {"good.pdf": 200, "bad.pdf": 422, "none.pdf": 400, "blank.pdf": 400, "a.txt": 415, "big.pdf": 413, " ": 400}
    assert store.documents().count() == 1 and store.table("nodes").count() == 1
    wrong = retrieval.ingest_files(store, files, offline, 10, 10, partitioner=partitioner).collect()
    assert {r.status_code for r in wrong} == {422} and store.documents().count() == 1


def test_default_backend_reads_auto_as_hi_res(monkeypatch):
    tried = []

    def backend(file, strategy, infer_table_structure):
        tried.append((strategy, infer_table_structure))
        if strategy != "fast":
            raise RuntimeError("no OCR")
        return ["ok"]

    monkeypatch.setattr(pdf, "default_partitioner", lambda: backend)
    assert pdf.partition_elements(b"x", "a.pdf") == ["ok"] and tried == [("hi_res", True), ("fast", False)]


def test_report(spark, tmp_path):
    spans = spark.createDataFrame([("d", 1, 600.0, 75.0, 800.0, "a"), ("d", 1, 600.0, 400.0, 790.0, "b"), ("e", 1, 600.0, 75.0, 800.0, "c")], "document_id string, page_number int, page_width double, x double, y double, text string")
    blocks = pdf.complete(pdf.spans_to_blocks(spans))
    assert layout.write_report(blocks, str(tmp_path / "r")) == {"text": 3}
    assert spark.read.json(str(tmp_path / "r/blocks")).count() == 3
    assert {(r.document_id, r.blocks) for r in spark.read.json(str(tmp_path / "r/counts")).collect()} == {("d", 2), ("e", 1)}


@pytest.mark.parametrize(
    ("error", "code", "message"),
    [(DocumentNotFound("d7"), 404, "d7"), (errors.RequestError("no", 415), 415, "no"), (pdf.LayoutParseError("bad"), 422, "bad"), (ValueError("x"), 422, "Request validation failed."), (OSError("secret path"), 500, "An unexpected server error occurred.")],
)
def test_errors(error, code, message):
    assert (errors.answer_of(error).status_code, errors.answer_of(error).message) == (code, message)
    assert errors.answer_of(embedding.QuotaExceeded("x", 2.1)).headers == {"Retry-After": "3"}


def test_envelope(spark):
    r = spark.range(1).select(envelope(F.col("id")).alias("e")).first().e
    assert (r.success, r.message, r.data) == (True, "OK", 0)
