"""What a task holds, and what is moved and written, stays in proportion to the input."""

import os
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import chunking, embedding
from quarry.functions import text as T
from quarry.operators import cells, grid, segments
from quarry.operators.store import Store
from quarry.plans import retrieval


def test_embeddings_lie_in_packs_alone_and_indexes_are_made_as_asked(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line one of {i}\n \nthe second {i}") for i in range(9)], "doc_id long, text string")
    about, nodes = docs.select(F.col("doc_id").cast("string").alias("document_id")), retrieval.line_nodes(docs)
    small = lambda c: embedding.mock_embedding(c, 32)
    one, two, bare = (Store(spark, str(tmp_path / n)) for n in ("one", "two", "bare"))
    assert one.publish(about, nodes, embed=small) == 18 == two.publish(about, embedding.embed_nodes(nodes, small)) == bare.publish(about, nodes, indexes=())
    for store in (one, two):
        assert "embedding" not in store.table("nodes").columns
        packs = store.vectors().collect()
        assert sum(len(p.node_ids) for p in packs) == 18 and all(len(p.units) == 4 * 32 * len(p.node_ids) for p in packs)
    wanted = {r.node_id: r.embedding for r in embedding.embed_nodes(nodes, small).collect()}
    assert {r.node_id: r.embedding for r in grid.unpacked(one.vectors(), raw=True).collect()} == wanted
    assert not bare._exists("vectors") and not bare._exists("blocks") and bare.table("nodes").count() == 18


def test_names_lie_once_in_a_segment_and_texts_move_once(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"d{i}", 0, "a b a c " * (i % 5)) for i in range(200)], "node_id string, document_id string, node_index int, content string")
    rows = segments.numbered(nodes, "x", 200)
    assert not {"node_ids", "document_ids"} & set(segments.postings(rows).columns)
    plan = segments.postings(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
    found = {r.lexeme: r for r in segments.blocks(rows).where("lexeme = 'a'").collect()}["a"]
    assert sorted(found.node_ids) == sorted(f"n{i}" for i in range(200) if i % 5) and found.n == 160 and found.best == 8


def most(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_scores_of_many_requests_are_worked_out_in_parts():
    rng = np.random.default_rng(1)
    unit, asked = rng.normal(size=(4000, 8)), rng.normal(size=(4000, 8))
    names, places = pa.array([f"n{i}" for i in range(4000)]), pa.array(range(4000), pa.int32())
    best = grid.Best(asked, list(range(4000)), [3] * 4000, [None] * 4000)
    assert most(lambda: best.add(unit, names, names, places, set())) < 100  # one product has 128 MB
    exact = np.argsort(-(asked[:50] @ unit.T), axis=1)[:, :3]
    assert [[r[4] for r in own] for own in best.rows[:50]] == [[f"n{i}" for i in row] for row in exact]


def test_rows_that_are_dealt_to_many_cells_leave_in_parts():
    rng = np.random.default_rng(2)
    centres, units = rng.normal(size=(400, 16)), rng.normal(size=(3000, 16))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(3001, dtype="i4") * 16), pa.array(units.ravel()))
    batches = list(cells._nearest(centres, 300)([pa.RecordBatch.from_arrays([pa.array(range(3000)), lists], names=["query_id", "unit"])]))
    assert sum(b.num_rows for b in batches) == 3000 * 300 and max(b.num_rows for b in batches) * 16 <= cells.NUMBERS


def test_unfinished_packs_are_bounded(monkeypatch):
    monkeypatch.setattr(grid, "HELD", 8 * 4 * 10)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(101, dtype="i4") * 4), pa.array(np.arange(400.0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), lists, pa.array([i % 50 for i in range(100)], pa.int32())], names=["query_id", "unit", "cell"])
    out = list(grid._packs([("query_id", "query_ids", pa.int64())], "asked", "cell", grid.PACK)([batch.slice(0, 50), batch.slice(50)]))
    assert sorted(q for b in out for q in b.column("query_ids")[0].as_py()) == list(range(100)) and len(out) > 50


def test_a_table_of_many_files_is_streamed_as_a_whole(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.document_id for r in catalogue.QUERIES["streamed_store"](spark, str(tmp_path)).collect()} == {str(r.doc_id) for r in whole.collect()}


def test_only_texts_that_may_not_be_composed_go_to_python(spark):
    texts = ["plain", "caf\u00e9", "cafe\u0301", "\u1112\u1161\u11ab", "\u4e2d", "", None, "\u0344", "\u212b", "x\u02ff"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(T.nfc(F.col("t")).alias("n")).collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert "CASE WHEN" in df.select(T.nfc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_leave_a_task_in_parts(monkeypatch):
    monkeypatch.setattr(chunking, "AT_ONCE", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(40)]), pa.array(["word " * 60, None] * 20)], names=["document_id", "text"])
    out = list(chunking.chunk_rows(100, 10)([batch]))
    assert len(out) > 3 and [r for b in out for r in b.column("content").to_pylist()] == [c for t in ["word " * 60] * 20 for c in chunking.recursive_chunks(t, 100, 10)]


def test_blocks_are_clustered_in_one_pass_and_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(segments, "HITS", 500)
    monkeypatch.setattr(segments, "SEGMENT", 50)
    nodes = spark.createDataFrame([(f"n{i}", f"d{i // 3}", i % 3, "the " * (i % 4) + " ".join(f"w{i * k % 389}" for k in range(1, i % 17))) for i in range(400)], "node_id string, document_id string, node_index int, content string")
    table = segments.clustered(nodes, "x", 400)
    assert "rangepartitioning" not in table._jdf.queryExecution().executedPlan().toString()
    rows = segments.numbered(nodes, "x", 400)
    known, held = segments.parted(table)
    for found, plain in ((known, segments.segments(rows)), (held, segments.postings(rows))):
        keys = [c for c in ("segment", "lexeme") if c in plain.columns]
        assert sorted(map(repr, found.orderBy(*keys).select(*plain.columns).collect())) == sorted(map(repr, plain.collect())) and plain.count() > 3
    parts = [r.k for r in held.select(F.struct(F.spark_partition_id().alias("p"), "lexeme", "segment", F.size("gaps").alias("hits")).alias("k")).collect()]
    of = {p: [r for r in parts if r.p == p] for p in {r.p for r in parts}}
    assert len(of) > 4 and max(sum(r.hits for r in own) for own in of.values()) < 3 * sum(r.hits for r in parts) / len(of)
    assert [(r.lexeme, r.segment) for p in sorted(of) for r in of[p]] == sorted((r.lexeme, r.segment) for r in parts)


def test_a_store_runs_each_text_through_its_lexemes_once(spark, tmp_path, monkeypatch):
    whole = []
    monkeypatch.setattr(segments, "numbered", lambda nodes, name, n, dealt=True, f=segments.numbered: (whole.append(dealt), f(nodes, name, n, dealt))[1])
    monkeypatch.setattr(segments, "LOOKED_AT", 5)
    docs = spark.createDataFrame([(i, f"line one of {i}\nthe second {i}") for i in range(40)], "doc_id long, text string")
    store = Store(spark, str(tmp_path / "s"))
    store.publish(docs.select(F.col("doc_id").cast("string").alias("document_id")), retrieval.line_nodes(docs), indexes=("blocks",))
    assert whole.count(True) == 1 and not os.path.exists(tmp_path / "s" / "segments")
    assert store.table("segments").agg(F.sum("n_nodes")).first()[0] == 80 and sum(len(r.gaps) for r in store.postings().collect()) == 280
    assert all(r.healthy for r in store.health().collect() if r.probe in ("segments", "blocks"))


def test_the_digest_of_a_text_is_no_part_of_what_is_done_for_each_byte(spark):
    plan = spark.range(1).select(embedding.mock_embedding(F.col("id").cast("string"), 32)).select("*")._jdf.queryExecution().analyzed().toString()
    assert "substring(hex" not in plan and "substring(sha2" not in plan and "sha2(" in plan
