"""What publications leave on the disks, and what reads move, stays small against the input."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import embedding
from quarry.operators import context, grid, settings
from quarry.operators.store import Store
from quarry.plans import prepared, retrieval


def small(c):
    return embedding.mock_embedding(c, 32)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, "\n".join(f"line {j} of {i} {i * j % 7}" for j in range(6))) for i in range(60)], "doc_id long, text string")


def about(d):
    return d.select(F.col("doc_id").cast("string").alias("document_id"))


def test_codes_give_vectors_back_bit_by_bit_or_are_not_taken():
    rng = np.random.default_rng(1)
    steps = 2 * rng.integers(0, 256, (500, 40)) - 255.0
    eight_bits = (steps / np.linalg.norm(steps, axis=1, keepdims=True)).astype("f4")
    others = rng.normal(size=(6, 40)).astype("f4")
    others[0] = 0
    others[1, 3], others[2, 5] = np.nan, np.inf
    others[3] = eight_bits[3]
    others[3, 20] = np.nextafter(others[3, 20], np.float32(2))
    codes, exact = grid.coded(np.concatenate([eight_bits, others]))
    assert exact[:500].mean() > 0.98 and not exact[500:].any()
    assert grid.decoded(codes[exact]).tobytes() == eight_bits[exact[:500]].tobytes()
    assert grid.coded(np.zeros((3, 0), "f4"))[1].tolist() == [False] * 3


def test_packs_of_codes_are_read_as_the_vectors_they_are_of(spark):
    rows = [(f"n{i}", f"d{i}", i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(9, 32)).tolist())]
    floats = spark.createDataFrame(rows, "node_id string, document_id string, node_index int, embedding array<float>")
    texts = spark.createDataFrame([(f"t{i}", f"d{i}", i, f"text {i}") for i in range(30)], "node_id string, document_id string, node_index int, content string")
    both = floats.unionByName(embedding.embed_nodes(texts, small).drop("content")).coalesce(1)
    plain, packs = grid.packed(both), grid.packed(both, code=True)
    sizes = sorted((len(p.units) // len(p.node_ids), len(p.node_ids)) for p in packs.collect())
    assert sizes == [(32, 30), (128, 9)]
    for raw in (False, True):
        assert sorted(map(tuple, grid.unpacked(packs, raw).collect())) == sorted(map(tuple, grid.unpacked(plain, raw).collect()))
    assert all(len(p.units) == 128 * len(p.node_ids) for p in grid.uncoded(packs).collect()) and grid.uncoded(packs).columns == packs.columns


def test_the_offline_embedding_is_what_functions_of_arrays_gave(spark):
    texts = ["a", "Test", " ", "", None, "é中"]
    number = lambda d, i: F.pmod(F.conv(F.substring(d, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int") + i * 17, F.lit(256)) / F.lit(255.0) - F.lit(0.5)
    raw = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: number(F.sha2("t", 256), i))
    plain = F.when(~embedding.blank(F.col("t")), F.transform(raw, lambda x: x / embedding.norm(raw)))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embedding.mock_embedding(F.col("t"), 300).alias("v"), plain.alias("p")).collect()
    assert all(r.v == (r.p or [0.0] * 300) for r in rows) and sum(r.p is not None for r in rows) == 3


def test_vector_search_makes_no_posting_blocks_and_a_later_query_adds_them(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(prepared, "own_folder", lambda spark, name: str(tmp_path / name))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    hits = catalogue.QUERIES["vector_search"](spark, str(tmp_path)).count()
    assert hits == 10 and not os.path.exists(tmp_path / "lines/blocks")
    before = {f for f in os.listdir(tmp_path / "lines/nodes")}
    assert catalogue.QUERIES["three_way_search"](spark, str(tmp_path)).count() == 10
    assert os.path.exists(tmp_path / "lines/blocks") and {f for f in os.listdir(tmp_path / "lines/nodes")} == before


def test_what_a_store_writes_leaves_no_shuffle_files_and_is_small(spark, docs, tmp_path):
    local = [d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for own in local for d, _, files in os.walk(own) for f in files if f.startswith("shuffle_")}
    store, was, seen = Store(spark, str(tmp_path / "s")), spark.conf.get(settings.CLEANUP), shuffles()
    spark.range(1000).repartition(7).write.parquet(str(tmp_path / "plain"))
    held = shuffles() - seen
    store._append(spark.range(1000).repartition(7), "some", "attempt")
    until = time.time() + 20
    while shuffles() - seen - held and time.time() < until:  # they are removed on the side
        time.sleep(0.2)
    assert held and not shuffles() - seen - held and spark.conf.get(settings.CLEANUP) == was
    assert store.publish(about(docs), retrieval.line_nodes(docs), embed=small) == 360
    names = [f for d, _, files in os.walk(tmp_path / "s") for f in files if f.endswith(".parquet")]
    assert names and all(".zstd." in f for f in names)
    packs = store.table("vectors").collect()
    assert sum(len(p.units) for p in packs) < 40 * 360 and "nodes" not in spark.read.parquet(f"{store.path}/blocks").columns


def test_ordinals_follow_from_gaps():
    from quarry.operators import segments

    gaps = pa.array([[0, 0, 3, 0, 1], [], [5], None, [0, 2, 2]], pa.list_(pa.int32()))
    for own in (gaps, gaps.slice(1), gaps.slice(2, 1)):
        want = [segments.hits_of(np.array(g or [], "i4"), np.zeros(len(g or []), "i4"))[0].tolist() for g in own.to_pylist()]
        assert segments._ordinals(own).to_pylist() == want


def test_parents_are_put_together_for_hits_alone(spark, docs):
    nodes = retrieval.line_nodes(docs)
    hits = [(1, "3-0", "3", 0, 0.5, 2), (1, "3-3", "3", 3, 0.9, 1), (1, "3-5", "3", 5, 0.4, 3), (2, "3-1", "3", 1, 0.7, 1), (2, "59-4", "59", 4, 0.2, 2), (2, "x-1", "x", 1, 0.1, 3)]
    found = spark.createDataFrame(hits, "query_id long, node_id string, document_id string, node_index int, score double, rank int")
    own = context.parents_of(F.broadcast(found), nodes)
    plain = context.to_parents(found, nodes.withColumn("parent_id", context.parent_of()), context.grouped(nodes))
    assert sorted(map(repr, own.select(*plain.columns).collect())) == sorted(map(repr, plain.collect())) and plain.count() == 4
    told = own._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in told and "SortMergeJoin" not in told  # nodes meet the hits before any exchange


def test_cells_hold_embeddings_as_small_as_the_store_does_and_find_the_same(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(about(docs), retrieval.line_nodes(docs), embed=small, indexes=("vectors",))
    store.build_cells()
    held = spark.read.parquet(f"{store.path}/cells/*/packs").collect()
    assert sum(len(p.node_ids) for p in held) == 360 and sum(len(p.units) for p in held) < 40 * 360  # unit vectors have 256 bytes each
    asked = docs.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), small(F.col("text")).alias("vector"), F.lit(5).alias("top_k"), F.lit(None).cast("string").alias("document_id"))
    exact = {(r.query_id, r.node_id): r.score for r in grid.top_k(store.vectors(), asked).collect()}
    near = {(r.query_id, r.node_id): r.score for r in store.nearest(asked).collect()}
    both = near.keys() & exact.keys()
    assert len(both) >= 0.9 * len(exact) == 54 and all(near[k] == exact[k] for k in both)


def test_cells_query_makes_no_posting_blocks(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(prepared, "own_folder", lambda spark, name: str(tmp_path / name))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    told = catalogue.QUERIES["store_cells_recall"](spark, str(tmp_path)).first()
    assert (told.n_queries, told.n_hits, told.nine_tenths) == (2, 10, True) and not os.path.exists(tmp_path / "cells/blocks")


def test_rounds_of_blocks_hold_every_segment_once_and_leave_other_texts_out_before_the_exchange(spark, monkeypatch):
    from quarry.operators import segments

    monkeypatch.setattr(segments, "SEGMENT", 16)
    monkeypatch.setattr(segments, "NEIGHBOURS", 4)
    nodes = spark.createDataFrame([(f"n{i}", f"d{i // 3}", i % 3, f"a b{i % 7} a c{i}") for i in range(300)], "node_id string, document_id string, node_index int, content string")
    held = lambda df: sorted((r.segment, r.lexeme or "", tuple(r.gaps or ()), tuple(r.node_ids or ())) for r in df.collect())
    parts = [segments.by_segment(nodes, "x", 300, i, 3) for i in range(3)]
    assert sorted(x for p in parts for x in held(p)) == held(segments.by_segment(nodes, "x", 300)) and all(held(p) for p in parts)
    plan = parts[1]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.rindex("Filter") > plan.rindex("Repartition")
    assert segments.rounds(300, 1) == 4 and segments.rounds(300, 2) == 2 and segments.rounds(3, 8) == 1
