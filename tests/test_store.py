"""The store: publish, list, delete, failed batches, health, and streaming ingest."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quarry.functions import embedding
from quarry.operators import search
from quarry.operators.log import Log, Taken
from quarry.operators.store import DocumentNotFound, Store, missing_columns
from quarry.plans import retrieval
from quarry.schema import REQUESTS
from quarry.streaming import ingest


def made(spark, *ids):
    docs = spark.createDataFrame([(i, f"line one of {i}\nthe second {i}") for i in ids], "doc_id long, text string")
    nodes = embedding.embed_nodes(retrieval.line_nodes(docs), lambda c: embedding.mock_embedding(c, 256))
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("f.pdf").alias("filename")), nodes


def hits(store) -> int:
    """Number of words in the store's posting blocks."""
    return sum(len(r.gaps) for r in store.postings().collect())


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not all(r.healthy for r in store.health().collect())
    assert store.publish(*made(spark, 1, 2), batch_id="b1") == 4
    assert store.publish(*made(spark, 1, 2), batch_id="b1") == 0
    store.publish(*made(spark, 3))
    assert {r.document_id: r.chunk_count for r in store.documents().collect()} == {"1": 2, "2": 2, "3": 2}
    assert [r.node_index for r in store.nodes_of("2").collect()] == [0, 1] and store.document("3").count() == 1
    store._append(made(spark, 9)[1], "nodes", "never-committed")
    assert store.table("nodes").count() == 6 and all(r.healthy for r in store.health().collect())
    store.delete(["2"])
    assert {r.document_id for r in store.table("nodes").collect()} == {"1", "3"} == {d for r in store.table("blocks").collect() for d in set(r.document_ids) - set(r.gone or ())}
    with pytest.raises(DocumentNotFound):
        store.delete(["77"])
    assert missing_columns({"nodes": store.table("nodes")}, {"nodes": ["node_id", "zz"], "other": ["a"]}) == {"nodes": ["zz"], "other": ["a"]}


def test_pages_of_the_listing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for ids in ((1, 2, 3, 4), (5, 6, 7)):
        store.publish(*made(spark, *ids))
    whole = [r.document_id for r in store.documents().collect()]
    assert whole == ["5", "6", "7", "1", "2", "3", "4"]
    pages, after = [], None
    while page := store.documents(3, after).collect():
        pages.append([r.document_id for r in page])
        after = page[-1].created_at, page[-1].document_id
    assert pages == [whole[:3], whole[3:6], whole[6:]]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string").write.parquet(source)
    store = Store(spark, str(tmp_path / "s"))
    as_docs = lambda d: d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("x").alias("filename"))
    as_nodes = lambda d: embedding.embed_nodes(retrieval.line_nodes(d), lambda c: embedding.mock_embedding(c, 256))
    for _ in range(2):
        stream = ingest.stream_documents(spark, source, "doc_id long, text string")
        ingest.publish_stream(stream, store, as_docs, as_nodes, str(tmp_path / "c")).awaitTermination(120)
    assert store.table("nodes").count() == 2 and store.manifest().count() == 1
    # a stream of other files under a new checkpoint numbers its batches from 0 again; none of them is taken for one that is there
    other = str(tmp_path / "in2")
    spark.createDataFrame([(2, "e f"), (3, "g")], "doc_id long, text string").coalesce(1).write.parquet(other)
    stream = ingest.stream_documents(spark, other, "doc_id long, text string")
    ingest.publish_stream(stream, store, as_docs, as_nodes, str(tmp_path / "c2")).awaitTermination(120)
    assert {r.document_id: r.chunk_count for r in store.documents().collect()} == {"1": 2, "2": 1, "3": 1} and hits(store) == 7


@pytest.mark.parametrize("fails", ["documents", "nodes", "vectors", "segments", "blocks", "manifest"])
def test_retry_after_a_failure_counts_once(spark, tmp_path, monkeypatch, fails):
    store = Store(spark, str(tmp_path / "s"))
    append, commit, failures = store._append, store._commit, [fails]

    def broken(df, name, attempt):
        append(df, name, attempt)
        if failures and failures[0] == name:
            raise OSError("the write of " + failures.pop())

    def uncommitted(*args):
        if failures:
            raise OSError(failures.pop())
        return commit(*args)

    monkeypatch.setattr(store, "_append", broken)
    monkeypatch.setattr(store, "_commit", uncommitted)
    with pytest.raises(OSError):
        store.publish(*made(spark, 1), batch_id="b")
    assert store.manifest().count() == 0
    assert store.publish(*made(spark, 1), batch_id="b") == 2 and store.publish(*made(spark, 1), batch_id="b") == 0
    assert [store.table(t).count() for t in ("documents", "nodes", "segments")] == [1, 2, 1] and hits(store) == 7
    assert store.vectors().select(F.explode("node_ids")).count() == 2


def told(store):
    """All that a reader can see of a store."""
    nodes = sorted((r.document_id, r.node_index, r.content) for r in store.table("nodes").collect())
    packs = sorted((n, d) for p in store.vectors().collect() for n, d in zip(p.node_ids, p.document_ids, strict=True) if d not in (p.gone or ()))
    words = sorted((b.lexeme, n) for b in store.postings().collect() for n, d in zip(b.node_ids, b.document_ids, strict=True) if d not in (b.gone or ()))
    return nodes, sorted((r.document_id, r.chunk_count) for r in store.table("documents").collect()), packs, words


def found(spark, store, query):
    ask = spark.createDataFrame([(1, query, 50, "hybrid", None, None)], REQUESTS)
    requests = retrieval.embedded(ask, lambda c: embedding.mock_embedding(c, 256))
    return {(r.document_id, r.node_index) for r in search.retrieve(store.vectors(), store.postings(), requests).collect()}


def test_two_writers_are_ordered_by_the_log_and_not_by_clocks(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.publish(*made(spark, 1, 2))
    # b has read the log before a adds again; its delete comes later in the log and hides both
    assert b.snapshot().version == 1
    a.publish(*made(spark, 1))
    b.delete(["1"])
    assert {r.document_id for r in a.table("nodes").collect()} == {"2"}
    a.publish(*made(spark, 1))
    assert {r.document_id for r in b.table("nodes").collect()} == {"1", "2"} and b.table("nodes").count() == 4
    assert [r.version for r in a.manifest().orderBy("version").collect()] == [1, 2, 3, 4]
    # an entry that another writer puts between the look and the put is looked at first
    put, raced = a.log.put, []

    def late(number, entry):
        if not raced:
            raced.append(b.publish(*made(spark, 7), batch_id="same"))
        return put(number, entry)

    a.log.put = late
    assert a.publish(*made(spark, 7), batch_id="same") == 0 and raced == [2]
    assert a.table("nodes").where("document_id = 7").count() == 2 and a.snapshot().version == 5


def test_many_writers_of_one_log(spark, tmp_path):
    logs = [Log(spark, str(tmp_path / "log")) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: logs[k % 4].append(lambda _: {"k": k}), range(24)))
    assert sorted(numbers) == list(range(1, 25)) and sorted(e["k"] for e in Log(spark, str(tmp_path / "log")).entries().values()) == list(range(24))
    with pytest.raises(Taken):
        logs[0].put(3, {})


def files_in(path):
    return [str(p) for p in path.rglob("*.parquet")]


def test_compaction_leaves_the_same_rows_in_fewer_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for i in range(1, 7):
        store.publish(*made(spark, i, 10 + i))
    store.delete(["2", "13"])
    store.publish(*made(spark, 2))
    store._append(made(spark, 99)[1], "nodes", "never-committed")
    seen, hit, files = told(store), found(spark, store, "line one"), len(files_in(tmp_path / "s"))
    assert ("13", 0) not in hit and ("2", 0) in hit
    version = store.compact()
    assert version == store.snapshot().version and len(store.snapshot().adds) == 1 and not store.snapshot().deletes
    assert told(store) == seen and found(spark, store, "line one") == hit
    assert store.clean(3600) == 0
    assert store.clean(0) > 7 and told(store) == seen and len(files_in(tmp_path / "s")) < files / 3
    assert told(Store(spark, store.path)) == seen and store.compact() is None
    store.delete(["1"])
    assert {d for d, *_ in told(store)[0]} == {d for d, *_ in seen[0]} - {"1"} and ("1", 0) not in found(spark, store, "line one")


def test_soft_deletion_hides_from_those_who_ask_and_can_be_taken_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(*made(spark, 1, 2))
    store.publish(*made(spark, 3))
    store.hide(["1", "3"], "2024-05-01 10:00:00")
    store.show(["3"])
    ids = lambda name, hidden: {r.document_id for r in store.table(name, hidden).collect()}
    assert ids("documents", True) == {"2", "3"} == ids("nodes", True) and ids("documents", False) == {"1", "2", "3"} == ids("nodes", False)
    assert {r.document_id: str(r.deleted_at) for r in store.documents().collect()} == {"1": "2024-05-01 10:00:00", "2": "None", "3": "None"}
    ask = retrieval.embedded(spark.createDataFrame([(1, "line one", 50, "hybrid", None, None)], REQUESTS), lambda c: embedding.mock_embedding(c, 256))
    seen = lambda hidden: {r.document_id for r in search.retrieve(store.vectors(hidden), store.postings(hidden), ask).collect()}
    assert seen(True) == {"2", "3"} and seen(False) == {"1", "2", "3"}
    store.compact()
    store.clean(0)
    assert ids("nodes", True) == {"2", "3"} == seen(True) and ids("documents", False) == {"1", "2", "3"}
    store.show(["1"])
    assert seen(True) == {"1", "2", "3"}


def test_what_others_do_during_a_compaction_stays(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    store.publish(*made(spark, 1))
    store.publish(*made(spark, 2))
    put = store.log.put

    def late(number, entry):
        store.log.put = put
        other.delete(["1"])
        other.publish(*made(spark, 3))
        return put(number, entry)

    store.log.put = late
    assert store.compact() == 5
    assert {d for d, *_ in told(store)[0]} == {"2", "3"} == {d for d, *_ in told(other)[0]}
    # of two compactions of the same attempts the second gives up
    seen, put = told(store), store.log.put
    store.log.put = lambda number, entry: (setattr(store.log, "put", put), other.compact(), put(number, entry))[2]
    assert store.compact() is None and told(store) == seen == told(other)
    assert store.clean(0) > 0 and told(store) == seen


def test_inverted_lists_of_a_store_follow_what_is_added_and_deleted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    some = lambda a, b: spark.createDataFrame([(i, "\n".join(f"line {j} of {i} {i * j % 7}" for j in range(8))) for i in range(a, b)], "doc_id long, text string")
    as_docs = lambda d: d.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("x").alias("filename"))
    add = lambda a, b: store.publish(as_docs(some(a, b)), embedding.embed_nodes(retrieval.line_nodes(some(a, b)), lambda c: embedding.mock_embedding(c, 32)))
    add(0, 60)
    ask = some(0, 90).where("doc_id % 4 = 0").select(F.col("doc_id").alias("query_id"), embedding.mock_embedding(F.col("text"), 32).alias("vector"), F.lit(6).alias("top_k"), F.lit(None).cast("string").alias("document_id"))
    exact = lambda: {(r.query_id, r.document_id, r.node_index) for r in search.vector_top_k(store.vectors(), ask).collect()}
    near = lambda: {(r.query_id, r.document_id, r.node_index) for r in store.nearest(ask).collect()}
    assert near() == exact()  # no lists yet
    store.build_cells(0.97)
    assert len(near() & exact()) >= 0.9 * len(exact()) and len(near()) == len(exact())
    add(60, 90)
    store.delete([str(i) for i in range(0, 60, 5)])
    add(0, 5)
    got, want = near(), exact()
    assert len(got & want) >= 0.9 * len(want) and not {d for _, d, _ in got} & {str(i) for i in range(5, 60, 5)} and any(int(d) >= 60 for _, d, _ in got)
    assert store.clean(0) == 0
    store.compact()
    assert near() == exact() == want and store.clean(0) > 0


def pages(content):
    for line in content.decode().split("/"):
        yield 600.0, [(75.0, 800.0, line)]


def test_files_are_streamed_once_whatever_their_name(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "s"))
    source.mkdir()
    (source / "a.pdf").write_bytes(b"first words/second page")
    (source / "b.pdf").write_bytes(b"other words")
    (source / "c.txt").write_bytes(b"no pdf")

    def run():
        stream = ingest.stream_files(spark, str(source), files_per_batch=1)
        how = {"embed": lambda c: embedding.mock_embedding(c, 256), "pages": pages}
        ingest.ingest_stream(stream, store, str(tmp_path / "c"), **how).awaitTermination(240)
        return sorted((r.filename, r.chunk_count) for r in store.documents().collect())

    assert run() == [("a.pdf", 2), ("b.pdf", 1)]
    # after a restart: the same bytes under other names, old files, and one that is new
    (source / "again.pdf").write_bytes(b"other words")
    (source / "new.pdf").write_bytes(b"third")
    os.utime(source / "new.pdf", (1, 1))
    assert run() == [("a.pdf", 2), ("b.pdf", 1), ("new.pdf", 1)] == run()
    reports = [r.status_code for p in (tmp_path / "s/reports").iterdir() for r in spark.read.schema("status_code int, filename string").json(str(p)).collect()]
    assert reports == [200, 200, 200]


def test_a_batch_of_files_that_failed_is_ingested_when_it_is_tried_again(spark, tmp_path, monkeypatch):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "s"))
    source.mkdir()
    (source / "a.pdf").write_bytes(b"first words")
    how = {"embed": lambda c: embedding.mock_embedding(c, 256), "pages": pages}
    commit, failures = store._commit, [1]

    def once(*args):
        if failures:
            failures.pop()
            raise OSError("gone")
        return commit(*args)

    monkeypatch.setattr(store, "_commit", once)
    with pytest.raises(Exception, match="gone"):
        ingest.ingest_stream(ingest.stream_files(spark, str(source)), store, str(tmp_path / "c"), **how).awaitTermination(240)
    ingest.ingest_stream(ingest.stream_files(spark, str(source)), store, str(tmp_path / "c"), **how).awaitTermination(240)
    assert [(r.filename, r.chunk_count) for r in store.documents().collect()] == [("a.pdf", 1)] and store.snapshot().version == 1
