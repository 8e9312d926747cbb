"""Search in depth: grids of packs, cells, posting segments, BM25, rerank and metrics, each against a plain version."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry import catalogue
from quarry.functions import embedding
from quarry.functions import text as T
from quarry.operators import cells, context, evaluation, grid, rerank, search, segments
from quarry.operators.cache import VectorCache
from quarry.plans import generation

ASK = "query_id long, query string, top_k int, document_id string"


def made_vectors(spark, n, width, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, width)).astype(float) if ties else rng.normal(size=(n, width))
    rows = [(f"n{i}", f"d{i % 7}", i, x[i].tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "node_id string, document_id string, node_index int, embedding array<double>")


def plain_top(x, asked, k, only=None):
    def unit(v):
        n = math.sqrt(sum(a * a for a in v))
        return [a / n if n else float("nan") for a in v]

    rows = []
    for i, v in enumerate(x):
        if only is None or f"d{i % 7}" == only:
            s = float((np.array(unit(v)) * np.array(unit(asked))).sum())
            rows.append((math.isnan(s), -s if s == s else 0.0, f"d{i % 7}", i))
    return [r[3] for r in sorted(rows)[:k]]


@pytest.mark.parametrize("ties", [False, True])
def test_many_requests_meet_the_vectors_in_a_grid(spark, monkeypatch, ties):
    """With tiny packs every request and vector crosses several bands; no request is on the driver."""
    for name, value in (("PACK", 2048), ("BAND", 2), ("AT_ONCE", 1000)):
        monkeypatch.setattr(grid, name, value)
    x, nodes = made_vectors(spark, 300, 8, ties=ties)
    asked = np.random.default_rng(2).integers(-2, 3, (120, 8)).astype(float)
    rows = [(i, asked[i].tolist(), 1 + i % 9, [None, "", "d3"][i % 3]) for i in range(120)]
    requests = spark.createDataFrame(rows, "query_id long, vector array<double>, top_k int, document_id string").repartition(5)
    got = collections.defaultdict(list)
    for r in search.vector_top_k(search.normalised(nodes), requests).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.node_index)
    for i, _, k, only in rows:
        if ties and (asked[i] == 0).all():
            continue
        want = plain_top(x, asked[i], k, only or None)
        near = [math.isclose(*(float(x[a] @ asked[i] / (np.linalg.norm(x[a]) or 1)) for a in p), abs_tol=1e-9) for p in zip(got[i], want, strict=True)]
        assert got[i] == want or all(near), i


def test_packs_hold_every_vector_once_and_prune_by_document(spark, monkeypatch):
    monkeypatch.setattr(grid, "PACK", 1024)
    x, nodes = made_vectors(spark, 200, 4)
    packs = grid.packed(search.normalised(nodes).repartitionByRange("document_id"))
    held = packs.collect()
    assert sorted(n for p in held for n in p.node_ids) == sorted(f"n{i}" for i in range(200)) and all(len(p.units) == 8 * 4 * len(p.node_ids) <= 1024 for p in held)
    assert all(p.first_document == min(p.document_ids) and p.last_document == max(p.document_ids) for p in held)
    ask = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], 3, "d2")], "query_id long, vector array<double>, top_k int, document_id string")
    assert [r.node_index for r in search.vector_top_k(packs, ask).orderBy("rank").collect()] == plain_top(x, [1.0, 0, 0, 0], 3, "d2")


def test_cells_open_few_and_find_nearly_all(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(60, 16)) for c in centres])
    rows = [(f"n{i}", f"d{i % 5}", i, v.tolist()) for i, v in enumerate(x)] + [("zero", "d0", 5000, [0.0] * 16), ("wide", "d0", 5001, [1.0] * 3)]
    nodes = search.normalised(spark.createDataFrame(rows, "node_id string, document_id string, node_index int, embedding array<double>"))
    index = cells.build(nodes, str(tmp_path / "i"))
    assert index.packs.select(F.explode("node_ids")).count() == len(rows)
    assert index.opens <= len(index.centres) / 3
    asked = spark.createDataFrame([(i, x[i].tolist(), 10, None) for i in range(0, 1200, 17)] + [(9999, [1.0] * 3, 2, None)], "query_id long, vector array<double>, top_k int, document_id string")
    told = cells.recall(index.top_k(asked), search.vector_top_k(nodes, asked)).first()
    assert told.recall >= 0.9 and told.n_queries == 72
    again = cells.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.top_k(asked).collect())) == sorted(map(tuple, index.top_k(asked).collect()))
    with pytest.raises(ValueError):
        cells.build(nodes.where(F.lit(False)), str(tmp_path / "none"))


def test_index_of_the_table_is_near_the_exact_search(spark, sf_dir):
    exact = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["vector_topk_batch"](spark, sf_dir).collect()}
    found = {(r.query_id, r.vec_id): r for r in catalogue.QUERIES["vector_topk_index"](spark, sf_dir).collect()}
    assert len(exact & set(found)) >= 0.9 * len(exact) and len(found) <= len(exact)


# ---- full text


def plain_words(t):
    return re.findall(r"[^\W_]+", t.lower())


def plain_cover(words, terms):
    hits = [(p, terms.index(w)) for p, w in enumerate(words, 1) if w in terms]
    return segments.cover_density(hits, len(terms)) if {t for _, t in hits} == set(range(len(terms))) else None


def made_texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice("aabbbcd" if i % 40 else "xyzab") for _ in range(rng.randint(0, 30))) * (8 if i % 97 == 0 else 1) for i in range(n)]


@pytest.fixture
def made(spark, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT", 16)
    monkeypatch.setattr(segments, "NEIGHBOURS", 4)
    texts = made_texts(600)
    nodes = spark.createDataFrame([(f"n{i:03}", f"d{i // 3:03}", i % 3, t) for i, t in enumerate(texts)], "node_id string, document_id string, node_index int, content string")
    rows = segments.numbered(nodes, "x", len(texts)).persist()
    return texts, segments.blocks(rows).persist(), segments.segments(rows).persist()


def test_cover_density_of_intervals():
    assert segments.cover_density([(1, 0), (2, 1)], 2) == 0.1 and segments.cover_density([(1, 0), (4, 1), (5, 0)], 2) == pytest.approx(0.1 / 3 + 0.1)
    assert segments.cover_density([(1, 0), (2, 0)], 1) == 0.2 and segments.cover_density([(1, 0)], 2) == 0


def test_bound_is_never_below_a_score():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 4)
        hits = [(p, rng.randrange(n)) for p in sorted(rng.sample(range(60), rng.randint(n, 20)))]
        counts = collections.Counter(t for _, t in hits)
        assert segments.cover_density(hits, n) <= segments.bound(n, np.array(min(counts[t] for t in range(n)))) + 1e-12


def test_segments_that_cannot_matter_stay_closed(spark, made):
    texts, blocks, _ = made
    ask = [(0, "a", 3, None), (1, "b a", 4, None), (2, "a c d", 2, None), (3, "x y", 5, None), (4, "none", 5, None), (5, "a b", 3, "d007"), (6, "!!", 3, None)]
    requests = spark.createDataFrame(ask, ASK)
    hits, told, _ = segments.plan(blocks, requests, 2)
    got = collections.defaultdict(list)
    for r in grid.ranked(hits, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.node_id, round(r.score, 9)))
    for i, q, k, only in ask:
        terms = list(dict.fromkeys(plain_words(q)))
        scores = [(f"n{j:03}", plain_cover(plain_words(t), terms)) for j, t in enumerate(texts) if terms and (only is None or only == f"d{j // 3:03}")]
        want = sorted(((n, round(s, 9)) for n, s in scores if s), key=lambda x: (-x[1], x[0]))[: 2 * k]
        assert got[i] == want, q
    opened = {r.query_id: (r.segments, r.opened) for r in told.collect()}
    assert opened[0][1] < opened[0][0] > 20 and opened[1][1] < opened[1][0] and set(opened) == {0, 1, 2, 3, 5}
    whole = {(r.query_id, r.node_id): round(r.score, 9) for r in segments.fulltext_hits(blocks, requests).collect()}
    assert {n for q, n in whole if q == 1} == {f"n{j:03}" for j, t in enumerate(texts) if {"a", "b"} <= set(plain_words(t))}


def test_more_terms_than_the_driver_takes(spark, made, monkeypatch):
    texts, blocks, _ = made
    requests = spark.createDataFrame([(i, q, 3, None) for i, q in enumerate(["a", "b a", "a c d"])], ASK)
    few = sorted(map(tuple, segments.fulltext_top_k(blocks, requests).collect()))
    monkeypatch.setattr(segments, "TERMS", 2)
    assert sorted(map(tuple, segments.fulltext_top_k(blocks, requests).collect())) == few and len(few) == 9


def test_bm25_equals_a_plain_version(spark, made):
    texts, blocks, totals = made
    words = [plain_words(t) for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    requests = spark.createDataFrame([(0, "a x", 7, None), (1, "d", 5, "d002"), (2, "none", 5, None)], ASK)
    got = collections.defaultdict(list)
    for r in segments.bm25_top_k(blocks, totals, requests).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.node_id, round(r.score, 6)))
    for i, terms, k, only in ((0, ["a", "x"], 7, None), (1, ["d"], 5, "d002")):
        df = {t: sum(t in w for w in words) for t in terms}
        score = lambda w: sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)  # noqa: E731, B023
        rows = [(f"n{j:03}", round(score(w), 6)) for j, w in enumerate(words) if set(terms) & set(w) and (only is None or only == f"d{j // 3:03}")]
        assert got[i] == sorted(rows, key=lambda x: (-x[1], x[0]))[:k]
    assert 2 not in got


def test_opened_segments_of_the_table(spark, sf_dir):
    rows = {r.query_id: r for r in catalogue.QUERIES["fulltext_segments_opened"](spark, sf_dir).collect()}
    assert set(rows) == {0, 1, 2, 3} and all(1 <= r.opened <= r.segments for r in rows.values())


def test_hits_of_one_parent_are_one_context(spark):
    nodes = spark.createDataFrame([("d", i, f"d-{i}", f"t{i}", "m") for i in range(10)] + [("e", 0, "e-0", "u", "m")], "document_id string, node_index int, node_id string, content string, metadata string")
    found = spark.createDataFrame([(1, "d-5", 0.9, 1), (1, "e-0", 0.8, 2), (1, "d-4", 0.95, 3), (1, "d-9", 0.1, 4), (2, "d-0", 0.5, 1), (2, "gone", 0.4, 2)], "query_id long, node_id string, score double, rank int")
    rows = context.to_parents(found, nodes.withColumn("parent_id", context.parent_of(4)), context.grouped(nodes, 4)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank, r.score, r.child_ids) for r in rows] == [(1, "d-parent-1", 1, 0.95, ["d-5", "d-4"]), (1, "e-parent-0", 2, 0.8, ["e-0"]), (1, "d-parent-2", 3, 0.1, ["d-9"]), (2, "d-parent-0", 1, 0.5, ["d-0"])]
    assert rows[0].content == "t4\nt5\nt6\nt7" and rows[2].content == "t8\nt9"


# ---- rerank, metrics, overlaps, caches, clients


def test_rerank_scores_bounded_hits_with_one_scorer_a_task(spark, tmp_path):
    made_at = str(tmp_path / "made")

    def make():
        with open(made_at, "a") as f:
            f.write("x")
        return lambda queries, texts: [float(len(t)) for t in texts]

    found = spark.createDataFrame([(1, r, "y" * (r % 5), f"n{r}") for r in range(1, 21)], "query_id long, rank int, content string, node_id string").coalesce(1)
    requests = spark.createDataFrame([(1, "q", 3)], "query_id long, query string, top_k int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = rerank.rerank(found, requests, make, 12).orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.node_id, r.rank, r.rerank_score) for r in got] == [("n4", 1, 4.0), ("n9", 2, 4.0), ("n3", 3, 3.0)]
    with pytest.raises(Exception, match="another number"):
        rerank.rerank(found, requests, lambda: lambda q, t: [], 12).collect()


def test_metrics_of_known_lists(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "b", 3), (2, "x", 1), (4, "a", 1)], "query_id long, item string, rank int")
    relevant = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 1.0), (2, "a", 1.0), (3, "a", 1.0), (1, "x", 0.0)], "query_id long, item string, grade double")
    rows = {r.query_id: r for r in evaluation.per_request(hits, relevant, 3).collect()}
    best = 2 + 1 / math.log2(3) + 1 / 2
    assert set(rows) == {1, 2, 3} and rows[1].recall == pytest.approx(2 / 3) and rows[1].ndcg == pytest.approx((1 + 2 / 2) / best) and rows[1].context_precision == pytest.approx((1 + 2 / 3) / 2)
    assert tuple(rows[2])[1:] == (0, 0, 0) == tuple(rows[3])[1:]
    told = {r.metric: r for r in evaluation.summary(evaluation.per_request(hits, relevant, 3)).collect()}
    assert told["recall"].mean == pytest.approx(2 / 9) and told["recall"].low <= told["recall"].mean <= told["recall"].high
    drawn = spark.range(20_000).select(evaluation.times_drawn(F.col("id"), F.lit(1)).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(drawn[0] - 1) < 0.03 and abs(drawn[1] - 1) < 0.05


@pytest.mark.parametrize("seed", range(5))
def test_overlap_is_the_longest_and_linear(seed):
    rng = random.Random(seed)
    for _ in range(2000):
        k = rng.choice([1, 2, 3])
        a, b = ("".join(rng.choice("abc"[:k]) for _ in range(rng.randint(0, 200))) for _ in range(2))
        cap = rng.choice([5, 100, 2000])
        want = max((n for n in range(min(len(a), len(b), cap) + 1) if n == 0 or a[-n:] == b[:n]), default=0)
        assert T.overlap(a, b, cap) == want
    assert T.overlap("a" * 2000, "a" * 2000) == 2000 and T.overlap("a" * 2000 + "b", "a" * 2000) == 0 and T.overlap("ab" * 5000 + "a", "ab" * 5000, 100_000) == 9999


def test_contexts_of_long_equal_texts(spark):
    df = spark.createDataFrame([("a" * 2000, "a" * 2000), (None, "a"), ("x", None)], "a string, b string")
    assert [r.y for r in df.select(T.join_overlap(F.col("a"), F.col("b")).alias("y")).collect()] == ["a" * 2000, None, None]
    assert T.folded(["ab", "bc", "x", ""]) == "abc\nx\n"


def test_every_distinct_text_is_sent_once(spark, tmp_path):
    sent = str(tmp_path / "sent")

    def make():
        def embed(texts):
            with open(sent, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [[float(len(t)), 1.0] for t in texts]

        return embed

    nodes = lambda *texts: spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "node_id string, content string").repartition(3)
    provider = lambda c: embedding.provider_embedding(c, make, 2)
    cache = VectorCache(spark, str(tmp_path / "c"), "m")
    first = cache.embed(nodes(*["same"] * 40, "other", " ", None), provider).collect()
    assert collections.Counter(tuple(r.embedding) if r.embedding else None for r in first) == {(4.0, 1.0): 40, (5.0, 1.0): 1, None: 2}
    second = cache.embed(nodes("same", "newer text", "other"), provider).collect()
    assert {r.content: r.embedding for r in second} == {"same": [4.0, 1.0], "newer text": [10.0, 1.0], "other": [5.0, 1.0]}
    with open(sent) as f:
        assert sorted(f.read().split("\n")[:-1]) == ["newer text", "other", "same"]
    # another model has vectors of its own, and a batch that fails leaves none
    other = VectorCache(spark, str(tmp_path / "c"), "m2")
    assert other.vectors().count() == 0
    with pytest.raises(Exception, match="down"):
        other.embed(nodes("zz"), lambda c: embedding.provider_embedding(c, lambda: lambda t: 1 / 0 if False else (_ for _ in ()).throw(ValueError("down")), 2))
    assert other.vectors().count() == 0 and cache.vectors().count() == 3


def test_two_models_of_one_factory_in_a_session(spark):
    def client(model):
        return lambda: lambda texts: [[float(len(model) + len(t))] for t in texts]

    df = spark.createDataFrame([("x",)], "content string")
    got = [embedding.embed_nodes(df, lambda c, m=m: embedding.provider_embedding(c, client(m), 1)).first().embedding for m in ("a", "longer")]
    assert got == [[2.0], [7.0]]


def test_one_model_client_for_each_task(spark, tmp_path):
    made_at = str(tmp_path / "made")

    def make():
        with open(made_at, "a") as f:
            f.write("x")
        return lambda system, human: f"{len(human)} [Source #1]"

    prompts = spark.range(30).coalesce(1).select(F.col("id").alias("query_id"), F.lit("q").alias("query"), F.lit("s").alias("system"), F.lit("human").alias("human"), F.lit(1).alias("n_sources"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        said = generation.answer(prompts, make).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with open(made_at) as f:
        assert f.read() == "x"
    assert {r.answer for r in said} == {"5 [Source #1]"} and all(r.citations_valid for r in said)
