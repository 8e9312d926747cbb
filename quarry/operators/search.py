"""Vector search, full-text search and rank fusion, for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import embedding as E
from quarry.operators import grid, segments
from quarry.schema import SETTINGS

#: Requests up to which they, and their hits (100 of each at most), are small enough to be sent to every task.
AT_ONCE = 500

def validate(requests: DataFrame) -> DataFrame:
    """requests with `problem`, null if good: query not blank, top_k 1 to 100, search_type vector or hybrid."""
    trimmed = F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)^\s+|\s+$", "")
    known = requests.withColumns({"query": trimmed, "top_k": F.coalesce("top_k", F.lit(SETTINGS.top_k)), "search_type": F.coalesce("search_type", F.lit("hybrid"))})
    problem = F.when(F.col("query") == "", "query must not be empty").when(~F.col("top_k").between(1, 100), "top_k must be from 1 to 100").when(~F.col("search_type").isin("vector", "hybrid"), "search_type must be vector or hybrid")
    return known.withColumn("problem", problem)


def normalised(nodes: DataFrame) -> DataFrame:
    """node_vectors: keys and unit vectors of nodes that have one; scoring is then one dot product. Written once for many queries."""
    return nodes.where("embedding is not null").select("node_id", "document_id", "node_index", E.unit(F.col("embedding")).alias("unit"))


def vector_top_k(vectors: DataFrame, requests: DataFrame, factor: int = 1) -> DataFrame:
    """The top_k * factor nodes of highest cosine for each request; see `grid.top_k`."""
    return grid.top_k(vectors, requests, factor)


def fulltext_hits(blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Every node that holds every lexeme of the query, with its cover-density rank; see `segments.fulltext_hits`."""
    return segments.fulltext_hits(blocks, requests)


def fulltext_top_k(blocks: DataFrame, requests: DataFrame, factor: int = 2) -> DataFrame:
    """The top_k * factor nodes of highest rank for each request; see `segments.fulltext_top_k`."""
    return segments.fulltext_top_k(blocks, requests, factor)


def fuse(lists: list[DataFrame], requests: DataFrame, k: int = SETTINGS.rrf_k) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists: score is the sum of 1 / (k + rank), ties to the first list's order, then the second's, and so on.

    rank counts from 1, and the request's top_k of each stay. Requests whose search_type is vector, if they have one, keep the first list and its scores.
    """
    keys = ["query_id", "node_id"]
    ranks = [f"rank_{i}" for i in range(len(lists))]
    every = None
    for i, one in enumerate(lists):
        own = [(F.col("rank") if j == i else F.lit(None)).cast("int").alias(r) for j, r in enumerate(ranks)]
        one = one.select(*keys, "document_id", "node_index", *own, (F.col("score") if not i and "score" in one.columns else F.lit(None)).cast("double").alias("first_score"))
        every = one if every is None else every.unionByName(one)
    both = every.groupBy(*keys).agg(*(F.max(c).alias(c) for c in ("document_id", "node_index", "first_score", *ranks)))
    parts = [F.coalesce(F.lit(1).cast("double") / (F.lit(k) + F.col(r)), F.lit(0.0)) for r in ranks]
    score = parts[0]
    for part in parts[1:]:
        score = score + part
    kinds = requests.select("query_id", "top_k", *(["search_type"] if "search_type" in requests.columns else []))
    both = both.join(kinds, "query_id")
    if "search_type" in kinds.columns:
        plain = F.col("search_type") == "vector"
        both = both.where(~plain | F.col("rank_0").isNotNull())
        score = F.when(plain, F.coalesce("first_score", F.lit(float("nan")))).otherwise(score)
        order = [F.when(~plain, score).desc_nulls_last()]
    else:
        order = [score.desc()]
    best = Window.partitionBy("query_id").orderBy(*order, *(F.col(r).asc_nulls_last() for r in ranks))
    fused = both.withColumn("rank", F.row_number().over(best)).where("rank <= top_k").withColumn("score", score)
    return fused.select(*keys, "document_id", "node_index", *ranks, "score", "rank")


def hybrid_top_k(vectors: DataFrame, blocks: DataFrame, requests: DataFrame) -> DataFrame:
    """Fusion of twice top_k hits of either search; without lexemes in the query the vector order remains, with fused scores."""
    return fuse([vector_top_k(vectors, requests, 2), fulltext_top_k(blocks, requests, 2)], requests.drop("search_type"))


def three_way_top_k(vectors: DataFrame, blocks: DataFrame, totals: DataFrame, requests: DataFrame) -> DataFrame:
    """Fusion of twice top_k hits by vector, by cover density and by BM25."""
    by_words = segments.bm25_top_k(blocks, totals, requests, 2)
    return fuse([vector_top_k(vectors, requests, 2), fulltext_top_k(blocks, requests, 2), by_words], requests.drop("search_type"))


def retrieve(vectors: DataFrame, blocks: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Hits of every request by its search_type: query_id, node_id, document_id, node_index, score, rank.

    Both kinds share one pass over the vectors, with twice top_k hits; the requests of kind 'vector' take the first half of theirs. The hits of
    AT_ONCE requests at most are sent to the tables that they are joined with, which then do not move. Where all requests are of kind 'vector', no blocks
    are needed; a 'hybrid' one is then an error.
    """
    if blocks is None:
        told = F.assert_true(F.col("search_type") == "vector", "search_type hybrid needs posting blocks")
        requests = requests.withColumn("search_type", F.when(told.isNull(), F.col("search_type")))
    size = grid.Size.of(requests, 2)
    by_vector = grid.top_k(vectors, requests, 2, size)
    lists = [by_vector] if blocks is None else [by_vector, fulltext_top_k(blocks, requests.where("search_type = 'hybrid'"), 2)]
    few = size.requests <= AT_ONCE
    found = fuse(lists, F.broadcast(requests) if few else requests).select("query_id", "node_id", "document_id", "node_index", "score", "rank")
    return F.broadcast(found) if few else found


def hits(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Search results as users see them: chunk_id, document_id, chunk_index, content, metadata, node_type, score, rank."""
    own = nodes.select("node_id", "content", "metadata", "node_type")
    return found.join(own, "node_id").select("query_id", F.col("node_id").alias("chunk_id"), "document_id", F.col("node_index").alias("chunk_index"), "content", "metadata", "node_type", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")
