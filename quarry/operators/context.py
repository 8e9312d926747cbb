"""Neighbour expansion and merging of contiguous chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.schema import SETTINGS


def expand(seeds: DataFrame, nodes: DataFrame, window: int = SETTINGS.neighbor_window) -> DataFrame:
    """Nodes within `window` of a seed in its document, each with score and rank of its nearest seed (ties to the better rank).

    seeds: query_id, document_id, node_index, score, rank (from 1). retrieval_rank and document_rank count from 0; document_rank is the order in
    which documents first appear. Of seeds at one place the last counts. The windows become rows, so the join with the nodes
    has equal keys.
    """
    own = seeds.groupBy("query_id", "document_id", "node_index").agg(F.max(F.struct(F.col("rank") - 1, "score")).alias("s"))
    own = own.select("query_id", "document_id", F.col("node_index").alias("seed"), F.col("s.col1").alias("seed_rank"), F.col("s.score").alias("score"))
    first = seeds.groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    first = first.withColumn("document_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")) - 1).drop("first")
    near = own.withColumn("node_index", F.explode(F.sequence(F.greatest(F.col("seed") - window, F.lit(0)), F.col("seed") + window)))
    near = near.groupBy("query_id", "document_id", "node_index").agg(F.min(F.struct(F.abs(F.col("seed") - F.col("node_index")).alias("far"), "seed_rank", "score", "seed")).alias("n"))
    rows = near.join(nodes.select("document_id", "node_index", "node_id", "content", "metadata"), ["document_id", "node_index"]).join(first, ["query_id", "document_id"])
    return rows.select(
        "query_id", F.col("node_id").alias("chunk_id"), "document_id", F.col("node_index").alias("chunk_index"), "content", "metadata", F.col("n.score").alias("score"), F.col("n.seed_rank").alias("retrieval_rank"),
        "document_rank", (F.col("n.far") > 0).alias("is_neighbor"), F.col("n.seed").alias("seed_chunk_index"),
    )


def merge(expanded: DataFrame) -> DataFrame:
    """One context for each run of neighbouring chunks: texts folded at their overlaps, highest score, best rank, first metadata.

    place numbers a query's contexts from 1 by rank, document and chunk.
    """
    by_index = Window.partitionBy("query_id", "document_id").orderBy("chunk_index")
    runs = expanded.withColumn("island", F.col("chunk_index") - F.row_number().over(by_index))
    part = F.struct("chunk_index", "chunk_id", "content")
    out = runs.groupBy("query_id", "document_id", "island").agg(
        F.sort_array(F.collect_list(part)).alias("parts"), F.max("score").alias("score"), F.min("retrieval_rank").alias("retrieval_rank"), F.min("document_rank").alias("document_rank"),
        F.min_by("metadata", "chunk_index").alias("metadata"), F.min("chunk_index").alias("chunk_index"),
    )
    content = T.fold_overlaps(F.transform("parts", lambda p: p["content"]))
    ids = F.transform("parts", lambda p: p["chunk_id"])
    several = F.size("parts") > 1
    order = Window.partitionBy("query_id").orderBy("retrieval_rank", "document_rank", "document_id", "chunk_index")
    return out.select(
        "query_id", F.when(several, F.concat(F.element_at(ids, 1), F.lit(".."), F.element_at(ids, -1))).otherwise(F.element_at(ids, 1)).alias("chunk_id"), "document_id", "chunk_index", content.alias("content"), "metadata",
        "score", F.transform("parts", lambda p: p["chunk_index"]).alias("chunk_indexes"), ids.alias("chunk_ids"), several.alias("expanded_context"), F.row_number().over(order).alias("place"),
    )


def grouped(nodes: DataFrame, many: int = SETTINGS.children) -> DataFrame:
    """Parents of nodes: `many` neighbours each, their texts a line apart. node_id is what `parent_of` names; node_type is parent."""
    own = nodes.withColumn("parent_id", parent_of(many)).groupBy("document_id", "parent_id").agg(
        F.sort_array(F.collect_list(F.struct("node_index", "content"))).alias("parts"), F.min_by("metadata", "node_index").alias("metadata"), (F.floor(F.min("node_index") / many)).cast("int").alias("node_index")
    )
    content = F.array_join(F.transform("parts", lambda x: x["content"]), "\n")
    return own.select(F.col("parent_id").alias("node_id"), "document_id", F.lit("parent").alias("node_type"), "node_index", content.alias("content"), "metadata")


def parent_of(many: int = SETTINGS.children) -> Column:
    """The id of the parent of a node with document_id and node_index."""
    return F.concat(F.col("document_id"), F.lit("-parent-"), F.floor(F.col("node_index") / many).cast("string"))


def to_parents(found: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (query_id, node_id, score, rank) to their parents, each once for a query: chunk_id, document_id, content, metadata, score, rank, child_ids.

    children: node_id, parent_id; parents: nodes. A parent has the best rank and the highest score of its hits, and child_ids in their order; ranks are numbered
    anew. A hit without a parent, or whose parent is not there, is left out. Hits are few against nodes, so they are what should be sent.
    """
    own = found.join(children.select("node_id", "parent_id").where("parent_id is not null"), "node_id")
    best = own.groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "node_id"))).alias("hits"))
    met = best.join(parents.select(F.col("node_id").alias("parent_id"), "document_id", "content", "metadata"), "parent_id")
    order = Window.partitionBy("query_id").orderBy("first")
    return met.select(
        "query_id", F.col("parent_id").alias("chunk_id"), "document_id", "content", "metadata", "score", F.row_number().over(order).alias("rank"), F.transform("hits", lambda h: h["node_id"]).alias("child_ids")
    )


def parents_of(found: DataFrame, nodes: DataFrame, many: int = SETTINGS.children) -> DataFrame:
    """As `to_parents` where parents are as of `grouped`, which are put together for the hits alone: hits meet their parents' nodes, and no other node moves.

    found: query_id, node_id, document_id, node_index, score, rank.
    """
    keys = ["query_id", "document_id", "parent_id"]
    best = found.withColumn("parent_id", parent_of(many)).groupBy(*keys).agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "node_id"))).alias("hits"))
    own = nodes.select("document_id", parent_of(many).alias("parent_id"), "node_index", "content", "metadata").join(best, ["document_id", "parent_id"])
    part = F.sort_array(F.collect_list(F.struct("node_index", "content"))).alias("parts")
    met = own.groupBy(*keys).agg(part, F.min_by("metadata", "node_index").alias("metadata"), *(F.first(c).alias(c) for c in ("score", "first", "hits")))
    order = Window.partitionBy("query_id").orderBy("first")
    content = F.array_join(F.transform("parts", lambda x: x["content"]), "\n")
    return met.select(
        "query_id", F.col("parent_id").alias("chunk_id"), "document_id", content.alias("content"), "metadata", "score", F.row_number().over(order).alias("rank"), F.transform("hits", lambda h: h["node_id"]).alias("child_ids")
    )
