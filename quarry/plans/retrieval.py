"""Whole plans: documents to nodes, requests to contexts and to answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import embedding
from quarry.functions import text as T
from quarry.operators import context, grid, layout, search, segments
from quarry.operators.store import Store
from quarry.plans import generation
from quarry.schema import SETTINGS
from quarry.sources import pdf


def line_nodes(documents: DataFrame) -> DataFrame:
    """A text node for each line of documents (doc_id, text) that is not blank, numbered in order. Nothing is shuffled."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.strip), lambda x: x != "")
    rows = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(lines).alias("node_index", "content"))
    return rows.select(F.concat_ws("-", "document_id", "node_index").alias("node_id"), "document_id", F.lit("text").alias("node_type"), "node_index", "content", F.struct(F.col("document_id").alias("source"), F.lit(1).alias("page_number")).alias("metadata"))


def chunk_nodes(documents: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """The same with recursive chunks instead of lines."""
    from quarry.functions import chunking

    rows = documents.select(F.col("doc_id").cast("string").alias("document_id"), "text").mapInArrow(chunking.chunk_rows(size, overlap), "document_id string, node_index int, content string")
    return rows.select(F.concat_ws("-", "document_id", "node_index").alias("node_id"), "document_id", F.lit("text").alias("node_type"), "node_index", "content", F.struct(F.col("document_id").alias("source"), F.lit(1).alias("page_number")).alias("metadata"))


def ingest(elements: DataFrame, embed: Callable[[Column], Column] = embedding.mock_embedding, **window) -> DataFrame:
    """Elements to embedded nodes."""
    return embedding.embed_nodes(layout.blocks_to_nodes(layout.elements_to_blocks(elements), **window), embed)


NO_BLOCKS, NO_NODES = "Unable to extract text, table, or image content from PDF.", "PDF produced no indexable layout nodes."


def ingest_files(store: Store, files: DataFrame, embed: Callable[[Column], Column] = embedding.mock_embedding, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, partitioner: Callable | None = None, pages: Callable | None = None, batch_id: str | None = None) -> DataFrame:
    """Files (as of `pdf.read_pdfs`) into the store, in one call. Gives document_id, filename, status_code, message, chunk_count: a row for each file.

    Rules of the upload come first; then the partitioner reads the good ones (or the default one, or, where there is none, the spans of
    `pages`), once: what it finds is written under the store. Blocks become nodes, nodes get embeddings, and all documents with
    nodes are published as one batch. A file that fails at any step is in the report with its code and is not published.
    """
    spark = store.spark
    names = ["document_id", "filename", "status_code", "message"]
    asked = files.withColumn("chunk_size", F.lit(size)).withColumn("chunk_overlap", F.lit(overlap))
    verdict = layout.upload_verdict(asked)
    turned_down = verdict.where("status_code <> 200").select(*names).withColumn("chunk_count", F.lit(0))
    if overlap >= size:
        return turned_down  # that holds for every file
    good = verdict.where("status_code = 200").withColumn("filename", F.col("clean_name"))
    staged = f"{store.path}/parsed/{uuid.uuid4().hex}"
    native = pages is not None or (partitioner is None and pdf.default_partitioner() is None)
    (pdf.read_spans(good, pages or pdf.pypdf_pages) if native else pdf.parse_all(good, partitioner)).write.parquet(staged)
    found, rejects = pdf.split_parsed(spark.read.parquet(staged))
    about = good.select("document_id", "filename", F.lit("pdf").alias("file_type"), "file_size")
    blocks = pdf.complete(pdf.spans_to_blocks(found).join(about.select("document_id", "filename"), "document_id")) if native else layout.elements_to_blocks(found)
    nodes = layout.blocks_to_nodes(blocks, size, overlap)
    kept = nodes.select("document_id").distinct()
    store.publish(about.join(kept, "document_id", "left_semi"), nodes, batch_id, embed)
    counts = nodes.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    held = blocks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    parsed = about.join(rejects.select("document_id"), "document_id", "left_anti").join(counts, "document_id", "left").join(held, "document_id", "left")
    bare = F.col("chunk_count").isNull()
    said = F.when(F.col("n_blocks").isNull(), NO_BLOCKS).when(bare, NO_NODES)
    done = parsed.select("document_id", "filename", F.when(bare, 400).otherwise(200).alias("status_code"), said.alias("message"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return done.unionByName(rejects.withColumn("chunk_count", F.lit(0))).unionByName(turned_down)


def embedded(requests: DataFrame, embed: Callable[[Column], Column] = embedding.mock_embedding) -> DataFrame:
    return requests.withColumn("vector", embed(F.col("query")))


def contexts(nodes: DataFrame, vectors: DataFrame, postings: DataFrame, requests: DataFrame, window: int = SETTINGS.neighbor_window) -> DataFrame:
    """Requests (with vectors) to merged contexts: search, neighbours, runs."""
    found = search.retrieve(vectors, postings, requests)
    return context.merge(context.expand(found, nodes, window))


def chat(nodes: DataFrame, vectors: DataFrame, postings: DataFrame, requests: DataFrame, make: Callable | None = None) -> DataFrame:
    """Requests to answers with citations, in one plan."""
    return generation.answer(generation.build_prompts(requests, contexts(nodes, vectors, postings, requests)), make)


def prepared(nodes: DataFrame, embed: Callable[[Column], Column] = embedding.mock_embedding, name: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """Packs of unit vectors and posting blocks of nodes. Written, they serve any number of queries."""
    vectors = search.normalised(nodes if "embedding" in nodes.columns else embedding.embed_nodes(nodes, embed))
    return grid.packed(vectors), segments.blocks(segments.numbered(nodes, name, nodes.count()))
