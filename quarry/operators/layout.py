"""Parsed elements to layout blocks, and blocks to document nodes. Native expressions; one exchange by document for the numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import chunking
from quarry.functions import text as T
from quarry.schema import SETTINGS

#: Categories of elements that become tables and images; all others become text.
TABLES = ("Table",)
IMAGES = ("Image", "FigureCaption", "Picture", "Graphic")


def page_number(c: Column) -> Column:
    return F.when(c > 0, c).otherwise(1).cast("int")


def bounding_box(points: Column, given: Column | None = None) -> Column:
    """Smallest box around at least two points; else the given box; else zeros."""
    whole = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(whole, lambda p: p[0].cast("double")), F.transform(whole, lambda p: p[1].cast("double"))

    def box(a: Column, b: Column, c: Column, d: Column) -> Column:
        return F.struct(a.alias("x0"), b.alias("top"), c.alias("x1"), d.alias("bottom"))

    zero = F.lit(0.0)
    fallback = box(zero, zero, zero, zero) if given is None else F.coalesce(given, box(zero, zero, zero, zero))
    return F.when((F.coalesce(F.size(points), F.lit(0)) >= 2) & (F.size(whole) > 0), box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(fallback)


def elements_to_blocks(elements: DataFrame) -> DataFrame:
    """Blocks in reading order of each document: tables with rows and Markdown, images with a name, texts unless blank.

    A table's rows come from its HTML if there is any (then from nothing else), else from its text; without rows its text stays.
    Order: page, top, left, and the element's own place for ties; block_ordinal numbers it from 0.
    """
    category = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("class_name"))
    e = elements.withColumn("category", category).withColumns({"text": T.sanitize(F.col("text")), "page_number": page_number(F.col("page_number")), "bbox": bounding_box(F.col("points"), F.col("bbox"))})
    kind = F.when(F.col("category").isin(*TABLES), "table").when(F.col("category").isin(*IMAGES), "image").otherwise("text")
    e = e.withColumn("block_type", kind)
    # Python sees the HTML of tables alone
    has_html = (F.col("block_type") == "table") & (F.coalesce("text_as_html", F.lit("")) != "")
    e = e.withColumn("_html", T.html_rows(F.when(has_html, F.col("text_as_html"))))
    found = F.when(has_html, F.col("_html")).when(F.col("block_type") == "table", T.text_rows(F.col("text")))
    e = e.withColumn("rows", F.when(F.size(found) > 0, found))
    name = F.coalesce(F.nullif(F.col("image_path"), F.lit("")), F.format_string("image-p%d-%d", F.col("page_number"), F.col("element_ordinal")))
    e = e.withColumns({"text": F.when(F.col("rows").isNotNull(), T.markdown(F.col("rows"))).otherwise(F.col("text")), "image_name": F.when(F.col("block_type") == "image", name)})
    e = e.where((F.col("block_type") != "text") | (T.strip(F.col("text")) != ""))
    order = Window.partitionBy("document_id").orderBy("page_number", F.col("bbox.top"), F.col("bbox.x0"), "element_ordinal")
    columns = ["document_id", "block_ordinal", "block_type", "page_number", "bbox", "text", "rows", "image_bytes", "image_name", "category", "element_id", "filename", "filetype", "parent_id", "languages"]
    return e.withColumn("block_ordinal", (F.row_number().over(order) - 1).cast("int")).select(*columns, F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("column"))


def blocks_as_json(blocks: DataFrame) -> DataFrame:
    """document_id, block_ordinal, json: blocks without their bytes, whose number is image_size."""
    box = F.array(*(F.col(f"bbox.{c}") for c in ("x0", "top", "x1", "bottom")))
    columns = [F.col(c) for c in blocks.columns if c not in ("bbox", "image_bytes", "document_id", "block_ordinal")]
    body = F.to_json(F.struct(*columns, box.alias("bbox"), F.octet_length("image_bytes").alias("image_size")))
    return blocks.select("document_id", "block_ordinal", body.alias("json"))


def block_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("block_type").agg(F.count(F.lit(1)).alias("blocks"))


def write_report(blocks: DataFrame, path: str) -> dict[str, int]:
    """Writes every block as JSON to path/blocks, and the number of blocks of each document and kind to path/counts. Gives the number of each kind."""
    blocks_as_json(blocks).write.mode("overwrite").json(f"{path}/blocks")
    blocks.groupBy("document_id", "block_type").agg(F.count(F.lit(1)).alias("blocks")).write.mode("overwrite").json(f"{path}/counts")
    return {r.block_type: r.blocks for r in block_counts(blocks).collect()}  # a row for each kind


def metadata() -> Column:
    box = F.array(*(F.col(f"bbox.{c}") for c in ("x0", "top", "x1", "bottom")))
    own = ["category", "element_id", "filetype", "parent_id", "title", "column", "languages"]
    return F.struct(F.col("source_name").alias("source"), "page_number", box.alias("bbox"), *own, F.col("filename"), F.col("semantic_chunk_index"), F.col("image_name"))


def blocks_to_nodes(blocks: DataFrame, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap, source: Column | None = None) -> DataFrame:
    """Nodes of all blocks: a text block gives a node for each chunk that is not blank, a table one of its Markdown (unless blank), an image
    one without content. node_index is dense in each document, in order of block and chunk.

    One pass routes all three kinds, so the blocks are read once; the numbering is the only exchange.
    """
    is_text, is_table = F.col("block_type") == "text", F.col("block_type") == "table"
    pieces = F.when(is_text, chunking.chunks(F.when(is_text, F.col("text")), size, overlap)).when(is_table, F.array(F.coalesce("text", F.lit("")))).otherwise(F.array(F.lit("")))
    parts = blocks.withColumn("source_name", source if source is not None else F.col("filename")).select("*", F.posexplode(pieces).alias("chunk", "piece"))
    parts = parts.withColumns({"content": F.when(F.col("block_type") == "image", "").otherwise(T.strip(T.sanitize(F.col("piece")))), "semantic_chunk_index": F.when(is_text, F.col("chunk")).cast("int")})
    parts = parts.where((F.col("block_type") == "image") | (F.col("content") != ""))
    order = Window.partitionBy("document_id").orderBy("block_ordinal", "chunk")
    rows = F.struct(F.coalesce("rows", F.array().cast("array<array<string>>")).alias("rows"))
    nodes = parts.withColumn("node_index", (F.row_number().over(order) - 1).cast("int"))
    return nodes.select(
        F.concat_ws("-", "document_id", "node_index").alias("node_id"), "document_id", F.lit(None).cast("string").alias("parent_id"), F.col("block_type").alias("node_type"), "node_index", "content",
        F.when(is_table, rows).alias("structured_data"), metadata().alias("metadata"),
    )


def upload_verdict(uploads: DataFrame, most_mb: int = SETTINGS.max_upload_mb, extensions: tuple[str, ...] = SETTINGS.extensions) -> DataFrame:
    """uploads (filename, file_size, chunk_size, chunk_overlap) with clean_name, status_code (200 if good) and message, first failing rule first."""
    name, ext = F.col("clean_name"), F.col("file_type")
    rules = [
        (name == "", 400, F.lit("Document filename cannot be empty.")),
        (~ext.isin(*extensions), 415, F.concat(F.lit("Unsupported file type: "), F.when(ext == "", "unknown").otherwise(ext), F.lit("."))),
        (F.col("file_size") > most_mb * 1024 * 1024, 413, F.lit(f"File exceeds the {most_mb} MB upload limit.")),
        (F.col("chunk_overlap") >= F.col("chunk_size"), 422, F.lit("chunk_overlap must be smaller than chunk_size.")),
    ]
    code, message = F.lit(200), F.lit(None).cast("string")
    for bad, status, said in reversed(rules):
        code, message = F.when(bad, status).otherwise(code), F.when(bad, said).otherwise(message)
    named = uploads.withColumn("clean_name", T.clean_filename(F.col("filename")))
    return named.withColumn("file_type", T.extension(name)).withColumns({"status_code": code, "message": message})
