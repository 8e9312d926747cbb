"""PDF files: Spark's binary reader, an injected partitioner with a fallback, and native layout of positioned text spans."""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.schema import BLOCKS, ELEMENTS


class LayoutParseError(ValueError):
    status_code = 422


def read_pdfs(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """document_id, filename, file_size, content. The id follows from name and bytes, so a recomputation gives it again. Files beyond
    most_bytes are told by their length before any byte is read."""
    files = binary_files(spark.read, path)
    return named(files.where(F.col("length") <= most_bytes) if most_bytes else files)


def binary_files(reader, path: str) -> DataFrame:
    """PDF files under path by Spark's binary source; reader: spark.read or spark.readStream."""
    fields = "path string, modificationTime timestamp, length long, content binary"
    return reader.format("binaryFile").schema(fields).option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)


def named(files: DataFrame) -> DataFrame:
    """document_id, filename, file_size, content."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.sha2(F.concat(name.cast("binary"), F.unhex(F.sha2("content", 256))), 256).alias("document_id"), name.alias("filename"), F.col("length").cast("int").alias("file_size"), "content")


def default_partitioner() -> Callable | None:
    """The partitioner of the optional package 'unstructured', or None where it is not installed."""
    try:
        from unstructured.partition.pdf import partition_pdf
    except ImportError:
        return None
    return partition_pdf


def partition_elements(content: bytes, filename: str, partitioner: Callable | None = None, strategy: str = "auto", infer_tables: bool = True) -> list:
    """Elements by the partitioner, or by the default one, for which 'auto' means 'hi_res'; if a strategy other than 'fast' fails, once more by 'fast'
    without table inference."""
    chosen = partitioner or default_partitioner()
    if chosen is None:
        raise LayoutParseError("PDF parsing needs a partitioner such as that of the 'unstructured' package.")
    first = "hi_res" if strategy == "auto" and partitioner is None else strategy
    steps = [(first, infer_tables)] + ([] if strategy == "fast" else [("fast", False)])
    for at, (how, tables) in enumerate(steps, 1):
        try:
            return chosen(file=io.BytesIO(content), strategy=how, infer_table_structure=tables)
        except Exception as e:
            if at == len(steps):
                raise LayoutParseError(f"Failed to parse PDF: {e}") from e
    return []


def partition_file(content: bytes, filename: str, partitioner: Callable | None = None, other: Callable | None = None, **how) -> list:
    """A PDF by name goes to the PDF partitioner; other files to `other`, if there is one."""
    if filename.lower().endswith(".pdf"):
        return partition_elements(content, filename, partitioner, **how)
    if other is None:
        raise LayoutParseError(f"No backend for {filename}: PDF files only.")
    return other(file=io.BytesIO(content), metadata_filename=filename)


def pypdf_pages(content: bytes):
    """(width, [(x, y, text), ...]) of each page, by the optional package 'pypdf'."""
    from pypdf import PdfReader

    for page in PdfReader(io.BytesIO(content)).pages:
        spans: list[tuple[float, float, str]] = []

        def seen(text, _matrix, place, _font, _size, spans=spans):
            if text.strip() and len(place) >= 6:
                spans.append((float(place[4]), float(place[5]), text))

        page.extract_text(visitor_text=seen)
        yield float(getattr(page.mediabox, "width", 0) or 0), spans


SPANS = "document_id string, page_number int, page_width double, x double, y double, text string, filename string, status_code int, message string"


def read_spans(files: DataFrame, pages: Callable = pypdf_pages) -> DataFrame:
    """Positioned text spans of all files (document_id, filename, content), a row each with status_code 200; a file that cannot be read, or has no
    text, gives one row with 422 and a message. Each file is read once."""
    columns = [c.split()[0] for c in SPANS.split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for d, name, content in zip(batch["document_id"], batch["filename"], batch["content"], strict=True):
                try:
                    found = [(d, number, width, x, y, text, name, 200, None) for number, (width, spans) in enumerate(pages(bytes(content)), 1) for x, y, text in spans]
                    problem = None if found else "This PDF has no extractable text."
                except Exception as e:  # noqa: BLE001 - whatever a broken file does to the reader
                    found, problem = [], f"Failed to parse PDF text: {e}"
                rows += found if problem is None else [(d, None, None, None, None, None, name, 422, problem)]
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return files.select("document_id", "filename", "content").mapInPandas(read, SPANS)


def element_row(element, ordinal: int, document_id: str, filename: str) -> dict:
    meta = getattr(element, "metadata", None)
    get = lambda name: getattr(meta, name, None)
    points = getattr(get("coordinates"), "points", None)
    page = get("page_number")
    return {
        "document_id": document_id, "element_ordinal": ordinal, "text": getattr(element, "text", None), "category": getattr(element, "category", None), "class_name": type(element).__name__,
        "element_id": str(i) if (i := getattr(element, "id", None)) else None, "page_number": page if isinstance(page, int) else None, "points": [[float(x) for x in p] for p in points] if points else None, "bbox": None,
        "text_as_html": get("text_as_html"), "image_path": get("image_path"), "image_bytes": None, "filename": get("filename") or filename, "filetype": get("filetype"), "parent_id": get("parent_id"), "languages": get("languages"),
    }


PARSED = f"{ELEMENTS}, status_code int, message string"


def parse_all(files: DataFrame, partitioner: Callable | None = None, other: Callable | None = None, **how) -> DataFrame:
    """Elements of all files (document_id, filename, content), a row each with status_code 200; a file that cannot be parsed gives one row with
    422, one without elements one with 400, and a message. Each file is parsed once."""
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def parsed(batches):
        for batch in batches:
            rows = []
            for d, name, content in zip(batch["document_id"], batch["filename"], batch["content"], strict=True):
                try:
                    found = [element_row(e, i, d, name) | {"status_code": 200} for i, e in enumerate(partition_file(bytes(content), name, partitioner, other, **how))]
                    rows += found or [{"document_id": d, "filename": name, "status_code": 400, "message": "Unable to extract text, table, or image content from PDF."}]
                except LayoutParseError as e:
                    rows.append({"document_id": d, "filename": name, "status_code": 422, "message": str(e)})
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda x: x.notna(), None)

    return files.select("document_id", "filename", "content").mapInPandas(parsed, PARSED)


def parse_files(files: DataFrame, partitioner: Callable | None = None, other: Callable | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Elements of all files, and rejects (document_id, filename, status_code, message). Write `parse_all` where both are used."""
    return split_parsed(parse_all(files, partitioner, other, **how))


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read and what was not, of a table of `parse_all` or `read_spans`."""
    return parsed.where("status_code = 200").drop("status_code", "message"), parsed.where("status_code <> 200").select("document_id", "filename", "status_code", "message")


def spans_to_blocks(spans: DataFrame) -> DataFrame:
    """Blocks from positioned text spans (document_id, page_number, page_width, x, y, text), y growing upwards. Native windows only.

    Spans at the same y (to 0.1) form a line, from left to right. A line that names a table ("Bảng", "Bang") opens one: lines of three
    or more spans below it are rows, until a source note or the first other line after a row. Lines outside tables are text, left column
    before right, parted at the middle of the page. Texts come before tables.
    """
    s = spans.withColumn("text", T.strip(T.sanitize(F.col("text")))).where("text <> ''").withColumn("y", F.round("y", 1))
    page = ["document_id", "page_number"]
    lines = s.groupBy(*page, "y").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("spans"), F.max("page_width").alias("page_width"))
    lines = lines.withColumn("line", F.array_join(F.transform("spans", lambda p: p["text"]), " "))
    pages = lines.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("y", "spans", "line")), asc=False).alias("lines"), F.max("page_width").alias("page_width"))

    # one pass over the lines of a page: for each line the number of its table, or 0
    nothing_yet = F.array().cast("array<struct<table:int,row:boolean>>")
    first = F.struct(F.lit(0).alias("table"), F.lit(False).alias("open"), F.lit(0).alias("rows"), nothing_yet.alias("marks"))

    def step(a, line):
        heading = F.contains(line["line"], F.lit("Bảng")) | F.contains(line["line"], F.lit("Bang"))
        source = F.contains(line["line"], F.lit("(Nguồn:")) | F.contains(line["line"], F.lit("(Nguon:"))
        row = F.size(line["spans"]) >= 3
        ends = a["open"] & (source | (~row & (a["rows"] > 0)))
        inside = a["open"] & ~ends
        opens = ~inside & heading
        table = F.when(opens, a["table"] + 1).otherwise(a["table"])
        mark = F.struct(F.when(opens | inside, table).otherwise(0).alias("table"), (inside & row).alias("row"))
        rows = F.when(opens, 0).when(inside & row, a["rows"] + 1).otherwise(a["rows"])
        return F.struct(table.alias("table"), (opens | inside).alias("open"), rows.alias("rows"), F.concat(a["marks"], F.array(mark)).alias("marks"))

    marks = F.aggregate("lines", first, step, lambda a: a["marks"])
    marked = pages.withColumn("marks", marks).select(*page, "page_width", F.posexplode(F.arrays_zip("lines", "marks")).alias("at", "z"))
    marked = marked.select(*page, "page_width", "at", F.col("z.lines.y").alias("y"), F.col("z.lines.spans").alias("spans"), F.col("z.lines.line").alias("line"), F.col("z.marks.table").alias("table"), F.col("z.marks.row").alias("is_row"))
    of_table = Window.partitionBy(*page, "table")
    marked = marked.withColumn("n_rows", F.when(F.col("table") > 0, F.sum(F.col("is_row").cast("int")).over(of_table)).otherwise(0))
    heads = F.row_number().over(of_table.orderBy("at")) == 1
    marked = marked.withColumn("in_table", (F.col("n_rows") > 0) & (F.col("is_row") | heads)).withColumn("is_head", heads)

    low, high = F.array_min(F.transform("spans", lambda p: p["x"])), F.array_max(F.transform("spans", lambda p: p["x"]))
    tables = marked.where("n_rows > 0").groupBy(*page, "table").agg(
        F.min(low).alias("x0"), F.max(F.when(F.col("is_head"), F.col("y"))).alias("top"), F.max(high).alias("x1"), F.min_by("y", F.col("at") * -1).alias("bottom"),
        F.sort_array(F.collect_list(F.when(F.col("is_row"), F.struct("at", F.transform("spans", lambda p: p["text"]).alias("cells"))))).alias("found"), F.max(F.when(F.col("is_head"), F.col("line"))).alias("title"),
    )
    cells = F.transform("found", lambda f: f["cells"])
    nothing = F.lit(None).cast("string")
    tables = tables.select(*page, F.lit("table").alias("block_type"), F.struct("x0", "top", "x1", "bottom").alias("bbox"), T.markdown(cells).alias("text"), cells.alias("rows"), F.lit("PDFTable").alias("category"), "title", nothing.alias("column"), (F.col("table") + 2).alias("place"))
    side = F.when((F.col("page_width") > 0) & (low >= F.col("page_width") / 2), "right").otherwise("left")
    texts = marked.where("not in_table").withColumn("column", side).groupBy(*page, "column").agg(F.min(low).alias("x0"), F.min_by("y", "at").alias("top"), F.max(high).alias("x1"), F.max_by("y", "at").alias("bottom"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    texts = texts.select(*page, F.lit("text").alias("block_type"), F.struct("x0", "top", "x1", "bottom").alias("bbox"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.lit("PDFText").alias("category"), nothing.alias("title"), "column", F.when(F.col("column") == "left", 0).otherwise(1).alias("place"))
    both = texts.unionByName(tables)
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "place")) - 1
    return both.withColumn("block_ordinal", ordinal.cast("int")).drop("place")


def complete(blocks: DataFrame) -> DataFrame:
    """blocks with every column of the schema; those that are not there are null."""
    wanted, depth, start = [], 0, 0
    for at, c in enumerate(BLOCKS + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            wanted.append(BLOCKS[start:at].strip().split(" ", 1))
            start = at + 1
    return blocks.select(*(F.col(n) if n in blocks.columns else F.lit(None).cast(kind).alias(n) for n, kind in wanted))
