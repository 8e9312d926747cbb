"""Streaming ingest: new files become nodes and are published batch by batch, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.operators.store import Store
from quarry.plans import retrieval
from quarry.sources import pdf

#: How long the content of a file is remembered after it was last taken in, and how old a file may be, against the newest one, to be taken in at all.
REMEMBERED, OLDEST = "30 days", "40000d"


def stream_documents(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Rows of the Parquet files of a folder as they come; pattern: names of files that are taken."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(path)


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 100, remembered: str = REMEMBERED) -> DataFrame:
    """PDF files as they come, as of `pdf.read_pdfs`; a file whose bytes came before, under whatever name, is left out.

    The state holds a hash for each content, and drops those that are older than `remembered` by the time of the batch that saw them: files
    are never late, however old they are.
    """
    files = pdf.named(pdf.binary_files(spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", OLDEST), path))
    seen = files.withColumn("content_hash", F.sha2("content", 256)).withColumn("seen_at", F.current_timestamp())
    return seen.withWatermark("seen_at", remembered).dropDuplicatesWithinWatermark(["content_hash"]).drop("content_hash", "seen_at")


def _each_batch(stream: DataFrame, checkpoint: str, name: str, work: Callable[[DataFrame, str], None]):
    """A batch is named by the id of the query, which its checkpoint keeps, and its number there: one that is tried again after a failure has its name again,
    and a new checkpoint begins new batches."""

    def run(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first().id
        batch.persist()
        try:
            if not batch.isEmpty():  # a batch that only lets state go
                work(batch, f"{name}-{query}-{number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(name).start()


def publish_stream(stream: DataFrame, store: Store, to_documents: Callable[[DataFrame], DataFrame], to_nodes: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "ingest", embed: Callable[[Column], Column] | None = None):
    """Every operator up to node building works document by document, so the stream keeps no state. A batch that is tried again is published once."""
    return _each_batch(stream, checkpoint, name, lambda batch, batch_id: store.publish(to_documents(batch), to_nodes(batch), batch_id, embed))


def ingest_stream(stream: DataFrame, store: Store, checkpoint: str, name: str = "files", **how):
    """Files of `stream_files` into the store, as `retrieval.ingest_files` does; its report of each batch lies under store.path/reports."""

    def work(batch: DataFrame, batch_id: str) -> None:
        report = retrieval.ingest_files(store, batch, batch_id=batch_id, **how)
        report.coalesce(1).write.mode("overwrite").json(f"{store.path}/reports/{batch_id}")

    return _each_batch(stream, checkpoint, name, work)
