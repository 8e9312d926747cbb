"""What searches share: tables of nodes, vectors and postings, published once into a store and read by every query that follows."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import embedding
from quarry.operators import cells
from quarry.operators.settings import shuffles_end_with_their_job
from quarry.operators.store import INDEXES, Store
from quarry.plans import retrieval

_STORES: dict[tuple, tuple[Store, frozenset]] = {}
_TABLES: dict[tuple, DataFrame] = {}
_INDEXES: dict[tuple, cells.Index] = {}
_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster shares; one of our own only where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="quarry-store-"))
    return _OWN[0]


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _version(spark: SparkSession, path: str) -> tuple:
    """Length and time of change of what lies at path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(p).getLength(), files.getFileStatus(p).getModificationTime()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has already gone
        pass


def line_store(spark: SparkSession, path: str, embed: Callable[[Column], Column] | None = None, dimension: int = 256, needs: tuple[str, ...] = INDEXES) -> Store:
    """A store of the line nodes of the documents at path (doc_id, text), with offline embeddings unless `embed` is given, and with the indexes of `needs` at least.

    It is published at the first call of a session, used again as long as the documents stay as they are, and removed when the process ends. Indexes that a later
    call needs are added to it.
    """
    key = spark.sparkContext.applicationId, path, _version(spark, path), dimension, embed
    embed_own = embed or (lambda c: embedding.mock_embedding(c, dimension))
    if key not in _STORES:
        store = Store(spark, own_folder(spark, "lines"))
        documents = spark.read.parquet(path)
        about = documents.select(F.col("doc_id").cast("string").alias("document_id"), F.octet_length("text").cast("int").alias("file_size"), F.lit("txt").alias("file_type"), *(c for c in documents.columns if c not in ("doc_id", "text")))
        store.publish(about, retrieval.line_nodes(documents), "lines", embed_own, needs)
        _STORES[key] = store, frozenset(needs)
    elif not set(needs) <= _STORES[key][1]:
        _STORES[key][0].complete(needs, embed_own)
        _STORES[key] = _STORES[key][0], _STORES[key][1] | set(needs)
    return _STORES[key][0]


def table(spark: SparkSession, name: str, path: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(table at path), written at the first call of a session and read from there as long as the table at path stays as it is."""
    key = spark.sparkContext.applicationId, name, path, _version(spark, path)
    if key not in _TABLES:
        own = own_folder(spark, name)
        with shuffles_end_with_their_job(spark):
            make(spark.read.parquet(path)).write.parquet(own)
        _TABLES[key] = spark.read.parquet(own)
    return _TABLES[key]


def vector_index(spark: SparkSession, path: str, rows: Callable[[DataFrame], DataFrame]) -> cells.Index:
    """The inverted lists of rows(table at path), built at the first call of a session."""
    key = spark.sparkContext.applicationId, path, _version(spark, path)
    if key not in _INDEXES:
        own = own_folder(spark, "cells")
        _INDEXES[key] = cells.build(rows(spark.read.parquet(path)), own)
    return _INDEXES[key]


def search_tables(store: Store, blocks: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Nodes, packs of vectors and posting blocks of a store, as `retrieval.contexts` takes them; without blocks, None for these."""
    return store.table("nodes"), store.table("vectors"), store.postings() if blocks else None
