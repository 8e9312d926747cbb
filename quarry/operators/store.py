"""A document store on plain tables: a numbered log says which batches count, so writers are ordered and readers see whole batches."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import embedding
from quarry.operators import cells, grid, segments
from quarry.operators.log import Log
from quarry.operators.settings import shuffles_end_with_their_job
from quarry.schema import DOCUMENTS, NODES

#: Rows of a file at most; what a bulk insert flushes at once.
RECORDS_PER_FILE = 1_000_000
TABLES = ("documents", "nodes", "vectors", "segments", "blocks")
#: Tables that lie in the folder of another one: a segment's row is among its posting blocks, as both come from one pass.
FOLDERS = {"segments": "blocks"}
#: What is derived from the nodes of a batch; blocks come with their segments.
INDEXES = ("vectors", "blocks")
MANIFEST = "batch_id string, attempt_id string, kind string, n_documents long, n_nodes long, version long"
#: Seconds after which files that no entry of the log names are taken for the remains of a failed attempt.
LEFT_FOR = 24 * 3600


class DocumentNotFound(KeyError):
    status_code = 404


@dataclass(frozen=True)
class Snapshot:
    """What counts after an entry of the log: attempts that hold rows, that delete, and that hide documents or show them again, each with the version from
    which it does."""

    version: int
    adds: dict[str, int]
    deletes: dict[str, int]
    hides: dict[str, int]

    @classmethod
    def of(cls, entries: dict[int, dict]) -> Snapshot:
        adds: dict[str, int] = {}
        deletes: dict[str, int] = {}
        hides: dict[str, int] = {}
        for number, e in entries.items():
            if e["kind"] == "add":
                adds[e["attempt_id"]] = number
            elif e["kind"] == "delete":
                deletes[e["attempt_id"]] = number
            elif e["kind"] == "hide":
                hides[e["attempt_id"]] = number
            elif e["kind"] == "compact":  # its rows are as of the entry that it read up to; what was deleted since still hides them
                for old in e["replaces"]:
                    adds.pop(old, None)
                    deletes.pop(old, None)
                adds[e["attempt_id"]] = e["as_of"]
        return cls(max(entries, default=0), adds, deletes, hides)


class Store:
    """Tables under one path, partitioned by the attempt that wrote them. Readers take the attempts that the log names, so a failed ingest leaves
    nothing visible, and a batch that is tried again writes under a new attempt and never beside its own remains.

    The log's numbers order all writers: a delete hides what was added before it and not what is added after. Of two attempts of one batch the first
    in the log holds, and the second one puts nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Log(spark, f"{self.path}/log")

    def _exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _append(self, df: DataFrame, name: str, attempt: str) -> None:
        rows = df.withColumn("attempt_id", F.lit(attempt)).write.mode("append").partitionBy("attempt_id")
        with shuffles_end_with_their_job(self.spark):
            rows.options(**(segments.PAGES if name == "blocks" else {})).option("compression", "zstd").option("maxRecordsPerFile", RECORDS_PER_FILE).parquet(f"{self.path}/{name}")

    def _written(self, name: str, attempt: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("attempt_id") == attempt).drop("attempt_id")

    def _commit(self, batch: str, attempt: str, kind: str, documents: int, nodes: int) -> int | None:
        """The entry's number; None if the batch is there already."""
        entry = {"batch_id": batch, "attempt_id": attempt, "kind": kind, "n_documents": documents, "n_nodes": nodes}
        return self.log.append(lambda entries: None if any(e["batch_id"] == batch for e in entries.values()) else entry)

    def snapshot(self) -> Snapshot:
        return Snapshot.of(self.log.entries())

    def manifest(self) -> DataFrame:
        """A row for each entry of the log."""
        rows = [(e["batch_id"], e["attempt_id"], e["kind"], e["n_documents"], e["n_nodes"], number) for number, e in self.log.entries().items()]
        return self.spark.createDataFrame(rows, MANIFEST)

    def publish(self, documents: DataFrame, nodes: DataFrame, batch_id: str | None = None, embed: Callable[[Column], Column] | None = None, indexes: tuple[str, ...] = INDEXES) -> int:
        """Writes documents and nodes, the packed embeddings and the posting blocks of these, then the log's entry. Gives the number of nodes.

        Embeddings lie in packs alone. embed gives them, from the content of nodes as they are written, so that each is made once and none is moved. Without it
        nodes have a column of that name, and their plan runs once for it and once without it.
        Nodes and vectors are clustered by document, so lookups skip most row groups, and the blocks of a few segments by lexeme, so they skip most pages. A batch_id that is committed already
        is left as it is, so a repeated call does nothing. A batch without one of the indexes is not found by searches that need it.
        """
        batch, attempt = batch_id or uuid.uuid4().hex, uuid.uuid4().hex
        if batch_id and any(e["batch_id"] == batch for e in self.log.entries().values()):
            return 0
        given = None if embed or "embedding" not in nodes.columns else nodes.select("node_id", "document_id", "node_index", "embedding")
        nodes = nodes.drop("embedding")
        own = {c.split()[0] for c in NODES.split(", ")}
        nodes = nodes.select(*(c for c in nodes.columns if c in own), *(c for c in nodes.columns if c not in own))
        self._append(nodes.repartition("document_id").sortWithinPartitions("document_id", "node_index"), "nodes", attempt)
        counts = self._written("nodes", attempt).groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        whole = documents.drop("chunk_count").join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        if "created_at" not in whole.columns:
            whole = whole.withColumn("created_at", F.current_timestamp())
        kinds = dict(c.split() for c in DOCUMENTS.split(", "))
        known = [(F.col(c) if c in whole.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        self._append(whole.select(*known, *(c for c in whole.columns if c not in kinds)), "documents", attempt)
        if given is not None:
            given = given.repartition("document_id").sortWithinPartitions("document_id", "node_index")
        elif embed:
            given = embedding.embed_nodes(self._written("nodes", attempt).select("node_id", "document_id", "node_index", "content"), embed)
        n = self._index(attempt, given, indexes)
        committed = self._commit(batch, attempt, "add", self._written("documents", attempt).count(), n)
        return n if committed else 0

    def _index(self, attempt: str, vectors: DataFrame | None, indexes: tuple[str, ...] = INDEXES) -> int:
        """Vectors (rows with embedding, clustered by document), segments and posting blocks of the nodes that an attempt has written; gives their number."""
        written = self._written("nodes", attempt)
        n = written.count()
        if "blocks" in indexes:
            turns = segments.rounds(n, self.spark.sparkContext.defaultParallelism)
            for turn in range(turns):
                self._append(segments.by_segment(written, attempt, n, turn, turns), "blocks", attempt)
        if "vectors" in indexes:
            vectors = vectors if vectors is not None else self.spark.createDataFrame([], "node_id string, document_id string, node_index int, embedding array<float>")
            self._append(grid.packed(vectors.where("embedding is not null"), code=True), "vectors", attempt)
        return n

    def complete(self, indexes: tuple[str, ...], embed: Callable[[Column], Column] | None = None) -> None:
        """Makes the indexes that attempts which count were published without; embed gives the embeddings."""
        for attempt in self.snapshot().adds:
            lacking = tuple(i for i in indexes if not self._exists(f"{i}/attempt_id={attempt}"))
            if lacking:
                nodes = self._written("nodes", attempt).select("node_id", "document_id", "node_index", "content")
                self._index(attempt, embedding.embed_nodes(nodes, embed) if embed else None, lacking)

    def delete(self, document_ids: list[str] | DataFrame) -> None:
        """Documents and all that belongs to them are gone from the next read on. Ids that are not there are an error, and nothing is deleted."""
        gone = document_ids if isinstance(document_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        missing = gone.join(self.table("documents"), "document_id", "left_anti").limit(1).collect()
        if missing:
            raise DocumentNotFound(missing[0].document_id)
        attempt = uuid.uuid4().hex
        self._append(gone.distinct(), "deleted", attempt)
        self._commit(attempt, attempt, "delete", self._written("deleted", attempt).count(), 0)

    def _rows(self, name: str, now: Snapshot) -> DataFrame:
        """All rows of a table's attempts; the names of the attempts prune its files."""
        rows = self.spark.read.parquet(f"{self.path}/{FOLDERS.get(name, name)}")
        rows = rows.where(F.col("attempt_id").isin(list(now.adds)))
        if name in ("segments", "blocks"):
            return segments.parted(rows)[name == "blocks"]
        return rows.drop("embedding") if name == "nodes" else rows

    def _since(self, attempts: dict[str, int]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(list(attempts.items()), "attempt_id string, since long"))  # a row for each attempt of the log

    def hide(self, document_ids: list[str], at: str | None = None) -> None:
        """Soft deletion: from the next read on, readers that ask for it do not see these documents, whose deleted_at is `at` (now, if it is null)."""
        self._set_hidden(document_ids, F.coalesce(F.lit(at).cast("timestamp_ntz"), F.current_timestamp().cast("timestamp_ntz")))

    def show(self, document_ids: list[str]) -> None:
        """The documents are not hidden any more."""
        self._set_hidden(document_ids, F.lit(None).cast("timestamp_ntz"))

    def _set_hidden(self, document_ids: list[str], at: Column) -> None:
        attempt = uuid.uuid4().hex
        self._append(self.spark.createDataFrame([(d,) for d in sorted(set(document_ids))], "document_id string").withColumn("hidden_at", at), "hidden", attempt)
        self._commit(attempt, attempt, "hide", len(set(document_ids)), 0)

    def _hidden(self, now: Snapshot) -> DataFrame | None:
        """document_id, hidden_at of the documents that are hidden: the last entry that names a document holds."""
        if not now.hides:
            return None
        rows = self.spark.read.parquet(f"{self.path}/hidden").where(F.col("attempt_id").isin(list(now.hides))).join(self._since(now.hides), "attempt_id")
        return rows.groupBy("document_id").agg(F.max_by("hidden_at", "since").alias("hidden_at")).where("hidden_at is not null")

    def _gone(self, now: Snapshot, hide_deleted_at: bool = False) -> DataFrame | None:
        """document_id, gone: the last version at which each document was deleted; of hidden ones, if they are not to be seen, a version behind all."""
        lists = []
        if now.deletes:
            deleted = self.spark.read.parquet(f"{self.path}/deleted").where(F.col("attempt_id").isin(list(now.deletes))).join(self._since(now.deletes), "attempt_id")
            lists.append(deleted.select("document_id", "since"))
        if hide_deleted_at and now.hides:
            lists.append(self._hidden(now).select("document_id", F.lit((1 << 62)).alias("since")))
        if not lists:
            return None
        every = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
        return every.groupBy("document_id").agg(F.max("since").alias("gone"))

    def table(self, name: str, hide_deleted_at: bool = False, now: Snapshot | None = None) -> DataFrame:
        """Rows of documents or nodes whose document has not been deleted by a later batch. hide_deleted_at also leaves out softly deleted documents, with all
        that belongs to them."""
        now = now or self.snapshot()
        if name in ("vectors", "segments"):
            return self._with_gone(name, now, hide_deleted_at)
        if name == "blocks":
            return segments.named(self._with_gone(name, now, hide_deleted_at), self._rows("segments", now))
        rows, gone = self._rows(name, now), self._gone(now, hide_deleted_at)
        if gone is not None:
            rows = rows.join(self._since(now.adds), "attempt_id").join(gone, "document_id", "left").where("gone is null or gone < since").drop("gone", "since")
        rows = rows.drop("attempt_id")
        if name == "documents" and now.hides:
            rows = rows.join(self._hidden(now), "document_id", "left").withColumn("deleted_at", F.coalesce("deleted_at", "hidden_at")).drop("hidden_at")
        return rows.where("deleted_at is null") if hide_deleted_at and "deleted_at" in rows.columns else rows

    def _with_gone(self, name: str, now: Snapshot, hide_deleted_at: bool = False) -> DataFrame:
        """Rows that hold many documents each, with `gone`: those of their documents that have been deleted, or are hidden."""
        rows, gone = self._rows(name, now), self._gone(now, hide_deleted_at)
        if gone is None:
            return rows.drop("attempt_id").withColumn("gone", F.lit(None).cast("array<string>"))
        key = F.get("node_ids", F.lit(0)) if name == "vectors" else F.col("segment")
        rows = rows.withColumn("of_key", key)
        held = rows if name == "vectors" else self._rows("segments", now).withColumn("of_key", F.col("segment"))
        return _marked(rows, held.join(self._since(now.adds), "attempt_id"), gone, ["attempt_id", "of_key"]).drop("attempt_id", "of_key")

    def build_cells(self, recall: float = 0.95) -> int:
        """Inverted lists of the vectors that count now (see `cells.build`), kept in the store. Gives the entry's number."""
        now, attempt = self.snapshot(), uuid.uuid4().hex
        cells.build(grid.unpacked(self._with_gone("vectors", now), raw=True), f"{self.path}/cells/attempt_id={attempt}", recall)
        entry = {"batch_id": attempt, "attempt_id": attempt, "kind": "cells", "as_of": now.version, "of": list(now.adds), "n_documents": 0, "n_nodes": 0}
        return self.log.append(lambda _: entry)

    def _cells(self, now: Snapshot) -> dict | None:
        """The newest entry of inverted lists whose batches all count still."""
        return next((e for e in reversed(self.log.entries().values()) if e["kind"] == "cells" and set(e["of"]) <= set(now.adds)), None)

    def nearest(self, requests: DataFrame, factor: int = 1) -> DataFrame:
        """As `grid.top_k` over `vectors`, by the inverted lists: what came later is searched exactly, and what was deleted later is no hit. Without lists, or
        once a compaction has replaced what they are of, the search is exact as a whole."""
        now = self.snapshot()
        entry = self._cells(now)
        if entry is None:
            return grid.top_k(self._with_gone("vectors", now), requests, factor)
        index, gone = cells.load(self.spark, f"{self.path}/cells/attempt_id={entry['attempt_id']}"), self._gone(now)
        if gone is not None:
            packs = index.packs.withColumn("of_key", F.get("node_ids", F.lit(0)))
            index = replace(index, packs=_marked(packs, packs.withColumn("since", F.lit(entry["as_of"])), gone, ["of_key"]).drop("of_key"))
        hits = index.top_k(requests, factor)
        later = {a: v for a, v in now.adds.items() if a not in entry["of"]}
        if not later:
            return hits
        size = grid.Size.of(requests, factor)
        hits = hits.unionByName(grid.top_k(self._with_gone("vectors", replace(now, adds=later)), requests, factor, size)).drop("rank")
        wanted = requests.select("query_id", (F.col("top_k") * factor).alias("wanted"))
        return grid.ranked(hits.join(wanted, "query_id"), size.most, F.isnan("score"))

    def documents(self, limit: int | None = None, after: tuple | None = None) -> DataFrame:
        """The newest first; of these at most `limit`, from behind the document with `after`'s created_at and document_id on. A page is a top-k of slim rows and
        no sort of all."""
        rows = self.table("documents")
        if after is not None:
            at, last = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
            rows = rows.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("document_id") > last)))
        rows = rows.orderBy(F.col("created_at").desc(), "document_id")
        return rows if limit is None else rows.limit(limit)

    def document(self, document_id: str) -> DataFrame:
        return self.table("documents").where(F.col("document_id") == document_id).limit(1)

    def nodes_of(self, document_id: str) -> DataFrame:
        return self.table("nodes").where(F.col("document_id") == document_id).orderBy("node_index")

    def vectors(self, hide_deleted_at: bool = False) -> DataFrame:
        """Packs of the nodes' vectors, four bytes a number. Vector search takes those of `table` as well, in which a number may have one."""
        return grid.uncoded(self.table("vectors", hide_deleted_at))

    def postings(self, hide_deleted_at: bool = False) -> DataFrame:
        """Posting blocks of the nodes, as full-text search takes them."""
        return self.table("blocks", hide_deleted_at)

    def compact(self) -> int | None:
        """Writes all rows that count now as one attempt, without what has been deleted, and puts it in place of the attempts it read. Gives the entry's
        number; None if there was nothing to do. Batches that others add or delete meanwhile stay as they are."""
        now = self.snapshot()
        if len(now.adds) + len(now.deletes) < 2:
            return None
        attempt = uuid.uuid4().hex
        self._append(self.table("nodes", now=now).repartition("document_id").sortWithinPartitions("document_id", "node_index"), "nodes", attempt)
        self._append(self.table("documents", now=replace(now, hides={})).coalesce(max(1, self.spark.sparkContext.defaultParallelism)), "documents", attempt)
        n = self._index(attempt, grid.unpacked(self._with_gone("vectors", now), raw=True))  # in the order in which they lie, which is by document
        replaces = [*now.adds, *now.deletes]
        # hidden documents are rows like others, and what hides them stays in the log
        entry = {"batch_id": attempt, "attempt_id": attempt, "kind": "compact", "as_of": now.version, "replaces": replaces, "n_documents": self._written("documents", attempt).count(), "n_nodes": n}

        def unless_done(entries: dict[int, dict]) -> dict | None:
            """Another compaction may have replaced the same attempts."""
            held = Snapshot.of(entries)
            return entry if set(now.adds) <= set(held.adds) and set(now.deletes) <= set(held.deletes) else None

        return self.log.append(unless_done)

    def clean(self, left_for: float = LEFT_FOR) -> int:
        """Removes the files of attempts that count no more, once nothing has been written to them for `left_for` seconds: those that a compaction replaced,
        and the remains of failed ones. Longer than any write or read takes, it takes nothing from anyone. Gives the number of folders removed."""
        now, removed = self.snapshot(), 0
        used = {*now.adds, *now.deletes, *now.hides, (self._cells(now) or {}).get("attempt_id")}
        for name in (*TABLES, "deleted", "hidden", "cells"):
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(folder) if files.exists(folder) else []:
                attempt = status.getPath().getName().removeprefix("attempt_id=")
                newest = max([status.getModificationTime(), *(f.getModificationTime() for f in files.listStatus(status.getPath()))]) if status.isDirectory() else 0
                if status.isDirectory() and attempt != status.getPath().getName() and attempt not in used and newest <= (time.time() - left_for) * 1000:
                    files.delete(status.getPath(), True)
                    removed += 1
        return removed

    def health(self) -> DataFrame:
        """probe, healthy for the engine, each table, and what a probe finds wrong makes unhealthy."""
        rows = [("engine", self.spark.sql("select 1").first()[0] == 1)]
        for name in TABLES:
            try:
                rows.append((name, bool(self._exists(FOLDERS.get(name, name)) and self.table(name).columns)))
            except Exception:  # noqa: BLE001 - any error is an unhealthy probe
                rows.append((name, False))
        return self.spark.createDataFrame(rows, "probe string, healthy boolean")


def _marked(rows: DataFrame, held: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `gone`: of the documents that held names for their keys, those that were deleted after `since`."""
    dead = held.select(*keys, "since", F.explode(F.array_distinct("document_ids")).alias("document_id")).join(gone, "document_id").where("gone > since")
    return rows.join(dead.groupBy(*keys).agg(F.collect_set("document_id").alias("gone")), keys, "left")


def missing_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> dict[str, list[str]]:
    """Required columns that tables lack, by table."""
    return {t: gone for t, cols in required.items() if (gone := sorted(set(cols) - set(tables[t].columns if t in tables else [])))}


def delete_cascade(documents: DataFrame, nodes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the documents of `gone` (document_id)."""
    return documents.join(gone, "document_id", "left_anti"), nodes.join(gone, "document_id", "left_anti")


def envelope(data: Column, message: str = "OK", success: bool = True) -> Column:
    """A struct column as responses are wrapped."""
    return F.struct(F.lit(success).alias("success"), F.lit(message).alias("message"), data.alias("data"), F.lit("now").alias("timestamp"))
