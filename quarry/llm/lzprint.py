"""Op 5. Lempel-Ziv phrase fingerprints: the phrases of an LZ78 parse, hashed, and the smallest hashes as the signature."""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bucket_of, documents, id_bounds, partitions, small_batches, text_of

#: Hashes in a signature; the likeness of two has a standard error of 0.06 at most.
SIGNATURE = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Parse:
    """An LZ78 parse of bytes that can go on from a state in two ways: `ends` are the ends of its phrases."""

    def __init__(self):
        self.root: dict = {}
        self.node, self.ends, self.at, self.log = self.root, [], 0, []

    def feed(self, data: bytes) -> None:
        root, node, at, ends, log = self.root, self.node, self.at, self.ends, self.log
        for at, byte in enumerate(data, at + 1):  # noqa: B020
            if byte in node:
                node = node[byte]
            else:
                node[byte] = {}
                ends.append(at)
                log.append((node, byte))
                node = root
        self.node, self.at = node, at

    def mark(self) -> tuple:
        self.log.clear()
        return self.node, self.at, len(self.ends)

    def back(self, mark: tuple) -> None:
        """Forgets all phrases since the mark."""
        for node, byte in reversed(self.log):
            del node[byte]
        self.log.clear()
        self.node, self.at = mark[:2]
        del self.ends[mark[2] :]


def signature(data: bytes, ends: list[int]) -> np.ndarray:
    """The smallest distinct 32-bit hashes of the phrases that end at `ends`. An unfinished last phrase repeats another one and adds nothing."""
    if not ends:
        return np.zeros(0, "u4")
    e = np.asarray(ends, "int64")
    n = int(e[-1])
    codes = np.frombuffer(data, "u1", n).astype("u8") + np.uint64(1)
    power = np.ones(n + 1, "u8")
    power[1:] = _BASE
    power = np.cumprod(power, dtype="u8")
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(codes * power[:-1], dtype="u8")])
    starts = np.concatenate([[0], e[:-1]])
    back = np.ones(n + 1, "u8")
    back[1:] = _INVERSE
    h = (sums[e] - sums[starts]) * np.cumprod(back, dtype="u8")[starts]
    h ^= (e - starts).astype("u8") << np.uint64(48)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique((h >> np.uint64(32)).astype("u4"))[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimate of the shared part of two phrase sets from their signatures; 1 for two empty ones."""
    both = np.union1d(a, b)[:SIGNATURE]
    return float(np.isin(both, a).astype(int) @ np.isin(both, b)) / len(both) if len(both) else 1.0


class Document:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.n = doc_id, text, len(text)
        self.head = text[: self.n - self.n // 2]
        first = self.head.encode()
        self.parse = Parse()
        self.parse.feed(first)
        self.mark = self.parse.mark()
        self.first, self.data = first, text.encode()
        self.parse.feed(self.data[len(first) :])
        self.signature = signature(self.data, self.parse.ends)

    def row(self, after: Document) -> tuple:
        """Its results, given the next document. Afterwards its phrases are gone."""
        tail = after.text[: self.n // 2].encode()
        self.parse.back(self.mark)
        self.parse.feed(tail)
        edited = self.first + tail
        other = signature(edited, self.parse.ends)
        self.parse = None
        return self.doc_id, self.n, hashlib.sha256(edited).hexdigest(), self.signature.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), likeness(self.signature, other), likeness(self.signature, after.signature)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text) with the fingerprints of its text and of its edited text, and their likenesses.

    The next document is the next row in ascending doc_id; the one after the last is the first. Null doc_ids come first; rows
    with equal doc_id are ordered by text, so repeated rows follow each other. Null text counts as empty; an empty text has an
    empty fingerprint. A single row is its own next, and an empty table gives no rows. Other columns are ignored. Very long texts are parsed whole.
    Rows that share a doc_id, or have none, stay in one bucket, as ids alone set the bounds.

    Texts move once: to ordered buckets between sampled ids. The row that begins a bucket goes to the bucket before it as well,
    as a guest, so every task has all neighbours it needs. A task holds two documents at a time.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ids = slim.select(F.col("doc_id").alias("id"))
    nulls = not ids.where(F.col("id").isNull()).isEmpty()
    bounds = id_bounds(ids, 4 * partitions(docs.sparkSession))
    own = bucket_of(bounds, F.col("doc_id"))
    begins = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(bounds[0] if bounds else 0)
    last = max(0, len(bounds) - 1)
    guest_of = F.when(begins, F.lit(last))
    if len(bounds) > 1:
        guest_of = guest_of.when(F.col("doc_id").isin(bounds[1:]), own - 1)
    places = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(False).alias("guest")), F.when(guest_of.isNotNull(), F.struct(guest_of.cast("int").alias("bucket"), F.lit(True).alias("guest")))))
    dealt = slim.withColumn("place", F.explode(places)).select("place.bucket", "place.guest", "doc_id", "text")

    def run(batches):
        gc.disable()  # the tries hold no cycles
        before = bucket = None
        try:
            for batch in batches:
                rows = []
                for b, guest, doc_id, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                    b, guest = b.as_py(), guest.as_py()
                    if guest and b != bucket:
                        continue  # a row that ties with the first guest
                    now = Document(doc_id.as_py(), text.as_py())
                    if before is not None:
                        rows.append(before.row(now))
                    before, bucket = (None, None) if guest else (now, b)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in SCHEMA.split(", ")])
        finally:
            gc.enable()

    return dealt.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text").mapInArrow(run, SCHEMA)


def op5_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
