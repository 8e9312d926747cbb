"""Op 3. Sorted-string-table shards of token ids.

A shard file holds documents in key order:

    blocks | Bloom filter | index | footer

A block is zstd-compressed and holds entries of (shared u16, unshared u16, ids u32, key suffix, ids): a key repeats the
first `shared` bytes of the key before it; every 16th entry of a block shares nothing. The sparse index has the first key,
place, length, entries and ids before each block, so a lookup asks the Bloom filter, finds its block by binary search and reads
that block alone. The footer has fixed length: places of filter and index, entries, ids, width of an id, magic.

Keys are the 8 bytes of the id with the sign bit turned, big end first, so byte order is number order; the null id has the
empty key and comes first. Keys may repeat.
"""

from __future__ import annotations

import array
import bisect
import functools
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import units
from quarry.llm.bpe import byte_characters
from quarry.llm.common import documents, new_path, partitions, small_batches, text_of

MAGIC = b"QSST0001"
FOOTER = struct.Struct("<QQQQQQB7x8s")
INDEX = struct.Struct("<HQIIQ")
BLOCK_BYTES = 1 << 17
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def _bits(key: bytes, n: int) -> list[int]:
    a, b = _hashes(key)
    return [(a + i * b) % n for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard through a pyarrow file system; entries must come in key order."""

    def __init__(self, files: fs.FileSystem, path: str, width: int):
        self.files, self.path, self.tmp = files, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out, self.dtype = files.open_output_stream(self.tmp), np.dtype({2: "<u2", 4: "<u4"}[width])
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.index, self.hashes, self.last, self.first = bytearray(), [], array.array("Q"), b"", b""
        self.entries = self.ids = self.block_entries = self.block_ids = self.place = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.block_entries % RESTART:
            n = min(len(key), len(self.last))
            shared = next((i for i in range(n) if key[i] != self.last[i]), n)
        else:
            shared = 0
        if not self.block_entries:
            self.first = key
        value = ids.astype(self.dtype).tobytes()
        self.block += struct.pack("<HHI", shared, len(key) - shared, len(ids)) + key[shared:] + value
        self.last, self.block_entries, self.block_ids = key, self.block_entries + 1, self.block_ids + len(ids)
        self.hashes.extend(_hashes(key))
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block_entries:
            data = self.zstd.compress(bytes(self.block))
            self.index.append((self.first, self.place, len(data), self.block_entries, self.ids))
            self.out.write(data)
            self.place, self.ids, self.entries = self.place + len(data), self.ids + self.block_ids, self.entries + self.block_entries
            self.block, self.block_entries, self.block_ids = bytearray(), 0, 0

    def close(self) -> None:
        self._flush()
        size = max(64, len(self.hashes) // 2 * BLOOM_BITS)
        bloom = np.zeros((size + 7) // 8, "u1")
        first, step = (np.frombuffer(self.hashes, "u8")[i::2] % np.uint64(size) for i in (0, 1))
        for i in range(BLOOM_HASHES):
            bit = (first + np.uint64(i) * step) % np.uint64(size)
            np.bitwise_or.at(bloom, (bit >> np.uint64(3)).astype("i8"), np.uint8(1) << (bit & np.uint64(7)).astype("u1"))
        index = b"".join(INDEX.pack(len(k), *rest) + k for k, *rest in self.index)
        self.out.write(bloom.tobytes() + index)
        self.out.write(FOOTER.pack(self.place, size, self.place + len(bloom), len(self.index), self.entries, self.ids, self.dtype.itemsize, MAGIC))
        self.out.close()
        self.files.move(self.tmp, self.path)  # a reader sees whole files only, whichever attempt of a task ends first


class Reader:
    """Reads one shard: all entries in order, or those of one key by binary search."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        bloom_at, self.bits, index_at, blocks, self.entries, self.ids, width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        self.dtype, self.zstd = np.dtype({2: "<u2", 4: "<u4"}[width]), zstandard.ZstdDecompressor()
        self.bloom = self.file.read_at(index_at - bloom_at, bloom_at)
        data, at, self.index = self.file.read_at(size - FOOTER.size - index_at, index_at), 0, []
        for _ in range(blocks):
            n, *rest = INDEX.unpack_from(data, at)
            at += INDEX.size + n
            self.index.append((data[at - n : at], *rest))

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length, entries, _ = self.index[i]
        data, at, key = self.zstd.decompress(self.file.read_at(length, place)), 0, b""
        for _ in range(entries):
            shared, unshared, n = struct.unpack_from("<HHI", data, at)
            at += 8
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, self.dtype, n, at)
            at += n * self.dtype.itemsize

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bits)):
            return []
        firsts, found = [x[0] for x in self.index], []
        for i in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            found += [ids for k, ids in self._block(i) if k == key]
        return found


_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_KIND = np.zeros(256, "u1")  # 1 letter or digit, 2 other visible ASCII, 0 the apostrophe and all else
_KIND[33:127] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes without ASCII white space and with small ASCII letters, where each part begins, and where each text ends.

    The vocabulary's own rules put ASCII letters into lower case and split at white space and between letters or digits and other
    signs; only beside an apostrophe or a character outside ASCII they may join or part in other ways, so no part ends there.
    Texts with "<|" may hold names of special tokens, which the library finds as they are written; those are cut at white space alone.
    """
    data, at = units.bytes_of(texts)
    space, kind, lower = _SPACE[data], _KIND[data], _LOWER[data]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for i in np.unique(np.searchsorted(at, special, "right")):
        kind[at[i - 1] : at[i]], lower[at[i - 1] : at[i]] = 0, data[at[i - 1] : at[i]]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[:-1] | ((kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0))
    cut[at] = True
    kept = np.concatenate([[0], np.cumsum(~space)])
    return lower[~space], kept[np.flatnonzero(cut[:-1] & ~np.append(space, True)[:-1])], kept[at[1:]]


@functools.lru_cache(maxsize=2)
def word_units(path: str) -> units.Units:
    """Ids of words by the tokenizers library; a Python worker keeps what it has learnt from one task to the next."""
    from tokenizers import Tokenizer

    units.quiet()
    tokenizer = Tokenizer.from_file(path)
    model, shown = tokenizer.model, {b: c for b, c in byte_characters().items() if chr(b) != c}

    def one(word: str) -> list[int]:
        return [t.id for t in model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(shown))]

    encode = units.simple_first(
        re.compile(r"[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+").fullmatch,
        one,
        lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)],
    )
    return units.Units(encode)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, width: int = 2, shards: int | None = None) -> list:
    """Encodes every text of docs (doc_id, text), appends end_id and writes shards to `folder`, ids ascending over all shards.

    One range exchange of the texts by doc_id; each task sorts its range (with spilling), encodes it in Arrow batches and
    streams it into its own file, so memory holds one block, and 16 bytes for each document until the Bloom filter is written. Gives a row for each shard: shard, path, entries, ids.
    Null text: empty. Null doc_id: before all others. Rows with the same doc_id follow each other, ordered by their text.
    Columns other than doc_id and text are ignored. An empty table gives no shard.
    width: bytes of an id in the files (2 for vocabularies up to 65,536 ids).
    """
    spark = docs.sparkSession
    small_batches(spark)

    def write(batches):
        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        writer, dealer = None, word_units(tokenizer_path)
        shard = TaskContext.get().partitionId()
        path = f"{base}/part-{shard:06d}.sst"
        for batch in batches:
            ids_of_docs = batch.column(0).to_pylist()
            done = 0
            for texts in units.slices(batch.column(1)):
                ids, upto = dealer.deal(*words(texts))
                start = 0
                for doc_id, end in zip(ids_of_docs[done : done + len(texts)], upto.tolist(), strict=True):
                    writer = writer or Writer(files, path, width)
                    writer.add(key_of(doc_id), np.append(ids[start:end], end_id))
                    start = end
                done += len(texts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "entries": [writer.entries], "ids": [writer.ids]})

    done = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .repartitionByRange(shards or partitions(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, "shard long, path string, entries long, ids long")
        .collect()  # a row for each shard; the tasks run once, which an orderBy would not grant
    )
    return sorted(done, key=lambda r: r.shard)


def read_shards(spark: SparkSession, manifest: list, folder: str) -> DataFrame:
    """doc_id, start (ids of all entries before it), ids: everything in the shards, in order. Each task streams whole shards block by block."""
    before, rows = 0, []
    for r in manifest:
        rows.append((r.path, before))
        before += r.ids

    def read(batches):
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for key, ids in Reader(files, path):
                    held.append((id_of(key), start, ids))
                    start, size = start + len(ids), size + len(ids)
                    if size > 1_000_000:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    shards = spark.createDataFrame(rows, "path string, start long")
    return shards.repartition(max(1, len(rows)), "path").mapInArrow(read, "doc_id long, start long, ids binary")


def _batch(held: list) -> pa.RecordBatch:
    ids, starts, values = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array([v.astype("<u4").tobytes() for v in values], pa.binary())], ["doc_id", "start", "ids"])


def op3_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "sstable")
    manifest = write_shards(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1, folder)
    ids = F.col("ids")
    return read_shards(spark, manifest, folder).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
