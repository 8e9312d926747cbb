"""Op 10. Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quarry.llm import units
from quarry.llm.common import documents, small_batches

INTS = ArrayType(IntegerType())


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: bytes that print as themselves in Latin-1 keep their character, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def tokenizer_of(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges by rank, and the bytes of each id.

    A rank file names no pairs: whatever two neighbours make a token may merge, at that token's rank. So every split of a
    token into two tokens becomes a merge, in order of the token's rank.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    units.quiet()
    ranks, shown = read_ranks(path), byte_characters()
    text = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(text[token[:i]], text[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    byte_of = {c: b for b, c in shown.items()}
    table = [b""] * (max(ranks.values()) + 1)
    for token, shown_as in text.items():
        table[ranks[token]] = bytes(byte_of[c] for c in shown_as)
    return tokenizer, table


#: Parts that are one match of the pattern.
_SIMPLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch


def _classes() -> np.ndarray:
    """Of each byte: 1 ASCII letter, 2 digit, 3 other visible ASCII but the apostrophe, 4 apostrophe, 5 space, 0 anything else."""
    kind = np.zeros(256, "u1")
    kind[33:127], kind[48:58], kind[65:91], kind[97:123], kind[39], kind[32] = 3, 2, 1, 1, 4, 5
    return kind


_KIND = _classes()


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places where a match of the pattern surely begins, so that what lies between them can be encoded apart.

    Between ASCII letters, digits and other signs, except beside an apostrophe; and before a space that stands alone between two
    visible ASCII characters or letters of U+00C0 to U+00FF. All else, such as longer white space, stays within one part.
    """
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        a, b = kind[:-1], kind[1:]
        cut[1:-1] = (a != b) & (a > 0) & (b > 0) & (a < 4) & (b < 4)
        shown = (kind > 0) & (kind < 5)
        latin = data == 0xC3
        ends = shown.copy()  # a visible character ends with this byte
        ends[1:] |= latin[:-1]
        cut[1:-2] |= (kind[1:-1] == 5) & ends[:-2] & (shown | latin)[2:]
    cut[at] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """ids of whole texts; each distinct part of a slice of texts is encoded once."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.table = tokenizer_of(path, pattern)
        shown, model = {b: c for b, c in byte_characters().items() if chr(b) != c}, self.tokenizer.model
        encode = units.simple_first(
            _SIMPLE,
            lambda part: [t.id for t in model.tokenize(part.encode().decode("latin-1").translate(shown))],
            lambda parts: [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)],
        )
        self.dealer = units.Units(encode, remembered=60_000)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the ids up to the end of each text."""
        data, at = units.bytes_of(texts)
        return self.dealer.deal(data, cuts(data, at), at[1:])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.table[i] for i in ids])


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> Encoder:
    """A Python worker keeps what it has learnt from one task to the next."""
    return Encoder(path, pattern)


def _parts(ids: np.ndarray, bound: np.ndarray) -> list[bytes]:
    data = ids.astype("<u4").tobytes()
    return [data[a:b] for a, b in zip((bound[:-1] * 4).tolist(), (bound[1:] * 4).tolist(), strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: str | None = None, packed: str | None = None, data: str | None = None) -> DataFrame:
    """docs without `text`, with `ids` array<int>; with `offsets`, also array<int>: the character at which each token begins;
    with `packed`, also binary: the ids as little-endian unsigned 32-bit integers; with `data`, also binary: the ids decoded.

    Null or empty text: no ids. Repeated rows are rows of their own, an empty table gives no rows, and a long text is encoded whole. A token may begin inside a character; its offset is then that character's.
    Every other column is carried along; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, ids, offsets, packed, data)]
    kept = docs.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = docs.select(*others).schema.add(ids, INTS)
    schema = schema.add(offsets, INTS) if offsets else schema
    schema = schema.add(packed, "binary") if packed else schema
    schema = schema.add(data, "binary") if data else schema

    def run(batches):
        encoder = encoder_of(path, pattern)
        size = np.array([len(t) for t in encoder.table])
        for batch in batches:
            at = 0
            for texts in units.slices(batch.column(batch.num_columns - 1)):
                found, upto = encoder.encode(texts)
                starts = pa.array(np.concatenate([[0], upto]), pa.int32())
                columns = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)]
                columns.append(pa.ListArray.from_arrays(starts, pa.array(found.astype("int32"))))
                if offsets:
                    character = np.cumsum((units.bytes_of(texts)[0] & 0xC0) != 0x80) - 1
                    byte = np.cumsum(size[found]) - size[found]
                    bound = np.concatenate([[0], upto])
                    of_text = np.repeat(np.arange(len(upto)), np.diff(bound))
                    first = np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))])[of_text]
                    columns.append(pa.ListArray.from_arrays(starts, pa.array((character[byte] - first).astype("int32"))))
                if packed:
                    columns.append(pa.array(_parts(found, np.concatenate([[0], upto])), pa.binary()))
                if data:
                    bound = [0, *upto.tolist()]
                    columns.append(pa.array([encoder.decode(found[a:b].tolist()) for a, b in itertools.pairwise(bound)], pa.binary()))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        units.release()

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data", text: str | None = "decoded") -> DataFrame:
    """encoded without `ids`, with `data` (the bytes) and `text`: the bytes as UTF-8, where ids that split a character at either
    end give U+FFFD for what is left of it. Null ids give null; ids outside the vocabulary fail."""
    others = [c for c in encoded.columns if c not in (ids, data, text)]
    schema = encoded.select(*others).schema.add(data, "binary")

    def run(batches):
        _, table = tokenizer_of(path, pattern)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, bound = column.values.to_numpy().tolist(), column.offsets.to_pylist()
            empty = column.is_null().to_pylist()
            values = [None if empty[i] else b"".join([table[x] for x in flat[bound[i] : bound[i + 1]]]) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.binary())], names=schema.names)

    out = encoded.select(*others, ids).mapInArrow(run, schema)
    return out.withColumn(text, F.make_valid_utf8(F.col(data).cast("string"))) if text else out


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), *vocabulary)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and, from the decoded ids, decoded_sha256."""
    coded = encode(docs, path, pattern, packed="packed", data="data")
    return coded.withColumns({"n_tokens": (F.octet_length("packed") / 4).cast("long"), "ids_sha256": F.sha2("packed", 256), "decoded_sha256": F.sha2("data", 256)}).drop("ids", "packed", "data")
