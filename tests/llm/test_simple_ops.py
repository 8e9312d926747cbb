"""Ops 3, 5, 9 and 10 against plain versions on small tables."""

import base64
import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyarrow import fs

from quarry.llm import bpe, lzprint, sharding, sstable
from quarry.llm.common import new_path

ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "É́ ñ ß ſ Å", "it's we'll  don't", "x y 　z", "1234567 89.5", "😀 👩‍👩‍👧 é", "a" * 3000, "word " * 2000, "  q \x1c r", "<|endoftext|> <|startoftext|>x", "# $%% ^& ,, ..  !", "日本語 テスト"]


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 1, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, size int")


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]


def test_byte_bpe_equals_tiktoken(spark, some):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(3)
    alphabet = list("abeinorst ''  \n\t1.,éßд中") + ["the", "ing", " "]
    texts = ODD + some + ["".join(rng.choice(alphabet, rng.integers(1, 80))) for _ in range(400)]
    got = {r.doc_id: r for r in bpe.encode(table(spark, texts).drop("ids"), path, P.PATTERN, offsets="at", packed="packed").collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode_ordinary(t or ""), t
        assert bytes(got[i].packed) == np.array(got[i].ids, "<u4").tobytes()
        data, at = (t or "").encode(), 0
        for token, offset in zip(got[i].ids, got[i].at, strict=True):
            assert offset == len(data[: at + 1].decode(errors="ignore") if (data[at] & 0xC0) != 0x80 and data[at] < 0x80 else data[:at].decode(errors="ignore") + "x") - 1
            at += len(own.decode_single_token_bytes(token))
    out = {r.doc_id: r for r in bpe.digests(table(spark, texts).drop("ids"), path, P.PATTERN).collect()}
    assert all(out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and out[i].n_tokens == len(got[i].ids) for i, t in enumerate(texts))


def test_decoding_handles_split_characters(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    df = bpe.encode(table(spark, ["😀日"]).drop("ids"), path, P.PATTERN)
    ids = df.first().ids
    cut = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    rows = {r.doc_id: r for r in bpe.decode(cut, path, P.PATTERN).collect()}
    assert bytes(rows[1].data) == "😀日".encode()[: len(rows[1].data)] and rows[1].decoded.endswith("�") == (len(rows[1].data) % 4 != 0)
    assert rows[2].data is None and bytes(rows[3].data) == b""


def test_sstable_shards(spark, some):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ODD + some
    ids = [*range(-5, len(texts) - 6), None]
    folder = new_path(spark, "sst")
    manifest = sstable.write_shards(table(spark, texts + texts[3:4], [*ids, ids[3]]), P.path("word_bpe_49k.json"), 1, folder, shards=5)
    rows = sstable.read_shards(spark, manifest, folder).orderBy("start").collect()
    want = sorted([*zip(ids, texts, strict=True), (ids[3], texts[3])], key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for r, (i, t) in zip(rows, want, strict=True):
        tokens = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.doc_id, r.start) == (i, at) and tokens == [*own.encode(t or "", add_special_tokens=False).ids, 1], t
        at += len(tokens)
    files, _ = fs.FileSystem.from_uri(folder)
    readers = [sstable.Reader(files, m.path) for m in manifest]
    for i, t in zip(ids, texts, strict=True):
        found = [x for r in readers for x in r.get(sstable.key_of(i))]
        assert len(found) == 1 + (i == ids[3]) and found[0].tolist() == [*own.encode(t or "", add_special_tokens=False).ids, 1]
    assert not any(r.get(sstable.key_of(10**12)) for r in readers)
    assert sstable.write_shards(table(spark, []), P.path("word_bpe_49k.json"), 1, new_path(spark, "sst")) == []


def test_sstable_keeps_prefixes_and_blocks(tmp_path):
    files = fs.LocalFileSystem()
    w = sstable.Writer(files, str(tmp_path / "a.sst"), 4)
    keys = [sstable.key_of(i) for i in range(0, 30_000, 3)]
    for n, k in enumerate(keys):
        w.add(k, np.arange(n % 40) + 70_000)
    w.close()
    r = sstable.Reader(files, str(tmp_path / "a.sst"))
    assert len(r.index) > 3 and [k for k, _ in r] == keys and r.get(keys[777])[0].tolist() == (np.arange(777 % 40) + 70_000).tolist() and r.get(sstable.key_of(1)) == []


def plain_phrases(data: bytes) -> set:
    known, at = set(), 0
    for end in range(1, len(data) + 1):
        if data[at:end] not in known:
            known.add(data[at:end])
            at = end
    return known


def test_lz_parse_is_lz78():
    for t in ["", "a", "aaaaaaa", "abababababc", "é😀é😀" * 9, "the cat the cat sat"]:
        p = lzprint.Parse()
        p.feed(t.encode())
        assert {t.encode()[a:b] for a, b in itertools.pairwise([0, *p.ends])} == plain_phrases(t.encode())


@pytest.mark.parametrize("n", [0, 1, 2, 300])
def test_fingerprints(spark, some, n):
    texts = (ODD + some * 5)[:n]
    ids = [None if i == 7 else (i * 37) % 301 - 20 for i in range(n)]
    df = table(spark, texts, ids)
    rows = lzprint.fingerprints(df.unionByName(df.where("doc_id = -20")) if n > 2 else df).collect()
    pairs = sorted([*zip(ids, texts, strict=True), *((i, t) for i, t in zip(ids, texts, strict=True) if n > 2 and i == -20)], key=lambda x: (x[0] is not None, x[0], x[1] or ""))
    assert len(rows) == len(pairs)
    got = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id))
    for k, (r, (i, t)) in enumerate(zip(got, pairs, strict=True)):
        t, nxt = t or "", pairs[(k + 1) % len(pairs)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.doc_id, r.n_chars) == (i, len(t))
        if i != -20:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def sign(x):
            p = lzprint.Parse()
            p.feed(x.encode())
            return lzprint.signature(x.encode(), p.ends)

        assert r.fingerprint == sign(t).astype(">u4").tobytes().hex()
        if i != -20:
            assert r.edited_fingerprint == sign(edited).astype(">u4").tobytes().hex() and r.near_next == lzprint.likeness(sign(t), sign(nxt))
            a, b = plain_phrases(t.encode()), plain_phrases(edited.encode())
            assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.3


def test_byte_shards(spark, some):
    texts = ODD + some * 10
    ids = [*range(len(texts) - 1), None]
    df = table(spark, texts, ids)
    df = df.unionByName(df.where("doc_id = 5"))
    from pyspark.sql import functions as F

    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = sorted(sharding.shard_by_bytes(df, 8, size).collect(), key=lambda r: (r.shard, r.slot))
    assert len(rows) == len(texts) + 1
    assert [(r.doc_id is not None, r.doc_id) for r in rows] == sorted((r.doc_id is not None, r.doc_id) for r in rows)
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s, own in itertools.groupby(rows, key=lambda r: r.shard):
        own = list(own)
        assert [r.slot for r in own] == list(range(len(own))) and abs(sum(r.size for r in own) - total / 8) <= most
    by = {r.doc_id: r for r in rows}
    assert all(by[i].text_crc32 == zlib.crc32((t or "").encode()) and by[i].size == len((t or "").encode()) + 1 for i, t in zip(ids, texts, strict=True))
    assert sharding.shard_by_bytes(table(spark, []), 8, size).count() == 0


def plain_phrases(data: bytes) -> set[bytes]:
    """The phrases of an LZ78 parse, by the definition: the shortest prefix of the rest that is no phrase yet."""
    seen, at = set(), 0
    while at < len(data):
        n = 1
        while data[at : at + n] in seen and at + n <= len(data):
            n += 1
        if at + n > len(data):
            break
        seen.add(data[at : at + n])
        at += n
    return seen


def plain_hash(phrase: bytes) -> int:
    m = (1 << 64) - 1
    h, power = 0, 1
    for b in phrase:
        h = (h + (b + 1) * power) & m
        power = power * 0x9E3779B97F4A7C15 & m
    h ^= len(phrase) << 48 & m
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 29
    return (h * 0xC4CEB9FE1A85EC53 & m) >> 32


def test_fingerprints_equal_a_plain_version(spark):
    texts = ["", "a", "abababab", "é😀 and more, é😀 and more", "x" * 3000, "the cat sat on the mat " * 40, "one " * 20_000] + [f"row {i} " * (i % 7) for i in range(20)]
    rows = sorted(lzprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    prints = [sorted({plain_hash(p) for p in plain_phrases(t.encode())})[:64] for t in texts]
    assert [r.fingerprint for r in rows] == ["".join(f"{h:08x}" for h in p) for p in prints]
    for i, r in enumerate(rows):
        after = texts[(i + 1) % len(texts)]
        edited = texts[i][: len(texts[i]) - len(texts[i]) // 2] + after[: len(texts[i]) // 2]
        other = sorted({plain_hash(p) for p in plain_phrases(edited.encode())})[:64]
        assert r.edited_fingerprint == "".join(f"{h:08x}" for h in other)
        least = sorted({*prints[i], *other})[:64]
        assert abs(r.near_edited - (sum(h in prints[i] and h in other for h in least) / len(least) if least else 1.0)) < 1e-9


def test_empty_tables(spark):
    import public_tokenizers as P

    none = spark.createDataFrame([], "doc_id long, text string, ids string")
    coded = bpe.encode(none, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert coded.count() == 0 and bpe.decode(coded, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
    assert lzprint.fingerprints(none).count() == 0


def test_bloom_filter_holds_every_key():
    from pyarrow import fs

    import tempfile

    path = f"{tempfile.mkdtemp()}/a.sst"
    w = sstable.Writer(fs.LocalFileSystem(), path, 2)
    for i in range(5000):
        w.add(sstable.key_of(3 * i), np.array([i % 60000, 1]))
    w.close()
    r = sstable.Reader(fs.LocalFileSystem(), path)
    assert all(r.get(sstable.key_of(3 * i))[0][0] == i % 60000 for i in range(0, 5000, 97))
    there = sum(all(r.bloom[b >> 3] >> (b & 7) & 1 for b in sstable._bits(sstable.key_of(3 * i + 1), r.bits)) for i in range(5000))
    assert there < 150 and not any(r.get(sstable.key_of(3 * i + 1)) for i in range(0, 5000, 301))
