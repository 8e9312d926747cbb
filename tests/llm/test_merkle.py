"""Op 12 against a plain tree, level by level."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle

H = lambda *x: sha256("".join(x).encode()).hexdigest()
ODD = "doc_id long, text string, lang string, source string, n_chars int, leaf string, root int, tree string, place string"


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf what stands before and after it in its run, level by level."""
    beside, under = [[] for _ in leaves], [[i] for i in range(len(leaves))]
    while len(leaves) > 1:
        runs = [leaves[i : i + 2] for i in range(0, len(leaves), 2)]
        for i, own in enumerate(under):
            run = runs[i // 2]
            for leaf in own:
                beside[leaf].append((run[0] if i % 2 else "", run[1] if not i % 2 and len(run) > 1 else ""))
        under = [sum(under[i : i + 2], []) for i in range(0, len(under), 2)]
        leaves = [H(*r) for r in runs]
    return leaves[0], beside


def plain(docs) -> list[tuple]:
    def leaf(d, more=0):
        values = [d.doc_id, d.source, d.lang, None if d.n_chars is None else d.n_chars + more, d.text]
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = sorted({d.lang for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    out, subroots = [], []
    for lang in langs:
        own = sorted((d for d in docs if d.lang == lang), key=lambda d: (d.doc_id is not None, d.doc_id or 0, leaf(d)))
        subroot, beside = plain_tree([leaf(d) for d in own])
        subroots.append(subroot)
        out.append((own, beside))
    if not docs:
        return []
    root, above = plain_tree(subroots)
    rows = []
    for (own, beside), up, subroot in zip(out, above, subroots, strict=True):
        for d, way in zip(own, beside, strict=True):
            tampered = d.doc_id is not None and zlib.crc32(str(d.doc_id).encode()) % 7 == 0
            folded = leaf(d, int(tampered))
            for before, after in way + up:
                folded = H(before, folded, after)
            rows.append((d.doc_id, leaf(d), subroot, root, H(*(x for pair in way + up for x in pair)), folded, folded == root))
    return sorted(rows, key=str)


def told(df) -> list[tuple]:
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()), key=str)


def test_query_equals_plain_tree(spark, sf_dir):
    found = told(merkle.op12_merkle_manifest(spark, sf_dir))
    assert found == plain(spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert 0 < sum(not r[-1] for r in found) < len(found) / 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 100])
def test_forest_does_not_depend_on_how_leaves_are_dealt(n):
    rng = random.Random(n)
    sizes = [n, 1, 5]
    leaves = [(t, size, 0, i, H(str((t, i)))) for t, size in enumerate(sizes) for i in range(size)]
    want = plain_tree([plain_tree([H(str((t, i))) for i in range(size)])[0] for t, size in enumerate(sizes)])[0]
    seen = set()
    for parts in (1, 3, 8):
        rng.shuffle(leaves)
        forests = [merkle.Forest(3, 2) for _ in range(parts)]
        for i, leaf in enumerate(leaves):
            forests[i % parts].add(*leaf)
        while len(forests) > 1:
            a, b = (forests.pop(rng.randrange(len(forests))) for _ in range(2))
            forests.append(a.merge(merkle.Forest(3, 2)).merge(b))
        assert list(forests[0].nodes.values()) == [want]
        assert len(forests[0].resolved) == len(set(forests[0].resolved))
        seen.add(tuple(sorted(forests[0].resolved)))
    assert len(seen) == 1


def test_neighbours_leave_few_nodes_open():
    forest = merkle.Forest(1)
    for i in range(1000, 5000):
        forest.add(0, 100_000, 0, i, H(str(i)))
    assert len(forest.nodes) <= 2 * 13


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_small_blocks_of_many_tiers(spark, levels):
    rng = random.Random(levels)
    docs = [(i, f"t{i}", rng.choice([None, "a", "b", "b", "b", "é", *"cdefghij"]), None, i) for i in range(150)] + [(9_000, "x", "lone", "s", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int")
    found = merkle.manifest(merkle.document_leaves(df), levels)
    rows = [(r.doc_id, r.leaf, r.subroot, r.root, H(*(x[1:] for x in r.proof)), r.folded_root, r.folded_root == r.root) for r in found.collect()]
    assert sorted(rows, key=str) == plain(df.collect())


def test_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "x", None, "s", 1), (1, "", "", "", 0), (1, "", "", "", 0), (2, "é" * 9, "z", None, 9), (2, "other", "z", None, 5), (3, "long " * 60_000, "z", "s", None), *((i, "t", "z", "s", 1) for i in range(10, 60))]
    spark.createDataFrame([(*r, "l", 1, "t", "p") for r in rows], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    assert told(merkle.op12_merkle_manifest(spark, str(tmp_path))) == plain(spark.read.parquet(f"{tmp_path}/documents.parquet").collect())
    one = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id = 3")
    one.write.parquet(f"{tmp_path}/one/documents.parquet")
    found = merkle.op12_merkle_manifest(spark, f"{tmp_path}/one").collect()
    assert [(r.leaf == r.root == r.subroot, r.proof_sha256 == H(""), r.verified) for r in found] == [(True, True, True)]
    one.where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.op12_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
