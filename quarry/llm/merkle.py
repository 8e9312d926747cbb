"""Op 12. Merkle manifest of a dataset: an associative forest of unresolved nodes, merged by treeReduce, and an inclusion proof for every row.

Each language is a tree over its documents, and the languages' roots are the leaves of one more tree. As the size of every tree is known, so is
the number of siblings of every node: a node whose run of siblings is whole becomes its parent at once. What a partition cannot resolve, a few nodes
for each end of its range, is its fragment; fragments merge in any order until the root is left.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, written
from quarry.llm.sharding import with_prefix_sums

#: Levels of a tree that one task works out at once for proofs: blocks of at most 2^13 nodes.
LEVELS = 13
#: Number of the tree over the roots of all trees.
TOP = -1

NODE = "tree long, n long, level int, place long, digest string"
PATHS = "tree long, place long, digest string, subroot string, path array<string>"
PROOFS = "doc_id long, leaf string, subroot string, proof array<string>, folded_root string"


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves of a tree of n leaves: 0 for a lone leaf."""
    return (n - 1).bit_length() if n > 1 else 0


class Forest:
    """Unresolved nodes, by tree, size of the tree, level and place; and what has been resolved on the way at the levels that proofs are cut at.

    `merge` is associative and commutative, with the empty forest as its neutral element, so partitions may be of any kind; those that hold
    runs of neighbours leave fewer nodes.
    """

    def __init__(self, trees: int, levels: int = LEVELS):
        self.trees, self.levels = trees, levels
        self.nodes: dict[tuple[int, int, int, int], str] = {}
        self.resolved: list[tuple[int, int, int, int, str]] = []

    def add(self, tree: int, n: int, level: int, place: int, digest: str) -> None:
        while True:
            if tree != TOP and level == height(n):
                tree, n, level, place = TOP, self.trees, 0, tree
            if level % self.levels == 0 and (tree == TOP or level):
                self.resolved.append((tree, n, level, place, digest))
            if level == height(n):
                self.nodes[tree, n, level, place] = digest  # the root of all
                return
            width = (n + (1 << level) - 1) >> level
            if place == width - 1 and not place & 1:
                digest = hashed(digest)  # the last run has one node
            else:
                other = self.nodes.pop((tree, n, level, place ^ 1), None)
                if other is None:
                    self.nodes[tree, n, level, place] = digest
                    return
                digest = hashed(other, digest) if place & 1 else hashed(digest, other)
            level, place = level + 1, place >> 1

    def merge(self, other: Forest) -> Forest:
        large, small = (self, other) if len(self.nodes) >= len(other.nodes) else (other, self)
        large.resolved += small.resolved
        for key, digest in small.nodes.items():
            large.add_again(key, digest)
        return large

    def add_again(self, key: tuple[int, int, int, int], digest: str) -> None:
        """A node that another forest has held: it is on its list of resolved nodes already."""
        held = len(self.resolved)
        self.add(*key, digest)
        if len(self.resolved) > held and self.resolved[held][:4] == key:
            del self.resolved[held]


def _fragments(trees: int, levels: int):
    """Leaves of a partition to the nodes that it leaves unresolved (open), and those it resolves at the levels that proofs are cut at."""

    def run(batches):
        forest = Forest(trees, levels)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "n", "place", "leaf")]
            for tree, n, place, leaf in zip(*columns, strict=True):
                forest.add(tree, n, 0, place, leaf)
            if len(forest.resolved) > 50_000:
                yield _rows(forest.resolved, False)
                forest.resolved = []
        yield _rows(forest.resolved, False)
        yield _rows([(*k, d) for k, d in forest.nodes.items()], True)

    return run


def _rows(nodes: list[tuple], is_open: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([is_open] * len(nodes), pa.bool_())], names=["tree", "n", "level", "place", "digest", "open"])


def _forest(trees: int, levels: int):
    def run(rows):
        forest = Forest(trees, levels)
        for r in rows:
            forest.add_again((r.tree, r.n, r.level, r.place), r.digest)
        yield forest

    return run


def siblings(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """For each level of a block of neighbours, `levels` at most and up to the root of a tree of n such nodes: what stands beside each node, led by < if it
    comes before the node and by > if after; empty for a node alone in its run."""
    out = []
    for _ in range(min(levels, height(n))):
        pairs = [digests[i : i + 2] for i in range(0, len(digests), 2)]
        out.append([x for p in pairs for x in ((f">{p[1]}", f"<{p[0]}") if len(p) > 1 else ("",))])
        digests = [hashed(*p) for p in pairs]
    return out


def fold(digest: str, path: list[str]) -> str:
    """The root that a node and what stands beside it on its way up lead to."""
    for beside in path:
        digest = hashed(beside[1:], digest) if beside[:1] == "<" else hashed(digest, beside[1:])
    return digest


def _ways(levels: int, tier: int, rows: list[dict]) -> list[list[str]]:
    """The way up of each node of a block, to the block's top. rows: n, place; in order of place."""
    n = (rows[0]["n"] + (1 << levels * tier) - 1) >> levels * tier
    beside = siblings([r["digest"] for r in rows], n, levels)
    return [[level[i >> k] for k, level in enumerate(beside)] for i in range(len(rows))]


def _lift(levels: int, tier: int):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["place"])
        top = above.to_pylist()[0] if rows else {}
        out = [(r["tree"], r["place"], r["digest"], top["subroot"], way + top["path"]) for r, way in zip(rows, _ways(levels, tier, rows) if rows else [], strict=True)]
        return _table(out, ["tree", "place", "digest", "subroot", "path"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())])

    return run


def _prove(levels: int):
    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["place"])
        top = above.to_pylist()[0] if rows else {}
        out = []
        for r, way in zip(rows, _ways(levels, 0, rows) if rows else [], strict=True):
            path = way + top["path"]
            out.append((r["doc_id"], r["digest"], top["subroot"], path, fold(r["altered"] or r["digest"], path)))
        return _table(out, ["doc_id", "leaf", "subroot", "proof", "folded_root"], [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()])

    return run


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _beside(nodes: DataFrame, above: DataFrame, levels: int, run, schema: str) -> DataFrame:
    """Blocks of nodes with the way up of each block's top, which `above` has by tree and place of the block."""
    block = nodes.withColumn("block", F.shiftright("place", levels)).groupBy("tree", "block")
    return block.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def _above(nodes: DataFrame, ends: DataFrame, highest: int, levels: int, tier: int = 0) -> DataFrame:
    """tree, place, subroot, path: the way up of the top of each block of the tier, to the root of all. ends: tree, height, subroot, path of each tree's
    root. A tree that ends in this tier has one block; the blocks of others are nodes of the tier above."""
    last = (F.col("height") <= levels * (tier + 1)) & ((F.col("height") > levels * tier) | F.lit(tier == 0))
    own = ends.where(last).select("tree", F.lit(0).cast("long").alias("place"), "subroot", "path")
    if highest <= levels * (tier + 1):
        return own
    higher = nodes.where(F.col("level") == levels * (tier + 1)).select("tree", "n", "place", "digest")
    lifted = _beside(higher, _above(nodes, ends, highest, levels, tier + 1), levels, _lift(levels, tier + 1), PATHS)
    return own.unionByName(lifted.select("tree", "place", "subroot", "path"))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (what stands beside each node on the way from leaf to root), folded_root.

    leaves: lang, doc_id, leaf and altered (digests as hex text; altered null for rows that are as they were). A tree for each lang, null first, then
    by bytes; its leaves by doc_id, null first, ties by leaf. folded_root is what the altered leaf, else the leaf, and its proof lead to. A row for each
    row; repeated rows have leaves and proofs of their own; an empty table gives no rows.

    One range exchange of slim rows orders the leaves, so a language of any size is split over tasks. The driver gets the root and what merging resolved
    for proofs: a few nodes for each partition and level. Proofs are worked out in blocks of 2^levels nodes, tier by tier.
    """
    spark = leaves.sparkSession
    slim = leaves.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "altered", F.lit(1).alias("one"))
    ordered = with_prefix_sums(slim, ["lang", "doc_id", "leaf"], "one").drop("before", "one")
    trees = ordered.groupBy("lang").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = written(with_prefix_sums(trees, ["first"], "n", rank="tree").select(F.col("lang").alias("of_lang"), "first", "n", "tree"), "trees")
    count, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], PROOFS).select("doc_id", "leaf", "subroot", F.lit("").alias("root"), "proof", "folded_root")
    placed = ordered.join(trees, F.col("lang").eqNullSafe(F.col("of_lang")))
    placed = written(placed.select("tree", "n", (F.col("row") - F.col("first")).alias("place"), "doc_id", "leaf", "altered"), "leaves")
    parts = written(placed.select("tree", "n", "place", "leaf").mapInArrow(_fragments(count, levels), f"{NODE}, open boolean"), "fragments")
    merged = parts.where("open").rdd.mapPartitions(_forest(count, levels)).treeReduce(Forest.merge, depth=3)
    root = merged.nodes[TOP, count, height(count), 0]
    nodes = parts.where("not open").drop("open").unionByName(spark.createDataFrame(merged.resolved, NODE))
    highest = spark.createDataFrame([(TOP, height(count), "", [])], "tree long, height int, subroot string, path array<string>")
    tops = nodes.where(F.col("tree") == TOP)
    ways = _beside(tops.where("level = 0").drop("level"), _above(tops, highest, height(count), levels), levels, _lift(levels, 0), PATHS)
    heights = trees.select("tree", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).alias("height"))
    ends = ways.select(F.col("place").alias("tree"), F.col("digest").alias("subroot"), "path").join(heights, "tree")
    above = _above(nodes.where(F.col("tree") != TOP), ends, height(most), levels)
    proofs = _beside(placed.withColumnRenamed("leaf", "digest"), above, levels, _prove(levels), PROOFS)
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof", "folded_root")


def leaf_of(*columns: Column) -> Column:
    """Digest of a row: each value with its number of bytes before it, - for null."""
    told = (F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in (c.cast("string") for c in columns))
    return F.sha2(F.concat(*told), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, altered: the leaf with n_chars one larger where 7 divides crc32(doc_id)."""
    before, text = [F.col(c) for c in ("doc_id", "source", "lang")], F.col("text")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = F.when(chosen & F.col("n_chars").isNotNull(), leaf_of(*before, F.col("n_chars").cast("long") + 1, text))
    return docs.select("lang", "doc_id", leaf_of(*before, F.col("n_chars"), text).alias("leaf"), altered.alias("altered"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(document_leaves(documents(spark, sf_dir)))
    proof = F.array_join(F.transform("proof", lambda x: F.substring(x, 2, 64)), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
