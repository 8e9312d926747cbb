"""Op 4. Exact n-gram Jaccard join with a token-group matrix.

Documents with the same shingle set form a class. Classes that may be similar come together by signatures. At high thresholds these
are hashes of parts: a linked pair differs in few shingles, fewer than there are parts of the hash space, so one part at least is the
same in both. At lower ones they are the rarest shingles of each set, one more than a linked set can lack.
Classes that share signatures, directly or through others, form a neighbourhood; no similar pair lies across two of them.

Inside a neighbourhood the join is a token-group matrix: similar classes stand side by side in groups, each group keeps the union
of its members' shingles, the overlap of a class with that union bounds its overlap with every member, and only groups whose bound
reaches the threshold are opened and compared exactly. Large neighbourhoods, most of them chains of sets that are not similar, are first
parted by their own exact counts of shingles; what stays large is cut into tiles, and pairs of tiles are tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quarry.llm import hashing, units
from quarry.llm.common import documents, partitions, small_batches, sorted_join, text_of, written
from quarry.llm.components import components

#: Sets in a group of the matrix; sets and shingles in a tile at most, so a task holds two tiles whatever the size of a neighbourhood.
GROUP, TILE, TILE_SHINGLES = 64, 4096, 1_500_000
#: Sets and shingles up to which a neighbourhood is one task, and beyond which it is parted first. Parting moves each shingle twice with the name of its
#: set, 32 bytes; comparing tiles moves 8 bytes of it to each tile of its own and the next band of sizes, which is more from about 40 tiles on.
WHOLE, WHOLE_SHINGLES, PARTED, PARTED_SHINGLES = 512, 500_000, 160_000, 60_000_000
#: From this similarity on, in percent, equal parts of the hash space hold enough shingles to tell sets apart; below, rare shingles do.
PARTS_FROM = 88


class Levels:
    """Sizes of sets in levels of about 1.3 times; `parts[l]` parts are enough for two linked sets of at most `upto[l]` shingles."""

    def __init__(self, percent: int):
        self.percent = percent
        self.upto, self.parts, self.slack = [], [], []
        size = 1
        while self.differ(size + 1, size + 1) == 0:
            size += 1
        while size < 1 << 40:
            slack = 2 if size >= 64 else 0
            self.upto.append(size)
            self.parts.append(self.differ(size, size) + 1 + slack)
            self.slack.append(slack)
            size = max(size + 1, size * 13 // 10)

    def differ(self, a: int, b: int) -> int:
        """Shingles that stand in one only of two linked sets of these sizes, at most."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def rarest(self, tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The rarest shingles of a set, one more than a linked set can lack: two linked sets share one of them at least.

        ranks: of each bucket of shingles, how common it is; shingles of one rank follow their hash. Any order that all sets share
        would do, but with the rare ones first hardly any sets meet that are not linked.
        """
        n = len(tokens)
        if not n:
            return tokens
        keep = n - -(-n * self.percent // 100) + 1
        bits = np.uint64(64 - int(len(ranks)).bit_length() + 1)
        order = hashing.mix(tokens) >> np.uint64(8) | ranks[(tokens >> bits).astype("i8")].astype("u8") << np.uint64(56)
        return tokens[np.argpartition(order, keep - 1)[:keep]]

    def level(self, n: int) -> int:
        return int(np.searchsorted(self.upto, n))

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """A hash of each part's shingles, at the set's own level and at that of the largest set it can be linked with.

        Parts with fewer than two shingles tell little; as there are `slack` parts more than needed, up to `slack` of them are left out.
        Sets so small that only equal ones are linked have none.
        """
        n, out = len(tokens), []
        if not n:
            return np.zeros(0, "u8")
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(hashing.mix(tokens ^ np.uint64(0xA5A5A5A5)), dtype="u8")])
        for level in {self.level(n), self.level(n * 100 // self.percent)}:
            if level == 0:
                continue
            k = self.parts[level]
            part = ((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            bound = np.searchsorted(part, np.arange(k + 1, dtype="u8"))
            counts = np.diff(bound)
            sig = hashing.mix(sums[bound[1:]] - sums[bound[:-1]] + np.arange(k, dtype="u8") * np.uint64(0x9E3779B97F4A7C15) + hashing.mix(np.array([level], "u8")))
            thin = counts < 2
            out.append(sig[~thin] if 0 < thin.sum() <= self.slack[level] else sig)
        return np.concatenate(out) if out else np.zeros(0, "u8")


def shingle_sets(texts: pa.Array, k: int):
    """The shingle set of each text."""
    data, at = units.bytes_of(texts)
    word, upto = hashing.words(data, at)
    start = 0
    for end in upto.tolist():
        yield hashing.shingles(word[start:end], k)
        start = end


#: Buckets of the sketch of common shingles, as a power of two, at most; and bytes of text for each bucket.
SKETCH_BITS, BYTES_A_BUCKET = 26, 64


def common_ranks(texts: DataFrame, k: int) -> np.ndarray:
    """How common the shingles of each hash bucket are, in half powers of two, from all texts.

    Each task counts into a byte for each bucket and compresses its counts; they are added in ranges of buckets, whose number grows with the corpus.
    What the driver gets and sends to the tasks has a byte for each bucket: 64 MB at most. Beyond that size of corpus buckets hold more
    shingles, so fewer differ in rank and more sets meet; `parted` sets them apart again, and which sets are linked does not change.
    """
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(12, min(SKETCH_BITS, (size // BYTES_A_BUCKET).bit_length()))
    ranges = 1 << max(6, min(12, (size >> 26).bit_length()))

    def count(batches):
        counts = np.zeros(1 << bits, "u1")
        seen: set[int] = set()
        for batch in batches:
            for part in units.slices(batch.column(0)):
                for tokens in shingle_sets(part, k):
                    name = set_hash(tokens)
                    if name not in seen:
                        seen.add(name)
                        at = (tokens >> np.uint64(64 - bits)).astype("i8")
                        counts[at] += counts[at] < 255
        packer = zstandard.ZstdCompressor(level=1)
        parts = [packer.compress(c.tobytes()) for c in np.split(counts, ranges)]
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int64()), pa.array(parts, pa.binary())], names=["part", "counts"])
        del counts, parts, seen
        units.release()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // ranges, "u4")
        for c in table.column("counts"):
            total += np.frombuffer(zstandard.decompress(c.as_py()), "u1")
        rank = np.floor(2 * np.log2(np.maximum(total, 1))).astype("u1")
        return pa.table({"part": table.column("part")[:1], "ranks": pa.array([zstandard.compress(rank.tobytes())], pa.binary())})

    rows = texts.select("text").mapInArrow(count, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, ranks binary").collect()
    found = [np.frombuffer(zstandard.decompress(bytes(r.ranks)), "u1") for r in sorted(rows, key=lambda r: r.part)]
    return np.concatenate(found) if found else np.zeros(1 << bits, "u1")


def set_hash(tokens: np.ndarray) -> int:
    both = np.array([hashing.mix(tokens).sum(dtype="u8"), np.bitwise_xor.reduce(tokens) if len(tokens) else 0, len(tokens)], "u8")
    return int(hashing.mix(both * np.array([3, 5, 7], "u8")).sum(dtype="u8").astype("i8"))


class Members:
    """Sets of one neighbourhood or tile: tokens as numbers from 0, in groups of similar sets."""

    def __init__(self, sets: list[np.ndarray], vocabulary: np.ndarray):
        self.sizes = np.array([len(s) for s in sets], "int64")
        self.tokens = np.searchsorted(vocabulary, np.concatenate(sets))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.groups = [(g, min(g + GROUP, len(sets))) for g in range(0, len(sets), GROUP)]
        # the matrix, by token: which groups hold it
        pairs = self.tokens * len(self.groups)
        pairs += np.repeat(np.arange(len(sets)) // GROUP, self.sizes)
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        self.by_token = pairs % len(self.groups)
        self.first = np.searchsorted(pairs // len(self.groups), np.arange(len(vocabulary) + 1))

    def of(self, i: int) -> np.ndarray:
        return self.tokens[self.starts[i] : self.starts[i] + self.sizes[i]]

    def bounds(self, own: np.ndarray) -> np.ndarray:
        """For each group, how many of the tokens its union holds."""
        a, b = self.first[own], self.first[own + 1]
        n = b - a
        places = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.by_token[places], minlength=len(self.groups))


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int):
    """Pairs of indexes (i, array of j) whose sets are linked: within `left` (j > i), or between left and right."""
    vocabulary = np.unique(np.concatenate([*left, *(right or [])]))
    own = Members(left, vocabulary)
    other = own if right is None else Members(right, vocabulary)
    marked = np.zeros(len(vocabulary), bool)
    for i in range(len(left)):
        tokens = own.of(i)
        size, least = len(tokens), -(-len(tokens) * percent // 100)
        first = i + 1 if right is None else 0
        for g in np.flatnonzero(other.bounds(tokens) >= least).tolist():
            a, b = other.groups[g]
            a = max(a, first)
            if a >= b:
                continue
            sizes = other.sizes[a:b]
            fit = np.flatnonzero((sizes * 100 >= size * percent) & (size * 100 >= sizes * percent))
            if not len(fit):
                continue
            marked[tokens] = True
            span = other.starts[a], other.starts[b - 1] + other.sizes[b - 1]
            upto = np.concatenate([[0], np.cumsum(marked[other.tokens[span[0] : span[1]]])])
            at = other.starts[a:b] - span[0]
            common = upto[at + sizes] - upto[at]
            marked[tokens] = False
            linked = np.flatnonzero(100 * common >= percent * (size + sizes - common))
            if len(linked):
                yield i, linked + a


def _solve(percent: int):
    def run(table: pa.Table) -> pa.Table:
        first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        itself = any(table.column("itself").to_pylist())  # the first tile is held against itself, too
        # tokens stay where Arrow has them
        keys = (table.column(c).to_pylist() for c in ("hood", "side", "order", "class", "copies"))
        rows = sorted(zip(*keys, table.column("tokens"), strict=True), key=lambda r: r[:4])
        out: dict[int, list] = {}
        at = 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            hood, at = rows[at:to], to
            sides = [[], []]
            seen = set()
            for _, side, _, name, copies, tokens in hood:
                if (side, name) not in seen:
                    seen.add((side, name))
                    sides[side].append((name, copies, np.frombuffer(tokens.as_buffer(), "u8")))
            parent = {r[0]: r[0] for s in sides for r in s}

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = dict.fromkeys(parent, 0)
            left, right = sides[0], sides[1]
            found = []
            if left and itself:
                found.append((left, links_between([r[2] for r in left], None, percent)))
            if left and right and first != second:
                found.append((right, links_between([r[2] for r in left], [r[2] for r in right], percent)))
            for others, pairs in found:
                for i, js in pairs:
                    for j in js.tolist():
                        a, b = left[i], others[j]
                        links[a[0]] += b[1]
                        links[b[0]] += a[1]
                        x, y = root(a[0]), root(b[0])
                        if x != y:
                            parent[max(x, y)] = min(x, y)
            for name in parent:
                out.setdefault(name, []).append((root(name), links[name]))
        del rows
        units.release()
        flat = [(name, r, n) for name, found in out.items() for r, n in found]
        return pa.table({"class": pa.array([f[0] for f in flat], pa.int64()), "root": pa.array([f[1] for f in flat], pa.int64()), "links": pa.array([f[2] for f in flat], pa.int64())})

    return run


def parted(members: DataFrame, percent: int) -> DataFrame:
    """members (class, hood, size, tokens, ...) with large neighbourhoods parted into those that similar sets need; sets that are alone then are left out.

    Each shingle of these neighbourhoods is counted exactly. Shingles that one set only holds meet nothing; of the others each set gives the rarest,
    as many as a linked set could not lack, and sets that share one of these stay together. Only large neighbourhoods are exploded, into one slim
    row for each shingle of each set; the lists that are collected have the length of one set.
    """
    sizes = members.groupBy("hood").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    large = sizes.where((F.col("n") > PARTED) | (F.col("shingles") > PARTED_SHINGLES)).select("hood", F.lit(True).alias("large"))
    if large.isEmpty():
        return members
    marked = members.join(large, "hood", "left")
    big = marked.where("large")

    def explode(batches):
        for batch in batches:
            n = np.array([len(t) // 8 for t in batch.column(1).to_pylist()])
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            name = np.repeat(batch.column(0).to_numpy(), n)
            for at in range(0, len(tokens), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in (name, tokens)], names=["class", "token"])

    # neighbourhoods are counted together: any order of the shingles that all sets share would do, and no row needs to name its neighbourhood
    rows = big.select("class", "tokens").mapInArrow(explode, "class long, token long")
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = rows.join(sorted_join(held), "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    shared = shared.join(big.select("class", "size"), "class")
    least = F.floor((F.col("size") * percent + 99) / 100)
    due = F.col("size") - least + 1 - (F.col("size") - F.size("shared"))  # of the first ones, those that others hold as well
    signed = shared.where(due > 0).select("class", F.explode(F.slice("shared", F.lit(1), F.least(due, F.size("shared")).cast("int"))).alias("s"))
    signed = written(signed.select("class", F.col("s.token").alias("signature")), "rarest")
    found = components(stars_of(signed)).select(F.col("a").alias("class"), F.col("component").alias("part"))
    apart = big.drop("large").join(sorted_join(found), "class").withColumn("hood", F.col("part")).drop("part")
    rest = marked.where("large is null").drop("large")
    return written(rest.select(*members.columns).unionByName(apart.select(*members.columns)), "parted")


def stars_of(signed: DataFrame) -> DataFrame:
    """Links from each class to the least one that shares a signature (class, signature) with it."""
    shared = signed.groupBy("signature").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("signature", "least")
    return signed.join(sorted_join(shared), "signature").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()


def similar_documents(docs: DataFrame, k: int = 3, percent: int = 90, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, n_links, component, and the columns of `carry`, for every row of docs (doc_id, text).

    component numbers the component (null for empty sets), as component_id may be null.

    Sets: distinct runs of k lower-cased (A-Z) words of the whole text; with fewer words the whole sequence. Two rows are linked
    when 100 * common >= percent * united. class_id: smallest doc_id with the same set; component_id: smallest doc_id that
    links reach; n_links: linked rows. A null text, or one without words, has an empty set and is linked with nothing. A null
    doc_id takes part like any other, but is never the smallest; rows of such ids alone have null for component and class.
    Repeated rows are rows of their own, linked with each other. Other columns are ignored.

    An empty table gives no rows; a very long text is a set like any other, and its signatures grow with it.

    Shingles, sets and signatures are 64-bit hashes. Copies collapse into their class before anything is compared, so a group
    of copies costs one comparison whatever its size; links within a class are counted and not listed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    levels = Levels(percent)
    ranks = None if percent >= PARTS_FROM else spark.sparkContext.broadcast(common_ranks(docs.select(text_of().alias("text")), k))

    def signatures(tokens: np.ndarray) -> np.ndarray:
        return levels.signatures(tokens) if ranks is None else levels.rarest(tokens, ranks.value)

    def scan(batches):
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for texts in units.slices(batch.column(1)):
                sizes, names, signs = [], [], []
                for tokens in shingle_sets(texts, k):
                    name = set_hash(tokens)
                    sizes.append(len(tokens))
                    names.append(name)
                    # copies in one task have the same signatures
                    signs.append(np.zeros(0, "i8") if name in seen or not len(tokens) else signatures(tokens).astype("i8"))
                    seen.add(name)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in signs])]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signs) if signs else np.zeros(0, "i8")))
                kept = [batch.column(c).slice(at, len(texts)) for c in range(batch.num_columns) if c != 1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), lists], names=schema.names)
                at += len(texts)
        units.release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *carry)
    schema = given.drop("text").schema.add("n_shingles", LongType()).add("class", LongType()).add("signatures", ArrayType(LongType()))
    sets = written(given.mapInArrow(scan, schema), "sets")
    own = sets.select("doc_id", *carry, "n_shingles", "class")
    classes = written(own.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size")), "classes")

    signed = sets.select("class", F.explode("signatures").alias("signature"))
    hoods = components(stars_of(signed)).select(F.col("a").alias("class"), F.col("component").alias("hood"))
    hoods = written(hoods.join(sorted_join(classes), "class"), "hoods")

    # the sets of these classes, from the text of one document each
    wanted = hoods.select("class", "hood", "copies", "size", F.coalesce("class_id", F.lit(-1)).alias("key"))

    def tokens(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            at = 0
            for texts in units.slices(batch.column(batch.num_columns - 1)):
                keep, data, order = [], [], []
                for i, t in enumerate(shingle_sets(texts, k), at):
                    if set_hash(t) == names[i]:
                        keep.append(i)
                        data.append(t.tobytes())
                        order.append(int(t[0] >> np.uint64(1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep, pa.int64())) for c in range(4)), pa.array(order, pa.int64()), pa.array(data, pa.binary())], names=["class", "hood", "copies", "size", "order", "tokens"])
                at += len(texts)
        units.release()

    texts = slim.withColumn("key", F.coalesce("doc_id", F.lit(-1)))
    members = wanted.join(sorted_join(texts), "key").select("class", "hood", "copies", "size", "text").mapInArrow(tokens, "class long, hood long, copies long, size long, order long, tokens binary")
    members = parted(written(members, "members"), percent)  # written: the texts' exchange is not needed any longer

    # Small neighbourhoods share tasks. Large ones are cut by size into bands, as linked sets lie in the same or the next band, and
    # bands into tiles; each pair of tiles that can hold links is a task, and a tile meets itself together with its first later partner.
    band = F.floor(F.log("size") / (math.log(100 / percent) * 1.0001)).cast("int")
    counts = members.withColumn("band", band).groupBy("hood", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    in_hood, by_band = Window.partitionBy("hood"), Window.partitionBy("hood").orderBy("band")
    whole = (F.sum("n").over(in_hood) <= WHOLE) & (F.sum("shingles").over(in_hood) <= WHOLE_SHINGLES)
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")

    def beside(step: int) -> Column:
        return F.when(F.lag("band", -step).over(by_band) == F.col("band") + step, F.lag("tiles", -step).over(by_band)).otherwise(0)

    counts = written(counts.withColumn("whole", whole).withColumn("tiles", tiles).withColumns({"after": beside(1), "before": beside(-1)}), "bands")
    shingles_in_all = counts.agg(F.coalesce(F.sum("shingles"), F.lit(0))).first()[0]
    tasks = max(4 * partitions(spark), shingles_in_all // 400_000)
    dealt = members.withColumn("band", band).join(counts.select("hood", "band", "whole", "tiles", "after", "before"), ["hood", "band"])
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))

    def number(b: Column, t: Column) -> Column:
        return b.cast("long") * 1_000_000 + t

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def pair(a: Column, b: Column, side: Column, itself: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"), itself.alias("itself"))

    b, own_tile = F.col("band"), F.col("tile")
    # the first later partner of a tile: the next tile of its band, else the first of the next band, else none
    last = own_tile == F.col("tiles") - 1
    lonely = F.when(last & (F.col("after") == 0), F.array(pair(number(b, own_tile), number(b, own_tile), F.lit(0), F.lit(True)))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint,side:int,itself:boolean>>"))
    same = F.transform(F.filter(upto(F.col("tiles")), lambda t: t != own_tile), lambda t: pair(number(b, F.least(t, own_tile)), number(b, F.greatest(t, own_tile)), own_tile > t, F.greatest(t, own_tile) == F.least(t, own_tile) + 1))
    later = F.transform(upto(F.col("after")), lambda t: pair(number(b, own_tile), number(b + 1, t), F.lit(0), last & (t == 0)))
    earlier = F.transform(upto(F.col("before")), lambda t: pair(number(b - 1, t), number(b, own_tile), F.lit(1), F.lit(False)))
    pairs = F.when(F.col("whole"), F.array(pair(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(0), F.lit(True)))).otherwise(F.concat(lonely, same, later, earlier))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select("hood", "pair.*", "order", "class", "copies", "tokens")
    work = F.when(F.col("a") < 0, F.pmod(F.xxhash64("hood"), F.lit(tasks))).otherwise(F.xxhash64("hood", "a", "b"))
    solved = written(dealt.withColumn("work", work).groupBy("work", "a", "b").applyInArrow(_solve(percent), "class long, root long, links long"), "solved")

    linked = components(solved.where("class <> root").select(F.col("class").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("class"), "component")
    counts = solved.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(linked, "class", "left").join(counts, "class", "left").withColumn("component", F.coalesce("component", "class"))
    known = written(known, "known")
    least = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = known.join(least, "component").select("class", "class_id", "component_id", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    empty = F.col("n_shingles") == 0
    return own.join(sorted_join(known), "class", "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", *carry
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component of `similar_documents` one row stays, that of the smallest doc_id.

    Rows without words are linked with nothing and all stay. Rows with a null doc_id give way to any other; of several rows alike in
    doc_id and text one stays.
    """
    row = F.struct(*docs.columns).alias("row")  # so that no column of docs meets a name of ours
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark_of_text"), row)
    found = similar_documents(marked.drop("row"), k, percent, ("mark_of_text",)).where("component is not null")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark_of_text")).alias("first")
    stay = found.groupBy("component").agg(first).select(F.coalesce("first.doc_id", F.lit(-1)).alias("own_id"), F.col("first.doc_id").isNull().alias("own_null"), F.col("first.mark_of_text").alias("own_mark"))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    full = marked.where(~wordless).select(F.coalesce("doc_id", F.lit(-1)).alias("own_id"), F.col("doc_id").isNull().alias("own_null"), F.col("mark_of_text").alias("own_mark"), "row")
    kept = full.join(sorted_join(stay), ["own_id", "own_null", "own_mark"]).dropDuplicates(["own_id", "own_null", "own_mark"])
    return kept.select("row.*").unionByName(docs.where(wordless))


def op4_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).drop("component")
