"""Op 6. Removal of long repeated byte strings.

A window of `length` bytes is repeated if the same bytes start anywhere else. Every window has an anchor: the k-gram of least hash in
it, which equal windows share. So windows are dealt by anchor, and only anchors that occur more than once go on. The windows of
one anchor that follow each other form a run; runs with equal bytes are one class, and a class of two or more is repeated as a whole.

What is left are anchors with different classes around them. Their segments come together in buckets. In a bucket the segments are
dealt to shards, each shard gets its own Burrows-Wheeler transform, and the transforms are merged by refining their interleave: round
h turns the interleave that is right for h symbols into the one for h + 1 by one stable pass over the merged transform, and the places
where neighbours part in a round are where their common prefix ends. No suffix of another shard is compared or sorted again. The
intervals that last to `length` bytes are the repeated windows. A symbol is a block of bytes, a string of the transform every
block of a segment at one offset, so 400 bytes take 8 rounds and not 400.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import hashing, units
from quarry.llm.common import documents, partitions, small_batches, sorted_join, text_of, written

#: Bytes of an anchor; bytes scanned at once (positions within must fit in 22 bits); segments of one anchor that a task compares at once.
GRAM, SCAN, TOGETHER = 32, 1 << 21, 20_000
#: Bytes of segments up to which all residues are taken together; bytes whose symbols are hashed at once.
AT_ONCE, NAMED = 1 << 20, 1 << 20
#: Segments from which an anchor is a group of its own; shards of a group; rows of an anchor for each part of a hot class, and parts at most.
ALONE, SHARDS, PART, PARTS = 200, 8, 4096, 64


def runs(data: np.ndarray, at: np.ndarray, length: int):
    """Runs of windows with one anchor: text, first and last window (within the text), the anchor's place from the first on, its hash, hash of all bytes.

    data, at: bytes of texts and where each begins, with the end of the last.
    """
    pieces, held, size = [], [], 0
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a < length:
            continue
        if b - a > SCAN:  # one long text: parts that overlap by a window less a byte
            pieces += [[(i, s, min(b, s + SCAN + length - 1), a)] for s in range(a, b - length + 1, SCAN)]
            continue
        if size + b - a > SCAN:
            pieces.append(held)
            held, size = [], 0
        held.append((i, a, b, a))
        size += b - a
    pieces.append(held)
    for piece in pieces:
        if piece:
            yield _runs(data, piece, length)


def _runs(data: np.ndarray, piece: list, length: int) -> tuple[np.ndarray, ...]:
    text, start, end, origin = np.array(piece).T
    part = np.concatenate([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    bound = np.concatenate([[0], np.cumsum(end - start)])
    ranges = hashing.Ranges(part)
    gram = ranges.grams(GRAM)
    low = np.uint64((1 << 22) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype="u8")
    span = length - GRAM + 1
    least, width = key, 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        more = span - width
        least = np.minimum(least[: len(least) - more], least[more:])
    valid = np.ones(len(least), bool)  # windows that do not leave their text
    for b in bound[1:-1].tolist():
        valid[max(0, b - length + 1) : b] = False
    at = np.flatnonzero(valid)
    anchor = (least[at] & low).astype("i8")
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])]
    lo, hi = at[new], at[np.r_[new[1:], True]]
    of = np.searchsorted(bound, lo, "right") - 1
    shift = start[of] - origin[of] - bound[of]
    return text[of], lo + shift, hi + shift, anchor[new] - lo, gram[anchor[new]].astype("i8"), ranges.of(lo, hi + length).astype("i8")


def symbol_bytes(length: int) -> int:
    """Bytes of a symbol: the largest divisor of `length` that leaves six symbols or more, so that a window is a whole number of symbols."""
    return max(d for d in range(1, max(1, length // 6) + 1) if length % d == 0)


def _numbered(parts: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the runs that `parts`, set where neighbours part, leaves."""
    out = np.zeros(len(parts) + 1, "i4")
    np.cumsum(parts, out=out[1:])
    return out


def _order(key: np.ndarray) -> np.ndarray:
    """The stable order of numbers below 2^32."""
    both = key.astype("u8") << np.uint64(32)
    both |= np.arange(len(key), dtype="u8")
    both.sort()
    return (both & np.uint64(0xFFFFFFFF)).astype("i8")


class Transform:
    """The Burrows-Wheeler transform of one shard, with its suffixes sorted by their first `depth` symbols.

    symbol: of each suffix its first symbol, 0 for the empty suffix that ends a string; after: the suffix one symbol further on (an
    empty one stays where it is); before: the symbol in front of it, 0 where its string begins.
    """

    def __init__(self, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, depth: int):
        rank, reach, jump = symbol, 1, after
        while reach < depth:  # ranks by twice as many symbols
            key = rank.astype("u8") << np.uint64(32) | rank[jump].astype("u8")
            order = np.argsort(key)
            rank = np.empty_like(rank)
            rank[order] = _numbered(np.diff(key[order]) != 0)
            reach, jump = 2 * reach, jump[jump]
        self.suffixes = _order(rank)
        self.bwt = before[self.suffixes]


def interleave(shards: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each suffix in the merged order of all shards by `depth` symbols, and the number of its interval.

    Suffixes of one interval have their first `depth` symbols in common; where a round sets a new bound, the common prefix of the
    neighbours is that round's number.
    """
    bwt = np.concatenate([t.bwt for t in shards])
    shard = np.repeat(np.arange(len(shards), dtype="u1"), [len(t.bwt) for t in shards])
    interval = np.zeros(len(bwt), "i4")
    for _ in range(depth):
        merged = np.empty_like(bwt)
        merged[np.argsort(shard, kind="stable")] = bwt  # every shard's transform in its own order, at its places in the interleave
        source = _order(merged)  # a stable pass by symbol
        symbol, was = merged[source], interval[source]
        parts = np.diff(was) != 0
        parts &= symbol[1:] > 0
        parts |= np.diff(symbol) != 0
        shard, interval = shard[source], _numbered(parts)
    return shard, interval


def _strings(sizes: np.ndarray, starts: np.ndarray, shift: np.ndarray, residues: np.ndarray, step: int, least: int) -> tuple[np.ndarray, ...]:
    """The strings of `least` symbols or more whose symbols begin at places that leave one of the residues, by segment: segment, first position and number
    of symbols of each."""
    first = (residues[None, :] + shift[:, None]) % step
    count = (sizes[:, None] - first) // step
    segment, r = np.nonzero(count >= least)
    return segment, starts[segment] + first[segment, r], count[segment, r]


def _names(data: np.ndarray, position: np.ndarray, step: int) -> np.ndarray:
    """Hashes of the symbols at ascending positions, a slice of the data at a time."""
    out = np.empty(len(position), "u8")
    at = 0
    while at < len(position):
        to = int(np.searchsorted(position, position[at] + NAMED, "right"))
        a = int(position[at])
        own = position[at:to] - a
        out[at:to] = hashing.Ranges(data[a : int(own[-1]) + a + step]).of(own, own + step)
        at = to
    return out


def repeated_windows(segments: list[bytes], length: int, group: np.ndarray | None = None, offset: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment, which of its windows of `length` bytes start anywhere else in the segments too.

    group, offset: the anchor of each segment and its place there, if any; then windows are held against those of the same anchor alone.
    As equal windows lie at equal distances from it, symbols of different distance differ, and strings whose distances leave different
    residues never meet: beyond AT_ONCE bytes they are taken residue by residue, so memory does not grow with the group as a whole.
    """
    sizes = np.array([len(s) for s in segments], "i8")
    if not len(sizes):
        return []
    step = symbol_bytes(length)
    need = length // step
    data = np.frombuffer(b"".join(segments), "u1")
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(data), bool)
    shift = np.zeros(len(sizes), "i8") if offset is None else np.asarray(offset, "i8")
    passes = 1 if group is None else min(step, -(-len(data) // AT_ONCE) or 1)
    for residues in np.array_split(np.arange(step), passes):
        segment, begin, count = _strings(sizes, starts, shift, residues, step, need)
        if not len(count):
            continue
        string = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
        position = begin[string] + step * place
        order = np.argsort(position, kind="stable")
        name = np.empty(len(position), "u8")
        name[order] = _names(data, position[order], step)
        if group is not None:
            of = segment[string]
            away = (position - starts[of] - shift[of]).astype("u8")
            name ^= hashing.mix(np.asarray(group)[of].astype("u8") + away * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(name)
        symbol = np.empty(len(name), "u4")
        symbol[order] = _numbered(np.diff(name[order]) != 0) + 1
        # a window with a symbol that occurs once is not repeated; strings without any other window stay out
        good = np.bincount(symbol)[symbol] > 1
        windows = count[string] - place >= need
        for k in range(need):
            windows[: len(good) - k] &= good[k:]
        kept = np.bincount(string[windows], minlength=len(count)) > 0
        inside = kept[string]
        out[_repeated(symbol[inside], position[inside], count[kept], starts[segment[kept]] * SHARDS // max(1, len(data)), need)] = True
    return [out[a : a + max(0, s - length + 1)] for a, s in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _repeated(symbol: np.ndarray, position: np.ndarray, count: np.ndarray, share: np.ndarray, need: int) -> np.ndarray:
    """Positions at which `need` symbols begin that also begin elsewhere. symbol, position: of strings of `count` symbols each, one after the other; share: the
    shard of each string, ascending."""
    if not len(count):
        return position[:0]
    ends = np.cumsum(count)
    shards, positions, lefts = [], [], []
    for k in np.unique(share).tolist():
        own = np.flatnonzero(share == k)
        a, b = ends[own[0]] - count[own[0]], ends[own[-1]]
        n, last = b - a, ends[own] - a - 1
        after = np.arange(1, n + len(own) + 1)
        after[last] = after[n:] = n + np.arange(len(own))  # an empty suffix ends each string
        before = np.concatenate([[0], symbol[a : b - 1], symbol[ends[own] - 1]]).astype("u4")
        before[(ends[own] - count[own] - a)] = 0
        shards.append(Transform(np.concatenate([symbol[a:b], np.zeros(len(own), "u4")]), after, before, need))
        left = np.repeat(ends[own], count[own]) - np.arange(a, b)
        positions.append(np.concatenate([position[a:b], np.full(len(own), -1)])[shards[-1].suffixes])
        lefts.append(np.concatenate([left, np.zeros(len(own), "i8")])[shards[-1].suffixes])
    shard, interval = interleave(shards, need)
    order = np.argsort(shard, kind="stable")
    where, left = np.empty(len(shard), "i8"), np.empty(len(shard), "i8")
    where[order], left[order] = np.concatenate(positions), np.concatenate(lefts)
    whole = left >= need
    return where[whole][np.bincount(interval[whole])[interval[whole]] > 1]


def spans(windows: np.ndarray, length: int, shift: int = 0) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the windows that are set."""
    at = np.flatnonzero(windows)
    if not len(at):
        return []
    new = np.r_[True, at[1:] > at[:-1] + length]
    return list(zip((at[new] + shift).tolist(), (at[np.r_[new[1:], True]] + length + shift).tolist(), strict=True))


RUN = "key long, mark long, lo long, hi long, off long, anchor long, class long"


def find_repeats(slim: DataFrame, length: int) -> DataFrame:
    """key, mark, ranges (array of from, to): repeated bytes of each text of slim (key, mark, text), where there are any."""
    spark = slim.sparkSession

    def scan(batches):
        for batch in batches:
            at = 0
            for texts in units.slices(batch.column(2)):
                data, places = units.bytes_of(texts)
                for text, lo, hi, off, anchor, name in runs(data, places, length):
                    keys = [batch.column(c).take(pa.array(text + at)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(lo), pa.array(hi), pa.array(off), pa.array(anchor), pa.array(name)], names=["key", "mark", "lo", "hi", "off", "anchor", "class"])
                at += len(texts)

    found = written(slim.select("key", "mark", "text").mapInArrow(scan, RUN), "runs")
    # written first, so that the join below has plain exchanges on both sides and Spark can split a common anchor
    anchors = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("n > 1")
    anchors = written(anchors, "anchors")
    again = found.join(sorted_join(anchors.select("anchor", "n", (F.col("a") != F.col("b")).alias("mixed"))), "anchor")
    again = written(again, "repeated-runs")
    ranges = [F.col("lo").alias("from"), (F.col("hi") + length).alias("to")]
    whole = again.where("not mixed").select("key", "mark", *ranges)

    # rows and classes of a common anchor are dealt by parts as well, so that a hot class is many tasks
    parts = F.least(F.lit(PARTS), F.floor(F.col("n") / PART) + 1).cast("int")
    mixed = again.where("mixed").withColumn("parts", parts)
    classes = mixed.groupBy("anchor", "class").agg(F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts"), *(F.first(c).alias(c) for c in ("key", "mark", "lo", "hi", "off")))
    classes = written(classes, "classes")
    copies = classes.where("n > 1").select("anchor", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = mixed.withColumn("part", F.pmod(F.xxhash64("key", "mark", "lo"), F.col("parts")).cast("int"))
    whole = whole.union(rows.join(sorted_join(copies), ["anchor", "class", "part"]).select("key", "mark", *ranges))

    # anchors with a class that stands alone: their segments, from the texts
    tally = classes.groupBy("anchor").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).where("least = 1")
    wanted = classes.join(sorted_join(tally.select("anchor", "classes")), "anchor")
    by_text = wanted.groupBy("key", "mark").agg(F.collect_list(F.struct("lo", "hi", "off", "anchor", (F.col("n") == 1).alias("alone"), "classes")).alias("cuts"))

    def cut(batches):
        last = None
        for batch in batches:
            rows = []
            for key, mark, cuts, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (key, mark) == last:  # the join is sorted, so rows that repeat as a whole follow each other
                    continue
                last, data = (key, mark), text.encode()
                rows += [(key, mark, c["lo"], c["off"], c["anchor"], c["alone"], c["classes"], data[c["lo"] : c["hi"] + length]) for c in cuts]
                if sum(len(r[7]) for r in rows[-len(cuts) :]) > units.SLICE or len(rows) > 4000:
                    yield _table(rows)
                    rows = []
            if rows:
                yield _table(rows)

    segments = by_text.join(sorted_join(slim), ["key", "mark"]).select("key", "mark", "cuts", "text").mapInArrow(cut, "key long, mark long, lo long, off long, anchor long, alone boolean, classes long, bytes binary")
    segments = written(segments, "segments")
    volume = segments.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(2 * partitions(spark), volume // 2_000_000)

    def merge(table: pa.Table) -> pa.Table:
        data = table.column("bytes").to_pylist()
        marks = table.column("mark").to_pylist()
        out = []
        alone, keys, los = (table.column(c).to_pylist() for c in ("alone", "key", "lo"))
        anchor, off = (table.column(c).to_numpy() for c in ("anchor", "off"))
        seen: dict = {}
        for i, d in enumerate(data):  # a repeated row that a split of the join has parted gives its segment more than once
            seen.setdefault((anchor[i], d), i)
        first = np.array(sorted(seen.values()), "i8")
        for i, w in zip(first.tolist(), repeated_windows([data[i] for i in first.tolist()], length, anchor[first], off[first]), strict=True):
            if alone[i]:
                out += [(keys[i], marks[i], a, b) for a, b in spans(w, length, los[i])]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["key", "mark", "from", "to"])

    bucket = F.when(F.col("classes") > ALONE, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(buckets)))
    calm = segments.where(F.col("classes") <= TOGETHER).withColumn("bucket", bucket)
    solved = calm.groupBy("bucket").applyInArrow(merge, "key long, mark long, from long, to long")

    # an anchor with more segments than fit together: each window is a row, and rows with equal bytes are counted
    def explode(batches):
        for batch in batches:
            for key, mark, lo, anchor, data in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 7)), strict=True):
                d = np.frombuffer(data, "u1")
                n = len(d) - length + 1
                p = np.arange(n)
                h = [hashing.Ranges(d, s).of(p, p + length).astype("i8") for s in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x)) for x in (key, mark, anchor)), pa.array(p + lo), *map(pa.array, h)], names=["key", "mark", "anchor", "from", "h", "i"])

    rows = segments.where(F.col("classes") > TOGETHER).mapInArrow(explode, "key long, mark long, anchor long, from long, h long, i long")
    twice = rows.groupBy("anchor", "h", "i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    crowded = rows.join(sorted_join(twice), ["anchor", "h", "i"]).select("key", "mark", "from", (F.col("from") + length).alias("to"))
    return whole.union(solved).union(crowded).groupBy("key", "mark").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def _table(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "mark", "lo", "off", "anchor", "alone", "classes", "bytes"])


def merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges that touch or overlap become one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) for every row of docs (doc_id, text).

    Removed is each byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another; all
    is judged on the input, and strings never cross texts. A null text counts as empty, an empty table gives no rows, and a very long
    text is scanned in parts that overlap. Repeated rows are texts of their own, so
    they remove each other if they are long enough. Null doc_ids take part like any other. Other columns are ignored.
    kept may break a character of UTF-8, as bytes are removed.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-1))).withColumn("mark", F.xxhash64("text"))
    # rows that agree in doc_id and text count as often as they stand there, and share their ranges
    repeats = find_repeats(slim, length)

    def strip(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text, ranges in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                data, kept, at, gone = text.encode(), [], 0, merged([(r["from"], r["to"]) for r in ranges or []])
                for a, b in gone:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((doc_id, len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
                size += len(data)
                if size > units.SLICE:
                    yield _kept(rows)
                    rows, size = [], 0
            if rows:
                yield _kept(rows)

    return slim.join(sorted_join(repeats), ["key", "mark"], "left").select("doc_id", "text", "ranges").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _kept(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text is what stays, as UTF-8, with U+FFFD for what is left of a character that was cut."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
