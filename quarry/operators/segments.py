"""Full-text search by segments: delta-coded posting blocks with the best count of each, so that blocks that cannot matter stay closed.

A segment is some thousand nodes. Of each lexeme in it there is a block: how often it comes at most in a node, and, apart from that, where. The first
numbers of all blocks tell how far a segment can come for a query. The best segments are opened first; of the others only those that can still
reach the score of the last hit wanted.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fulltext
from quarry.operators.grid import ranked

#: Nodes of a segment, and of a document's neighbours that stay in one.
SEGMENT, NEIGHBOURS = 8192, 1024
#: Terms of requests up to which they are known to the driver, which then prunes the scan by them. Segments of a query that are opened first.
TERMS, FIRST = 4000, 4

#: Lexemes of a segment that leave its task at once.
AT_ONCE = 20_000
#: Segments of a task, as many as another one has, where there are enough of them for all cores.
OF_A_TASK = 8
#: Rounds in which the posting blocks of a store are made, so that no more than a share of its texts is exchanged at a time; segments for each core that make a round
#: worth its scan of the nodes.
ROUNDS, WORTH = 4, 4
#: Nodes that are looked at for bounds between files of posting blocks; keys of a file that are drawn from them, and of all files; hits of a file.
LOOKED_AT, DRAWN, DRAWN_IN_ALL, HITS = 16_384, 200, 1_000_000, 1 << 20

#: Files of posting blocks have small pages, so that the blocks of a lexeme are read without many others.
PAGES = {"parquet.page.row.count.limit": "2000"}

POSTINGS = "segment long, lexeme string, n int, best int, gaps array<int>, steps array<int>, nodes array<int>"
INDEXED = POSTINGS + ", n_nodes long, n_lexemes long, document_ids array<string>, node_ids array<string>, places array<int>, lengths array<int>"
BLOCKS = "segment long, lexeme string, n int, best int, gaps array<int>, steps array<int>, lengths array<int>, node_ids array<string>, document_ids array<string>, places array<int>"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
HIT = "query_id long, node_id string, document_id string, node_index int, score double, wanted int"


def numbered(nodes: DataFrame, name: str, n_nodes: int, dealt: bool = True) -> DataFrame:
    """nodes (node_id, document_id, node_index, content) with lexemes and segment, dealt by segment and in order inside it: a node's ordinal is its place there.
    name makes segments of batches differ. Texts move once; their lexemes are found behind the exchange. Not dealt, rows stay where they are; `segments` needs no more."""
    parts = max(1, -(-n_nodes // SEGMENT))
    tasks = min(parts, max(nodes.sparkSession.sparkContext.defaultParallelism, -(-parts // OF_A_TASK)))
    number = F.pmod(F.xxhash64("document_id", F.floor(F.col("node_index") / NEIGHBOURS)), F.lit(parts))
    rows = nodes.select("node_id", "document_id", F.col("node_index").cast("int").alias("node_index"), "content", F.xxhash64(F.lit(name), number).alias("segment"), F.xxhash64("content").alias("tie"), (number % tasks).cast("int").alias("task"))
    if dealt:
        rows = rows.repartitionById(tasks, "task").sortWithinPartitions("segment", "document_id", "node_index", "node_id", "tie")
    return rows.select("segment", "document_id", "node_index", "node_id", "tie", fulltext.lexemes(F.col("content")).alias("lexemes"))


def segments(rows: DataFrame) -> DataFrame:
    """What is known of each segment: segment, n_nodes, n_lexemes, and by ordinal document_ids, node_ids, places and lengths (in lexemes). rows: as of `numbered`."""
    length = F.size("lexemes").alias("length")
    held = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.size("lexemes")).cast("long").alias("n_lexemes"), F.sort_array(F.collect_list(F.struct("document_id", "node_index", "node_id", "tie", length))).alias("h"))
    named = {"document_ids": "document_id", "node_ids": "node_id", "places": "node_index", "lengths": "length"}
    return held.select("segment", "n_nodes", "n_lexemes", *(F.transform("h", _field(c)).alias(name) for name, c in named.items()))


def postings(rows: DataFrame) -> DataFrame:
    """The posting blocks of `numbered` rows, without names. gaps and steps have a number for each hit: ordinals less the one before, and positions less the one
    before in the same node; nodes are the ordinals, each once. A segment's words are sorted as numbers in its task, so no row is made for a hit."""
    return rows.select("segment", "lexemes").mapInArrow(_postings, POSTINGS)


def clustered(nodes: DataFrame, name: str, n_nodes: int) -> DataFrame:
    """`postings` and `segments` of nodes in one pass, clustered by lexeme and then segment: a row without lexeme holds what is known of its segment. To be written
    as it is, and taken apart by `parted`. An exchange by range would run its input twice, once to draw its bounds; these come from some of the nodes."""
    parts, bounds = _bounds(nodes, name, n_nodes)
    rows = numbered(nodes, name, n_nodes).select("segment", "lexemes", "document_id", "node_id", "node_index").mapInArrow(_indexed(parts, bounds), f"{INDEXED}, part int")
    return rows.repartitionById(parts, "part").sortWithinPartitions("lexeme", "segment").drop("part")


def rounds(n_nodes: int, cores: int) -> int:
    return min(ROUNDS, max(1, n_nodes // SEGMENT // (WORTH * cores)))


def by_segment(nodes: DataFrame, name: str, n_nodes: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """The same rows as `clustered` gives, where they are made: in order of lexeme and segment inside a task's segments. Texts move once and blocks, which take more
    room than texts, not at all; a reader passes over the pages of a task's file that lack its lexemes. PAGES is how a file is to be written. nodes, a third of
    a block's bytes, are left out: `parted` has them from gaps. Of several turns each takes other segments, and texts of others are left out before the exchange."""
    own = numbered(nodes, name, n_nodes).where(F.pmod("segment", F.lit(turns)) == turn)
    rows = own.select("segment", "lexemes", "document_id", "node_id", "node_index").mapInArrow(_indexed(1, []), f"{INDEXED}, part int")
    return rows.drop("part", "nodes").sortWithinPartitions("lexeme", "segment")


def _bounds(nodes: DataFrame, name: str, n_nodes: int) -> tuple[int, list[tuple[str, int]]]:
    """How many parts the blocks of nodes are dealt to, and the lexemes and segments where each but the first begins, so that parts have some HITS hits."""
    some = numbered(nodes.where(F.pmod(F.xxhash64("node_id"), F.lit(max(1, n_nodes // LOOKED_AT))) == 0), name, n_nodes, False).select("segment", "node_id", "lexemes")
    found, words = some.agg(F.count(F.lit(1)), F.sum(F.size("lexemes"))).first()
    parts = max(1, round((words or 0) / max(1, found) * n_nodes / HITS))
    if parts == 1:
        return 1, []
    each = some.select("segment", "node_id", F.posexplode("lexemes").alias("position", "lexeme"))
    one_in = max(1, words // min(DRAWN * parts, DRAWN_IN_ALL))
    drawn = sorted((r.lexeme, r.segment) for r in each.where(F.pmod(F.xxhash64("node_id", "position", "lexeme"), F.lit(one_in)) == 0).select("lexeme", "segment").collect())
    return parts, [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []


def parted(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as of `segments` and as of `postings` from those of `clustered`, and what else the table has."""
    rest = [c for c in table.columns if c not in [p.split()[0] for p in INDEXED.split(", ")]]
    table = table if "nodes" in table.columns else table.withColumn("nodes", F.arrow_udf(_ordinals, "array<int>")("gaps"))
    known = table.where("lexeme is null").select("segment", "n_nodes", "n_lexemes", "document_ids", "node_ids", "places", "lengths", *rest)
    return known, table.where("lexeme is not null").select(*(c.split()[0] for c in POSTINGS.split(", ")), *rest)


def _ordinals(gaps: pa.Array) -> pa.Array:
    """The ordinals of the nodes of blocks, each once."""
    ends = gaps.offsets.to_numpy() - gaps.offsets[0].as_py()
    sizes, flat = np.diff(ends), gaps.flatten().to_numpy()
    begins = ends[:-1][sizes > 0]
    new = flat > 0
    new[begins] = True
    sums = np.cumsum(flat, dtype="i8")
    sums -= np.repeat((sums - flat)[begins], sizes[sizes > 0])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(new))[ends].astype("i4")), pa.array(sums[new].astype("i4")))


def _grouped(batches):
    """Rows in order of segment to each segment and its parts of batches."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("segment").to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and own[a] != now:
                yield now, held
                held = []
            now = own[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def _postings(batches):
    """Rows in order of segment to a row for each of a segment's lexemes."""
    for segment, parts in _grouped(batches):
        yield from _segment(segment, [p.column("lexemes") for p in parts])


def _indexed(parts: int, bounds: list[tuple[str, int]]):
    """Rows in order of segment to its blocks and one row of what is known of it; rows of the latter kind are dealt to all parts."""
    schema = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in f"{INDEXED}, part int".split(", ")])

    def filled(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches):
        for segment, held in _grouped(batches):
            segment, lists = int(segment), [p.column("lexemes") for p in held]
            for found in _segment(segment, lists):
                part = pa.array([bisect_right(bounds, (w, segment)) for w in found.column("lexeme").to_pylist()] if bounds else np.zeros(found.num_rows, "i4"), pa.int32())
                yield filled(dict(zip(found.schema.names, found.columns, strict=True)) | {"part": part}, found.num_rows)
            lengths = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
            names = {n: pa.concat_arrays([p.column(c) for p in held]) for n, c in (("document_ids", "document_id"), ("node_ids", "node_id"), ("places", "node_index"))}
            whole = {n: pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), x) for n, x in (names | {"lengths": pa.array(lengths, pa.int32())}).items()}
            sums = {"segment": segment, "n_nodes": len(lengths), "n_lexemes": int(lengths.sum()), "part": segment % parts}
            yield filled({n: pa.array([x]) for n, x in sums.items()} | whole, 1)

    return run


def _segment(segment: int, parts: list[pa.ListArray]):
    lengths = np.concatenate([np.diff(p.offsets.to_numpy()) for p in parts])
    coded = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
    total = len(coded)
    if not total:
        return
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, ordinals = codes[order], np.repeat(np.arange(len(lengths), dtype="i4"), lengths)[order]
    positions = (np.arange(1, total + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype("i4")[order]
    word = np.append(True, codes[1:] != codes[:-1])
    node = word | np.append(True, ordinals[1:] != ordinals[:-1])
    gaps = np.where(word, ordinals, ordinals - np.append(0, ordinals[:-1])).astype("i4")
    steps = np.where(node, positions, positions - np.append(0, positions[:-1])).astype("i4")
    words, nodes = np.flatnonzero(word), np.flatnonzero(node)
    of_node = np.searchsorted(nodes, words)  # the first node of each word
    best = np.maximum.reduceat(np.diff(np.append(nodes, total)), of_node)
    hits, upto = np.append(words, total), np.append(of_node, len(nodes))
    for a in range(0, len(words), AT_ONCE):
        b = min(a + AT_ONCE, len(words))
        of = lambda values, ends: pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype("i4")), pa.array(values[ends[a] : ends[b]]))  # noqa: E731, B023
        columns = [pa.array(np.full(b - a, segment)), coded.dictionary.take(pa.array(codes[words[a:b]])), pa.array(np.diff(upto[a : b + 1]).astype("i4")), pa.array(best[a:b].astype("i4"))]
        yield pa.RecordBatch.from_arrays([*columns, of(gaps, hits), of(steps, hits), of(ordinals[nodes], upto)], names=[c.split()[0] for c in POSTINGS.split(", ")])


def named(table: DataFrame, known: DataFrame) -> DataFrame:
    """`postings` with lengths (in lexemes) and keys, one for each node: columns of BLOCKS, and what else table has. known: as of `segments`. Names lie once in a
    segment and not with each of its lexemes; what is asked of lexemes is asked of the postings before they meet."""
    names = ("lengths", "node_ids", "document_ids", "places")
    met = table.join(known.select("segment", *(F.col(c).alias(f"all_{c}") for c in names)), "segment")
    of_node = lambda c: F.transform("nodes", lambda o: F.get(F.col(f"all_{c}"), o)).alias(c)
    rest = [c for c in table.columns if c not in [p.split()[0] for p in POSTINGS.split(", ")]]
    return met.select("segment", "lexeme", "n", "best", "gaps", "steps", *(of_node(c) for c in names), *rest)


def blocks(rows: DataFrame) -> DataFrame:
    """The posting blocks of `numbered` rows, with names."""
    return named(postings(rows), segments(rows))


def _field(name: str):
    return lambda x: x[name]


def hits_of(gaps: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ordinals of the nodes of a block, where the hits of each begin (and the end of all), and the positions of all hits."""
    begins = np.flatnonzero(np.append(True, gaps[1:] > 0)) if len(gaps) else np.zeros(0, "i8")
    sums = np.cumsum(steps, dtype="i8")
    before = np.append(0, sums)[begins]
    ends = np.append(begins, len(gaps))
    return np.cumsum(gaps, dtype="i8")[begins], ends, sums - np.repeat(before, np.diff(ends))


def cover_density(hits: list[tuple[int, int]], n_terms: int) -> float:
    """0.1 / (1 + noise) for each smallest interval that holds every term; hits: (position, term) in order. noise: the words between that are no terms."""
    newest, begun, score = [-1] * n_terms, -1, 0.0
    for i, (position, term) in enumerate(hits):
        newest[term] = i
        oldest = min(newest)
        if oldest > begun:
            begun = oldest
            score += 0.1 / (1 + (position - hits[oldest][0]) - (i - oldest))
    return score


class Segment:
    """The blocks of a query's terms in one segment."""

    def __init__(self, parts: pa.StructArray, only: str | None, gone: set[str]):
        found = [{c: parts.field(c)[i].values for c in ("gaps", "steps", "lengths", "node_ids", "document_ids", "places")} for i in range(len(parts))]
        self.names = min(found, key=lambda p: len(p["node_ids"]))  # the rarest term's
        self.terms = [hits_of(p["gaps"].to_numpy(), p["steps"].to_numpy()) for p in found]
        common = self.terms[0][0]
        for ordinals, *_ in self.terms[1:]:
            common = np.intersect1d(common, ordinals, assume_unique=True)
        own = next(t for t, p in zip(self.terms, found, strict=True) if p is self.names)[0]
        self.at = np.searchsorted(own, common)  # of the common nodes in the names
        if only or gone:
            documents = np.array(self.names["document_ids"].take(pa.array(self.at)).to_pylist(), object)
            keep = np.array([d not in gone and (not only or d == only) for d in documents], bool)
            common, self.at = common[keep], self.at[keep]
        self.places = [np.searchsorted(ordinals, common) for ordinals, *_ in self.terms]
        self.counts = np.array([np.diff(ends)[p] for (_, ends, _), p in zip(self.terms, self.places, strict=True)]).reshape(len(self.terms), len(common))

    def covers(self, wanted: int | None) -> list[tuple[int, float]]:
        """Common nodes and their scores; of `wanted` best ones at least. A cover begins at a hit of its own, and a hit is in as many covers as there are
        terms at most, so the rarest term bounds the score; nodes are looked at by that bound, up to the first that cannot be among the best."""
        n = len(self.terms)
        if n == 1:
            return list(enumerate((0.1 * self.counts[0]).tolist()))
        bounds = bound(n, self.counts.min(0, initial=1 << 30))
        out, best = [], []
        for i in np.argsort(-bounds, kind="stable").tolist():
            if wanted and len(best) == wanted and bounds[i] < best[0]:
                break
            hits = sorted((p, t) for t, ((_, ends, positions), place) in enumerate(zip(self.terms, self.places, strict=True)) for p in positions[ends[place[i]] : ends[place[i] + 1]].tolist())
            out.append((i, cover_density(hits, n)))
            if wanted:
                (heapq.heappush if len(best) < wanted else heapq.heappushpop)(best, out[-1][1])
        return out

    def rows(self, scores: list[tuple[int, float]], wanted: int | None) -> list[tuple]:
        keys = [self.names[c].take(pa.array(self.at[[i for i, _ in scores]] if scores else [], pa.int64())).to_pylist() for c in ("node_ids", "document_ids", "places")]
        rows = [(n, d, p, s) for n, d, p, (_, s) in zip(*keys, scores, strict=True)]
        return sorted(rows, key=lambda r: (-r[3], r[1], r[2]))[:wanted] if wanted else rows


def bound(n_terms: int, least: np.ndarray) -> np.ndarray:
    """What a score can be at most where the rarest of the terms comes `least` times."""
    return 0.1 * (n_terms if n_terms > 1 else 1) * least


def _open(batches):
    """Opened segments of queries to their hits: the best `wanted` of each, or all."""
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            one = {c: batch.column(c)[i].as_py() for c in ("query_id", "only", "gone", "wanted")}
            segment = Segment(batch.column("parts")[i].values, one["only"], set(one["gone"] or ()))
            out += [(one["query_id"], *r, one["wanted"]) for r in segment.rows(segment.covers(one["wanted"]), one["wanted"])]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in HIT.split(", ")])


def _terms(requests: DataFrame, wanted) -> tuple[DataFrame, list[str] | None, int]:
    """query_id, only, lexeme, term, n_terms, wanted; the lexemes, if there are TERMS terms at most; the largest number wanted."""
    asked = requests.select(F.col("query_id").cast("long").alias("query_id"), "query", F.struct(F.nullif(F.col("document_id"), F.lit("")).alias("only"), wanted.cast("int").alias("wanted")).alias("document_id"))
    terms = fulltext.query_terms(asked).select("query_id", "document_id.*", "lexeme", "term", "n_terms")
    few = terms.limit(TERMS + 1).collect()
    if len(few) > TERMS:
        return terms, None, terms.agg(F.max("wanted")).first()[0] or 0
    known = requests.sparkSession.createDataFrame(few, "query_id long, only string, wanted int, lexeme string, term int, n_terms int")
    return known, sorted({r.lexeme for r in few}), max((r.wanted or 0 for r in few), default=0)


def _opened(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Hits of the segments that are asked for. asked: query_id, only, wanted, lexeme, term, n_terms and, if only some are to be opened, segment."""
    table = table if "gone" in table.columns else table.withColumn("gone", F.lit(None).cast("array<string>"))
    met = table.join(asked, ["lexeme", *(["segment"] if "segment" in asked.columns else [])])
    met = met.where(F.col("only").isNull() | F.array_contains("document_ids", F.col("only")))
    part = F.struct("term", "gaps", "steps", "lengths", "node_ids", "document_ids", "places")
    whole = met.groupBy("query_id", "segment", "only", "wanted", "n_terms").agg(F.sort_array(F.collect_list(part)).alias("parts"), F.first("gone").alias("gone"))
    return whole.where(F.size("parts") == F.col("n_terms")).select("query_id", "only", "wanted", "gone", "parts").mapInArrow(_open, HIT)


def fulltext_hits(table: DataFrame, requests: DataFrame) -> DataFrame:
    """query_id, node_id, document_id, node_index, score: every node that holds every lexeme of the query. table: as of `blocks`."""
    terms, lexemes, _ = _terms(requests, F.lit(None))
    if lexemes is not None:
        terms, table = F.broadcast(terms), table.where(F.col("lexeme").isin(lexemes))
    return _opened(terms, table).drop("wanted")


def heads(table: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, segment, bound, turn: segments that have all terms of a query, by how far they can come. Only the first numbers of blocks are read."""
    met = table.select("segment", "lexeme", "best").join(terms, "lexeme").groupBy("query_id", "segment", "n_terms").agg(F.count(F.lit(1)).alias("found"), F.min("best").alias("least"))
    own = met.where("found = n_terms").select("query_id", "segment", (0.1 * F.when(F.col("n_terms") > 1, F.col("n_terms")).otherwise(1) * F.col("least")).alias("bound"))
    return own.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "segment")))


def plan(table: DataFrame, requests: DataFrame, factor: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """Hits, and query_id, segments, opened: how many segments have all terms of a query, and how many of them were opened. Also the most hits wanted."""
    terms, lexemes, most = _terms(requests, F.col("top_k") * factor)
    if lexemes is not None:
        terms, table = F.broadcast(terms), table.where(F.col("lexeme").isin(lexemes))
    ahead = heads(table, terms)
    first = ahead.where(F.col("turn") <= FIRST).select("query_id", "segment")
    first = terms.join(first, "query_id")
    hits = _opened(F.broadcast(first) if lexemes is not None else first, table)  # FIRST rows for each of TERMS terms
    last = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    floor = hits.withColumn("place", F.row_number().over(last)).where("place = wanted").select("query_id", F.col("score").alias("floor"))
    rest = ahead.where(F.col("turn") > FIRST).join(floor, "query_id", "left").where("floor is null or bound >= floor - 1e-9")
    more = _opened(terms.join(rest.select("query_id", "segment"), "query_id"), table)
    opened = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("later"))
    told = ahead.groupBy("query_id").agg(F.count(F.lit(1)).alias("segments")).join(opened, "query_id", "left")
    told = told.select("query_id", "segments", (F.least("segments", F.lit(FIRST)) + F.coalesce("later", F.lit(0))).alias("opened"))
    return hits.unionByName(more), told, most


def fulltext_top_k(table: DataFrame, requests: DataFrame, factor: int = 1) -> DataFrame:
    """query_id, node_id, document_id, node_index, score, rank: the top_k * factor nodes of highest cover density for each request, exactly.

    A document filter applies to the bound of no segment, so it only keeps more of them open.
    """
    hits, _, most = plan(table, requests, factor)
    return ranked(hits, most)


# ---- BM25

#: How soon repeats of a term stop to count, and how far the length of a node counts.
K1, B = 1.2, 0.75


def _parts_of_bm25(batches):
    """A block of a query's term to what the term adds to the score of each of its nodes."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            one = {c: batch.column(c)[i].as_py() for c in ("query_id", "only", "gone", "wanted", "weight", "mean")}
            lists = {c: batch.column(c)[i].values for c in ("gaps", "lengths", "node_ids", "document_ids", "places")}
            gaps = lists["gaps"].to_numpy()
            times = np.diff(np.append(np.flatnonzero(np.append(True, gaps[1:] > 0)), len(gaps)))
            score = one["weight"] * times * (K1 + 1) / (times + K1 * (1 - B + B * lists["lengths"].to_numpy() / one["mean"]))
            gone = set(one["gone"] or ())
            keys = (lists[c].to_pylist() for c in ("node_ids", "document_ids", "places"))
            out += [(one["query_id"], n, d, p, s, one["wanted"]) for n, d, p, s in zip(*keys, score.tolist(), strict=True) if d not in gone and one["only"] in (None, d)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in HIT.split(", ")])


def bm25_top_k(table: DataFrame, totals: DataFrame, requests: DataFrame, factor: int = 1) -> DataFrame:
    """query_id, node_id, document_id, node_index, score, rank: the top_k * factor nodes of highest BM25 for each request; one word of the query is enough.

    table: as of `blocks`; totals: as of `segments`. Each batch of a store has its own numbers of nodes, lexemes and nodes of each lexeme; they are summed
    when they are read. Nodes of deleted documents are never hits, but count in these numbers until the store is compacted.
    """
    terms, lexemes, most = _terms(requests, F.col("top_k") * factor)
    if lexemes is not None:
        terms, table = F.broadcast(terms), table.where(F.col("lexeme").isin(lexemes))
    n, words = totals.agg(F.sum("n_nodes"), F.sum("n_lexemes")).first()
    n, mean = n or 0, (words or 0) / n if n else 1.0
    held = table.groupBy("lexeme").agg(F.sum("n").alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(held, "lexeme").select("query_id", "only", "wanted", "lexeme", weight.alias("weight"), F.lit(mean or 1.0).alias("mean"))
    table = table if "gone" in table.columns else table.withColumn("gone", F.lit(None).cast("array<string>"))
    met = table.join(F.broadcast(weighed) if lexemes is not None else weighed, "lexeme")  # as many rows as terms
    parts = met.select("query_id", "only", "gone", "wanted", "weight", "mean", "gaps", "lengths", "node_ids", "document_ids", "places").mapInArrow(_parts_of_bm25, HIT)
    whole = parts.groupBy("query_id", "node_id", "document_id", "node_index", "wanted").agg(F.sum("score").alias("score"))
    return ranked(whole, most)
