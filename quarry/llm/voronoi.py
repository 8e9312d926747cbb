"""Op 1. Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

Inner products become distances by one more component: data get sqrt(M - |s|^2), M the largest squared norm, queries get 0. Then
|q - s|^2 = |q|^2 + M - 2 q.s, and the nearest are those of highest score. Pivots cut the space into cells. For each cell a
summary keeps the range of distances to the pivot and its nearest rows. From the summaries alone follows, for the queries of a
cell, a distance within which k rows surely lie. A cell is of no use to them if the plane midway between the two pivots is farther than
that from each query; of the others a row can matter only if its distance to its own pivot lies in a certain range, by the triangle
inequality. Rows go, in packed blocks, to those groups of queries only, and each is solved locally with exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import written

#: Pivots at most, queries in a group unless that makes more than GROUPS groups. What the driver holds follows PIVOTS squared and PIVOTS times GROUPS.
PIVOTS, QUERIES, GROUPS = 512, 2048, 1024
#: Rows with a query's own id that the bounds allow for; a cell with a query that has more of them needs all rows, and the other cells keep their bounds.
REPEATS = 200


def integers(embedding: str = "embedding", scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a null, NaN or infinity."""
    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * scale)))


class Space:
    """Pivots and what assigns rows to their cells."""

    def __init__(self, pivots: list[list[int]], width: int, most: int):
        self.width, self.most = width, most
        p = padded(pivots, width).astype("f8")
        self.pivots = np.column_stack([p, np.sqrt(np.maximum(0.0, most - (p * p).sum(1)))])

    def squares(self, v: np.ndarray, data: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """v as floats, its last component, and the squared distances to all pivots."""
        v = v.astype("f8")
        norm = (v * v).sum(1)
        last = np.sqrt(np.maximum(0.0, self.most - norm)) if data else np.zeros(len(v))
        square = (norm + last * last)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * (v @ self.pivots[:, :-1].T + last[:, None] * self.pivots[None, :, -1])
        return v, last, square

    def cells(self, v: np.ndarray, data: bool) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each row, and the distance to it."""
        v, last, square = self.squares(v, data)
        cell = square.argmin(1)
        exact = np.sqrt(((v - self.pivots[cell, :-1]) ** 2).sum(1) + (last - self.pivots[cell, -1]) ** 2)
        return cell, exact

    def between(self) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((self.pivots[:, None, :] - self.pivots[None, :, :]) ** 2).sum(2)))


def padded(rows, width: int) -> np.ndarray:
    """Rows of integers as a matrix; components that a row lacks count as 0."""
    out = np.zeros((len(rows), width), "i8")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), width) if (sizes == width).all() else padded(column.to_pylist(), width)


class Bounds:
    """For each group of queries and each cell, between which distances to the cell's pivot a row may matter; nothing lies between inf and -inf."""

    def __init__(self, groups: int, pivots: int):
        self.low, self.high = np.full((groups, pivots), math.inf), np.full((groups, pivots), -math.inf)

    def widen(self, group: int, apart: np.ndarray, span: float, useful: np.ndarray) -> None:
        """For queries of a cell: apart, its distances to the pivots; span, the farthest that a needed row is from its pivot; useful, of which cells."""
        self.low[group, useful] = np.minimum(self.low[group], apart - span)[useful]
        self.high[group, useful] = np.maximum(self.high[group], apart + span)[useful]

    def needed(self, group: int, cell: np.ndarray, far: np.ndarray) -> np.ndarray:
        return np.flatnonzero((far >= self.low[group, cell]) & (far <= self.high[group, cell]))


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, "i8")
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = order[rank < k]
    return query[rank < k], ids[keep], scores[keep]


def solve(q_ids: np.ndarray, q: np.ndarray, blocks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, vec_id and score of the k best rows of the blocks for each query; a query's own id is no candidate."""
    best = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
    least = np.iinfo("i8").min
    low = np.full(len(q_ids), least)
    order = np.argsort(q_ids, kind="stable")
    largest = int(np.abs(q).max(initial=0))
    for ids, v in blocks:
        for at in range(0, len(ids), 1024):
            part, own = v[at : at + 1024], ids[at : at + 1024]
            exact = largest * int(np.abs(part).max(initial=0)) * max(1, q.shape[1]) < 1 << 52
            s = (q.astype("f8") @ part.T.astype("f8")).astype("i8") if exact else q @ part.T
            a, b = np.searchsorted(q_ids[order], own), np.searchsorted(q_ids[order], own, "right")
            for j in np.flatnonzero(b > a).tolist():
                s[order[a[j] : b[j]], j] = least
            keep = (s >= low[:, None]) & (s > least)
            if s.shape[1] > k:
                keep &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
            row, col = np.nonzero(keep)
            best = tuple(np.concatenate([x, y]) for x, y in zip(best, (row, own[col], s[row, col]), strict=True))
            best = _top(*best, k)
            count = np.bincount(best[0], minlength=len(q_ids))
            full = count == k
            ends = np.cumsum(count) - 1
            low[full] = best[2][ends[full]]
    return best


def midplanes(asked: DataFrame, space: Space) -> dict[int, np.ndarray]:
    """For each cell of queries and each pivot: the least of (distance to the plane midway to that pivot) - (distance to the own pivot) over its queries."""
    apart = space.between()

    def each(batches):
        for batch in batches:
            cell = batch.column(1).to_numpy()
            _, _, square = space.squares(matrix(batch.column(0), space.width), False)
            own = square[np.arange(len(cell)), cell][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart[cell] > 0, (square - own) / (2 * apart[cell]), 0.0)
            plane -= batch.column(2).to_numpy()[:, None]
            found = [(c, plane[cell == c].min(0).tobytes()) for c in np.unique(cell).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["q_cell", "least"])

    def least(table: pa.Table) -> pa.Table:
        both = np.min([np.frombuffer(x, "f8") for x in table.column("least").to_pylist()], 0)
        return pa.table({"q_cell": table.column("q_cell")[:1], "least": pa.array([both.tobytes()], pa.binary())})

    rows = asked.select("v", "q_cell", "q_far").mapInArrow(each, "q_cell long, least binary").groupBy("q_cell").applyInArrow(least, "q_cell long, least binary").collect()
    return {r.q_cell: np.frombuffer(bytes(r.least), "f8") for r in rows}


def plan(rows: DataFrame, is_query: Column, k: int = 20, pivots: int | None = None):
    """Rows in their cells, queries in theirs, and which rows each group of queries needs: None without queries, else (placed, asked, number of rows, width, bounds, parts).

    parts: of each cell with queries, its first group and the number of groups that share it.
    """
    spark = rows.sparkSession
    rows = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("is_query")).where("vec_id is not null and v is not null"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, width, most, queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0))).first()
    if not queries:
        return None
    pivots = pivots or max(1, min(PIVOTS, math.isqrt(n) // 2))
    chosen = rows.select("v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pivots).collect()
    space = Space([r.v for r in chosen], width, most)

    def assign(batches):
        for batch in batches:
            v = matrix(batch.column(1), space.width)
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            cell, far = space.cells(v, True)
            q_cell, q_far = np.zeros(len(v), "i8"), np.zeros(len(v))
            if asked.any():
                q_cell[asked], q_far[asked] = space.cells(v[asked], False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far), pa.array(q_cell), pa.array(q_far)], names=["vec_id", "v", "is_query", "cell", "far", "q_cell", "q_far"])

    placed = written(rows.mapInArrow(assign, "vec_id long, v array<long>, is_query boolean, cell long, far double, q_cell long, q_far double"), "cells")
    asked = placed.where("is_query").groupBy("vec_id", "v").agg(F.first("q_cell").alias("q_cell"), F.first("q_far").alias("q_far"))
    asked = written(asked.withColumn("query", F.xxhash64("vec_id", "v")), "queries")

    # summaries: of each cell its queries' reach, and the distances of its nearest rows: k, and as many as can have the query's own id
    ids = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"), F.max("is_query").alias("asked")).where("asked").select("vec_id", "own")
    repeats = asked.join(ids.where("own > 1"), "vec_id", "left").withColumn("own", F.coalesce("own", F.lit(1)))
    cells = repeats.groupBy("q_cell").agg(F.max("q_far").alias("reach"), F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).collect()
    reach, own = {r.q_cell: (r.reach, r.n) for r in cells}, {r.q_cell: r.own for r in cells}
    near_rows = k + min(max(own.values()), REPEATS)
    in_cell = Window.partitionBy("cell").orderBy("far")
    near = placed.select("cell", "far").withColumn("r", F.row_number().over(in_cell)).where(F.col("r") <= near_rows).groupBy("cell").agg(F.collect_list("far").alias("far")).collect()
    apart, planes = space.between(), midplanes(asked, space)
    within: dict[int, float] = {}  # a query's distance to its pivot and this: as far off are k rows of other ids at most
    for i in reach:
        upper = np.concatenate([apart[i, r.cell] + np.array(r.far) for r in near])
        due = k + own[i]
        within[i] = float(np.partition(upper, due - 1)[due - 1]) if len(upper) >= due and own[i] <= REPEATS else math.inf

    # groups: cells in order of nearness, cut into nearly equal numbers of queries; a cell with more is cut by hash
    each = max(QUERIES, -(-sum(count for _, count in reach.values()) // GROUPS))
    todo, chain = set(reach), []
    while todo:
        here = min(todo, key=lambda c: (apart[chain[-1], c], c)) if chain else min(todo)
        todo.remove(here)
        chain.append(here)
    groups: list[list[int]] = [[]]
    held, parts = 0, {}
    for c in chain:
        count = reach[c][1]
        if held and held + count > each:
            groups.append([])
            held = 0
        more = -(-count // each)
        parts[c] = (len(groups) - 1, more)
        groups[-1].append(c)
        groups += [[c] for _ in range(more - 1)]
        held = held + count if more == 1 else each
    bounds = Bounds(len(groups), len(space.pivots))
    slack = 1e-6 * (1 + math.sqrt(most))
    for g, cells in enumerate(groups):
        for c in cells:
            bounds.widen(g, apart[c], 2 * reach[c][0] + within[c] + slack, planes[c] <= within[c] + slack)
    return placed, asked, n, width, bounds, parts


def nearest(rows: DataFrame, is_query: Column, k: int = 20, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of highest inner product, ties to the smaller vec_id.

    rows: vec_id, v (array<long>). Rows with a null vec_id or v take no part. A query's candidates are all rows with another vec_id;
    all of them are returned if they are fewer than k. Repeated rows are candidates each; a query that is repeated is answered once, two
    different queries with one vec_id are answered each. Components that a shorter vector lacks count as 0. An empty table, or one
    without queries, gives no rows.
    """
    spark = rows.sparkSession
    planned = plan(rows, is_query, k, pivots)
    if planned is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed, asked, n, width, bounds, parts = planned
    groups, count = bounds.low.shape
    split = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups), -(-n // 50_000))
    first_of, more_of = (np.array([parts.get(c, (0, 1))[x] for c in range(count)]) for x in (0, 1))
    shared = spark.sparkContext.broadcast(bounds)  # GROUPS times PIVOTS pairs of numbers at most

    def deal(batches):
        bounds = shared.value
        for number, batch in enumerate(batches):
            v, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
            cell, far = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = []
            for g in range(groups):
                keep = bounds.needed(g, cell, far)
                for at in range(0, len(keep), 1024):
                    some = keep[at : at + 1024]
                    out.append((g, int((ids[some[0]] + number + at // 1024) % split), ids[some].astype("<i8").tobytes(), v[some].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["g", "part", "ids", "v"])

    blocks = placed.select("vec_id", "v", "cell", "far").mapInArrow(deal, "g long, part long, ids binary, v binary")

    def group(batches):
        for batch in batches:
            cell, query = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            g = first_of[cell] + (query % more_of[cell])
            v = matrix(batch.column(1), width).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), batch.column(3), pa.array([r.tobytes() for r in v], pa.binary())], names=["g", "vec_id", "query", "v"])

    grouped = asked.select("vec_id", "v", "q_cell", "query").mapInArrow(group, "g long, vec_id long, query long, v binary")
    grouped = grouped.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(split - 1)).cast("array<bigint>")))

    def local(q: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "score"]
        found = [[np.zeros(0, "i8")] for _ in names]
        if len(q) and len(data):
            ids, hashes = q.column("vec_id").to_numpy(), q.column("query").to_numpy()
            v = np.frombuffer(b"".join(q.column("v").to_pylist()), "<i8").reshape(len(ids), width)
            for at in range(0, len(ids), QUERIES):
                pairs = zip(data.column("ids"), data.column("v"), strict=True)
                blocks = ((i := np.frombuffer(a.as_py(), "<i8"), np.frombuffer(b.as_py(), "<i8").reshape(len(i), width)) for a, b in pairs)
                row, vec_id, score = solve(ids[at : at + QUERIES], v[at : at + QUERIES], blocks, k)
                for held, x in zip(found, (hashes[at:][row], ids[at:][row], vec_id, score), strict=True):
                    held.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in found], names=names)

    solved = grouped.groupBy("g", "part").cogroup(blocks.groupBy("g", "part")).applyInArrow(local, "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(embeddings.select("vec_id", integers().alias("v")), F.col("vec_id") % 20 == 0)


OP1_SQL = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS score
  FROM rows q JOIN rows d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM scored QUALIFY rank <= 20
"""
