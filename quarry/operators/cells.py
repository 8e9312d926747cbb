"""Vector search by inverted lists of cells: vectors lie in the cell of their nearest centre, and a request opens the cells that are nearest to it.

The centres are fitted on a bounded sample; every vector is indexed. How many cells a request opens follows from a recall that is asked for, measured on a
bounded number of vectors against the exact search. The exact search stays: `grid.top_k`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import embedding as E
from quarry.operators import grid, settings

#: Vectors that centres are fitted on at most; vectors that the number of opened cells is measured with; cells at most; rounds of fitting.
SAMPLE, PROBES, MOST_CELLS, ROUNDS = 20_000, 200, 4096, 10
#: Hits of each vector that is measured with.
MEASURED_HITS = 20
#: Numbers of a task's matrices at once.
NUMBERS = 2 << 20


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of length 1 of `cells` groups of a sample of unit vectors, by the inner product; groups that run empty begin again at the rows that are worst served."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        score = sample @ centres.T
        near = score.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(score.max(1), kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def _nearest(centres: np.ndarray, many: int):
    """A function from Arrow batches with `unit`, or embedding, to the same rows, once for each of the `many` nearest cells (as `cell`). A vector without
    direction, or of another width, is in cell 0, and opens it alone."""

    def run(batches):
        for batch in batches:
            step = max(1, NUMBERS // max(len(centres), many * centres.shape[1]))
            for a in range(0, batch.num_rows, step):
                yield dealt(batch.slice(a, step))

    def dealt(batch):
        column = batch.column("unit" if "unit" in batch.schema.names else "embedding")
        sizes = np.diff(column.offsets.to_numpy())
        good = np.flatnonzero(sizes == centres.shape[1])
        begins = np.cumsum(sizes) - sizes
        units = column.flatten().to_numpy(zero_copy_only=False)[begins[good][:, None] + np.arange(centres.shape[1])]
        finite = np.isfinite(units).all(1)
        good, units = good[finite], units[finite]
        if units.dtype != "f8":
            units = units.astype("f8")
            norm = np.sqrt((units * units).sum(1, keepdims=True))
            good, units = good[norm[:, 0] > 0], units[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
        score = units @ centres.T
        if many == 1:
            best = score.argmax(1)[:, None]
        else:
            best = np.argsort(-score, axis=1, kind="stable")[:, :many]
        rest = np.setdiff1d(np.arange(batch.num_rows), good)
        rows = np.append(np.repeat(good, best.shape[1]), rest)
        cell = np.append(best.ravel(), np.zeros(len(rest), "i8"))
        taken = [batch.column(c).take(pa.array(rows)) for c in batch.schema.names]
        return pa.RecordBatch.from_arrays([*taken, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _dealt(rows: DataFrame, centres: np.ndarray, many: int = 1) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_nearest(centres, many), f"{fields}, cell int")


@dataclass(frozen=True)
class Index:
    """packs: read from a folder that is partitioned by cell; opens: cells that a request opens."""

    packs: DataFrame
    centres: np.ndarray
    opens: int

    def top_k(self, requests: DataFrame, factor: int = 1) -> DataFrame:
        """As `grid.top_k`, over the opened cells. Only the folders of cells that some request opens are read; a cell's packs meet its requests by the cell."""
        size = grid.Size.of(requests, factor)
        spark = self.packs.sparkSession
        if not size.requests:
            return spark.createDataFrame([], f"{grid.HIT}, rank int").drop("wanted")
        asked = _dealt(grid.asked_of(requests, factor), self.centres, self.opens)
        opened = sorted(r.cell for r in asked.select("cell").distinct().collect())  # MOST_CELLS at most
        few = 8 * size.numbers * self.opens <= grid.AT_ONCE
        packs = grid.asked_packs(asked.coalesce(1) if few else asked.repartition("cell"), "cell")
        hits = grid.scored(self.packs.where(F.col("cell").isin(opened)), F.broadcast(packs) if few else packs, ["cell"])
        return grid.ranked(hits, size.most, F.isnan("score"))


def _some(vectors: DataFrame, n: int, count: int) -> DataFrame:
    """About `count` of n vectors, and never more than twice as many, by the hash of their key."""
    chance = max(1, n // count)
    return vectors.where(F.pmod(F.xxhash64("node_id"), F.lit(chance)) == 0).orderBy(F.xxhash64("node_id"), "node_id").limit(2 * count)


def build(vectors: DataFrame, path: str, recall: float = 0.95, cells: int | None = None) -> Index:
    """Writes vectors (rows of node_id, document_id, node_index, and unit or embedding) as packs by cell under path/packs, the centres under path/centres, and gives
    the index. Embeddings stay as small as they are.

    Every vector is indexed. Centres are fitted on 2 * SAMPLE vectors at most, on the driver. 2 * PROBES vectors at most are searched exactly; a request
    opens as many cells as hold `recall` of their MEASURED_HITS best hits. Cells are split over tasks, so a hot one is no single task.
    """
    spark, raw = vectors.sparkSession, "embedding" in vectors.columns
    own = "embedding" if raw else "unit"
    n, width = vectors.agg(F.count(F.lit(1)), F.mode(F.size(own))).first()
    if not n:
        raise ValueError("there is no vector to index")
    usable = vectors.where((F.size(own) == width) & ~F.exists(own, lambda x: F.isnan(x)))
    if raw:
        usable = usable.where(F.exists("embedding", lambda x: x != 0)).withColumn("unit", E.unit(F.col("embedding")))
    sample = np.array([r.unit for r in _some(usable, n, SAMPLE).select("unit").collect()], "f8").reshape(-1, width)
    count = min(cells or int(np.sqrt(n)) + 1, MOST_CELLS, max(1, len(sample)))
    centres = fit(sample, count) if len(sample) else np.zeros((1, width))
    dealt = _dealt(vectors, centres).repartitionByRange("cell", "document_id", "node_id")
    packs = grid.packed(dealt.sortWithinPartitions("cell", "document_id", "node_index"), "cell", True)
    with settings.shuffles_end_with_their_job(spark):
        packs.write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/packs")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    held = spark.read.parquet(f"{path}/packs")
    # how near, in order of cells, are the cells of the best hits of some vectors?
    probes = _some(usable, n, PROBES).select(F.xxhash64("node_id").alias("query_id"), F.col("unit").alias("vector"), F.lit(MEASURED_HITS).alias("top_k"), F.lit(None).cast("string").alias("document_id"))
    found = grid.top_k(held.drop("cell"), probes)
    places = held.select(F.explode(F.arrays_zip("node_ids", "document_ids", "places")).alias("n"), "cell").select("n.*", "cell")
    hits = found.join(places, (F.col("node_id") == F.col("node_ids")) & (F.col("document_id") == F.col("document_ids")) & (F.col("node_index") == F.col("places")))
    met = hits.select("query_id", "cell").join(probes.select("query_id", "vector"), "query_id").collect()  # 2 * PROBES * MEASURED_HITS at most
    order = [int((np.asarray(r.vector) @ centres.T > np.asarray(r.vector) @ centres[r.cell]).sum()) for r in met]
    opens = int(np.quantile(order, recall, method="higher")) + 1 if order else count
    spark.createDataFrame([(opens,)], "opens int").coalesce(1).write.parquet(f"{path}/opens")
    return load(spark, path)


def load(spark, path: str) -> Index:
    """The index that `build` has written."""
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()], "f8")  # MOST_CELLS at most
    return Index(spark.read.parquet(f"{path}/packs"), centres, spark.read.parquet(f"{path}/opens").first().opens)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_queries, n_hits, recall: the share of the exact hits (query_id, node_id) that were found."""
    both = exact.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("met")), ["query_id", "node_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_hits"), (F.count("met") / F.count(F.lit(1))).alias("recall"))
