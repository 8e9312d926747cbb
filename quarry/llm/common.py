"""Shared pieces of the training-data operators: working folder, written tables, ordered buckets, byte tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where that is unset (local tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if "dir" not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="quarry-")
    return _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when this process ends in the usual way."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has already gone
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors, and is read with column pruning.

    The exchanges behind df serve this write alone, so Spark is told to drop their files when it ends.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once for each row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def free_name(taken: list[str], name: str) -> str:
    """name, or, if it is taken, one like it that is not."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"{name}_"
    return name


#: Elements of an array that are worked through one after the other; more are taken block by block.
_BLOCK = 256


def before(values: Column, op: Callable[[Column, Column], Column], first: int) -> Column:
    """For each of the values, op over all values before it, beginning with `first`. An array grows by being copied, so that is done in blocks of _BLOCK
    values and over the blocks: for n values the work is n * (_BLOCK + n / _BLOCK^2) and not n^2."""

    def scan(v: Column, start: Column) -> Column:
        none = F.struct(start.alias("at"), F.array().cast("array<int>").alias("seen"))
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["seen"], F.array(s["at"])).alias("seen"))
        return F.aggregate(v, none, step, lambda s: s["seen"])

    def of_blocks(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(first), lambda s, x: op(s, x))), F.lit(first))
        return F.flatten(F.zip_with(blocks, starts, scan))

    def cut(v: Column) -> Column:
        n = F.ceil(F.size(v) / _BLOCK).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.slice(v, k * _BLOCK + 1, F.lit(_BLOCK)))

    return let(values, lambda v: let(cut(v), of_blocks))


def id_bounds(ids: DataFrame, buckets: int, per_bucket: int = 24) -> list[int]:
    """Ascending ids that begin buckets of nearly equal row counts; the first is the smallest id. ids: one column, `id`.

    The bounds come from a hash sample of about buckets * per_bucket ids, so what the driver holds follows the number of
    buckets and not the rows. They decide only the balance, never the result. Every bound is an id of the table.
    """
    n, least = ids.agg(F.count("id"), F.min("id")).first()
    if not n:
        return []
    step = max(1, n // (buckets * per_bucket))
    sample = ids.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(step)) == 0)).distinct()
    known = sorted({r.id for r in sample.collect()})
    return sorted({least, *(known[i * len(known) // buckets] for i in range(1, buckets) if known)})


def bucket_of(bounds: list[int], id_col: Column) -> Column:
    """Index of the last bound that is not above the id; null ids come first, in bucket 0."""
    if len(bounds) < 2:
        return F.lit(0)
    held = F.array(*(F.lit(b).cast("long") for b in bounds[1:]))
    return F.coalesce(F.size(F.filter(held, lambda b: b <= id_col)), F.lit(0)).cast("int")


def small_batches(spark: SparkSession) -> None:
    """Batches of text go to Python in small parts: memory of a worker then follows the longest text and not the number of rows.
    A session that asks for still smaller batches keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, min(1024, int(spark.conf.get(key)) or 1024))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def sorted_join(df: DataFrame) -> DataFrame:
    """df, to be joined by a sort-merge join at every size: its sides grow with the corpus, and skewed keys of it can be split."""
    return df.hint("merge")
