"""Vectors by the content they are of: equal texts are sent to a provider once, across nodes, batches and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.log import Log

#: Rows of texts that hold over a thousandth of all nodes are dealt over SALTS parts; there are fewer than HOT such texts.
SALTS, HOT = 32, 1000


class VectorCache:
    """A table of digest and embedding for one model, under one path. What a batch adds counts when its entry is in the log, so a failed batch leaves
    nothing; of two batches that send the same text at once both vectors are kept and one is read."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self.log = Log(spark, f"{self.path}/log")

    def vectors(self) -> DataFrame:
        attempts = [e["attempt_id"] for e in self.log.entries().values() if e["model"] == self.model]
        if not attempts:
            return self.spark.createDataFrame([], "digest string, embedding array<float>")
        rows = self.spark.read.parquet(f"{self.path}/vectors").where(F.col("attempt_id").isin(attempts))
        return rows.select("digest", "embedding").dropDuplicates(["digest"])

    def embed(self, nodes: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
        """nodes (with content) with `embedding`; null where the content is blank. Only texts that no committed batch has a vector of are given to `embed`,
        each once; their vectors are committed before the nodes are read."""
        some = F.regexp_replace(F.coalesce("content", F.lit("")), r"(?U)\s+", "") != ""
        keyed = nodes.withColumn("digest", F.when(some, F.sha2("content", 256)))
        texts = keyed.where("digest is not null").groupBy("digest").agg(F.any_value("content").alias("content"), F.count(F.lit(1)).alias("n"))
        attempt = uuid.uuid4().hex
        new = texts.join(self.vectors(), "digest", "left_anti").select("digest", embed(F.col("content")).cast("array<float>").alias("embedding"))
        new.withColumn("attempt_id", F.lit(attempt)).write.mode("append").partitionBy("attempt_id").parquet(f"{self.path}/vectors")
        self.log.append(lambda _: {"attempt_id": attempt, "model": self.model})
        total = nodes.count()
        common = [r.digest for r in texts.where(F.col("n") * HOT > total).select("digest").collect()]  # fewer than HOT
        hot = F.col("digest").isin(common)
        parts = F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        known = self.vectors().withColumn("salt", parts)
        dealt = keyed.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("node_id"), F.lit(SALTS)).cast("int")).otherwise(0))
        return dealt.join(known, ["digest", "salt"], "left").drop("digest", "salt")
