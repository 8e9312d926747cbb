"""Settings of a session that hold for a while."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_their_job(spark: SparkSession):
    """Writes that are begun inside leave no shuffle files behind. Without it these stay until the driver's JVM collects what refers to them, so that the steps of
    a publication lie on the disks together."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
