"""How good hits are, by the relevance of documents that is known: recall, nDCG and context precision of each request, and means with their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Resamples of the requests for the intervals, and the share of them that an interval holds.
RESAMPLES, SHARE = 200, 0.95
METRICS = ("recall", "ndcg", "context_precision")


def per_request(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, ndcg, context_precision of the first k hits of each request that has something relevant; without hits all are 0.

    hits: query_id, item, rank (from 1); relevant: query_id, item, grade (above 0). recall: share of the relevant items that are hits. ndcg: grades
    over log2(1 + rank), against the best order. context_precision: mean, over the relevant hits, of the share of relevant ones up to there.
    Hits and relevance meet by request and item; a request's relevant items are ranked by a window, and only its first k are summed.
    """
    first = hits.where(F.col("rank") <= k).select("query_id", "item", "rank")
    met = first.join(relevant.where("grade > 0"), ["query_id", "item"])
    upto = Window.partitionBy("query_id").orderBy("rank")
    met = met.withColumn("good", F.row_number().over(upto))
    gain = lambda grade, rank: grade / F.log2(F.lit(1.0) + rank)
    own = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("gain"), F.avg(F.col("good") / F.col("rank")).alias("context_precision"))
    best = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item")
    ideal = relevant.where("grade > 0").withColumn("place", F.row_number().over(best))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("due"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("best"))
    out = ideal.join(own, "query_id", "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query_id", none(F.col("found") / F.col("due")).alias("recall"), none(F.col("gain") / F.col("best")).alias("ndcg"), none(F.col("context_precision")).alias("context_precision"))


def times_drawn(query_id: Column, resample: Column) -> Column:
    """How often a request is drawn in a resample, a Poisson number of mean 1 that follows from a hash, so that every run draws alike."""
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", query_id.cast("string"), resample.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, upto, part = F.lit(8), 0.0, 0.36787944117144233
    below = []
    for n in range(8):
        upto += part
        below.append((upto, n))
        part /= n + 1
    for limit, n in reversed(below):
        out = F.when(chance < limit, F.lit(n)).otherwise(out)
    return out


def summary(scores: DataFrame, resamples: int = RESAMPLES, share: float = SHARE) -> DataFrame:
    """metric, n_queries, mean, low, high: means over the requests and the bounds between which the `share` middle ones of the resampled means lie.

    A resample weighs each request by itself, so all are one aggregation and no request is drawn on the driver.
    """
    each = scores.select("query_id", F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))).alias("metric", "value"))
    means = each.groupBy("metric").agg(F.count(F.lit(1)).alias("n_queries"), F.avg("value").alias("mean"))
    drawn = each.withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("times", times_drawn(F.col("query_id"), F.col("resample")))
    held = drawn.groupBy("metric", "resample").agg(F.try_divide(F.sum(F.col("value") * F.col("times")), F.sum("times")).alias("value")).where("value is not null")
    edge = (1 - share) / 2
    bounds = held.groupBy("metric").agg(F.percentile("value", F.lit(edge)).alias("low"), F.percentile("value", F.lit(1 - edge)).alias("high"))
    return means.join(bounds, "metric").select("metric", "n_queries", "mean", "low", "high")
