"""Hits scored again by a model that reads query and text together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hits of a request that are scored again at most.
MOST = 50


def rerank(found: DataFrame, requests: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[float]]], most: int = MOST) -> DataFrame:
    """found (query_id, rank, content and others) with `rerank_score`, ranked by it: each request's top_k, ties to the rank before.

    make() loads the scorer, once for each task; it gets the queries and texts of an Arrow batch and gives a number for each pair. The first `most` hits of
    a request are scored; so many or more should have been searched for. A request's text joins its hits; texts are not moved twice.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for queries, texts in batches:
            scores = list(scorer(queries.tolist(), texts.tolist()))
            if len(scores) != len(texts):
                raise RuntimeError("the scorer gave another number of scores than pairs")
            yield pd.Series(scores, dtype="float64")

    asked = requests.select("query_id", F.col("query").alias("_query"), F.col("top_k").alias("_top_k"))
    pairs = found.where(F.col("rank") <= most).join(asked, "query_id")
    scored = pairs.withColumn("rerank_score", score(F.col("_query"), F.coalesce("content", F.lit(""))))
    best = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("_top_k")).drop("_query", "_top_k")
