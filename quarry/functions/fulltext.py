"""Full-text primitives: lexemes, postings, the match of all lexemes, and cover-density rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a lexeme is a run of letters and digits, in lower case; no stop words, no stemming.
LEXEME = r"([\p{L}\p{N}]+)"


def lexemes(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(LEXEME), F.lit(1))


def postings(nodes: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """keys, lexeme, position (from 1). To be written sorted by lexeme where many queries follow."""
    return nodes.select(*keys, F.posexplode(lexemes(F.col(content))).alias("p", "lexeme")).select(*keys, "lexeme", (F.col("p") + 1).alias("position"))


def query_terms(requests: DataFrame) -> DataFrame:
    """query_id, document_id, lexeme, term (its number), n_terms: the distinct lexemes of each query. A query without any matches nothing."""
    words = requests.withColumn("_l", F.array_distinct(lexemes(F.col("query"))))
    return words.select("query_id", "document_id", F.posexplode("_l").alias("term", "lexeme"), F.size("_l").alias("n_terms"))


def cover_density(hits: Column, n_terms: Column) -> Column:
    """Rank of array<struct<position, term>> in order of position: 0.1 / (1 + noise) for each smallest interval that holds every term.

    noise counts the words between that are no terms. One pass: `last` keeps the newest hit of each term; a cover ends at a hit
    where the oldest of them has moved on.
    """
    start = F.struct(F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("from"), F.lit(0).alias("at"), F.lit(0.0).alias("rank"))

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda v, i: F.when(i == h["term"], s["at"]).otherwise(v))
        oldest = F.array_min(last)
        new = oldest > s["from"]
        noise = h["position"] - F.element_at(hits, F.greatest(oldest, F.lit(0)) + 1)["position"] - (s["at"] - oldest)
        more = F.when(new, F.lit(0.1).cast("double") / (1 + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), F.when(new, oldest).otherwise(s["from"]).alias("from"), (s["at"] + 1).alias("at"), (s["rank"] + more).alias("rank"))

    return F.aggregate(hits, start, step, lambda s: s["rank"])
