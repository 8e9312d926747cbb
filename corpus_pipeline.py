"""The corpus pipeline: five stages over `documents`. Each stage's rows are written and read again as the next one's documents.

1. quality        documents that the factorisation machine rejects go
2. near_copies    of each group of near copies (word 5-grams, similarity 0.8 or more) the document of the smallest doc_id stays
3. personal_data  spans of personal data become <KIND>; n_chars follows
4. mix            sources come in their target shares: a document is there as often as its words are taken, rounded
5. tokens         byte-level BPE ids, and a digest of the bytes that they decode to

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and empty tables; what it does with each is said at
its operator. Columns beside doc_id, text, lang, source and n_chars go along up to the mix; the last stage returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, mixing, pii, quality
from quarry.llm.common import documents, free_name, written

SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null text counts as empty and is scored like any other; rows with equal doc_id are judged each by its own text."""
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "score_of_quality")
    return quality.scored(docs, machine, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words are near copies of nothing and all stay; of rows alike in doc_id and text one stays."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null text stays null, and its n_chars is null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The null source is a source; a row without words is in no mix."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null text has no ids; each row of the mix is a row."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(docs.select("doc_id", "lang", "source", "n_chars", "text"), *vocabulary)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("personal_data", redact_personal_data), ("mix", mix_sources), ("tokens", tokenise)]

#: The classifier, the similarity join and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
