"""Op 2. Quality classifier: a factorisation machine over hashed words, structure and length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import hashing, units
from quarry.llm.common import documents, free_name, small_batches, text_of

#: Labelled rows that the model learns from at most: those with the smallest hash of doc_id.
TRAIN_ROWS = 6000
BUCKETS, FACTORS, EPOCHS = 512, 8, 160
THRESHOLD = 0.3
#: Steps into which every structure statistic is cut, besides its own value.
STEPS = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
STATISTICS = ("symbols", "bars", "exclaims", "upper", "digits", "outside_ascii", "repeated_neighbours", "distinct", "short_words", "long_words", "lines", "length")
WIDTH = BUCKETS + len(STATISTICS) * (1 + len(STEPS))

_BYTE = np.zeros((7, 256), "f4")
_BYTE[0, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()|-"]] = 1
_BYTE[1, ord("|")] = 1
_BYTE[2, ord("!")] = 1
_BYTE[3, 65:91] = 1
_BYTE[4, 48:58] = 1
_BYTE[5, 128:] = 1
_BYTE[6, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of WIDTH values for each text: word counts in hash buckets, damped and brought to unit length, and structure statistics."""
    data, at = units.bytes_of(texts)
    n = len(texts)
    word, upto = hashing.words(data, at)
    first = np.concatenate([[0], upto[:-1]]).astype("i8")
    n_words = upto - first
    of = np.repeat(np.arange(n), n_words)
    bag = np.bincount(of * BUCKETS + (word % np.uint64(BUCKETS)).astype("i8"), minlength=n * BUCKETS).reshape(n, BUCKETS).astype("f4")
    bag = np.log1p(bag)
    bag /= np.maximum(1e-6, np.sqrt((bag * bag).sum(1)))[:, None]

    def each(values: np.ndarray) -> np.ndarray:  # sums over the bytes of each text
        sums = np.concatenate([[0.0], np.cumsum(values, dtype="f8")])
        return sums[at[1:]] - sums[at[:-1]]

    size, letters, words = np.maximum(1, np.diff(at)), np.maximum(1, each(_BYTE[6][data])), np.maximum(1, n_words)
    same = np.zeros(len(word))
    same[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    pairs = _distinct(of, word) if len(word) else of
    distinct = np.bincount(pairs, minlength=n)
    visible = ~hashing.SPACE[data]
    mean_length = each(visible.astype("f4")) / words
    stats = [
        each(_BYTE[0][data]) / size,
        each(_BYTE[1][data]) / words,
        each(_BYTE[2][data]) / words,
        each(_BYTE[3][data]) / letters,
        each(_BYTE[4][data]) / size,
        each(_BYTE[5][data]) / size,
        np.bincount(of, same, minlength=n) / words,
        distinct / words,
        np.clip((5 - mean_length) / 5, 0, 1),
        np.clip((mean_length - 5) / 20, 0, 1),
        np.clip(each(data == 10) / words * 5, 0, 1),
        np.clip(np.log1p(n_words) / 12, 0, 1),
    ]
    s = np.clip(np.stack(stats, 1), 0, 1).astype("f4")
    steps = (s[:, :, None] >= STEPS[None, None, :]).astype("f4").reshape(n, -1) * np.float32(0.5)
    return np.concatenate([bag, s, steps], 1)


def _distinct(of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, word)."""
    h = np.sort(hashing.mix(word ^ hashing.mix(of.astype("u8") + np.uint64(1))) >> np.uint64(24) | of.astype("u8") << np.uint64(40))
    return (h[np.r_[True, h[1:] != h[:-1]]] >> np.uint64(40)).astype("i8")


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + sum over factors of ((v.x)^2 - v^2.x^2) / 2): all pairs in time linear in the features."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.w + 0.5 * (((x @ self.v) ** 2).sum(1) - (x * x) @ (self.v * self.v).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype("f8"), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Machine:
    """Logistic loss with weight decay, by Adam on all rows. With no rows the score is 0.5; with one label only it leans that way."""
    rng = np.random.default_rng(seed)
    known = len(y) > 0
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH, "f4"), rng.normal(0, 0.01, (WIDTH, FACTORS)).astype("f4") if known else np.zeros((WIDTH, FACTORS), "f4"))
    if not known or y.min() == y.max():
        m.v[:] = 0
        return m
    xx = x * x
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (np.zeros(1, "f4"), m.w, m.v)]
    for step in range(1, EPOCHS + 1):
        inner = x @ m.v
        raw = m.bias + x @ m.w + 0.5 * ((inner**2).sum(1) - xx @ (m.v * m.v).sum(1))
        miss = ((1 / (1 + np.exp(-np.clip(raw, -30, 30)))) - y).astype("f4") / len(y)
        slopes = [np.array([miss.sum()]), x.T @ miss + 1e-4 * m.w, x.T @ (inner * miss[:, None]) - m.v * (xx.T @ miss)[:, None] + 1e-4 * m.v]
        rate, moves = 0.05 / (1 + step / 80), []
        for k, slope in enumerate(slopes):
            a, b = moments[k]
            a += 0.1 * (slope - a)
            b += 0.001 * (slope * slope - b)
            moves.append(rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        m.bias, m.w, m.v = m.bias - float(moves[0][0]), m.w - moves[1], m.v - moves[2]
    return m


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Learns from at most `rows` labelled documents that are not held out. Only their features come to the driver.

    Labels other than 0 and 1 and ids that are null are passed over; an id with both labels counts as 0. Of rows that share an id the least
    text counts, so never more than `rows` feature rows reach the driver. Without labels every score is 0.5.
    """
    small_batches(docs.sparkSession)
    chosen = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # `rows` ids
    picked = picked.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")

    def run(batches):
        for batch in batches:
            at = 0
            for texts in units.slices(batch.column(1), 400_000):
                x = features(texts).astype("<f2")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).cast(pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "x"])
                at += len(texts)

    found = picked.mapInArrow(run, "quality long, x binary").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in found), "<f2").reshape(len(found), WIDTH).astype("f4")
    y = np.array([r.quality for r in found], "f4")
    order = np.lexsort((x[:, BUCKETS:].sum(1), y))  # the same model whatever the order of the rows
    return train(x[order], y[order])


def scored(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 for each row, from its whole text alone; a null text counts as empty. Nothing is shuffled.

    Very long texts are scored whole, repeated rows each, and an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != name]
    schema = docs.select(*others).schema.add(name, "double")
    rows = docs.select(*others, text_of().alias(free_name(docs.columns, "text_to_score")))  # the last column; `text` itself goes along unchanged

    def run(batches):
        for batch in batches:
            at = 0
            for texts in units.slices(batch.column(batch.num_columns - 1), 400_000):
                score = machine.score(features(texts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in range(len(others))), pa.array(score)], names=schema.names)
                at += len(texts)
        units.release()

    return rows.mapInArrow(run, schema)


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    machine = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, machine)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
