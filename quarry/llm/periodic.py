"""Op 11. Periodic runs of words: Lyndon roots from a stack scanned right to left under both orders, extended by hashed common extensions.

A run that holds its period three times or more has, under one of the two orders of its words, its Lyndon roots as the longest Lyndon words that begin
at their places. So the next smaller suffix of every place gives all candidates. Suffixes are compared, and candidates extended, by binary
search over rolling hashes; the words themselves confirm every run. Every text is worked on by itself: nothing is shuffled.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, small_batches
from quarry.llm.units import release

#: Words of a run at least, and how often it holds its period at least.
LEAST, TIMES = 24, 3
#: Words of two suffixes that are compared one by one before hashes are asked.
DIRECT = 8
_PRIMES, _BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_103_515_245, 1_644_838_417)

RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, best struct<start:long,length:long,period:long>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.string())])


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, "u8")
    done = 1
    while done < n:
        step = pow(base, done, prime)
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done += more
    return out


class Extensions:
    """How far a sequence of words goes on alike from two places: hashes of all prefixes under two primes, and binary search."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.primes = [np.uint64(p) for p in _PRIMES]
        self.powers = [_powers(b, p, self.n + 1) for b, p in zip(_BASES, _PRIMES, strict=True)]
        self.sums = []
        for p, power in zip(self.primes, self.powers, strict=True):
            terms = (words.astype("u8") + np.uint64(1)) * power[:-1] % p  # under 2^31 each, so sums of 2^32 of them fit
            self.sums.append(np.concatenate([np.zeros(1, "u8"), np.cumsum(terms, dtype="u8") % p]))
        self._lists = None

    def equal(self, i: np.ndarray, j: np.ndarray, k: int | np.ndarray) -> np.ndarray:
        """Whether the k words from i and from j (i < j) have equal hashes."""
        same = np.ones(len(i), bool)
        for p, power, s in zip(self.primes, self.powers, self.sums, strict=True):
            same &= (s[i + k] + p - s[i]) % p * power[j - i] % p == (s[j + k] + p - s[j]) % p
        return same

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that follow alike from i and from j (i < j)."""
        k = np.zeros(len(i), "i8")
        for step in (1 << b for b in range(self.n.bit_length(), -1, -1)):
            at = np.flatnonzero(j + k + step <= self.n)
            at = at[self.equal(i[at] + k[at], j[at] + k[at], step)]
            k[at] += step
        return k

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of words that come alike before i and before j (i < j)."""
        k = np.zeros(len(i), "i8")
        for step in (1 << b for b in range(self.n.bit_length(), -1, -1)):
            at = np.flatnonzero(i - k - step >= 0)
            at = at[self.equal(i[at] - k[at] - step, j[at] - k[at] - step, step)]
            k[at] += step
        return k

    def common(self, i: int, j: int) -> int:
        """The same as `forward`, of one pair that is alike for DIRECT words, by doubling and then halving the step."""
        if self._lists is None:
            self._lists = [(p, x.tolist(), s.tolist()) for p, x, s in zip(_PRIMES, self.powers, self.sums, strict=True)]
        (p, x, s), (q, y, t) = self._lists
        k, step, grows = DIRECT, DIRECT, True
        while step:
            a, b = i + k, j + k
            c = b + step
            if c <= self.n and not ((s[a + step] - s[a]) * x[j - i] - s[c] + s[b]) % p and not ((t[a + step] - t[a]) * y[j - i] - t[c] + t[b]) % q:
                k += step
                step = step * 2 if grows else step // 2
            else:
                grows = False
                step //= 2
        return k


def next_smaller(words: list[int], extensions: Extensions) -> list[int]:
    """For each place, the next one whose suffix is smaller (the end of all, if none): the longest Lyndon word goes up to there.

    The places that the chain of `after` links are the stack. Of two suffixes that are alike to the end the shorter one is smaller.
    """
    n = len(words)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        a, j = words[i], i + 1
        while j < n:
            b = words[j]
            if a == b:
                k, most = 1, min(DIRECT, n - j)
                while k < most and words[i + k] == words[j + k]:
                    k += 1
                if k == DIRECT:
                    k = extensions.common(i, j)
                if j + k >= n or words[i + k] > words[j + k]:
                    break
            elif a > b:
                break
            j = after[j]
        after[i] = j
    return after


def _frequent(words: np.ndarray) -> list[np.ndarray]:
    """Stretches of places that can hold runs: every word of a run is in it TIMES times, so words that are rarer in their stretch cut it."""
    places = np.arange(len(words))
    while len(places):
        piece = np.cumsum(np.diff(places, prepend=places[0]) != 1)
        long = np.bincount(piece)[piece] >= LEAST
        places, piece = places[long], piece[long]
        _, code, count = np.unique(piece * (int(words.max()) + 1) + words[places], return_inverse=True, return_counts=True)
        often = count[code] >= TIMES
        if often.all():
            return np.split(places, np.flatnonzero(np.diff(places) != 1) + 1) if len(places) else []
        places = places[often]
    return []


def _exact(words: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """Start and end of the stretch around i that keeps period p, word by word."""
    differs = np.flatnonzero(words[:-p] != words[p:])
    at = int(np.searchsorted(differs, i))
    return int(differs[at - 1]) + 1 if at else 0, int(differs[at]) + p if at < len(differs) else len(words)


def _runs_of_piece(words: np.ndarray) -> set[tuple[int, int, int]]:
    extensions, found = Extensions(words), set()
    for sign in (1, -1):
        i = np.arange(len(words))
        p = np.array(next_smaller((sign * words).tolist(), extensions)) - i
        some = i + 2 * p <= len(words)  # the root comes twice from its place on
        i, p = i[some], p[some]
        some = (words[i] == words[i + p]) & (words[i + p - 1] == words[i + 2 * p - 1])
        i, p = i[some], p[some]
        some = extensions.equal(i, i + p, p)
        i, p = i[some], p[some]
        start, end = i - extensions.backward(i, i + p), i + p + extensions.forward(i, i + p)
        keep = end - start >= np.maximum(LEAST, TIMES * p)
        each, first = np.unique(np.stack([start[keep], end[keep], p[keep]]), axis=1, return_index=True)
        for (s, e, q), at in zip(each.T.tolist(), i[keep][first].tolist(), strict=True):
            if (words[s : e - q] != words[s + q : e]).any():  # hashes were alike and words are not
                s, e = _exact(words, at, q)
                if e - s < max(LEAST, TIMES * q):
                    continue
            found.add((s, e - s, q))
    return found


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start and period."""
    if len(words) < LEAST:
        return []
    return sorted((s + int(places[0]), n, q) for places in _frequent(words) for s, n, q in _runs_of_piece(np.unique(words[places], return_inverse=True)[1].astype("i8")))


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that holds its period most often, exactly; ties to the smaller start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places that no run holds after its first period."""
    steps = np.zeros(n + 1, "i8")
    for s, length, q in runs:
        steps[s + q] += 1
        steps[s + length] -= 1
    return np.flatnonzero(np.cumsum(steps[:n]) == 0)


def _of_text(text: str | None) -> tuple:
    words = (text or "").encode().split()  # of bytes: at the six signs of ASCII white space
    numbers: dict[bytes, int] = {}
    runs = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], "i8"))
    if runs:
        words = [words[i] for i in kept_words(len(words), runs).tolist()]
    return runs, best_of(runs), b" ".join(words).decode()


def _scan(batches):
    for batch in batches:
        rows = [_of_text(t.as_py()) for t in batch.column("text")]
        named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _, _ in rows]
        best = [dict(zip(("start", "length", "period"), b, strict=True)) if b else None for _, b, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(named, _SCHEMA.field("runs").type), pa.array(best, _RUN), pa.array([c for *_, c in rows], pa.string())], schema=_SCHEMA)
    release()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period), best (the run that holds its period most often), collapsed (the words
    that no run holds after its first period, joined by one space).

    A run is a stretch of words with smallest period q, of max(LEAST, TIMES * q) words at least, that no neighbouring word extends. A row for each row: a null
    or empty text, or one of few words, has no runs, a null best and its own words; repeated rows are rows of their own; an empty table gives
    no rows; other columns do not matter. Memory follows the longest text, time its length.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, RUNS)


def with_repeats(text: Column, doc_id: Column) -> Column:
    """Texts of the contract: where crc32(doc_id) is a multiple of 10, the words from one on repeat a stretch of words. Others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    chosen = F.when(h % 10 == 0, text)
    words = F.regexp_extract_all(chosen, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # as the one element of an array, so that the words are cut out once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return F.coalesce(changed, text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
