"""Op 11 against a plain search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import periodic

ODD = "doc_id long, text string, runs string, best int, collapsed string, words int"


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and not any(w[s : e - k] == w[s + k : e] for k in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out)


def plain_row(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def told(rows) -> list[tuple]:
    return [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_words_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(80):
        k, w = rng.choice([1, 2, 3, 5]), []
        while len(w) < rng.randint(0, 140):
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
            w += (unit * 12)[: rng.randint(1, 8 * len(unit))] if rng.random() < 0.6 else unit
        assert periodic.runs_of(np.array(w, "i8")) == plain_runs(w)


def test_runs_that_hashes_take_for_longer_are_cut_by_the_words(monkeypatch):
    """With hashes that see nothing, only runs whose words agree are left."""
    monkeypatch.setattr(periodic.Extensions, "equal", lambda self, i, j, k: np.ones(len(i), bool))
    w = [9, 8, *[1, 2, 3] * 9, 7, 7, *[1] * 30]
    assert set(periodic.runs_of(np.array(w, "i8"))) <= set(plain_runs(w))


def test_one_word_many_times_and_words_of_fibonacci():
    assert periodic.runs_of(np.zeros(50_000, "i8")) == [(0, 50_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic.runs_of(np.array(b, "i8")) == plain_runs(b)


def test_query_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = told(periodic.op11_periodic_runs(spark, sf_dir).collect())
    assert sorted(found) == sorted(plain_row(d.doc_id, d.text) for d in docs)
    assert sum(r[1] > 0 for r in found) > 5


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "x y z " * 30, "a b\x1fc d " * 9, "é\x85ö " * 40, "a b c " * 20_000]
    # ids whose texts stay, and ids whose texts are made to repeat
    keep = [i for i in range(900) if zlib.crc32(str(i).encode()) % 10]
    turn = [i for i in range(900) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [*zip(keep, texts, strict=False), *zip(turn, texts[:-1], strict=False)] + [(None, "a " * 30), (None, None), (keep[0], "b " * 30), (keep[0], "b " * 30)]
    spark.createDataFrame([(i, t, "r", 1, "c", 2) for i, t in rows], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    assert sorted(told(periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted((plain_row_of_long(*r) for r in rows), key=key)
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def plain_row_of_long(doc_id, text):
    """The plain version looks at every period; a long text of one short period is known without."""
    if text and len(text) > 10_000 and zlib.crc32(str(doc_id).encode()) % 10:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        n = len(text.split())
        return doc_id, 1, 0, n, 3, 1000 * n // 3, sha(f"0,{n},3\n"), sha("a b c")
    return plain_row(doc_id, text)
