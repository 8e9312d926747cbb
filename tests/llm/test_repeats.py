"""Op 6 against brute force."""

import collections
import subprocess
import sys

import numpy as np
import pytest

from quarry.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(d, "u1")[~gone[:-1]])
        out.append((len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept))
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh éß ")
    passages = ["".join(rng.choice(letters, k)) for k in (39, 40, 41, 55, 90, 300)]
    texts = [None, "", "a" * 500, "ab" * 300, "xyz" * 20, "short", passages[1], passages[1] + "q", "z" + passages[5], passages[0], passages[0] + "!"]
    while len(texts) < n:
        parts = ["".join(rng.choice(letters, rng.integers(0, 150)))]
        for _ in range(rng.integers(0, 3)):
            parts.append(passages[rng.integers(len(passages))])
            parts.append("".join(rng.choice(letters, rng.integers(0, 60))))
        texts.append("".join(parts))
        if rng.random() < 0.3:
            t = texts[rng.integers(2, len(texts))]
            at = rng.integers(0, len(t) + 1)
            texts.append(t[:at] + "#" + t[at:] if rng.random() < 0.7 else t)
    return texts[:n]


@pytest.mark.parametrize("seed,together,scan", [(1, 20_000, 1 << 21), (2, 2, 1 << 21), (3, 20_000, 200)])
def test_equals_brute_force(spark, monkeypatch, seed, together, scan):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "GRAM", 8)
    monkeypatch.setattr(repeats, "SCAN", scan)
    texts = corpus(seed, 160)
    rows = [*((i if i != 9 else None, t, 1) for i, t in enumerate(texts)), (20, texts[20], 1), (21, texts[30], 1)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, key int"), 40).collect()
    want = [(d, *x) for (d, *_), x in zip(rows, brute([t for _, t, _ in rows], 40), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)


def test_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120).collect()
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows)).collect()}
    for r, want in zip(rows, brute([r.text for r in rows], 400), strict=True):
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) == want


def test_refinement_equals_counting():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = bytes(rng.integers(97, 99, 300, dtype="u1"))
        segments = [base[i : i + rng.integers(20, 90)] for i in rng.integers(0, 200, 12)]
        segments = list(dict.fromkeys(segments))
        count = collections.Counter(s[p : p + 20] for s in segments for p in range(len(s) - 19))
        got = repeats.repeated_windows(segments, 20)
        assert all(g.tolist() == [count[s[p : p + 20]] > 1 for p in range(len(s) - 19)] for s, g in zip(segments, got, strict=True))


@pytest.mark.parametrize("at_once", [1 << 20, 100, 10])
def test_windows_of_anchors_equal_counting_by_anchor_and_distance(monkeypatch, at_once):
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    word = lambda n, low=97, high=99: bytes(rng.integers(low, high, n, dtype="u1"))
    for _ in range(20):
        anchors = [word(6), word(6)]
        rows = [(g, left, left + anchors[g] + word(rng.integers(0, 14))) for g in rng.integers(0, 2, 40).tolist() for left in [word(rng.integers(0, 14))]]
        segments, group, offset = [s for *_, s in rows], np.array([g for g, *_ in rows]), np.array([len(left) for _, left, _ in rows])
        count = collections.Counter((g, p - len(left), s[p : p + 20]) for g, left, s in rows for p in range(len(s) - 19))
        got = repeats.repeated_windows(segments, 20, group, offset)
        assert all(w.tolist() == [count[g, p - len(left), s[p : p + 20]] > 1 for p in range(max(0, len(s) - 19))] for (g, left, s), w in zip(rows, got, strict=True))


CROWDED = """
import resource
import numpy as np
from quarry.llm import repeats
rng = np.random.default_rng(0)
base, segments = bytes(rng.integers(97, 123, 768, dtype="u1")), []
for i in range(20_000):
    b = bytearray(base)
    for low in (0, 400):
        b[low + rng.integers(0, 368)] = rng.integers(65, 90)
    segments.append(bytes(b))
repeats.repeated_windows(segments, 400, np.zeros(20_000, "i8"), np.full(20_000, 368))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_one_anchor_of_very_many_near_copies_takes_little_memory():
    """20,000 segments of 768 bytes that differ in a place before and one after their anchor."""
    done = subprocess.run([sys.executable, "-c", CROWDED], check=True, capture_output=True, text=True, timeout=300, cwd=__file__.rsplit("/tests/", 1)[0])
    assert int(done.stdout) < 500


def test_planted_passages_of_over_50_words_are_caught_from_400_bytes_on(spark):
    rng = np.random.default_rng(5)
    words = lambda n, low, high: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(low, high))) for _ in range(n))
    passages = [words(60, 7, 12) for _ in range(10)] + [words(55, 3, 6) for _ in range(10)]
    texts = [f"{words(150, 2, 9)} {p} {words(150, 2, 9)}" for p in passages for _ in range(3)] + [words(360, 2, 9) for _ in range(60)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        p = passages[i // 3] if i < 60 else ""
        assert got[i].n_bytes == len(t)
        assert (got[i].n_removed >= len(p) and p.encode() not in got[i].kept) if len(p) >= 400 else got[i].n_removed == 0
    assert sum(len(p) >= 400 for p in passages) == 10 and max(map(len, passages[10:])) < 390


def test_rows_that_repeat_as_a_whole_give_their_segments_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh"), 900))
    near = [base[:p] + "#" + base[p + 1 :] for p in (300, 450, 600)]
    rows = [*[(None, base)] * 200, *[(7, near[0])] * 200, *enumerate(near[1:])]
    sizes, real = {}, repeats.written

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "written", counted)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 400), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)
    assert 0 < sizes["segments"] < 100


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
