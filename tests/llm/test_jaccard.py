"""Op 4 against brute force."""

import collections
import re

import numpy as np
import pytest

from quarry.llm import jaccard
from quarry.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=90, k=3):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "'", "the", "The"]
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "ONE two three"]
    while len(texts) < n:
        if len(texts) < 30 or rng.random() < 0.25:
            w = list(rng.choice(vocabulary, rng.integers(1, 260)))
        else:
            w = str(texts[rng.integers(8, len(texts))]).split(" ")
            for _ in range(rng.integers(0, max(1, len(w) // 30) + 1)):
                at = rng.integers(0, len(w))
                how = rng.integers(3)
                w[at : at + (how != 1)] = [] if how == 0 and len(w) > 1 else [str(rng.choice(vocabulary))]
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("seed,n,small", [(1, 350, False), (2, 300, True)])
def test_equals_brute_force(spark, monkeypatch, seed, n, small):
    if small:  # tiles and groups of a few sets
        monkeypatch.setattr(jaccard, "TILE", 8)
        monkeypatch.setattr(jaccard, "WHOLE", 8)
        monkeypatch.setattr(jaccard, "PARTED_SHINGLES", 900)
        monkeypatch.setattr(jaccard, "GROUP", 4)
    texts = corpus(seed, n)
    ids = [None if i in (40, 41) else (i * 7919) % 10007 for i in range(n)]
    rows = [*zip(ids, texts, strict=True), (ids[50], texts[50]), (ids[51], texts[60])]
    df = spark.createDataFrame([(d, t, "x", 3) for d, t in rows], "doc_id long, text string, class string, hood int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("percent,k,tile", [(80, 5, 256), (60, 2, 256), (80, 5, 6), (60, 2, 6)])
def test_lower_thresholds(spark, monkeypatch, percent, k, tile):
    for name in ("TILE", "WHOLE", "PARTED"):
        monkeypatch.setattr(jaccard, name, tile)
    texts = corpus(percent, 260)
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()), key=str)
    assert got == brute(rows, percent, k)


def test_one_of_each_group_stays(spark):
    texts = corpus(7, 200)
    rows = [(i if i not in (30, 31, 77) else None, t, "x") for i, t in enumerate(texts)] + [(20, texts[20], "x"), (None, texts[30], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = jaccard.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    component = {}
    sets = [shingles(t, 5) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    for i, r in enumerate(rows):
        if sets[i]:
            component.setdefault(root(i), []).append((r[0] is None, r[0] or 0, i))
    empty = [(d, t) for (d, t, _), s in zip(rows, sets, strict=True) if not s]
    assert len(got) == len(component) + len(empty)
    firsts = {min(c)[1] for c in component.values() if not min(c)[0]}
    assert {d for d, t in got if d is not None and (t or "").strip()} == firsts and [x for x in got if not (x[1] or "").strip()] == sorted(empty, key=str)


def test_chains_of_unlike_sets_are_parted(spark, monkeypatch):
    """Sets that share rare shingles with the next one only are one neighbourhood at first, and none of them is compared in the end; copies among them are found."""
    monkeypatch.setattr(jaccard, "PARTED", 4)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 50).astype("u8")) for _ in range(12)]
    sets = [np.unique(np.concatenate([a, b[:4]])) for a, b in zip(sets, [*sets[1:], sets[0]], strict=True)]
    sets.append(np.unique(np.concatenate([sets[3][:-1], np.array([5], "u8")])))
    rows = [(i, 0, 1, len(s), int(s[0] >> np.uint64(1)), bytearray(s.tobytes())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "class long, hood long, copies long, size long, order long, tokens binary")
    assert {(r["class"], r.hood) for r in jaccard.parted(df, 80).collect()} == {(3, 3), (12, 3)}
    whole = spark.createDataFrame(rows[:4], df.schema)
    assert jaccard.parted(whole, 80).count() == 4


def test_long_text(spark):
    w = [f"w{i % 7919}x{i % 13}" for i in range(60_000)]
    other = [*w[:30_000], "new", *w[30_000:]]
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:40_000]))]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    levels = jaccard.Levels(90)
    for _ in range(400):
        n = int(rng.integers(9, 400))
        base = rng.integers(0, 1 << 63, n, dtype="u8") * np.uint64(2)
        drop, more = int(rng.integers(0, max(2, n // 18))), int(rng.integers(0, max(2, n // 18)))
        other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, more, dtype="u8")]))
        base = np.unique(base)
        both = len(np.intersect1d(base, other))
        if 100 * both >= 90 * (len(base) + len(other) - both) and len(np.setxor1d(base, other)):
            assert len(np.intersect1d(levels.signatures(base), levels.signatures(other)))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(120)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {(r.a, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for e in edges if e[0] != e[1] for x in e} | {(x, root(x)) for x, _ in got}
