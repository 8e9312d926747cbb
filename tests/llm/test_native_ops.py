"""Ops 7 and 8 against plain versions."""

import collections
import hashlib
import re

import numpy as np
import pytest

from quarry.llm import mixing, pii

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        whole = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * weight[s] / whole for s in names}
        over = {s for s in names if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = np.random.default_rng(seed)
    sources = ["a", "b", "B", "é", "zz", None, "", "hot"]
    rows = []
    for i in range(1500):
        s = "hot" if i % 3 == 0 else sources[int(rng.integers(0, len(sources) - 1)) if rng.random() < 0.9 else 0]
        s = "a" if s == "a" and i % 9 else s
        rows.append((i if i != 5 else None, s, None if i == 7 else " ".join(["w"] * int(rng.integers(0, 60))) + "\n", 1, "x"))
    rows.append(rows[10])
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, number int, block string")
    got = mixing.mix(df).collect()
    size = [len(WORD.findall(t or "")) for _, _, t, *_ in rows]
    by = collections.Counter()
    for (_, s, *_), n in zip(rows, size, strict=True):
        by[s] += n
    want = plain_targets(by)
    assert sorted(((r.doc_id, r.source, r.size) for r in got), key=str) == sorted(((d, s, n) for (d, s, *_), n in zip(rows, size, strict=True)), key=str)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 10 for s in by), (taken, want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    copies = mixing.mixed(df)
    assert copies.columns == df.columns
    count = collections.Counter((r.doc_id, r.source) for r in copies.collect())
    assert max(count.values()) <= 6


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 0, 400, 100.0), ("b", 1, 400, 300.0), ("c", 2, 0, 0.0)], "source string, number int, source_size long, target double")
    rows = mixing.schedule(spark, t, 400, 1).orderBy("slot").collect()
    ones = np.array([r.number for r in rows])
    assert len(rows) == 400 and all(abs((ones[:n] == 0).sum() - n / 4) < 3 for n in range(1, 400))
    for k in (0, 1):
        assert [r["rank"] for r in rows if r.number == k] == list(range((ones == k).sum()))


def test_small_sources_reach_their_targets_beside_a_large_one(spark):
    rows = [(i, "large", "w " * 1000) for i in range(900)]
    rows += [(10_000 + 100 * k + j, f"small{k:02}", "w " * (10 if k % 2 else 70)) for k in range(40) for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken, target = collections.Counter(), {}
    for r in mixing.mix(df, block=512).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target["small01"] == 300 and target["small00"] == 2100
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 10 for s in target), (taken, target)


def test_blocks_of_a_stream_are_equal(spark):
    t = spark.createDataFrame([(s, b, w) for s, b in [(7, 3), (700, 256), (10**12 + 1, 2 * 10**9)] for w in (0, 1, 2, 6, s - 1) if w < s], "source_size long, blocks long, word long")
    for r in t.withColumn("block", mixing._block_of("word")).withColumn("begin", mixing._first_word("block")).withColumn("end", mixing._first_word("(block + 1)")).collect():
        assert r.begin == r.block * r.source_size // r.blocks <= r.word < r.end == (r.block + 1) * r.source_size // r.blocks


def test_empty_mix(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)).collect()
    assert all((x.size, x.taken, x.target) == (0, 0, 0.0) for x in r)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, sf_dir):
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "@", ".", "x.y", "%", "-", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "1.2.3.4", "256.1.1.1", "0001.02.3.04", "12", " ", "+", "(", ")", "é", "😀", "3056 9309 0259 04", "a@b", "c@d.e-f.g", "\n", "5500-0000-0000-0004", "1 2 3", "+49-30.1234567"]
    texts = [None, "", "a@b.c@d.e", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "4" * 3000, "a." * 3000 + "@", "1 " * 5000]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, kind int")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i if i != 3 else None], plain_spans(t)
        assert [(x.start, x.no, x.end, x.kind) for x in r.base] == [(a, n + 1, b, k) for a, n, b, k in want], t
        assert r.n_email == sum(x[3] == "email" for x in want) and {(x.start, x.end, x.kind) for x in r.base} <= {(x.start, x.end, x.kind) for x in r.spans}
    out = {r.doc_id: r for r in pii.redact(df.withColumn("n_chars", df.doc_id)).collect()}
    for i, t in enumerate(texts[-200:], len(texts) - 200):
        plain = t
        for a, _, b, k in reversed(plain_spans(t)):
            plain = plain[:a] + f"<{k.upper()}>" + plain[b:]
        assert out[i].text == plain and out[i].n_chars == len(plain)
    assert out[0].text is None


def test_digest(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "x a@b.co 10.0.0.1 z"), (2, "none")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(df).select("doc_id", F.sha2(pii.listed("base"), 256).alias("h"), pii.listed("spans").alias("s")).collect()}
    assert rows[1].s == "email:2:8,ip:9:17" and rows[1].h == hashlib.sha256(b"email:2:8,ip:9:17").hexdigest()
    assert rows[2].s == "" and rows[2].h == hashlib.sha256(b"").hexdigest()


def test_model_adds_what_labelers_agree_on(spark):
    texts = [f"call our phone (212) 555-{1000 + i} today" for i in range(300)] + [f"version {i}.2.3 of 2023-01-0{i % 9}" for i in range(100)] + [f"mail joe.{i} [at] host{i} [dot] com now" for i in range(300)] + [f"tel +1 (212) 555-{1000 + i}" for i in range(200)] + [f"a{i}@b.com" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.detect(df).collect()}
    assert all([x.kind for x in rows[i].spans] == ["phone"] and not rows[i].base for i in range(300))
    assert all(not rows[i].spans for i in range(300, 400))
    assert all([x.kind for x in rows[i].spans] == ["email"] for i in range(400, 700))


def test_added_families_are_found_and_nothing_else(spark):
    """Spans planted in writings that the base rules do not know, beside look-alikes that are no personal data."""
    ends = ("com", "org", "net", "de")
    yes = [("email", f"please mail anna.{i} at host{i} dot {ends[i % 4]} about it", f"anna.{i} at host{i} dot {ends[i % 4]}") for i in range(60)]
    yes += [("ip", f"login from host 10.{i % 200}.7.9 and server {i % 250}[.]2[.]3[.]4 today", f"{i % 250}[.]2[.]3[.]4") for i in range(2, 62)]
    yes += [("card", f"pay by card 4111.1111.1111.1111 number {'x' * (i % 5)}", "4111.1111.1111.1111") for i in range(60)]
    yes += [("phone", f"call the phone 0049 30 12345{10 + i} now", f"0049 30 12345{10 + i}") for i in range(60)]
    no = [f"version {i}.{i % 7}.0 was built at 2023 dot matrix" for i in range(60)] + [f"card 4111.1111.1111.1{i:03} is wrong" for i in range(112, 170) if not luhn(f"4111111111111{i:03}")] + [f"isbn 0030 {1000 + i} 22{i:02} page {i}" for i in range(60)] + [f"server {300 + i}[.]2[.]3[.]4 is none" for i in range(60)]
    plain = [f"mail a{i}@b.com, call +1 (212) 555-{1000 + i} or pay by card 4111 1111 1111 1111 from host 10.1.1.{i % 200}" for i in range(200)]
    texts = [t for _, t, _ in yes] + no + plain
    rows = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: {(x.kind, texts[i][x.start : x.end]) for x in rows[i]} for i in rows}
    hits = sum((kind, m) in found[i] for i, (kind, _, m) in enumerate(yes))
    wrong = sum(len(found[i]) for i in range(len(yes), len(yes) + len(no)))
    assert hits >= 0.9 * len(yes) and wrong <= 0.02 * len(no), (hits, len(yes), wrong, len(no))
    assert all(len(found[i]) == 4 for i in range(len(yes) + len(no), len(texts)))


def test_long_text_and_empty_table(spark):
    text = "word " * 60_000 + "a@b.co " + "1 2 " * 60_000 + "+1 (743) 555-3824"
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    rows = pii.detect(df).collect()
    assert len(rows) == 2 and all([(x.start, x.end, x.kind) for x in r.spans] == [(x[0], x[2], x[3]) for x in plain_spans(text)] for r in rows)
    assert pii.detect(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0
    assert len(mixing.mix(df.selectExpr("doc_id", "text", "'s' as source")).collect()) == 2
