"""Each stage of the pipeline against a plain version, on a table with odd rows."""

import base64
import collections
import hashlib
import time

import numpy as np
import public_tokenizers as P
import pytest

import corpus_pipeline
from quarry.llm import pii, quality
from tests.llm.test_jaccard import shingles
from tests.llm.test_native_ops import WORD, plain_spans, plain_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "no id here at all", None, None, None), (5000, None, "en", "src1", 0), (5001, "", "en", "src1", 0), (5001, "", "en", "src1", 0), rows[3], (5002, "mail a.b@c.org or +1 (212) 555-0100 " * 3, "en", None, 105)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "text", "lang", "source")) for r in df.collect()), key=str)


def test_stages_in_order(spark, sf_dir, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "personal_data", "mix", "tokens"]
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    given = docs
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality"](spark, given, sf_dir)
    assert kept.columns == docs.columns
    scores = quality.scored(docs, machine).collect()
    assert rows_of(kept) == sorted(((r.doc_id, r.text, r.lang, r.source) for r in scores if r.score >= 0.3), key=str)
    given = spark.createDataFrame(kept.collect(), SCHEMA)

    alone = stage["near_copies"](spark, given, sf_dir)
    assert alone.columns == docs.columns
    rows = rows_of(given)
    sets = [shingles(t, 5) for _, t, *_ in rows]
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
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i) if sets[i] else -1 - i].append((r[0] is None, r[0] or 0, r))
    assert rows_of(alone) == sorted((min(g, key=lambda x: x[:2])[2] for g in groups.values()), key=str)
    given = spark.createDataFrame(alone.collect(), SCHEMA)

    clean = stage["personal_data"](spark, given, sf_dir)
    assert clean.columns == docs.columns
    want = []
    for d, t, *rest in rows_of(given):
        for a, _, b, k in sorted(plain_spans(t), reverse=True):
            t = t[:a] + f"<{k.upper()}>" + t[b:]
        want.append((d, t, *rest))
    assert rows_of(clean) == sorted(want, key=str)
    given = spark.createDataFrame(clean.collect(), SCHEMA)

    mixed = stage["mix"](spark, given, sf_dir)
    assert mixed.columns == docs.columns
    size = lambda t: len(WORD.findall(t or ""))
    before, after = collections.Counter(), collections.Counter()
    for _, t, _, s in rows_of(given):
        before[s] += size(t)
    copies = collections.Counter(rows_of(mixed))
    assert set(copies) <= set(rows_of(given)) and max(copies.values()) <= 3
    for (_, t, _, s), n in copies.items():
        after[s] += n * size(t)
    target = plain_targets(before)
    assert sum(abs(after[s] - target[s]) for s in target) < 0.35 * sum(target.values())  # whole documents of a small table
    given = spark.createDataFrame(mixed.collect(), SCHEMA)

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = stage["tokens"](spark, given, sf_dir).collect()
    want = collections.Counter()
    for d, t, *_ in rows_of(given):
        ids = own.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == want


def test_overlapping_spans_are_cut_from_the_text_as_given(spark, sf_dir):
    texts = ["call +33.1.23.45.67.89 now", "a@1.2.3.4 x", "+1 4111 1111 1111 1111.2.3.4", "é😀 1.2.3.4@b.co, +49-30.1234567", "none", "", None, "tel (212) 555-0100 or +1 (743) 555-3824"]
    texts += [f"call our phone (212) 555-{1000 + i} today, then a.b@c.de" for i in range(300)] + [f"mail joe.{i} [at] host{i} [dot] com now 10.0.0.{i % 250}" for i in range(300)]
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    spans = {r.doc_id: r.spans for r in pii.detect(given).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, given, sf_dir).collect()}
    assert len(got) == len(texts) and [x.kind for x in spans[8]] == ["phone", "email"] and [x.kind for x in spans[308]] == ["email", "ip"]
    for i, t in enumerate(texts):
        united = []
        for x in spans[i]:
            if united and x.start < united[-1][1]:
                united[-1][1] = max(united[-1][1], x.end)
            else:
                united.append([x.start, x.end, x.kind])
        want = t
        for a, b, k in reversed(united):
            want = want[:a] + f"<{k.upper()}>" + want[b:]
        assert got[i].text == want, t
        assert got[i].n_chars == (None if t is None else len(want))
    assert got[0].text == "call <PHONE> now"


def test_empty_table(spark, sf_dir):
    given = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, given, sf_dir)
        assert out.count() == 0


def test_other_columns_and_clashing_names_go_along(spark, sf_dir, docs):
    """Names that the stages use themselves are columns of the table here."""
    from pyspark.sql import functions as F

    names = ["score", "class", "hood", "tokens", "row", "kind", "size", "number", "block", "taken", "copies", "own_id", "email", "pattern", "_spans", "spans", "_text", "_row", "row_as_given", "redacted", "score_of_quality", "score_of_quality_", "text_to_score", "partition_of_range"]
    few = docs.limit(60).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, few, sf_dir)
        rows = out.collect()
        if name != "tokens":
            assert out.columns == few.columns and rows and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in rows), name
        else:
            assert len(rows) == 60 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)


def test_a_text_of_very_many_spans_is_cut_in_linear_time(spark, sf_dir):
    many = "".join(f"é{i} a{i}@b.co, " for i in range(100_000))
    rows = [(1, many, "en", "s", 0), (2, "x 1.2.3.4 y", "en", "s", 0)]
    began = time.perf_counter()
    got = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].text == "".join(f"é{i} <EMAIL>, " for i in range(100_000)) and got[1].n_chars == len(got[1].text) and got[2].text == "x <IP> y"
