"""Op 13 against a plain search with Python's own regexes."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import leaks

ODD = "doc_id long, text string, key string, rules string, salt int, row string, trigram string"
PLAIN = {
    "assign": (re.compile(r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(doc_id, text) -> tuple:
    spans = sorted((m.start(), no, m.end(), kind) for no, (kind, (p, good)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if good(m))
    told = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return doc_id, *(sum(x[3] == k for x in spans) for k in PLAIN), hashlib.sha256(told.encode()).hexdigest()


def base(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in df.collect()), key=str)


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def test_query_equals_plain_search(spark, sf_dir):
    found = base(leaks.op13_trigram_secrets(spark, sf_dir))
    assert found == sorted((plain(d.doc_id, d.text) for d in read(spark, sf_dir).collect()), key=str)


def test_made_up_texts_equal_plain_search(spark, tmp_path):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret:", "token", "API_KEY", "apikey", "api__key", '"', "'", " ", "  ", "=", ":", "abc", "abcdef", "x9/_.=-", "AKIA", "AKIAABCDEFGH", "0123456789ABCDEF", "deadbeef", "0" * 24, "f" * 23, "é", "\n", "AKI", "tok", "en", "ſecret=abcdefgh", "toKen=abcdefgh", "secret:token:abcdefghi "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert base(leaks.op13_trigram_secrets(spark, str(tmp_path))) == sorted((plain(*r) for r in rows), key=str)
    assert sum(plain(*r)[1] > 0 for r in rows) > 100


def test_odd_rows(spark, tmp_path):
    leak = "token = abcdefgh " * 3
    rows = [(None, None), (None, leak), (1, ""), (1, ""), (2, leak), (2, leak), (3, "x" * 300_000 + " secret=hunter2222"), (4, "password" + " " * 100_000), (5, "a" * 200_000), (6, "token=abcdefg " * 20_000), *((i, leak) for i in range(10, 400))]
    spark.createDataFrame([(*r, "k", "r", 1, "w", "g") for r in rows], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    assert base(leaks.op13_trigram_secrets(spark, str(tmp_path))) == sorted((plain(*r) for r in rows), key=str)
    read(spark, tmp_path).where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert leaks.op13_trigram_secrets(spark, f"{tmp_path}/none").count() == 0


ADDED = {
    "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "aB3" * 12, "gitlab": "glpat-" + "aB3_" * 5, "slack": "xoxb-123456789012-abcdef", "stripe": "sk_live_" + "a1B2" * 5, "google": "AIza" + "aB3-x" * 7,
    "npm": "npm_" + "aB3" * 12, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "url": "postgres://admin:hunter2@", "bearer": "Bearer abcdefghij0123456789", "credential": "Access-Key: abcd1234",
}
ALIKE = ["-----BEGIN PUBLIC KEY-----", "ghp_short", "glpat-x", "xoxb", "sk_live_1", "AIza", "npm_install", "eyJx.eyJy.z", "http://host:80/path@", "bearer of news", "access key: wordwords", "key=abcd1234", "monkey = banana1234"]


def test_added_kinds_are_found_and_look_alikes_left_alone(spark):
    rows = [(i, f"so é {t} end") for i, t in enumerate([*ADDED.values(), *ALIKE])]
    found = {r.doc_id: r.spans for r in leaks.detect(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", leaks.listed("spans").alias("spans")).collect()}
    for i, (kind, t) in enumerate(ADDED.items()):
        assert found[i] == f"{kind}:5:{5 + len(t)}"
    assert [found[i] for i in range(len(ADDED), len(rows))] == [""] * len(ALIKE)


@pytest.mark.parametrize(("pattern", "sets"), [
    ("abcd", [{"abc", "bcd"}]), ("ab+c", []), ("(?i:AB)cd?e", [{"abc", "bcd", "cde"}, {"abc", "bce"}]), ("foo|ba[rz]", [{"bar"}, {"baz"}, {"foo"}]), ("x[0-9]y", []), ("abc.*def", [{"abc", "def"}]), ("(?:abc){2}", [{"abc"}]), (r"(?<!x)abc\b", [{"abc"}]),
])
def test_trigram_queries(pattern, sets):
    assert leaks.trigram_query(pattern) == sorted((frozenset(s) for s in sets), key=sorted)


def test_every_match_holds_a_set_of_its_query():
    for kind, text in ADDED.items():
        assert any(all(g in text.lower() for g in s) for s in leaks.trigram_query(leaks.RULES[kind])), kind
    assert leaks.trigram_query(leaks.RULES["hex"]) == []


def test_candidates_are_few_and_postings_are_not_of_every_trigram(spark):
    rows = [(i, "nothing to see but tok and ens") for i in range(50)] + [(50, "a Token here"), (51, "AKIA")]
    index = leaks.postings(spark.createDataFrame(rows, "doc_id long, text string"), ["tok", "oke", "ken", "aki", "kia"])
    assert {(r.trigram, r.n_rows) for r in index.collect()} == {("tok", 50), ("tok", 1), ("oke", 1), ("ken", 1), ("aki", 1), ("kia", 1)}
    assert sorted(r.rules for r in leaks.candidates(index, {k: leaks.RULES[k] for k in ("assign", "access")}).collect()) == [["access"], ["assign"]]
