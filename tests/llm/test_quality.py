"""Op 2: held-out accuracy, the sum-of-squares identity, and odd tables."""

import numpy as np
import pyarrow as pa

from quarry.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in quality.op2_factorisation_machine(spark, sf).collect()}
    labels = [(rows[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    out = [(r, y) for r, y in labels if r.held_out]
    assert len(rows) == 1000 and 40 < len(out) < 140
    assert np.mean([r.predicted == y for r, y in out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    x = rng.normal(size=(4, 6))
    want = [0.3 + r @ m.w + sum((m.v[i] @ m.v[j]) * r[i] * r[j] for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(m.raw(x), want)


def test_features_do_not_depend_on_neighbours():
    texts = ["a b c", "", "Word word!! 12 | é", "x" * 5000, " \n ", "the the the"]
    whole = quality.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quality.features(pa.array([t])) for t in texts]), atol=1e-6) and whole.shape[1] == quality.WIDTH


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "c", 3), (None, "abc def", "c", 3), (2, "", None, 4), (2, "", None, 4)], "doc_id long, text string, quality string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.fit(docs, none)).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.asDict()["quality"] in ("c", None) for r in rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, quality.fit(docs, labels)).collect())
    assert quality.scored(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def plain_features(text):
    """Bag and structure statistics of one text, word by word."""
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    data = text.encode()
    names, _ = quality.hashing.words(np.frombuffer(data, "u1"), np.array([0, len(data)]))
    lower = {}
    for w, h in zip(words, names.tolist(), strict=True):
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
        assert lower.setdefault(key, h) == h  # a word has one hash
    bag = np.zeros(quality.BUCKETS)
    for h in names.tolist():
        bag[h % quality.BUCKETS] += 1
    bag = np.log1p(bag)
    bag /= max(1e-6, np.sqrt((bag * bag).sum()))
    size, n = max(1, len(data)), max(1, len(words))
    letters = max(1, sum(b >= 128 or chr(b).isalpha() for b in data))
    mean = sum(len(w.encode()) for w in words) / n
    folded = names.tolist()
    stats = [
        sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()|-" for b in data) / size, text.count("|") / n, text.count("!") / n, sum("A" <= c <= "Z" for c in text) / letters, sum("0" <= c <= "9" for c in text) / size, sum(b >= 128 for b in data) / size,
        sum(a == b for a, b in zip(folded, folded[1:])) / n, len(set(folded)) / n, (5 - mean) / 5, (mean - 5) / 20, 5 * text.count("\n") / n, np.log1p(len(words)) / 12,
    ]
    s = np.clip(stats, 0, 1)
    return np.concatenate([bag, s, [0.5 * (x >= t) for x in s for t in quality.STEPS]])


def test_features_equal_a_plain_version(sf_dir, spark):
    texts = ["a b c", "", "Word word!! 12 | é É", "x" * 5000, " \n ", "the The THE the", "#$% ^& a-b (c)"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    got, want = quality.features(pa.array(texts)), np.stack([plain_features(t) for t in texts])
    near_step = np.abs(got[:, quality.BUCKETS : quality.BUCKETS + 12][:, :, None] - quality.STEPS).reshape(len(texts), -1) < 1e-5  # either side of a step is right there
    assert np.allclose(got[:, : quality.BUCKETS + 12], want[:, : quality.BUCKETS + 12], atol=1e-5)
    assert ((got[:, quality.BUCKETS + 12 :] == want[:, quality.BUCKETS + 12 :]) | near_step).all()


def test_training_follows_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.WIDTH)).astype("f4") * 0.1
    pair = x[:, 3] * x[:, 7] * 100  # what only a product of two features tells
    y = (pair > 0).astype("f4")

    def loss(m):
        p = m.score(x)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    start = quality.Machine(0.0, np.zeros(quality.WIDTH, "f4"), np.zeros((quality.WIDTH, quality.FACTORS), "f4"))
    assert loss(quality.train(x, y)) < 0.5 * loss(start)


def test_repeated_ids_bring_one_row_each(spark):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(50)] + [(2, "other"), (3, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, "text number 0"), (2, "other"), (3, "more")], "doc_id long, text string")
    a, b = quality.fit(docs, labels), quality.fit(once, labels)
    assert a.bias == b.bias and (a.w == b.w).all()
