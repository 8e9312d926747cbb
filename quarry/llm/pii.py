"""Op 8. Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides. DataFrame functions only.

Regexes, gazetteers and the words around a candidate vote; expectation-maximisation over the counts of vote patterns estimates how far each
labeler is to be trusted and so a probability for each pattern. These probabilities are the labels of a logistic span classifier, which
does not see the votes: its features are the shape of the span and the words beside it, hashed. It decides on every candidate that the
base rules do not name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import before, documents, let, text_of, written

# Possessive repeats and look-behinds keep every search linear: a match can begin only where a run begins or the last match ended,
# which is where the leftmost match of the plain pattern begins too.
_LOCAL = "A-Za-z0-9._%+-"
#: Families of candidates in the order of their kinds; base families first.
FAMILIES = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "hidden_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}+)++",
    "spoken_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{1,63}+)++",
    "broken_ip": r"(?<![0-9.])[0-9]{1,3}+(?:[\[({]\.[\])}][0-9]{1,3}+){3}(?![0-9])",
    "dotted_card": r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9./])",
    "trunk_phone": r"(?<![0-9A-Za-z+.-])00[1-9][0-9]{0,2}(?:[\x20./-]?\(?[0-9]{2,5}\)?){2,4}(?![0-9A-Za-z])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]\x20)(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z])",
}
BASE = ("email", "ip", "card", "phone")
KIND = {"hidden_email": "email", "spoken_email": "email", "broken_ip": "ip", "dotted_card": "card", "trunk_phone": "phone", "local_phone": "phone"}
#: Words that stand before personal data of a kind, and words that stand before other numbers.
CONTEXT = {
    "email": r"e-?mail|mail|contact|correo|courriel|write|reach|adress",
    "ip": r"\bips?\b|host|server|address|client|login|from",
    "card": r"card|visa|master|credit|debit|pay|karte|carte|tarjeta",
    "phone": r"phone|tel\b|tel[.:]|call|mobile|cell|fax|tél|telefon|teléfono|contact",
}
BESIDE = r"^[\s,;.)]*(?:or|and|und|oder|ou|et|o|y)?[\s,;.(]*(?:e-?mail|phone|tel|call|fax|mobile|contact|card|expires|exp|cvc|cvv|host|server|login)\b"
AGAINST = r"version|\bv\.?$|isbn|build|chapter|section|§|№|no\.$|page|id\b"
#: Gazetteers of top-level domains and of first digits of cards and of dialling codes.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|br|mx|ar|au|jp|cn|in"
CARDS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4))"
DIALLING = r"^\+(?:1|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
#: Probability from which the classifier adds a candidate that the base rules do not name.
ADDED_FROM = 0.9
LABELERS = ("rule", "shape", "gazetteer", "context", "beside", "against")
#: Candidates that the classifier is fitted on at most: those of smallest hash. Buckets of its features; features of a candidate.
TRAIN_SPANS, BUCKETS, FEATURES = 8192, 1024, 12
#: How often each labeler votes 1 on personal data and on other candidates, before anything is seen, and for how many candidates that counts. Of labelers that
#: only ever vote one way an abstention is the other vote.
PRIORS = {"rule": (0.98, 0.2), "shape": (0.9, 0.5), "gazetteer": (0.9, 0.4), "context": (0.6, 0.1), "beside": (0.1, 0.03), "against": (0.98, 0.6)}
PRIOR_COUNT, ONE_WAY = 20, {"context": 0, "beside": 0, "against": 1}


def _octets(m: Column) -> Column:
    one = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{one}\.{one}\.{one}\.{one}$")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    places = F.when(F.length(digits) <= 19, F.sequence(F.lit(1), F.length(digits))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def valid(family: str, m: Column) -> Column:
    """Whether a match of a base family holds, or what it would be in plain writing."""
    kind, digits = KIND.get(family, family), F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(F.regexp_replace(m, r"[^0-9.]", ""))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15)


def votes(family: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Votes in the order of LABELERS: 1 for personal data, 0 against, -1 for neither."""
    kind, digits = KIND.get(family, family), F.regexp_replace(m, "[^0-9]", "")
    shape = {
        "email": ~m.rlike(r"^[.-]|\.\.|[.-]@|@-"),
        "ip": ~m.rlike(r"(?:^|\.)0[0-9]") & ~after.rlike(r"^\.?[0-9]"),
        "card": m.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"),
        "phone": m.rlike(r"^\+?[0-9]{0,5}[ ./-]?\(?[0-9]{2,4}\)?(?:[ ./-]?\(?[0-9]{2,5}\)?){1,4}$"),
    }[kind]
    gazetteer = {
        "email": F.lower(m).rlike(rf"[. )\]](?:{DOMAINS})$"),
        "ip": m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])[\[({.]") & ~m.rlike(r"^127[\[({.]"),
        "card": digits.rlike(CARDS),
        "phone": F.lit(True) if family == "local_phone" else F.regexp_replace(m, "^00", "+").rlike(DIALLING),
    }[kind]
    near = F.lower(before)
    # a rule that a family of its own kind always keeps tells nothing
    rule = valid(family, m).cast("int") if family in BASE or kind in ("ip", "card") or family == "trunk_phone" else F.lit(-1)
    return [
        rule,
        shape.cast("int"),
        gazetteer.cast("int"),
        F.when(near.rlike(CONTEXT[kind]), F.lit(1)).otherwise(F.lit(-1)),
        F.when(F.lower(after).rlike(BESIDE), F.lit(1)).otherwise(F.lit(-1)),
        F.when(near.rlike(AGAINST) | after.rlike(r"^[A-Za-z0-9]"), F.lit(0)).otherwise(F.lit(-1)),
    ]


def features(family: str, m: Column, before: Column, after: Column) -> Column:
    """Buckets of what the classifier sees: whether the digits could be such data at all, kind, family, shape, signs, length and digits of the span, and the words
    and signs beside it."""

    def sign(c: Column) -> Column:
        return F.when(c == "", "").when(c.rlike(r"\p{L}"), "a").when(c.rlike(r"\p{N}"), "0").when(c.rlike(r"\s"), " ").otherwise(c)

    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), "[A-Za-z]+", "a"), "(?:a[._-]?)+a", "a")
    near = F.lower(before)
    seen = [
        valid(family, m).cast("string"), F.lit(KIND.get(family, family)), F.lit(family), shape, F.regexp_replace(m, "[A-Za-z0-9]+", ""), F.floor(F.length(m) / 4).cast("string"), F.length(F.regexp_replace(m, "[^0-9]", "")).cast("string"),
        F.regexp_extract(near, r"(\p{L}+)[^\p{L}]*$", 1), F.regexp_extract(near, r"(\p{L}+)[^\p{L}]+\p{L}+[^\p{L}]*$", 1), sign(F.right(before, F.lit(1))), F.regexp_extract(F.lower(after), r"^[^\p{L}]*(\p{L}+)", 1), sign(F.left(after, F.lit(1))),
    ]
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), x), F.lit(BUCKETS)).cast("int") for i, x in enumerate(seen)))


def matches(text: Column, family: str) -> Column:
    return F.regexp_extract_all(text, F.lit(FAMILIES[family]), F.lit(0))


#: What is kept of a candidate: characters since the last match of its family, its own, whether a base rule holds, its vote pattern, the classifier's
#: features, and a hash that orders candidates.
ONE = "struct<gap:int,long:int,good:boolean,pattern:string,features:array<int>,chance:bigint>"


def candidates(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, and an array of candidates (ONE) for each family; null if it has none.

    What stands between the matches comes from splitting the text by the same pattern, so positions are sums of lengths. Votes and features of a
    candidate are worked out here, once; what follows reads them.
    """
    base = docs.select(*keep, text_of().alias("_text"))
    with_m = base.withColumns({f"_m_{f}": _guard(f, matches(F.col("_text"), f)) for f in FAMILIES})

    def spans(f: str) -> Column:
        between = F.split(F.col("_text"), FAMILIES[f], -1)
        zipped = F.slice(F.arrays_zip(F.col(f"_m_{f}").alias("m"), between.alias("b"), F.slice(between, 2, 1 << 30).alias("a")), 1, F.size(f"_m_{f}"))
        placed = F.transform(zipped, lambda x: F.struct(F.length(x["b"]).alias("gap"), x["m"].alias("m"), F.right(x["b"], F.lit(32)).alias("before"), F.left(x["a"], F.lit(24)).alias("after")))

        def one(x: Column) -> Column:
            args = x["m"], x["before"], x["after"]
            good = valid(f, x["m"]) if f in BASE else F.lit(False)
            return F.struct(x["gap"].alias("gap"), F.length(x["m"]).alias("long"), good.alias("good"), _pattern_of(f, *args).alias("pattern"), features(f, *args).alias("features"), F.xxhash64(*args).alias("chance"))

        return F.when(F.size(f"_m_{f}") > 0, F.transform(placed, one))

    return with_m.select(*[c for c in base.columns if c != "_text"], *(spans(f).alias(f) for f in FAMILIES))


def _guard(f: str, found: Column) -> Column:
    need = {"email": "@", "phone": "+", "ip": ".", "hidden_email": "dot", "spoken_email": " dot ", "trunk_phone": "00"}.get(f)
    return F.when(F.contains(F.col("_text"), F.lit(need)), found).otherwise(F.array().cast("array<string>")) if need else found



def _pattern_of(f: str, m: Column, before: Column, after: Column) -> Column:
    """Family, votes and length class of a candidate: all that the votes' model sees of it."""
    length = F.when(F.length(m) > 30, "l").otherwise("s")
    return F.concat_ws(",", F.lit(f), *(v.cast("string") for v in votes(f, m, before, after)), length)


def _of_family(f: str) -> Column:
    return F.coalesce(F.col(f), F.array().cast(f"array<{ONE}>"))


def seen(found: DataFrame) -> DataFrame:
    """pattern, features, chance of every candidate of `candidates`."""
    listed_as = lambda f: F.transform(_of_family(f), lambda x: F.struct(x["pattern"].alias("pattern"), x["features"].alias("features"), x["chance"].alias("chance")))
    return found.select(F.explode(F.concat(*map(listed_as, FAMILIES))).alias("c")).select("c.*")


def spans_of(found: DataFrame, key: list[str], model: Model) -> DataFrame:
    """A row for each candidate of `candidates` that counts as personal data: the key columns, family, start, end. One exchange of the
    candidates by their row, for the running sums of lengths."""

    def listed_as(f: str) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.struct(F.lit(f).alias("family"), i.alias("at"), x["gap"].alias("gap"), x["long"].alias("long"), model.holds(f, x).alias("hit"))

        return F.transform(_of_family(f), one)

    every = F.concat(*map(listed_as, (*BASE, *model.families)))
    rows = found.select(*key, F.explode(every).alias("c")).select(*key, "c.*")
    upto = F.sum(F.col("gap") + F.col("long")).over(Window.partitionBy(*key, "family").orderBy("at"))
    return rows.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.col("long")).where("hit").select(*key, "family", "start", "end")


@dataclass
class Model:
    """posterior: of each vote pattern, the probability that such a candidate is personal data; reliabilities: of each labeler for each kind; weights:
    of the classifier's feature buckets, the last one the bias."""

    posterior: dict[str, float]
    reliabilities: dict[str, float]
    weights: list[float]

    def score(self, buckets: Column) -> Column:
        known = F.split(F.lit(",".join(map(repr, self.weights[:-1]))), ",").cast("array<double>")  # one constant, not a node of the plan for each weight
        raw = F.aggregate(buckets, F.lit(self.weights[-1]), lambda s, i: s + F.element_at(known, i + 1))
        return 1 / (1 + F.exp(-raw))

    def holds(self, family: str, x: Column) -> Column:
        """A base candidate whose rule holds; any other one that the classifier takes. The votes have no say here: they are what it has learned from."""
        return x["good"] if family in BASE else self.score(x["features"]) >= ADDED_FROM

    @property
    def families(self) -> list[str]:
        """Families beyond the base that have candidates."""
        return [f for f in FAMILIES if f not in BASE and any(p.startswith(f"{f},") for p in self.posterior)]


def weigh(pattern_counts: list[tuple[str, int]], rounds: int = 60) -> tuple[dict[str, float], dict[str, float]]:
    """Probabilities of the vote patterns and reliabilities of the labelers, by expectation-maximisation.

    A pattern is a family, a vote of each labeler and a length class: a bounded number, whatever the input. Each labeler has, for each
    kind of data, a chance to vote 1 on personal data and on other candidates, with PRIORS. What the base rules say of their own
    families is known and stays, and so is a candidate whose digits fail the rule of its kind; that ties the estimates down, as labelers that always
    agree could else stand for either side.
    """

    def counted(vote: int, labeler: str) -> int:
        return ONE_WAY.get(labeler, -1) if vote < 0 else vote

    rows = [(p, p.split(",")[0], [counted(int(v), k) for v, k in zip(p.split(",")[1:], LABELERS, strict=False)], n) for p, n in sorted(pattern_counts)]
    posterior = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(1 if x == 1 else -1 if x == 0 else 0 for x in v))) for p, _, v, _ in rows}
    known = {p: 0.99 if v[0] == 1 else 0.01 for p, f, v, _ in rows if f in BASE or v[0] == 0}
    posterior |= known
    right: dict = {}
    kinds = sorted({KIND.get(f, f) for _, f, *_ in rows})
    for _ in range(rounds):
        right, prior = {}, {}
        for kind in kinds:
            own = [(posterior[p], n) for p, f, _, n in rows if KIND.get(f, f) == kind]
            prior[kind] = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
            for k, labeler in enumerate(LABELERS):
                one = [(posterior[p], v[k], n) for p, f, v, n in rows if KIND.get(f, f) == kind and v[k] >= 0]
                yes = (sum(q * n for q, v, n in one if v == 1) + PRIORS[labeler][0] * PRIOR_COUNT) / (sum(q * n for q, _, n in one) + PRIOR_COUNT)
                no = (sum((1 - q) * n for q, v, n in one if v == 1) + PRIORS[labeler][1] * PRIOR_COUNT) / (sum((1 - q) * n for q, _, n in one) + PRIOR_COUNT)
                right[kind, k] = yes, no
        for p, f, v, _ in rows:
            if p in known:
                continue
            odds = math.log(prior[KIND.get(f, f)] / (1 - prior[KIND.get(f, f)]))
            for k, vote in enumerate(v):
                if vote >= 0:
                    yes, no = right[KIND.get(f, f), k]
                    odds += math.log(yes / no) if vote else math.log((1 - yes) / (1 - no))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior, {f"{kind}:{LABELERS[k]}": (yes + 1 - no) / 2 for (kind, k), (yes, no) in right.items()}


def train(buckets: np.ndarray, target: np.ndarray, steps: int = 300) -> list[float]:
    """Weights of a logistic classifier on probabilities as labels, with weight decay, by Adam. Without rows all are 0."""
    w = np.zeros(BUCKETS + 1)
    if not len(target):
        return w.tolist()
    index = np.column_stack([buckets, np.full(len(buckets), BUCKETS)])
    a, b = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        miss = 1 / (1 + np.exp(-np.clip(w[index].sum(1), -30, 30))) - target
        slope = np.bincount(index.ravel(), np.repeat(miss, index.shape[1]), BUCKETS + 1) / len(target) + 1e-4 * w
        a += 0.1 * (slope - a)
        b += 0.01 * (slope * slope - b)
        w = w - 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return w.tolist()


def fit(found: DataFrame) -> Model:
    """The model of the candidates of a table. The driver gets a count for each vote pattern, and features of TRAIN_SPANS candidates at most: all
    candidates count for the labelers, and the classifier learns from different ones of a share of the hashes that follows from their number."""
    every = seen(found)
    counts = every.groupBy("pattern").count().collect()  # bounded by the number of patterns
    posterior, reliabilities = weigh([(r["pattern"], r["count"]) for r in counts])
    step = max(1, sum(r["count"] for r in counts) // (2 * TRAIN_SPANS))  # so that no more than is needed leaves the tasks
    chosen = every.where(F.pmod("chance", F.lit(step)) == 0).select("chance", "pattern", "features").distinct()
    rows = chosen.orderBy("chance", "pattern", "features").limit(TRAIN_SPANS).collect()
    buckets = np.array([r.features for r in rows], "i8").reshape(len(rows), FEATURES)
    return Model(posterior, reliabilities, train(buckets, np.array([posterior[r.pattern] for r in rows])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (array of start, kind_no, end, kind), spans (the same with what the model adds).

    Every row of docs gives a row; a null text counts as empty, an empty one has no spans, repeated rows are rows of their own, an empty table gives no rows.
    Every search is linear in the text, so very long ones are whole. Positions are code points. Added spans that overlap a base
    span are left out. What is shuffled are candidates, not texts.
    """
    found = written(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), [F.col("doc_id"), F.monotonically_increasing_id().alias("row")]), "candidates")
    model = fit(found)
    kind_no = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind")).cast("int")
    own = spans_of(found, ["row"], model).withColumn("is_base", F.col("family").isin(*BASE))
    kind = F.col("family")
    for f, k in KIND.items():
        kind = F.when(F.col("family") == f, F.lit(k)).otherwise(kind)
    own = own.withColumn("kind", kind).withColumn("no", kind_no)
    item = F.struct("start", "no", "end", "kind", "is_base")
    lists = own.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("every"))  # those of one document
    base = F.filter("every", lambda x: x["is_base"])
    lists = lists.withColumn("base", base)
    free = F.filter("every", lambda x: x["is_base"] | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    lists = lists.withColumn("spans", F.when(F.size("base") == F.size("every"), F.col("every")).otherwise(free))
    out = found.select("row", "doc_id").join(lists, "row", "left")
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,is_base:boolean>>")
    out = out.withColumns({"base": F.coalesce("base", empty), "spans": F.coalesce("spans", empty)})
    return out.select("doc_id", *(F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE), "base", "spans")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


SPAN = "struct<start:int,no:int,end:int,kind:string,is_base:boolean>"
#: Characters of the pieces that a text is taken apart into before it is cut: a piece is looked through from its own beginning.
PIECE = 1024


def _placed(family: str, model: Model) -> Column:
    """Spans of a family that count, as SPAN, from the sums of all gaps and lengths before."""
    kind = KIND.get(family, family)
    found = _of_family(family)
    moves = F.transform(found, lambda x: x["gap"] + x["long"])

    def one(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(BASE.index(kind) + 1).alias("no"), (start + x["long"]).alias("end"), F.lit(kind).alias("kind"), F.lit(family in BASE).alias("is_base"), model.holds(family, x).alias("hit"))

    placed = F.filter(F.zip_with(found, before(moves, lambda a, b: a + b, 0), one), lambda x: x["hit"])
    spans = F.transform(placed, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "no", "end", "kind", "is_base"))))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _without_overlaps(spans: Column) -> Column:
    """Sorted spans without the added ones that overlap a base span: one that begins before reaches over their start, or the next one begins before their end."""
    far = 1 << 30

    def kept(every: Column) -> Column:
        reach = before(F.transform(every, lambda x: F.when(x["is_base"], x["end"]).otherwise(0)), F.greatest, 0)
        following = F.reverse(before(F.reverse(F.transform(every, lambda x: F.when(x["is_base"], x["start"]).otherwise(far))), F.least, far))
        told = F.arrays_zip(every.alias("x"), reach.alias("reach"), following.alias("following"))
        free = F.filter(told, lambda t: t["x"]["is_base"] | ((t["reach"] <= t["x"]["start"]) & (t["following"] >= t["x"]["end"])))
        return F.transform(free, lambda t: t["x"])

    return let(F.sort_array(spans), kept)


def _cut(text: Column, spans: Column) -> Column:
    """text with each of the sorted spans replaced by its kind; spans that overlap go as one, under the kind of the first."""

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Characters from a to b, which may lie in several pieces."""
        places = F.when(b > a, F.sequence(F.floor(a / PIECE), F.floor((b - 1) / PIECE))).otherwise(F.array().cast("array<bigint>"))

        def part(k: Column) -> Column:
            low = F.greatest(a - k * PIECE, F.lit(0))
            return F.substring(F.get(pieces, k), low.cast("int") + 1, (F.least(b - k * PIECE, F.lit(PIECE)) - low).cast("int"))

        return F.array_join(F.transform(places, part), "")

    def joined(pieces: Column, every: Column) -> Column:
        reach = before(F.transform(every, lambda x: x["end"]), F.greatest, 0)
        first = F.filter(F.arrays_zip(every.alias("x"), reach.alias("reach")), lambda t: t["x"]["start"] >= t["reach"])
        marked = F.transform(first, lambda t: F.concat(between(pieces, t["reach"], t["x"]["start"]), F.lit("<"), F.upper(t["x"]["kind"]), F.lit(">")))
        last = F.array_max(F.transform(every, lambda x: x["end"]))
        return F.concat(F.array_join(marked, ""), let(last, lambda a: between(pieces, a, F.length(text))))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda p: let(spans, lambda every: joined(p, every)))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `detect` in `text` replaced by <KIND>, and n_chars, if there, brought up to date. Null text stays null.

    All families are searched in the text as given, once: what they find is written beside the row, the model is fitted on it, and each text
    is cut from that table. Spans that overlap go as one, under the kind of the first (by start, then by the order of families). No text
    is shuffled. The work on a text grows with its length and the number of its spans. An empty table gives no rows, repeated rows are rows of
    their own, and other columns, whatever their names, go along as they are.
    """
    held = written(candidates(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_as_given")]), "found")
    model = fit(held)
    row = F.col("row_as_given")
    spans = F.concat(*(_placed(f, model) for f in (*BASE, *model.families)))
    out = held.select("row_as_given", (_without_overlaps(spans) if model.families else F.sort_array(spans)).alias("spans"))
    text = row.getField("text")
    out = out.select("row_as_given", F.when(F.size("spans") > 0, _cut(text, F.col("spans"))).otherwise(text).alias("redacted"))
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted")}
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return out.select(*((changed[c].cast(kinds[c]) if c in changed else row.getField(c)).alias(c) for c in docs.columns))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(documents(spark, sf_dir))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
