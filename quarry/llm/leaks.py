"""Op 13. Secrets by a trigram index: each rule's regex gives a Boolean query of trigrams, postings are intersected, and candidates verified.

The index holds, for every different text, the trigrams that some rule asks for. A rule is searched only in the texts that its query leaves; a rule without
a trigram that every match must hold is searched everywhere. DataFrame functions only.
"""

from __future__ import annotations

from itertools import product
from re import _constants as R  # the standard library's own reading of a regex
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, text_of, written

BASE = ("assign", "access", "hex")
_VALUE = r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
#: What the kinds look like, base kinds first. A run that is too short is no match of `access` or `hex`, and none begins within it.
RULES = {
    "assign": rf"(?i:password|passwd|secret|token|api_?key){_VALUE}",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "private_key": r"-----BEGIN\x20(?:[A-Z]{2,10}\x20){0,3}PRIVATE\x20KEY(?:\x20BLOCK)?-----",
    "github": r"(?<![A-Za-z0-9])gh[opsru]_[A-Za-z0-9]{36,}+",
    "gitlab": r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}+",
    "slack": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+",
    "stripe": r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+",
    "google": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "npm": r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "url": r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,31}+://[^\s/:@]{1,128}+:[^\s/@]{1,128}+@",
    "bearer": r"(?<![A-Za-z0-9])(?i:bearer)\x20[A-Za-z0-9._~+/=-]{20,}+",
    "credential": rf"(?<![A-Za-z0-9])(?i:pwd|passphrase|(?:access|auth|private|encryption)[_-]?key){_VALUE}",
}
#: Branches that a query may have; where a regex has more, what stands there is left open, which leaves more candidates and never fewer.
BRANCHES = 64
#: Parts that the rows of a text are dealt over, if they are over a thousandth of all rows; there are fewer than a thousand such texts.
SALTS, HOT = 64, 1000


def holds(kind: str, m: Column) -> Column:
    """Whether a match counts."""
    if kind not in ("assign", "credential"):
        return F.lit(True)
    value = F.regexp_extract(m, RULES[kind], 1)
    if kind == "assign":
        return F.length(value) >= 6
    return (F.length(value) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _pieces(nodes) -> list[list[str]]:
    """What every match of a parsed regex holds: alternatives, each a list of literal pieces with anything between them."""
    out = [[""]]

    def then(more: list[list[str]]) -> None:
        """Each alternative goes on with each of `more`; the last piece of one joins the first of the other."""
        nonlocal out
        if len(out) * len(more) > BRANCHES:
            more = [["", ""]]
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(out, more)]

    for op, value in nodes:
        if op is R.LITERAL:
            then([[chr(value).lower()]])
        elif op is R.IN:
            chars = sorted({chr(v).lower() for o, v in value if o is R.LITERAL})
            plain = all(o is R.LITERAL for o, _ in value)
            then([[c] for c in chars] if plain and len(chars) <= 8 else [["", ""]])
        elif op is R.SUBPATTERN:
            then(_pieces(value[-1]))
        elif op is R.ATOMIC_GROUP:
            then(_pieces(value))
        elif op is R.BRANCH:
            then([p for branch in value[1] for p in _pieces(branch)])
        elif op in (R.MAX_REPEAT, R.MIN_REPEAT, R.POSSESSIVE_REPEAT):
            least, most, inner = value
            if (least, most) == (0, 1):
                then([[""], *_pieces(inner)])
            else:
                if least:
                    then(_pieces(inner))
                then([["", ""]] if (least, most) != (1, 1) else [[""]])
        elif op not in (R.AT, R.ASSERT, R.ASSERT_NOT):
            then([["", ""]])
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams: a text with a match holds all of at least one set. Empty if some match need not hold any: all texts are candidates."""
    sets = {frozenset(p[i : i + 3] for p in pieces for i in range(len(p) - 2)) for pieces in _pieces(_parser.parse(pattern))}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """trigram, key, n_rows: for each trigram of the vocabulary the texts (by hash) that hold it, and how many rows have that text.

    Texts of equal hash share their postings, which leaves more candidates and never fewer.
    """
    known = F.array(*map(F.lit, vocabulary))
    held = F.get(F.transform(F.array(F.lower(text_of())), lambda t: F.filter(known, lambda g: F.contains(t, g))), F.lit(0))
    rows = docs.select(F.xxhash64(text_of()).alias("key"), F.explode(held).alias("trigram"))
    return rows.groupBy("trigram", "key").agg(F.count(F.lit(1)).alias("n_rows"))


def candidates(index: DataFrame, rules: dict[str, str]) -> DataFrame:
    """key, rules, n_rows: the texts that the query of a rule leaves. Rules whose query leaves all texts are not looked up."""
    terms = [(kind, f"{kind}.{i}", g, len(s)) for kind, p in rules.items() for i, s in enumerate(trigram_query(p)) for g in sorted(s)]
    asked = index.sparkSession.createDataFrame(terms, "rule string, branch string, trigram string, needed int")
    # as many rows as the rules have trigrams
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "branch", "rule", "needed").agg(F.count(F.lit(1)).alias("found"), F.max("n_rows").alias("n_rows"))
    return met.where("found = needed").groupBy("key").agg(F.collect_set("rule").alias("rules"), F.max("n_rows").alias("n_rows"))


def _located(text: Column, kind: str) -> Column:
    """gap (characters since the match before), long and good of every match of a kind; null without matches. Positions are sums of lengths, as what stands
    between matches comes from splitting the text by the same pattern."""
    pattern = F.lit(RULES[kind])

    def listed_of(m: Column) -> Column:
        pairs = F.arrays_zip(m.alias("m"), F.slice(F.split(text, RULES[kind], -1), 1, F.size(m)).alias("b"))
        return F.when(F.size(m) > 0, F.transform(pairs, lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["m"]).alias("long"), holds(kind, x["m"]).alias("good"))))

    # as the one element of an array, so that the matches are searched once
    return F.get(F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), listed_of), F.lit(0))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (array of start, no, end, kind, is_base), spans (the same with what other rules add).

    A row for each row: a null text counts as empty, an empty one has no spans, repeated rows are rows of their own, an empty table gives no rows, other
    columns do not matter. Every search is linear in the text, so very long ones are whole. Positions are code points. Added spans
    that overlap a base span are left out. Rows meet their candidates by the hash of their text; rows of very common texts are dealt over SALTS parts.
    """
    queries = {kind: trigram_query(p) for kind, p in RULES.items()}
    vocabulary = sorted({g for sets in queries.values() for s in sets for g in s})
    index = written(postings(docs, vocabulary).sortWithinPartitions("trigram"), "trigrams")
    chosen = written(candidates(index, RULES), "candidates")
    n = docs.count()
    common = [r.key for r in chosen.where(F.col("n_rows") * HOT > n).select("key").collect()]  # fewer than HOT
    parts = F.when(F.col("key").isin(common), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    chosen = chosen.select("key", F.explode(parts).alias("salt"), "rules")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.xxhash64("text"))
    rows = rows.withColumn("salt", F.when(F.col("key").isin(common), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0))
    rows = rows.join(chosen, ["key", "salt"], "left")

    def searched(kind: str) -> Column:
        found = _located(F.col("text"), kind)
        return F.when(F.array_contains("rules", kind), found) if queries[kind] else found

    found = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), *(searched(k).alias(f"of_{k}") for k in RULES))
    found = written(found, "matches")
    none = F.array().cast("array<struct<gap:int,long:int,good:boolean>>")

    def numbered(no: int, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"of_{kind}"), none), lambda x, i: F.struct(F.lit(no).alias("no"), i.alias("at"), x["gap"].alias("gap"), x["long"].alias("long"), x["good"].alias("good")))

    each = [numbered(no, kind) for no, kind in enumerate(RULES)]
    places = found.select("row", F.explode(F.concat(*each)).alias("x")).select("row", "x.*")
    upto = F.sum(F.col("gap") + F.col("long")).over(Window.partitionBy("row", "no").orderBy("at"))
    places = places.withColumn("end", upto.cast("long")).where("good").withColumn("start", F.col("end") - F.col("long"))
    kind = F.element_at(F.array(*map(F.lit, RULES)), F.col("no") + 1)
    item = F.struct("start", "no", "end", kind.alias("kind"), (F.col("no") < len(BASE)).alias("is_base"))
    lists = places.groupBy("row").agg(F.sort_array(F.collect_list(item)).alias("every"))  # those of one document
    lists = lists.withColumn("base", F.filter("every", lambda x: x["is_base"]))
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


def op13_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(documents(spark, sf_dir))
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
