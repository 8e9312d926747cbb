"""Op 7. Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, sorted_join, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Slots of a schedule at least (unless there are fewer words), words of a slot's block at most, and slots of a source at least.
LEAST_SLOTS, MOST_WORDS, LEAST_EACH = 1 << 16, 512, 256
CELLS = 4096
# (sqrt(5) - 1) / 2 to 60 digits, so that its multiples keep their fractions
_GOLDEN = Fraction(math.isqrt(5 * 10**120) - 10**60, 2 * 10**60)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """A row for each source: source, number (by code point, null last), source_size, target.

    Weights repeat in that order and share all words. A target stops at cap times the source's size; the excess is shared
    again by weight until none is above: target = least(cap * size, level * weight). In order of cap * size / weight, `level`
    is the largest of what would be left for each weight if all sources before were capped.
    sizes: source, size. The windows run over one row for each source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") % len(weights)) + 1).cast("int"))
    numbered = by_source.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    past, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(past), F.lit(0))
    levels = numbered.withColumn("left_each", left / F.sum("weight").over(rest))
    level = F.max("left_each").over(everything)
    return levels.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("weight")).cast("double")).select("source", "number", "source_size", "target")


def in_blocks(targets: DataFrame, block: int) -> DataFrame:
    """targets with blocks, the number of equal parts of each source's stream, and due, the slots that its target comes to.

    A part has at most `block` words, and so few that the target comes to LEAST_EACH slots or the part to one word. Parts of a
    source differ by one word at most, so none of its slots is spent on a rest.
    """
    own = F.greatest(F.lit(1.0), F.least(F.lit(float(block)), F.col("target") / LEAST_EACH))
    cut = targets.withColumn("blocks", F.ceil(F.col("source_size") / own))
    return cut.withColumn("due", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))


def _first_word(block: str) -> Column:
    """Where a block of the source's stream begins. Decimals, as the product may leave 64 bits."""
    return F.expr(f"cast({block} as decimal(19, 0)) * cast(source_size as decimal(19, 0)) div blocks")


def _block_of(word: str) -> Column:
    """The last block that begins at or before a word of the source's stream."""
    return F.expr(f"(cast({word} + 1 as decimal(19, 0)) * cast(blocks as decimal(18, 0)) - 1) div source_size")


def schedule(spark: SparkSession, targets: DataFrame, words: int, block: int, cap: int = 3) -> DataFrame:
    """slot, number (of the source), rank (of the slot among its source's), block (of the source's stream that the slot takes).

    Slot i lies at the fraction of i times the golden ratio, and belongs to the source whose part of the cumulative slots due
    holds that point; so every stretch of the schedule has the mix of the whole. Without words there are no slots. Ranks run over the source's blocks again and
    again; a rank beyond cap rounds is left out. Points find their source by equal cell of a grid, so no list of sources is
    held anywhere, and ranks come from counts of stretches of slots, so a large source is no single task.
    """
    targets = in_blocks(targets, block)
    slots = round(targets.agg(F.sum("due")).first()[0] or 0) if words else 0
    stretch = max(4096, math.isqrt(slots))
    fine, coarse = float(_GOLDEN), float(_GOLDEN * (1 << 20) % 1)  # i = high * 2^20 + low keeps the fraction exact enough for any i
    def part(x: Column) -> Column:
        return x - F.floor(x)

    low, high = F.col("slot") % (1 << 20), F.floor(F.col("slot") / (1 << 20))
    points = spark.range(slots).select(F.col("id").alias("slot")).withColumn("point", part(part(low * fine) + part(high * coarse)))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    upto = F.sum("due").over(Window.orderBy("number"))
    total = F.sum("due").over(Window.partitionBy(F.lit(0)))
    parts = targets.where("target > 0").withColumn("to", upto / total).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("number")), F.lit(0.0)))
    parts = parts.withColumn("to", F.when(F.lead("number").over(Window.orderBy("number")).isNull(), F.lit(2.0)).otherwise(F.col("to")))
    cells = parts.select("number", "from", "to", "blocks", F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS)))).alias("cell"))
    dealt = points.join(cells, "cell").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("to")))
    dealt = dealt.select("slot", "number", F.floor(F.col("slot") / stretch).alias("stretch"), "blocks")
    before = Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("number", "stretch").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("number", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    own = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("slot")) - 1
    ranked = dealt.withColumn("own_rank", own).join(counts, ["number", "stretch"]).withColumn("rank", F.col("own_rank") + F.col("ranks_before"))
    return ranked.where(F.col("rank") < cap * F.col("blocks")).select("slot", "number", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int | None = None, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, source, text).

    size counts words (null text: 0). Each source's documents are shuffled by a hash of seed and doc_id and laid end to end; the
    stream is cut into equal blocks of `block` words or less, and `schedule` takes blocks. taken: the document's words in the blocks taken,
    counted as often as they are taken; at most cap times its size. Null sources form one source, the last. Rows with equal
    doc_id are rows of their own. A document without words takes 0; so does every one if there are no words at all, and an empty table gives no
    rows. A very long document spans many blocks. Other columns are ignored. Reruns agree.

    Texts are read once, for their sizes; what is shuffled is slim. A source's stream is summed in hash ranges, as many as the
    square root of the rows, so a source with a third of all rows is spread like the others.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"))
    slim = written(slim.withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")), "sizes")
    rows, words = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = block or max(1, min(words // LEAST_SLOTS, MOST_WORDS))
    targets = written(in_blocks(source_targets(slim, weights, cap), block), "targets")
    known = slim.join(targets, slim["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    known = known.withColumn("range", F.pmod("place", F.lit(max(1, math.isqrt(rows)))))
    past = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = known.groupBy("number", "range").agg(F.sum("size").alias("n"))
    ranges = ranges.select("number", "range", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("words_before"))
    order = Window.partitionBy("number", "range").orderBy("place", "doc_id", "size")
    placed = known.withColumn("row", F.row_number().over(order)).withColumn("from", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(ranges, ["number", "range"]).withColumn("from", F.col("from") + F.col("words_before")).withColumn("to", F.col("from") + F.col("size"))
    covered = F.when(F.col("size") > 0, F.sequence(_block_of("`from`"), _block_of("(`to` - 1)")))
    parts = placed.withColumn("block", F.explode_outer(covered))
    held = F.least("to", _first_word("(block + 1)")) - F.greatest("from", _first_word("block"))
    times = schedule(spark, targets, words, block, cap).groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = parts.withColumn("held", held).join(times, ["number", "block"], "left")
    key = ["number", "range", "row"]
    out = taken.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.coalesce(F.sum(F.col("held") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix has them: each document as many times as its words are taken, rounded (so up to cap times, or not at all).

    The copies follow the key (doc_id, source, size of the text); rows that agree in all three share their number of copies.
    """
    taken = mix(docs, **how).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    taken = taken.withColumn("copies", F.round(F.col("taken") / (F.col("rows") * F.greatest("size", F.lit(1)))).cast("int"))
    # docs as one column, so that no column of it meets a name of ours
    left = docs.select("doc_id", "source", n_words().alias("words"), F.struct(*docs.columns).alias("row"))
    right = taken.where("copies > 0").select(F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), F.col("size").alias("own_size"), "copies")
    same = left["doc_id"].eqNullSafe(right["own_id"]) & left["source"].eqNullSafe(right["own_source"]) & (left["words"] == right["own_size"])
    return left.join(sorted_join(right), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op7_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")
