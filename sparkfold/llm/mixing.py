"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of N has the van der Corput point of i; the blocks that sources are to give, cumulated, cut [0, 1) into a range for each
source. The k-th slot of a source takes the k-th block of its shuffled documents, and
starts over after the last one. Points are walked in their own order (j = bit-reversed i), where each
source is one range of whole numbers, so slots meet sources by an equi-join on ranges of j. A range may hold
a few points more or less than the source is to give: the last ones take nothing, or slots after N are added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, let, lookup_join

WEIGHTS = (5, 2, 1)
#: Words of a block, and blocks that a small source is cut into at least (of one word at least).
BLOCK_WORDS, SOURCE_BLOCKS = 64, 16
SHARE_NUM, SHARE_DEN = 3, 2
MAX_EPOCHS = 2


def _reversed(x: Column, bits: int) -> Column:
    """The lowest `bits` bits of x, in reverse."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        low = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(low), shift).bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(low))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, src (a key that tells null from any source), size in words, key of the shuffle."""
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2")).alias("src"), size.alias("size"), key.alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS) -> DataFrame:
    """sid, src, source_size, target, width (words of a block), blocks, n (blocks to give), and cum, the blocks that the sources before give.

    One row a source; sources rank by code point with null last and take the weights in turn. The
    targets share SHARE_NUM / SHARE_DEN of all words by weight; none is above MAX_EPOCHS times its
    source. Sources in ascending order of that bound over weight are full as long as the level that the others
    would reach is above it.
    """
    src = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("src")) - 1
    w = src.select((rank).alias("sid"), "src", "source_size", F.array(*map(F.lit, weights))[rank % len(weights)].cast("bigint").alias("w"))
    cap = MAX_EPOCHS * F.col("source_size")
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = w.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(everything) * SHARE_NUM / SHARE_DEN).withColumn("all_w", F.sum("w").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("full", F.col("level") * F.col("w") > F.col("cap"))
    s = s.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "sid", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w")))
    size = F.col("source_size")
    s = s.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(size / SOURCE_BLOCKS))).cast("bigint")).withColumn("blocks", F.ceil(size / F.col("width")).cast("bigint"))
    whole = F.floor(F.col("target") / size).cast("bigint")  # the last block of a round may be short
    rest = F.round((F.col("target") - whole * size) / F.col("width")).cast("bigint")
    s = s.withColumn("n", F.when(size > 0, F.least(whole * F.col("blocks") + F.least(rest, F.col("blocks")), MAX_EPOCHS * F.col("blocks"))).otherwise(F.lit(0)).cast("bigint"))
    return s.withColumn("cum", F.sum("n").over(everything.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).select("sid", "src", "source_size", "target", "width", "blocks", "n", "cum")


def schedule(sources: DataFrame) -> DataFrame:
    """sid, slot, block, epoch: which block of which source each slot takes, in slot order; a source has exactly its n slots.

    Slots are ranked within a source in two steps, counts of runs of slots and then places
    in a run, so a source with most of the slots is spread over about the square root of their number of
    runs. `sources` is cut.
    """
    spark = sources.sparkSession
    n = max(1, sources.agg(F.max(F.col("cum") + F.col("n"))).first()[0] or 0)
    bits = max(1, math.ceil(math.log2(n)) if n > 1 else 1)
    points = 1 << bits
    edge = lambda c: F.ceil(c.cast("decimal(38,0)") * points / F.lit(n).cast("decimal(20,0)")).cast("bigint")
    scale = max(bits - 12, 0)
    ranges = sources.where("n > 0").select("sid", F.col("n").alias("wanted"), "blocks", edge(F.col("cum")).alias("j0"), edge(F.col("cum") + F.col("n")).alias("j1"))
    ranges = ranges.where("j1 > j0").withColumn("run", F.explode(F.sequence(F.shiftright("j0", scale), F.shiftright(F.col("j1") - 1, scale))))
    j = spark.range(points).select(F.col("id").alias("j"), F.shiftright("id", scale).alias("run"))
    slots = lookup_join(j, ranges, ["run"], F.col("j"), "inner").where("j >= j0 AND j < j1")
    slots = slots.select("sid", "blocks", "wanted", _reversed(F.col("j"), bits).alias("slot")).where(F.col("slot") < n)
    slots = slots.withColumn("stretch", F.shiftright("slot", bits // 2))
    counts = slots.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    first = counts.select("sid", "stretch", (F.sum("n").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("n")).alias("first"))
    ranked = slots.withColumn("k", F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1)
    k = F.col("first") + F.col("k")
    in_range = ranked.join(first, ["sid", "stretch"]).where(k < F.col("wanted")).select("sid", "slot", k.alias("k"), "blocks")
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = sources.where("n > 0").select("sid", F.col("n").alias("wanted"), "blocks").join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < wanted")
    added = short.withColumn("k", F.explode(F.sequence("have", F.col("wanted") - 1)))  # a few a source
    added = added.select("sid", (F.row_number().over(Window.orderBy("k", "sid")) - 1 + n).cast("bigint").alias("slot"), "k", "blocks")
    return in_range.union(added).select("sid", "slot", (F.col("k") % F.col("blocks")).alias("block"), F.floor(F.col("k") / F.col("blocks")).cast("int").alias("epoch"))


def places(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of sizes with sid, source_size, target and start: words of the source's documents before, in shuffled order."""
    n = sizes.count()
    bits = math.ceil(math.log2(n + 1) / 2)
    keyed = lookup_join(sizes, sources.select("src", "sid", "source_size", "target", "width", "blocks"), ["src"], F.col("key"), "inner").withColumn("stretch", F.shiftright("key", 60 - bits))
    sums = keyed.groupBy("sid", "stretch").agg(F.sum("size").alias("words"))
    first = sums.select("sid", "stretch", (F.sum("words").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("words")).alias("first"))
    inside = Window.partitionBy("sid", "stretch").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.withColumn("upto", F.sum("size").over(inside)).join(first, ["sid", "stretch"]).withColumn("start", F.col("first") + F.col("upto") - F.col("size")).drop("upto", "first", "stretch", "key", "src")


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    A null source is a source of its own; null and empty texts have size 0 and take nothing; rows with
    equal doc_ids are documents of their own. A source's blocks have `block` words, or a SOURCE_BLOCKS-th of a smaller
    source (one word at least), and its taken words are within about one block of its target. Each block of a source is taken at most MAX_EPOCHS
    times, so no document is above that many times its size. The shuffle and the slots depend on ids and sizes
    alone: reruns agree.
    """
    sizes = cut(sized(docs))
    sources = cut(targets(sizes, block=block))
    uses = schedule(sources).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    placed = places(sizes, sources)
    end, width = F.col("start") + F.col("size"), F.col("width")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))))
    overlap = F.least(end, (F.col("block") + 1) * width) - F.greatest(F.col("start"), F.col("block") * width)
    took = parts.withColumn("overlap", overlap).join(uses, ["sid", "block"], "left")
    took = took.groupBy("sid", "doc_id", "start", "size", "source_size", "target").agg(F.sum(F.col("overlap") * F.coalesce("uses", F.lit(0))).alias("taken"))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return took.select(out).union(placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).select(out))


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: the columns of docs, one row for each document and round that takes words of it.

    The text is the whole text where all of its words are taken, else its beginning up to the last word taken. n_chars, where
    docs has it, follows the text. A document with no words taken has no row.
    """
    sizes = cut(sized(docs))
    sources = cut(targets(sizes, block=block))
    used = schedule(sources).groupBy("sid").agg(F.count("*").alias("slots"))
    placed = places(sizes, sources).join(F.broadcast(used) if used.count() <= 100_000 else used, "sid").where("size > 0")
    taken = F.least(F.greatest((F.col("slots") - F.col("epoch") * F.col("blocks")) * F.col("width") - F.col("start"), F.lit(0)), F.col("size")).cast("bigint")
    rounds = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1)))).withColumn("taken", taken).where("taken > 0")
    # rows that share doc_id and size are told apart by their rank on both sides
    keys = [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id"), F.col("size").alias("_size")]
    each = rounds.groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("epoch", "taken")))["taken"].alias("takes"))
    plan = each.groupBy("_id", "_size").agg(F.sort_array(F.collect_list(F.struct("start", "takes")))["takes"].alias("_takes"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    same = docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_size", F.size(words).cast("bigint"))
    same = same.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_size").orderBy("text")) - 1)
    copies = same.join(plan, ["_id", "_size"]).withColumn("_taken", F.explode(F.get("_takes", F.col("_k"))))
    text = F.when(F.col("_taken") >= F.col("_size"), F.col("text")).otherwise(let(F.split("text", WORD, -1), lambda blanks: F.array_join(F.transform(F.slice(words, F.lit(1), F.col("_taken").cast("int")), lambda w, i: F.concat(F.get(blanks, i), w)), "")))
    out = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(docs.columns)
