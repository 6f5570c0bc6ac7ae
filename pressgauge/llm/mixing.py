"""Mixing sources to target weights, in DataFrame operations only.

1. Each source's words, in order of doc_id, are packed into blocks of a fixed length. A large source
   is dealt into lanes first, so that no task orders a whole source; a lane's last block is shorter.
2. Sources share out the mix by weight. No source may give more than `most` times what it has; what
   it can't give is shared by weight among the others until none is above.
3. Every output shard draws how many blocks it takes from each source. The draws are multinomial,
   conditional on their sums over all shards: slot j of n takes a random place in the j-th of n equal
   parts of the unit interval, and a slot's shard is random. So a source's total is its target to
   within a block, and no source is drawn more often than `most` allows.
4. A source's n-th slot takes the block to which a pseudorandom permutation of its block numbers
   sends n (in further rounds through the source: n modulo the number of blocks). The permutation is
   the swap-or-not shuffle, which works for any number of blocks.
5. Blocks and draws are joined by source and block number.

Everything random is a hash of the seed, so reruns agree. Null text has no words and null sources
form one source, the last. Rows of size 0 are never taken. Repeated rows are rows like others.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressgauge.llm.common import WORD, cut_lineage


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by order of sources, repeating
    share: float = 1.5  # of all words
    most: int = 2  # rounds through a source
    block: int = 64  # words
    lane_rows: int = 2_000  # rows of a lane, about
    shard_blocks: int = 10_000  # blocks of an output shard, about
    rounds: int = 24  # of the shuffle
    seed: int = 20
    long: int = 256  # a row of this part of its source is long


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _unit(*parts: Column) -> Column:
    """A number from 0 up to, not including, 1."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def permute(n: Column, blocks: Column, key: Column, settings: Settings) -> Column:
    """Swap-or-not: in each round a number meets a partner, and one bit of the pair decides whether they swap."""

    def one_round(x: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(settings.seed), key, k), blocks) - x, blocks)
        bit = F.xxhash64(F.lit(settings.seed), key, k, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(settings.rounds)), n.cast("bigint"), one_round)


def _targets(rows: DataFrame, settings: Settings) -> DataFrame:
    """source, source_size, n_rows, target: one row for each source.

    With every source above its limit held to it, the level (words per unit of weight) is the same
    for all others; in order of limit per weight, those held come first.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(settings.weights)
    weight = F.element_at(F.array(*map(F.lit, settings.weights)), (F.pmod(F.row_number().over(by_name) - 1, n) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(settings.most)
    everything = Window.partitionBy()
    before = Window.orderBy(limit / F.col("weight"), "weight", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    held, free = F.coalesce(F.sum(limit).over(before), F.lit(0)), F.sum("weight").over(everything)
    free = free - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if just the sources before this one are held. It is too high for this one until enough
    # are held, and falls as more than those are: the largest level that suits its source is right.
    level = (F.sum("source_size").over(everything) * F.lit(settings.share) - held) / free
    leveled = sources.withColumn("weight", weight).withColumn("__level", level)
    level = F.max(F.when(F.col("__level") * F.col("weight") <= limit, F.col("__level"))).over(everything)
    target = F.least(limit.cast("double"), F.coalesce(level * F.col("weight"), limit.cast("double")))
    return leveled.withColumn("target", target).select("source", "source_size", "n_rows", "target")


def _packed(rows: DataFrame, sources: DataFrame, settings: Settings) -> DataFrame:
    """Rows with their lane and the place of their first word in it. Only numbers are moved."""
    lanes = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / settings.lane_rows)).cast("int")
    lane = F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id", "size"), lanes).cast("int")
    in_lane = Window.partitionBy("source", "lane").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    joined = joined.drop("__source").withColumn("lane", lane)
    return joined.withColumn("start", F.coalesce(F.sum("size").over(in_lane), F.lit(0)))


def _block_numbers(packed: DataFrame, settings: Settings) -> DataFrame:
    """source, lane, first_block (of the source's numbering) and the source's number of blocks."""
    lanes = packed.groupBy("source", "lane").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = F.ceil(F.col("words") / settings.block)
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return (
        lanes.withColumn("first_block", F.coalesce(F.sum(blocks).over(before), F.lit(0)))
        .withColumn("blocks", F.sum(blocks).over(of_source))
        .select("source", "lane", "first_block", "blocks", "source_size", "target")
    )


def _draws(numbers: DataFrame, settings: Settings) -> DataFrame:
    """source, block, shard, times: which blocks each output shard takes."""
    sources = numbers.groupBy("source").agg(*[F.first(c).alias(c) for c in ("blocks", "source_size", "target")])
    # blocks of a source hold source_size / blocks words on average
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.withColumn("wanted", wanted).withColumn("upto", F.sum("wanted").over(upto))
    shares = shares.withColumn("from", F.col("upto") - F.col("wanted"))
    # the slots whose place in their part of the interval falls to this source
    place = lambda slot: slot + _unit(F.lit(settings.seed), F.lit("slot"), slot)
    first = F.floor(F.col("from"))
    first = first + F.when(place(first) < F.col("from"), 1).otherwise(0)
    last = F.floor(F.col("upto"))
    last = last - F.when(place(last) >= F.col("upto"), 1).otherwise(0)
    count = F.least(last - first + 1, F.col("blocks") * F.lit(settings.most))
    slots = shares.agg(F.sum("wanted")).first()[0] or 0
    shares = shares.withColumn("__first", first).withColumn("__count", count).where("__count > 0")
    # runs of slots first, then their slots, so that no single row becomes a whole source; the number of
    # tasks is given, as Spark would merge rows that look few before they are slots
    run = 4_096
    runs = shares.withColumn("__run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__count") - 1) / run).cast("int"))))
    runs = runs.repartition(max(1, math.ceil(slots / (8 * run))), F.xxhash64("source", "__run"))
    n = F.explode(F.sequence(F.col("__run") * F.lit(run).cast("bigint"), F.least(F.col("__run") * F.lit(run).cast("bigint") + (run - 1), F.col("__count") - 1)))
    shards = F.lit(max(1, math.ceil(slots / settings.shard_blocks)))
    runs = runs.withColumn("n", n)
    key = F.xxhash64(F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    return runs.select(
        "source",
        permute(F.pmod(F.col("n"), F.col("blocks")), F.col("blocks"), key, settings).alias("block"),
        F.pmod(F.xxhash64(F.lit(settings.seed), F.lit("shard"), F.col("__first") + F.col("n")), shards).alias("shard"),
    )


def words_taken(docs: DataFrame, settings: Settings = Settings(), *keys: str) -> DataFrame:
    """doc_id, `keys`, size, source, source_size, target, taken, and the row's lane and place in it. One row for each row.

    The texts are read once, for their word counts; from then on only numbers are shuffled.
    """
    rows = cut_lineage(docs.select("doc_id", *keys, F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    sources = _targets(rows, settings)
    packed = cut_lineage(_packed(rows, sources, settings))
    numbers = cut_lineage(_block_numbers(packed, settings))
    drawn = _draws(numbers, settings).groupBy("source", "block").count().withColumnRenamed("count", "times")

    first_of_lane = numbers.select(F.col("source").alias("__source"), F.col("lane").alias("__lane"), "first_block")
    placed = packed.where("size > 0").join(
        first_of_lane, F.col("source").eqNullSafe(F.col("__source")) & (F.col("lane") == F.col("__lane"))
    )
    length = settings.block
    parts = placed.select(
        "source",
        "lane",
        "start",
        "size",
        "first_block",
        F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))).alias("__b"),
    ).select(
        F.col("source").alias("__source"),
        "lane",
        "start",
        (F.col("first_block") + F.col("__b")).alias("__block"),
        (
            F.least(F.col("start") + F.col("size"), (F.col("__b") + 1) * length) - F.greatest(F.col("start"), F.col("__b") * length)
        ).alias("words"),
    )
    # Spark sizes slots by the rows that they are made of, far too low: it must not broadcast them
    taken = (
        parts.join(drawn.hint("merge"), F.col("__source").eqNullSafe(F.col("source")) & (F.col("__block") == F.col("block")))
        .groupBy("__source", F.col("lane").alias("__lane"), F.col("start").alias("__start"))
        .agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    )
    matches = (
        F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("lane") == F.col("__lane"))
        & (F.col("start") == F.col("__start"))
        & (F.col("size") > 0)
    )
    return packed.join(taken.hint("merge"), matches, "left").select(
        "doc_id",
        *keys,
        "size",
        "source",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "lane",
        "start",
    )


def _same_source(name: str) -> Column:
    return F.col("source").eqNullSafe(F.col(name))


def plan_mix(docs: DataFrame, settings: Settings = Settings(), *keys: str) -> DataFrame:
    """doc_id, `keys`, size, source, source_size, target, taken, and first_taken: how often the row goes into a mix of
    whole documents. One row for each row.

    Copies follow taken / size. Long rows (at most `long` of a source) are rounded one after another by falling
    size, each making up for what those before it are off. What they leave is spread over the ratios of the
    others, whose running sum in order of size is rounded: rounding then errs by half of the longest of them at most.
    """
    plan = cut_lineage(words_taken(docs, settings, *keys))
    columns = [c for c in plan.columns if c not in ("lane", "start")]
    is_long = F.col("size") * settings.long >= F.col("source_size")
    most = F.lit(settings.most)

    listed = F.struct(-F.col("size"), "lane", "start", *columns)
    ordered = plan.where(is_long & (F.col("size") > 0)).groupBy(F.col("source").alias("__source")).agg(F.sort_array(F.collect_list(listed)).alias("rows"))

    def step(state: Column, row: Column) -> Column:
        size, taken, off = row["size"], row["taken"], state["off"]
        low, high = F.greatest(F.ceil(taken / size) - 1, F.lit(0)), F.least(F.floor(taken / size) + 1, most)
        k = F.least(F.greatest(F.round((taken - off) / size).cast("bigint"), low), high).cast("bigint")
        return F.struct((off + k * size - taken).alias("off"), F.concat(state["copies"], F.array(k)).alias("copies"))

    start = F.struct(F.lit(0).cast("bigint").alias("off"), F.array().cast("array<bigint>").alias("copies"))
    rounded = cut_lineage(ordered.select("__source", "rows", F.aggregate("rows", start, step).alias("state")))
    pairs = F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("state.copies").alias("copies")))
    long = rounded.select(pairs.alias("p")).select(*[F.col(f"p.row.{c}").alias(c) for c in columns], F.col("p.copies").alias("first_taken"))

    short = plan.where(~is_long & (F.col("size") > 0))
    sums = short.groupBy(F.col("source").alias("__of")).agg(
        F.sum("taken").alias("__all"), F.sum(F.col("size") * most - F.col("taken")).alias("__room")
    )
    off = sums.join(rounded.select("__source", F.col("state.off").alias("__off")), F.col("__of").eqNullSafe(F.col("__source")), "left").drop("__source")
    ratio = F.col("taken") / F.col("size")
    less = ratio * (1 - F.least(F.lit(1.0), F.col("__off") / F.greatest("__all", F.lit(1))))
    more = ratio + (most - ratio) * F.least(F.lit(1.0), -F.col("__off") / F.greatest("__room", F.lit(1)))
    ratio = F.when(F.col("__off") > 0, less).when(F.col("__off") < 0, more).otherwise(ratio)
    # in whole numbers, so that running sums are exact
    one = 1 << 30
    short = short.join(off, _same_source("__of")).withColumn("__r", F.least(F.floor(ratio * one), most * F.lit(one).cast("bigint")))
    # rows of one size are equal here; the sizes of a source are few, about the root of twice its words at most
    lanes = short.groupBy("source", "size", "lane").agg(F.sum("__r").alias("__sum"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.withColumn("__lanes", F.sum("__sum").over(upto("source", "size").orderBy("lane")))
    sizes = lanes.groupBy(F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.sum("__sum").alias("__sum"))
    sizes = sizes.withColumn("__sizes", F.sum("__sum").over(upto("__source").orderBy(F.desc("__size")))).drop("__sum")
    before = F.coalesce("__lanes", F.lit(0)) + F.coalesce("__sizes", F.lit(0))
    lanes = lanes.join(sizes, _same_source("__source") & (F.col("size") == F.col("__size"))).select(
        F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("lane").alias("__lane"), before.alias("__before")
    )
    of_lane = _same_source("__source") & (F.col("size") == F.col("__size")) & (F.col("lane") == F.col("__lane"))
    inside = F.coalesce(F.sum("__r").over(upto("source", "size", "lane").orderBy("start")), F.lit(0))
    place = F.col("__before") + F.col("__inside") + F.lit(one // 2)
    copies = F.shiftright(place + F.col("__r"), 30) - F.shiftright(place, 30)
    short = short.withColumn("__inside", inside).join(lanes, of_lane).select(*columns, copies.alias("first_taken"))

    none = plan.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("first_taken"))
    return long.unionByName(short).unionByName(none)


def shard_draws(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """shard, source, blocks: what each output shard draws from each source."""
    rows = cut_lineage(docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text")).alias("size")))
    numbers = cut_lineage(_block_numbers(_packed(rows, _targets(rows, settings), settings), settings))
    return _draws(numbers, settings).groupBy("shard", "source").agg(F.count("*").alias("blocks"))
