"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's rows are dealt by a hash into 256 blocks, which is a random permutation of
blocks. A source's target is met by whole passes over its blocks and by the first blocks of
one more pass; the last of those is cut at a hash that is found digit by digit, so rows are
never sorted as a whole. The block draws of all sources are then split among the output
shards: a binary tree halves the shards, and each node draws how many of its blocks of each
source go left from the multivariate hypergeometric law (one source after another, by
inversion of the exact probabilities). The leaves hold exact quotas; each takes the next
blocks of a source's permutation, so shards are disjoint, and shuffles its rows by a hash.

Defined results: a null text has size 0 and counts as taken by 0 words. Null is a source of
its own, last in order. Rows with the same ``doc_id`` and source are drawn together. Sources
without words have target 0. An empty table gives an empty result. Equal seeds give equal
mixes, whatever the partitions. Other columns stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .frames import join_small, word_count

DIGIT = 8  # bits: 256 blocks of a source, and 256 ranges of a block at each cut
MAX_DIGITS = 7
PART_BYTES = 16 << 20  # of text that a task sorts
SMALL_RANGE = 1_000  # rows of a source among which the last are chosen one by one


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by the order of the sources, repeating
    share: float = 1.5  # of all sizes
    most: float = 2.0  # times a source's size
    shards: int = 16
    seed: int = 4


def targets(sizes: DataFrame, options: MixOptions) -> DataFrame:
    """(source, source_size, target). ``sizes``: a row for each source.

    Targets follow the weights up to ``most`` times a source's size. With the sources in
    order of cap / weight, those up to some place are full and the rest share what is left
    by weight; sums over the ordered table find that place. One row per source is sorted.
    """
    weights = F.array(*[F.lit(float(w)) for w in options.weights])
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(weights, ((F.col("_r") - 1) % len(options.weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(options.most))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_r")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(options.share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return free.select("source", "source_size", F.least("_cap", F.coalesce(first * F.col("_w"), F.col("_cap"))).alias("target"))


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("_h", 64 - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def draw_plan(sized: DataFrame, aims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, last): for each source the whole passes and the hash below which rows are drawn
    once more, and the hashes in the ranges from there on that are drawn besides, in order,
    each if it still fits.

    ``sized``: (source, _h, size). Each digit costs one aggregation of at most 256 rows per
    source over the rows of the range that the cut lies in.
    """
    passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
    state = aims.select(
        "source",
        F.when(F.col("source_size") > 0, passes).otherwise(F.lit(0)).alias("passes"),
        F.when(F.col("source_size") > 0, F.col("target") - passes * F.col("source_size")).otherwise(F.lit(0.0)).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),  # digits fixed so far
    )
    state = written(state, "mix-state")
    for level in range(MAX_DIGITS):
        digits = DIGIT * level
        inside = join_small(sized, state, ["source"], "_h")
        if level:
            inside = inside.where(F.shiftrightunsigned("_h", 64 - digits) == F.col("prefix"))
        counted = inside.where(F.col("rest") > 0).groupBy("source", _digit(level).alias("d")).agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"), F.max("rest").alias("rest"), F.max("prefix").alias("prefix")
        )
        order = Window.partitionBy("source").orderBy("d")
        ranged = counted.withColumn("_to", F.sum("words").over(order)).withColumn("_upto", F.sum("rows").over(order))
        ranged = ranged.withColumn("_beyond", F.col("_to") > F.col("rest"))
        skipped = F.min(F.when(F.col("_beyond"), F.col("_upto") - F.col("rows"))).over(Window.partitionBy("source"))
        cut = ranged.withColumn("_few", F.col("_beyond") & (F.col("_upto") - skipped <= SMALL_RANGE)).where("_beyond").groupBy("source").agg(
            F.min(F.struct("d", "_to", "words", "rows", "rest", "prefix")).alias("c"), F.max(F.when(F.col("_few"), F.col("d"))).alias("e")
        )
        parent = F.col("c.prefix") * (1 << DIGIT)
        step = cut.select(
            F.col("source").alias("_s"),
            (parent + F.col("c.d")).alias("_prefix"),
            (parent + F.coalesce("e", "c.d")).alias("_upper"),
            (F.col("c.rest") - F.col("c._to") + F.col("c.words")).alias("_rest"),
            F.col("c.rows").alias("_rows"),
        )
        state = state.drop("upper").join(step, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "passes",
            F.coalesce("_rest", F.lit(0.0)).alias("rest"),
            F.coalesce("_prefix", F.col("prefix") * (1 << DIGIT)).alias("prefix"),
            F.coalesce("_upper", F.col("prefix") * (1 << DIGIT)).alias("upper"),
            F.coalesce("_rows", F.lit(0)).alias("_rows"),
        )
        state = written(state, "mix-state")
        widest = state.agg(F.max("_rows")).first()[0] or 0
        state = state.drop("_rows")
        if widest <= SMALL_RANGE:
            break
    bits = DIGIT * (level + 1)
    plan = state.withColumn("bits", F.lit(bits))
    near = join_small(sized, plan, ["source"], "_h").where(
        (F.col("rest") > 0) & F.shiftrightunsigned("_h", 64 - bits).between(F.col("prefix"), F.col("upper"))
    )
    # at most SMALL_RANGE rows of a source, or the rows of one hash, which are one entry
    grouped = near.groupBy("source", "_h").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    listed = grouped.groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("_h", "words"))).alias("entries"), F.max("rest").alias("rest")
    )
    start = F.struct(F.col("rest").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    folded = F.aggregate(
        "entries", start,
        lambda s, e: F.when(
            e["words"] <= s["left"],
            F.struct((s["left"] - e["words"]).alias("left"), F.array_append(s["taken"], e["_h"]).alias("taken")),
        ).otherwise(s),
    )
    last = listed.select("source", F.explode(folded["taken"]).alias("_h"))
    return plan, written(last, "mix-last")


def log_steps(big: Column, good: Column, draws: Column, x: Column) -> Column:
    """log P(x + 1) - log P(x) of the hypergeometric law: ``draws`` from ``big``, ``good`` marked."""
    return F.log((good - x) * (draws - x) * F.lit(1.0) / ((x + 1) * (big - good - draws + x + 1)))


def hypergeometric(big: Column, good: Column, draws: Column, unit: Column) -> Column:
    """Number of marked among ``draws`` of ``big``, by inversion at ``unit`` (0 to 1)."""
    low = F.greatest(F.lit(0).cast("long"), draws - (big - good))
    high = F.least(good, draws)
    xs = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
    def step(s: Column, x: Column) -> Column:
        return s["l"] + log_steps(big, good, draws, x)

    # what a pass needs of the pass before is part of its first state, which is computed once
    peak = F.aggregate(
        xs, F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("m")),
        lambda s, x: F.struct(step(s, x).alias("l"), F.greatest(s["m"], step(s, x)).alias("m")),
    )["m"]
    mass = F.aggregate(
        xs, F.struct(F.lit(0.0).alias("l"), peak.alias("m"), F.lit(0.0).alias("t")),
        lambda s, x: F.struct(step(s, x).alias("l"), s["m"].alias("m"), (s["t"] + F.exp(step(s, x) - s["m"])).alias("t")),
    )
    first = F.array(mass)  # the start of the last pass uses it several times
    begin = F.element_at(F.transform(first, lambda m: F.struct(
        F.lit(0.0).alias("l"), m["m"].alias("m"), F.exp(-m["m"]).alias("t"), (unit * (m["t"] + F.exp(-m["m"]))).alias("u"), low.alias("x")
    )), 1)
    return F.aggregate(
        xs, begin,
        lambda s, x: F.struct(
            step(s, x).alias("l"), s["m"].alias("m"),
            (s["t"] + F.exp(step(s, x) - s["m"])).alias("t"), s["u"].alias("u"),
            F.when(s["t"] < s["u"], x + 1).otherwise(s["x"]).alias("x"),
        ),
    )["x"]


def split_quotas(quotas: DataFrame, options: MixOptions) -> DataFrame:
    """(source, shard, quota): blocks of each source for each shard. ``quotas``: (source, blocks).

    A node is a row per source; the draws of a node are made one source after another, so
    the marked, remaining and drawn numbers of a source follow from those before it. As an
    array of a node would grow with the sources, the chain is a fold over the node's row.
    """
    whole = quotas.where(F.col("blocks") > 0).groupBy().agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "blocks"))).alias("q")
    ).select(F.lit(0).alias("shard"), F.lit(options.shards).alias("span"), "q")
    level = 0
    while 1 << level < options.shards:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, e: s + e["blocks"])
        left_span = F.floor((F.col("span") + 1) / 2).cast("int")
        node = whole.withColumn("total", total).withColumn("left_span", left_span)
        node = node.withColumn("left_total", F.floor(F.col("total") * F.col("left_span") / F.col("span")).cast("long"))
        start = F.struct(
            F.col("total").alias("big"), F.col("left_total").alias("draws"), F.array().cast("array<bigint>").alias("out")
        )

        def draw(s: Column, e: Column) -> Column:
            unit = (F.pmod(F.xxhash64(F.col("shard"), F.lit(level), e["source"], F.lit(options.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            got = F.when(s["draws"] > 0, hypergeometric(s["big"], e["blocks"], s["draws"], unit)).otherwise(F.lit(0).cast("long"))
            pair = F.array(got)  # bound once below
            return F.element_at(
                F.transform(pair, lambda x: F.struct((s["big"] - e["blocks"]).alias("big"), (s["draws"] - x).alias("draws"), F.array_append(s["out"], x).alias("out"))),
                1,
            )

        node = node.withColumn("left", F.aggregate("q", start, draw)["out"])
        here = F.zip_with("q", "left", lambda e, x: F.struct(e["none"].alias("none"), e["source"].alias("source"), x.alias("blocks")))
        there = F.zip_with("q", "left", lambda e, x: F.struct(e["none"].alias("none"), e["source"].alias("source"), (e["blocks"] - x).alias("blocks")))
        children = F.array(
            F.struct(F.col("shard"), F.col("left_span").alias("span"), here.alias("q")),
            F.struct((F.col("shard") + F.col("left_span")).alias("shard"), (F.col("span") - F.col("left_span")).alias("span"), there.alias("q")),
        )
        kept = node.where(F.col("span") > 1).select(F.inline(children))
        whole = written(kept.unionByName(node.where(F.col("span") <= 1).select("shard", "span", "q")), "mix-tree")
        level += 1
    return whole.select("shard", F.inline("q")).select("source", "shard", F.col("blocks").alias("quota"))


def cut_block() -> Column:
    """Block of a source in which the last pass is cut; the blocks before it are drawn whole."""
    return F.expr(f"shiftrightunsigned(prefix, bits - {DIGIT})").cast("int")


def assign_blocks(plan: DataFrame, options: MixOptions) -> DataFrame:
    """(source, block, copy, shard): every draw of a whole block with its shard, in a source's order."""
    per = 1 << DIGIT
    quotas = split_quotas(plan.select("source", (F.col("passes") * per + cut_block()).alias("blocks")), options)
    order = Window.partitionBy("source").orderBy("shard")
    begin = F.coalesce(F.sum("quota").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = quotas.withColumn("_from", begin).where(F.col("quota") > 0)
    draws = spans.select("source", "shard", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("quota") - 1)).alias("_at"))
    return draws.select("source", F.pmod("_at", F.lit(per)).cast("int").alias("block"), F.floor(F.col("_at") / per).cast("int").alias("copy"), "shard")


def with_draws(documents: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(doc_id, row, size, source_size, target, draws) of every row: ``row`` holds all its
    columns, ``draws`` is an array of (copy, shard) with one entry for each time the mix takes it."""
    named = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns]
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", F.lit(options.seed)).alias("_h"), F.struct(*named).alias("row"))
    sized = written(rows.select("source", "_h", "size"), "mix-sizes")
    totals = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    aims = written(targets(totals, options), "mix-targets")
    plan, last = draw_plan(sized, aims)
    blocks = written(assign_blocks(plan, options), "mix-blocks")
    picked = blocks.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("_dealt"))
    picked = written(picked.withColumnRenamed("block", "_block"), "mix-picked")
    facts = aims.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    facts = written(facts.select("source", "source_size", "target", F.col("passes").cast("int").alias("_passes"), F.col("prefix").alias("_prefix"), F.col("bits").alias("_bits"), cut_block().alias("_cut")), "mix-facts")
    out = join_small(rows, facts, ["source"], "_h").withColumn("_block", _digit(0))
    out = join_small(out, picked, ["source", "_block"], "_h")
    out = join_small(out, last.withColumn("_last", F.lit(True)), ["source", "_h"], "_h")
    below = (F.col("_block") == F.col("_cut")) & (F.expr("shiftrightunsigned(_h, 64 - _bits)") < F.col("_prefix"))
    none = F.array().cast("array<struct<copy:int,shard:int>>")
    own = F.pmod(F.xxhash64("_h", F.lit(options.seed + 2)), F.lit(options.shards)).cast("int")
    more = F.when(below | F.coalesce("_last", F.lit(False)), F.array(F.struct(F.col("_passes").alias("copy"), own.alias("shard")))).otherwise(none)
    drawn = F.concat(F.coalesce("_dealt", none), more)
    return out.select("doc_id", "row", "_h", "size", "source_size", "target", drawn.alias("draws"))


def mix(documents: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The mix itself: the columns of ``documents``, a row for each draw.

    Rows are dealt by shard, a shard over as many parts as its bytes call for, and shuffled
    inside their part, so a task's share does not grow with the mix.
    """
    total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(options.share * total / (PART_BYTES * options.shards)))
    rows = with_draws(documents, options).select("row", "_h", F.explode("draws").alias("_d"))
    place = F.xxhash64("_h", "_d.copy", F.lit(options.seed + 1))
    rows = rows.select("row", F.col("_d.shard").alias("_shard"), place.alias("_place"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_place", F.lit(options.seed)), F.lit(parts)))
    return rows.repartition(options.shards * parts, "_shard", "_part").sortWithinPartitions("_shard", "_part", "_place").select("row.*")
