"""Mixing sources to target weights (operator 3), DataFrame operations only.

Temperature mixing: source token shares p are raised to an exponent a in [0, 1]
and normalised.  The exponent is found by bisection: the largest one whose
mixture reaches the target entropy (a share of the entropy of the uniform
mixture), raised where needed until the most repeated source is repeated at
most ``max_repeat`` times as often as the least repeated one.  One aggregate
evaluates five levels of the bisection at once, so six small jobs halve the
bracket thirty times, whatever the number of sources.

The weights become token budgets.  With no budget given, the least one is taken
that plays every source at least once, so nothing is lost.  A source's budget is
played as whole passes and a part of a last one; each pass is a permutation of
the source's 256 blocks (rows are dealt to blocks by a hash of their id) and of
the rows in each block.  The last pass stops at the block and row where the
budget is reached; only that block's rows are ever ranked, so a source that
holds a third of all rows is no single group.

Order keys are MD5 texts of (seed, source, pass, block) and (seed, pass, id); a source plays its passes in turn, and each pass in
the order of (block_key, row_key).  A row's ``place`` is the share of its source's budget that is played before it, so in the
order of places all sources run side by side, and every stretch of the schedule holds them in the target proportions.

Defined cases: null text: no tokens; a null source is a source of its own; a
source without tokens weighs nothing and its rows play once; a null id is dealt
like the text ''; repeated rows share keys and are played or left together; an
empty table gives an empty schedule; extra columns are kept by ``mixed``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actuaria.llm.common import SPACE, read, staged

SEED, SALTS, LEVELS, PASSES, DIGITS = "mix-1", 16, 5, 6, 3
ENTROPY, MAX_REPEAT = 0.9, 4.0


def tokens_of(text: Column) -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^") + "+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Null as a source of its own."""
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source.cast("string")))


def row_keys(id: Column) -> Column:
    return F.coalesce(id.cast("string"), F.lit(""))


def block_of(id: Column) -> Column:
    """One of 256 blocks, as two hex digits."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(SEED), row_keys(id)).cast("binary")), 1, 2)


def block_key(source: Column, play: Column, block: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), source, play, block).cast("binary"))


def row_key(play: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), play, row_keys(id)).cast("binary"))


def bisect_exponent(sources: DataFrame, keeps, low: float = 0.0, high: float = 1.0) -> float:
    """Largest exponent in [low, high] at which ``keeps`` holds (it holds below and fails above).

    ``keeps(sums, a)`` gets ln Z(a) = ln sum p^a and S(a) = sum p^a ln p."""
    steps = (1 << LEVELS) - 1
    for _ in range(PASSES):
        at = [low + (high - low) * (i + 1) / (steps + 1) for i in range(steps)]
        p = F.col("share")
        row = sources.agg(*(F.sum(F.pow(p, F.lit(a))).alias(f"z{i}") for i, a in enumerate(at)),
                          *(F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}") for i, a in enumerate(at))).first()
        # walk the five levels of the bisection that this pass has evaluated
        lo, hi = -1, steps
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if keeps((row[f"z{mid}"], row[f"s{mid}"]), at[mid]) else (lo, mid)
        low, high = (at[lo] if lo >= 0 else low), (at[hi] if hi < steps else high)
    return low


def entropy(sums: tuple[float, float], a: float) -> float:
    z, s = sums
    return math.log(z) - a * s / z


def exponent(sources: DataFrame, entropy_share: float, max_repeat: float) -> float:
    """Exponent of the mixture over (source, tokens, share) with tokens > 0."""
    row = sources.agg(F.count(F.lit(1)).alias("n"), F.max("share").alias("hi"), F.min("share").alias("lo"),
                      F.sum(-F.col("share") * F.log("share")).alias("h")).first()
    if not row["n"] or row["n"] == 1:
        return 1.0
    target = entropy_share * math.log(row["n"])
    a = 1.0 if row["h"] >= target else bisect_exponent(sources, lambda s, x: entropy(s, x) >= target)
    spread = math.log(row["hi"] / row["lo"])
    limit = math.log(max_repeat)
    if (1 - a) * spread > limit:  # too much repetition: the least exponent within the limit
        a = bisect_exponent(sources, lambda _, x: (1 - x) * spread > limit, low=a)
    return round(a, 6)


def weights(rows: DataFrame, entropy_share: float = ENTROPY, max_repeat: float = MAX_REPEAT,
            budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, budget, passes, rest): how often each source of (source, n_tokens) is played.

    passes: whole plays; rest: tokens of the last, partial play."""
    totals = staged(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "mix-sources")
    real = totals.filter(F.col("tokens") > 0)
    whole = real.agg(F.sum("tokens")).first()[0]
    if not whole:
        return totals.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"),
                             F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("rest"))
    a = exponent(real.withColumn("share", F.col("tokens") / whole), entropy_share, max_repeat)
    most, z = real.agg(F.max("tokens"), F.sum(F.pow(F.col("tokens") / whole, F.lit(a)))).first()
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / whole, F.lit(a)) / z).otherwise(0.0)
    # the largest source has the least repetition; played once it fixes the whole budget
    fixed = budget if budget is not None else most / ((most / whole) ** a / z)
    own = F.round(weight * fixed).cast("long")
    own = F.greatest(own, F.col("tokens")) if budget is None else own
    out = totals.select("source", "tokens", F.round(weight, 9).alias("weight"), own.alias("budget"))
    some = F.col("tokens") > 0
    return out.select("*", F.when(some, F.expr("budget div tokens")).otherwise(1).alias("passes"),
                      F.when(some, F.expr("budget % tokens")).otherwise(0).alias("rest"))


def plan(rows: DataFrame, **targets) -> DataFrame:
    """One row per source of (id, source, n_tokens): weights, and where its last play stops (cut_block, cut_row)."""
    sources = staged(weights(rows, **targets), "mix-weights")
    last = rows.withColumn("block", block_of(F.col("id")))
    blocks = (last.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
              .join(sources.select("source", "passes", "rest"), "source")
              .withColumn("key", block_key(F.col("source"), F.col("passes"), F.col("block"))))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    # the last play's blocks in order (at most 256 a source); the one that reaches the budget is cut
    cut = (blocks.withColumn("upto", F.sum("n").over(run))
           .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")) & (F.col("rest") > 0))
           .select("source", "block", F.col("key").alias("cut_block"), "passes",
                   (F.col("rest") - F.col("upto") + F.col("n")).alias("left")))
    cut = staged(cut.groupBy("source").agg(F.min_by(F.struct("block", "cut_block", "passes", "left"), "cut_block")
                                           .alias("c")).select("source", "c.*"), "mix-cuts")
    inside = (last.join(cut, ["source", "block"]).withColumn("key", row_key(F.col("passes"), F.col("id")))
              .groupBy("source", "key", "cut_block", "left").agg(F.sum("n_tokens").alias("n"))
              .withColumn("part", F.substring("key", 1, DIGITS)))
    # the part of the cut block in which the budget is reached, by the first digits of the rows' keys; only that part is ranked
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (inside.groupBy("source", "part").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
             .withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0))).filter(F.col("before") < F.col("left"))
             .groupBy("source").agg(F.max(F.struct("part", "before")).alias("p")).select("source", "p.*"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    stop = (inside.join(parts, ["source", "part"])
            .withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
            .filter(F.col("before") < F.col("left")).groupBy("source", "cut_block").agg(F.max("key").alias("cut_row")))
    return staged(sources.join(stop, "source", "left"), "mix-plan")


def block_places(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(source, play, block, first, size): the share of the source's budget before each block of each play, and the block's."""
    blocks = rows.groupBy("source", block_of(F.col("id")).alias("block")).agg(F.sum("n_tokens").alias("n"))
    plays = blocks.join(made.select("source", "tokens", "passes", "budget"), "source").withColumn(
        "play", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
    run = Window.partitionBy("source", "play").orderBy(block_key(F.col("source"), F.col("play"), F.col("block"))).rowsBetween(
        Window.unboundedPreceding, -1)  # at most 256 blocks
    whole = F.greatest("budget", F.lit(1))
    return plays.select("source", "play", "block", ((F.col("play") * F.col("tokens") + F.coalesce(F.sum("n").over(run), F.lit(0)))
                                                    / whole).alias("first"), (F.col("n") / whole).alias("size"))


def realised(rows: DataFrame, made: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with (id, source) repeated as planned, plus weight, play, block, block_key, row_key and place.

    The plan has one row per source; salted, so that no source is a hot join key where it is too large to broadcast."""
    salted = made.select("source", "weight", "passes", "cut_block", "cut_row",
                         F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    last = F.col("passes")
    joined = (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
              .join(salted, ["source", "salt"]).drop("salt").withColumn("block", block_of(F.col("id"))))
    key = block_key(F.col("source"), last, F.col("block"))
    extra = F.coalesce((key < F.col("cut_block")) | (
        (key == F.col("cut_block")) & (row_key(last, F.col("id")) <= F.col("cut_row"))), F.lit(False))
    plays = joined.withColumn("plays", last + extra.cast("long")).filter(F.col("plays") > 0)
    played = plays.withColumn("play", F.explode(F.sequence(F.lit(0).cast("long"), F.col("plays") - 1)))
    played = played.join(places, ["source", "play", "block"]).withColumn("row_key", row_key(F.col("play"), F.col("id")))
    share = F.conv(F.substring("row_key", 1, 8), 16, 10).cast("double") / (1 << 32)  # of the block's rows, before it
    return played.withColumns({
        "block_key": block_key(F.col("source"), F.col("play"), F.col("block")),
        "place": F.col("first") + F.col("size") * share}).drop("passes", "cut_block", "cut_row", "plays", "first", "size")


def counted(docs: DataFrame) -> DataFrame:
    """(id, source, n_tokens) of every document, staged: the texts are read once."""
    return staged(docs.select(docs["doc_id"].alias("id"), source_key(docs["source"]).alias("source"),
                              tokens_of(docs["text"]).alias("n_tokens")), "mix-tokens")


def mixed(docs: DataFrame, **targets) -> DataFrame:
    """The documents, each as often as the mixture plays it, with their columns, in the order of the schedule."""
    sizes = counted(docs)
    made = plan(sizes, **targets)
    rows = docs.select(docs["doc_id"].alias("id"), source_key(docs["source"]).alias("source"),
                       F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    order = ["place", "source", "row_key"]
    return realised(rows, made, staged(block_places(sizes, made), "mix-places")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc.*")


def mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the schedule of the whole ``documents`` table: one row per play of a document."""
    rows = counted(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    made = plan(rows)
    return realised(rows, made, staged(block_places(rows, made), "mix-places")).select(
        F.col("id").alias("doc_id"), F.when(F.col("source") != "null", F.substring("source", 2, 1 << 30)).alias("source"),
        "n_tokens", "weight", "play", "block", "block_key", "row_key", "place")
