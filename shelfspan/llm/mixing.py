"""Mixes of sources by entropy balancing: how often each document is taken so that sources come to target sizes.

Of all rates between 0 and `most` that give each source its target of words, the ones nearest to 1 in relative
entropy are exp(lambda * size / mean size), cut at `most`, with one lambda for each source: the solution of the convex dual,
found by Newton steps that stay in a bracket. A step needs only how many documents of each size a source has, so the
steps run on those counts, each one join and groupBy of all sources at once. Rates are multiples of 2^-20 and sums
are exact decimals, so that lost tasks and reruns give the same rates.

Copies are rates rounded in order of size: a document gets one more copy where the running sum of fractions of its
source passes a half. As fractions carried on never exceed a half, a source's words miss their target by half of its
longest document at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.llm.common import Scratch, table

WEIGHTS = (5, 2, 1)
#: Times that a document is taken, and size of a source's target against its own, at most.
MOST = 3
#: Rates are multiples of 1 / UNIT.
UNIT = 1 << 20
#: A source is done when its words are so near its target, or its bracket can't be parted.
NEAR, STEPS = 1e-7, 200
WORD = "[^\\x20\\x09-\\x0D]+"
EXACT = "decimal(38,0)"
#: monotonically_increasing_id() has a row's place in its partition in so many low bits.
PLACE_BITS = 33


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(values: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """values with long `rank` from 0 in ascending order of the column `by`, nulls last. Sorted by range, so no task has all; of each range one row is summed in a window, so as many as there are partitions."""
    ordered = values.repartitionByRange(F.col(by).asc_nulls_last()).sortWithinPartitions(F.col(by).asc_nulls_last())
    placed = scratch.save(ordered.withColumn("place", F.monotonically_increasing_id()))
    return _ranks(placed, scratch).drop("place", "part")


def _ranks(placed: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds part and rank to rows with their `place` in a sorted table."""
    part = F.shiftright("place", PLACE_BITS).cast("int")
    rows = placed.withColumn("part", part)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    return rows.join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("start")


def targets(sources: DataFrame, weights: Sequence[float], most: float, scratch: Scratch) -> DataFrame:
    """sources (source, source_size) with weight and target: shares of all sizes by weight, at most `most` times the own size; what is above goes to the others by weight, until none is above."""
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights)).cast("int"))
    rows = scratch.save(ranked(sources, "source", scratch).select("source", "source_size", w.alias("weight")))
    level = 0.0
    full = lambda at: F.col("weight") * F.lit(at) >= F.col("source_size") * F.lit(float(most))
    while True:
        # One row: exact whole sums where weights are whole.
        r = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(full(level), F.col("source_size"))).alias("full"), F.sum(F.when(~full(level), F.col("weight"))).alias("open")).first()
        if r["open"] is None:
            break
        higher = (r["all"] - most * (r["full"] or 0)) / r["open"]
        if higher <= level:
            break
        level = higher
    return rows.withColumn("target", F.when(full(level), F.col("source_size") * F.lit(float(most))).otherwise(F.col("weight") * F.lit(level)))


def _rate(lam: Column, size: Column, mean: Column, most: float) -> Column:
    """The rate in units. `lam` is null for a source that takes all as often as it may."""
    tilted = F.least(F.exp(F.least(lam * size / mean, F.lit(60.0))), F.lit(float(most)))
    return F.round(F.coalesce(tilted, F.lit(float(most))) * UNIT).cast("long")


def tilts(counts: DataFrame, goals: DataFrame, most: float, scratch: Scratch) -> DataFrame:
    """goals with `lam` and `mean`: the dual's solution of each source, by Newton steps within a bracket.

    counts (source, size, n) has sizes of 1 and more; goals are sources with a positive target.
    """
    facts = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    share = F.col("target") / F.col("source_size")
    widest = F.col("mean") / F.col("least")
    # At the upper end even the shortest documents are taken as often as may be, at the lower end all at most as often as the source's share.
    state = goals.alias("g").join(facts, goals["source"].eqNullSafe(facts["source"])).select(
        "g.*", "mean", F.lit(0.0).alias("lam"), F.least(F.log(share) * widest, F.lit(-1.0)).alias("low"), (F.lit(math.log(most)) * widest + 1.0).alias("high"), (share >= most * (1 - 1e-12)).alias("done"), (share >= most * (1 - 1e-12)).alias("whole")
    )
    state = scratch.save(state)
    kept = state.columns
    for _ in range(STEPS):
        if state.where("not done").isEmpty():
            break
        size, n = F.col("size"), F.col("n")
        open_ = state.where("not done").select(F.col("source").alias("s"), "mean", "lam")
        at = counts.join(open_, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", _rate(F.col("lam"), size, F.col("mean"), most))
        # Sums of whole numbers, so they don't depend on the order of rows. Documents at the limit don't move.
        taken = at.groupBy("s").agg(
            F.sum((size * n).cast("decimal(22,0)") * F.col("rate").cast("decimal(10,0)")).cast(EXACT).alias("taken"),
            F.coalesce(F.sum(F.when(F.col("rate") < int(most * UNIT), n.cast("decimal(14,0)") * size.cast("decimal(12,0)") * size.cast("decimal(12,0)") * F.col("rate").cast("decimal(10,0)"))), F.lit(0)).cast("double").alias("moving"),
        )
        miss = F.col("taken").cast("double") / UNIT - F.col("target")
        low, high = F.when(miss < 0, F.col("lam")).otherwise(F.col("low")), F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - miss / (F.col("moving") / UNIT / F.col("mean"))
        j = state.join(taken, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumns({"miss": miss, "low2": low, "high2": high, "step": step})
        inside = F.coalesce((F.col("step") > F.col("low2")) & (F.col("step") < F.col("high2")), F.lit(False))
        stop = (F.abs("miss") <= F.col("target") * NEAR) | (F.col("high2") - F.col("low2") <= 1e-12 * F.greatest(F.abs("high2"), F.abs("low2")))
        changed = {
            "low": F.when(F.col("done"), F.col("low")).otherwise(F.col("low2")),
            "high": F.when(F.col("done"), F.col("high")).otherwise(F.col("high2")),
            "lam": F.when(F.col("done") | stop, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("low2") + F.col("high2")) / 2),
            "done": F.col("done") | stop,
        }
        state = scratch.save(j.withColumns(changed).select(*kept))
    return state.withColumn("lam", F.when(~F.col("whole"), F.col("lam")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, text: str = "text", source: str = "source", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, then size, source_size, target, rate, copies and taken (copies * size).

    Sources in ascending order of code points, null last, have the given weights in turn. Every row is returned, repeated rows one by one; rows without words (null and
    empty texts too) have rate 1, one copy, and take nothing. A source without words has target 0. An empty table gives an empty one. Kept columns
    travel with the sort, so name the text only where it is wanted. A kept column with the name of a new one is replaced by it.
    The result reads a table in the shared folder.
    """
    spark = docs.sparkSession
    scratch, kept_tables = Scratch(spark), Scratch(spark)
    size = words(F.col(f"`{text}`"))
    narrow = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
    hashed = scratch.save(narrow.withColumns({"h": F.xxhash64("row"), "i": F.xxhash64(F.lit(1), "row")}))
    # Sorted by range over 128 bits of hash too, so that many documents of one source and size are parted.
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("size", "h", "i"))]
    placed = kept_tables.save(hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "i").withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", PLACE_BITS).cast("int"))
    # Documents of one source and size in one range: the rates and the places of these groups are all that the rest needs.
    groups = scratch.save(placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")))
    counts = scratch.save(groups.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")))
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = scratch.save(targets(sources, weights, most, scratch).drop("weight"))
    solved = tilts(counts, goals.where("target > 0"), most, scratch)
    s = solved.select(F.col("source").alias("s"), "lam", "mean")
    rated = groups.join(goals.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g"))).drop("g").join(s, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rate = F.when(F.col("size") == 0, F.lit(UNIT)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), most))
    rated = rated.withColumn("rate", rate.cast("long")).withColumn("rest", F.col("rate") % UNIT)
    # A source's groups in order of size: at most as many as its longest text has words, and the ranges.
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("sum", F.coalesce(F.sum((F.col("rest") * F.col("n")).cast(EXACT)).over(before), F.lit(0).cast(EXACT)))
    rated = kept_tables.save(rated.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), "first", "source_size", "target", "rate", "rest", (F.col("sum") % UNIT).cast("long").alias("sum")))
    scratch.drop()
    j = placed.join(rated, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    upto = lambda k: F.floor((F.col("sum") + F.lit(UNIT // 2) + k * F.col("rest")) / UNIT).cast("long")
    k = F.col("place") - F.col("first")
    copies = F.floor(F.col("rate") / UNIT).cast("long") + upto(k + 1) - upto(k)
    new = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "rate": F.col("rate") / UNIT, "copies": copies.cast("int"), "taken": copies * F.col("size")}
    return j.select(*(F.col(f"row.`{c}`").alias(c) for c in keep if c not in new), *(v.alias(c) for c, v in new.items()))


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")
