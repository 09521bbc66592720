"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Of all rates that give each source its target of words,
with none above `most`, entropy balancing takes those nearest to 1 by entropy: rate = min(most, exp(dual * size /
mean size)), with one dual number a source. The dual problem is convex; Newton steps, kept inside a bracket, solve it
for all sources at once, on a table with one row for each (source, size). Rates become copies by systematic rounding
along the sizes of a source, and the last few words are settled by giving or taking single copies.

Native: DataFrame functions only. The driver holds single numbers. Texts of any length are counted where they lie. Defined results: null texts have size 0; a null
source is a source of its own, the last; equal rows are documents of their own; extra columns are dropped; an empty
table gives an empty result; a source without words has target 0 and takes 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, rank_within, text_of

#: Weights of the sources in order, repeating, and what the mix holds against all words.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, key, size): key is the source with a mark before it, so that nulls compare; null sorts last."""
    source = F.col(source_col).cast("string")
    return df.select(F.col(id_col), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("key"), F.regexp_count(text_of(df, text_col), F.lit(WORD)).cast("long").alias("size"))


def weighed(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds weight by the source's place in code point order, from counts of range partitions: no global sort in one task."""
    ranged = cut(sources.repartitionByRange(8, "key").withColumn("range", F.spark_partition_id()))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1 + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.join(ranges.select("range", before.alias("before")), "range").withColumn("weight", F.get(cycle, (place % len(weights)).cast("int"))).drop("range", "before")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """(key, source_size, weight, target): share of all words by weight, none above most times its source.

    In each round the sources above their limit are set to it and the rest is shared anew; the rounds end when none is.
    """
    base = cut(weighed(sources, weights))
    total = share * (base.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    limit = F.col("source_size") * F.lit(float(most))
    level, fixed = None, F.lit(False)
    while True:
        fixed = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        got = base.agg(F.sum(F.when(fixed, limit)).alias("full"), F.sum(F.when(~fixed, F.col("weight"))).alias("open"), F.count_if(fixed).alias("n")).first()
        if level is not None and got["n"] == known or not got["open"]:
            break
        known, level = got["n"], (total - (got["full"] or 0.0)) / got["open"]
    return base.withColumn("target", F.least(limit, F.col("weight") * F.lit(float(level or 0.0))))


def rate_of(dual, most: float):
    """The tilted rate; at an infinite dual the limit."""
    return F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.least(F.lit(float(most)), F.exp(F.least(dual * F.col("size") / F.col("mean"), F.lit(50.0)))))


def solve(classes: DataFrame, goals: DataFrame, most: float = MOST, close: float = 1e-6) -> DataFrame:
    """(key, dual) with sum of rate * size over a source equal to its target, by bracketed Newton steps.

    classes: (key, size, n). goals: (key, target, source_size, mean). A step is one aggregation over classes. Steps go on
    until every source is close or its bracket is too narrow for a number between (then rounding settles what lacks).
    """
    full = F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12)
    state = cut(goals.select("key", "target", "mean", F.when(full, F.lit(1e9)).otherwise(F.lit(0.0)).alias("dual"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), (full | (F.col("source_size") == 0)).alias("done")))
    while True:
        at = classes.join(state.filter(~F.col("done")), "key")
        rate, z = rate_of(F.col("dual"), most), F.col("size") / F.col("mean")
        words = F.col("n") * F.col("size") * rate
        sums = at.groupBy("key").agg(F.sum(words).alias("got"), F.sum(F.when(rate < most, words * z).otherwise(0.0)).alias("slope"))
        seen = state.join(sums, "key", "left")
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.greatest("low", "dual")).otherwise(F.col("low")), F.when(gap > 0, F.least("high", "dual")).otherwise(F.col("high"))
        seen = seen.withColumns({"low2": low, "high2": high, "newton": F.when(F.col("slope") > 0, F.col("dual") - gap / F.col("slope"))})
        inside = (F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2"))
        # Outside the bracket, or without slope: halve it; while an end is still open, step away from 0.
        middle = F.when((F.col("low2") > -1e6) & (F.col("high2") < 1e6), (F.col("low2") + F.col("high2")) / 2).when(gap > 0, F.least(F.col("dual") * 2, F.col("dual") - 4)).otherwise(F.greatest(F.col("dual") * 2, F.col("dual") + 4))
        narrow = (F.col("high2") - F.col("low2") <= 1e-12 * F.greatest(F.abs("dual"), F.lit(1.0))) | (F.abs("dual") >= 1e6)
        settled = F.col("done") | (F.abs(gap) <= F.greatest(F.col("target") * close, F.lit(0.5))) | narrow
        state = cut(seen.select("key", "target", "mean", F.when(settled, F.col("dual")).when(inside, F.col("newton")).otherwise(middle).alias("dual"), F.col("low2").alias("low"), F.col("high2").alias("high"), settled.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("key", "dual")


def copies(classes: DataFrame, goals: DataFrame, duals: DataFrame, most: int = MOST) -> DataFrame:
    """(key, size, n, copies): how many copies the n documents of a (source, size) have together, 0 to most * n.

    Along a source's sizes the running sum of rates is rounded, so that errors of neighbours cancel. Then what still lacks
    or exceeds is given to or taken from classes from the largest size that fits downwards, until nothing fits; at last
    single copies of the class that brings the words nearest to the target, be it past it, until none does.
    """
    run = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("key").orderBy("size"))
    rated = classes.join(duals.join(goals, "key"), "key").withColumn("rate", rate_of(F.col("dual"), most)).withColumn("run", F.floor(run + 0.5))
    last = F.coalesce(F.lag("run").over(Window.partitionBy("key").orderBy("size")), F.lit(0))
    made = F.greatest(F.lit(0), F.least(F.col("run") - last, F.col("n") * most)).cast("long")
    out = cut(rated.withColumn("copies", made).select("key", "size", "n", "target", "copies"))
    while True:
        gaps = out.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        near = out.join(gaps, "key").withColumn("room", F.when(F.col("gap") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies")))
        near = near.withColumn("fits", (F.col("size") > 0) & (F.col("size") <= F.abs("gap")))
        filled = F.when(F.col("fits"), F.col("room") * F.col("size")).otherwise(0)
        before = F.coalesce(F.sum(filled).over(Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        step = F.when(F.col("fits"), F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("gap") - before) / F.greatest("size", F.lit(1)))))).otherwise(0)
        stepped = cut(near.withColumn("step", step.cast("long")).select("key", "size", "n", "target", "copies", "gap", "step"))
        if stepped.filter("step <> 0").isEmpty():
            break
        out = stepped.withColumn("copies", (F.col("copies") + F.signum("gap") * F.col("step")).cast("long")).select("key", "size", "n", "target", "copies")
    while True:
        gaps = out.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        near = out.join(gaps, "key").withColumn("step", F.signum("gap")).filter("size > 0 and step != 0")
        able = F.when(F.col("step") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0)
        left = F.abs(F.abs(F.col("gap")) - F.col("size"))
        best = near.filter(able & (left < F.abs("gap"))).groupBy("key").agg(F.min_by(F.struct("size", "step"), F.struct(left, F.col("size"))).alias("change"))
        one = cut(best.select("key", F.col("change.size").alias("size"), F.col("change.step").cast("long").alias("step")))
        if one.isEmpty():
            break
        out = cut(out.join(one, ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step"))
    return out


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, most: int = MOST, weights=WEIGHTS) -> DataFrame:
    """(id, size, source_size, target, taken, n_copies, source_taken) of every document; the same at every run.

    source_taken less target is what rounding leaves of a source.
    """
    docs = cut(sized(df, id_col, text_col, source_col))
    classes = cut(docs.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = classes.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    aims = targets(sources.select("key", "source_size", "docs"), share, most, weights)
    goals = cut(aims.withColumn("mean", F.greatest(F.col("source_size") / F.coalesce("docs", F.lit(1)), F.lit(1.0))).select("key", "source_size", "target", "mean"))
    dealt = copies(classes, goals.select("key", "target", "mean"), solve(classes, goals, most), most)
    reached = dealt.groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("source_taken"))
    dealt = dealt.join(goals.select("key", "source_size").join(reached, "key"), "key")

    # A class's copies go to its documents evenly, the remainder to the first by hash: ranks from counts by (class, part).
    ranked = rank_within(docs.withColumn("lot", F.xxhash64(id_col)), ["key", "size"], ["lot", id_col], "rank", buckets=256)
    extra = (F.col("rank") < F.col("copies") % F.col("n")).cast("long")
    n = (F.floor(F.col("copies") / F.col("n")) + extra).cast("long")
    joined = ranked.join(dealt, ["key", "size"])
    return joined.select(id_col, "size", F.col("source_size").cast("long"), F.col("target").cast("double"), (n * F.col("size")).alias("taken"), n.alias("n_copies"), F.col("source_taken").cast("long"))
