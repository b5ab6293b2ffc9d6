"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document has a rate, its expected number of copies, as near to 1 as the token constraints allow in relative entropy: the dual has
one multiplier a source, and the rates are ``least(most, exp(multiplier * size / mean size))``. Newton steps on the dual are sums over a
histogram of sizes, all sources at once. Rates become copies by systematic rounding along documents in order of size, so a source
misses its target by one document at most, and repairs of single documents bring it closer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmarch.session import cut, discard

STEPS = 80
BUCKETS = 64
REPAIRS = 4
#: Tables of a few rows a source are broadcast up to so many sources, so no source is one task; tables of documents never are.
FEW = 10_000
CLOSE = 1e-8


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``, one row a source.

    Sources by code point, null last, get the repeating ``weights``; targets share the sum of all sizes and stop at ``most`` times their
    source's size, the excess going to the others by weight until none is above. In order of size per weight the sources that stop come
    first; the first that does not stop fixes what a unit of weight is worth.
    """
    name = [F.col("source").isNull(), F.col("source")]
    place = F.row_number().over(Window.orderBy(*name)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), *name)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    unit = (F.sum("source_size").over(whole) - stopped) / rest
    fits = F.col("unit") * F.col("weight") <= most * F.col("source_size")
    return (
        totals.withColumn("weight", weight).withColumn("unit", unit)
        .withColumn("unit", F.first(F.when(fits, F.col("unit")), ignorenulls=True).over(whole))
        .select("source", "source_size", F.least(most * F.col("source_size"), F.col("unit") * F.col("weight")).cast("double").alias("target"))
    )


def _rate(most: float) -> Column:
    tilted = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), tilted))


def balance(histogram: DataFrame, aims: DataFrame, most: float = 3.0) -> DataFrame:
    """Multipliers: ``histogram(source_key, size, n)`` and ``aims(source_key, mean, full, target, source_size)`` to ``aims`` with ``multiplier``.

    A bracket around each root narrows with every step; a Newton step that would leave it, or leap, is replaced by halving or doubling.
    Sources marked ``full`` take the limit everywhere and need no step.
    """
    nothing = F.lit(None).cast("double")
    state = cut(aims.withColumns({"multiplier": F.lit(0.0), "low": nothing, "high": nothing, "done": F.col("full")}))
    for _ in range(STEPS):
        rate = _rate(most)
        slope = F.when(rate < most, rate * F.col("size") * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            histogram.join(state.filter("not done").select("source_key", "mean", "full", "multiplier"), "source_key").groupBy("source_key")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * slope).alias("slope"))
        )
        at, miss, low, high = F.col("multiplier"), F.col("got") - F.col("target"), F.col("low"), F.col("high")
        newton = at - miss / F.when(F.col("slope") > 0, F.col("slope"))
        sound = (F.abs(newton) <= 4 * F.abs(at) + 2) & (low.isNull() | (newton > low)) & (high.isNull() | (newton < high))
        away = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(low.isNull(), F.least(F.lit(-1.0), at * 2)).otherwise(F.greatest(F.lit(1.0), at * 2))
        found = F.col("done") | F.col("got").isNull() | (F.abs(miss) <= CLOSE * F.col("source_size"))
        fresh = cut(
            state.join(sums, "source_key", "left")
            .withColumns({"low": F.when(miss < 0, at).otherwise(low), "high": F.when(miss >= 0, at).otherwise(high), "done": found})
            .withColumn("multiplier", F.when(F.col("done"), at).when(F.coalesce(sound, F.lit(False)), newton).otherwise(away))
            .drop("got", "slope")
        )
        discard(state)
        state = fresh
        if state.filter("not done").isEmpty():
            break
    return state


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Copies of every row: ``row`` (a number for id, text and source), ``doc_id, size, source_size, target, copies, taken``.

    Sizes count runs of characters outside space and U+0009..U+000D; null and blank texts have size 0 and are copied once. Null sources
    form one source, ordered last. Rows of equal id, source and size are alike and may get one another's copies; nothing else depends on
    the order of rows, so reruns agree. An empty table gives no rows; other columns are not read.
    """
    limit = float(most)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    sized = cut(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("source_key"), size.alias("size"), F.xxhash64(doc_id, text, source).alias("row"))
        .withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)))
    )
    fine = cut(sized.groupBy("source_key", "size", "bucket").agg(F.count("*").alias("n"), F.min("source").alias("source")))
    words = F.col("n") * F.col("size")
    totals = fine.groupBy("source_key").agg(
        F.min("source").alias("source"), F.sum(words).alias("source_size"), (F.sum(words) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean")
    )
    aimed = targets(totals.select("source", "source_size"), weights, limit).select(F.col("source").alias("named"), "target")
    aims = cut(
        totals.join(aimed, F.col("source").eqNullSafe(F.col("named")))
        .select("source_key", "source_size", "mean", "target", (F.col("target") >= limit * F.col("source_size")).alias("full"))
    )
    by_source = "broadcast" if aims.count() <= FEW else "merge"
    histogram = cut(fine.filter("size > 0").groupBy("source_key", "size").agg(F.sum("n").alias("n")))
    solved = balance(histogram, aims.filter("source_size > 0"), limit)

    # the i-th document of a source, smallest first, gets floor(sum of rates up to it) less floor(sum of rates before it)
    by_size = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    in_level = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        histogram.join(solved, "source_key").withColumn("rate", _rate(limit))
        .withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0))).select("source_key", "size", "rate", "before")
    )
    parts = fine.select("source_key", "size", "bucket", F.coalesce(F.sum("n").over(in_level), F.lit(0)).alias("ahead")).join(levels.hint("merge"), ["source_key", "size"])
    number = F.row_number().over(Window.partitionBy("source_key", "size", "bucket").orderBy("doc_id", "row"))
    start = F.col("before") + (F.col("ahead") + F.col("number") - 1) * F.col("rate") + 0.5
    rounded = F.least(F.lit(most), (F.floor(start + F.col("rate")) - F.floor(start)).cast("int"))
    chosen = cut(
        sized.withColumn("number", number).join(parts.hint("merge"), ["source_key", "size", "bucket"], "left")
        .select("source_key", "doc_id", "row", "size", "bucket", "number", F.coalesce(rounded, F.lit(1)).alias("copies"))
    )
    place = ["source_key", "size", "bucket", "number"]
    for _ in range(REPAIRS):
        gaps = (
            chosen.groupBy("source_key").agg(F.sum(F.col("copies") * F.col("size")).alias("taken")).join(aims, "source_key")
            .select("source_key", (F.col("target") - F.col("taken")).alias("gap"))
        )
        better = F.abs(F.abs(F.col("gap")) - F.col("size"))
        can = (F.col("size") > 0) & (better < F.abs(F.col("gap"))) & F.when(F.col("gap") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        best = (
            chosen.join(gaps.hint(by_source), "source_key").filter(can).groupBy("source_key", F.signum("gap").cast("int").alias("change"))
            .agg(F.min(F.struct(better.alias("off"), "size", "bucket", "number")).alias("b")).select("source_key", "b.size", "b.bucket", "b.number", "change")
        )
        fresh = cut(chosen.join(best.hint(by_source), place, "left").select(*place, "doc_id", "row", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies")))
        discard(chosen)
        chosen = fresh
    for done in (sized, fine, histogram, solved):
        discard(done)
    return chosen.join(aims.hint(by_source), "source_key").select("row", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say, with its own columns and ``copy`` (``mix_copy`` if taken) from 1."""
    mine, own, total, alike, nth, times = (f"__mix_{x}" for x in ("row", "key", "total", "alike", "nth", "times"))
    copies = mix(docs, weights, most).groupBy(F.col("row").alias(own)).agg(F.sum("copies").alias(total), F.count("*").alias(alike))
    marked = docs.withColumn(mine, F.xxhash64("doc_id", "text", "source"))
    joined = marked.join(copies.hint("shuffle_hash"), F.col(mine) == F.col(own))
    single = joined.filter(F.col(alike) == 1).withColumn(times, F.col(total))
    # rows equal in id, text and source share their copies evenly, the first of them taking the remainder
    turn = F.row_number().over(Window.partitionBy(mine).orderBy(mine))
    share = F.floor(F.col(total) / F.col(alike)) + F.when(F.col(nth) <= F.col(total) % F.col(alike), 1).otherwise(0)
    shared = joined.filter(F.col(alike) > 1).withColumn(nth, turn).withColumn(times, share).drop(nth)
    name = "copy" if "copy" not in docs.columns else "mix_copy"
    every = single.unionByName(shared).filter(F.col(times) > 0)
    return every.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(name))
