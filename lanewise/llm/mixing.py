"""Mixing sources to target weights by entropy balancing.

Each document i gets a rate r_i, the expected number of its copies. Among all rates of at most
``cap`` whose words add up to their source's target, the ones closest in relative entropy to the
common base rate are exponentially tilted: r_i = min(cap, base * exp(lambda_s * size_i / mean_s)).
The dual has one lambda per source and is solved by Newton steps, kept inside a bracket. A step is
one aggregation over the histogram of sizes; the state is a table with a row per source. Rates
become copies inside small buckets of documents, largest first: each rate is rounded to the side
that keeps the words taken so far closest to the words due, so a bucket ends within about half of
its smallest document.

Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.session import stored

BUCKET_ROWS = 1024


def word_count(text: Column) -> Column:
    """Number of runs without white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``target`` per row of (source, source_size): ``share`` of all sizes, shared by weight.

    Weights go round over the sources by code point, null last. No target exceeds ``cap`` times
    its source's size; what exceeds it is shared again by weight among the others. With sources in
    the order of cap / weight, those before some place are at their cap and the rest have one
    level: the place is the first where that level fits. The table has one row per source.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(every)
    out = out.withColumn("level", (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    out = out.withColumn("place", F.row_number().over(order))
    fits = F.col("level") * F.col("weight") <= F.col("most") * (1 + 1e-12)
    out = out.withColumn("first", F.min(F.when(fits, F.struct("place", "level"))).over(every))
    capped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return out.select(
        "source", "source_size", F.when(capped, F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("first.level"))).alias("target")
    )


def tilt(base: float, cap: float) -> Column:
    """Rate of a document from ``lam``, ``size`` and ``mean``."""
    return F.when(F.col("size") <= 0, F.lit(0.0)).otherwise(
        F.lit(base) * F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap / base))))
    )


def solve(histogram: DataFrame, state: DataFrame, base: float, cap: float, rounds: int = 80) -> DataFrame:
    """``lam`` per source by bracketed Newton steps on the dual.

    ``histogram`` has (source, size, n), ``state`` (source, target, source_size, mean, least). The
    words taken grow with lambda from 0 to ``cap`` times the source's size, so a bracket exists;
    a step that leaves it is replaced by its middle. Sources without words keep lambda 0.
    """
    closed = F.col("mean") / F.col("least")
    state = state.withColumns(
        {
            "low": F.when(F.col("target") > 0, F.least(F.lit(0.0), F.log(F.col("target") / (base * F.col("source_size"))) * closed)).otherwise(F.lit(0.0)),
            "high": F.lit(math.log(cap / base)) * closed,
            "lam": F.lit(0.0),
        }
    ).withColumn("lam", F.when(F.col("target") >= cap * F.col("source_size"), F.col("high")).otherwise(F.col("lam")))
    state = stored(state.withColumn("gap", F.lit(None).cast("double")), "mix-state")
    for _ in range(rounds):
        words = F.col("n") * F.col("size")
        free = F.col("lam") * F.col("size") / F.col("mean") < math.log(cap / base)
        sums = (
            histogram.join(state.select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(
                F.sum(words * tilt(base, cap)).alias("taken"),
                F.sum(F.when(free, words * tilt(base, cap) * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        new = state.drop("gap").join(sums.withColumnRenamed("s", "key"), F.col("source").eqNullSafe(F.col("key")), "left")
        gap = F.coalesce(F.col("taken") - F.col("target"), F.lit(0.0))
        done = F.abs(gap) <= 1e-12 * F.greatest("target", F.lit(1.0))
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > low) & (step < high)
        moved = F.when(done, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
        state = stored(
            new.select(
                "source", "target", "source_size", "mean", "least", low.alias("low"), high.alias("high"),
                moved.alias("lam"), F.when(done, F.lit(0.0)).otherwise(F.least(F.abs(gap) / F.greatest("target", F.lit(1.0)), F.abs(moved - F.col("lam")))).alias("gap"),
            ),
            "mix-state",
        )
        worst = state.agg(F.max("gap")).first()[0]
        if worst is None or worst <= 1e-12:
            break
    return state.withColumn("lam", F.round("lam", 9))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``, ``taken``.

    One row per input row; ``copies`` is at most ``cap`` rounded up and ``taken`` is copies times
    size. Null texts and texts without words have size 0 and no copies. A null source is a source
    of its own, after all others. Rows that repeat an id and text are rounded as separate rows.
    Nothing depends on the order or the partitions of the input, so reruns agree. Other columns
    are ignored, and an empty table gives no rows.
    """
    rows = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.xxhash64(F.col(doc_id), F.col(text)).alias("draw"),
        ),
        "mix-sizes",
    )
    histogram = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    worded = F.when(F.col("size") > 0, F.col("size"))
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum("n").alias("docs"),
        (F.sum(F.col("n") * worded) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean"),
        F.min(worded).cast("double").alias("least"),
    )
    sources = stored(sources, "mix-sources")
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    known = sources.select(F.col("source").alias("s"), "mean", "least")
    state = targets.join(known, F.col("source").eqNullSafe(F.col("s"))).select("source", "target", "source_size", "mean", "least")
    solved = solve(histogram, state, share, cap).select(F.col("source").alias("s"), "target", "source_size", "mean", "lam")
    solved = solved.join(sources.select(F.col("source").alias("t"), "docs"), F.col("s").eqNullSafe(F.col("t"))).drop("t")

    rated = rows.join(solved, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "rate", F.least(F.round(tilt(share, cap), 9), F.lit(float(cap)))
    )
    bucket = F.pmod(F.xxhash64("doc_id", "draw"), F.ceil(F.col("docs") / BUCKET_ROWS))
    item = F.struct((-F.col("size")).alias("order"), "draw", "doc_id", "size", "rate")
    groups = rated.groupBy("source", bucket.alias("bucket"), "source_size", "target").agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )

    def rounded(state: Column, x: Column) -> Column:
        due = state["due"] + x["rate"] * x["size"]
        low = F.floor(x["rate"])
        up = (x["rate"] > low) & (due - low * x["size"] > x["size"] / 2)
        copies = (low + up.cast("long")).cast("long")
        return F.struct((due - copies * x["size"]).alias("due"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("due"), F.expr("cast(array() as array<bigint>)").alias("copies"))
    copies = F.aggregate("items", start, rounded, lambda s: s["copies"])
    out = groups.withColumn("copies", copies).select(
        "source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("row")
    )
    return out.select(
        "row.items.doc_id", "source", "row.items.size", F.col("source_size").cast("long").alias("source_size"), "target",
        "row.items.rate", "row.copies", (F.col("row.copies") * F.col("row.items.size")).alias("taken"),
    )
