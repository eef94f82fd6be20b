"""Mixing sources to target weights by entropy balancing.

Targets: each source's weight times a share of all tokens, held at ``most_copies`` times the
source's size, the excess shared again by weight. Rates: of all rates r with sum(r * size) equal to
the source's target and r at most ``most_copies``, those nearest to 1 in relative entropy,
r = min(most_copies, exp(lambda * size)). Newton's method solves the convex dual for all sources at
once, one aggregation a step, kept inside a bracket where the clipping bends the dual. Rounding:
rows of one source and size are alike, so the rates are first rounded to a number of copies per
(source, size): by the running sum of wanted copies in the order of size, so that what one size gets too
much its neighbours get too little, which leaves at most half the largest size of error; then one copy
more or less of the smallest sizes, as many as fit the error. The copies are dealt over the rows of the
cell in the order of a hash.

Only the (source, size) histogram is iterated over: its rows are bounded by sources times distinct
sizes, not by documents; running sums take one pass over a source's sizes in order, no arrays. Sources are
ranked in ranges, and the level of the targets is found by sharing the excess again, one aggregation a
step. Ranks within a cell are taken in hashed slices of about ``SLICE`` rows, by a hash of id and text, so
a cell with a third of all rows is no single task, rows without id included unless they repeat one text.
Everything is DataFrame expressions.

Defined results: null text has size 0 and is taken 0 times (nothing to repeat); null sources are a
source of their own, sorted last; repeated rows are separate rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, broadcast_if_small, native_words

SLICE = 1024
#: Tables of one row per source are broadcast up to this many rows.
SMALL_ROWS = 1_000_000
STEPS, TOLERANCE = 60, 1e-6


def token_size(text: Column) -> Column:
    """The number of space-separated words."""
    return F.size(native_words(text)).cast("long")


def ranks(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with ``rank``, from 1 in the order of source by code point, null last: ranges ranked by themselves, after those before."""
    order = F.col("source").asc_nulls_last()
    ranged = scratch.write(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted(ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per task
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    table = sources.sparkSession.createDataFrame(starts, "part int, start long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return ranged.withColumn("rank", inside).join(F.broadcast(table), "part").withColumn("rank", F.col("rank") + F.col("start")).drop("part", "start")


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], most_copies: int, scratch: Scratch) -> DataFrame:
    """source, source_size, target: weights' shares, held at the cap, the excess shared again; one row per source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranks(sources.select("source", "source_size"), scratch).withColumns({"weight": weight, "cap": (most_copies * F.col("source_size")).cast("double")})
    rows = scratch.write(ranked.select("source", "source_size", "weight", "cap"), "weights")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:  # the level only rises, and with it the sources held at their caps, until none is added
        full = F.col("cap") <= F.col("weight") * level
        caps, free, n = rows.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == held or not free:
            break
        held, level = n, max(level, (budget - (caps or 0.0)) / free)
    target = F.least(F.col("cap"), F.col("weight") * level) if free else F.col("cap")
    return rows.select("source", "source_size", target.alias("target"))


def balance(cells: DataFrame, goals: DataFrame, scratch: Scratch, most_copies: int) -> DataFrame:
    """source, tilt: the dual solution per source over the cells (source, size, n)."""
    top = float(most_copies)
    rows = cells.where("size > 0").join(broadcast_if_small(goals, SMALL_ROWS), cells["source"].eqNullSafe(goals["source"]), "inner").select(cells["source"], (F.col("size") / F.col("mean")).alias("x"), "n", (F.col("target") / F.col("mean")).alias("want"))
    rows = scratch.write(rows, "dual-rows")
    state = scratch.write(goals.select("source", F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")), "dual-0")
    few = goals.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS  # and so has each state
    for step in range(1, STEPS + 1):
        rate = F.least(F.lit(top), F.exp(F.least(F.col("tilt") * F.col("x"), F.lit(50.0))))
        slope = F.when(rate < top, rate).otherwise(0.0)
        sums = rows.alias("r").join((F.broadcast(state) if few else state).alias("s"), F.expr("r.source <=> s.source")).groupBy("s.source").agg(
            F.first("tilt").alias("tilt"), F.first("low").alias("low"), F.first("high").alias("high"),
            (F.sum(F.col("n") * F.col("x") * rate) - F.first("want")).alias("gap"), F.sum(F.col("n") * F.col("x") * F.col("x") * slope).alias("bend"), F.first("want").alias("want"))
        low = F.when(F.col("gap") < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("gap") > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.when(F.col("bend") > 0, F.col("tilt") - F.col("gap") / F.col("bend"))
        middle = F.when(low < -1e5, F.least(high, F.lit(0.0)) * 4 - 4).when(high > 1e5, F.greatest(low, F.lit(0.0)) * 4 + 4).otherwise((low + high) / 2)
        done = F.abs("gap") <= TOLERANCE * (F.abs("want") + 1)
        following = F.when(done, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise(middle)
        state = scratch.write(sums.select("source", following.alias("tilt"), low.alias("low"), high.alias("high"), (done | (high - low < 1e-12) | (following > 1e4)).alias("done")), f"dual-{step}")
        scratch.drop(f"dual-{step - 1}")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "tilt")


def rounded(rated: DataFrame, most_copies: int) -> DataFrame:
    """Adds to each (source, size, n, target, rate) the whole number of copies ``total`` of its n rows."""
    wanted = F.when(F.col("size") > 0, F.least(F.col("n") * F.col("rate"), (F.col("n") * most_copies).cast("double"))).otherwise(0.0)
    up = Window.partitionBy("source").orderBy("size")
    rows = rated.withColumn("base", F.floor(wanted).cast("long")).withColumn("rest", wanted - F.col("base"))
    rows = rows.withColumn("sum", F.sum("rest").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    # the running sum crosses a half: this size gets the copy
    more = F.floor(F.col("sum") + 0.5) - F.floor(F.col("sum") - F.col("rest") + 0.5)
    total = F.least(F.col("n") * most_copies, F.col("base") + more.cast("long"))
    rows = rows.withColumn("total", F.when(F.col("size") > 0, F.greatest(F.lit(0).cast("long"), total)).otherwise(F.lit(0).cast("long")))
    # what is missing (or over) goes to the smallest sizes that have a copy to give, as long as it lasts
    every = Window.partitionBy("source")
    rows = rows.withColumn("error", F.col("target") - F.sum(F.col("total") * F.col("size")).over(every))
    can = (F.col("size") > 0) & F.when(F.col("error") > 0, F.col("total") < F.col("n") * most_copies).otherwise(F.col("total") > 0)
    rows = rows.withColumn("step", F.when(can, F.col("size")).otherwise(F.lit(0)))
    spent = F.sum("step").over(up.rowsBetween(Window.unboundedPreceding, 0))
    change = F.when((F.col("step") > 0) & (spent <= F.abs("error") + F.col("step") / 2), F.signum("error").cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("change", change).select("source", "target", "source_size", "size", "n", "rate", (F.col("total") + F.col("change")).alias("total"))


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_copies: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of each row of docs (doc_id, text, source)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.write(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), token_size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(5)).alias("mark")), "sized")
    cells = scratch.write(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    goals = targets(totals.select("source", "source_size"), share, weights, most_copies, scratch)
    g, t = goals.alias("g"), totals.alias("t")
    mean = F.greatest(F.col("t.source_size") / F.col("documents"), F.lit(1e-9))
    goals = scratch.write(g.join(t, F.expr("g.source <=> t.source")).select("g.source", "g.source_size", "target", mean.alias("mean")), "goals")
    # a source without words has no tilt, but its rows are returned all the same
    tilts = balance(cells, goals, scratch, most_copies)
    c, s, w = cells.alias("c"), tilts.alias("s"), goals.alias("w")
    rate = F.when(F.col("target") >= most_copies * F.col("source_size"), F.lit(float(most_copies))).otherwise(F.least(F.lit(float(most_copies)), F.exp(F.least(F.coalesce("tilt", F.lit(0.0)) * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = c.join(broadcast_if_small(w, SMALL_ROWS), F.expr("c.source <=> w.source")).join(broadcast_if_small(s, SMALL_ROWS), F.expr("c.source <=> s.source"), "left").select("c.source", "size", "n", "source_size", "target", rate.alias("rate"))
    whole = scratch.write(rounded(scratch.write(rated, "rated"), most_copies), "whole")
    # the rank of a row in its cell: slices of the hash range, an offset per slice, a rank per slice
    d, h = sized.alias("d"), whole.alias("h")
    mark = F.col("d.mark")
    slices = F.ceil(F.col("n") / SLICE)
    placed = d.join(h, F.expr("d.source <=> h.source and d.size = h.size")).select("d.doc_id", "d.source", "d.size", "source_size", "target", "n", "rate", "total", "mark", F.pmod(mark, slices).cast("int").alias("slice"))
    placed = scratch.write(placed, "placed")
    counts = placed.where(F.col("n") > SLICE).groupBy("source", "size", "slice").agg(F.count("*").alias("k"))
    order = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "size", "slice", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("offset"))
    p, o = placed.alias("p"), offsets.alias("o")
    inside = F.row_number().over(Window.partitionBy("p.source", "p.size", "p.slice").orderBy("mark", "doc_id"))
    ranked = p.join(o, F.expr("p.source <=> o.source and p.size = o.size and p.slice = o.slice"), "left").select("doc_id", "p.source", "p.size", "source_size", "target", "n", "rate", "total", (inside + F.coalesce("offset", F.lit(0))).alias("rank"))
    copies = (F.floor(F.col("total") / F.col("n")) + (F.col("rank") <= F.pmod(F.col("total"), F.col("n"))).cast("long")).cast("long")
    return ranked.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


__all__ = ["SEPARATORS", "balance", "mix", "targets", "token_size"]
