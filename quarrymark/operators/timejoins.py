"""Joins by time on equal keys only: the last row before, and all intervals around a moment.

No condition but equality reaches the join itself. Hot keys are split by time: a task holds the rows of a
key in one bin, and between bins goes one row per key and bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of bins: each level's are 2 ** _STEP of the one below, up to 2 ** _LEVELS bins.
_STEP, _LEVELS = 4, 44


def _micros(x: Column) -> Column:
    return F.unix_micros(x.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_time: str, right_time: str, values: list[str], bin_seconds: int = 86400, tolerance_seconds: int | None = None) -> DataFrame:
    """Left rows with the values of the last right row of equal keys at or before their time.

    Of right rows of one time the greatest values count. Rows without key or time find nothing and are
    found by none; with a tolerance, right rows older than that aren't taken. The right
    row's time comes as ``matched_at``, null where there is none. Every left row stays, repeats included.
    """
    width = bin_seconds * 1_000_000
    key = lambda side, k: F.struct(*(F.col(pair[k]).alias(f"k{n}") for n, pair in enumerate(on)))
    whole = lambda k, time: F.lit(True) if not on else ~F.exists(F.array(*(F.col(p[k]).isNull() for p in on), F.col(time).isNull()), lambda x: x)
    found = F.struct(_micros(F.col(right_time)).alias("_t"), F.col(right_time).alias("matched_at"), *(F.col(v) for v in values))
    theirs = right.where(whole(1, right_time)).select(key(right, 1).alias("_k"), _micros(F.col(right_time)).alias("_t"), found.alias("_r"))
    theirs = theirs.withColumn("_b", F.floor(F.col("_t") / width))
    ours = left.select(F.struct(*left.columns).alias("_l"), key(left, 0).alias("_k"), _micros(F.col(left_time)).alias("_t"), whole(0, left_time).alias("_whole")).withColumn("_b", F.floor(F.col("_t") / width))
    # the last right row of each bin, carried to the later bins of the key
    last = theirs.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    bins = last.unionByName(ours.where("_whole").select("_k", "_b").distinct().withColumn("_r", F.lit(None).cast(last.schema["_r"].dataType))).groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    before = F.max("_r").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = bins.select("_k", "_b", before.alias("_r")).where("_r is not null").withColumn("_t", (F.col("_b") * width).cast("long"))
    none = F.lit(None).cast(ours.schema["_l"].dataType)
    rows = ours.where("_whole").select("_k", "_b", "_t", "_l", F.lit(None).cast(last.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    for other in (carried, theirs):
        rows = rows.unionByName(other.select("_k", "_b", "_t", none.alias("_l"), "_r", F.lit(0).alias("_side")))
    latest = F.max("_r").over(Window.partitionBy("_k", "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_m", latest).where("_side = 1")
    if tolerance_seconds is not None:
        joined = joined.withColumn("_m", F.when(F.col("_t") - F.col("_m._t") <= tolerance_seconds * 1_000_000, F.col("_m")))
    lost = ours.where("not _whole").select("_l", F.lit(None).cast(last.schema["_r"].dataType).alias("_m"))
    return joined.select("_l", "_m").unionByName(lost).select("_l.*", "_m.matched_at", *(f"_m.{v}" for v in values))


def _cover(first: Column, last: Column) -> Column:
    """Five aligned blocks (level, number) at most that hold the bins from first to last: of the least size of which four reach."""
    many = last - first + 1
    level = F.when(many <= 4, F.lit(0))
    for bits in range(_STEP, _LEVELS + 1, _STEP):
        level = level.when(many <= 4 << bits, F.lit(bits))
    at = lambda x, bits: F.call_function("shiftright", x.cast("long"), bits)
    blocks = lambda bits: F.transform(F.sequence(at(first, bits), at(last, bits)), lambda number: F.struct(bits.alias("level"), number.alias("number")))
    return F.flatten(F.transform(F.array(level), blocks))


def interval_join(points: DataFrame, intervals: DataFrame, on: list[tuple[str, str]], time: str, start: str, end: str, bin_seconds: int = 3600) -> DataFrame:
    """Pairs of points and intervals of equal keys with start <= time < end; columns must be named apart.

    An interval lies in five aligned blocks of one size at most, a point in one block of each size in use, of which
    each is sixteen times the one below; so each pair meets in one block only, and long intervals cost little. The
    blocks reach over an interval by less than nine times its length, which the exact times cut off.
    Rows without key or time, and intervals that end before they begin, meet nothing.
    """
    width = bin_seconds * 1_000_000
    lo, hi = F.floor(_micros(F.col(start)) / width), F.floor((_micros(F.col(end)) - 1) / width)
    cut = intervals.where(F.col(start) < F.col(end)).withColumn("_block", F.explode(_cover(lo, hi))).withColumns({"_level": F.col("_block.level"), "_number": F.col("_block.number")}).drop("_block")
    levels = sorted(r[0] for r in cut.select("_level").distinct().collect())  # a dozen numbers at most
    laid = points.where(F.col(time).isNotNull()).withColumn("_point_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_point_number", F.expr(f"shiftright(cast(floor(unix_micros(cast(`{time}` as timestamp)) / {width}) as bigint), _point_level)"))
    same = (F.col("_point_level") == F.col("_level")) & (F.col("_point_number") == F.col("_number"))
    for ours, theirs in on:
        same = same & (laid[ours] == cut[theirs])
    inside = (F.col(start) <= F.col(time)) & (F.col(time) < F.col(end))
    return laid.join(cut, same).where(inside).drop("_level", "_number", "_point_level", "_point_number")
