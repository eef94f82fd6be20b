"""Phone numbers by a landed number plan: the longest prefix decides whether a number can exist.

The plan (prefix, shortest, longest, kind) holds international prefixes without plus and how many digits a
number under them has in all. A number's prefix is found by one equi join per prefix length in the plan, the longest
first; a plan of up to ``SMALL_ROWS`` prefixes is broadcast, a larger one shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 200_000


def international(text: Column, country: str = "7", trunk: str = "8", national: int = 10) -> Column:
    """The digits with their country code: of numbers with plus or 00 as they are, of national ones with trunk digit or bare, by length."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)(доб|ext|x|#).*$", "")
    digits = F.regexp_replace(plain, r"\D", "")
    abroad = F.ltrim(plain).startswith("+")
    return (
        F.when(digits == "", F.lit(None))
        .when(abroad, digits)
        .when(digits.startswith("00"), F.substring(digits, 3, 30))
        .when((F.length(digits) == national + 1) & digits.startswith(trunk), F.concat(F.lit(country), F.substring(digits, 2, 30)))
        .when(F.length(digits) == national, F.concat(F.lit(country), digits))
        .otherwise(digits)
    )


def number_plan(plan: DataFrame) -> DataFrame:
    """One row per prefix; of repeated prefixes the widest bounds and the least kind."""
    rows = plan.where(F.col("prefix").rlike("^[0-9]+$"))
    return rows.groupBy("prefix").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"), F.min("kind").alias("kind"))


def match_plan(rows: DataFrame, digits: str, plan: DataFrame) -> DataFrame:
    """Adds ``plan``: prefix, shortest, longest and kind of the longest prefix of the digits, or null."""
    known = number_plan(plan).withColumn("_n", F.length("prefix"))
    lengths = sorted((r[0] for r in known.select("_n").distinct().collect()), reverse=True)  # E.164 has 15 digits at most
    small = known.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    none = F.lit(None).cast("struct<prefix:string,shortest:int,longest:int,kind:string>")
    out = rows.withColumn("plan", none)
    for n in lengths:
        part = known.where(F.col("_n") == n).select(F.col("prefix").alias("_prefix"), F.struct("prefix", F.col("shortest").cast("int").alias("shortest"), F.col("longest").cast("int").alias("longest"), "kind").alias("_plan"))
        # numbers with a longer match, or none of this length, join on nothing
        key = F.when(F.col("plan").isNull() & (F.length(digits) >= n), F.substring(digits, 1, n))
        out = out.join(F.broadcast(part) if small else part, key == F.col("_prefix"), "left").withColumn("plan", F.coalesce("plan", "_plan")).drop("_prefix", "_plan")
    return out


def normalize_phones(rows: DataFrame, column: str, plan: DataFrame, into: str = "phone", country: str = "7") -> DataFrame:
    """Adds the number as +digits where the plan has its prefix and allows its length, else null."""
    matched = match_plan(rows.withColumn("_digits", international(F.col(column), country)), "_digits", plan)
    valid = F.length("_digits").between(F.col("plan.shortest"), F.col("plan.longest"))
    return matched.withColumn(into, F.when(valid, F.concat(F.lit("+"), F.col("_digits")))).drop("_digits", "plan")
