"""Benchmark decontamination: which documents contain which short test items.

Documents are partitioned by the size of their shingle set, and the MinHash signature grows with
the size: a set of n shingles is hashed once and cut by the leading bits of the hash into n to 2 n
bins, the least value of each bin being the signature (one-permutation MinHash). An item of q
shingles has its own least values at the resolution of each partition; those it shares with a
document estimate the containment, since a document keeps a contained shingle in its signature
with a probability of at least ``KEPT`` whatever its length. Candidates are the pairs that share as many
values as a contained item does but for one case in a thousand or fewer, and one at least. That is too little
for an item of fewer than ``SHORT`` shingles: those items, and they alone, are looked up at the
finest resolution, at which a signature is the whole set, which finds them exactly. An item of fewer words
than a shingle is one shingle of its own width, looked up among the documents' shingles of that width.
Candidates are verified by exact containment of the shingle strings in the whole text. DataFrame
expressions only.

Defined results: texts are compared in lower case, split at ASCII white space; null or empty texts
contain and are nothing; an item repeated under several ids matches under each; a doc_id repeated by
several rows contains what any of them does; rows without doc_id or item_id can't be reported and are
left out; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, native_words

SHORT, SPARE_BITS, FINEST = 12, 0, 62
#: The least probability that a contained shingle is in both signatures, in the smallest documents; 0.63 in others.
KEPT = 0.56


def _lowered_words(text: Column) -> Column:
    return native_words(F.lower(text))


def _starts(words: Column, width: int) -> Column:
    """Positions (from 0) at which a shingle begins; empty for shorter texts."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def hashed_shingles(words: Column, width: int) -> Column:
    """The sorted distinct 64-bit hashes of the shingles."""
    return F.sort_array(F.array_distinct(F.transform(_starts(words, width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))))


def fewest_hits(shingles: Column, least: float) -> Column:
    """How many values a contained item of that many shingles shares, but for at most one case in a thousand."""
    shared = F.ceil(shingles * least - 1e-9).cast("double")
    return F.greatest(F.lit(1), F.floor(shared * KEPT - 3.3 * F.sqrt(shared * (KEPT * (1 - KEPT)))).cast("int"))


def shingle_strings(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(_starts(words, width), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])))


def _least_of_bins(hashes: Column, bits: Column) -> Column:
    """Of sorted hashes, the first of each run with the same leading bits."""
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, (F.lit(64) - bits).cast("int"))
    return F.filter(hashes, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(hashes, i - 1))))


def _bits(size: Column) -> Column:
    """The size partition: 2 ** bits bins for a set of that size."""
    return (F.ceil(F.log2(F.greatest(size, F.lit(1)).cast("double"))) + SPARE_BITS).cast("int")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, width: int = 5, small_rows: int = 1_000_000) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles, containment of each contained item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    named = benchmark.select(F.col("item_id").cast("long"), _lowered_words(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0")
    named = scratch.write(named, "named")
    items = named.where(F.size("words") >= width).select("item_id", hashed_shingles(F.col("words"), width).alias("hashes"), shingle_strings(F.col("words"), width).alias("shingles")).withColumn("q", F.size("shingles"))
    items = scratch.write(items, "items")
    # the item's own signature: from which partition on a shingle is the least of its bin
    spread = items.select("item_id", "q", "hashes", F.explode(F.sequence(F.lit(SPARE_BITS), F.lit(FINEST))).alias("bits"))
    keys = spread.select("item_id", "q", "bits", F.explode_outer(_least_of_bins(F.col("hashes"), F.col("bits"))).alias("hash")).groupBy("item_id", "q", "hash").agg(F.min("bits").alias("from_bits"))
    keys = scratch.write(keys, "keys")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    # one projection per step: an expression repeated inside a lambda would run once per shingle
    words = texts.select("doc_id", _lowered_words(F.col("text")).alias("words"))
    hashed = words.select("doc_id", hashed_shingles(F.col("words"), width).alias("hashes"))
    sized = hashed.select("doc_id", "hashes", _bits(F.size("hashes")).alias("bits"))
    # explode_outer and coalesce: for plain forms the optimizer infers null filters and pushes them
    # below the projections, where they compute the arrays again
    signed = sized.select("doc_id", "bits", F.explode_outer(_least_of_bins(F.col("hashes"), F.col("bits"))).alias("hash"))
    met = signed.join(broadcast_if_small(keys.where(F.col("q") >= SHORT), small_rows), "hash").where(F.coalesce("bits", F.lit(0)) >= F.col("from_bits")).select("doc_id", "item_id", "q")
    few = keys.where(F.col("q") < SHORT).select("item_id", "q", "hash")
    if not few.isEmpty():
        finest = hashed.select("doc_id", F.explode_outer("hashes").alias("hash"))
        met = met.unionByName(finest.join(broadcast_if_small(few, small_rows), "hash").select("doc_id", "item_id", "q"))
    hits = met.groupBy("doc_id", "item_id", "q").agg(F.count("*").alias("hits"))
    candidates = scratch.write(hits.where(F.col("hits") >= fewest_hits(F.col("q"), least)).select("doc_id", "item_id").distinct(), "candidates")
    ids = candidates.select("doc_id").distinct()
    full = texts.join(broadcast_if_small(ids, small_rows), "doc_id", "left_semi").select("doc_id", _lowered_words(F.col("text")).alias("words")).select("doc_id", shingle_strings(F.col("words"), width).alias("own"))
    pairs = full.join(candidates, "doc_id").join(items.select("item_id", "q", "shingles"), "item_id")
    shared = pairs.select("doc_id", "item_id", F.col("q").alias("item_shingles"), F.size(F.array_intersect("shingles", "own")).alias("shared_shingles"))
    best = shared.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles"))
    # items of fewer words than a shingle: one shingle each, as wide as the item
    tiny = named.where(F.size("words") < width)
    for n in sorted(r[0] for r in tiny.select(F.size("words")).distinct().collect()):  # fewer than ``width`` numbers
        whole = tiny.where(F.size("words") == n).select("item_id", F.concat_ws(" ", "words").alias("own"))
        parts = words.select("doc_id", F.explode_outer(shingle_strings(F.col("words"), n)).alias("own"))
        met = parts.join(broadcast_if_small(whole, small_rows), "own").select("doc_id", "item_id").distinct()
        best = best.unionByName(met.withColumns({"item_shingles": F.lit(1), "shared_shingles": F.lit(1)}))
    return best.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles")).where(F.col("containment") >= least)
