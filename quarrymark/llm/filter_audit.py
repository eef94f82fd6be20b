"""Interaction of filters: what each removes first, in vain or alone, in every order of application.

Each document has an incidence mask, bit k set where it fails filter k. The masks of a part (a
source) make a histogram of 32 counts; the histograms of all documents, of those of good quality and
of toxic ones are stacked as rows and multiplied by integer matrices of 32 masks by 600 outcomes
(120 orders of five steps). So the table is read once, and the orders cost nothing per document.

Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 * code
points; D any of ``#$%&*|``; E the text of a smaller doc_id, table-wide. Defined results: a null
text is empty (so it fails A, and E beside a smaller doc_id's empty text); a null source is the
empty one; a null doc_id has no label, is no smaller than another and never fails E; repeated rows
count each, and rows of one doc_id don't fail E for each other; labels may repeat, one of value 1 is
enough; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, join_groups, native_words

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts of one product: 600 rows each.
PARTS = 64
SMALL_ROWS = 500_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def outcome_matrices() -> dict[str, np.ndarray]:
    """32 x 600 integer matrices: what becomes of a mask at each step of each order."""
    steps = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    masks = np.arange(1 << len(FILTERS))
    fails = (masks[:, None, None] >> steps) & 1
    so_far = np.cumsum(fails, axis=2)
    removed = fails * (so_far == 1)
    # by filter over all orders, then laid out by the filter of each order's step
    summed = np.stack([(removed * (steps == f)).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    found = {
        "kept": so_far == 0,
        "removed": removed,
        "redundant": fails * (so_far > 1),
        "unique": (masks[:, None, None] == 1 << steps),
        "shapley": summed[:, steps],
    }
    return {k: v.reshape(len(masks), -1).astype(np.int64) for k, v in found.items()}


def text_mask(text) -> F.Column:
    """Column: the bits of the filters that look at the text alone (A to D)."""
    text = F.coalesce(text, F.lit(""))
    words = native_words(text)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    by_words = F.transform(F.array(words), lambda w: F.when(F.size(w) < 50, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 2).otherwise(0))[0]
    return by_words + F.when(100 * capitals.cast("long") > 5 * F.length(text).cast("long"), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def masks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part, mask and n (equal rows of documents) of all documents; texts are read once and never shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), text_mask(F.col("text")).alias("own"))
    rows = scratch.write(rows.groupBy("doc_id", "part", "key", "own").agg(F.count("*").alias("n")), "rows")
    groups = rows.groupBy("key").agg(F.sum("n").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("high > low").drop("high")
    joined = join_groups(rows, scratch.write(groups, "groups"), "key", "rows", spread=F.col("doc_id"))
    copy = F.when(F.col("doc_id") > F.col("low"), 16).otherwise(0)
    return joined.select("doc_id", "part", (F.col("own") + copy).alias("mask"), "n")


def histograms(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: the documents n, those of label quality=1 (good) and of label toxic=1."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"label_{c}")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(one("quality"), one("toxic")).withColumn("at", F.lit(0))
    # rows without doc_id match nothing: they are dealt out by a second key
    rows = masks.withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("part", "mask", "n"), F.lit(1000))).otherwise(F.lit(0)))
    joined = rows.join(broadcast_if_small(known, SMALL_ROWS), (F.coalesce(F.col("doc_id"), F.col("n")) == F.col("labelled")) & (F.col("spread") == F.col("at")), "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(F.col(f"label_{c}"), F.lit(0)))
    return joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("quality").alias("good"), lost("toxic").alias("toxic"))


def audit(histograms: DataFrame) -> DataFrame:
    """600 rows per part (120 orders of five steps), by products of the stacked histograms with the outcome matrices."""
    outcomes = outcome_matrices()
    orders = pa.array([o for o in ORDERS for _ in FILTERS])
    steps = pa.array(list(range(1, len(FILTERS) + 1)) * len(ORDERS), pa.int32())
    cells = len(ORDERS) * len(FILTERS)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS):
                batch = whole.slice(at, PARTS)
                parts, cell = batch.column(0), batch.column(1)
                entries = cell.flatten()
                place = np.repeat(np.arange(len(parts)), cell.value_lengths().to_numpy())
                mask, *counts = (entries.field(k).to_numpy() for k in range(4))
                stacked = np.zeros((3, len(parts), 32), np.int64)
                for row, n in zip(stacked, counts, strict=True):
                    np.add.at(row, (place, mask), n)
                everything, good, toxic = stacked
                table = [everything @ outcomes[k] for k in ("kept", "removed", "redundant", "unique")] + [good @ outcomes["removed"], toxic @ outcomes["removed"], everything @ outcomes["shapley"]]
                yield pa.RecordBatch.from_arrays(
                    [parts.take(pa.array(np.repeat(np.arange(len(parts)), cells))), pa.concat_arrays([orders] * len(parts)), pa.concat_arrays([steps] * len(parts)), *(pa.array(t.ravel()) for t in table)],
                    ["part", "filter_order", "step", *COUNTS],
                )

    stacked = histograms.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 entries at most
    return stacked.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(histograms(masks(docs, Scratch(docs.sparkSession, "filter-audit")), labels))
