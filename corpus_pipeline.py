"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
every stage's result as Parquet in the shared folder and reads it again for the next one. All but
the last return the columns of documents.

- quality: documents whose probability of more than the lowest grade is below one half go.
- near_dedup: of each group of near duplicates, linked where at least 0.8 of their 5-word shingles
  are shared (Jaccard; op1_near_dedup has 0.85), the document with the smallest doc_id stays.
- decontaminate: documents that contain a benchmark item go.
- mix: documents are repeated or left out so that sources meet their target weights.
- token_files: the ids of the mix in bit-packed block files, read back.

Defined results: every stage decides row by row, whatever the doc_ids. Where doc_ids repeat or are
null, near_dedup and mix number the rows in the order of doc_id (null last) and text, and work on the
numbers, so of near duplicates the first row in that order stays, exact repeats of a row included, and
each row is repeated or left out by itself; decontaminate works on texts. Null and empty texts are
graded from whole-text measures alone, are nobody's duplicate, contain nothing, and are taken 0 times.
An empty table stays empty. Other columns, of any name but ``__quarrymark_...``, pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymark.llm import decontaminate, mixing, near_dedup, quality, token_files
from quarrymark.llm.common import Scratch, broadcast_if_small
from quarrymark.llm.queries import WORD_TOKENIZER, tokenizer_path
from quarrymark.session import ship

SMALL_ROWS = 1_000_000
NEAR_PERCENT = 80
_MARK, _ROW = "__quarrymark_stage", "__quarrymark_row"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.grade(docs, model, into=_MARK).where(quality.selected(_MARK)).drop(_MARK)


def _with_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a number of their own: the doc_id, where each has one of its own."""
    own = F.col("doc_id").cast("long")
    unclear = docs.groupBy(own.alias("k")).agg(F.count("*").alias("n")).where("n > 1 or k is null")
    if unclear.isEmpty():
        return docs.withColumn(_ROW, own)
    order = [own.asc_nulls_last(), F.xxhash64("text")]  # the hash parts rows of one doc_id over tasks
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return scratch.write(ranged.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark, "dedup-stage")
    rows = _with_rows(docs, scratch)
    found = near_dedup.near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"), percent=NEAR_PERCENT)
    gone = scratch.write(found.where(~F.col("kept")).select(F.col("doc_id").alias(_MARK)), "gone", near_dedup.NARROW)
    return rows.join(broadcast_if_small(gone, SMALL_ROWS), F.col(_ROW) == F.col(_MARK), "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by text, so that rows of one doc_id, or of none, are told apart
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.contaminated(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = Scratch(spark, "decontaminate-stage").write(found.select(F.col("doc_id").alias(_MARK)).distinct(), "gone")
    return docs.join(broadcast_if_small(gone, SMALL_ROWS), F.xxhash64("text") == F.col(_MARK), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mix-stage")
    rows = _with_rows(docs, scratch)
    mixed = mixing.mix(rows.select(F.col(_ROW).alias("doc_id"), "text", "source"))
    mixed = scratch.write(mixed.select(F.col("doc_id").alias(_MARK), F.col("copies").cast("int").alias(f"{_MARK}_copies")), "copies", near_dedup.NARROW)
    joined = rows.join(broadcast_if_small(mixed, SMALL_ROWS), F.col(_ROW) == F.col(_MARK))
    return joined.withColumn(_MARK, F.explode(F.array_repeat(F.lit(0), F.col(f"{_MARK}_copies")))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return token_files.token_files(docs, tokenizer_path(WORD_TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("token_files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs


#: The quality stage fits a model, which SQL can't express; tests compare the rest by brute force.
ORACLE_SQL = None
