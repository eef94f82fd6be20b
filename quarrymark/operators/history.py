"""Run history as Parquet tables, saved whole or not at all, with the page cache's upsert and expiry rules.

A save writes each table below an attempt of its own and commits all of them with one manifest, which
names the attempt of every (table, run). Readers take the attempt named last, so a save that died between its
tables, or is still writing, shows the former run. Saving a run again replaces the given tables' rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.schemas import HISTORY
from ..manifest import Manifests
from ..scratch import delete, file_system
from .pages import first_wins

_COMMIT = "entries array<struct<table:string,run_id:string,attempt:string>>, seq long"


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a history table in order; missing ones are added as null, so older files stay readable."""
    spark = df.sparkSession
    want = spark.createDataFrame([], HISTORY[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def save_run(root: str, tables: dict[str, DataFrame]) -> None:
    """Replaces the rows of the runs in every given table, all of them at once; saving a run again leaves no old evidence."""
    if "page_cache" in tables:
        raise ValueError("the page cache is not part of a run")
    attempt, runs, spark = uuid.uuid4().hex, {}, None
    for name, df in tables.items():
        spark = df.sparkSession
        conform(df, name).write.partitionBy("run_id").parquet(f"{root}/saved/{name}/attempt={attempt}")
        runs[name] = _runs_of(spark, f"{root}/saved/{name}/attempt={attempt}", name)
    everyone = sorted(set().union(*runs.values()))
    # a table without rows of a run loses its former ones too
    entries = [{"table": name, "run_id": run, "attempt": attempt} for name in tables for run in everyone]
    if entries:
        log = Manifests(spark, f"{root}/_commits")
        log.change(lambda last: {"entries": entries, "seq": last.get("seq", 0) + 1})


def _runs_of(spark: SparkSession, path: str, table: str) -> set[str]:
    """The runs that a save wrote, from its folders' names: one per run, never per row."""
    rows = spark.read.schema(HISTORY[table]).parquet(path).select("run_id").distinct()
    return {r[0] for r in rows.collect() if r[0] is not None}


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """(table, run_id, attempt) as committed last."""
    path, files = file_system(spark, f"{root}/_commits")
    if not files.exists(path):
        return spark.createDataFrame([], "table string, run_id string, attempt string")
    rows = spark.read.schema(_COMMIT).json(f"{root}/_commits").select("seq", F.inline("entries"))
    return rows.groupBy("table", "run_id").agg(F.max_by("attempt", "seq").alias("attempt"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of the committed runs, and those of runs never committed that tables of the former layout hold."""
    found = spark.createDataFrame([], HISTORY[table])
    columns, live = found.columns, _commits(spark, root).where(F.col("table") == table).select("run_id", "attempt")
    for folder in (f"{root}/saved/{table}", f"{root}/{table}"):
        path, files = file_system(spark, folder)
        if not files.exists(path):
            continue
        saved = folder.startswith(f"{root}/saved/")
        rows = spark.read.schema(HISTORY[table] + (", attempt string" if saved else "")).parquet(folder)
        shown = rows.join(live, ["run_id", "attempt"], "left_semi") if saved else rows.join(live, "run_id", "left_anti")
        found = found.unionByName(shown.select(*columns))
    return found


def vacuum(spark: SparkSession, root: str) -> int:
    """Removes attempts that no run shows any more; returns their number. Not beside running saves."""
    live = {(r["table"], r["attempt"]) for r in _commits(spark, root).select("table", "attempt").distinct().collect()}
    gone = 0
    for table in (t for t in HISTORY if t != "page_cache"):
        path, files = file_system(spark, f"{root}/saved/{table}")
        for name in [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []:
            if name.startswith("attempt=") and (table, name.partition("=")[2]) not in live:
                delete(spark, f"{root}/saved/{table}/{name}")
                gone += 1
    return gone


def latest_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def list_runs(spark: SparkSession, root: str, limit: int = 20) -> DataFrame:
    """The latest runs."""
    return latest_runs(read(spark, root, "search_runs"), limit)


def list_sources(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return read(spark, root, "sources").where(F.col("run_id") == run_id).orderBy("seq")


def list_suppliers(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return read(spark, root, "suppliers").where(F.col("run_id") == run_id).orderBy("name", "supplier_id")


def supplier_payload(scored: DataFrame, run_id: str) -> DataFrame:
    """History rows of scored suppliers, with the whole record as JSON."""
    return scored.select(F.lit(run_id).alias("run_id"), F.col("id").alias("supplier_id"), "name", "score", (F.col("result_group") == "excluded").alias("excluded"), F.col("result_group").alias("verification_status"), F.to_json(F.struct(*scored.columns)).alias("payload"))


def cache_entries(pages: DataFrame, ttl_hours: int = 168) -> DataFrame:
    """Cache rows of fetched pages: failures live an hour at most; empty texts are null; the HTML is hashed."""
    hours = F.when(F.col("status") == "ok", F.lit(ttl_hours)).otherwise(F.lit(min(ttl_hours, 1)))
    html = C.blank_to_null("html")
    return pages.select("url", "final_url", "http_status", "mime_type", "fetched_at", (F.col("fetched_at") + F.make_dt_interval(hours=hours)).alias("expires_at"), F.sha2(html, 256).alias("content_hash"), html.alias("html"), C.blank_to_null("text").alias("cleaned_text"), F.col("error"))


def upsert_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest entry per URL; of equals the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, ["url"], [F.desc("fetched_at"), F.desc("_new"), "content_hash"]).drop("_new")


def fresh(cache: DataFrame, now) -> DataFrame:
    """Entries not expired at ``now``; entries without a readable expiry are misses."""
    return cache.where(F.try_to_timestamp(F.col("expires_at").cast("string")) > F.lit(now).cast("timestamp"))


def cached_status(cache: DataFrame) -> DataFrame:
    """Adds the status a cached page stands for."""
    blocked = F.col("http_status").isin(401, 403) | C.contains_any(F.coalesce("error", F.lit("")), ("robots", "mime", "captcha", "размер"))
    return cache.withColumn("status", F.when(C.blank_to_null("cleaned_text").isNotNull(), "cached").when(F.coalesce(blocked, F.lit(False)), "skipped").otherwise("failed"))
