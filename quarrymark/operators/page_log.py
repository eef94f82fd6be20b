"""The page cache as a log: URLs hashed into buckets, a delta per upsert and touched bucket, merged on read.

An upsert writes its own rows only, into the buckets they fall in, and becomes visible with one manifest
that names every live file folder of every bucket. A lookup computes the buckets of its URLs and reads
those alone. ``compact`` rewrites buckets with many deltas as one. Writers work optimistically: one that
finds its version taken adds its deltas to the newer one. Of entries of a URL the latest fetch counts,
then the later upsert, then the content hash; rows without URL are left out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import HISTORY
from ..manifest import Manifests
from ..scratch import delete, file_system
from . import history
from .pages import first_wins

BUCKETS = 64
SMALL_ROWS = 100_000


def bucket_of(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _manifests(spark: SparkSession, root: str) -> Manifests:
    return Manifests(spark, f"{root}/_manifests")


def _latest(rows: DataFrame) -> DataFrame:
    return first_wins(rows, ["url"], [F.desc_nulls_last("fetched_at"), F.desc("seq"), "content_hash"]).drop("seq")


def _folders(spark: SparkSession, base: str) -> dict[str, str]:
    """Bucket to folder of what one write left below ``base``."""
    path, files = file_system(spark, base)
    names = [f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()]
    return {n.partition("=")[2]: n for n in names if n.startswith("bucket=")}


def _write(rows: DataFrame, root: str, buckets: int) -> dict[str, str]:
    """Writes rows below a folder of their own, dealt by bucket and size, and names the folder of each touched bucket."""
    name = f"delta-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", bucket_of(F.col("url"), buckets)).hint("rebalance", "bucket")
    dealt.write.partitionBy("bucket").parquet(f"{root}/{name}")
    return {bucket: f"{name}/{folder}" for bucket, folder in _folders(rows.sparkSession, f"{root}/{name}").items()}


def upsert(root: str, entries: DataFrame, buckets: int = BUCKETS, source: str | None = None, epoch: int = 0) -> list[int]:
    """Adds cache entries; returns the buckets written. ``buckets`` counts only for the first upsert of a table.

    A (source, epoch) that the log has already is not added again, so a repeated micro-batch changes nothing.
    """
    spark, log = entries.sparkSession, _manifests(entries.sparkSession, root)
    _, known = log.latest()
    if source is not None and known.get("epochs", {}).get(source, -1) >= epoch:
        return []
    width = known.get("buckets", buckets)
    rows = history.conform(entries, "page_cache").where("url is not null").withColumn("seq", F.lit(0))
    touched = _write(_latest(rows), root, width)

    def add(content: dict) -> dict | None:
        epochs = content.get("epochs", {})
        if source is not None and epochs.get(source, -1) >= epoch:
            return None
        if content.get("buckets", width) != width:
            raise ValueError("the table was created with another number of buckets meanwhile")
        live = dict(content.get("live", {}))
        for bucket, folder in touched.items():
            live[bucket] = [*live.get(bucket, []), folder]
        return {"buckets": width, "live": live, "epochs": epochs | ({source: epoch} if source is not None else {})}

    log.change(add)
    return sorted(map(int, touched))


def _read(spark: SparkSession, root: str, content: dict, wanted: set[int] | None) -> DataFrame:
    """Entries of the wanted buckets (None: all) of one version, with ``seq``, their place among the deltas of the bucket."""
    live = {b: folders for b, folders in content.get("live", {}).items() if wanted is None or int(b) in wanted}
    by_place: dict[int, list[str]] = {}
    for folders in live.values():
        for place, folder in enumerate(folders):
            by_place.setdefault(place, []).append(f"{root}/{folder}")
    parts = [spark.read.schema(HISTORY["page_cache"]).parquet(*paths).withColumn("seq", F.lit(place)) for place, paths in sorted(by_place.items())]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], HISTORY["page_cache"] + ", seq int"))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The cache: one entry per URL, as of the latest or the given version."""
    log = _manifests(spark, root)
    return _latest(_read(spark, root, log.latest()[1] if version is None else log.read(version), None))


def lookup(spark: SparkSession, root: str, urls: DataFrame, now: Column | str) -> DataFrame:
    """Entries of the URLs (column ``url``) that haven't expired at ``now``; reads the buckets of these URLs alone."""
    _, content = _manifests(spark, root).latest()
    wanted = urls.select("url").where("url is not null").distinct()
    width = content.get("buckets", BUCKETS)
    # at most one number per bucket comes to the driver
    buckets = {r[0] for r in wanted.select(bucket_of(F.col("url"), width).alias("b")).distinct().collect()}
    few = wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    rows = _read(spark, root, content, buckets).join(F.broadcast(wanted) if few else wanted, "url", "left_semi")
    return history.fresh(_latest(rows), now)


def compact(spark: SparkSession, root: str, most: int = 8) -> list[int]:
    """Rewrites buckets of more than ``most`` deltas as one; returns them. Upserts that come meanwhile stay behind the rewritten."""
    log = _manifests(spark, root)
    _, content = log.latest()
    long = {b: folders for b, folders in content.get("live", {}).items() if len(folders) > most}
    if not long:
        return []
    rewritten = _write(_latest(_read(spark, root, content, {int(b) for b in long})), root, content["buckets"])

    def swap(now: dict) -> dict:
        live = dict(now["live"])
        for bucket, folders in long.items():
            if live[bucket][: len(folders)] != folders:
                raise RuntimeError("another compaction came first")
            live[bucket] = [rewritten[bucket], *live[bucket][len(folders) :]]
        return now | {"live": live}

    log.change(swap)
    return sorted(map(int, long))


def vacuum(spark: SparkSession, root: str, keep_versions: int = 1) -> int:
    """Removes folders and manifests that none of the last versions names; returns the number of folders. Not beside running upserts."""
    log = _manifests(spark, root)
    versions = log.versions()
    if not versions:
        return 0
    kept = versions[-keep_versions:]
    named = {folder for v in kept for folders in log.read(v).get("live", {}).values() for folder in folders}
    path, files = file_system(spark, root)
    removed = 0
    for delta in [f.getPath().getName() for f in files.listStatus(path) if f.getPath().getName().startswith("delta-")]:
        for folder in _folders(spark, f"{root}/{delta}").values():
            if f"{delta}/{folder}" not in named:
                delete(spark, f"{root}/{delta}/{folder}")
                removed += 1
        if not _folders(spark, f"{root}/{delta}"):
            delete(spark, f"{root}/{delta}")
    log.forget(kept[0])
    return removed
