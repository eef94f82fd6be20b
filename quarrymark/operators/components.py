"""Companies across runs: stored components to which new records attach without computing old ones again.

A run's edges are contracted to the components they touch; only that small graph is solved. What it
merges goes into a table of renamed components (former name to present one), so the labels that
earlier runs wrote stay as they are. Components keep the smallest node's name, as in a single full run.
Tables of nodes and components are merged, never broadcast, so that none passes through the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..manifest import Manifests
from ..scratch import Scratch
from .entities import connected_components

LABELS, RENAMED = "ord long, component long", "component long, now long"


def _tables(spark: SparkSession, root: str, content: dict) -> tuple[DataFrame, DataFrame]:
    labels = [spark.read.schema(LABELS).parquet(f"{root}/{name}") for name in content.get("labels", [])]
    renamed = spark.read.schema(RENAMED).parquet(f"{root}/{content['renamed']}") if content.get("renamed") else spark.createDataFrame([], RENAMED)
    return reduce(DataFrame.unionByName, labels, spark.createDataFrame([], LABELS)), renamed


def _present(labels: DataFrame, renamed: DataFrame) -> DataFrame:
    return labels.join(renamed.hint("merge"), "component", "left").select("ord", F.coalesce("now", "component").alias("component"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """(ord, component) of all nodes so far, under the components' present names."""
    return _present(*_tables(spark, root, Manifests(spark, f"{root}/_manifests").latest()[1]))


def attach(root: str, nodes: DataFrame, edges: DataFrame) -> int:
    """Adds nodes (ord) and edges (a, b) between any nodes, old or new; returns the version that shows them.

    Nodes that are there already stay; nodes named by edges alone are added; nulls are left out. Runs
    attach one after the other: one that finds another's version raises, and is to be run again.
    """
    spark = nodes.sparkSession
    log, scratch = Manifests(spark, f"{root}/_manifests"), Scratch(spark, "components")
    version, content = log.latest()
    labels, renamed = _tables(spark, root, content)
    links = scratch.write(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "links")
    named = nodes.select(F.col("ord").cast("long").alias("ord")).unionByName(links.select(F.col("a").alias("ord"))).unionByName(links.select(F.col("b").alias("ord")))
    # of the stored labels only those that this run's nodes touch are joined on
    touched = scratch.write(named.where("ord is not null").distinct().join(_present(labels, renamed).hint("merge"), "ord", "left").withColumn("known", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "ord")), "touched")
    at = lambda c: touched.select(F.col("ord").alias(c), F.col("component").alias(f"{c}_component"))
    contracted = links.join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b")).where("a <> b").distinct()
    ends = contracted.select(F.col("a").alias("ord")).unionByName(contracted.select(F.col("b").alias("ord"))).distinct()
    merged = scratch.write(connected_components(ends, contracted).where("ord <> component").select(F.col("ord").alias("component"), F.col("component").alias("now")), "merged")
    name = uuid.uuid4().hex
    fresh = touched.where("not known").select("ord", "component")
    _present(fresh, merged).write.parquet(f"{root}/labels-{name}")
    # former names follow what their present one became; merged components of this run's new nodes need no entry
    old = merged.join(touched.where("known").select("component").distinct().hint("merge"), "component", "left_semi")
    follow = renamed.join(merged.select(F.col("component").alias("now"), F.col("now").alias("later")).hint("merge"), "now", "left").select("component", F.coalesce("later", "now").alias("now"))
    follow.unionByName(old).write.parquet(f"{root}/renamed-{name}")
    log.commit(version + 1, {"labels": [*content.get("labels", []), f"labels-{name}"], "renamed": f"renamed-{name}"})
    return version + 1
