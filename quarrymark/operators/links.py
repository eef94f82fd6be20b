"""Joins between hits, pages and suppliers. An OR of equalities is a union of equi joins, never a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.constants import CATALOG_DOMAINS
from ..scratch import Scratch
from .pages import first_wins

NONE = "cast(array() as array<string>)"
#: Tasks that a domain's pages are dealt to at least.
PARTS = 8


def attach_hits(suppliers: DataFrame, hits: DataFrame) -> DataFrame:
    """Suppliers with the queries and URLs of their hits appended, and a website from the first hit outside catalogues."""
    linked = hits.where("supplier_id is not null")
    site = F.concat(F.regexp_extract("_own", "^([a-z]+://)", 1), C.normalize_domain("_own"))
    entry = F.struct("ord", "query", "url", F.coalesce("related_urls", F.expr(NONE)).alias("related"))
    found = linked.groupBy("supplier_id").agg(F.sort_array(F.collect_list(entry)).alias("_h"), F.min_by("url", F.when(~C.is_catalog("url"), F.col("ord"))).alias("_own")).withColumn("_site", site)
    out = suppliers.join(found, suppliers["id"] == found["supplier_id"], "left").drop("supplier_id")
    urls = F.flatten(F.transform("_h", lambda h: F.concat(F.array(h["url"]), h["related"])))
    add = lambda name, more: F.array_distinct(F.concat(F.coalesce(name, F.expr(NONE)), F.coalesce(more, F.expr(NONE))))
    out = out.withColumns({"discovery_queries": add("discovery_queries", F.transform("_h", lambda h: h["query"])), "source_urls": add("source_urls", urls), "website": F.coalesce(C.blank_to_null("website"), "_site")})
    return out.withColumn("domain", F.coalesce(C.blank_to_null("domain"), C.normalize_domain("website"))).select(*suppliers.columns)


def unattached_hits(suppliers: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits that name no known supplier; each becomes a candidate of its own."""
    return hits.join(suppliers.select(F.col("id").alias("supplier_id")), "supplier_id", "left_anti")


def hit_sources(hits: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Lineage of hits with the supplier's name by id, else by domain (the last supplier of a domain)."""
    by_id = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("_by_id"))
    by_domain = first_wins(suppliers.where("domain is not null"), ["domain"], [F.desc("ord")]).select("domain", F.col("name").alias("_by_domain"))
    rows = hits.withColumn("domain", C.normalize_domain("url")).join(by_id, "supplier_id", "left").join(by_domain, "domain", "left")
    return rows.select("url", "domain", F.lit("skipped").alias("status"), F.lit(None).cast("int").alias("http_status"), F.lit("найдено в поиске").alias("note"), F.coalesce("_by_id", "_by_domain").alias("supplier_name"), F.col("query").alias("discovery_query"), "provider", F.lit("search_result").alias("source_kind"))


def fetch_urls(suppliers: DataFrame, hits: DataFrame) -> DataFrame:
    """(url, ord): hits, then related pages, then websites; first mention counts, places pages are out."""
    rows = hits.select("url", F.struct(F.lit(0).alias("k"), "ord", F.lit(0).alias("i")).alias("o"))
    rows = rows.unionByName(hits.select(F.posexplode("related_urls").alias("i", "url"), "ord").select("url", F.struct(F.lit(1).alias("k"), "ord", "i").alias("o")))
    rows = rows.unionByName(suppliers.where("website is not null").select(F.col("website").alias("url"), F.struct(F.lit(2).alias("k"), "ord", F.lit(0).alias("i")).alias("o")))
    return rows.where(~C.domain_in(C.normalize_domain("url"), ("2gis.ru",))).groupBy("url").agg(F.min("o").alias("ord"))


def _keys(suppliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supplier_id, key) of a supplier's URLs, and of its domain if that is no catalogue."""
    urls = suppliers.select(F.col("id").alias("supplier_id"), F.explode("source_urls").alias("key"))
    domains = suppliers.select(F.col("id").alias("supplier_id"), F.coalesce("domain", C.normalize_domain("website")).alias("key")).where("key is not null").where(~C.domain_in("key", CATALOG_DOMAINS))
    return urls.distinct(), domains.distinct()


def _addresses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, key) of a page's requested and final URL, and of its final domain."""
    page = pages.select("url", C.normalize_url("url").alias("u"), C.normalize_url("final_url").alias("f"), C.normalize_domain("final_url").alias("d"))
    return page.select("url", F.explode(F.array_distinct(F.array("u", "f"))).alias("key")).distinct(), page.select("url", F.col("d").alias("key")).where("key is not null").distinct()


def page_owners(pages: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(supplier_id, url): pages that belong to a supplier by requested or final URL, or by a domain that is no catalogue.

    A domain's pages times its suppliers may be many more rows than there are pages and suppliers.
    Those pairs are distinct as they are joined, so they are neither shuffled nor sorted; of the other ones
    only those are added that they don't hold. Addresses are normalised once and written.
    """
    spark = pages.sparkSession
    urls, domains = _keys(suppliers)
    page = pages.select("url", F.array(C.normalize_url("url"), C.normalize_url("final_url")).alias("keys"), C.normalize_domain("final_url").alias("domain"))
    known = page.groupBy("url").agg(F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"), F.collect_set("domain").alias("domains"))
    known = Scratch(spark, "addresses").write(known, "pages")
    by_url, by_domain = (known.select("url", "domains", F.explode(c).alias("key")) for c in ("keys", "domains"))
    # an id that stands for several domains may meet a page by more than one
    single = domains.groupBy("supplier_id").agg(F.min("key").alias("key"), F.max("key").alias("_last"))
    several = domains.join(single.where("key <> _last").select("supplier_id"), "supplier_id", "left_semi")
    single = single.where("key = _last").drop("_last")
    # a hot domain is dealt to several tasks, by its pages; the work is in the pairs, so tasks are not put together by the little that they read
    dealt = by_domain.select("url", "key", F.pmod(F.xxhash64("url"), F.lit(PARTS)).alias("_part")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "_part")
    direct = dealt.join(single.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>"))), ["key", "_part"])
    others = by_url.join(urls, "key").select("supplier_id", "url", "domains").unionByName(by_domain.join(several, "key").select("supplier_id", "url", "domains")).dropDuplicates(["supplier_id", "url"])
    others = others.join(single, "supplier_id", "left").where(~F.coalesce(F.array_contains("domains", F.col("key")), F.lit(False)))
    return direct.select("supplier_id", "url").unionByName(others.select("supplier_id", "url"))


def first_page_owners(pages: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(url, supplier_id): the first supplier in order that a page belongs to, from the first supplier of each URL and domain."""
    order = suppliers.select(F.col("id").alias("supplier_id"), "ord")
    found = []
    for keys, addresses in zip(_keys(suppliers), _addresses(pages), strict=True):
        first = keys.join(order, "supplier_id").groupBy("key").agg(F.min(F.struct("ord", "supplier_id")).alias("_first"))
        found.append(addresses.join(first, "key").select("url", "_first"))
    return found[0].unionByName(found[1]).groupBy("url").agg(F.min("_first").alias("_first")).select("url", "_first.supplier_id")


def first_owner(owners: DataFrame, suppliers: DataFrame) -> DataFrame:
    """(url, supplier_id): the first supplier in order that a page belongs to."""
    order = suppliers.select(F.col("id").alias("supplier_id"), "ord")
    return first_wins(owners.join(order, "supplier_id"), ["url"], ["ord", "supplier_id"]).select("url", "supplier_id")


def model_pages(suppliers: DataFrame, owners: DataFrame, pages: DataFrame, most_suppliers: int = 6, per_supplier: int = 2) -> DataFrame:
    """The first pages of the first suppliers that have any, for fact extraction by a model."""
    order = suppliers.select(F.col("id").alias("supplier_id"), F.col("ord").alias("supplier_ord"))
    rows = owners.join(order, "supplier_id").join(pages, "url")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("supplier_id").orderBy("ord", "url"))).where(F.col("_n") <= per_supplier)
    first = rows.groupBy("supplier_id").agg(F.min("supplier_ord").alias("o")).orderBy("o").limit(most_suppliers).select("supplier_id")
    return rows.join(F.broadcast(first), "supplier_id").drop("_n")  # at most most_suppliers rows


def first_pages(suppliers: DataFrame, pages: DataFrame, most_suppliers: int = 6, per_supplier: int = 2) -> DataFrame:
    """``model_pages`` of all that ``page_owners`` gives, where only the chosen suppliers are joined with their pages."""
    met = [keys.join(addresses.select("key").distinct(), "key", "left_semi").select("supplier_id") for keys, addresses in zip(_keys(suppliers), _addresses(pages), strict=True)]
    order = suppliers.select(F.col("id").alias("supplier_id"), "ord")
    first = order.join(met[0].unionByName(met[1]).distinct(), "supplier_id", "left_semi").groupBy("supplier_id").agg(F.min("ord").alias("o")).orderBy("o", "supplier_id").limit(most_suppliers)
    chosen = suppliers.join(F.broadcast(first.select(F.col("supplier_id").alias("id"))), "id", "left_semi")  # at most most_suppliers rows
    return model_pages(chosen, page_owners(pages, chosen), pages, most_suppliers, per_supplier)
