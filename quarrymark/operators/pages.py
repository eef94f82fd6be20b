"""Search hits and pages: deduplication, site filters, caps per domain, fetch gates, useful links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def deduplicate_hits(hits: DataFrame) -> DataFrame:
    """One hit per normalised URL: the first that names a supplier, else the first; at the place of the first. Hits on blocked sites go.

    Hits are reduced by their URL as it is written first, so that each way of writing is normalised once, as a
    result of that reduction: filters on it can't be moved below and normalise again.
    """
    known = F.coalesce(F.col("supplier_id"), F.lit("")) == ""
    best = F.min_by(F.struct(*hits.columns), F.struct(known.cast("int"), "ord"))
    written = hits.groupBy(F.col("url").alias("_written")).agg(best.alias("_hit"), F.min("ord").alias("_seen"), C.normalize_url(F.min("url")).alias("_url"))
    fit = written.where(F.col("_url").isNotNull() & ~C.is_blocked("_url")).select("_hit.*", "_seen", "_url").withColumn("url", F.col("_url"))
    placed = fit.drop("_url").withColumn("_first", F.min("_seen").over(Window.partitionBy("url")))
    first = first_wins(placed, ["url"], [known.cast("int"), "ord"]).withColumn("ord", F.col("_first")).drop("_first", "_seen")
    related = F.transform(F.coalesce("related_urls", F.array().cast("array<string>")), C.normalize_url)
    return first.withColumn("related_urls", F.filter(related, lambda u: u.isNotNull() & ~C.is_blocked(u) & (u != F.col("url"))))


def select_initial_urls(urls: DataFrame, max_domains: int = 12, max_per_domain: int = 3) -> DataFrame:
    """url, domain, ord of the first URLs of the first domains seen. Repeats use up a domain's share.

    Domains are ranked on one row per domain (a top-k), never on all rows.
    """
    rows = urls.select(C.normalize_url("url").alias("url"), "ord").withColumn("domain", C.normalize_domain("url")).where("url is not null and domain is not null")
    first = rows.groupBy("domain").agg(F.min("ord").alias("seen")).orderBy("seen", "domain").limit(max_domains)
    capped = rows.join(F.broadcast(first), "domain")  # at most max_domains rows
    capped = capped.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("ord", "url"))).where(F.col("_n") <= max_per_domain)
    return capped.groupBy("url", "domain").agg(F.min("ord").alias("ord"))


def second_wave(links: DataFrame, visited: DataFrame, max_per_domain: int = 3) -> DataFrame:
    """Links of the first pages not visited yet, up to what is left of each domain's share."""
    spent = visited.groupBy("domain").agg(F.count("*").alias("spent"))
    fresh = links.join(visited.select("url"), "url", "left_anti").groupBy("url", "domain").agg(F.min("ord").alias("ord"))
    ranked = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("ord", "url")))
    return ranked.join(spent, "domain", "left").where(F.col("_n") <= max_per_domain - F.coalesce("spent", F.lit(0))).select("url", "domain", "ord")


def useful_links(pages: DataFrame) -> DataFrame:
    """page url, target, score, place: links of the same site that name useful sections, best and shortest first."""
    anchors = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<a\b[^>]*?href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select("url", F.posexplode(anchors).alias("pos", "anchor"))
    href = F.regexp_extract("anchor", r"(?is)href\s*=\s*[\"']([^\"']+)[\"']", 1)
    site = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    scheme = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    target = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(site, href)).otherwise(F.concat(folder, F.lit("/"), href))
    rows = rows.select("url", "pos", C.normalize_url(target).alias("target"), C.plain_html("anchor").alias("label"))
    rows = rows.where(C.normalize_domain("target") == C.normalize_domain("url"))
    hay = F.lower(F.concat_ws(" ", "target", "label"))
    score = F.aggregate(C.strings(K.USEFUL_LINK_WORDS), F.lit(0), lambda n, w: n + F.contains(hay, w).cast("int"))
    scored = rows.withColumn("score", score).where("score > 0")
    best = first_wins(scored, ["url", "target"], [F.desc("score"), F.length("target"), "pos"])
    place = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), F.length("target"), "pos", "target"))
    return best.select("url", "target", "score", place.alias("place"))


def fetch_gates(pages: DataFrame, max_bytes: int = 2_000_000) -> DataFrame:
    """Adds status and note for landed pages: blocked, failed, other media, too large, CAPTCHA, else ok."""
    visible = F.lower(F.coalesce("text", F.lit("")))
    mime = F.lower(F.split_part(F.coalesce("mime_type", F.lit("")), F.lit(";"), F.lit(1)))
    captcha = C.contains_any(visible, K.CAPTCHA_MARKERS[1:]) | (F.contains(visible, F.lit(K.CAPTCHA_MARKERS[0])) & (F.length(visible) < 5000))
    gate = (
        F.when(F.col("http_status").isin(401, 403), F.struct(F.lit("skipped").alias("status"), F.lit("authorisation or robot block").alias("note")))
        .when(F.col("http_status") >= 400, F.struct(F.lit("failed").alias("status"), F.format_string("HTTP %d", F.col("http_status")).alias("note")))
        .when(~(F.startswith(mime, F.lit("text/html")) | F.startswith(mime, F.lit("application/xhtml+xml"))), F.struct(F.lit("skipped").alias("status"), F.concat(F.lit("mime: "), mime).alias("note")))
        .when(F.octet_length("html") > max_bytes, F.struct(F.lit("skipped").alias("status"), F.lit("page too large").alias("note")))
        .when(captcha, F.struct(F.lit("skipped").alias("status"), F.lit("captcha").alias("note")))
        .otherwise(F.struct(F.lit("ok").alias("status"), F.lit(None).cast("string").alias("note")))
    )
    return pages.withColumn("_gate", gate).withColumn("status", F.col("_gate.status")).withColumn("note", F.col("_gate.note")).drop("_gate")


def usable(pages: DataFrame) -> DataFrame:
    """Loaded or cached pages with text or HTML."""
    return pages.where(F.col("status").isin("ok", "cached") & ((F.length(F.coalesce("text", F.lit(""))) > 0) | (F.length(F.coalesce("html", F.lit(""))) > 0)))


def page_sources(pages: DataFrame, provider: str = "HTTP") -> DataFrame:
    """Lineage rows of pages: catalogue or official site."""
    kind = F.when(C.is_catalog("final_url"), "catalog").otherwise("official_site")
    return pages.select(F.col("final_url").alias("url"), C.normalize_domain("final_url").alias("domain"), "status", "http_status", F.col("error").alias("note"), F.lit(None).cast("string").alias("supplier_name"), F.lit(None).cast("string").alias("discovery_query"), F.lit(provider).alias("provider"), kind.alias("source_kind"))


def text_budget(pages: DataFrame, key: str, max_chars: int = 18_000) -> DataFrame:
    """The text of a supplier's pages in order, cut where the running length passes the budget."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    kept = pages.withColumn("_used", used).where(F.col("_used") < max_chars)
    return kept.withColumn("text", F.substr("text", F.lit(1), (F.lit(max_chars) - F.col("_used")).cast("int"))).drop("_used")
