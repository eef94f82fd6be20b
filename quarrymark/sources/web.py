"""Search result pages of several engines, landed as JSON, XML or HTML, as hits."""

from __future__ import annotations

import html as html_lib
import urllib.robotparser
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import constants as K
from ..functions.schemas import HIT, SUPPLIER, WEB_RESULTS
from ..operators.entities import normalize_suppliers
from ..operators.pages import deduplicate_hits
from .provider import conform


def json_hits(payloads: DataFrame, provider: str = "brave", limit: int = 20) -> DataFrame:
    """Hits of landed JSON answers (query, supplier_id, payload, ord), ranked by position."""
    rows = payloads.select("query", "supplier_id", "ord", F.posexplode(F.from_json("payload", WEB_RESULTS)["web"]["results"]).alias("pos", "r")).where(C.blank_to_null(F.col("r.url")).isNotNull() & (F.col("pos") < limit))
    hits = rows.select(F.col("r.url").alias("url"), C.plain_html(F.coalesce("r.title", F.lit(""))).alias("title"), C.plain_html(F.coalesce("r.description", F.lit(""))).alias("snippet"), "query", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("rank"), "supplier_id", (F.col("ord") * 1000 + F.col("pos")).alias("ord"))
    return deduplicate_hits(conform(hits, HIT))


def xml_hits(payloads: DataFrame, provider: str = "yandex", limit: int = 20) -> DataFrame:
    """Hits of base64-coded XML answers (query, supplier_id, payload, ord)."""
    schema = "response struct<results:struct<grouping:struct<group:array<struct<doc:array<struct<url:string,title:string,passages:struct<passage:array<string>>>>>>>>>"
    xml = F.decode(F.unbase64("payload"), "UTF-8")
    docs = F.flatten(F.transform(F.from_xml(xml, schema)["response"]["results"]["grouping"]["group"], lambda g: g["doc"]))
    rows = payloads.select("query", "supplier_id", "ord", F.posexplode(F.filter(docs, lambda d: C.blank_to_null(d["url"]).isNotNull())).alias("pos", "d")).where(F.col("pos") < limit)
    hits = rows.select(F.col("d.url").alias("url"), C.plain_html(F.coalesce("d.title", F.lit(""))).alias("title"), C.plain_html(F.array_join("d.passages.passage", " ")).alias("snippet"), "query", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("rank"), "supplier_id", (F.col("ord") * 1000 + F.col("pos")).alias("ord"))
    return deduplicate_hits(conform(hits, HIT))


class _Blocks(HTMLParser):
    """Elements of a page as a flat list of (tag, attributes, text, depth path), tolerant of broken markup."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"tag": tag, "attrs": dict(attrs), "text": [], "up": self.open[-1] if self.open else -1})
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[at]]["tag"] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        for at in self.open:
            self.nodes[at]["text"].append(data)


def _parsed(page: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(page or "")
    for n in parser.nodes:
        n["words"] = " ".join(" ".join(n["text"]).split())
        n["classes"] = set((n["attrs"].get("class") or "").split())
    return parser.nodes


def _inside(nodes: list[dict], at: int) -> Iterator[dict]:
    for k in range(at + 1, len(nodes)):
        up = nodes[k]["up"]
        while up > at:
            up = nodes[up]["up"]
        if up == at:
            yield nodes[k]
        elif nodes[k]["up"] < at:
            return


_ROWS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "snippet", "related")]))


@F.pandas_udf(_ROWS)
def result_blocks(pages: pd.Series) -> pd.Series:
    """Result blocks of an HTML answer: link, title and snippet."""
    out = []
    for page in pages:
        nodes, rows = _parsed(page), []
        for at, n in enumerate(nodes):
            if "result" not in n["classes"]:
                continue
            inner = list(_inside(nodes, at))
            link = next((x for x in inner if x["tag"] == "a" and "result__a" in x["classes"] and x["attrs"].get("href")), None)
            if link:
                note = next((x["words"] for x in inner if "result__snippet" in x["classes"]), "")
                rows.append({"url": link["attrs"]["href"], "title": link["words"], "snippet": note, "related": None})
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(_ROWS)
def product_cards(pages: pd.Series) -> pd.Series:
    """Product cards of a catalogue page: product link, company or product title, descriptor, producer's link."""
    base, out = "https://productcenter.ru", []
    for page in pages:
        nodes, rows = _parsed(page), []
        for at, n in enumerate(nodes):
            if not {"card_item", "product"} <= n["classes"]:
                continue
            inner = list(_inside(nodes, at))
            href = lambda x: x["attrs"].get("href") or ""
            link = next((x for x in inner if x["tag"] == "a" and "link" in x["classes"] and href(x).startswith("/products/")), None)
            if link is None:
                continue
            company = next((x for x in inner if "ii_company" in x["classes"]), None)
            title = (company["attrs"].get("title") or "").split(":", 1)[-1].strip() if company else ""
            producer = next((x for x in inner if x["tag"] == "a" and href(x).startswith("/producers/")), None)
            related = None
            if company and producer:
                own = next((x["attrs"]["data-producer-id"] for x in inner if x["attrs"].get("data-producer-id")), "")
                path = href(producer).split("/")
                if own and len(path) > 2 and path[2].isdigit():
                    path[2] = own
                related = urljoin(base, "/".join(path))
            words = next((x["words"] for x in inner if "item_descriptor" in x["classes"]), "")
            rows.append({"url": urljoin(base, href(link)), "title": title or link["words"], "snippet": " — ".join(v for v in (link["words"], words) if v), "related": related})
        out.append(rows)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def visible_text(pages: pd.Series) -> pd.Series:
    """The visible lines of a page, by a parser: text outside of scripts, styles and the like."""
    hidden = {"script", "style", "noscript", "svg", "template"}

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.deep = [], 0

        def handle_starttag(self, tag, attrs):
            self.deep += tag in hidden

        def handle_endtag(self, tag):
            self.deep -= tag in hidden and self.deep > 0

        def handle_data(self, data):
            if not self.deep:
                self.parts.append(data)

    out = []
    for page in pages:
        if page is None:
            out.append(None)
            continue
        parser = Text()
        parser.feed(page)
        out.append("\n".join(line for part in parser.parts for line in (x.strip() for x in part.splitlines()) if line))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities resolved."""
    return texts.map(lambda t: None if t is None else html_lib.unescape(t))


def _html_hits(payloads: DataFrame, rows: Column, provider: str) -> DataFrame:
    hits = payloads.select("query", "supplier_id", "ord", F.posexplode(rows).alias("pos", "r"))
    return hits.select(C.redirect_target("r.url").alias("url"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"), "query", F.lit(provider).alias("provider"), (F.col("pos") + 1).alias("rank"), "supplier_id", F.array_compact(F.array("r.related")).alias("related_urls"), (F.col("ord") * 1000 + F.col("pos")).alias("ord"), "pos")


def html_hits(payloads: DataFrame, provider: str = "duckduckgo", limit: int = 20) -> DataFrame:
    """Hits of landed HTML answers, redirects resolved."""
    return deduplicate_hits(conform(_html_hits(payloads, result_blocks("payload"), provider).where(F.col("pos") < limit), HIT))


def card_score(title: Column, snippet: Column, query: Column) -> Column:
    """Merits named in the card, less three for each prepared food that the query doesn't name."""
    text, product, asked = F.lower(F.concat_ws(" ", title, snippet)), F.lower(F.split_part(snippet, F.lit("—"), F.lit(1))), F.lower(query)
    merits = F.aggregate(C.strings(K.CARD_MERITS), F.lit(0), lambda n, m: n + F.contains(text, m).cast("int"))
    faults = F.aggregate(C.strings(K.CARD_CONFLICTS), F.lit(0), lambda n, m: n + (F.contains(product, m) & ~F.contains(asked, m)).cast("int"))
    return merits - 3 * faults


def catalog_hits(payloads: DataFrame, provider: str = "catalog", limit: int = 20) -> DataFrame:
    """Catalogue cards that match their query, over-fetched, scored, cut and ranked anew."""
    rows = _html_hits(payloads, product_cards("payload"), provider)
    product = F.split_part("snippet", F.lit(" — "), F.lit(1))
    fit = rows.where(C.title_matches(product, "query") & ~C.conflicts(product, "query", K.TITLE_CONFLICTS))
    seen = Window.partitionBy("query", "supplier_id").orderBy("ord")
    fit = fit.withColumn("rank", F.row_number().over(seen)).where(F.col("rank") <= max(3 * limit, 30))
    best = Window.partitionBy("query", "supplier_id").orderBy(F.desc(card_score(F.col("title"), F.col("snippet"), F.col("query"))), "rank")
    fit = fit.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return deduplicate_hits(conform(fit, HIT))


def composite_hits(primary: DataFrame | None, fallback: DataFrame, target: int) -> DataFrame:
    """Primary hits; the fallback only where they are absent or too few; linked ones first, the best ``target``."""
    enough = primary is not None and primary.limit(target).count() >= target
    both = primary if enough else fallback if primary is None else primary.unionByName(fallback.withColumn("ord", F.col("ord") + F.lit(1 << 40)))
    return deduplicate_hits(both).orderBy(F.col("supplier_id").isNull(), "rank", "ord").limit(target)


def provider_failures(calls: DataFrame) -> DataFrame:
    """Per provider: calls, failures, and whether it was refused or throttled."""
    s = F.col("http_status")
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if(s.isNull() | (s >= 400)).alias("failures"), F.bool_or(F.coalesce(s.isin(401, 403), F.lit(False))).alias("refused"), F.bool_or(F.coalesce(s == 429, F.lit(False))).alias("throttled"))


def choose_provider(keys: dict[str, str | None]) -> str:
    """The engine whose key is set, by preference, else the keyless one."""
    return next((name for name in ("yandex", "brave") if keys.get(name)), "duckduckgo")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """URLs with ``allowed`` by their origin's landed robots file (origin, body); no file allows all."""
    origin = F.lower(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1))

    @F.pandas_udf("boolean")
    def allowed(url: pd.Series, body: pd.Series) -> pd.Series:
        rules: dict[str, urllib.robotparser.RobotFileParser] = {}
        out = []
        for u, b in zip(url, body, strict=True):
            if not b:
                out.append(True)
                continue
            if b not in rules:
                if len(rules) > 1000:
                    rules.clear()
                rules[b] = urllib.robotparser.RobotFileParser()
                rules[b].parse(b.splitlines())
            out.append(rules[b].can_fetch(agent, u or ""))
        return pd.Series(out)

    return urls.withColumn("origin", origin).join(robots, "origin", "left").withColumn("allowed", allowed("url", "body")).drop("origin", "body")


def suppliers_from_hits(hits: DataFrame, checked_at: Column) -> DataFrame:
    """A candidate per hit: the title up to a dash or bar is the name; nothing in the snippet counts as a fact."""
    host = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1), r"^www\.", "")
    name = F.coalesce(C.blank_to_null(C.strip(F.get(F.split("title", r"(?U)\s+[|—–-]\s+", 2), F.lit(0)))), host)
    catalog = C.is_catalog("url")
    listing = catalog & C.contains_any(name, K.LISTING_MARKERS)
    kind = F.when(listing, "marketplace").otherwise(F.coalesce(C.typed_by(name, K.LINE_COMPANY_TYPES), F.lit("unknown")))
    site = F.when(~catalog, F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1))
    rows = hits.select(C.url_id("web-", "url").alias("id"), name.alias("name"), kind.alias("company_type"), site.alias("website"), F.concat(F.array("url"), F.coalesce("related_urls", F.array().cast("array<string>"))).alias("source_urls"), F.array("query").alias("discovery_queries"), F.expr("cast(array() as array<struct<field_name:string,value:string,source_url:string,quote:string,confidence:double>>)").alias("evidence"), checked_at.alias("checked_at"))
    return normalize_suppliers(conform(rows, SUPPLIER))
