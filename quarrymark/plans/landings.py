"""Registered queries over landed payloads: contracts, registry cards, places, search answers, and the joins of hits, pages and suppliers.

The payloads are made of the driver tables in the form in which a source answers (JSON, RSS, XML,
HTML, card text), in pages of a bounded size; the parsers read them back. The SQL states what must
come out from the tables alone and never sees a payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.schemas import HIT, PLACES
from ..operators import links, pages
from ..operators.scoring import Request
from ..scratch import Scratch
from ..sources import contracts, places, web
from ..sources.provider import conform
from .catalogue import query, table

REQUEST = Request("сырники", "Екатеринбург")
PAGE = 50


def _checked() -> Column:
    return F.lit("2026-01-01").cast("timestamp")


def _payload(rows: DataFrame, page: Column, order: str, item: Column, name: str) -> DataFrame:
    """(page, items): the items of each page in order; a page holds a bounded stretch of unique keys."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(page.alias("page")).agg(listed.alias(name))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- contracts ----------------------------------------------------------------------------------

_UUID = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode({0}))"
_CONTRACTS = r"""
l AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey * 20 + l_partkey % 20 AS s, CASE WHEN l_partkey % 10 IN (0, 2, 8) THEN 'Сырники ' || p_name WHEN l_partkey % 10 = 6 THEN 'СЫРНИК ' || p_name END AS product,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT k, string_agg(product, '|' ORDER BY n) AS products, count(*) AS many FROM (SELECT k, product, min(n) AS n FROM l WHERE product IS NOT NULL GROUP BY k, product) GROUP BY k),
c AS (SELECT o_orderkey AS k, products, many, o_orderdate, o_custkey % 4 IN (0, 2) AS here, CASE WHEN o_orderkey % 22 = 0 THEN NULL WHEN o_orderkey % 11 IN (0, 1) THEN 'N' || o_orderkey ELSE lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS number FROM orders JOIN g ON k = o_orderkey WHERE o_orderkey % 22 <> 0),
f AS (SELECT c.*, s, 'ООО Компания ' || s AS name, CASE WHEN s % 5 <> 0 THEN CAST(7700000000 + s AS VARCHAR) END AS inn, CASE WHEN c.k % 3 = 0 THEN 'https://z.example/c/' || c.k ELSE 'https://zakupki.gov.ru/epz/contract/contractCard/common-info.html?reestrNumber=' || number END AS official,
  row_number() OVER (PARTITION BY s ORDER BY c.k, n) AS first FROM c JOIN l USING (k) WHERE s % 50 <> 7)"""


def contract_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contracts, api_url, ord): orders as contracts, 50 a payload; every thirteenth is landed again in a later payload, altered."""
    none = F.lit(None).cast("string")

    def product(x: Column) -> Column:
        p, name = x["l_partkey"], x["p_name"]
        return F.struct(F.when(p % 10 == 6, _text("СЫРНИК ", name)).when(p % 10 == 4, _text("Сырники-снек ", name)).when(p % 2 == 0, _text(" Сырники ", name)).otherwise(_text("Творог ", name)).alias("name"))

    def party(k: Column, x: Column) -> Column:
        return C.bind(x["l_suppkey"] * 20 + x["l_partkey"] % 20, lambda s: supplier(k, s))

    def supplier(k: Column, s: Column) -> Column:
        digits = F.lpad((s % 10000000).cast("string"), 7, "0")
        contact = F.struct(F.when(s % 3 == 0, _text("8 912 ", digits)).alias("phone"), F.when(s % 3 == 1, _text("+7 (343) ", digits)).alias("phoneNumber"), F.when(s % 4 == 0, _text(" INFO", s, "@Firm.RU ")).when(s % 4 == 1, "no address").alias("email"))
        return F.struct(F.when(s % 50 != 7, _text(" ООО Компания ", s, " ")).alias("organizationName"), F.when(s % 5 != 0, (s + 7700000000).cast("string")).alias("inn"), F.when(k % 2 == 0, _text("ул. Мира, ", k)).otherwise("").alias("factualAddress"), _text("а/я ", k).alias("postalAddress"), contact.alias("contactInfo"))

    again = lambda key: F.explode(F.when(F.col(key) % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    page = lambda key: (F.floor(F.col(key) / PAGE) + F.col("again") * 1000000000).alias("page")
    # lines and orders are dealt by page once, and need no further shuffle up to the payload; its texts are made page by page
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", again("l_orderkey")).select("*", page("l_orderkey")).drop("again").repartition("page")
    listed = lines.groupBy("page", "l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", again("o_orderkey")).select("*", page("o_orderkey")).repartition("page")
    rows = orders.join(listed.withColumnRenamed("l_orderkey", "o_orderkey"), ["page", "o_orderkey"])
    packed = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderdate", "again", "lines"))).alias("data"))

    def contract(x: Column) -> Column:
        k, c, again = x["o_orderkey"], x["o_custkey"] % 4, x["again"]
        return F.struct(
            F.when(k % 11 == 0, none).when(k % 11 == 1, "").otherwise(F.lpad(k.cast("string"), 10, "0")).alias("regNum"), F.when(k % 22 != 0, _text("N", k)).alias("number"),
            F.when(k % 17 != 0, F.date_format(F.date_add(x["o_orderdate"], again), "yyyy-MM-dd'T'HH:mm:ss")).alias("signDate"), F.when(again == 1, "66").when(c == 0, "66").when(c == 1, "77").alias("regionCode"),
            F.when(k % 3 == 0, _text("http://z.example/c/", k)).when(k % 3 == 1, "").otherwise("ftp://z.example/").alias("contractUrl"),
            F.struct(F.when(c == 2, "").when(c == 3, "Москва").alias("postalAddress"), F.when(c == 2, "г. Екатеринбург, 620066").alias("legalAddress")).alias("customer"),
            F.transform(x["lines"], product).alias("products"), F.transform(x["lines"], lambda line: party(k, line)).alias("suppliers"))

    packed = packed.withColumn("data", F.transform("data", contract)).select("page", F.to_json(F.struct(F.struct(F.size("data").alias("total"), "data").alias("contracts"))).alias("payload"))
    return packed.select(F.from_json("payload", contracts.CONTRACTS)["contracts"].alias("contracts"), _text("https://api.example/", F.col("page")).alias("api_url"), F.col("page").alias("ord"))


@query(rf"""WITH {_CONTRACTS}, h AS (SELECT *, {_UUID.format("coalesce(inn, name)")} AS h, CASE WHEN s % 3 < 2 THEN '+7' || CASE WHEN s % 3 = 0 THEN '912' ELSE '343' END || lpad(CAST(s % 10000000 AS VARCHAR), 7, '0') END AS phone, CASE WHEN s % 4 = 0 THEN 'info' || s || '@firm.ru' END AS email FROM f WHERE first = 1)
 SELECT 'contracts-' || h[1:12] || '5' || h[14:16] AS id, name, inn, products, CASE WHEN here THEN 'Екатеринбург' ELSE '' END AS regions, phone, email, CASE WHEN k % 2 = 0 THEN 'ул. Мира, ' ELSE 'а/я ' END || k AS address, 'https://api.example/' || k // 50 || ' ' || official AS urls,
  many + 2 + CASE WHEN inn IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN phone IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN email IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN here THEN 1 ELSE 0 END AS facts FROM h""")
def contract_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies that delivered the product under any contract, with all facts of their first one."""
    found = contracts.contract_suppliers(contract_payloads(spark, sf_dir), REQUEST, _checked(), None).suppliers
    return found.select("id", "name", "inn", F.array_join("contract_products", "|").alias("products"), F.array_join("regions", "|").alias("regions"), "phone", "email", "address", F.array_join("source_urls", " ").alias("urls"), F.size("evidence").cast("long").alias("facts"))


@query(rf"""WITH {_CONTRACTS} SELECT official AS url, 'контракт № ' || number || ', дата ' || CASE WHEN k % 17 = 0 THEN 'не указана' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS note, name AS supplier_name FROM f WHERE first = 1""")
def contract_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract that each of those companies was found by."""
    return contracts.contract_suppliers(contract_payloads(spark, sf_dir), REQUEST, _checked(), None).sources.select("url", "note", "supplier_name")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT count(*) AS contracts, strftime(max(CASE WHEN k % 17 <> 0 THEN CAST(o_orderdate AS DATE) + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END), '%Y-%m-%d') AS newest FROM orders JOIN l ON k = o_orderkey WHERE k % 22 <> 0""")
def contract_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.contract_stats(contract_payloads(spark, sf_dir))


# ---- registry -----------------------------------------------------------------------------------


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'сырники' ELSE 'творог' END AS query, CASE o_orderkey % 3 WHEN 0 THEN 'https://zakupki.gov.ru/epz/card?reestrNumber=' || 1660000000000000 + o_orderkey || '&x=1' WHEN 1 THEN 'https://other.example/?reestrNumber=' || 1660000000000000 + o_orderkey ELSE 'https://zakupki.gov.ru/epz/view' END AS url,
 CAST(1660000000000000 + o_orderkey AS VARCHAR) AS registry_number, CASE WHEN o_orderkey % 3 = 2 THEN 'Номер реестровой записи контракта: ' || 1660000000000000 + o_orderkey ELSE 'Контракт' END AS description FROM orders WHERE o_orderkey % 3 < 2 OR o_orderkey % 7 > 0""")
def registry_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items of two queries' feeds, a feed for 50 keys; every third is repeated in a later feed of another query."""
    k = F.col("o_orderkey")
    number = (k + 1660000000000000).cast("string")
    link = F.when(k % 3 == 0, _text(" /epz/card?reestrNumber=", number, "&amp;x=1")).when(k % 3 == 1, _text("https://other.example/?reestrNumber=", number)).otherwise("/epz/view")
    about = F.when(k % 3 < 2, F.lit("Контракт")).when(k % 7 > 0, _text("Номер реестровой записи контракта: ", number)).otherwise("№ 123")
    item = _text("<item><title>т</title><link>", link, "</link><description>", about, "</description></item>")
    rows = table(spark, sf_dir, "orders").withColumn("again", F.explode(F.when(k % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    wanted = F.when(F.col("again") == 1, "снова").when(k % 5 == 0, "сырники").otherwise("творог")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]), "")
    feeds = rows.groupBy(wanted.alias("query"), F.floor(k / PAGE).alias("page")).agg(listed.alias("items"))
    later = F.when(F.col("query") == "снова", F.lit(1 << 40)).otherwise(F.lit(0))
    feeds = feeds.select("query", _text("<rss><channel>", F.col("items"), "</channel></rss>").alias("xml"), (F.col("page") * 2 + (F.col("query") == "творог").cast("int") + later).alias("ord"))
    return contracts.parse_rss(feeds).select("query", "url", "registry_number", "description")


@query(rf"""WITH l AS (SELECT l_orderkey AS k, arg_min(product, struct_pack(n := length(product), l := l_linenumber, p := l_partkey)) AS quote FROM (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'Сырники ' ELSE 'Творог ' END || p_name AS product FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE l_partkey % 2 = 0 GROUP BY 1),
 a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey % 4 > 0),
 c AS (SELECT o_orderkey AS k, o_custkey AS s, a.k IS NOT NULL AS goods, CASE WHEN o_orderkey % 4 > 0 THEN quote END AS quote, CASE WHEN o_custkey % 6 > 0 THEN CAST(7700000000 + o_custkey AS VARCHAR) END AS inn, CASE WHEN o_custkey % 3 = 0 THEN '8 912 ' || lpad(CAST(o_custkey % 10000000 AS VARCHAR), 7, '0') END AS raw, o_orderkey % 2 = 0 AS here FROM orders LEFT JOIN l ON l.k = o_orderkey LEFT JOIN a ON a.k = o_orderkey WHERE o_custkey % 9 <> 4),
 h AS (SELECT *, {_UUID.format("'https://z.example/common/' || k")} AS h FROM c)
 SELECT k AS card, coalesce('eis-' || inn, 'eis-' || h[1:12] || '5' || h[14:16]) AS id, 'ООО Компания ' || s AS name, inn, '+7' || replace(raw[3:], ' ', '') AS phone, CASE WHEN s % 4 = 0 THEN 'info' || s || '@firm.ru' END AS email, CASE WHEN here THEN 'Екатеринбург' ELSE '' END AS regions, coalesce(quote, '') AS products,
  CASE WHEN goods THEN 2 ELSE 1 END AS pages, 1 + CASE WHEN inn IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quote IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN here THEN 1 ELSE 0 END + CASE WHEN raw IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN s % 4 = 0 THEN 1 ELSE 0 END AS facts FROM h""")
def registry_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registry cards of two pages; every fourth has no page of goods, some have no supplier section or tax number."""
    k, s = F.col("o_orderkey"), F.col("o_custkey")
    number = k.cast("string").alias("registry_number")
    section = F.when(s % 9 != 4, _text("Информация о поставщиках\nОрганизация\n ООО Компания ", s, "\n"))
    tax = F.when(s % 6 > 0, _text("ИНН:\nкод\n", s + 7700000000, "\n")).otherwise("")
    contact = F.concat(F.when(s % 3 == 0, _text("8 912 ", F.lpad((s % 10000000).cast("string"), 7, "0"), "\n")).otherwise(""), F.when(s % 4 == 0, _text("Info", s, "@firm.ru\n")).otherwise(""))
    place = _text("Информация о контракте\n", K.DELIVERY_PLACE, "\n", F.when(k % 2 == 0, "г. ЕКАТЕРИНБУРГ").otherwise("г. Пермь"), "\n8 999 1112233\nzakaz@gov.example.ru")
    orders = table(spark, sf_dir, "orders")
    common = orders.select(number, _text("https://z.example/common/", k).alias("url"), F.concat(F.coalesce(section, F.lit("")), tax, contact, place).alias("text"))
    product = F.concat(F.when(F.col("l_partkey") % 2 == 0, "Сырники  ").otherwise("Творог "), "p_name")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).where("l_orderkey % 4 > 0")
    goods = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", product.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    goods = goods.select(F.col("l_orderkey").cast("string").alias("registry_number"), _text("https://z.example/goods/", F.col("l_orderkey")).alias("url"), "text")
    cards = contracts.join_card_pages(orders.select(number, F.lit("10.51.40").alias("query")), common, goods)
    found = contracts.registry_suppliers(cards, REQUEST, _checked())
    card = F.split_part(F.col("source_urls")[0], F.lit("/"), F.lit(5)).cast("long")
    return found.select(card.alias("card"), "id", "name", "inn", "phone", "email", F.array_join("regions", "|").alias("regions"), F.array_join("contract_products", "|").alias("products"), F.size("source_urls").cast("long").alias("pages"), F.size("evidence").cast("long").alias("facts"))


# ---- places -------------------------------------------------------------------------------------

_PLACES = """
p AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN 'Склад ' || c_name WHEN c_custkey % 5 = 0 THEN 'Завод ' || c_name WHEN c_custkey % 5 = 1 THEN 'Фабрика, магазин у дома ' || c_name ELSE c_name END AS name, c_mktsegment AS segment,
  CASE c_custkey % 4 WHEN 0 THEN 'https://2gis.ru/firm/' || c_custkey WHEN 1 THEN 'https://x.example/f/' || c_custkey WHEN 2 THEN 'https://2gis.ru/city/' || c_custkey ELSE 'http://y.example/' || c_custkey END AS url, CASE WHEN c_custkey % 3 = 0 THEN 'https://firm' || c_custkey || '.ru' WHEN c_custkey % 3 = 1 THEN 'http://firm.ru/' || c_custkey END AS website FROM customer WHERE c_custkey % 40 <> 0 AND c_custkey % 7 <> 1)"""


def place_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(meta, result, ord): customers as organisation cards, 50 an answer; every third in a later answer again, and refused answers."""
    k = F.col("c_custkey")
    name = F.when(k % 7 < 2, F.lit("  ")).when(k % 5 == 0, _text(" Завод ", F.col("c_name"))).when(k % 5 == 1, _text("Фабрика, магазин у дома ", F.col("c_name"))).otherwise(F.col("c_name"))
    link = F.when(k % 4 == 1, _text("//x.example/f/", k)).when(k % 4 == 2, _text("/city/", k)).when(k % 4 == 3, _text("http://y.example/", k, "/"))
    of = lambda kind, value, text=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), text.alias("text"))
    phones = F.array(of("phone", F.lit(" ")), of("phone", F.lit(None), _text("8 (343) ", F.lpad((k % 10000000).cast("string"), 7, "0"))), of("phone", F.lit("8 912 0000000")))
    others = F.array(of("email", F.when(k % 2 == 0, _text("Mail", k, "@firm.ru"))), of("website", F.when(k % 3 == 0, _text("firm", k, ".ru/")).when(k % 3 == 1, _text("http://www.firm.ru/", k))))
    named = lambda *v: F.array(*[F.struct(x.alias("name")) for x in v])
    card = F.struct(
        F.when(k % 40 != 0, k.cast("string")).alias("id"), F.when(F.col("again") == 1, "Позже").otherwise(name).alias("name"), F.when(k % 7 == 0, _text("Склад ", F.col("c_name"))).alias("full_name"), _text(" ул. Мира, ", k).alias("address_name"), link.alias("link"),
        named(F.lit("Продукты"), F.col("c_mktsegment"), F.lit(" "), F.lit("Продукты")).alias("rubrics"), named(F.lit("ЕКБ"), F.lit("Свердловская обл.")).alias("adm_div"), F.struct(F.when(k % 10 == 3, _text("o", k)).alias("id"), _text("ООО ", k).alias("name")).alias("org"),
        F.array(F.struct(phones.alias("contacts")), F.struct(F.lit(None).cast("array<struct<type:string,value:string,text:string>>").alias("contacts")), F.struct(others.alias("contacts"))).alias("contact_groups"))
    rows = table(spark, sf_dir, "customer").withColumn("again", F.explode(F.when(k % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    packed = _payload(rows, F.floor(k / PAGE) + F.col("again") * 1000000000, "c_custkey", card, "items")
    answers = packed.select("page", F.to_json(F.struct(F.struct(F.lit("200").alias("code")).alias("meta"), F.struct("items").alias("result"))).alias("payload"))
    failed = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("page"), F.when(F.col("n_nationkey") % 2 == 0, _text('{"meta":{"code":', F.col("n_nationkey") + 400, ',"error":{"message":" "}}}')).otherwise(_text('{"meta":{"code":403,"error":{"message":" нет доступа ', F.col("n_nationkey"), '"}}}')).alias("payload"))
    return answers.unionByName(failed).select(F.from_json("payload", PLACES).alias("x"), F.col("page").alias("ord")).select("x.*", "ord")


@query(rf"""WITH {_PLACES} SELECT '2gis-' || CASE WHEN k % 10 = 3 THEN 'o' ELSE '' END || id AS id, name, 'ООО ' || id AS legal_name, CASE WHEN k % 7 = 0 THEN 'wholesaler' WHEN k % 5 = 0 THEN 'manufacturer' WHEN k % 5 = 1 THEN 'retailer' ELSE 'unknown' END AS company_type, 'Продукты|' || segment AS categories,
 'Екатеринбург|Свердловская область' AS regions, 'ул. Мира, ' || id AS address, '+7343' || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') AS phone, CASE WHEN k % 2 = 0 THEN 'mail' || id || '@firm.ru' END AS email, website, CASE WHEN k % 3 = 0 THEN 'firm' || id || '.ru' WHEN k % 3 = 1 THEN 'firm.ru' END AS domain,
 url || CASE WHEN website IS NOT NULL THEN ' ' || website ELSE '' END AS urls, 7 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 1 ELSE 0 END AS facts FROM p""")
def place_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies of all cards with their contacts, kinds and evidence; the first card of an id counts."""
    found = places.place_suppliers(place_payloads(spark, sf_dir), "сырники", _checked(), None).suppliers
    return found.select("id", "name", "legal_name", "company_type", F.array_join("product_categories", "|").alias("categories"), F.array_join("regions", "|").alias("regions"), "address", "phone", "email", "website", "domain", F.array_join("source_urls", " ").alias("urls"), F.size("evidence").cast("long").alias("facts"))


@query(rf"""WITH {_PLACES}, r AS (SELECT name AS supplier_name, CASE WHEN k % 4 = 3 THEN url || '/' ELSE url END AS url, 'ok' AS status, 'organization_api' AS source_kind, 'карточка организации' AS note FROM p
 UNION ALL SELECT name, CASE WHEN k % 3 = 0 THEN website || '/' ELSE replace(website, '://', '://www.') END, 'skipped', 'official_site', 'сайт из карточки; загрузка ещё не выполнялась' FROM p WHERE website IS NOT NULL
 UNION ALL SELECT NULL, NULL, 'failed', 'organization_api', CASE WHEN n_nationkey % 2 = 0 THEN 'ошибка API ' || (400 + n_nationkey) ELSE 'нет доступа ' || n_nationkey END FROM nation)
 SELECT supplier_name, url, CASE WHEN url IS NULL THEN '2gis.ru' ELSE regexp_replace(split_part(url, '/', 3), '^www\.', '') END AS domain, status, source_kind, note FROM r""")
def place_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards and websites as sources, refused answers with their message."""
    return places.place_suppliers(place_payloads(spark, sf_dir), "сырники", _checked(), None).sources.select("supplier_name", "url", "domain", "status", "source_kind", "note")


# ---- search answers -----------------------------------------------------------------------------

_FOUND = """f AS (SELECT p_partkey AS k, p_partkey // 20 AS page, 'https://shop' || p_partkey % 37 || '.ru/p/' || p_partkey % 700 AS url, p_name, CASE WHEN (p_partkey // 20) % 3 = 0 THEN 's' || p_partkey // 20 END AS supplier_id, p_partkey // 20 * 1000 + p_partkey % 20 AS ord FROM part WHERE p_partkey % 29 <> 0 AND p_partkey % 31 <> 0),
 w AS (SELECT *, min(ord) OVER (PARTITION BY url) AS first, row_number() OVER (PARTITION BY url ORDER BY supplier_id IS NULL, ord) AS place FROM f)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as results, twenty an answer; some of blocked sites, some without a URL."""
    k = F.col("p_partkey")
    url = F.when(k % 29 == 0, _text("https://www.avito.ru/", k)).when(k % 31 != 0, _text("https://WWW.shop", k % 37, ".ru/p/", k % 700, "/?utm_source=x#top")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(k / 20).alias("ord"), url.alias("url"), "p_name", F.lit("сырники").alias("query")).withColumn("supplier_id", F.when(F.col("ord") % 3 == 0, _text("s", F.col("ord"))))


def _answers(rows: DataFrame, item: Column, pack) -> DataFrame:
    listed = rows.groupBy("ord", "query", "supplier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return listed.select("query", "supplier_id", pack(F.col("items")).alias("payload"), "ord")


@query(rf"""WITH {_FOUND}, e AS (SELECT unnest(['brave', 'yandex']) AS provider) SELECT provider, url, 'Сырники & ' || p_name AS title, 'опт ' || k AS snippet, supplier_id, CASE WHEN provider = 'brave' THEN k % 20 + 1 ELSE k % 20 + 1 - (SELECT count(*) FROM part q WHERE q.p_partkey // 20 = w.page AND q.p_partkey < w.k AND q.p_partkey % 31 = 0 AND q.p_partkey % 29 <> 0) END AS rank FROM w, e WHERE place = 1""")
def answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results as JSON and as base64-coded XML: a hit per URL, one that names a supplier before others."""
    rows, k = _found(spark, sf_dir), F.col("p_partkey")
    js = _answers(rows, F.struct(F.when(F.col("url") != "", F.col("url")).alias("url"), _text("<b>Сырники</b> &amp; ", F.col("p_name")).alias("title"), _text("опт  ", k).alias("description")), lambda x: F.to_json(F.struct(F.struct(x.alias("results")).alias("web"))))
    doc = _text("<group><doc><url>", F.col("url"), "</url><title>Сырники &amp; ", F.col("p_name"), "</title><passages><passage>опт</passage><passage>", k, "</passage></passages></doc></group>")
    xml = _answers(rows, doc, lambda x: F.base64(F.encode(_text("<yandexsearch><response><results><grouping>", F.array_join(x, ""), "</grouping></results></response></yandexsearch>"), "UTF-8")))
    return web.json_hits(js).unionByName(web.xml_hits(xml)).select("provider", "url", "title", "snippet", "supplier_id", F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {_FOUND} SELECT url, 'Сырники & ' || p_name AS title, CASE WHEN k % 4 = 0 THEN '' ELSE 'опт ' || k END AS snippet, supplier_id FROM w WHERE place = 1""")
def html_answer_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results as HTML with redirects, nested and unclosed elements."""
    rows, k = _found(spark, sf_dir), F.col("p_partkey")
    link = F.when(F.col("url") == "", F.lit("")).when(k % 2 == 0, _text("//duckduckgo.com/l/?rut=1&amp;uddg=", F.url_encode("url"))).otherwise(F.col("url"))
    block = _text('<div class="result web"><h2><a rel="nofollow" class="result__a" href="', link, '">Сырники\n <b>&amp;</b> ', F.col("p_name"), "</a></h2>", F.when(k % 4 == 0, F.lit("<br>")).otherwise(_text('<p><a class="result__snippet">опт ', k, "</a>")), "</div>")
    return web.html_hits(_answers(rows, block, lambda x: _text("<html><body>", F.array_join(x, "\n"), "</body></html>"))).select("url", "title", "snippet", "supplier_id")


@query("""WITH f AS (SELECT p_partkey AS k, p_partkey // 20 AS page, 'Сырники ' || p_name AS product, CASE p_partkey % 4 WHEN 0 THEN 'опт' WHEN 1 THEN 'опт, ГОСТ' WHEN 2 THEN 'с гречкой' ELSE 'прайс' END AS words FROM part WHERE p_partkey % 5 > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY CASE k % 4 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END DESC, k) AS rank FROM f)
 SELECT 'https://productcenter.ru/products/' || k AS url, CASE WHEN k % 3 = 0 THEN 'ООО ' || k ELSE product END AS title, product || ' — ' || words AS snippet, 's' || page AS supplier_id, rank, CASE WHEN k % 3 = 0 THEN 'https://productcenter.ru/producers/' || CASE WHEN k % 2 = 0 THEN 7 ELSE 1 END || '/x' ELSE '' END AS related FROM r""")
def catalog_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalogue cards: those that match the query, the best words first."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.floor(k / 20).alias("ord"), F.lit("купить сырники").alias("query"), _text("s", F.floor(k / 20)).alias("supplier_id"))
    words = F.when(k % 4 == 0, "опт").when(k % 4 == 1, "опт, ГОСТ").when(k % 4 == 2, "с гречкой").otherwise("прайс")
    name = F.when(k % 10 == 0, _text("Творог ", F.col("p_name"))).when(k % 10 == 5, _text("Сырники и котлеты ", F.col("p_name"))).otherwise(_text("Сырники ", F.col("p_name")))
    company = F.when(k % 3 == 0, F.concat(_text('<div class="ii_company" title="Компания: ООО ', k, '"><a href="/producers/1/x">о</a></div>'), F.when(k % 2 == 0, F.lit('<i data-producer-id="7"></i>')).otherwise(""))).otherwise("")
    card = _text('<div class="product card_item"><a class="link" href="/products/', k, '">', name, '</a><p class="item_descriptor">', words, "</p>", company, "</div>")
    hits = web.catalog_hits(_answers(rows, card, lambda x: F.array_join(x, "")))
    return hits.select("url", "title", "snippet", "supplier_id", F.col("rank").cast("long").alias("rank"), F.array_join("related_urls", " ").alias("related"))


# ---- hits, pages and suppliers --------------------------------------------------------------------

_LINKS = """
s AS (SELECT c_custkey AS k, 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'https://site' || c_custkey % 300 || '.ru' END AS site, c_name FROM customer),
f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'https://tiu.ru/x' || o_orderkey % 4001 ELSE 'https://site' || o_custkey % 300 || '.ru/p' || o_orderkey % 4001 END AS url, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'x' || o_custkey ELSE 'c' || o_custkey END AS sid, 'q' || o_orderkey % 3 AS q FROM orders),
w AS (SELECT *, min(k) OVER (PARTITION BY url) AS ord, row_number() OVER (PARTITION BY url ORDER BY sid IS NULL, k) AS place FROM f),
h AS (SELECT *, 'https://doc.example/' || k % 9 AS related FROM w WHERE place = 1)"""


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as suppliers; every fourth has a website."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(_text("c", k).alias("id"), F.col("c_name").alias("name"), F.when(k % 4 == 0, _text("https://site", k % 300, ".ru")).alias("website"), F.array(F.lit("own")).alias("discovery_queries"), F.expr("cast(array() as array<string>)").alias("source_urls"), k.alias("ord"))
    return rows.withColumn("domain", C.normalize_domain("website"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of customers' sites and of a catalogue; some name a supplier that isn't known, some none."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    url = F.when(k % 5 == 0, _text("https://tiu.ru/x", k % 4001, "/")).otherwise(_text("https://www.site", c % 300, ".ru/p", k % 4001, "#a"))
    rows = table(spark, sf_dir, "orders").select(url.alias("url"), _text("q", k % 3).alias("query"), F.lit("web").alias("provider"), F.when(k % 7 == 1, _text("x", c)).when(k % 7 != 0, _text("c", c)).alias("supplier_id"), F.array(_text("https://doc.example/", k % 9)).alias("related_urls"), k.alias("ord"))
    return pages.deduplicate_hits(conform(rows, HIT))


@query(f"""WITH {_LINKS}, q AS (SELECT sid, string_agg(q, '|' ORDER BY ord) AS queries FROM (SELECT sid, q, min(ord) AS ord FROM h GROUP BY sid, q) GROUP BY sid), e AS (SELECT sid, url AS u, ord * 2 AS o FROM h UNION ALL SELECT sid, related, ord * 2 + 1 FROM h),
 u AS (SELECT sid, string_agg(u, ' ' ORDER BY o) AS urls FROM (SELECT sid, u, min(o) AS o FROM e GROUP BY sid, u) GROUP BY sid), t AS (SELECT sid, 'https://' || split_part(arg_min(url, ord), '/', 3) AS site FROM h WHERE url NOT LIKE 'https://tiu.ru%' GROUP BY sid)
 SELECT id, coalesce('own|' || queries, 'own') AS queries, coalesce(urls, '') AS urls, coalesce(s.site, t.site) AS website, replace(coalesce(s.site, t.site), 'https://', '') AS domain FROM s LEFT JOIN q ON q.sid = id LEFT JOIN u ON u.sid = id LEFT JOIN t ON t.sid = id""")
def hits_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the queries, URLs and the website that their hits give them."""
    out = links.attach_hits(_suppliers(spark, sf_dir), _hits(spark, sf_dir))
    return out.select("id", F.array_join("discovery_queries", "|").alias("queries"), F.array_join("source_urls", " ").alias("urls"), "website", "domain")


@query(f"""WITH {_LINKS} SELECT url, sid AS supplier_id, q AS query, ord FROM h WHERE sid IS NULL OR sid NOT IN (SELECT id FROM s)""")
def hits_unattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.unattached_hits(_suppliers(spark, sf_dir), _hits(spark, sf_dir)).select("url", "supplier_id", "query", "ord")


@query(f"""WITH {_LINKS}, d AS (SELECT site, arg_max(c_name, k) AS by_domain FROM s WHERE site IS NOT NULL GROUP BY site)
 SELECT url, split_part(url, '/', 3) AS domain, coalesce(s.c_name, by_domain) AS supplier_name, q AS discovery_query FROM h LEFT JOIN s ON s.id = sid LEFT JOIN d ON d.site = 'https://' || split_part(url, '/', 3)""")
def hit_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the supplier they name, else the last one of their domain."""
    return links.hit_sources(_hits(spark, sf_dir), _suppliers(spark, sf_dir)).select("url", "domain", "supplier_name", "discovery_query")


@query(f"""WITH {_LINKS}, a AS (SELECT url, 0 AS kind, ord FROM h UNION ALL SELECT related, 1, ord FROM h UNION ALL SELECT site, 2, k FROM s WHERE site IS NOT NULL) SELECT url, min(kind) AS kind, arg_min(ord, kind * 1000000000000 + ord) AS ord FROM a GROUP BY url""")
def urls_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, then related pages, then websites, in the order of first mention."""
    return links.fetch_urls(_suppliers(spark, sf_dir), _hits(spark, sf_dir)).select("url", F.col("ord.k").cast("long").alias("kind"), F.col("ord.ord").alias("ord"))


_OWNERS = f"""{_LINKS}, u AS (SELECT sid AS id, url AS u FROM h UNION SELECT sid, related FROM h), t AS (SELECT sid, 'https://' || split_part(arg_min(url, ord), '/', 3) AS site FROM h WHERE url NOT LIKE 'https://tiu.ru%' GROUP BY sid),
 d AS (SELECT id, replace(coalesce(s.site, t.site), 'https://', '') AS domain FROM s LEFT JOIN t ON t.sid = id), p AS (SELECT url, ord, CASE WHEN ord % 6 = 0 THEN 'https://site' || ord % 300 || '.ru' ELSE url END AS final FROM h),
 o AS (SELECT s.id AS supplier_id, url FROM p JOIN u ON u.u IN (p.url, p.final) JOIN s USING (id) UNION SELECT id, url FROM p JOIN d ON d.domain = split_part(p.final, '/', 3))"""


def _owned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers with their hits, and a page for every hit (every sixth redirected to another site); written once, as owners are sought by several keys."""
    scratch = Scratch(spark, "owned")
    found = scratch.write(_hits(spark, sf_dir), "hits")
    attached = scratch.write(links.attach_hits(_suppliers(spark, sf_dir), found).select("id", "website", "domain", "source_urls", "ord"), "suppliers")
    landed = found.select("url", F.when(F.col("ord") % 6 == 0, _text("https://www.site", F.col("ord") % 300, ".ru/")).otherwise(F.col("url")).alias("final_url"), "ord")
    return attached, landed


@query(f"WITH {_OWNERS} SELECT supplier_id, url FROM o")
def pages_of_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that belong to a supplier by URL, or by a domain that is no catalogue."""
    attached, landed = _owned(spark, sf_dir)
    return links.page_owners(landed, attached)


@query(f"WITH {_OWNERS} SELECT url, arg_min(supplier_id, k) AS supplier_id FROM o JOIN s ON id = supplier_id GROUP BY url")
def first_page_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    attached, landed = _owned(spark, sf_dir)
    return links.first_page_owners(landed, attached)


@query(f"""WITH {_OWNERS}, r AS (SELECT supplier_id, url, row_number() OVER (PARTITION BY supplier_id ORDER BY ord, url) AS n FROM o JOIN p USING (url)), b AS (SELECT id FROM s WHERE id IN (SELECT supplier_id FROM o) ORDER BY k LIMIT 6) SELECT supplier_id, url FROM r JOIN b ON id = supplier_id WHERE n <= 2""")
def pages_for_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of the first six suppliers that have any (the operator's limits)."""
    attached, landed = _owned(spark, sf_dir)
    return links.first_pages(attached, landed).select("supplier_id", "url")
