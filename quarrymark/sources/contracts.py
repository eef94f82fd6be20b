"""State contracts landed as JSON, and registry cards landed as RSS and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.schemas import CONTRACTS, SUPPLIER
from ..operators.entities import normalize_suppliers
from ..operators.pages import first_wins
from ..operators.scoring import Request
from .landed import read_landed
from .provider import Provider, Result, conform, contract_queries

CARD = "https://zakupki.gov.ru/epz/contract/contractCard/common-info.html?reestrNumber="
NONE = "cast(array() as array<string>)"


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads, one JSON document per file, with their file as api_url and ordinal."""
    return spark.read.schema(CONTRACTS).option("multiLine", True).json(path).select("contracts", F.col("_metadata.file_path").alias("api_url")).withColumn("ord", F.col("api_url"))


def landed_contracts(path: str, checked_at: Column, most: int = 50) -> Provider:
    """A provider over a landing: reads the request's region and queries alone, the newest contracts of each."""

    def provide(spark: SparkSession, request: Request) -> Result:
        rows = read_landed(spark, path, most).where(F.col("category").isin(contract_queries(request)))
        if request.region:
            code = next((c for name, c in K.REGION_CODES.items() if name in request.region.lower()), None)
            rows = rows.where(F.col("region") == code) if code else rows
        parsed = rows.select(F.from_json("payload", CONTRACTS)["contracts"].alias("contracts"), F.lit(path).alias("api_url"), F.struct(F.concat_ws("|", "category", "region", "number").alias("name"), F.sha2("payload", 256).alias("payload")).alias("ord")).dropDuplicates(["ord"])
        return contract_suppliers(parsed, request, checked_at)

    return provide


def contract_url(raw: Column, number: Column) -> Column:
    upgraded = F.regexp_replace(raw, "^http://", "https://")
    return F.when(F.startswith(upgraded, F.lit("https://")), upgraded).otherwise(F.concat(F.lit(CARD), number))


def customer_address(contract: Column) -> Column:
    c = contract["customer"]
    return F.coalesce(C.blank_to_null(c["postalAddress"]), C.blank_to_null(c["legalAddress"]), F.lit(""))


def in_region(contract: Column, region: str) -> Column:
    code = C.region_code(F.lit(region))
    return F.coalesce((contract["regionCode"] == code) | F.contains(customer_address(contract), code), F.lit(False))


def matching_products(products: Column, category: str) -> Column:
    """Names that hold every word of the category and no foreign prepared food, cut and distinct."""
    wanted = C.plain_tokens(F.lit(category), K.CONTRACT_STOP_WORDS)
    names = F.filter(F.transform(products, lambda p: C.strip(p["name"])), lambda n: n.isNotNull())
    fit = F.filter(names, lambda n: ~C.conflicts(n, F.lit(category), K.CONTRACT_CONFLICTS) & C.all_stems_found(wanted, C.plain_tokens(n)))
    return F.array_distinct(F.transform(fit, lambda n: F.substring(n, 1, 240)))


def _evidence(field: str, value: Column, url: Column, confidence: float, quote: Column | None = None) -> Column:
    q = value if quote is None else quote
    return F.when(C.blank_to_null(value).isNotNull(), F.struct(F.lit(field).alias("field_name"), value.alias("value"), url.alias("source_url"), q.alias("quote"), F.lit(confidence).alias("confidence")))


def contract_suppliers(payloads: DataFrame, request: Request, checked_at: Column, max_suppliers: int | None = 12) -> Result:
    """Contract parties with the products they delivered: first contract per number, first record per company, then the cut; None keeps all.

    Numbers, keys and places alone are shuffled to find those records; then each payload gives the few that are its own.
    ``ord`` names a payload.
    """
    inn_of = lambda s: C.blank_to_null(C.strip(s["inn"]))
    name_of = lambda s: C.blank_to_null(C.strip(s["organizationName"]))
    number_of = lambda c: F.coalesce(C.blank_to_null(c["regNum"]), C.blank_to_null(c["number"]))
    products_of = lambda c: matching_products(c["products"], request.category)
    key_of = lambda s: F.concat(F.coalesce(inn_of(s), F.lit("")), F.lit("|"), F.lower(name_of(s)))  # noqa: E731  null without a name
    # outer: else a filter on the size is put before it, which parses every payload again; empty ones have no number
    contracts = payloads.select("ord", F.posexplode_outer("contracts.data").alias("pos", "c"))
    keys = F.when(F.size(products_of(F.col("c"))) > 0, F.transform("c.suppliers", key_of))
    contracts = contracts.select("ord", "pos", number_of(F.col("c")).alias("number"), keys.alias("keys")).where("number is not null")
    parties = first_wins(contracts, ["number"], ["ord", "pos"]).select("ord", "pos", F.posexplode("keys").alias("spos", "_key")).where("_key is not null")
    parties = first_wins(parties, ["_key"], ["ord", "pos", "spos"]).drop("_key")
    if max_suppliers is not None:
        parties = parties.orderBy("ord", "pos", "spos").limit(max_suppliers)
    places = parties.groupBy("ord").agg(F.collect_list(F.struct("pos", "spos")).alias("_places"))

    def party(c: Column, s: Column) -> Column:
        local = in_region(c, request.region) if request.region else F.lit(False)
        return F.struct(
            number_of(c).alias("number"), products_of(c).alias("products"), c["contractUrl"].alias("raw_url"), F.substring(c["signDate"], 1, 10).alias("signed"),
            local.alias("local"), F.when(local, customer_address(c)).alias("customer"), s.alias("s"))

    own = F.transform("_places", lambda p: C.bind(F.get(F.col("contracts.data"), p["pos"]), lambda c: party(c, F.get(c["suppliers"], p["spos"]))))
    rows = payloads.join(places.hint("shuffle_hash"), "ord").select("api_url", F.explode(own).alias("_party")).select("api_url", "_party.*")
    rows = rows.withColumns({"name": name_of(F.col("s")), "inn": inn_of(F.col("s"))})
    phone = F.coalesce(C.blank_to_null(C.strip("s.contactInfo.phone")), C.blank_to_null(C.strip("s.contactInfo.phoneNumber")))
    email = C.normalize_email("s.contactInfo.email")
    address = F.coalesce(C.blank_to_null(C.strip("s.factualAddress")), C.blank_to_null(C.strip("s.postalAddress")))
    local = F.col("local")
    regions = F.when(local, F.array(F.lit(request.region))).otherwise(F.expr(NONE))
    official, api = contract_url(F.coalesce(F.col("raw_url"), F.lit("")), F.col("number")), F.col("api_url")
    single = [_evidence(f, v, api, 0.78) for f, v in (("legal_name", F.col("name")), ("inn", F.col("inn")), ("address", address), ("phone", phone), ("email", email))]
    place = F.when(local, _evidence("regions", F.lit(request.region), api, 0.75, F.coalesce(C.blank_to_null("customer"), F.lit(request.region))))
    evidence = F.concat(F.transform("products", lambda p: _evidence("contract_products", p, api, 0.78)), F.array_compact(F.array(*single, place)))
    suppliers = rows.select(
        C.url_id("contracts-", F.coalesce("inn", "name")).alias("id"), "name", F.col("name").alias("legal_name"), "inn", F.lit("unknown").alias("company_type"), F.col("products").alias("contract_products"), address.alias("address"), regions.alias("regions"),
        C.normalize_phone(phone).alias("phone"), phone.alias("phone_raw"), email.alias("email"), F.array(api, official).alias("source_urls"), F.array(F.lit(request.category)).alias("discovery_queries"), evidence.alias("evidence"), checked_at.alias("checked_at"))
    note = F.concat(F.lit("контракт № "), F.col("number"), F.lit(", дата "), F.coalesce(C.blank_to_null("signed"), F.lit("не указана")))
    lineage = rows.select(official.alias("url"), F.lit("zakupki.gov.ru").alias("domain"), F.lit("skipped").alias("status"), note.alias("note"), F.col("name").alias("supplier_name"), F.lit(request.category).alias("discovery_query"), F.lit("contracts").alias("provider"), F.lit("government_contract").alias("source_kind"))
    return Result(normalize_suppliers(conform(suppliers, SUPPLIER)), lineage)


def contract_stats(payloads: DataFrame) -> DataFrame:
    """Contracts seen and the newest signing date."""
    rows = payloads.select(F.explode_outer("contracts.data").alias("c")).select(F.coalesce(C.blank_to_null(F.col("c.regNum")), C.blank_to_null(F.col("c.number"))).alias("number"), F.substring("c.signDate", 1, 10).alias("signed"))
    return rows.where("number is not null").agg(F.countDistinct("number").alias("contracts"), F.max("signed").alias("newest"))


# ---- registry cards ---------------------------------------------------------------------------


def registry_number(x: Column) -> Column:
    """Digits of the reestrNumber parameter, else 15 to 25 digits after the number's label."""
    return F.coalesce(C.first_match(x, r"[?&]reestrNumber=(\d+)(?:[&#]|$)", 1), C.first_match(x, r"(?U)(?:реестровой записи контракта[^\d]*|№\s*)(\d{15,25})", 1))


def parse_rss(feeds: DataFrame, base_url: str = "https://zakupki.gov.ru") -> DataFrame:
    """query, url, registry_number, description of each item of landed feeds (query, xml, ord), the first per number."""
    schema = "channel struct<item:array<struct<title:string,link:string,description:string>>>"
    items = feeds.select("query", "ord", F.from_xml("xml", schema).alias("x")).select("query", "ord", F.posexplode("x.channel.item").alias("pos", "i"))
    link = F.trim(F.coalesce("i.link", F.lit("")))
    url = F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base_url), link))
    rows = items.select("query", "ord", "pos", url.alias("url"), F.coalesce("i.description", F.lit("")).alias("description"))
    rows = rows.withColumn("registry_number", F.coalesce(registry_number(F.col("url")), registry_number(F.col("description")))).where("registry_number is not null")
    return first_wins(rows, ["registry_number"], ["ord", "pos"]).select("query", "url", "registry_number", "description", "ord", "pos")


def supplier_section(lines: Column) -> Column:
    """The lines between the supplier header and the next section, 40 at most."""
    return C.bind(lines, _section_of)


def _section_of(lines: Column) -> Column:
    header, *ends = K.SUPPLIER_SECTION
    start = F.array_position(lines, header).cast("int")
    rest = F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))
    marks = F.transform(rest, lambda s, i: F.when(F.startswith(s, F.lit(ends[0])) | F.startswith(s, F.lit(ends[1])), i))
    end = F.coalesce(F.array_min(F.array_compact(marks)), F.least(F.size(rest), F.lit(40)))
    return F.when(start > 0, F.slice(rest, F.lit(1), end)).otherwise(F.expr(NONE))


def supplier_identity(section: Column) -> Column:
    """(name, inn): the first line before the tax number's label that is no header; the number within three lines after it."""
    return C.bind(section, _identity_in)


def _identity_in(section: Column) -> Column:
    label = F.array_min(F.array_compact(F.transform(section, lambda s, i: F.when(F.rtrim(s, F.lit(":")) == "ИНН", i))))
    before = F.slice(section, F.lit(1), F.coalesce(label, F.size(section)))
    name = F.get(F.filter(before, lambda s: ~F.array_contains(C.strings(K.SUPPLIER_HEADERS), s)), F.lit(0))
    after = F.slice(section, F.coalesce(label, F.lit(0)) + 2, F.lit(3))
    inn = F.get(F.array_compact(F.transform(after, lambda s: C.first_match(s, r"\b(?:\d{12}|\d{10})\b"))), F.lit(0))
    return F.struct(name.alias("name"), F.when(label.isNotNull(), inn).alias("inn"))


def registry_suppliers(cards: DataFrame, request: Request, checked_at: Column) -> DataFrame:
    """Suppliers from cards (query, registry_number, common_url, common_text, product_url, product_text; the product page may be missing)."""
    rows = cards.withColumn("_common", C.text_lines("common_text")).withColumn("_goods", C.text_lines("product_text"))
    rows = rows.withColumn("_section", supplier_section(F.col("_common"))).withColumn("_who", supplier_identity(F.col("_section"))).where("_who.name is not null")
    category, query = F.lit(request.category), F.col("query")
    quote = lambda lines, what: C.product_quote(F.col(lines), what, K.REGISTRY_STOP_WORDS, 300)
    coded = F.replace("query", F.lit("."), F.lit("")).rlike("^[0-9]+$")
    tries = [(quote("_goods", category), "product_url"), (quote("_common", category), "common_url"), (F.when(~coded, quote("_goods", query)), "product_url"), (F.when(~coded, quote("_common", query)), "common_url")]
    found = F.coalesce(*[C.bind(F.struct(q.alias("quote"), F.col(u).alias("url")), lambda x: F.when(x["quote"].isNotNull(), x)) for q, u in tries])
    place = C.value_after(F.col("_common"), K.DELIVERY_PLACE)
    local = F.coalesce(F.contains(F.lower(place), F.lower(F.lit(request.region))), F.lit(False)) if request.region else F.lit(False)
    contact = F.array_join("_section", " ")
    rows = rows.withColumns({"_found": found, "_phone": C.first_match(contact, K.REGISTRY_PHONE), "_email": C.first_match(contact, K.EMAIL), "_local": local, "_place": place})
    url, name, inn = F.col("common_url"), F.col("_who.name"), F.col("_who.inn")
    evidence = F.array_compact(F.array(
        _evidence("legal_name", name, url, 0.9), _evidence("inn", inn, url, 0.9), _evidence("contract_products", F.col("_found.quote"), F.col("_found.url"), 0.85), F.when(F.col("_local"), _evidence("regions", F.lit(request.region), url, 0.9, F.col("_place"))),
        _evidence("phone", F.coalesce(C.normalize_phone("_phone"), "_phone"), url, 0.9, F.col("_phone")), _evidence("email", F.coalesce(C.normalize_email("_email"), "_email"), url, 0.9, F.col("_email"))))
    suppliers = rows.select(
        F.coalesce(F.concat(F.lit("eis-"), inn), C.url_id("eis-", url)).alias("id"), name.alias("name"), name.alias("legal_name"), inn.alias("inn"), F.lit("unknown").alias("company_type"), F.array_compact(F.array("_found.quote")).alias("contract_products"),
        F.when(F.col("_local"), F.array(F.lit(request.region))).otherwise(F.expr(NONE)).alias("regions"), F.col("_phone").alias("phone_raw"), F.col("_email").alias("email"), F.array_compact(F.array(url, F.when(C.blank_to_null("product_text").isNotNull(), F.col("product_url")))).alias("source_urls"),
        F.array(F.concat(F.lit("ЕИС: "), query, F.lit("; контракт № "), F.col("registry_number"))).alias("discovery_queries"), evidence.alias("evidence"), checked_at.alias("checked_at"))
    return normalize_suppliers(conform(suppliers, SUPPLIER))


def join_card_pages(items: DataFrame, common: DataFrame, product: DataFrame) -> DataFrame:
    """Items with both pages of their card by registry number; a missing product page is tolerated."""
    c = common.select("registry_number", F.col("url").alias("common_url"), F.col("text").alias("common_text"))
    p = product.select("registry_number", F.col("url").alias("product_url"), F.col("text").alias("product_text"))
    return items.join(c, "registry_number").join(p, "registry_number", "left")
