"""Facts from pages, each with its source URL and a literal quote.

Facts are a long table (supplier_id, field_name, value, source_url, quote, confidence, ord): every
page yields its candidates in one projection, and the first page wins per single-valued field.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import columns as C
from ..functions import constants as K
from ..functions.schemas import EVIDENCE, FACT, PAGE_FACTS
from .pages import first_wins, usable

ORGANISATION_TYPES = ("Organization", "LocalBusiness", "Corporation")
LIST_FIELDS = ("matched_products", "certificates")


def _opened(value) -> list[dict]:
    """The objects of a JSON value, those inside lists and ``@graph`` at any depth included, in order."""
    found, rest = [], [value]
    while rest:
        v = rest.pop()
        if isinstance(v, dict):
            found.append({k: x for k, x in v.items() if k != "@graph"})
            if v.get("@graph"):
                rest.append(v["@graph"])
        elif isinstance(v, list):
            rest.extend(reversed(v))
    return found


@F.pandas_udf(ArrayType(StringType()))
def _json_objects(scripts: pd.Series) -> pd.Series:
    """Of each text, the JSON objects it opens into; none if it isn't JSON."""

    def objects(text) -> list[str]:
        try:
            return [json.dumps(x, ensure_ascii=False) for x in _opened(json.loads(text or ""))]
        except (ValueError, RecursionError):
            return []

    return scripts.map(objects)


def json_ld(pages: DataFrame) -> DataFrame:
    """url, script, place and fields (a map of VARIANT) of the pages' JSON-LD objects; bad JSON is skipped."""
    scripts = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    found = pages.select("url", F.posexplode(scripts).alias("script", "json"))
    opened = found.select("url", "script", F.posexplode(_json_objects("json")).alias("place", "item"))
    return opened.select("url", "script", "place", F.expr("try_variant_get(try_parse_json(item), '$', 'map<string,variant>')").alias("fields")).where("fields is not null")


def structured_value(fields: Column | str, key: str) -> Column:
    """item[key], item[key][key] or item.address[key], whichever is a text first."""
    f = C.col(fields)
    direct = F.call_function("try_variant_get", f[key], F.lit("$"), F.lit("string"))
    nested = F.call_function("try_variant_get", f[key], F.lit(f"$.{key}"), F.lit("string"))
    address = F.call_function("try_variant_get", f["address"], F.lit(f"$.{key}"), F.lit("string"))
    is_object = F.call_function("try_variant_get", f[key], F.lit("$"), F.lit("map<string,variant>")).isNotNull()
    return F.coalesce(F.when(~F.coalesce(is_object, F.lit(False)), C.blank_to_null(C.strip(direct))), C.blank_to_null(C.strip(nested)), C.blank_to_null(C.strip(address)))


def item_types(fields: Column | str) -> Column:
    f = C.col(fields)["@type"]
    many = F.call_function("try_variant_get", f, F.lit("$"), F.lit("array<string>"))
    return F.coalesce(many, F.array_compact(F.array(F.call_function("try_variant_get", f, F.lit("$"), F.lit("string")))))


def page_structures(pages: DataFrame) -> DataFrame:
    """url, product_names, organisation (name, street) of the pages' structured data."""
    items = json_ld(pages).withColumn("types", item_types("fields"))
    is_product = F.array_contains("types", "Product")
    is_organisation = F.arrays_overlap("types", C.strings(ORGANISATION_TYPES))
    at = F.struct("script", "place")
    first = lambda value, kind: F.min_by(value, F.when(kind & value.isNotNull(), at))
    products = F.array_sort(F.collect_list(F.when(is_product & structured_value("fields", "name").isNotNull(), F.struct("script", "place", structured_value("fields", "name").alias("name")))))
    return items.groupBy("url").agg(
        F.array_distinct(F.transform(products, lambda x: x["name"])).alias("product_names"),
        F.coalesce(first(structured_value("fields", "legalName"), is_organisation), first(structured_value("fields", "name"), is_organisation)).alias("organisation"),
        first(structured_value("fields", "streetAddress"), is_organisation).alias("street"),
    )


def price_line(lines: Column, access: bool) -> Column:
    """The first line with a price that is (or isn't) a fee for access to the catalogue."""
    return C.first_line(lines, lambda s: s.rlike(K.PRICE) & (C.contains_any(s, K.ACCESS_PRICE_MARKERS) == access))


def access_note(line: Column) -> Column:
    amount = F.coalesce(C.strip(C.first_match(line, K.PRICE)), F.lit("платно"))
    return F.concat(F.lit("Цена товара не опубликована; платный доступ ProductCenter к закрытой информации — "), amount, F.lit(" на 24 часа"))


def page_facts(pages: DataFrame, category: str, names: DataFrame | None = None) -> DataFrame:
    """All candidate facts of usable pages (supplier_id, url, final_url, text, html, ord).

    names: supplier_id and _name, which counts as a page's first line where the company type is sought.
    """
    structures = page_structures(usable(pages).select(F.col("final_url").alias("url"), "html"))
    rows = usable(pages).join(structures.withColumnRenamed("url", "final_url"), "final_url", "left")
    rows = rows.withColumn("_name", F.lit("")) if names is None else rows.join(names, "supplier_id", "left").withColumn("_name", F.coalesce("_name", F.lit("")))
    rows = rows.withColumn("lines", C.text_lines("text")).withColumn("confidence", F.when(C.is_catalog("final_url"), 0.7).otherwise(0.9))
    lines, text = F.col("lines"), F.coalesce("text", F.lit(""))
    named = F.concat(F.coalesce("product_names", F.array().cast("array<string>")), lines)
    email, phone = C.first_match(text, K.EMAIL), C.first_match(text, K.PHONE)
    goods, fee = price_line(lines, False), price_line(lines, True)
    fact = lambda name, value, quote: F.struct(F.lit(name).alias("field_name"), value.alias("value"), quote.alias("quote"))
    same = lambda name, value: fact(name, value, value)
    facts = F.array(
        same("matched_products", C.product_quote(named, F.lit(category))),
        same("legal_name", F.col("organisation")),
        fact("company_type", F.nullif(C.line_company_type(lines, F.col("_name")), F.lit("unknown")), C.company_type_line(lines, F.col("_name"))),
        fact("email", C.normalize_email(email), email),
        fact("phone", F.coalesce(C.normalize_phone(phone), phone), phone),
        fact("inn", C.normalize_inn(C.first_match(text, K.INN, 1)), C.first_match(text, K.INN)),
        fact("price", C.strip(C.first_match(goods, K.PRICE)), goods),
        fact("price_access_note", F.when(goods.isNull() & fee.isNotNull(), access_note(fee)), fee),
        same("minimum_order", C.first_line(lines, lambda s: s.rlike(K.MINIMUM_ORDER))),
        same("delivery", C.keyword_line(lines, K.DELIVERY_WORDS)),
        same("certificates", C.keyword_line(lines, K.CERTIFICATE_WORDS)),
        same("address", F.col("street")),
    )
    out = rows.select("supplier_id", F.col("final_url").alias("source_url"), "confidence", "ord", F.inline(facts))
    return out.where(C.blank_to_null("value").isNotNull())


def first_facts(facts: DataFrame) -> DataFrame:
    """Single-valued fields keep the first page's fact; list fields keep every distinct value."""
    single = first_wins(facts.where(~F.col("field_name").isin(*LIST_FIELDS)), ["supplier_id", "field_name"], ["ord", "source_url", "value"])
    many = first_wins(facts.where(F.col("field_name").isin(*LIST_FIELDS)), ["supplier_id", "field_name", "value"], ["ord", "source_url"])
    return single.unionByName(many)


def evidence_of(facts: DataFrame) -> DataFrame:
    """supplier_id and the evidence array of its facts, distinct by field, source and quote, in page order."""
    distinct = first_wins(facts, ["supplier_id", "field_name", "source_url", "quote"], ["ord", "value"])
    entry = F.struct("ord", "field_name", "value", "source_url", "quote", "confidence")
    packed = distinct.groupBy("supplier_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return packed.select("supplier_id", F.transform("e", lambda x: F.struct(*[x[n].alias(n) for n in ("field_name", "value", "source_url", "quote", "confidence")])).alias("evidence"))


_FILLED = ("legal_name", "inn", "address", "minimum_order", "price", "price_access_note", "delivery", "email")
_EVIDENCE = f"cast(array() as array<{EVIDENCE}>)"


def _needed(suppliers: DataFrame) -> DataFrame:
    """supplier_id, _filled (single fields that pages and models may not change), _has (the list fields' values)."""
    filled = [F.when(C.blank_to_null(n).isNotNull(), F.lit(n)) for n in _FILLED]
    filled += [F.when(F.coalesce(C.blank_to_null("phone"), C.blank_to_null("phone_raw")).isNotNull(), F.lit("phone")), F.when(F.coalesce("company_type", F.lit("unknown")) != "unknown", F.lit("company_type"))]
    filled += [F.when(C.blank_to_null("phone_raw").isNotNull(), F.lit("phone_raw"))]
    own = F.create_map(*[x for n in (*LIST_FIELDS, "regions") for x in (F.lit(n), F.coalesce(n, F.array().cast("array<string>")))])
    return suppliers.select(F.col("id").alias("supplier_id"), F.array_compact(F.array(*filled)).alias("_filled"), own.alias("_has")).dropDuplicates(["supplier_id"])


def _apply(suppliers: DataFrame, facts: DataFrame, urls: DataFrame, lists: tuple[str, ...], phone: str = "value") -> DataFrame:
    """Suppliers with the facts' values in their fields, the facts as evidence, and ``urls`` (supplier_id, _urls) among the sources.

    phone: which part of a phone's fact is the number as found.
    """
    single = facts.where(~F.col("field_name").isin(*lists)).groupBy("supplier_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("value", "quote")))).alias("_values"))
    many = facts.where(F.col("field_name").isin(*lists)).groupBy("supplier_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field_name") == n, F.struct("ord", "value")))), lambda x: x["value"]).alias(f"_{n}") for n in lists])
    out = suppliers.withColumnRenamed("evidence", "_own")
    for part in (single, many, urls, evidence_of(facts).withColumnRenamed("evidence", "_found")):
        out = out.join(part, out["id"] == part["supplier_id"], "left").drop("supplier_id")
    none = F.array().cast("array<string>")
    value = lambda n: F.element_at("_values", n)["value"]
    for name in _FILLED:
        out = out.withColumn(name, F.coalesce(C.blank_to_null(name), value(name)))
    raw = F.element_at("_values", "phone")[phone]
    out = out.withColumns({"phone": F.coalesce(C.blank_to_null("phone"), C.normalize_phone(raw)), "phone_raw": F.coalesce(C.blank_to_null("phone_raw"), raw), "company_type": F.coalesce(value("company_type"), "company_type")})
    for name in lists:
        out = out.withColumn(name, F.array_distinct(F.concat(F.coalesce(name, none), F.coalesce(f"_{name}", none))))
    out = out.withColumn("source_urls", F.array_distinct(F.concat(F.coalesce("source_urls", none), F.coalesce("_urls", none))))
    out = out.withColumn("evidence", F.concat(F.coalesce("_own", F.expr(_EVIDENCE)), F.coalesce("_found", F.expr(_EVIDENCE))))
    return out.select(*suppliers.columns)


def enrich(suppliers: DataFrame, pages: DataFrame, category: str) -> DataFrame:
    """Suppliers with empty fields filled from their pages, products and documents added, and evidence for what was taken."""
    facts = page_facts(pages, category, suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("_name")).dropDuplicates(["supplier_id"]))
    taken = facts.join(_needed(suppliers), "supplier_id").where(~F.array_contains("_filled", F.col("field_name")))
    taken = taken.where(~F.coalesce(F.array_contains(F.element_at("_has", F.col("field_name")), F.col("value")), F.lit(False)))
    # a note on paid access is of no use once a price is known
    priced = F.min(F.when(F.col("field_name") == "price", F.col("ord"))).over(Window.partitionBy("supplier_id"))
    note = F.col("field_name") == "price_access_note"
    taken = taken.withColumn("_priced", priced).where(~(note & (F.array_contains("_filled", "price") | F.coalesce(F.col("_priced") <= F.col("ord"), F.lit(False)))))
    seen = usable(pages).groupBy("supplier_id").agg(F.sort_array(F.collect_set("final_url")).alias("_urls"))
    return _apply(suppliers, first_facts(taken.select(*facts.columns)), seen, LIST_FIELDS, "quote")


def _quoted(facts: DataFrame, pages: DataFrame, literal: bool = False) -> DataFrame:
    """Adds _ok: the fact's page, by normalised URL, holds the trimmed quote literally, the value isn't blank, nor an access fee as a price; _page is that page's address."""
    ranked = F.struct(*[c for c in ("ord",) if c in pages.columns], "final_url")
    texts = pages.select(C.normalize_url("final_url").alias("_url"), F.struct(ranked.alias("r"), F.col("final_url").alias("url"), "text").alias("p")).groupBy("_url").agg(F.max_by("p", "p.r").alias("_p"))
    joined = facts.withColumn("_url", C.normalize_url("source_url")).join(texts, "_url", "left")
    value, quote = (C.blank_to_null(F.col(c) if literal else C.strip(c)) for c in ("value", "quote"))
    named = F.col("field_name") if "field_name" in facts.columns else F.lit("")
    fee = (named == "price") & C.contains_any(F.concat_ws(" ", value, quote), K.ACCESS_PRICE_MARKERS)
    ok = value.isNotNull() & quote.isNotNull() & F.contains(F.col("_p.text"), quote) & ~F.coalesce(fee, F.lit(False))
    return joined.withColumns({"_ok": F.coalesce(ok, F.lit(False)), "_page": F.col("_p.url"), "_value": value, "_quote": quote}).drop("_p")


def verify_facts(facts: DataFrame, pages: DataFrame, literal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) facts; each needs a value and a quote that its page holds, trimmed, or with its white space if ``literal``."""
    rows = facts if "value" in facts.columns else facts.withColumn("value", F.col("quote"))
    checked = _quoted(rows, pages, literal)
    return checked.where("_ok").select(*facts.columns), checked.where("not _ok").select(*facts.columns)


MODEL_LISTS = ("matched_products", "regions", "certificates")
MODEL_SINGLE = ("legal_name", "inn", "address", "minimum_order", "price", "delivery", "phone", "email", "company_type")


def model_facts(answers: DataFrame) -> DataFrame:
    """supplier_id, field_name, value, quote, source_url, ord of parsed model answers (supplier_id, facts)."""
    single = [F.array(F.struct(F.lit(n).alias("field_name"), F.lit(0).alias("ord"), F.col(f"facts.{n}").alias("f"))) for n in MODEL_SINGLE]

    def listed(name: str) -> Column:
        return F.transform(F.coalesce(F.col(f"facts.{name}"), F.expr(f"cast(array() as array<{FACT}>)")), lambda x, i: F.struct(F.lit(name).alias("field_name"), i.alias("ord"), x.alias("f")))

    many = [listed(n) for n in MODEL_LISTS]
    rows = answers.select("supplier_id", F.explode(F.concat(*single, *many)).alias("x")).where("x.f is not null")
    return rows.select("supplier_id", "x.field_name", "x.f.value", "x.f.quote", "x.f.source_url", F.col("x.ord").alias("ord"))


def merge_model_facts(suppliers: DataFrame, facts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suppliers with accepted model facts merged in, and accepted and rejected counts per supplier_id.

    Only empty single fields and an unknown company type ask for a fact; the others' facts aren't
    counted. Lists take every accepted value. A company type must be a known one.
    """
    checked = _quoted(facts, pages).join(_needed(suppliers), "supplier_id")
    asked = F.when(F.col("field_name") == "phone", F.lit("phone_raw")).otherwise(F.col("field_name"))
    checked = checked.where(~F.array_contains("_filled", asked))
    kind = F.lower("_value")
    checked = checked.withColumn("_ok", F.col("_ok") & ((F.col("field_name") != "company_type") | F.coalesce(kind.isin(*K.COMPANY_TYPES), F.lit(False))))
    counts = checked.groupBy("supplier_id").agg(F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))
    good = checked.where("_ok").select(
        "supplier_id", F.when(F.col("field_name") == "company_type", kind).otherwise(F.col("_value")).alias("value"), "field_name", F.col("_page").alias("source_url"), F.col("_quote").alias("quote"),
        F.when(C.is_catalog("_page"), 0.65).otherwise(0.82).alias("confidence"), "ord")
    single = first_wins(good.where(~F.col("field_name").isin(*MODEL_LISTS)), ["supplier_id", "field_name"], ["ord", "source_url", "value"])
    good = single.unionByName(good.where(F.col("field_name").isin(*MODEL_LISTS)))
    urls = good.groupBy("supplier_id").agg(F.sort_array(F.collect_set("source_url")).alias("_urls"))
    # a fact that is on record already fills its field and adds no evidence
    merged = _apply(suppliers, good, urls, MODEL_LISTS)
    before = F.transform("_own", lambda e: F.struct(e["field_name"], C.normalize_url(e["source_url"]), e["quote"]))
    own = suppliers.select(F.col("id").alias("_id"), F.col("evidence").alias("_own")).dropDuplicates(["_id"])
    out = merged.join(own, merged["id"] == F.col("_id"), "left")
    fresh = F.filter(F.slice("evidence", F.size("_own") + 1, F.size("evidence")), lambda e: ~F.array_contains(before, F.struct(e["field_name"], C.normalize_url(e["source_url"]), e["quote"])))
    return out.withColumn("evidence", F.concat("_own", fresh)).select(*suppliers.columns), counts


def parse_model_facts(payloads: DataFrame, schema: str = PAGE_FACTS, column: str = "payload") -> DataFrame:
    """Landed model answers parsed strictly; an answer that doesn't fit the schema gives null."""
    return payloads.withColumn("facts", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))
