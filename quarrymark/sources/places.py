"""Organisation cards of a places directory, landed as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.schemas import PLACES, SUPPLIER
from ..operators.entities import normalize_suppliers
from ..operators.pages import first_wins
from .provider import Result, conform


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLACES).option("multiLine", True).json(path)


def api_status(payload: Column) -> Column:
    return payload["code"].try_cast("int")


def api_error(meta: Column) -> Column:
    """The message of a failed answer; null for status 200 or none."""
    code = api_status(meta)
    return F.when(code.isNotNull() & (code != 200), F.coalesce(C.blank_to_null(F.trim(meta["error"]["message"])), F.concat(F.lit("ошибка API "), code.cast("string"))))


def names(items: Column) -> Column:
    return C.distinct_non_null(F.transform(F.coalesce(items, F.expr("cast(array() as array<struct<name:string>>)")), lambda x: C.blank_to_null(C.strip(x["name"]))))


def contacts(groups: Column) -> Column:
    """All contacts of all groups in order."""
    return F.flatten(F.filter(F.transform(groups, lambda g: g["contacts"]), lambda c: c.isNotNull()))


def first_contact(found: Column, kind: str) -> Column:
    """The first non-blank value of a kind; a website gets a scheme."""
    values = F.transform(F.filter(found, lambda c: c["type"] == kind), lambda c: F.coalesce(C.blank_to_null(C.strip(c["value"])), C.blank_to_null(C.strip(c["text"]))))
    value = F.get(F.array_compact(values), F.lit(0))
    if kind == "website":
        return F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("https://"), F.ltrim(value, F.lit("/"))))
    return value


def company_type(name: Column, categories: Column) -> Column:
    return F.coalesce(C.typed_by(F.concat_ws(" ", name, F.array_join(categories, " ")), K.PLACE_COMPANY_TYPES), F.lit("unknown"))


def unpivot_evidence(url: Column, single: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Evidence of literal values: (field, value) pairs of singles and lists."""
    entry = lambda f, v: F.struct(F.lit(f).alias("field_name"), v.alias("value"), url.alias("source_url"), v.alias("quote"), F.lit(0.9).alias("confidence"))
    ones = [F.array_compact(F.array(F.when(v.isNotNull(), entry(f, v)))) for f, v in single.items()]
    of_field = lambda f: lambda x: entry(f, x)
    many = [F.transform(v, of_field(f)) for f, v in lists.items()]
    return F.concat(ones[0], *many, *ones[1:])


def place_suppliers(payloads: DataFrame, query: str, checked_at: Column, most: int | None = 30) -> Result:
    """Suppliers and lineage from answers (meta, result, ord): the first card per id, cards without a name skipped, ``most`` at most (None keeps all); failed answers are lineage alone."""
    items = payloads.select("ord", F.posexplode("result.items").alias("pos", "i")).where("i.id is not null")
    rows = first_wins(items.withColumn("_id", F.col("i.id")), ["_id"], ["ord", "pos"])
    if most is not None:
        rows = rows.orderBy("ord", "pos").limit(most)
    found = contacts(F.col("i.contact_groups"))
    rows = rows.withColumns({"name": F.coalesce(C.blank_to_null(C.strip("i.name")), C.blank_to_null(C.strip("i.full_name"))), "url": C.absolute_place_url("i.link", "i.id"), "website": first_contact(found, "website"), "phone": first_contact(found, "phone"), "email": first_contact(found, "email"), "categories": names(F.col("i.rubrics")), "regions": names(F.col("i.adm_div")), "address": C.blank_to_null(C.strip("i.address_name"))}).where("name is not null")
    evidence = unpivot_evidence(F.col("url"), {"name": F.col("name"), "address": F.col("address"), "phone": F.col("phone"), "email": F.col("email"), "website": F.col("website")}, {"product_categories": F.col("categories"), "regions": F.col("regions")})
    suppliers = rows.select(F.concat(F.lit("2gis-"), F.coalesce(C.blank_to_null(C.strip("i.org.id")), F.col("i.id"))).alias("id"), "name", C.blank_to_null(C.strip("i.org.name")).alias("legal_name"), company_type(F.col("name"), F.col("categories")).alias("company_type"), F.col("categories").alias("product_categories"), "address", "regions", "phone", "email", "website", F.array_distinct(F.array_compact(F.array("url", "website"))).alias("source_urls"), F.array(F.lit(query)).alias("discovery_queries"), evidence.alias("evidence"), checked_at.alias("checked_at"))
    line = lambda url, status, note, kind: F.struct(url.alias("url"), F.coalesce(C.normalize_domain(url), F.lit("2gis.ru")).alias("domain"), F.lit(status).alias("status"), F.lit(note).alias("note"), F.col("name").alias("supplier_name"), F.lit(query).alias("discovery_query"), F.lit("places").alias("provider"), F.lit(kind).alias("source_kind"))
    other = C.normalize_url("website").isNotNull() & ~C.normalize_url("website").eqNullSafe(C.normalize_url("url"))
    sources = rows.select(F.inline(F.array_compact(F.array(line(F.col("url"), "ok", "карточка организации", "organization_api"), F.when(other, line(F.col("website"), "skipped", "сайт из карточки; загрузка ещё не выполнялась", "official_site"))))))
    none = F.lit(None).cast("string")
    refused = payloads.withColumn("error", api_error(F.col("meta"))).where("error is not null")
    refused = refused.select(none.alias("url"), F.lit("2gis.ru").alias("domain"), F.lit("failed").alias("status"), F.col("error").alias("note"), none.alias("supplier_name"), F.lit(query).alias("discovery_query"), F.lit("places").alias("provider"), F.lit("organization_api").alias("source_kind"))
    return Result(normalize_suppliers(conform(suppliers, SUPPLIER)), sources.unionByName(refused))
