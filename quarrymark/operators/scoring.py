"""Scoring: a formula over a company and a request, itemised as (points, reason)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


@dataclass(frozen=True)
class Request:
    """What the buyer asks for. A volume of 0 is no volume."""

    category: str
    region: str | None = None
    required_volume_kg: float | None = None
    delivery_required: bool = False
    documents_required: bool = False
    extra_requirements: str | None = None
    eis_queries: tuple[str, ...] = ()
    max_results: int = 10


def max_score(weights: Mapping[str, float] = K.WEIGHTS) -> float:
    return sum(v for v in weights.values() if v > 0)


def _item(points: Column | float, reason: Column | str) -> Column:
    p = F.lit(float(points)) if isinstance(points, int | float) else points
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(p.cast("double").alias("points"), r.alias("reason"))


def _filled(name: str) -> Column:
    return C.blank_to_null(name)


def category_match(df: DataFrame, category: str) -> DataFrame:
    """Adds key_ratio, related_only and positions of the request's category in the assortment."""
    q = F.lit(category)
    tokens = C.scoring_tokens(q)
    generic = lambda t: F.exists(C.strings(K.GENERIC_TOKENS), lambda g: C.same_word(t, g))
    query = df.sparkSession.range(1).select(tokens.alias("q_all"), F.filter(tokens, lambda t: ~generic(t)).alias("q_key"))
    query = query.select("q_all", F.when(F.size("q_key") > 0, F.col("q_key")).otherwise(F.col("q_all")).alias("q_key"))
    none = F.array().cast("array<string>")
    rows = df.crossJoin(F.broadcast(query))  # one row
    listed = F.filter(F.concat(F.coalesce("product_categories", none), F.coalesce("matched_products", none)), lambda p: ~C.conflicts(p, q, K.SCORING_CONFLICTS))
    rows = rows.withColumn("_listed", F.transform(listed, lambda p: F.struct(p.alias("p"), C.scoring_tokens(p).alias("t"))))
    met = lambda wanted, t: F.filter(wanted, lambda w: F.exists(t, lambda x: C.same_word(w, x)))
    rows = rows.withColumn("_met", F.transform("_listed", lambda x: F.struct(x["p"].alias("p"), met(F.col("q_key"), x["t"]).alias("key"), (F.size(met(F.col("q_all"), x["t"])) > 0).alias("any"))))
    keys = F.array_distinct(F.flatten(F.transform("_met", lambda x: x["key"])))
    key_rows, related = F.filter("_met", lambda x: F.size(x["key"]) > 0), F.filter("_met", lambda x: x["any"])
    ratio = F.when(F.size("q_all") == 0, 0.0).otherwise(F.size(keys) / F.size("q_key"))
    out = rows.withColumn("key_ratio", ratio.cast("double"))
    out = out.withColumn("related_only", (F.col("key_ratio") == 0) & (F.size(related) > 0) & (F.size("q_all") > 0))
    out = out.withColumn("positions", F.transform(F.when(F.col("key_ratio") > 0, key_rows).otherwise(related), lambda x: x["p"]))
    return out.drop("q_all", "q_key", "_listed", "_met")


def region_confirmed(region: str) -> Column:
    wanted = F.lit(region)
    by_list = F.exists(F.coalesce("regions", F.array().cast("array<string>")), lambda r: C.region_covers(r, wanted))
    hay = F.lower(F.concat_ws(" ", _filled("address"), _filled("delivery")))
    return by_list | F.contains(hay, F.lower(wanted))


def secondary_only() -> Column:
    """Known only from catalogues: no website but sources, or a catalogue's website."""
    return F.when(_filled("website").isNull(), F.size(F.coalesce("source_urls", F.array().cast("array<string>"))) > 0).otherwise(C.is_scoring_catalog("domain"))


def display_phone() -> Column:
    return F.coalesce(_filled("phone"), _filled("phone_raw"))


def display_price() -> Column:
    return F.coalesce(_filled("price"), _filled("price_access_note"))


def missing_fields() -> Column:
    """Tracked fields without a value; the shown phone counts as phone."""
    lists = ("regions", "certificates")
    empty = lambda n: (F.size(F.coalesce(n, F.array().cast("array<string>"))) == 0) if n in lists else (display_phone() if n == "phone" else _filled(n)).isNull()
    return F.array_compact(F.array(*[F.when(empty(n), F.lit(n)) for n in K.TRACKED_FIELDS]))


def items(request: Request, weights: Mapping[str, float], candidate: bool) -> Column:
    """The breakdown array."""
    w, q = weights, request
    quoted = F.array_join(F.transform(F.slice("positions", 1, 3), lambda p: F.concat(F.lit("«"), p, F.lit("»"))), ", ")
    category = (
        _item(0, f"точное наличие «{q.category}» требует проверки")
        if candidate
        else F.when(F.col("key_ratio") >= 1, _item(w["category_match"], F.concat(F.lit("ассортимент подтверждает категорию: "), quoted)))
        .when(F.col("key_ratio") > 0, _item(round(w["category_match"] / 2, 1), F.concat(F.lit("категория подтверждена частично: "), quoted)))
        .otherwise(_item(0, F.concat(F.lit(f"позиции «{q.category}» в ассортименте нет, найдены смежные товары: "), quoted, F.lit(" — наличие нужно уточнить у поставщика"))))
    )
    region = (
        F.when(region_confirmed(q.region), _item(w["region_match"], f"подтверждена работа в регионе «{q.region}»")).otherwise(_item(w["penalty_region_unconfirmed"], f"работа в регионе «{q.region}» не подтверждена"))
        if q.region
        else _item(0, "регион в запросе не указан")
    )
    delivery = F.when(_filled("delivery").isNotNull(), _item(w["delivery_available"], F.concat(F.lit("опубликованы условия доставки: "), F.col("delivery")))).otherwise(_item(0, "условия доставки не найдены"))
    order = _filled("minimum_order")
    found = F.when(order.isNull(), _item(0, "минимальный заказ не указан")).otherwise(_item(w["minimum_order_found"], F.concat(F.lit("указан минимальный заказ: "), order)))
    parts = [category, region, delivery, found]
    optional = []
    if q.required_volume_kg:
        kg = F.coalesce(F.nullif("minimum_order_kg", F.lit(0.0)), C.parse_weight_kg("minimum_order"))
        volume = C.general_number(F.lit(float(q.required_volume_kg)))
        said = lambda middle: F.concat(F.lit("минимальный заказ "), C.general_number(kg), F.lit(middle), volume, F.lit(" кг"))
        fits = (
            F.when(kg.isNull(), _item(0, "минимальный заказ указан не в весовых единицах, сравнение с объёмом запроса невозможно"))
            .when(kg <= q.required_volume_kg, _item(w["minimum_order_fits"], said(" кг укладывается в объём ")))
            .otherwise(_item(0, said(" кг выше объёма ")))
        )
        optional.append(F.when(order.isNotNull(), fits))
    papers = F.coalesce("certificates", F.array().cast("array<string>"))
    certificates = F.when(F.size(papers) > 0, _item(w["certificates_found"], F.concat(F.lit("опубликованы сведения о документах: "), F.array_join(F.slice(papers, 1, 3), ", ")))).otherwise(_item(0, "сведения о документах не найдены"))
    contact = F.concat_ws(", ", display_phone(), _filled("email"))
    contacts = F.when(contact != "", _item(w["direct_contacts"], F.concat(F.lit("найдены прямые контакты: "), contact))).otherwise(_item(0, "прямые контакты не найдены"))
    price = F.when(_filled("price").isNotNull(), _item(w["price_published"], F.concat(F.lit("опубликована цена: "), F.col("price")))).otherwise(_item(0, "цена не опубликована"))
    second = "сведения только из вторичного источника" if candidate else "сведения только из каталога организаций, сайт не найден"
    penalties = [F.when(secondary_only(), _item(w["penalty_secondary_source_only"], second)), F.when(F.coalesce("page_unavailable", F.lit(False)), _item(w["penalty_page_unavailable"], "страницы поставщика не открылись при проверке"))]
    return F.array_compact(F.array(*parts, *optional, certificates, contacts, price, *penalties))


def total(breakdown: Column, weights: Mapping[str, float]) -> Column:
    points = F.aggregate(breakdown, F.lit(0.0), lambda a, i: a + i["points"])
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), points / max_score(weights) * 100)), 1)


def has_product_evidence() -> Column:
    return F.exists("evidence", lambda e: e["field_name"] == "matched_products")


def score(suppliers: DataFrame, request: Request, weights: Mapping[str, float] = K.WEIGHTS) -> DataFrame:
    """Suppliers with score, breakdown, missing_fields, result_group (verified, candidate, excluded) and its reason.

    page_unavailable (all sources failed) is a column of the input. Companies without product
    evidence are scored as candidates unless they are excluded by type; candidates found by no
    query and unrelated ones with evidence are excluded.
    """
    rows = category_match(suppliers, request.category)
    kind = F.when(F.col("company_type") == "retailer", "розничная торговля, а не оптовая поставка").when(F.col("company_type") == "marketplace", "каталог организаций, а не поставщик")
    unrelated = F.when((F.col("key_ratio") == 0) & ~F.col("related_only"), F.lit(f"ассортимент не подтверждает категорию «{request.category}»"))
    verified = F.coalesce(has_product_evidence(), F.lit(False))
    undiscovered = F.size(F.coalesce("discovery_queries", F.array().cast("array<string>"))) == 0
    why = F.coalesce(kind, F.when(verified | undiscovered, unrelated))
    rows = rows.withColumn("exclusion_reason", why).withColumn("result_group", F.when(why.isNotNull(), "excluded").when(verified, "verified").otherwise("candidate"))
    breakdown = F.when(F.col("result_group") == "excluded", F.array(_item(0, F.concat(F.lit("исключено: "), F.col("exclusion_reason"))))).when(F.col("result_group") == "verified", items(request, weights, False)).otherwise(items(request, weights, True))
    rows = rows.withColumn("breakdown", breakdown)
    rows = rows.withColumn("score", F.when(F.col("result_group") == "excluded", 0.0).otherwise(total(F.col("breakdown"), weights)))
    contracts = F.coalesce("contract_products", F.array().cast("array<string>"))
    reason = (
        F.when(F.col("result_group") == "excluded", F.col("exclusion_reason"))
        .when((F.col("result_group") == "verified") & secondary_only(), "точный товар подтверждён отраслевым каталогом; актуальность рекомендуется уточнить у поставщика")
        .when(F.col("result_group") == "verified", "точный товар подтверждён официальным сайтом")
        .when(F.size(contracts) > 0, F.concat(F.lit("в ЕИС найдена история контрактов по товару: "), F.array_join(F.slice(contracts, 1, 2), ", "), F.lit("; актуальное наличие на сайте ещё не подтверждено")))
        .otherwise(F.lit(f"организация найдена по запросу, но точное наличие «{request.category}» на странице не подтверждено"))
    )
    return rows.withColumn("verification_reason", reason).withColumn("missing_fields", missing_fields())


def mark_unavailable(suppliers: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds page_unavailable: a company has sources on record and all of them failed."""
    urls = suppliers.select("id", F.explode("source_urls").alias("url"))
    failed = urls.join(sources.select("url", "status"), "url").groupBy("id").agg(F.bool_and(F.col("status") == "failed").alias("page_unavailable"))
    return suppliers.join(failed, "id", "left").withColumn("page_unavailable", F.coalesce("page_unavailable", F.lit(False)))


def rank(scored: DataFrame, k: int | None = None) -> DataFrame:
    """Adds place within the group, by score and name; with ``k``, only the best verified and candidates stay.

    With ``k`` the companies of a group are cut to the best ones in every task before they meet, and the
    excluded, which are all kept, get no place; without it each group is one order, as its places are.
    """
    place = F.row_number().over(Window.partitionBy("result_group").orderBy(F.desc("score"), "name", "id"))
    if k is None:
        return scored.withColumn("place", place)
    excluded = F.col("result_group") == "excluded"
    best = scored.where(~excluded).withColumn("place", place).where(F.col("place") <= k)
    return best.unionByName(scored.where(excluded).withColumn("place", F.lit(None).cast("int")))


def format_breakdown() -> Column:
    """Signed items and the total, a line each."""
    line = F.transform("breakdown", lambda i: F.when(i["points"] == 0, F.concat(F.lit("  0 — "), i["reason"])).otherwise(F.concat(F.format_string("%+.0f", i["points"]), F.lit(" — "), i["reason"])))
    return F.concat(F.array_join(line, "\n"), F.lit("\nИтого: "), C.general_number("score"), F.lit("/100"))
