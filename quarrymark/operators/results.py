"""Result tables: display rows, candidates, sources, export, comparison, run counters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from .scoring import display_phone, display_price, format_breakdown


def or_missing(x: Column | str) -> Column:
    return F.coalesce(C.blank_to_null(x), F.lit(K.MISSING))


def shorten(values: Column | str, limit: int = 3) -> Column:
    """The first values, comma-joined, and how many more there are."""
    v = F.coalesce(C.col(values), F.array().cast("array<string>"))
    head = F.array_join(F.slice(v, 1, limit), ", ")
    return F.when(F.size(v) == 0, K.MISSING).when(F.size(v) <= limit, head).otherwise(F.concat(head, F.lit(" и ещё "), (F.size(v) - limit).cast("string")))


def field_label(x: Column | str) -> Column:
    return F.coalesce(F.element_at(C.lookup(K.FIELD_LABELS), C.col(x)), C.col(x))


def _lists(*names: str) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in names]))


def base_columns() -> list[Column]:
    values = (
        F.col("score"), F.col("name"), shorten(_lists("matched_products", "contract_products", "product_categories")), shorten("regions", 2), or_missing("minimum_order"), or_missing(display_price()), or_missing("delivery"),
        F.when(F.size(_lists("certificates")) > 0, "найдено").otherwise(K.MISSING), or_missing(F.concat_ws(", ", display_phone(), C.blank_to_null("email"))), or_missing("domain"), F.date_format("checked_at", "dd.MM.yyyy"),
    )
    return [v.alias(n) for v, n in zip(values, K.TABLE_COLUMNS, strict=True)]


def result_table(scored: DataFrame) -> DataFrame:
    return scored.select(*base_columns())


def candidate_table(scored: DataFrame) -> DataFrame:
    return scored.select(*base_columns(), F.coalesce(C.blank_to_null("verification_reason"), F.lit("требует проверки")).alias("Причина проверки"))


def sources_table(sources: DataFrame) -> DataFrame:
    dash = lambda c: F.coalesce(C.blank_to_null(c), F.lit("—"))
    return sources.select(
        dash("supplier_name").alias("Компания"), F.col("domain").alias("Домен"), F.col("url").alias("Ссылка"), dash("provider").alias("Провайдер"), dash("discovery_query").alias("Поисковый запрос"),
        F.element_at(C.lookup(K.KIND_LABELS), F.col("source_kind")).alias("Тип источника"), F.coalesce(F.element_at(C.lookup(K.STATUS_LABELS), F.col("status")), F.col("status")).alias("Статус"),
        dash(F.col("http_status").cast("string")).alias("HTTP"), F.coalesce("note", F.lit("")).alias("Примечание"))


def export_frame(scored: DataFrame) -> DataFrame:
    more = {
        "Тип компании": F.col("company_type"), "Юридическое название": or_missing("legal_name"), "ИНН": or_missing("inn"), "Адрес": or_missing("address"), "Телефон": or_missing(display_phone()), "Email": or_missing("email"),
        "Незаполненные поля": F.coalesce(C.blank_to_null(F.array_join(F.transform("missing_fields", field_label), ", ")), F.lit("нет")), "Расшифровка оценки": format_breakdown(),
        "Источники": or_missing(F.array_join(_lists("source_urls"), " ")), "Статус проверки": F.when(F.col("result_group") == "verified", "подтверждён").otherwise("кандидат"),
        "Причина проверки": F.coalesce(C.blank_to_null("verification_reason"), F.lit("—")), "Поставки по контрактам ЕИС": or_missing(F.array_join(_lists("contract_products"), "; ")),
    }
    return scored.select(*base_columns(), *[v.alias(n) for n, v in more.items()])


def write_csv(scored: DataFrame, path: str) -> None:
    """The export as CSV files with a header, written by the executors."""
    export_frame(scored).write.mode("overwrite").option("header", True).csv(path)


def write_single_csv(scored: DataFrame, folder: str, run_id: str) -> Path:
    """One UTF-8 file with a byte-order mark, for the cut result lists of one run (at most twice max_results rows)."""
    target = Path(folder) / f"suppliers-{run_id}.csv"
    target.parent.mkdir(parents=True, exist_ok=True)
    export_frame(scored).toPandas().to_csv(target, index=False, encoding="utf-8-sig")
    return target


def comparison(scored: DataFrame, ids: list[str]) -> DataFrame:
    """Criteria as rows, 2 to 4 chosen companies as columns, keyed by id so that equal names stay apart."""
    if not 2 <= len(ids) <= 4:
        raise ValueError("choose 2 to 4 companies")
    criteria = [c for c in K.TABLE_COLUMNS if c != "Компания"]
    rows = scored.where(F.col("id").isin(*ids)).select("id", *base_columns())
    entries = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(c).alias("Критерий"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(criteria)])
    return rows.select("id", F.inline(entries)).groupBy("n", "Критерий").pivot("id", ids).agg(F.first("value")).orderBy("n").drop("n")


def run_counters(sources: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: pages loaded, failed and skipped, companies per group (counted before any cut)."""
    pages = sources.agg(F.count_if(F.col("status").isin("ok", "cached")).alias("pages_loaded"), F.count_if(F.col("status") == "failed").alias("pages_failed"), F.count_if(F.col("status") == "skipped").alias("pages_skipped"))
    groups = scored.agg(*[F.count_if(F.col("result_group") == g).alias(f"{n}_found") for g, n in (("verified", "suppliers"), ("candidate", "candidates"), ("excluded", "excluded"))])
    return pages.crossJoin(groups)  # one row each


def evidence_long(suppliers: DataFrame) -> DataFrame:
    """A row per fact of a supplier."""
    return suppliers.select(F.col("id").alias("supplier_id"), F.inline("evidence"))
