"""The whole search over landed data: sources, deduplication, facts, companies, scores.

Plans are lazy within a phase; the records before and after enrichment and the companies are
materialised, since several joins read each of them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import entities, extraction, history, links, pages, results, scoring
from ..sources import web
from ..sources.provider import redacted


@dataclass
class SearchResult:
    """Ranked companies (all groups), lineage, counters and what went wrong; sinks take one action each."""

    companies: DataFrame
    sources: DataFrame
    counters: DataFrame
    warnings: list[str] = field(default_factory=list)


def numbered(suppliers: DataFrame, start: int = 0) -> DataFrame:
    """Gives each record an ordinal of its own from ``start`` on, in the order of its providers, and writes it down."""
    return entities.materialise(suppliers.withColumn("ord", F.lit(start) + F.monotonically_increasing_id()), suppliers.sparkSession)


def first_pages(suppliers: DataFrame, hits: DataFrame) -> DataFrame:
    """url, domain, ord of what a landing job fetches first."""
    return pages.select_initial_urls(links.fetch_urls(suppliers, hits))


def next_pages(landed: DataFrame) -> DataFrame:
    """url, domain, ord of what it fetches next: useful links of the landed pages, within what is left of each domain's share."""
    found = pages.useful_links(landed.select(F.col("final_url").alias("url"), "html"))
    order = F.struct((-F.col("score")).alias("score"), "place", "url")
    visited = landed.select(C.normalize_url("url").alias("url"), C.normalize_domain("url").alias("domain"))
    return pages.second_wave(found.select(F.col("target").alias("url"), C.normalize_domain("target").alias("domain"), order.alias("ord")), visited)


def search(request: scoring.Request, suppliers: DataFrame, hits: DataFrame, landed: DataFrame, sources: DataFrame, checked_at: Column, answers: DataFrame | None = None, warnings: list[str] | None = None) -> SearchResult:
    """suppliers and sources come from the providers, hits from the web sources, landed holds fetched pages of both
    waves, answers (supplier_id, payload) what a model said of them, warnings what the providers reported."""
    known = suppliers if "ord" in suppliers.columns else numbered(suppliers)
    keep = lambda df: entities.materialise(df, df.sparkSession)
    unique = keep(pages.deduplicate_hits(hits))
    attached = links.attach_hits(known, unique)
    fresh = numbered(web.suppliers_from_hits(links.unattached_hits(known, unique), checked_at), 1 << 61)
    everyone = keep(attached.unionByName(fresh, allowMissingColumns=True))
    gated = keep(pages.fetch_gates(landed))
    owned = keep(links.page_owners(gated, everyone).join(gated, "url"))
    found = keep(extraction.enrich(everyone, owned, request.category))
    if answers is not None:
        found = keep(extraction.merge_model_facts(found, extraction.model_facts(extraction.parse_model_facts(answers)), pages.usable(gated))[0])
    companies = keep(entities.deduplicate(keep(entities.normalize_suppliers(found))))
    lineage = sources.unionByName(links.hit_sources(unique, everyone), allowMissingColumns=True).unionByName(pages.page_sources(gated), allowMissingColumns=True)
    scored = scoring.score(scoring.mark_unavailable(companies, lineage), request)
    return SearchResult(scoring.rank(scored, request.max_results), lineage, results.run_counters(lineage, scored), list(warnings or []))


def save(result: SearchResult, request: scoring.Request, root: str, run_id: str, started_at: Column, finished_at: Column, warnings: list[str] | None = None) -> None:
    """Writes the run, its companies with their evidence, and its sources to the history below ``root``, all or nothing."""
    run, warnings = F.lit(run_id), [*result.warnings, *(warnings or [])]
    row = result.counters.select(
        run.alias("run_id"), started_at.alias("started_at"), finished_at.alias("finished_at"), F.lit("partial" if warnings else "completed").alias("status"), F.lit(json.dumps(asdict(request), ensure_ascii=False)).alias("request"),
        F.to_json(F.struct(*result.counters.columns)).alias("stats"), F.lit(json.dumps(warnings, ensure_ascii=False)).alias("warnings"), "suppliers_found", "candidates_found")
    lineage = result.sources.withColumns({"run_id": run, "seq": F.monotonically_increasing_id()})
    facts = results.evidence_long(result.companies).withColumn("run_id", run)
    history.save_run(root, {"search_runs": row, "suppliers": history.supplier_payload(result.companies, run_id), "evidence": facts, "sources": lineage})


def persist(result: SearchResult, request: scoring.Request, root: str, run_id: str, started_at: Column, finished_at: Column, secrets: tuple[str, ...] = ()) -> bool:
    """Saves the run; a history that can't be written becomes a warning of the result, which stays whole."""
    try:
        save(result, request, root, run_id, started_at, finished_at)
    except Exception as error:  # whatever the store says, the result must reach the caller
        result.warnings.append(f"history: {redacted(error, secrets)}")
        return False
    return True
