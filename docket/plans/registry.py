"""All queries of the engine's own operators.

A registered query gives flat columns: arrays are joined with commas and dates
written as ISO text, alike in Spark and in the SQL, because result comparers
disagree about how such values look. The operators themselves keep their types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.plans import Query, canonical, caselog, drafts, evidence, reports, retrieval, rules, segmentation, sources

BOOKS = [segmentation.BOOK, canonical.BOOK, retrieval.BOOK, evidence.BOOK, rules.BOOK, drafts.BOOK, reports.BOOK, caselog.BOOK, sources.BOOK]

ARRAYS = {
    "g11_name_fields": ["args_list"],
    "g16_low_text_pages": ["pages"],
    "g17_distinct_characters": ["found"],
    "g21_scrub_query": ["removed"],
    "n11_hint_precedence": ["hints"],
    "h06_fusion": ["passed"],
    "h08_hybrid_search": ["passed"],
    "h08_stored_hybrid": ["passed"],
    "h17_rank_coverage": ["hit", "missing"],
    "h18_precedents": ["rebuttals", "near_misses"],
    "h24_authority_conflicts": ["letters", "rulings"],
    "h27_substantive": ["results"],
    "j07_selected_sources": ["sides"],
    "j10_highlights": ["codes"],
    "j12_narrative_coverage": ["missing"],
    "d05_items_present": ["problems"],
    "d15_case_verdict": ["items"],
    "d19_grounds": ["reasons", "grounds", "warnings"],
    "q01_citations_outside": ["outside"],
    "q02_text_citations": ["cites"],
    "q04_verify_quotes": ["cited_truncated"],
    "q05_fragments": ["fragments"],
    "q07_headline_conflicts": ["numbers"],
    "q10_route_words": ["words"],
    "r04_quality_report": ["bad"],
    "r04_compound_cases": ["clauses", "results"],
    "r13_set_operations": ["only_a", "shared"],
    "l03_version_list": ["versions"],
    "l20_risk_tags": ["risks"],
    "s13_archive_bundle": ["parts"],
}
DATES = {
    "d21_case_summary": ["deadline"],
    "p01_appeal_period": ["start_from", "deadline"],
    "p02_amend_deadline": ["deadline"],
    "p03_roc_calendar": ["back", "words", "wrong", "short", "mixed"],
}


def _flat(name: str, query: Query) -> Query:
    arrays, dates = ARRAYS.get(name, []), DATES.get(name, [])
    if not arrays and not dates:
        return query

    def run(spark, sf_dir: str) -> DataFrame:
        joined = {c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",") for c in arrays}
        return query(spark, sf_dir).withColumns(joined | {c: F.col(c).cast("string") for c in dates})

    return run


def _flat_sql(name: str, sql: str) -> str:
    arrays, dates = ARRAYS.get(name, []), DATES.get(name, [])
    if not arrays and not dates:
        return sql
    parts = [f"array_to_string(list_transform({c}, lambda x: coalesce(x::VARCHAR, 'null')), ',') AS {c}" for c in arrays] + [f"{c}::VARCHAR AS {c}" for c in dates]
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql.strip()})"


def queries() -> dict[str, Query]:
    return {name: _flat(name, q) for book in BOOKS for name, q in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _flat_sql(name, text) for book in BOOKS for name, text in book.sql.items()}
