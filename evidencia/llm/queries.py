"""Queries of the corpus operators by name, and their SQL where it is exact and affordable."""

from __future__ import annotations

from evidencia.llm import language, neardup, orgnames, packing, pii, places, spans, tokens

QUERIES: dict = {
    "p1_found": places.p1_found,
    "p3_found": orgnames.p3_found,
    "p3_organisations": orgnames.p3_organisations,
    "p4_found": pii.p4_found,
    "p4_redacted": pii.p4_redacted,
    "p5_found": language.p5_found,
    "p5_segments": language.p5_segments,
    "p6_found": neardup.p6_found,
    "p6_groups": neardup.p6_groups,
    "p6_documents": neardup.p6_documents,
    "p8_ids": tokens.p8_ids,
    "p9_packing": packing.p9_packing,
    "p10_found": spans.p10_found,
    "p10_shared": spans.p10_shared,
}
SQL: dict = neardup.SQL | spans.SQL
