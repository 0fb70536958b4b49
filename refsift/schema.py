"""The record schema, and enumerations as values in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the output contract.
TIERS = {"T1": 1, "T2": 2, "T3": 3, "T4": 4, "UNKNOWN": 0}
RELEVANCE = {"DIRECT": 2, "TANGENTIAL": 1, "OFF_TOPIC": 0}
DIRECT, TANGENTIAL, OFF_TOPIC = 2, 1, 0
ACCESS = ("accessible", "restricted", "broken", "no_url", "open_access")
GRADES = ("gold", "silver", "bronze", "discard", "ungraded")
MODALITIES = ("pesquisa-base", "revisao-integrativa", "revisao-sistematica", "revisao-escopo", "meta-revisao")
VERDICTS = ("include", "exclude", "maybe")
RISKS = ("CRITICAL", "HIGH", "MEDIUM", "LOW-MEDIUM", "LOW", "NONE", "UNKNOWN")
RISK_OF_STATUS = {
    "VERIFIED": "NONE",
    "APPROXIMATE_MATCH": "LOW",
    "ENTITY_FOUND": "LOW-MEDIUM",
    "THEMATIC_MATCH": "NONE",
    "NOT_FOUND_ABSTRACT": "MEDIUM",
    "NOT_FOUND_FULLTEXT": "HIGH",
    "NOT_FOUND_ALL_REFS": "CRITICAL",
    "MATH_ERROR": "HIGH",
    "UNVERIFIABLE": "UNKNOWN",
}

#: name type default; every reader fills what is missing.
REFS = (
    "_seq long, id string, title string, authors array<string>, year int, doi string, pmid string, openalex_id string, url string,"
    " journal string, abstract string, volume string, issue string, pages string, source_api string, search_query string, pub_type string,"
    " is_duplicate boolean, canonical_id string, doi_resolves boolean, crossref_match boolean, crossref_title_similarity double,"
    " authors_verified boolean, verified_via string, verification_issues array<string>, tier string, domain string, relevance int,"
    " relevance_method string, relevance_score double, mapped_axes array<string>, citation_count long, is_canonical boolean,"
    " semantic_score double, llm_verdict string, llm_reason string, llm_criteria array<string>, retracted boolean, has_correction boolean,"
    " access_status string, is_open_access boolean, oa_url string, grade string"
)

def conformed(df: DataFrame) -> DataFrame:
    """All columns of REFS, typed, missing ones with their defaults, further ones after them. `_seq` must be there."""
    kinds = dict(field.split(" ", 1) for field in REFS.split(", "))

    def value(name: str, kind: str) -> Column:
        own = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        if name == "is_duplicate":
            own = F.coalesce(own, F.lit(False))
        elif name == "relevance_score":
            own = F.coalesce(own, F.lit(0.0))
        elif kind == "array<string>":
            own = F.coalesce(own, F.array().cast(kind))
        return own.alias(name)

    return df.select(*[value(n, k) for n, k in kinds.items()], *[c for c in df.columns if c not in kinds])
