"""The declared scope of a project, its configuration file, and the query strings of external sources."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Results kept a source and at the end, by modality.
LIMITS = {
    "pesquisa-base": (100, 40),
    "revisao-integrativa": (300, 80),
    "revisao-sistematica": (500, 200),
    "revisao-escopo": (500, 200),
    "meta-revisao": (500, 100),
}
LANGUAGE_NAMES = {"en": "english", "pt": "portuguese", "es": "spanish"}
REVIEW_FILTER = 'systematic[sb] OR "meta-analysis"[Publication Type] OR "systematic review"[Publication Type]'
APPLICATION_WORDS = ("application", "aplica", "intervention", "interven", "problem")
DOMAIN_WORDS = ("domain", "domín", "domin", "context", "setting")


@dataclass(frozen=True)
class Block:
    concept: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Axis:
    name: str
    keywords: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class Scope:
    project: str = ""
    modality: str = "pesquisa-base"
    question: str = ""
    blocks: tuple[Block, ...] = ()
    axes: tuple[Axis, ...] = ()
    mesh: tuple[str, ...] = ()
    direct_terms: tuple[str, ...] = ()
    off_topic_terms: tuple[str, ...] = ()
    years: tuple[int, int] = (2015, 2026)
    languages: tuple[str, ...] = ("en", "pt", "es")
    sources: tuple[str, ...] = ()
    max_results: int = 100
    max_final: int = 40
    fields_of_study: tuple[str, ...] = ("Medicine",)
    semantic: bool = False
    semantic_threshold: float = 0.60
    semantic_weight: float = 8.0
    warnings: tuple[str, ...] = field(default=())
    inclusion: tuple[str, ...] = ()
    exclusion: tuple[str, ...] = ()

    def _terms_of(self, words: Sequence[str]) -> tuple[str, ...]:
        """Terms of the last block whose concept holds one of the words."""
        found = [b.terms for b in self.blocks if any(w in b.concept.lower() for w in words)]
        return found[-1] if found else ()

    @property
    def application_terms(self) -> tuple[str, ...]:
        return self._terms_of(APPLICATION_WORDS)

    @property
    def domain_terms(self) -> tuple[str, ...]:
        return self._terms_of(DOMAIN_WORDS)


def read_scope(values: Mapping[str, Any]) -> Scope:
    """A scope from the configuration's mapping: its value, else the modality's, else the general default. A list of
    fields of study that is given and empty means no filter."""
    modality = values.get("modality") or "pesquisa-base"
    most, final = LIMITS.get(modality, LIMITS["pesquisa-base"])
    words = values.get("relevance_keywords") or {}
    blocks = tuple(Block(str(b.get("concept", "")), tuple(b.get("terms") or ())) for b in values.get("keyword_blocks") or ())
    notes = tuple(n for n, bad in (("no keyword blocks", not blocks), ("no research question", not values.get("research_question"))) if bad)
    return Scope(
        project=values.get("project_name") or "",
        modality=modality,
        question=values.get("research_question") or "",
        blocks=blocks,
        axes=tuple(Axis(a["name"], tuple(a.get("keywords") or ()), tuple(a.get("synonyms") or ())) for a in values.get("axes") or ()),
        mesh=tuple(values.get("mesh_terms") or ()),
        direct_terms=tuple(words.get("direct") or ()),
        off_topic_terms=tuple(words.get("off_topic") or ()),
        years=tuple(values.get("year_range") or Scope.years),
        languages=tuple(values.get("languages") or Scope.languages),
        sources=tuple(values.get("apis") or ()),
        max_results=values.get("max_results_per_api") or most,
        max_final=values.get("max_final_refs") or final,
        fields_of_study=tuple(values["fields_of_study"]) if values.get("fields_of_study") is not None else Scope.fields_of_study,
        semantic=bool(values.get("semantic", False)),
        semantic_threshold=float(values.get("semantic_threshold", 0.60)),
        semantic_weight=float(values.get("semantic_weight", 8.0)),
        warnings=notes,
        inclusion=tuple(values.get("inclusion_criteria") or ()),
        exclusion=tuple(values.get("exclusion_criteria") or ()),
    )


def load_scope(path: str) -> Scope:
    import yaml

    with open(path, encoding="utf-8") as f:
        return read_scope(yaml.safe_load(f) or {})


def query_text(scope: Scope) -> str:
    """What is embedded for a review: its question and the terms of its blocks."""
    return ". ".join(p for p in (scope.question, *scope.inclusion, *(t for b in scope.blocks for t in b.terms)) if p)


def environment(lines: Sequence[str], process: Mapping[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines, over which the process environment wins."""
    out = {}
    for line in lines:
        name, sign, value = line.strip().partition("=")
        if sign and name and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("'\"")
    return out | {k: v for k, v in (os.environ if process is None else process).items() if k in out}


def _grouped(parts: Sequence[str], word: str) -> str:
    return f" {word} ".join(parts)


def pubmed_query(scope: Scope) -> str:
    """Blocks joined by AND, terms by OR; then MeSH, years, languages and, for reviews of reviews, their filter."""
    groups = ["(" + _grouped([f'"{t}"[Title/Abstract]' for t in b.terms], "OR") + ")" for b in scope.blocks if b.terms]
    if not groups:
        return ""
    query = _grouped(groups, "AND")
    if scope.mesh:
        query = f"({query}) AND (" + _grouped([f'"{m}"[MeSH Terms]' for m in scope.mesh], "OR") + ")"
    return query + _pubmed_filters(scope, scope.modality == "meta-revisao")


def pubmed_fallback(scope: Scope) -> str:
    """Keywords or MeSH; the filters bind to the last group only."""
    groups = ["(" + _grouped([f'"{t}"[Title/Abstract]' for t in b.terms], "OR") + ")" for b in scope.blocks if b.terms]
    mesh = "(" + _grouped([f'"{m}"[MeSH Terms]' for m in scope.mesh], "OR") + ")"
    return f"({_grouped(groups, 'AND')}) OR {mesh}" + _pubmed_filters(scope, False)


def _pubmed_filters(scope: Scope, reviews: bool) -> str:
    out = f" AND ({scope.years[0]}:{scope.years[1]}[Date - Publication])"
    names = [LANGUAGE_NAMES[x] for x in scope.languages if x in LANGUAGE_NAMES]
    if names:
        out += " AND (" + _grouped([f"{n}[Language]" for n in names], "OR") + ")"
    return out + (f" AND ({REVIEW_FILTER})" if reviews else "")


def openalex_query(scope: Scope) -> str:
    """The first two terms of the first three blocks, and the first synonym of the first two axes."""
    words = [t for b in scope.blocks[:3] for t in b.terms[:2]] + [a.synonyms[0] for a in scope.axes[:2] if a.synonyms]
    return " ".join(words)


def semantic_scholar_query(scope: Scope) -> str:
    """At most five terms a block; only terms of several words are quoted."""
    return " + ".join("(" + " | ".join(f'"{t}"' if " " in t else t for t in b.terms[:5]) + ")" for b in scope.blocks if b.terms)


def europe_pmc_query(scope: Scope) -> str:
    groups = ["(" + _grouped([f'"{t}"' for t in b.terms], "OR") + ")" for b in scope.blocks if b.terms]
    return _grouped(groups, "AND") + f" AND (FIRST_PDATE:[{scope.years[0]}-01-01 TO {scope.years[1]}-12-31])" if groups else ""


def lilacs_query(scope: Scope) -> str:
    """Keywords, or the health descriptors."""
    groups = ["(" + _grouped([f'"{t}"' for t in b.terms], "OR") + ")" for b in scope.blocks if b.terms]
    words = _grouped(groups, "AND")
    return f"({words}) OR (" + _grouped([f'mh:"{m}"' for m in scope.mesh], "OR") + ")" if scope.mesh else words
