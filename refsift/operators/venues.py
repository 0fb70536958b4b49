"""Look-ups of publication venues: by ISSN, by title, and the recommendation of venues for a text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import token_set_ratio
from .journals import FINALISTS, candidates, finalists, pre_score

# Fixed value: from this likeness on a title is taken for a venue's.
LIKE = 85.0


def by_issn(wanted: DataFrame, journals: DataFrame) -> DataFrame:
    """wanted: issn; journals: issn_l, issns and more. Each ISSN beside the venue that it leads to: the one whose key it
    is, else the one among whose ISSNs it is (of several the smallest key); ISSNs without a venue are left out."""
    keys = wanted.select("issn").distinct()
    own = journals.select(F.col("issn_l").alias("issn"), "issn_l", F.lit(0).alias("_rank"))
    listed = journals.select(F.explode("issns").alias("issn"), "issn_l", F.lit(1).alias("_rank"))
    best = keys.join(own.unionByName(listed), "issn").groupBy("issn").agg(F.min_by("issn_l", F.struct("_rank", "issn_l")).alias("issn_l"))
    return best.join(journals, "issn_l").select("issn", *journals.columns)


def _best(wanted: DataFrame, found: DataFrame, via: str) -> DataFrame:
    """titulo -> the most like of its candidates, of equals the first. found: titulo, rank, name, issn_l, issns."""
    met = wanted.select("titulo").distinct().join(found, "titulo")
    met = met.withColumn("_like", token_set_ratio(F.lower("titulo"), F.lower(F.coalesce("name", F.lit("")))))
    row = F.struct(F.col("_like").alias("similaridade"), "issn_l", "issns", F.lit(via).alias("via"))
    return met.groupBy("titulo").agg(F.max_by(row, F.struct("_like", (-F.col("rank")).alias("r"))).alias(via))


def by_title(wanted: DataFrame, openalex: DataFrame, crossref: DataFrame, least: float = LIKE) -> DataFrame:
    """wanted: titulo. titulo, issn_l, issns, similaridade, via. The second service counts only where the first one's best
    is below `least`, and only if it is strictly better; below `least` nothing is resolved, but the likeness is told."""
    out = wanted.select("titulo").distinct().join(_best(wanted, openalex, "openalex"), "titulo", "left").join(_best(wanted, crossref, "crossref"), "titulo", "left")
    one, two = F.col("openalex"), F.col("crossref")
    first = F.coalesce(one["similaridade"], F.lit(0.0))
    other = (first < least) & two.isNotNull() & (two["similaridade"] > first)
    best = F.when(other, two).otherwise(one)
    good = best["similaridade"] >= least
    return out.select("titulo", *[F.when(good, best[c]).alias(c) for c in ("issn_l", "issns", "via")], best["similaridade"].alias("similaridade"))


def seed(entries: DataFrame, origin: str, openalex: DataFrame, crossref: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """entries: rows of a curated list. The curated rows with what their titles resolve to, and the least rows (issn_l,
    titulo, issns, homepage_url) of the venues found, to be merged into the known ones."""
    told = entries.join(by_title(entries, openalex, crossref), "titulo", "left").withColumn("origem", F.lit(origin))
    told = told.withColumn("resolvido_em", F.when(F.col("issn_l").isNotNull(), as_of))
    hit = told.where("issn_l is not null")
    venues = hit.groupBy("issn_l").agg(F.max_by(F.struct("titulo", "issns", F.col("url").alias("homepage_url")), F.struct("file", "line")).alias("v"))
    return told, venues.select("issn_l", "v.*")


def descriptors(answers: DataFrame) -> DataFrame:
    """answers: term, label, uri. Suggestions of each term: exact ones first, then by label; those without a label go."""
    exact = F.lower("label") == F.lower(F.trim("term"))
    told = answers.where("label <> ''").select("term", F.struct((~exact).alias("other"), F.col("label"), F.col("uri")).alias("s"))
    lists = told.groupBy("term").agg(F.sort_array(F.collect_list("s")).alias("s"))  # a service gives a few for a term
    return lists.select("term", F.posexplode("s").alias("position", "s")).select("term", "position", "s.label", "s.uri", (~F.col("s.other")).alias("exact"))


def search_terms(blocks: Sequence[Sequence[str]]) -> list[str]:
    """The distinct terms of all blocks, in order."""
    return list(dict.fromkeys(t for terms in blocks for t in terms if t))


def currently_indexed(answers: DataFrame) -> DataFrame:
    """answers: issn, count (a string, as answered). issn, indexed: true, false, or null where the count is no number."""
    return answers.select("issn", (F.col("count").cast("string").try_cast("int") > 0).alias("indexed"))


def flag(c: Column) -> Column:
    """1, 0 or null of a boolean."""
    return c.cast("boolean").cast("int")


def consultation(theme: str | None = None, profile: str | None = None, manuscript: str | None = None) -> dict:
    """What to look for: a profile (JSON text) before a theme before a manuscript (Markdown text), whose title is its
    first heading and whose beginning is its first 120 words."""
    if profile:
        told = json.loads(profile)
        if not told.get("keywords_en") and not told.get("tema"):
            raise ValueError("a profile needs keywords_en or tema")
        return told
    if theme:
        return {"tema": theme, "keywords_en": [], "tipo_de_estudo": None}
    if manuscript:
        heads = [line.lstrip("# ").strip() for line in manuscript.splitlines() if line.startswith("#")]
        words = re.sub(r"[#*\[\]`>-]", " ", manuscript).split()
        return {"tema": f"{heads[0] if heads else ''}. {' '.join(words[:120])}", "keywords_en": [], "tipo_de_estudo": None}
    raise ValueError("a theme, a profile or a manuscript is needed")


def recommend(
    consult: Mapping, works: DataFrame, base: DataFrame, curated: DataFrame, interest: Sequence[str] = (), top: int = FINALISTS
) -> tuple[DataFrame, DataFrame]:
    """works: issn_l, _seq of the works found for the consultation; base: enriched venues; curated: issn_l, titulo. The
    finalists, and the candidates that have no row in the base with the reason."""
    wanted = candidates(works, base, curated)
    frequency = works.groupBy("issn_l").agg(F.count(F.lit(1)).alias("n"))
    known = base.join(wanted, "issn_l", "left_semi")
    text = " ".join([consult.get("tema") or "", *consult.get("keywords_en", [])])
    scored = pre_score(known, text, frequency, curated, interest)
    missing = wanted.join(base.select("issn_l"), "issn_l", "left_anti").withColumn("reason", F.lit("no row in the base"))
    return finalists(scored, top), missing


def standing(verdict: Column, quartile: Column, member: Column) -> Column:
    """Four groups of venues: by both doors, by one of them, by neither, or without data."""
    member = F.coalesce(member.cast("boolean"), F.lit(False))
    return (
        F.when((verdict == "consolidado") & member, "A/B")
        .when(verdict == "consolidado", F.coalesce(quartile, F.lit("A")))
        .when(member, "B")
        .when(verdict == "nao_por_scimago", "Q3/Q4")
        .when(verdict == "sem_categoria_saude", "no health category")
        .otherwise("no data")
    )
