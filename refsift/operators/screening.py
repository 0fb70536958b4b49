"""Screening cascade, ranking, axis mapping, landmark works, semantic rescue, verdicts and agreement of reviewers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..functions.text import evaluation_text, hits_any, hits_count, once, term_hits
from ..plans.scope import Scope
from ..schema import DIRECT, OFF_TOPIC, TANGENTIAL

# Fixed values.
EXCLUDED_TYPES = ("editorial", "letter", "comment", "news", "newspaper article", "personal narrative", "published erratum", "retracted publication")
REVIEW_TYPES = ("review", "systematic-review", "systematic review", "meta-analysis", "journal-review")
REVIEW_TITLE = (
    r"(?i)systematic review|meta-?analysis|scoping review|umbrella review|integrative review|rapid review|overview of (systematic )?reviews"
    r"|revis[aã]o sistem[aá]tica|revis[aã]o de escopo|revis[aã]o integrativa|metan[aá]lise|meta-an[aá]lise|revis[aã]o guarda-chuva"
)


def excluded_type(pub_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(pub_type)).isin(*EXCLUDED_TYPES), F.lit(False))


def review_like(pub_type: Column, title: Column) -> Column:
    return F.coalesce(F.lower(F.trim(pub_type)).isin(*REVIEW_TYPES), F.lit(False)) | F.coalesce(title.rlike(REVIEW_TITLE), F.lit(False))


def all_terms(scope: Scope) -> list[str]:
    """Every term that the cascade or the ranking looks for in a record's text."""
    lists = [b.terms for b in scope.blocks] + [t for a in scope.axes for t in (a.keywords, a.synonyms)]
    return [t for terms in (*lists, scope.direct_terms, scope.application_terms, scope.domain_terms) for t in terms]


def blocks_hit(hits: Column, scope: Scope) -> Column:
    return reduce(lambda a, b: a + b, [hits_any(hits, b.terms).cast("int") for b in scope.blocks], F.lit(0))


def axes_of(hits: Column, scope: Scope) -> Column:
    """Names of the axes that a keyword or synonym of hits, in the scope's order."""
    if not scope.axes:
        return F.array().cast("array<string>")
    found = [F.when(hits_any(hits, [*a.keywords, *a.synonyms]), F.lit(a.name)) for a in scope.axes]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def screen(refs: DataFrame, scope: Scope, with_hits: bool = False) -> DataFrame:
    """relevance, relevance_method and mapped_axes of the active rows; duplicates pass unchanged. with_hits: also _hits,
    the scope's terms that the text holds, which `rank` then need not look for again.

    The first rule that fits decides, and rows that the first four rules decide are closed: axes and verdicts don't
    reach them."""
    on_doubt = scope.modality != "pesquisa-base"
    text = evaluation_text(F.col("title"), F.col("abstract"), F.col("journal"))
    seen = F.struct(
        term_hits(text, all_terms(scope)).alias("hits"),
        term_hits(F.lower(F.coalesce(F.col("title"), F.lit(""))), scope.off_topic_terms).alias("title"),
        (~text.rlike(r"\S")).alias("blank"),
    )
    told = refs.withColumn("_seen", once(seen))
    hits = F.col("_seen.hits")
    told = told.withColumns(
        {
            "_k": blocks_hit(hits, scope),
            "_direct": hits_any(hits, scope.direct_terms),
            "_out": hits_any(F.col("_seen.title"), scope.off_topic_terms),
            "_axes": axes_of(hits, scope),
        }
    )
    k, direct = F.col("_k"), F.col("_direct")
    blank = F.col("_seen.blank")
    not_review = F.lit(scope.modality == "meta-revisao") & ~review_like(F.col("pub_type"), F.col("title"))
    closing = (
        F.when(blank, F.lit("no_text"))
        .when(excluded_type(F.col("pub_type")), "pub_type_excluded")
        .when(not_review, "nao_e_revisao")
        .when(F.col("_out") & ~direct, "exclusion_keyword")
    )
    method = (
        F.when(k >= 2, F.concat(F.lit("co_occurrence_"), k.cast("string"), F.lit("_blocks")))
        .when((k == 1) & direct, "single_block_plus_direct_keyword")
        .when(k == 1, "single_block")
        .when(direct, "direct_keyword_only")
        .otherwise("default_include" if on_doubt else "no_match")
    )
    level = F.when((k >= 2) | ((k == 1) & direct), DIRECT).when((k == 1) | direct | F.lit(on_doubt), TANGENTIAL).otherwise(OFF_TOPIC)
    told = told.withColumns({"_closed": closing, "_level": level, "_method": method})
    if scope.axes:
        lost = (F.col("_level") == DIRECT) & (F.size("_axes") == 0)
        told = told.withColumns({"_level": F.when(lost, TANGENTIAL).otherwise(F.col("_level")), "_method": F.when(lost, F.concat("_method", F.lit("_no_axis"))).otherwise(F.col("_method"))})
    verdict = F.col("llm_verdict")
    after = F.when((verdict == "include") & (F.col("_level") == TANGENTIAL), DIRECT).when((verdict == "include") & (F.col("_level") == OFF_TOPIC), TANGENTIAL).otherwise(F.col("_level"))
    note = (
        F.when((verdict == "include") & (F.col("_level") == TANGENTIAL), "|llm_include")
        .when((verdict == "include") & (F.col("_level") == OFF_TOPIC), "|llm_divergent_include")
        .when((verdict == "exclude") & (F.col("_level") != OFF_TOPIC), "|llm_divergent_exclude")
        .when(verdict == "maybe", "|llm_maybe")
        .otherwise("")
    )
    first = F.when(blank & F.lit(on_doubt), TANGENTIAL).otherwise(OFF_TOPIC)
    active, closed = ~F.col("is_duplicate"), F.col("_closed").isNotNull()
    out = told.withColumns(
        {
            "relevance": F.when(~active, F.col("relevance")).when(closed, first).otherwise(after),
            "relevance_method": F.when(~active, F.col("relevance_method")).when(closed, F.col("_closed")).otherwise(F.concat("_method", note)),
            "mapped_axes": F.when(active & ~closed & (F.col("_level") != OFF_TOPIC), F.col("_axes")).otherwise(F.coalesce(F.col("mapped_axes"), F.array().cast("array<string>"))),
        }
    )
    out = out.withColumn("_hits", hits) if with_hits else out
    return out.drop("_seen", "_k", "_direct", "_out", "_axes", "_closed", "_level", "_method")


def rank(refs: DataFrame, scope: Scope) -> DataFrame:
    """relevance_score: 0 for duplicates and off-topic rows."""
    if "_hits" not in refs.columns:
        text = evaluation_text(F.col("title"), F.col("abstract"), F.col("journal"))
        refs = refs.withColumn("_hits", once(term_hits(text, [*scope.application_terms, *scope.domain_terms, *scope.direct_terms])))
    hits = F.col("_hits")
    year, cites = F.coalesce("year", F.lit(0)), F.coalesce(F.col("citation_count"), F.lit(0)).cast("double")
    recency = F.when(year >= 2025, 3).when(year >= 2023, 2).when(year >= 2021, 1).otherwise(0)
    score = (
        3.0 * F.size("mapped_axes")
        + 2.0 * hits_count(hits, scope.application_terms)
        + 1.0 * hits_count(hits, scope.domain_terms)
        + 0.5 * F.least(hits_count(hits, scope.direct_terms), F.lit(5))
        + recency
        + F.when(F.coalesce(F.col("is_open_access"), F.lit(False)), 2.0).otherwise(0.0)
        + F.least(cites / 50.0, F.lit(5.0))
    )
    idle = F.col("is_duplicate") | (F.col("relevance") == OFF_TOPIC)
    return refs.withColumn("relevance_score", F.when(idle, 0.0).otherwise(F.bround(score, 2))).drop("_hits")


def landmark_threshold(refs: DataFrame, cites: str = "citation_count", most: int = 1 << 16) -> DataFrame:
    """One row: the citation count at rank max(1, n div 10) of the rows with citations; null without any.

    No task sees all values: counts by 1,024 equal parts of the range tell which part holds the rank, and that part is
    divided anew until it has at most `most` rows, or one value. Values must differ as doubles if they differ."""
    values = refs.where(F.col(cites) > 0).select(F.col(cites).alias("v"))
    x = F.col("v").cast("double")
    total, low, high = values.agg(F.count(F.lit(1)), F.min(x), F.max(x)).first()
    rank, inside = max(1, total // 10), total
    while inside > most and low < high:
        part = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / 1024)), F.lit(1023))
        parts = values.where(x.between(low, high)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("a"), F.max(x).alias("b"))
        for r in sorted(parts.collect(), key=lambda r: -r["p"]):  # 1,024 rows at most
            if rank <= r["n"]:
                low, high, inside = r["a"], r["b"], r["n"]
                break
            rank -= r["n"]
    left = values.where(x.between(low, high)) if total else values
    if total and low < high:
        left = left.orderBy(F.desc("v")).limit(rank)
    return left.agg(F.min("v").alias("threshold"))


def mark_landmarks(refs: DataFrame) -> DataFrame:
    """is_canonical becomes true from 100 citations on, or in the top decile; it is never cleared."""
    bar = F.broadcast(landmark_threshold(refs.where(~F.col("is_duplicate"))))
    hit = ~F.col("is_duplicate") & (F.col("citation_count") > 0) & ((F.col("citation_count") >= 100) | (F.col("citation_count") >= F.col("threshold")))
    return refs.join(bar, F.lit(True), "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)) | F.coalesce(hit, F.lit(False))).drop("threshold")


def semantic_layer(refs: DataFrame, vectors: DataFrame, query: list[float], threshold: float = 0.60, weight: float = 8.0) -> DataFrame:
    """vectors: id, embedding. Rows off topic for want of a match come back at the threshold; then every scored row that
    isn't off topic gains score * weight."""
    scored = vectors.select(F.col("id"), F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query])), 4).alias("_score"))
    out = refs.drop("semantic_score").join(scored.withColumnRenamed("_score", "semantic_score"), "id", "left")
    score = F.col("semantic_score")
    saved = (F.col("relevance") == OFF_TOPIC) & (F.split_part("relevance_method", F.lit("|"), F.lit(1)) == "no_match") & (score >= threshold)
    out = out.withColumn("_saved", F.coalesce(saved, F.lit(False)))
    out = out.withColumns(
        {
            "relevance": F.when(F.col("_saved"), TANGENTIAL).otherwise(F.col("relevance")),
            "relevance_method": F.when(F.col("_saved"), F.concat("relevance_method", F.lit("|semantic_rescue"))).otherwise(F.col("relevance_method")),
        }
    )
    gain = F.when((F.col("relevance") != OFF_TOPIC) & score.isNotNull(), score * weight).otherwise(0.0)
    return out.withColumn("relevance_score", F.col("relevance_score") + gain).drop("_saved")


def merge_verdicts(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: id, verdict, reason, criteria and _line; a later line for an id overwrites an earlier one."""
    last = verdicts.groupBy("id").agg(F.max_by(F.struct("verdict", "reason", "criteria"), "_line").alias("v"))
    out = refs.join(last, "id", "left")
    return out.withColumns({"llm_verdict": F.coalesce("v.verdict", "llm_verdict"), "llm_reason": F.coalesce("v.reason", "llm_reason"), "llm_criteria": F.coalesce("v.criteria", "llm_criteria")}).drop("v")


def without_verdict(refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    return refs.where(~F.col("is_duplicate")).join(verdicts.select("id"), "id", "left_anti")


def kappa(pairs: DataFrame) -> DataFrame:
    """Agreement of two raters; pairs: one, two (`include` or `exclude`). One row: n, observed, kappa, label."""
    cell = {f"{a}{b}": F.count_if((F.col("one") == x) & (F.col("two") == y)).cast("double") for a, x in (("i", "include"), ("e", "exclude")) for b, y in (("i", "include"), ("e", "exclude"))}
    told = pairs.agg(*[v.alias(k) for k, v in cell.items()])
    ii, ie, ei, ee = (F.col(c) for c in ("ii", "ie", "ei", "ee"))
    n = ii + ie + ei + ee
    observed = F.try_divide(ii + ee, n)
    expected = F.try_divide((ii + ie) * (ii + ei) + (ee + ei) * (ee + ie), n * n)
    value = F.when(n < 2, None).when(expected == 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    out = told.select(n.cast("long").alias("n"), F.when(n < 2, 0.0).otherwise(observed).alias("observed"), value.alias("kappa"))
    k = F.col("kappa")
    label = F.when(k > 0.8, "almost perfect").when(k > 0.6, "substantial").when(k > 0.4, "moderate").when(k > 0.2, "fair").when(k.isNotNull(), "slight")
    return out.withColumn("label", label)


def keyword_choice(relevance: Column) -> Column:
    return F.when(relevance == OFF_TOPIC, "exclude").otherwise("include")


def divergences(refs: DataFrame) -> DataFrame:
    """Disagreements in order, then all rows that the verdict leaves open."""
    choice = keyword_choice(F.col("relevance"))
    kind = F.when(F.col("llm_verdict") == "maybe", 1).when(F.col("llm_verdict") != choice, 0)
    return refs.where(~F.col("is_duplicate")).select("id", "_seq", choice.alias("keyword"), F.col("llm_verdict").alias("verdict"), kind.alias("kind")).where("kind is not null").orderBy("kind", "_seq")
