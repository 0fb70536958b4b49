"""Rules on single records: source tier, pendencies, grade, access, comparison with authoritative metadata, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import best_title, indel
from ..functions.text import filled, host, suffixes
from ..schema import DIRECT, OFF_TOPIC, TANGENTIAL

NOWHERE = "no DOI or PubMed id, and the title was found in no service: check by hand before citing"

# Publication types by tier.
ACADEMIC_TYPES = ("journal-article", "proceedings-article", "book-chapter", "dissertation", "posted-content", "peer-review", "reference-entry", "monograph")
REPORT_TYPES = ("report", "report-component", "dataset", "standard")


def domain_tier(df: DataFrame, tiers: DataFrame, url: str = "url") -> DataFrame:
    """df with domain and tier: the longest suffix of the host that the table (domain, tier) holds, else UNKNOWN.

    The table is joined on every suffix of every distinct host, so hosts are shuffled, never rows."""
    hosts = df.select(host(F.col(url)).alias("_host")).where("_host <> ''").distinct()
    parts = hosts.select("_host", F.posexplode(suffixes(F.col("_host"))).alias("_at", "_part"))
    dim = tiers.select(F.col("domain").alias("_part"), F.col("tier").alias("_tier"))
    found = parts.join(dim, "_part").groupBy("_host").agg(F.min_by("_tier", "_at").alias("_tier"))
    out = df.drop("domain", "tier").withColumn("_host", host(F.col(url))).join(found, "_host", "left")
    return out.withColumns({"domain": F.col("_host"), "tier": F.coalesce("_tier", F.lit("UNKNOWN"))}).drop("_host", "_tier")


def type_tier(pub_type: Column) -> Column:
    low = F.lower(pub_type)
    return F.when(low.isin(*ACADEMIC_TYPES), "T1").when(low.isin(*REPORT_TYPES), "T3").otherwise("UNKNOWN")


def classify(refs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Tier by domain; where that is unknown by PubMed id, then by publication type, then by a DOI that resolves."""
    told = domain_tier(refs, tiers)
    unknown = F.col("tier") == "UNKNOWN"
    pmid, kind = filled(F.col("pmid")).isNotNull(), type_tier(F.col("pub_type"))
    tier = F.when(~unknown, F.col("tier")).when(pmid, "T1").when(kind != "UNKNOWN", kind).when(F.coalesce(F.col("doi_resolves"), F.lit(False)), "T1").otherwise("UNKNOWN")
    return told.withColumns({"domain": F.when(unknown & pmid, F.coalesce(filled(F.col("domain")), F.lit("pubmed"))).otherwise(F.col("domain")), "tier": tier})


def pendencies() -> Column:
    """Codes of what a person must still settle, in order. Only an explicit false counts, not a null."""
    no = lambda c: F.col(c).eqNullSafe(F.lit(False))
    nothing = filled(F.col("doi")).isNull() & filled(F.col("pmid")).isNull() & filled(F.col("verified_via")).isNull()
    found = [
        F.when(no("authors_verified"), F.lit("authors_diverge")),
        F.when(F.col("doi_resolves").eqNullSafe(F.lit(True)) & no("crossref_match"), F.lit("title_diverges")),
        F.when(nothing, F.lit("unverifiable")),
        F.when(no("doi_resolves"), F.lit("doi_does_not_resolve")),
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def grade() -> Column:
    """The first rule that fits decides; access never lowers a grade, a pendency caps it at bronze."""
    tier, relevance = F.col("tier"), F.col("relevance")
    discard = F.col("retracted").eqNullSafe(F.lit(True)) | relevance.eqNullSafe(F.lit(OFF_TOPIC)) | (tier == "T4") | F.col("access_status").eqNullSafe(F.lit("broken"))
    high = tier.isin("T1", "T2")
    return (
        F.when(discard, "discard")
        .when(F.size(pendencies()) > 0, "bronze")
        .when(high & (relevance == DIRECT), "gold")
        .when((tier == "T3") & (relevance == DIRECT), "silver")
        .when(high & (relevance == TANGENTIAL), "silver")
        .otherwise("bronze")
    )


def grades_of(modality: str) -> tuple[str, ...]:
    return ("gold", "silver") if modality == "pesquisa-base" else ("gold", "silver", "bronze")


def access_status(url: Column, open_access: Column, probe: Column) -> Column:
    return (
        F.when(filled(url).isNull(), "no_url")
        .when(F.coalesce(open_access, F.lit(False)), "open_access")
        .when(probe == "accessible", "accessible")
        .when(probe == "broken", "broken")
        .otherwise("restricted")
    )


def probe_status(code: Column, retried: Column, error: Column, url: Column) -> Column:
    """What a request for a page says: code of HEAD, code of the GET that follows 403, 405 and 406, and the error."""
    return (
        F.when(~F.coalesce(url.startswith("http"), F.lit(False)), "no_url")
        .when(error == "timeout", "timeout")
        .when(error.isNotNull(), "broken")
        .when(code == 200, "accessible")
        .when(code.isin(403, 405, 406), F.when(retried == 200, "accessible").otherwise("restricted"))
        .when(code == 404, "broken")
        .when(code.between(300, 399), "accessible")
        .otherwise("restricted")
    )


def add_access(refs: DataFrame, probes: DataFrame, licences: DataFrame) -> DataFrame:
    """probes: id, probe; licences: doi, is_oa, oa_link. Lookup sides are made unique first."""
    p = probes.groupBy("id").agg(F.max("probe").alias("_probe"))
    o = licences.groupBy(F.lower("doi").alias("_doi")).agg(F.bool_or("is_oa").alias("_oa"), F.min("oa_link").alias("_link"))
    out = refs.join(p, "id", "left").join(o, F.lower("doi") == F.col("_doi"), "left")
    is_open = F.coalesce(F.col("_oa"), F.lit(False)) | F.coalesce(F.col("is_open_access"), F.lit(False))
    status = access_status(F.col("url"), is_open, F.col("_probe"))
    return out.withColumns({"access_status": status, "is_open_access": is_open, "oa_url": F.coalesce("oa_url", "_link")}).drop("_probe", "_doi", "_oa", "_link")


def to_obtain(refs: DataFrame) -> DataFrame:
    wanted = F.col("grade").isin("gold", "silver") & ~F.coalesce("is_open_access", F.lit(False)) & F.col("access_status").isin("restricted", "no_url")
    return refs.where(wanted).orderBy(F.desc(F.coalesce("is_canonical", F.lit(False))), F.desc(F.coalesce("citation_count", F.lit(0))), F.desc("relevance_score"), "_seq")


def discard_reason() -> Column:
    method = F.coalesce("relevance_method", F.lit(""))
    return (
        F.when(F.coalesce("retracted", F.lit(False)), "retracted")
        .when(method == "pub_type_excluded", "pub_type_excluded")
        .when(method == "exclusion_keyword", "exclusion_keyword")
        .when(F.col("relevance") == OFF_TOPIC, "off_topic")
        .when(F.col("tier") == "T4", "informal_source")
        .when(F.col("access_status") == "broken", "broken_url")
        .otherwise("composite")
    )


def synthesize(refs: DataFrame, modality: str, most: int) -> DataFrame:
    """refs with grade, and final: whether the row is among the first `most` by score of the grades that count."""
    graded = refs.withColumn("grade", F.when(F.col("is_duplicate"), F.col("grade")).otherwise(grade()))
    eligible = graded.where(~F.col("is_duplicate") & F.col("grade").isin(*grades_of(modality)))
    top = eligible.orderBy(F.desc("relevance_score"), "_seq").limit(most).select("_seq", F.lit(True).alias("final"))
    return graded.join(F.broadcast(top), "_seq", "left").withColumn("final", F.coalesce("final", F.lit(False)))


def _author(c: Column) -> Column:
    return F.trim(F.replace(F.lower(c), F.lit("."), F.lit("")))


def compare_authors(refs: DataFrame, stored: str = "authors", verified: str = "verified_authors") -> DataFrame:
    """refs with author_score and authors_ok. The first author must be alike to 85, authors 2 to 6 to 80, and the shorter
    list be half as long as the longer at least. Nothing to compare with is fine; nothing stored is not."""
    out = refs
    n_s, n_v = F.size(F.coalesce(F.col(stored), F.array())), F.size(F.coalesce(F.col(verified), F.array()))
    scores = []
    for i in range(6):
        both = (n_s > i) & (n_v > i)
        score = indel(_author(F.coalesce(F.get(stored, F.lit(i)), F.lit(""))), _author(F.coalesce(F.get(verified, F.lit(i)), F.lit(""))))
        out = out.withColumn(f"_s{i}", F.when(both, score))
        scores.append(F.col(f"_s{i}"))
    known = F.filter(F.array(*scores), lambda s: s.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    mean = F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))
    bad = F.coalesce(scores[0] < 85, F.lit(False)) | reduce(lambda a, b: a | b, [F.coalesce(s < 80, F.lit(False)) for s in scores[1:]])
    short = F.least(n_s, n_v) < 0.5 * F.greatest(n_s, n_v)
    ok = F.when(n_v == 0, True).when(n_s == 0, False).otherwise(~bad & ~short)
    return out.withColumns({"author_score": F.when(n_v == 0, 100.0).when(n_s == 0, 0.0).otherwise(mean), "authors_ok": ok}).drop(*[f"_s{i}" for i in range(6)])


def abbreviates(short: Column, full: Column) -> Column:
    """Whether 80 % of the short title's words begin, in order, words of the full one (or the reverse), joining words
    left out; a matched word is used up."""
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"\.", " ")), r"\s+"), lambda w: w != "")
    small, large = words(short), F.filter(words(full), lambda w: ~w.isin("and", "of", "the", "in", "for", "on"))

    def step(state: Column, w: Column) -> Column:
        rest = state["rest"]
        hits = F.filter(F.transform(rest, lambda x, i: F.when(x.startswith(w) | w.startswith(x), i)), lambda i: i.isNotNull())
        at = F.get(hits, F.lit(0))
        left = F.when(at.isNull(), rest).otherwise(F.filter(rest, lambda x, i: i != at))
        return F.struct(left.alias("rest"), (state["n"] + at.isNotNull().cast("int")).alias("n"))

    end = F.aggregate(small, F.struct(large.alias("rest"), F.lit(0).alias("n")), step)
    return F.coalesce((F.size(small) > 0) & (end["n"] >= 0.8 * F.size(small)), F.lit(False))


def same_journal(stored: Column, short: Column, full: Column) -> Column:
    """Either missing; equal; alike to 75; one inside the other; or an abbreviation."""
    s, v, f = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (stored, short, full))
    inside = ((v != "") & (F.contains(v, s) | F.contains(s, v))) | ((f != "") & F.contains(f, s))
    alike = (s == v) | (s == f) | (indel(s, v) >= 75) | (indel(s, f) >= 75) | inside | abbreviates(s, v) | abbreviates(s, f) | abbreviates(v, s)
    return F.when((s == "") | ((v == "") & (f == "")), True).otherwise(alike)


def verify(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """answers by lower-cased DOI: doi, resolves, found_title, found_authors, found_journal, found_journal_full,
    found_volume, found_issue, source, is_retracted, was_updated. A row that no answer fits keeps its tri-states null."""
    a = answers.withColumn("_doi", F.lower("doi")).drop("doi").dropDuplicates(["_doi"])
    told = refs.join(a, F.lower("doi") == F.col("_doi"), "left")
    title = indel(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("found_title", F.lit(""))))
    told = compare_authors(told.withColumn("_title", title), "authors", "found_authors")
    known = F.col("_doi").isNotNull()
    issues = F.filter(
        F.array(
            F.when(~F.col("authors_ok"), F.lit("authors")),
            F.when(~same_journal(F.col("journal"), F.col("found_journal"), F.col("found_journal_full")), F.lit("journal")),
            F.when((filled(F.col("volume")) != filled(F.col("found_volume"))), F.lit("volume")),
            F.when((filled(F.col("issue")) != filled(F.col("found_issue"))), F.lit("issue")),
        ),
        lambda x: x.isNotNull(),
    )
    titled = (F.length("title") > 0) & (F.length("found_title") > 0)
    return told.withColumns(
        {
            "doi_resolves": F.when(known, F.col("resolves")).otherwise(F.col("doi_resolves")),
            "crossref_title_similarity": F.when(known & titled, F.col("_title")),
            "crossref_match": F.when(known, F.coalesce(titled & (F.col("_title") >= 80), F.lit(False))).otherwise(F.col("crossref_match")),
            "authors_verified": F.when(known & (F.size("found_authors") > 0), F.col("authors_ok")),
            "verified_via": F.coalesce("verified_via", F.when(known, F.col("source"))),
            "verification_issues": F.when(known, issues).otherwise(F.col("verification_issues")),
            "retracted": F.when(known, F.coalesce("is_retracted", F.lit(False))).otherwise(F.coalesce("retracted", F.lit(False))),
            "has_correction": F.when(known, F.coalesce("was_updated", F.lit(False))).otherwise(F.coalesce("has_correction", F.lit(False))),
        }
    ).drop(*[c for c in a.columns if c not in refs.columns], "_title", "author_score", "authors_ok")


def validate(refs: DataFrame) -> DataFrame:
    """Faults of the active rows that aren't discarded: id, fault."""
    active = refs.where(~F.col("is_duplicate") & (F.col("grade") != "discard"))
    faults = F.array(
        F.when(filled(F.col("title")).isNull(), F.lit("no_title")),
        F.when(filled(F.col("doi")).isNull() & filled(F.col("url")).isNull(), F.lit("no_doi_or_url")),
        F.when(F.col("doi_resolves").eqNullSafe(F.lit(False)), F.lit("doi_does_not_resolve")),
        F.when(F.col("access_status") == "broken", F.lit("broken_url")),
        F.when(F.col("grade") != grade(), F.lit("grade_differs")),
    )
    return active.select("id", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("fault"))


def rescue_by_title(refs: DataFrame, pubmed: DataFrame, crossref: DataFrame, least: float = 90) -> DataFrame:
    """Active rows without DOI and PubMed id get one by their title: pubmed and crossref are candidates (key: _seq, rank,
    title, year, value), the first that is alike to `least` with an adjacent year counts, PubMed's before the other. What
    is found nowhere gets an issue, once."""
    lost = refs.where(~F.col("is_duplicate") & filled(F.col("doi")).isNull() & filled(F.col("pmid")).isNull())
    wanted = lost.select(F.col("_seq").alias("key"), "title", F.nullif("year", F.lit(0)).alias("year"))
    one = best_title(wanted, pubmed, least).select(F.col("key").alias("_seq"), F.col("value").alias("_pmid"))
    two = best_title(wanted, crossref, least).select(F.col("key").alias("_seq"), F.col("value").alias("_doi"))
    out = refs.join(wanted.select(F.col("key").alias("_seq"), F.lit(True).alias("_lost")), "_seq", "left").join(one, "_seq", "left").join(two, "_seq", "left")
    by_pmid = F.col("_pmid").isNotNull()
    by_doi = ~by_pmid & F.col("_doi").isNotNull()
    nowhere = F.coalesce("_lost", F.lit(False)) & ~by_pmid & ~by_doi
    issues = F.coalesce("verification_issues", F.array().cast("array<string>"))
    return out.withColumns(
        {
            "pmid": F.when(by_pmid, F.col("_pmid")).otherwise(F.col("pmid")),
            "doi": F.when(by_doi, F.col("_doi")).otherwise(F.col("doi")),
            "verified_via": F.when(by_pmid, "title-pubmed").when(by_doi, "title-crossref").otherwise(F.col("verified_via")),
            "verification_issues": F.when(nowhere, F.array_union(issues, F.array(F.lit(NOWHERE)))).otherwise(issues),
        }
    ).select(*refs.columns)


def integrity(refs: DataFrame, answers: DataFrame) -> DataFrame:
    """retracted and has_correction of active rows that are still open. answers: doi, resolves, is_retracted, was_updated;
    what doesn't resolve, has no answer or no DOI is neither."""
    a = answers.withColumn("_doi", F.lower("doi")).groupBy("_doi").agg(F.max(F.struct("resolves", "is_retracted", "was_updated")).alias("_a"))
    out = refs.join(a, F.lower("doi") == F.col("_doi"), "left")
    asked = ~F.col("is_duplicate") & filled(F.col("doi")).isNotNull() & F.col("retracted").isNull()
    bare = ~F.col("is_duplicate") & filled(F.col("doi")).isNull()
    told = lambda c: F.coalesce(F.col("_a.resolves"), F.lit(False)) & F.coalesce(F.col(f"_a.{c}"), F.lit(False))
    return out.withColumns(
        {
            "retracted": F.when(asked, told("is_retracted")).when(bare, F.coalesce("retracted", F.lit(False))).otherwise(F.col("retracted")),
            "has_correction": F.when(asked, told("was_updated")).when(bare, F.coalesce("has_correction", F.lit(False))).otherwise(F.col("has_correction")),
        }
    ).select(*refs.columns)


def verification_stats(refs: DataFrame) -> DataFrame:
    """One row of counters over the active rows that have an identifier."""
    has = lambda issue: F.coalesce(F.exists("verification_issues", lambda x: x == issue), F.lit(False))
    known = refs.where(~F.col("is_duplicate") & (filled(F.col("doi")).isNotNull() | filled(F.col("pmid")).isNotNull()))
    return known.agg(
        F.count_if(F.col("verified_via").isNotNull()).alias("verified"),
        F.count_if("doi_resolves").alias("resolved"),
        F.count_if("crossref_match").alias("titles_matched"),
        F.count_if("authors_verified").alias("authors_matched"),
        F.count_if(~F.col("authors_verified")).alias("authors_mismatched"),
        F.count_if(has("journal")).alias("journal_mismatched"),
        F.count_if(F.col("verified_via") == "pubmed").alias("pubmed_found"),
    )
