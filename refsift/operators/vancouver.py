"""Numbered references of a text against authoritative metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import indel
from ..functions.text import filled
from ..sources.text import author_list
from .records import _author, abbreviates

STATUSES = ("ok", "mismatch", "skipped", "no_doi", "pmid_only", "error")


def identified(entries: DataFrame, dois: DataFrame, pmids: DataFrame) -> DataFrame:
    """entries with a DOI where the title gave one (dois: number, found_doi), and pmid (pmids: number, found_pmid)."""
    d = dois.groupBy("number").agg(F.min("found_doi").alias("_doi"))
    p = pmids.groupBy("number").agg(F.min("found_pmid").alias("pmid"))
    out = entries.join(d, "number", "left").join(p, "number", "left")
    return out.withColumn("doi", F.coalesce(filled(F.col("doi")), F.col("_doi"))).drop("_doi")


def verify(entries: DataFrame, answers: DataFrame) -> DataFrame:
    """entries: rows of numbered_references with pmid; answers: doi, found_authors, found_journal, found_journal_full,
    found_volume, found_issue, source, at most one a DOI. entries with status, issues and source. Only journals are
    verified; without a DOI a PubMed id alone is no check; the number of authors is not compared, and a journal without
    an abbreviation in the answer isn't either."""
    a = answers.where(F.size("found_authors") > 0).withColumn("_doi", F.lower("doi")).drop("doi").dropDuplicates(["_doi"])
    told = entries.withColumn("_own", author_list(F.coalesce("authors_str", F.lit("")))).join(a, F.lower("doi") == F.col("_doi"), "left")
    scores = []
    for i in range(6):
        one, two = F.get("_own", F.lit(i)), F.get("found_authors", F.lit(i))
        told = told.withColumn(f"_s{i}", F.when(one.isNotNull() & two.isNotNull(), indel(_author(F.coalesce(one, F.lit(""))), _author(F.coalesce(two, F.lit(""))))))
        scores.append(F.when(F.col(f"_s{i}") < (85 if i == 0 else 80), F.lit(f"author {i + 1}")))
    norm = lambda c: _author(F.coalesce(F.col(c), F.lit("")))
    s, short, full = norm("journal"), norm("found_journal"), norm("found_journal_full")
    told = told.withColumn("_j", F.greatest(indel(s, short), F.when(full != "", indel(s, full)).otherwise(0.0)))
    named = (F.length("journal") > 0) & (F.length("found_journal") > 0)
    other = (F.col("_j") < 75) & ~F.contains(short, s) & ~F.contains(s, short) & ~abbreviates(s, full) & ~abbreviates(s, short)
    differs = lambda c: filled(F.col(c)) != filled(F.col(f"found_{c}"))
    issues = F.filter(F.array(*scores, F.when(named & other, F.lit("journal")), F.when(differs("volume"), F.lit("volume")), F.when(differs("issue"), F.lit("issue"))), lambda x: x.isNotNull())
    told = told.withColumn("_issues", F.when(F.col("_doi").isNotNull(), issues).otherwise(F.array().cast("array<string>")))
    missing = filled(F.col("doi")).isNull()
    status = (
        F.when(F.col("ref_type") != "journal", "skipped")
        .when(missing & filled(F.col("pmid")).isNotNull(), "pmid_only")
        .when(missing, "no_doi")
        .when(F.col("_doi").isNull(), "error")
        .when(F.size("_issues") > 0, "mismatch")
        .otherwise("ok")
    )
    return told.select(*entries.columns, status.alias("status"), F.col("_issues").alias("issues"), "source")


def tally(verified: DataFrame) -> DataFrame:
    """One row: a count for each status."""
    return verified.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def failed(verified: DataFrame) -> bool:
    """Whether any reference differs from its source: the command's exit code."""
    return verified.where("status = 'mismatch'").limit(1).count() > 0


def title_wanted(entries: DataFrame) -> DataFrame:
    """key, title, year of the journal references without a DOI, to be looked up by title."""
    return entries.where((F.col("ref_type") == "journal") & filled(F.col("doi")).isNull() & (F.length("title") > 0)).select(
        F.col("number").alias("key"), "title", F.col("year").try_cast("int").alias("year")
    )
