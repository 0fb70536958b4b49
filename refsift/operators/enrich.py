"""Enrichment of venues from response tables: a field family is filled only where it is stale, each field with its source
and date; nulls never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from .keyed import expired, upsert

# Days after which a family is stale.
TTL = {"identity": 90, "apc": 180, "doaj": 90, "medline": 180, "snapshot": 180}


def stale_rows(journals: DataFrame, checked: str, as_of: Column, days: int) -> DataFrame:
    return journals.where(expired(F.col(checked), as_of, days))


def _provenance(field: str, source: str, as_of: Column) -> list[Column]:
    has = F.col(field).isNotNull()
    return [F.when(has, F.lit(source)).alias(f"{field}_fonte"), F.when(has, as_of).alias(f"{field}_verificado_em")]


def identity(works: DataFrame, as_of: Column) -> DataFrame:
    """works: issn_l, source struct(display_name, publisher, is_oa, apc_usd, citedness, topics)."""
    s = F.col("source")
    base = works.select("issn_l", s["display_name"].alias("titulo"), s["is_oa"].cast("int").alias("is_oa"), s["apc_usd"].cast("double").alias("apc_usd"), s["citedness"].alias("citedness_2yr"), F.slice(s["topics"], 1, 15).alias("topicos"))
    return base.select("*", *_provenance("is_oa", "openalex", as_of), *_provenance("apc_usd", "openalex", as_of))


def open_journals(answers: DataFrame, as_of: Column) -> DataFrame:
    """answers: issn_l, listed boolean, prices array<struct<currency,price>>. Not listed is a fact (0), not a failure;
    listed without a price is free of charge."""
    usd = F.get(F.filter("prices", lambda p: p["currency"] == "USD"), F.lit(0))
    one = F.coalesce(usd, F.get("prices", F.lit(0)))
    value = F.when(F.col("listed"), F.coalesce(one["price"], F.lit(0.0)))
    base = answers.select(
        "issn_l", F.col("listed").cast("int").alias("in_doaj"), value.cast("double").alias("apc_valor"), F.when(F.col("listed"), one["currency"]).alias("apc_moeda"),
        F.when(F.col("listed") & (one["currency"] == "USD"), one["price"]).cast("double").alias("apc_usd"),
    )
    return base.select("*", *_provenance("in_doaj", "doaj", as_of), *_provenance("apc_valor", "doaj", as_of))


def enrich(journals: DataFrame, families: list[tuple[DataFrame, str, int]], as_of: Column) -> DataFrame:
    """families: (answers, date column, days). Answers for venues that aren't stale in that family are left out; where two
    families give a field, the first keeps it."""
    out = journals
    for answers, checked, days in families:
        due = stale_rows(out, checked, as_of, days).select("issn_l") if checked in out.columns else out.select("issn_l")
        out = upsert(out, answers.join(due, "issn_l", "left_semi"), "issn_l")
    return out


#: A page with fewer signs than this is no snapshot.
LEAST_SNAPSHOT = 200


def candidate_urls(journals: DataFrame) -> DataFrame:
    """issn_l, at, url: the pages of a venue to be kept: its homepage, and a publisher's page of metrics where known."""
    insights = F.concat(F.lit("https://journalinsights.elsevier.com/journals/"), F.col("issn_l"))
    metrics = F.when(F.contains(F.lower(F.coalesce("editora", F.lit(""))), F.lit("elsevier")), insights)
    urls = F.filter(F.array(filled(F.col("homepage_url")), metrics), lambda u: u.isNotNull())
    return journals.select("issn_l", F.posexplode(urls).alias("at", "url"))


def due_snapshots(urls: DataFrame, snapshots: DataFrame, as_of: Column) -> DataFrame:
    """urls without a snapshot (issn_l, url, text, captured) that is fresh and still has its text."""
    fresh = snapshots.where(~expired(F.col("captured"), as_of, TTL["snapshot"]) & F.col("text").isNotNull())
    return urls.join(fresh.select("issn_l", "url").distinct(), ["issn_l", "url"], "left_anti")


def captured(pages: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """pages: issn_l, url, text. Snapshots, and the pages that are too short to be one."""
    long_enough = F.coalesce(F.length("text") >= LEAST_SNAPSHOT, F.lit(False))
    return pages.where(long_enough).withColumn("captured", as_of), pages.where(~long_enough).select("issn_l", "url")


def from_crossref(answers: DataFrame, as_of: Column) -> DataFrame:
    """answers: issn_l, message struct(title, publisher). Identity where the first source has none."""
    m = F.col("message")
    return answers.select("issn_l", m["title"].alias("titulo"), m["publisher"].alias("editora"), *[c for c in _provenance_of(m["title"], "titulo", "crossref", as_of)])


def _provenance_of(value: Column, field: str, source: str, as_of: Column) -> list[Column]:
    return [F.when(value.isNotNull(), F.lit(source)).alias(f"{field}_fonte"), F.when(value.isNotNull(), as_of).alias(f"{field}_verificado_em")]
