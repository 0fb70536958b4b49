"""Delimited and JSON sources, and response tables of external services."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import best_title
from ..functions.text import abstract_of, filled, norm_issn, stripped
from ..operators.dedup import cut
from ..operators.keyed import QUARTILES, STRATA, fold_strata
from ..schema import conformed


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, separated by whichever of `;` and `,` its first line has more of. All strings."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    sep = ";" if line.count(";") > line.count(",") else ","
    return spark.read.csv(path, header=True, sep=sep, encoding="UTF-8", multiLine=False)


def column_like(df: DataFrame, *parts: str) -> Column:
    """The first column whose lower-cased name holds one of the parts, in the parts' order."""
    for part in parts:
        for name in df.columns:
            if part in name.lower().replace("﻿", ""):
                return F.col(f"`{name}`")
    raise ValueError(f"no column like {parts}")


def decimal(c: Column) -> Column:
    """A number with a decimal comma; null for what is none."""
    return F.replace(F.replace(stripped(c), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def strata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Ranking sheet folded to one row an ISSN, and counts of its invalid rows."""
    raw = delimited(spark, path)
    rows = raw.select(
        norm_issn(column_like(raw, "issn")).alias("issn"),
        stripped(column_like(raw, "tulo", "titulo", "title")).alias("titulo"),
        stripped(column_like(raw, "rea")).alias("area"),
        F.upper(stripped(column_like(raw, "estrato", "stratum"))).alias("estrato"),
        F.monotonically_increasing_id().alias("_line"),  # order within one file, as read
    )
    ok = F.col("issn").isNotNull() & F.coalesce(F.col("estrato").isin(*STRATA), F.lit(False))
    bad = rows.agg(F.count_if(~ok).alias("invalid"), F.count_if(ok).alias("valid"))
    return fold_strata(rows.where(ok), "issn", "titulo", "area", "estrato", "_line"), bad


def scimago(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """issn, ano, titulo, sjr, quartil, h_index: a row for each ISSN of a cell."""
    raw = delimited(spark, path)
    years = [c for c in raw.columns if c.strip().lower() in ("year", "ano")]
    if not years and year is None:
        raise ValueError("the file has no year, and none is given")
    ano = F.col(f"`{years[0]}`").try_cast("int") if years else F.lit(year)
    rows = raw.select(
        F.explode(F.split(column_like(raw, "issn"), ",")).alias("cell"),
        F.coalesce(ano, F.lit(year).cast("int")).alias("ano"),
        column_like(raw, "title", "tulo").alias("titulo"),
        decimal(F.col("`SJR`")).alias("sjr"),
        filled(column_like(raw, "quartile", "quartil")).alias("quartil"),
        column_like(raw, "h index", "h_index").try_cast("int").alias("h_index"),
    )
    return rows.withColumn("issn", norm_issn(stripped(F.col("cell")))).where("issn is not null").drop("cell")


def categories(spark: SparkSession, path: str) -> DataFrame:
    raw = delimited(spark, path)
    rows = raw.select(
        norm_issn(column_like(raw, "issn")).alias("issn"),
        stripped(column_like(raw, "categor")).alias("categoria"),
        F.upper(stripped(column_like(raw, "quartil"))).alias("quartil"),
        F.coalesce(F.col("ano").try_cast("int"), F.lit(0)).alias("ano") if "ano" in raw.columns else F.lit(0).alias("ano"),
    )
    return rows.where(F.col("issn").isNotNull() & (F.length("categoria") > 0) & F.col("quartil").isin(*QUARTILES))


def collection(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("titulo string, issn string, issns array<string>").json(path, multiLine=True)
    keys = F.when(F.size("issns") > 0, F.col("issns")).otherwise(F.array("issn"))
    return rows.select(F.explode(keys).alias("raw"), "titulo").select(norm_issn(F.col("raw")).alias("issn"), "titulo").where("issn is not null")


def records_json(spark: SparkSession, path: str) -> DataFrame:
    """references[] of a stage file, in order; whatever columns it lacks get their defaults."""
    raw = spark.read.json(path, multiLine=True).select(F.posexplode("references").alias("_seq", "r")).select(F.col("_seq").cast("long"), "r.*")
    return conformed(raw)


#: Records that one source may give: their places in the union follow each other source by source.
MOST_OF_A_SOURCE = 1 << 40


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL in the order of the configuration: `_seq` runs through the first source, then the second, and so on.
    Places leave gaps between sources, so nothing is counted or sorted."""
    dealt = [f.withColumn("_seq", F.col("_seq") + F.lit(i * MOST_OF_A_SOURCE)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dealt)


def numbered(rows: DataFrame, segment: int = 16) -> DataFrame:
    """rows with `place`, 1 and on by `_seq` (0 or more). A segment is 2**segment values of `_seq`: rows are numbered
    within theirs, after as many as the segments before hold. These are summed up within groups of 2**16 segments and then
    over the groups, of which a source has 256 at most (2**segment times 2**16 into MOST_OF_A_SOURCE), so no task sorts
    all rows."""
    one, two = F.shiftright("_seq", segment), F.shiftright("_seq", segment + 16)
    told = rows.withColumns({"_one": one, "_two": two})
    counts = told.groupBy("_two", "_one").agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy("_two").agg(F.sum("_n").alias("_n"))

    def before(within: list[str], by: str) -> Column:
        return F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    since = counts.select("_two", "_one", before(["_two"], "_one").alias("_here")).join(groups.select("_two", before([], "_two").alias("_there")), "_two")
    place = F.row_number().over(W.partitionBy("_two", "_one").orderBy("_seq")) + F.col("_here") + F.col("_there")
    return told.join(since, ["_two", "_one"]).withColumn("place", place).select(*rows.columns, "place")


def search(spark: SparkSession, sources: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """The union of the sources in order, and a log (position, source, records, error). A source that fails gives no rows
    and an entry in the log; each is written down before the next is asked, so an error is its own."""
    frames, log = [], []
    for i, (name, read) in enumerate(sources):
        try:
            found = cut(conformed(read()))
            log.append((i, name, found.count(), None))
            frames.append(found)
        except Exception as e:  # noqa: BLE001  whatever a connector raises is what the log is for
            log.append((i, name, 0, f"{type(e).__name__}: {e}".splitlines()[0][:500]))
            frames.append(conformed(spark.range(0).select(F.col("id").alias("_seq"))))
    empty = conformed(spark.range(0).select(F.col("id").alias("_seq")))
    return union_sources(frames or [empty]), spark.createDataFrame(log, "position int, source string, records long, error string")


def better_of(primary: DataFrame, fallback: DataFrame, least: int = 10) -> DataFrame:
    """What a search gives: the wider fallback only where the query has fewer than `least` hits and the fallback more."""
    n = primary.limit(least).count()
    return fallback if n < least and fallback.limit(n + 1).count() > n else primary


def seed_records(seeds: DataFrame, answers: DataFrame) -> DataFrame:
    """seeds: at, doi; answers: doi, title, authors, year, journal, pub_type, is_retracted, was_updated of the DOIs that
    resolve. A record for each of them."""
    a = answers.withColumn("_doi", F.lower("doi")).drop("doi").dropDuplicates(["_doi"])
    met = seeds.where("doi is not null").select("at", "doi").join(a, F.lower("doi") == F.col("_doi"))
    return conformed(met.select(
        F.col("at").cast("long").alias("_seq"), F.concat(F.lit("seed_"), F.replace("doi", F.lit("/"), F.lit("_"))).alias("id"), "title", "authors", "year", "doi", "journal", "pub_type",
        F.lit("crossref").alias("source_api"), F.lit(True).alias("doi_resolves"), F.lit(True).alias("crossref_match"), F.col("is_retracted").alias("retracted"), F.col("was_updated").alias("has_correction"),
    ))


def seed_texts(seeds: DataFrame, found: DataFrame, least: float = 70, candidates: int = 3) -> DataFrame:
    """seeds: at, title; found: key (at), rank, title, year, value (DOI) of a text search. Records of the first of the
    `candidates` that is alike to `least`; a text without one is kept, to be verified."""
    wanted = seeds.where("doi is null").select(F.col("at").alias("key"), "title", F.lit(None).cast("int").alias("year"))
    best = best_title(wanted, found.where(F.col("rank") < candidates), least).select("key", F.col("value").alias("doi"))
    told = wanted.join(best, "key", "left")
    name = F.coalesce(F.replace("doi", F.lit("/"), F.lit("_")), F.substring(F.sha2("title", 256), 1, 8))
    return conformed(told.select(
        F.col("key").cast("long").alias("_seq"), F.concat(F.lit("seed_"), name).alias("id"), "title", "doi", F.when(F.col("doi").isNull(), "needs_verification").alias("relevance_method"),
        F.lit("crossref").alias("source_api"), F.col("doi").isNotNull().alias("doi_resolves"),
    ))


def claims_json(spark: SparkSession, path: str) -> DataFrame:
    """claims[] of a claims report, in order; the text is read from claim_text, or from text where that is what there is."""
    point = "struct<raw_text:string,value:double,unit:string,is_percentage:boolean>"
    claim = f"struct<claim_text:string,text:string,claim_type:string,ref_numbers:array<int>,data_points:array<{point}>,has_calculation:boolean,status:string,fabrication_risk:string>"
    raw = spark.read.schema(f"claims array<{claim}>").json(path, multiLine=True)
    one = raw.select(F.posexplode("claims").alias("claim", "c"))
    return one.select(
        "claim", F.coalesce(filled(F.col("c.claim_text")), F.col("c.text")).alias("claim_text"), "c.claim_type", "c.ref_numbers", "c.data_points", "c.has_calculation", "c.status",
        F.col("c.fabrication_risk").alias("risk"),
    )


def claim_values(claims: DataFrame) -> DataFrame:
    """claim, ref_number, at, value: what facts.cross_check takes."""
    each = claims.select("claim", F.posexplode("ref_numbers").alias("at", "ref_number"), "data_points")
    return each.select("claim", "ref_number", "at", F.explode("data_points").alias("p")).select("claim", "ref_number", "at", "p.value")


def lilacs_documents(answers: DataFrame) -> DataFrame:
    """answers: _seq, body (JSON) in either of the service's two envelopes. _seq, doc (field -> values) for `lilacs`;
    a field with one value is a list of one."""
    plain = "array<map<string,string>>"
    inner = F.from_json("body", f"struct<response:struct<docs:{plain}>>")["response"]["docs"]
    outer = F.get(F.from_json("body", f"struct<diaServerResponse:array<struct<response:struct<docs:{plain}>>>>")["diaServerResponse"], F.lit(0))["response"]["docs"]
    one = answers.select("_seq", F.posexplode(F.coalesce(outer, inner)).alias("at", "d"))
    values = lambda k, v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    return one.select((F.col("_seq") * 1000 + F.col("at")).alias("_seq"), F.transform_values("d", values).alias("doc"))


# Response tables: one row a response, as stored by a connector; each function gives records.


def openalex(responses: DataFrame) -> DataFrame:
    """responses: _seq, work struct(id, doi, title, publication_year, ids.pmid, abstract_inverted_index, ...)."""
    w = F.col("work")
    return conformed(
        responses.select(
            "_seq",
            F.concat(F.lit("openalex_"), F.regexp_extract(w["id"], r"([^/]+)$", 1)).alias("id"),
            w["title"].alias("title"),
            F.transform(w["authorships"], lambda a: a["author"]["display_name"]).alias("authors"),
            w["publication_year"].cast("int").alias("year"),
            F.regexp_replace(w["doi"], r"^https?://doi\.org/", "").alias("doi"),
            F.regexp_extract(w["ids"]["pmid"], r"(\d+)/?$", 1).alias("pmid"),
            F.coalesce(w["primary_location"]["landing_page_url"], w["id"]).alias("url"),
            w["primary_location"]["source"]["display_name"].alias("journal"),
            abstract_of(w["abstract_inverted_index"]).alias("abstract"),
            w["type"].alias("pub_type"),
            w["cited_by_count"].cast("long").alias("citation_count"),
            w["open_access"]["is_oa"].alias("is_open_access"),
            F.lit("openalex").alias("source_api"),
        )
    )


def europe_pmc(responses: DataFrame) -> DataFrame:
    """responses: _seq, hit struct(id, title, authorString, pubYear, doi, pmid, pmcid, abstractText, ...)."""
    h = F.col("hit")
    url = (
        F.when(F.length(h["pmcid"]) > 0, F.concat(F.lit("https://europepmc.org/article/PMC/"), h["pmcid"]))
        .when(F.length(h["pmid"]) > 0, F.concat(F.lit("https://europepmc.org/article/MED/"), h["pmid"]))
        .when(F.length(h["doi"]) > 0, F.concat(F.lit("https://doi.org/"), h["doi"]))
    )
    authors = F.slice(F.transform(F.split(F.rtrim(h["authorString"], F.lit(".")), ","), lambda a: F.trim(a)), 1, 10)
    return conformed(
        responses.select(
            "_seq", F.concat(F.lit("epmc_"), h["id"]).alias("id"), h["title"].alias("title"), authors.alias("authors"), h["pubYear"].try_cast("int").alias("year"), h["doi"].alias("doi"),
            h["pmid"].alias("pmid"), url.alias("url"), h["journalTitle"].alias("journal"), h["abstractText"].alias("abstract"), (h["isOpenAccess"] == "Y").alias("is_open_access"), F.lit("europe_pmc").alias("source_api"),
        )
    )


def crossref(responses: DataFrame) -> DataFrame:
    """responses: message struct(DOI, title[], author[], container-title[], volume, issue, update-to[], assertion[]).
    Answers for refsift.operators.records.verify."""
    m = F.col("message")
    initials = lambda g: F.array_join(F.transform(F.filter(F.split(g, r"[\s.-]+"), lambda x: x != ""), lambda x: F.upper(F.substring(x, 1, 1))), "")
    authors = F.transform(F.filter(m["author"], lambda a: F.length(a["family"]) > 0), lambda a: F.trim(F.concat_ws(" ", a["family"], initials(a["given"]))))
    updates = F.coalesce(m["update-to"], F.array().cast("array<struct<type:string>>"))
    notes = F.coalesce(m["assertion"], F.array().cast("array<struct<name:string>>"))
    retracted = F.exists(updates, lambda u: u["type"] == "retraction") | F.exists(notes, lambda a: F.contains(F.lower(a["name"]), F.lit("retract")))
    corrected = F.exists(updates, lambda u: u["type"].isin("correction", "erratum", "addendum"))
    return responses.select(
        m["DOI"].alias("doi"),
        F.lit(True).alias("resolves"),
        F.get(m["title"], F.lit(0)).alias("found_title"),
        authors.alias("found_authors"),
        F.get(m["container-title"], F.lit(0)).alias("found_journal"),
        F.get(m["container-title"], F.lit(0)).alias("found_journal_full"),
        m["volume"].alias("found_volume"),
        m["issue"].alias("found_issue"),
        F.lit("crossref").alias("source"),
        F.coalesce(retracted, F.lit(False)).alias("is_retracted"),
        F.coalesce(corrected, F.lit(False)).alias("was_updated"),
    )


def pubmed(responses: DataFrame) -> DataFrame:
    """responses: _seq, article struct(pmid, title, abstract array<string>, authors array<struct<last,initials>>, journal,
    volume, issue, pages, year, medline_date, elocation_doi, article_ids array<struct<type,value>>, pub_types)."""
    a = F.col("article")
    year = F.coalesce(a["year"].try_cast("int"), F.regexp_extract(F.coalesce(a["medline_date"], F.lit("")), r"(\d{4})", 1).try_cast("int"))
    listed = F.get(F.transform(F.filter(a["article_ids"], lambda x: x["type"] == "doi"), lambda x: x["value"]), F.lit(0))
    return conformed(
        responses.select(
            "_seq", F.concat(F.lit("pubmed_"), a["pmid"]).alias("id"), a["pmid"].alias("pmid"), a["title"].alias("title"), F.array_join(a["abstract"], " ").alias("abstract"),
            F.transform(F.filter(a["authors"], lambda x: F.length(x["last"]) > 0), lambda x: F.concat_ws(" ", x["last"], x["initials"])).alias("authors"),
            a["journal"].alias("journal"), a["volume"].alias("volume"), a["issue"].alias("issue"), a["pages"].alias("pages"), year.alias("year"),
            F.coalesce(filled(a["elocation_doi"]), listed).alias("doi"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), a["pmid"], F.lit("/")).alias("url"),
            F.get(a["pub_types"], F.lit(0)).alias("pub_type"), F.lit("pubmed").alias("source_api"),
        )
    )


def semantic_scholar(responses: DataFrame) -> DataFrame:
    """responses: _seq, paper struct(paperId, title, abstract, year, authors array<struct<name>>, venue, externalIds
    struct<DOI,PubMed>, url, publicationTypes, isOpenAccess, openAccessPdf struct<url>). Counts of citations are left out."""
    p = F.col("paper")
    return conformed(
        responses.select(
            "_seq", F.concat(F.lit("s2_"), F.substring(p["paperId"], 1, 12)).alias("id"), p["title"].alias("title"), p["abstract"].alias("abstract"), p["year"].cast("int").alias("year"),
            F.transform(p["authors"], lambda x: x["name"]).alias("authors"), p["venue"].alias("journal"), p["externalIds"]["DOI"].alias("doi"), p["externalIds"]["PubMed"].alias("pmid"),
            p["url"].alias("url"), F.get(p["publicationTypes"], F.lit(0)).alias("pub_type"), p["isOpenAccess"].alias("is_open_access"), p["openAccessPdf"]["url"].alias("oa_url"), F.lit("semantic_scholar").alias("source_api"),
        )
    )


def lilacs(responses: DataFrame) -> DataFrame:
    """responses: _seq, doc map<string, array<string>>; of a field's values the first counts. Without an id the row's
    content gives one."""
    d = F.col("doc")
    first = lambda *names: F.coalesce(*[filled(F.get(d[n], F.lit(0))) for n in names])
    title = first("ti", "title", "ti_pt", "ti_es", "ti_en")
    key = F.coalesce(first("id"), F.conv(F.abs(F.xxhash64(title, first("da", "dp"))).cast("string"), 10, 16))
    return conformed(
        responses.select(
            "_seq", F.concat(F.lit("bvs_"), key).alias("id"), title.alias("title"), F.coalesce(d["au"], F.array().cast("array<string>")).alias("authors"),
            F.regexp_extract(F.coalesce(first("da", "dp"), F.lit("")), r"(\d{4})", 1).try_cast("int").alias("year"), first("doi").alias("doi"), first("ta", "fo").alias("journal"),
            first("ab", "ab_pt", "ab_es", "ab_en").alias("abstract"), first("ur").alias("url"), first("type", "pt").alias("pub_type"), F.lit("bvs_lilacs").alias("source_api"),
        )
    )


def open_access(responses: DataFrame) -> DataFrame:
    """responses: doi, is_oa, best struct(url_for_pdf, url). Licences for refsift.operators.records.add_access."""
    return responses.select("doi", "is_oa", F.coalesce(filled(F.col("best.url_for_pdf")), F.col("best.url")).alias("oa_link"))
