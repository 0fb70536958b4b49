"""Further record operators as queries over the provided tables, each with SQL; see `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import claims, dedup, enrich, facts, journals, records, reports, screening, venues, written
from .queries import _GRADED, _REFS, _SCREENED, SCOPE, _flow_refs, _whole, query, refs, table
from .sources import documents, sinks, tables
from .sources import text as text_sources
from .streaming import pending


@query(
    f"""WITH {_REFS} SELECT id, CASE WHEN doc_id_pmid THEN 'T1' WHEN pub_type = 'journal-article' THEN 'T1' WHEN pub_type = 'report' THEN 'T3' WHEN coalesce(doi_resolves, false) THEN 'T1' ELSE 'UNKNOWN' END AS tier,
    CASE WHEN doc_id_pmid THEN 'pubmed' END AS domain FROM (SELECT *, seq % 23 = 0 AS doc_id_pmid FROM r)"""
)
def type_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without a known domain: tier by PubMed id, publication type, then DOI."""
    r = refs(spark, sf_dir).withColumns({"url": F.lit(None).cast("string"), "pmid": F.when(F.col("_seq") % 23 == 0, F.col("id")), "tier": F.lit(None).cast("string")})
    return records.classify(r, spark.sql("SELECT 'example.com' AS domain, 'T1' AS tier")).select("id", "tier", "domain")


@query(
    """SELECT p_partkey, lower(trim(CASE p_partkey % 4 WHEN 0 THEN ' Review' WHEN 1 THEN 'journal-article' WHEN 2 THEN 'Meta-Analysis ' ELSE 'report' END)) IN ('review', 'meta-analysis')
    OR regexp_matches(CASE p_size % 5 WHEN 0 THEN 'A Systematic Review of ' || p_name WHEN 1 THEN 'Metaanálise' WHEN 2 THEN 'Umbrella  review' WHEN 3 THEN 'Revisão de escopo: ' || p_name ELSE p_name END, '(?i)systematic review|meta-?analysis|revis[aã]o de escopo|metan[aá]lise') AS review FROM part"""
)
def review_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    kind = F.when(k % 4 == 0, " Review").when(k % 4 == 1, "journal-article").when(k % 4 == 2, "Meta-Analysis ").otherwise("report")
    title = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("A Systematic Review of "), n)).when(F.col("p_size") % 5 == 1, "Metaanálise").when(F.col("p_size") % 5 == 2, "Umbrella  review")
    title = title.when(F.col("p_size") % 5 == 3, F.concat(F.lit("Revisão de escopo: "), n)).otherwise(n)
    return table(spark, sf_dir, "part").select("p_partkey", screening.review_like(kind, title).alias("review"))


@query(f"WITH {_GRADED} SELECT id FROM g WHERE grade IN ('gold', 'silver') AND NOT coalesce(oa, false) AND access_status IN ('restricted', 'no_url')")
def works_to_obtain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.to_obtain(refs(spark, sf_dir).withColumn("grade", records.grade())).select("id")


@query(
    """WITH p AS (SELECT user_id AS id, max(CASE event_id % 3 WHEN 0 THEN 'accessible' WHEN 1 THEN 'broken' ELSE 'timeout' END) AS probe FROM events GROUP BY 1),
    o AS (SELECT '10.1/' || (event_id % 700) AS doi, bool_or(event_id % 2 = 0) AS oa, min('u' || event_id % 5) AS link FROM events GROUP BY 1),
    r AS (SELECT c_custkey AS k, '10.1/' || (c_custkey % 900) AS doi, c_custkey % 6 = 0 AS own, c_custkey % 11 = 0 AS bare FROM customer)
    SELECT k AS id, CASE WHEN bare THEN 'no_url' WHEN coalesce(oa, false) OR own THEN 'open_access' WHEN probe = 'accessible' THEN 'accessible' WHEN probe = 'broken' THEN 'broken' ELSE 'restricted' END AS access_status,
    coalesce(oa, false) OR own AS is_open_access, link AS oa_url FROM r LEFT JOIN p ON p.id = k LEFT JOIN o ON o.doi = r.doi"""
)
def access_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as works, events as probes of their pages and as licences."""
    e, k = F.col("event_id"), F.col("c_custkey")
    events = table(spark, sf_dir, "events")
    probes = events.select(F.col("user_id").alias("id"), F.when(e % 3 == 0, "accessible").when(e % 3 == 1, "broken").otherwise("timeout").alias("probe"))
    licences = events.select(F.concat(F.lit("10.1/"), (e % 700).cast("string")).alias("doi"), (e % 2 == 0).alias("is_oa"), F.concat(F.lit("u"), (e % 5).cast("string")).alias("oa_link"))
    works = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(F.lit("10.1/"), (k % 900).cast("string")).alias("doi"), (k % 6 == 0).alias("is_open_access"), F.when(k % 11 == 0, "").otherwise("http://x").alias("url"), F.lit(None).cast("string").alias("oa_url")
    )
    return records.add_access(works, probes, licences).select("id", "access_status", "is_open_access", "oa_url")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 50 = 7 AND (l_returnflag = 'A' OR l_linestatus = 'O') AND l_quantity > 10")
def facts_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 50).alias("ref_number"), F.array("l_returnflag", "l_linestatus").alias("tags"), F.when(F.col("l_quantity") > 10, "quantitative").otherwise("conceptual").alias("fact_type")
    )
    return facts.find(rows, ref=7, tags=["A", "O"], kind="quantitative").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """WITH t AS (SELECT doc_id, '**Link:** x' || chr(10) || coalesce(text, '') || chr(10) || '--- end' || chr(10) || 'see https://a.b/c?d and 10.1000/xyz.' || doc_id || ' here' AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(regexp_replace(t, '(?m)^(\\*\\*(Link|Autores|Grade|Eixos|Acesso):.*|---.*)$\\n?', '', 'g'), 'https?://\\S+|10\\.\\d{4,}/\\S+', '', 'g')) AS digest FROM t"""
)
def searchable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts between lines of metadata, without these, links and DOIs."""
    t = F.concat(F.lit("**Link:** x\n"), F.col("text"), F.lit("\n--- end\nsee https://a.b/c?d and 10.1000/xyz."), F.col("doc_id").cast("string"), F.lit(" here"))
    return _whole(spark, sf_dir).select("doc_id", F.md5(facts.searchable(t)).alias("digest"))


@query(
    """WITH v AS (SELECT 'doc_' || (event_id % 400) AS id, arg_max(CASE event_id % 3 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' ELSE 'maybe' END, event_id) AS verdict FROM events GROUP BY 1)
    SELECT 'doc_' || doc_id AS id, verdict AS llm_verdict FROM documents LEFT JOIN v ON v.id = 'doc_' || doc_id"""
)
def verdicts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    verdict = F.when(e % 3 == 0, "include").when(e % 3 == 1, "exclude").otherwise("maybe")
    v = table(spark, sf_dir, "events").select(F.concat(F.lit("doc_"), (e % 400).cast("string")).alias("id"), verdict.alias("verdict"), F.lit("r").alias("reason"), F.array().cast("array<string>").alias("criteria"), e.alias("_line"))
    return screening.merge_verdicts(refs(spark, sf_dir), v).select("id", "llm_verdict")


@query(
    """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no such words §' ELSE replace(substr(coalesce(text, ''), 5, 40), ' ', '   ') END AS q, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, q, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS c FROM f)
    SELECT doc_id FROM n WHERE length(q) > 0 AND contains(t, c)"""
)
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes with wide spaces, of each document's whole text or of nowhere, against the text."""
    d = _whole(spark, sf_dir).select("doc_id", "text", F.col("doc_id").cast("string").alias("issn_l"), F.lit("u").alias("url"))
    fields = d.select("doc_id", "issn_l", "url", F.when(F.col("doc_id") % 3 == 0, "no such words §").otherwise(F.replace(F.substring("text", 5, 40), F.lit(" "), F.lit("   "))).alias("quote"))
    return facts.grounded(fields, d.select("issn_l", "url", "text")).select("doc_id")


@query(
    """WITH w AS (SELECT user_id AS issn, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1), h AS (SELECT * FROM w ORDER BY n DESC, first LIMIT 90),
    u AS (SELECT issn FROM h WHERE issn % 3 <> 0 ORDER BY n DESC, first LIMIT 30)
    SELECT CAST(issn AS VARCHAR) AS issn_l FROM (SELECT issn FROM u UNION SELECT issn FROM w WHERE issn % 3 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 1)"""
)
def venue_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as venues of the works found, every third one known, some suppliers curated."""
    works = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("issn_l"), F.col("event_id").alias("_seq"))
    known = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("issn_l")).distinct()
    curated = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 1").select(F.col("s_suppkey").cast("string").alias("issn_l"))
    return journals.candidates(works, known, curated)


@query("SELECT CAST(p_partkey AS VARCHAR) AS issn_l, round(p_retailprice) AS pre_score FROM part ORDER BY round(p_retailprice) DESC, CAST(p_partkey AS VARCHAR) LIMIT 12")
def venue_finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journals.finalists(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("issn_l"), F.round("p_retailprice").alias("pre_score")))


@query(
    f"""WITH {_GRADED}, t AS (SELECT id, seq, unnest(CASE WHEN seq % 3 = 0 THEN ['one', 'two'] WHEN seq % 3 = 1 THEN ['two'] ELSE ['three', 'other'] END) AS axis FROM g WHERE grade = 'gold'),
    x AS (SELECT * FROM (VALUES (0, 'one'), (1, 'two'), (2, 'three')) AS v(position, axis))
    SELECT CAST(row_number() OVER (ORDER BY position, seq % 5 DESC, seq) AS INT) AS number, axis, id FROM t JOIN x USING (axis)"""
)
def brief_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("_seq")
    axes = F.when(i % 3 == 0, F.array(F.lit("one"), F.lit("two"))).when(i % 3 == 1, F.array(F.lit("two"))).otherwise(F.array(F.lit("three"), F.lit("other")))
    r = refs(spark, sf_dir).withColumns({"grade": records.grade(), "relevance_score": (i % 5).cast("double")}).withColumns({"final": F.col("grade") == "gold", "mapped_axes": axes})
    return reports.brief(r, ["one", "two", "three"]).select(F.col("number").cast("int").alias("number"), "axis", "id")


@query(f"WITH {_GRADED} SELECT id, CASE WHEN coalesce(NOT authors_verified, false) THEN 'authors_diverge;' ELSE '' END || CASE WHEN coalesce(doi_resolves AND NOT crossref_match, false) THEN 'title_diverges;' ELSE '' END || CASE WHEN doi IS NULL THEN 'unverifiable;' ELSE '' END || CASE WHEN coalesce(NOT doi_resolves, false) THEN 'doi_does_not_resolve;' ELSE '' END AS pendencies FROM g WHERE grade <> 'discard' AND pending > 0")
def pendency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = written.pending(refs(spark, sf_dir).withColumn("grade", records.grade()))
    return told.select("id", F.concat(F.array_join("pendencies", ";"), F.lit(";")).alias("pendencies"))


@query("SELECT coalesce(nullif(source, ''), 'seed/manual') AS source_api, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def records_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written.by_source(refs(spark, sf_dir).withColumn("source_api", F.col("journal")))


@query(
    f"""WITH {_REFS} SELECT count(*) FILTER (WHERE seq % 5 = 0) AS verified, count(*) FILTER (WHERE doi_resolves) AS resolved, count(*) FILTER (WHERE crossref_match) AS titles_matched, count(*) FILTER (WHERE authors_verified) AS authors_matched,
    count(*) FILTER (WHERE NOT authors_verified) AS authors_mismatched, count(*) FILTER (WHERE seq % 8 = 1) AS journal_mismatched, count(*) FILTER (WHERE seq % 5 = 0) AS pubmed_found FROM r WHERE doi IS NOT NULL"""
)
def verification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("_seq")
    r = refs(spark, sf_dir).withColumns({"verified_via": F.when(i % 5 == 0, "pubmed"), "verification_issues": F.when(i % 8 == 1, F.array(F.lit("journal"))).otherwise(F.array().cast("array<string>"))})
    return records.verification_stats(r)


@query(
    """WITH f AS (SELECT CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'N' THEN 'derived' ELSE 'rejected' END AS status, l_linestatus AS fact_type, l_partkey % 20 AS ref_number FROM lineitem)
    SELECT 'status' AS kind, status AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'fact_type', fact_type, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'ref_number', CAST(ref_number AS VARCHAR), count(*) FROM f GROUP BY 2"""
)
def facts_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.when(flag == "A", "verified").when(flag == "N", "derived").otherwise("rejected").alias("status"), F.col("l_linestatus").alias("fact_type"), (F.col("l_partkey") % 20).alias("ref_number"))
    return facts.tallies(rows)


@query(
    """WITH s AS (SELECT c_custkey, c_custkey % 10 AS a, c_custkey % 10 + c_custkey % 4 AS b FROM customer),
    n AS (SELECT c_custkey, list_sort(list_distinct(list_concat(range(a, b + 1), [b + 3, 2]))) AS l FROM s) SELECT c_custkey, array_to_string(l, ',') AS numbers FROM n"""
)
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a, b = k % 10, k % 10 + k % 4
    said = F.concat_ws("", a.cast("string"), F.lit("-"), b.cast("string"), F.lit(", "), (b + 3).cast("string"), F.lit(",2,x,9-1"))
    found = numbers.ref_range(said)
    return table(spark, sf_dir, "customer").select(k, F.array_join(F.transform(found, lambda n: n.cast("string")), ",").alias("numbers"))


@query(
    """WITH j AS (SELECT s_suppkey AS key, [s_suppkey, s_suppkey + 1, 1000000 + s_suppkey] AS issns FROM supplier), w AS (SELECT DISTINCT p_partkey % 150 AS issn FROM part),
    h AS (SELECT issn, key, 0 AS r FROM w JOIN j ON key = issn UNION ALL SELECT issn, key, 1 FROM w JOIN (SELECT key, unnest(issns) AS i FROM j) ON i = issn)
    SELECT CAST(issn AS VARCHAR) AS issn, CAST(arg_min(key, r * 1000000000 + key) AS VARCHAR) AS issn_l FROM h GROUP BY 1"""
)
def venue_by_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as venues that also carry their successor's number, looked up by the parts' numbers."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(k.cast("string").alias("issn_l"), F.array(*[(k + d).cast("string") for d in (0, 1, 1000000)]).alias("issns"))
    wanted = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).cast("string").alias("issn"))
    return venues.by_issn(wanted, base).select("issn", "issn_l")


@query(
    f"""WITH {_REFS}, a AS (SELECT doc_id, doc_id % 3 <> 0 AS ok, doc_id % 4 = 1 AS gone, doc_id % 5 = 1 AS fixed FROM documents WHERE doc_id % 2 = 0)
    SELECT id, CASE WHEN seq % 7 = 0 THEN true WHEN doi IS NULL THEN false ELSE coalesce(ok AND gone, false) END AS retracted,
    CASE WHEN seq % 7 = 0 AND doi IS NOT NULL THEN NULL WHEN doi IS NULL THEN false ELSE coalesce(ok AND fixed, false) END AS has_correction FROM r LEFT JOIN a ON doc_id = seq AND doi IS NOT NULL"""
)
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record is known to be retracted; half of the others' DOIs have an answer."""
    i = F.col("doc_id")
    answers = table(spark, sf_dir, "documents").where(i % 2 == 0).select(F.concat(F.lit("10.1000/"), i.cast("string")).alias("doi"), (i % 3 != 0).alias("resolves"), (i % 4 == 1).alias("is_retracted"), (i % 5 == 1).alias("was_updated"))
    r = refs(spark, sf_dir).withColumn("retracted", F.when(F.col("_seq") % 7 == 0, F.lit(True)))
    return records.integrity(r, answers).select("id", "retracted", "has_correction")


@query("SELECT doc_id, md5(trim(coalesce(split_part(text, chr(10), 1), '') || '. ' || left(coalesce(text, ''), 1500), ' ')) AS digest FROM documents")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a record goes into an embedding: the title, and as much of the abstract as the model takes."""
    r = refs(spark, sf_dir)
    return r.select(F.col("_seq").alias("doc_id"), F.md5(text.record_text(F.col("title"), F.col("abstract"))).alias("digest"))


@query(
    """SELECT CAST(coalesce(regexp_matches(lower(text), 'exceeding|more than|over'), false) AS INT) + 2 * CAST(coalesce(regexp_matches(lower(text), 'approximately|about|cerca de'), false) AS INT) AS kind, count(*) AS n FROM documents GROUP BY 1"""
)
def number_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = facts.warnings(F.col("text"))
    kind = F.array_contains(w, "bound").cast("int") + 2 * F.array_contains(w, "approximate").cast("int")
    return _whole(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'ftp://x' ELSE 'http://x' END AS url, [200, 301, 403, 404, 405, 500][event_id % 6 + 1] AS code, CASE WHEN event_id % 4 = 0 THEN 200 ELSE 403 END AS again, CASE WHEN event_id % 17 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'refused' END AS error FROM events)
    SELECT CASE WHEN url NOT LIKE 'http%' THEN 'no_url' WHEN error = 'timeout' THEN 'timeout' WHEN error IS NOT NULL THEN 'broken' WHEN code = 200 THEN 'accessible' WHEN code IN (403, 405) THEN CASE WHEN again = 200 THEN 'accessible' ELSE 'restricted' END
    WHEN code = 404 THEN 'broken' WHEN code = 301 THEN 'accessible' ELSE 'restricted' END AS status, count(*) AS n FROM p GROUP BY 1"""
)
def probe_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 301, 403, 404, 405, 500)]), (e % 6 + 1).cast("int"))
    status = records.probe_status(code, F.when(e % 4 == 0, 200).otherwise(403), F.when(e % 17 == 0, "timeout").when(e % 19 == 0, "refused"), F.when(e % 13 == 0, "ftp://x").otherwise("http://x"))
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH l AS (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS r, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, r, CASE WHEN (doc_id + r) % 3 = 0 THEN t || r ELSE '' END AS content FROM l),
    b AS (SELECT doc_id, arg_min(content, r) AS content, min(r) AS r FROM c WHERE length(content) > 0 AND (doc_id % 10 <> 0) GROUP BY 1)
    SELECT d.doc_id AS number, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE md5(b.content) END AS digest, CASE WHEN d.doc_id % 7 = 0 OR b.content IS NULL THEN 'none' WHEN b.r >= 3 THEN 'abstract' ELSE 'full_text' END AS source_level FROM documents d LEFT JOIN b USING (doc_id)"""
)
def contents_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five levels of contents, some empty, of whole texts; every seventh work is a web page."""
    i = F.col("doc_id")
    levels = F.array(*[F.struct(F.lit(n).alias("r"), F.lit(name).alias("level")) for n, name in enumerate(documents.LEVELS)])
    found = _whole(spark, sf_dir).where("doc_id % 10 <> 0").select(i, "text", F.explode(levels).alias("l"))
    found = found.select(i.alias("number"), "l.level", F.when((i + F.col("l.r")) % 3 == 0, F.concat("text", F.col("l.r").cast("string"))).otherwise("").alias("content"))
    works = _whole(spark, sf_dir).select(i.alias("number"), F.when(i % 7 == 0, "web").otherwise("journal").alias("ref_type"))
    return documents.resolve(works, found).select("number", F.md5("content").alias("digest"), "source_level")


@query(
    """WITH f AS (SELECT s_suppkey AS file, list_distinct(['alpha' || s_suppkey % 7, 'beta' || s_suppkey % 5, 'gamma' || s_suppkey % 3]) AS w FROM supplier),
    k AS (SELECT p_partkey AS work, list_distinct(['alpha' || p_partkey % 7, 'beta' || p_partkey % 5, 'delta' || p_partkey % 2]) AS w FROM part),
    m AS (SELECT file, work, len(list_intersect(f.w, k.w)) AS n FROM f, k) SELECT 'alpha' || file % 7 || '_beta' || file % 5 || '-gamma' || file % 3 || '.2019.' || file AS file, max(n) / 3.0::DOUBLE AS score FROM m WHERE n >= 2 GROUP BY file"""
)
def files_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and works that share words of their names."""

    def named(k, third: str, size: int, sep: str):
        return F.concat(F.lit("alpha"), (k % 7).cast("string"), F.lit("_beta"), (k % 5).cast("string"), F.lit(f"{sep}{third}"), (k % size).cast("string"))

    s, p = F.col("s_suppkey"), F.col("p_partkey")
    files = table(spark, sf_dir, "supplier").select(F.concat(named(s, "gamma", 3, "-"), F.lit(".2019."), s.cast("string")).alias("file"), s.alias("k"))
    works = table(spark, sf_dir, "part").select(named(p, "delta", 2, " ").alias("work")).distinct()
    plain = files.select(F.regexp_replace("file", r"\.\d+$", "").alias("file")).distinct()
    best = documents.match_files(plain, works).select(F.col("file").alias("_f"), "score")
    return files.join(best, F.regexp_replace("file", r"\.\d+$", "") == F.col("_f")).select("file", "score")


@query(
    """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exclude' ELSE 'include' END AS keyword, CASE doc_id % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'maybe' END AS verdict FROM documents)
    SELECT 'doc_' || doc_id AS id, keyword, verdict, CASE WHEN verdict = 'maybe' THEN 1 ELSE 0 END AS kind FROM c WHERE verdict = 'maybe' OR verdict <> keyword"""
)
def verdict_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("_seq")
    r = refs(spark, sf_dir).withColumn("llm_verdict", F.when(i % 4 == 0, "include").when(i % 4 == 1, "exclude").when(i % 4 == 2, "maybe"))
    return screening.divergences(r).select("id", "keyword", "verdict", "kind")


@query("SELECT seq, id FROM (SELECT row_number() OVER (ORDER BY k, id) AS seq, id FROM (SELECT 0 AS k, s_suppkey AS id FROM supplier UNION ALL SELECT 1, n_nationkey FROM nation UNION ALL SELECT 2, r_regionkey FROM region))")
def union_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources one after another, numbered throughout."""
    one = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("_seq"), F.col(c).cast("long").alias("id")) for t, c in (("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))]
    return tables.numbered(tables.union_sources(one)).select(F.col("place").alias("seq"), "id")


@query(
    """WITH t AS (SELECT p_partkey AS k, 'The ' || p_name || ', of Things & co (' || p_size || ')' AS title FROM part), w AS (SELECT k, list_filter(string_split_regex(regexp_replace(title, '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND lower(x) NOT IN ('a', 'an', 'the', 'of', 'in', 'on', 'for', 'and', 'to', 'de', 'da', 'do', 'e', 'em', 'o')) AS l FROM t)
    SELECT k, (1990 + k % 30) || '_' || CASE WHEN k % 3 = 0 THEN 'Unknown' ELSE 'Silva' || k END || '_' || array_to_string(list_transform(l[1:5], lambda x: upper(left(x, 1)) || lower(substr(x, 2))), '') AS name FROM w"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    title = F.concat(F.lit("The "), F.col("p_name"), F.lit(", of Things & co ("), F.col("p_size").cast("string"), F.lit(")"))
    authors = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Silva"), k.cast("string"), F.lit(", A"))))
    return table(spark, sf_dir, "part").select(k.alias("k"), sinks.file_name(1990 + k % 30, authors, title).alias("name"))


@query("SELECT count(*) FILTER (WHERE NOT d AND retracted) AS retracted, count(*) FILTER (WHERE NOT d AND relevance = 2) AS direct, count(*) FILTER (WHERE NOT d) AS active FROM (SELECT doc_id % 13 = 0 AS retracted, doc_id % 3 AS relevance, coalesce(toxic = 1, false) AS d FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.activity(_flow_refs(spark, sf_dir))


@query(
    f"""WITH {_SCREENED} SELECT count(*) FILTER (WHERE level = 2) AS direct, count(*) FILTER (WHERE level = 1) AS tangential, count(*) FILTER (WHERE level = 0 AND closed IS NULL) AS off_topic,
    count(*) FILTER (WHERE closed IS NOT NULL) AS closed, count(*) FILTER (WHERE len(mapped) > 0) AS mapped FROM screened"""
)
def screening_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.screening_counts(screening.screen(refs(spark, sf_dir), SCOPE))


@query(
    """WITH u AS (SELECT s_suppkey AS issn_l, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['http://h/' || s_suppkey] ELSE [] END || CASE WHEN s_suppkey % 4 = 0 THEN ['https://journalinsights.elsevier.com/journals/' || s_suppkey] ELSE [] END) AS url FROM supplier),
    f AS (SELECT s_suppkey AS issn_l, 'http://h/' || s_suppkey AS url FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 < 4 AND s_suppkey % 2 = 1)
    SELECT CAST(u.issn_l AS VARCHAR) AS issn_l, url FROM u WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.issn_l = u.issn_l AND f.url = u.url)"""
)
def snapshots_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as venues; snapshots of some homepages are a hundred days old for each unit of the key modulo seven."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    base = s.select(k.cast("string").alias("issn_l"), F.when(k % 3 == 0, F.concat(F.lit("http://h/"), k.cast("string"))).otherwise("").alias("homepage_url"), F.when(k % 4 == 0, "Elsevier BV").alias("editora"))
    day = F.lit("2026-01-01").cast("date")
    held = s.where(k % 5 != 0).select(
        k.cast("string").alias("issn_l"), F.concat(F.lit("http://h/"), k.cast("string")).alias("url"), F.when(k % 2 == 1, "text").alias("text"), F.date_sub(day, F.when(k % 7 < 4, 100).otherwise(200)).alias("captured")
    )
    return enrich.due_snapshots(enrich.candidate_urls(base), held, day).select("issn_l", "url")


@query(
    """WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    n AS (SELECT doc_id, lead(body) OVER (ORDER BY doc_id) AS other FROM t),
    w AS (SELECT t.doc_id, CASE WHEN t.doc_id % 2 = 0 THEN body ELSE coalesce(other, '') END AS content, list_slice(regexp_extract_all(lower(body), '[a-z]{5,}'), 3, 8) AS own FROM t JOIN n USING (doc_id)),
    k AS (SELECT doc_id, content || CASE WHEN doc_id % 10 = 5 THEN ' Data Governance' ELSE '' END AS content,
      list_distinct(list_filter(own, lambda x: x NOT IN ('entre', 'sobre', 'ainda', 'muito', 'outros', 'outras', 'todos', 'sistema', 'sistemas', 'dados', 'forma', 'casos', 'parte', 'setor', 'papel', 'primeiro', 'segundo', 'exemplo', 'permite', 'inclui', 'incluem', 'chamados', 'chamada', 'assim', 'sendo', 'geral', 'maior', 'menor', 'novos')) ||
      CASE WHEN doc_id % 5 = 0 THEN ['governança de dados', 'data governance', 'governança'] ELSE [] END) AS words FROM w)
    SELECT doc_id, len(words) AS n_words, CASE WHEN content = '' THEN 'UNVERIFIABLE' WHEN len(words) = 0 THEN 'THEMATIC_MATCH'
      WHEN len(list_filter(words, lambda x: contains(lower(content), x))) / len(words) >= 0.3 THEN 'THEMATIC_MATCH' ELSE 'NOT_FOUND_ABSTRACT' END AS status FROM k"""
)
def claims_thematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conceptual claim of words of each document, with a composite term in every fifth, about its own whole text or
    the next one's; in every tenth that is given the term in English."""
    i = F.col("doc_id")
    d = _whole(spark, sf_dir)
    own = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0), 3, 6)
    said = F.concat(F.lit("Os sistemas de ainda "), F.when(i % 5 == 0, "governança de dados ").otherwise(""), F.array_join(own, " "), F.lit(" muito [1]."))
    texts = d.select(i.cast("string").alias("doc"), said.alias("text"))
    # the next document's text: ids follow each other in the table
    following = d.select((i - 1).alias("doc_id"), F.col("text").alias("other"))
    cited = d.join(following, "doc_id", "left").select("doc_id", F.when(i % 2 == 0, F.col("text")).otherwise(F.coalesce("other", F.lit(""))).alias("content"))
    contents = cited.select(i.cast("string").alias("doc"), F.lit(1).alias("number"), F.concat("content", F.when(i % 10 == 5, " Data Governance").otherwise("")).alias("content"), F.lit("abstract").alias("source_level"))
    told = claims.verify(claims.extract(texts).where("claim_type = 'C'"), contents)
    return told.select(F.col("doc").cast("long").alias("doc_id"), F.size(claims.keywords(F.col("claim_text"))).cast("long").alias("n_words"), "status")


@query(
    """WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS a FROM documents)
    SELECT 'Study ' || doc_id AS title, 1990 + doc_id % 30 AS year, md5(nullif(trim(array_to_string(list_prepend(a[1], list_transform(a[2:], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), ' '), E' \\t\\n\\r\\f\\x0B'), '')) AS abstract FROM l"""
)
def ris_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as abstracts of records in RIS files, which are written once and read back in as many splits as they
    give; a record's lines may lie in two of them."""
    i = F.col("doc_id").cast("string")
    body = F.regexp_replace("text", r"\r?\n", "\n")
    record = F.concat(F.lit("TY  - JOUR\nTI  - Study "), i, F.lit("\nPY  - "), (1990 + F.col("doc_id") % 30).cast("string"), F.lit("\nAB  - "), body, F.lit("\nER  - "))
    path = dedup.shared_path(spark, "ris")
    _whole(spark, sf_dir).select(record.alias("value")).write.text(path)
    r = text_sources.ris(text_sources.split_lines(spark, path), "imp")
    return r.select("title", F.col("year").cast("long").alias("year"), F.md5("abstract").alias("abstract"))


@query(
    """SELECT doc_id, length(trim(text)) >= 400 AS own, false AS strange FROM documents WHERE length(trim(coalesce(text, ''))) >= 400"""
)
def quotes_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote is in a document's whole text: one of its middle that lacks every twentieth sign, and signs that
    no text is made of. A quote that lacks every twentieth sign is alike to 97 of 100 to where it comes from."""
    d = _whole(spark, sf_dir).withColumn("n", F.length(F.trim("text"))).where("n >= 400")
    middle = F.substring(F.trim("text"), (F.col("n") / 2).cast("int") - 100, F.lit(240))
    quote = F.regexp_replace(middle, r"(?s)(.{19}).", "$1")
    told = d.select("doc_id", facts.quote_found(quote, F.col("text")).alias("own"), facts.quote_found(F.lit("@#~^|" * 20), F.col("text")).alias("strange"))
    return told


@query(
    """WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '\\s+', ' ', 'g')) AS body FROM documents)
    SELECT doc_id, md5('### Study ' || doc_id || chr(10) || chr(10) || 'first and last' || CASE WHEN body = '' THEN '' ELSE chr(10) || chr(10) || '### Deep' || chr(10) || chr(10) || body END) AS sections FROM t"""
)
def xml_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as paragraphs of a section within a section, beside paragraphs that belong to neither."""
    body = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\s+", " "))
    safe = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(
        F.lit("<article><front><p>no</p></front><body><p>none</p><sec><title>Study "), F.col("doc_id").cast("string"), F.lit("</title><p>first <i>and</i> last</p><sec><title>Deep</title><p> "), safe, F.lit(" </p></sec><list><p>no</p></list></sec></body></article>")
    )
    return _whole(spark, sf_dir).select("doc_id", F.md5(documents.xml_sections(xml)).alias("sections"))


@query(
    """WITH t AS (SELECT page_id, trim(regexp_replace(coalesce(html, ''), '[^A-Za-z0-9]+', ' ', 'g')) AS body FROM pages)
    SELECT page_id, CASE WHEN length(body) >= 200 THEN md5(body) END AS article FROM t"""
)
def page_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters and digits of each page's whole markup as the text of containers of every kind, nested and repeated:
    of each page the right one is found, and ends where it ends."""
    body = F.trim(F.regexp_replace(F.coalesce("html", F.lit("")), "[^A-Za-z0-9]+", " "))
    i = F.col("page_id") % 4
    page = (
        F.when(i == 0, F.concat(F.lit("<body><main>m</main><div class='content'>d</div><article><nav>n</nav>"), body, F.lit("</article>x<article>y</article></body>")))
        .when(i == 1, F.concat(F.lit("<body>a<div class='b page-content'><script>s</script><span>"), body, F.lit("</span></div>x<div class='paper'>y</div></body>")))
        .when(i == 2, F.concat(F.lit("<body>a<div class='other'>o</div><main>"), body, F.lit("<footer>f</footer></main>x</body>")))
        .otherwise(F.concat(F.lit("<head><style>h</style></head><body><header>h</header>"), body, F.lit("</body>")))
    )
    return table(spark, sf_dir, "pages").select("page_id", F.md5(documents.article_text(page)).alias("article"))


@query("SELECT DISTINCT user_id % 40 AS ref_number, event_type AS unit, floor(value) AS value FROM events")
def registry_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quantitative facts that come in three batches, each of which holds what others have told: every fact is
    registered once."""
    number = F.col("event_id")
    told = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).cast("int").alias("ref_number"), F.lit("quantitative").alias("fact_type"), F.lit(None).cast("string").alias("exact_quote"), F.floor("value").cast("double").alias("value"), F.col("event_type").alias("unit"),
        F.lit("verified").alias("status"), F.lit("events").alias("_file"), F.lit(0).cast("long").alias("_block"), (number % 3).alias("part"),
    )
    registry = dedup.shared_path(spark, "registry")
    for k in range(3):
        pending.add_batch(told.where(F.col("part") == k).drop("part"), k, registry, lambda batch: batch)
    return pending.registered(spark, registry).select("ref_number", "unit", "value")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN cents * 1000000 ELSE cents END AS cents FROM l"""
)
def number_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in two notations, with and without grouping, by themselves or in millions."""
    price, k = F.col("l_extendedprice"), F.col("l_orderkey") % 4
    english = F.format_number(price, 2)
    swapped = F.translate(english, ",.", ".,")
    raw = F.when(k == 0, english).when(k == 1, swapped).when(k == 2, F.replace(english, F.lit(","), F.lit(""))).otherwise(F.replace(swapped, F.lit("."), F.lit("")))
    context = F.concat(F.lit("some "), raw, F.when(F.col("l_linenumber") % 2 == 0, " million in all").otherwise(" in all"))
    value = numbers.number_value(raw, context)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value * 100).cast("long").alias("cents"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS f, o_custkey % 5 AS off, o_totalprice AS a, o_totalprice * 0.8 + o_custkey AS b FROM orders),
    c AS (SELECT *, CASE f WHEN 0 THEN (a - b) / a * 100 WHEN 1 THEN (b - a) / a * 100 WHEN 2 THEN a / b WHEN 3 THEN a - b WHEN 4 THEN a + b END AS v FROM o)
    SELECT o_orderkey, coalesce(abs(v * (1 + off * 0.004) - v) <= greatest(abs(v) * 0.01, 0.1), false) AS holds FROM c"""
)
def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of orders, and what is said to follow from them: right, up to 0.8 % off, or more."""
    f = F.element_at(F.array(*[F.lit(n) for n in ("percentage_reduction", "percentage_increase", "ratio", "difference", "sum", "unknown")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    values = F.array(F.col("o_totalprice"), F.col("o_totalprice") * 0.8 + F.col("o_custkey"))
    told = table(spark, sf_dir, "orders").select("o_orderkey", f.alias("f"), values.alias("v"), (F.col("o_custkey") % 5).alias("off"))
    stated = numbers.derived(F.col("f"), F.col("v")) * (1 + F.col("off") * 0.004)
    return told.select("o_orderkey", numbers.derivation_holds(F.col("f"), F.col("v"), stated).alias("holds"))


@query(
    """WITH o AS (SELECT o_orderkey, 100.0 + o_custkey % 90 AS a, 1.0 + o_orderkey % 150 AS b, CAST(o_orderkey % 97 AS DOUBLE) AS p FROM orders),
    c AS (SELECT *, greatest(a, b) AS h, least(a, b) AS l FROM o)
    SELECT o_orderkey, abs((h - l) / h * 100 - p) <= 5 OR abs((h - l) / l * 100 - p) <= 5 AS holds FROM c"""
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`a to b, a change of p percent`: by the larger or by the smaller value, give or take five points."""
    a, b, p = 100.0 + F.col("o_custkey") % 90, 1.0 + F.col("o_orderkey") % 150, (F.col("o_orderkey") % 97).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.transition_holds(a, b, p).alias("holds"))


@query(
    """SELECT p_partkey, p_partkey % 3 < 2 AS abbreviates FROM part
    WHERE len(string_split(p_name, ' ')) = len(list_distinct(list_transform(string_split(p_name, ' '), lambda w: left(w, 3))))"""
)
def journal_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names abridged word by word, in their order or the other way round, and other words; names whose words begin
    alike are left out, since there a word of another place may stand for it."""
    words = F.split("p_name", " ")
    short = F.transform(words, lambda w: F.concat(F.substring(w, 1, 3), F.lit(".")))
    own = table(spark, sf_dir, "part").where(F.size(words) == F.size(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 3)))))
    k = F.col("p_partkey") % 3
    given = F.when(k == 0, F.array_join(short, " ")).when(k == 1, F.array_join(F.reverse(short), " ")).otherwise("Qzx. Xyz.")
    return own.select("p_partkey", records.abbreviates(given, F.col("p_name")).alias("abbreviates"))
