"""The operators as queries over the provided tables: name -> (function, SQL or None).

The tables are no bibliographic records; `refs` gives documents the columns of records (title: first line, year, flags
and counts from the id), and the other queries use whichever table has the shape that an operator needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers, similarity, text
from .operators import claims, dedup, facts, journals, keyed, records, reports, screening
from .plans.scope import Axis, Block, Scope
from .schema import conformed
from .sources import sinks
from .sources import text as text_sources

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}

SCOPE = Scope(
    project="demo",
    modality="pesquisa-base",
    blocks=(Block("technology", ("the", "der", "les")), Block("application problem", ("with", "mit", "avec", "para")), Block("domain setting", ("from", "von", "sur"))),
    axes=(Axis("first", ("that",), ("this",)), Axis("second", ("nicht", "dans"), ("los",))),
    direct_terms=("was", "is", "und", "est"),
    off_topic_terms=("by", "zu"),
)
AXES = tuple(a.name for a in SCOPE.axes)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _ALL[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records."""
    i = F.col("doc_id")
    return conformed(
        table(spark, sf_dir, "documents").select(
            i.alias("_seq"),
            F.concat(F.lit("doc_"), i.cast("string")).alias("id"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("abstract"),
            F.col("source").alias("journal"),
            (F.lit(2015) + i % 12).cast("int").alias("year"),
            F.col("n_chars").alias("citation_count"),
            (i % 3 == 0).alias("is_open_access"),
            F.when(i % 17 == 0, "editorial").when(i % 5 == 0, "journal-article").when(i % 7 == 0, "report").alias("pub_type"),
            F.when(i % 4 != 0, F.concat(F.lit("10.1000/"), i.cast("string"))).alias("doi"),
            F.when(i % 4 != 0, i % 9 != 0).alias("doi_resolves"),
            F.when(i % 4 != 0, i % 11 != 0).alias("crossref_match"),
            F.when(i % 6 == 0, i % 5 != 0).alias("authors_verified"),
            F.when(i % 13 == 0, F.lit(True)).otherwise(F.lit(False)).alias("retracted"),
            F.element_at(F.array(*[F.lit(t) for t in ("T1", "T2", "T3", "T4", "UNKNOWN")]), (i % 5 + 1).cast("int")).alias("tier"),
            F.element_at(F.array(*[F.lit(a) for a in ("accessible", "restricted", "broken", "no_url", "open_access")]), (i % 5 + 1).cast("int")).alias("access_status"),
            (i % 3).cast("int").alias("relevance"),
        )
    )


def _hit(terms: tuple[str, ...], column: str = "t") -> str:
    return f"regexp_matches({column}, '" + "|".join(f"(?:{text.term_pattern(t)})" for t in terms) + "')"


def _count(terms: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST({_hit((t,))} AS INT)" for t in terms) + ")" if terms else "0"


_REFS = """
r AS (
  SELECT doc_id AS seq, 'doc_' || doc_id AS id, split_part(text, chr(10), 1) AS title, text AS abstract, source AS journal,
         CAST(2015 + doc_id % 12 AS INT) AS year, n_chars AS cites, doc_id % 3 = 0 AS oa,
         CASE WHEN doc_id % 17 = 0 THEN 'editorial' WHEN doc_id % 5 = 0 THEN 'journal-article' WHEN doc_id % 7 = 0 THEN 'report' END AS pub_type,
         CASE WHEN doc_id % 4 <> 0 THEN '10.1000/' || doc_id END AS doi,
         CASE WHEN doc_id % 4 <> 0 THEN doc_id % 9 <> 0 END AS doi_resolves,
         CASE WHEN doc_id % 4 <> 0 THEN doc_id % 11 <> 0 END AS crossref_match,
         CASE WHEN doc_id % 6 = 0 THEN doc_id % 5 <> 0 END AS authors_verified,
         doc_id % 13 = 0 AS retracted,
         ['T1', 'T2', 'T3', 'T4', 'UNKNOWN'][doc_id % 5 + 1] AS tier,
         ['accessible', 'restricted', 'broken', 'no_url', 'open_access'][doc_id % 5 + 1] AS access_status,
         CAST(doc_id % 3 AS INT) AS relevance
  FROM documents
)"""

_SCREENED = f"""
{_REFS}, s0 AS (
  SELECT *, lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(journal, ''))) AS t FROM r
), s1 AS (
  SELECT *, {" + ".join(f"CAST({_hit(b.terms)} AS INT)" for b in SCOPE.blocks)} AS k, {_hit(SCOPE.direct_terms)} AS direct,
         {_hit(SCOPE.off_topic_terms, "lower(title)")} AS off_title,
         list_filter([{", ".join(f"CASE WHEN {_hit(a.keywords + a.synonyms)} THEN '{a.name}' END" for a in SCOPE.axes)}], lambda x: x IS NOT NULL) AS axes
  FROM s0
), s2 AS (
  SELECT *, CASE WHEN NOT regexp_matches(t, '\\S') THEN 'no_text' WHEN pub_type = 'editorial' THEN 'pub_type_excluded' WHEN off_title AND NOT direct THEN 'exclusion_keyword' END AS closed,
         CASE WHEN k >= 2 THEN 'co_occurrence_' || k || '_blocks' WHEN k = 1 AND direct THEN 'single_block_plus_direct_keyword' WHEN k = 1 THEN 'single_block'
              WHEN direct THEN 'direct_keyword_only' ELSE 'no_match' END AS m0,
         CASE WHEN k >= 2 OR (k = 1 AND direct) THEN 2 WHEN k = 1 OR direct THEN 1 ELSE 0 END AS l0
  FROM s1
), s3 AS (
  SELECT *, CASE WHEN closed IS NOT NULL THEN closed WHEN l0 = 2 AND len(axes) = 0 THEN m0 || '_no_axis' ELSE m0 END AS method,
         CASE WHEN closed IS NOT NULL THEN 0 WHEN l0 = 2 AND len(axes) = 0 THEN 1 ELSE l0 END AS level
  FROM s2
), s4 AS (
  SELECT *, CASE WHEN closed IS NULL AND level <> 0 THEN axes ELSE [] END AS mapped FROM s3
), screened AS (
  SELECT *, CASE WHEN level = 0 THEN 0.0 ELSE 3.0 * len(mapped) + 2.0 * {_count(SCOPE.application_terms)} + 1.0 * {_count(SCOPE.domain_terms)}
         + 0.5 * least({_count(SCOPE.direct_terms)}, 5) + CASE WHEN year >= 2025 THEN 3 WHEN year >= 2023 THEN 2 WHEN year >= 2021 THEN 1 ELSE 0 END
         + CASE WHEN oa THEN 2.0 ELSE 0.0 END + least(cites / 50.0, 5.0) END AS score
  FROM s4
)"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.rank(screening.screen(refs(spark, sf_dir), SCOPE, with_hits=True), SCOPE)


@query(f"WITH {_SCREENED} SELECT id, CAST(level AS INT) AS relevance, method AS relevance_method, CAST(round_even(score, 2) AS DOUBLE) AS relevance_score FROM screened ORDER BY round_even(score, 2) DESC, seq LIMIT 40")
def screen_blocks_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = screened(spark, sf_dir).orderBy(F.desc("relevance_score"), "_seq").limit(SCOPE.max_final)
    return top.select("id", "relevance", "relevance_method", "relevance_score")


@query(f"WITH {_SCREENED} SELECT CAST(level AS INT) AS relevance, method AS relevance_method, count(*) AS n, sum(len(mapped)) AS axes FROM screened GROUP BY 1, 2")
def screen_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = screening.screen(refs(spark, sf_dir), SCOPE)
    return told.groupBy("relevance", "relevance_method").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("mapped_axes")).alias("axes"))


@query(
    f"""WITH {_SCREENED}, e AS (SELECT CASE method WHEN 'pub_type_excluded' THEN 'pub_type_excluded' WHEN 'exclusion_keyword' THEN 'exclusion_keyword' WHEN 'no_text' THEN 'no_text' ELSE 'no_match' END AS reason FROM screened WHERE level = 0)
    SELECT reason, count(*) AS n FROM e GROUP BY 1"""
)
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exclusion_reasons(screening.screen(refs(spark, sf_dir), SCOPE))


@query(
    """WITH d AS (SELECT doc_id AS seq, 'doc_' || doc_id AS id, md5(lower(text)) AS k, nullif(n_chars, 0) AS c FROM documents),
    g AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS head, max(c) OVER (PARTITION BY k) AS top FROM d WINDOW w AS (PARTITION BY k ORDER BY seq))
    SELECT id, n > 1 AS is_duplicate, CASE WHEN n > 1 THEN head END AS canonical_id, CASE WHEN n = 1 THEN top ELSE c END AS citation_count FROM g"""
)
def exact_dedup_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that share a DOI (here a digest of the text): the first is canonical and takes the largest count."""
    r = refs(spark, sf_dir).withColumn("doi", F.md5(F.lower("abstract"))).withColumn("abstract", F.lit(None).cast("string"))
    return dedup.exact(r).select("id", "is_duplicate", "canonical_id", "citation_count")


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.normalize_fields(refs(spark, sf_dir)).withColumn("abstract", F.lit(None).cast("string"))


@query()
def fuzzy_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy duplicates by title and year, each with its leader."""
    return dedup.fuzzy(dedup.cut(_titles(spark, sf_dir)))[0].where("is_duplicate").select("id", "canonical_id")


@query()
def suspects_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _titles(spark, sf_dir).select("_seq", "id", "title", "authors", "year", "journal", "doi", "citation_count", "is_duplicate", "canonical_id")
    return dedup.fuzzy(dedup.cut(told))[1]


_TIERS = "(VALUES ('example.com', 'T1'), ('blog.thering.example.com', 'T4'), ('example.net', 'T2'), ('net', 'T3'), ('thered.example.org', 'T2')) AS t(domain, tier)"


@query(
    f"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages),
    s AS (SELECT page_id, host, i, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS part FROM h, range(1, 9) AS g(i) WHERE i <= len(string_split(host, '.'))),
    m AS (SELECT page_id, arg_min(tier, i) AS tier FROM s JOIN {_TIERS} ON domain = part GROUP BY 1)
    SELECT page_id, host AS domain, coalesce(tier, 'UNKNOWN') AS tier FROM h LEFT JOIN m USING (page_id)"""
)
def host_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.sql(f"SELECT * FROM {_TIERS}")
    return records.domain_tier(table(spark, sf_dir, "pages").select("page_id", "url"), tiers).select("page_id", "domain", "tier")


_PENDING = """CAST(coalesce(NOT authors_verified, false) AS INT) + CAST(coalesce(doi_resolves AND NOT crossref_match, false) AS INT)
    + CAST(doi IS NULL AS INT) + CAST(coalesce(NOT doi_resolves, false) AS INT)"""
_GRADED = f"""{_REFS}, p AS (SELECT *, {_PENDING} AS pending FROM r), g AS (
  SELECT *, CASE WHEN retracted OR relevance = 0 OR tier = 'T4' OR access_status = 'broken' THEN 'discard' WHEN pending > 0 THEN 'bronze'
    WHEN tier IN ('T1', 'T2') AND relevance = 2 THEN 'gold' WHEN tier = 'T3' AND relevance = 2 THEN 'silver' WHEN tier IN ('T1', 'T2') AND relevance = 1 THEN 'silver' ELSE 'bronze' END AS grade FROM p)"""


@query(f"WITH {_GRADED} SELECT id, pending, grade FROM g")
def grade_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refs(spark, sf_dir).select("id", F.size(records.pendencies()).alias("pending"), records.grade().alias("grade"))


@query(f"WITH {_GRADED} SELECT CASE WHEN retracted THEN 'retracted' WHEN relevance = 0 THEN 'off_topic' WHEN tier = 'T4' THEN 'informal_source' WHEN access_status = 'broken' THEN 'broken_url' ELSE 'composite' END AS reason, count(*) AS n FROM g WHERE grade = 'discard' GROUP BY 1")
def discard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = refs(spark, sf_dir).withColumn("grade", records.grade()).where("grade = 'discard'")
    return graded.groupBy(records.discard_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GRADED}, t AS (SELECT id FROM g WHERE grade IN ('gold', 'silver') ORDER BY seq LIMIT 40) SELECT id, grade, id IN (SELECT id FROM t) AS final FROM g")
def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.synthesize(refs(spark, sf_dir), SCOPE.modality, SCOPE.max_final).select("id", "grade", "final")


@query(f"WITH {_GRADED} SELECT id, f.fault FROM g, (VALUES ('no_title'), ('no_doi_or_url'), ('doi_does_not_resolve')) AS f(fault) WHERE grade <> 'discard' AND CASE f.fault WHEN 'no_title' THEN title IS NULL OR title = '' WHEN 'no_doi_or_url' THEN doi IS NULL ELSE coalesce(NOT doi_resolves, false) END")
def validation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.validate(refs(spark, sf_dir).withColumn("grade", records.grade()))


@query("WITH o AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC) AS n, count(*) OVER () AS total FROM orders WHERE o_totalprice > 0) SELECT max(v) AS threshold FROM o WHERE n >= greatest(1, total // 10)")
def canonical_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.landmark_threshold(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    f"""WITH {_REFS}, o AS (SELECT cites, row_number() OVER (ORDER BY cites DESC) AS n, count(*) OVER () AS total FROM r WHERE cites > 0),
    b AS (SELECT max(cites) AS bar FROM o WHERE n >= greatest(1, total // 10)) SELECT count(*) FILTER (WHERE cites >= 100 OR cites >= bar) AS landmarks, count(*) AS n FROM r, b"""
)
def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.mark_landmarks(refs(spark, sf_dir)).agg(F.count_if("is_canonical").alias("landmarks"), F.count(F.lit(1)).alias("n"))


_FLOW = f"""{_GRADED}, d AS (SELECT g.*, l.toxic = 1 AS dup FROM g LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = seq),
f AS (SELECT *, coalesce(dup, false) AS is_dup FROM d)"""


def _flow_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records graded, toxic documents standing for duplicates."""
    marks = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_seq")).agg((F.max("toxic") == 1).alias("_dup"))
    r = refs(spark, sf_dir).withColumn("grade", records.grade()).join(marks, "_seq", "left")
    return r.withColumn("is_duplicate", F.coalesce("_dup", F.lit(False))).drop("_dup")


@query(
    f"""WITH {_FLOW}, c AS (SELECT *, NOT is_dup AND relevance <> 0 AS cand FROM f)
    SELECT count(*) AS identified, count(*) FILTER (WHERE is_dup) AS duplicates, count(*) FILTER (WHERE NOT is_dup) AS screened, count(*) FILTER (WHERE NOT is_dup AND relevance = 0) AS excluded_screening,
    count(*) FILTER (WHERE cand AND access_status = 'broken') AS not_retrieved, count(*) FILTER (WHERE cand AND access_status = 'restricted') AS to_obtain, count(*) FILTER (WHERE cand AND access_status <> 'broken') AS assessed,
    count(*) FILTER (WHERE cand AND access_status <> 'broken' AND retracted) AS retracted, 0 AS divergent, count(*) FILTER (WHERE cand AND access_status <> 'broken' AND grade IN ('gold', 'silver', 'bronze')) AS included FROM c"""
)
def prisma_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.flow(_flow_refs(spark, sf_dir), "revisao-sistematica")


@query(
    f"""WITH {_FLOW}, e AS (SELECT * FROM (VALUES (0, 'gold'), (1, 'silver'), (2, 'bronze'), (3, 'discard'), (4, 'ungraded')) AS v(position, grade)), u AS (SELECT grade FROM f WHERE NOT is_dup)
    SELECT position, e.grade, count(u.grade) AS n, count(u.grade) * 100.0::DOUBLE / (SELECT count(*) FROM u) AS percent FROM e LEFT JOIN u USING (grade) GROUP BY 1, 2"""
)
def audit_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_domain(_flow_refs(spark, sf_dir).where("not is_duplicate"), "grade", ("gold", "silver", "bronze", "discard", "ungraded"))


@query(f"WITH {_FLOW} SELECT count(*) FILTER (WHERE tier = 'T1') * 100.0::DOUBLE / count(*) AS share, count(*) FILTER (WHERE tier = 'T1') * 100.0 / count(*) < 50 AS alert FROM f WHERE NOT is_dup")
def t1_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.t1_alert(_flow_refs(spark, sf_dir), "pesquisa-base")


@query(
    f"""WITH {_SCREENED}, a AS (SELECT unnest(mapped) AS axis, CASE WHEN level = 2 THEN 'gold' ELSE 'silver' END AS grade FROM screened WHERE level <> 0), x AS (SELECT * FROM (VALUES (0, 'first'), (1, 'second'), (2, 'third')) AS v(position, axis))
    SELECT position, x.axis, count(grade) AS total, count(*) FILTER (WHERE grade = 'gold') AS gold, count(*) FILTER (WHERE grade = 'silver') AS silver,
    CASE WHEN count(grade) >= 3 THEN 'adequate' WHEN count(grade) > 0 THEN 'insufficient' ELSE 'none' END AS status FROM x LEFT JOIN a USING (axis) GROUP BY 1, 2"""
)
def coverage_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = screening.screen(refs(spark, sf_dir), SCOPE).withColumn("grade", F.when(F.col("relevance") == 2, "gold").when(F.col("relevance") == 1, "silver"))
    return reports.coverage(told, (*AXES, "third"))


@query(f"WITH {_SCREENED}, t AS (SELECT *, row_number() OVER (ORDER BY round_even(score, 2) DESC, seq) AS n FROM screened WHERE level <> 0) SELECT CAST(n AS INT) AS rank, id, CASE WHEN n <= 40 THEN 'selected' ELSE 'borderline' END AS label FROM t WHERE n <= 50")
def validation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validation_list(screened(spark, sf_dir), 40).select("rank", "id", "label")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def counter_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(
    """WITH p AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
    c AS (SELECT count(*) FILTER (WHERE a AND b)::DOUBLE AS ii, count(*) FILTER (WHERE a AND NOT b)::DOUBLE AS ie, count(*) FILTER (WHERE NOT a AND b)::DOUBLE AS ei, count(*) FILTER (WHERE NOT a AND NOT b)::DOUBLE AS ee FROM p),
    o AS (SELECT ii + ie + ei + ee AS n, (ii + ee) / (ii + ie + ei + ee) AS o, ((ii + ie) * (ii + ei) + (ee + ei) * (ee + ie)) / ((ii + ie + ei + ee) * (ii + ie + ei + ee)) AS e FROM c)
    SELECT CAST(n AS BIGINT) AS n, round(o, 9) AS observed, round((o - e) / (1 - e), 9) AS kappa,
    CASE WHEN (o - e) / (1 - e) > 0.8 THEN 'almost perfect' WHEN (o - e) / (1 - e) > 0.6 THEN 'substantial' WHEN (o - e) / (1 - e) > 0.4 THEN 'moderate' WHEN (o - e) / (1 - e) > 0.2 THEN 'fair' ELSE 'slight' END AS label FROM o"""
)
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").where("quality is not null and toxic is not null").select(F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("one"), F.when(F.col("toxic") == 0, "include").otherwise("exclude").alias("two"))
    return screening.kappa(pairs).withColumns({"observed": F.round("observed", 9), "kappa": F.round("kappa", 9)})


@query("SELECT 'doc_' || doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def without_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"))
    return screening.without_verdict(refs(spark, sf_dir), marks).select("id")


@query("SELECT conv_id, arg_max(role, turn) AS role, arg_max(md5(text), turn) AS digest, max(turn) AS turn FROM conversations GROUP BY 1")
def verdict_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    return keyed.replace_last(turns, ["conv_id"], "turn")


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id = 0").first()["embedding"]  # one vector
    score = F.round(similarity.cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in wanted])), 6)
    return vectors.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(
    f"""WITH {_SCREENED}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS s FROM embeddings, q)
    SELECT id, CAST(CASE WHEN level = 0 AND method = 'no_match' AND s >= 0.1 THEN 1 ELSE level END AS INT) AS relevance, method || CASE WHEN level = 0 AND method = 'no_match' AND s >= 0.1 THEN '|semantic_rescue' ELSE '' END AS relevance_method
    FROM screened LEFT JOIN v ON vec_id = seq"""
)
def semantic_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wanted = vectors.where("vec_id = 0").first()["embedding"]
    own = vectors.select(F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return screening.semantic_layer(screened(spark, sf_dir), own, wanted, threshold=0.1).select("id", "relevance", "relevance_method")


@query(
    """WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 1
    UNION ALL SELECT s_suppkey + 1000000, 'new', NULL FROM supplier WHERE s_suppkey % 5 = 0)
    SELECT coalesce(n.s_suppkey, o.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, coalesce(n.s_acctbal, o.s_acctbal) AS s_acctbal, o.s_nationkey FROM supplier o FULL JOIN n ON n.s_suppkey = o.s_suppkey"""
)
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    k = F.col("s_suppkey")
    new = old.where(k % 4 != 1).select(k, F.when(k % 3 == 0, F.upper("s_name")).alias("s_name"), F.when(k % 2 == 0, F.col("s_acctbal") + 1).alias("s_acctbal"))
    more = old.where(k % 5 == 0).select((k + 1000000).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(None).cast("double").alias("s_acctbal"))
    return keyed.upsert(old, new.unionByName(more), "s_suppkey")


@query("SELECT c_custkey, coalesce(a.n_name, b.n_name) AS n_name FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey + 15 LEFT JOIN nation b ON b.n_nationkey = c_nationkey WHERE coalesce(a.n_name, b.n_name) IS NOT NULL")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_nationkey") + 15, F.col("c_nationkey")).alias("keys"))
    return keyed.first_hit(rows, "c_custkey", "keys", table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("WITH o AS (SELECT o_custkey, o_orderkey, CAST(year(o_orderdate) AS INT) AS ano FROM orders) SELECT * FROM o WHERE ano = (SELECT max(ano) FROM o p WHERE p.o_custkey = o.o_custkey)")
def latest_year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("ano"))
    return keyed.latest(rows, ["o_custkey"], "ano")


@query(
    """WITH l AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS line, l_returnflag AS title, l_linestatus AS area, CAST(l_quantity AS INT) % 10 + 1 AS p FROM lineitem),
    b AS (SELECT *, min(p) OVER (PARTITION BY part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
    SELECT part, arg_min(title, line) AS title, ['A1', 'A2', 'A3', 'A4', 'B1', 'B2', 'B3', 'B4', 'B5', 'C'][min(p)] AS stratum, array_to_string(list_sort(list(DISTINCT area)), ',') AS areas, count(*) FILTER (WHERE before <> p) AS conflicts FROM b GROUP BY part"""
)
def best_stratum_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    stratum = F.element_at(F.array(*[F.lit(s) for s in keyed.STRATA]), (F.col("l_quantity").cast("int") % 10 + 1))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("area"), stratum.alias("stratum"))
    return keyed.fold_strata(rows, "part", "title", "area", "stratum", "line").withColumn("areas", F.array_join("areas", ","))


@query("SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice <> 0 AND abs(p_retailprice - l_extendedprice) / abs(l_extendedprice) <= 0.25")
def band_join_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return keyed.band_join(lines, parts, "p_partkey", "l_extendedprice", "p_retailprice", 0.25).select("l_orderkey", "l_linenumber", "p_partkey")


@query("SELECT event_type, count(*) FILTER (WHERE ts IS NULL OR date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) > 7) AS expired, count(*) AS n FROM events GROUP BY 1")
def ttl_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    as_of = F.lit(events.agg(F.max("ts").cast("date")).first()[0])
    old = keyed.expired(F.col("ts").cast("date"), as_of, 7)
    return events.groupBy("event_type").agg(F.count_if(old).alias("expired"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT doc_id, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS t FROM documents), b AS (SELECT doc_id, CASE WHEN instr(t, '---') > 0 THEN substr(t, instr(t, '---') + 3) ELSE t END AS t FROM d)
    SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), 1, 16) AS content_hash FROM b"""
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("WITH f AS (SELECT doc_id, doc_id % 50 AS ref_number, CASE WHEN doc_id % 7 = 0 THEN 'rejected' ELSE 'verified' END AS status FROM documents) SELECT CASE WHEN ref_number % 3 = 0 AND status <> 'rejected' THEN 'stale' ELSE status END AS status, count(*) AS n FROM f GROUP BY 1")
def stale_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(i, (i % 50).alias("ref_number"), F.when(i % 7 == 0, "rejected").otherwise("verified").alias("status"))
    hashes = spark.range(50).select(F.col("id").alias("ref_number"), F.lit("a").alias("stored"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("current"))
    return keyed.stale(rows, hashes).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH t AS (SELECT doc_id, 'see (10.' || (1000 + doc_id % 900) || '/ab.' || doc_id || '). ' || coalesce(text, '') || ' 10.5555/x,y 10.' || (1000 + doc_id % 900) || '/ab.' || doc_id AS t FROM documents),
    m AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(t, '(10\\.\\d{4,}/[^\\s\\]\\)\\},;]+)', 1), lambda d: rtrim(rtrim(rtrim(d, '.'), ','), ')')), lambda d: len(d) > 8) AS l FROM t)
    SELECT doc_id, l[1] AS first, len(list_distinct(l)) AS n FROM m"""
)
def doi_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs of whole texts, each between two of its own."""
    i = F.col("doc_id")
    own = F.concat(F.lit("10."), (1000 + i % 900).cast("string"), F.lit("/ab."), i.cast("string"))
    t = F.concat(F.lit("see ("), own, F.lit("). "), F.col("text"), F.lit(" 10.5555/x,y "), own)
    found = _whole(spark, sf_dir).select(i, text.dois(t).alias("l"))
    return found.select("doc_id", F.get("l", F.lit(0)).alias("first"), F.size("l").alias("n"))


_PRICE = "CASE o_orderkey % 4 WHEN 0 THEN replace(CAST(CAST(floor(o_totalprice) AS INT) AS VARCHAR), '.', ',') || ',5' WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS INT) // 1000 AS VARCHAR) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS INT) // 1000 AS VARCHAR) || '.' || lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS VARCHAR), 3, '0') || ',25' ELSE 'n/a' END"


@query(
    f"""WITH t AS (SELECT o_orderkey, {_PRICE} AS raw FROM orders)
    SELECT o_orderkey, raw, coalesce(TRY_CAST(CASE WHEN raw LIKE '%,%' AND raw LIKE '%.%' THEN replace(replace(raw, '.', ''), ',', '.') WHEN regexp_matches(raw, '^[^,]{{0,3}},[^,]{{3}}$') THEN replace(raw, ',', '') ELSE replace(raw, ',', '.') END AS DOUBLE), 0.0) AS value FROM t"""
)
def numbers_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    n = F.floor(p).cast("int")
    group = F.floor(n / 1000).cast("int").cast("string")
    rest = F.lpad((n % 1000).cast("string"), 3, "0")
    raw = F.when(k % 4 == 0, F.concat(n.cast("string"), F.lit(",5"))).when(k % 4 == 1, F.concat(group, F.lit(","), rest)).when(k % 4 == 2, F.concat(group, F.lit("."), rest, F.lit(",25"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select(k, raw.alias("raw")).withColumn("value", numbers.pt_number(F.col("raw")))


@query("SELECT event_type, count(*) AS n, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the whole text, null as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]', ' ', 'g')), '\\s+'), lambda w: len(w) > 2)) AS w FROM documents)
    SELECT doc_id, len(w) AS n, len(list_intersect(w, ['the', 'and', 'with', 'der', 'les'])) AS hits FROM t"""
)
def tokens_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of whole texts, and how many of five are among them."""
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "with", "der", "les")])
    words = _whole(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").alias("n"), F.size(F.array_intersect("w", wanted)).alias("hits"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def inverted_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to an inverted index and back, which gives the text again. Places are grouped in the sorted words, so
    the work doesn't grow with words times distinct words."""
    words = F.split("text", " ")
    pairs = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    d = _whole(spark, sf_dir).select("doc_id", pairs.alias("p"))
    first = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i)["w"] != F.get("p", i - 1)["w"]))
    d = d.withColumn("heads", first)
    ends = lambda i: F.coalesce(F.get("heads", i + 1), F.size("p"))
    places = F.transform("heads", lambda h, i: F.transform(F.slice("p", h + 1, ends(i) - h), lambda x: x["at"]))
    keys = F.transform("heads", lambda h: F.get("p", h)["w"])
    return d.select("doc_id", F.md5(text.abstract_of(F.map_from_arrays(keys, places))).alias("digest"))


@query("(SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def candidate_union_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    base = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("nation"))
    return keyed.not_in(one.unionByName(two).distinct(), base, "nation")


@query(
    """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN lpad(CAST(s_suppkey * 7919 % 10000000 AS VARCHAR), 7, '0') || 'x' WHEN 1 THEN ' ' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') || '-0123 ' ELSE 'bad' || s_suppkey END AS raw FROM supplier),
    m AS (SELECT s_suppkey, replace(regexp_extract(regexp_replace(upper(raw), '\\s', '', 'g'), '^(\\d{4})-?(\\d{3}[\\dX])$', 0), '-', '') AS p FROM s)
    SELECT s_suppkey, CASE WHEN p <> '' THEN substr(p, 1, 4) || '-' || substr(p, 5, 4) END AS issn FROM m"""
)
def issn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"), F.lit("x"))).when(k % 3 == 1, F.concat(F.lit(" "), F.lpad(k.cast("string"), 4, "0"), F.lit("-0123 "))).otherwise(F.concat(F.lit("bad"), k.cast("string")))
    return table(spark, sf_dir, "supplier").select(k, text.norm_issn(raw).alias("issn"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10.1/a' WHEN 1 THEN '10.1/b' WHEN 2 THEN '10.1/c' ELSE 'http://doi.org/10.1/d' END AS doi FROM documents")
def doi_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    raw = F.when(i % 4 == 0, " HTTPS://doi.org/10.1/A\t").when(i % 4 == 1, "doi:10.1/B").when(i % 4 == 2, "https://doi.org/doi:10.1/c").otherwise("doi:http://doi.org/10.1/d")
    return table(spark, sf_dir, "documents").select(i, text.norm_doi(raw).alias("doi"))


@query(
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '' ELSE 'http://x' END AS url, event_id % 5 = 0 AS oa, ['accessible', 'restricted', 'timeout', 'broken', 'other'][event_id % 5 + 1] AS probe, event_id % 7 = 0 AS open FROM events)
    SELECT CASE WHEN url = '' THEN 'no_url' WHEN open THEN 'open_access' WHEN probe = 'accessible' THEN 'accessible' WHEN probe = 'broken' THEN 'broken' ELSE 'restricted' END AS status, count(*) AS n FROM p GROUP BY 1"""
)
def access_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    probe = F.element_at(F.array(*[F.lit(p) for p in ("accessible", "restricted", "timeout", "broken", "other")]), (i % 5 + 1).cast("int"))
    status = records.access_status(F.when(i % 9 == 0, "").otherwise("http://x"), i % 7 == 0, probe)
    return table(spark, sf_dir, "events").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_GRADED} SELECT seq, md5('@' || CASE WHEN pub_type = 'journal-article' THEN 'article' WHEN pub_type = 'report' THEN 'techreport' WHEN coalesce(journal, '') <> '' THEN 'article' ELSE 'misc' END || '{{Unknown' || year || right(id, 4) || ',') AS head
    FROM g WHERE grade IN ('gold', 'silver')"""
)
def bibtex_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = refs(spark, sf_dir).withColumn("grade", records.grade())
    entries = sinks.bibtex(graded, ("gold", "silver"))
    return entries.select(F.col("_seq").alias("seq"), F.md5(F.split_part("entry", F.lit("\n"), F.lit(1))).alias("head"))


@query("SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer)[^>]*>.*?</(script|style|nav|header|footer)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("digest"))


def _claim_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Markdown with three cited claims: doc, text, and the numbers in them (b, then a, and p percent, which
    is wrong for every fifth)."""
    i = F.col("doc_id")
    a, b = 50 + i % 50, 10 + i % 30
    p = F.when(i % 5 == 0, F.lit(5)).otherwise(F.floor((200 * (a - b) + a) / (2 * a)))
    d = table(spark, sf_dir, "documents").select(i.cast("string").alias("doc"), i.alias("i"), a.alias("a"), b.alias("b"), p.cast("long").alias("p"), F.coalesce("n_chars", F.lit(0)).alias("n"), F.coalesce("text", F.lit("")).alias("body"))
    said = F.format_string(
        "Intro sem citação.\n\nO tempo caiu de %d para %d dias, uma redução de %d%% [1]. O uso de machine learning cresceu [2,3].\n\nUma economia de %d registros foi relatada [4].\n\n## Referências\n1. Silva A. Texto [9].", "a", "b", "p", "n"
    )
    return d.withColumn("text", said)


_CLAIM_SQL = """t AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS doc, 50 + doc_id % 50 AS a, 10 + doc_id % 30 AS b, coalesce(n_chars, 0) AS n, coalesce(text, '') AS body,
    CASE WHEN doc_id % 5 = 0 THEN 5 ELSE (200 * ((50 + doc_id % 50) - (10 + doc_id % 30)) + 50 + doc_id % 50) // (2 * (50 + doc_id % 50)) END AS p FROM documents)"""


@query(
    f"""WITH {_CLAIM_SQL} SELECT doc, 1 AS paragraph, 0 AS ordinal, 'A' AS claim_type, '1' AS refs, CAST(a AS VARCHAR) || ',' || b || ',' || p AS points, true AS has_calculation FROM t
    UNION ALL SELECT doc, 1, 1, 'B', '2,3', '', false FROM t UNION ALL SELECT doc, 2, 0, 'A', '4', CAST(n AS VARCHAR), false FROM t"""
)
def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims.extract(_claim_texts(spark, sf_dir))
    points = F.transform("data_points", lambda x: x["value"].cast("long"))
    points = F.when(F.size(points) == 3, F.array(F.get(points, F.lit(1)), F.get(points, F.lit(2)), F.get(points, F.lit(0)))).otherwise(points)
    text_of = lambda x: F.array_join(F.transform(x, lambda n: n.cast("string")), ",")
    return c.select("doc", "paragraph", "ordinal", "claim_type", text_of(F.col("ref_numbers")).alias("refs"), text_of(points).alias("points"), "has_calculation")


@query(
    f"""WITH {_CLAIM_SQL}, c AS (SELECT *, lower(regexp_replace(body, '[0-9]', '', 'g')) || CASE doc_id % 3 WHEN 0 THEN ' in ' || a || ' days' WHEN 1 THEN ' some ' || (a * 6 // 5) ELSE '' END AS one,
      lower(body) || CASE WHEN doc_id % 4 = 0 THEN ' machine learning' ELSE '' END AS two, a * 6 // 5 AS x, doc_id % 2 = 0 AS whole FROM t),
    s AS (SELECT doc, 1 AS paragraph, 0 AS ordinal, CASE WHEN doc_id % 5 = 0 THEN 'MATH_ERROR' WHEN contains(one, CAST(a AS VARCHAR)) OR contains(one, CAST(b AS VARCHAR)) OR contains(one, p || '%') OR contains(one, p || ' %') OR contains(one, p || ' percent') THEN 'VERIFIED'
      WHEN doc_id % 3 = 1 AND (abs(x - a) <= 0.3 * a OR abs(x - b) <= 0.3 * b OR abs(x - p) <= 0.3 * p) THEN 'APPROXIMATE_MATCH' WHEN whole THEN 'NOT_FOUND_FULLTEXT' ELSE 'NOT_FOUND_ABSTRACT' END AS status FROM c
    UNION ALL SELECT doc, 1, 1, CASE WHEN contains(two, 'machine learning') THEN 'ENTITY_FOUND' WHEN whole THEN 'NOT_FOUND_FULLTEXT' ELSE 'NOT_FOUND_ABSTRACT' END FROM c
    UNION ALL SELECT doc, 2, 0, 'UNVERIFIABLE' FROM c)
    SELECT *, CASE status WHEN 'VERIFIED' THEN 'NONE' WHEN 'APPROXIMATE_MATCH' THEN 'LOW' WHEN 'ENTITY_FOUND' THEN 'LOW-MEDIUM' WHEN 'NOT_FOUND_ABSTRACT' THEN 'MEDIUM' WHEN 'UNVERIFIABLE' THEN 'UNKNOWN' ELSE 'HIGH' END AS risk FROM s"""
)
def claims_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited works are the documents' whole texts: the first without digits but for one number, the second with an
    entity in every fourth; a third is empty, a fourth missing."""
    t = _claim_texts(spark, sf_dir)
    i = F.col("i")
    near = F.floor(F.col("a") * 6 / 5).cast("string")
    one = F.concat(F.regexp_replace("body", "[0-9]", ""), F.when(i % 3 == 0, F.concat(F.lit(" in "), F.col("a").cast("string"), F.lit(" days"))).when(i % 3 == 1, F.concat(F.lit(" some "), near)).otherwise(""))
    two = F.concat("body", F.when(i % 4 == 0, " Machine Learning").otherwise(""))
    works = F.array(*[F.struct(F.lit(n).alias("number"), c.alias("content")) for n, c in ((1, one), (2, two), (3, F.lit("")))])
    level = F.when(i % 2 == 0, "full_text").otherwise("abstract").alias("source_level")
    contents = t.select("doc", level, F.explode(works).alias("w")).select("doc", "source_level", "w.*")
    return claims.verify(claims.extract(t), contents).select("doc", "paragraph", "ordinal", "status", "risk")


@query(
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^(\\*\\*(Link|Autores|Grade|Eixos|Acesso):.*|---.*)$\\n?', '', 'g'), 'https?://\\S+|10\\.\\d{4,}/\\S+', '', 'g') AS s FROM documents),
    p AS (SELECT *, CASE WHEN doc_id % 4 = 3 THEN 'nowhere \u00a7 to be found' ELSE substr(t, 3, 20) END AS q, doc_id % 3 = 0 AS quantitative, doc_id % 7 = 0 AS web FROM d),
    c AS (SELECT *, length(t) > 0 AND length(q) > 0 AS checked, contains(lower(s), lower(regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) AS hit FROM p)
    SELECT doc_id, CASE WHEN checked AND NOT hit THEN 'rejected' WHEN quantitative AND doc_id % 5 = 0 THEN 'rejected' WHEN quantitative THEN CASE WHEN web THEN 'verified_web' ELSE 'verified' END
      WHEN checked THEN CASE WHEN web THEN 'verified_web' ELSE 'verified' END WHEN web THEN 'unverifiable' ELSE 'context_supported' END AS status FROM c"""
)
def facts_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact from each document, with a short quote of it or of nowhere, and a value that its source's numbers have
    within 5 % but for every fifth."""
    i = F.col("doc_id")
    d = _whole(spark, sf_dir)
    value = (10 + i % 90).cast("double")
    pending = d.select(
        i, i.alias("ref_number"), F.when(i % 3 == 0, "quantitative").otherwise("qualitative").alias("fact_type"), F.when(i % 4 == 3, "nowhere \u00a7 to be found").otherwise(F.substring("text", 3, 20)).alias("exact_quote"), value.alias("value"),
        F.lit(None).cast("string").alias("derivation_formula"), F.lit(None).cast("array<double>").alias("source_values"), F.lit(None).cast("double").alias("stated_result"),
    )
    numbers_of = F.array(F.when(i % 5 == 0, value * 2).otherwise(value * 1.04))
    contents = d.select(i.alias("number"), F.col("text").alias("content"), F.when(i % 7 == 0, "web").otherwise("journal").alias("ref_type"), numbers_of.alias("numbers"))
    return facts.import_pending(pending, contents).select("doc_id", "status")


@query("SELECT min(event_id) AS seq FROM events GROUP BY user_id % 40, event_type, floor(value)")
def facts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quantitative facts of forty references, their type being the unit: the first of equal ones stays."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_seq"), (F.col("user_id") % 40).alias("ref_number"), F.lit("quantitative").alias("fact_type"), F.lit(None).cast("string").alias("exact_quote"),
        F.floor("value").cast("double").alias("value"), F.col("event_type").alias("unit"),
    )
    return facts.distinct_facts(rows).select(F.col("_seq").alias("seq"))


@query("SELECT l_orderkey * 10 + l_linenumber AS claim, l_extendedprice AS value, CASE WHEN count(p_partkey) FILTER (WHERE abs(p_retailprice - l_extendedprice) / l_extendedprice <= 0.05) > 0 THEN 'REGISTRADO' ELSE 'NAO_REGISTRADO' END AS status FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE l_extendedprice <> 0 GROUP BY 1, 2")
def facts_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").where("l_extendedprice <> 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("l_partkey").alias("ref_number"), F.lit(0).alias("at"), F.col("l_extendedprice").alias("value"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref_number"), F.col("p_retailprice").alias("value"), F.lit("quantitative").alias("fact_type"), F.col("p_partkey").alias("_seq"))
    return facts.cross_check(values, known).select("claim", "value", "status")


_AREAS = ("Epidemiology", "Education", "Surgery", "Oncology", "Law")
_HEALTH = ("Epidemiology", "Surgery", "Oncology")


@query(
    f"""WITH c AS (SELECT p_partkey // 17 AS issn, {list(_AREAS)}[p_size % 5 + 1] AS categoria, 'Q' || (p_partkey % 4 + 1) AS quartil, 2020 + p_size % 3 AS ano FROM part),
    l AS (SELECT DISTINCT issn, categoria, quartil FROM (SELECT *, max(ano) OVER (PARTITION BY issn) AS top FROM c) WHERE ano = top),
    g AS (SELECT issn, arg_min(categoria, quartil || categoria) AS categoria, min(quartil) AS quartil FROM l WHERE categoria IN {_HEALTH} GROUP BY 1), k AS (SELECT DISTINCT issn FROM l)
    SELECT CAST(s_suppkey AS VARCHAR) AS issn_l, CASE WHEN k.issn IS NULL THEN 'sem_dado' WHEN g.issn IS NULL THEN 'sem_categoria_saude' WHEN quartil IN ('Q1', 'Q2') THEN 'consolidado' ELSE 'nao_por_scimago' END AS porta_a_status,
    categoria AS porta_a_categoria, quartil AS porta_a_quartil, coalesce(quartil IN ('Q1', 'Q2'), false) OR s_suppkey % 7 = 0 AS consolidado
    FROM supplier LEFT JOIN k ON k.issn = s_suppkey LEFT JOIN g ON g.issn = s_suppkey"""
)
def journal_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as venues, parts as their subject categories by year."""
    k = F.col("s_suppkey").cast("string")
    base = table(spark, sf_dir, "supplier").select(k.alias("issn_l"), F.array(F.concat(F.lit("old-"), k), k).alias("issns"))
    p = table(spark, sf_dir, "part")
    area = F.element_at(F.array(*[F.lit(a) for a in _AREAS]), (F.col("p_size") % 5 + 1).cast("int"))
    cats = p.select(F.floor(F.col("p_partkey") / 17).cast("string").alias("issn"), area.alias("categoria"), F.concat(F.lit("Q"), (F.col("p_partkey") % 4 + 1).cast("string")).alias("quartil"), (2020 + F.col("p_size") % 3).alias("ano"))
    members = table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(k.alias("issn"), F.lit("t").alias("titulo"))
    health = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in _HEALTH])).alias("categoria"))
    return journals.verdict(base, cats, members, health).select("issn_l", "porta_a_status", "porta_a_categoria", "porta_a_quartil", "consolidado")


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS issn_l, CASE p_size % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.85::DOUBLE ELSE 0.45::DOUBLE END AS cons,
    least(1.0::DOUBLE, 0.5::DOUBLE * p_size / (SELECT max(p_size) FROM part) + 0.0::DOUBLE + CASE WHEN p_partkey % 5 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS fit,
    greatest(0.0::DOUBLE, 1 - p_retailprice / 5000.0::DOUBLE) AS apc, CASE WHEN p_partkey % 2 = 1 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS oa FROM part),
    q AS (SELECT issn_l, cons * 0.40::DOUBLE + fit * 0.25::DOUBLE + apc * 0.12::DOUBLE + oa * 0.08::DOUBLE + 0.3::DOUBLE * 0.08::DOUBLE + 0.4::DOUBLE * 0.07::DOUBLE AS s FROM p)
    SELECT issn_l, round_even(s, 4) AS score FROM q"""
)
def prescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    base = part.select(
        k.cast("string").alias("issn_l"), F.lit(None).cast("array<string>").alias("topicos"), F.when(F.col("p_size") % 3 == 2, "nao_por_scimago").otherwise("consolidado").alias("porta_a_status"),
        F.when(F.col("p_size") % 3 == 0, "Q1").when(F.col("p_size") % 3 == 1, "Q2").otherwise("Q3").alias("porta_a_quartil"), F.lit(None).cast("array<struct<categoria:string,quartil:string>>").alias("porta_a_categorias"),
        F.lit(False).alias("porta_b_scielo_sp"), F.col("p_retailprice").alias("apc_usd"), F.lit(None).cast("double").alias("apc_valor"), (k % 2).cast("int").alias("is_oa"),
        F.lit(None).cast("double").alias("citedness_2yr"), F.lit(None).cast("int").alias("medline_indexado"),
    )
    frequency = part.select(k.cast("string").alias("issn_l"), F.col("p_size").alias("n"))
    curated = part.where(k % 5 == 0).select(k.cast("string").alias("issn_l"))
    return journals.pre_score(base, "", frequency, curated).select("issn_l", F.col("pre_score").alias("score"))


@query(
    """WITH d AS (SELECT *, row_number() OVER (ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS n, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
    r AS (SELECT 2 * n - 1 AS seq, 'Study ' || doc_id AS title, 2 AS n_authors, CAST(1990 + doc_id % 30 AS INT) AS year, '10.1/' || doc_id AS doi, '1-9' AS pages, md5('in short ' || t) AS abstract, 'JOUR' AS pub_type FROM d
    UNION ALL SELECT 2 * n, 'Thesis ' || doc_id, 0, NULL, NULL, NULL, NULL, 'THES' FROM d)
    SELECT 'imp_' || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INT), '0') AS id, * EXCLUDE (seq) FROM r"""
)
def ris_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of two records and one without a title, its whole text being the first one's abstract."""
    i = F.col("doc_id").cast("string")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    year = (1990 + F.col("doc_id") % 30).cast("string")
    record = [F.lit("TY  - JOUR\nTI  - Study "), i, F.lit("\nAU  - Silva, A\nAU  - Souza, B\nPY  - "), year, F.lit("/05\nDO  - https://doi.org/10.1/"), i, F.lit("\nSP  - 1\nEP  - 9\nAB  - in short\n "), body]
    files = _whole(spark, sf_dir).select(F.lpad(i, 12, "0").alias("file"), F.concat(*record, F.lit("\nER  -\nTY  - THES\nT1  - Thesis "), i, F.lit("\nER  -\nTY  - JOUR\nAU  - No Title\n")).alias("text"))
    r = text_sources.ris(files, "imp")
    return r.select("id", "title", F.greatest(F.size(F.coalesce("authors", F.array())), F.lit(0)).alias("n_authors"), "year", "doi", "pages", F.md5("abstract").alias("abstract"), "pub_type")


def queries() -> dict[str, Query]:
    from . import more_queries  # noqa: F401  registers its own

    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
