"""Rules as tables of cases, and operators against sequential versions on random rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from refsift.functions import numbers, similarity, text
from refsift.operators import claims, dedup, facts, journals, keyed, records, reports, screening
from refsift.plans import review
from refsift.plans import scope as scopes
from refsift.schema import REFS, conformed
from refsift.sources import sinks, tables
from refsift.sources import text as sources
from refsift.streaming import pending


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def refs(spark, rows, **defaults):
    names = sorted({k for r in rows for k in r})
    kinds = {"_seq": "long", "year": "int", "authors": "array<string>", "citation_count": "long", "relevance": "int", "is_duplicate": "boolean", "doi_resolves": "boolean", "crossref_match": "boolean", "authors_verified": "boolean", "retracted": "boolean", "is_open_access": "boolean", "mapped_axes": "array<string>", "relevance_score": "double"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return conformed(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


# --- similarity ---


def slow_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abç") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == slow_lcs(a, b)
    assert similarity.indel_ratio("", "") == 100 and similarity.indel_ratio("ab", "") == 0
    assert similarity.partial_indel_ratio("bcd", "abcde") == 100 and similarity.partial_indel_ratio("", "x") == 0
    assert similarity.token_set_ratio_of("saúde pública revista", "revista saúde pública brasileira") == 100
    assert similarity.token_set_ratio_of("a b", "c d") < 50


def test_prefilter_is_sound(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("abcd")
        rows.append((a, "".join(b)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.may_reach(F.col("a"), F.col("b"), 80).alias("may"), similarity.indel(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["may"] for r in got if r["s"] >= 80) and all(r["s"] == pytest.approx(similarity.indel_ratio(r["a"], r["b"])) for r in got)


def test_cosine(spark):
    got = one(spark, a=similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0))), z=similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))))
    assert got["a"] == pytest.approx(0.5**0.5) and got["z"] == 0


# --- text and numbers ---


@pytest.mark.parametrize(("term", "string", "hit"), [("rea", "área de", False), ("rea", "a rea b", True), ("área", "na área!", True), ("c++", "c++x", True), ("c++", "c++ x", False), ("machine learning", "deep machine learning.", True), ("ai", "said", False)])
def test_terms(spark, term, string, hit):
    assert one(spark, x=text.has_term(F.lit(string), [term]))["x"] is hit


def test_text_functions(spark):
    got = one(
        spark,
        issn=text.norm_issn(F.lit(" 1234-567x ")), bad=text.norm_issn(F.lit("12")), host=text.host(F.lit("https://WWW.Example.com:80/x")), none=text.host(F.lit("no url")),
        suffixes=F.array_join(text.suffixes(F.lit("a.b.c")), " "), pmc=text.pmcid(F.lit("https://x/PMC/PMC123/")), tokens=text.tokens(F.lit("The héart of it, the HEART"), ["the"]),
        hash=text.content_hash(F.lit("head --- Body  TEXT ")), same=text.content_hash(F.lit("x---body text")),
    )
    assert (got["issn"], got["bad"], got["host"], got["none"], got["suffixes"]) == ("1234-567X", None, "example.com", None, "a.b.c b.c c")
    assert got["tokens"] == ["héart", "heart"] and got["hash"] == got["same"] and len(got["hash"]) == 16 and got["pmc"] == "PMC123"


@pytest.mark.parametrize(("raw", "value"), [("1.234,5", 1234.5), ("469,000", 469000.0), ("6,2", 6.2), ("469.000", 469.0), ("x", 0.0), ("1234,567", 1234.567)])
def test_pt_numbers(spark, raw, value):
    assert one(spark, x=numbers.pt_number(F.lit(raw)))["x"] == value


@pytest.mark.parametrize(("raw", "context", "value"), [("1,234.5", "", 1234.5), ("1.234,5", "", 1234.5), ("3,000", "", 3000.0), ("6,2", "", 6.2), ("2.5", "about 2.5 billion", 2.5e9), ("469", "469 mil", 469e3), ("7", "7 milhões", 7e6), ("1'000", "", 1000.0)])
def test_number_values(spark, raw, context, value):
    assert one(spark, x=numbers.number_value(F.lit(raw), F.lit(context)))["x"] == pytest.approx(value)


@pytest.mark.parametrize(("formula", "values", "stated", "ok"), [("percentage_reduction", [96, 26], 72.9, True), ("percentage_reduction", [96, 26], 65, False), ("percentage_increase", [100, 150], 50, True), ("ratio", [1, 0], 1, False), ("sum", [1, 2, 3], 6, True), ("difference", [5, 3], 2, True), ("cagr", [100, 121, 2], 10, True)])
def test_derivations(spark, formula, values, stated, ok):
    assert one(spark, x=numbers.derivation_holds(F.lit(formula), F.array(*[F.lit(float(v)) for v in values]), F.lit(float(stated))))["x"] is ok


# --- records ---


@pytest.mark.parametrize(
    ("row", "grade"),
    [
        ({"tier": "T1", "relevance": 2, "doi": "x"}, "gold"), ({"tier": "T3", "relevance": 2, "doi": "x"}, "silver"), ({"tier": "T2", "relevance": 1, "doi": "x"}, "silver"),
        ({"tier": "T3", "relevance": 1, "doi": "x"}, "bronze"), ({"tier": "T4", "relevance": 2, "doi": "x"}, "discard"), ({"tier": "T1", "relevance": 0, "doi": "x"}, "discard"),
        ({"tier": "T1", "relevance": 2}, "bronze"), ({"tier": "T1", "relevance": 2, "doi": "x", "retracted": True}, "discard"), ({"tier": "T1", "relevance": 2, "doi": "x", "access_status": "broken"}, "discard"),
        ({"tier": "T1", "relevance": 2, "doi": "x", "access_status": "restricted"}, "gold"), ({"tier": "T1", "relevance": 2, "doi": "x", "authors_verified": False}, "bronze"),
        ({"tier": "T1", "relevance": 2, "doi": "x", "doi_resolves": False}, "bronze"), ({"tier": "T1", "relevance": 2, "doi": "x", "doi_resolves": True, "crossref_match": False}, "bronze"),
        ({"tier": "UNKNOWN", "relevance": 2, "pmid": "1"}, "bronze"),
    ],
)
def test_grades(spark, row, grade):
    assert refs(spark, [{"_seq": 0, **row}]).select(records.grade().alias("g")).first()["g"] == grade


def test_conformed(spark):
    r = refs(spark, [{"_seq": 1, "title": "t"}])
    assert r.columns == [f.split(" ")[0] for f in REFS.split(", ")]
    assert r.first()["is_duplicate"] is False and r.first()["authors"] == [] and r.first()["title"] == "t"


def test_tiers(spark):
    dim = spark.createDataFrame([("gov.br", "T2"), ("saude.ba.gov.br", "T4"), ("doi.org", "T1")], "domain string, tier string")
    rows = [{"_seq": i, "url": u} for i, u in enumerate(["https://www.saude.ba.gov.br/x", "http://x.gov.br", "https://doi.org/1", "http://none.com", None, ""])]
    got = {r["_seq"]: r["tier"] for r in records.domain_tier(refs(spark, rows), dim).collect()}
    assert [got[i] for i in range(6)] == ["T4", "T2", "T1", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    more = [{"_seq": 0, "pmid": "1"}, {"_seq": 1, "pub_type": "Report"}, {"_seq": 2, "doi_resolves": True}, {"_seq": 3}]
    got = {r["_seq"]: (r["tier"], r["domain"]) for r in records.classify(refs(spark, more), dim).collect()}
    assert got == {0: ("T1", "pubmed"), 1: ("T3", None), 2: ("T1", None), 3: ("UNKNOWN", None)}


@pytest.mark.parametrize(("code", "again", "error", "url", "status"), [(200, None, None, "http://x", "accessible"), (403, 200, None, "http://x", "accessible"), (403, 403, None, "http://x", "restricted"), (404, None, None, "http://x", "broken"), (301, None, None, "http://x", "accessible"), (500, None, None, "http://x", "restricted"), (None, None, "timeout", "http://x", "timeout"), (None, None, "refused", "http://x", "broken"), (200, None, None, "ftp", "no_url")])
def test_probes(spark, code, again, error, url, status):
    assert one(spark, x=records.probe_status(F.lit(code).cast("int"), F.lit(again).cast("int"), F.lit(error).cast("string"), F.lit(url)))["x"] == status


def test_journal_titles(spark):
    cases = [("J Am Med Assoc", "Journal of the American Medical Association", True), ("Rev Saude Publica", "Revista de Saude Publica", True), ("Nature", "The Lancet", False), ("", "Nature", True), ("BMJ", "BMJ Open", True)]
    for stored, found, ok in cases:
        assert one(spark, x=records.same_journal(F.lit(stored), F.lit(""), F.lit(found)))["x"] is ok, stored


def test_authors(spark):
    rows = [(["Silva A.", "Souza B"], ["Silva A", "Souza B"]), (["Silva A"], ["Pereira Z"]), ([], ["X"]), (["X"], []), (["Silva A"], ["Silva A", "B C", "D E"])]
    got = records.compare_authors(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, authors array<string>, verified_authors array<string>")).orderBy("i").collect()
    assert [r["authors_ok"] for r in got] == [True, False, False, True, False] and got[0]["author_score"] == 100


def test_verify(spark):
    answers = tables.crossref(
        spark.read.json(spark.sparkContext.parallelize([json.dumps({"message": {"DOI": "10.1/X", "title": ["A study of things"], "author": [{"given": "Ana Maria", "family": "Silva"}, {"given": "x"}], "container-title": ["J X"], "volume": "2", "issue": "1", "update-to": [{"type": "correction"}], "assertion": [{"name": "Retracted"}]}})]))
    )
    rows = [{"_seq": 0, "doi": "10.1/x", "title": "A study of things", "authors": ["Silva AM"], "journal": "J X", "volume": "3"}, {"_seq": 1, "doi": "10.1/none", "title": "t"}]
    got = {r["_seq"]: r for r in records.verify(refs(spark, rows), answers).collect()}
    assert got[0]["doi_resolves"] and got[0]["crossref_match"] and got[0]["authors_verified"] and got[0]["verification_issues"] == ["volume"] and got[0]["retracted"] and got[0]["has_correction"]
    assert got[1]["doi_resolves"] is None and got[1]["crossref_match"] is None and got[1]["retracted"] is False


def test_validate(spark):
    rows = [{"_seq": 0, "id": "a", "title": "", "tier": "T1", "relevance": 2, "grade": "gold"}, {"_seq": 1, "id": "b", "title": "t", "doi": "x", "tier": "T1", "relevance": 2, "grade": "gold"}]
    assert {(r["id"], r["fault"]) for r in records.validate(refs(spark, rows)).collect()} == {("a", "no_title"), ("a", "no_doi_or_url"), ("a", "grade_differs")}


# --- deduplication ---


def test_exact_passes(spark):
    rows = [{"_seq": 0, "id": "a", "pmid": "1", "citation_count": 5}, {"_seq": 1, "id": "b", "pmid": "1", "doi": "10.1/x", "citation_count": 9}, {"_seq": 2, "id": "c", "doi": "https://doi.org/10.1/X"}, {"_seq": 3, "id": "d"}, {"_seq": 4, "id": "e", "doi": ""}]
    got = {r["id"]: r for r in dedup.exact(dedup.normalize_fields(refs(spark, rows))).collect()}
    assert got["a"]["doi"] == "10.1/x" and got["a"]["citation_count"] == 9 and not got["a"]["is_duplicate"]
    assert got["b"]["canonical_id"] == "a" and got["c"]["canonical_id"] == "a" and not got["d"]["is_duplicate"] and not got["e"]["is_duplicate"]


@pytest.mark.parametrize("seed", range(4))
def test_leaders(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(60)})
    near = {i: [a for a, b in edges if b == i] for i in range(n)}
    lead, want = set(), {}
    for i in range(n):
        mine = [a for a in near[i] if a in lead]
        if mine:
            want[i] = min(mine)
        else:
            lead.add(i)
    got = dedup.leaders(spark.createDataFrame(edges, "_seq_a long, _seq_b long")).collect()
    assert {r["_seq_b"]: r["leader"] for r in got} == want
    assert dedup.leaders(spark.createDataFrame([], "_seq_a long, _seq_b long")).count() == 0


def score(a, b):
    """The rule for a pair, written out."""
    t = similarity.indel_ratio(a["title"].lower(), b["title"].lower()) if a["title"] and b["title"] else 0
    if t < 80:
        return 0
    cost = 0
    if a["year"] and b["year"]:
        if abs(a["year"] - b["year"]) > 1:
            return 0
        cost = 2 * abs(a["year"] - b["year"])
    gain = 0
    if a["authors"] and b["authors"]:
        s = similarity.indel_ratio(a["authors"][0].lower(), b["authors"][0].lower())
        if s < 60:
            return 0
        gain = 5 if s >= 80 else 0
    return t - cost + gain


def test_fuzzy(spark):
    rng = random.Random(3)
    words = ["health", "digital", "hospital", "review", "learning", "care", "model"]
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.6:
            title = list(rng.choice(rows)["title"])
            for _ in range(rng.randint(0, 9)):
                title[rng.randrange(len(title))] = rng.choice("abcxyz ")
            title = "".join(title).strip() or "x"
        else:
            title = " ".join(rng.choice(words) for _ in range(5))
        rows.append({"_seq": i, "id": f"r{i}", "title": title, "year": rng.choice([None, 2020, 2021, 2022]), "authors": rng.choice([[], ["Silva A"], ["Silva B"], ["Khan Z"]]), "journal": "J"})
    alive, lead, suspects = {}, [], set()
    for i, b in enumerate(rows):
        mine = [j for j in lead if score(rows[j], b) >= 90]
        if mine:
            alive[i] = min(mine)
        else:
            lead.append(i)
    for i in lead:
        for j in range(i + 1, len(rows)):
            if 80 <= score(rows[i], rows[j]) < 90 and (j not in alive or alive[j] > i):
                suspects.add((f"r{i}", f"r{j}"))
    marked, pairs = dedup.fuzzy(refs(spark, rows))
    got = {r["id"]: r["canonical_id"] for r in marked.where("is_duplicate").collect()}
    assert got == {f"r{i}": f"r{j}" for i, j in alive.items()} and len(got) > 3
    assert {(r["ref_a"], r["ref_b"]) for r in pairs.collect()} == suspects


# --- screening ---

SCOPE = scopes.read_scope(
    {
        "modality": "revisao-integrativa",
        "research_question": "q",
        "keyword_blocks": [{"concept": "technology", "terms": ["machine learning"]}, {"concept": "application problem", "terms": ["bed"]}, {"concept": "domain", "terms": ["hospital"]}],
        "relevance_keywords": {"direct": ["triage"], "off_topic": ["plant"]},
    }
)


@pytest.mark.parametrize(
    ("row", "level", "method"),
    [
        ({"title": "Machine learning in the hospital"}, 2, "co_occurrence_2_blocks"), ({"title": "Bed triage"}, 2, "single_block_plus_direct_keyword"), ({"title": "Bed"}, 1, "single_block"),
        ({"title": "Triage"}, 1, "direct_keyword_only"), ({"title": "Nothing"}, 1, "default_include"), ({"title": None}, 1, "no_text"), ({"title": "Plant bed"}, 0, "exclusion_keyword"),
        ({"title": "Plant triage"}, 1, "direct_keyword_only"), ({"title": "Hospital", "pub_type": " Letter "}, 0, "pub_type_excluded"), ({"title": "Bed", "llm_verdict": "include"}, 2, "single_block|llm_include"),
        ({"title": "Bed", "llm_verdict": "exclude"}, 1, "single_block|llm_divergent_exclude"), ({"title": "Bed", "llm_verdict": "maybe"}, 1, "single_block|llm_maybe"),
        ({"title": "x", "pub_type": "letter", "llm_verdict": "include"}, 0, "pub_type_excluded"),
    ],
)
def test_screening(spark, row, level, method):
    got = screening.screen(refs(spark, [{"_seq": 0, **row}]), SCOPE).first()
    assert (got["relevance"], got["relevance_method"]) == (level, method)


def test_review_of_reviews(spark):
    from dataclasses import replace

    rows = [{"_seq": 0, "title": "A scoping review of hospital machine learning"}, {"_seq": 1, "title": "Hospital machine learning"}, {"_seq": 2, "title": "Hospital", "pub_type": "Review"}]
    got = screening.screen(refs(spark, rows), replace(SCOPE, modality="meta-revisao")).orderBy("_seq").collect()
    assert [r["relevance_method"] for r in got] == ["co_occurrence_2_blocks", "nao_e_revisao", "single_block"]


def test_kappa(spark):
    def of(rows):
        return screening.kappa(spark.createDataFrame(rows, "one string, two string")).first()

    i, e = "include", "exclude"
    assert of([(i, i), (e, e)])["kappa"] == 1 and of([(i, i)])["kappa"] is None and of([(i, i), (i, i)])["kappa"] == 1
    got = of([(i, i)] * 20 + [(i, e)] * 5 + [(e, i)] * 10 + [(e, e)] * 15)
    assert got["kappa"] == pytest.approx(0.4) and got["label"] == "fair"


def test_landmarks(spark):
    rng = random.Random(4)
    for n in (0, 3, 10, 25, 200):
        values = [rng.randint(0, 60) for _ in range(n)]
        full = sorted((v for v in values if v), reverse=True)
        want = full[max(0, len(full) // 10 - 1)] if full else None
        got = screening.landmark_threshold(spark.createDataFrame([(v,) for v in values], "citation_count long")).first()
        assert got["threshold"] == want


def test_verdicts(spark, tmp_path):
    path = tmp_path / "v.jsonl"
    path.write_text('{"id": "a", "verdict": "include"}\nno json\n{"id": "b", "verdict": "sure"}\n{"id": "a", "verdict": "exclude", "reason": "r"}\n{"verdict": "maybe"}\n')
    good, bad = sources.verdicts(spark, str(path))
    assert sorted(r["reason"] for r in bad.collect()) == ["no JSON", "no id", "unknown verdict"]
    got = {r["id"]: r for r in screening.merge_verdicts(refs(spark, [{"_seq": 0, "id": "a"}, {"_seq": 1, "id": "c"}]), good).collect()}
    assert got["a"]["llm_verdict"] == "exclude" and got["a"]["llm_reason"] == "r" and got["c"]["llm_verdict"] is None


# --- keyed, reports, journals ---


def test_band_join_by_brute_force(spark):
    rng = random.Random(5)
    a = [(rng.randint(0, 3), rng.choice([0.0, -1, 1]) * rng.uniform(0.001, 500)) for _ in range(80)]
    b = [(rng.randint(0, 3), rng.choice([0.0, -1, 1]) * rng.uniform(0.001, 500)) for _ in range(80)]
    got = keyed.band_join(spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "i int, k int, w double"), spark.createDataFrame([(j, *r) for j, r in enumerate(b)], "j int, k int, v double"), "k", "w", "v", 0.3)
    want = sorted((i, j) for i, (k, w) in enumerate(a) for j, (m, v) in enumerate(b) if k == m and w and v and abs(v - w) / abs(w) <= 0.3)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, n string, v double")
    new = spark.createDataFrame([(2, None, 9.0, "x"), (3, "c", None, "y")], "k int, n string, v double, more string")
    assert sorted(tuple(r) for r in keyed.upsert(old, new, "k").collect()) == [(1, "a", 1.0, None), (2, "b", 9.0, "x"), (3, "c", None, "y")]


def test_coverage_and_flow(spark):
    rows = [{"_seq": i, "id": str(i), "grade": g, "mapped_axes": x, "relevance": 2} for i, (g, x) in enumerate([("gold", ["a"]), ("gold", ["a", "b"]), ("silver", ["a"]), ("bronze", ["b"])])]
    got = {r["axis"]: (r["total"], r["gold"], r["silver"], r["status"]) for r in reports.coverage(refs(spark, rows), ["a", "b", "c"]).collect()}
    assert got == {"a": (3, 2, 1, "adequate"), "b": (1, 1, 0, "insufficient"), "c": (0, 0, 0, "none")}
    flow = reports.flow(refs(spark, [{"_seq": 0, "relevance": 2, "grade": "gold"}, {"_seq": 1, "is_duplicate": True}, {"_seq": 2, "relevance": 0}, {"_seq": 3, "relevance": 2, "grade": "silver"}]), "pesquisa-base").first()
    assert (flow["identified"], flow["duplicates"], flow["screened"], flow["excluded_screening"], flow["included"]) == (4, 1, 3, 1, 2)


def test_prescore_order(spark):
    rows = [("1", ["saúde digital"], "consolidado", "Q1", False, 0.0, 0.0, 1, 5.0, 1), ("2", None, "sem_dado", None, True, None, None, None, None, None), ("3", None, "sem_categoria_saude", None, False, 9000.0, None, 0, 1.0, 0)]
    base = spark.createDataFrame(rows, "issn_l string, topicos array<string>, porta_a_status string, porta_a_quartil string, porta_b_scielo_sp boolean, apc_usd double, apc_valor double, is_oa int, citedness_2yr double, medline_indexado int")
    base = base.withColumn("porta_a_categorias", F.lit(None).cast("array<struct<categoria:string,quartil:string>>"))
    got = journals.finalists(journals.pre_score(base, "saúde digital", spark.createDataFrame([("1", 3)], "issn_l string, n int"), spark.createDataFrame([("1",)], "issn_l string"))).collect()
    assert [r["issn_l"] for r in got] == ["1", "2", "3"] and got[0]["flags"] == [] and "porta_b" in got[1]["flags"]


# --- sources and sinks ---


def test_strata_file(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("ISSN;Título;Área de Avaliação;Estrato\n1234-5678;A;Saúde;A2\n12345678;A bis;Direito;A1\n1111-222x;B;Saúde;B1\nbad;C;Saúde;A1\n2222-3333;D;Saúde;Z9\n", encoding="utf-8")
    got, bad = tables.strata(spark, str(path))
    assert {r["issn"]: (r["titulo"], r["estrato"], r["areas"], r["conflicts"]) for r in got.collect()} == {"1234-5678": ("A", "A1", ["Direito", "Saúde"], 1), "1111-222X": ("B", "B1", ["Saúde"], 0)}
    assert bad.first()["invalid"] == 2


def test_scimago_file(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Rank;Title;Issn;SJR;SJR Best Quartile;H index\n1;J One;"12345678, 87654321";1,25;Q1;10\n2;J Two;-;x;-;y\n', encoding="utf-8")
    got = tables.scimago(spark, str(path), 2025).collect()
    assert {(r["issn"], r["ano"], r["sjr"], r["h_index"]) for r in got} == {("1234-5678", 2025, 1.25, 10), ("8765-4321", 2025, 1.25, 10)}
    with pytest.raises(ValueError):
        tables.scimago(spark, str(path))


def test_curated_list(spark):
    note = "## A1\n- **Revista X** — escopo dela. Taxa: US$ 100. [Link](http://x)\n## Notas\n- **Y** - outro\n- sem título\n"
    got = sources.curated_list(spark.createDataFrame([("f", note)], "file string, text string")).orderBy("line").collect()
    assert [(r["titulo"], r["estrato_origem"], r["escopo_texto"], r["apc_texto"], r["url"]) for r in got] == [("Revista X", "A1", "escopo dela", "US$ 100", "http://x"), ("Y", None, "outro", None, None)]


def test_numbered_references(spark):
    note = "# T\n## Referências\n1. Dash S, Silva A. Big data. J Big Data. 2019;6(1):1-25. DOI: 10.1186/s1.\n2. Brasil. Lei nº 1. Diário Oficial.\n3. WHO. Page. Disponível na Internet: https://who.int/x (acesso)\n"
    got = {r["number"]: r for r in sources.numbered_references(spark.createDataFrame([("f", note)], "file string, text string")).collect()}
    one_ = got[1]
    assert (one_["authors_str"], one_["title"], one_["journal"], one_["year"], one_["volume"], one_["issue"], one_["pages"], one_["doi"]) == ("Dash S, Silva A", "Big data", "J Big Data", "2019", "6", "1", "1-25", "10.1186/s1")
    assert (got[2]["ref_type"], got[3]["ref_type"], got[3]["url"]) == ("legislation", "web", "https://who.int/x")


def test_import_appends(spark):
    base = refs(spark, [{"_seq": 0, "id": "imp_0001", "title": "t"}])
    new = sources.ris(spark.createDataFrame([("f", "TY  - JOUR\nTI  - One\nER  -\nTI  - Two\n")], "file string, text string"), "imp")
    again = sources.append_unique(base, new)
    assert sorted(r["id"] for r in again.collect()) == ["imp_0001", "imp_0001b", "imp_0002"]
    assert sorted(r["id"] for r in sources.append_unique(again, new).collect())[-2:] == ["imp_0002", "imp_0002b"]


def test_records_file(spark, tmp_path):
    path = tmp_path / "refs.json"
    path.write_text(json.dumps({"metadata": {}, "references": [{"id": "a", "title": "T", "authors": ["X"]}, {"id": "b", "title": "U", "authors": []}]}, indent=1))
    got = tables.records_json(spark, str(path)).orderBy("_seq").collect()
    assert [r["id"] for r in got] == ["a", "b"] and got[0]["authors"] == ["X"] and got[1]["is_duplicate"] is False


def test_sinks(spark, tmp_path):
    rows = [{"_seq": 0, "id": "x_1234", "title": "On {braces}", "authors": ["Silva, A"], "year": 2020, "journal": "J", "abstract": "a {b}", "grade": "gold"}, {"_seq": 1, "id": "y", "grade": "discard"}]
    r = refs(spark, rows)
    got = sinks.bibtex(r, ("gold",)).collect()
    assert len(got) == 1 and got[0]["entry"].startswith("@article{Silva20201234,\n  title = {On {braces}}") and "a \\{b\\}" in got[0]["entry"]
    sinks.write_records(r, str(tmp_path), "final")
    assert spark.read.parquet(str(tmp_path / "final")).count() == 2 and spark.read.json(str(tmp_path / "final.metadata")).first()["total_refs"] == 2
    assert "| gold | 1 |" in sinks.markdown_table(r.groupBy("grade").count())
    assert one(spark, x=sinks.file_name(F.lit(2020), F.array(F.lit("Silva A")), F.lit("The use of DATA in care")))["x"] == "2020_Silva_UseDataCare"


def test_query_strings():
    s = scopes.Scope(blocks=(scopes.Block("a", ("x y", "z")), scopes.Block("b", ("w",))), mesh=("M",), years=(2020, 2024), languages=("en",), modality="meta-revisao")
    q = scopes.pubmed_query(s)
    assert q.startswith('(("x y"[Title/Abstract] OR "z"[Title/Abstract]) AND ("w"[Title/Abstract])) AND ("M"[MeSH Terms])') and "systematic[sb]" in q and "2020:2024" in q
    assert scopes.pubmed_query(scopes.Scope()) == "" and "systematic[sb]" not in scopes.pubmed_fallback(s)
    assert scopes.openalex_query(s) == "x y z w" and scopes.semantic_scholar_query(s) == '("x y" | z) + (w)' and "2020-01-01" in scopes.europe_pmc_query(s)
    assert scopes.read_scope({"fields_of_study": []}).fields_of_study == () and scopes.read_scope({}).fields_of_study == ("Medicine",)
    assert scopes.environment(["A='1'", "# c", "B=2"], {"B": "3", "C": "4"}) == {"A": "1", "B": "3"}


# --- claims and facts ---


@pytest.mark.parametrize(("string", "kind"), [("cresceu 85%", "A"), ("custou R$ 5", "A"), ("os 5 Vs do tema", "C"), ("usa LSTM na rede", "B"), ("tema geral", "C"), ("de 96 para 26", "A")])
def test_claim_types(spark, string, kind):
    assert one(spark, x=claims.claim_type(F.lit(string)))["x"] == kind


def test_data_points(spark):
    got = one(spark, x=claims.data_points(F.lit("6,2% e 6,2%, 3,4 bilhões de reais, 96 para 26 dias, 40 leitos, 2019 para 2021")))["x"]
    assert [(p["value"], p["unit"], p["percent"]) for p in got] == [(6.2, "%", True), (3.4e9, "bilhões reais", False), (96.0, "dias", False), (26.0, "dias", False), (40.0, "leitos", False)]


def test_approximate(spark):
    got = one(spark, a=claims.approximate(F.lit(400000.0), F.lit("in 2019 [15] some 420 thousand")), b=claims.approximate(F.lit(10.0), F.lit("20 and 30")), c=claims.approximate(F.lit(0.0), F.lit("0")))
    assert (got["a"], got["b"], got["c"]) == (420000.0, None, None)


def test_number_candidates(spark):
    contents = spark.createDataFrame([(1, "# T\n**Link:** http://x/99\n---\nIn 2019 we saw 1,234 patients [12] and many more people later on, 5% of all, then 7 of them. 0 left.")], "number int, content string")
    got = {r["raw"]: r["value"] for r in facts.number_candidates(contents).collect()}
    assert got == {"5": 5.0} or got == {"1,234": 1234.0, "5": 5.0}


def test_stream(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "a.json").write_text('{"ref_number": 1, "fact_type": "conceptual", "statement": "s"}\n')
    contents = spark.createDataFrame([(1, "", "journal", [])], "number int, content string, ref_type string, numbers array<double>")
    for name in ("a", "b"):
        (drop / f"{name}.json").write_text('{"ref_number": 1, "fact_type": "conceptual", "statement": "s"}\n')
        pending.drain(spark, str(drop), str(tmp_path / "check"), str(tmp_path / "out"), lambda b: facts.import_pending(b, contents)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and {r["status"] for r in got.collect()} == {"context_supported"}


def test_review_resumes(spark, tmp_path):
    rows = [{"_seq": i, "id": f"r{i}", "title": t, "pmid": str(i), "year": 2024} for i, t in enumerate(["Machine learning in the hospital", "Bed", "Hospital machine learning triage", "Machine learning in the hospital"])]
    plan = review.stages(SCOPE, spark.createDataFrame([("doi.org", "T1")], "domain string, tier string"))
    out = review.run(spark, refs(spark, rows), str(tmp_path), plan)
    got = {r["id"]: r for r in out.collect()}
    assert got["r3"]["is_duplicate"] and got["r3"]["canonical_id"] == "r0" and got["r0"]["grade"] == "gold" and got["r0"]["final"] and got["r1"]["grade"] == "silver"
    again = review.run(spark, None, str(tmp_path), plan, start="screened")
    assert again.count() == 4
