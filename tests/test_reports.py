"""Reports, look-ups of venues, numbered references, facts registry, commands."""

import json

import pytest
from pyspark.sql import functions as F

from refsift import cli, data
from refsift.functions import numbers, text
from refsift.operators import claims, enrich, facts, journals, records, reports, vancouver, venues, written
from refsift.plans.scope import Axis, Block, Scope, query_text, read_scope
from refsift.schema import conformed
from refsift.sources import sinks, tables
from refsift.sources import text as texts

SCOPE = Scope(project="p", modality="revisao-sistematica", blocks=(Block("x", ("a",)),), axes=(Axis("one", ("a",), ()), Axis("two", ("b",), ())))


def refs(spark, rows):
    """rows: dicts; _seq runs."""
    lines = [json.dumps({"_seq": i, "id": f"r{i}", **r}) for i, r in enumerate(rows)]
    from refsift.schema import REFS

    return conformed(spark.createDataFrame([(x,) for x in lines], "v string").select(F.from_json("v", REFS).alias("r")).select("r.*"))


def lines(report):
    return [r["line"] for r in written.ordered(report).collect()]


ROWS = [
    {"title": "Gold one", "grade": "gold", "relevance": 2, "tier": "T1", "doi": "10.1/a", "source_api": "pubmed", "relevance_score": 3.0, "mapped_axes": ["one"], "authors": ["Silva A", "Souza B"], "access_status": "restricted", "citation_count": 5, "year": 2020},
    {"title": "Gold two", "grade": "gold", "relevance": 2, "tier": "T2", "doi": "10.1/b", "source_api": "pubmed", "relevance_score": 9.0, "mapped_axes": ["one", "two"], "authors": [], "access_status": "accessible", "is_canonical": True},
    {"title": "Left open", "grade": "bronze", "relevance": 1, "tier": "T1", "source_api": "", "access_status": "no_url"},
    {"title": "Off", "grade": "discard", "relevance": 0, "relevance_method": "no_match", "tier": "T4", "doi": "10.1/c"},
    {"title": "Copy", "is_duplicate": True, "relevance": 2, "source_api": "openalex", "grade": "ungraded"},
    {"title": "Broken", "grade": "discard", "relevance": 1, "tier": "T3", "access_status": "broken", "doi": "10.1/d", "retracted": True, "has_correction": True},
]


def test_audit_and_flow(spark):
    r = refs(spark, ROWS)
    audit = lines(written.audit(r, SCOPE))
    for wanted in ("| identified | 6 |", "| after deduplication | 5 |", "| duplicates | 1 |", "| retracted | 1 |", "| corrected | 1 |", "| GOLD | 2 | 40.0% |", "| T1 | 2 | 40.0% | peer-reviewed |", "| pubmed | 2 |"):
        assert wanted in audit
    assert any(x.startswith("> ALERT: T1 is at 40%") and "70%" in x for x in audit)
    assert "| r2 | Left open | - | unverifiable |" in audit and "| r3 | Off | off_topic |" in audit
    gold = [x for x in audit if x.startswith("| ") and "Gold " in x]
    assert [x.split(" | ")[2] for x in gold] == ["Gold two", "Gold one"] and gold[1].startswith("| Silva A et al. | 2020 |")
    assert audit.index("## Grades") < audit.index("| GOLD | 2 | 40.0% |") < audit.index("## Tiers")
    flow = lines(written.flow(r, SCOPE))
    assert "Standard: PRISMA 2020" in flow and "| seed/manual | 3 |" in flow and "| total | 6 |" in flow and "| no_match | 1 |" in flow
    assert "- not retrieved: 1" in flow and "- included: 3" in flow and "  - gold: 2" in flow
    many = r.crossJoin(spark.range(60).select(F.col("id").alias("_n"))).withColumns({"_seq": F.col("_seq") * 100 + F.col("_n")}).drop("_n")
    assert "and 70 more" in lines(written.audit(many, SCOPE))


def test_lists(spark, tmp_path):
    r = refs(spark, ROWS).withColumn("final", F.col("grade") == "gold")
    assert lines(written.to_obtain(r))[1].startswith("- **Gold one**") and lines(written.to_obtain(r.limit(0))) == []
    brief = lines(written.brief(r, SCOPE))
    assert [x for x in brief if x[0].isdigit()] == [
        "1. **Gold two** — , https://doi.org/10.1/b", "2. **Gold one** — Silva A, Souza B, 2020, https://doi.org/10.1/a", "3. **Gold two** — , https://doi.org/10.1/b",
    ]
    assert "| one | 2 | 0 | 2 | insufficient |" in lines(written.coverage(r, SCOPE))
    assert sum("selected" in x for x in lines(written.validation(r, SCOPE))) == 4
    told = r.withColumn("verification_issues", F.when(F.col("_seq") == 0, F.array(F.lit("journal"))).otherwise(F.array().cast("array<string>"))).withColumn("doi_resolves", F.lit(True))
    found = lines(written.verification(told))
    assert "| journal_mismatched | 1 |" in found and "| r0 | Gold one | 10.1/a | journal |" in found and "| resolved | 4 |" in found
    written.write(written.coverage(r, SCOPE), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == len(lines(written.coverage(r, SCOPE)))
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(1001))


def test_brief_numbers_run_on(spark):
    rows = [{"title": f"t{i}", "mapped_axes": ["two"] if i % 3 else ["one", "two"], "relevance_score": float(i % 5)} for i in range(12)]
    r = refs(spark, rows).withColumn("final", F.lit(True))
    got = [(x["number"], x["axis"], x["id"]) for x in reports.brief(r, ["one", "two"]).orderBy("number").collect()]
    want, n = [], 0
    for axis in ("one", "two"):
        for i in sorted((i for i in range(12) if axis in rows[i]["mapped_axes"]), key=lambda i: (-(i % 5), i)):
            n += 1
            want.append((n, axis, f"r{i}"))
    assert got == want


def test_claims_report(spark):
    md = "Intro.\n\nA taxa caiu 40 % [1]. O XGBoost reduziu custos [2].\n\nConceito geral de gestão hospitalar integrada [3].\n\n## Referências\n1. x"
    told = claims.verify(claims.extract(spark.createDataFrame([("d", md)], "doc string, text string")), spark.createDataFrame([("d", 1, "nothing at all", "full_text")], "doc string, number int, content string, source_level string"))
    out = "\n".join(lines(written.claims(told)))
    assert "| NOT_FOUND_FULLTEXT | 1 | HIGH |" in out and out.index("## Risk HIGH") < out.index("### [1] NOT_FOUND_FULLTEXT") < out.index("## Risk UNKNOWN")
    assert written.blocking(told) and not written.blocking(told.where("risk <> 'HIGH'"))
    row = sinks.claim_rows(told).where("status = 'NOT_FOUND_FULLTEXT'").first()
    assert row["data_points"][0]["is_percentage"] and row["layer2_verdict"] is None


def test_numbered_references(spark):
    md = "# T\n\n## Referências\n" + "\n".join(
        [
            "1. Silva AB, Souza C. A title of a work. Rev Saude Publica. 2020;54(2):10. DOI: 10.1/a",
            "2. Silva AB, Souza C. A title of a work. Rev Saude Publica. 2020;55(2):10. DOI: 10.1/a",
            "3. Outro X. Another work here. Journal of Things. 2019;1(1):1.",
            "4. Brasil. Lei nº 8080. Diário Oficial da União. 1990.",
            "5. Outro X. Third work here. Journal of Things. 2019;1(1):1. DOI: 10.1/zz",
        ]
    )
    entries = texts.numbered_references(spark.createDataFrame([("f", md)], "file string, text string"))
    answers = spark.createDataFrame([("10.1/A", ["Silva AB", "Souza C"], "Rev Saude Publica", "Revista de Saude Publica", "54", "2", "crossref")], "doi string, found_authors array<string>, found_journal string, found_journal_full string, found_volume string, found_issue string, source string")
    none = spark.createDataFrame([], "number int, found_doi string"), spark.createDataFrame([], "number int, found_pmid string")
    told = vancouver.verify(vancouver.identified(entries, *none), answers)
    got = {r["number"]: (r["status"], r["issues"]) for r in told.collect()}
    assert got == {1: ("ok", []), 2: ("mismatch", ["volume"]), 3: ("no_doi", []), 4: ("skipped", []), 5: ("error", [])}
    assert vancouver.tally(told).first().asDict() == {"ok": 1, "mismatch": 1, "skipped": 1, "no_doi": 1, "pmid_only": 0, "error": 1} and vancouver.failed(told)
    assert [r["key"] for r in vancouver.title_wanted(entries).collect()] == [3]
    found = spark.createDataFrame([(3, "99")], "number int, found_pmid string")
    assert vancouver.verify(vancouver.identified(entries, none[0], found), answers).where("status = 'pmid_only'").first()["number"] == 3
    out = lines(written.references(told, "x.md"))
    assert "| mismatch | 1 |" in out and out.index(next(x for x in out if x.startswith("| 2 | mismatch"))) < out.index(next(x for x in out if x.startswith("| 1 | ok")))


def test_text_references(spark):
    md = "x\n# References\n\n1. Silva A. The long title of the first work. J. 2020\n[2] Souza B, et al. Short. 2019\nnot one\nMüller is no match but Santos is long enough to be one of them\nSantos C is long enough to be one of these references.\n# End\n3. After. The end of all things comes here."
    got = texts.text_references(spark.createDataFrame([("f", md)], "file string, text string")).orderBy("at").collect()
    assert [(r["title"], r["author"]) for r in got] == [
        ("The long title of the first work", "Silva"), ("Souza B, et al. Short. 2019", "Souza"), ("Santos C is long enough to be one of these references.", "Santos"),
    ]
    many = "# Referências\n" + "\n".join(f"{i}. Autor A. Um título longo o bastante aqui." for i in range(1, 40))
    files = spark.createDataFrame([("f", many)], "file string, text string")
    assert texts.text_references(files).count() == 20 and texts.text_references(files, None).count() == 39


def test_venues(spark):
    base = spark.createDataFrame([("1111-1111", ["1111-1111", "2222-2222"], "One"), ("2222-2222", ["2222-2222"], "Two"), ("3333-3333", ["3333-3333", "4444-4444"], "Three")], "issn_l string, issns array<string>, titulo string")
    wanted = spark.createDataFrame([("2222-2222",), ("4444-4444",), ("9999-9999",)], "issn string")
    assert {r["issn"]: r["issn_l"] for r in venues.by_issn(wanted, base).collect()} == {"2222-2222": "2222-2222", "4444-4444": "3333-3333"}
    schema = "titulo string, rank int, name string, issn_l string, issns array<string>"
    titles = spark.createDataFrame([("Cadernos de Saude",), ("Revista Nova",), ("Nada",)], "titulo string")
    openalex = spark.createDataFrame([("Cadernos de Saude", 0, "Saude Cadernos de", "a", ["a"]), ("Cadernos de Saude", 1, "Cadernos de Saude", "b", ["b"]), ("Revista Nova", 0, "Something", "c", ["c"])], schema)
    crossref = spark.createDataFrame([("Cadernos de Saude", 0, "Cadernos de Saude", "z", ["z"]), ("Revista Nova", 0, "Revista Nova", "d", ["d"]), ("Nada", 0, "Other words", "e", ["e"])], schema)
    got = {r["titulo"]: (r["issn_l"], r["via"]) for r in venues.by_title(titles, openalex, crossref).collect()}
    assert got == {"Cadernos de Saude": ("a", "openalex"), "Revista Nova": ("d", "crossref"), "Nada": (None, None)}
    entries = titles.withColumns({"file": F.lit("f"), "line": F.lit(1), "url": F.lit("u")})
    told, found = venues.seed(entries, "o", openalex, crossref, F.lit("2026-01-01").cast("date"))
    assert told.count() == 3 and {r["issn_l"]: r["titulo"] for r in found.collect()} == {"a": "Cadernos de Saude", "d": "Revista Nova"}
    mesh = spark.createDataFrame([("Heart ", "Heart Failure", "u1"), ("Heart ", "heart", "u2"), ("Heart ", "", "u3"), ("x", "B", "u"), ("x", "A", "u")], "term string, label string, uri string")
    assert [(r["label"], r["exact"]) for r in venues.descriptors(mesh).where("term = 'Heart '").orderBy("position").collect()] == [("heart", True), ("Heart Failure", False)]
    assert "- heart (exact)" in lines(written.descriptors(venues.descriptors(mesh)))
    flags = {r["issn"]: r["indexed"] for r in venues.currently_indexed(spark.createDataFrame([("a", "2"), ("b", "0"), ("c", "?")], "issn string, count string")).collect()}
    assert flags == {"a": True, "b": False, "c": None}
    assert venues.search_terms([["a", "b", ""], ["b", "c"]]) == ["a", "b", "c"]


def test_consultation():
    assert venues.consultation("t", '{"tema": "p"}')["tema"] == "p" and venues.consultation("t", None, "# m")["tema"] == "t"
    told = venues.consultation(manuscript="intro\n## The *title*\n" + "w " * 200)["tema"]
    assert told.startswith("The *title*. intro The title w w") and len(told.split()) == 122
    for bad in ({}, {"profile": '{"x": 1}'}):
        with pytest.raises(ValueError):
            venues.consultation(**bad)


def test_recommend(spark):
    fields = "issn_l string, titulo string, topicos array<string>, porta_a_status string, porta_a_quartil string, porta_b_scielo_sp boolean, porta_a_categorias array<struct<categoria:string,quartil:string>>, apc_usd double, apc_valor double, is_oa int, citedness_2yr double, medline_indexado int"
    base = spark.createDataFrame([("a", "A", ["Health"], "consolidado", "Q1", False, [], 0.0, None, 1, 5.0, 1), ("b", "B", [], "sem_dado", None, False, [], None, None, None, None, None)], fields)
    works = spark.createDataFrame([("a", 1), ("a", 2), ("n", 3)], "issn_l string, _seq long")
    best, missing = venues.recommend({"tema": "health services"}, works, base, spark.createDataFrame([("b",)], "issn_l string"))
    assert [r["issn_l"] for r in best.collect()] == ["a", "b"] and [r["issn_l"] for r in missing.collect()] == ["n"]
    report = lines(written.venues(best, missing))
    assert report[2].startswith("- **A** ") and "- n: no row in the base" in report
    groups = base.select(venues.standing(F.col("porta_a_status"), F.col("porta_a_quartil"), F.col("porta_b_scielo_sp")).alias("s"))
    assert [r["s"] for r in groups.collect()] == ["Q1", "no data"]


def test_fixed_tables(spark):
    tiers, cats = data.domain_tiers(spark), data.health_categories(spark)
    assert {r["tier"]: r["n"] for r in tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()} == {"T1": 87, "T2": 35, "T3": 40, "T4": 41}
    assert cats.count() == cats.distinct().count() == 80
    urls = spark.createDataFrame([("https://saude.ba.gov.br/x",), ("http://www.x.gov.br",), ("https://sub.scielo.br/a",), ("https://a.b.unknown",)], "url string")
    assert [r["tier"] for r in records.domain_tier(urls, tiers).orderBy(F.desc("url")).collect()] == ["T1", "T4", "UNKNOWN", "T2"]
    j = spark.createDataFrame([("a", ["a"])], "issn_l string, issns array<string>")
    c = spark.createDataFrame([("a", "Epidemiology", "Q2", 2024), ("a", "Library and Information Sciences", "Q1", 2024)], "issn string, categoria string, quartil string, ano int")
    row = journals.verdict(j, c, spark.createDataFrame([], "issn string, titulo string"), cats).first()
    assert (row["porta_a_status"], row["porta_a_categoria"], row["porta_a_quartil"]) == ("consolidado", "Epidemiology", "Q2")


def test_rescue_and_integrity(spark):
    r = refs(spark, [{"title": "A study of things in places", "year": 2020}, {"title": "Another study of things", "year": 2020}, {"title": "Known", "doi": "10.1/k"}, {"title": "Lost for good"}, {"title": "Copy", "is_duplicate": True}])
    schema = "key long, rank int, title string, year int, value string"
    pubmed = spark.createDataFrame([(0, 0, "A study of thinks in places", 2021, "77"), (1, 0, "Another study of things", 2010, "78")], schema)
    crossref = spark.createDataFrame([(0, 0, "A study of things in places", 2020, "10.1/no"), (1, 0, "nothing alike", 2020, "10.1/x"), (1, 1, "Another study of things", None, "10.1/y"), (1, 2, "Another study of things", 2020, "10.1/z")], schema)
    got = {x["_seq"]: x for x in records.rescue_by_title(records.rescue_by_title(r, pubmed, crossref), pubmed, crossref).collect()}
    assert (got[0]["pmid"], got[0]["doi"], got[0]["verified_via"]) == ("77", None, "title-pubmed")
    assert (got[1]["doi"], got[1]["verified_via"]) == ("10.1/y", "title-crossref")
    assert got[3]["verification_issues"] == [records.NOWHERE] and got[2]["verification_issues"] == [] == got[4]["verification_issues"]
    answers = spark.createDataFrame([("10.1/K", True, True, False)], "doi string, resolves boolean, is_retracted boolean, was_updated boolean")
    whole = {x["_seq"]: (x["retracted"], x["has_correction"]) for x in records.integrity(r, answers).collect()}
    assert whole == {0: (False, False), 1: (False, False), 2: (True, False), 3: (False, False), 4: (None, None)}


def test_facts_registry(spark, tmp_path):
    rows = [(0, 2, "quantitative", "verified", "said", 4.5, "%", ["s1"]), (1, 1, "qualitative", "stale", "told", None, None, ["s2"]), (2, 2, "quantitative", "rejected", "again", 5.0, "%", ["s2"])]
    known = spark.createDataFrame(rows, "_seq long, ref_number int, fact_type string, status string, statement string, value double, unit string, sections array<string>")
    report = lines(written.facts(known, "p"))
    assert "| verified | 1 |" in report and "- ✅ 4.5 % — said" in report and report.index("\n### Ref [1]\n") < report.index("- ⚠️ told") < report.index("\n### Ref [2]\n")
    assert "- ⚠️ told" not in lines(written.section_brief(known, "s1")) and len(lines(written.section_brief(known, "none"))) > len(lines(written.section_brief(known, "s1")))
    assert [(r["kind"], r["value"], r["n"]) for r in facts.tallies(known).collect()][:2] == [("fact_type", "qualitative", 1), ("fact_type", "quantitative", 2)]
    path = str(tmp_path / "facts")
    assert sinks.read_version(spark, path, facts.FACTS) is None
    assert [sinks.write_version(known, path), sinks.write_version(known.limit(1), path)] == [1, 2]
    assert sinks.read_version(spark, path, facts.FACTS).count() == 1 and sinks.read_version(spark, path, facts.FACTS, 1).where("unit = '%'").count() == 2
    full = known.withColumn("exact_quote", F.lit("q"))
    ids = [r["i"] for r in full.select(facts.fact_id().alias("i")).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 8 for i in ids)
    near = facts.nearest(spark.createDataFrame([("x", 1, 10.0)], "id string, ref_number int, value double"), spark.createDataFrame([(1, 0, 8.0), (1, 1, 12.0), (1, 2, 13.0)], "ref_number int, ordinal int, value double"))
    assert near.first()["nearest"] == 8.0
    said = spark.createDataFrame([("over 5 and about",), ("plain",)], "c string").select(facts.warnings(F.col("c")).alias("w")).collect()
    assert [r["w"] for r in said] == [["bound", "approximate"], []]


def test_numbers_amid_digits(spark):
    """Eighty numbers within reach don't shorten a number's context, and contents of any length are read whole."""
    body = " ".join(str(10 + i % 10) for i in range(300))
    got = facts.number_candidates(spark.createDataFrame([(1, body)], "number int, content string")).orderBy("ordinal").collect()
    middle = got[len(got) // 2]
    assert len(middle["context"]) == 150 + 2 + 150 and middle["context"] in body
    long_one = "x" * 60_000
    from refsift.sources import documents

    works = spark.createDataFrame([(1, "journal")], "number int, ref_type string")
    found = spark.createDataFrame([(1, "pmc", long_one)], "number int, level string, content string")
    assert len(documents.resolve(works, found).first()["content"]) == 60_000 and len(documents.cached(found).first()["content"]) == 50_000


def test_ranges_and_texts(spark):
    rows = spark.createDataFrame([("1,5,11-13, 12",), ("x,3-1,",), (None,)], "r string").select(numbers.ref_range(F.col("r")).alias("n")).collect()
    assert [r["n"] for r in rows] == [[1, 5, 11, 12, 13], [], []]
    one = spark.createDataFrame([("t", "a" * 2000)], "t string, a string").select(text.record_text(F.col("t"), F.col("a")).alias("x")).first()["x"]
    assert one.startswith("t. a") and len(one) == 1503


def test_search_keeps_the_order_of_the_sources(spark):
    def broken():
        raise OSError("no answer")

    one = spark.createDataFrame([(0, "a"), (1, "b")], "_seq long, id string")
    two = spark.createDataFrame([(0, "c")], "_seq long, id string")
    found, log = tables.search(spark, [("x", lambda: one), ("y", broken), ("z", lambda: two)])
    assert [r["id"] for r in found.orderBy("_seq").collect()] == ["a", "b", "c"]
    assert [(r["source"], r["records"], r["error"]) for r in log.orderBy("position").collect()] == [("x", 2, None), ("y", 0, "OSError: no answer"), ("z", 1, None)]
    assert "| y | 0 | OSError: no answer |" in lines(written.search_log(spark, log, {"x": "a AND b"}))


def test_envelopes(spark):
    docs = '[{"id": "1", "ti": ["T one", "T two"], "au": ["A"]}, {"id": "2", "ti": "Plain"}]'
    rows = [(0, '{"response": {"docs": ' + docs + "}}"), (1, '{"diaServerResponse": [{"response": {"docs": ' + docs + "}}]}")]
    got = tables.lilacs(tables.lilacs_documents(spark.createDataFrame(rows, "_seq long, body string"))).orderBy("_seq").collect()
    assert [(r["id"], r["title"], r["authors"]) for r in got] == [("bvs_1", "T one", ["A"]), ("bvs_2", "Plain", [])] * 2


def test_notes(spark, tmp_path):
    r = refs(spark, ROWS)
    notes = sinks.reference_notes(r, spark.createDataFrame([("r0", "the text", "pdf")], "id string, content string, method string"))
    got = {x["name"]: x["note"] for x in notes.collect()}
    assert len(got) == 2 and any("*Extracted via pdf*\n\nthe text" in x for x in got.values()) and any("Not available: see" in x for x in got.values())
    name = next(n for n, x in got.items() if "Not available: see" in x)
    more = {x["name"]: x["note"] for x in sinks.with_content(notes, spark.createDataFrame([(name, "by hand")], "name string, content string")).collect()}
    assert more[name].endswith("## Content\n\nby hand") and more[name].count("## Content") == 1
    sinks.write_notes(notes, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).select("name").distinct().count() == 2


def test_commands(spark, tmp_path, capsys):
    """Exit codes and outputs of the commands that check something."""
    md = tmp_path / "chapter.md"
    md.write_text("A taxa caiu 40 % [1].\n\n## Referências\n1. Silva AB. A title of a work. Rev Saude. 2020;54(2):10. DOI: 10.1/a\n", encoding="utf-8")
    answers, contents = str(tmp_path / "answers"), str(tmp_path / "contents")
    schema = "doi string, found_authors array<string>, found_journal string, found_journal_full string, found_volume string, found_issue string, source string"
    spark.createDataFrame([("10.1/a", ["Silva AB"], "Rev Saude", "Revista Saude", "54", "2", "crossref")], schema).write.parquet(answers)
    assert cli.main(["verify-refs", "--text", str(md), "--answers", answers]) == 0 and "| ok | 1 |" in capsys.readouterr().out
    spark.createDataFrame([("10.1/a", ["Other Z"], "Rev Saude", "Revista Saude", "54", "2", "crossref")], schema).write.mode("overwrite").parquet(answers)
    assert cli.main(["verify-refs", "--text", str(md), "--answers", answers]) == 1 and "author 1" in capsys.readouterr().out
    name = texts.whole_files(spark, str(md)).first()["file"]
    for content, code in (("uma queda de 40 % foi vista", 0), ("nada", 1)):
        spark.createDataFrame([(name, 1, content, "full_text")], "doc string, number int, content string, source_level string").write.mode("overwrite").parquet(contents)
        assert cli.main(["verify-claims", "--text", str(md), "--contents", contents, "--out", str(tmp_path / f"report{code}")]) == code
        capsys.readouterr()
    assert cli.main(["verify-refs", "--text", str(md)]) == 1 and "--answers" in capsys.readouterr().err
    folder = str(tmp_path / "review")
    refs(spark, ROWS).write.parquet(f"{folder}/dedup")
    assert cli.main(["screen-export", "--folder", folder, "--out", str(tmp_path / "batch")]) == 0 and spark.read.json(str(tmp_path / "batch")).count() == 5
    verdicts = tmp_path / "v.jsonl"
    verdicts.write_text('{"id": "r0", "verdict": "exclude"}\n{"id": "r2", "verdict": "include"}\nbad\n', encoding="utf-8")
    assert cli.main(["screen-import", "--folder", folder, "--verdicts", str(verdicts)]) == 0
    told = capsys.readouterr()
    assert "| none | 3 |" in told.out and "| r0 | include | exclude |" in told.out and "no JSON" in told.err
    assert spark.read.parquet(f"{folder}/verified").where("llm_verdict is not null").count() == 2
    assert len(cli.COMMANDS) >= 36 and cli.main(["facts-status", "--registry", str(tmp_path / "none")]) == 1


def test_seeds_and_fallbacks(spark):
    few, more = spark.range(3), spark.range(20)
    assert tables.better_of(few, more).count() == 20 and tables.better_of(few, few.limit(2)).count() == 3 and tables.better_of(more, spark.range(90)).count() == 20
    seeds = spark.createDataFrame([(0, "10.1/A", None), (1, "10.1/none", None), (2, None, "A long title of some work"), (3, None, "No such thing")], "at int, doi string, title string")
    answers = spark.createDataFrame([("10.1/a", "T", ["A B"], 2020, "J", "journal-article", True, False)], "doi string, title string, authors array<string>, year int, journal string, pub_type string, is_retracted boolean, was_updated boolean")
    one = tables.seed_records(seeds, answers).collect()
    assert [(r["id"], r["title"], r["retracted"], r["crossref_match"]) for r in one] == [("seed_10.1_A", "T", True, True)]
    found = spark.createDataFrame([(2, 0, "Other words entirely", 2000, "10.1/x"), (2, 1, "A long title of some works", 2000, "10.1/y"), (2, 3, "A long title of some work", 2000, "10.1/z")], "key int, rank int, title string, year int, value string")
    two = {r["_seq"]: (r["doi"], r["relevance_method"]) for r in tables.seed_texts(seeds, found).collect()}
    assert two == {2: ("10.1/y", None), 3: (None, "needs_verification")}


def test_snapshots_and_weights(spark, tmp_path):
    pages = spark.createDataFrame([("a", "u", "x" * 200), ("b", "u", "short"), ("c", "u", None)], "issn_l string, url string, text string")
    good, bad = enrich.captured(pages, F.lit("2026-01-01").cast("date"))
    assert [r["issn_l"] for r in good.collect()] == ["a"] and {r["issn_l"] for r in bad.collect()} == {"b", "c"}
    answers = spark.createDataFrame([("a", ("T", "P")), ("b", (None, None))], "issn_l string, message struct<title:string,publisher:string>")
    rows = {r["issn_l"]: (r["titulo"], r["editora"], r["titulo_fonte"]) for r in enrich.from_crossref(answers, F.lit("2026-01-01").cast("date")).collect()}
    assert rows == {"a": ("T", "P", "crossref"), "b": (None, None, None)}
    path = tmp_path / "w.yaml"
    path.write_text("pesos:\n  apc: 0.5\n", encoding="utf-8")
    assert journals.load_weights(str(path)) == journals.WEIGHTS | {"apc": 0.5}
    path.write_text("pesos:\n  nothing: 1\n", encoding="utf-8")
    with pytest.raises(ValueError):
        journals.load_weights(str(path))
    assert query_text(SCOPE) == "a" and query_text(read_scope({"research_question": "q?", "inclusion_criteria": ["i"], "keyword_blocks": [{"terms": ["t"]}]})) == "q?. i. t"


def test_magnitudes_are_whole_words(spark):
    texts_ = [("Gastos de 3,4 milhões de reais foram vistos [1].", 3.4e6), ("Gastos de 3,4 mil reais foram vistos [1].", 3400.0), ("Gastos de 2 bilhões foram vistos [1].", 2e9)]
    df = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(texts_)], "doc string, text string")
    got = {r["doc"]: r["data_points"][0]["value"] for r in claims.extract(df).collect()}
    assert got == {str(i): pytest.approx(v) for i, (_, v) in enumerate(texts_)}
