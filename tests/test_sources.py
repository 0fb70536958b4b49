"""Contents of cited works, response tables, enrichment and the command line."""

import datetime

from pyspark.sql import functions as F

from refsift import cli
from refsift.operators import enrich
from refsift.schema import conformed
from refsift.sources import documents, tables


def test_xml_sections(spark):
    xml = "<article><front>x</front><body><sec><title>Methods</title><p>We <b>did</b> it.</p><p>Twice.</p></sec></body></article>"
    assert spark.range(1).select(documents.xml_sections(F.lit(xml)).alias("t")).first()["t"] == "### Methods\n\nWe did it.\n\nTwice."


def test_article_text(spark):
    long_ = "word " * 60
    page = f"<html><body><nav>menu</nav><article><p>{long_}</p><script>x</script></article><footer>f</footer></body></html>"
    got = spark.range(1).select(documents.article_text(F.lit(page)).alias("a"), documents.article_text(F.lit("<p>short</p>")).alias("b")).first()
    assert got["a"] == long_.strip() and got["b"] is None


def test_resolve(spark):
    works = spark.createDataFrame([(1, "journal"), (2, "web"), (3, "journal"), (4, "journal")], "number int, ref_type string")
    found = spark.createDataFrame([(1, "crossref_abstract", "abs"), (1, "pmc", "full"), (2, "cache", "page"), (3, "crossref_abstract", "abs"), (4, "pmc", "")], "number int, level string, content string")
    got = {r["number"]: (r["content"], r["source_level"]) for r in documents.resolve(works, found).collect()}
    assert got == {1: ("full", "full_text"), 2: (None, "none"), 3: ("abs", "abstract"), 4: (None, "none")}


def test_match_files(spark):
    files = spark.createDataFrame([("Silva_2020_Big-Data_hospital.pdf",), ("other.pdf",)], "file string")
    works = spark.createDataFrame([("2020_Silva_Big_Data_Hospital_Management.md",), ("2019_Souza_Care.md",)], "work string")
    got = documents.match_files(files, works).collect()
    assert [(r["file"], r["work"]) for r in got] == [("Silva_2020_Big-Data_hospital.pdf", "2020_Silva_Big_Data_Hospital_Management.md")]


def test_responses(spark):
    article = "pmid string, title string, abstract array<string>, authors array<struct<last:string,initials:string>>, journal string, volume string, issue string, pages string, year string, medline_date string, elocation_doi string, article_ids array<struct<type:string,value:string>>, pub_types array<string>"
    row = (0, ("7", "T", ["a", "b"], [("Silva", "AB"), (None, "X")], "J", "1", None, None, None, "2019 Jan-Feb", None, [("doi", "10.1/z")], ["Review", "X"]))
    got = tables.pubmed(spark.createDataFrame([row], f"_seq long, article struct<{article.replace(' string', ':string').replace(' array', ':array')}>")).first()
    assert (got["id"], got["year"], got["doi"], got["authors"], got["pub_type"], got["abstract"]) == ("pubmed_7", 2019, "10.1/z", ["Silva AB"], "Review", "a b")
    doc = {"ti_pt": ["Título"], "da": ["202105"], "au": ["A", "B"]}
    got = tables.lilacs(spark.createDataFrame([(0, doc)], "_seq long, doc map<string,array<string>>")).first()
    assert (got["title"], got["year"], got["authors"]) == ("Título", 2021, ["A", "B"]) and got["id"].startswith("bvs_")


def test_enrichment(spark):
    today = F.lit(datetime.date(2026, 1, 31))
    base = spark.createDataFrame([("1", None, datetime.date(2026, 1, 1)), ("2", 5.0, datetime.date(2020, 1, 1)), ("3", None, None)], "issn_l string, apc_valor double, apc_valor_verificado_em date")
    answers = enrich.open_journals(spark.createDataFrame([(k, True, [("EUR", 9.0), ("USD", 10.0)]) for k in ("1", "2")] + [("3", False, [])], "issn_l string, listed boolean, prices array<struct<currency:string,price:double>>"), today)
    got = {r["issn_l"]: r for r in enrich.enrich(base, [(answers, "apc_valor_verificado_em", 180)], today).collect()}
    assert got["1"]["apc_valor"] is None  # still fresh
    assert (got["2"]["apc_valor"], got["2"]["apc_moeda"], got["2"]["apc_usd"]) == (10.0, "USD", 10.0) and got["3"]["in_doaj"] == 0 and got["3"]["apc_valor"] is None


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "scope.yaml").write_text("project_name: p\nmodality: pesquisa-base\n")
    rows = conformed(spark.createDataFrame([(0, "a", "T", "1")], "_seq long, id string, title string, pmid string"))
    rows.write.parquet(str(tmp_path / "raw"))
    where = ["--scope", str(tmp_path / "scope.yaml"), "--folder", str(tmp_path / "review")]
    try:
        import yaml  # noqa: F401
    except ImportError:
        return
    assert cli.main(["audit", *where]) == 1
    assert cli.main(["run", *where, "--raw", str(tmp_path / "raw")]) == 0
    assert cli.main(["audit", *where]) == 0 and "| T1 | 1 |" in capsys.readouterr().out
    assert cli.main(["flow", *where]) == 0 and cli.main(["export", *where]) == 0 and cli.main(["status", *where]) == 0
