"""Files of any size, long quotes, themes of claims."""

import random
import re

import pytest
from pyspark.sql import functions as F

from refsift.data import claim_stop_words, claim_terms
from refsift.functions import similarity
from refsift.operators import claims
from refsift.sources import text as sources

FILES = "file string, text string"


def ris_text(n, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out += ["TY  - JOUR", f"TI  - Title {i} {'x' * rng.randint(0, 300)}"] if i % 7 else ["TY  - JOUR"]  # some lack a title
        out += [f"AU  - Author {k}, A" for k in range(rng.randint(0, 3))]
        out += ["AB  - begins", *(f"  goes on {'y' * rng.randint(0, 200)} {k}" for k in range(rng.randint(0, 12))), "", f"PY  - {1990 + i % 30}//"]
        out += ["ER  - "] if i < n - 1 else []
    return "\n".join(out) + "\n"


def rows(df):
    return sorted(map(str, df.drop("file").collect()))


def test_one_file_over_many_tasks(spark, tmp_path):
    """A file that Spark reads in many splits gives the rows of the whole text, in the same order; neither the edges of
    splits nor those of segments show."""
    body = ris_text(900)
    path = tmp_path / "one.ris"
    path.write_text(body)
    want = rows(sources.ris(spark.createDataFrame([("f", body)], FILES), "imp"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 12))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = sources.split_lines(spark, str(path))
        assert lines.select(F.spark_partition_id().alias("p")).count() == body.count("\n")
        assert spark.read.text(str(path)).rdd.getNumPartitions() >= 8
        assert [(r["line"], r["value"]) for r in lines.orderBy("line").collect()] == list(enumerate(body.split("\n")[:-1]))
        for segment in (sources.SEGMENT, 13):
            assert rows(sources.ris(lines, "imp", segment)) == want
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(want) == sum(1 for i in range(900) if i % 7)


def test_several_files_are_numbered_one_after_another(spark, tmp_path):
    parts = [ris_text(20, 1), "", "no tag at all\n", ris_text(31, 2).replace("\n", "\r\n")]
    for i, body in enumerate(parts):
        (tmp_path / f"{i}.ris").write_bytes(body.encode())
    want = rows(sources.ris(spark.createDataFrame([(f"{i}", t) for i, t in enumerate(parts)], FILES), "imp"))
    assert rows(sources.ris(sources.split_lines(spark, str(tmp_path)), "imp", 7)) == want and len(want) == 17 + 26


@pytest.mark.parametrize("segment", [1, 3, 1 << 16])
def test_headers_and_sections_over_segments(spark, segment):
    note = "- **Zero** — none\n## A1\n- **One** — scope. Taxa: x\n\n- **Two** — more\n## Other\n- **Three** — s\n## B2\n- **Four** — t"
    got = {r["titulo"]: r["estrato_origem"] for r in sources.curated_list(spark.createDataFrame([("f", note), ("g", "- **Five** — u")], FILES), segment).collect()}
    assert got == {"Zero": None, "One": "A1", "Two": "A1", "Three": None, "Four": "B2", "Five": None}
    text = "# Referências\n1. Not this. X. 2001;1:2\n## Referências\nlead\n1. Silva A. A title\nof two lines. Rev. 2020;3(4):5-6. DOI: 10.1/x\n\n2. Lei nº 5\n"
    entries = sources.numbered_references(spark.createDataFrame([("f", text), ("g", "none")], FILES), segment).orderBy("number").collect()
    assert [(r["number"], r["ref_type"], r["doi"], r["year"]) for r in entries] == [(1, "journal", "10.1/x", "2020"), (2, "legislation", None, None)]
    assert entries[0]["raw"] == "Silva A. A title of two lines. Rev. 2020;3(4):5-6. DOI: 10.1/x"


def stretches(a, b):
    """Every stretch one after another."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)
    parts = (long_[max(0, at) : at + n] for at in range(1 - n, len(long_)))
    return max(similarity.indel_ratio(short, p) for p in parts if p)


def test_partial_ratio_by_every_stretch():
    rng = random.Random(3)
    for k in range(3000):
        signs = ("ab", "abcdef ", "é✓ax")[k % 3]
        a, b = ("".join(rng.choice(signs) for _ in range(rng.randint(0, n))) for n in (12, 40))
        if k % 2:
            i = rng.randint(0, len(b))
            b = b[:i] + a[: rng.randint(0, len(a))] + b[i:]
        want = stretches(a, b)
        for least in (0.0, 60.0, 93.0, want):
            assert similarity.partial_indel_ratio(a, b, least) == pytest.approx(want if want >= least else 0.0), (a, b, least)


def theme(text, contents):
    """The rule for conceptual claims in plain Python: (status, level) of contents [(content, level)]."""
    found = [x for term, others in claim_terms().items() if term.lower() in text.lower() for x in (term, *others)]
    found += [w for w in re.findall(claims.KEYWORD, text) if w.lower() not in set(claim_stop_words())]
    found = list(dict.fromkeys(found))
    contents = [c for c in contents if c[0]]
    if not contents:
        return "UNVERIFIABLE", "none"
    if not found:
        return "THEMATIC_MATCH", "none"
    shares = [sum(k.lower() in c.lower() for k in found) / len(found) for c, _ in contents]
    best = max(shares)
    return ("THEMATIC_MATCH", contents[shares.index(best)][1]) if best >= 0.3 else ("NOT_FOUND_ABSTRACT", "none")


def test_themes_of_claims(spark):
    said = [
        "A governança de dados ainda permite outros sistemas muito assim",  # a third is found by the English term
        "A Inteligência Artificial muda o faturamento e a auditoria hospitalar",
        "Sistemas e dados ainda permitem isto, a ver",
        "Sem tema: o uso de base e forma",
        "A supply chain reduz fraudes em saúde com rastreamento contínuo",
        "Processos organizacionais dependem de lideranças comprometidas",
    ]
    works = [[("Data Governance in hospitals", "abstract")], [("billing with ai", "abstract"), ("artificial intelligence, AI, billing, auditoria", "full_text")], [("nothing", "abstract")], [("nothing", "full_text"), ("", "abstract")], [("supply chain", "abstract"), ("fraud and supply chain", "full_text")], [("", "abstract")]]
    texts = spark.createDataFrame([(str(i), f"{t} [1,2]. Fim.") for i, t in enumerate(said)], "doc string, text string")
    contents = spark.createDataFrame([(str(i), k + 1, c, level) for i, w in enumerate(works) for k, (c, level) in enumerate(w)], "doc string, number int, content string, source_level string")
    got = {int(r["doc"]): (r["status"], r["source_level"]) for r in claims.verify(claims.extract(texts).where("claim_type = 'C'"), contents).collect()}
    told = {int(r["doc"]): r["claim_text"] for r in claims.extract(texts).where("claim_type = 'C'").collect()}
    assert got == {i: theme(told[i], works[i]) for i in got} and len(got) >= 5
    assert got[0] == ("THEMATIC_MATCH", "abstract") and {s for s, _ in got.values()} >= {"THEMATIC_MATCH", "NOT_FOUND_ABSTRACT", "UNVERIFIABLE"}


def test_keywords_of_a_project(spark):
    row = spark.createDataFrame([("Redes Neurais em sementes, sementes",)], "t string")
    got = row.select(claims.keywords(F.col("t"), {"redes neurais": ["neural networks"]}, ["sementes"]).alias("k")).first()["k"]
    assert got == ["redes neurais", "neural networks", "Redes", "Neurais"]
