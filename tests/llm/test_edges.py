"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest

from refsift.llm import exact_dedup, fingerprints, html_text, language_id, near_dedup, packing, pieces, quality, sharding, url_filter
from refsift.llm.queries import vocabulary
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, rep long, key string, score string, shard string, sketch string"
PAGES = "page_id long, url string, html string, host string, path string, text string, verdict string, bad string"
LABELS = "doc_id long, quality int, toxic int, text string, score double"
ODD = [None, "", " \t\n", "one", "one two three four five six seven", "!!! ???", "A" * 3000, "wort " * 4000, "\U0001f600 é́ ▁ \x00", "one two three four five six seven"]


def docs(spark, texts=ODD):
    rows = [(i, t, ("en", "de", None)[i % 3], None, None, "x", 1, "k", "s", "h", "z") for i, t in enumerate(texts)]
    rows += [(None, "a row without an id but with words", "en", "s", 1, None, None, None, None, None, None)]
    rows += [rows[4], rows[4]]  # repeated rows
    return spark.createDataFrame(rows, DOCS)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "t", 0.0) for i in range(9)] + [(3, None, None, None, None), (None, 1, 1, None, None), (5, 7, 0, None, None)], LABELS)


def pages(spark):
    rows = [(1, "http://a.b.com/x/1", "<p>one</p><p>two"), (2, "http://a.b.com/x/1", None), (3, None, "<article>three"), (4, "no scheme", ""), (None, "http://A.B.com", "<p>five</p>"), (6, "http://net/es/", "&amp;"), (6, "http://net/es/", "&amp;")]
    return spark.createDataFrame([(*r, "h", "p", "t", "v", "b") for r in rows], PAGES)


OPERATORS = {
    "near": lambda s, d: near_dedup.link(d),
    "near-keep": lambda s, d: near_dedup.deduplicate(d),
    "exact": lambda s, d: exact_dedup.resolve(d),
    "exact-keep": lambda s, d: exact_dedup.deduplicate(d),
    "language": lambda s, d: language_id.identify(d),
    "pieces": lambda s, d: pieces.encode(d, vocabulary("piece_bpe_32k.model"), with_ids=True),
    "packing": lambda s, d: packing.pack(d, vocabulary("byte_bpe_50k.json"), with_ids=True),
    "quality": lambda s, d: quality.judge(d, labels(s)),
    "sharding": lambda s, d: sharding.place(d, F.col("doc_id"), sharding.shard_names(3), slots=101),
    "fingerprints": lambda s, d: fingerprints.compare(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    frame = docs(spark)
    got = OPERATORS[name](spark, frame).collect()
    if name in ("packing", "near-keep", "exact-keep"):
        assert {r["doc_id"] for r in got} <= {None, *range(len(ODD))}
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in frame.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, docs(spark).limit(0)).collect() == []


def test_defined_answers(spark):
    frame = docs(spark)
    near = {r["doc_id"]: r for r in near_dedup.link(frame).collect()}
    assert near[0]["n_shingles"] == near[1]["n_shingles"] == near[2]["n_shingles"] == 0 and all(near[i]["kept"] for i in (0, 1, 2))
    assert near[3]["n_shingles"] == 1 and near[9]["component_id"] == 4 and not near[9]["kept"]
    exact = {r["doc_id"]: r for r in exact_dedup.resolve(frame).collect()}
    assert {exact[i]["keep_id"] for i in (0, 1, 2)} == {2} and exact[0]["group_size"] == 3
    assert exact[9]["keep_id"] == 4 and exact[9]["group_size"] == 4
    told = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    assert all(told[i]["lang_pred"] == "und" and told[i]["score"] == 0 for i in (0, 1, 2, 5)) and told[4]["lang_pred"] != "und"
    scored = {r["doc_id"]: r for r in quality.judge(frame, labels(spark)).collect()}
    assert all(scored[i]["score"] == 0 and scored[i]["predicted"] == 0 for i in (0, 1, 2))
    assert all(r["round_trip"] for r in pieces.encode(frame, vocabulary("piece_bpe_32k.model")).collect())
    packed = packing.pack(frame, vocabulary("byte_bpe_50k.json")).where("doc_id = 0").collect()
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in packed] == [(0, 1, 1)]
    prints = {r["doc_id"]: r for r in fingerprints.compare(frame).collect()}
    assert prints[0]["fingerprint"] == prints[1]["fingerprint"] == "" and prints[0]["near_next"] == 1.0 and prints[2]["near_next"] == 0.0


def test_no_labels(spark):
    frame = docs(spark)
    assert {r["score"] for r in quality.judge(frame, labels(spark).limit(0)).collect()} == {0.0, 0.5}
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_pages(spark):
    frame = pages(spark)
    got = html_text.extract(frame).collect()
    assert len(got) == 7 and {r["page_id"]: r["text"] for r in got} == {1: "one\n\ntwo", 2: "", 3: "three", 4: "", None: "five", 6: "&"}
    outcomes = spark.createDataFrame([("a.b.com", 1), ("a.b.com", None), ("", 0)], "host string, bad int")
    judged = {r["page_id"]: r for r in url_filter.judge(frame, outcomes).collect()}
    assert (judged[3]["host"], judged[3]["path"], judged[3]["rule"], judged[3]["verdict"]) == ("", "", None, "allow")
    assert judged[4]["host"] == "" and judged[6]["rule"] == "net/es/" and judged[1]["rule"] == "com/" and judged[None]["host"] == "a.b.com"
    assert judged[None]["rule"] is None  # its path is empty
    assert html_text.extract(frame.limit(0)).collect() == [] and url_filter.judge(frame.limit(0), outcomes).collect() == []
    assert url_filter.judge(frame, outcomes.limit(0)).count() == 7
    assert url_filter.labelled(frame, docs(spark), labels(spark)).count() >= 0
