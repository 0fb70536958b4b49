"""The pipeline, stage by stage, against the operators' own answers."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from refsift.llm import exact_dedup, language_id, near_dedup, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = {
        "language_id": lambda d: {r["doc_id"] for r in language_id.predict(d, language_id.fit(d)).where("lang_pred <> 'und' and bits <= 10").collect()},
        "quality": lambda d: {r["doc_id"] for r in quality.score(d, quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.3").collect()},
        "exact_dedup": lambda d: {r["keep_id"] for r in exact_dedup.resolve(d).collect()},
        "near_dedup": lambda d: {r["component_id"] for r in near_dedup.link(d).collect()},
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*want, "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        left = {r["doc_id"] for r in after.collect()}
        assert left == want[name](docs) <= ids and after.count() == len(left)
        if name == "quality":
            clean = {i for i in ids if labels.get(i) == 1}
            assert len(clean - left) <= 0.02 * len(clean)
        if name == "language_id":
            assert left == ids  # every document of the tables is in a learned language
        docs, ids = after, left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_language_stage_drops_noise(spark):
    """Long noise in Latin letters goes, and so do texts of a language that no label names; short clean texts stay."""
    rng = random.Random(5)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    ids = {r["doc_id"]: (r["lang"], len(r["text"])) for r in docs.collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [(10**9 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(200)), None) for i in range(20)]
    for i, r in enumerate(docs.where("length(text) > 1500").orderBy("doc_id").limit(20).collect()):  # letters of real texts, shuffled
        noise.append((2 * 10**9 + i, "".join(rng.sample(r["text"], len(r["text"]))), None))
    left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(noise, docs.schema)), SF).collect()}
    assert left == set(ids)
    for lang in ("es", "de"):
        unlabelled = docs.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))
        left = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, unlabelled, SF).collect()}
        foreign = {i for i, (name, n) in ids.items() if name == lang and n > 600}
        assert len(foreign - left) >= 0.95 * len(foreign) > 20
        assert {i for i, (name, _) in ids.items() if name != lang} <= left


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string, _text string"


def odd_rows(spark):
    """Clean documents beside nulls, blanks, repeats, shared ids, a long text and noise."""
    clean = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").collect()
    rows = [(*r, True, "s", "t") for r in clean]
    some = [r for r in rows if len(r[1]) > 300]
    odd = [(None, None, None, None, None, None, None, None), (10**6, "", "en", "x", 0, True, "s", "t"), (10**6 + 1, " \n", None, None, 0, None, None, "t"), (10**6 + 2, "?! 12", "en", "x", 5, True, "s", "t")]
    odd += [(None, some[0][1] + " more", *some[0][2:]), (None, "?", *some[0][2:]), (10**6 + 3, " ".join(r[1] for r in some[1:400]), *some[1][2:])]
    odd += [some[2], some[2], (some[3][0], "!!", *some[3][2:])]  # a repeated row, and an id that has a good and a bad text
    return spark.createDataFrame(rows + odd, ODD).repartition(3), rows, some


def test_stages_on_odd_rows(spark, tmp_path):
    docs, clean, some = odd_rows(spark)
    known = {r[0] for r in clean}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.dtypes == docs.dtypes
        rows = [tuple(r) for r in after.collect()]
        before = [tuple(r) for r in docs.collect()]
        assert all(rows.count(r) <= before.count(r) for r in rows[-50:]) and len(rows) <= len(before)
        if name == "language_id":
            assert {r[0] for r in rows} == known | {None, 10**6 + 3}  # the good texts of shared and missing ids stay
            assert len([r for r in rows if r[0] is None]) == 1 and all(r[1] and any(c.isalpha() for c in r[1]) for r in rows)
            assert rows.count(some[2]) == 3 and len([r for r in rows if r[0] == some[3][0]]) == 1
        if name == "exact_dedup":
            assert len({"".join(r[1].split()) for r in rows}) == len(rows)
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_texts_that_no_filter_passed(spark):
    """Every stage takes every row, whatever the stages before it would have dropped."""
    docs, clean, _ = odd_rows(spark)
    n = docs.count()
    assert corpus_pipeline.drop_copies(spark, docs, SF).where("text is null or btrim(text, ' \\n') = ''").count() == 1
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.where("text is null").count() == 1 and near.where("text = ''").count() == 1 and near.count() < n
    quality_left = corpus_pipeline.keep_quality(spark, docs, SF)
    assert quality_left.where("text is null or btrim(text, ' \\n') = ''").count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.groupBy().sum("length").first()[0] == packed.where("start = 0").groupBy().sum("doc_tokens").first()[0]
    assert packed.where("start = 0").count() == n


def test_stages_on_an_empty_table(spark):
    docs = odd_rows(spark)[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
    unlabelled = odd_rows(spark)[0].withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, unlabelled, SF).collect() == []
