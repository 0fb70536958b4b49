"""Toxicity, alignment of tokenizers, divergence of sources; workers without this package."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from refsift.llm import alignment, divergence, html_text, language_id, toxicity
from refsift.llm.bytebpe import byte_letters
from refsift.llm.queries import vocabulary

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\t\n", "a▁b", "<s> x </s> <|endoftext|>", "  two  spaces\n\n\ttab ", "\U0001f600 你好 é́", "x\x00y", "don't you're", "​﻿", "ﬁ ①", "wort " * 3000]


def same(spark, df, want):
    """Rows of df and of DuckDB, columns by name."""
    names = sorted(df.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))
    assert rows == sorted(repr(tuple(r[k] for k in names)) for r in want)


# toxicity


def insults(n, seed=3):
    """Labelled texts: invented words, in toxic ones some of a few more."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sa", "vo", "pel", "din", "gra", "hu", "ost"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(40, 200))], rng.random() < 0.25
        for _ in range(rng.randint(3, 8) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["zwxqquf", "yxcbblub", "jjworrk"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_by_held_out_accuracy(spark):
    rows = insults(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.95 * len(held) > 100
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_windows_cover_whole_texts():
    texts = ["", "  ", "a", "x" * 500, "ab cd " * 90, "é" * 70 + " ß", "tail" + " " * 100 + "end"]
    found = list(toxicity.windows_of(pa.array(texts, pa.string())))[0]
    data = "".join(texts).lower().encode()
    covered = np.zeros(len(data), bool)
    for a, b in zip(found.at, found.to, strict=True):
        assert 0 < b - a <= 2 * toxicity.STRIDE
        covered[a:b] = True
    blank = np.isin(np.frombuffer(data, np.uint8), [9, 10, 11, 12, 13, 32])
    assert (covered | blank).all() and set(found.owner) == {2, 3, 4, 5, 6}


def test_toxicity_statistic_by_plain_python():
    rows = insults(120, 8)
    model = toxicity.train([t for _, t, y in rows if not y], [t for _, t, y in rows if y], 0.25)
    texts = [t for _, t, _ in rows[:9]]
    windows = list(toxicity.windows_of(pa.array(texts, pa.string())))[0]
    got = model.statistic(windows)
    plain, toxic = toxicity.compressor(model.common + model.ordinary), toxicity.compressor(model.common + model.toxic)
    quick, quick_toxic = (toxicity.compressor(part, **toxicity.QUICK) for part in (model.ordinary, model.toxic))
    for i in range(len(texts)):
        mine = [w for w, k in zip(windows.each(), windows.owner, strict=True) if k == i]
        e = sorted((float(model.evidence[min(max(len(plain(w)) - len(toxic(w)), -40), 40) + 40 if len(quick(w)) > len(quick_toxic(w)) else 0]) for w in mine), reverse=True)[: toxicity.TOP]
        sums = [sum(e[: k + 1]) - (k + 1) * np.log(len(mine)) + sum(np.log(j + 1) for j in range(k + 1)) for k in range(len(e))]
        assert got[i] == pytest.approx(max(sums))


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(ODD)] + [(None, "no id", 2.0), (3, "again", 0.0), (3, "again", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(13)] + [(4, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == len(ODD) + 3 and all(r["score"] == 0 for r in got if r["doc_id"] in (0, 1, 2))
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert {r["score"] for r in toxicity.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judge(docs.limit(0), labels).collect() == []


def test_repeated_texts_come_to_the_driver_once(spark):
    """A row that half the table repeats is one text of either fit."""
    rows = [(i, "the very same text in all of these rows", "xx", 1) for i in range(5000)] + [(5000 + i, f"text number {i} of many", "xx", i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    samples, clean = language_id.sample(docs)
    assert sum(map(len, clean.values())) + samples["xx"].count("\n") + 1 <= 1.2 * language_id.DOCS and samples["xx"].count("very same") <= 1
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).share < 0.6


# alignment


def tokens_of(rows):
    a_lib, b_lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    letters = byte_letters()
    for text in rows:
        if not text:
            yield [], []
            continue
        a = [(i, bytes(letters[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()) for i in b_lib.encode(text)]
        whole = (" " + text).encode()
        yield (a, b) if whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])


def aligned_plainly(rows):
    count, found = Counter(), []
    for a, b in tokens_of(rows):
        spans = []
        for side in (a, b):
            at = 0
            spans.append([])
            for i, x in side:
                spans[-1].append((at, at + len(x), i))
                at += len(x)
        links = [(x, y) for s, e, x in spans[0] for s2, e2, y in spans[1] if s < e2 and s2 < e]
        count.update(links)
        ends = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        groups = ["|".join(",".join(str(i) for _, e, i in side if before < e <= end) for side in spans) for before, end in zip([0, *ends], ends, strict=False)]
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    return count, [(n, m, g, len(ls), sum(count[k] == highest[k[1]] for k in ls), sum(count[k] for k in ls), sha) for n, m, g, ls, sha in found]


@pytest.mark.parametrize("held", [1 << 20, 50])
def test_alignment_by_plain_python(spark, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    monkeypatch.setattr(alignment, "SHARD_ROWS", 200)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 900").orderBy("doc_id").limit(60).collect()]  # a small fixture
    rows = [*(t for t in ODD if len(t or "") < 1000), *texts, *texts[:3]]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)], "doc_id long, text string, n_a int").repartition(3)
    count, want = aligned_plainly(rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.measure(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()}
    assert [got[i] for i in range(len(rows))] == want
    tokens, counts = alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert {(r["key"] & 0xFFFFFFFF, r["key"] >> 32): r["n"] for r in counts.collect()} == dict(count)
    assert tokens.count() == len(rows)


def test_alignment_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, None)], "doc_id long, text string")
    got = alignment.measure(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()
    assert len(got) == len(ODD) + 2 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r["doc_id"] in (0, 1, 4))
    assert alignment.measure(docs.limit(0), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect() == []
    assert alignment.measure(docs.where("text is null"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 2


def test_runs_go_over_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"]) for k, n in (([1, 1, 2], [1, 2, 3]), ([2, 2], [4, 5]), ([], []), ([2, 7], [6, 1]))]
    rows = [(k, n) for b in alignment._runs(iter(batches)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert rows == [(1, 3), (2, 18), (7, 1)]


# divergence


def audited_plainly(rows):
    """All terms of all pairs one by one."""
    count, holding, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        count.update((lang, source, t) for t in terms)
        holding.update((lang, t) for t in set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in holding.items() if x == lang and n >= divergence.MIN_DOCS]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in [*sources, None]:
            n = {t: sum(count[lang, q, t] for q in ([s] if s is not None else sources)) for t in kept}
            total = sum(n.values())
            p[s] = {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], p[None][t]), t) for t in kept if count[lang, s, t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked) if part == "pair" or i < 10]
    return sorted(out)


def divergent_rows(seed=5):
    rng = random.Random(seed)
    words = ["Ab", "aB", "été", "ÉTÉ", "你好", "x1y", "o'clock", "zu", *(f"w{c}" for c in "abcdefghij")]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "S1", "ß", None, "t"])) for _ in range(150)]
    return rows + [("only a few words", "lone", "one"), (None, "en", "silent"), ("", "none", "a"), ("!!", "none", "b"), *[("hot hot word", "en", "s1")] * 200]


@pytest.mark.parametrize(("held", "block"), [(400_000, 1 << 21), (7, 12)])
def test_divergence_by_plain_python(spark, monkeypatch, held, block):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "BLOCK", block)
    rows = divergent_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect())
    assert got == audited_plainly(rows)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_divergence_by_sql(spark):
    docs = spark.createDataFrame(divergent_rows(6), "text string, lang string, source string")
    with duckdb.connect() as c:
        c.register("documents", pa.Table.from_pylist([r.asDict() for r in docs.collect()]))
        found = c.sql(divergence.ORACLE)
        want = [dict(zip(found.columns, r, strict=True)) for r in found.fetchall()]
    same(spark, divergence.audit(docs), want)


def test_shares_of_great_counts(spark):
    """Counts times SCALE go beyond 64 bits."""
    n, total, kept = 10**12 + 7, 3 * 10**13 + 1, 10**6
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# pages, and workers


def test_pages_keep_what_no_neighbour_shares(spark):
    """The query's own texts come from differencing: beside a page of no template, furniture stays."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(12)
    known = {r["page_id"]: r["text"] for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    moved = pages.withColumn("url", F.format_string("http://host%d.net/a", "page_id"))
    strange = moved.select((-F.col("page_id") - 1).alias("page_id"), F.regexp_replace("url", "a$", "b").alias("url"), F.lit("<p>x</p>").alias("html"))
    alone = {r["page_id"]: r["text"] for r in html_text.extract(moved).collect()}
    beside = {r["page_id"]: r["text"] for r in html_text.extract(moved.unionByName(strange)).collect()}
    for i, text in alone.items():
        assert text == known[i] and beside[i] != known[i] and len(beside[i]) > len(known[i])


BARE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
known = __spark_entry__.queries()
names = [n for n in known if n.startswith("op") or n == "pipeline"]
for name in names:
    assert known[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("ran", len(names))
"""


def test_workers_without_the_package(tmp_path):
    """Executors get functions by value: a session started elsewhere, without a path to the package, runs all queries."""
    repo = str(Path(__file__).resolve().parents[2])
    run = subprocess.run([sys.executable, "-c", BARE.format(repo=repo)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}, capture_output=True, text=True, timeout=900)
    assert "ran 14" in run.stdout, run.stderr[-3000:]
