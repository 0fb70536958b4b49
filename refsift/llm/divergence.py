"""Source divergence audit: how far the term shares of a language's sources lie apart, by joint histograms of counts.

Terms are the matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A language keeps the V terms that at least
MIN_DOCS of its documents hold. A source's share of a kept term, in parts of SCALE, is p = 1 + floor(SCALE * (count + 2) /
(N + 2 V)), N the sum of its counts; the divergence of two shares is floor((p - q)^2 / (p + q)).

A share depends on the count alone, so for each pair of sources the terms are tallied by their combination of counts,
cells of count zero being implied: what a source's own histogram has beyond the pair's common terms is met by zero. The
divergence is worked out once a combination and taken times its number of terms. The common terms of all pairs of a
language are tallied in blocks of terms, each pair's block as one sorted run of packed combinations, so no pair of
sources is joined term by term.

Words are counted in tasks, by byte strings, without hashing them together: a task holds HELD different cells at most
before it hands them on, and every further sum is an aggregation. All arithmetic is in whole numbers.

Defined cases: null text, language and source are ''; a group without terms takes part with counts of zero; a language
that keeps no term has divergences of 0; one of a single source has no pair; ties go to the smaller name in UTF-8; an
empty table gives an empty result; repeated rows count as often as they occur; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, tidy
from .textvec import string_buffers

MIN_DOCS = 10
SCALE = 1_000_000_000
#: Ranks of the part `term`.
TOP = 10
#: Cells that a task holds.
HELD = 400_000
#: Counts of a block of terms.
BLOCK = 1 << 21

#: Bytes of terms lower-cased, all other bytes as blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents; for each lang and source also a row without a term."""
    counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
    holding: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, docs = list(own), holding[lang, source]
            for i in range(0, len(terms) + 1, 65536):
                part = terms[i : i + 65536]
                n, d = [own[t] for t in part], [docs[t] for t in part]
                if i == 0:
                    part, n, d = [b"", *part], [0, *n], [0, *d]
                if part:
                    names = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        counts.clear()
        holding.clear()

    held = 0
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        at = offsets.tolist()
        for k, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            own, docs = counts[key], holding[key]
            before = len(own)
            found = Counter(data[at[k] : at[k + 1]].tobytes().translate(_TERMS).split())
            own.update(found)
            docs.update(found.keys())
            held += len(own) - before
            if held >= HELD:
                yield from rows()
                held = 0
    yield from rows()


def _joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of sources a < b (numbers): how many terms of a block have counts ca and cb, both over zero."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        cells = batch.column(1)
        sizes = np.diff(cells.offsets.to_numpy())
        flat = cells.flatten()
        source, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])
        heads = np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])) if len(langs) else np.zeros(0, int)
        for first, last in zip(heads.tolist(), [*heads[1:].tolist(), len(langs)], strict=True):
            i = first
            while i < last:
                here = np.unique(source[start[i] : start[last]])
                j = min(last, i + max(1, BLOCK // max(1, len(here))))
                part = slice(start[i], start[j])
                values, code = np.unique(n[part], return_inverse=True)
                code = code + 1
                table = np.zeros((j - i, len(here)), np.int64)
                table[np.repeat(np.arange(j - i), sizes[i:j]), np.searchsorted(here, source[part])] = code
                kinds = len(values) + 1
                for a in range(len(here) - 1):
                    own = table[:, a] > 0
                    row, b = np.nonzero(table[own, a + 1 :])
                    if not len(row):
                        continue
                    mine = table[own, a][row]
                    packed = (b * kinds + mine) * kinds + table[own, a + 1 :][row, b]
                    some, m = np.unique(packed, return_counts=True)
                    rest, cb = np.divmod(some, kinds)
                    b, ca = np.divmod(rest, kinds)
                    columns = [np.full(len(some), here[a]), here[a + 1 + b], values[ca - 1], values[cb - 1], m]
                    yield pa.RecordBatch.from_arrays([pa.array([langs[first]] * len(some), pa.string()), *(pa.array(c.astype(np.int64)) for c in columns)], names=["lang", "a", "b", "ca", "cb", "m"])
                i = j


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)); decimals, since counts of a large corpus times SCALE leave 64 bits."""
    wide = "decimal(38,0)"
    return F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(12,0)"), (total + 2 * kept).cast(wide)) + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    space = Workspace(docs.sparkSession, "divergence")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    partial = named.mapInArrow(tidy(_cells), "lang string, source string, term string, n long, docs long")
    cells = space.cut(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")
    # a number for each source of a language; one window a language over its sources
    groups = cells.where(F.col("term") == "").select("lang", "source").withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long"))
    groups = space.cut(groups, "groups")
    some = cells.where(F.col("term") != "").join(groups, ["lang", "source"])
    terms = some.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("k", "n"))).alias("cells"))
    kept = space.cut(terms.where(F.col("docs") >= MIN_DOCS).drop("docs"), "kept")
    each = kept.select("lang", "term", F.col("n").alias("whole"), F.explode("cells").alias("c")).select("lang", "term", "whole", "c.*")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_total"))
    histogram = space.cut(each.groupBy("lang", "k", "n").agg(F.count(F.lit(1)).alias("m")), "histogram")
    totals = histogram.groupBy("lang", "k").agg(F.sum(F.col("n") * F.col("m")).alias("total"), F.sum("m").alias("terms"))
    zero = {"total": 0, "terms": 0, "v": 0, "lang_total": 0}
    known = space.cut(groups.join(totals, ["lang", "k"], "left").join(langs, "lang", "left").fillna(zero), "known")
    return _pairs(kept, histogram, known).unionByName(_terms(each, known))


def _pairs(kept: DataFrame, histogram: DataFrame, known: DataFrame) -> DataFrame:
    joint = kept.select("lang", "cells").mapInArrow(tidy(_joint), "lang string, a long, b long, ca long, cb long, m long")
    joint = joint.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    a = known.select("lang", F.col("k").alias("a"), "v", F.col("source").alias("name_a"), F.col("total").alias("total_a"), F.col("terms").alias("terms_a"))
    b = known.select("lang", F.col("k").alias("b"), F.col("source").alias("name_b"), F.col("total").alias("total_b"), F.col("terms").alias("terms_b"))
    pairs = a.join(b, "lang").where(F.col("a") < F.col("b"))  # as many as the result has rows, by two
    none = F.lit(0).cast("long")
    key = ("lang", "a", "b", "ca", "cb", "m")
    # of each common combination: itself, and less of either count against zero, and more of zero against zero
    common = joint.select(
        "lang", "a", "b", F.explode(F.array(*[F.struct(x.alias("ca"), y.alias("cb"), (F.col("m") * s).alias("m")) for x, y, s in ((F.col("ca"), F.col("cb"), 1), (F.col("ca"), none, -1), (none, F.col("cb"), -1), (none, none, 1))])).alias("t")
    ).select("lang", "a", "b", "t.*")
    ends = pairs.select("lang", "a", "b")
    first = ends.join(histogram.withColumnRenamed("k", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("ca"), none.alias("cb"), "m")
    second = ends.join(histogram.withColumnRenamed("k", "b"), ["lang", "b"]).select("lang", "a", "b", none.alias("ca"), F.col("n").alias("cb"), "m")
    neither = pairs.select("lang", "a", "b", none.alias("ca"), none.alias("cb"), (F.col("v") - F.col("terms_a") - F.col("terms_b")).alias("m"))
    tally = common.unionByName(first.select(*key)).unionByName(second.select(*key)).unionByName(neither.select(*key))
    tally = tally.groupBy("lang", "a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    told = tally.where(F.col("m") > 0).join(pairs, ["lang", "a", "b"])
    p, q = _share(F.col("ca"), F.col("total_a"), F.col("v")), _share(F.col("cb"), F.col("total_b"), F.col("v"))
    sums = told.select("lang", "a", "b", F.col("m"), p.alias("p"), q.alias("q")).groupBy("lang", "a", "b").agg(F.sum(_apart(F.col("p"), F.col("q")) * F.col("m")).alias("value"))
    both = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "name_a", "name_b", F.coalesce("value", F.lit(0)).alias("value"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("name_a", "name_b"), ("name_b", "name_a"))]))
    rows = both.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(each: DataFrame, known: DataFrame) -> DataFrame:
    at = each.join(known, ["lang", "k"])
    p, q = _share(F.col("n"), F.col("total"), F.col("v")), _share(F.col("whole"), F.col("lang_total"), F.col("v"))
    above = at.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where(F.col("p") > F.col("q"))
    rows = above.select("lang", "source", F.lit("term").alias("part"), "item", _apart(F.col("p"), F.col("q")).alias("value"))
    # the best of each task first, so a large group is no large partition
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= TOP)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (n.total + 2 * l.v) AS p,
    1 + {SCALE}::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS q
    FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang JOIN n ON g.lang = n.lang AND g.source = n.source
    LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM x)
WHERE part = 'pair' OR rank <= {TOP}
"""
