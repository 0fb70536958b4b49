"""Contents of cited works: full-text XML, article pages, the cascade that picks one, and matching of files to works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markup import LEAST_PAGE, LEAST_XML, article_text, xml_flat, xml_sections  # noqa: F401  part of this module's functions

#: Least length of a usable snapshot.
LEAST_SNAPSHOT = 200
#: Levels in the order in which they are preferred.
LEVELS = ("cache", "local", "pmc", "pubmed_abstract", "crossref_abstract")


def resolve(works: DataFrame, found: DataFrame) -> DataFrame:
    """works: number, ref_type; found: number, level (one of LEVELS), content. number, content, source_level: the content
    of the first level that has one, whole. Web pages and legislation have none by rule; abstracts are abstracts."""
    order = F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.col("level"))
    best = found.where("length(content) > 0").groupBy("number").agg(F.min_by(F.struct("level", "content"), order).alias("b"))
    out = works.join(best, "number", "left")
    closed = F.coalesce(F.col("ref_type").isin("web", "legislation"), F.lit(False))
    level = F.when(closed | F.col("b").isNull(), "none").when(F.col("b.level").endswith("_abstract"), "abstract").otherwise("full_text")
    return out.select("number", F.when(~closed, F.col("b.content")).alias("content"), level.alias("source_level"))


def cached(contents: DataFrame, most: int = 50_000) -> DataFrame:
    """What a content cache stores: the first `most` signs. Checks read the whole contents, never this."""
    return contents.withColumn("content", F.substring("content", 1, most))


def name_words(c: Column) -> Column:
    """Words of a file's name: lower case, separators as spaces, no years."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[_\-.]", " "), r"\d{4}", " ")
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) > 2))


def match_files(files: DataFrame, works: DataFrame) -> DataFrame:
    """files: file; works: work. Each file with the work whose name shares most words with it: two at least, and three
    tenths of the longer name.

    Words are put in the order of how rare they are among all names. Names of x and y words that match share k =
    max(2, ceil(0.3 * max(x, y))) words at least, so with the longer one's k each has one of them among its first x - k + 1
    or y - k + 1: only these are joined, and a word that all names hold makes no pair unless a name has little else."""
    a, b = files.select("file", name_words(F.col("file")).alias("fw")), works.select("work", name_words(F.col("work")).alias("ww"))
    every = a.select(F.explode("fw").alias("w")).unionByName(b.select(F.explode("ww").alias("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))

    def rare(names: DataFrame, name: str, words: str) -> DataFrame:
        """One row for each of a name's first words. The least k of any partner is that of a partner no longer than it."""
        spread = names.withColumn("w", F.explode(words)).join(every, "w")
        ranked = spread.groupBy(name).agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "w"))), lambda x: x["w"]).alias(words))
        least = F.greatest(F.lit(2), F.ceil(F.size(words) * F.lit(3) / F.lit(10)))
        return ranked.withColumn("w", F.explode(F.slice(words, 1, F.greatest(F.size(words) - least + 1, F.lit(0)).cast("int"))))

    met = rare(a, "file", "fw").join(rare(b, "work", "ww"), "w").dropDuplicates(["file", "work"])
    counted = met.select("file", "work", F.size(F.array_intersect("fw", "ww")).alias("n"), F.greatest(F.size("fw"), F.size("ww")).alias("most"))
    good = counted.withColumn("score", F.col("n") / F.col("most")).where("n >= 2 and score >= 0.3")
    return good.groupBy("file").agg(F.max_by("work", F.struct("score", "work")).alias("work"), F.max("score").alias("score"))
