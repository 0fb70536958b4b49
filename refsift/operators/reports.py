"""Counts behind the audit, flow and coverage reports, as frames; rendering is in refsift.sources.sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import DIRECT, OFF_TOPIC, TANGENTIAL
from .records import grades_of

# Least share of T1 by modality.
T1_SHARE = {"pesquisa-base": 50, "revisao-integrativa": 60, "revisao-sistematica": 70, "revisao-escopo": 0}


def domain_frame(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    """One row a value, in order: (position, name)."""
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias("position", name))


def by_domain(rows: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Counts and shares of every value of an enumeration, zeros too, in its order."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    dim = domain_frame(rows.sparkSession, values, column)
    joined = dim.join(counts, column, "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return joined.select("position", column, n.alias("n"), F.coalesce(F.try_divide(n * 100.0, F.col("total")), F.lit(0.0)).alias("percent"))


def most_common(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Counts, largest first; of equal counts the value that occurs first."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


def flow(refs: DataFrame, modality: str) -> DataFrame:
    """One row with the numbers of the flow diagram, in one pass."""
    unique = ~F.col("is_duplicate")
    candidate = unique & ~F.col("relevance").eqNullSafe(F.lit(OFF_TOPIC))
    assessed = candidate & ~F.col("access_status").eqNullSafe(F.lit("broken"))
    included = assessed & F.col("grade").isin(*grades_of(modality))
    return refs.agg(
        F.count(F.lit(1)).alias("identified"),
        F.count_if("is_duplicate").alias("duplicates"),
        F.count_if(unique).alias("screened"),
        F.count_if(unique & (F.col("relevance") == OFF_TOPIC)).alias("excluded_screening"),
        F.count_if(candidate & (F.col("access_status") == "broken")).alias("not_retrieved"),
        F.count_if(candidate & (F.col("access_status") == "restricted")).alias("to_obtain"),
        F.count_if(assessed).alias("assessed"),
        F.count_if(assessed & F.col("retracted")).alias("retracted"),
        F.count_if(assessed & F.contains(F.coalesce("relevance_method", F.lit("")), F.lit("llm_divergent"))).alias("divergent"),
        F.count_if(included).alias("included"),
    )


def activity(refs: DataFrame) -> DataFrame:
    """One row: active rows, those that are retracted, and those of direct relevance."""
    live = refs.where(~F.col("is_duplicate"))
    return live.agg(F.count_if("retracted").alias("retracted"), F.count_if(F.col("relevance") == DIRECT).alias("direct"), F.count(F.lit(1)).alias("active"))


def screening_counts(refs: DataFrame) -> DataFrame:
    """One row: active rows by relevance, and those that the first rules closed (they are no rows off topic)."""
    live = refs.where(~F.col("is_duplicate"))
    closed = F.col("relevance_method").isin("no_text", "pub_type_excluded", "nao_e_revisao", "exclusion_keyword")
    off = F.col("relevance") == OFF_TOPIC
    return live.agg(
        F.count_if(F.col("relevance") == DIRECT).alias("direct"), F.count_if(F.col("relevance") == TANGENTIAL).alias("tangential"), F.count_if(off & ~closed).alias("off_topic"),
        F.count_if(closed).alias("closed"), F.count_if(F.size("mapped_axes") > 0).alias("mapped"),
    )


def exclusion_reasons(refs: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.split_part(F.coalesce("relevance_method", F.lit("")), F.lit("|"), F.lit(1)), F.lit("")), F.lit("unclassified"))
    return refs.where(~F.col("is_duplicate") & (F.col("relevance") == OFF_TOPIC)).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def coverage(refs: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Gold and silver rows of each axis, zeros too: at least three are adequate."""
    told = refs.where(~F.col("is_duplicate") & F.col("grade").isin("gold", "silver")).select(F.explode("mapped_axes").alias("axis"), "grade")
    counts = told.groupBy("axis").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("grade") == "gold").alias("gold"))
    out = domain_frame(refs.sparkSession, axes, "axis").join(counts, "axis", "left")
    total, gold = F.coalesce("total", F.lit(0)), F.coalesce("gold", F.lit(0))
    status = F.when(total >= 3, "adequate").when(total > 0, "insufficient").otherwise("none")
    return out.select("position", "axis", total.alias("total"), gold.alias("gold"), (total - gold).alias("silver"), status.alias("status"))


def t1_alert(refs: DataFrame, modality: str) -> DataFrame:
    """Share of T1 among unique rows, and whether it is below what the modality asks for."""
    least = T1_SHARE.get(modality, 50)
    share = F.coalesce(F.try_divide(F.count_if(F.col("tier") == "T1") * 100.0, F.count(F.lit(1))), F.lit(0.0))
    return refs.where(~F.col("is_duplicate")).agg(share.alias("share")).withColumn("alert", (F.col("share") < least) & F.lit(least > 0))


def validation_list(refs: DataFrame, most: int, margin: int = 10) -> DataFrame:
    """The first `most` rows by score, and `margin` borderline rows after them."""
    active = refs.where(~F.col("is_duplicate") & (F.col("relevance") != OFF_TOPIC))
    top = active.orderBy(F.desc("relevance_score"), "_seq").limit(most + margin)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("relevance_score"), "_seq")))
    return ranked.select("rank", "id", "title", "relevance_score", F.when(F.col("rank") <= most, "selected").otherwise("borderline").alias("label"))


def brief(refs: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Final rows axis by axis, numbered throughout: within the axis, after as many as the axes before have."""
    dim = domain_frame(refs.sparkSession, axes, "axis")
    told = refs.where("final").select("id", "_seq", "relevance_score", F.explode("mapped_axes").alias("axis")).join(F.broadcast(dim), "axis")
    counts = told.groupBy("position").agg(F.count(F.lit(1)).alias("_n"))
    since = counts.select("position", (F.sum("_n").over(W.orderBy("position")) - F.col("_n")).alias("_since"))  # a row an axis
    place = F.row_number().over(W.partitionBy("position").orderBy(F.desc("relevance_score"), "_seq"))
    return told.withColumn("_place", place).join(F.broadcast(since), "position").select((F.col("_since") + F.col("_place")).alias("number"), "axis", "id")
