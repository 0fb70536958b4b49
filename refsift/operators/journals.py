"""Publication venues: eligibility verdict and score for choosing finalists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .keyed import first_hit, latest

# Weights of the components, and of the verdicts within the first one.
WEIGHTS = {"consolidacao": 0.40, "fit_tematico": 0.25, "apc": 0.12, "oa": 0.08, "seletividade": 0.08, "indexacao": 0.07}
VERDICT_VALUE = {"porta_a_q1": 1.00, "porta_a_q2": 0.85, "porta_b": 0.85, "nao_por_scimago": 0.45, "sem_dado": 0.35, "sem_categoria_saude": 0.10}
APC_CEILING = 5000.0
FINALISTS = 12


def load_weights(path: str) -> dict[str, float]:
    """Weights of the components from a file (YAML, key `pesos`); components that it lacks keep theirs."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = (yaml.safe_load(f) or {}).get("pesos") or {}
    unknown = set(given) - set(WEIGHTS)
    if unknown:
        raise ValueError(f"unknown components: {sorted(unknown)}")
    return WEIGHTS | {k: float(v) for k, v in given.items()}


def categories_of(journals: DataFrame, categories: DataFrame) -> DataFrame:
    """issn_l -> all categories (categoria, quartil) of the latest year of its first ISSN with data."""
    top = latest(categories, ["issn"], "ano").groupBy("issn").agg(F.collect_set(F.struct("categoria", "quartil")).alias("cats"))
    return first_hit(journals, "issn_l", "issns", top, "issn", "cats")


def verdict(journals: DataFrame, categories: DataFrame, collection: DataFrame, health: DataFrame) -> DataFrame:
    """journals with porta_a_status, porta_a_categoria, porta_a_quartil, porta_a_categorias, porta_b_scielo_sp and
    consolidado. health: categoria, the categories that count; collection: issn, titulo."""
    cats = categories_of(journals, categories)
    parts = cats.select("issn_l", F.explode("cats").alias("c")).select("issn_l", "c.categoria", "c.quartil")
    good = parts.join(F.broadcast(health.select("categoria").distinct()), "categoria", "left_semi")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(q) for q in ("Q1", "Q2", "Q3", "Q4")]), F.col("quartil")), F.lit(9))
    rank = F.when(rank == 0, 9).otherwise(rank).cast("int")
    kept = good.groupBy("issn_l").agg(F.array_sort(F.collect_list(F.struct(rank.alias("o"), "categoria", "quartil"))).alias("g"))
    members = first_hit(journals, "issn_l", "issns", collection, "issn", "titulo").select("issn_l", F.col("titulo").alias("porta_b_titulo"))
    out = journals.join(cats, "issn_l", "left").join(kept, "issn_l", "left").join(members, "issn_l", "left")
    best = F.get("g", F.lit(0))
    status = F.when(F.col("cats").isNull(), "sem_dado").when(F.col("g").isNull(), "sem_categoria_saude").when(best["quartil"].isin("Q1", "Q2"), "consolidado").otherwise("nao_por_scimago")
    member = F.col("porta_b_titulo").isNotNull()
    return out.withColumns(
        {
            "porta_a_status": status,
            "porta_a_categoria": best["categoria"],
            "porta_a_quartil": best["quartil"],
            "porta_a_categorias": F.transform("g", lambda x: F.struct(x["categoria"].alias("categoria"), x["quartil"].alias("quartil"))),
            "porta_b_scielo_sp": member,
            "consolidado": (status == "consolidado") | member,
        }
    ).drop("cats", "g")


def pre_score(journals: DataFrame, query: str, frequency: DataFrame, curated: DataFrame, interest: Sequence[str] = (), weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """journals with pre_score (4 places) and flags. frequency: issn_l, n; curated: issn_l."""
    most = F.broadcast(frequency.agg(F.greatest(F.max("n"), F.lit(1)).alias("_most")))
    out = journals.join(frequency.select("issn_l", F.col("n").alias("_n")), "issn_l", "left").join(most, F.lit(True))
    out = out.join(curated.select("issn_l", F.lit(True).alias("_curated")).distinct(), "issn_l", "left")
    status, quartile, member = F.col("porta_a_status"), F.col("porta_a_quartil"), F.coalesce(F.col("porta_b_scielo_sp").cast("boolean"), F.lit(False))
    v = VERDICT_VALUE
    base = (
        F.when((status == "consolidado") & (quartile == "Q1"), v["porta_a_q1"])
        .when((status == "consolidado") & (quartile == "Q2"), v["porta_a_q2"])
        .when(member, v["porta_b"])
        .when(status == "nao_por_scimago", v["nao_por_scimago"])
        .when(status == "sem_categoria_saude", v["sem_categoria_saude"])
        .otherwise(v["sem_dado"])
    )
    wanted = tokens(F.lit(query))
    own = tokens(F.array_join(F.coalesce("topicos", F.array().cast("array<string>")), " "))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, own)).cast("double"), F.size(wanted)), F.lit(0.0))
    cats = F.transform(F.coalesce("porta_a_categorias", F.array().cast("array<struct<categoria:string,quartil:string>>")), lambda c: c["categoria"])
    hit = F.arrays_overlap(cats, F.array(*[F.lit(c) for c in interest])) if interest else F.lit(False)
    fit = 0.5 * F.coalesce("_n", F.lit(0)) / F.col("_most") + 0.5 * overlap + F.when(F.col("_curated"), 0.3).otherwise(0.0) + F.when(hit, 0.15).otherwise(0.0)
    parts = {
        "consolidacao": F.when(member, F.greatest(base, F.lit(v["porta_b"]))).otherwise(base),
        "fit_tematico": F.least(F.lit(1.0), fit),
        "apc": F.when(F.col("apc_usd").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("apc_usd") / APC_CEILING)).when(F.col("apc_valor") == 0, 1.0).otherwise(0.5),
        "oa": F.when(F.col("is_oa") == 1, 1.0).when(F.col("is_oa") == 0, 0.3).otherwise(0.5),
        "seletividade": F.when(F.col("citedness_2yr").isNotNull(), F.least(F.lit(1.0), F.col("citedness_2yr") / 10)).otherwise(0.3),
        "indexacao": F.when(F.col("medline_indexado") == 1, 1.0).when(F.col("medline_indexado") == 0, 0.0).otherwise(0.4),
    }
    total = sum(weights.values())
    score = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0)) / total
    flags = F.filter(
        F.array(
            F.when((status == "consolidado") & quartile.isin("Q1", "Q2"), None).when(member, F.lit("porta_b")).otherwise(F.coalesce(status, F.lit("sem_dado"))),
            F.when(F.col("apc_usd").isNull() & ~F.coalesce(F.col("apc_valor") == 0, F.lit(False)), F.lit("apc_unknown")),
            F.when(F.col("is_oa").isNull(), F.lit("oa_unknown")),
            F.when(F.col("citedness_2yr").isNull(), F.lit("metrics_unknown")),
            F.when(F.col("medline_indexado").isNull(), F.lit("indexing_unknown")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.withColumns({"pre_score": F.bround(score, 4), "flags": flags}).drop("_n", "_most", "_curated")


def finalists(scored: DataFrame, top: int = FINALISTS) -> DataFrame:
    """By rounded score, ties by ISSN."""
    return scored.orderBy(F.desc("pre_score"), "issn_l").limit(top)


def candidates(works: DataFrame, base: DataFrame, curated: DataFrame, common: int = 90, new: int = 30) -> DataFrame:
    """issn_l of curated and known venues, and of the first `new` unknown ones among the `common` most frequent."""
    counts = works.groupBy("issn_l").agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("first"))
    head = counts.orderBy(F.desc("n"), "first").limit(common)
    unknown = head.join(base.select("issn_l"), "issn_l", "left_anti").orderBy(F.desc("n"), "first").limit(new).select("issn_l")
    known = counts.join(base.select("issn_l"), "issn_l", "left_semi").select("issn_l")
    return curated.select("issn_l").unionByName(known).unionByName(unknown).distinct().orderBy("issn_l")
