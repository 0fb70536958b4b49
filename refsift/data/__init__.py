"""Tables of fixed values, kept as text beside this file; projects may pass tables of their own instead."""

from __future__ import annotations

import csv
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession


def _lines(name: str) -> list[str]:
    text = files(__name__).joinpath(name).read_text(encoding="utf-8")
    return [line for line in text.splitlines() if line and not line.startswith("#")]


def domain_tiers(spark: SparkSession) -> DataFrame:
    """domain, tier of some two hundred domains."""
    rows = list(csv.reader(_lines("domain_tiers.csv")))[1:]
    return spark.createDataFrame([tuple(r) for r in rows], "domain string, tier string")


def health_categories(spark: SparkSession) -> DataFrame:
    """categoria: the subject categories that count as health."""
    return spark.createDataFrame([(c,) for c in _lines("health_categories.txt")], "categoria string")


def claim_terms() -> dict[str, list[str]]:
    """Composite terms and what sources in English call them."""
    return {term: english.split(";") for term, english in list(csv.reader(_lines("claim_terms.csv")))[1:]}


def claim_stop_words() -> list[str]:
    """Words that say nothing about a claim's theme."""
    return [w for line in _lines("claim_stop_words.txt") for w in line.split()]
