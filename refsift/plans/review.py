"""The review pipeline as one plan of stages; each stage is a table in the project's folder, from which a run can resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import dedup, records, screening
from .scope import Scope

STAGES = ("dedup", "verified", "classified", "screened", "accessed", "final")


def stages(scope: Scope, tiers: DataFrame, answers: DataFrame | None = None, probes: DataFrame | None = None, licences: DataFrame | None = None) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """name -> frame to frame. Without the tables of a service its stage passes rows through."""

    def screened(refs: DataFrame) -> DataFrame:
        return screening.mark_landmarks(screening.rank(screening.screen(refs, scope, with_hits=True), scope))

    return {
        "dedup": lambda r: dedup.deduplicate(r)[0],
        "verified": lambda r: records.verify(r, answers) if answers is not None else r,
        "classified": lambda r: records.classify(r, tiers),
        "screened": screened,
        "accessed": lambda r: records.add_access(r, probes, licences) if probes is not None and licences is not None else r,
        "final": lambda r: records.synthesize(r, scope.modality, scope.max_final),
    }


def run(spark: SparkSession, raw: DataFrame, folder: str, plan: dict[str, Callable[[DataFrame], DataFrame]], start: str = STAGES[0], stop: str = STAGES[-1]) -> DataFrame:
    """From stage `start` to stage `stop`. A later start reads the table of the stage before it; all tables from `start`
    on are written anew, so no stale one is ever picked up."""
    names = list(plan)
    i, j = names.index(start), names.index(stop)
    refs = raw if i == 0 else spark.read.parquet(f"{folder}/{names[i - 1]}")
    for name in names[i : j + 1]:
        plan[name](refs).write.mode("overwrite").parquet(f"{folder}/{name}")
        refs = spark.read.parquet(f"{folder}/{name}")
    return refs
