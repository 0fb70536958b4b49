"""Command line: stages of a review, its reports, and checks of a text's references, claims and facts.

    python -m refsift.cli run --scope scope.yaml --raw records/ --folder review/ [--from-stage screened]
    python -m refsift.cli audit|flow|coverage|brief|to-obtain|validation|verification|status --scope scope.yaml --folder review/
    python -m refsift.cli verify-refs --text chapter.md --answers answers/
    python -m refsift.cli verify-claims --text chapter.md --contents contents/

Tables are folders of Parquet; answers of services are given as tables, since connectors run elsewhere. Reports go to
--out (a folder of text), or to the screen. The exit code is 1 on any error, where a reference differs from its source,
and where a claim is of critical or high risk.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import data
from .operators import claims, dedup, facts, journals, keyed, records, screening, vancouver, venues, written
from .operators.dedup import resolve_latest
from .plans import review
from .plans.scope import Scope, load_scope, pubmed_query
from .sources import sinks, tables
from .sources import text as texts

Command = Callable[[SparkSession, argparse.Namespace], int]
COMMANDS: dict[str, tuple[Command, tuple[str, ...]]] = {}
#: Every option that a command may ask for, with its help.
OPTIONS = {
    "scope": "the review's configuration (YAML)",
    "folder": "folder of the review's stages",
    "raw": "records to start from",
    "tiers": "CSV with the columns domain and tier (else the table that comes with the package)",
    "text": "a Markdown text",
    "answers": "table of a service's answers",
    "contents": "table of the cited works' contents",
    "registry": "folder of the facts registry",
    "pending": "table of facts to be imported",
    "verdicts": "file of verdicts, one JSON row a line",
    "vectors": "table of id and embedding",
    "query": "file with the embedding of the question, a JSON list",
    "section": "name of a section",
    "source": "files to read",
    "base": "table of venues",
    "works": "table of works found for a text (issn_l, _seq)",
    "curated": "table of curated venues (issn_l)",
    "theme": "what to look for",
    "profile": "file of a profile (JSON)",
    "manuscript": "file of a manuscript (Markdown)",
    "categories": "CSV of subject categories",
    "collection": "JSON of a collection of venues",
    "crossref": "table of a second service's answers",
    "as_of": "the day that counts, as YYYY-MM-DD",
}
#: Stages whose table a later step reads, the latest first.
CHECKPOINTS = ("verified", "dedup", "raw")


class Failure(Exception):
    """What the user is told, with exit code 1."""


def command(name: str, *needs: str) -> Callable[[Command], Command]:
    def add(f: Command) -> Command:
        COMMANDS[name] = (f, needs)
        return f

    return add


def _latest(spark: SparkSession, args: argparse.Namespace, stages: tuple[str, ...] = tuple(reversed(review.STAGES))) -> DataFrame:
    refs = resolve_latest(spark, [f"{args.folder}/{s}" for s in stages])
    if refs is None:
        raise Failure("no stage has been run")
    return refs


def _tell(args: argparse.Namespace, report: DataFrame) -> int:
    if args.out:
        written.write(report, args.out)
    else:
        print(written.text_of(report))
    return 0


def _write(args: argparse.Namespace, df: DataFrame) -> int:
    if not args.out:
        raise Failure("--out is needed")
    df.write.mode("overwrite").parquet(args.out)
    return 0


def _report(name: str, make: Callable[[DataFrame, Scope], DataFrame]) -> None:
    @command(name, "scope", "folder")
    def tell(spark: SparkSession, args: argparse.Namespace) -> int:
        return _tell(args, make(_latest(spark, args), load_scope(args.scope)))


for _name, _make in {
    "audit": written.audit,
    "flow": written.flow,
    "coverage": written.coverage,
    "brief": written.brief,
    "validation": written.validation,
    "to-obtain": lambda refs, scope: written.to_obtain(refs),
    "verification": lambda refs, scope: written.verification(refs),
}.items():
    _report(_name, _make)


@command("run", "scope", "folder")
def run(spark: SparkSession, args: argparse.Namespace) -> int:
    scope = load_scope(args.scope)
    tiers = spark.read.csv(args.tiers, header=True, comment="#") if args.tiers else data.domain_tiers(spark)
    raw = spark.read.parquet(args.raw) if args.raw else None
    if raw is None and args.from_stage == review.STAGES[0]:
        raise Failure("--raw is needed to start from the first stage")
    review.run(spark, raw, args.folder, review.stages(scope, tiers), args.from_stage, args.to_stage)
    return 0


@command("scope", "scope")
def scope(spark: SparkSession, args: argparse.Namespace) -> int:
    found = load_scope(args.scope)
    print(f"{found.project} ({found.modality}): {len(found.blocks)} blocks, {len(found.axes)} axes\n{pubmed_query(found)}")
    for warning in found.warnings:
        print(f"warning: {warning}")
    return 0


@command("search", "source", "out")
def search(spark: SparkSession, args: argparse.Namespace) -> int:
    """Tables of records, separated by commas, in the order of the configuration."""
    paths = args.source.split(",")
    found, log = tables.search(spark, [(p, lambda p=p: spark.read.parquet(p)) for p in paths])
    _write(args, found)
    print(written.text_of(written.search_log(spark, log, {})))
    return 1 if log.where("error is not null").count() == len(paths) else 0


@command("verify", "scope", "folder", "answers")
def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    refs = _latest(spark, args, ("dedup", "raw"))
    answers = spark.read.parquet(args.answers)
    records.integrity(records.verify(refs, answers), answers).write.mode("overwrite").parquet(f"{args.folder}/verified")
    return _tell(args, written.verification(spark.read.parquet(f"{args.folder}/verified")))


@command("export", "scope", "folder")
def export(spark: SparkSession, args: argparse.Namespace) -> int:
    entries = sinks.bibtex(_latest(spark, args), records.grades_of(load_scope(args.scope).modality))
    entries.orderBy("_seq").select(F.col("entry").alias("value")).write.mode("overwrite").text(f"{args.folder}/refs.bib")
    return 0


@command("status", "folder")
def status(spark: SparkSession, args: argparse.Namespace) -> int:
    refs = _latest(spark, args)
    print(sinks.markdown_table(refs.agg(F.count(F.lit(1)).alias("records"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(F.col("grade").isin("gold", "silver")).alias("selected"))))
    return 0


@command("seed", "source", "out")
def seed(spark: SparkSession, args: argparse.Namespace) -> int:
    files = texts.whole_files(spark, args.source)
    found = texts.seeds(files).select("file", "at", "doi", *[F.lit(None).cast("string").alias(c) for c in ("title", "author")])
    return _write(args, found.unionByName(texts.text_references(files).select("file", "at", F.lit(None).cast("string").alias("doi"), "title", "author")))


@command("extract", "folder", "contents", "out")
def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    sinks.write_notes(sinks.reference_notes(_latest(spark, args), spark.read.parquet(args.contents)), args.out)
    return 0


@command("extract-manual", "source", "contents", "out")
def extract_manual(spark: SparkSession, args: argparse.Namespace) -> int:
    """source: table of notes (name, note); contents: name, content, from files given by hand."""
    sinks.write_notes(sinks.with_content(spark.read.parquet(args.source), spark.read.parquet(args.contents)), args.out)
    return 0


@command("import-ris", "source", "out")
def import_ris(spark: SparkSession, args: argparse.Namespace) -> int:
    return _write(args, tables.conformed(texts.ris(texts.split_lines(spark, args.source), "ris")))


@command("verify-refs", "text", "answers")
def verify_refs(spark: SparkSession, args: argparse.Namespace) -> int:
    entries = texts.numbered_references(texts.split_lines(spark, args.text)).withColumn("pmid", F.lit(None).cast("string"))
    told = dedup.cut(vancouver.verify(entries, spark.read.parquet(args.answers)))
    _tell(args, written.references(told, Path(args.text).name))
    return int(vancouver.failed(told))


@command("verify-claims", "text", "contents")
def verify_claims(spark: SparkSession, args: argparse.Namespace) -> int:
    files = texts.whole_files(spark, args.text).select(F.col("file").alias("doc"), "text")
    told = dedup.cut(claims.verify(claims.extract(files), spark.read.parquet(args.contents)))
    _tell(args, written.claims(told))
    return int(written.blocking(told))


@command("extract-facts", "contents", "out")
def extract_facts(spark: SparkSession, args: argparse.Namespace) -> int:
    found = facts.number_candidates(spark.read.parquet(args.contents))
    return _write(args, found.withColumn("warnings", facts.warnings(F.col("context"))))


def _registry(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    known = sinks.read_version(spark, args.registry, facts.FACTS)
    if known is None:
        raise Failure("the registry is empty")
    return known


@command("facts-import", "pending", "contents", "registry")
def facts_import(spark: SparkSession, args: argparse.Namespace) -> int:
    known = sinks.read_version(spark, args.registry, facts.FACTS)
    told = facts.import_pending(spark.read.parquet(args.pending), spark.read.parquet(args.contents))
    # new facts follow the known ones; an earlier fact keeps its place before those that equal it
    if known is not None:
        told = told.withColumn("_seq", F.col("_seq") + F.lit(known.agg(F.coalesce(F.max("_seq") + 1, F.lit(0))).first()[0]))
        told = known.unionByName(told, allowMissingColumns=True)
    kept = facts.distinct_facts(told).withColumn("id", F.coalesce("id", facts.fact_id()) if "id" in told.columns else facts.fact_id())
    print(f"version {sinks.write_version(kept, args.registry)}")
    return 0


@command("facts-status", "registry")
def facts_status(spark: SparkSession, args: argparse.Namespace) -> int:
    told = facts.tallies(_registry(spark, args))
    return _tell(args, written.joined([written.said(spark, 0, written.heading("kind", "value", "facts")), written.listed(1, told, written.cells("kind", "value", "n"), F.xxhash64("kind", "value"))]))


@command("facts-report", "registry")
def facts_report(spark: SparkSession, args: argparse.Namespace) -> int:
    known = _registry(spark, args)
    return _tell(args, written.section_brief(known, args.section) if args.section else written.facts(known, Path(args.registry).name))


@command("facts-crosscheck", "registry", "source")
def facts_crosscheck(spark: SparkSession, args: argparse.Namespace) -> int:
    """source: claims report (JSON)."""
    told = dedup.cut(facts.cross_check(tables.claim_values(tables.claims_json(spark, args.source)), _registry(spark, args)))
    _tell(args, written.joined([written.said(spark, 0, written.heading("claim", "value", "fact", "status")), written.listed(1, told, written.cells("claim", "value", "fact_value", "status"), F.col("claim"))]))
    return int(told.where("status = 'NAO_REGISTRADO'").limit(1).count() > 0)


@command("screen-export", "folder", "out")
def screen_export(spark: SparkSession, args: argparse.Namespace) -> int:
    sinks.screening_batch(_latest(spark, args, CHECKPOINTS)).write.mode("overwrite").text(args.out)
    return 0


@command("screen-import", "folder", "verdicts")
def screen_import(spark: SparkSession, args: argparse.Namespace) -> int:
    good, wrong = texts.verdicts(spark, args.verdicts)
    told = dedup.cut(screening.merge_verdicts(_latest(spark, args, CHECKPOINTS), good))
    told.write.mode("overwrite").parquet(f"{args.folder}/verified")
    choice = told.where("not is_duplicate and llm_verdict in ('include', 'exclude')").select(screening.keyword_choice(F.col("relevance")).alias("one"), F.col("llm_verdict").alias("two"))
    _tell(args, written.screening(told, screening.kappa(choice), screening.divergences(told)))
    for r in wrong.orderBy("_line").limit(written.MISSING).collect():
        print(f"line {r['_line']}: {r['reason']}", file=sys.stderr)
    return 0


@command("semantic", "scope", "folder", "vectors", "query")
def semantic(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scores, relevance and method of the first table that exists; relevance_score is worked out by the screening."""
    plan, refs = load_scope(args.scope), _latest(spark, args, CHECKPOINTS)
    asked = json.loads(Path(args.query).read_text(encoding="utf-8"))
    told = screening.semantic_layer(refs, spark.read.parquet(args.vectors), asked, plan.semantic_threshold, plan.semantic_weight)
    told = dedup.cut(told.drop("relevance_score").join(refs.select("_seq", "relevance_score"), "_seq").select(*refs.columns))
    told.write.mode("overwrite").parquet(f"{args.folder}/semantic")
    scored = told.where("semantic_score is not null")
    print(sinks.markdown_table(scored.orderBy(F.desc("semantic_score"), "_seq").select("id", "title", "semantic_score").limit(5)))
    saved = scored.where(F.contains(F.coalesce("relevance_method", F.lit("")), F.lit("semantic_rescue")))
    print(sinks.markdown_table(saved.orderBy(F.desc("semantic_score"), "_seq").select("id", "title", "semantic_score").limit(10)))
    return 0


@command("descriptors", "answers")
def descriptors(spark: SparkSession, args: argparse.Namespace) -> int:
    return _tell(args, written.descriptors(venues.descriptors(spark.read.parquet(args.answers))))


@command("journals-import", "categories", "out")
def journals_import(spark: SparkSession, args: argparse.Namespace) -> int:
    return _write(args, tables.categories(spark, args.categories))


@command("journals-collection", "collection", "out")
def journals_collection(spark: SparkSession, args: argparse.Namespace) -> int:
    return _write(args, tables.collection(spark, args.collection))


@command("journals-strata", "source", "out")
def journals_strata(spark: SparkSession, args: argparse.Namespace) -> int:
    return _write(args, tables.strata(spark, args.source)[0])


@command("journals-seed", "source", "answers", "crossref", "as_of", "out")
def journals_seed(spark: SparkSession, args: argparse.Namespace) -> int:
    entries = texts.curated_list(texts.split_lines(spark, args.source))
    told, _ = venues.seed(entries, Path(args.source).name, spark.read.parquet(args.answers), spark.read.parquet(args.crossref), F.lit(args.as_of).cast("date"))
    return _write(args, told)


@command("journals-verdict", "base", "categories", "collection", "out")
def journals_verdict(spark: SparkSession, args: argparse.Namespace) -> int:
    """categories, collection: tables that the imports have written."""
    return _write(args, journals.verdict(spark.read.parquet(args.base), spark.read.parquet(args.categories), spark.read.parquet(args.collection), data.health_categories(spark)))


@command("journals-show", "base", "source")
def journals_show(spark: SparkSession, args: argparse.Namespace) -> int:
    """source: an ISSN."""
    wanted = spark.range(1).select(F.lit(args.source).alias("issn"))
    found = venues.by_issn(wanted, spark.read.parquet(args.base)).select(F.to_json(F.struct("*")).alias("row")).collect()
    if not found:
        raise Failure(f"no venue with {args.source}")
    print(found[0]["row"])
    return 0


@command("journals-recommend", "base", "works", "curated")
def journals_recommend(spark: SparkSession, args: argparse.Namespace) -> int:
    read = lambda p: Path(p).read_text(encoding="utf-8") if p else None
    consult = venues.consultation(args.theme, read(args.profile), read(args.manuscript))
    return _tell(args, written.venues(*venues.recommend(consult, spark.read.parquet(args.works), spark.read.parquet(args.base), spark.read.parquet(args.curated))))


@command("journals-status", "base", "as_of")
def journals_status(spark: SparkSession, args: argparse.Namespace) -> int:
    base = spark.read.parquet(args.base)
    day = F.lit(args.as_of).cast("date")
    dated = [c for c in base.columns if c.endswith("_verificado_em")]
    print(sinks.markdown_table(base.agg(F.count(F.lit(1)).alias("venues"), *[F.count_if(keyed.expired(F.col(c), day, 180)).alias(f"stale_{c.removesuffix('_verificado_em')}") for c in dated])))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="refsift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=sorted(COMMANDS))
    for name, told in OPTIONS.items():
        p.add_argument("--" + name.replace("_", "-"), help=told)
    p.add_argument("--out", help="folder to write to")
    p.add_argument("--from-stage", default=review.STAGES[0], choices=review.STAGES)
    p.add_argument("--to-stage", default=review.STAGES[-1], choices=review.STAGES)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    work, needs = COMMANDS[args.command]
    missing = [n for n in needs if getattr(args, n) is None]
    if missing:
        print("needed: " + ", ".join("--" + n.replace("_", "-") for n in missing), file=sys.stderr)
        return 1
    try:
        return work(SparkSession.builder.appName("refsift").getOrCreate(), args)
    except Failure as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
