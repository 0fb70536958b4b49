"""Reports as frames of lines.

A report is a frame (section int, a double, b long, line string); its lines are in the order of the first three. Counts
are aggregated before they become lines; listings stay distributed, so a report of any length is written by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filled
from ..plans.scope import Scope
from ..schema import ACCESS, DIRECT, GRADES, OFF_TOPIC, RISK_OF_STATUS, RISKS, TANGENTIAL, TIERS
from . import records, reports

# Standards of reporting by modality, what a tier is, labels of exclusions.
STANDARDS = {"revisao-sistematica": "PRISMA 2020", "revisao-escopo": "PRISMA-ScR", "revisao-integrativa": "PRISMA 2020 (adapted)", "meta-revisao": "PRIOR"}
TIER_MEANING = {"T1": "peer-reviewed", "T2": "institution", "T3": "technical report", "T4": "blog, news", "UNKNOWN": "unclassified"}
STATUS_ORDER = (
    "MATH_ERROR", "NOT_FOUND_ALL_REFS", "NOT_FOUND_FULLTEXT", "NOT_FOUND_ABSTRACT", "APPROXIMATE_MATCH", "ENTITY_FOUND", "THEMATIC_MATCH", "VERIFIED",
    "UNVERIFIABLE",
)
ICONS = {
    "verified": "✅", "context_supported": "☑️", "derived": "⚙️", "verified_web": "\U0001f310", "unverifiable": "❓", "pending": "⏳",
    "stale": "⚠️", "rejected": "❌",
}
#: Rows that a list of discards shows, and candidates that a list of missing verdicts shows.
DISCARDS, MISSING = 50, 30


def said(spark: SparkSession, section: int, texts: Sequence[str]) -> DataFrame:
    """Given lines."""
    rows = F.array(*[F.lit(t) for t in texts]) if texts else F.array().cast("array<string>")
    one = spark.range(1).select(F.posexplode(rows).alias("b", "line"))
    return one.select(F.lit(section).alias("section"), F.lit(0.0).alias("a"), F.col("b").cast("long").alias("b"), "line")


def listed(section: int, rows: DataFrame, line: Column, b: Column, a: Column | None = None) -> DataFrame:
    """One line a row, in the order of a, then b."""
    return rows.select(F.lit(section).alias("section"), (a if a is not None else F.lit(0.0)).cast("double").alias("a"), b.cast("long").alias("b"), line.alias("line"))


def cells(*columns: Column | str) -> Column:
    """A row of a table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def heading(*names: str) -> list[str]:
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]


def joined(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy("section", "a", "b")


def text_of(report: DataFrame, most: int = 5000) -> str:
    """A short report as one text; over `most` lines it is written by `write` instead."""
    lines = ordered(report).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"over {most} lines: write the report")
    return "\n".join(r["line"] for r in lines) + "\n"


def write(report: DataFrame, path: str) -> None:
    """The lines as text; the parts of the folder follow each other in order."""
    ordered(report).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def short(c: Column, n: int, more: str = "...") -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def percent(c: str = "percent") -> Column:
    return F.concat(F.format_string("%.1f", F.col(c)), F.lit("%"))


def _shares(section: int, rows: DataFrame, column: str, values: Sequence, name: Column, *more: Column) -> DataFrame:
    told = reports.by_domain(rows, column, values)
    return listed(section, told, cells(name, "n", percent(), *more), F.col("position"))


def by_source(refs: DataFrame, none: str = "seed/manual") -> DataFrame:
    """source_api, n, first: records of each source, most first."""
    named = refs.withColumn("source_api", F.coalesce(filled(F.col("source_api")), F.lit(none)))
    return reports.most_common(named, "source_api", "_seq")


def pending(refs: DataFrame) -> DataFrame:
    """Active rows that aren't discarded and that a person must still settle, with their pendencies."""
    active = refs.where(~F.col("is_duplicate") & (F.col("grade") != "discard"))
    return active.withColumn("pendencies", records.pendencies()).where(F.size("pendencies") > 0)


def audit(refs: DataFrame, scope: Scope) -> DataFrame:
    spark, active = refs.sparkSession, refs.where(~F.col("is_duplicate"))
    method = F.coalesce("relevance_method", F.lit(""))
    n = refs.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_duplicate")).alias("active"),
        *[F.count_if(~F.col("is_duplicate") & c).alias(k) for k, c in {
            "by_type": method == "pub_type_excluded", "by_word": method == "exclusion_keyword", "direct": F.col("relevance") == DIRECT, "tangential": F.col("relevance") == TANGENTIAL,
            "off": F.col("relevance") == OFF_TOPIC, "gold": F.col("grade") == "gold", "silver": F.col("grade") == "silver",
            "retracted": F.coalesce("retracted", F.lit(False)), "corrected": F.coalesce("has_correction", F.lit(False)),
        }.items()],
    ).first().asDict()
    steps = [
        ("identified", n["total"]), ("after deduplication", n["active"]), ("excluded by publication type", n["by_type"]), ("excluded by words off topic", n["by_word"]),
        ("screened by co-occurrence", n["direct"] + n["tangential"]), ("direct", n["direct"]), ("tangential", n["tangential"]), ("off topic", n["off"]), ("selected (gold and silver)", n["gold"] + n["silver"]),
        ("duplicates", n["total"] - n["active"]), ("retracted", n["retracted"]), ("corrected", n["corrected"]),
    ]
    grade, gold = F.col("grade"), F.col("grade") == "gold"
    alert = reports.t1_alert(refs, scope.modality).where("alert")
    discarded = active.where(grade == "discard").withColumn("reason", records.discard_reason())
    head = discarded.orderBy("_seq").limit(DISCARDS)
    author = F.concat(F.coalesce(F.get("authors", F.lit(0)), F.lit("?")), F.when(F.size("authors") > 1, " et al.").otherwise(""))
    title = F.coalesce("title", F.lit(""))
    criteria = [x for name, given in (("Inclusion", scope.inclusion), ("Exclusion", scope.exclusion)) if given for x in (f"{name}:", *[f"- {c}" for c in given], "")]
    tiers = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_MEANING.items() for x in kv]), F.col("tier"))
    return joined(
        [
            said(spark, 0, [f"# Audit: {scope.project}", "", f"Modality: {scope.modality}", "", "## Flow", "", *heading("step", "records"), *[f"| {k} | {v} |" for k, v in steps], "", *criteria, f"Sources: {', '.join(scope.sources) or '-'}; years {scope.years[0]} to {scope.years[1]}; languages {', '.join(scope.languages)}", "", "## Pending", "", *heading("id", "title", "DOI", "pendencies")]),
            listed(1, pending(refs), cells("id", F.substring(title, 1, 60), F.coalesce(filled(F.col("doi")), F.lit("-")), F.array_join("pendencies", "; ")), F.col("_seq")),
            said(spark, 2, ["", "## Grades", "", *heading("grade", "records", "share")]),
            _shares(3, active, "grade", GRADES, F.upper("grade")),
            said(spark, 4, ["", "## Tiers", "", *heading("tier", "records", "share", "meaning")]),
            _shares(5, active, "tier", tuple(TIERS), F.col("tier"), tiers),
            listed(6, alert, F.concat(F.lit("> ALERT: T1 is at "), F.format_string("%.0f", F.col("share")), F.lit(f"%, below the {reports.T1_SHARE.get(scope.modality, 50)}% that {scope.modality} asks for")), F.lit(0)),
            said(spark, 7, ["", "## Relevance", "", *heading("relevance", "records", "share")]),
            _shares(8, active, "relevance", (DIRECT, TANGENTIAL, OFF_TOPIC), F.col("relevance")),
            said(spark, 9, ["", "## Access", "", *heading("status", "records", "share")]),
            _shares(10, active, "access_status", ACCESS, F.col("access_status")),
            said(spark, 11, ["", "## Sources", "", *heading("source", "records")]),
            listed(12, by_source(active), cells("source_api", "n"), F.col("first"), -F.col("n")),
            said(spark, 13, ["", "## Discarded", "", *heading("id", "title", "reason")]),
            listed(14, head, cells("id", short(title, 60), "reason"), F.col("_seq")),
            listed(15, discarded.agg((F.count(F.lit(1)) - DISCARDS).alias("n")).where("n > 0"), F.concat(F.lit("and "), F.col("n").cast("string"), F.lit(" more")), F.lit(0)),
            said(spark, 16, ["", "## Gold", "", *heading("authors", "year", "title", "DOI", "tier", "score", "axes")]),
            listed(17, active.where(gold), cells(author, F.coalesce(F.col("year").cast("string"), F.lit("?")), short(title, 50), F.coalesce(filled(F.col("doi")), F.lit("-")), "tier", F.format_string("%.1f", F.col("relevance_score")), F.array_join(F.slice("mapped_axes", 1, 2), ", ")), F.col("_seq"), -F.col("relevance_score")),
        ]
    )


def flow(refs: DataFrame, scope: Scope) -> DataFrame:
    """The flow diagram with its tables: records by database, exclusions by reason, what is included by grade."""
    spark = refs.sparkSession
    n = reports.flow(refs, scope.modality).first().asDict()
    sources = by_source(refs)
    included = refs.where(~F.col("is_duplicate") & ~F.col("relevance").eqNullSafe(F.lit(OFF_TOPIC)) & ~F.col("access_status").eqNullSafe(F.lit("broken")) & F.col("grade").isin(*records.grades_of(scope.modality)))
    diagram = [
        "```mermaid", "flowchart TD", f'    A["Identified: {n["identified"]}"] --> B["Duplicates: {n["duplicates"]}"]', f'    A --> C["Screened: {n["screened"]}"]',
        f'    C --> D["Excluded: {n["excluded_screening"]}"]', f'    C --> E["Not retrieved: {n["not_retrieved"]}"]', f'    C --> G["Assessed: {n["assessed"]}"]',
        f'    G --> H["Retracted: {n["retracted"]}, divergent: {n["divergent"]}"]', f'    G --> I["Included: {n["included"]}"]', "```",
    ]
    return joined(
        [
            said(spark, 0, [f"# Flow: {scope.project}", "", f"Standard: {STANDARDS.get(scope.modality, 'PRISMA 2020 (simplified)')}", f"Modality: {scope.modality}", "", *diagram, "", "## Identification", "", *heading("database", "records")]),
            listed(1, sources, cells("source_api", "n"), F.col("first"), -F.col("n")),
            said(spark, 2, [f"| total | {n['identified']} |", f"| duplicates | {n['duplicates']} |", "", "## Screening", "", *heading("reason", "records")]),
            listed(3, reports.exclusion_reasons(refs), cells("reason", "n"), F.xxhash64("reason"), -F.col("n")),
            said(spark, 4, ["", "## Retrieval", "", *[f"- {k.replace('_', ' ')}: {n[k]}" for k in ("not_retrieved", "to_obtain", "assessed", "retracted", "divergent", "included")], ""]),
            listed(5, included.groupBy("grade").agg(F.count(F.lit(1)).alias("n")), F.concat(F.lit("  - "), F.col("grade"), F.lit(": "), F.col("n").cast("string")), F.xxhash64("grade"), -F.col("n")),
        ]
    )


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def claims(told: DataFrame) -> DataFrame:
    """Verified claims: counts by status, then the claims by risk."""
    spark = told.sparkSession
    status = reports.domain_frame(spark, STATUS_ORDER, "status").join(counts(told, "status"), "status")
    risk_of = F.element_at(F.create_map(*[F.lit(x) for kv in RISK_OF_STATUS.items() for x in kv]), F.col("status"))
    points = F.array_join(F.transform("data_points", lambda p: F.concat(p["raw"], F.lit(" (="), p["value"].cast("string"), p["unit"], F.lit(")"))), ", ")
    entry = F.concat(
        F.lit("### ["), F.array_join(F.transform("ref_numbers", lambda r: r.cast("string")), ","), F.lit("] "), F.col("status"), F.lit("\n\n"), F.col("claim_text"),
        F.lit("\n\ntype "), F.col("claim_type"), F.lit(", risk "), F.col("risk"), F.lit(", source "), F.coalesce("source_level", F.lit("none")),
        F.when(F.size("data_points") > 0, F.concat(F.lit("\n\ndata: "), points)).otherwise(""), F.lit("\n"),
    )
    place = F.array_position(F.array(*[F.lit(r) for r in RISKS]), F.col("risk"))
    sections = reports.domain_frame(spark, RISKS, "risk").join(counts(told, "risk"), "risk")
    return joined(
        [
            said(spark, 0, ["# Claims", "", *heading("status", "claims", "risk")]),
            listed(1, status, cells("status", "n", risk_of), F.col("position")),
            listed(2, sections, F.concat(F.lit("\n## Risk "), F.col("risk"), F.lit("\n")), F.lit(-1), F.col("position") + 1),
            listed(2, told, entry, F.xxhash64("doc", "paragraph", "ordinal").bitwiseAND(F.lit((1 << 62) - 1)), place),
        ]
    )


def blocking(told: DataFrame) -> bool:
    """Whether any claim is of critical or high risk: the command's exit code."""
    return told.where(F.col("risk").isin("CRITICAL", "HIGH")).limit(1).count() > 0


def icon(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv]), status), F.lit("❓"))


def _fact_line() -> Column:
    amount = F.concat_ws(" ", F.col("value").cast("string"), "unit")
    return F.concat_ws(" ", F.lit("-"), icon(F.col("status")), F.when(F.col("fact_type") == "quantitative", F.concat(amount, F.lit(" —"))), F.col("statement"))


def _by_reference(section: int, facts: DataFrame) -> list[DataFrame]:
    heads = facts.select("ref_number").distinct()
    return [
        listed(section, heads, F.concat(F.lit("\n### Ref ["), F.col("ref_number").cast("string"), F.lit("]\n")), F.lit(-1), F.col("ref_number")),
        listed(section, facts, _fact_line(), F.col("_seq"), F.col("ref_number")),
    ]


def facts(registry: DataFrame, project: str) -> DataFrame:
    """registry: _seq, ref_number, fact_type, status, value, unit, statement."""
    spark = registry.sparkSession
    total = registry.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ref_number").alias("refs"))
    return joined(
        [
            said(spark, 0, [f"# Facts: {project}", ""]),
            listed(1, total, F.concat(F.col("n").cast("string"), F.lit(" facts of "), F.col("refs").cast("string"), F.lit(" references")), F.lit(0)),
            said(spark, 2, ["", *heading("status", "facts")]),
            *[listed(s, counts(registry, c).withColumn("_p", F.row_number().over(_by(c))), cells(c, "n"), F.col("_p")) for s, c in ((3, "status"), (5, "fact_type"))],
            said(spark, 4, ["", *heading("type", "facts")]),
            *_by_reference(6, registry),
        ]
    )


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)  # over one row for each value of an enumeration


def section_brief(registry: DataFrame, section: str) -> DataFrame:
    """The facts of a section by reference, or all of them where it has none."""
    own = registry.where(F.array_contains("sections", section))
    found = own if own.limit(1).count() else registry
    legend = "Legend: " + " ".join(f"{v}={k}" for k, v in ICONS.items())
    return joined([said(registry.sparkSession, 0, [f"# Facts for section {section}"]), *_by_reference(1, found), said(registry.sparkSession, 2, ["", "---", legend])])


def references(told: DataFrame, name: str) -> DataFrame:
    """Verified numbered references by status."""
    spark = told.sparkSession
    order = F.array_position(F.array(*[F.lit(s) for s in ("mismatch", "error", "no_doi", "pmid_only", "skipped", "ok")]), F.col("status"))
    tally = reports.domain_frame(spark, ("ok", "mismatch", "skipped", "no_doi", "pmid_only", "error"), "status").join(counts(told, "status"), "status", "left")
    return joined(
        [
            said(spark, 0, [f"# References of {name}", "", *heading("status", "references")]),
            listed(1, tally, cells("status", F.coalesce("n", F.lit(0))), F.col("position")),
            said(spark, 2, ["", *heading("number", "status", "DOI", "differences", "reference")]),
            listed(3, told, cells("number", "status", F.coalesce("doi", F.lit("-")), F.array_join("issues", ", "), short(F.col("raw"), 120)), F.col("number"), order),
        ]
    )


def verification(refs: DataFrame) -> DataFrame:
    """Counters, and the rows that have issues."""
    stats = records.verification_stats(refs)
    rows = refs.where(~F.col("is_duplicate") & (F.size("verification_issues") > 0))
    counters = stats.select(F.posexplode(F.array(*[F.concat(F.lit(f"| {c} | "), F.col(c).cast("string"), F.lit(" |")) for c in stats.columns])).alias("b", "line"))
    return joined(
        [
            said(refs.sparkSession, 0, ["# Verification", "", *heading("counter", "records")]),
            listed(1, counters, F.col("line"), F.col("b")),
            said(refs.sparkSession, 2, ["", *heading("id", "title", "DOI", "issues")]),
            listed(3, rows, cells("id", short(F.col("title"), 60), F.coalesce(filled(F.col("doi")), F.lit("-")), F.array_join("verification_issues", "; ")), F.col("_seq")),
        ]
    )


def search_log(spark: SparkSession, log: DataFrame, queries: dict[str, str]) -> DataFrame:
    """log: position, source, records, error."""
    lines = [x for name, q in queries.items() for x in (f"### {name}", "", "```", q, "```", "")]
    return joined(
        [
            said(spark, 0, ["# Search", "", *heading("source", "records", "error")]),
            listed(1, log, cells("source", "records", F.coalesce("error", F.lit(""))), F.col("position")),
            said(spark, 2, ["", "## Queries", "", *lines]),
        ]
    )


def _entry() -> Column:
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), filled(F.col("doi"))), F.col("url"), F.lit("-"))
    who = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    return F.concat(F.lit("**"), F.coalesce("title", F.lit("?")), F.lit("** — "), F.concat_ws(", ", who, F.col("year").cast("string"), "journal", link))


def to_obtain(refs: DataFrame) -> DataFrame:
    """Works that are behind a barrier, landmark works first; without any there are no lines."""
    rows = records.to_obtain(refs)
    landmark = F.when(F.coalesce("is_canonical", F.lit(False)), 0.0).otherwise(1.0)
    head = rows.limit(1).select(F.lit("# To obtain\n").alias("line"))
    return joined([listed(0, head, F.col("line"), F.lit(0)), listed(1, rows, F.concat(F.lit("- "), _entry()), F.col("_seq"), landmark * 1e9 - F.coalesce("citation_count", F.lit(0)))])


def brief(refs: DataFrame, scope: Scope) -> DataFrame:
    """Final rows axis by axis, numbered throughout, and the criteria."""
    axes = [a.name for a in scope.axes]
    numbered = reports.brief(refs, axes).join(refs.where("final"), "id")
    heads = reports.domain_frame(refs.sparkSession, axes, "axis")
    place = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("axis")) if axes else F.lit(1)
    return joined(
        [
            said(refs.sparkSession, 0, [f"# Brief: {scope.project}"]),
            listed(1, heads, F.concat(F.lit("\n## "), F.col("axis"), F.lit("\n")), F.lit(-1), F.col("position") + 1),
            listed(1, numbered, F.concat(F.col("number").cast("string"), F.lit(". "), _entry()), F.col("number"), place),
        ]
    )


def coverage(refs: DataFrame, scope: Scope) -> DataFrame:
    told = reports.coverage(refs, [a.name for a in scope.axes])
    return joined([said(refs.sparkSession, 0, [f"# Coverage: {scope.project}", "", *heading("axis", "gold", "silver", "total", "status")]), listed(1, told, cells("axis", "gold", "silver", "total", "status"), F.col("position"))])


def validation(refs: DataFrame, scope: Scope) -> DataFrame:
    rows = reports.validation_list(refs, scope.max_final)
    return joined([said(refs.sparkSession, 0, [f"# Validation: {scope.project}", "", *heading("rank", "id", "title", "score", "label")]), listed(1, rows, cells("rank", "id", short(F.col("title"), 80), F.format_string("%.2f", F.col("relevance_score")), "label"), F.col("rank"))])


def screening(refs: DataFrame, agreement: DataFrame, apart: DataFrame) -> DataFrame:
    """Verdicts by kind, agreement with the words, divergences, and the first rows without a verdict."""
    active = refs.where(~F.col("is_duplicate"))
    missing = active.where("llm_verdict is null").orderBy("_seq").limit(MISSING)
    return joined(
        [
            said(refs.sparkSession, 0, ["# Screening", "", *heading("verdict", "records")]),
            listed(1, counts(active.withColumn("v", F.coalesce("llm_verdict", F.lit("none"))), "v"), cells("v", "n"), F.xxhash64("v"), -F.col("n")),
            listed(2, agreement, F.concat(F.lit("\nagreement "), F.format_string("%.3f", "observed"), F.lit(", kappa "), F.coalesce(F.format_string("%.3f", "kappa"), F.lit("-")), F.lit(" "), F.coalesce("label", F.lit("")), F.lit("\n")), F.lit(0)),
            said(refs.sparkSession, 3, heading("id", "words", "verdict")),
            listed(4, apart, cells("id", "keyword", "verdict"), F.col("_seq"), F.col("kind")),
            said(refs.sparkSession, 5, ["", "## Without a verdict", ""]),
            listed(6, missing, F.concat(F.lit("- "), F.col("id")), F.col("_seq")),
        ]
    )


def descriptors(found: DataFrame) -> DataFrame:
    """found: term, position, label, exact."""
    heads = found.select("term").distinct()
    line = F.concat(F.lit("- "), F.col("label"), F.when(F.col("exact"), " (exact)").otherwise(""))
    key = F.xxhash64("term").cast("double")
    return joined([said(found.sparkSession, 0, ["# Descriptors"]), listed(1, heads, F.concat(F.lit("\n## "), F.col("term"), F.lit("\n")), F.lit(-1), key), listed(1, found, line, F.col("position"), key)])


def venues(chosen: DataFrame, missing: DataFrame) -> DataFrame:
    """Finalists in order, each with its score and flags, and what has no row."""
    line = F.concat(F.lit("- **"), F.coalesce("titulo", F.col("issn_l")), F.lit("** "), F.format_string("%.3f", F.col("pre_score")), F.lit(" "), F.array_join("flags", ", "))
    return joined(
        [
            said(chosen.sparkSession, 0, ["# Venues", ""]),
            listed(1, chosen, line, F.xxhash64("issn_l"), -F.col("pre_score")),
            said(chosen.sparkSession, 2, ["", "## Not in the base", ""]),
            listed(3, missing, F.concat(F.lit("- "), F.col("issn_l"), F.lit(": "), F.col("reason")), F.xxhash64("issn_l")),
        ]
    )
