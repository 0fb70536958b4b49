"""Facts taken from sources: candidates, import with checks, duplicates, cross-check of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import TOLERANCE, close_to, derivation_holds, number_class, number_value
from ..functions.similarity import indel, partial_reaches
from ..functions.text import collapsed, stripped
from .dedup import cut, leaders
from .keyed import band_join

# How alike a quote must be, lines and links that don't count, what a number looks like, what is none.
QUOTE, SHORT_QUOTE = 93.0, 40
METADATA = r"(?m)^(\*\*(Link|Autores|Grade|Eixos|Acesso):.*|---.*)$\n?"
LINKS = r"https?://\S+|10\.\d{4,}/\S+"
AMOUNT = r"((?:(?:US?\$|R\$|\$)\s*)?(?:\d[\d,.']*\d|\d)(?:\s*%)?)"
CITED, YEAR = r"\[\d+(?:\s*[,–-]\s*\d+)*\]", r"^(19|20)\d\d$"


def searchable(content: Column) -> Column:
    """Without the header's lines of metadata, links and DOIs."""
    return F.regexp_replace(F.regexp_replace(content, METADATA, ""), LINKS, "")


def number_candidates(contents: DataFrame, reach: int = 150) -> DataFrame:
    """number, ordinal, raw, context, value, kind for every number of a content that is no citation, year, zero or
    single digit (unless a percentage or an amount)."""
    clean = contents.select("number", searchable(F.col("content")).alias("text"))
    pattern = AMOUNT
    parts = clean.withColumns({"gaps": F.split("text", pattern), "hits": F.regexp_extract_all("text", F.lit(pattern), 1)})
    # a number has a sign of its own and one beside it, so so many on either side hold all signs within reach
    far = reach // 2 + 1

    def before(o: Column) -> Column:
        at = F.sequence(F.greatest(o - far, F.lit(0)), o)
        joined = F.array_join(F.transform(at, lambda i: F.concat(F.get("gaps", i), F.when(i < o, F.get("hits", i)).otherwise(""))), "")
        return F.substring(joined, F.greatest(F.length(joined) - reach + 1, F.lit(1)), F.lit(reach))

    def after(o: Column) -> Column:
        at = F.sequence(o + 1, F.least(o + far, F.size("hits")))
        return F.substring(F.array_join(F.transform(at, lambda i: F.concat(F.get("gaps", i), F.coalesce(F.get("hits", i), F.lit("")))), ""), 1, reach)

    # the places beside a number are cut out before the rows are spread, so no row carries its whole text along
    spans = F.transform("hits", lambda h, o: F.struct(o.alias("ordinal"), h.alias("hit"), before(o).alias("before"), after(o).alias("after")))
    one = parts.select("number", F.explode(spans).alias("s")).select("number", "s.*")
    raw = F.regexp_extract("hit", r"(\d[\d,.']*\d|\d)", 1)
    context = F.concat("before", "hit", "after")
    near = F.concat(F.substring("before", F.greatest(F.length("before") - 14, F.lit(1)), F.lit(15)), F.col("hit"), F.substring("after", 1, 15))
    told = one.select("number", "ordinal", raw.alias("raw"), "hit", context.alias("context"), near.alias("near"))
    noise = F.col("near").rlike(CITED) | F.col("raw").rlike(YEAR)
    single = (F.length("raw") == 1) & ~F.col("hit").rlike(r"[%$]")
    told = told.where(~noise & ~single).withColumns({"value": number_value(F.col("raw"), F.col("context")), "kind": number_class(F.col("context"))})
    return told.where("value is not null and value <> 0").select("number", "ordinal", "raw", "context", "value", "kind")


def quote_found(quote: Column, content: Column) -> Column:
    """Short quotes by substring, longer ones by the best partial ratio."""
    q, text = F.lower(stripped(quote)), F.lower(searchable(content))
    return F.when(F.length(q) < SHORT_QUOTE, F.contains(text, q)).otherwise(partial_reaches(q, text, QUOTE))


def import_pending(pending: DataFrame, contents: DataFrame) -> DataFrame:
    """pending facts with status. contents: number, content, ref_type, numbers (array of the source's values).

    Without a content or a quote the quote is not checked, without source numbers the value is not."""
    told = pending.join(contents.withColumnRenamed("number", "ref_number"), "ref_number", "left")
    checked = (F.length("content") > 0) & (F.length("exact_quote") > 0)
    told = told.withColumn("_quote", F.when(checked, quote_found(F.coalesce("exact_quote", F.lit("")), F.coalesce("content", F.lit("")))))
    quantitative = F.col("fact_type") == "quantitative"
    in_source = F.exists("numbers", lambda n: close_to(n, F.col("value")))
    absent = quantitative & F.col("value").isNotNull() & (F.size("numbers") > 0) & ~in_source
    derived = (F.length("derivation_formula") > 0) & (F.size("source_values") > 0) & F.col("stated_result").isNotNull()
    holds = derivation_holds(F.col("derivation_formula"), F.col("source_values"), F.col("stated_result"))
    base = F.when(quantitative, "verified").when(F.coalesce(F.col("_quote"), F.lit(False)), "verified").otherwise("context_supported")
    web = F.coalesce(F.col("ref_type").isin("web", "legislation"), F.lit(False))
    status = (
        F.when(F.col("_quote").eqNullSafe(F.lit(False)), "rejected")
        .when(F.coalesce(absent, F.lit(False)), "rejected")
        .when(F.coalesce(derived, F.lit(False)), F.when(holds, "derived").otherwise("rejected"))
        .when(web, F.when(base == "verified", "verified_web").otherwise("unverifiable"))
        .otherwise(base)
    )
    return told.withColumn("status", status).select(*pending.columns, "status")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """facts (with _seq) without those that an earlier kept one of the same reference equals: quantitative ones by unit
    and value to 0.001, others by quote (equal if short, else alike to 93)."""
    every = facts.select("_seq", "ref_number", "fact_type", "unit", "value", F.lower(stripped(F.coalesce("exact_quote", F.lit("")))).alias("q"))
    # of facts that say the very same only the first is compared, so one that is told very often makes no pairs
    number = F.when((F.col("fact_type") == "quantitative") & F.col("value").isNotNull(), F.struct("unit", "value"))
    quote = F.when((F.col("fact_type") != "quantitative") & (F.col("q") != ""), F.col("q"))
    alone = F.when(number.isNull() & quote.isNull(), F.col("_seq"))
    f = every.groupBy("ref_number", number.alias("_n"), quote.alias("_q"), alone.alias("_s")).agg(F.min_by(F.struct(*every.columns), "_seq").alias("r")).select("r.*")
    f = cut(f)
    a = f.select(*[F.col(c).alias(f"{c}_a") for c in f.columns])
    b = f.select(*[F.col(c).alias(f"{c}_b") for c in f.columns])
    cell = lambda c: F.floor(c / 0.001).cast("long")
    left = a.where("value_a is not null").withColumn("cell", F.explode(F.array(*[cell(F.col("value_a")) + d for d in (-1, 0, 1)])))
    right = b.where("value_b is not null and fact_type_b = 'quantitative'").withColumn("cell", cell(F.col("value_b")))
    same = (F.col("ref_number_a") == F.col("ref_number_b")) & F.col("unit_a").eqNullSafe(F.col("unit_b")) & (left["cell"] == right["cell"])
    numbers = left.join(right, same).where((F.col("_seq_a") < F.col("_seq_b")) & (F.abs(F.col("value_a") - F.col("value_b")) < 0.001))
    quotes = a.where("q_a <> ''").join(b.where("q_b <> '' and fact_type_b <> 'quantitative'"), (F.col("ref_number_a") == F.col("ref_number_b")) & (F.col("_seq_a") < F.col("_seq_b")))
    short = F.least(F.length("q_a"), F.length("q_b")) < SHORT_QUOTE
    alike = quotes.where(F.when(short, F.col("q_a") == F.col("q_b")).otherwise(indel(F.col("q_a"), F.col("q_b")) >= QUOTE))
    edges = cut(numbers.select("_seq_a", "_seq_b").unionByName(alike.select("_seq_a", "_seq_b")).distinct())
    kept = f.select("_seq").join(leaders(edges).select(F.col("_seq_b").alias("_seq")), "_seq", "left_anti")
    return facts.join(kept, "_seq", "left_semi")


def find(facts: DataFrame, ref: int | None = None, section: str | None = None, tags: list[str] | None = None, kind: str | None = None) -> DataFrame:
    out = facts
    if ref is not None:
        out = out.where(F.col("ref_number") == ref)
    if section is not None:
        out = out.where(F.array_contains("sections", section))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return out.where(F.col("fact_type") == kind) if kind is not None else out


def cross_check(values: DataFrame, facts: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """values: claim, ref_number, at (place of the reference), value. Every value with the first registered fact of its
    references within the tolerance, or none."""
    known = facts.where("fact_type = 'quantitative'").select("ref_number", F.col("value").alias("fact_value"), F.col("_seq").alias("fact_seq"))
    hits = band_join(values, known, "ref_number", "value", "fact_value", tolerance)
    first = hits.groupBy("claim", "value").agg(F.min_by(F.struct("fact_seq", "fact_value"), F.struct("at", "fact_seq")).alias("hit"))
    every = values.select("claim", "value").distinct()
    out = every.join(first, ["claim", "value"], "left")
    return out.select("claim", "value", F.col("hit.fact_value").alias("fact_value"), F.when(F.col("hit").isNull(), "NAO_REGISTRADO").otherwise("REGISTRADO").alias("status"))


def grounded(fields: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fields: issn_l, url, field, value, quote; snapshots: issn_l, url, text. Those whose quote is in the snapshot."""
    met = fields.join(snapshots, ["issn_l", "url"])
    return met.where((F.length("quote") > 0) & F.contains(collapsed(F.col("text")), collapsed(F.col("quote")))).select(*fields.columns)


#: The registry's columns.
FACTS = (
    "_seq long, id string, ref_number int, ref_doi string, ref_title string, ref_content_hash string, fact_type string, status string, statement string,"
    " exact_quote string, quote_context string, value double, unit string, original_format string, derivation_formula string, source_values array<double>,"
    " calculated_result double, stated_result double, sections array<string>, tags array<string>, extracted_by string, extracted_at string,"
    " source_level string, cross_validation_detail string, web_verified_at string, notes string"
)


def fact_id() -> Column:
    """Eight hexadecimal digits of what a fact says, the same whenever it is told again."""
    return F.substring(F.sha2(F.concat_ws("|", "ref_number", "fact_type", "statement", "exact_quote", F.col("value").cast("string"), "unit"), 256), 1, 8)


def nearest(values: DataFrame, numbers: DataFrame) -> DataFrame:
    """values: id, ref_number, value; numbers: ref_number, ordinal, value of a source. id, nearest: the number of its
    source that is nearest to each value, of equals the first. A value's source has few numbers, so they are compared one
    by one."""
    n = numbers.select("ref_number", "ordinal", F.col("value").alias("_n"))
    met = values.join(n, "ref_number").withColumn("_d", F.abs(F.col("_n") - F.col("value")))
    return met.groupBy("id").agg(F.min_by("_n", F.struct("_d", "ordinal")).alias("nearest"))


def warnings(context: Column) -> Column:
    """What a number's context says about it: a bound, or an approximation."""
    low = F.lower(context)
    found = F.array(F.when(low.rlike("exceeding|more than|over"), F.lit("bound")), F.when(low.rlike("approximately|about|cerca de"), F.lit("approximate")))
    return F.filter(found, lambda w: w.isNotNull())


def tallies(facts: DataFrame) -> DataFrame:
    """kind, value, n: facts by status, by type and by reference, sorted."""
    parts = [facts.groupBy(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")) for k in ("status", "fact_type", "ref_number")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("kind", F.col("value").try_cast("int"), "value")
