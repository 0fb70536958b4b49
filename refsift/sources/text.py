"""Text sources: RIS files, curated Markdown lists, numbered reference lists, line-wise JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dois, filled, stripped
from ..operators.dedup import cut

# The line of a tag, and the entry of a numbered list.
RIS_TAG = r"^([A-Z][A-Z0-9])  ?- ?(.*)$"
NUMBERED = r"^\d+\.(\s|$)"
BIB = r"(\d{4});(\d+)(?:\(([^)]+)\))?:(\S+?)\.?\s*$"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of text files of any size: a file is read in as many splits as Spark makes of it.

    Within a split, ids ascend one by one, so a line's number is its id less the split's first, and the lines of the
    splits before, which are a row a split."""
    rows = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("value")
    )
    counts = rows.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    since = counts.select("file", "_block", (before - F.col("_first")).alias("_since"))
    return rows.join(since, ["file", "_block"]).select("file", (F.col("_id") + F.col("_since")).alias("line"), "value")


def lines_of(files: DataFrame) -> DataFrame:
    """file, line, value of files (file, text), or of lines that are so already."""
    if "line" in files.columns:
        return files.select("file", "line", "value")
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("line", "value"))


#: Lines that are scanned together.
SEGMENT = 1 << 16


def _segmented(rows: DataFrame, segment: int) -> tuple[DataFrame, W, W]:
    """rows with _segment, the order within a segment up to a row, and the order of a file's segments before one."""
    rows = rows.withColumn("_segment", F.floor(F.col("line") / segment))
    here = W.partitionBy("file", "_segment").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return rows, here, W.partitionBy("file").orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)


def counted_upto(rows: DataFrame, marks: dict[str, Column], segment: int = SEGMENT) -> DataFrame:
    """rows (file, line, ...) with, for each name, how many lines of the file up to this one its mark holds for.

    Each segment of a file's lines is counted by itself; what the segments before hold is carried over by their sums, a
    row a segment. So no task has more than a segment's lines, however long a file is."""
    rows, here, before = _segmented(rows.withColumns({name: mark.cast("int") for name, mark in marks.items()}), segment)
    sums = rows.groupBy("file", "_segment").agg(*[F.sum(name).alias(name) for name in marks])
    carried = sums.select("file", "_segment", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in marks])
    met = rows.join(carried, ["file", "_segment"])
    return met.withColumns({name: F.coalesce(F.sum(name).over(here), F.lit(0)) + F.col(f"_before_{name}") for name in marks}).drop("_segment", *[f"_before_{name}" for name in marks])


def last_upto(rows: DataFrame, name: str, value: Column, segment: int = SEGMENT) -> DataFrame:
    """rows with the last value that is not null of the file's lines up to this one, in segments like `counted_upto`."""
    rows, here, before = _segmented(rows.withColumn(name, value), segment)
    lasts = rows.groupBy("file", "_segment").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line"))).alias(name))
    carried = lasts.select("file", "_segment", F.last(name, ignorenulls=True).over(before).alias("_before"))
    met = rows.join(carried, ["file", "_segment"])
    return met.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(here), F.col("_before"))).drop("_segment", "_before")


def ris(files: DataFrame, label: str, segment: int = SEGMENT) -> DataFrame:
    """files: file, text, or the lines that `split_lines` reads. Records end at ER, the last one without it too; repeated
    tags collect; other lines go on with the last tag. A record needs a title. `_seq` is the record's place, ids are
    label and number.

    Places of records and tags are counts up to a line, so one file is the work of many tasks: only the lines of one tag,
    and the tags of one record, come together."""
    rows = lines_of(files).withColumns({"tag": filled(F.regexp_extract("value", RIS_TAG, 1)), "rest": F.regexp_extract("value", RIS_TAG, 2)})
    ends = F.coalesce(F.col("tag") == "ER", F.lit(False))
    marked = counted_upto(rows, {"record": ends, "entry": F.col("tag").isNotNull()}, segment).withColumn("record", F.col("record") - ends.cast("int")).where("entry > 0")
    texts = marked.groupBy("file", "record", "entry").agg(
        F.min("line").alias("line"),
        F.min_by("tag", "line").alias("tag"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.coalesce(F.when(F.col("tag").isNotNull(), F.col("rest")), stripped(F.col("value"))).alias("t")))), lambda x: x["t"]), " ").alias("t"),
    )
    tags = texts.where("tag <> 'ER'").withColumn("t", stripped(F.col("t"))).groupBy("file", "record").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("entry", "tag", "t"))).alias("e"))

    def all_of(tag: str) -> Column:
        return F.transform(F.filter("e", lambda x: x["tag"] == tag), lambda x: x["t"])

    def first(*names: str) -> Column:
        return F.coalesce(*[filled(F.get(F.filter(all_of(n), lambda v: v != ""), F.lit(0))) for n in names])

    authors = F.when(F.size(all_of("AU")) > 0, all_of("AU")).otherwise(all_of("A1"))
    found = tags.withColumn("title", first("TI", "T1")).where("title is not null")
    # numbered segment by segment, from the counts of those before; only the counts are put in order by one task
    found = found.withColumn("_segment", F.floor(F.col("line") / segment))
    counts = found.groupBy("file", "_segment").agg(F.count(F.lit(1)).alias("_n"))
    since = counts.select("file", "_segment", (F.sum("_n").over(W.orderBy("file", "_segment").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_since"))
    place = F.row_number().over(W.partitionBy("file", "_segment").orderBy("record"))
    numbered = found.withColumn("_place", place).join(since, ["file", "_segment"]).withColumn("_seq", (F.col("_since") + F.col("_place")).cast("long")).drop("_place", "_since", "_segment")
    pages = F.when(first("SP").isNotNull() & first("EP").isNotNull(), F.concat(first("SP"), F.lit("-"), first("EP"))).otherwise(first("SP"))
    return numbered.select(
        "_seq",
        F.concat(F.lit(f"{label}_"), F.repeat(F.lit("0"), 4 - F.length(F.col("_seq").cast("string"))), F.col("_seq").cast("string")).alias("id"),
        "title",
        F.transform(authors, lambda a: stripped(a)).alias("authors"),
        F.regexp_extract(F.coalesce(first("PY", "Y1", "DA"), F.lit("")), r"(\d{4})", 1).try_cast("int").alias("year"),
        stripped(F.regexp_replace(first("DO", "DI"), r"https?://doi\.org/", "")).alias("doi"),
        first("JO", "JF", "T2", "JA").alias("journal"),
        first("VL").alias("volume"),
        first("IS").alias("issue"),
        pages.alias("pages"),
        first("UR").alias("url"),
        first("AB", "N2").alias("abstract"),
        first("TY").alias("pub_type"),
        F.lit(label).alias("source_api"),
    )


def append_unique(base: DataFrame, new: DataFrame) -> DataFrame:
    """base and new rows; a new id that is taken gets `b` until it is free (rows that share an id get more of them)."""
    taken = base.select(F.col("id").alias("_id")).distinct()
    out, last = new, base.agg(F.coalesce(F.max("_seq"), F.lit(0)).alias("_last"))
    out = out.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("_seq")) - 1).withColumn("id", F.concat("id", F.repeat(F.lit("b"), F.col("_n"))))
    while True:  # one round for each `b` of the longest chain of taken ids; a round reads a written table
        out = cut(out)
        hit = out.join(taken, F.col("id") == F.col("_id"), "left")
        if not hit.where("_id is not null").limit(1).count():
            break
        out = hit.withColumn("id", F.when(F.col("_id").isNotNull(), F.concat("id", F.lit("b"))).otherwise(F.col("id"))).drop("_id")
    out = out.drop("_n").join(F.broadcast(last), F.lit(True)).withColumn("_seq", F.col("_seq") + F.col("_last")).drop("_last")
    return base.unionByName(out, allowMissingColumns=True)


def curated_list(files: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """titulo, estrato_origem, escopo_texto, apc_texto, url of `- **Title** — scope. Taxa ... [Link](url)` bullets; a
    stratum header holds for the bullets after it, until another header. files: as for `ris`."""
    rows = lines_of(files)
    header = F.when(stripped(F.col("value")).startswith("##"), F.regexp_extract(stripped(F.col("value")), r"^##\s+(A[1-4]|B[1-5]|C)\s*$", 1))
    rows = last_upto(rows, "estrato", header, segment).withColumn("estrato", filled(F.col("estrato")))
    bullet = r"^\s*-\s+\*\*(.+?)\*\*\s*[—–-]\s*(.+)$"
    found = rows.where(F.col("value").rlike(bullet)).withColumn("rest", stripped(F.regexp_extract("value", bullet, 2)))
    plain = stripped(F.regexp_replace("rest", r"\[Link\]\([^)]+\)", ""))
    dot = lambda c: F.rtrim(stripped(c), F.lit("."))
    return found.select(
        "file",
        "line",
        stripped(F.regexp_extract("value", bullet, 1)).alias("titulo"),
        F.col("estrato").alias("estrato_origem"),
        filled(dot(F.split_part(plain, F.lit(" Taxa"), F.lit(1)))).alias("escopo_texto"),
        filled(dot(F.regexp_extract(plain, r"Taxa:?\s*(.+?)(?=\s+Citado|\s+\[Link\]|$)", 1))).alias("apc_texto"),
        filled(stripped(F.regexp_extract("rest", r"\[Link\]\(([^)]+)\)", 1))).alias("url"),
    )


def numbered_references(files: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Entries of the references' section: number, raw, authors_str, title, journal, year, volume, issue, pages, doi, url
    and ref_type (legislation, web, journal or unknown). files: as for `ris`.

    The section begins after its first heading and ends with the file; of the two forms of the heading the second counts
    where the first is absent. An entry begins at a numbered line and holds those up to the next."""
    rows = lines_of(files)
    heads = rows.groupBy("file").agg(*[F.min(F.when(F.col("value").rlike(rf"^{h} Referências\s*$"), F.col("line"))).alias(f"_{len(h)}") for h in ("##", "#")])
    since = heads.select("file", F.coalesce("_2", "_1").alias("_since")).where("_since is not null")
    inside = rows.join(since, "file").where(F.col("line") > F.col("_since"))
    marked = counted_upto(inside, {"entry": F.col("value").rlike(NUMBERED)}, segment).where("entry > 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"])
    entries = marked.groupBy("file", F.col("entry").alias("_entry")).agg(F.array_join(lines, "\n").alias("entry"))
    e = entries.select("file", F.regexp_extract("entry", r"^(\d+)", 1).cast("int").alias("number"), F.replace(stripped(F.regexp_replace("entry", r"^\d+\.\s+", "")), F.lit("\n"), F.lit(" ")).alias("raw"))
    named = filled(F.regexp_extract("raw", r"DOI:\s*(10\.\S+?)\.?\s*$", 1))
    e = e.withColumns({"doi": F.coalesce(named, filled(F.regexp_extract("raw", r"\b(10\.\d{4,}/\S+?)\.?\s*$", 1))), "_cut": F.when(named.isNotNull(), F.rtrim(stripped(F.regexp_replace("raw", r"DOI:\s*10\.\S+?\.?\s*$", "")), F.lit("."))).otherwise(F.col("raw"))})
    e = e.withColumn("url", filled(F.regexp_extract("_cut", r"Disponível na Internet:\s*(https?://\S+?)(?:\s*\(|$)", 1)))
    law = F.col("raw").rlike("Diário Oficial|Lei nº|Decreto")
    kind = F.when(law, "legislation").when(F.col("url").isNotNull() & F.col("doi").isNull(), "web").when(F.col("doi").isNotNull() | F.col("raw").rlike(r"\d{4};\d+"), "journal").when(F.col("url").isNotNull(), "web").otherwise("unknown")
    bib = BIB
    e = e.withColumns({"ref_type": kind, "_bib": F.regexp_extract("_cut", bib, 0)})
    has = F.col("_bib") != ""
    before = F.when(has, F.rtrim(stripped(F.regexp_replace("_cut", bib, "")), F.lit("."))).otherwise(F.col("_cut"))
    rest = F.regexp_extract(before, r"(?s)^.*?\. (.*)$", 1)
    journal = F.col("ref_type") == "journal"
    split = journal & F.contains(before, F.lit(". "))
    part = lambda i: F.when(journal & has, filled(F.regexp_extract("_cut", bib, i)))
    return e.select(
        "file",
        "number",
        "raw",
        F.when(split, stripped(F.regexp_extract(before, r"(?s)^(.*?)\. ", 1))).alias("authors_str"),
        F.when(split, F.when(F.instr(rest, ".") > 0, stripped(F.regexp_extract(rest, r"(?s)^(.*)\.[^.]*$", 1))).otherwise(stripped(rest))).alias("title"),
        F.when(split & (F.instr(rest, ".") > 0), stripped(F.regexp_replace(F.regexp_extract(rest, r"(?s)^.*\.([^.]*)$", 1), r"\s*\d{4}\s*$", ""))).alias("journal"),
        F.coalesce(part(1), F.when(journal, filled(F.regexp_extract("_cut", r"\b(20\d{2})\b", 1)))).alias("year"),
        part(2).alias("volume"),
        part(3).alias("issue"),
        part(4).alias("pages"),
        "doi",
        "url",
        "ref_type",
    )


def author_list(c: Column) -> Column:
    """Authors of a numbered reference, without `et al.`"""
    return F.filter(F.transform(F.split(F.regexp_replace(c, r"\s*et al\.?\s*$", ""), ","), lambda a: stripped(a)), lambda a: a != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parse, with `_line`, and the lines that don't: (rows, rejected). One file keeps its line order."""
    rows = split_lines(spark, path).where(F.length(F.trim("value")) > 0)
    parsed = rows.withColumn("v", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.where("v is not null and v._corrupt is null").select("v.*", F.col("line").alias("_line")).drop("_corrupt")
    return good, parsed.where("v is null or v._corrupt is not null").select("file", "line", "value")


def verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Verdict lines, and those without an id or a known verdict as (_line, reason)."""
    good, bad = json_lines(spark, path, "id string, verdict string, reason string, criteria array<string>")
    ok = (F.length("id") > 0) & F.col("verdict").isin("include", "exclude", "maybe")
    wrong = good.where(~F.coalesce(ok, F.lit(False))).select("_line", F.when(F.length("id") > 0, "unknown verdict").otherwise("no id").alias("reason"))
    return good.where(ok), wrong.unionByName(bad.select(F.col("line").alias("_line"), F.lit("no JSON").alias("reason")))


def seeds(files: DataFrame) -> DataFrame:
    """Distinct DOIs of Markdown files in order, to be looked up."""
    return files.select("file", F.posexplode(dois(F.col("text"))).alias("at", "doi"))


def text_references(files: DataFrame, most: int | None = 20) -> DataFrame:
    """file, at, raw, title, author: the reference lines of the first section of that name, which ends at the next
    heading: numbered ones, and long ones that begin with a capitalised word. A list keeps its first `most` lines (the
    feature's own limit; None for all)."""
    rows = lines_of(files).withColumn("t", stripped(F.col("value")))
    here = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("begins", F.col("t").rlike(r"(?i)^#+\s*(Referências|References|Bibliografia)"))
    rows = rows.withColumn("since", F.min(F.when(F.col("begins"), F.col("line"))).over(here))
    other = F.col("t").rlike(r"^#+\s") & ~F.col("begins") & F.col("since").isNotNull()
    rows = rows.withColumn("over", F.max(other.cast("int")).over(here))
    wanted = F.col("t").rlike(r"^(\d+[.)]\s|\[\d+\]\s)") | (F.col("t").rlike(r"^[A-Z][a-záàâã]") & (F.length("t") > 30))
    found = rows.where((F.col("since") < F.col("line")) & ~F.col("begins") & (F.col("over") == 0) & wanted)
    found = found.withColumn("at", F.row_number().over(W.partitionBy("file").orderBy("line")))
    found = found if most is None else found.where(F.col("at") <= most)
    return found.select("file", "at", F.col("t").alias("raw"), *title_author(F.col("t")))


def title_author(raw: Column) -> tuple[Column, Column]:
    """Of a reference's text, the first sentence after the first that is longer than 15 signs (else its first 100 signs),
    and the word that it begins with, if capitalised."""
    text = stripped(F.regexp_replace(raw, r"^(\d+[.)]\s|\[\d+\]\s)", ""))
    parts = F.split(text, r"\.\s+")
    long_ones = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.length(p) > 15)
    title = F.coalesce(F.regexp_replace(F.get(long_ones, F.lit(0)), r"^\.+|\.+$", ""), F.substring(text, 1, 100))
    return title.alias("title"), F.regexp_extract(text, r"^([A-Z][a-záàâãéèêíóòôõúç]+)", 1).alias("author")
