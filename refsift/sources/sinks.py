"""Sinks. Tables are written by Spark; short reports are rendered from frames that are small by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

# Entry types by publication type.
ENTRY_TYPES = (
    ("article", ("journal-article", "article")),
    ("incollection", ("book-chapter", "chapter")),
    ("book", ("book", "monograph")),
    ("inproceedings", ("proceedings-article", "conference-paper")),
    ("phdthesis", ("dissertation", "thesis")),
    ("techreport", ("report",)),
    ("misc", ("dataset",)),
)
#: Where the content of a note begins.
CONTENT = "## Content"


def entry_type() -> Column:
    kind = F.lower(F.coalesce("pub_type", F.lit("")))
    out = F.when(filled(F.col("journal")).isNotNull(), "article").otherwise("misc")
    for name, types in ENTRY_TYPES:
        out = F.when(kind.isin(*types), name).otherwise(out)
    return out


def cite_key() -> Column:
    first = F.coalesce(F.get("authors", F.lit(0)), F.lit("Unknown"))
    word = F.get(F.filter(F.split(F.replace(first, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""), F.lit(0))
    surname = F.regexp_replace(F.coalesce(word, F.lit("Unknown")), "[^a-zA-Z]", "")
    return F.concat(surname, F.coalesce(F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit("nd")), F.substring(F.coalesce("id", F.lit("")), -4, 4))


def bibtex(refs: DataFrame, grades: tuple[str, ...]) -> DataFrame:
    """_seq, entry: a BibTeX entry for each unique row of the grades."""
    brace = lambda c: F.regexp_replace(c, r"([{}])", r"\\$1")
    fields = [
        ("title", F.col("title")), ("author", F.when(F.size("authors") > 0, F.array_join("authors", " and "))), ("year", F.col("year").cast("string")),
        ("journal", F.col("journal")), ("volume", F.col("volume")), ("number", F.col("issue")), ("pages", F.col("pages")), ("doi", F.col("doi")),
        ("url", F.col("url")), ("abstract", brace(F.substring("abstract", 1, 500))),
    ]
    lines = F.filter(F.array(*[F.when(filled(c).isNotNull(), F.concat(F.lit(f"  {n} = {{"), c, F.lit("}"))) for n, c in fields]), lambda x: x.isNotNull())
    entry = F.concat(F.lit("@"), entry_type(), F.lit("{"), cite_key(), F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))
    return refs.where(~F.col("is_duplicate") & F.col("grade").isin(*grades)).select("_seq", entry.alias("entry"))


def write_records(refs: DataFrame, path: str, stage: str) -> None:
    """Records as Parquet, and beside them one JSON row of metadata."""
    refs.write.mode("overwrite").parquet(f"{path}/{stage}")
    refs.agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("total_refs"), F.count_if("is_duplicate").alias("duplicates")).write.mode("overwrite").json(f"{path}/{stage}.metadata")


def screening_batch(refs: DataFrame, abstract: int = 1800) -> DataFrame:
    """JSON lines for a reviewer."""
    row = F.struct("id", "title", F.substring(F.coalesce("abstract", F.lit("")), 1, abstract).alias("abstract"), "journal", "year")
    return refs.where(~F.col("is_duplicate")).select(F.to_json(row).alias("value"))


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report's table; for frames of a few rows (enumerations, axes, heads of lists). More than `most` rows are an
    error: such a frame is written as a table instead."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no report; write the frame as a table")
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]])


def file_name(year: Column, authors: Column, title: Column, stop: tuple[str, ...] = ("a", "an", "the", "of", "in", "on", "for", "and", "to", "de", "da", "do", "e", "em", "o")) -> Column:
    """Year, first word of the first author, and the first five words of the title that aren't stop words."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}\s]", ""), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin(*stop))
    capital = F.transform(F.slice(words, 1, 5), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200))))
    author = F.regexp_extract(F.coalesce(F.get(authors, F.lit(0)), F.lit("Unknown")), r"^([^\s,]+)", 1)
    return F.concat_ws("_", F.coalesce(year.cast("string"), F.lit("XXXX")), author, F.array_join(capital, ""))


def reference_notes(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """name, note: a Markdown note of each unique gold or silver row that isn't off topic. contents: id, content, method;
    a work without one is said to be unavailable."""
    body = contents.groupBy("id").agg(F.min(F.struct("content", "method")).alias("_c"))
    wanted = refs.where(~F.col("is_duplicate") & F.col("grade").isin("gold", "silver") & ~F.col("relevance").eqNullSafe(F.lit(0))).join(body, "id", "left")
    who = F.when(F.size("authors") == 0, "?").otherwise(F.concat(F.array_join(F.slice("authors", 1, 6), ", "), F.when(F.size("authors") > 6, " et al.").otherwise("")))
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), filled(F.col("doi"))), F.col("url"), F.lit(""))
    or_ = lambda c, other: F.coalesce(filled(c.cast("string")), F.lit(other))
    access = F.when(F.coalesce("is_open_access", F.lit(False)), "Open Access").otherwise(F.coalesce("access_status", F.lit("-")))
    text = F.coalesce(F.concat(F.lit(f"{CONTENT}\n\n*Extracted via "), F.col("_c.method"), F.lit("*\n\n"), filled(F.col("_c.content"))), F.lit(f"{CONTENT}\n\n*Not available: see to-obtain*"))
    head = F.concat(
        F.lit("# "), or_(F.col("title"), "?"), F.lit("\n\n**Link:** "), link, F.lit("\n**Authors:** "), who, F.lit(" | **Year:** "), or_(F.col("year"), "?"), F.lit(" | **Journal:** "), or_(F.col("journal"), "?"),
        F.lit("\n**Grade:** "), F.upper("grade"), F.lit(" | **Tier:** "), or_(F.col("tier"), "UNKNOWN"), F.lit(" | **Citations:** "), or_(F.nullif("citation_count", F.lit(0)), "-"),
        F.lit("\n**Axes:** "), or_(F.array_join("mapped_axes", ", "), "-"), F.lit("\n**Access:** "), access, F.lit(" | **PMID:** "), or_(F.col("pmid"), "-"), F.lit("\n\n---\n\n## Abstract\n\n"), or_(F.col("abstract"), "*Not available*"), F.lit("\n\n"),
    )
    return wanted.select(file_name(F.nullif("year", F.lit(0)), F.col("authors"), F.col("title")).alias("name"), F.concat(head, text).alias("note"))


def with_content(notes: DataFrame, contents: DataFrame) -> DataFrame:
    """notes whose content section is replaced, or added, by the content of the same name."""
    body = contents.select("name", F.concat(F.lit(f"{CONTENT}\n\n"), F.col("content")).alias("_b"))
    at = F.instr("note", CONTENT)
    kept = F.when(at > 0, F.substring(F.col("note"), F.lit(1), at - 1)).otherwise(F.concat("note", F.lit("\n\n")))
    return notes.join(body, "name", "left").withColumn("note", F.when(F.col("_b").isNull(), F.col("note")).otherwise(F.concat(kept, F.col("_b")))).drop("_b")


def write_notes(notes: DataFrame, path: str) -> None:
    """One folder a note, named like it, each written where its row is."""
    notes.select("name", F.col("note").alias("value")).write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def claim_rows(told: DataFrame) -> DataFrame:
    """Verified claims in the shape of the claims report, with room for a second reviewer."""
    points = F.transform("data_points", lambda p: F.struct(p["raw"].alias("raw_text"), p["value"].alias("value"), p["unit"].alias("unit"), p["percent"].alias("is_percentage")))
    return told.select(
        "doc", "paragraph", "ordinal", "claim_text", "claim_type", "ref_numbers", points.alias("data_points"), "has_calculation", "status", F.col("risk").alias("fabrication_risk"), "source_level",
        F.lit(None).cast("string").alias("layer2_verdict"), F.lit("").alias("layer2_notes"),
    )


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a table that write_version has written."""
    jvm, base = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base)]
    done = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in done)


def write_version(df: DataFrame, path: str) -> int:
    """A new version of a table; earlier ones stay, and one that broke off is never read."""
    number = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").json(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame | None:
    """The latest version, or a given one; None without any."""
    known = versions(spark, path)
    return spark.read.schema(schema).json(f"{path}/version={number or known[-1]}") if known else None
