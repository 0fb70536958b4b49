"""Cited claims of Markdown texts: extraction, data points, and the check against the cited works' contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import claim_stop_words, claim_terms
from ..functions.numbers import MAGNITUDES, pt_number, transition_holds
from ..functions.text import stripped
from ..schema import RISK_OF_STATUS

# Citations, what makes a claim quantitative, named methods and institutions.
CITATION = r"\[\d+(?:\s*,\s*\d+)*\]"
REFERENCES_HEADER = r"(?m)^##?\s*Referências\s*$"
QUANTITATIVE = (
    r"\d+[,.]?\d*\s*%|\d[\d.,]*\s*(mil|milh|bilh|trilh)|R\$|US\$|\$|dólares|reais|MAPE|acurácia|redução de|economia de"
    r"|crescimento de|taxa de|margem de|\d+\s*para\s*\d+"
)
CONCEPTUAL_COUNT = (
    r"(?i)(?:cinco|quatro|três|seis|sete|oito|nove|dez)\s+(?:características|níveis|estágios|camadas|princípios|frentes|domínios|etapas|tipos|Vs)|\d\s+Vs\b"
)
ENTITY = r"XGBoost|Random Forest|LSTM|CNN|NLP|machine learning|deep learning|FHIR|HL7|TISS|LGPD|AMAM|HIMSS|gêmeos? digitais|digital twin|OMS|WHO|DATASUS|ANS|SUS"
MODELS = r"(?i)(XGBoost|Random Forest|LSTM|CNN|RNN|SVM|GBM|neural network|rede neural|NLP|GPT|LLM|deep learning|machine learning|regressão logística|logistic regression)"
INSTITUTIONS = r"(?i)(FHIR|HL7|TISS|LGPD|AMAM|HIMSS|OMS|WHO|DATASUS|ANS|SUS|RNDS|DRG|digital twin|gêmeos? digitais)"
CAPITALISED = r"([A-Z][a-z]+ (?:[A-Z][a-z]+ )*[A-Z][a-z]+)"
# What a data point looks like, and what makes a calculation.
NUMBER = r"\d+(?:[,.]\d+)?"
PERCENT = rf"{NUMBER}\s*%"
SIZED = rf"{NUMBER}\s*(?:mil|milh[õo]es|bilh[õo]es|trilh[õo]es)\b\s*(?:de\s+)?(?:dólares|reais|dolares)?"
MOVE = rf"{NUMBER}\s*(?:para|→)\s*{NUMBER}\s*(?:dias|anos|meses|horas)?"
COUNTED = rf"{NUMBER}\s*(?:leitos|pacientes|contratos|registros)"
ANNUAL = r"(?i)crescimento\s+anual|taxa\s+anual|CAGR"
SPAN = r"(?i)entre\s+\d+[,.]?\d*\s*%\s+e\s+\d+|de\s+\d+[,.]?\d*\s*%\s+a\s+\d+"
MOVED = r"\d+\s*(?:para|→)\s*\d+"
TOLD = (
    r"(?i)(?:redu[çc]ão|melhor(?:ia|ou)|queda|varia[çc]ão|aument)\s+(?:de\s+)?\d+[,.]?\d*\s*%"
    r"|\d+\s*(?:para|→)\s*\d+.*?(?:—|–|-)\s*(?:uma?\s+)?(?:redu|melhor|queda|aument)\S*\s+(?:de\s+)?\d+[,.]?\d*\s*%"
)

KEYWORD = r"([a-záàâãéêíóôõúçA-Z]{5,})"
#: A text is on a claim's theme from this share of the claim's keywords on.
THEMATIC = 0.3

POINT = "struct<raw:string,value:double,unit:string,percent:boolean>"


def claim_type(text: Column) -> Column:
    """A: substantive numbers; B: named methods or institutions; C: anything else."""
    year_only = F.regexp_extract(text, QUANTITATIVE, 0).rlike(r"^\s*\d{4}\s*$")
    return F.when(text.rlike(QUANTITATIVE) & ~text.rlike(CONCEPTUAL_COUNT) & ~year_only, "A").when(text.rlike(ENTITY), "B").otherwise("C")


def _is_year(v: Column) -> Column:
    return v.between(1900, 2099)


def _point(raw: Column, value: Column, unit: Column, percent: bool) -> Column:
    return F.struct(raw.alias("raw"), value.alias("value"), unit.alias("unit"), F.lit(percent).alias("percent"))


def data_points(text: Column) -> Column:
    """Percentages, magnitudes, `X para Y` and counted units, in this order; a text that repeats counts once. The longest
    word of a magnitude counts: `3,4 milhões` is 3,400,000, not 3,400 for the `mil` that it begins with."""

    def found(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))

    def number(c: Column, n: int = 1) -> Column:
        return pt_number(F.get(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), 1), F.lit(n - 1)))

    percents = F.filter(F.transform(found(PERCENT), lambda m: _point(m, number(m), F.lit("%"), True)), lambda p: ~_is_year(p["value"]))

    def scaled(m: Column) -> Column:
        word = F.lower(F.regexp_extract(m, r"(?i)(mil|milh[õo]es|bilh[õo]es|trilh[õo]es)\b", 1))
        factor = F.lit(1.0)
        for name, size in MAGNITUDES:
            factor = F.when(word == name, size).otherwise(factor)
        money = F.regexp_extract(m, r"(dólares|reais|dolares)$", 1)
        return _point(m, number(m) * factor, F.trim(F.concat_ws(" ", word, money)), False)

    sized = F.transform(found(SIZED), lambda m: scaled(F.trim(m)))

    def steps(m: Column) -> Column:
        unit = F.regexp_extract(m, r"(dias|anos|meses|horas)$", 1)
        raw = F.regexp_extract_all(m, F.lit(f"({NUMBER})"), 1)
        return F.array(*[_point(F.get(raw, F.lit(i)), pt_number(F.get(raw, F.lit(i))), unit, False) for i in (0, 1)])

    moves = F.flatten(F.filter(F.transform(found(MOVE), steps), lambda a: ~F.exists(a, lambda p: _is_year(p["value"]))))
    counted = F.transform(found(COUNTED), lambda m: _point(m, number(m), F.regexp_extract(m, r"(\p{L}+)$", 1), False))
    return F.concat(*[F.coalesce(a.cast(f"array<{POINT}>"), F.array().cast(f"array<{POINT}>")) for a in (percents, sized, moves, counted)])


def has_calculation(text: Column, points: Column) -> Column:
    """Two values or more and a percentage that is said to follow from them."""
    percents, values = F.filter(points, lambda p: p["percent"]), F.filter(points, lambda p: ~p["percent"])
    span = (F.size(percents) >= 2) & text.rlike(SPAN)
    return (F.size(values) >= 2) & (F.size(percents) > 0) & ~text.rlike(ANNUAL) & ~span & text.rlike(MOVED) & text.rlike(TOLD)


def extract(texts: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """doc, paragraph, ordinal, claim_text, ref_numbers, claim_type, data_points, has_calculation: a row for each
    citation, which owns the text since the citation before it in its paragraph, or, where that is shorter than ten
    signs, since the last full stop. Text from the references' header on doesn't count, nor do headings."""
    body = F.get(F.split(F.col(text_col), REFERENCES_HEADER, 2), F.lit(0))
    paragraphs = texts.select(F.col(id_col).alias("doc"), F.posexplode(F.split(body, r"\n\s*\n")).alias("paragraph", "p")).withColumn("p", stripped(F.col("p")))
    paragraphs = paragraphs.where(F.col("p").rlike(CITATION) & ~F.col("p").startswith("#"))
    told = paragraphs.withColumns({"parts": F.split("p", CITATION), "cites": F.regexp_extract_all(F.col("p"), F.lit(f"({CITATION})"), 1)})

    def since(i: Column) -> Column:
        """The text from the last part with a full stop on."""
        dotted = F.filter(F.sequence(F.lit(0), i), lambda k: F.contains(F.get("parts", k), F.lit(".")))
        return F.array_join(F.transform(F.sequence(F.coalesce(F.array_max(dotted), F.lit(0)), i), lambda k: F.concat(F.get("parts", k), F.when(k < i, F.get("cites", k)).otherwise(""))), "")

    # a citation's own text is cut out before the rows are spread, so no row carries its whole paragraph along
    spans = F.transform("cites", lambda cite, i: F.struct(i.alias("ordinal"), cite.alias("cite"), F.get("parts", i).alias("part"), since(i).alias("since")))
    one = told.select("doc", "paragraph", F.explode(spans).alias("s")).select("doc", "paragraph", "s.*")
    plain = F.regexp_replace(F.regexp_replace(stripped(F.col("part")), r"\*{1,2}(.+?)\*{1,2}", "$1"), r"^\s*[—–\-]\s*", "")
    sentence = stripped(F.element_at(F.split("since", r"\."), -1))
    one = one.withColumns({"_plain": plain, "_sentence": sentence})
    text = F.when(F.length("_plain") >= 10, F.col("_plain")).otherwise(F.col("_sentence"))
    one = one.withColumn("claim_text", text).where(F.length("claim_text") >= 10)
    numbers = F.transform(F.regexp_extract_all("cite", F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    one = one.withColumns({"ref_numbers": numbers, "claim_type": claim_type(F.col("claim_text"))})
    one = one.withColumn("data_points", F.when(F.col("claim_type") == "A", data_points(F.col("claim_text"))).otherwise(F.array().cast(f"array<{POINT}>")))
    one = one.withColumn("has_calculation", (F.col("claim_type") == "A") & has_calculation(F.col("claim_text"), F.col("data_points")))
    return one.select("doc", "paragraph", "ordinal", "claim_text", "ref_numbers", "claim_type", "data_points", "has_calculation")


def entities(text: Column) -> Column:
    """Methods, then institutions, then runs of capitalised words, each once."""
    names = F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), 1), lambda e: (F.length(e) > 5) & (e != "Big Data"))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(MODELS), 1), F.regexp_extract_all(text, F.lit(INSTITUTIONS), 1), names))


def keywords(text: Column, terms: dict[str, list[str]] | None = None, stop_words: list[str] | None = None) -> Column:
    """What a source on a claim's theme may say: the composite terms that the claim names, each with what it is called in
    the source's language, then its words of five letters or more that are no stop words; each once.

    terms, stop_words: tables of a project's own instead of those in `data`."""
    known = claim_terms() if terms is None else terms
    stops = F.array(*[F.lit(w) for w in (claim_stop_words() if stop_words is None else stop_words)]).cast("array<string>")
    low = F.lower(text)
    named = [F.when(F.contains(low, F.lit(term.lower())), F.array(*[F.lit(x) for x in (term, *others)])) for term, others in known.items()]
    found = F.flatten(F.filter(F.array(*named), lambda x: x.isNotNull())) if named else F.array().cast("array<string>")
    words = F.filter(F.regexp_extract_all(text, F.lit(KEYWORD), 1), lambda w: ~F.array_contains(stops, F.lower(w)))
    return F.array_distinct(F.concat(found, words))


def variants(point: Column) -> Column:
    """Texts that a data point may have in a source."""
    v = point["value"]
    whole = v == F.floor(v)
    as_int, pt = v.cast("long").cast("string"), F.replace(v.cast("string"), F.lit("."), F.lit(","))
    percent = F.when(whole, F.transform(F.array(F.lit("%"), F.lit(" %"), F.lit(" percent")), lambda s: F.concat(as_int, s))).otherwise(
        F.array(F.concat(v.cast("string"), F.lit("%")), F.concat(v.cast("string"), F.lit(" %")), F.concat(v.cast("string"), F.lit(" percent")), F.concat(pt, F.lit("%")))
    )

    def large(size: float, english: str, portuguese: str) -> Column:
        x = v / size
        s = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
        p = F.replace(s, F.lit("."), F.lit(","))
        return F.array(F.concat(s, F.lit(f" {english}")), F.concat(F.lit("$"), s, F.lit(f" {english}")), F.concat(p, F.lit(f" {portuguese}")))

    grouped = F.format_number(v, 0)
    thousands = F.array(grouped, as_int, F.concat(F.lit("$"), grouped), F.concat(F.lit("$"), as_int))
    kilo = (v / 1000).cast("long").cast("string")
    round_thousands = F.concat(thousands, F.array(*[F.concat(F.lit(a), kilo, F.lit(b)) for a, b in (("", "K"), ("$", "K"), ("", " mil"), ("", " thousand"))]))
    plain = F.when(whole, F.array(as_int)).otherwise(F.array(v.cast("string"), pt))
    return F.array_distinct(
        F.when(point["percent"], percent)
        .when(v >= 1e12, large(1e12, "trillion", "trilhões"))
        .when(v >= 1e9, large(1e9, "billion", "bilhões"))
        .when(v >= 1e6, large(1e6, "million", "milhões"))
        .when((v >= 1000) & whole & (v % 1000 == 0), round_thousands)
        .when((v >= 1000) & whole, thousands)
        .otherwise(plain)
    )


def approximate(value: Column, content: Column, tolerance: float = 0.30) -> Column:
    """The first number of the content that, by itself or in thousands or millions, lies within the tolerance. Numbers
    in square brackets, links and years don't count."""
    clean = F.regexp_replace(F.regexp_replace(content, r"https?://\S+|10\.\d{4,}/\S+", ""), r"\[[\d,\s–-]*\]", "")
    raw = F.regexp_extract_all(clean, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)
    kept = F.filter(raw, lambda r: ~r.rlike(r"^(19|20)\d\d$"))
    values = F.transform(kept, lambda r: F.replace(r, F.lit(","), F.lit(".")).try_cast("double"))
    tried = F.flatten(F.transform(values, lambda x: F.array(x, x * 1000, x * 1e6)))
    return F.get(F.filter(tried, lambda x: (value != 0) & (F.abs(x - value) <= F.abs(value) * tolerance)), F.lit(0))


def verify(claims: DataFrame, contents: DataFrame, words: Column | None = None) -> DataFrame:
    """claims with status, risk and source_level. contents: doc, number, content, source_level (full_text, abstract).

    A: arithmetic first; then one data point found as text in a cited content is enough (by plain substring), else one
    within 30 %; B: an entity found; C: three tenths of the keywords in one content, or none to look for. Claims without
    contents can't be verified. source_level is, of a thematic match, that of the content that holds most keywords (of
    equal ones the first cited), of other conceptual claims none. words: the keywords, where not those of `keywords`."""
    key = ["doc", "paragraph", "ordinal"]
    c = claims.withColumns(
        {
            "points": F.transform("data_points", lambda p: F.struct(p["value"].alias("value"), variants(p).alias("texts"))),
            "names": entities(F.col("claim_text")),
            "words": words if words is not None else keywords(F.col("claim_text")),
        }
    )
    refs = c.select(*key, "claim_type", "points", "names", "words", F.posexplode("ref_numbers").alias("at", "number"))
    met = refs.join(contents.select("doc", "number", F.col("content"), F.lower("content").alias("low"), "source_level"), ["doc", "number"]).where(F.length("content") > 0)
    low = F.col("low")
    has_text = F.exists("points", lambda p: F.exists(p["texts"], lambda t: F.contains(low, F.lower(t))))
    has_near = F.exists("points", lambda p: approximate(p["value"], F.col("content")).isNotNull())
    has_name = F.exists("names", lambda e: F.contains(low, F.lower(e)))
    share = F.coalesce(F.try_divide(F.size(F.filter("words", lambda w: F.contains(low, F.lower(w)))).cast("double"), F.size("words")), F.lit(0.0))
    told = met.groupBy(*key).agg(
        F.bool_or(has_text).alias("has_text"),
        F.bool_or(has_near).alias("has_near"),
        F.bool_or(has_name).alias("has_name"),
        F.max(share).alias("share"),
        F.max_by("source_level", F.struct(share, -F.col("at"))).alias("best_level"),
        F.min_by("source_level", "at").alias("source_level"),
        F.bool_or(F.col("source_level") == "full_text").alias("full"),
    )
    percents = F.filter("data_points", lambda p: p["percent"])
    values = F.transform(F.filter("data_points", lambda p: ~p["percent"]), lambda p: p["value"])
    pair = F.regexp_extract_all("claim_text", F.lit(r"(\d+(?:[,.]\d+)?\s*(?:para|→)\s*\d+(?:[,.]\d+)?)"), 1)
    ends = F.regexp_extract_all(F.get(pair, F.lit(0)), F.lit(r"(\d+(?:[,.]\d+)?)"), 1)
    ordered = F.sort_array(values, asc=False)
    x = F.when(F.size(pair) > 0, pt_number(F.get(ends, F.lit(0)))).otherwise(F.get(ordered, F.lit(0)))
    y = F.when(F.size(pair) > 0, pt_number(F.get(ends, F.lit(1)))).otherwise(F.get(ordered, F.lit(1)))
    first = F.get(percents, F.lit(0))["value"]
    wrong = F.col("has_calculation") & (F.size(values) >= 2) & (F.size(percents) > 0) & F.coalesce(~transition_holds(x, y, first), F.lit(False))
    out = c.join(told, key, "left")
    kind = F.when((F.col("claim_type") == "A") & (F.size("points") == 0), "B").otherwise(F.col("claim_type"))
    kind = F.when((kind == "B") & (F.size("names") == 0), "C").otherwise(kind)
    missing = F.when(F.coalesce("full", F.lit(False)), "NOT_FOUND_FULLTEXT").otherwise("NOT_FOUND_ABSTRACT")
    status = (
        F.when((F.col("claim_type") == "A") & wrong, "MATH_ERROR")
        .when(F.col("source_level").isNull(), "UNVERIFIABLE")
        .when(kind == "A", F.when(F.col("has_text"), "VERIFIED").when(F.col("has_near"), "APPROXIMATE_MATCH").otherwise(missing))
        .when(kind == "B", F.when(F.col("has_name"), "ENTITY_FOUND").otherwise(missing))
        .when((F.size("words") == 0) | (F.col("share") >= THEMATIC), "THEMATIC_MATCH")
        .otherwise("NOT_FOUND_ABSTRACT")
    )
    level = F.when((kind != "C") | (F.col("status") == "MATH_ERROR"), F.col("source_level")).when((F.col("status") == "THEMATIC_MATCH") & (F.size("words") > 0), F.col("best_level"))
    risk = F.element_at(F.create_map(*[F.lit(v) for kv in RISK_OF_STATUS.items() for v in kv]), F.col("status"))
    return out.withColumn("status", status).withColumn("risk", risk).select(*claims.columns, "status", "risk", F.coalesce(level, F.lit("none")).alias("source_level"))
