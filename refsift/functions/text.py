"""Text functions on Columns; all of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"


def stripped(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Null for the empty string: both mean `no value`."""
    return F.nullif(c, F.lit(""))


def norm_doi(c: Column) -> Column:
    """Lower case, and without the prefixes, each of which is looked for once, in this order."""
    out = F.lower(stripped(c))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.when(out.startswith(prefix), F.substring(out, F.lit(len(prefix) + 1), F.length(out))).otherwise(out)
    return out


def collapsed(c: Column) -> Column:
    """White space as single spaces, lower case."""
    return F.lower(stripped(F.regexp_replace(c, r"\s+", " ")))


def evaluation_text(*columns: Column) -> Column:
    """The non-empty ones of title, abstract and venue, in lower case."""
    return F.lower(F.concat_ws(" ", *[filled(c) for c in columns]))


def term_pattern(term: str) -> str:
    """A term between word boundaries, where letters of any script are word signs. Where a term begins or ends with
    another sign, a word boundary there asks for a word sign next to it."""
    term = term.lower()
    left = rf"(^|[^{WORD}])" if re.match(r"\w", term) else rf"[{WORD}]"
    right = rf"($|[^{WORD}])" if re.search(r"\w\Z", term) else rf"[{WORD}]"
    quoted = re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", term)
    return f"{left}{quoted}{right}"


def has_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term occurs in the lower-cased text: one alternation, read once."""
    if not terms:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{term_pattern(t)})" for t in terms))


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """Those of the terms (lower-cased) that occur in the lower-cased text. One-word terms are looked up among the words
    of the text, which is cut into words once; only phrases need a pattern each."""
    known = list(dict.fromkeys(t.lower() for t in terms))
    single = [t for t in known if re.fullmatch(r"\w+", t)]
    found = F.array().cast("array<string>")
    if single:
        found = F.array_intersect(F.split(text, rf"[^{WORD}]+"), F.array(*[F.lit(t) for t in single]))
    phrases = [F.when(text.rlike(term_pattern(t)), F.lit(t)) for t in known if t not in set(single)]
    return F.concat(found, F.filter(F.array(*phrases), lambda t: t.isNotNull())) if phrases else found


def hits_any(hits: Column, terms: Sequence[str]) -> Column:
    """Whether `term_hits` found any of the terms."""
    return F.coalesce(F.arrays_overlap(hits, F.array(*[F.lit(t.lower()) for t in terms])), F.lit(False)) if terms else F.lit(False)


def hits_count(hits: Column, terms: Sequence[str]) -> Column:
    """How many of the terms `term_hits` found."""
    return reduce(lambda a, b: a + b, [F.array_contains(hits, t.lower()).cast("int") for t in terms], F.lit(0))


def once(c: Column) -> Column:
    """c, worked out once a row: what reads or filters on it later is not rewritten to the expression itself."""
    return F.explode(F.array(c))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, [text.rlike(term_pattern(t)).cast("int") for t in terms], F.lit(0))


def host(url: Column) -> Column:
    """The lower-cased host without `www.`; null for what is no url."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def suffixes(name: Column) -> Column:
    """A host name and its parents, longest first."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def norm_issn(c: Column) -> Column:
    """XXXX-XXXX, or null."""
    packed = F.regexp_replace(F.upper(c), r"\s", "")
    found = F.regexp_extract(packed, r"^(\d{4})-?(\d{3}[\dX])$", 0)
    plain = F.regexp_replace(found, "-", "")
    return F.when(found != "", F.concat(F.substring(plain, 1, 4), F.lit("-"), F.substring(plain, 5, 4)))


def dois(text: Column) -> Column:
    """Distinct DOIs of a text in order, without trailing dots, commas and brackets."""
    found = F.regexp_extract_all(text, F.lit(r"(10\.\d{4,}/[^\s\]\)\},;]+)"), 1)
    cleaned = F.transform(found, lambda d: F.rtrim(F.rtrim(F.rtrim(d, F.lit(".")), F.lit(",")), F.lit(")")))
    return F.array_distinct(F.filter(cleaned, lambda d: F.length(d) > 8))


def tokens(c: Column, stop: Sequence[str] = ()) -> Column:
    """Distinct lower-cased words of over two signs that are no stop words."""
    words = F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", " ")), r"\s+")
    kept = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_distinct(F.array_except(kept, F.array(*[F.lit(s) for s in stop])) if stop else kept)


def content_hash(c: Column) -> Column:
    """16 hexadecimal digits of the text after the first `---`, in lower case and with single spaces."""
    low = F.lower(stripped(c))
    at = F.instr(low, "---")
    body = F.when(at > 0, F.substring(low, at + 3, F.length(low))).otherwise(low)
    return F.substring(F.sha2(stripped(F.regexp_replace(body, r"\s+", " ")), 256), 1, 16)


def abstract_of(index: Column) -> Column:
    """Text of an inverted index (word -> places): map<string, array<int>>."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " ")


def pmcid(url: Column) -> Column:
    return filled(F.regexp_extract(url, r"/(PMC\d+)", 1))


def last_first(text: Column, n: int) -> Column:
    """The first n signs, with a null for the empty text."""
    return filled(F.substring(text, 1, n))


def strip_html(c: Column) -> Column:
    """Text of markup by rules that any regular-expression engine knows: no scripts and styles, tags as spaces."""
    bare = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</(script|style|nav|header|footer)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def record_text(title: Column, abstract: Column, most: int = 1500) -> Column:
    """What of a record is embedded; the limit is the embedding model's input, not the record's."""
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.substring(F.coalesce(abstract, F.lit("")), 1, most)))
