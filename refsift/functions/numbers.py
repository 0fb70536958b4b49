"""Numbers in Portuguese and English texts, and arithmetic on facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of magnitude and their factors, and signs of a unit.
TRILLION = r"\b(trillion|trilh[õo]es)\b"
BILLION = r"\b(billion|bilh[õo]es)\b"
MILLION = r"\b(million|milh[õo]es)\b"
THOUSAND = r"\b(thousand|mil)\b"
MAGNITUDES = (("mil", 1e3), ("milhões", 1e6), ("milhoes", 1e6), ("bilhões", 1e9), ("bilhoes", 1e9), ("trilhões", 1e12), ("trilhoes", 1e12))
CURRENCY = r"(?i)US?\$|R\$|\$|dólar|dollar|USD|BRL"
UNITS = (
    r"(?i)(minutes?|hours?|days?|weeks?|years?|months?|minutos?|horas?|dias?|semanas?|anos?|meses?"
    r"|patients?|pacientes?|beds?|leitos?|min/week|per week|per year|por semana|por ano)"
)

#: Relative difference up to which a value counts as found.
TOLERANCE = 0.05


def pt_number(c: Column) -> Column:
    """Both separators: dots group, the comma is decimal. A comma alone groups if three digits follow and at most three
    precede it. A dot alone is decimal. What is no number is 0."""
    has_comma, has_dot = F.instr(c, ",") > 0, F.instr(c, ".") > 0
    grouped = c.rlike(r"^[^,]{0,3},[^,]{3}$")
    plain = (
        F.when(has_comma & has_dot, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(has_comma & grouped, F.replace(c, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(c, F.lit(","), F.lit(".")))
        .otherwise(c)
    )
    return F.coalesce(plain.try_cast("double"), F.lit(0.0))


def number_value(raw: Column, context: Column, scale_by_context: bool = True) -> Column:
    """The last separator decides which one is decimal; a comma alone groups if three digits follow. Then the largest
    magnitude named anywhere in the context multiplies the value (scale_by_context=False leaves it)."""
    s = F.regexp_replace(raw, r"[\s']", "")
    comma, dot = F.length(s) - F.instr(F.reverse(s), ","), F.length(s) - F.instr(F.reverse(s), ".")
    has_comma, has_dot = F.instr(s, ",") > 0, F.instr(s, ".") > 0
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    decimal_comma = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = (
        F.when(has_comma & has_dot, F.when(comma > dot, decimal_comma).otherwise(no_commas))
        .when(has_comma & s.rlike(r"^[^,]*,[^,]{3}$"), no_commas)
        .when(has_comma, F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(s)
    )
    value = plain.try_cast("double")
    if not scale_by_context:
        return value
    low = F.lower(context)
    factor = (
        F.when(low.rlike(TRILLION), 1e12)
        .when(low.rlike(BILLION), 1e9)
        .when(low.rlike(MILLION), 1e6)
        .when(low.rlike(THOUSAND) & low.rlike(r"\d\s+mil\b"), 1e3)
        .otherwise(1.0)
    )
    return value * factor


def number_class(context: Column) -> Column:
    """percentage, currency, metric or count, by what stands around the middle of the context."""
    half = F.floor(F.length(context) / 2).cast("int")
    start = F.greatest(F.lit(0), half - 20)
    near = F.substring(context, start + 1, half + 20 - start)
    return F.when(F.instr(near, "%") > 0, "percentage").when(context.rlike(CURRENCY), "currency").when(context.rlike(UNITS), "metric").otherwise("count")


def derived(formula: Column, values: Column) -> Column:
    """The value that a formula gives; null where it has none."""
    a, b, n = F.get(values, F.lit(0)), F.get(values, F.lit(1)), F.size(values)
    return (
        F.when((formula == "percentage_reduction") & (n >= 2), F.try_divide(a - b, a) * 100)
        .when((formula == "percentage_increase") & (n >= 2), F.try_divide(b - a, a) * 100)
        .when((formula == "cagr") & (n >= 3), (F.pow(F.try_divide(b, a), F.try_divide(F.lit(1.0), F.get(values, F.lit(2)))) - 1) * 100)
        .when((formula == "ratio") & (n >= 2), F.try_divide(a, b))
        .when((formula == "difference") & (n >= 2), a - b)
        .when(formula == "sum", F.aggregate(values, F.lit(0.0), lambda x, y: x + y))
    )


def derivation_holds(formula: Column, values: Column, stated: Column) -> Column:
    """Within 1 % of the calculated value, or 0.1."""
    found = derived(formula, values)
    return F.coalesce(F.abs(found - stated) <= F.greatest(F.abs(found) * 0.01, F.lit(0.1)), F.lit(False))


def close_to(value: Column, wanted: Column, tolerance: float = TOLERANCE) -> Column:
    """Within the tolerance of the wanted value; nothing is close to 0."""
    return F.coalesce(F.try_divide(F.abs(value - wanted), F.abs(wanted)) <= tolerance, F.lit(False))


def transition_holds(first: Column, second: Column, percent: Column, points: float = 5.0) -> Column:
    """`first to second` is a reduction or an increase of percent, give or take some points; null if both are 0."""
    high, low = F.greatest(first, second), F.least(first, second)
    less, more = F.try_divide(high - low, high) * 100, F.coalesce(F.try_divide(high - low, low) * 100, F.lit(0.0))
    return F.when(high != 0, (F.abs(less - percent) <= points) | (F.abs(more - percent) <= points))


def ref_range(c: Column) -> Column:
    """`1,5,11-17` as sorted distinct numbers; parts that are no number or range are left out."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p))

    def end(p: Column, group: int) -> Column:
        digits = F.regexp_extract(p, r"^(\d+)(?:\s*-\s*(\d+))?$", group)
        return F.when(digits != "", digits.try_cast("int"))  # a cast that fails costs some ten times as much as one that doesn't

    ends = F.transform(parts, lambda p: F.struct(end(p, 1).alias("a"), end(p, 2).alias("b")))
    known = F.filter(ends, lambda e: e["a"].isNotNull() & (F.coalesce(e["b"], e["a"]) >= e["a"]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(known, lambda e: F.sequence(e["a"], F.coalesce(e["b"], e["a"]))))))
