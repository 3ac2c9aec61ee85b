"""Search-term sheets: combining and deriving formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.text import is_spelling_fix, main_term, strip_all, strip_field_tags

# Prefixes that are written once when every formula of a group has them.
TOPIC_PREFIXES = ("TS=", "TI=", "AU=", "SO=", "AB=")
TITLE_PREFIXES = ("TITLE-ABS-KEY",)
# Marker rows of a stored sheet, which are layout and not entries.
MARKERS = ("__SECTION_HEADER__", "__SUBSECTION_HEADER__", "__COLUMN_HEADER__", "__COMBINED_STRING_ROW__", "__SEPARATOR_ROW__")


def entries(sheet: DataFrame, raw: str = "Raw_Output", section: str = "Section") -> DataFrame:
    """Entry rows of a sheet: without marker rows and old-style section lines."""
    marker = strip_all(F.coalesce(F.col(raw), F.lit(""))).isin(*MARKERS)
    return sheet.where(~marker & ~F.coalesce(F.col(section).startswith("==="), F.lit(False)))


def without_outer_parentheses(c: Column) -> Column:
    return F.when(c.startswith("(") & c.endswith(")"), F.substring(c, F.lit(2), F.greatest(F.length(c) - 2, F.lit(0)))).otherwise(c)


def _unprefixed(n: int):
    """Formula without its first ``n`` characters and outer parentheses, in parentheses."""
    return lambda s: F.concat(
        F.lit("("), without_outer_parentheses(F.substring(s["core"], F.lit(n + 1), F.length(s["core"]))), F.lit(")")
    )


def combine(df: DataFrame, by: Sequence[str], order: str, formula: str, prefixes: Sequence[str] = (), out: str = "combined") -> DataFrame:
    """OR-joined formulas per group in row order; a prefix shared by all members is hoisted.

    The result of a group is one string, so a group's formulas meet in one task;
    only the formula text and its order key are shuffled.
    """
    f = F.col(formula)
    kept = df.select(*by, order, F.when(strip_all(f) != "", f).alias("__f"))
    stripped = strip_all(F.col("__f"))
    core = strip_all(without_outer_parentheses(stripped))
    aggs = [F.array_sort(F.collect_list(F.when(F.col("__f").isNotNull(), F.struct(order, F.col("__f").alias("f"), core.alias("core"))))).alias("__l")]
    aggs += [F.bool_and(core.startswith(p)).alias(f"__p{i}") for i, p in enumerate(prefixes)]
    grouped = kept.groupBy(*by).agg(*aggs)
    plain = F.array_join(F.transform("__l", lambda s: F.concat(F.lit("("), s["f"], F.lit(")"))), " OR ")
    result = F.when(F.size("__l") == 0, F.lit(None)).otherwise(plain)
    for i, p in reversed(list(enumerate(prefixes))):
        body = F.transform("__l", _unprefixed(len(p)))
        hoisted = F.concat(F.lit(p + "("), F.array_join(body, " OR "), F.lit(")"))
        result = F.when(F.col(f"__p{i}") & (F.size("__l") > 0), hoisted).otherwise(result)
    return grouped.select(*by, result.alias(out))


def needs_formula(*cols: str) -> Column:
    """Any formula missing."""
    out = F.lit(False)
    for c in cols:
        out = out | (strip_all(F.coalesce(F.col(c), F.lit(""))) == "")
    return out


def derive_formulas(df: DataFrame, name: str, base: str, *others: str) -> DataFrame:
    """Other databases' formulas from the base formula without its field tags.

    Adds ``failed`` and ``corrected``: the main term of the first derived
    formula, kept only where it is a spelling fix of the name.
    """
    has = strip_all(F.coalesce(F.col(base), F.lit(""))) != ""
    derived = F.when(has, strip_field_tags(F.col(base))).otherwise("")
    out = df.withColumns({c: derived for c in others}).withColumn("failed", ~has)
    terms = [F.when(main_term(F.col(c)) != "", main_term(F.col(c))) for c in (*others, base)]
    best = F.coalesce(*terms)
    return out.withColumn("corrected", F.when(is_spelling_fix(F.col(name), best), best))
