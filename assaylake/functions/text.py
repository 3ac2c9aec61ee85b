"""Numbers in text, join keys, search-formula text and output sanitising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.columns import string_columns

# ---------------------------------------------------------------- numbers in text

# Accepted number syntax and the marks removed before parsing.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DECIMAL_COMMA = r"\d+,\d+"
LEADING_ZERO = r"^0\d+$"
WHOLE_KEY = r"^(0|-?[1-9]\d{0,14})$"
NEGATIVE_PARENTHESES = r"^\(\s*(.*)\s*\)$"
SPACE_OR_APOSTROPHE = "[ '’]"
DOT_THOUSANDS = r"(?<=\d)\.(?=\d{3}(\D|$))"
COMMA_NUMBER = r"^-?\d+(?:\.\d{3})*(?:,\d+)?$"
BLANKS, RARE_LINE_ENDS = " \t\n\x0b\f\r", ("\u0085", "\u2028", "\u2029")
NO_BREAK_SPACES = "\u00a0\u202f"
MIN_NUMERIC_RATIO = 0.3
LEADING_ZERO_RATIO = 0.5


def parse_plain(c: Column) -> Column:
    """Strict number text to double, NULL otherwise (no 'd'/'f' suffixes)."""
    return F.when(c.rlike(PLAIN_NUMBER), c.try_cast("double"))


def plain_spaces(c: Column) -> Column:
    """No-break spaces become spaces; ends are trimmed."""
    return F.trim(F.translate(c, NO_BREAK_SPACES, "  "))


def number_from_text(c: Column, decimal_mark: str = "auto") -> Column:
    """Thousands marks, decimal comma, percent and parenthesised negatives to double.

    ``decimal_mark='.'`` keeps a dot before three digits as the decimal mark.
    """
    x = F.regexp_replace(plain_spaces(c), NEGATIVE_PARENTHESES, "-$1")
    x = F.regexp_replace(x, SPACE_OR_APOSTROPHE, "")
    if decimal_mark != ".":
        x = F.regexp_replace(x, DOT_THOUSANDS, "")
    percent = x.endswith("%")
    x = F.replace(x, F.lit("%"))
    x = F.when(x.rlike(COMMA_NUMBER), F.translate(x, ",", ".")).otherwise(x)
    value = parse_plain(x)
    return F.when(percent, value / 100.0).otherwise(value)


def numeric_text_columns(df: DataFrame, cols: Sequence[str] | None = None, min_ratio: float = MIN_NUMERIC_RATIO) -> dict[str, str]:
    """Which text columns are numbers, and how to read them: one pass over all columns.

    Values are 'number' (full rule) or 'comma' (plain comma-to-dot replacement).
    """
    cols = list(cols or string_columns(df))
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        aggs += [
            F.count(c).alias(f"known{i}"),
            F.count_if(c.rlike(LEADING_ZERO)).alias(f"zero{i}"),
            F.coalesce(F.bool_or(c.rlike(DECIMAL_COMMA)), F.lit(False)).alias(f"comma{i}"),
            F.count(number_from_text(c)).alias(f"num{i}"),
            F.count(parse_plain(F.translate(c, ",", "."))).alias(f"simple{i}"),
        ]
    row = df.agg(*aggs).first()
    n, out = row["n"] or 1, {}
    for i, name in enumerate(cols):
        if not row[f"known{i}"] or row[f"zero{i}"] / n >= LEADING_ZERO_RATIO:
            continue
        if row[f"num{i}"] and (row[f"comma{i}"] or row[f"num{i}"] / n >= min_ratio):
            out[name] = "number"
        elif row[f"comma{i}"] and row[f"simple{i}"]:
            out[name] = "comma"
    return out


def coerce_numeric_text(df: DataFrame, cols: Sequence[str] | None = None, min_ratio: float = MIN_NUMERIC_RATIO) -> DataFrame:
    """Replace text columns that hold numbers by double columns."""
    how = numeric_text_columns(df, cols, min_ratio)
    read = {"number": number_from_text, "comma": lambda c: parse_plain(F.translate(c, ",", "."))}
    return df.withColumns({c: read[h](F.col(f"`{c}`")) for c, h in how.items()}) if how else df


# ---------------------------------------------------------------- join keys

# Texts that are no key, and when a number counts as whole.
KEY_MISSING = ("", "nan", "none", "null", "nat", "n/a", "na")
WHOLE_RELATIVE, WHOLE_ABSOLUTE = 1e-5, 1e-12


def key_text(c: Column) -> Column:
    """Trimmed key, NULL for missing marks."""
    text = plain_spaces(c.cast("string"))
    return F.when(~F.lower(text).isin(*KEY_MISSING), text)


def key_number(key: Column) -> Column:
    """The key as a number, unless it is a whole number already or has leading zeros."""
    return F.when(~key.rlike(WHOLE_KEY) & ~key.rlike(LEADING_ZERO), parse_plain(F.translate(key, ",", ".")))


def key_from(key: Column, value: Column) -> Column:
    whole = F.rint(value)
    is_whole = F.abs(value - whole) <= F.lit(WHOLE_ABSOLUTE) + F.lit(WHOLE_RELATIVE) * F.abs(whole)
    scientific = F.format_string("%.14e", value)
    short = F.regexp_replace(scientific, r"\.?0+e", "e")
    fixed = F.rtrim(scientific.cast("double").try_cast("decimal(38,18)").cast("string"), F.lit("0"))
    fraction = F.when(F.abs(value) >= 1e-4, fixed).otherwise(short)
    return F.when(value.isNull(), key).when(is_whole, F.coalesce(whole.try_cast("decimal(38,0)").cast("string"), key)).otherwise(fraction)


def normalise_key(c: Column) -> Column:
    """One text form for the same key: '1', '1.0', ' 1 ' and '1,0' become '1'.

    Identifiers with leading zeros stay as they are; missing marks become NULL;
    fractions are written with 15 significant digits.
    """
    key = key_text(c)
    return key_from(key, key_number(key))


def with_keys(df: DataFrame, cols: dict[str, str], complete: bool = False) -> DataFrame:
    """Add normalised keys (new name -> column), in steps so that nothing is parsed twice.

    Whole-number columns need no parsing: their text is the key. ``complete``
    leaves out rows without a key and declares the new columns non-null, so a
    join adds no null test that would repeat the parsing.
    """
    if complete:
        df = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols.values()))
    plain = {out for out, c in cols.items() if isinstance(df.schema[c].dataType, T.IntegralType)}
    text = {out: c for out, c in cols.items() if out not in plain}
    df = df.withColumns({out: F.col(f"`{cols[out]}`").cast("string") for out in plain}) if plain else df
    if not text:
        return df
    df = df.withColumns({out: key_text(F.col(f"`{c}`")) for out, c in text.items()})
    for out in text if complete else ():
        df = df.where(F.col(out).isNotNull())
    df = df.withColumns({f"__n_{out}": key_number(F.col(out)) for out in text})
    final = lambda c: F.coalesce(c, F.lit("")) if complete else c
    return df.withColumns({out: final(key_from(F.col(out), F.col(f"__n_{out}"))) for out in text}).drop(*[f"__n_{out}" for out in text])


# ---------------------------------------------------------------- output text

MAX_TEXT = 200  # fixed value: longest text passed on


def safe_text(c: Column, max_len: int = MAX_TEXT) -> Column:
    """Without control characters, cut with an ellipsis."""
    s = F.regexp_replace(c.cast("string"), r"[\x00-\x1F\x7F]", "")
    return F.when(F.length(s) > max_len, F.concat(F.substring(s, 1, max_len - 1), F.lit("…"))).otherwise(s)


def finite(c: Column) -> Column:
    """NULL instead of NaN or infinity."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), c)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


# ---------------------------------------------------------------- search formulas

# Reasoning tags, field tags, and the limits of the text checks.
REASONING_TAGS = (
    r"(?is)<think>.*?</think>",
    r"(?is)<thinking>.*?</thinking>",
    r"(?is)\[thinking\].*?\[/thinking\]",
)
FIELD_TAGS = r"\[(?:tiab|tw|MeSH Terms|MeSH|all|au|ti|ab)\]"
REPETITION_MIN_CHARS, REPETITION_MIN_PARTS, REPETITION_UNIQUE = 50, 5, 0.15
SPELLING_MIN_EDITS, SPELLING_LENGTH_RATIO = 3, 0.7


def strip_all(c: Column) -> Column:
    """Trim every kind of white space at both ends; every run of blanks is looked at once."""
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++$", "")


def strip_each(items: Column) -> Column:
    """``strip_all`` of every text of an array, without a pattern where plain trimming does the same.

    That is so unless a text holds a rare line end, as blanks in front of a last one go too.
    """

    def one(c: Column) -> Column:
        rare = [F.contains(c, F.lit(x)) for x in RARE_LINE_ENDS]
        return F.when(rare[0] | rare[1] | rare[2], strip_all(c)).otherwise(F.btrim(c, F.lit(BLANKS)))

    return F.transform(items, one)


def strip_reasoning(c: Column) -> Column:
    for pattern in REASONING_TAGS:
        c = F.regexp_replace(c, pattern, "")
    return strip_all(c)


def strip_field_tags(c: Column) -> Column:
    return strip_all(F.regexp_replace(c, FIELD_TAGS, ""))


def is_repetitive(c: Column) -> Column:
    """Long OR lists in which fewer than 15 % of the parts differ."""
    parts = F.split(c, " OR ", -1)
    unique = F.size(F.array_distinct(F.transform(parts, strip_all)))
    return F.coalesce(
        (F.length(c) >= REPETITION_MIN_CHARS) & (F.size(parts) > REPETITION_MIN_PARTS)
        & (unique < F.size(parts) * REPETITION_UNIQUE),
        F.lit(False),
    )


def is_spelling_fix(original: Column, corrected: Column) -> Column:
    """Few edits and similar length, but not the same text."""
    a, b = strip_all(F.lower(original)), strip_all(F.lower(corrected))
    allowed = F.greatest(F.lit(SPELLING_MIN_EDITS), F.floor(F.length(a) / 10).cast("int"))
    ratio = F.try_divide(F.length(b), F.length(a))
    return F.coalesce((a != b) & (F.levenshtein(a, b) <= allowed) & (ratio > SPELLING_LENGTH_RATIO), F.lit(False))


def main_term(c: Column) -> Column:
    """First quoted phrase, else the first OR part of the first parentheses, without tags."""
    quoted = F.regexp_extract(c, '"([^"]+)"', 1)
    inner = F.regexp_extract(c, r"\(([^)]+)\)", 1)
    first = F.regexp_replace(strip_all(F.split(inner, " OR ", 2)[0]), r"\[.*?\]", "")
    first = F.regexp_replace(first, "^[\"'() ]+|[\"'() ]+$", "")
    return F.when(quoted != "", quoted).otherwise(F.coalesce(first, F.lit("")))


def combine_formulas(parts: Column, operator: str = "OR") -> Column:
    """Join formulas, each in parentheses; a single one stays bare."""
    kept = F.filter(parts, lambda q: strip_all(q) != "")
    wrapped = F.array_join(F.transform(kept, lambda q: F.concat(F.lit("("), q, F.lit(")"))), f" {operator} ")
    return F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "").when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(wrapped)
