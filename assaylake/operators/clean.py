"""Missing values, column selection, scaling and outlier rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.columns import complete_rows, numeric_columns, safe_div, sum_columns
from assaylake.operators.gram import Gram, gram
from assaylake.operators.ordered import forward_fill, join_group_rows, with_global_index
from assaylake.operators.quantiles import exact_quantiles, grouped_quantiles

# Texts that mean "missing".
MISSING_TOKENS = ("na", "NA", "n/a", "", "null", "NULL", "None", "nan", "NaN")

# ---------------------------------------------------------------- missing values


def tokens_to_null(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing-value texts become NULL in string columns, NaN in float columns."""
    new: dict[str, Column] = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            new[f.name] = F.when(~c.isin(*tokens), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            new[f.name] = F.when(~F.isnan(c), c)
    return df.withColumns(new) if new else df


def null_counts(df: DataFrame) -> dict[str, int]:
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first().asDict()


def drop_rows_with_nulls(df: DataFrame) -> DataFrame:
    return complete_rows(df)


def drop_columns_with_nulls(df: DataFrame) -> DataFrame:
    holes = null_counts(df)
    return df.select(*[c for c in df.columns if not holes[c]])


def fill_constant(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=list(cols) if cols else None)


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return _fill(df, list(cols or numeric_columns(df)), lambda c: F.avg(c))


def fill_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    medians = exact_quantiles(df, cols, [0.5])
    return _fill_values(df, {c: medians[c][0] for c in cols})


def fill_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column, the smallest of several."""
    return _fill_values(df, mode_values(df, list(cols or df.columns)))


TRACKED, SURVIVORS = 4096, 1000  # counters per column and task, and values that a column's summary gives back


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value of every column (the smallest of several), nulls skipped, by two aggregates for any number of columns.

    A mergeable summary of frequent values is kept for all columns at once; its
    error is at most 3.5 / ``TRACKED`` of the rows. The values that may be the
    mode are then counted exactly. A count above three times the error proves the mode,
    because every value left out has less. Columns without such a value (nearly
    all values differ) are counted with a shuffle on the value.
    """
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    others = [c for c in cols if not isinstance(df.schema[c].dataType, plain)]
    cols = [c for c in cols if c not in others]
    quoted = {c: F.col(f"`{c}`") for c in cols}
    if not quoted:
        return {c: mode_value(df, c) for c in others}
    tracked = {c: F.expr(f"approx_top_k(`{c}`, {SURVIVORS}, {TRACKED})").alias(f"top{i}") for i, c in enumerate(cols)}
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted[c]).alias(f"n{i}") for i, c in enumerate(cols)], *tracked.values()).first()
    error = 3.5 / TRACKED * first["n"]
    likely: dict[str, list] = {}
    for i, c in enumerate(cols):
        found = [(r["item"], r["count"]) for r in first[f"top{i}"] or [] if r["item"] is not None]
        most = max((n for _, n in found), default=0)
        likely[c] = [v for v, n in found if n + 2 * error >= most]
    asked = [(c, k, v) for c in cols for k, v in enumerate(likely[c])]
    counts = df.agg(*[F.count_if(quoted[c] == F.lit(v).cast(df.schema[c].dataType)).alias(f"c{j}") for j, (c, _, v) in enumerate(asked)]).first() if 0 < len(asked) <= 512 else None
    exact: dict[str, list] = {c: [] for c in cols}
    if counts is not None:
        for j, (c, _, v) in enumerate(asked):
            exact[c].append((-counts[f"c{j}"], v))
    elif asked:
        marks = F.array_compact(F.array(*[
            F.when(quoted[c].isin(*likely[c]), F.struct(F.lit(i).alias("i"), F.array_position(F.array(*[F.lit(v).cast(df.schema[c].dataType) for v in likely[c]]), quoted[c]).alias("k")))
            for i, c in enumerate(cols) if likely[c]
        ]))
        for r in df.select(F.explode(marks).alias("m")).groupBy("m.i", "m.k").agg(F.count(F.lit(1)).alias("n")).collect():
            c = cols[r["i"]]
            exact[c].append((-r["n"], likely[c][int(r["k"]) - 1]))
    out: dict[str, object] = {c: mode_value(df, c) for c in others}
    for i, c in enumerate(cols):
        if not first[f"n{i}"]:
            out[c] = None
        elif exact[c] and -min(exact[c])[0] > 3 * error:
            out[c] = min(exact[c])[1]
        else:
            out[c] = mode_value(df, c)
    return out


def mode_value(df: DataFrame, col: str):
    """Counted with a shuffle on the value: ``mode()`` would hold all values in one task."""
    c = F.col(f"`{col}`")
    top = (
        df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
    )
    return top[0]["v"] if top else None


def impute(df: DataFrame, how: Mapping[str, object], order: Sequence[str] | None = None) -> DataFrame:
    """Fill each column its own way: "mean", "median", "mode", "ffill" (in row order ``order``, ending in a unique key), or a constant.

    A text constant is given as ("constant", value) where it equals one of these
    names; a number for a text column is written as text.
    """
    ways = {c: w[1] if isinstance(w, tuple) else w for c, w in how.items()}
    named = lambda name: [c for c, w in how.items() if isinstance(w, str) and w == name]
    values: dict[str, object] = {}
    if named("mean"):
        values |= df.agg(*[F.avg(f"`{c}`").alias(c) for c in named("mean")]).first().asDict()
    if named("median"):
        values |= {c: q[0] for c, q in exact_quantiles(df, named("median"), [0.5]).items()}
    if named("mode"):
        values |= mode_values(df, named("mode"))
    computed = {c for name in ("mean", "median", "mode", "ffill") for c in named(name)}
    for c, w in ways.items():
        if c not in computed:
            values[c] = str(w) if isinstance(df.schema[c].dataType, T.StringType) else w
    out = df
    for c in named("ffill"):
        if not order:
            raise ValueError("a forward fill needs the row order")
        out = forward_fill(out, list(order), c, "__filled").drop(c).withColumnRenamed("__filled", c)
    return _fill_values(out, values).select(*df.columns)


def _fill(df: DataFrame, cols: list[str], agg) -> DataFrame:
    row = df.agg(*[agg(F.col(c)).alias(c) for c in cols]).first().asDict()
    return _fill_values(df, row)


def _fill_values(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Coalesce; an integer column filled with a fraction becomes double."""
    new = {}
    for c, v in values.items():
        if v is None:
            continue
        integral = isinstance(df.schema[c].dataType, T.IntegralType)
        if integral and isinstance(v, float):
            new[c] = F.coalesce(F.col(c).cast("double"), F.lit(v))
        else:
            new[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(new) if new else df


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and missing cells before and after a cleaning step."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        holes = sum_columns([F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
        return df.agg(
            F.count(F.lit(1)).alias(f"rows_{tag}"),
            F.lit(len(df.columns)).cast("long").alias(f"cols_{tag}"),
            F.coalesce(F.sum(holes), F.lit(0)).cast("long").alias(f"missing_{tag}"),
        )

    both = side(before, "before").crossJoin(side(after, "after"))  # two single rows
    return both.withColumns(
        {
            "rows_removed": F.col("rows_before") - F.col("rows_after"),
            "cols_removed": F.col("cols_before") - F.col("cols_after"),
            "missing_filled": F.col("missing_before") - F.col("missing_after"),
        }
    )


# ---------------------------------------------------------------- columns


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename many columns; blanks and unchanged names are skipped, clashes rejected."""
    wanted = {old: new.strip() for old, new in mapping.items()}
    wanted = {old: new for old, new in wanted.items() if new and new != old}
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    targets = list(wanted.values())
    if len(set(targets)) != len(targets):
        raise ValueError("two columns would get the same name")
    staying = set(df.columns) - set(wanted)
    clash = sorted(staying & set(targets))
    if clash:
        raise ValueError(f"names already in use: {clash}")
    return df.select(*[F.col(f"`{c}`").alias(wanted.get(c, c)) for c in df.columns])  # at once, so names may be swapped


def numeric_complete(df: DataFrame) -> DataFrame:
    """Numeric columns without any null."""
    return drop_columns_with_nulls(df.select(*numeric_columns(df)))


def keep_groups(df: DataFrame, groups: DataFrame, group_ids: Sequence[str], keep_others: bool = True) -> DataFrame:
    """Columns listed in the chosen groups, plus text columns listed in no group."""
    listed = groups.where(F.col("descriptor").isin(*df.columns)).select("group_id", "descriptor").collect()
    chosen = {r["descriptor"] for r in listed if r["group_id"] in set(group_ids)}
    in_any = {r["descriptor"] for r in listed}
    text = set(df.columns) - set(numeric_columns(df)) - in_any if keep_others else set()
    return df.select(*[c for c in df.columns if c in chosen or c in text])


def features_of_groups(
    df: DataFrame, groups: DataFrame, group_ids: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Feature names of the groups in listed order without repeats, and those absent from ``df``."""
    rows = groups.where(F.col("group_id").isin(*group_ids)).select("group_id", "item_no", "descriptor").collect()
    rank = {g: i for i, g in enumerate(group_ids)}
    names = dict.fromkeys(r["descriptor"] for r in sorted(rows, key=lambda r: (rank[r["group_id"]], r["item_no"])))
    return [c for c in names if c in df.columns], [c for c in names if c not in df.columns]


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with one distinct value; NULL counts as a value."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    out = []
    for i, name in enumerate(df.columns):
        known = row[f"n{i}"]
        if row["n"] and (known == 0 or (known == row["n"] and row[f"lo{i}"] == row[f"hi{i}"])):
            out.append(name)
    return out


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def low_variance_columns(df: DataFrame, threshold: float = 0.01, ddof: int = 1) -> list[str]:
    cols = numeric_columns(df)
    fn = F.var_samp if ddof else F.var_pop
    row = df.agg(*[fn(F.col(c).cast("double")).alias(c) for c in cols]).first().asDict()
    return [c for c in cols if row[c] is not None and row[c] <= threshold]


def drop_low_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    return df.drop(*low_variance_columns(df, threshold))


def drop_zero_variance(df: DataFrame, population_threshold: float | None = None) -> DataFrame:
    gone = set(low_variance_columns(df, 0.0))
    if population_threshold is not None:
        gone |= set(low_variance_columns(df, population_threshold, ddof=0))
    return df.drop(*gone)


def correlated_columns(df: DataFrame, threshold: float = 0.9, cols: Sequence[str] | None = None) -> list[str]:
    """Column j goes if it correlates with any earlier column, kept or not."""
    cols = list(cols or numeric_columns(df))
    r = np.abs(gram(df, cols).correlation())
    return [c for j, c in enumerate(cols) if j and np.nanmax(np.append(r[:j, j], -1.0)) > threshold]


def drop_correlated(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    return df.drop(*correlated_columns(df, threshold))


# Names recognised as sample identifiers.
ID_NAMES = ("id", "sample_id", "name", "compound", "sample_name", "sample")


def report_order(df: DataFrame, leading: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Leading columns, identifiers, used features, then the rest."""
    ids = [c for c in df.columns if c.lower() in ID_NAMES]
    order = dict.fromkeys([*leading, *ids, *features, *df.columns])
    return df.select(*[c for c in order if c in df.columns])


# ---------------------------------------------------------------- scaling


def scaling_parameters(df: DataFrame, cols: Sequence[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """(location, scale) per column; a zero scale becomes 1."""
    cols = list(cols)
    if method == "standard":
        row = df.agg(
            *[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
        ).first()
        got = {c: (row[f"a_{c}"], row[f"s_{c}"]) for c in cols}
    elif method == "minmax":
        row = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"s_{c}") for c in cols]).first()
        got = {c: (row[f"a_{c}"], row[f"s_{c}"] - row[f"a_{c}"] if row[f"a_{c}"] is not None else None) for c in cols}
    elif method == "robust":
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        got = {c: (q[c][1], q[c][2] - q[c][0] if q[c][1] is not None else None) for c in cols}
    else:
        raise ValueError(f"unknown scaling method: {method}")
    return {c: (float(a or 0.0), float(s) if s else 1.0) for c, (a, s) in got.items()}


def scaling_from_gram(g: Gram, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Standard-scaling parameters out of a Gram that is there anyway."""
    at = [g.names.index(c) for c in cols]
    sd = np.sqrt(np.maximum(np.diag(g.cross)[at], 0.0) / g.n)
    return {c: (float(g.mean[i]), float(s) if s > 0 else 1.0) for c, i, s in zip(cols, at, sd)}


def apply_scaling(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(a)) / F.lit(s) for c, (a, s) in params.items()})


def scale(df: DataFrame, method: str = "standard", cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return apply_scaling(df, scaling_parameters(df, cols, method))


def scale_on_train(df: DataFrame, cols: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """Parameters from the training rows only, applied to all rows."""
    return apply_scaling(df, scaling_parameters(df.where(F.col(split) == train), cols, "standard"))


# ---------------------------------------------------------------- rows


def delete_rows(df: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(rows.select(*key), list(key), "left_anti")


def outlier_flag(df: DataFrame, target: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Add ``is_outlier`` from bounds over all rows."""
    y = F.col(target)
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        q1, q3 = exact_quantiles(df, [target], [0.25, 0.75])[target]
        flag = (y < F.lit(q1 - k * (q3 - q1))) | (y > F.lit(q3 + k * (q3 - q1)))
    elif method == "zscore":
        k = 3.0 if threshold is None else threshold
        row = df.agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("s")).first()
        flag = F.abs(y - F.lit(row["m"])) > F.lit(k * row["s"])
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return df.withColumn("is_outlier", F.coalesce(flag, F.lit(False)))


def outlier_flag_by(df: DataFrame, target: str, by: str, k: float = 1.5) -> DataFrame:
    """IQR bounds inside each group; the bounds are one row per group.

    Null is a group of its own; a row with a null value, or in a group without
    bounds, is no outlier.
    """
    q = grouped_quantiles(df, [by], [target], [0.25, 0.75]).select(
        F.col(by).alias("__by"), F.col(target)[0].alias("__q1"), F.col(target)[1].alias("__q3")
    )
    y, iqr = F.col(target), F.col("__q3") - F.col("__q1")
    flag = (y < F.col("__q1") - k * iqr) | (y > F.col("__q3") + k * iqr)
    joined = join_group_rows(df, q.withColumnRenamed("__by", by), [by])
    return joined.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("__q1", "__q3")


def box_stats(df: DataFrame, by: str, target: str) -> DataFrame:
    """Quartiles and 1.5 IQR whisker ends per category."""
    q = grouped_quantiles(df, [by], [target], [0.25, 0.5, 0.75]).select(
        by, *[F.col(target)[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    iqr = F.col("q3") - F.col("q1")
    y = F.col(target)
    return (
        join_group_rows(df.select(by, target).where(F.col(by).isNotNull()), q, [by], "inner")
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count(y).alias("n"),
            F.min(F.when(y >= F.col("q1") - 1.5 * iqr, y)).alias("whisker_low"),
            F.max(F.when(y <= F.col("q3") + 1.5 * iqr, y)).alias("whisker_high"),
            F.count_if((y < F.col("q1") - 1.5 * iqr) | (y > F.col("q3") + 1.5 * iqr)).alias("n_outliers"),
        )
    )


# ---------------------------------------------------------------- transforms of a target


def check_domain(df: DataFrame, col: str, method: str) -> None:
    y = F.col(col)
    bad = {"log": y <= 0, "sqrt": y < 0, "inverse": y == 0}.get(method)
    if bad is not None and df.where(bad).limit(1).count():
        raise ValueError(f"{method} is not defined for all values of {col}")


def transform_target(col: Column, method: str) -> Column:
    """log, sqrt, square or inverse; NULL outside the domain."""
    return {
        "none": col,
        "log": F.when(col > 0, F.ln(col)),
        "sqrt": F.when(col >= 0, F.sqrt(col)),
        "square": col * col,
        "inverse": F.when(col != 0, safe_div(F.lit(1.0), col)),
    }[method]


def boxcox(col: Column, lam: float) -> Column:
    """Box-Cox of a positive column."""
    return F.ln(col) if abs(lam) < 1e-12 else (F.pow(col, F.lit(lam)) - 1.0) / F.lit(lam)


def yeojohnson(col: Column, lam: float) -> Column:
    pos = F.log1p(col) if abs(lam) < 1e-12 else (F.pow(col + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    neg = (
        -F.log1p(-col) if abs(lam - 2.0) < 1e-12 else -(F.pow(1.0 - col, F.lit(2.0 - lam)) - 1.0) / F.lit(2.0 - lam)
    )
    return F.when(col >= 0, pos).otherwise(neg)


def power_lambda(
    df: DataFrame, col: str, method: str = "boxcox", lo: float = -5.0, hi: float = 5.0, grid: int = 21, rounds: int = 5
) -> float:
    """Maximum-likelihood lambda: a grid of likelihoods per pass, then a finer grid."""
    y = F.col(col).cast("double")
    if method == "boxcox":
        check_domain(df, col, "log")
        transform, jacobian = boxcox, F.ln(y)
    elif method == "yeojohnson":
        transform, jacobian = yeojohnson, F.signum(y) * F.log1p(F.abs(y))
    else:
        raise ValueError(f"unknown power transform: {method}")
    data = df.where(y.isNotNull())
    best = 1.0
    for _ in range(rounds):
        lams = np.linspace(lo, hi, grid)
        row = data.agg(
            F.count(y).alias("n"), F.sum(jacobian).alias("j"),
            *[F.var_pop(transform(y, float(x))).alias(f"v{i}") for i, x in enumerate(lams)],
        ).first()
        ll = [
            -0.5 * row["n"] * np.log(row[f"v{i}"]) + (x - 1.0) * row["j"] if row[f"v{i}"] else -np.inf
            for i, x in enumerate(lams)
        ]
        best = float(lams[int(np.argmax(ll))])
        step = (hi - lo) / (grid - 1)
        lo, hi = best - step, best + step
    return best


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Code by sorted distinct text; the dictionary is ranked in ranges, so it may be large."""
    cats = df.select(F.col(col).cast("string").alias("__cat")).distinct()
    codes = with_global_index(cats, ["__cat"], out)
    return df.join(codes, F.col(col).cast("string").eqNullSafe(F.col("__cat")), "left").drop("__cat")


def first_appearance_codes(df: DataFrame, col: str, order: str, out: str) -> DataFrame:
    """Code categories in order of their first row."""
    cats = df.groupBy(F.col(col).alias("__cat")).agg(F.min(order).alias("__first"))
    codes = with_global_index(cats, ["__first"], out).drop("__first")
    return df.join(codes, F.col(col).eqNullSafe(F.col("__cat")), "left").drop("__cat")
