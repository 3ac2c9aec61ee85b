"""Batch scoring: input transforms, validation, additive models, response curves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.columns import first_true, sum_columns
from assaylake.functions.text import parse_plain
from assaylake.operators.rules import validate

# Fixed values of the particle-toxicity input: allowed categories, inclusive ranges, header names.
SHAPES = ("Irregular", "Lentil", "Sphere")
CELL_TYPES = ("A431", "A549", "AGS", "Caco-2", "HEK293", "HFL1", "HUVEC", "SHSY5Y", "THP-1", "WISH")
ASSAYS = ("CCK-8", "MTS", "MTT", "NRU")
YES_NO = ("Yes", "No")
DIAMETER, TIME, CONCENTRATION = "Diameter (nm)", "Time (hr)", "Concentration (ug/ml)"
RANGES = {DIAMETER: (5, 100), TIME: (3, 72), CONCENTRATION: (0.01, 1000)}
REQUIRED = ("Shape", "Anatase", "Rutile", DIAMETER, "Cell_Type", TIME, "Test", CONCENTRATION)
ALLOWED = {"Shape": SHAPES, "Cell_Type": CELL_TYPES, "Test": ASSAYS, "Anatase": YES_NO, "Rutile": YES_NO}
HEADER_NAMES = {
    "Shape": ("shape",),
    "Anatase": ("anatase",),
    "Rutile": ("rutile",),
    DIAMETER: ("diameter", "diameter_nm", "diameter (nm)"),
    "Cell_Type": ("cell_type", "celltype", "cell type"),
    TIME: ("time", "time_hr", "time (hr)", "exposure_time"),
    "Test": ("test", "assay"),
    CONCENTRATION: ("concentration", "concentration_ug_ml", "concentration (ug/ml)", "conc"),
}
# Viability bands (lower limit, text) and the response level of a half-maximal effect.
VIABILITY_BANDS = (
    (80.0, "Low toxicity - cells largely viable"),
    (50.0, "Moderate toxicity - significant cell death"),
    (20.0, "High toxicity - majority of cells affected"),
)
VIABILITY_WORST = "Severe toxicity - extensive cell death"
HALF_RESPONSE = 50.0
# Rating limits (exclusive) and the time needed for degradation.
TIME_CATEGORIES = (
    (4.75, "Hours"),
    (4.25, "Hours to Days"),
    (3.75, "Days"),
    (3.25, "Days to Weeks"),
    (2.75, "Weeks"),
    (2.25, "Weeks to Months"),
    (1.75, "Months"),
)
TIME_WORST = "Recalcitrant"


def log_concentration(c: Column) -> Column:
    """log10, and 0 for non-positive concentrations."""
    x = c.cast("double")
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(0.0))


def viability_band(c: Column) -> Column:
    return F.when(c.isNotNull(), first_true([(c >= F.lit(v), F.lit(t)) for v, t in VIABILITY_BANDS], F.lit(VIABILITY_WORST)))


def time_category(rating: Column) -> Column:
    return F.when(rating.isNotNull(), first_true([(rating > F.lit(v), F.lit(t)) for v, t in TIME_CATEGORIES], F.lit(TIME_WORST)))


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def logit(p: Column) -> Column:
    return F.when((p > 0) & (p < 1), F.ln(p / (1.0 - p)))


# ---------------------------------------------------------------- batch table


def standard_headers(df: DataFrame) -> DataFrame:
    """Rename known header spellings to the standard names."""
    known = {a: name for name, aliases in HEADER_NAMES.items() for a in aliases}
    return df.withColumnsRenamed({c: known[c.lower().strip()] for c in df.columns if c.lower().strip() in known})


def prepare_batch(df: DataFrame) -> DataFrame:
    """Standard headers, numbers parsed, ``errors`` and ``is_valid`` per row."""
    df = validate(standard_headers(df), REQUIRED, ALLOWED, RANGES)
    return df.withColumns({c: parse_plain(F.trim(F.col(f"`{c}`").cast("string"))) for c in RANGES})


def predict_batch(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], out: str = "prediction", keep: Sequence[str] | None = None) -> DataFrame:
    """Score with any model that maps a pandas batch to numbers; the model travels in the closure."""
    kept = df.select(*keep) if keep else df
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + f", {out} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: fn(pdf).astype(float)})

    return kept.mapInPandas(run, schema)


# ---------------------------------------------------------------- additive models


class AdditiveModel:
    """Intercept plus one score per feature: by category, or by bin of a number.

    ``terms`` maps a feature to ``{category: score}`` or to ``(edges, scores)``
    with one score more than edges. A value on an edge falls into the upper bin;
    an unknown category or a missing value scores 0.
    """

    def __init__(self, intercept: float, terms: Mapping[str, Mapping[str, float] | tuple[Sequence[float], Sequence[float]]]):
        self.intercept, self.terms = float(intercept), dict(terms)

    def contribution(self, feature: str) -> Column:
        x, term = F.col(f"`{feature}`"), self.terms[feature]
        if isinstance(term, Mapping):
            pairs = [(x.cast("string") == F.lit(k), F.lit(float(v))) for k, v in term.items()]
        else:
            edges, scores = term
            pairs = [(x.isNull(), F.lit(0.0))] + [(x < F.lit(float(e)), F.lit(float(s))) for e, s in zip(edges, scores)]
            return first_true(pairs, F.lit(float(scores[-1])))
        return first_true(pairs, F.lit(0.0))

    def score(self) -> Column:
        return F.lit(self.intercept) + sum_columns([self.contribution(f) for f in self.terms])

    def contributions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Long table (keys, feature, contribution)."""
        wide = df.select(*keep, *[self.contribution(f).alias(f) for f in self.terms])
        return wide.unpivot(list(keep), list(self.terms), "feature", "contribution")

    def importance(self, df: DataFrame) -> DataFrame:
        """Mean |contribution| per feature."""
        row = df.agg(*[F.avg(F.abs(self.contribution(f))).alias(f) for f in self.terms])
        return row.unpivot([], list(self.terms), "feature", "importance")


# ---------------------------------------------------------------- response curves


def concentration_grid(df: DataFrame, low: float = 1.0, high: float = 1000.0, points: int = 50, out: str = CONCENTRATION) -> DataFrame:
    """Every row repeated over a log-spaced grid; both ends included."""
    a, step = math.log10(low), (math.log10(high) - math.log10(low)) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.pow(F.lit(10.0), F.lit(a) + i * F.lit(step)))
    return df.withColumn(out, F.explode(grid))


def half_response(curves: DataFrame, key: Sequence[str], conc: str, value: str) -> DataFrame:
    """First fall through 50 by linear interpolation; NULL where a curve never crosses.

    A curve is a bounded grid per sample, so the window holds one curve.
    """
    w = Window.partitionBy(*key).orderBy(conc)
    v, c = F.col(value), F.col(conc)
    stepped = curves.withColumns({"__v2": F.lead(value).over(w), "__c2": F.lead(conc).over(w)})
    at = c + (F.lit(HALF_RESPONSE) - v) * (F.col("__c2") - c) / (F.col("__v2") - v)
    hit = (v >= HALF_RESPONSE) & (F.col("__v2") < HALF_RESPONSE)
    return stepped.groupBy(*key).agg(F.min_by(F.when(hit, at), F.when(hit, c)).alias("ic50"))
