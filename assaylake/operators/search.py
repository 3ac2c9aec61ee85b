"""Report of candidate feature subsets of a linear model.

The subsets are given, as a table of any size. The data is read once, into one Gram per
split and one per fold; every subset is judged by small solves on sub-matrices,
and all reported subsets share one scoring pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.operators.gram import gram_by
from assaylake.operators.regress import RESIDUAL_LIMIT, LinearModel, cross_validate, holdout_sse, solve_ols
from assaylake.session import materialize


@dataclass
class ReportOptions:
    """Defaults are the fixed values of the report; ``best`` None reports all candidates."""

    best: int | None = 5
    min_r2: float = 0.68
    min_q2: float = 0.68
    ad_threshold: float | None = None


SHARED_BYTES = 256 << 20  # most that the Grams sent to the tasks may take
PAGE = 64  # reported subsets that share one scoring pass


def judged(grams: dict, folds: dict, target: str, candidates: DataFrame) -> DataFrame:
    """(features, r2cv, r2, q2) of every distinct subset, solved where the candidates are: one small solve per row and fold."""
    train, test = grams["train"], grams.get("test")
    size = sum(8 * len(g.names) ** 2 for g in [*grams.values(), *folds.values()])
    if size > SHARED_BYTES:
        raise ValueError(f"the Grams of all folds take {size} bytes, more than the {SHARED_BYTES} that are sent to tasks")
    shared = candidates.sparkSession.sparkContext.broadcast((train, test, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, test, folds = shared.value
        for batch in batches:
            rows = []
            for names in batch.column(0).to_pylist():
                m = solve_ols(train, target, names)
                rows.append((float(cross_validate(folds, target, names)["r2cv"]), float(m.r2), external_q2(test, m)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], pa.float64()) for k in range(3)]], names=["features", "r2cv", "r2", "q2"])

    distinct = candidates.select("features").distinct()
    return distinct.mapInArrow(run, "features array<string>, r2cv double, r2 double, q2 double")


def external_q2(test, m: LinearModel) -> float:
    if test is None or not test.n:
        return float(m.r2)
    sse, tss = holdout_sse(test, m)
    around = tss + test.n * (test.select([m.target]).mean[0] - m.mean_y) ** 2
    return float(1.0 - sse / around) if around > 0 else float(m.r2)


def candidate_report(
    data: DataFrame, target: str, features: Sequence[str], candidates: DataFrame, split: str = "split", fold: str = "fold", options: ReportOptions | None = None
) -> DataFrame:
    """Finalists: split R2 and Q2, training R2, R2loo, RMSE, domain coverage, coefficients, rank.

    ``candidates`` has a column ``features`` (array of names) and may be of any
    size; only reported subsets come to the driver, page by page.
    """
    o = options or ReportOptions()
    grams = gram_by(data, [*features, target], split)
    folds = gram_by(data.where(F.col(split) == "train"), [*features, target], fold)
    train = grams["train"]
    ranked = materialize(judged(grams, folds, target, candidates), "candidates")
    order = [F.desc_nulls_last("q2"), F.desc_nulls_last("r2"), F.desc_nulls_last("r2cv")]
    # The list ends at the first subset that fails both thresholds.
    fails = (F.col("r2") < o.min_r2) & (F.col("q2") < o.min_q2)
    end = ranked.where(fails).orderBy(*order).limit(1).collect()
    good = ranked.where(~fails)
    if end:
        mark = F.struct(*[F.lit(end[0][c]).alias(c) for c in ("q2", "r2", "r2cv")])
        good = good.where(F.struct("q2", "r2", "r2cv") > mark)
    good = good.orderBy(*order, "features")
    exact = o.best is not None and o.ad_threshold is None
    rows = iter(good.limit(o.best).collect()) if exact else good.toLocalIterator()
    out: list[list] = []
    while o.best is None or len(out) < o.best:
        scores = list(islice(rows, PAGE))
        if not scores:
            break
        page = [solve_ols(train, target, r["features"]) for r in scores]
        out += _scored_page(data.where(F.col(split) == "train"), target, page, scores, o)
    out = out if o.best is None else out[: o.best]
    schema = (
        "rank int, features array<string>, n_features int, r2cv double, r2 double, q2 double, r2loo double, rmse_tr double, "
        "ad_coverage double, intercept double, coefficients array<double>, equation string"
    )
    out.sort(key=lambda r: -r[2])
    return data.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(out)], schema)


def _scored_page(train: DataFrame, target: str, models: list[LinearModel], scores: list, o: ReportOptions) -> list[list]:
    """Rows of the report for some subsets, from one pass over the training rows."""
    aggs = []
    for i, m in enumerate(models):
        h, e = m.leverage(), F.col(target) - m.predict()
        left = F.greatest(1.0 - h, F.lit(1e-10))
        std = e / (F.lit(math.sqrt(m.sigma2)) * F.sqrt(left))
        aggs += [F.sum((e / left) * (e / left)).alias(f"press{i}"), F.max(F.abs(std)).alias(f"worst{i}"),
                 F.avg((h < F.lit(m.h_star)).cast("double")).alias(f"inside{i}")]
    row = train.agg(*aggs).first()
    out = []
    for i, (m, s) in enumerate(zip(models, scores)):
        cover = 0.0 if row[f"worst{i}"] is not None and row[f"worst{i}"] >= RESIDUAL_LIMIT else 100.0 * (row[f"inside{i}"] or 0.0)
        if o.ad_threshold is not None and cover < o.ad_threshold:
            continue
        text = f"{m.const:.6f} " + " ".join(f"{'+' if b >= 0 else '-'} {abs(b):.6f}*{c}" for c, b in zip(m.features, m.coef))
        out.append([m.features, len(m.features), s["r2cv"], s["r2"], s["q2"], 1.0 - row[f"press{i}"] / m.tss, math.sqrt(m.sse / m.n), float(cover), float(m.const), [float(b) for b in m.coef], text])
    return out
