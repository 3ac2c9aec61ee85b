"""One pass for means and cross-products: the base of correlation, OLS and PCA.

The cross-products are taken around a shift near the data (the mean of a small
head sample), so nothing cancels, and the exact mean is restored at the end.
The result is sized by columns and, if asked, by groups such as folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import complete_rows

EXPRESSION_LIMIT = 12  # up to this many columns the pass is plain JVM sums


@dataclass
class Gram:
    """Count, mean and centred cross-product matrix of ``names``."""

    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if other.n == 0:
            return self
        if self.n == 0:
            return other
        d = other.mean - self.mean
        mean = self.mean + d * (other.n / n)
        return Gram(self.names, n, mean, self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def __sub__(self, other: Gram) -> Gram:
        n = self.n - other.n
        if n == 0 or other.n == 0:
            return Gram(self.names, n, self.mean, self.cross if n else self.cross * 0)
        mean = (self.mean * self.n - other.mean * other.n) / n
        d = other.mean - mean
        return Gram(self.names, n, mean, self.cross - other.cross - np.outer(d, d) * (n * other.n / self.n))

    def select(self, names: Sequence[str]) -> Gram:
        idx = [self.names.index(c) for c in names]
        return Gram(list(names), self.n, self.mean[idx], self.cross[np.ix_(idx, idx)])

    def scaled(self, names: Sequence[str], loc: np.ndarray, scale: np.ndarray) -> Gram:
        """Gram of ``(x - loc) / scale`` for ``names``, others unchanged."""
        a, b = np.zeros(len(self.names)), np.ones(len(self.names))
        for c, m, s in zip(names, loc, scale):
            a[self.names.index(c)], b[self.names.index(c)] = m, s
        return Gram(self.names, self.n, (self.mean - a) / b, self.cross / np.outer(b, b))

    def covariance(self, ddof: int = 1) -> np.ndarray:
        return self.cross / (self.n - ddof)

    def correlation(self) -> np.ndarray:
        """Pearson matrix; NaN where a column is constant."""
        sd = np.sqrt(np.diag(self.cross))
        sd = np.where(sd > 1e-12 * np.maximum(np.abs(self.mean), 1.0), sd, np.nan)
        r = self.cross / np.outer(sd, sd)
        r[np.diag_indices_from(r)] = np.where(np.isnan(sd), np.nan, 1.0)
        return np.clip(r, -1.0, 1.0)


def gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    """Gram of scalar columns over the rows complete in them."""
    return _gram_by(df, list(cols), None)[None]


def gram_by(df: DataFrame, cols: Sequence[str], by: str) -> dict[object, Gram]:
    """The same per value of ``by`` (few values: folds or splits) in one pass."""
    return _gram_by(df, list(cols), by)


def gram_array(df: DataFrame, col: str, names: Sequence[str], by: str | None = None) -> dict[object, Gram]:
    """Gram of the elements of an array column."""
    key = F.col(by) if by else F.lit(None).cast("string")
    return _arrow_pass(df.select(key.alias("k"), F.col(col).cast("array<double>").alias("x")), list(names))


def _gram_by(df: DataFrame, cols: list[str], by: str | None) -> dict[object, Gram]:
    if len(cols) > EXPRESSION_LIMIT:
        key = F.col(by) if by else F.lit(None).cast("string")
        wide = F.array(*[F.col(c).cast("double") for c in cols])
        return _arrow_pass(df.select(key.alias("k"), wide.alias("x")), cols)
    data = complete_rows(df.select(*([by] if by else []), *[F.col(c).cast("double").alias(c) for c in cols]), cols)
    head = data.limit(1000).agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = [head[c] or 0.0 for c in cols]
    x = [F.col(c) - F.lit(s) for c, s in zip(cols, shift)]
    p = len(cols)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(x[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs]
    rows = (data.groupBy(by) if by else data.groupBy()).agg(*aggs).collect()
    out = {}
    for row in rows:
        n = row["n"]
        s = np.array([row[f"s{i}"] or 0.0 for i in range(p)])
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"m{i}_{j}"] or 0.0
        out[row[by] if by else None] = _from_shifted(cols, n, s, m, np.array(shift))
    return out


def _from_shifted(names, n, s, m, shift) -> Gram:
    n = int(n)
    mean = s / n if n else s
    return Gram(list(names), n, shift + mean, m - np.outer(s, s) / n if n else m)


def _arrow_pass(data: DataFrame, names: list[str]) -> dict[object, Gram]:
    """Per partition numpy partials, added up element-wise on the JVM side.

    A partition emits one row per matrix row and key, so the shuffle carries
    p + 1 short vectors per partition, whatever the number of input rows.
    """
    p = len(names)
    head = data.limit(1000).select(F.posexplode("x").alias("i", "v")).where("NOT isnan(v)").groupBy("i").agg(F.avg("v").alias("m")).collect()
    shift = np.zeros(p)
    for row in head:
        shift[row["i"]] = row["m"]
    key_type = data.schema["k"].dataType.simpleString()

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[object, np.ndarray] = {}
        key_arrow = None
        for batch in batches:
            key_arrow = batch.schema.field("k").type
            if batch.num_rows == 0:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p) - shift
            whole = ~np.isnan(x).any(axis=1)  # nulls arrive as NaN
            z = np.hstack([np.ones((len(x), 1)), x])[whole]
            keys = batch.column(0).filter(pa.array(whole))
            if not len(z):
                continue
            codes = keys.dictionary_encode()
            codes = codes if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks()
            idx = codes.indices.to_pandas().fillna(-1).astype(int).to_numpy()
            values = codes.dictionary.to_pylist()
            for code in np.unique(idx):
                part = z if len(values) <= 1 and (idx == code).all() else z[idx == code]
                k = values[code] if code >= 0 else None
                acc[k] = acc.get(k, 0.0) + part.T @ part
        for k, m in acc.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k] * (p + 1), type=key_arrow),
                    pa.array(range(p + 1), type=pa.int32()),
                    pa.array(m.tolist(), type=pa.list_(pa.float64())),
                ],
                names=["k", "i", "row"],
            )

    summed = (
        data.where("x IS NOT NULL")
        .mapInArrow(partials, f"k {key_type}, i int, row array<double>")
        .groupBy("k", "i")
        .agg(Summarizer.sum(array_to_vector("row")).alias("row"))
    )
    mats: dict[object, np.ndarray] = {}
    for row in summed.collect():  # groups x (p + 1) rows
        mats.setdefault(row["k"], np.zeros((p + 1, p + 1)))[row["i"]] = row["row"].toArray()
    return {k: _from_shifted(names, m[0, 0], m[0, 1:], m[1:, 1:], shift) for k, m in mats.items()}


def matrix_frame(spark, names: Sequence[str], m: np.ndarray, value: str = "value") -> DataFrame:
    """A column-sized matrix as (row, col, value) rows; NaN becomes NULL."""
    rows = [
        (a, b, None if np.isnan(m[i, j]) else float(m[i, j]))
        for i, a in enumerate(names)
        for j, b in enumerate(names)
    ]
    return spark.createDataFrame(rows, f"row string, col string, {value} double")
