"""Writing results: CSV and Parquet stages, split export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.session import new_path


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """A folder of CSV parts with a header and no index column; quotes inside fields are doubled, blanks are kept."""
    writer = df.write.option("header", True).option("sep", sep).option("encoding", encoding).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_stage(df: DataFrame, label: str) -> str:
    """Persist a stage (original, cleaned, ...) as Parquet; stages are never overwritten."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def split_export(df: DataFrame, split: str = "split") -> DataFrame:
    """Leading ``Set`` column with Train or Test."""
    return df.select(F.initcap(split).alias("Set"), *[c for c in df.columns if c != split])
