"""DataFrame helpers of the corpus operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.session import new_path

WORD = r"[^\x20\x09-\x0D]+"  # fixed value: the word rule of the queries


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(c: Column | str) -> Column:
    """A-Z to a-z, nothing else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket_of(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, then let Spark drop the shuffle files behind it.

    The written table survives lost executors. Spark removes shuffle files when
    the driver's objects for them are collected; asking for that here keeps the
    disk use of long jobs at one stage instead of the sum of all.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` which no later result reads."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


SAMPLE_BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], max_rows: int, max_bytes: int = SAMPLE_BYTES, only: Column | None = None) -> list[dict]:
    """At most ``max_rows`` labelled documents, picked by a hash of their id, collected for fitting.

    Rows with a null id or label are left out; of a repeated id the smallest
    labels count, and the smallest text. The texts together hold at most
    ``max_bytes``: they are taken in the order of the hash while they fit, whatever
    their length; only a text of more than a sixteenth of the bound is passed over, so
    that one text can not take the place of all others. Only the bounded list of ids
    is sent to the scan of the texts; texts are not shuffled.
    """
    spark = docs.sparkSession
    wanted = labels.where(F.col("doc_id").isNotNull())
    for c in columns:
        wanted = wanted.where(F.col(c).isNotNull())
    if only is not None:
        wanted = wanted.where(only)
    picked = (
        wanted.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(max_rows).collect()
    )
    if not picked:
        return []
    label = {r["doc_id"]: r["label"].asDict() for r in picked}
    kind = dict(labels.dtypes)["doc_id"]
    texts_of = lambda ids, *c: docs.where("text is not null").select("doc_id", *c).join(F.broadcast(spark.createDataFrame([(k,) for k in ids], f"doc_id {kind}")), "doc_id")
    size: dict = {}
    for r in texts_of(label, F.octet_length("text").alias("n")).collect():
        size[r["doc_id"]] = max(size.get(r["doc_id"], 0), r["n"])
    chosen, total = [], 0
    for k in label:
        if k in size and size[k] <= max_bytes // 16:
            if total + size[k] > max_bytes:
                break
            chosen.append(k)
            total += size[k]
    texts: dict = {}
    for r in texts_of(chosen, "text").collect() if chosen else []:
        texts[r["doc_id"]] = min(texts.get(r["doc_id"], r["text"]), r["text"])
    return [{"doc_id": k, "text": texts[k], **label[k]} for k in chosen]
