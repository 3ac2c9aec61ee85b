"""A corpus pipeline of five stages, each one operator of ``assaylake.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; its result is written as Parquet and read again. All stages but
the last return the columns of ``documents``. Rows with a null id pass the
near-duplicate and repeat stages unchanged; an empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.llm import minhash, mixing, packing, repeats, rules
from assaylake.llm.frames import documents, table, written
from assaylake.llm.queries import domains_of

PULL = 0.02  # weight of a document's distance to rate 1 against the domains' misses


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line model reject go."""
    return rules.keep(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays, the one with the smallest id."""
    found = minhash.near_duplicates(docs, percent=80)
    stay = found.where("kept and doc_id is not null").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    kept = docs.join(stay.hint("merge"), "doc_id", "left_semi").withColumn("__copy", F.row_number().over(one)).where("__copy = 1").drop("__copy")
    return kept.unionByName(docs.where("doc_id is null"))


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus go; bytes left without the rest of their character go too."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = repeats.remove_repeats(docs.withColumn("__null", F.col("text").isNull()), length=100, with_kept=True, carry=(*carry, "__null"))
    text = F.when(~F.col("__null"), F.expr("regexp_replace(coalesce(try_validate_utf8(kept), make_valid_utf8(kept)), '\ufffd', '')"))
    done = cut.withColumn("text", text)
    columns = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.withColumns(columns).select(*docs.columns) if columns else done.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of at most 1 that bring the mix towards clean tokens only; documents whose rate rounds to none go.

    The pull leaves a document at its rate unless the other domains outweigh its clean part."""
    model = mixing.fit_domains(docs, domains_of(table(spark, sf_dir, "labels")))
    if model is None:
        return docs
    posteriors = written(mixing.posteriors(docs, model), "posteriors")
    steps, _, _ = mixing.fit_rates(posteriors, model, {"clean": 1.0}, max_rate=1.0, pull=PULL)
    return mixing.realise(docs, model, steps, max_rate=1.0)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    import public_tokenizers

    return packing.pack(written(packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_repeats", suffix_repeats),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

# Line models, similarity links, repeated strings, fitted rates and packing are not expressible in one SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
