"""Small tables with the awkward cases of every operator."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def awkward(spark, with_null_id=False, seed=3):
    """Nulls, empty, blank and very long texts, repeated rows and ties, and columns whose names clash with results."""
    rng = random.Random(seed)
    words = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "nar tel sim rok vup".split()]
    base = sentence(rng, 120, words)
    edited = base.replace(base.split()[60], "zzz", 1)
    passage = sentence(rng, 40, words)
    texts = [
        base, base, edited, None, "", " \n\t ", "one two three", "One TWO three", passage + "\n" + sentence(rng, 30, words), sentence(rng, 25, words) + "\n" + passage,
        "été\n" * 40, "a" * 3000, "#*$%&|<> " * 60, sentence(rng, 60_000, words), "x", "the the the the", "the and of", "!!! ???",
    ]
    rows = [(k, t, ["en", "fr", None][k % 3], "s", len(t) if t else 0) for k, t in enumerate(texts)]
    if with_null_id:
        rows.append((None, base, "en", None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    # Names that the operators use for results of their own.
    for name in ("score", "kept", "label", "piece", "node", "bucket", "length", "items", "block"):
        df = df.withColumn(name, df.n_chars)
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(df, spark):
    return spark.createDataFrame([(r["doc_id"], r["doc_id"] % 2, 0) for r in df.select("doc_id").collect() if r["doc_id"] is not None], "doc_id bigint, quality int, toxic int")
