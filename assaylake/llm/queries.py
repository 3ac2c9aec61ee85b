"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import convnet, language, merkle, minhash, mixing, packing, prefix_trie, quotes, repeats, rules, spotsigs, suffix_tree, token_counts
from assaylake.llm.frames import bucket_of, documents, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_language_bitmask")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(bucket_of("doc_id", 4) != 2))
    return language.predict(docs, model).withColumn("held_out", bucket_of("doc_id", 4) == 2)


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rules.apply(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_byte_convnet")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = convnet.fit(docs, table(spark, sf_dir, "labels"), only=bucket_of("doc_id", 5) != 0)
    return convnet.score(docs, net).withColumn("held_out", bucket_of("doc_id", 5) == 0)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(written(packing.tokenise(documents(spark, sf_dir), path), "pieces"))


@query("op8_minmax_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


@query("op3_suffix_repeats")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), length=100)


@query("op10_suffix_tree_scores")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    corpus = suffix_tree.gather(docs, bucket_of("doc_id", 10) != 0)
    return suffix_tree.score(corpus, suffix_tree.fit(corpus)).withColumn("held_out", bucket_of("doc_id", 10) == 0)


@query("op2_spotsigs_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_and_next(documents(spark, sf_dir))


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic labels."""
    name = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")
    return labels.select("doc_id", name.alias("domain"))


@query("op4_soft_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, domains_of(table(spark, sf_dir, "labels")), {"clean": 0.9, "toxic": 0.05, "low": 0.05}, total_share=1.0)


@query(
    "op7_quotation_linking",
    r"""
    WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS norm FROM conversations),
    o AS (SELECT conv_id, norm, min(turn) AS original FROM m WHERE norm <> '' GROUP BY 1, 2),
    p AS (SELECT a.conv_id, a.turn, a.role, a.text, o.original AS parent,
                 (CASE WHEN b.conv_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c.conv_id IS NULL THEN 0 ELSE 1 END) AS n_passages,
                 (CASE WHEN o.original IS NULL THEN 0 ELSE 1 END) + (CASE WHEN o2.original IS NULL THEN 0 ELSE 1 END) AS n_linked
          FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN m c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2
          LEFT JOIN o ON o.conv_id = b.conv_id AND o.norm = b.norm LEFT JOIN o o2 ON o2.conv_id = c.conv_id AND o2.norm = c.norm),
    r AS (SELECT conv_id, turn, turn AS thread, 0 AS depth FROM p WHERE parent IS NULL
          UNION ALL SELECT p.conv_id, p.turn, r.thread, r.depth + 1 FROM p JOIN r ON p.conv_id = r.conv_id AND p.parent = r.turn)
    SELECT p.conv_id, p.turn, p.role, regexp_replace(regexp_replace(p.text, '^\s+', ''), '\s+$', '') AS own_text, CAST(p.n_passages AS BIGINT) AS n_passages, CAST(p.n_linked AS BIGINT) AS n_linked,
           p.parent AS parent_turn, r.thread AS thread_turn, CAST(r.depth AS BIGINT) AS depth
    FROM p JOIN r ON p.conv_id = r.conv_id AND p.turn = r.turn
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.linked_messages(quotes.as_mailbox(table(spark, sf_dir, "conversations")))
    return linked.select(F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("own_text"), "n_passages", "n_linked", F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"), "depth")


def crc_sql(table: str, column: str) -> str:
    """CTEs ``sums`` and ``crc`` (the value and ``crc``) with the unsigned crc32 of the decimal text of every value of a whole-number column."""
    text = f"CAST({column} AS VARCHAR)"
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # fixed value: the reversed polynomial
    return f"""ids AS (SELECT DISTINCT {column} FROM {table} WHERE {column} IS NOT NULL),
        sums AS (SELECT {column}, 0 AS i, 0 AS b, CAST(4294967295 AS BIGINT) AS c FROM ids
            UNION ALL SELECT {column}, CASE WHEN b = 0 THEN i + 1 ELSE i END, (b + 1) % 9,
                CASE WHEN b = 0 THEN xor(c, CAST(ascii(substr({text}, i + 1, 1)) AS BIGINT)) ELSE {step} END
            FROM sums WHERE b > 0 OR i < length({text})),
        crc AS (SELECT {column}, xor(c, 4294967295) AS crc FROM sums WHERE b = 0 AND i = length({text}))"""


def merkle_sql(levels: int = 7, arity: int = 16) -> str:
    """The manifest level by level, for at most ``arity ** levels`` rows in a source."""
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        crc_sql("documents", "doc_id"),
        f"hashed AS (SELECT d.doc_id, source, {leaf('text').replace('doc_id', 'd.doc_id')} AS leaf, CASE WHEN crc % 5 = 0 THEN {leaf(lower).replace('doc_id', 'd.doc_id')} END AS altered FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id)",
        """a0 AS (SELECT doc_id, altered, leaf AS h, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM hashed)""",
    ]

    def climb(name: str, first: str) -> None:
        for k in range(levels):
            below = first if k == 0 else f"{name}{k}"
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, place // {arity} AS place, CASE WHEN max(size) = 1 THEN 1 ELSE (max(size) + {arity - 1}) // {arity} END AS size, "
                f"CASE WHEN max(size) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h FROM {below} GROUP BY tree, place // {arity})"
            )

    climb("a", "a0")
    parts.append(f"s0 AS (SELECT 1 AS tree, a.tree AS source_tree, a.h, row_number() OVER (ORDER BY a.tree) - 1 AS place, count(*) OVER () AS size FROM a{levels} a)")
    climb("s", "s0")

    def walk(name: str, first: str, start: str, columns: str) -> None:
        """Siblings and the folded hash per level: w<k> holds the state below level k."""
        parts.append(f"{name}w0 AS ({start})")
        for k in range(levels):
            below = first if k == 0 else f"{name}{k}"
            left = f"coalesce((SELECT string_agg(o.h, '' ORDER BY o.place) FROM {below} o WHERE o.tree = w.tree AND o.place // {arity} = w.place // {arity} AND o.place < w.place), '')"
            right = left.replace("o.place < w.place", "o.place > w.place")
            parts.append(
                f"{name}x{k} AS (SELECT w.*, {left} AS l, {right} AS r, (SELECT max(o.size) FROM {below} o WHERE o.tree = w.tree) AS level_size FROM {name}w{k} w)"
            )
            parts.append(
                f"{name}w{k + 1} AS (SELECT tree, place // {arity} AS place, {columns}, proof || l || r AS proof, CASE WHEN level_size = 1 THEN f ELSE sha256(l || f || r) END AS f FROM {name}x{k})"
            )

    walk("a", "a0", "SELECT tree, place, tree AS source_tree, place AS leaf_place, doc_id, h AS leaf, '' AS proof, coalesce(altered, h) AS f FROM a0", "source_tree, leaf_place, doc_id, leaf")
    walk(
        "s", "s0", f"SELECT s0.tree, s0.place, w.doc_id, w.leaf, s0.h AS subroot, w.proof, w.f FROM aw{levels} w JOIN s0 ON s0.source_tree = w.source_tree", "doc_id, leaf, subroot",
    )
    return (
        "WITH RECURSIVE " + ",\n".join(parts)
        + f"\nSELECT w.doc_id, w.leaf, w.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified FROM sw{levels} w JOIN s{levels} t ON t.tree = w.tree"
    )


@query("op11_merkle_manifest", merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(documents(spark, sf_dir), F.coalesce(tampered, F.lit(False))).withColumnRenamed("key", "doc_id")


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op13_prefix_trie",
    rf"""
    WITH RECURSIVE {crc_sql("conversations", "conv_id")},
    t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
    hashed AS (SELECT conv_id, turn, sha256(CAST(octet_length(encode(role)) AS VARCHAR) || ':' || role || text) AS hash, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words FROM t),
    own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, hash) AS pos FROM hashed),
    c AS (SELECT conv_id, crc % 4 AS h, conv_id - conv_id % 20 AS donor, (SELECT count(*) FROM own o WHERE o.conv_id = crc.conv_id - crc.conv_id % 20 AND o.pos <= crc.crc % 4) AS got FROM crc),
    r AS (SELECT c.conv_id, o.pos, o.hash, o.words FROM c JOIN own o ON o.conv_id = c.donor AND o.pos <= c.h
          UNION ALL SELECT c.conv_id, c.got + o.pos - c.h, o.hash, o.words FROM c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
    steps AS (SELECT c.conv_id, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS words, '' AS path, count(r.pos) AS length FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
          UNION ALL SELECT r.conv_id, r.pos, r.words, string_agg(r.hash, '') OVER (PARTITION BY r.conv_id ORDER BY r.pos), count(*) OVER (PARTITION BY r.conv_id) FROM r),
    n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
                 sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM steps GROUP BY path, depth),
    k AS (SELECT n.path, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n d WHERE d.depth = n.depth + 1 AND left(d.path, length(n.path)) = n.path) AS n_children
          FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = left(n.path, length(n.path) - 64)),
    s AS (SELECT n.path, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
          FROM n JOIN n d ON left(d.path, length(n.path)) = n.path JOIN k ON k.path = d.path GROUP BY n.path)
    SELECT n.conv_id, n.depth, k.parent_conv_id, n.n_convs, CAST(k.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM n JOIN k ON k.path = n.path JOIN s ON s.path = n.path
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations"), F.col("conv") - F.col("conv") % 20, given, 3))
