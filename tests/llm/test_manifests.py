"""Hash trees, token counts and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaylake.llm import merkle, positions, prefix_trie, queries, token_counts
from tests.llm.cases import SCHEMA, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows, arity, altered):
    """(leaf, subroot, root, proof, folded) of every row, as a sorted list."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(enc, [r["doc_id"], r["source"], r["lang"], r["n_chars"], text])))

    def tree(h):
        ways, at = [[] for _ in h], list(range(len(h)))
        while len(h) > 1:
            for i, w in enumerate(at):
                b = w // arity * arity
                ways[i].append(("".join(h[b:w]), "".join(h[w + 1 : b + arity])))
                at[i] = w // arity
            h = [H("".join(h[i : i + arity])) for i in range(0, len(h), arity)]
        return h[0], ways

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))
    sides = []
    for s in order:
        groups[s].sort(key=key)
        sides.append(tree([leaf(r, r["text"]) for r in groups[s]]))
    root, top = tree([s for s, _ in sides]) if sides else (None, [])
    out = []
    for s, (subroot, ways), up in zip(order, sides, top):
        for r, way in zip(groups[s], ways):
            text = r["text"]
            if altered(r) and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for a, b in way + up:
                h = H(a + h + b)
            out.append((leaf(r, r["text"]), subroot, root, H("".join(a + b for a, b in way + up)), h, h == root))
    return sorted(out)


def got_manifest(df):
    return sorted(tuple(r)[1:] for r in df.collect())


@pytest.mark.parametrize("arity", [2, 16])
def test_manifest_with_awkward_rows(spark, arity):
    base = awkward(spark, with_null_id=True)
    more = [(k % 40, f"Text {k % 40}", None, [None, "", "a", "é", "ab"][k % 5], k) for k in range(130)]
    df = base.unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)
    tampered = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    found = merkle.manifest(df, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)), arity=arity)
    want = brute_manifest([r.asDict() for r in df.collect()], arity, tampered)
    assert got_manifest(found) == want and {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_sizes(spark, n):
    df = spark.createDataFrame([(k, "T", None, "s", 1) for k in range(n)], SCHEMA)
    found = merkle.manifest(df, F.lit(False))
    assert got_manifest(found) == brute_manifest([r.asDict() for r in df.collect()], 16, lambda r: False)


def test_manifest_of_equal_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(7, "T", None, "s", 1)] * 20, SCHEMA)
    assert got_manifest(merkle.manifest(df, F.lit(True))) == brute_manifest([r.asDict() for r in df.collect()], 16, lambda r: True)
    assert merkle.manifest(empty(spark), F.lit(False)).collect() == []


def test_places_in_groups_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b", f"g{k % 9}"]), k % 50) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    found = positions.ranked(df, "g", ["v"], rows_per_range=40).collect()
    groups = defaultdict(list)
    for g, v in rows:
        groups[g].append(v)
    start = 0
    for g in sorted(groups, key=lambda s: (s is not None, s or "")):
        mine = sorted((r["rank"], r["v"]) for r in found if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(groups[g]))) and [v for _, v in mine] == sorted(groups[g])
        assert {(r["size"], r["start"]) for r in found if r["g"] == g} == {(len(groups[g]), start)}
        start += len(groups[g])


# Token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(PATH, token_counts.proven(PATH), token_counts.safe_classes(PATH))


def test_proven_strings_are_one_token(tokenizer):
    one = token_counts.proven(PATH)
    assert 45_000 < len(one) <= tokenizer.get_vocab_size()
    assert all(len(e.ids) == 1 for e in tokenizer.encode_batch(sorted(one), add_special_tokens=False))


def test_counts_against_the_library_on_random_strings(tokenizer, counter):
    rng = random.Random(4)
    parts = [*"abc  \n\t 'stredm1²½!?<|>éß　 中文字́​😀\x85\x1c\x1f\x00ɐꟍ׉", "<|endoftext|>", "'s", " the", "  ", " don't", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(8000)]
    assert [counter(t) for t in texts] == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_do_not_depend_on_the_pieces(tokenizer, counter):
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "'ll", "é", "中", "<|endoftext|>", "!"]) for _ in range(3000))
    assert "".join(token_counts.cuts(text, 50)) == text and len(list(token_counts.cuts(text, 50))) > 50
    whole = len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert sum(counter._piece(p) for p in token_counts.cuts(text, 50)) == whole


def test_counts_only_merge_what_is_not_proven(tokenizer):
    asked = []
    counter = token_counts.Counter(PATH, token_counts.proven(PATH), token_counts.safe_classes(PATH))
    counter._encode = type("Spy", (), {"encode_batch_fast": lambda self, w, add_special_tokens: (asked.extend(w), tokenizer.encode_batch(w, add_special_tokens=False))[1]})()
    assert counter("the house qqxyzzy qqxyzzy is") == len(tokenizer.encode("the house qqxyzzy qqxyzzy is").ids)
    assert asked == [" qqxyzzy"]


def test_token_query(spark, sf, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.QUERIES["op12_token_counts"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 1024)


def test_token_counts_of_awkward_rows(spark, tokenizer):
    df = awkward(spark, with_null_id=True).withColumn("n_tokens", F.lit("x"))
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in token_counts.count(df, PATH).collect()) == want
    assert token_counts.count(empty(spark), PATH).collect() == []
    with pytest.raises(ValueError):
        token_counts.proven(public_tokenizers.path("word_bpe_49k.json"))


# Prefix trie

TALK = "conv_id bigint, turn bigint, role string, text string"


def brute_trie(rows, donor=lambda c: c - c % 20, given=lambda c: zlib.crc32(str(c).encode()) % 4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own[c].append((turn is not None, turn or 0, H(f"{len(r.encode())}:{r}{t}"), r, t))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {c: tuple(turns.get(donor(c), [])[: given(c)] + turns[c][given(c) :]) for c in turns}
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0)
    ends = defaultdict(list)
    for c, path in built.items():
        ends[path].append(c)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], H(",".join(map(str, sorted(ends[p]))))) for p, m in nodes.items()
    )


def talk(rng, n):
    """Conversations that share beginnings, one with very many turns, nulls, ties and repeated rows."""
    rows = []
    for c in range(n):
        for k in range(rng.randint(0, 7)):
            rows.append((c * 3, k, rng.choice(["user", None]), rng.choice(["hello there", "x", "", None, "a b c"]) if rng.random() < 0.9 else f"own {c}"))
    rows += [(1000 + c, k, "user", f"line {k}" if k < 30 + c else f"line {c}") for c in range(3) for k in range(40)]
    rows += [(2000, None, "user", "late"), (2000, 1, "user", "late"), (2000, 1, "user", "later"), (2000, 1, "user", "late"), (None, 0, "user", "nobody"), (-7, 0, "user", "minus")]
    return rows + [(20_001, 0, "a", "only"), (20_002, 0, "a", "only")]


def got_trie(df):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("shard, segment", [(2048, 64), (3, 4), (1, 1)])
def test_trie_against_brute_force(spark, shard, segment):
    rows = talk(random.Random(shard), 40)
    df = spark.createDataFrame(rows, TALK).withColumn("depth", F.lit("x")).withColumn("conv", F.lit(1))
    given = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).cast("int")
    donor = F.col("conv") - F.col("conv") % 20
    found = prefix_trie.trie(*prefix_trie.rebuilt(df, donor, given, 3, segment=segment), shard=shard, segment=segment)
    # Spark's remainder has the sign of the dividend.
    want = brute_trie(rows, donor=lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1))
    assert got_trie(found) == want


def test_trie_query_and_no_rows(spark, sf, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(queries.QUERIES["op13_prefix_trie"](spark, sf)) == brute_trie(rows)
    spark.createDataFrame([], TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect() == []
