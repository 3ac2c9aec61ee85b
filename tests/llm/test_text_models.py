"""Language filters, line rules, byte network and suffix tree."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaylake.llm import convnet, language, queries, rules, suffix_tree, tokens
from assaylake.llm.frames import bucket_of
from tests.llm.cases import awkward, empty, labels_of

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_on_held_out_rows(spark):
    rows = queries.QUERIES["op1_language_bitmask"](spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and out and all(r["held_out"] == (held(r["doc_id"], 4) == 2) for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.95


def test_bit_slices_equal_single_filters(spark):
    """The AND of the slots is the set of languages whose own filter holds all slots of the gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language.fit(docs, per_language=50)
    data = np.frombuffer(b" hello world bonjour ", np.uint8)
    offsets = np.array([0, len(data)])
    codes, _ = language.grams(data, offsets)
    total, hits = language.counts(m, data, offsets)
    slots = language._slots(codes, m.bits, m.hashes)
    for k in range(len(m.languages)):
        own = (m.slots[0] >> np.uint64(k)) & np.uint64(1)
        assert hits[0, k] == sum(all(own[s[i]] for s in slots) for i in range(len(codes)))
    assert total[0] == len(codes) == len(data) - language.GRAM + 1


def test_language_cases(spark):
    df = awkward(spark, with_null_id=True)
    m = language.fit(df, min_count=1)
    got = language.predict(df, m).collect()
    assert len(got) == df.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (3, 4, 5, 12, 17))
    assert by[0]["lang_pred"] == by[1]["lang_pred"] and all(0 <= r["score"] <= 1 for r in got)
    assert language.predict(empty(spark), m).count() == 0
    assert {r["lang_pred"] for r in language.predict(df, language.fit(empty(spark))).collect()} == {"und"}


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules_against_brute_force(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for df in (awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = {r["doc_id"]: r for r in rules.apply(df, rules.PRIOR).collect()}
        for r in df.collect():
            want, g = brute_rules(r["text"]), got[r["doc_id"]]
            assert tuple(g[n] for n in names) == want
            assert g["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (g["base_failed"] and g["kept"])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    bounds = np.array([0, 1, 5, 5, 12])
    features = rng.standard_normal((12, 3))
    m = rules.LineModel(np.array([1.0, -1.0, 0.5]), np.array([[0.4, -0.3], [-0.6, 0.2]]))
    labels = rules.viterbi(m, features, bounds)
    score = features @ m.emission
    for a, b in zip(bounds[:-1], bounds[1:]):
        value = lambda path: sum(score[a + i] * y for i, y in enumerate(path)) + sum(m.transition[x, y] for x, y in zip(path, path[1:]))
        paths = [tuple((k >> i) & 1 for i in range(b - a)) for k in range(2 ** (b - a))]
        assert value(tuple(labels[a:b])) == pytest.approx(max(map(value, paths)))


def test_crf_gradient():
    rng = np.random.default_rng(2)
    bounds, features, gold = np.array([0, 3, 7]), rng.standard_normal((7, 2)), np.array([0, 1, 1, 0, 0, 1, 0])

    def value(w, t):
        total = 0.0
        for a, b in zip(bounds[:-1], bounds[1:]):
            s = features[a:b] @ w
            f = lambda p: sum(s[i] * y for i, y in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:]))
            paths = [tuple((k >> i) & 1 for i in range(b - a)) for k in range(2 ** (b - a))]
            total += f(tuple(gold[a:b])) - math.log(sum(math.exp(f(p)) for p in paths))
        return total / 7

    w, t = np.array([0.3, -0.2]), np.array([[0.1, 0.4], [-0.3, 0.2]])
    g, h = rules._gradient(rules.LineModel(w, t), features, bounds, gold)
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert g[k] == pytest.approx((value(w + step, t) - value(w - step, t)) / 2e-5, abs=1e-6)
    step = np.array([[0, 1e-5], [0, 0]])
    assert h[0, 1] == pytest.approx((value(w, t + step) - value(w, t - step)) / 2e-5, abs=1e-6)


def test_rules_stage_drops_cached_token_parts(spark):
    """A worker that has packed texts holds no token parts any more while it works on rules."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(1).selectExpr("id AS doc_id", "'some words to be encoded and then dropped again' AS text").coalesce(1)

    def encode(batches):
        for batch in batches:
            tokens.encoder(path)(batch.column(1).to_pylist())
            assert tokens.encoder(path)._cache
            yield batch

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(tokens.encoder(path)._cache)]})

    # Whichever worker runs the last stage: either it was used by the first two, or its cache is empty anyway.
    docs.mapInArrow(encode, docs.schema).count()
    rules.keep(docs, rules.PRIOR).count()
    assert [r["n"] for r in docs.mapInArrow(held, "n long").collect()] == [0]


def test_rules_cases(spark):
    df = awkward(spark, with_null_id=True)
    model = rules.fit(df, labels_of(df, spark))
    assert model is rules.PRIOR  # too few labels
    got = rules.apply(df, model).collect()
    assert len(got) == df.count() and rules.apply(empty(spark), model).count() == 0
    kept = {r["doc_id"] for r in got if r["kept"]}
    left = rules.keep(df, model)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == kept
    assert not kept & {3, 4, 5, 6, 12} and 0 in kept


def test_convnet_scores_whole_texts(spark):
    df = awkward(spark, with_null_id=True)
    net = convnet.start()
    got = {r["doc_id"]: r for r in convnet.score(df, net).collect()}
    for r in df.where("doc_id is not null").collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        n = max(-(-(len(raw) - convnet.WIDTH) // convnet.STRIDE), 0) + 1
        padded = np.concatenate([raw, np.zeros(convnet.WIDTH, np.uint8)])
        at = np.arange(n) * convnet.STRIDE
        z = net.vectors[padded[at[:, None] + np.arange(convnet.WIDTH)]].reshape(n, -1) @ net.filters + net.bias
        pooled = np.maximum(np.stack([z[i : i + convnet.SEGMENT].max(axis=0) for i in range(0, n, convnet.SEGMENT)]), 0)
        logit = pooled.mean(axis=0) @ net.mean_weight + pooled.max(axis=0) @ net.max_weight + net.offset[0]
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-4) and g["predicted"] == int(g["score"] >= 0.3)
    assert convnet.score(empty(spark), net).count() == 0
    assert {r["score"] for r in convnet.score(df, convnet.fit(df, labels_of(df, spark).where("false"))).collect()} == {0.5}


def test_convnet_gradient():
    rng = np.random.default_rng(4)
    net = convnet.start(filters=3, size=2)
    data = rng.integers(0, 256, 700).astype(np.uint8)
    window, bounds = convnet.chunks(data, np.array([0, 0, 300, 700]))
    gold, weight = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)

    def loss():
        logit = convnet.forward(net, window, bounds)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(logit)) - gold * logit))

    for p, g in zip(net.parameters(), convnet._gradients(net, window, bounds, gold, weight)):
        flat, k = p.reshape(-1), int(np.abs(g).argmax())
        old = flat[k]
        flat[k] = old + 1e-2
        up = loss()
        flat[k] = old - 1e-2
        down = loss()
        flat[k] = old
        assert np.reshape(g, -1)[k] == pytest.approx((up - down) / 2e-2, rel=0.15, abs=2e-4)


def test_convnet_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_byte_convnet"](spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels]) > 0.85


def brute_base(rows):
    token = {k: [w.lower() for w in (t or "").encode().split()] + [b"\n"] for k, t in rows}
    count = Counter(w for k, ws in token.items() if held(k, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    return {k: (len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for k, ws in token.items()}


def symbols(text):
    return [w.lower() for w in (text or "").encode().split()] + [b"\n"]


def brute_tree(rows, depth, least, divergence, discount=0.5):
    """Scores by a plain dictionary version: all grams counted, smoothed and pruned in floats."""
    base_of = Counter(w for k, t in rows if held(k, 10) for w in symbols(t))
    n, v = sum(base_of.values()), len(base_of)
    count, inside = Counter(), Counter()
    for k, t in rows:
        if held(k, 10):
            s = [b"\n", *symbols(t)]
            for i in range(1, len(s)):
                for d in range(1, min(i, depth) + 1):
                    count[tuple(s[i - d : i + 1])] += 1
                    inside[tuple(s[i - d : i])] += 1
    kept = {}
    for g, c in count.items():
        if c >= least:
            kept.setdefault(g[:-1], {})[g[-1]] = c

    def p(context, w):
        if not context:
            return (base_of[w] + 0.1) / (n + 0.1 * (v + 1))
        shorter, here = p(context[1:], w), kept.get(context)
        if here is None:
            return shorter
        m = inside[context]
        return (here[w] - discount if w in here else 0) / m + (m - sum(here.values()) + discount * len(here)) / m * shorter

    retained = {c for c, here in kept.items() if sum(x * math.log(x / inside[c] / p(c[1:], w)) for w, x in here.items()) >= divergence}
    retained |= {c[k:] for c in retained for k in range(1, len(c))}
    out = {}
    for k, t in rows:
        s, total = [b"\n", *symbols(t)], 0.0
        for i in range(1, len(s)):
            d = max((d for d in range(min(i, depth) + 1) if d == 0 or tuple(s[i - d : i]) in retained))
            total += math.log10(p(tuple(s[i - d : i]), s[i]))
        out[k] = total
    return out


def prose(spark, n, seed=6):
    """Texts that share passages, and a text of many pieces' length with repeated parts."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    passages = [" ".join(rng.choice(words, 12)) for _ in range(4)]
    text = lambda m: " ".join(str(rng.choice(words)) if rng.random() < 0.7 else str(rng.choice(passages)) for _ in range(m))
    return spark.createDataFrame([(k, text(30)) for k in range(n)] + [(n, None), (n + 1, "")], "doc_id bigint, text string")


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_suffix_tree_against_brute_force(spark, broadcast):
    train = bucket_of("doc_id", 10) != 0
    for df in (prose(spark, 80), awkward(spark).limit(13).unionByName(awkward(spark).where("doc_id > 13"))):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        corpus = suffix_tree.gather(df, train, block_bytes=5_000)
        tree = suffix_tree.fit(corpus, depth=3, least=3, divergence=4.0, broadcast=broadcast)
        got = {r["doc_id"]: r for r in suffix_tree.score(corpus, tree, broadcast=broadcast).collect()}
        want = brute_tree(rows, 3, 3, 4.0)
        assert tree.size > 0
        for k, b in brute_base(rows).items():
            g = got[k]
            assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == b[:3] and g["base_score"] == pytest.approx(b[3], rel=1e-9)
            assert g["score"] == pytest.approx(want[k], rel=1e-5)


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{k * k % 97}" for k in range(3000))
    column = pa.array(["short one", text, None], pa.string())
    whole = [(i, r.symbol[r.own], [c[r.own] for c, _ in r.grams(3)], r.place[r.own]) for i, _, r in suffix_tree.runs(column, 4)]
    monkeypatch.setattr(suffix_tree, "PIECE", 500)
    cut = [(i, r.symbol[r.own], [c[r.own] for c, _ in r.grams(3)], r.place[r.own]) for i, _, r in suffix_tree.runs(column, 4)]
    assert len(cut) > 10
    glue = lambda parts, at: np.concatenate([p[at] for p in parts])
    assert (glue(whole, 1) == glue(cut, 1)).all() and (glue(whole, 3) == glue(cut, 3)).all()
    for d in range(4):
        a, b = (np.concatenate([p[2][d] for p in parts]) for parts in (whole, cut))
        there = glue(whole, 3) >= d
        assert (a[there] == b[there]).all()


def test_suffix_tree_asks_only_for_what_may_be_there(spark):
    """A sieve holds all codes of its table and few others; texts ask for nothing else."""
    codes = np.random.default_rng(5).integers(0, 1 << 64, 2_000, dtype=np.uint64)
    for n in (0, 1, 1_000):
        words = suffix_tree.sieve(spark.createDataFrame([(int(c),) for c in codes[:n].view(np.int64)], "code bigint"), "code")
        found = suffix_tree.passes(words, codes)
        assert found[:n].all() and found[n:].mean() < 0.2
    corpus = suffix_tree.gather(prose(spark, 3), F.lit(True), block_bytes=5_000)
    tree = suffix_tree.fit(corpus, depth=2, least=3, divergence=4.0, broadcast=0)
    sieves = spark.sparkContext.broadcast([suffix_tree.sieve(tree.states.where(F.col("depth") == d), "code") for d in range(3)])
    asked = corpus.rows.select("text", "block").mapInArrow(suffix_tree._asked(2, sieves), "block bigint, depth int, code bigint")
    full = spark.sparkContext.broadcast([np.full(16, 2**64 - 1, np.uint64)] * 3)
    every = corpus.rows.select("text", "block").mapInArrow(suffix_tree._asked(2, full), "block bigint, depth int, code bigint")
    keys = ["depth", "code"]
    assert asked.count() < every.count() * 2 / 3
    assert asked.join(tree.states, keys, "left_semi").count() == every.join(tree.states, keys, "left_semi").count() > 0


def test_suffix_tree_cases(spark):
    train = bucket_of("doc_id", 10) != 0
    corpus = suffix_tree.gather(empty(spark), train)
    tree = suffix_tree.fit(corpus)
    assert tree.size == 0 and suffix_tree.score(corpus, tree).count() == 0
    corpus = suffix_tree.gather(prose(spark, 3).where("doc_id < 3"), F.lit(False))
    rows = suffix_tree.score(corpus, suffix_tree.fit(corpus)).collect()
    assert len(rows) == 3 and all(r["score"] == pytest.approx(r["base_score"]) for r in rows)
    df = awkward(spark, with_null_id=True)
    corpus = suffix_tree.gather(df, train)
    assert suffix_tree.score(corpus, suffix_tree.fit(corpus)).count() == df.count()


def test_suffix_tree_grows_with_the_input(spark):
    size = [suffix_tree.fit(suffix_tree.gather(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), F.lit(True))).size for sf in ("sf0.001", "sf0.01", "sf0.1")]
    assert size[1] > 4 * size[0] and size[2] > 6 * size[1]


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_suffix_tree_beats_the_base_on_held_out_text(spark, scale):
    rows = queries.QUERIES["op10_suffix_tree_scores"](spark, f"/root/testdata/{scale}").where("held_out").collect()
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
