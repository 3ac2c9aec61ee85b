"""Fingerprints, near-duplicates, repeated strings."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import minhash, repeats, spotsigs
from assaylake.llm.graph import components
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    """Smallest id reachable; rows of one id are one document."""
    sets = [(k, shingles(t)) for k, t in rows]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in parent}


def family(rng, n, edits, length=150):
    """A base text and copies with ``edits`` replaced words: near to the base, farther from each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(length)] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("block", [8, 1024])
def test_near_duplicates_against_brute_force(spark, block):
    rng = random.Random(block)
    texts = [t for n, e in ((30, 2), (30, 4), (25, 6), (3, 1)) for t in family(rng, n, e)]
    rng.shuffle(texts)
    texts += [texts[0]] * 5 + ["", None, "a b c", "A b  c"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(df, percent=85, block=block).collect()
    want = brute_components(rows, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingles(texts[r["doc_id"]])) for r in got)


def test_near_duplicates_cases(spark):
    df = awkward(spark, with_null_id=True)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 0 and got[7]["component_id"] == 6
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == got[5]["n_shingles"] == 0 and got[4]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash.near_duplicates(empty(spark)).count() == 0
    twice = df.where("doc_id < 3").union(df.where("doc_id < 3"))
    assert sorted(r["component_id"] for r in minhash.near_duplicates(twice).collect()) == [0] * 6


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    h = rng.integers(0, 1 << 64, 1200, np.uint64)
    a, b = np.sort(h[:1000]), np.sort(h[200:])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 600)
    assert np.mean(s[0] == s[1]) == pytest.approx(800 / 1200, abs=0.06)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 200), (200, 150), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(edges.where("false")).count() == 0


def brute_repeats(rows, length):
    seen, out = {}, {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen[raw[p : p + length]] = k
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def check_repeats(df, length):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, length=length).collect()}
    assert got == brute_repeats([(r["doc_id"], r["text"]) for r in df.collect()], length)


def test_repeats_against_brute_force(spark):
    check_repeats(awkward(spark), 100)
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(90, 260))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randrange(0, 60) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ü") for _ in range(rng.randrange(150))) for _ in range(rng.randrange(1, 5))]
        texts.append("".join(parts))
    texts += ["ab" * 200, "q" * 99, "q" * 100, "q" * 101, texts[0], texts[0][:150]]
    check_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 100)


def test_repeats_long_texts_go_by_segments(spark, monkeypatch):
    rng = random.Random(5)
    data = "".join(rng.choice("abcdefgh") for _ in range(3000))
    raw = np.frombuffer((data + data[500:1500]).encode(), np.uint8)
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    parts = repeats.sampled(raw, np.array([0, len(raw)]), 100)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(parts[2], parts[3])])
    assert sorted(covered) == list(range(len(raw) - 99))


def test_repeats_cases(spark):
    df = awkward(spark, with_null_id=True)
    got = repeats.remove_repeats(df, with_kept=True, carry=("lang", "source")).collect()
    assert len(got) == df.count() and {r["n_removed"] for r in got if r["doc_id"] is None} == {0}
    assert repeats.remove_repeats(empty(spark)).count() == 0
    twice = df.where("doc_id = 0").union(df.where("doc_id = 0"))
    assert [r["n_removed"] for r in repeats.remove_repeats(twice).collect()] == [0, 0]


def brute_signatures(text):
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if w]
    anchors, runs, run = set(spotsigs.ANCHOR_SET), [], []
    for w in words:
        if w in anchors:
            run.append(w)
        else:
            runs.append((run, w))
            run = []
    runs.append((run, ""))
    after = [c for _, c in runs[1:]] + [""]
    spots = {(r[-1], c, n) for (r, c), n in zip(runs, after) if r}
    if spots:
        return spots
    return {(c, n) for (_, c), n in zip(runs, after)} if words else ({text} if text else set())


def test_fingerprints_against_brute_force(spark):
    for df in (awkward(spark).select("doc_id", "text"), spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted((r["doc_id"], r["text"] or "") for r in df.collect())
        got = {r["doc_id"]: r for r in spotsigs.edited_and_next(df).collect()}
        prints = {}
        for k, (i, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            n = len(t) // 4
            edited = t[: len(t) - n] + after[:n]
            g = got[i]
            assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            own, edit, other = map(brute_signatures, (t, edited, after))
            jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            assert g["near_edited"] == pytest.approx(jaccard(own, edit)) and g["near_next"] == pytest.approx(jaccard(own, other))
            assert len(g["fingerprint"]) == 16 * len(own) and prints.setdefault(t, g["fingerprint"]) == g["fingerprint"]


def test_fingerprint_cases(spark):
    assert spotsigs.edited_and_next(empty(spark)).count() == 0
    df = awkward(spark, with_null_id=True)
    assert spotsigs.edited_and_next(df).count() == df.count()
    one = spotsigs.edited_and_next(df.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0


@pytest.mark.parametrize("cuts", [2, 16, 256])
def test_next_document_in_many_ranges(spark, cuts):
    """A third of the rows under one id, a third without an id, copies among both, ids far apart."""
    rng = random.Random(cuts)
    ids = [7] * 40 + [None] * 40 + [rng.choice((1, 10**6, 10**15)) * rng.randrange(-50, 50) for _ in range(38)] + [2**63 - 1] * 2
    df = spark.createDataFrame([(k, f"text {rng.randrange(90)}") for k in ids], "doc_id bigint, text string").repartition(5)
    got = spotsigs.with_next(df, rows_per_range=3, cuts=cuts).collect()
    order = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) h").collect()}
    rows = sorted(((k is None, k or 0, order[t], t) for k, t in ((r["doc_id"], r["text"]) for r in df.collect())))
    want = [(None if null else k, t, rows[(i + 1) % len(rows)][3]) for i, (null, k, _, t) in enumerate(rows)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got), key=key) == sorted(want, key=key)
    buckets = spotsigs._ranged(df, F.xxhash64("text"), 3, cuts).groupBy("bucket").count()
    if cuts**2 * 3 >= 120:  # as many ranges as the rows ask for
        assert buckets.agg(F.max("count")).first()[0] <= 12


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for n, e in ((6, 2), (6, 5), (4, 12)):
        base = [rng.choice(["the", "of", "and"]) if k % 3 == 0 else f"w{rng.randrange(10**6)}" for k in range(150)]
        texts.append(" ".join(base))
        for _ in range(n):
            copy = list(base)
            for _ in range(e):
                copy[rng.randrange(150)] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts + texts[:2])), "doc_id bigint, text string")
    got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.similar_pairs(df, threshold=0.7).collect()}
    sets = [brute_signatures(t) for t in texts]
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.7})


def test_fingerprints_stay_in_the_jvm(spark):
    plan = spotsigs.edited_and_next(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
