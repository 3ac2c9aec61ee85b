"""Mixing, packing, quotation linking and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from assaylake.llm import mixing, packing, queries, quotes
from tests.llm.cases import awkward, empty

SF = "/root/testdata/sf0.001"


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return path, t


def brute_pieces(rows, t, capacity):
    out = []
    for k, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [0, len(ids)]
        if len(ids) > capacity:
            cut = sorted({0, *range(len(ids), 0, -capacity)})
        out += [(k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:]))]
    return sorted(out)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_round_trip(spark, capacity):
    path, t = tokenizer()
    odd = spark.createDataFrame([(900, "tab\tand blank \x1c x\r\n y"), (901, "it's  'll 12,5 <|endoftext|> x.y  "), (902, "été:…“a”—b\n\n\nc  \n d")], "doc_id bigint, text string")
    df = awkward(spark).select("doc_id", "text").union(odd).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000", "text"))
    got = packing.pack(packing.written(packing.tokenise(df, path, capacity=capacity), "t"), capacity=capacity, per_partition=100).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces([(r["doc_id"], r["text"]) for r in df.collect()], t, capacity)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    least = packing.lower_bound(np.bincount([r["length"] for r in got], minlength=capacity + 1), capacity)
    assert least <= len(places) <= least * 1.02 + 1


def test_bounds_and_best_fit():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(1, 13, rng.integers(1, 9))
        bins, offsets = packing.best_fit(lengths, 12)

        def fewest(left, room):
            if not left:
                return len(room)
            w, rest, best = left[0], left[1:], 99
            for i, r in enumerate(room):
                if r >= w:
                    best = min(best, fewest(rest, room[:i] + (r - w,) + room[i + 1 :]))
            return min(best, fewest(rest, (*room, 12 - w)))

        exact = fewest(tuple(sorted(lengths.tolist(), reverse=True)), ())
        assert packing.lower_bound(np.bincount(lengths, minlength=13), 12) <= exact <= bins.max() + 1
        assert np.bincount(bins, weights=lengths).max() <= 12
    assert packing.lower_bound(np.bincount([7] * 10, minlength=13), 12) == 10  # no two fit together


def test_certificates_and_gaps_choose_what_is_exchanged():
    sizes = lambda *x: np.array(x)
    full = sizes(10, 10, 6, 4)
    assert not packing.takes_part(full, packing.best_fit(full, 10)[0], 10).any()
    certified = sizes(9, 9, 3)  # three bins are the fewest; only the emptiest can still be saved
    assert packing.takes_part(certified, packing.best_fit(certified, 10)[0], 10).tolist() == [False, False, True]
    above = sizes(5, 4, 4, 3, 2, 2)  # two bins would do, best-fit decreasing takes three
    bins = packing.best_fit(above, 10)[0]
    assert bins.max() == 2 and packing.takes_part(above, bins, 10).sum() == (10 - np.bincount(bins, weights=above) > 0).sum() > 1


def test_exchange_saves_bins_until_it_stops_falling(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(None if k % 3 == 0 else 1, k, int(w)) for k, w in enumerate(rng.integers(1, 700, 3000))]
    df = packing.written(spark.createDataFrame(rows, "doc_id bigint, piece int, length bigint"), "t")
    bins = lambda t: t.select("sequence_id").distinct().count()
    kept = bins(packing.pack(df, per_partition=50))
    least = packing.bound(df, 2048)
    groups = [r["n"] for r in packing._round(df, "doc_id", 2048, 60, 0).selectExpr("shiftright(sequence_id, 24) AS part").groupBy("part").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert len(groups) == 60 and max(groups) < 100  # null and equal ids are spread
    monkeypatch.setattr(packing, "takes_part", lambda lengths, bins, capacity: np.zeros(bins.max() + 1, bool))
    assert kept < bins(packing.pack(df, per_partition=50)) and kept <= least * 1.01 + 1


def test_packing_cases(spark):
    path, _ = tokenizer()
    assert packing.pack(packing.written(packing.tokenise(empty(spark), path), "t")).count() == 0
    df = awkward(spark, with_null_id=True)
    rows = packing.pack(packing.written(packing.tokenise(df.union(df), path), "t")).collect()
    assert len({r["doc_id"] for r in rows}) == df.count() and [r["length"] for r in rows if r["doc_id"] == 3] == [1, 1]


def test_mixing_reaches_targets(spark):
    rows = queries.QUERIES["op4_soft_mixing"](spark, "/root/testdata/sf0.01").collect()
    n, p, r = (np.array([x[c] for x in rows]) for c in ("n_tokens", "posterior", "rate"))
    words = {x["doc_id"]: len((x["text"] or "").encode().split()) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {x["doc_id"]: x["n_tokens"] for x in rows} == words
    assert r.min() >= 0 and np.allclose(p.sum(axis=1), 1)
    assert np.allclose((r * n) @ p / n.sum(), [0.9, 0.05, 0.05], rtol=1e-3)


def in_process(monkeypatch, p, n):
    """``fit_rates`` on plain arrays."""
    monkeypatch.setattr(mixing, "_aggregate", lambda _table, size, values: values(p, n) if len(n) else np.zeros(size))
    return type("Rows", (), {"count": lambda self: len(n), "coalesce": lambda self, k: self})()


def model_of(k):
    return mixing.DomainModel(tuple("abcd"[:k]), np.zeros(0, np.uint64), np.zeros((0, k)), np.zeros((4, k)))


def slow_optimum(p, n, wanted, most):
    """The distance left after very many plain projected steps."""
    rate, bound = np.ones(len(n)), np.maximum(p @ (n @ p), 1e-300)
    for _ in range(30_000):
        further = np.clip(rate - p @ ((n * rate) @ p - wanted) / bound, 0, most)
        if np.abs(further - rate).max() < 1e-13:
            break
        rate = further
    return np.linalg.norm((n * rate) @ p - wanted)


def test_rates_of_1000_small_tables(monkeypatch):
    """One-sided, tiny, sharp and flat tables, capped or not: rates come back for all, and are the best there are."""
    rng = np.random.default_rng(11)
    for trial in range(1000):
        k, m = int(rng.integers(2, 5)), int(rng.integers(0, 30))
        p = rng.dirichlet(np.full(k, rng.choice([0.02, 0.1, 0.5, 2.0])), m) if rng.random() < 0.8 else np.eye(k)[rng.integers(0, k, m)]
        n = rng.integers(0, 500, m).astype(float)
        most = rng.choice([None, 1.0, 4.0])
        targets = dict(zip("abcd", rng.dirichlet(np.full(k, 0.5)))) if rng.random() < 0.7 else {"a": 1.0}
        steps, reached, wanted = mixing.fit_rates(in_process(monkeypatch, p, n), model_of(k), targets, total=rng.choice([None, n.sum()]), max_rate=most)
        if not n.sum():
            continue
        rate = mixing.rate_of(p, steps, most)
        assert rate.min() >= 0 and (most is None or rate.max() <= most) and np.allclose((n * rate) @ p, reached)
        if trial % 25 == 0:
            assert np.linalg.norm(reached - wanted) <= slow_optimum(p, n, wanted, np.inf if most is None else most) + 0.01 * np.linalg.norm(wanted)


def test_a_target_out_of_reach_is_missed_by_as_little_as_possible(monkeypatch):
    p, n = np.eye(2)[[0, 1, 1, 1, 1]], np.full(5, 100.0)
    steps, reached, wanted = mixing.fit_rates(in_process(monkeypatch, p, n), model_of(2), {"a": 0.6, "b": 0.4}, total=500.0, max_rate=1.0)
    assert np.allclose(reached, [100, 200]) and np.allclose(wanted, [300, 200])


def test_projected_gradient_is_the_least_squares_optimum(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    n = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(int(k), int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(n, p))], "doc_id bigint, n_tokens bigint, posterior array<double>")
    model = mixing.DomainModel(("a", "b", "c"), np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros((4, 3)))
    steps, reached, wanted = mixing.fit_rates(df, model, {"a": 0.7, "b": 0.3}, total=float(n.sum()), pull=0.05, max_rate=2.0, rounds=200, tolerance=1e-9)
    rate = np.array([r["rate"] for r in sorted(mixing.rates(df, steps, 3, max_rate=2.0).collect(), key=lambda r: r["doc_id"])])
    slope = p @ ((n * rate) @ p - wanted) / (p @ (n @ p)) + 0.05 * (rate - 1)
    inner = (rate > 1e-6) & (rate < 2 - 1e-6)
    assert np.abs(slope[inner]).max() < 1e-3 and (slope[rate <= 1e-6] > -1e-3).all() and (slope[rate >= 2 - 1e-6] < 1e-3).all()
    assert np.allclose(reached, (n * rate) @ p)


def test_telling_words_of_rare_languages_are_learned(spark):
    """Recall on held-out rows per language; the words of the smaller one are in 1 % of all documents."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(1600):
        lang, toxic = ("en", k % 10 == 0) if k % 8 else ("de", k % 16 == 0)
        words = [f"{lang}{w}" for w in rng.integers(0, 300, 40)]
        if toxic:
            words[7] = f"{lang}bad{rng.integers(0, 4)}"
        rows.append((k, " ".join(words), lang, "toxic" if toxic else "clean"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, domain string")
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 0]
    model = mixing.fit_domains(df, df.where(~df.doc_id.isin([r[0] for r in out])).select("doc_id", "domain"))
    got = {r["doc_id"]: model.domains[int(np.argmax(r["posterior"]))] for r in mixing.posteriors(df, model).collect()}
    for lang in ("en", "de"):
        assert np.mean([got[r[0]] == "toxic" for r in out if r[2] == lang and r[3] == "toxic"]) > 0.7
    assert np.mean([got[r[0]] == "clean" for r in out if r[3] == "clean"]) > 0.95


def posterior_table(spark, rows):
    return spark.createDataFrame([(k, n, [float(x) for x in p]) for k, (n, p) in enumerate(rows)], "doc_id bigint, n_tokens bigint, posterior array<double>")


@pytest.mark.parametrize("toxic", [120, 10, 1])  # of 1000 documents of equal length
def test_rate_of_an_unwanted_domain_does_not_depend_on_its_share(spark, toxic):
    rng = np.random.default_rng(5)
    p = np.stack([rng.uniform(0.9, 1, 1000), np.zeros(1000)], axis=1)
    p[:toxic] = [0.0, 1.0]
    p[:, 1] = 1 - p[:, 0]
    for rows in (p, np.round(p)):
        df = posterior_table(spark, [(100, x) for x in rows])
        model = mixing.DomainModel(("clean", "toxic"), np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros((4, 2)))
        multipliers, _, _ = mixing.fit_rates(df, model, {"clean": 1.0}, max_rate=1.0)
        rate = mixing.rate_of(rows, multipliers, 1.0)
        assert rate[:toxic].max() < 1e-3 and (rate[toxic:] >= 0.5).mean() > 0.5
    assert rate[toxic:].min() > 0.999


@pytest.mark.parametrize("supply", [(760, 140, 100), (985, 10, 5)])
def test_scarce_domains_reach_their_targets(spark, monkeypatch, supply):
    p = np.eye(3)[np.repeat([0, 1, 2], supply)]
    docs = posterior_table(spark, [(100, x) for x in p])
    model = mixing.DomainModel(("a", "b", "c"), np.zeros(0, np.uint64), np.zeros((0, 3)), np.zeros((4, 3)))
    monkeypatch.setattr(mixing, "fit_domains", lambda *_a, **_k: model)
    monkeypatch.setattr(mixing, "posteriors", lambda *_a, **_k: docs)
    targets = {"a": 0.9, "b": 0.05, "c": 0.05}
    out, totals = mixing.mix_with_totals(docs, docs, targets, total_share=1.0)
    rows = out.collect()
    got = np.array([r["rate"] * r["n_tokens"] for r in rows]) @ np.array([r["posterior"] for r in rows])
    assert np.allclose(got, [90_000, 5_000, 5_000], rtol=1e-3)
    assert np.allclose([t.reached for t in totals], got) and np.allclose([t.wanted for t in totals], [90_000, 5_000, 5_000])
    if supply[2] == 5:
        with pytest.warns(UserWarning, match="c 2000 of 5000"):
            mixing.mix(docs, docs, targets, total_share=1.0, max_rate=4.0)


def test_mixing_cases(spark):
    df = awkward(spark, with_null_id=True)
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    got = mixing.mix(df, none, {"a": 1.0}).collect()
    assert len(got) == df.count() and {r["rate"] for r in got} == {1.0}
    some = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(14)], "doc_id bigint, domain string")
    got = {r["doc_id"]: r for r in mixing.mix(df, some, {"a": 0.5, "b": 0.5}).collect()}
    assert len(got) == df.count() and got[0]["rate"] == pytest.approx(got[1]["rate"]) and got[3]["n_tokens"] == 0
    assert mixing.mix(empty(spark), some, {"a": 1.0}).count() == 0


def test_quotes_nested_partial_and_out_of_order(spark):
    rows = [
        (1, 0, "ann", "Shall we meet on Monday at nine?\nThe room is free all day long."),
        (1, 1, "bob", "> Shall we meet  on Monday at nine?\n> The room is free all day long.\n\nYes, Monday is good for me too."),
        (1, 2, "cyd", ">The room is free all day long.\nI can not come before ten."),
        (1, 3, "ann", "> > Shall we meet on Monday at nine?\n> > The room is free all day long.\n> Yes, Monday is good for me too.\nDone."),
        (1, 4, "dan", None),
        (1, 5, "eve", "> nobody ever said these words here\nHm."),
        (2, 0, "fay", "The room is free all day long."),
        (2, 1, "fay", "The room is free all day long."),
        (2, 2, "gus", "> The room is free all day long.\nGood."),
        (None, 0, "x", "> a"), (3, None, "y", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r["conv"], r["turn"]): r for r in quotes.linked_messages(df).collect()}
    assert len(got) == len(rows)
    assert [got[1, k]["parent"] for k in range(6)] == [None, 0, 0, 1, None, None]
    assert [got[1, k]["depth"] for k in range(6)] == [0, 1, 1, 2, 0, 0] and got[1, 3]["thread"] == 0
    assert got[1, 3]["own"] == "Done." and got[1, 3]["n_passages"] == 2 and got[1, 3]["n_linked"] == 2 and got[1, 4]["own"] == ""
    assert got[2, 2]["parent"] == 0 and got[None, 0]["parent"] is None
    talks = {(r["conv"], r["thread"]): [m["content"] for m in r["messages"]] for r in quotes.conversations(quotes.linked_messages(df)).collect()}
    assert talks[1, 0][2:] == ["I can not come before ten.", "Done."] and len(talks[1, 0]) == 4
    assert quotes.linked_messages(df.where("false")).count() == 0


def test_quotes_oracle_and_plan(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    df = queries.QUERIES["op7_quotation_linking"](spark, SF)
    want = con.execute(queries.ORACLES["op7_quotation_linking"])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(*names).collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = {}
    for name, stage in corpus_pipeline.STAGES:
        new = packing.written(stage(spark, docs, SF), name)
        total[name] = new.count()
        if name != "best_fit_packing":
            assert new.columns == docs.columns
            before = {r["doc_id"]: r for r in docs.collect()}
            assert all(r["doc_id"] in before for r in new.collect())
            docs = new
    assert total["suffix_repeats"] == total["near_duplicates"] < total["quality_rules"]
    assert corpus_pipeline.run(spark, SF).count() == total["best_fit_packing"]


def test_pipeline_on_awkward_rows(spark):
    df = awkward(spark, with_null_id=True).select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (df, empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = packing.written(stage(spark, rows, SF), "stage")
            assert rows.columns == df.columns
    kept = corpus_pipeline.near_duplicates(spark, df, SF)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.collect()} - {1, 2, 7}
