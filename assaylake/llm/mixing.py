"""Mixing documents to target weights per domain, with soft membership.

1. A classifier fitted on a bounded sample of labelled documents gives every
   document posterior probabilities of the domains (multinomial logistic
   regression on the presence of tokens tied to a domain and three shape features).
2. Nonnegative rates per document are fitted so that expected domain totals
   sum(rate * tokens * posterior) match the targets: least squares by
   projected gradient from rate 1 on, each rate's step bounded by its own curvature. A gradient
   is a few numbers per domain, so a step is one Spark aggregate, and a document's
   rate is found again from the list of steps: no per-document state is kept.

Special cases: a null or empty text has no tokens; its rate follows its
posterior like any other but moves no total. Without labels of at least two
domains all rates are 1. Equal documents get equal rates; rows with a null id
take part. Other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.blocks import BLOCK_BYTES, WHITE, SpanHash, blocks, fold_case, give_back, sums, white_cuts
from assaylake.llm.frames import SAMPLE_BYTES, labelled_sample, written

_KIND = np.full(256, 1, np.int8)  # letters, digits and all bytes above ASCII
_KIND[:128] = [1 if chr(b).isalnum() else 2 for b in range(128)]  # punctuation runs are tokens too
_KIND[WHITE] = 0
ROWS_A_TASK = 100_000
TARGET_TOLERANCE = 1e-3  # of a domain's own target; a larger miss is a warning of ``mix``


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray  # (tokens, domains)
    shape_weights: np.ndarray  # (shapes, domains)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their documents, shape features per document, and words per document."""
    token, doc, raw = _tokens(data, offsets)
    return token, doc, _shape(raw), raw[:, 4].astype(np.int64)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their documents, and per document: bytes, punctuation bytes, capitals, tokens that repeat the one before, words, tokens."""
    folded = fold_case(data)
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    token = SpanHash(folded, seed=13)(starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    again = np.zeros(len(token), bool)
    again[1:] = (token[1:] == token[:-1]) & (doc[1:] == doc[:-1])
    n = len(offsets) - 1
    solid = kind > 0
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] = solid[first]
    raw = [np.diff(offsets), sums(kind == 2, offsets), sums((data >= 0x41) & (data <= 0x5A), offsets), np.bincount(doc, weights=again, minlength=n), sums(begin, offsets), np.bincount(doc, minlength=n)]
    return token, doc, np.stack(raw, axis=1).astype(np.float64)


def _shape(raw: np.ndarray) -> np.ndarray:
    size, tokens = np.maximum(raw[:, 0], 1), np.maximum(raw[:, 5], 1)
    return np.stack([np.ones(len(raw)), raw[:, 1] / size * 10, raw[:, 2] / size * 5, raw[:, 3] / tokens * 5], axis=1)


def _hits(tokens: np.ndarray, token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, index of known token) pairs."""
    if len(tokens) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(tokens, token), len(tokens) - 1)
    known = tokens[at] == token
    pair = np.unique(doc[known].astype(np.int64) * len(tokens) + at[known])
    return pair // len(tokens), pair % len(tokens)


def _long_text(tokens: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens and counts of one long text, piece by piece."""
    known, raw, last = np.zeros(0, np.int64), np.zeros((1, 6)), None
    for a, b in white_cuts(data):
        token, doc, more = _tokens(data[a:b], np.array([0, b - a]))
        known = np.union1d(known, _hits(tokens, token, doc)[1])
        raw += more
        if len(token):
            raw[0, 3] += last is not None and token[0] == last
            last = token[-1]
    return np.zeros(len(known), np.int64), known, raw


def posteriors_of(model: DomainModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(offsets) == 2 and len(data) > 2 * BLOCK_BYTES:
        d, t, raw = _long_text(model.tokens, data)
    else:
        token, doc, raw = _tokens(data, offsets)
        d, t = _hits(model.tokens, token, doc)
    words = raw[:, 4].astype(np.int64)
    logit = _shape(raw) @ model.shape_weights
    for k in range(len(model.domains)):
        logit[:, k] += np.bincount(d, weights=model.weights[t, k], minlength=len(offsets) - 1)
    p = np.exp(logit - logit.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), words


def telling(counts: np.ndarray, sizes: np.ndarray, least: int, evidence: float) -> np.ndarray:
    """Which tokens are tied to a domain; ``counts[token, domain]`` documents of ``sizes[domain]`` hold them.

    A token must be over-represented in a domain, in at least ``least`` of its
    documents, with a log-likelihood ratio (two by two: token, domain) of ``evidence`` or more.
    """
    n, held = sizes.sum(), counts.sum(axis=1, keepdims=True)
    cells = np.stack([counts, held - counts, sizes - counts, n - held - sizes + counts]).astype(np.float64)
    by_chance = np.stack([held * sizes, held * (n - sizes), (n - held) * sizes, (n - held) * (n - sizes)]) / n
    ratio = 2 * np.where(cells > 0, cells * np.log(np.maximum(cells, 1) / np.maximum(by_chance, 1e-12)), 0).sum(axis=0)
    return ((counts >= least) & (cells[0] > by_chance[0]) & (ratio >= evidence)).any(axis=1)


def fit_domains(docs: DataFrame, labels: DataFrame, *, domain: str = "domain", max_rows: int = 5000, max_bytes: int = SAMPLE_BYTES, least: int = 5, evidence: float = 15.0, steps: int = 60, ridge: float = 0.01) -> DomainModel | None:
    """Fit on at most ``max_rows`` labelled documents; ``labels`` has (doc_id, domain).

    Only tokens tied to a domain take part (see ``telling``), however rare they
    are in the sample; all others would let the fit learn documents by heart.
    """
    rows = labelled_sample(docs, labels, [domain], max_rows, max_bytes)
    names = tuple(sorted({str(r[domain]) for r in rows}))
    if len(names) < 2:
        return None
    gold = np.array([names.index(str(r[domain])) for r in rows])
    tokens, docs_of, shapes = [], [], []
    for i, _, data, offsets in blocks(pa.array([r["text"] for r in rows], pa.string())):
        token, doc, shape, _ = _features(data, offsets)
        tokens.append(token)
        docs_of.append(doc + i)
        shapes.append(shape)
    token, doc, shape = np.concatenate(tokens), np.concatenate(docs_of), np.concatenate(shapes)
    every, index = np.unique(token, return_inverse=True)
    pair = np.unique(doc.astype(np.int64) * len(every) + index)
    k, n = len(names), len(rows)
    counts = np.bincount(pair % len(every) * k + gold[pair // len(every)], minlength=len(every) * k).reshape(-1, k)
    chosen = every[telling(counts, np.bincount(gold, minlength=k), least, evidence)]
    d, t = _hits(chosen, token, doc)
    target = np.eye(k)[gold]
    weight = (n / (k * np.bincount(gold, minlength=k)))[gold] ** 0.5
    weights, shape_weights = np.zeros((len(chosen), k)), np.zeros((shape.shape[1], k))
    squares = [np.full_like(weights, 1e-8), np.full_like(shape_weights, 1e-8)]
    for _ in range(steps):
        logit = shape @ shape_weights
        for c in range(k):
            logit[:, c] += np.bincount(d, weights=weights[t, c], minlength=n)
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None] / n
        grad = np.stack([np.bincount(t, weights=error[d, c], minlength=len(chosen)) for c in range(k)], axis=1) + ridge * weights / max(len(chosen), 1) ** 0.5
        for w, g, q in ((weights, grad, squares[0]), (shape_weights, shape.T @ error, squares[1])):
            q += g * g
            w -= 0.15 * g / np.sqrt(q)
    return DomainModel(names, chosen, weights, shape_weights)


def posteriors(docs: DataFrame, model: DomainModel, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, posterior) of every document; words count as tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = docs.schema[key].dataType.simpleString()
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(1)):
                p, words = posteriors_of(shared.value, data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k), pa.int32()), pa.array(p.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(words), lists], names=[key, "n_tokens", "posterior"])

    return docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, n_tokens bigint, posterior array<double>")


@dataclass(frozen=True)
class RateSteps:
    """The way from rate 1 to the fitted rates: the domains' misses at every step, and the momentum behind it.

    A step takes (posterior . miss) / (posterior . supply) off a rate. That is the
    gradient over a bound of its own curvature, so a document of a rare domain
    moves as fast as one of a common domain.
    """

    misses: np.ndarray  # (steps, domains)
    momentum: np.ndarray  # (steps,)
    supply: np.ndarray  # (domains,)
    pull: float = 0.0

    def follow(self, p: np.ndarray, max_rate: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rates of rows with posteriors ``p``: the point where the next gradient is taken, the last rates, and those before."""
        ahead, rate, earlier = (np.ones(len(p)) for _ in range(3))
        bound = np.maximum(p @ self.supply, 1e-300)
        for miss, momentum in zip(self.misses, self.momentum):
            earlier = rate
            rate = np.clip(ahead - (p @ miss / bound + self.pull * (ahead - 1)) / (1 + self.pull), 0, max_rate)
            ahead = rate + momentum * (rate - earlier)
        return ahead, rate, earlier


def rate_of(p: np.ndarray, steps: RateSteps, max_rate: float | None) -> np.ndarray:
    """Rates of rows with posteriors ``p``."""
    return steps.follow(p, max_rate)[1]


def _aggregate(table: DataFrame, size: int, values) -> np.ndarray:
    """Sum over all rows of ``values(posteriors, tokens)``, ``size`` numbers; one partial sum per task and number, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            n = batch.column(0).to_numpy().astype(np.float64)
            if len(n):
                total += values(batch.column(1).flatten().to_numpy().reshape(len(n), -1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size)
    for r in table.select("n_tokens", "posterior").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def fit_rates(table: DataFrame, model: DomainModel, targets: dict[str, float], *, total: float | None = None, pull: float = 0.0, max_rate: float | None = None, rounds: int = 200, tolerance: float = 1e-4) -> tuple[RateSteps, np.ndarray, np.ndarray]:
    """The steps to the fitted rates, and the expected and wanted tokens per domain.

    ``targets`` are shares per domain (missing: 0) of ``total`` tokens; ``total``
    None means the expected tokens of the domains with a target. What is made
    small is sum over domains (expected - wanted)^2 + ``pull`` * sum over documents
    tokens * (posterior . supply) * (rate - 1)^2. Steps carry momentum, which starts
    anew when the objective rises.

    The work ends when all targets are met to ``tolerance`` of their domain's
    wanted and given tokens, or when a step without momentum moves no domain by
    more (then the targets are out of reach and missed by as little as
    possible), or after ``rounds``. The best rates met are returned in any case;
    the expected tokens show what they reach. Every round reads the table once,
    in few large partitions (about ``ROWS_A_TASK`` rows).
    """
    k = len(model.domains)
    table = table.coalesce(max(1, -(-table.count() // ROWS_A_TASK)))
    supply = _aggregate(table, k, lambda p, n: n @ p)
    share = np.array([targets.get(name, 0.0) for name in model.domains])
    none = RateSteps(np.zeros((0, k)), np.zeros(0), supply, pull)
    if share.sum() <= 0 or supply.sum() <= 0:
        return none, supply, supply
    share = share / share.sum()
    wanted = share * (supply[share > 0].sum() if total is None else total)
    allowed = tolerance * np.maximum(np.maximum(supply, wanted), 1e-12 * supply.sum())

    misses, momentum = [], []
    ahead, reached, best, best_value, age = supply, supply, (none, supply), np.inf, 1.0
    value_before = float(((supply - wanted) ** 2).sum())
    for _ in range(rounds):
        if not pull and (np.abs(reached - wanted) <= allowed).all():
            break
        misses.append(ahead - wanted)
        following = (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum.append((age - 1) / following)
        steps = RateSteps(np.array(misses), np.array(momentum), supply, pull)

        def sums_of(p: np.ndarray, n: np.ndarray, steps: RateSteps = steps) -> np.ndarray:
            here, rate, earlier = steps.follow(p, max_rate)
            return np.concatenate([(n * here) @ p, (n * rate) @ p, (n * np.abs(rate - earlier)) @ p, [(n * (p @ supply)) @ (rate - 1) ** 2]])

        found = _aggregate(table, 3 * k + 1, sums_of)
        ahead, reached, moved = found[:k], found[k : 2 * k], found[2 * k : 3 * k]
        value = float(((reached - wanted) ** 2).sum()) + pull * float(found[-1])
        if value < best_value:
            best, best_value = (steps, reached), value
        plain = len(momentum) == 1 or momentum[-2] == 0  # the last step began where the rates were
        still = (moved <= allowed).all()
        if still and plain:
            break
        if still or value > value_before:
            age, momentum[-1], ahead = 1.0, 0.0, reached
        else:
            age = following
        value_before = value
    return (*best, wanted) if best_value < np.inf else (none, reached, wanted)


def rates(table: DataFrame, steps: RateSteps, domains: int, *, key: str = "doc_id", max_rate: float | None = None) -> DataFrame:
    """Adds ``rate`` to the posterior table."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", rate double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(2).flatten().to_numpy().reshape(-1, domains)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate_of(p, steps, max_rate))], names=[*batch.schema.names, "rate"])

    return table.mapInArrow(run, schema)


@dataclass(frozen=True)
class DomainTotal:
    domain: str
    reached: float  # expected tokens with the fitted rates
    wanted: float

    @property
    def missed(self) -> float:
        """Distance from the target relative to it; to one token where the target is none."""
        return abs(self.reached - self.wanted) / max(self.wanted, 1.0)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, domain: str = "domain", total: float | None = None, total_share: float | None = None, pull: float = 0.0, max_rate: float | None = None) -> DataFrame:
    """The documents of ``mix_with_totals``; a warning names targets that are missed."""
    out, totals = mix_with_totals(docs, labels, targets, domain=domain, total=total, total_share=total_share, pull=pull, max_rate=max_rate)
    missed = [t for t in totals if t.missed > TARGET_TOLERANCE]
    if missed:
        warnings.warn("targets not reached: " + ", ".join(f"{t.domain} {t.reached:.6g} of {t.wanted:.6g} tokens" for t in missed), stacklevel=2)
    return out


def mix_with_totals(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, domain: str = "domain", total: float | None = None, total_share: float | None = None, pull: float = 0.0, max_rate: float | None = None) -> tuple[DataFrame, list[DomainTotal]]:
    """(doc_id, n_tokens, posterior, domain, rate, copies) for every document, and reached and wanted tokens per domain.

    ``total_share``: target total as a share of all tokens. ``domain`` is the
    likeliest one. ``copies`` is the rate rounded up or down by a hash of the id,
    so that its expectation is the rate. Without a model there are no totals.
    """
    model = fit_domains(docs, labels, domain=domain)
    if model is None:
        plain = docs.select("doc_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint").alias("n_tokens"))
        return plain.select("doc_id", "n_tokens", F.array(F.lit(1.0)).alias("posterior"), F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies")), []
    table = written(posteriors(docs, model), "posteriors")
    if total_share is not None:
        total = total_share * float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    steps, reached, wanted = fit_rates(table, model, targets, total=total, pull=pull, max_rate=max_rate)
    out = rates(table, steps, len(model.domains), max_rate=max_rate)
    names = F.array(*[F.lit(n) for n in model.domains])
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(29)), F.lit(1_000_000)) / F.lit(1e6)
    result = out.select(
        "doc_id", "n_tokens", "posterior", F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1).alias("domain"), "rate", F.floor(F.col("rate") + chance).cast("int").alias("copies")
    )
    return result, [DomainTotal(n, float(r), float(w)) for n, r, w in zip(model.domains, reached, wanted)]


def realise(docs: DataFrame, model: DomainModel, steps: RateSteps, *, text: str = "text", max_rate: float | None = 1.0, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose rate is at least ``least``, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model, steps))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, x = shared.value
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(at)):
                rate = rate_of(posteriors_of(m, data, offsets)[0], x, max_rate)
                yield batch.slice(i, j - i).filter(pa.array(rate >= least))

    return docs.mapInArrow(run, docs.schema)
