"""Texts far longer than a block: same results piece by piece, and memory that does not follow their length."""

import resource
import subprocess
import sys

import numpy as np
import pytest

from assaylake.llm import blocks, convnet, language, minhash, mixing, rules, suffix_tree, token_counts


def long_bytes(n, seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([f"{'Ab' if k % 9 == 0 else 'w'}{k:x}{'é' if k % 7 == 0 else ''}{'.' if k % 5 == 0 else ''}" for k in range(3000)])
    text = " ".join(words[rng.integers(0, len(words), n // 5)])
    return np.frombuffer(text.encode()[:n], np.uint8)


def test_long_texts_give_the_results_of_whole_texts(monkeypatch):
    data = long_bytes(300_000)
    one = np.array([0, len(data)])
    net = convnet.start()
    model = language.LanguageModel(("a", "b"), np.random.default_rng(2).integers(0, 4, (1, 1 << 12), dtype=np.uint64), np.zeros(2), 0, 2)
    token = mixing._features(data[:5000], np.array([0, 5000]))[0]
    domains = mixing.DomainModel(("x", "y"), np.unique(token)[::3], np.random.default_rng(3).normal(size=(len(np.unique(token)[::3]), 2)) * 0.01, np.ones((4, 2)))

    def results():
        total, hits = language.counts(model, data, one)
        p, words = mixing.posteriors_of(domains, data, one)
        items, bounds = minhash.shingle_sets(data, one)
        return [convnet.logits(net, data, one), total, hits, p, words, items, bounds]

    monkeypatch.setattr(convnet, "GROUP", 1 << 20)
    whole = results()  # shorter than two blocks: in one go
    for module in (language, mixing, minhash):
        monkeypatch.setattr(module, "BLOCK_BYTES", 4096)
    for module in (mixing, minhash):
        monkeypatch.setattr(module, "white_cuts", lambda d: blocks.white_cuts(d, 4096))
    monkeypatch.setattr(convnet, "GROUP", 7)
    for a, b in zip(whole, results()):
        assert np.allclose(a, b, rtol=1e-4)


def test_running_counts_and_hashes_step_by_step():
    data = long_bytes(5000)
    starts, ends = blocks.word_spans(data, np.array([0, len(data)]))
    whole = blocks.SpanHash(data, seed=1)(starts, ends)
    lines = np.sort(np.random.default_rng(4).integers(0, len(data) + 1, 40))
    plain = np.concatenate([[0], np.cumsum(data > 100)])
    for step in (1, 7, 64, 5000, 1 << 20):
        assert (blocks.long_spans(data, starts, ends, step=step) == whole).all()
        assert (blocks.long_spans(data, lines[:-1], lines[1:], step=step) == blocks.SpanHash(data)(lines[:-1], lines[1:])).all()
        assert (blocks.before(data > 100, lines, step) == plain[lines]).all()
    assert blocks.before(np.zeros(0, bool), np.zeros(3, np.int64)).tolist() == [0, 0, 0]
    assert len(blocks.long_spans(np.zeros(0, np.uint8), np.zeros(2, np.int64), np.zeros(2, np.int64))) == 2


@pytest.mark.parametrize("tail", range(0, 140, 13))
def test_convnet_groups_end_anywhere(monkeypatch, tail):
    data, net = long_bytes(convnet.SEGMENT * convnet.STRIDE * 6 + tail), convnet.start()
    one = np.array([0, len(data)])
    whole = convnet.forward(net, *convnet.chunks(data, one))[0]
    monkeypatch.setattr(convnet, "GROUP", 2)
    assert convnet.logits(net, data, one) == pytest.approx(whole, rel=1e-4)


CHILD = """
import resource, sys
sys.path[:0] = {path!r}
import numpy as np, pyarrow as pa
from tests.llm.test_long_texts import long_bytes, {name}
data = long_bytes({size})
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{name}(data)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def run_convnet(data):
    convnet.logits(convnet.start(), data, np.array([0, len(data)]))


def run_language(data):
    model = language.LanguageModel(("a", "b"), np.ones((1, 1 << 19), np.uint64), np.zeros(2), 0, 2)
    language.counts(model, data, np.array([0, len(data)]))


def run_mixing(data):
    model = mixing.DomainModel(("x", "y"), np.arange(100, dtype=np.uint64), np.ones((100, 2)), np.ones((4, 2)))
    mixing.posteriors_of(model, data, np.array([0, len(data)]))


def run_minhash(data):
    items, bounds = minhash.shingle_sets(data, np.array([0, len(data)]))
    minhash.signatures(items, bounds, 60)


def run_rules(data):
    data = data.copy()
    data[200::400] = 0x0A
    rules._decide(rules.PRIOR, data, np.array([0, len(data)]), 20, 30, 0.5)


def run_suffix_tree(data):
    import pyarrow as pa

    for _, _, run in suffix_tree.runs(pa.array([data.tobytes()[:-8].decode(errors="ignore")]), 5):
        for _code, _there in run.grams(4):
            pass


def run_token_counts(data):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = data.tobytes().decode(errors="ignore")
    token_counts.Counter(path, token_counts.proven(path), token_counts.safe_classes(path, 0x2FF))(text)


@pytest.mark.parametrize("name", ["run_convnet", "run_language", "run_mixing", "run_minhash", "run_rules", "run_suffix_tree", "run_token_counts"])
def test_a_text_of_30_mb_stays_within_1_gb(name):
    code = CHILD.format(path=[p for p in sys.path if p] + ["."], name=name, size=30 << 20)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout.split()[-1]) < 1024, out.stdout
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0
