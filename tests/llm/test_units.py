"""Pieces without Spark: hashes, words, signatures, tokens, packing, machines and models against plain statements of them."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quillspark.llm import embdedup, hmm_lm, langid, minhash, secrets, topk, weaklabel
from quillspark.llm.common import Words, hash_strings
from quillspark.llm.packing import plan_rows
from quillspark.llm.spfhp import pack_histogram
from quillspark.llm.tokens import word_bpe

ODD = ["", "   ", "a", "A b\tc\nD  e", "x" * 300, "é É ß", "a\x1cb", "\x85 z", "日本 語", "one two three four five six"]


def test_words_match_split():
    w = Words(pa.array(ODD))
    for k, text in enumerate(ODD):
        plain = [x.decode() for x in text.encode().lower().split()]
        assert [w.words[int(c)].as_py() for c in w.codes[w.offsets[k] : w.offsets[k + 1]]] == plain


def test_hash_depends_on_content_only():
    a = hash_strings(pa.array(["", "ab", "ba", "ab", "abc"]))
    b = hash_strings(pa.array(["zzz", "ab"]).slice(1))
    assert a[1] == a[3] == b[0] and len(set(a.tolist())) == 4


def _sets(texts):
    out = []
    for t in texts:
        w = t.encode().lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def test_shingle_set_sizes():
    texts = [*ODD, "a b c d e " * 50, "a b c d"]
    _, offsets = minhash.shingle_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(s) for s in _sets(texts)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (300, 150, 30):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 600 - shared, dtype=np.uint64)
            a, b = np.unique(pool[:300]), np.unique(pool[300 - shared : 600 - shared])
            s = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    one = minhash.superminhash(np.array([5], np.uint64), np.array([0, 1, 1]))
    assert sorted(np.floor(one[0])) == list(range(minhash.SLOTS)) and np.isinf(one[1]).all()


def test_ids_equal_the_library():
    bpe = word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    alphabet = "ab'sStTdDmMlLvVrReE0 9.,!_é\t\nßÿ×÷À́​日"
    texts = [*ODD, "don't we'll 'tis", "<|endoftext|> x", "İ ΣΑΣ ½ x²", *["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]]
    ids, offsets = bpe.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == bpe.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("counts", [{}, {2048: 3}, {1: 5000}, {1000: 7, 1048: 3, 5: 100}, dict(enumerate(np.random.default_rng(0).integers(0, 40, 2049).tolist()[1:], 1))])
def test_histogram_packing_places_all(counts):
    placed, packs = Counter(), 0
    for many, pattern in pack_histogram(counts, 2048):
        assert sum(length * times for length, times in pattern) <= 2048
        packs += many
        for length, times in pattern:
            placed[length] += many * times
    assert placed == Counter({k: v for k, v in counts.items() if v})
    if counts:
        assert packs <= 2 * sum(k * v for k, v in counts.items()) / 2048 + 1
    rows = plan_rows(counts, 2048)
    assert all(lo < hi and hi <= counts[length] for length, lo, hi, *_ in rows)


def test_forward_recursion_sums_all_paths():
    rng = np.random.default_rng(2)
    k, c = 3, 4
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm_lm.Model(norm(rng.random(k)), norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))), np.zeros(0, np.uint64))
    seq = rng.integers(0, c, 5)
    total = 0.0
    for path in np.ndindex(*[k] * 5):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for t in range(1, 5):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], seq[t]]
        total += p
    got = hmm_lm.log10_likelihood(model, np.concatenate([seq, seq[:2]]), np.array([0, 5, 7]))
    assert math.isclose(got[0], math.log10(total), rel_tol=1e-12)
    counts = hmm_lm.expected_counts(model, seq, np.array([0, 5]))
    assert math.isclose(counts[:k].sum(), 1) and math.isclose(counts[2 * k : 2 * k + k * k].sum(), 4) and math.isclose(counts[2 * k + k * k :].sum(), 5)


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(4)
    hidden = np.repeat(rng.integers(0, 2, 80), 40)
    seq = np.where(rng.random(3200) < 0.9, hidden * 3, 0) + rng.integers(0, 3, 3200)
    ends = np.arange(0, 3201, 400)
    model = hmm_lm.initial(np.bincount(seq, minlength=6).astype(float), np.zeros(0, np.uint64), 2)
    before = hmm_lm.log10_likelihood(model, seq, ends).sum()
    for _ in range(10):
        model = model.updated(hmm_lm.expected_counts(model, seq, ends))
    assert hmm_lm.log10_likelihood(model, seq, ends).sum() > before + 10


def test_baum_welch_counts_whole_documents():
    rng = np.random.default_rng(8)
    k, c = 3, 5
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = hmm_lm.Model(norm(rng.random(k)), norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, c))), np.zeros(0, np.uint64))
    ends = np.array([0, 700, 703, 1100])
    seq = rng.integers(0, c, 1100)
    counts = hmm_lm.expected_counts(model, seq, ends)
    want = np.zeros((k, k))
    for s, e in zip(ends, ends[1:], strict=False):
        x = seq[s:e]
        alpha, beta = np.zeros((len(x), k)), np.ones((len(x), k))
        for t in range(len(x)):
            alpha[t] = norm((alpha[t - 1] @ model.move if t else model.start) * model.emit[:, x[t]])
        for t in range(len(x) - 2, -1, -1):
            beta[t] = norm(model.move @ (model.emit[:, x[t + 1]] * beta[t + 1]))
        for t in range(len(x) - 1):
            pair = alpha[t][:, None] * model.move * model.emit[:, x[t + 1]] * beta[t + 1]
            want += pair / pair.sum()
    assert np.allclose(counts[2 * k : 2 * k + k * k].reshape(k, k), want, rtol=1e-9)
    assert math.isclose(counts[:k].sum(), 3) and math.isclose(want.sum(), 1097)


def test_machines_separate_and_families_come_first():
    texts = {"en": "the cat sat on the mat with that hat", "de": "der hund und die katze sind nicht hier", "fr": "le chat et la souris sont dans la maison", "es": "el gato y los perros están en la casa"}
    rng = random.Random(1)
    rows, langs = [], []
    for lang, t in texts.items():
        for _ in range(30):
            rows.append(" ".join(rng.choice(t.split()) for _ in range(12)))
            langs.append(lang)
    x, labels, families = langid.features(pa.array(rows)), np.array(langs), np.array([langid.family_of(v) for v in langs])
    of = lambda side, rows=slice(None): langid.fit_svm(x[rows], side[rows])
    weights = {langid._machine(f): of(np.where(families == f, 1, -1)) for f in ("germanic", "romance")}
    for f, a, b in (("germanic", "de", "en"), ("romance", "es", "fr")):
        weights[langid._machine(f, a, b)] = of(np.where(labels == a, 1, -1), (labels == a) | (labels == b))
    model = langid.LanguageModel(list(texts), weights)
    assert model.members == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    told, score = model.predict(langid.features(pa.array([" ".join(reversed(t.split())) for t in texts.values()])))
    assert told.tolist() == list(texts) and ((score > 0.3) & (score <= 1)).all()
    assert langid.LanguageModel([], {}).predict(np.zeros((1, langid.WIDTH)))[0][0] == "und"


def test_secret_spans():
    text = "secret:token:abcdefgh PassWord = 'hunter22x' api_key=abc AKIA" + "A" * 16 + " " + "0f" * 12 + " token==abcdef"
    found = secrets.find(text)
    assert [k for k, *_ in found] == ["assign", "access", "hex", "assign"]
    assert text[found[0][1] : found[0][2]] == "PassWord = 'hunter22x"


def test_codes_estimate_inner_products():
    rng = np.random.default_rng(6)
    turns = embdedup.rotations(64, embdedup.ESTIMATES)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * rng.random((400, 1)) * 2
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    codes, factors = embdedup.encode(x, turns)
    guess, sure = embdedup.estimate(codes, factors, y, turns)
    many, bound = embdedup.estimates(codes, factors, y, turns)
    assert np.allclose(np.diag(many), guess) and np.allclose(bound, sure)
    true = (x * y).sum(axis=1)
    assert abs((guess - true).mean()) < 0.01 and (np.abs(guess - true) <= sure).all() and sure.mean() < 0.35


@pytest.mark.parametrize("width", [2, 8, 64])
def test_tables_find_close_pairs(width):
    """Pairs exactly at the threshold share a key; unlike ones rarely do."""
    rng = np.random.default_rng(7)
    x, z = rng.standard_normal((2, 3000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    tables = embdedup.Tables(3000, width, 0.9)
    a, b = tables.keys(x), tables.keys(0.9 * x + math.sqrt(0.19) * z)
    assert ((a == b).any(axis=1)).mean() > 0.998
    if width == 64:
        assert (a == tables.keys(z)).mean() < 0.001


def test_best_breaks_ties_by_id():
    row, ids, score = topk._best(np.array([[3.0, 5, 5, 1, 5]]), np.array([9, 8, 2, 7, 4]), np.array([4]), 2)
    assert ids.tolist() == [2, 8] and score.tolist() == [5, 5]


def test_labeller_accuracies():
    rng = np.random.default_rng(8)
    truth = rng.random(20000) < 0.8
    right = np.array([0.95, 0.85, 0.7, 0.9])
    votes = np.where(rng.random((20000, 4)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    votes[rng.random((20000, 4)) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, found, _ = weaklabel.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.02 and np.abs(found[1] - right).max() < 0.03
