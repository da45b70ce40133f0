"""Weak-label quality, language identification and the whole pipeline against plain forms that look at one document after the other."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import langid, mixing, secrets, weaklabel

SMALL = "/root/testdata/sf0.001/documents.parquet"
M64 = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def _mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M64
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M64
    return h ^ (h >> 31)


def _root(slots, width):
    x = np.zeros(width, np.float64)
    for k, n in slots.items():
        x[k] = math.sqrt(n)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


# Quality ---------------------------------------------------------------------------------------------------------------


def _votes(text):
    n, words = max(1, len(text)), re.findall("[^\x20\x09-\x0d]+", text)
    share = lambda signs: sum(c in signs for c in text) / n
    signs, capitals, shouts, digits = share("#$%&*|~^<>{}\\"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?"), share("0123456789")
    parts, of_word = text.lower().split(" "), n / max(1, len(words))
    varied = len(set(parts)) / len(parts)
    three = lambda bad, good=False: -1 if bad else int(good)
    runs = len(re.findall(r"([^\w\s])\1{2,}", text, re.ASCII)) * 200 > n
    return [
        three(signs > 0.02), three(capitals > 0.25), three(shouts > 0.02), three(digits > 0.2), three(runs),
        three(signs > 0.02 or capitals > 0.25 or shouts > 0.02, signs < 0.005 and capitals < 0.1 and shouts < 0.005),
        three(len(words) >= 20 and varied < 0.3, len(words) >= 20 and varied > 0.5), three(of_word > 20 or of_word < 3, len(words) >= 5 and 4 <= of_word <= 12),
    ]


def _plain_posteriors(votes):
    """Expectation-maximisation over documents, one by one."""
    prior, right, last = 0.7, [[0.8] * 8, [0.8] * 8], [0.7] * len(votes)
    for _ in range(weaklabel.ROUNDS):
        now = []
        for v in votes:
            good = math.log(prior) + sum(math.log(right[1][k] if x == 1 else 1 - right[1][k]) for k, x in enumerate(v) if x)
            bad = math.log(1 - prior) + sum(math.log(right[0][k] if x == -1 else 1 - right[0][k]) for k, x in enumerate(v) if x)
            now.append(1 / (1 + math.exp(min(500, max(-500, bad - good)))))
        moved, last = max(abs(a - b) for a, b in zip(now, last, strict=True)), now
        prior = min(0.99, max(0.01, (sum(now) + 1) / (len(now) + 2)))
        for k in range(8):
            said = [(p, v[k]) for p, v in zip(now, votes, strict=True) if v[k]]
            right[1][k] = min(0.999, max(0.5, (sum(p for p, x in said if x == 1) + 8) / (sum(p for p, _ in said) + 10)))
            right[0][k] = min(0.999, max(0.5, (sum(1 - p for p, x in said if x == -1) + 8) / (sum(1 - p for p, _ in said) + 10)))
        if moved < 1e-9:
            break
    return last


def _shape_features(text):
    raw, slots = [int(weaklabel._SHAPE[b]) for b in text.encode()], Counter()
    for size in (2, 3):
        for k in range(len(raw) - size + 1):
            code = size
            for b in raw[k : k + size]:
                code = code * 256 + b
            slots[_mix(code * STEP & M64) >> (64 - weaklabel.BITS)] += 1
    return _root(slots, weaklabel.WIDTH)


def test_quality_equals_a_plain_form(spark):
    docs = spark.read.parquet(SMALL)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    worded = [(i, t) for i, t in rows if t.split()]
    votes = {i: _votes(t) for i, t in rows}
    posterior = dict(zip([i for i, _ in worded], _plain_posteriors([votes[i] for i, _ in worded]), strict=True))
    x = np.array([_shape_features(t) for _, t in worded])
    fitted, target = x.astype(np.float32).astype(np.float16).astype(float), np.array([posterior[i] for i, _ in worded])
    order = np.lexsort([fitted[:, 0], fitted.sum(axis=1), target])
    w = weaklabel.fit(fitted[order], target[order])
    score = dict(zip([i for i, _ in worded], 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), strict=True))
    got = weaklabel.score_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["votes_good"], r["votes_bad"]) == (sum(v == 1 for v in votes[i]), sum(v == -1 for v in votes[i]))
        assert math.isclose(r["posterior"], posterior.get(i, 0.0), abs_tol=1e-6) and math.isclose(r["score"], score.get(i, 0.0), abs_tol=2e-3)
        assert r["kept"] == (r["score"] >= 0.5)


# Languages -------------------------------------------------------------------------------------------------------------


def _letter_features(text):
    raw, slots = [int(langid._LETTER[b]) for b in text.lower().encode()], Counter()
    for size in (2, 3):
        for k in range(len(raw) - size + 1):
            some = raw[k : k + size]
            if all(b == 32 for b in some):
                continue
            code = 0
            for b in some:
                code = code * 256 + b
            slots[((code + (size << 32)) * STEP & M64) >> (64 - langid.BITS)] += 1
    return _root(slots, langid.WIDTH)


def test_languages_equal_a_plain_form(spark):
    """One machine for each family and for each pair of languages in one, fitted and asked by themselves."""
    docs = spark.read.parquet(SMALL)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    x = {i: _letter_features(t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)}
    learned = [(i, lang) for i, _, lang in rows if i in x and lang and not held[i]]
    langs = sorted({lang for _, lang in learned})
    family = {v: langid.family_of(v) for v in langs}
    families = sorted(set(family.values()))

    def machine(rows, side):
        own = np.array([x[i].astype(np.float32).astype(np.float16).astype(np.float32) for i, _ in rows])
        y = np.array([side(lang) for _, lang in rows], np.int32)
        order = np.lexsort([own[:, 0], own.sum(axis=1), y])
        return langid.fit_svm(own[order], y[order])

    of_family = {f: machine(learned, lambda v, f=f: 1 if family[v] == f else -1) for f in families} if len(families) > 1 else {}
    of_pair = {(a, b): machine([r for r in learned if r[1] in (a, b)], lambda v, a=a: 1 if v == a else -1) for a, b in combinations(langs, 2) if family[a] == family[b]}
    margin = lambda v, w: langid.STEEPNESS * (float(v @ w[:-1]) + w[-1])
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in langid.languages(docs).collect()}
    assert got.keys() == held.keys() and len(langs) > 2
    for i in held:
        if i not in x:
            assert got[i] == (held[i], "und", 0.0)
            continue
        m = {f: margin(x[i], w) for f, w in of_family.items()} or {families[0]: 0.0}
        share = {f: math.exp(v - max(m.values())) for f, v in m.items()}
        best = max(families, key=lambda f: share.get(f, 0))
        votes, belief = defaultdict(int), defaultdict(float)
        members = [v for v in langs if family[v] == best]
        for a, b in combinations(members, 2):
            p = 1 / (1 + math.exp(-min(30, max(-30, margin(x[i], of_pair[a, b])))))
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p / (len(members) - 1)
            belief[b] += (1 - p) / (len(members) - 1)
        if len(members) == 1:
            belief[members[0]] = 1.0
        won = max(members, key=lambda v: votes[v] + belief[v] / 2)
        assert got[i][:2] == (held[i], won) and math.isclose(got[i][2], share[best] / sum(share.values()) * belief[won], abs_tol=5e-3)


# Pipeline --------------------------------------------------------------------------------------------------------------


def _documents():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ng", "l")]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, text(int(rng.integers(30, 120))), ("en", "fr", "de")[k % 3], f"s{int(rng.random() ** 2 * 3)}") for k in range(60)]
    for k in (0, 7, 20):
        changed = rows[k][1].split()
        changed[-2:] = ["changed", "here"]
        rows += [(100 + k, rows[k][1], "en", "s0"), (200 + k, " ".join(changed), "en", "s1")]
    rows += [(300, "12 34 ## 5", "en", "s0"), (301, None, "en", "s0"), (302, "", "en", "s0")]
    rows += [(400 + k, text(50) + f' password = "hunter{k}hunter" ' + "{};" * (9 * (k % 2)) + " AKIA" + "Z" * 16, "en", "s2") for k in range(6)]
    return rows


def _masked(text, spans):
    out, at = "", 0
    for start, end in sorted(spans):
        if start >= at:
            out += text[at:start] + secrets.MASK
        at = max(at, end)
    return out + text[at:]


def test_the_pipeline_equals_plain_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = _documents()
    schema = "doc_id long, text string, lang string, source string"
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, schema).write.parquet(path)
    # Language: all have one, so those with a letter stay.
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    # Near-duplicates: the smallest id that can be reached stays.
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [r[1].lower().split()] for k in range(len(w) - 4)} for r in left}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {i: new if x == old else x for i, x in root.items()}
    left = [r for r in left if root[r[0]] == r[0]]
    assert len(left) < len(sets)
    # Secrets: every run of overlapping spans is masked.
    rules = secrets.Rules()
    left = [(i, _masked(t, [x[1:3] for x in rules.scan(t)]), lang, source) for i, t, lang, source in left]
    assert not any("hunter" in r[1] or "AKIA" in r[1] for r in left)
    # Mixing: cells by sequential scaling to tempered shares, one factor for all chances, a draw by hash.
    table = spark.createDataFrame(left, schema)
    draw = F.pmod(F.xxhash64(F.lit(0), "doc_id", "text"), F.lit(1 << 52)) / float(1 << 52)
    looked = {r["doc_id"]: (r["topic"], r["u"]) for r in table.select("doc_id", mixing.topic_of(F.col("text")).alias("topic"), draw.alias("u")).collect()}
    cell = {r[0]: (r[3], r[2], looked[r[0]][0]) for r in left}
    tokens = {r[0]: len(r[1].split()) for r in left}
    mass = Counter()
    for i, c in cell.items():
        mass[c] += tokens[i]
    of, every = dict(mass), sum(mass.values())
    target = []
    for m in range(3):
        raw = Counter()
        for c, n in of.items():
            raw[c[m]] += n
        raw = {v: n**mixing.TEMPERATURE for v, n in raw.items()}
        target.append({v: x / sum(raw.values()) for v, x in raw.items()})
    mass = dict(mass)
    for _ in range(300):
        for m in range(3):
            now = Counter()
            for c, x in mass.items():
                now[c[m]] += x
            mass = {c: x * target[m][c[m]] / now[c[m]] for c, x in mass.items()}
    ratio = {c: mass[c] / of[c] for c in mass}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        factor = (lo + hi) / 2
        lo, hi = (factor, hi) if sum(of[c] * min(1.0, ratio[c] * factor) for c in of) < mixing.BUDGET * every else (lo, factor)
    left = [r for r in left if looked[r[0]][1] < min(1.0, ratio[cell[r[0]]] * factor)]
    assert 0 < len(left) < len(cell)
    # Packing: every id of the library in one piece, sequences without gaps.
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r[0]: [*library.encode(r[1], add_special_tokens=False).ids, 1] for r in left}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found, filled = defaultdict(list), defaultdict(list)
    for r in got:
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found.keys() == ids.keys()
    for i, pieces in found.items():
        at = 0
        for start, length, crc, whole in sorted(pieces):
            assert start == at and whole == len(ids[i]) and crc == zlib.crc32(np.array(ids[i][start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i])
    assert sorted(filled) == list(range(len(filled)))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
