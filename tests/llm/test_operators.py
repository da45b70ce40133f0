"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import hashlib
import math
import re
import threading
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import compaction, embdedup, hmm_lm, langid, minhash, mixing, packing, secrets, topk, weaklabel
from quillspark.llm.common import chunks, cut, hash_strings, new_path, quoted, work
from quillspark.llm.grouping import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, class string, keys int"


def _documents():
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    rows = []
    for k, t in enumerate(base):
        rows.append((k, t))
        rows.append((100 + k, t))  # an exact copy
        near = t.split()
        near[3] = "changed"
        rows.append((200 + k, " ".join(near)))
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "one two"), (304, "one two"), (305, "ONE\ttwo"), (None, base[0]), (306, "long " + base[1] * 40), (0, base[0])]
    rows.append((307, 'password = "hunter2hunter2" and ' + "ab12" * 8 + " é AKIA" + "Z" * 16))
    langs = ("en", "de", None)
    return [(i, t, langs[k % 3], f"s{k % 2}" if k % 5 else None, None, 7, "x", 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_documents(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _groups(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, k) for k in range(60, 90)] + [(7, 7), (100, 99), (99, 100)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _groups({x for e in edges for x in e} - set(), edges)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_equal_brute_force(spark, docs, none):
    rows = [r for r in _documents() if r[0] is not None]
    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(i, _sets(t))
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = _groups(ids, linked)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(_documents())
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"]
            continue
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], r["doc_id"] == want[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0


def test_large_group_of_near_copies(spark):
    """A chain of gradual changes: most pairs aren't alike, but all are linked through others."""
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in rng.integers(0, 10**6, 120)]
    rows = []
    for k in range(60):
        text = list(base)
        for j in rng.choice(120, 4, replace=False):
            text[j] = f"n{k}_{j}"
        rows.append((k, " ".join(text)))
    sets = {i: _sets(t) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _groups(sets, linked)


def test_language_model_base_is_exact(spark, docs, none):
    got = hmm_lm.score_documents(docs).collect()
    counts = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = _documents()
    for i, t, *_ in rows:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm_lm.score_documents(none).count() == 0


def test_language_model_learns_from_all_documents(spark):
    rng = np.random.default_rng(5)
    text = lambda kind, topic, n: " ".join(f"{kind}{topic}{x}" for x in rng.integers(0, 20, n))
    # One chunk: 480,000 words of the first kind come before those of the second.
    rows = [(k, text("a", k % 8, 1000)) for k in range(480)] + [(1000 + k, text("b", k % 4, 200)) for k in range(400)]
    got = hmm_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    late = [r for r in got if r["doc_id"] >= 1000]
    assert len(late) == 400
    assert sum((r["score"] - r["base_score"]) / r["n_tokens"] for r in late) / len(late) > 0.8


def test_language_model_tells_rare_words_of_an_ending_apart(spark):
    fold = lambda k: zlib.crc32(str(k).encode()) % 10
    trained, held = [k for k in range(500) if fold(k)][:400], [k for k in range(1000, 1200) if fold(k) == 0][:2]
    rng = np.random.default_rng(6)
    common = {t: [f"{t}{x}" for _ in range(20) for x in rng.permutation(2100)] for t in "ab"}
    # 4200 words of two topics, 20 times each, fill the classes of their own. Pairs of rare words share an ending; each comes four times, within texts of one topic.
    parts = lambda j: (common["ab"[j % 2]][j // 2 * 210 :][:210], [f"{'pq'[j % 2]}{j // 2 % 50:03d}"], 7 * (j // 2 % 25) + 20)
    rows = [(k, " ".join(words[:at] + rare + words[at:])) for k, (words, rare, at) in zip(trained, map(parts, range(400)), strict=True)]
    text = " ".join(common["a"][:100])
    rows += [(held[0], f"{text} p007 {text}"), (held[1], f"{text} q007 {text}")]
    got = {r["doc_id"]: r for r in hmm_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert math.isclose(got[held[0]]["base_score"], got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 0.5


def test_languages(spark, docs, none):
    got = langid.languages(docs).collect()
    assert len(got) == len(_documents())
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (300, 301, 302)) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.languages(none).count() == 0


def test_secrets_ledger_scans_once(spark, docs, none):
    seen = new_path(spark, "ledger")
    first = secrets.scan_history(docs, "doc_id", seen).collect()
    held = spark.read.parquet(seen).count()
    assert held == len({hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in _documents()})
    again = secrets.scan_history(docs, "doc_id", seen).collect()
    assert spark.read.parquet(seen).count() == held and Counter(map(str, again)) == Counter(map(str, first))
    secrets.scan_history(docs, "doc_id", seen, secrets.Rules("next")).count()
    assert spark.read.parquet(seen).count() == 2 * held
    r = secrets.digest(secrets.scan_history(docs, "doc_id")).where("doc_id = 307").first()
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert secrets.digest(secrets.scan_history(none, "doc_id")).count() == 0
    cut = secrets.masked(F.lit("abécdef"), F.from_json(F.lit('[{"start":1,"end":4},{"start":2,"end":5}]'), "array<struct<start:int,end:int>>"))
    assert spark.range(1).select(cut).first()[0] == f"a{secrets.MASK}ef"
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert "hunter2" not in masked.where("doc_id = 307").first()["text"] and masked.where("text IS NULL").count() == 1


def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, size=64).toPandas()
    want = Counter()
    for i, t, *_ in _documents():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END]
        for s in range(0, len(ids), 64):
            want[i, s, min(64, len(ids) - s), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes()), len(ids)] += 1
    rows = packing.pack(docs, TOKENIZER, size=64).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert Counter(map(tuple, rows)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 64
    assert sorted(set(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    assert packing.pack(none, TOKENIZER).count() == 0


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))
    rows = [(int(k), [float(v) for v in r], 1) for k, r in enumerate(x)]
    rows += [(50 + k, [float(v) for v in x[k] + rng.standard_normal(8) * 0.15], 1) for k in range(20)]
    rows += [(100, [float(v) for v in x[0]], 2), (101, None, 2), (102, [0.0] * 8, 2), (103, [float("nan")] * 8, 2), (104, [None, 1.0], 2), (105, [], 2), (106, [1.0, 2.0], 2), (150, [2 * float(v) for v in x[1]], 2)]
    return rows


def _padded(v):
    return np.array(v + [0.0] * (8 - len(v)))


def test_vector_links_equal_brute_force(spark):
    rows = _vectors()
    able = {i: _padded(v) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    linked = [(a, b) for a in able for b in able if a < b and able[a] @ able[b] / np.linalg.norm(able[a]) / np.linalg.norm(able[b]) >= 0.9]
    want, n = _groups([i for i, *_ in rows], linked), Counter(x for e in linked for x in e)
    got = embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], want[i], want[i] == i) for i, *_ in rows}
    assert embdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_top_k_equals_brute_force(spark):
    rows = _vectors()
    able = {i: np.floor(256 * _padded([float(np.float32(x)) for x in v])) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    for i, v, _ in rows:
        if i in able:
            able[i][len(v) :] = 0
    got = topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = set()
    for q in able:
        if q % 50 == 0:
            best = sorted(((-int(able[q] @ able[c]), c) for c in able if c != q))[:5]
            want |= {(q, k, c, -s) for k, (s, c) in enumerate(best, 1)}
    assert {tuple(r) for r in got} == want
    assert topk.search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_top_k_of_large_components_is_exact(spark):
    """Products beyond 2^53, beyond a long and beyond 38 digits, against whole numbers; ties go to the smaller id."""
    rng = np.random.default_rng(4)
    for scale, ids in ((1e6, 30), (3e8, 30), (1e30, 12)):
        rows = [(int(k), [float(v) for v in rng.integers(-1000, 1000, 8) * scale / 1000 + (scale < 1e9)]) for k in range(ids)]
        rows += [(100, rows[3][1]), (101, rows[3][1]), (102, [0.5] * 8), (103, [0.0] * 8), (104, [1e308] * 8)]
        able = {i: [math.floor(256 * Fraction(x)) for x in v] for i, v in rows if i != 104}
        got = topk.search_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        want = set()
        for q in able:
            if q % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(able[q], able[c], strict=True)), c) for c in able if c != q)[:5]
                want |= {(q, k, c, clip(-s)) for k, (s, c) in enumerate(best, 1)}
        assert {tuple(r) for r in got} == want


def test_top_k_stops_at_the_bound(spark, monkeypatch):
    """Well-parted groups of vectors: queries visit few of the annuli, each at most once."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (16, 4))
    x = (centres[np.arange(1600) % 16] + rng.integers(-20, 20, (1600, 4))).astype(float)
    visits = []
    vectors = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, x array<double>")
    got = topk.top_k(vectors, "vec_id % 100 = 0", 3, visits=visits).collect()
    products = x[::100] @ x.T
    for j in range(16):
        best = sorted((-products[j, c], c) for c in range(1600) if c != 100 * j)[:3]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == 100 * j), key=lambda r: r["rank"])] == [(c, int(-s)) for s, c in best]
    seen = [(r["query_block"], r["block_id"], a) for v in visits for r in v.collect() for a in r["active"]]
    assert len(seen) == len(set(seen)) and len(visits) > 1
    blocks = len({s[1] for s in seen}) and 1600 // 32
    assert len(seen) < 0.5 * 16 * blocks


def test_raking_meets_the_margins(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["word"] * int(rng.integers(1, 40))) + (" {};" * 9 if k % 7 == 0 else ""), "ab"[int(rng.random() < 0.3)], f"s{int(rng.random() ** 2 * 4)}") for k in range(400)]
    got = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    for m in mixing.MARGINS:
        raw = got.groupby(m).tokens.sum() ** mixing.TEMPERATURE
        assert np.abs((got.weight * got.tokens).groupby(got[m]).sum() - raw / raw.sum()).max() < 1e-4
    expected = (got.p * got.tokens).sum() / got.tokens.sum()
    assert abs(expected - mixing.BUDGET) < 1e-3 and got.p.between(0, 1).all()
    odd = mixing.weigh(docs)
    assert odd.count() == docs.count() and odd.where("tokens = 0 AND sampled").count() == 0
    assert mixing.weigh(none).count() == 0


def test_mixing_equals_a_plain_fit(spark):
    """Weights against sequential scaling in numpy, for targets given and taken from the data, and p against its definition."""
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["word"] * int(rng.integers(1, 40))), "abc"[int(rng.random() * 3)], f"s{int(rng.random() ** 2 * 4)}") for k in range(300)]
    wanted = {"lang": {"a": 0.5, "b": 0.3, "c": 0.2, "absent": 7.0}}
    given = {m: spark.createDataFrame(list(t.items()), "value string, share double") for m, t in wanted.items()}
    got = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), wanted=given).toPandas()
    cells = got.groupby(list(mixing.MARGINS)).agg(tokens=("tokens", "sum"), weight=("weight", "first"), p=("p", "first")).reset_index()
    mass = cells.tokens.to_numpy(float)
    shares = {}
    for m in mixing.MARGINS:
        raw = cells.groupby(m).tokens.sum() ** mixing.TEMPERATURE if m not in wanted else cells.groupby(m).tokens.sum() * 0 + [wanted[m][v] for v in sorted(set(cells[m]))]
        shares[m] = cells[m].map(raw / raw.sum()).to_numpy(float)
    for _ in range(200):
        for m in mixing.MARGINS:
            mass *= shares[m] / cells.assign(mass=mass).groupby(m).mass.transform("sum").to_numpy()
    assert np.abs(mass / cells.tokens - cells.weight).max() < 1e-5 * cells.weight.max()
    factor = (cells.p / cells.weight)[cells.p < 1]
    assert factor.max() - factor.min() < 1e-9 * factor.max() and (cells.weight[cells.p == 1] * factor.min() >= 1 - 1e-9).all()
    assert abs((cells.p * cells.tokens).sum() / cells.tokens.sum() - mixing.BUDGET) < 1e-6
    assert (got.residual == got.residual[0]).all() and got.residual[0] <= 1e-4


CLASHES = ["source_", "__source", "__lang", "__spans", "__blob", "blob", "own", "spans", "new", "row", "rank", "shard_rows", "shard_tier", "shard_bytes", "tier", "path", "_metadata", "a.b"]


def test_operators_that_return_documents_keep_clashing_names(spark, docs):
    wide = docs.where("doc_id < 110").select("doc_id", "text", "lang", "source", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES)])
    want = Counter(map(tuple, wide.drop("text").collect()))
    assert Counter(map(tuple, secrets.redact(wide).drop("text").collect())) == want
    assert Counter(map(tuple, mixing.weigh(wide).drop("text", *mixing.ADDED).collect())) == want
    assert langid.identify(wide, langid.train(wide)).drop("lang_pred", "score", "text").columns == wide.drop("text").columns


def test_languages_of_held_out_documents(spark):
    """Whole documents of the driver's table: those not learned from are nearly all right."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL")
    right, n = got.selectExpr("sum(int(lang_pred = lang))", "count(*)").first()
    assert n > 200 and right >= 0.98 * n


def test_quality_of_labelled_documents(spark):
    """Scores rank documents labelled good above those labelled bad, though no label is looked at in training."""
    folder = "/root/testdata/sf0.01"
    got = weaklabel.score_quality(spark.read.parquet(f"{folder}/documents.parquet")).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    ranks = got.score.rank()
    good, bad = (got.quality == 1).sum(), (got.quality == 0).sum()
    assert min(good, bad) > 50
    assert (ranks[got.quality == 1].sum() - good * (good + 1) / 2) / (good * bad) > 0.95


def test_secrets_of_whole_documents_equal_plain_expressions(spark):
    """Every document of the driver's table, scanned here by the expressions of the contract alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan_history(docs, "doc_id")).collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    some = 0
    for r in docs.select("doc_id", "text").collect():
        t = r["text"] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        said = ",".join(f"{secrets.BASE[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in secrets.BASE] == [sum(x[1] == j for x in spans) for j in range(3)]
        some += bool(spans)
    assert some > 5


def test_language_model_is_the_same_for_any_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    two, seven = ({r["doc_id"]: (r["score"], r["base_score"], r["n_known"]) for r in hmm_lm.score_documents(docs.repartition(n)).collect()} for n in (2, 7))
    assert len(two) == docs.count() and two.keys() == seven.keys()
    for k, (score, base, known) in two.items():
        assert math.isclose(score, seven[k][0], rel_tol=1e-6) and math.isclose(base, seven[k][1], rel_tol=1e-9) and known == seven[k][2]


@pytest.mark.parametrize("rare", [0.0, 1e-4, 2e-3, 0.05])
def test_most_frequent_words_are_exact_whatever_chunks_leave_out(spark, rare, monkeypatch):
    monkeypatch.setattr(hmm_lm, "TOP_WORDS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    count = Counter(w for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10 for w in (r["text"] or "").encode().lower().split())
    found = hmm_lm._most_frequent(hmm_lm.coded_documents(docs, rare))
    hashed = dict(zip(hash_strings(pa.array([w.decode() for w in count])).view(np.int64).tolist(), count.values(), strict=True))
    expected = sorted(hashed.items(), key=lambda x: (-x[1], x[0]))[:300]
    assert [(h, n) for h, n, _ in found] == expected


def test_language_model_score_is_the_forward_sum(spark):
    """Scores of a small table against a plain forward recursion over the trained model's own probabilities, which sum to 1."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)] + ["rare1", "rare2", "rare3"]
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(0, 25))))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    t, backed = hmm_lm.train(hmm_lm.coded_documents(docs), 3)
    chances, total = {}, 0.0
    for b in backed.toArrow().to_batches():
        for k in range(b.num_rows):
            c, seen, model = t.emitted(b, k)
            for j, h in enumerate(c.hashes.tolist()):
                if h not in chances:
                    total = total + model.emit[:, 1 + j] * (seen[j] > 0)
                chances[h] = model.emit[:, 1 + j]
    assert (total + t.model.emit[:, 0] < 1).all() and (total + t.model.emit[:, 0] > 0.5).all()
    known = lambda w: chances[int(hash_strings(pa.array([w]))[0])]
    for r in hmm_lm.score_documents(docs, 3).collect():
        a = None
        for w in [*rows[r["doc_id"]][1].split(), None]:
            a = (t.model.start if a is None else a @ t.model.move) * (t.model.emit[:, 0] if w is None else known(w))
        assert math.isclose(r["score"], math.log10(a.sum()), rel_tol=1e-9)


def test_compaction_round_trip_and_versions(spark, docs, none):
    root = new_path(spark, "shards")
    store = compaction.ShardStore(spark, root, target_bytes=1 << 20, shard_rows=2, fanout=2)
    for k in range(3):
        store.append(docs.where(F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) == k))
    before = store.manifest().count()
    assert store.versions() == [1, 2, 3] and store.compact() == 4 and store.manifest().count() < before
    assert store.compact() is None
    key = lambda df: Counter(map(tuple, df.select(docs.columns).collect()))
    assert key(store.read()) == key(store.read(3)) == key(docs)
    with pytest.raises(compaction.Conflict):
        store._commit(store.manifest(), 3)
    assert store.vacuum() == 0 and store.vacuum(0) > 0 and key(store.read()) == key(docs) and store.versions() == [4]
    out = compaction.sharded(docs, new_path(spark, "shards"))
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out.collect()) == Counter((i, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in _documents())
    assert compaction.sharded(none, new_path(spark, "shards")).count() == 0


def test_vacuum_spares_an_append_under_way(spark, docs, monkeypatch):
    """Another writer's vacuum between the writing of shards and their commit; names that the store adds; many shards in turns."""
    monkeypatch.setattr(compaction, "MOST_PATHS", 3)
    wide = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES)])
    key = lambda df: Counter(map(tuple, df.select(*map(quoted, wide.columns)).collect()))
    root = new_path(spark, "shards")
    one, two = compaction.ShardStore(spark, root, 1 << 20, 2, 2), compaction.ShardStore(spark, root, 1 << 20, 2, 2)
    one.append(wide.where("doc_id < 110"))
    commit = two._commit
    monkeypatch.setattr(two, "_commit", lambda *a: (one.vacuum(), commit(*a))[1])
    two.append(wide.where("doc_id >= 110"))
    assert key(one.read()) == key(wide.where("doc_id IS NOT NULL"))
    while one.compact():
        pass
    assert key(one.read()) == key(wide.where("doc_id IS NOT NULL"))
    assert compaction.sharded(wide, new_path(spark, "shards")).count() == wide.count()


@pytest.mark.parametrize("base", [0, 1])
def test_an_append_that_was_overtaken_and_vacuumed_is_a_conflict(spark, docs, base):
    root = new_path(spark, "shards")
    one, two = compaction.ShardStore(spark, root, 1 << 20, 2, 2), compaction.ShardStore(spark, root, 1 << 20, 2, 2)
    rows = docs.where("doc_id IS NOT NULL")
    if base:
        one.append(rows.where("doc_id < 100"))
    commit = one._commit

    def late(shards, number):
        two.append(rows.where("doc_id BETWEEN 100 AND 199"))
        two.append(rows.where("doc_id >= 200"))
        two.vacuum()
        return commit(shards, number)

    one._commit = late
    with pytest.raises(compaction.Conflict):
        one.append(rows.where("doc_id = 5"))
    one._commit = commit
    assert one.latest() == base + 2 and one.versions() == [base + 2]
    assert one.read().count() == rows.where("doc_id >= 100" if not base else "true").count()
    assert one.append(rows.where("doc_id = 5")) == base + 3
    assert "Join" not in one.read()._jdf.queryExecution().executedPlan().toString()


def test_a_compaction_whose_shards_went_is_a_conflict(spark, docs):
    root = new_path(spark, "shards")
    one, two = compaction.ShardStore(spark, root, 1 << 20, 2, 2), compaction.ShardStore(spark, root, 1 << 20, 2, 2)
    one.append(docs)
    one.append(docs)
    commit = one._commit
    one._commit = lambda shards, base: (two.compact(), two.vacuum(0), commit(shards, base))[2]
    with pytest.raises(compaction.Conflict):
        one.compact()
    assert two.read().count() == 2 * docs.count()


def test_features_of_many_tiny_texts_are_made_in_bounded_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab c"] * 10_000)], ["text"])
    assert langid.FEATURE_ROWS == weaklabel.FEATURE_ROWS == 256
    assert [b.num_rows for b in chunks([batch], rows=256)] == [256] * 39 + [16]
    tracemalloc.start()
    for b in chunks([batch], limit=langid.FEATURE_BYTES, rows=langid.FEATURE_ROWS):
        langid.features(b.column("text"))
        weaklabel.features(b.column("text"))
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_work_tables_of_another_thread_are_left_alone(spark, docs):
    made, inside, go = [], threading.Event(), threading.Event()

    def other():
        with work(spark):
            made.append(cut(docs.select("doc_id"), "other"))
            inside.set()
            go.wait(60)
            made.append(made[0].count())

    with work(spark) as kept:
        thread = threading.Thread(target=other)
        thread.start()
        assert inside.wait(60)
        with work(spark) as inner:
            inner.append(path := new_path(spark, "mine"))
            docs.select("doc_id").write.parquet(path)
        assert spark.read.parquet(path).count() == docs.count() and not kept
    go.set()
    thread.join()
    assert made[1] == docs.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_quality_scores(spark, docs, none):
    rows = [(k, "the quiet house by the river was sold to a young family " * 3 + f"in year {k}") for k in range(60)]
    rows += [(100 + k, "BUY NOW!!! CHEAP!!! $$$ ### " * (5 + k % 5)) for k in range(20)] + [(200, None), (201, " ")]
    got = {r["doc_id"]: r for r in weaklabel.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k]["kept"] for k in range(60)) and not any(got[100 + k]["kept"] for k in range(20))
    assert not got[200]["kept"] and got[201]["score"] == 0
    assert weaklabel.score_quality(docs).count() == docs.count() and weaklabel.score_quality(none).count() == 0
