"""Periodic runs, line dedup and tokenizer alignment against plain statements of them, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import crosstoken, linededup, periodic
from quillspark.llm.common import new_path, spread_join

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, run string, n long, h1 long, chunk string, `a.b` string"


def _rows(texts):
    return [(i, t, "x", 1, 2, "y", "z") for i, t in texts]


def _texts():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["été", "日本", "naïve—dash", "<|endoftext|>", "<s>", "x" * 60]
    out = []
    for k in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        out.append((k, "\n".join(lines + ["  Same Line\t"] * (k % 2) + [f"rare {k % 9}"])))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, " "), (104, "a"), (105, "a b " * 200), (106, "b a\n" * 30 + "same line"), (107, "\n\nx\r\n y  z　  q  "), (108, "has ▁ in it"), (109, "one two three four five six " * 40)]
    out += [(None, "same line\nw1 w2"), (None, None), (104, "a"), (104, "a"), (110, "word " * 30_000), (111, "tab\tnew\nline\x0bv\x85 n")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(_texts()), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _multiset(df):
    return Counter(tuple(r) for r in df.collect())


# Periodic runs ---------------------------------------------------------------------------------------------------------


def plain_runs(symbols, least=12):
    """(start, length, smallest period): every period's maximal stretches, the smallest period of each stretch."""
    s, best = np.asarray(symbols), {}
    for q in range(1, len(s) // 2 + 1):
        change = np.diff(np.concatenate([[0], (s[:-q] == s[q:]).astype(np.int8), [0]]))
        for lo, hi in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True):
            if hi - lo + q >= max(least, 2 * q):
                best.setdefault((lo, hi + q), q)
    return sorted((lo, hi - lo, q) for (lo, hi), q in best.items())


def _sequences():
    rng = random.Random(3)
    out = [[], [1], [1, 1], [0] * 50, [0, 1] * 30]
    for _ in range(200):
        k, n = rng.choice([1, 2, 3, 10]), rng.randint(0, 90)
        base = [rng.randrange(k) for _ in range(rng.randint(1, 20))]
        d = [base[i % len(base)] for i in range(n)] if rng.random() < 0.5 else [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.3:
            d[rng.randrange(n)] = k
        out.append(d)
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    return [*out, b]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_many_sequences_at_once(least):
    sequences = _sequences()
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sequences])]).astype(np.int64)
    symbols = np.array([x for s in sequences for x in s], np.int64)
    low, end, period = periodic.runs_of(symbols, offsets, least)
    expected = [(lo + o, n, q) for s, o in zip(sequences, offsets.tolist(), strict=False) for lo, n, q in plain_runs(s, least)]
    assert sorted(zip(low.tolist(), (end - low).tolist(), period.tolist(), strict=True)) == sorted(expected)
    may = periodic.may_repeat(symbols, offsets, least)
    assert all(may[k] for k, s in enumerate(sequences) if plain_runs(s, least))


def test_leaves_are_looked_at_in_the_smaller_halves_only():
    n = 1 << 12
    tree = periodic.SuffixTree(np.zeros(n, np.int64), np.array([0, n]))
    head, node, looks = tree.heads(), tree.leaf_parent, 0
    while (node >= 0).any():
        node = node[node >= 0]
        looks += len(node)
        node = tree.parent[head[node]]
    assert looks <= n * 13


def _plain_periodic(doc_id, text, plant=True):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if plant and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    seen = {}
    return words, plain_runs([seen.setdefault(w, len(seen)) for w in words])


def test_periodic_query_equals_a_plain_one(spark, docs, none):
    short = docs.where("doc_id IS NULL OR doc_id <> 110")
    many = spark.createDataFrame(_rows([(k, " ".join(f"u{j % 7 if k % 3 else j}" for j in range(k))) for k in range(200, 330)]), SCHEMA)
    expected = Counter()
    for r in short.union(many).collect():
        words, runs = _plain_periodic(r.doc_id, r.text)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        row = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        said, kept = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2]))), " ".join(w for i, w in enumerate(words) if i not in gone)
        expected[(r.doc_id, len(runs), *row, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())] += 1
    found = periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(short.union(many))))
    assert _multiset(found) == expected and sum(n for r, n in expected.items() if r[1]) > 20
    assert periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(none))).count() == 0


def test_a_long_text_of_one_word_is_one_run(docs):
    row = periodic.periodic_runs(docs.where("doc_id = 110")).first()
    assert row.n_words == 30_000 and [tuple(r) for r in row.runs] == [(0, 30_000, 1)] and row.collapsed == "word"


# Line dedup ------------------------------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain_lines(rows, least, least_chars=1):
    held = Counter(k for _, t in rows for k in {_key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(_key(x)) >= least_chars and held[_key(x)] >= least)]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize(("least", "least_chars", "arrivals"), [(10, 1, 4), (2, 1, 7), (5, 8, 1), (3, 1, 3)])
def test_lines_equal_a_plain_count(docs, least, least_chars, arrivals):
    expected = plain_lines([(r.doc_id, r.text) for r in docs.collect()], least, least_chars)
    found = _multiset(linededup.without_common_lines(docs, least, least_chars, arrivals))
    assert found == expected and (least != 10 or sum(r[2] for r in expected) > 20)


def test_lines_of_an_empty_table(none):
    assert linededup.without_common_lines(none).count() == 0


def test_runs_are_levelled_restart_and_ignore_a_batch_taken_in_before(spark):
    root = new_path(spark, "line-runs")
    rng = np.random.default_rng(1)
    batches = [spark.createDataFrame([(int(x), int(x) * 7) for x in rng.integers(0, 40, 60)], "h1 long, h2 long") for _ in range(11)]
    total = Counter()
    for k, batch in enumerate(batches, 1):
        runs = linededup.LineRuns(spark, root, least=10, fanout=2, buckets=3)  # a new writer each time
        settled = {x for x, n in total.items() if n >= 10}
        runs.add(k, batch)
        runs.add(k, batch)
        runs.close()
        total.update(r.h1 for r in batch.collect())
        assert len(runs.runs()) <= 2 * (k.bit_length() + 1) and settled <= {x for x, n in total.items() if n >= 10}
        covered = [b for _, lo, hi in runs.runs() for b in range(lo, hi + 1)]
        assert covered == list(range(1, k + 1))
    runs = linededup.LineRuns(spark, root, least=10, fanout=2)
    assert runs.buckets == 3 and max(r[0] for r in runs.runs()) == 3
    assert {r.h1 for r in runs.common().collect()} == {x for x, n in total.items() if n >= 10}
    plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    runs.close()


def test_settled_lines_are_not_written_again(spark):
    root = new_path(spark, "line-runs")
    runs = linededup.LineRuns(spark, root, least=2, fanout=9)
    batch = spark.createDataFrame([(1, 1), (1, 1), (2, 2)], "h1 long, h2 long")
    for k in (1, 2, 3):
        runs.add(k, batch)
    rows = [tuple(r) for r in runs._read(runs.runs()).collect()]
    assert Counter(rows) == Counter({(1, 1, 2): 1, (2, 2, 1): 3})
    runs.close()


def test_hot_keys_join_by_broadcast_and_the_others_by_shuffle(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.max("id").alias("v")).where("k < 2000").cache()
    found = spread_join(left, right, ["k"], "rows", most=10)
    assert _multiset(found.select("k", "id", "v")) == _multiset(left.join(right, "k").select("k", "id", "v"))


# Tokenizer alignment ---------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    both = crosstoken.pair(A, B)
    groups = []
    for _, text in rows:
        t, raw = text or "", (" " + (text or "")).encode()
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or b"".join(both.bytes_a[k] for k in ia) != raw or b"".join(both.bytes_b[k] for k in ib) != raw:
            groups.append([])
            continue
        ends = [np.cumsum([len(some[k]) for k in ids]).tolist() for ids, some in ((ia, both.bytes_a), (ib, both.bytes_b))]
        own, x, y = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            own.append((ia[x:p], ib[y:q]))
            x, y = p, q
        groups.append(own)
    count = Counter((p[-1], q[-1]) for own in groups for p, q in own)
    best = defaultdict(int)
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    out = Counter()
    for (i, _), own in zip(rows, groups, strict=True):
        links = [(p[-1], q[-1]) for p, q in own]
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in own)
        row = (sum(len(p) for p, _ in own), sum(len(q) for _, q in own), len(own), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links))
        out[(i, *row, hashlib.sha256(said.encode()).hexdigest() if own else "")] += 1
    return out


def test_alignment_equals_whole_texts(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NULL OR doc_id <> 110").collect()]
    found = crosstoken.digest(crosstoken.align(docs.where("doc_id IS NULL OR doc_id <> 110"), A, B))
    expected = plain_alignment(rows)
    assert _multiset(found) == expected and sum(n for r, n in expected.items() if not r[1]) >= 4
    assert crosstoken.align(none, A, B).count() == 0


def test_alignment_by_shuffled_joins(docs, monkeypatch):
    some = docs.where("doc_id < 30 OR doc_id IN (107, 108)")
    expected = _multiset(crosstoken.align(some, A, B))
    whole = crosstoken.spread_join
    monkeypatch.setattr(crosstoken, "spread_join", lambda *args, **more: whole(*args, **(more | {"most": 3})))
    assert _multiset(crosstoken.align(some, A, B, chunk_bytes=500)) == expected


def test_segments_are_cut_where_neither_vocabulary_joins():
    both = crosstoken.pair(A, B)
    assert both.cuts == " \n\t"
    flat, offsets = crosstoken.segmented(pa.array([" a b\n\nc", "", "  d  e　 f g"]), both.cuts)
    assert flat.to_pylist() == [" a", " b", "\n\nc", "  d  e　 f", " g"] and offsets.tolist() == [0, 3, 3, 5]
    assert crosstoken.segmented(pa.array([" a b"]), "")[0].to_pylist() == [" a b"]


def test_a_vocabulary_that_joins_forbids_the_cut(monkeypatch):
    both = crosstoken.Pair(A, B)
    pieces = [both.b.id_to_piece(k) for k in range(both.b.get_piece_size())]
    assert both._parted(" ", pieces) and not both._parted(" ", [*pieces[:-1], "of▁the"])
    both.bytes_a[-1] = b"end\nof"
    assert not both._parted("\n", pieces) and both._parted(" ", pieces)
