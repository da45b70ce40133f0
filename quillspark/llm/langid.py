"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, remainder

UNKNOWN = "und"
BITS = 12
WIDTH = 1 << BITS
#: Documents of each language that the machines of its family are fitted on, as expected number, and documents of all languages
#: that a machine of families is fitted on; all others are only predicted.
SAMPLE = 800
FAMILY_SAMPLE = 6400
STEEPNESS = 4.0
#: Text whose features are made at a time: a row of WIDTH numbers each is held for the texts in it.
FEATURE_BYTES = 1 << 20
#: Rows whose features are made side by side.
FEATURE_ROWS = 256
# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he am mt",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.array([b if 97 <= b < 123 or b >= 128 else 32 for b in range(256)], np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def family_of(lang: str) -> str:
    """The family of a code; a code that isn't listed is a family of its own."""
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def features(texts: pa.Array) -> np.ndarray:
    """Roots of the counts of hashed byte bigrams and trigrams of the lower-cased texts, each row of length 1.

    Bytes that belong to no letter count as spaces, and n-grams lie within one text.
    """
    low = pc.utf8_lower(texts).cast(pa.large_string())
    n = len(low)
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int64)[low.offset : low.offset + n + 1]
    out = np.zeros((n, WIDTH), np.float32)
    if data is None or ends[-1] == ends[0]:
        return out
    raw = _LETTER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]].astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(ends))
    flat = np.zeros(n * WIDTH)
    for size in (2, 3):
        m = len(raw) - size + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        for k in range(size):
            code = code * np.uint64(256) + raw[k : k + m]
        blank = code == int.from_bytes(b" " * size, "big")
        code = (code + np.uint64(size << 32)) * _STEP
        good = (row[:m] == row[size - 1 :]) & ~blank
        flat += np.bincount((row[:m] * WIDTH + (code >> np.uint64(64 - BITS)).astype(np.int64))[good], minlength=n * WIDTH)
    out[:] = np.sqrt(flat.reshape(n, WIDTH))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 25, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with hinge loss, by coordinate descent on its dual."""
    # Both classes weigh the same, however many rows they have.
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    square = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1
    alpha, w, rng = np.zeros(len(y)), np.zeros(x.shape[1] + 1), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(y)):
            new = min(max(alpha[k] - (y[k] * (x[k] @ w[:-1] + w[-1]) - 1) / square[k], 0.0), cost[k])
            if new != alpha[k]:
                w[:-1] += (new - alpha[k]) * y[k] * x[k]
                w[-1] += (new - alpha[k]) * y[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w


class LanguageModel:
    """Family machines (one against the rest) and, in each family, a machine for each pair of languages."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs = sorted(langs)
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.family_w = np.array([weights[_machine(f)] for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {(f, a, b): weights[_machine(f, a, b)] for f, members in self.members.items() for a, b in combinations(members, 2)}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (0 to 1: the family's share times the mean share of the pairs) of each row."""
        n = len(x)
        out, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if not self.langs or not n:
            return out, score
        best, sure = np.zeros(n, int), np.ones(n)
        if self.family_w is not None:
            margin = STEEPNESS * (x @ self.family_w[:, :-1].T + self.family_w[:, -1])
            share = np.exp(margin - margin.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            best, sure = share.argmax(axis=1), share.max(axis=1)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            if not len(rows):
                continue
            votes, belief = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, j in combinations(range(len(members)), 2):
                w = self.pairs[f, members[i], members[j]]
                p = 1 / (1 + np.exp(-np.clip(STEEPNESS * (x[rows] @ w[:-1] + w[-1]), -30, 30)))
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                belief[:, i] += p
                belief[:, j] += 1 - p
            if len(members) > 1:
                belief /= len(members) - 1
            else:
                belief[:] = 1
            won = (votes + belief / 2).argmax(axis=1)
            out[rows] = np.array(members, object)[won]
            score[rows] = sure[rows] * belief[np.arange(len(rows)), won]
        return out, score


def _machine(family: str, *pair: str) -> str:
    return json.dumps([family, *pair])


_ROWS = "machine string, side int, x binary"


def _sampled(langs: list[str]):
    """Features of sampled texts, once for each machine that they are fitted in; ``side`` is 1 or -1."""
    families = sorted({family_of(v) for v in langs})
    within = {v: [(_machine(family_of(v), *pair), 1 if pair[0] == v else -1) for pair in combinations([u for u in langs if family_of(u) == family_of(v)], 2) if v in pair] for v in langs}
    across = {v: [(_machine(f), 1 if family_of(v) == f else -1) for f in families] if len(families) > 1 else [] for v in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=FEATURE_BYTES, rows=FEATURE_ROWS):
            x = features(b.column("text")).astype(np.float16)
            rows = [(m, side, k) for k, (lang, own, all_) in enumerate(zip(*(b.column(c).to_pylist() for c in ("lang", "within", "across")), strict=True)) for m, side in within[lang] * own + across[lang] * all_]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([x[r[2]].tobytes() for r in rows], pa.binary())], ["machine", "side", "x"])

    return run


def _fitted(table: pa.Table) -> pa.Table:
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    side = np.asarray(table.column("side"))
    # Whatever order the rows come in, the fit is the same.
    order = np.lexsort([x[:, 0], x.sum(axis=1), side])
    return pa.table({"machine": table.column("machine")[:1], "w": pa.array([fit_svm(x[order], side[order]).tobytes()], pa.binary())})


def train(labelled: DataFrame, sample: int = SAMPLE, family_sample: int = FAMILY_SAMPLE) -> LanguageModel:
    """A model of ``labelled`` (doc_id, text, lang), fitted on documents chosen by a hash of id and text.

    A machine within a family is fitted on about ``sample`` documents of each of its two languages, a family's machine on about
    ``family_sample`` of all languages, each in one task (8 KB a document); only the weights reach the driver. Rows without language
    or letter aren't used.
    """
    rows = labelled.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], {})
    limit, langs = 1 << 30, sorted(counts)
    share = lambda most: F.create_map(*[v for lang in langs for v in (F.lit(lang), F.lit(min(limit, limit * most // counts[lang] + 1)))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(limit))
    marked = rows.select("lang", "text", (draw < share(sample)[F.col("lang")]).alias("within"), (draw < share(min(sample, max(1, family_sample // len(langs))))[F.col("lang")]).alias("across"))
    found = marked.where("within OR across").mapInArrow(_sampled(langs), _ROWS).groupBy("machine").applyInArrow(_fitted, "machine string, w binary")
    return LanguageModel(langs, {r["machine"]: np.frombuffer(r["w"]) for r in found.toLocalIterator()})


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``documents`` (doc_id, text, further columns) with lang_pred and score; the text alone is looked at.

    Null or empty texts and texts without a letter: ``und`` with score 0. With no language learned all are ``und``. Texts are
    looked at whole, however long. Repeated rows are returned each; an empty table gives an empty result. Columns named lang_pred or score are replaced.
    """
    kept = documents.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks([whole], limit=FEATURE_BYTES, rows=FEATURE_ROWS):
                lettered = np.asarray(pc.match_substring_regex(b.column("text"), r"\pL"))
                lang, score = model.predict(features(b.column("text")))
                lang[~lettered] = UNKNOWN
                score[~lettered | (lang == UNKNOWN)] = 0
                yield b.append_column("lang_pred", pa.array(lang.tolist(), pa.string())).append_column("score", pa.array(score.astype(np.float64)))

    # Plain names on the way through Python; columns get theirs back, whatever signs these hold.
    plain = kept.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(kept.columns)])
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*kept.columns, "lang_pred", "score")


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document; learned from the folds other than crc32(doc_id) mod 4 = 2."""
    held = remainder("doc_id", 4) == 2
    docs = documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text", "lang")
    model = train(docs.where(~F.coalesce(held, F.lit(True))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
