"""Quality from weak labels: expectation-maximisation over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, mix
from .langid import FEATURE_BYTES, FEATURE_ROWS
from .mixing import words_in

BITS = 12
WIDTH = 1 << BITS
#: Documents of each posterior class that the scorer is fitted on, as expected number; labels and votes cover all.
SAMPLE = 1200
ROUNDS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _three(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def labellers() -> dict[str, Column]:
    """Votes on ``text`` (with ``__words``): 1 good, -1 bad, 0 none. All look at the whole text."""
    text, words = F.col("text"), F.col("__words")
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda signs: (size - F.length(F.translate(text, signs, ""))) / size
    signs, capitals, shouts, digits = share("#$%&*|~^<>{}\\"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?"), share("0123456789")
    parts = F.split(F.lower(text), " ")
    varied = F.size(F.array_distinct(parts)) / F.size(parts).cast("double")
    of_word = size / F.greatest(words, F.lit(1))
    none = F.lit(False)
    # A labeller that looks for one fault doesn't call what lacks it good.
    return {
        "signs": _three(signs > 0.02, none),
        "capitals": _three(capitals > 0.25, none),
        "shouts": _three(shouts > 0.02, none),
        "digits": _three(digits > 0.2, none),
        "runs": _three(F.regexp_count(text, F.lit(r"([^\w\s])\1{2,}")) * 200 > size, none),
        "plain": _three((signs > 0.02) | (capitals > 0.25) | (shouts > 0.02), (signs < 0.005) & (capitals < 0.1) & (shouts < 0.005)),
        "varied": _three((words >= 20) & (varied < 0.3), (words >= 20) & (varied > 0.5)),
        "words": _three((of_word > 20) | (of_word < 3), (words >= 5) & (of_word >= 4) & (of_word <= 12)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, accuracies of the labellers in each class (2 x labellers), and each pattern's posterior.

    Patterns are distinct rows of votes with how many documents have them: all that expectation-maximisation needs, at
    most three to the power of the labellers whatever the input. A labeller without a vote says nothing. Accuracies start
    at 0.8, so the better class is the one that most votes call good.
    """
    prior, right = 0.7, np.full((2, patterns.shape[1]), 0.8)
    good, bad = patterns == 1, patterns == -1
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        of_good = np.log(prior) + good @ np.log(right[1]) + bad @ np.log(1 - right[1])
        of_bad = np.log(1 - prior) + bad @ np.log(right[0]) + good @ np.log(1 - right[0])
        now = 1 / (1 + np.exp(np.clip(of_bad - of_good, -500, 500)))
        moved = np.abs(now - posterior).max() if len(now) else 0.0
        posterior = now
        w1, w0 = counts * posterior, counts * (1 - posterior)
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        right[1] = (w1 @ good + 8) / (w1 @ (good | bad) + 10)
        right[0] = (w0 @ bad + 8) / (w0 @ (good | bad) + 10)
        right = np.clip(right, 0.5, 0.999)  # a labeller is never taken to be worse than chance
        if moved < 1e-9:
            break
    return prior, right, posterior


_SHAPE = np.array([48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256)], np.uint8)


def features(texts: pa.Array) -> np.ndarray:
    """Roots of the shares of hashed byte bigrams and trigrams of whole texts, with digits and capitals made alike."""
    low = texts.cast(pa.large_string())
    n = len(low)
    _, ends, data = low.buffers()
    ends = np.frombuffer(ends, np.int64)[low.offset : low.offset + n + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros((n, WIDTH), np.float32)
    raw = _SHAPE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]].astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(ends))
    flat = np.zeros(n * WIDTH)
    for size in (2, 3):
        m = len(raw) - size + 1
        if m <= 0:
            continue
        code = np.full(m, size, np.uint64)
        for k in range(size):
            code = code * np.uint64(256) + raw[k : k + m]
        slot = (mix(code * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)
        good = row[:m] == row[size - 1 :]
        flat += np.bincount((row[:m] * WIDTH + slot)[good], minlength=n * WIDTH)
    out = np.sqrt(flat.reshape(n, WIDTH)).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1)


def fit(x: np.ndarray, target: np.ndarray, steps: int = 300, rate: float = 20.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft targets, both classes weighing the same."""
    w = np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    good = max(1e-9, target.sum())
    weight = target / good + (1 - target) / max(1e-9, (1 - target).sum())
    weight /= weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
        pull = weight * (p - target)
        w[:-1] -= rate * (x.T @ pull + decay * w[:-1])
        w[-1] -= rate * pull.sum()
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, limit=FEATURE_BYTES, rows=FEATURE_ROWS):
        x = features(b.column("text")).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("posterior"), pa.array([r.tobytes() for r in x], pa.binary())], ["posterior", "x"])


def score_quality(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, votes_good, votes_bad, posterior, score, kept) of each row of ``documents`` (doc_id, text).

    All documents vote into a table of patterns, from which the labellers' accuracies come; posteriors go back by
    pattern. The scorer is fitted to posteriors of a bounded sample (SAMPLE), drawn by a hash of id and text, and
    scores every whole text, however long: ``kept`` if its score is ``least`` or more. Texts are looked at once for votes, and written with
    them for the scorer. Null texts count as empty; texts without a word have score 0 and aren't kept. Repeated rows are returned each. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("__words", words_in(F.col("text")))
    rules = labellers()
    names = [f"v_{n}" for n in rules]
    voted = cut(docs.select("doc_id", "text", F.xxhash64("text").alias("t"), F.col("__words").alias("words"), *[v.cast("tinyint").alias(f"v_{n}") for n, v in rules.items()]), "votes")
    table = voted.where("words > 0").groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    patterns = np.array([[r[n] for n in names] for r in table], int).reshape(-1, len(names))
    counts = np.array([r["n"] for r in table], float)
    _, _, posterior = estimate(patterns, counts)
    spark = documents.sparkSession
    known = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, posterior, strict=True)], ", ".join([f"{n} tinyint" for n in names] + ["posterior double"]))
    # At most three to the power of the labellers; wordless texts have no pattern of their own.
    named = voted.join(F.broadcast(known), names, "left").withColumn("posterior", F.when(F.col("words") > 0, F.col("posterior")).otherwise(F.lit(0.0)))
    total = (float(counts @ posterior), float(counts @ (1 - posterior))) if len(counts) else (0.0, 0.0)
    limit = 1 << 30
    share = [min(limit, int(limit * SAMPLE / max(1.0, v)) + 1) for v in (total[1], total[0])]
    draw = F.pmod(F.xxhash64("doc_id", "t"), F.lit(limit)) < F.when(F.col("posterior") >= 0.5, share[1]).otherwise(share[0])
    found = named.where("words > 0").where(draw).select("text", "posterior").mapInArrow(_featured, "posterior double, x binary").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float64)
    target = np.asarray(found.column("posterior"))
    order = np.lexsort([x[:, 0], x.sum(axis=1), target]) if len(x) else []
    w = fit(x[order], target[order]) if len(x) else np.zeros(WIDTH + 1)
    del x, found

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, limit=FEATURE_BYTES, rows=FEATURE_ROWS):
            worded = np.asarray(b.column("words")) > 0
            p = 1 / (1 + np.exp(-np.clip(features(b.column("text")) @ w[:-1] + w[-1], -500, 500)))
            votes = np.array([np.asarray(b.column(n)) for n in names])
            out = [b.column("doc_id"), pa.array((votes == 1).sum(axis=0).astype(np.int32)), pa.array((votes == -1).sum(axis=0).astype(np.int32)), b.column("posterior"), pa.array(np.where(worded, p, 0.0))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "votes_good", "votes_bad", "posterior", "score"])

    out = named.select("doc_id", "text", "words", *names, "posterior").mapInArrow(scored, "doc_id long, votes_good int, votes_bad int, posterior double, score double")
    return out.select("*", (F.col("score") >= least).alias("kept"))
