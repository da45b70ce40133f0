"""Hidden Markov language model: Baum-Welch counts summed across partitions, exact likelihood by the scaled forward recursion.

A state emits a word's class, and state and class emit the word: P(word | state) = B[state, class] * P(word | state, class).
The most frequent words are classes of their own; other words fall into classes by their last bytes, and each has its
expected count in every state. The classes, and so all that is broadcast, have a fixed number, while the counts of single
words are summed by word, joined back to the chunks and never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, cut, hash_strings, mix, remainder

STATES = 8
TOP_WORDS = 4096
ENDINGS = 2048
#: Expected tokens of the documents, drawn by a hash from all, that the start values are fitted to, and the rounds on them.
START_TOKENS = 400_000
START_ROUNDS = 12
#: Rounds over all documents end when the log likelihood of a training token rises by less.
SETTLED = 1e-2
#: Tokens of the documents whose counts are taken side by side (one document, if it is longer), and of a long document.
BATCH = 1 << 18
LONG = 1024
#: Each token's state probabilities are counted in steps of 1 / STEPS, so that sums of words are whole numbers, whatever chunks they are taken in.
STEPS = 1024
#: Words with a smaller share of a chunk's tokens are left out where the most frequent words are looked for first.
RARE = 4e-6
#: Pairs of word and chunk whose counts one task sums; pieces of a task's sums over classes, and groups of tasks that they are summed in.
WORD_PAIRS = 500_000
SLICES, SALTS = 16, 8
ALPHA = 0.1
#: Text of a coded chunk: larger ones hold fewer distinct words for their size.
CODED_BYTES = 8 << 20


def _ending_class(words: pa.Array) -> np.ndarray:
    """Class (0 to ENDINGS - 1) of each word by a hash of its last three bytes."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.int32)
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)
    code = np.zeros(len(words), np.uint64)
    for k in (1, 2, 3):
        at = ends[1:] - k
        code = code * np.uint64(257) + np.where(at >= ends[:-1], raw[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return (mix(code) % np.uint64(ENDINGS)).astype(np.int32)


@dataclass
class Model:
    """Start, mean, transition and emission probabilities; class 0 is the end, then the top words, then the endings."""

    start: np.ndarray
    mean: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    top: np.ndarray

    @property
    def classes(self) -> int:
        return self.emit.shape[1]

    def class_of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        out = 1 + len(self.top) + endings.astype(np.int64)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            hit = self.top[at] == hashes
            out[hit] = 1 + at[hit]
        return out

    def updated(self, counts: np.ndarray) -> Model:
        k, c = self.emit.shape
        start, mean, move, emit = np.split(counts, [k, 2 * k, 2 * k + k * k])
        share = lambda x, add: (x + add) / (x + add).sum(axis=-1, keepdims=True)
        # A class keeps a little of its overall frequency in every state, so no probability is 0.
        emit = emit.reshape(k, c)
        overall = (emit.sum(axis=0) + ALPHA) / (emit.sum() + ALPHA * c)
        emit = (emit + 5.0 * overall) / (emit.sum(axis=1, keepdims=True) + 5.0)
        return Model(share(start, ALPHA), share(mean, ALPHA), share(move.reshape(k, k), ALPHA), emit, self.top)


def initial(frequency: np.ndarray, top: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    """States that tend to stay, each with class frequencies randomly tilted from the overall ones."""
    rng = np.random.default_rng(seed)
    emit = (frequency + ALPHA) * rng.gamma(1.0, 1.0, (states, len(frequency)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    even = np.full(states, 1 / states)
    return Model(even, even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True), top)


def counted(model: Model, classes: np.ndarray, offsets: np.ndarray, posteriors: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Baum-Welch counts (starts, occupation, moves, emissions) of sequences of classes, each over its whole length, and
    their log likelihood. ``posteriors``, if given, gets each token's state probabilities instead of the emissions' sums."""
    k, c = model.emit.shape
    start, mean, move, emit = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    before = np.concatenate([[0], np.cumsum(n[order])])
    by_class, forth, one, likelihood = np.ascontiguousarray(model.emit.T), model.move, np.ones(k), 0.0
    back, first = np.ascontiguousarray(forth.T), model.start
    s = 0
    while s < len(order):
        e = max(s + 1, int(np.searchsorted(before, before[s] + BATCH, side="right")) - 1)
        here, length = offsets[order[s:e]], n[order[s:e]]
        s, longest = e, int(length[0])
        # Positions are laid out by their place in the document: those of place t lie from row[t] to row[t + 1].
        live = np.searchsorted(-length, -np.arange(longest), side="left").tolist()
        row = np.concatenate([[0], np.cumsum(live)]).tolist()
        place = np.concatenate([here[:m] + t for t, m in enumerate(live)])
        seen = classes[place]
        emitted = by_class[seen]
        alpha, scale = np.empty_like(emitted), np.empty(len(seen))
        for t, m in enumerate(live):
            lo, hi = row[t], row[t + 1]
            a = alpha[lo:hi]
            if t:
                np.matmul(alpha[row[t - 1] : row[t - 1] + m], forth, out=a)
            else:
                a[:] = first
            a *= emitted[lo:hi]
            total = scale[lo:hi]
            np.matmul(a, one, out=total)
            a /= total[:, None]
        likelihood += float(np.log(scale).sum())
        emitted /= scale[:, None]
        beta = np.ones((len(here), k))
        for t in range(longest - 1, -1, -1):
            m, lo, hi = live[t], row[t], row[t + 1]
            now = beta[:m]
            alpha[lo:hi] *= now
            if t:
                w = emitted[lo:hi]
                w *= now
                move += alpha[row[t - 1] : row[t - 1] + m].T @ w
                np.matmul(w, back, out=now)
        start += alpha[: len(here)].sum(axis=0)
        mean += alpha.sum(axis=0)
        if posteriors is not None:
            posteriors[place] = alpha
            continue
        by_state = np.ascontiguousarray(alpha.T)
        for j in range(k):
            emit[j] += np.bincount(seen, weights=by_state[j], minlength=c)
    return np.concatenate([start, mean, (move * model.move).ravel(), emit.ravel()]), likelihood


def expected_counts(model: Model, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of sequences of classes; see ``counted``."""
    return counted(model, classes, offsets)[0]


def fitted(model: Model, classes: np.ndarray, offsets: np.ndarray, rounds: int = START_ROUNDS) -> Model:
    """``model`` after Baum-Welch rounds on sequences that lie in one place."""
    for _ in range(rounds if len(classes) else 0):
        model = model.updated(counted(model, classes, offsets)[0])
    return model


def log10_likelihood(model: Model, classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of classes: the scaled forward recursion over its whole length, all at once."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    at, length = offsets[:-1][order], n[order]
    out = np.zeros(len(n))
    by_class = np.ascontiguousarray(model.emit.T)
    a = np.tile(model.start, (len(n), 1))
    longest = int(length[0]) if len(n) else 0
    live = np.searchsorted(-length, -np.arange(longest), side="left")
    for t in range(longest):
        m = int(live[t])
        a = (a[:m] @ model.move if t else a[:m]) * by_class[classes[at[:m] + t]]
        total = a.sum(axis=1)
        a /= total[:, None]
        out[:m] += np.log10(total)
    back = np.empty(len(n))
    back[order] = out
    return back


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers compressed byte plane by byte plane."""
    flat = np.ascontiguousarray(values).reshape(-1, 1).view(np.uint8)
    return pa.compress(pa.py_buffer(np.ascontiguousarray(flat.T)), codec="zstd", asbytes=True) if len(flat) else b""


def _numbers(data: pa.Buffer | bytes, kind: str, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, count * size, codec="zstd"), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_CODED = "chunk long, tokens long, slack long, doc_ids array<long>, held array<boolean>, draws array<long>, offsets array<long>, words int, codes binary, hashes binary, endings binary, counts binary, heavy array<struct<h:long,n:long,e:int>>, by_ending binary"


def _coded(rare: float):
    """A row for each chunk of texts: its distinct words by hash, their training counts, and each text as codes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        one = lambda x, kind: pa.array([x], kind)
        for b in chunks(batches, limit=CODED_BYTES):
            words = Words(b.column("text"))
            held = np.asarray(b.column("held"))
            hashes, endings = hash_strings(words.words), _ending_class(words.words)
            by_hash = np.argsort(hashes, kind="stable")
            hashes, endings = hashes[by_hash], endings[by_hash]
            place = np.empty(len(by_hash), np.int32)
            place[by_hash] = np.arange(len(by_hash), dtype=np.int32)
            codes = place[words.codes] if len(words.codes) else np.zeros(0, np.int32)
            n = np.diff(words.offsets)
            trained = codes[np.repeat(~held, n)]
            counts = np.bincount(trained, minlength=len(hashes))
            slack = int(len(trained) * rare)
            heavy = [{"h": int(hashes[k].view(np.int64)), "n": int(counts[k]), "e": int(endings[k])} for k in np.flatnonzero(counts > slack)]
            yield pa.RecordBatch.from_arrays(
                [
                    one(chunk, pa.int64()), one(int(len(trained) + (~held).sum()), pa.int64()), one(slack, pa.int64()), one(b.column("doc_id").to_pylist(), pa.list_(pa.int64())), one(held, pa.list_(pa.bool_())), one(np.asarray(b.column("t")), pa.list_(pa.int64())),
                    one(words.offsets, pa.list_(pa.int64())), one(len(hashes), pa.int32()), one(_planes(codes), pa.binary()), one(_planes(np.diff(hashes, prepend=np.uint64(0))), pa.binary()),
                    one(_planes(endings.astype(np.int16)), pa.binary()), one(_planes(counts.astype(np.int32)), pa.binary()), one(heavy, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64()), ("e", pa.int32())]))),
                    one(np.bincount(endings, weights=counts, minlength=ENDINGS).tobytes(), pa.binary()),
                ],
                ["chunk", "tokens", "slack", "doc_ids", "held", "draws", "offsets", "words", "codes", "hashes", "endings", "counts", "heavy", "by_ending"],
            )
            chunk += 1

    return run


class Chunk:
    """A coded chunk: ``hashes``, ``endings`` and ``of_word`` (the classes) of its words, ``codes`` and ``offsets`` of its texts."""

    def __init__(self, model: Model, b: pa.RecordBatch, k: int):
        self.get = lambda name: b.column(name)[k]
        n = self.get("words").as_py()
        self.hashes = np.cumsum(_numbers(self.get("hashes").as_buffer(), "<u8", n), dtype=np.uint64)
        self.endings = _numbers(self.get("endings").as_buffer(), "<i2", n)
        self.offsets, self.held = np.asarray(self.get("offsets").values), np.asarray(self.get("held").values)
        self.codes = _numbers(self.get("codes").as_buffer(), "<i4", int(self.offsets[-1]))
        self.of_word = model.class_of(self.hashes, self.endings)
        #: Words that share a class with others: those whose counts are exchanged.
        self.shared = np.flatnonzero(self.of_word > len(model.top))

    def sequences(self, classes: np.ndarray, end: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Texts as ``classes`` of their words, each with its ``end``, and their offsets; only those to ``keep``, if given."""
        n = np.diff(self.offsets)
        whole = np.insert(classes[self.codes], self.offsets[1:], end)
        if keep is None:
            return whole, np.concatenate([[0], np.cumsum(n + 1)])
        return whole[np.repeat(keep, n + 1)], np.concatenate([[0], np.cumsum((n + 1)[keep])])

    def parts(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """The shared words by part: ranges of hashes, so that each part's words lie together."""
        part = ((self.hashes[self.shared] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        used, first = np.unique(part, return_index=True)
        yield from zip(used.tolist(), np.split(self.shared, first[1:]), strict=True) if len(used) else ()


def _drawn(model: Model, share: float):
    """Classes and lengths of the start documents: training documents drawn by a hash of their ids and texts, which goes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(model, b, k)
                draw = mix(np.asarray(b.column("draws")[k].values).view(np.uint64))
                keep = ~c.held & (draw.astype(float) < share * 2.0**64)
                classes, ends = c.sequences(c.of_word, 0, keep)
                parts = classes.astype(np.int32), np.diff(ends), draw[keep]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["classes", "lengths", "draws"])

    return run


def _start_fit(model: Model):
    """A fit to the start documents in order of their hashes, wherever they were read."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
        classes, lengths, draws = join("classes", np.int32), join("lengths", np.int64), join("draws", np.uint64)
        start = np.cumsum(lengths) - lengths
        order = np.lexsort((lengths, draws))
        ends = np.concatenate([[0], np.cumsum(lengths[order])]).astype(np.int64)
        place = np.repeat(start[order] - ends[:-1], lengths[order]) + np.arange(ends[-1])
        got = fitted(model, classes[place], ends)
        return pa.table({"w": pa.array([np.concatenate([got.start, got.mean, got.move.ravel(), got.emit.ravel()]).tobytes()], pa.binary())})

    return run


def _candidate_counts(hashes: np.ndarray):
    """Training counts of some words (sorted hashes) in each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                n = b.column("words")[k].as_py()
                own = np.cumsum(_numbers(b.column("hashes")[k].as_buffer(), "<u8", n), dtype=np.uint64)
                counts = _numbers(b.column("counts")[k].as_buffer(), "<i4", n)
                at = np.minimum(np.searchsorted(own, hashes), max(0, n - 1))
                found = np.where(own[at] == hashes, counts[at], 0) if n else np.zeros(len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array([found.astype(float).tobytes()], pa.binary())], ["v"])

    return run


def _all_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n, e) of all training words of each chunk."""
    for b in batches:
        for k in range(b.num_rows):
            n = b.column("words")[k].as_py()
            own = np.cumsum(_numbers(b.column("hashes")[k].as_buffer(), "<u8", n), dtype=np.uint64)
            columns = own.view(np.int64), _numbers(b.column("counts")[k].as_buffer(), "<i4", n).astype(np.int64), _numbers(b.column("endings")[k].as_buffer(), "<i2", n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[columns[1] > 0]) for x in columns], ["h", "n", "e"])


def _most_frequent(coded: DataFrame) -> list[tuple[int, int, int]]:
    """(hash, training count, ending) of the TOP_WORDS most frequent words, ties to the smaller hash.

    Chunks give the words that aren't rare in them. A word may lack ``slack`` occurrences in each chunk, which bounds what its sum lacks: only those that may
    still be among the first are then counted exactly. Where nearly all are rare everywhere, every word is summed.
    """
    ordered = lambda words: words.orderBy(F.desc("n"), "h").limit(TOP_WORDS).collect()
    sums = cut(coded.select(F.explode("heavy").alias("x")).groupBy("x.h").agg(F.sum("x.n").alias("n"), F.max("x.e").alias("e")), "heavy")
    slack = coded.agg(F.coalesce(F.sum("slack"), F.lit(0))).first()[0]
    first = ordered(sums)
    if not slack:
        return [(r["h"], r["n"], r["e"]) for r in first]
    least = first[-1]["n"] if len(first) == TOP_WORDS else 0
    if least <= 2 * slack:
        words = coded.select("words", "hashes", "endings", "counts").mapInArrow(_all_counts, "h long, n long, e int").groupBy("h").agg(F.sum("n").alias("n"), F.max("e").alias("e"))
        return [(r["h"], r["n"], r["e"]) for r in ordered(words)]
    # Fewer than 1 / (least - slack) of all tokens' number.
    close = sums.where(F.col("n") + slack >= least).select("h", "e").collect()
    hashes = np.array([r["h"] for r in close], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counts = _vector_sum(coded.select("words", "hashes", "counts").mapInArrow(_candidate_counts(hashes[order]), "v binary"), len(hashes)).astype(np.int64)
    found = [(int(hashes[k].view(np.int64)), int(n), close[k]["e"]) for k, n in zip(order, counts, strict=True)]
    return sorted(found, key=lambda x: (-x[1], x[0]))[:TOP_WORDS]


def _count_pass(model: Model):
    """Slices of a task's sums over its training documents; the last number is the log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, long, size = 0.0, [], 0
        add = lambda parts: np.append(*counted(model, np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])))
        for b in batches:
            for k in range(b.num_rows):
                c = Chunk(model, b, k)
                classes, ends = c.sequences(c.of_word, 0, ~c.held)
                n = np.diff(ends)
                far = np.repeat(n > LONG, n)
                total = total + add([(classes[~far], n[n <= LONG])])
                # Long documents wait for others, as the recursion takes a step for each of their words.
                long.append((classes[far], n[n > LONG]))
                size += int(far.sum())
                if size >= BATCH:
                    total, long, size = total + add(long), [], 0
        if size:
            total = total + add(long)
        if not np.isscalar(total):
            yield _sliced(total)

    return run


_SUMS = "part int, chunk long, words int, hashes binary, endings binary, counts binary, expected binary"
_NAMES = [x.split()[0] for x in _SUMS.split(", ")]
_KINDS = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, _KINDS, strict=True)], _NAMES)


def _sliced(total: np.ndarray) -> pa.RecordBatch:
    """A task's sums in slices, as parts below 0: -1 - (slice * SALTS + salt)."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    return _sum_rows([(-1 - (j * SALTS + salt), j, 0, None, None, None, x.tobytes()) for j, x in enumerate(np.array_split(total, SLICES))])


def _slice_sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer()) for x in table.column("expected"))
    return pa.Table.from_batches([_sum_rows([(table.column("part")[0].as_py(), table.column("chunk")[0].as_py(), 0, None, None, None, total.tobytes())])])


def _whole(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of all slices: SLICES * SALTS rows reach the driver."""
    total = [0.0] * SLICES
    for r in rows.where("part < 0").select("chunk", "expected").collect():
        total[r["chunk"]] = total[r["chunk"]] + np.frombuffer(r["expected"])
    return np.concatenate(total) if not np.isscalar(total[0]) else np.zeros(size)


def _word_pass(model: Model, parts: int):
    """Training and expected counts of each chunk's shared words by part, and slices of a task's other sums; the last numbers are
    the log likelihood and the training counts of the classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, c = model.emit.shape
        small, total = 2 * k + k * k, np.zeros(2 * k + k * k + k * c + 1 + c)
        for b in batches:
            for i in range(b.num_rows):
                chunk = Chunk(model, b, i)
                trained, ends = chunk.sequences(np.arange(1, len(chunk.hashes) + 1), 0, ~chunk.held)
                classes = np.concatenate([[0], chunk.of_word])
                posterior = np.empty((len(trained), k), np.float32)
                counts, likelihood = counted(model, classes[trained], ends, posterior)
                np.rint(posterior * STEPS, out=posterior)
                by_word = np.stack([np.bincount(trained, weights=posterior[:, j], minlength=len(classes)) for j in range(k)], axis=1)
                seen = np.bincount(trained, minlength=len(classes))
                total[:small] += counts[:small]
                total[small : small + k * c] += np.concatenate([np.bincount(classes, weights=by_word[:, j], minlength=c) for j in range(k)]) / STEPS
                total[small + k * c] += likelihood
                total[small + k * c + 1 :] += np.bincount(classes, weights=seen, minlength=c)
                steps = by_word[1:].astype(np.int32)
                rows = [(p, chunk.get("chunk").as_py(), len(at), _planes(np.diff(chunk.hashes[at], prepend=np.uint64(0))), _planes(chunk.endings[at]), _planes(seen[1:][at].astype(np.int32)), _planes(steps[at])) for p, at in chunk.parts(parts)]
                yield _sum_rows(rows)
        yield _sliced(total)

    return run


def _word_sums(states: int):
    """Of a part: for each chunk its words' training and expected counts over all chunks, in the chunk's order, and (as chunk -1) the
    distinct training words of each ending; of slices: their sum."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            return _slice_sum(table)
        n = table.column("words").to_pylist()
        read = lambda name, kind, times=1: [_numbers(x.as_buffer(), kind, m * times) for x, m in zip(table.column(name), n, strict=True)]
        words, first, which = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in read("hashes", "<u8")]), return_index=True, return_inverse=True)
        counts = np.bincount(which, weights=np.concatenate(read("counts", "<i4")), minlength=len(words)).astype(np.int64)
        steps = np.concatenate(read("expected", "<i4", states)).reshape(-1, states)
        total = np.stack([np.bincount(which, weights=steps[:, j], minlength=len(words)) for j in range(states)], axis=1).astype(np.int64)
        rows = [(part, chunk, len(x), None, None, _planes(counts[x]), _planes(total[x])) for chunk, x in zip(table.column("chunk").to_pylist(), np.split(which, np.cumsum(n)[:-1]), strict=True)]
        endings = np.concatenate(read("endings", "<i2"))[first]
        rows.append((part, -1, 0, None, None, None, np.bincount(endings, weights=counts > 0, minlength=ENDINGS).tobytes()))
        return pa.Table.from_batches([_sum_rows(rows)])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Trained:
    """``model``; what each class's words, with one unseen, add up to in each state (``inside``); the training counts of classes,
    tokens and distinct tokens; and the number of parts that words' sums lie in."""

    model: Model
    inside: np.ndarray
    class_counts: np.ndarray
    tokens: int
    types: int
    parts: int

    def emitted(self, b: pa.RecordBatch, k: int) -> tuple[Chunk, np.ndarray, Model]:
        """A chunk, its words' training counts, and the model whose classes are the end (0) and the chunk's words."""
        model, states = self.model, len(self.model.start)
        c = Chunk(model, b, k)
        seen, expected, places = self.class_counts[c.of_word], np.zeros((len(c.hashes), states)), dict(c.parts(self.parts))
        for piece in b.column("found")[k].values if b.column("found")[k].is_valid else ():
            at = places[piece["part"].as_py()]
            seen[at] = _numbers(piece["counts"].as_buffer(), "<i8", len(at))
            expected[at] = _numbers(piece["expected"].as_buffer(), "<i8", len(at) * states).reshape(-1, states) / STEPS
        emit = model.emit[:, np.concatenate([[0], c.of_word])]
        emit[:, 1 + c.shared] *= (expected[c.shared].T + ALPHA) / self.inside[:, c.of_word[c.shared]]
        return c, seen, Model(model.start, model.mean, model.move, emit, model.top)


def _scorer(t: Trained):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ends_seen = t.tokens + ALPHA * (t.types + 1), t.class_counts[0]
        for b in batches:
            for k in range(b.num_rows):
                c, seen, words = t.emitted(b, k)
                plain, end = np.log10((seen + ALPHA) / total), np.log10((ends_seen + ALPHA) / total)
                n = np.diff(c.offsets)
                doc = np.repeat(np.arange(len(n)), n)
                add = lambda x: np.bincount(doc, weights=x[c.codes], minlength=len(n))  # noqa: B023, E731
                score = log10_likelihood(words, *c.sequences(np.arange(1, len(c.hashes) + 1), 0))
                known = add((seen > 0).astype(float)).astype(np.int64) + int(ends_seen > 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, pa.array(c.held), pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), t.tokens)), pa.array(add(plain) + end), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(x.as_buffer()) for b in batches for x in b.column("v"))
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _vector_sum(vectors: DataFrame, size: int = ENDINGS) -> np.ndarray:
    """Sum of vectors (v binary) of ``size`` numbers: one from each task reaches the next, and one from each of these the driver."""
    found = vectors.mapInArrow(_added, "v binary").repartition(SALTS).mapInArrow(_added, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in found), np.zeros(size))


def train(coded: DataFrame, states: int = STATES) -> tuple[Trained, DataFrame]:
    """Baum-Welch over all training documents: start values from documents drawn by a hash from all chunks, rounds of classes
    until the likelihood settles, and a round that counts every word in every state. Also ``coded`` with what its chunks' words
    have in all (found)."""
    spark = coded.sparkSession
    tokens, pairs = coded.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    heavy = _most_frequent(coded)
    top = np.array([h for h, _, _ in heavy], np.int64).view(np.uint64)
    order = np.argsort(top)
    top = top[order]
    # Frequencies of classes for the start: what the chunks' frequent words don't hold falls to the endings.
    frequency = np.concatenate([np.zeros(1 + len(top)), _vector_sum(coded.selectExpr("by_ending AS v"))])
    frequency[1 : 1 + len(top)] = np.array([n for _, n, _ in heavy], float)[order]
    for _, n, e in heavy:
        frequency[1 + len(top) + e] -= n
    frequency[0] = max(1.0, tokens - frequency[1:].sum())
    model = initial(np.maximum(frequency, 0), top, states)
    k, c = model.emit.shape
    size = 2 * k + k * k + k * c
    own = coded.select("chunk", "held", "offsets", "words", "codes", "hashes", "endings")
    if tokens:
        drawn = coded.select("chunk", "held", "draws", "offsets", "words", "codes", "hashes", "endings").mapInArrow(_drawn(model, min(1.0, START_TOKENS / tokens)), "classes binary, lengths binary, draws binary")
        w = np.frombuffer(drawn.groupBy().applyInArrow(_start_fit(model), "w binary").collect()[0]["w"])
        start, mean, move, emit = np.split(w, [k, 2 * k, 2 * k + k * k])
        model = Model(start, mean, move.reshape(k, k), emit.reshape(k, c), top)
    before = -np.inf
    while tokens:
        got = _whole(own.mapInArrow(_count_pass(model), _SUMS).groupBy("part").applyInArrow(_slice_sum, _SUMS), size + 1)
        model, now = model.updated(got[:size]), got[size] / tokens
        if not now - before >= SETTLED:
            break
        before = now
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // WORD_PAIRS))
    sums = cut(own.mapInArrow(_word_pass(model, parts), _SUMS).groupBy("part").applyInArrow(_word_sums(k), _SUMS), "sums", "uncompressed")
    got = _whole(sums, size + 1 + c)
    of_classes, class_types = got[size + 1 :], np.zeros(c)
    class_types[1 + len(top) :] = _vector_sum(sums.where("part >= 0 AND chunk = -1").selectExpr("expected AS v"))
    types = int(class_types.sum()) + int((of_classes[: 1 + len(top)] > 0).sum())
    inside = got[size - k * c : size].reshape(k, c) + ALPHA * (class_types + 1)
    found = sums.where("part >= 0 AND chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "expected")).alias("found"))
    backed = coded.drop("counts", "heavy", "by_ending", "draws", "slack").join(found, "chunk", "left")
    return Trained(model.updated(got[:size]), inside, of_classes, int(of_classes.sum()), types, parts), backed


def coded_documents(documents: DataFrame, rare: float = RARE) -> DataFrame:
    """Texts of ``documents`` (doc_id, text) as codes of words, a row for each chunk of them, in a work table."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("t"))
    docs = docs.withColumn("held", F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)))
    return cut(docs.mapInArrow(_coded(rare), _CODED), "coded", "uncompressed")


def score_documents(documents: DataFrame, states: int = STATES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``documents`` (doc_id, text).

    Words and one end a text are the tokens; those of rows whose crc32(doc_id) mod 10 is not 0 train. Texts are coded
    once, in chunks. Start values come from Baum-Welch on documents drawn by a hash of their ids and texts (about START_TOKENS). Then each
    round counts every training document over its whole length, first by class, until the likelihood settles, and last each word in
    each state. Counts of words (by a 64-bit hash) are summed by word, and each chunk gets back the sums of its own words only;
    those of the most frequent words are sums over classes, so no word's rows meet in one task for every chunk. All documents are
    scored over their whole length. How a table is divided into partitions and chunks changes no more than the rounding of sums. ``score`` is the model's log10 probability, where words not seen in training have, in each
    state and class, the mass of one more word without a count.

    Null or empty texts: the end alone. Null ids train. Repeated rows each count and are returned each. A very long text is a chunk of its
    own. Without training rows both scores are those of empty counts. An empty table gives an empty result; other columns are ignored.
    """
    trained, backed = train(coded_documents(documents), states)
    return backed.mapInArrow(_scorer(trained), _SCORED)
