"""Alignment of two tokenizers: texts are cut into segments that neither merges across, each different segment is tokenised and aligned once,
and alignments are joined back and composed to documents."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, spread_join
from .tokens import _byte_letters

#: Text whose segments are counted and coded together.
CHUNK = 12 << 20
#: White space that a cut may come before, if the vocabularies allow it.
CUTS = " \n\t"
_WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_SPACE = "\u2581"
#: Pairs of ids that are broadcast to the segments, the most frequent ones.
FEW_PAIRS = 500_000
_CODED = "chunk long, doc_ids array<long>, ends array<int>, codes binary, segments array<string>, counts array<int>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_loaded: dict[tuple[str, str], Pair] = {}


class Pair:
    """Two tokenizer files, loaded once in a worker: A is byte-level BPE, B is pieces with byte fallback that adds a space itself.

    ``cuts``: the white space characters w that a text may be cut before, where a character that isn't white space comes before w. Neither tokenizer
    can join the two: no token of either vocabulary holds such a character and then w, and merges make nothing but tokens of the vocabulary. A's
    pre-tokenizer also starts a new piece at every white space that follows something else. A segment that begins with
    another white space than a space gets a space from B, which is taken off again: no token holds a space and then w.
    """

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        back = {c: k for k, c in _byte_letters().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in some], np.int64) for some in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_SPACE)
        with open(a, encoding="utf-8") as f:
            form = json.load(f)
        plain = form["normalizer"] is None and form["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.cuts = "".join(w for w in CUTS if plain and self._parted(w, pieces))

    def _parted(self, w: str, pieces: list[str]) -> bool:
        def joins(token: str) -> bool:
            return any(y == w and (x not in _WHITE or (x == " " != w)) for x, y in zip(token, token[1:], strict=False))

        in_a = any(joins(x.decode("utf-8", "replace")) for k, x in enumerate(self.bytes_a) if w.encode() in x and x not in (b" " + w.encode(),))
        in_b = any(joins(p.replace(_SPACE, " ")) for k, p in enumerate(pieces) if not self.b.is_byte(k))
        return not in_a and not in_b and self.space != self.b.unk_id()

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments as they stand, without a space of its own."""
        ids = self.b.encode([s[1:] if s.startswith(" ") else s for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            if s == " ":
                ids[k] = [self.space]
            elif not s.startswith(" "):
                ids[k] = ids[k][1:] if ids[k][:1] == [self.space] else []
        return ids


def pair(a: str, b: str) -> Pair:
    if (a, b) not in _loaded:
        _loaded[a, b] = Pair(a, b)
    return _loaded[a, b]


def segmented(texts: pa.Array, cuts: str) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts, end to end, and each text's offsets among them. Texts begin with a space."""
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[: ends[-1]]
    allowed, white = np.zeros(256, bool), np.zeros(256, bool)
    allowed[list(cuts.encode())] = True
    white[[ord(c) for c in _WHITE if ord(c) < 128]] = True
    new = np.zeros(len(raw), bool)
    at = np.flatnonzero(allowed[raw])
    at = at[at > ends[0]]
    before = raw[at - 1]
    free = ~white[before]
    # White space outside ASCII ends in a byte of 128 and on: few places, looked at one by one.
    for k in np.flatnonzero(free & (before >= 128)):
        tail = raw[max(0, at[k] - 4) : at[k]].tobytes().decode("utf-8", "ignore")
        free[k] = tail[-1:] not in _WHITE
    new[at[free]] = True
    filled = ends[:-1][np.diff(ends) > 0]
    new[: ends[0]] = False
    new[filled] = True
    first = np.flatnonzero(new)
    offsets = np.searchsorted(first, ends)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, ends[-1]).astype(np.int64)), data), offsets


def _coded(a: str, b: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, cuts = TaskContext.get().partitionId() << 32, pair(a, b).cuts
        for batch in chunks(batches, limit=limit):
            texts = batch.column("text")
            spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
            flat, offsets = segmented(spaced, cuts)
            coded = flat.dictionary_encode()
            code = np.asarray(coded.indices).astype(np.int64)
            counts = np.bincount(code, minlength=len(coded.dictionary))
            # Frequent segments first: small codes, which compress well.
            order = np.argsort(-counts, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            blob = pa.compress(place[code].astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
            row = [[made], [batch.column("doc_id").to_pylist()], [offsets[1:].tolist()], [blob], [coded.dictionary.take(pa.array(order)).cast(pa.string())], [counts[order].tolist()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
            listed = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(t.value_type) if isinstance(x, pa.Array) else pa.array(x, t.value_type))
            columns = [listed(x[0], t) if pa.types.is_list(t) else pa.array(x, t) for x, t in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "doc_ids", "ends", "codes", "segments", "counts"])
            made += 1

    return run


def _ends(ids: list[list[int]], size: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids, the segment of each, and the byte at which it ends, counted from the first segment's."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((x for each in ids for x in each), np.int64, int(n.sum()))
    owner = np.repeat(np.arange(len(ids)), n)
    width = size[flat]
    reach = np.cumsum(width)
    before = np.concatenate([[0], reach])[np.concatenate([[0], np.cumsum(n)[:-1]])] if len(ids) else np.zeros(0, np.int64)
    return flat, owner, reach - before[owner] + base[owner]


def _aligned(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(a, b)
        for batch in chunks(batches, "segment", 1 << 20):
            segments = batch.column("segment").to_pylist()
            raw = [s.encode() for s in segments]
            of_a = [e.ids for e in both.a.encode_batch_fast(segments, add_special_tokens=False)]
            of_b = both.encode_b(segments)
            good = np.array([b"".join([both.bytes_a[k] for k in x]) == r == b"".join([both.bytes_b[k] for k in y]) for x, y, r in zip(of_a, of_b, raw, strict=True)], bool)
            of_a = [x if fine else [] for x, fine in zip(of_a, good.tolist(), strict=True)]
            of_b = [y if fine else [] for y, fine in zip(of_b, good.tolist(), strict=True)]
            base = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            a_ids, a_of, a_end = _ends(of_a, both.size_a, base)
            b_ids, b_of, b_end = _ends(of_b, both.size_b, base)
            common = np.intersect1d(a_end, b_end, assume_unique=True)
            columns = [batch.column("segment"), batch.column("n"), _packed(a_ids, np.searchsorted(common, a_end), b_ids, np.searchsorted(common, b_end), a_of, b_of, len(raw))]
            yield pa.RecordBatch.from_arrays(columns, ["segment", "n", "tokens"])

    return run


def _packed(a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray, a_of: np.ndarray, b_of: np.ndarray, many: int) -> pa.Array:
    """Each segment's tokens, group by group A's and then B's, three bytes each: twice the id, and one more for B's."""
    groups = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
    of_a, of_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    flat = np.empty(len(a_ids) + len(b_ids), "<u4")
    flat[np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[a_group]] = a_ids << 1
    flat[np.arange(len(b_ids)) + np.cumsum(of_a)[b_group]] = (b_ids << 1) | 1
    n = np.bincount(a_of, minlength=many) + np.bincount(b_of, minlength=many)
    ends = np.concatenate([[0], np.cumsum(n)]) * 3
    return pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.view(np.uint8).reshape(-1, 4)[:, :3].tobytes())])


class Tokens:
    """Packed tokens of several segments, end to end: ids, whether each is B's, the segment of each, and where groups begin and end."""

    def __init__(self, packed: pa.Array):
        packed = packed.cast(pa.large_binary())
        n = np.asarray(pc.binary_length(packed)).astype(np.int64) // 3
        _, ends, data = packed.buffers()
        first = int(np.frombuffer(ends, np.int64)[packed.offset]) if len(packed) else 0
        raw = np.frombuffer(data, np.uint8)[first : first + 3 * int(n.sum())].reshape(-1, 3).astype(np.int64) if data is not None else np.zeros((0, 3), np.int64)
        value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        self.many, self.ids, self.of_b = len(packed), value >> 1, (value & 1).astype(bool)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.ends = np.concatenate([[0], np.cumsum(n)])
        self.starts = ~self.of_b & np.append(True, self.of_b[:-1])[: len(self.ids)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The last ids of each group, A's and B's in one number, and the segment of each."""
        last_a = ~self.of_b & np.append(self.of_b[1:], False)[: len(self.ids)]
        last_b = self.of_b & np.append(self.starts[1:], True)[: len(self.ids)]
        return (self.ids[last_a] << 32) | self.ids[last_b], self.owner[last_b]

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's tokens, B's tokens and groups of each segment."""
        return tuple(np.bincount(self.owner[x], minlength=self.many) for x in (~self.of_b, self.of_b, self.starts))

    def written(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each segment."""
        before = np.where(self.starts, ";", np.where(self.of_b & ~np.append(False, self.of_b[:-1])[: len(self.ids)], "|", ",")).astype(object)
        before[self.ends[:-1][np.diff(self.ends) > 0]] = ""
        each = pc.binary_join_element_wise(pa.array(before, pa.string()), pa.array(self.ids).cast(pa.string()), "")
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), each), "").to_pylist()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(link, count, rows): how often the links of a batch of segments occur in the texts, and how many segments hold them."""
    for batch in batches:
        link, owner = Tokens(batch.column("tokens")).links()
        distinct, of = np.unique(link, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        np.add.at(count, of, np.asarray(batch.column("n"))[owner])
        rows = np.bincount(np.unique(np.column_stack([of, owner]), axis=0)[:, 0], minlength=len(distinct)) if len(of) else count
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(count), pa.array(rows.astype(np.int64))], ["link", "count", "rows"])


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, tokens, link, times): each link of a segment once; the segment's tokens stand beside the first of them."""
    for batch in batches:
        link, owner = Tokens(batch.column("tokens")).links()
        each, times = np.unique(np.column_stack([owner, link]), axis=0, return_counts=True)
        first = np.append(True, each[1:, 0] != each[:-1, 0])[: len(each)]
        at = pa.array(each[:, 0])
        tokens = pc.if_else(pa.array(first), batch.column("tokens").take(at), pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("segment").take(at), tokens, pa.array(each[:, 1]), pa.array(times.astype(np.int64))], ["segment", "tokens", "link", "times"])


def _codes(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a chunk and each document's offsets."""
    ends = np.concatenate([[0], np.asarray(row.column("ends")[0].values)]).astype(np.int64)
    raw = pa.decompress(row.column("codes")[0].as_py(), decompressed_size=int(ends[-1]) * 4, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint32).astype(np.int64), ends


def _of_refused(bad: pa.Table, row: pa.Table) -> pa.Table:
    """(segment, n): less by the occurrences in documents that hold a segment whose bytes differ."""
    code, ends = _codes(row)
    segments = row.column("segments")[0].values
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    hit = np.zeros(len(segments), bool)
    hit[np.asarray(bad.column("code"))] = True
    refused = np.zeros(len(ends) - 1, bool)
    refused[owner[hit[code]]] = True
    n = np.bincount(code[refused[owner]], minlength=len(segments))
    at = np.flatnonzero(n)
    return pa.table({"segment": segments.take(pa.array(at)), "n": pa.array(-n[at].astype(np.int64))})


#: Rows whose alignments are gathered by chunk before they are shuffled, and bytes from which a piece of them is compressed.
GATHERED, SMALL = 400_000, 256
_FIELDS = (("code", "<u4"), ("width", "<u4"), ("n_best", "<i8"), ("count_sum", "<i8"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, many, size, piece): the rows of a chunk among the next GATHERED ones in one value, column by column, which takes half the room
    of the rows; ``size`` is that of a compressed piece, else 0."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            yield _pieces(pa.Table.from_batches(held).combine_chunks())
            held, rows = [], 0
    if rows:
        yield _pieces(pa.Table.from_batches(held).combine_chunks())


def _pieces(rows: pa.Table) -> pa.RecordBatch:
    rows = rows.take(pa.array(np.lexsort((np.asarray(rows["code"]), np.asarray(rows["chunk"])))))
    chunk, tokens = np.asarray(rows["chunk"]), rows["tokens"].combine_chunks().cast(pa.large_binary())
    values = {n: np.asarray(pc.binary_length(tokens) if n == "width" else rows[n]).astype(t) for n, t in _FIELDS}
    _, ends, data = tokens.buffers()
    ends, first = np.frombuffer(ends, np.int64)[tokens.offset :], np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
    sizes, blobs = [], []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(chunk)], strict=True):
        raw = b"".join([*(v[lo:hi].tobytes() for v in values.values()), memoryview(data)[ends[lo] : ends[hi]]])
        sizes.append(len(raw) if len(raw) >= SMALL else 0)
        blobs.append(pa.compress(raw, codec="zstd", asbytes=True) if len(raw) >= SMALL else raw)
    many = np.diff(np.append(first, len(chunk))).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(chunk[first]), pa.array(many), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "many", "size", "piece"])


def _opened(pieces: pa.Table) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The columns of all pieces, end to end, and their packed tokens."""
    found, tokens = {n: [np.zeros(0, t)] for n, t in _FIELDS}, []
    for many, size, piece in zip(*(pieces[c].to_pylist() for c in ("many", "size", "piece")), strict=True):
        raw, at = pa.decompress(piece, decompressed_size=size, codec="zstd", asbytes=True) if size else piece, 0
        for n, t in _FIELDS:
            found[n].append(np.frombuffer(raw, t, many, at))
            at += found[n][-1].nbytes
        tokens.append(raw[at:])
    columns = {n: np.concatenate(x).astype(np.int64) for n, x in found.items()}
    ends = np.concatenate([[0], np.cumsum(columns["width"])]).astype(np.int64)
    return columns, pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(tokens))])


def _composed(row: pa.Table, pieces: pa.Table) -> pa.Table:
    """The documents of a chunk from its segments' alignments; a segment that isn't among these has none."""
    code, ends = _codes(row)
    columns, packed = _opened(pieces)
    of = columns["code"]
    place = np.full(int(code.max(initial=-1)) + 1, len(of))
    place[of] = np.arange(len(of))
    code = place[code]
    tokens = Tokens(packed)
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(np.append(v, 0)[code])])[ends])
    good = np.diff(np.concatenate([[0], np.cumsum(code == len(of))])[ends]) == 0
    n_a, n_b, n_groups = tokens.counts()
    sums = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups, "n_best": columns["n_best"], "count_sum": columns["count_sum"]}
    sums = {c: np.where(good, total(v), 0).astype(np.int64) for c, v in sums.items()}
    said = tokens.written()
    groups = [";".join([said[k] for k in code[s:e].tolist()]) if fine else "" for s, e, fine in zip(ends[:-1].tolist(), ends[1:].tolist(), good.tolist(), strict=True)]
    return pa.table({"doc_id": row.column("doc_ids")[0].values, **sums, "groups": pa.array(groups, pa.string())})


def align(documents: DataFrame, a: str, b: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row: its text in the two tokenizers, group by group.

    A encodes a space and the text, B the text, to which it adds the space; special tokens' strings are plain text. Byte offsets at which a token of both ends cut the tokens
    into groups (``groups``: ``a1,a2|b1;a3|b2,b3``); the last tokens of a group are linked. ``n_best`` counts links whose pair of ids is, of all pairs with its B
    id, linked most often in all rows (ties included), ``count_sum`` sums how often the links' pairs are linked in all rows.

    Chunks of texts are coded over their own segments; different segments are counted over all chunks, aligned once, scored, and joined back to the chunks that hold
    them. Nearly every segment may hold the same pair: see ``spread_join``. A segment joins a row for each chunk, so none has more than a small share of them. Whole texts are aligned as one segment where the vocabularies
    allow no cut (see ``Pair``).

    Null and empty texts have no tokens: zeros and an empty ``groups``; so do texts that B doesn't give back byte by byte (those that hold U+2581), and their links count nowhere. Repeated
    rows and null ids give a row each and count each. A very long text is a chunk of its own. An empty table gives an empty result. Other columns are
    ignored.
    """
    rows = documents.selectExpr("CAST(doc_id AS long) AS doc_id", "text")
    coded = cut(rows.mapInArrow(_coded(a, b, chunk_bytes), _CODED), "coded")
    each = coded.select("chunk", F.posexplode(F.arrays_zip("segments", "counts")).alias("code", "x")).select("chunk", "code", F.col("x.segments").alias("segment"), F.col("x.counts").alias("n"))
    distinct = each.groupBy("segment").agg(F.sum("n").alias("n"))
    aligned = cut(distinct.mapInArrow(_aligned(a, b), "segment string, n long, tokens binary"), "aligned")
    counted = aligned.where("length(tokens) > 0")
    refused = aligned.where("length(tokens) = 0")
    if not refused.isEmpty():
        wrong = each.select("chunk", "code", F.col("segment").alias("s")).join(refused, F.col("s") == F.col("segment"), "left_semi").select("chunk", "code")
        held = coded.select(F.col("chunk").alias("of"), "ends", "codes", "segments").join(wrong, F.col("of") == F.col("chunk"), "left_semi")
        less = wrong.groupBy("chunk").cogroup(held.groupBy("of")).applyInArrow(_of_refused, "segment string, n long")
        less = less.groupBy(F.col("segment").alias("s")).agg(F.sum("n").alias("less"))
        counted = counted.join(less, F.col("segment") == F.col("s"), "left").select("segment", (F.col("n") + F.coalesce("less", F.lit(0))).alias("n"), "tokens")
    pairs = counted.select("n", "tokens").mapInArrow(_linked, "link long, count long, rows long").groupBy("link").agg(F.sum("count").alias("count"), F.sum("rows").alias("rows"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND((1 << 32) - 1))  # at most A's vocabulary in one
    pairs = cut(pairs.withColumn("best", F.col("count") == F.max("count").over(of_b)), "pairs")
    links = aligned.where("length(tokens) > 0").select("segment", "tokens").mapInArrow(_link_rows, "segment string, tokens binary, link long, times long")
    best, count_sum = F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))), F.sum(F.col("count") * F.col("times"))
    # Grouped and joined by segment: one exchange of the aligned segments.
    scored = spread_join(links, pairs, ["link"], "rows", most=FEW_PAIRS).groupBy("segment").agg(F.first("tokens", ignorenulls=True).alias("tokens"), best.alias("n_best"), count_sum.alias("count_sum"))
    scored = scored.withColumnRenamed("segment", "s").hint("merge")
    parts = each.select("chunk", "code", "segment").join(scored, F.col("segment") == F.col("s")).select("chunk", "code", "tokens", "n_best", "count_sum")
    pieces = parts.mapInArrow(_gathered, "chunk long, many long, size long, piece binary")
    documents_of = coded.select(F.col("chunk").alias("of"), "doc_ids", "ends", "codes")
    return documents_of.groupBy("of").cogroup(pieces.groupBy("chunk")).applyInArrow(_composed, _RESULT)


def digest(found: DataFrame) -> DataFrame:
    """The rows of ``align`` with a hash of their groups instead ('' without tokens)."""
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("n_groups") == 0, F.lit("")).otherwise(F.sha2(F.col("groups"), 256)).alias("groups_sha256"))
