"""Token ids of a public word-end BPE file, a batch of texts at a time.

The ids equal those of the ``tokenizers`` library for the same file. Each distinct word of a batch is merged once, all
words together as arrays; what lies outside plain letters, digits and signs goes through the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0  -‏ -  -⁤　﻿]|<\\|(?:start|end)oftext\\|>")
_LONGEST = 40
#: Of a byte of plain text: 0 letter (all of Latin-1's two-byte letters too), 1 digit, 2 sign.
_KIND = np.array([1 if 48 <= b < 58 else 0 if 97 <= b < 123 or b >= 128 else 2 for b in range(256)], np.int8)
_loaded: dict[str, WordBpe] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """Encoder of one tokenizer file, loaded once in a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + model["end_of_word_suffix"]] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.width = np.uint64(len(vocab) + 1)
        keys = np.array([vocab[a] for a, _ in pairs], np.uint64) * self.width + np.array([vocab[b] for _, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [-1], np.int32)
        self.none = len(pairs)
        self.bits = 18
        self.slots = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        self.reach = 0
        for k, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist(), strict=True)):
            step = 0
            while self.slots[(slot + step) % len(self.slots)] != np.iinfo(np.uint64).max:
                step += 1
            self.slots[(slot + step) % len(self.slots)], self.ranks[(slot + step) % len(self.slots)] = key, k
            self.reach = max(self.reach, step)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids; ``none`` where there is no such merge."""
        keys = a.astype(np.uint64) * self.width + b.astype(np.uint64)
        slot = self._slot(keys)
        held = self.slots[slot]
        rank = np.where(held == keys, self.ranks[slot], self.none).astype(np.int32)
        open_ = np.flatnonzero((held != keys) & (held != np.iinfo(np.uint64).max))
        for _ in range(self.reach):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.slots)
            held = self.slots[slot[open_]]
            hit = held == keys[open_]
            rank[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.iinfo(np.uint64).max)]
        return rank

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply merges to words of one length (a row each); the ids, left-aligned, and how many each row has."""
        n, width = ids.shape
        count = np.full(n, width)
        if width < 2:
            return ids, count
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        rows, out = np.arange(n), ids.copy()
        cols = np.arange(width)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            going = best < self.none
            done = ~going
            out[rows[done]] = ids[done]
            rows, ids, rank, at, best = rows[going], ids[going], rank[going], at[going], best[going]
            if not len(rows):
                break
            k = np.arange(len(rows))
            shift = np.minimum(cols[None, :] + (cols[None, :] > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, axis=1)
            ids[k, at] = self.made[best]
            count[rows] -= 1
            left = count[rows]
            moved = np.minimum(cols[None, :-1] + (cols[None, :-1] > at[:, None]), width - 2)
            rank = np.take_along_axis(rank, moved, axis=1)
            rank[cols[None, :-1] >= left[:, None] - 1] = self.none
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < left - 1)
            rank[after, at[after]] = self._rank(ids[after, at[after]], ids[after, at[after] + 1])
        return out, count

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of words already split and lower-cased, each of bytes that stand for themselves."""
        n = len(words)
        size = np.asarray(pc.binary_length(words)).astype(np.int64)
        words = words.cast(pa.large_string())
        _, ends, data = words.buffers()
        start = np.frombuffer(ends, np.int64)[words.offset : words.offset + n]
        raw = np.frombuffer(data, np.uint8)
        count = np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(size):
            at = np.flatnonzero(size == width)
            if width > _LONGEST:
                each = [np.array(self.library.encode(words[int(k)].as_py(), add_special_tokens=False).ids, np.int32) for k in at]
                for k, x in zip(at, each, strict=True):
                    count[k] = len(x)
                    kept.append((np.array([k]), x[None, :], np.array([len(x)])))
                continue
            for some in np.array_split(at, max(1, len(at) * int(width) // 2_000_000)):
                letters = raw[start[some][:, None] + np.arange(width)]
                ids = self.inner[letters]
                ids[:, -1] = self.final[letters[:, -1]]
                ids, left = self._merge(ids)
                count[some] = left
                kept.append((some, ids, left))
        offsets = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(offsets[-1], np.int32)
        for at, ids, left in kept:
            cols = np.arange(ids.shape[1])[None, :]
            inside = cols < left[:, None]
            flat[(offsets[at][:, None] + cols)[inside]] = ids[inside]
        return flat, offsets

    @staticmethod
    def _runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Letter runs, digits and sign runs of plain words without quotes, and each one's word."""
        words = words.cast(pa.large_string())
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(words) + 1]
        kind = _KIND[np.frombuffer(data, np.uint8)[: ends[-1]]] if len(words) and ends[-1] else np.zeros(0, np.int8)
        first = np.zeros(len(kind), np.int64)
        np.add.at(first, ends[:-1][np.diff(ends) > 0], 1)
        new = first > 0
        new[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        at = np.flatnonzero(new)
        filled = np.flatnonzero(np.diff(ends) > 0)
        runs = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(kind)).astype(np.int64)), data)
        return runs, filled[np.cumsum(first)[at] - 1]

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of distinct runs between white space."""
        plain = np.asarray(pc.match_substring_regex(words, _PLAIN)) if len(words) else np.zeros(0, bool)
        quoted = np.asarray(pc.match_substring(words, "'")) if len(words) else np.zeros(0, bool)
        easy = np.flatnonzero(plain & ~quoted)
        runs, owner = self._runs(pc.utf8_lower(words.take(pa.array(easy))))
        pieces: list[str] = []
        of_pieces: list[int] = []
        odd: dict[int, list[int]] = {}
        for k in np.flatnonzero(~plain | quoted):
            word = words[int(k)].as_py()
            if plain[k]:
                found = _PIECES.findall(word.lower())
                pieces += found
                of_pieces += [int(k)] * len(found)
            else:
                odd[int(k)] = self.library.encode(word, add_special_tokens=False).ids
        coded = pa.concat_arrays([runs, pa.array(pieces, pa.large_string())]).dictionary_encode()
        ids, ends = self._words(coded.dictionary)
        piece = np.asarray(coded.indices).astype(np.int64)
        place = np.concatenate([easy[owner], np.array(of_pieces, np.int64)])
        order = np.argsort(place, kind="stable")
        flat, owner_of = gather(ids, ends, piece[order], place[order])
        if odd:
            flat = np.concatenate([flat, *[np.array(x, np.int32) for x in odd.values()]])
            owner_of = np.concatenate([owner_of, *[np.full(len(x), k) for k, x in odd.items()]])
            order = np.argsort(owner_of, kind="stable")
            flat, owner_of = flat[order], owner_of[order]
        return flat, np.concatenate([[0], np.cumsum(np.bincount(owner_of, minlength=len(words)))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and each text's offsets. No special ids are added."""
        strange = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _ODD.pattern)))
        split = pc.ascii_split_whitespace(texts)
        owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(split)))
        coded = split.flatten().dictionary_encode()
        ids, ends = self._distinct(coded.dictionary)
        code = np.asarray(coded.indices).astype(np.int64)
        if len(strange):
            keep = ~np.isin(owner, strange)
            code, owner = code[keep], owner[keep]
        flat, owner_of = gather(ids, ends, code, owner)
        if len(strange):
            each = [np.array(self.library.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.int32) for k in strange]
            flat = np.concatenate([flat, *each])
            owner_of = np.concatenate([owner_of, np.repeat(strange, [len(x) for x in each])])
            order = np.argsort(owner_of, kind="stable")
            flat, owner_of = flat[order], owner_of[order]
        return flat, np.concatenate([[0], np.cumsum(np.bincount(owner_of, minlength=len(texts)))]).astype(np.int64)


def gather(ids: np.ndarray, ends: np.ndarray, code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each code in turn, and the owner of each id."""
    n = np.diff(ends)[code]
    total = int(n.sum())
    first = np.repeat(np.asarray(ends)[:-1][code] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(code) else np.zeros(0, np.int64), n)
    return ids[first + np.arange(total)] if total else np.zeros(0, np.int32), np.repeat(owner, n)


def word_bpe(path: str) -> WordBpe:
    """The encoder of a file, one for each worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
