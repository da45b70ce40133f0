"""Structure and measures of reports as Arrow functions: a report has few kinds of sentences, and each different one is read once in a Python worker."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from . import dims
from .text import WHITE

_NARROW = tuple(zip(*dims.PUNCTUATION, strict=True))
_SPACE, _ODD_ENDS = " \t\n\x0b\f\r", ("\x85", "\u2028", "\u2029")
_SECTION = {label: re.compile(rf"(?:^|(?<=[\n\x85\u2028\u2029])){label}[{_SPACE}]*:[{_SPACE}]*([^\n\r\x85\u2028\u2029]+)") for label in ("描述", "初步诊断")}
_DIGITS = frozenset("0123456789")
_COUNTED, _MACULA, _OCCLUSION, _CROSSING = (re.compile(p) for p in (dims.COUNTED_PATTERN, dims.MACULA_PATTERN, dims.OCCLUSION_PATTERN, dims.CROSSING_PATTERN))
_RATIO = re.compile(dims.RATIO_PATTERN.replace(r"\s", r"[ \t\x0b\f\r]"))
_NAMES = {kind: re.search(r"可见(?:\(散在\|大量\)\?)?\(([^()?]*)\)\$$", p)[1].split("|") for kind, p in (("视网膜", dims.COUNTED_PATTERN), ("黄斑处", dims.MACULA_PATTERN))}
#: All findings and places in order: sets of them are whole numbers, a bit each.
FINDINGS = tuple(sorted({*dims.DIRECT_FINDINGS.values(), dims.OCCLUSION_FINDING, dims.CROSSING_FINDING, *(f"{kind}:{n}" for kind, names in _NAMES.items() for n in names)}))
PLACES = tuple(sorted(dims.PLACE_ORDER))
_FINDING_BIT, _PLACE_BIT = ({x: 1 << k for k, x in enumerate(of)} for of in (FINDINGS, PLACES))
#: Longest sentence and line of labels that are remembered, in signs, and how many.
_LONGEST, _SENTENCES, _LINES = 512, 16_384, 4096


def normalized(text: str | None) -> list[str]:
    """The lines of ``text.normalized``."""
    text = text or ""
    for wide, narrow in _NARROW:
        text = text.replace(wide, narrow)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [x for x in [line.strip(WHITE) for line in text.split("\n")] if x]


def section(lines: list[str], label: str) -> str:
    """``text.section`` of the text with these lines."""
    for line in lines:
        if line.startswith(label):
            if line.startswith(":", len(label)) and len(line) > len(label) + 1 and not _odd(lines):
                return line[len(label) + 1 :].strip(WHITE)
            break
    else:
        if not _odd(lines):
            return ""
    found = _SECTION[label].search("\n".join(lines))
    return found[1].strip(WHITE) if found else ""


def _odd(lines: list[str]) -> bool:
    """Whether the lines hold ends of lines that patterns know, but that don't part them."""
    for line in lines:
        for end in _ODD_ENDS:
            if end in line:
                return True
    return False


def _places(found: str | None) -> int:
    mask = 0
    for place in found.split("、") if found else ():
        mask |= _PLACE_BIT[place]
    return mask


#: What a sentence says: (finding, places, bucket's key, bucket, ratio, whether it ends with a digit).
_NOTHING = (0, 0, None, None, None, False)


def _kind(piece: str) -> tuple:
    sentence = piece.strip(" ,")
    if finding := dims.DIRECT_FINDINGS.get(sentence):
        return _FINDING_BIT[finding], *_NOTHING[1:]
    if m := _COUNTED.fullmatch(sentence):
        return _FINDING_BIT[f"视网膜:{m[3]}"], _places(m[1]), f"视网膜|{m[3]}|{m[1] or dims.NO_PLACE}", m[2] or dims.PLAIN_BUCKET, None, False
    if m := _MACULA.fullmatch(sentence):
        return _FINDING_BIT[f"黄斑处:{m[1]}"], *_NOTHING[1:]
    if m := _OCCLUSION.fullmatch(sentence):
        return _FINDING_BIT[dims.OCCLUSION_FINDING], _places(m[1]), *_NOTHING[2:]
    if _CROSSING.fullmatch(sentence):
        return _FINDING_BIT[dims.CROSSING_FINDING], *_NOTHING[1:]
    ratio = float(m[1]) if (m := _RATIO.fullmatch(sentence)) else None
    return 0, 0, None, None, ratio, piece[-1:] in _DIGITS


_known: dict[str, tuple] = {}


def _kind_of(piece: str) -> tuple:
    kind = _known.get(piece)
    if kind is None:
        kind = _kind(piece)
        if len(piece) <= _LONGEST and len(_known) < _SENTENCES:
            _known[piece] = kind
    return kind


def described(line: str) -> tuple[int, int, dict[str, str], float | None]:
    """(findings, places, bucket of each key, ratio) of a description; of equal keys the last counts, and the last ratio. Its sentences are those of
    ``text.sentences_of``: a stop between digits is a decimal point."""
    findings, places, buckets, last, known = 0, 0, {}, None, _known
    for part in line.split(";") if ";" in line else (line,):
        begun = None  # what stands before a stop, if that ends with a digit
        pieces = part.split(".")
        pieces.append("")  # an end that no digit follows
        for piece in pieces:
            if begun is not None:
                if piece[:1] in _DIGITS:
                    piece, begun = f"{begun}.{piece}", None
                else:
                    if (ratio := _kind_of(begun)[4]) is not None:
                        last = ratio
                    begun = None
            finding, where, key, bucket, ratio, digit = known.get(piece) or _kind_of(piece)
            if digit:
                begun = piece
                continue
            findings |= finding
            places |= where
            if key is not None:
                buckets[key] = bucket
            elif ratio is not None:
                last = ratio
    return findings, places, buckets, last


def _labels(diagnosis: str) -> list[str]:
    return sorted({x for x in [part.strip(WHITE) for part in diagnosis.split("、")] if x})


_short_labels = lru_cache(_LINES)(_labels)


def report(text: str | None, like: tuple | None = None) -> tuple:
    """(lines, description, diagnosis, labels, format, findings, places, buckets, ratio) of a raw report; labels are a sorted list that must not be changed.
    ``like`` is another report that may have the same description."""
    lines = normalized(text)
    description, diagnosis = section(lines, "描述"), section(lines, "初步诊断")
    labels = _short_labels(diagnosis) if len(diagnosis) <= _LONGEST else _labels(diagnosis)
    good = len(lines) == 2 and lines[0].startswith("描述:") and lines[1].startswith("初步诊断:")
    return lines, description, diagnosis, labels, good, *(like[5:] if like is not None and like[1] == description else described(description))


def _set_f1(a: int, b: int) -> float:
    if not a and not b:
        return 1.0
    shared = (a & b).bit_count()
    if not shared:
        return 0.0
    p, r = shared / a.bit_count(), shared / b.bit_count()
    return 2 * p * r / (p + r)


def measures(p: tuple, r: tuple) -> tuple[float, ...]:
    """``score.MEASURES`` of a predicted and a true ``report``."""
    _, p_text, _, p_labels, good, p_findings, p_places, p_buckets, p_ratio = p
    _, r_text, _, r_labels, _, r_findings, r_places, r_buckets, r_ratio = r
    near = 0.0 if r_ratio is None else 1.0 if p_ratio is None else abs(p_ratio - r_ratio)
    hit = p_ratio is None if r_ratio is None else p_ratio is not None and near <= dims.RATIO_TOLERANCE
    same = 1.0 if p_buckets is r_buckets and r_buckets else len(p_buckets.items() & r_buckets.items()) / len(r_buckets) if r_buckets else float(not p_buckets)
    return float(good), float(p_labels == r_labels), float(p_text == r_text), _set_f1(p_findings, r_findings), _set_f1(p_places, r_places), same, near, float(hit)


@lru_cache(_LINES)
def _listed(mask: int, names: tuple[str, ...]) -> list[str]:
    return [x for k, x in enumerate(names) if mask >> k & 1]


def texts(column: pa.Array) -> list[str | None]:
    """A column's texts; bytes that aren't UTF-8 are replaced, as Spark's patterns do."""
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except (UnicodeDecodeError, pa.ArrowException):
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()]


def lists(column: pa.Array) -> list[tuple[str | None, ...]]:
    """The lists of a column as tuples; null is an empty one."""
    values, at = texts(column.values), column.offsets.to_pylist()
    if column.null_count:
        there = column.is_valid().to_pylist()
        return [tuple(values[a:b]) if x else () for a, b, x in zip(at, at[1:], there, strict=False)]
    return [tuple(values[a:b]) for a, b in zip(at, at[1:], strict=False)]


_STRINGS = pa.list_(pa.string())
_BUCKETS = pa.list_(pa.struct([("key", pa.string()), ("bucket", pa.string())]))


def _columns(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.StructArray:
    by_field = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(by_field, types.values(), strict=True)], list(types))


_REPORT = {"norm": pa.string(), "description": pa.string(), "diagnosis": pa.string(), "labels": _STRINGS, "format": pa.bool_(), "findings": _STRINGS, "places": _STRINGS, "buckets": _BUCKETS, "ratio": pa.float64()}


def parsed_report():
    """The fields of ``parse.parsed`` of a report."""

    @F.arrow_udf("norm string, description string, diagnosis string, labels array<string>, format boolean, findings array<string>, places array<string>, buckets array<struct<key:string,bucket:string>>, ratio double")
    def run(s: pa.Array) -> pa.Array:
        rows = []
        for text in texts(s):
            lines, *found, findings, places, buckets, ratio = report(text)
            rows.append(("\n".join(lines), *found, _listed(findings, FINDINGS), _listed(places, PLACES), [{"key": k, "bucket": buckets[k]} for k in sorted(buckets)], ratio))
        return _columns(rows, _REPORT)

    return run


def measured(names: tuple[str, ...], labels: tuple[str, str]):
    """struct of the measures, by ``names``, and both label lists of a prediction and its reference; equal texts are read once."""
    types = dict.fromkeys(names, pa.float64()) | dict.fromkeys(labels, _STRINGS)

    @F.arrow_udf(", ".join([f"{n} double" for n in names] + [f"{n} array<string>" for n in labels]))
    def run(prediction: pa.Array, reference: pa.Array) -> pa.Array:
        rows = []
        for said, true in zip(texts(prediction), texts(reference), strict=True):
            r = report(true)
            p = r if said == true else report(said, r)
            rows.append((*measures(p, r), p[3], r[3]))
        return _columns(rows, types)

    return run


def _share(found: list[str], gold: tuple[str | None, ...]) -> float:
    """``score.set_f1`` of a sorted set and of another's different values."""
    if not found and not gold:
        return 1.0
    shared = len(set(found).intersection(gold))
    if not shared:
        return 0.0
    p, r = shared / len(found), shared / len(gold)
    return 2 * p * r / (p + r)


#: JSON of buckets as ``reward.gold_fields`` writes it, which needs no decoding.
PLAIN_BUCKETS = r'^\{(?:"[^"\\\x00-\x1f]*": "[^"\\\x00-\x1f]*"(?:, "[^"\\\x00-\x1f]*": "[^"\\\x00-\x1f]*")*)?\}\z'


def _plain_buckets(source: str) -> list[tuple[str, str]]:
    pieces = source.split('"')
    return list(zip(pieces[1::4], pieces[3::4], strict=True))


def measured_against(names: tuple[str, ...]):
    """struct of the measures, by ``names``, of a completion against what is known of the truth: its labels, description, findings and places (lists of different
    values), buckets as JSON (see ``PLAIN_BUCKETS``) or, decoded, as a list of (key, bucket), and ratio."""
    types = dict.fromkeys(names, pa.float64())

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(completion: pa.Array, labels: pa.Array, description: pa.Array, findings: pa.Array, places: pa.Array, plain: pa.Array, decoded: pa.Array, ratio: pa.Array) -> pa.Array:
        others = decoded.to_pylist() if decoded.null_count < len(decoded) else [None] * len(decoded)
        rows = []
        for said, r_labels, r_text, r_findings, r_places, source, other, r_ratio in zip(texts(completion), lists(labels), texts(description), lists(findings), lists(places), texts(plain), others, ratio.to_pylist(), strict=True):
            p = report(said)
            r_buckets = _plain_buckets(source) if other is None else [(x["key"], x["bucket"]) for x in other]
            # Sets that aren't told by bits are compared here.
            near, exact = measures(p, (None, r_text, None, list(r_labels), None, 0, 0, {}, r_ratio)), p[7].items()
            same = len(exact & set(r_buckets)) / len(r_buckets) if r_buckets else float(not p[7])
            rows.append((*near[:3], _share(_listed(p[5], FINDINGS), r_findings), _share(_listed(p[6], PLACES), r_places), same, *near[6:]))
        return _columns(rows, types)

    return run
