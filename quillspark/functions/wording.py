"""Wording of report text as an Arrow function: clauses are looked up by codes, and what labels add is worked out once for each list of labels."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import dims
from .structure import lists, texts
from .text import WHITE

#: A counted clause's code: thrice the mask of its places, and its level; NONE without a clause. An optional clause's code is 1 or 0.
LEVELS, NONE = ("", dims.FEW, dims.MANY), 48
OPTIONAL = {
    "discbloodnumber": "视盘可见出血。", "ratioatrophymaxwidth": "视盘旁可见脉络膜萎缩弧。", "atrophicfocinumber": "可见斑片状萎缩灶。", "lacquercracknumber": "视网膜可见漆裂纹。",
    dims.LASER: "眼底可见激光斑。", "rnfldarea": "可见神经纤维层缺损。",
}
_TEXTS = {t: x for t, x in {**dims.DISEASE_TEXT, **dims.LESION_TEXT}.items() if x and t not in dims.DIAGNOSIS_ONLY_TAGS}
_BLANKS, _RANK = dict.fromkeys(map(ord, WHITE)), {t: k for k, t in enumerate(dims.DIAGNOSIS_ORDER)}
#: Lists of labels that are remembered, and the most signs of one.
_LISTS, _LONGEST = 16_384, 1024


def normalized_tag(tag: str | None) -> str:
    """``text.normalized_tag``."""
    bare = (tag or "").replace("（", "(").replace("）", ")").translate(_BLANKS)
    return dims.TAG_ALIASES.get(bare, bare)


def _labelled(tags: tuple[str | None, ...]) -> tuple[bool, dict[str, tuple[str | None, ...]], str]:
    """Whether labels name a vein occlusion, the clauses that they add to each section (None stands for that of an occlusion), and the diagnosis line."""
    all_tags = list(dict.fromkeys(t for t in map(normalized_tag, tags) if t))
    used = [t for t in all_tags if t not in dims.IGNORED_TAGS]
    clauses = {s: [] for s in dims.SECTIONS}
    for t in used:
        if t in dims.OCCLUSION_TAGS:
            clauses["vessel"].append(None)
        elif t in _TEXTS:
            clauses[dims.SECTION_OF.get(t, "other")].append(_TEXTS[t])
    named = list(dict.fromkeys(x for x in (normalized_tag(t) for t in used if t in dims.DISEASE_TEXT) if x))
    line = "、".join(sorted(named, key=lambda t: _RANK.get(t, len(_RANK) + named.index(t))))
    return any(t in dims.OCCLUSION_TAGS for t in all_tags), {s: tuple(c) for s, c in clauses.items() if c}, line or dims.NO_FINDING


_short_labelled = lru_cache(_LISTS)(_labelled)


def _tables() -> tuple[dict[str, list[tuple[str, np.ndarray]]], np.ndarray]:
    """The texts by code of the clauses of each section, in order, with the name of what they tell of; and of a vein occlusion by mask."""
    words = lambda *values: np.array(values, dtype=object)
    counted = lambda name, leveled: words(*[f"{dims.PLACES_BY_MASK[m]}视网膜可见{level if leveled else ''}{name}。" for m in range(16) for level in LEVELS], "")
    of = lambda section: [(p, counted(name, leveled)) for p, name, _, leveled, where in dims.COUNTED if where == section]
    optional = lambda *names: [(n, words("", OPTIONAL[n])) for n in names]
    sections = {
        "disc": optional("discbloodnumber", "ratioatrophymaxwidth"),
        "vessel": of("vessel"),
        "macula": [(p + "r2", words("", f"黄斑处可见{name}。")) for p, name, macula, *_ in dims.COUNTED if macula],
        "retina": [*of("retina"), *optional("atrophicfocinumber", "lacquercracknumber", dims.LASER, "rnfldarea")],
        "other": [],
    }
    return sections, words(*[f"静脉迂曲扩张，{dims.PLACES_BY_MASK[m]}视网膜沿血管放射状出血。" for m in range(16)])


_SECTIONS, _OCCLUDED = _tables()
#: The codes of a report in order: the clauses of all sections, the mask of an occlusion and the number of crossings.
CODES = [name for section in _SECTIONS.values() for name, _ in section]
_BLOOD = {p for p, name, *_ in dims.COUNTED if name == "出血"} | {p + "r2" for p, name, *_ in dims.COUNTED if name == "出血"}


def worded(codes: np.ndarray, ratios: list[str | None], tags: list[tuple[str | None, ...]]) -> list[str]:
    """Report texts of rows of codes (see ``CODES``), texts of ratios and labels. A section has each of its clauses once; blood isn't told of again where a vein is occluded."""
    columns, blood, place = {}, {}, 0
    for section, clauses in _SECTIONS.items():
        columns[section] = [table[codes[:, place + k]].tolist() for k, (_, table) in enumerate(clauses)]
        blood[section] = [k for k, (name, _) in enumerate(clauses) if name in _BLOOD]
        place += len(clauses)
    rows = {section: list(zip(*found, strict=True)) for section, found in columns.items() if found}
    veins, crossings = _OCCLUDED[codes[:, place]].tolist(), codes[:, place + 1].tolist()
    out = []
    for i, own in enumerate(tags):
        occluded, added, line = _short_labelled(own) if sum(len(t or "") for t in own) <= _LONGEST else _labelled(own)
        ratio = ratios[i]
        parts = ["描述："]
        for section in dims.SECTIONS:
            clauses = rows[section][i] if section in rows else ()
            if section == "disc" and ratio is not None:
                clauses = (f"杯盘比为{ratio}。", *clauses)
            elif section == "vessel" and crossings[i] > 0:
                clauses = (f"可见{crossings[i]}处动静脉交叉压迫点。", *clauses)
            elif occluded and blood[section]:
                clauses = [x for k, x in enumerate(clauses) if k not in blood[section]]
            if section in added:
                clauses = dict.fromkeys((*clauses, *[veins[i] if x is None else x for x in added[section]]))
            parts.append("".join(clauses))
        out.append(f"{''.join(parts)}\n初步诊断：{line}")
    return out


def report_words():
    """Report text of its codes, text of the ratio and labels."""

    @F.arrow_udf("string")
    def run(codes: pa.Array, ratio: pa.Array, tags: pa.Array) -> pa.Array:
        numbers = codes.flatten().to_numpy(zero_copy_only=False).reshape(len(codes), len(CODES) + 2)
        return pa.array(worded(numbers, texts(ratio), lists(tags)), pa.string())

    return run
