"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims


def literal_map(values: dict) -> Column:
    """A map literal; look-ups of absent keys give null."""
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])


#: White space of any alphabet: the characters of a pattern's ``(?U)\\s``.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any alphabet at both ends, which alone are looked at (``trim`` by itself takes spaces only)."""
    return F.btrim(c, F.lit(WHITE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def unified_lines(c: Column) -> Column:
    return F.replace(F.replace(or_empty(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines_of(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(unified_lines(c), "\n"), strip), lambda x: x != "")


def normalized(c: Column) -> Column:
    """Narrow punctuation and clean lines: equal to the full form (``udf.nfkc_normalized``) for texts without compatibility characters."""
    return F.array_join(lines_of(F.translate(or_empty(c), *dims.PUNCTUATION)), "\n")


def section(norm: Column, label: str) -> Column:
    """Rest of the line that starts with ``label`` and a colon; if that is blank, the line after it."""
    return strip(F.regexp_extract(norm, rf"(?m)^{label}\s*:\s*(.+)$", 1))


def labels_of(c: Column) -> Column:
    """Items between 、, stripped, without blanks."""
    return F.filter(F.transform(F.split(or_empty(c), "、"), strip), lambda x: x != "")


def label_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(labels_of(c)))


def has_report_format(norm: Column) -> Column:
    """Exactly a description line and a diagnosis line."""
    parts = F.filter(F.split(norm, "\n"), lambda x: x != "")
    return (F.size(parts) == 2) & F.startswith(F.get(parts, F.lit(0)), F.lit("描述:")) & F.startswith(F.get(parts, F.lit(1)), F.lit("初步诊断:"))


#: A full stop or semicolon with the blanks around it; a stop between digits is a decimal point.
SENTENCE_END = r"[ ,]*(?:(?<![0-9])\.|\.(?![0-9])|;)[ ,]*"


def sentences_of(norm: Column) -> Column:
    """Sentences between full stops and semicolons; a stop between digits is a decimal point."""
    return F.filter(F.split(F.regexp_replace(norm, "^[ ,]+|[ ,]+$", ""), SENTENCE_END), lambda x: x != "")


def sentence_lines(line: Column) -> Column:
    """The sentences of one line as lines of a text, which may have blank lines."""
    return F.regexp_replace(line, rf"^[ ,]+|{SENTENCE_END}|[ ,]+$", "\n")


def diagnosis_part(c: Column) -> Column:
    """What stands after the diagnosis label in a raw report; UNKNOWN without one."""
    found = F.regexp_extract(or_empty(c), r"初步诊断[：:]\s*([^\n]+)", 1)
    return F.when(found == "", F.lit("UNKNOWN")).otherwise(strip(found))


def normalized_report(c: Column) -> Column:
    return strip(unified_lines(c))


def report_hash(c: Column) -> Column:
    return F.substring(F.sha1(normalized_report(c).cast("binary")), 1, 16)


def normalized_tag(c: Column) -> Column:
    """Narrow brackets, no white space, one spelling."""
    bare = F.regexp_replace(F.translate(or_empty(c), "（）", "()"), r"(?U)\s+", "")
    return F.coalesce(literal_map(dims.TAG_ALIASES)[bare], bare)


def tag_list(c: Column) -> Column:
    """Quoted labels of a text such as ``None"a", , "b",``, in order, once each."""
    quoted = F.regexp_extract_all(or_empty(c), F.lit('"([^"]+)"'), F.lit(1))
    cleaned = F.transform(quoted, lambda x: F.regexp_replace(normalized_tag(x), "^,+|,+$", ""))
    return F.array_distinct(F.filter(cleaned, lambda x: (x != "") & (F.lower(x) != "none")))


def sided_tags(items: Column, side: Column) -> Column:
    """Labels of ``label，side`` items that hold for an eye's side."""
    split = F.transform(items, lambda x: F.split(strip(or_empty(x)), "，", 2))
    fits = lambda p: (F.size(p) == 2) & (
        ((strip(F.get(p, F.lit(1))) == "右眼") & (side == "right")) | ((strip(F.get(p, F.lit(1))) == "左眼") & (side == "left")) | (strip(F.get(p, F.lit(1))) == "双眼")
    )
    return F.array_distinct(F.transform(F.filter(split, fits), lambda p: normalized_tag(strip(F.get(p, F.lit(0))))))


def in_diagnosis_order(tags: Column) -> Column:
    """Labels once each, known ones by rank, then unknown ones by position."""
    once = F.array_distinct(F.filter(F.transform(tags, normalized_tag), lambda x: x != ""))
    rank = literal_map({t: k for k, t in enumerate(dims.DIAGNOSIS_ORDER)})
    keyed = F.transform(once, lambda x, i: F.struct(F.coalesce(rank[x], F.lit(len(dims.DIAGNOSIS_ORDER)) + i).alias("r"), i.alias("i"), x.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def image_id(name: Column) -> Column:
    """What lies between the last underscore and the extension of a file name."""
    name = strip(or_empty(name))
    found = F.regexp_extract(name, r"_([^_/\\]+)\.[^.]+$", 1)
    return F.when(found != "", strip(found)).when(F.contains(name, F.lit("_")), strip(F.element_at(F.split(name, "_"), -1))).otherwise(name)


def record_of(name: Column) -> Column:
    """struct(record, side) of ``<record>_..._<OD|OS>`` names with three parts or more; null otherwise."""
    stem = F.regexp_replace(F.element_at(F.split(or_empty(name), r"[/\\]"), -1), r"\.[^.]+$", "")
    parts = F.split(stem, "_")
    side = literal_map({"OD": "right", "OS": "left"})[F.upper(F.element_at(parts, -1))]
    return F.when((F.size(parts) >= 3) & side.isNotNull() & (F.get(parts, F.lit(0)) != ""), F.struct(F.get(parts, F.lit(0)).alias("record"), side.alias("side")))


def identifier(c: Column) -> Column:
    """An id that a spreadsheet turned into a number loses its ``.0``."""
    return F.regexp_replace(strip(or_empty(c)), r"^([0-9]+)\.0+$", "$1")


def safe_int(c: Column) -> Column:
    """Whole part of a number, as a long; 0 for whatever is none."""
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def excluded(c: Column) -> Column:
    """Free text that marks an image as unusable."""
    return (strip(or_empty(c)) == "4") | F.contains(or_empty(c), F.lit("模糊"))


def has_place(c: Column) -> Column:
    return or_empty(c).rlike(dims.PLACE_PATTERN)


def duration(seconds: Column) -> Column:
    """hh:mm:ss."""
    whole = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _plain_cells(c: Column) -> Column:
    def units(text: Column) -> Column:
        *areas, white = dims.CELL_PATTERNS
        plain = text
        for pattern in areas:  # each of them needs a 2
            plain = F.regexp_replace(plain, *pattern)
        return F.regexp_replace(F.when(F.contains(text, F.lit("2")), plain).otherwise(text), *white)

    return let(F.translate(or_empty(c), *dims.CELL_CHARACTERS), units)


def _closed(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))


def _repaired(t: Column) -> Column:
    # The cut unit stands before a bracket or, if none does, anywhere.
    whole = F.when(F.contains(t, F.lit("m²)")), F.replace(t, F.lit("m²)"), F.lit("mm²)"))).otherwise(F.replace(t, F.lit("m²"), F.lit("mm²")))
    return F.when(F.contains(t, F.lit(dims.CELL_CUT_MEASURE)) & ~F.contains(t, F.lit("mm²")), whole).otherwise(t)


def cell_text(c: Column) -> Column:
    """Text of a report cell, entities decoded: characters, area units, white space and brackets made alike."""
    return F.replace(let(_closed(F.trim(_plain_cells(c))), _repaired), *map(F.lit, dims.CELL_MISREAD))


#: Signs between the cells of a row and between rows, where a table is one text; no cell holds them.
CELL_END, ROW_END = "\u0001", "\u0002"


def grid_of(joined: Column) -> Column:
    """Rows of clean cells (see ``cell_text``) of a table in one text. All cells are cleaned at once, as no pattern reaches over an end; rows without text go."""
    text = _closed(F.trim(F.regexp_replace(_plain_cells(joined), f" *([{CELL_END}{ROW_END}]) *", "$1")))
    text = F.replace(text, *map(F.lit, dims.CELL_MISREAD))

    def rows(t: Column) -> Column:
        filled = F.filter(F.split(t, ROW_END), lambda r: F.replace(r, F.lit(CELL_END)) != "")
        cells = F.transform(filled, lambda r: F.split(r, CELL_END))
        return F.when(F.contains(t, F.lit(dims.CELL_CUT_MEASURE)), F.transform(cells, lambda r: F.transform(r, _repaired))).otherwise(cells)

    return let(text, rows)


def eye_side(c: Column) -> Column:
    """right, left or both for the usual spellings of an eye's side; other text in lower case."""
    plain = F.lower(strip(or_empty(c)))
    return F.coalesce(literal_map(dims.EYE_SIDES)[plain], plain)


def column_key(c: Column) -> Column:
    """Letters and digits of a column's name, in lower case."""
    return F.regexp_replace(F.lower(strip(or_empty(c))), "[^a-z0-9]+", "")


def column_by_aliases(columns: list[str], aliases: list[str], required: bool = True) -> str | None:
    """The column whose plain name is that of the first alias that any column has; of columns with one plain name, the last."""
    plain = lambda name: "".join(x for x in name.strip().lower() if x in "abcdefghijklmnopqrstuvwxyz0123456789")
    known = {plain(c): c for c in columns}
    found = next((known[plain(a)] for a in aliases if plain(a) in known), None)
    if found is None and required:
        raise KeyError(f"none of {aliases} is among {columns}")
    return found


def one_decimal(value: Column) -> Column:
    """Text of a number with one decimal, rounded half to even on its exact binary value below 2^48 (whole numbers with their shortest digits
    from there on); null counts as 0.

    Twenty times the value is a double and the exact rest of that sum, so what lies on which side of a half is known without wider numbers.
    """
    x = F.abs(F.coalesce(value.cast("double"), F.lit(0.0)))

    def rounded(twenty: Column, rest: Column) -> Column:
        low = F.floor(twenty / 2)
        over = twenty - low * 2 - 1
        up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (low % 2 == 1))))
        return low + up.cast("long")

    def told(x: Column) -> Column:
        whole, four = x * 16, x * 4
        twenty = whole + four
        part = twenty - whole
        tenths = rounded(twenty, (whole - (twenty - part)) + (four - part))
        return let(tenths, lambda n: F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string")))

    text = F.when(x < 2.0**48, let(x, told)).otherwise(F.when(F.isnan(x), F.lit("nan")).otherwise(F.format_string("%.1f", x)))
    return F.when(value.cast("double") < 0, F.concat(F.lit("-"), text)).otherwise(text)
