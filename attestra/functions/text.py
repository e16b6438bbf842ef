"""Scalar functions on readings: folding, comparison by position, alignment, and notes.

Lengths count code points. Positions are from 0 in arrays and from 1 in messages. A `?` in a reading is an unread
place. Columns may be null; unless said otherwise the result then is null.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra import constants as K

#: White space as ECMAScript's \s has it.
SPACE = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_ITEM = T.StructType().add("kind", T.StringType()).add("i", T.IntegerType()).add("bc", T.StringType()).add("ocr", T.StringType())
MISMATCH_TYPE = T.StructType().add("count", T.IntegerType()).add("items", T.ArrayType(_ITEM)).add("unclear", T.BooleanType()).add("dist", T.IntegerType())


@cache
def _foldable() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII character, and that character."""
    pairs = [(chr(c), n) for c in range(0x80, sys.maxunicode + 1) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Full-width and other compatibility forms of one ASCII character become it; all else stays."""
    return F.translate(text, *_foldable())


def norm(text: Column) -> Column:
    """fold(), then no white space."""
    return F.regexp_replace(fold(text), SPACE + "+", "")


def characters(text: Column) -> Column:
    """array<string> of code points; empty for an empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _indices(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(text: Column, i: Column) -> Column:
    """Code point i of a text; null beyond its end."""
    return F.when((i >= 0) & (i < F.length(text)), F.substring(text, i + 1, F.lit(1)))


def positional_diff(a: Column, b: Column) -> Column:
    """array<struct<i, a, b, same>> over the longer length; the shorter side is padded with a middle dot."""
    pad = lambda x, i: F.coalesce(at(x, i), F.lit("·"))
    return F.transform(_indices(F.greatest(F.length(a), F.length(b))), lambda i: F.struct(i.alias("i"), pad(a, i).alias("a"), pad(b, i).alias("b"), at(a, i).eqNullSafe(at(b, i)).alias("same")))


def is_matrix(symbology: Column) -> Column:
    """Whether a symbology is one of two dimensions; false for null."""
    return F.coalesce(F.regexp_replace(F.lower(symbology), "[^a-z]", "").isin(*K.MATRIX_CODES), F.lit(False))


def one_based(positions: Column, separator: str = "、") -> Column:
    return F.array_join(F.transform(positions, lambda i: (i + 1).cast("string")), separator)


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def conflict_positions(a: Column, b: Column) -> Column:
    """Positions inside both texts where both are read and differ."""
    return F.filter(_indices(F.least(F.length(a), F.length(b))), lambda i: (at(a, i) != "?") & (at(b, i) != "?") & (at(a, i) != at(b, i)))


def merge_resolutions(low: Column, high: Column, low_margins: Column, high_margins: Column, rerendered: Column) -> Column:
    """struct<text, margins, margin, filled>: low where it is read, else high if that is new evidence, else `?`.

    filled lists the places taken from high. margin is the least of the chosen ones, 0 without any.
    """
    taken = lambda i: (at(low, i) == "?") & F.coalesce(at(high, i) != "?", F.lit(False)) & rerendered
    places = _indices(F.length(low))
    text = F.array_join(F.transform(places, lambda i: F.when(at(low, i) != "?", at(low, i)).when(taken(i), at(high, i)).otherwise("?")), "")
    margins = F.transform(places, lambda i: F.when(taken(i), F.get(high_margins, i)).otherwise(F.get(low_margins, i)))
    return F.struct(text.alias("text"), margins.alias("margins"), F.coalesce(F.array_min(margins), F.lit(0.0)).alias("margin"), F.filter(places, taken).alias("filled"))


def wrong_positions(reading: Column, value: Column) -> Column:
    """Places of a reading that are read and aren't the value's character there."""
    return F.filter(_indices(F.length(reading)), lambda i: (at(reading, i) != "?") & ~at(reading, i).eqNullSafe(at(value, i)))


def unread_positions(reading: Column) -> Column:
    return F.filter(_indices(F.length(reading)), lambda i: at(reading, i) == "?")


def contradicts(reading: Column, text: Column) -> Column:
    """Whether a reading has unread places and yet a read one that isn't the text's, or lies beyond it."""
    return F.coalesce(reading.contains("?") & (F.size(wrong_positions(reading, text)) > 0), F.lit(False))


def complete(reading: Column) -> Column:
    return F.coalesce((reading != "") & ~reading.contains("?"), F.lit(False))


def alignment(a: str, b: str) -> tuple[int, list[tuple[str, int, str | None, str | None]]]:
    """(distance, steps) of a unit-cost alignment; among equal ones the last step is a match or change, then a
    loss, then an extra, and so on from the end. A step is (same, sub, del or ins; place in a; of a; of b)."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j - 1] + (x != y), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    steps, i, j = [], len(a), len(b)
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            steps.append(("same" if a[i] == b[j] else "sub", i, a[i], b[j]))
        elif i and here == rows[i - 1][j] + 1:
            i -= 1
            steps.append(("del", i, a[i], None))
        else:
            j -= 1
            steps.append(("ins", i, None, b[j]))
    return rows[-1][-1], steps[::-1]


def _in_a_run(step: tuple, a: str, b: str) -> bool:
    """Whether a lost or extra character has an equal neighbour, so that its place isn't certain."""
    kind, i, lost, extra = step
    if kind == "sub":
        return False
    text, k = (a, i) if kind == "del" else (b, b.find(extra, max(0, i - 1)))
    return k >= 0 and (text[k - 1 : k] == text[k] if k else False) | (text[k + 1 : k + 2] == text[k])


def mismatches_of(value: str | None, reading: str | None) -> tuple[int, list[tuple], bool, int | None]:
    """(count, items, unclear, distance or None for equal lengths); see char_mismatches()."""
    a, b = value or "", reading or ""
    if len(a) == len(b):
        items = [("sub", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y]
        return len(items), items, False, None
    dist, steps = alignment(a, b)
    items = [s for s in steps if s[0] != "same"]
    unclear = dist > max(3, math.ceil(0.4 * len(a))) or any(_in_a_run(s, a, b) for s in items)
    return len(items), [] if unclear else items, unclear, dist


@F.pandas_udf(MISMATCH_TYPE)
def _aligned(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in pairs:
        rows = [mismatches_of(x, y) for x, y in zip(a, b, strict=True)]
        items = [[{"kind": k, "i": i, "bc": x, "ocr": y} for k, i, x, y in r[1]] for r in rows]
        yield pd.DataFrame({"count": [r[0] for r in rows], "items": items, "unclear": [r[2] for r in rows], "dist": pd.array([r[3] for r in rows], "Int32")})


def char_mismatches(value: Column, reading: Column) -> Column:
    """struct<count, items, unclear, dist>: where a reading departs from a value. For display only.

    Null is empty. Texts of one length are compared by position, in the JVM. Others are aligned; too far apart, or
    with a lost or extra character beside an equal one, they are unclear and list no items. Counts and distances
    are reported all the same.
    """
    a, b = F.coalesce(value, F.lit("")), F.coalesce(reading, F.lit(""))
    differ = F.filter(_indices(F.length(a)), lambda i: at(a, i) != at(b, i))
    items = F.transform(differ, lambda i: F.struct(F.lit("sub").alias("kind"), i.alias("i"), at(a, i).alias("bc"), at(b, i).alias("ocr")))
    level = F.struct(F.size(differ).alias("count"), items.alias("items"), F.lit(False).alias("unclear"), F.lit(None).cast("int").alias("dist"))
    # The Arrow function sees the pairs of unequal length only as such; for others it gets two empty texts.
    uneven = F.length(a) != F.length(b)
    return F.when(uneven, _aligned(F.when(uneven, a).otherwise(""), F.when(uneven, b).otherwise(""))).otherwise(level)


def mismatch_text(item: Column) -> Column:
    """A message for an item of char_mismatches()."""
    n = (item["i"] + 1).cast("string")
    return (
        F.when(item["kind"] == "del", F.concat(F.lit("character "), n, F.lit(": the code has "), item["bc"], F.lit(", the reading lacks it")))
        .when((item["kind"] == "ins") & (item["i"] == 0), F.concat(F.lit("at the start: the reading has an extra "), item["ocr"]))
        .when(item["kind"] == "ins", F.concat(F.lit("after character "), item["i"].cast("string"), F.lit(": the reading has an extra "), item["ocr"]))
        .otherwise(F.concat(F.lit("character "), n, F.lit(": the code has "), item["bc"], F.lit(", the reading "), item["ocr"]))
    )


def layout_note(mode: Column, line_sizes: Column, raw_value: Column, font: Column) -> Column:
    """What was unusual about a reading; empty if nothing was."""
    right = F.when(mode == "right", F.concat(F.lit("text to the right, "), F.size(line_sizes).cast("string"), F.lit(" lines ("), F.array_join(F.transform(line_sizes, lambda n: n.cast("string")), "+"), F.lit(" characters)")))
    spaced = F.when(raw_value.rlike(SPACE), F.concat(F.lit("the code has white space ("), F.replace(html_escape(raw_value), F.lit(" "), F.lit("␣")), F.lit("), ignored")))
    other = F.when(font != K.FONTS[0], F.concat(F.lit("template font: "), html_escape(font)))
    return F.concat_ws("; ", right, spaced, other)


def template_note(why: Column, reading: Column, wrong: Column, margin: Column) -> Column:
    """struct<kind, n, ratio, weak>: kind is not-applicable, unread, wrong or match; null where nothing was read."""
    note = lambda kind, n, ratio, weak: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), ratio.cast("double").alias("ratio"), weak.alias("weak"))
    none, ratio = F.lit(None), F.coalesce(margin, F.lit(0.0)) / K.TEMPLATE_MARGIN
    return (
        F.when(why.isNotNull() & (why != ""), note("not-applicable", none, none, F.lit(True)))
        .when(F.coalesce(reading, F.lit("")) == "", F.lit(None))
        .when(reading.contains("?"), note("unread", F.size(unread_positions(reading)), none, F.lit(True)))
        .when(F.size(F.coalesce(wrong, F.array().cast("array<int>"))) > 0, note("wrong", F.size(wrong), none, F.lit(False)))
        .otherwise(note("match", F.length(reading), ratio, ratio < 1.5))
    )


def retry_checks(low: Column, high: Column, reading: Column, why: Column, conflict: Column, filled: Column, rerendered: Column) -> Column:
    """array<struct<ok, check, detail>>: what the two resolutions agree on, each point on its own.

    low and high are the two text readings, reading is the merged template reading.
    """
    point = lambda ok, check, detail: F.struct(F.lit(ok).alias("ok"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))
    blank, some = F.lit(""), lambda x: F.size(F.coalesce(x, F.array().cast("array<int>"))) > 0
    high, low, reading = F.coalesce(high, blank), F.coalesce(low, blank), F.coalesce(reading, blank)
    twice = F.when(high == "", point(False, "readings", F.lit("second reading is empty"))).when(low == high, point(True, "readings", F.lit("same text twice"))).otherwise(point(False, "readings", F.concat(low, F.lit(" / "), high)))
    template = (
        F.when(why.isNotNull() & (why != ""), point(False, "template", F.concat(F.lit("not applicable: "), why)))
        .when(reading == "", point(False, "template", F.lit("not run: numbers of glyphs and characters differ")))
        .when(some(conflict), point(False, "template", F.concat(F.lit("resolutions differ at "), one_based(conflict))))
        .when(reading.contains("?"), point(False, "template", F.concat(F.lit("unread at "), one_based(unread_positions(reading)))))
        .otherwise(point(True, "template", F.concat(F.length(reading).cast("string"), F.lit(" characters read"))))
    )
    fill = F.when(some(filled), point(True, "filled", F.concat(F.lit("second resolution gave "), one_based(filled)))).when(reading != "", point(True, "filled", F.lit("nothing to fill")))
    weight = F.when(~F.coalesce(rerendered, F.lit(False)), point(False, "evidence", F.lit("an enlarged raster is no new evidence")))
    return F.filter(F.array(twice, template, fill, weight), lambda x: x.isNotNull())
