import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import pixels as P
from attestra.functions import text as X
from attestra.functions import vectors as V
from attestra.functions.geometry import box, crop_to_page, page_to_crop, text_area, usable


def one(spark, *cols, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(*cols).first()


def test_fold_and_norm(spark):
    r = one(spark, X.fold(F.col("a")).alias("f"), X.norm(F.col("b")).alias("n"), X.fold(F.lit("㎏ﬁ①")).alias("k"), X.norm(F.lit(None).cast("string")).alias("z"), a="２７７ＡＢ", b="1234567    01　20 26﻿01\u000b01")
    assert (r.f, r.n, r.k, r.z) == ("277AB", "12345670120260101", "㎏ﬁ1", None)


def test_positional_diff_pads_with_a_dot(spark):
    r = one(spark, X.positional_diff(F.lit("abc"), F.lit("axcd")).alias("d")).d
    assert [(x.i, x.a, x.b, x.same) for x in r] == [(0, "a", "a", True), (1, "b", "x", False), (2, "c", "c", True), (3, "·", "d", False)]
    assert one(spark, X.positional_diff(F.lit(""), F.lit("")).alias("d")).d == []


def test_small_text_functions(spark):
    r = one(spark, X.is_matrix(F.lit("QR-Code")).alias("q"), X.is_matrix(F.lit("Code128")).alias("c"), X.is_matrix(F.lit(None).cast("string")).alias("n"), X.one_based(F.array(F.lit(0), F.lit(4))).alias("o"), X.html_escape(F.lit('<a&"b">')).alias("h"))
    assert (r.q, r.c, r.n, r.o, r.h) == (True, False, False, "1、5", "&lt;a&amp;&quot;b&quot;&gt;")


def test_resolution_merge(spark):
    args = [F.lit("1?3?"), F.lit("1554"), F.array(*map(F.lit, [0.5, 0.1, 0.4, 0.2])), F.array(*map(F.lit, [0.9, 0.3, 0.9, 0.6]))]
    m = one(spark, X.merge_resolutions(*args, F.lit(True)).alias("m")).m
    assert (m.text, m.filled, m.margins, m.margin) == ("1534", [1, 3], [0.5, 0.3, 0.4, 0.6], 0.3)
    m = one(spark, X.merge_resolutions(*args, F.lit(False)).alias("m")).m
    assert (m.text, m.filled, m.margin) == ("1?3?", [], 0.1)
    m = one(spark, X.merge_resolutions(F.lit("?2"), F.lit(""), args[2], F.array().cast("array<double>"), F.lit(True)).alias("m")).m
    assert (m.text, m.filled) == ("?2", [])
    r = one(spark, X.conflict_positions(F.lit("1?34"), F.lit("12?5")).alias("c"), X.wrong_positions(F.lit("1?39"), F.lit("123")).alias("w"))
    assert (r.c, r.w) == ([3], [3])


@pytest.mark.parametrize(
    ("value", "reading", "count", "unclear", "dist", "kinds"),
    [
        ("1239", "1238", 1, False, None, [("sub", 3)]),
        ("12345", "2345", 1, False, 1, [("del", 0)]),
        ("1112", "112", 1, True, 1, []),
        ("12345", "912345", 1, False, 1, [("ins", 0)]),
        ("abcdef", "xyz", 6, True, 6, []),
        ("", None, 0, False, None, []),
        (None, "a", 1, False, 1, [("ins", 0)]),
        ("same", "same", 0, False, None, []),
    ],
)
def test_char_mismatches(spark, value, reading, count, unclear, dist, kinds):
    df = spark.createDataFrame([(value, reading)], "a string, b string")
    m = df.select(X.char_mismatches(F.col("a"), F.col("b")).alias("m")).first().m
    assert (m["count"], m.unclear, m.dist, [(x.kind, x.i) for x in m["items"]]) == (count, unclear, dist, kinds)


def test_distance_limit_is_inclusive():
    assert X.mismatches_of("abcdefgh", "abcd")[2] is False  # 4 changes, and ceil(0.4 * 8) is 4
    assert X.mismatches_of("abcdefgh", "abc")[2] is True


def test_alignment_is_shortest():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(8))) for _ in range(2))
        d, steps = X.alignment(a, b)
        assert d == sum(s[0] != "same" for s in steps)
        assert "".join(s[2] or "" for s in steps) == a and "".join(s[3] or "" for s in steps) == b


def test_mismatch_text(spark):
    item = lambda k, i, a, b: F.struct(F.lit(k).alias("kind"), F.lit(i).alias("i"), F.lit(a).alias("bc"), F.lit(b).alias("ocr"))
    r = one(spark, X.mismatch_text(item("ins", 0, "", "x")).alias("a"), X.mismatch_text(item("ins", 2, "", "x")).alias("b"), X.mismatch_text(item("sub", 2, "p", "q")).alias("c"), X.mismatch_text(item("del", 0, "p", "")).alias("d"))
    assert r.a.startswith("at the start") and r.b.startswith("after character 2") and "character 3" in r.c and "character 1" in r.d


def test_notes(spark):
    n = lambda *a: one(spark, X.template_note(*a).alias("n")).n
    none, empty = F.lit(None).cast("string"), F.array().cast("array<int>")
    assert n(F.lit("poor-fit"), F.lit("??"), empty, F.lit(0.0)).kind == "not-applicable"
    assert n(none, F.lit(""), empty, F.lit(0.0)) is None
    assert (n(none, F.lit("1?"), empty, F.lit(0.1)).n, n(none, F.lit("12"), F.array(F.lit(1)), F.lit(0.1)).kind) == (1, "wrong")
    assert n(none, F.lit("12"), empty, F.lit(0.03)).weak is False and n(none, F.lit("12"), empty, F.lit(0.029)).weak is True
    r = one(spark, X.layout_note(F.lit("right"), F.array(F.lit(7), F.lit(2)), F.lit("a b"), F.lit("Calibri")).alias("x"), X.layout_note(F.lit("below"), empty, F.lit("ab"), F.lit("Arial")).alias("y"))
    assert r.x.count(";") == 2 and "a␣b" in r.x and r.y == ""


def test_retry_checks_never_claim_what_was_not_run(spark):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<int>")
    c = one(spark, X.retry_checks(F.lit("12"), F.lit("12"), F.lit(""), none, empty, empty, F.lit(False)).alias("c")).c
    assert [(x.check, x.ok) for x in c] == [("readings", True), ("template", False), ("evidence", False)]


def test_medians(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (4, 1, 3, 2)] + [(2, 7.0), (3, None)], "k int, x double")
    assert {r.k: r.m for r in df.groupBy("k").agg(V.upper_median(F.col("x")).alias("m")).collect()} == {1: 3.0, 2: 7.0, 3: None}
    assert {r.k: r.m for r in V.upper_median_of(df, ["k"], "x", "m").collect()} == {1: 3.0, 2: 7.0}


def test_otsu_agrees_with_pixels(spark):
    g = np.random.default_rng(3).integers(0, 256, (40, 50)).astype(np.uint8)
    df = spark.createDataFrame([(1, int(v)) for v in g.reshape(-1)] + [(2, 5)], "k int, level int").groupBy("k", "level").count()
    assert [tuple(r) for r in V.otsu(df, ["k"], n="count").collect()] == [(1, P.threshold(g))]


def test_ctc(spark):
    classes = F.array(F.lit(""), F.lit("2"), F.lit("7"))
    decode = lambda path, p: one(spark, V.ctc_decode(F.array(*map(F.lit, path)), F.array(*map(F.lit, p)), classes).alias("d")).d
    assert decode([1, 2, 2, 2], [1.0, 0.5, 0.1, 0.1]) == ("27", 0.75)
    assert decode([1, 2, 0, 2, 2], [1.0] * 5).raw == "277"
    assert decode([0, 0], [0.9, 0.9]) == ("", 0.0)


def area_of(spark, corners, side="below", clip=None, w=1000.0, h=1000.0):
    c = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners))
    b = box(*(F.lit(None if clip is None else float(v)).cast("double") for v in (clip or [0] * 4)))
    a = text_area(c, F.lit(w), F.lit(h), b, side)
    return spark.range(1).select(a.alias("a"), usable(a).alias("ok")).first()


def test_text_area_follows_the_reading_direction(spark):
    r = area_of(spark, [(400, 400), (500, 400), (500, 440), (400, 440)])
    assert r.ok and r.a.angle == 0 and [round(v, 6) for v in r.a.rect] == [250, 442, 650, 488]
    # Turned by half: the text is on the other side of the page.
    r = area_of(spark, [(500, 440), (400, 440), (400, 400), (500, 400)])
    assert r.ok and abs(r.a.angle) == 180 and [round(v, 6) for v in r.a.rect] == [250, 352, 650, 398]
    r = area_of(spark, [(400, 400), (440, 400), (440, 440), (400, 440)], "right", clip=(0, 0, 600, 1000))
    assert [round(v, 6) for v in r.a.rect] == [442, 398, 600, 450]


def test_skew_gate_and_lost_areas(spark):
    turn = lambda d: [(500 + x * np.cos(np.radians(d)) - y * np.sin(np.radians(d)), 500 + x * np.sin(np.radians(d)) + y * np.cos(np.radians(d))) for x, y in ((0, 0), (100, 0), (100, 40), (0, 40))]
    assert area_of(spark, turn(4.99)).ok and not area_of(spark, turn(5.01)).ok
    assert area_of(spark, [(1, 1)] * 4).a.skew == 99
    assert area_of(spark, [(400, 960), (500, 960), (500, 999.5), (400, 999.5)]).a.rect is None


@pytest.mark.parametrize("angle", [0, 90, 180, 270, -90, 360])
def test_crop_and_page_are_inverse(spark, angle):
    rect = box(*(F.lit(float(v)) for v in (10, 20, 110, 220)))
    p = page_to_crop(F.lit(30.0), F.lit(50.0), rect, F.lit(angle))
    r = spark.range(1).select(crop_to_page(box(p["x"], p["y"], p["x"], p["y"]), rect, F.lit(angle)).alias("b")).first().b
    assert tuple(r) == (30.0, 50.0, 30.0, 50.0)


def flood(bw):
    """8-connected parts by flood fill."""
    seen, out = np.zeros(bw.shape, bool), []
    for y, x in zip(*np.nonzero(bw), strict=True):
        if seen[y, x]:
            continue
        stack, part = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            part.append((a, b))
            for c in range(max(0, a - 1), min(bw.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(bw.shape[1], b + 2)):
                    if bw[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        ys, xs = [p[0] for p in part], [p[1] for p in part]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return out


def test_components_against_flood_fill():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.3, 0.5, 0.8):
        bw = (rng.random((25, 31)) < share).astype(np.uint8) * 255
        assert [tuple(map(int, r)) for r in P.components(bw)] == [tuple(map(int, r)) for r in flood(bw)]
    assert P.components(np.zeros((4, 4), np.uint8)).shape == (0, 5)


def test_area_resize_keeps_the_mean_and_enlarges_to_the_nearest():
    src = np.random.default_rng(2).random((48, 36)) * 255
    assert abs(P.area_resize(src, 24, 12).mean() - src.mean()) < 1e-3
    assert (P.area_resize(np.array([[1.0, 2.0]]), 2, 4) == [[1, 1, 2, 2], [1, 1, 2, 2]]).all()
    v = P.descriptor((np.arange(60).reshape(10, 6) % 7 * 30).astype(np.uint8))
    assert v.shape == (576,) and abs((v**2).sum() - 1) < 1e-5 and P.descriptor(np.zeros((5, 5), np.uint8)) is None


def test_glyphs_of_a_row_of_bars():
    page = np.full((60, 200), 255, np.uint8)
    for i in range(5):
        page[20:40, 10 + 30 * i : 18 + 30 * i] = 0
    page[10:12, 50:51] = 0  # a speck
    found = P.glyphs(page)
    assert [g[:4] for g in found] == [(10 + 30 * i, 20, 8, 20) for i in range(5)]
    assert P.glyphs(np.full((30, 30), 255, np.uint8)) == []
    assert P.tight(page, [g[:4] for g in found]).shape == (32, 140) and P.tight(page, []).shape == page.shape
    flat, boxes = P.side_by_side(page, [[found[0][:4]], [found[1][:4]]])
    assert flat.shape == (32, 2 * 20 + 18) and boxes[1][0] > boxes[0][0] + 8


def test_ink_sums_and_rotation():
    page = np.full((9, 7), 255, np.uint8)
    page[2:5, 1:4] = 0
    s = P.ink_sums(page)
    assert P.ink_inside(s, [0, 0, 7, 9]) == 9 and P.ink_inside(s, [1.5, 2.5, 2.5, 3.5]) == 4 and P.ink_inside(s, [-5, -5, 0, 0]) == 0
    assert P.upright(page, 90).shape == (7, 9) and (P.upright(page, 360) == page).all()
    assert P.enlarge(page, 14).shape == (18, 14) and P.crop(page, 1.9, 2.2, 1.95, 4.9).shape == (2, 1)
