import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.operators import clusters, lines, regions, sequential, summary, templates
from attestra.operators.verdict import judge
from attestra.plans import pieces


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


BOX = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double"


def test_frames_are_strokes_over_the_least_size(spark):
    k = 400 / 72
    data = [("d", 1, "stroke", 0.0, 0.0, 120 * k + 1, 60 * k + 1), ("d", 1, "stroke", 0.0, 0.0, 120 * k, 60 * k), ("d", 1, "fill", 0.0, 0.0, 5000.0, 5000.0), ("d", 1, "stroke", 0.0, 0.0, 2000.0, 2000.0)]
    f = regions.frames_of_paths(spark.createDataFrame(data, "doc_id string, page_no int, paint string, x0 double, y0 double, x1 double, y1 double"))
    assert [(i, round(x)) for i, x in rows(f, "frame_idx", "x1")] == [(0, round(120 * k + 1)), (1, 2000)]


def test_smallest_container_counts_edges_and_misses(spark):
    boxes = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, 0.0, 0.0, 50.0, 50.0)], "doc_id string, page_no int, frame_idx int, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([("d", 1, 0, 10.0, 10.0), ("d", 1, 1, 11.0, 3.0), ("d", 1, 2, 51.0, 1.0), ("e", 1, 3, 1.0, 1.0)], "doc_id string, page_no int, seq int, cx double, cy double")
    assert rows(regions.smallest_container(points, boxes, regions.PAGE, ["seq"]), "seq", "label") == [(0, 0), (1, 1), (2, -1), (3, -1)]


def test_clips_of_neighbours_and_frames(spark):
    s = spark.createDataFrame([("d", 1, 0, 1000.0, 800.0, 100.0, 100.0, 200.0, 200.0, -1), ("d", 1, 1, 1000.0, 800.0, 500.0, 110.0, 600.0, 210.0, -1), ("d", 1, 2, 1000.0, 800.0, 120.0, 600.0, 220.0, 700.0, 0)],
                              "doc_id string, page_no int, seq int, width double, height double, x0 double, y0 double, x1 double, y1 double, label int")
    f = spark.createDataFrame([("d", 1, 0, 50.0, 550.0, 400.0, 750.0)], "doc_id string, page_no int, frame_idx int, x0 double, y0 double, x1 double, y1 double")
    c = {r.seq: r for r in regions.clips(s, f).collect()}
    assert tuple(c[0].clip) == (0, 0, 350, 400) and tuple(c[0].clip_right) == (0, 0, 498, 400)
    assert tuple(c[2].clip) == (50, 550, 400, 750) == tuple(c[2].clip_right)


def test_equal_centres_go_right_and_to_the_bottom(spark):
    items = spark.createDataFrame([("k", 0, 10.0, 10.0), ("k", 1, 10.0, 10.0)], "k string, i int, cx double, cy double")
    assert rows(regions.neighbour_clip(items, ["k"], "i", F.lit(100.0), F.lit(90.0)), "left", "top", "right", "bottom") == [(0, 0, 100, 10)] * 2


def test_words_need_their_centre_inside_and_turn_with_the_page(spark):
    w = spark.createDataFrame([("d", 5.0, 5.0, 4.0, 4.0, "a"), ("d", 20.0, 5.04, 4.0, 4.0, "b"), ("d", 5.0, 20.0, 4.0, 4.0, "c"), ("d", 97.0, 5.0, 9.0, 4.0, "out"), ("d", 1.0, 1.0, 1.0, 1.0, "  ")], "doc_id string, x double, y double, w double, h double, s string")
    areas = spark.createDataFrame([("d", i, (0.0, 0.0, 100.0, 100.0), a) for i, a in enumerate((0, 90, 180, 270))] + [("d", 9, (200.0, 0.0, 300.0, 9.0), 0)], "doc_id string, i int, rect struct<x0: double, y0: double, x1: double, y1: double>, angle int")
    assert rows(regions.words_in_areas(areas, w, ["doc_id"], ["doc_id", "i"]), "i", "words") == [(0, "a b c"), (1, "a c b"), (2, "c b a"), (3, "b c a")]


def glyphs(spark, boxes, **more):
    cols = "".join(f", {k} {'double' if isinstance(v, float) or v is None else 'string'}" for k, v in more.items())
    return spark.createDataFrame([("d", float(x), float(y), float(w), float(h), *more.values()) for x, y, w, h in boxes], "k string, x double, y double, w double, h double" + cols)


def test_a_gap_of_twice_the_height_keeps_a_run(spark):
    line = [(0, 0, 10, 20), (50, 0, 10, 20), (101, 0, 10, 20), (150, 0, 10, 20)]
    pick = lambda c: [x for x, in rows(lines.pick_line(glyphs(spark, line, centre_x=c), ["k"]), "x")]
    assert pick(None) == [0, 50] and pick(5.0) == [0, 50] and pick(140.0) == [101, 150] and pick(900.0) == [0, 50]


def test_glyphs_off_the_line_go(spark):
    g = glyphs(spark, [(0, 0, 10, 20), (15, 0, 10, 20), (30, 40, 10, 20)], centre_x=None)
    assert [x for x, in rows(lines.pick_line(g, ["k"]), "x")] == [0, 15]
    assert lines.pick_line(glyphs(spark, [(3, 3, 3, 3)], centre_x=None), ["k"]).count() == 1


def test_blocks_beside_a_symbol(spark):
    two = [(5 + 12 * i, y, 10, 20) for y in (0, 30) for i in range(3)]
    far = [(5 + 12 * i, 200, 10, 20) for i in range(4)]
    g = lines.pick_block(glyphs(spark, two + far + [(300, 0, 10, 20)], centre_y=25.0), ["k"])
    assert rows(g, "line_no", "pos", "x") == [(0, 0, 5), (0, 1, 17), (0, 2, 29), (1, 3, 5), (1, 4, 17), (1, 5, 29)]
    assert {y for y, in rows(lines.pick_block(glyphs(spark, two + far, centre_y=230.0), ["k"]), "y")} == {200}
    assert {y for y, in rows(lines.pick_block(glyphs(spark, two + far, centre_y=None), ["k"]), "y")} == {0, 30}
    assert lines.pick_block(glyphs(spark, [(90, 0, 10, 20)], centre_y=None), ["k"]).count() == 0


def test_narrow_digits_stay_in_one_word(spark):
    # Two narrow ones at the pitch of the others: the space between them is their own.
    boxes = [(0, 0, 4, 20), (14, 0, 4, 20), (25, 0, 10, 20), (39, 0, 10, 20), (53, 0, 10, 20)]
    assert lines.pick_block(glyphs(spark, boxes, centre_y=None), ["k"]).count() == 5


def test_running_mean_of_bands(spark):
    ys = [0, 11, 22, 60]
    got = rows(lines.bands(glyphs(spark, [(i, y, 5, 20) for i, y in enumerate(ys)]), ["k"]), "y", "band")
    assert got == [(0, 0), (11, 0), (22, 1), (60, 2)]


def test_line_classes(spark):
    g = glyphs(spark, [(0, 0, 9, 20), (10, 0, 9, 20), (20, 6, 9, 14), (30, 6, 9, 19)]).withColumn("line_no", F.lit(0))
    c = lines.line_classes(g, ["k"])
    assert [(round(r, 2), d, low) for _, r, d, low in rows(c, "x", "rel", "descends", "lower")] == [(1, False, True), (1, False, True), (0.7, False, True), (0.95, True, True)]
    assert not lines.line_classes(glyphs(spark, [(0, 0, 9, 20), (9, 1, 9, 19)]).withColumn("line_no", F.lit(0)), ["k"]).first().lower


def test_word_gap_and_offsets(spark):
    r = spark.range(1).select(lines.word_gap(F.array(F.lit(2.0), F.lit(4.0)), F.lit(10.0)).alias("a"), lines.word_gap(F.array().cast("array<double>"), F.lit(10.0)).alias("b"), lines.word_gap(F.array(F.lit(0.5)), F.lit(20.0)).alias("c")).first()
    assert (r.a, r.b, r.c) == (12, 20, 7)
    d = spark.createDataFrame([("k", i, 100, 20.0) for i in range(3)], "k string, line_no int, w int, hm double")
    assert [x for _, x in rows(lines.line_offsets(d, ["k"]), "line_no", "x_offset")] == [0, 118, 236]


def unit(*v):
    v = np.array(v, float)
    return (v / np.sqrt((v * v).sum())).tolist()


def test_template_gates(spark):
    pairs = spark.createDataFrame([("a", "X", 0.70, 1), ("a", "Y", 0.68, 2), ("b", "X", 0.9, 1), ("b", "Y", 0.89, 2), ("c", "X", 0.99, 1), ("e", "X", 0.5, 1), ("e", "Y", 0.5, 2)], "g string, ch string, s double, o int")
    n = templates.nearest_two(pairs, ["g"], "ch", F.col("s"), "o").withColumn("c", F.coalesce(templates.accepted(F.col("best"), F.col("top"), F.round("margin", 9)), F.lit("?")))
    assert rows(n, "g", "best", "c") == [("a", "X", "X"), ("b", "X", "?"), ("c", "X", "?"), ("e", "X", "?")]


def test_read_with_fonts(spark):
    """Against the rule, glyph by glyph: ties, one candidate only, no templates of the height, and no vector."""
    made = [("Arial", 20, "A", [1.0, 0.0]), ("Arial", 20, "B", [0.0, 1.0]), ("Arial", 20, "C", [0.0, 1.0]), ("Calibri", 20, "A", [0.8, 0.6]), ("Arial", 40, "A", [1.0, 0.0]), ("Arial", 20, "a", [1.0, 0.0])]
    t = spark.createDataFrame(made, "font string, h_bucket int, ch string, v array<double>")
    m = spark.createDataFrame([(f, c, 0.7 if c == "a" else 1.0, False) for f in ("Arial", "Calibri") for c in "ABCa"], "font string, ch string, rel double, descends boolean")
    seen = [("k", 0, 20.0, [1.0, 0.0], 1.0), ("k", 1, 20.0, [0.0, 1.0], 1.0), ("k", 2, 40.0, [1.0, 0.0], 1.0), ("k", 3, 80.0, [1.0, 0.0], 1.0), ("k", 4, 20.0, None, 1.0), ("small", 0, 20.0, [1.0, 0.0], 0.7), ("small", 1, 20.0, [0.6, 0.8], 1.0)]
    g = spark.createDataFrame(seen, "k string, pos int, h double, v array<double>, rel double").withColumn("descends", F.lit(False)).withColumn("lower", F.col("k") == "small")
    got = {(r.k, r.font): (r.text, [round(x, 9) for x in r.margins], round(r.fit, 9)) for r in templates.read_with_fonts(g, t, m, ["k"], ("Arial", "Calibri")).collect()}

    def plain(k, font):
        text, margins, fit, own = "", [], 0.0, [x for x in seen if x[0] == k]
        for _, _, h, v, rel in own:
            kin = [(c, w) for f, b, c, w in made if f == font and b == h and v and (abs(rel / (0.7 if c == "a" else 1.0) - 1) <= 0.15 if k == "small" else c.isupper())]
            s = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), c) for c, w in kin), key=lambda x: (x[0], x[1]))
            margin, top = (s[1][0] - s[0][0], -s[0][0]) if len(s) > 1 else (0.0, 0.0)
            text += s[0][1] if len(s) > 1 and margin >= K.TEMPLATE_MARGIN and top >= K.TEMPLATE_SIMILARITY else "?"
            margins.append(round(margin, 9))
            fit += top
        return text, margins, round(fit / len(own), 9)

    assert got == {(k, f): plain(k, f) for k in ("k", "small") for f in ("Arial", "Calibri")} and got["k", "Arial"][0] == "A????"


def test_font_gates(spark):
    r = lambda *fits: spark.createDataFrame([("k", f, "12", x) for f, x in zip(("Arial", "Calibri"), fits, strict=False)], "k string, font string, text string, fit double")
    choose = lambda *fits, **kw: templates.choose_font(r(*fits), ["k"], **kw).select("font", "text", "why").first()
    assert choose(0.83, 0.5) == ("Arial", "12", None) and choose(0.829, 0.5) == ("Arial", "??", "poor-fit")
    assert choose(0.5, 0.9) == ("Calibri", "12", None) and choose(0.9, 0.895) == ("Arial", "??", "ambiguous-font")
    assert choose(0.9, 0.5, missing=("Calibri",)) == ("Arial", "", "font-missing") and choose(0.95).why is None


def plain_leaders(rows_, th, votes=2):
    """The rule, written for single vectors."""
    cs = []
    for i, (v, h) in enumerate(rows_):
        best, at = -1, None
        for c in cs:
            ratio = h / c["h"]
            s = float(np.dot(c["v"].astype(float), v))
            if 0.8 <= ratio <= 1.25 and s > best:
                best, at = s, c
        if at is not None and best >= th:
            n = len(at["m"])
            c = ((at["v"].astype(float) * n + v) / (n + 1)).astype(np.float32)
            at["v"] = (c / np.sqrt((c.astype(float) ** 2).sum())).astype(np.float32)
            at["h"] = (at["h"] * n + h) / (n + 1)
            at["m"].append(i)
        else:
            cs.append({"v": v.astype(np.float32), "h": h, "m": [i]})
    for c in cs:
        if len(c["m"]) >= votes or not c["m"]:
            continue
        best, at = -1, None
        for d in cs:
            s = float(np.dot(c["v"].astype(float), d["v"].astype(float)))
            if d is not c and len(d["m"]) >= votes and 0.8 <= c["h"] / d["h"] <= 1.25 and s > best:
                best, at = s, d
        if at is not None and best >= th:
            at["m"] += c["m"]
            c["m"] = []
    out = {i: k for k, c in enumerate(cs) for i in c["m"]}
    return [out[i] for i in range(len(rows_))]


def test_leaders_against_a_plain_model():
    rng = np.random.default_rng(5)
    for _ in range(20):
        base = rng.normal(size=(4, 12))
        v = base[rng.integers(0, 4, 40)] + rng.normal(size=(40, 12)) * 0.35
        v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
        h = rng.choice([10.0, 12.0, 20.0], 40)
        assert clusters.leaders(v, h, 0.85).tolist() == plain_leaders(list(zip(v, h, strict=True)), 0.85)


def test_an_orphan_joins_an_established_cluster():
    a = np.array([unit(1, 0.43), unit(1, -0.05), unit(1, 0.0), unit(1, 0.42)], np.float32)
    assert clusters.leaders(a[[0, 1, 2]], np.full(3, 10.0), 0.92).tolist() == [0, 1, 1]
    b = np.array([unit(1, 0.40), unit(1, -0.04), unit(1, 0.06)], np.float32)
    assert clusters.leaders(b, np.full(3, 10.0), 0.92).tolist() in ([1, 1, 1], [0, 0, 0])


def test_votes(spark):
    data = [(1, "a")] + [(2, x) for x in "aabb"] + [(3, x) for x in "aaaab"] + [(4, x) for x in "aaab"] + [(5, None)]
    v = clusters.vote(spark.createDataFrame(data, "k int, c string"), ["k"], "c")
    assert rows(v, "k", "label", "confidence") == [(1, "?", 1.0), (2, "?", 0.5), (3, "a", 0.8), (4, "?", 0.75), (5, "?", 0.0)]


CASES = [
    ({}, "OK", "match"),
    ({"early": "skewed"}, "CHECK", "early"),
    ({"ocr": None}, "NOTEXT", "no-text"),
    ({"ocr2": ""}, "CHECK", "second-empty"),
    ({"pdf_text": "9"}, "CHECK", "text-layer"),
    ({"pdf_text": "12"}, "OK", "match"),
    ({"ocr2": "13"}, "CHECK", "readings-differ"),
    ({"conflict": [0]}, "CHECK", "resolutions-differ"),
    ({"shape": "?3"}, "CHECK", "partial-shape-conflict"),
    ({"shape": "1??"}, "OK", "match"),
    ({"shape": "?23"}, "CHECK", "partial-shape-conflict"),
    ({"template": "3?"}, "CHECK", "partial-template-conflict"),
    ({"template": "13"}, "CHECK", "tracks-differ"),
    ({"shape": "", "template": ""}, "CHECK", "single-track"),
    ({"score": 0.79, "template": ""}, "CHECK", "low-score"),
    ({"score": 0.79}, "OK", "match"),
    ({"score": 0.80, "template": "1?"}, "CHECK", "template-unread"),
    ({"template": "??", "why": "poor-fit"}, "CHECK", "template-not-applicable"),
    ({"template": ""}, "CHECK", "template-incomplete"),
    ({"value": "21"}, "NG", "differs-from-value"),
    ({"value": None}, "NG", "differs-from-value"),
]


def test_verdict_cascade(spark):
    base = {"value": "12", "ocr": "12", "ocr2": "12", "pdf_text": None, "score": 0.9, "shape": "12", "template": "12", "conflict": [], "why": None, "early": None}
    data = [(i, *(base | change).values()) for i, (change, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(data, "i int, value string, ocr string, ocr2 string, pdf_text string, score double, shape string, template string, conflict array<int>, why string, early string")
    got = {r.i: (r.verdict, r.reason_code) for r in judge(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [(v, c) for _, v, c in CASES]


def test_no_ok_without_a_complete_template(spark):
    rng = random.Random(1)
    pick = lambda: rng.choice([None, "", "12", "1?", "??", "13"])
    data = [(rng.choice(["12", "13"]), pick(), pick(), pick(), rng.random(), pick(), pick(), rng.choice([None, [], [0]]), rng.choice([None, "poor-fit"]), rng.choice([None, None, "skewed"])) for _ in range(600)]
    df = judge(spark.createDataFrame(data, "value string, ocr string, ocr2 string, pdf_text string, score double, shape string, template string, conflict array<int>, why string, early string"))
    for r in df.collect():
        assert r.reason and r.verdict in ("OK", "NG", "CHECK", "NOTEXT")
        if r.verdict in ("OK", "NG"):
            assert r.template and "?" not in r.template and r.template == r.ocr == r.ocr2 and (r.verdict == "OK") == (r.ocr == r.value)


def test_count_anomalies(spark):
    c = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 0), (2, 1, 0), (2, 2, 0), (3, 1, 1), (3, 2, 2)], "p int, label int, n int")
    assert rows(summary.count_anomalies(c, ["p"]), "p", "label", "mode") == [(1, 3, 3), (3, 1, 2)]
    assert rows(summary.count_anomalies(c.where("p = 1"), []), "label", "mode") == [(3, 3)]


@pytest.mark.parametrize(("verdicts", "warned", "counted", "level", "chk"), [(["OK"], 0, True, "ok", 0), (["OK"], 0, False, "warn", 0), (["OK"], 1, True, "bad", 0), ([None], 0, True, "bad", 0), (["OK", "NOTEXT"], 0, True, "bad", 1), (["NG"], 0, True, "bad", 0)])
def test_summary(spark, verdicts, warned, counted, level, chk):
    df = spark.createDataFrame([("d", v) for v in verdicts], "d string, verdict string")
    r = summary.summarize(df, ["d"], F.lit(warned), F.lit(counted)).first()
    assert (r.level, r.chk, r.n) == (level, chk, sum(v is not None for v in verdicts))


def test_duplicates_of_symbols(spark):
    corners = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    data = [("d", 1, i, "QR", "t", corners(float(x), float(y))) for i, (x, y) in enumerate([(0, 0), (19, 19), (20, 0), (38, 19)])] + [("d", 2, i, "QR", "t", corners(100.0 * i, 0.0)) for i in range(70)]
    s = sequential.first_symbols(spark.createDataFrame(data, "doc_id string, page_no int, seq int, fmt string, text string, corners array<struct<x: double, y: double>>"))
    # The last one is near a dropped and near a kept one.
    assert rows(s.where("page_no = 1"), "seq") == [(0,), (2,)] and s.where("page_no = 2").count() == K.SYMBOLS_PER_PAGE


def test_placement_prefers_blank_space_below(spark):
    page = np.full((200, 300), 255, np.uint8)
    mark = {"x0": 50, "y0": 50, "x1": 150, "y1": 70, "h": 20, "n_lines": 1, "ox": 0, "oy": 0, "angle": 0}
    best = sequential.place_marks(page, [mark, mark])
    assert best[0]["scale"] == 1 and best[0]["y0"] > 70 and best[0]["cost"] == 0 and best[1]["y1"] < 50
    page[70:] = 0
    assert sequential.place_marks(page, [mark])[0]["y1"] < 50
    m = spark.createDataFrame(pd.DataFrame([{"doc_id": "d", "page_no": 1, "mark": 0} | {k: float(v) for k, v in mark.items()}]))
    p = spark.createDataFrame([("d", 1, 300, 200, bytearray(page.tobytes()))], "doc_id string, page_no long, width int, height int, pixels binary")
    assert sequential.placements(m, p).first().y1 < 50


def test_text_areas_decide_whole_overlaps_as_their_sql_does(spark, tmp_path):
    # Overlaps of 11, 8834 and 624 less 0.137, which the SQL's doubles put at, at and just below the whole number.
    orders = [(27807, 13949, 63131.95, "1997-02-09"), (47166, 6110, 366479.75, "2000-05-17"), (10680, 6916, 425286.25, "2000-08-01")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, day string").withColumn("o_orderdate", F.to_timestamp("day")).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(pieces.text_areas(spark, str(tmp_path)), "o_orderkey", "overlap") == [(10680, 623), (27807, 11), (47166, 8834)]
