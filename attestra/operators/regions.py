"""Joins of symbols, label frames, neighbours and words by place.

Every join has the page (doc_id, page_no) as equality key, so it is a hash or sort-merge join whose candidates are
those of one page; a page holds at most 64 symbols, and frames and words in proportion to its area.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.geometry import box, quarter
from attestra.functions.vectors import half_up

PAGE = ["doc_id", "page_no"]


def frames_of_paths(paths: DataFrame, dpi: int = K.DPI) -> DataFrame:
    """(doc_id, page_no, frame_idx, x0, y0, x1, y1): stroked paths that are large enough for a label's frame.

    paths: doc_id, page_no, paint (stroke or fill), x0, y0, x1, y1 in pixels. Frames are numbered by area, then top,
    then left, so that the first one around a point is the smallest.
    """
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    f = paths.where((F.col("paint") != "fill") & (wide > K.FRAME_WIDTH * dpi / 72) & (high > K.FRAME_HEIGHT * dpi / 72))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(wide * high, "y0", "x0", "x1")) - 1
    return f.select(*PAGE, n.alias("frame_idx"), "x0", "y0", "x1", "y1")


#: Operations that paint a path's line, and those that only fill it.
STROKES, FILLS = ("stroke", "closeStroke", "closeFillStroke", "fillStroke", "eoFillStroke", "closeEOFillStroke"), ("fill", "eoFill")


def _placed(ops: list[str], args: list, view: list[float]) -> list[list[float]]:
    """Boxes of the paths that a page's drawing operations stroke, in pixels."""
    matrix = lambda m: np.array([[m[0], m[2], m[4]], [m[1], m[3], m[5]], [0, 0, 1]], float)
    now, stack, path, out, view = np.eye(3), [], None, [], matrix(view)
    for op, a in zip(ops, args, strict=True):
        if op in ("save", "beginForm"):
            stack.append(now)
            now = now @ matrix(a) if op == "beginForm" and a is not None and len(a) else now
        elif op in ("restore", "endForm"):
            now = stack.pop() if stack else np.eye(3)
        elif op == "transform":
            now = now @ matrix(a)
        elif op == "path":
            path = np.array(a, float) if a is not None and len(a) == 4 and np.isfinite(np.array(a, float)).all() else None
        elif op in STROKES or op in FILLS:
            if path is not None and op in STROKES:
                corners = (view @ now @ np.array([path[[0, 2, 2, 0]], path[[1, 1, 3, 3]], np.ones(4)]))[:2]
                out.append([*corners.min(1), *corners.max(1)])
            path = None
    return out


def paths_of_draws(draws: DataFrame) -> DataFrame:
    """(doc_id, page_no, paint, x0, y0, x1, y1), as frames_of_paths() takes them, of a page's drawing operations.

    draws: doc_id, page_no, n (the order), op, args array<double>, view array<double> (six numbers of the page's map to
    pixels). op: save, restore, transform (six numbers), beginForm (six or none), endForm, path (its least and largest
    x and y: x0, y0, x1, y1), or one of STROKES or FILLS. A path is painted once; a page whose operations can't be
    followed has no paths. The state is a stack, so a page's operations are scanned in order.
    """
    schema = draws.select(*PAGE).schema
    for name, kind in (("paint", "string"), ("x0", "double"), ("y0", "double"), ("x1", "double"), ("y1", "double")):
        schema = schema.add(name, kind)

    def scan(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n", kind="stable")
        try:
            found = _placed(g.op.tolist(), g.args.tolist(), g["view"].iloc[0])
        except (ValueError, IndexError, TypeError):
            found = []
        return pd.DataFrame([(*key, "stroke", *b) for b in found], columns=schema.names)

    return draws.groupBy(*PAGE).applyInPandas(scan, schema)


def smallest_container(points: DataFrame, boxes: DataFrame, on: list[str], key: list[str], x: str = "cx", y: str = "cy", label: str = "label") -> DataFrame:
    """points with the index of the smallest box around each, edges inside; -1 where there is none.

    boxes: on, frame_idx, x0, y0, x1, y1. key identifies a point. Equal areas: the upper, then the left one.
    """
    px, py = F.col(f"p.{x}"), F.col(f"p.{y}")
    inside = (px >= F.col("b.x0")) & (px <= F.col("b.x1")) & (py >= F.col("b.y0")) & (py <= F.col("b.y1"))
    same = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in on]
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    pairs = points.select(*on, *[c for c in key if c not in on], x, y).alias("p").join(boxes.alias("b"), [*same, inside])
    best = pairs.groupBy(*[F.col(f"p.{c}").alias(c) for c in dict.fromkeys([*on, *key])]).agg(F.min_by("b.frame_idx", F.struct(area, F.col("b.y0"), F.col("b.x0"), F.col("b.frame_idx"))).alias(label))
    return points.join(best, list(dict.fromkeys([*on, *key])), "left").withColumn(label, F.coalesce(F.col(label), F.lit(-1)))


def neighbour_clip(items: DataFrame, on: list[str], key: str, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """(on, key, left, top, right, bottom): room of each item up to the midlines to its neighbours.

    items: on, key, cx, cy. A neighbour further off sideways than up or down bounds the left or right (a neighbour at
    the same cx the right), others the top or bottom (at the same cy the bottom). The items' own columns width and height
    bound the rest, or else the constants given.
    """
    me, other = items.alias("a"), items.select(*on, key, "cx", "cy").alias("b")
    pairs = me.join(other, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [F.col(f"a.{key}") != F.col(f"b.{key}")], "left")
    dx, dy = F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy")
    beside = F.abs(dx) > F.abs(dy)
    mx, my = (F.col("b.cx") + F.col("a.cx")) / 2, (F.col("b.cy") + F.col("a.cy")) / 2
    sized = "width" in items.columns
    room = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in [*on, key]]).agg(
        F.max(F.when(beside & (dx < 0), mx)).alias("left"),
        F.max(F.when(~beside & (dy < 0), my)).alias("top"),
        F.min(F.when(beside & (dx >= 0), mx)).alias("right"),
        F.min(F.when(~beside & (dy >= 0), my)).alias("bottom"),
        *([F.first("a.width").alias("_w"), F.first("a.height").alias("_h")] if sized else []),
    )
    w, h = (F.col("_w"), F.col("_h")) if sized else (width, height)
    zero = F.lit(0.0)
    return room.select(*on, key, F.greatest(zero, "left").alias("left"), F.greatest(zero, "top").alias("top"), F.least(w, "right").alias("right"), F.least(h, "bottom").alias("bottom"))


def clips(symbols: DataFrame, frames: DataFrame) -> DataFrame:
    """symbols with struct columns clip and clip_right, the room of the text below and to the right.

    symbols: doc_id, page_no, seq, width, height (of the page), x0, y0, x1, y1 and label. A symbol with a frame has
    the frame as its room for both. Without, the room ends at midlines; to the right, it ends two pixels before the
    next symbol that shares some of its height.
    """
    s = symbols.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    room = neighbour_clip(s.select(*PAGE, "seq", "cx", "cy", "width", "height"), PAGE, "seq")
    a, b = s.select(*PAGE, "seq", "x1", "y0", "y1").alias("a"), s.select(*PAGE, "seq", "x0", "y0", "y1").alias("b")
    shares = F.least("a.y1", "b.y1") - F.greatest("a.y0", "b.y0") > 0
    ahead = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in PAGE] + [F.col("a.seq") != F.col("b.seq"), F.col("b.x0") >= F.col("a.x1"), shares])
    ahead = ahead.groupBy("a.doc_id", "a.page_no", "a.seq").agg((F.min("b.x0") - 2).alias("next"))
    f = frames.select(*PAGE, F.col("frame_idx").alias("label"), box(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))).alias("frame"))
    out = symbols.join(room, [*PAGE, "seq"], "left").join(ahead, [*PAGE, "seq"], "left").join(f, [*PAGE, "label"], "left")
    below = box(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))
    right = box(F.col("left"), F.col("top"), F.least(F.col("width").cast("double"), F.col("next")), F.col("bottom"))
    return out.withColumn("clip", F.coalesce("frame", below)).withColumn("clip_right", F.coalesce("frame", right)).drop("left", "top", "right", "bottom", "next", "frame")


def words_in_areas(areas: DataFrame, words: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    """(on, key, words): text of the words whose centre lies in an area, edges inside, in reading order.

    areas: on, key, rect, angle. words: on, x, y, w, h, s. Blank words don't count. At 0 and 180 degrees words are
    ordered by tenths of y, then x; at 90 and 270 by tenths of x, then y; at 180 and 270 the other way round. Areas
    without a word have no row.
    """
    w = words.where(F.trim("s") != "").withColumn("wx", F.col("x") + F.col("w") / 2).withColumn("wy", F.col("y") + F.col("h") / 2)
    a = areas.where("rect is not null").alias("a")
    inside = (F.col("wx") >= F.col("a.rect.x0")) & (F.col("wx") <= F.col("a.rect.x1")) & (F.col("wy") >= F.col("a.rect.y0")) & (F.col("wy") <= F.col("a.rect.y1"))
    pairs = a.join(w.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on] + [inside])
    q = quarter(F.col("a.angle"))
    level = q.isin(0, 180)
    sign = F.when(q.isin(180, 270), -1).otherwise(1)
    order = F.struct((sign * half_up(10 * F.when(level, F.col("b.y")).otherwise(F.col("b.x")))).alias("line"), (sign * F.when(level, F.col("b.x")).otherwise(F.col("b.y"))).alias("place"), F.col("b.s").alias("s"))
    out = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in dict.fromkeys([*on, *key])]).agg(F.array_sort(F.collect_list(order)).alias("_w"))
    return out.withColumn("words", F.array_join("_w.s", " ")).drop("_w")
