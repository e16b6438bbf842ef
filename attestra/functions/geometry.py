"""Areas around a symbol and maps between a page and an upright crop, as column arithmetic.

Boxes are struct<x0, y0, x1, y1>, corners struct<x, y> of top left, top right, bottom right and bottom left in the
symbol's own reading order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.vectors import half_up

NO_AREA_SKEW = 99.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once; a plain Column would be written out wherever it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def quarter(angle: Column) -> Column:
    """Angle in degrees, rounded, from 0 to 359."""
    return F.pmod(half_up(angle), F.lit(360))


def text_area(corners: Column, width: Column, height: Column, clip: Column, side: str) -> Column:
    """struct<rect, angle, skew, cx, cy> of the text area `below` a symbol or to its `right`.

    Right and below are the symbol's own: its axis runs from top left to top right, and down is that turned by a
    quarter. The area is cut at the page and at clip (null: not). Without an area of two pixels each way rect is
    null and the skew unusable; angle is a multiple of 90 degrees, skew what the axis departs from it.
    """
    none = F.lit(None).cast("double")
    p = [F.get(corners, F.lit(i)) for i in range(4)]
    axis = F.struct((p[1]["x"] - p[0]["x"]).alias("x"), (p[1]["y"] - p[0]["y"]).alias("y"), corners.alias("c"), width.alias("w"), height.alias("h"), clip.alias("clip"))

    def unit(s: Column) -> Column:
        length = F.hypot(s["x"], s["y"])
        whole = F.when(length >= 1, length)
        return F.struct((s["x"] / whole).alias("x"), (s["y"] / whole).alias("y"), *(s[k].alias(k) for k in ("c", "w", "h", "clip")))

    def extents(u: Column) -> Column:
        along = F.transform(u["c"], lambda q: q["x"] * u["x"] + q["y"] * u["y"])
        down = F.transform(u["c"], lambda q: q["y"] * u["x"] - q["x"] * u["y"])
        ends = {"a0": F.array_min(along), "a1": F.array_max(along), "d0": F.array_min(down), "d1": F.array_max(down)}
        degrees = F.degrees(F.atan2(u["y"], u["x"]))
        return F.struct(u.alias("u"), degrees.alias("degrees"), *(v.alias(k) for k, v in ends.items()))

    def cut(e: Column) -> Column:
        u, wide, thick = e["u"], e["a1"] - e["a0"], e["d1"] - e["d0"]
        if side == "below":
            ends = [e["a0"] - wide * K.BELOW_SIDE, e["a1"] + wide * K.BELOW_SIDE]
            bands = [e["d1"] + thick * K.BELOW_GAP, e["d1"] + thick * (K.BELOW_GAP + K.BELOW_HEIGHT)]
            solid = thick >= 1
        else:
            ends = [e["a1"] + wide * K.RIGHT_GAP, e["a1"] + wide * (K.RIGHT_GAP + K.RIGHT_LENGTH)]
            bands = [e["d0"] - thick * K.RIGHT_ABOVE, e["d1"] + thick * K.RIGHT_BELOW]
            solid = (thick >= 1) & (wide >= 1)
        xs = [u["x"] * a - u["y"] * b for a in ends for b in bands]
        ys = [u["y"] * a + u["x"] * b for a in ends for b in bands]
        zero, ac, dc = F.lit(0.0), (e["a0"] + e["a1"]) / 2, (e["d0"] + e["d1"]) / 2
        rect = box(F.greatest(F.least(*xs), zero, u["clip"]["x0"]), F.greatest(F.least(*ys), zero, u["clip"]["y0"]), F.least(F.greatest(*xs), u["w"], u["clip"]["x1"]), F.least(F.greatest(*ys), u["h"], u["clip"]["y1"]))
        return F.struct(F.when(solid, rect).alias("r"), e["degrees"].alias("degrees"), (half_up(e["degrees"] / 90) * 90).alias("angle"), (u["x"] * ac - u["y"] * dc).alias("cx"), (u["y"] * ac + u["x"] * dc).alias("cy"))

    def area(s: Column) -> Column:
        some = F.coalesce((s["r"]["x1"] - s["r"]["x0"] >= 2) & (s["r"]["y1"] - s["r"]["y0"] >= 2), F.lit(False))
        return F.struct(
            F.when(some, s["r"]).alias("rect"),
            F.when(s["r"].isNotNull(), s["angle"]).otherwise(0).cast("int").alias("angle"),
            F.when(some, F.abs(s["degrees"] - s["angle"])).otherwise(NO_AREA_SKEW).alias("skew"),
            F.when(some, s["cx"]).otherwise(none).alias("cx"),
            F.when(some, s["cy"]).otherwise(none).alias("cy"),
        )

    return let(let(let(let(axis, unit), extents), cut), area)


def usable(area: Column) -> Column:
    return F.coalesce(area["rect"].isNotNull() & (area["skew"] <= K.MAX_SKEW), F.lit(False))


def page_to_crop(x: Column, y: Column, rect: Column, angle: Column) -> Column:
    """struct<x, y> in the upright crop of a page point; angles other than 0, 90 and 180 count as 270."""
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))

    def turn(s: Column) -> Column:
        left, right, top, bottom = s["x"] - s["r"]["x0"], s["r"]["x1"] - s["x"], s["y"] - s["r"]["y0"], s["r"]["y1"] - s["y"]
        return F.when(s["a"] == 0, point(left, top)).when(s["a"] == 90, point(top, right)).when(s["a"] == 180, point(right, bottom)).otherwise(point(bottom, left))

    return let(F.struct(x.alias("x"), y.alias("y"), rect.alias("r"), quarter(angle).alias("a")), turn)


def crop_to_page(b: Column, rect: Column, angle: Column) -> Column:
    """The page box of a box in the upright crop."""

    def turn(s: Column) -> Column:
        a, r = s["a"], s["r"]

        def point(x: Column, y: Column) -> tuple[Column, Column]:
            px = F.when(a == 0, r["x0"] + x).when(a == 90, r["x1"] - y).when(a == 180, r["x1"] - x).otherwise(r["x0"] + y)
            py = F.when(a == 0, r["y0"] + y).when(a == 90, r["y0"] + x).when(a == 180, r["y1"] - y).otherwise(r["y1"] - x)
            return px, py

        (px, py), (qx, qy) = point(s["b"]["x0"], s["b"]["y0"]), point(s["b"]["x1"], s["b"]["y1"])
        return box(F.least(px, qx), F.least(py, qy), F.greatest(px, qx), F.greatest(py, qy))

    return let(F.struct(b.alias("b"), rect.alias("r"), quarter(angle).alias("a")), turn)
