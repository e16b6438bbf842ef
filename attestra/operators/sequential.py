"""Operators that depend on what was kept or placed before: duplicates of symbols, and placement of printed values.

Each scans one page in its given order; pages spread over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.pixels import ink_inside, ink_sums


def first_of_neighbours(rows: DataFrame, by: list[str], order: list[str], places: list[str], radius: float = K.DUPLICATE_RADIUS) -> DataFrame:
    """rows without those that lie nearer than radius, in every one of places, to a row kept before in the order.

    A group is gathered and scanned in its order, in the JVM; the rows kept are compared with each row. Columns of a
    map type aren't supported, as rows that the order doesn't tell apart are taken by their other columns. Nulls are
    near to nothing.
    """
    one = F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.struct(*rows.columns).alias("_row"))
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_all")).select(F.col("_all._row").alias("_all"))
    near = lambda x, y: reduce(and_, (F.coalesce(F.abs(x[p].cast("double") - y[p].cast("double")) < radius, F.lit(False)) for p in places))
    keep = lambda kept, x: F.when(F.exists(kept, lambda y: near(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
    return packed.select(F.explode(F.aggregate("_all", F.filter("_all", lambda x: F.lit(False)), keep)).alias("_row")).select("_row.*")


def first_symbols(observations: DataFrame) -> DataFrame:
    """Symbols of each page in the decoder's order, at most 64, without repeats of a symbol at the same place; with the
    box of the corners and their mean as centre."""
    xs, ys = F.col("corners.x"), F.col("corners.y")
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / 4
    number = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("seq"))
    o = observations.withColumn("_n", number).where(F.col("_n") <= K.SYMBOLS_PER_PAGE).drop("_n").withColumn("mx", mean(xs)).withColumn("my", mean(ys))
    o = o.withColumn("x0", F.array_min(xs)).withColumn("y0", F.array_min(ys)).withColumn("x1", F.array_max(xs)).withColumn("y1", F.array_max(ys))
    return first_of_neighbours(o, ["doc_id", "page_no"], ["seq"], ["mx", "my"])


def place_marks(page: np.ndarray, marks: list[dict]) -> list[dict]:
    """Where to print each mark's value near its text: scale, box and cost.

    Each mark has a box x0, y0, x1, y1 of its glyphs on an upright label, their height h, n_lines, an origin ox, oy
    and an angle. Below the text and above it are tried at falling scales; cost is the share of the box that is ink,
    overlaps a box placed before, or lies off the page (which counts by half). The first clean place is taken, else the
    cheapest, the earlier one unless a later is cheaper by more than rounding.
    """
    sums, placed, out = ink_sums(page), [], []
    high, wide = page.shape[:2]
    for m in marks:
        a = np.radians(m["angle"])
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        left, right = m["x0"] - 0.2 * m["h"], m["x1"] + 0.2 * m["h"]
        best = None
        for scale in K.PLACE_SCALES:
            size = m["h"] * scale
            deep, gap = 1.3 * size * m["n_lines"], 0.08 * (m["h"] + size)
            for top in (m["y1"] + gap, m["y0"] - gap - deep):
                p = np.array([[x, y] for x in (left, right) for y in (top, top + deep)]) @ turn.T + [m["ox"], m["oy"]]
                b = [*p.min(0), *p.max(0)]
                area = (b[2] - b[0]) * (b[3] - b[1])
                inside = (min(b[2], wide) - max(b[0], 0)) * (min(b[3], high) - max(b[1], 0))
                over = sum(max(0, min(b[2], q[2]) - max(b[0], q[0])) * max(0, min(b[3], q[3]) - max(b[1], q[1])) for q in placed)
                cost = (ink_inside(sums, b) + over + K.PLACE_OUTSIDE * (area - max(0, inside))) / area
                if best is None or cost < best["cost"] - 1e-9:
                    best = {"scale": scale, "x0": b[0], "y0": b[1], "x1": b[2], "y1": b[3], "cost": cost}
            if best["cost"] < K.PLACE_BLANK:
                break
        placed.append([best[k] for k in ("x0", "y0", "x1", "y1")])
        out.append(best)
    return out


def placements(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, mark, scale, x0, y0, x1, y1, cost) of marks (doc_id, page_no, mark, x0, y0, x1, y1, h, n_lines,
    ox, oy, angle) on pages (doc_id, page_no, width, height, pixels: grey, one byte each)."""
    page = ["doc_id", "page_no"]
    schema = "scale double, x0 double, y0 double, x1 double, y1 double, cost double"
    ids = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marks.select(*page, "mark").schema)

    def scan(key: tuple, m: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        m = m.sort_values("mark")
        if p.empty or m.empty:
            return pd.DataFrame(columns=[*page, "mark", "scale", "x0", "y0", "x1", "y1", "cost"])
        grey = np.frombuffer(p.pixels.iloc[0], np.uint8).reshape(int(p.height.iloc[0]), int(p.width.iloc[0]))
        found = pd.DataFrame(place_marks(grey, m.to_dict("records")), index=m.index)
        return pd.concat([m[[*page, "mark"]], found], axis=1)

    return marks.groupBy(*page).cogroup(pages.groupBy(*page)).applyInPandas(scan, f"{ids}, {schema}")
