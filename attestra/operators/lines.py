"""Lines and blocks of glyphs, as windows over ordered rows.

Glyphs: key columns (of a crop), then x, y, w, h. A crop is one small group: windows are partitioned by it and no
group is gathered, except for row banding, which depends on a running mean and takes an ordered scan of a crop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.geometry import let
from attestra.functions.vectors import half_up, upper_median


def runs(df: DataFrame, by: list[str], order: list[Column | str], start: Column, end: Column, limit: Column, name: str = "run") -> DataFrame:
    """df with the number of its run from 0: a run ends where the gap from the row before's end exceeds the limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = F.coalesce((start - F.lag(end).over(w) > limit).cast("int"), F.lit(0))
    return df.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def longest_run(df: DataFrame, by: list[str], run: str = "run") -> DataFrame:
    """(by..., run, n): the run of most rows, the first one at ties."""
    n = df.groupBy(*by, run).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by(F.struct(run, "n"), F.struct("n", (-F.col(run)).alias("r"))).alias("b")).select(*by, f"b.{run}", "b.n")


def ink_gaps(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """glyphs with `gap`, the space before each, less half of what it and the glyph before are narrower than the
    line's upper median width; null for the first."""
    w = Window.partitionBy(*by).orderBy("x", "y")
    middle = glyphs.groupBy(*by).agg(upper_median(F.col("w")).alias("_m"))
    slack = F.greatest(F.lit(0.0), F.col("_m") - F.col("w")) / 2
    g = glyphs.join(middle, by).withColumn("_s", slack)
    return g.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) - F.lag("_s").over(w) - F.col("_s")).drop("_m", "_s")


def word_gap(gaps: Column, height: Column) -> Column:
    """The gap from which a new word begins, of an array of the line's gaps and the height of its letters."""
    middle = F.get(F.sort_array(gaps), F.floor(F.size(gaps) / 2).cast("int"))
    limit = F.least(2.0 * height, F.greatest(3.0 * F.greatest(middle, F.lit(1.0)), 0.35 * height))
    return F.when(F.size(gaps) > 0, limit).otherwise(2.0 * height)


def pick_line(glyphs: DataFrame, by: list[str], centre: str = "centre_x") -> DataFrame:
    """Glyphs of the one line of text that belongs to the symbol above it.

    Of the glyphs near the upper median height of the middle, runs are told apart by gaps over twice the upper median
    height. The first run around the symbol's centre (column centre, null: unknown), give or take that height, is
    the line, else the longest, first at ties. A single glyph is a line.
    """
    cy = F.col("y") + F.col("h") / 2
    m = glyphs.groupBy(*by).agg(upper_median(F.col("h")).alias("_h"), upper_median(cy).alias("_c"), F.count("*").alias("_n"))
    g = glyphs.join(m, by).where((F.col("_n") < 2) | (F.abs(cy - F.col("_c")) <= 0.6 * F.col("_h")))
    g = runs(g, by, ["x", "y"], F.col("x"), F.col("x") + F.col("w"), 2.0 * F.col("_h"), "_run")
    last = F.max_by(F.col("x") + F.col("w"), F.struct("x", "y"))
    r = g.groupBy(*by, "_run").agg(F.count("*").alias("n"), F.min("x").alias("a"), last.alias("b"), F.first("_h").alias("hm"), F.first(centre).alias("c"))
    hit = F.coalesce((F.col("c") >= F.col("a") - F.col("hm")) & (F.col("c") <= F.col("b") + F.col("hm")), F.lit(False))
    # Among runs that are hit the first; if none is, the longest, then the first.
    best = r.groupBy(*by).agg(F.max_by("_run", F.struct(hit.cast("int"), F.when(hit, 0).otherwise(F.col("n")), -F.col("_run"))).alias("_run"))
    return g.join(best, [*by, "_run"]).drop("_run", "_h", "_c", "_n")


def bands(glyphs: DataFrame, by: list[str]) -> DataFrame:
    """glyphs with `band`, rows from above: in the order of their middle (then x), a glyph joins the last row if it is
    within 0.6 of the upper median height of the row's mean middle so far. The mean moves, so a crop's glyphs are
    gathered and scanned in their order; there are as many as a crop has, and the scan stays in the JVM."""
    rest = [c for c in glyphs.columns if c not in by]
    one = F.struct((F.col("y") + F.col("h") / 2).alias("_c"), F.col("x").alias("_x"), F.struct(*rest).alias("_g"))
    packed = glyphs.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    heights = F.sort_array(F.transform("_all", lambda g: g["_g"]["h"].cast("double")))
    packed = packed.withColumn("_near", 0.6 * F.get(heights, F.floor(F.size("_all") / 2).cast("int")))
    state = "struct<band: int, mean: double, n: int, of: array<int>>"

    def join(s: Column, g: Column) -> Column:
        c = g["_c"].cast("double")
        near = (s["n"] > 0) & (F.abs(c - s["mean"]) <= F.col("_near"))
        band = F.when(near, s["band"]).otherwise(s["band"] + 1)
        mean = F.when(near, (s["mean"] * s["n"] + c) / (s["n"] + 1)).otherwise(c)
        n = F.when(near, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(band.alias("band"), mean.alias("mean"), n.alias("n"), F.concat(s["of"], F.array(band)).alias("of")).cast(state)

    start = F.struct(F.lit(-1).alias("band"), F.lit(0.0).alias("mean"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of")).cast(state)
    packed = packed.withColumn("_of", F.aggregate("_all", start, join)["of"])
    out = packed.select(*by, F.explode(F.arrays_zip(F.col("_all._g").alias("g"), F.col("_of").alias("band"))).alias("z"))
    return out.select(*by, "z.g.*", F.col("z.band").alias("band")).select(*glyphs.columns, "band")


def pick_block(glyphs: DataFrame, by: list[str], anchor: str = "centre_y", by_words: bool = True) -> DataFrame:
    """Glyphs of the block of lines beside a symbol, with line_no from above and pos from the left.

    Each band is cut after its first gap over the limit (that of words, or twice the upper median height), and
    counts only if it starts within three heights of the symbol. Lines further apart than 2.2 heights are different
    blocks. The first block that spans the anchor, give or take a height, is taken, else the one with the nearest
    edge; without an anchor the one of most glyphs, the first at ties.
    """
    line = [*by, "band"]
    height = glyphs.groupBy(*by).agg(upper_median(F.col("h")).alias("_h"))
    g = bands(glyphs, by).join(height, by)
    w = Window.partitionBy(*line).orderBy("x", "y")
    if by_words:
        g = ink_gaps(g, line)
        gaps = g.groupBy(*line).agg(F.collect_list("gap").alias("_gaps"))
        g = g.join(gaps, line).withColumn("_limit", word_gap(F.col("_gaps"), F.col("_h"))).drop("_gaps")
    else:
        g = g.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)).withColumn("_limit", 2.0 * F.col("_h"))
    ended = F.max(F.coalesce((F.col("gap") > F.col("_limit")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = g.withColumn("_ended", ended).withColumn("_first", F.first("x").over(w)).where("_ended = 0 and _first <= 3 * _h")
    lines = g.groupBy(*line).agg(F.avg(F.col("y") + F.col("h") / 2).alias("cy"), F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"), F.count("*").alias("n"), F.first("_h").alias("hm"), F.first(anchor).alias("anchor"))
    lines = runs(lines, by, ["band"], F.col("cy"), F.col("cy"), 2.2 * F.col("hm"), "block")
    b = lines.groupBy(*by, "block").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sum("n").alias("n"), F.first("hm").alias("hm"), F.first("anchor").alias("anchor"))
    spans = F.coalesce((F.col("anchor") >= F.col("top") - F.col("hm")) & (F.col("anchor") <= F.col("bottom") + F.col("hm")), F.lit(False))
    off = F.when(spans, 0.0).when(F.col("anchor").isNotNull(), F.least(F.abs(F.col("anchor") - F.col("top")), F.abs(F.col("anchor") - F.col("bottom")))).otherwise(-F.col("n"))
    best = b.groupBy(*by).agg(F.min_by("block", F.struct((~spans).cast("int"), off, "block")).alias("block"))
    kept = lines.select(*line, "block").join(best, [*by, "block"]).drop("block")
    g = g.join(kept, line).drop("_h", "_limit", "_ended", "_first", "gap")
    g = g.withColumn("line_no", F.dense_rank().over(Window.partitionBy(*by).orderBy("band")) - 1)
    return g.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("line_no", "x", "y")) - 1).drop("band")


def line_classes(glyphs: DataFrame, by: list[str], line: str = "line_no") -> DataFrame:
    """glyphs with rel, descends and `lower`: height against the line's capitals, whether it drops below the baseline,
    and whether anything in the group (all its lines) shows small letters. A line's glyphs are gathered once, and all
    of it is computed on them; there are as many as a crop has."""
    each = [*by, line]
    rest = [c for c in glyphs.columns if c not in each]
    heights = lambda of: F.transform(of, lambda g: g["h"])
    middle = lambda values: let(F.sort_array(F.array_compact(values)), lambda v: F.get(v, F.floor(F.size(v) / 2).cast("int")))
    on = lambda s, g: F.abs(g["_bottom"] - s["base"]) <= s["tol"]

    # Each step is bound once; plain columns would be written out for each glyph.
    def base(g: Column) -> Column:
        return F.struct(g.alias("g"), middle(F.transform(g, lambda x: x["_bottom"])).alias("base"), (middle(heights(g)) * 0.08).alias("tol"))

    def top(s: Column) -> Column:
        return F.struct(s.alias("s"), F.array_max(heights(F.filter(s["g"], lambda x: on(s, x)))).alias("high"), F.array_max(heights(s["g"])).alias("any"))

    def cap(t: Column) -> Column:
        s, highest = t["s"], F.coalesce(t["high"], t["any"])
        tall = F.filter(s["g"], lambda x: (on(s, x) | t["high"].isNull()) & (x["h"] >= K.SMALL * highest))
        return F.struct(s.alias("s"), F.coalesce(middle(heights(tall)), highest).alias("cap"))

    def told(t: Column) -> Column:
        s = t["s"]
        return F.transform(s["g"], lambda x: F.struct(x.alias("g"), (x["h"] / t["cap"]).alias("rel"), (x["_bottom"] - s["base"] > K.DESCENT * t["cap"]).alias("descends")))

    g = glyphs.groupBy(*each).agg(F.collect_list(F.struct(*rest, (F.col("y") + F.col("h")).alias("_bottom"))).alias("_g"))
    g = g.select(*each, let(let(let(base(F.col("_g")), top), cap), told).alias("_g"))
    g = g.withColumn("_shows", F.exists("_g", lambda x: (x["rel"] < K.SMALL) | x["descends"]).cast("int"))
    g = g.withColumn("lower", F.coalesce(F.max("_shows").over(Window.partitionBy(*by)), F.lit(0)) == 1)
    g = g.select(*each, "lower", F.explode("_g").alias("_g"))
    return g.select(*[F.col(c) if c in each else F.col(f"_g.g.{c}").alias(c) for c in glyphs.columns], "_g.rel", "_g.descends", "lower")


def line_offsets(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines (by, line_no, w, hm) with the x at which each begins when they are put side by side with a gap."""
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("x_offset", F.coalesce(F.sum(F.col("w") + half_up(0.9 * F.col("hm"))).over(w), F.lit(0)))
