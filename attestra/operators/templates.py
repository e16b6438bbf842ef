"""Reading glyphs by the nearest template, with the margin to the second nearest.

Templates are a table (font, h_bucket, ch, v) and metrics a table (font, ch, rel, descends); a few thousand rows by
the alphabet, whatever the input. The join's key is font and height bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.vectors import dot, half_up


def height_bucket(h: Column) -> Column:
    return (half_up(h / 4) * 4).cast("int")


def nearest_two(pairs: DataFrame, by: list[str], candidate: str, similarity: Column, tie: str) -> DataFrame:
    """(by..., best, top, margin, n): the most similar candidate of each group, the earliest by tie among equals, and
    its lead on the second; margin is 0 and top null with fewer than two candidates. A group holds one number for each
    candidate, which are as many as the templates of one font."""
    s = pairs.withColumn("_s", similarity).where("_s is not null")
    top = s.groupBy(*by).agg(F.max_by(candidate, F.struct("_s", (-F.col(tie)).alias("t"))).alias("best"), F.slice(F.sort_array(F.collect_list("_s"), asc=False), 1, 2).alias("_two"), F.count("*").alias("n"))
    return top.select(*by, "best", F.when(F.col("n") > 1, F.get("_two", F.lit(0))).alias("top"), F.when(F.col("n") > 1, F.get("_two", F.lit(0)) - F.get("_two", F.lit(1))).otherwise(0.0).alias("margin"), "n")


def accepted(best: Column, top: Column, margin: Column, similarity: float = K.TEMPLATE_SIMILARITY, least: float = K.TEMPLATE_MARGIN) -> Column:
    """The character, or `?` where it isn't similar enough or not clearly more than another."""
    return F.when((margin >= least) & (top >= similarity), best).otherwise("?")


def read_with_fonts(glyphs: DataFrame, templates: DataFrame, metrics: DataFrame, by: list[str], fonts: tuple[str, ...] = K.FONTS) -> DataFrame:
    """(by..., font, text, margins, fit) of each group of glyphs and font.

    glyphs: by, pos, h, v, rel, descends, lower (see line_classes). Where the group shows small letters, they are
    candidates too, and a candidate must descend as the glyph does and have its relative height within 15 %. fit is
    the sum of the best similarities over the number of all glyphs; a glyph with fewer than two candidates is `?`
    and adds none.
    """
    alphabet = K.CAPITALS + K.LETTERS
    t = templates.join(metrics.select("font", "ch", F.col("rel").alias("m_rel"), F.col("descends").alias("m_descends")), ["font", "ch"], "left")
    t = t.where(F.col("font").isin(*fonts)).withColumn("order", F.instr(F.lit(alphabet), F.col("ch"))).where("`order` > 0")
    # One row for each height, so that a glyph meets its candidates in one row and no pair of them moves.
    t = t.groupBy("h_bucket").agg(F.collect_list(F.struct("font", "ch", "order", "m_rel", "m_descends", "v")).alias("_t"))
    fits = lambda t: F.when(F.col("lower"), (t["m_descends"] == F.col("descends")) & (F.abs(F.col("rel") / t["m_rel"] - 1) <= K.HEIGHT_TOLERANCE)).otherwise(t["order"].between(1, len(K.CAPITALS)))
    compared = F.transform(F.filter("_t", fits), lambda t: F.struct(dot(F.col("v"), t["v"]).alias("s"), (-t["order"]).alias("t"), t["ch"].alias("ch"), t["font"].alias("font")))
    g = glyphs.select(*by, "pos", "v", "rel", "descends", "lower", height_bucket(F.col("h")).alias("h_bucket")).join(t, "h_bucket", "left")
    g = g.select(*by, "pos", F.sort_array(F.filter(compared, lambda x: x["s"].isNotNull()), asc=False).alias("_near"))

    def best(near: Column) -> Column:
        """The two nearest of one font's candidates, as nearest_two() has them, and what is read from them."""
        some = F.size(near) > 1
        top, margin = F.get(near, F.lit(0)), F.when(some, F.get(near, F.lit(0))["s"] - F.get(near, F.lit(1))["s"]).otherwise(0.0)
        read = F.coalesce(accepted(top["ch"], F.when(some, top["s"]), margin), F.lit("?"))
        return F.struct(read.alias("c"), margin.alias("m"), F.when(some, top["s"]).otherwise(0.0).alias("s"))

    def of(font: str) -> Column:
        return F.coalesce(F.filter("_near", lambda x: x["font"] == font), F.array().cast("array<struct<s: double, t: int, ch: string, font: string>>"))

    g = g.select("*", *[of(f).alias(f"_{i}") for i, f in enumerate(fonts)])
    g = g.select(*by, F.struct("pos", *[best(F.col(f"_{i}")).alias(f"f{i}") for i in range(len(fonts))]).alias("_r"))
    out = g.groupBy(*by).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    fit = lambda r: F.aggregate(r, F.lit(0.0), lambda s, x: s + x["s"]) / F.size(r)
    each = [(f, F.col(f"_r.f{i}")) for i, f in enumerate(fonts)]
    one = F.array(*[F.struct(F.lit(f).alias("font"), F.array_join(r["c"], "").alias("text"), r["m"].alias("margins"), fit(r).alias("fit")) for f, r in each])
    return out.select(*by, F.explode(one).alias("_r")).select(*by, "_r.*")


def choose_font(readings: DataFrame, by: list[str], fonts: tuple[str, ...] = K.FONTS, missing: tuple[str, ...] = ()) -> DataFrame:
    """(by..., font, text, margins, fit, why): the reading of the best fitting font.

    why is null where it applies. It is `font-missing` (nothing read) if a font has no templates here, `poor-fit` if
    the best font doesn't fit, `ambiguous-font` if the second fits nearly as well; the text then is all `?`. The
    choice looks at shapes only, never at the value that is verified. Equal fits: the font named first.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("fit"), F.array_position(F.array(*[F.lit(f) for f in fonts]), F.col("font"))))
    second = F.lead("fit").over(Window.partitionBy(*by).orderBy(F.desc("fit"), F.array_position(F.array(*[F.lit(f) for f in fonts]), F.col("font"))))
    top = readings.withColumn("_r", rank).withColumn("_second", second).where("_r = 1")
    why = F.when(F.lit(bool(missing)), "font-missing").when(F.col("fit") < K.TEMPLATE_FIT, "poor-fit").when(F.col("fit") - F.col("_second") < K.FONT_GAP, "ambiguous-font")
    text = F.when(F.lit(bool(missing)), "").when(F.col("why").isNotNull(), F.repeat(F.lit("?"), F.length("text"))).otherwise(F.col("text"))
    return top.withColumn("why", why).withColumn("text", text).drop("_r", "_second")


def missing_fonts(templates: DataFrame, fonts: tuple[str, ...] = K.FONTS) -> DataFrame:
    """(font): required fonts that the template table lacks."""
    required = templates.sparkSession.createDataFrame([(f,) for f in fonts], "font string")
    return required.join(templates.select("font").distinct(), "font", "left_anti")
