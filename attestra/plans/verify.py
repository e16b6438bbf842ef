"""The whole verification of documents, from observations to verdicts, warnings and a summary.

Tables, by name (columns beyond these are ignored):

document      doc_id, expect_total
page          doc_id, page_no, width, height, rerenderable
barcode_obs   doc_id, page_no, seq, fmt, text, corners array<struct<x, y>>  in the decoder's order
path          doc_id, page_no, paint, x0, y0, x1, y1  in pixels
glyph         doc_id, page_no, seq, res (lo, hi), side (below, right), x, y, w, h, v  in the upright crop
read          doc_id, page_no, seq, res, side, line_no, raw, score
pdf_word      doc_id, page_no, x, y, w, h, s
template      font, h_bucket, ch, v
char_metric   font, ch, rel, descends

Work is by page and symbol; only shape clustering needs all glyphs of a document together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions import text as X
from attestra.functions.geometry import box, crop_to_page, page_to_crop, text_area, usable
from attestra.functions.vectors import upper_median
from attestra.operators import clusters, lines, regions, sequential, summary, templates
from attestra.operators.verdict import judge
from attestra.session import settled

SYMBOL = ["doc_id", "page_no", "seq"]


def located(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(symbols with their label, reading order and text areas, frames)."""
    frames = regions.frames_of_paths(t["path"])
    pages = t["page"].select("doc_id", "page_no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "rerenderable")
    s = sequential.first_symbols(t["barcode_obs"].select(*SYMBOL, "fmt", "text", "corners"))
    s = s.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
    s = settled(s)
    s = regions.smallest_container(s, frames, regions.PAGE, SYMBOL).drop("cx", "cy", "mx", "my").join(pages, regions.PAGE)
    s = regions.clips(s, frames)
    area = lambda side, clip: text_area(F.col("corners"), F.col("width"), F.col("height"), F.col(clip), side)
    s = s.withColumn("below", area("below", "clip")).withColumn("right", area("right", "clip_right")).withColumn("value", X.norm(F.col("text")))
    return settled(s), settled(frames)


def chosen_glyphs(symbols: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Glyphs of each symbol's own text, with side, line_no and pos, for both resolutions.

    A symbol of two dimensions takes the block to its right if the low resolution has two glyphs or more there; all
    others take the line below.
    """
    crop = [*SYMBOL, "res"]
    at = lambda side: page_to_crop(F.col(f"{side}.cx"), F.col(f"{side}.cy"), F.col(f"{side}.rect"), F.col(f"{side}.angle"))
    # The high resolution shows the same area larger.
    scale = F.when(F.col("res") == "hi", F.lit(K.DPI_HIGH / K.DPI)).otherwise(1.0)
    g = glyphs.select(*crop, "side", "x", "y", "w", "h", "v")
    places = symbols.select(*SYMBOL, X.is_matrix(F.col("fmt")).alias("matrix"), usable(F.col("below")).alias("below_ok"), usable(F.col("right")).alias("right_ok"), at("below")["x"].alias("cx"), at("right")["y"].alias("cy"))
    g = g.join(places, SYMBOL).withColumn("centre_x", F.col("cx") * scale).withColumn("centre_y", F.col("cy") * scale)
    block = lines.pick_block(g.where("side = 'right' and matrix and right_ok"), crop).select(*crop, "side", "line_no", "pos", "x", "y", "w", "h", "v")
    line = lines.pick_line(g.where("side = 'below' and below_ok"), crop).withColumn("line_no", F.lit(0).cast("int"))
    line = line.withColumn("pos", F.row_number().over(Window.partitionBy(*crop).orderBy("x", "y")) - 1).select(block.columns)
    right = block.where("res = 'lo'").groupBy(*SYMBOL).agg(F.count("*").alias("n")).where("n >= 2").select(SYMBOL)
    return block.join(right, SYMBOL, "left_semi").unionByName(line.join(right, SYMBOL, "left_anti"))


def text_readings(reads: DataFrame, sides: DataFrame) -> DataFrame:
    """(symbol, ocr, ocr2, score): lines joined in order, the least score of all lines and resolutions. A resolution
    without lines reads nothing, with score 0."""
    r = reads.join(sides, [*SYMBOL, "side"], "left_semi").groupBy(*SYMBOL, "res").agg(F.array_sort(F.collect_list(F.struct("line_no", X.norm(F.col("raw")).alias("t")))).alias("l"), F.min("score").alias("score"))
    r = r.withColumn("t", F.array_join("l.t", ""))
    one = lambda res, c: F.max(F.when(F.col("res") == res, F.col(c)))
    return r.groupBy(*SYMBOL).agg(one("lo", "t").alias("ocr"), one("hi", "t").alias("ocr2"), F.least(F.coalesce(one("lo", "score"), F.lit(0.0)), F.coalesce(one("hi", "score"), F.lit(0.0))).alias("score"))


def template_readings(symbols: DataFrame, glyphs: DataFrame, t: dict[str, DataFrame], fonts: tuple[str, ...], missing: tuple[str, ...]) -> DataFrame:
    """(symbol, template, margin, filled, conflict, wrong, why, tpl_font) of symbols with as many glyphs as characters."""
    crop = [*SYMBOL, "res"]
    fits = glyphs.groupBy(*crop).agg(F.count("*").alias("n")).join(symbols.select(*SYMBOL, F.length("value").alias("chars")), SYMBOL).where("n = chars")
    g = lines.line_classes(glyphs.join(fits.select(crop), crop, "left_semi"), crop)
    r = templates.choose_font(templates.read_with_fonts(g, t["template"], t["char_metric"], crop, fonts), crop, fonts, missing)
    one = lambda res: F.max(F.when(F.col("res") == res, F.struct("text", "margins", "font", "why")))
    both = r.groupBy(*SYMBOL).agg(one("lo").alias("lo"), one("hi").alias("hi")).where("lo is not null")
    both = both.join(symbols.select(*SYMBOL, "value", F.coalesce("rerenderable", F.lit(False)).alias("rerenderable")), SYMBOL)
    low, high = F.col("lo.text"), F.coalesce(F.col("hi.text"), F.lit(""))
    m = X.merge_resolutions(low, high, F.col("lo.margins"), F.coalesce(F.col("hi.margins"), F.array().cast("array<double>")), F.col("rerenderable"))
    both = both.withColumn("m", m)
    why = F.when(F.col("lo.why").isNotNull() & (F.col("hi.why").isNotNull() | (high == "")), F.col("lo.why"))
    font = F.when(F.col("lo.why").isNull(), F.col("lo.font")).when(F.col("hi.why").isNull(), F.col("hi.font"))
    return both.select(*SYMBOL, F.col("m.text").alias("template"), F.col("m.margin").alias("margin"), F.col("m.filled").alias("filled"), X.conflict_positions(low, high).alias("conflict"), X.wrong_positions(F.col("m.text"), F.col("value")).alias("wrong"), why.alias("why"), font.alias("tpl_font"))


def verify(t: dict[str, DataFrame], fonts: tuple[str, ...] = K.FONTS) -> dict[str, DataFrame]:
    """rows (one verdict for each symbol), warnings and summary of the documents."""
    symbols, frames = located(t)
    # As many rows as required fonts.
    missing = tuple(sorted(r["font"] for r in templates.missing_fonts(t["template"], fonts).collect()))
    glyphs = settled(chosen_glyphs(symbols, t["glyph"]))
    low = glyphs.where("res = 'lo'")
    # Without glyphs the area below is read as a whole.
    sides = symbols.select(SYMBOL).join(low.select(*SYMBOL, "side").distinct(), SYMBOL, "left").withColumn("side", F.coalesce("side", F.lit("below")))
    sides = settled(sides)
    read = settled(text_readings(t["read"], sides))
    # Rows are clustered in the order of the report: by label, from above, from the left.
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "label", "y0", "x0", "seq"))
    numbered = settled(symbols.select(*SYMBOL, number.alias("bc_id")))
    shapes, _ = clusters.shape_reading(low.join(numbered, SYMBOL).select("doc_id", "bc_id", "pos", "h", "v"), read.join(numbered, SYMBOL).select("doc_id", "bc_id", "ocr"))
    shapes = settled(shapes.join(numbered, ["doc_id", "bc_id"]).drop("bc_id"))
    tpl = settled(template_readings(symbols, glyphs, t, fonts, missing))
    area = symbols.join(sides, SYMBOL).select(*SYMBOL, F.when(F.col("side") == "right", F.col("right")).otherwise(F.col("below")).alias("a")).select(*SYMBOL, "a.rect", "a.angle")
    # The text layer is asked for the letters' own box on the page, with a margin of 0.3 heights.
    room = low.groupBy(*SYMBOL).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), (0.3 * upper_median(F.col("h"))).alias("m"))
    letters = box(F.col("x0") - F.col("m"), F.col("y0") - F.col("m"), F.col("x1") + F.col("m"), F.col("y1") + F.col("m"))
    area = area.join(room.select(*SYMBOL, letters.alias("letters")), SYMBOL, "left")
    area = area.withColumn("rect", F.coalesce(F.when(F.col("letters").isNotNull(), crop_to_page(F.col("letters"), F.col("rect"), F.col("angle"))), F.col("rect"))).drop("letters")
    layer = regions.words_in_areas(area, t["pdf_word"], regions.PAGE, SYMBOL).select(*SYMBOL, X.norm(F.col("words")).alias("pdf_text"))
    rows = symbols.join(sides, SYMBOL, "left")
    for part in (read, shapes, tpl, layer):
        rows = rows.join(part, SYMBOL, "left")
    right_only = (F.col("side") == "right") & usable(F.col("right"))
    rows = settled(rows)
    early = F.when(~usable(F.col("below")) & ~F.coalesce(right_only, F.lit(False)), F.when(F.col("below.skew") < 99, "skewed").otherwise("no text area"))
    rows = settled(judge(rows.withColumn("early", early)))
    rows = rows.withColumn("mismatches", X.char_mismatches(F.col("value"), F.col("ocr"))).withColumn("template_note", X.template_note(F.col("why"), F.col("template"), F.col("wrong"), F.col("margin")))
    rows = rows.withColumn("checks", X.retry_checks(F.col("ocr"), F.col("ocr2"), F.col("template"), F.col("why"), F.col("conflict"), F.col("filled"), F.col("rerenderable")))
    rows = settled(rows)
    lost = t["document"].sparkSession.createDataFrame([(f,) for f in missing], "font string")
    warned = settled(summary.warnings(t["page"], symbols, frames, t["document"], lost))
    out = t["document"].select("doc_id", "expect_total").join(rows.select("doc_id", "verdict"), "doc_id", "left").join(warned.groupBy("doc_id").agg(F.count("*").alias("n_warn")), "doc_id", "left")
    total = summary.summarize(out, ["doc_id"], F.coalesce(F.max("n_warn"), F.lit(0)), F.coalesce(F.max("expect_total"), F.lit(0)) != 0)
    return {"rows": rows.drop("corners", "clip", "clip_right"), "warnings": warned, "summary": total}

