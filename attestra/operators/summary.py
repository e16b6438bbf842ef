"""Counts and conclusions over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(rows: DataFrame, by: list[str], warnings: Column, counted: Column) -> DataFrame:
    """(by..., n, ng, chk, level): rows without a verdict (null) stand for a group without rows.

    chk counts what is neither OK nor NG. A group is clean if it has rows, all OK, and no warnings; clean and counted
    is `ok`, clean alone `warn`, all else `bad`. warnings and counted are aggregates.
    """
    v = F.col("verdict")
    n, ng, ok = F.count(v), F.count_if(v == "NG"), F.count_if(v == "OK")
    clean = (n > 0) & (ok == n) & (warnings == 0)
    level = F.when(clean & counted, "ok").when(clean, "warn").otherwise("bad")
    return rows.groupBy(*by).agg(n.alias("n"), ng.alias("ng"), (n - ng - ok).alias("chk"), level.alias("level"))


def reconcile(expected: Column, found: Column) -> Column:
    """struct<counted, missing>: whether a total was given (neither null nor 0), and by how much it differs, null if not."""
    given = F.coalesce(expected, F.lit(0)) != 0
    return F.struct(given.alias("counted"), F.when(given & (expected != found), expected - found).alias("missing"))


def count_anomalies(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """counts with the usual count of its group as `mode`, those rows only that differ from it.

    The mode is taken over counts above 0; of equally frequent ones the larger. Zero counts are reported against it;
    a group of zeros only has no mode and no anomaly. Counts are combined before the shuffle.
    """
    how_often = counts.where(F.col(n) > 0).groupBy(*by, n).agg(F.count("*").alias("_f"))
    mode = how_often.groupBy(*by).agg(F.max_by(n, F.struct("_f", n)).alias("mode")) if by else how_often.agg(F.max_by(n, F.struct("_f", n)).alias("mode"))
    joined = counts.join(mode, by) if by else counts.withColumn("mode", mode.scalar())
    return joined.where(F.col(n) != F.col("mode"))


def symbols_by_label(symbols: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, page_no, label, n): symbols for each frame, zeros included, of pages that have a frame. Labels count
    from 1; symbols outside every frame form label 0, where there are any."""
    page = ["doc_id", "page_no"]
    labels = frames.select(*page, (F.col("frame_idx") + 1).alias("label"), F.lit(0).alias("one"))
    own = symbols.select(*page, (F.col("label") + 1).alias("label"), F.lit(1).alias("one")).join(frames.select(*page).distinct(), page, "left_semi")
    return labels.unionByName(own).groupBy(*page, "label").agg(F.sum("one").alias("n"))


def empty_pages(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    return pages.join(symbols, ["doc_id", "page_no"], "left_anti").select("doc_id", "page_no")


def warnings(pages: DataFrame, symbols: DataFrame, frames: DataFrame, documents: DataFrame, lost_fonts: DataFrame) -> DataFrame:
    """(doc_id, code, page_no, label, found, wanted): empty pages, count anomalies, wrong totals and missing fonts."""
    none = lambda t: F.lit(None).cast(t)
    row = lambda df, code, page_no, label, found, wanted: df.select("doc_id", F.lit(code).alias("code"), page_no.cast("int").alias("page_no"), label.cast("int").alias("label"), found.cast("long").alias("found"), wanted.cast("string").alias("wanted"))
    empty = row(empty_pages(pages, symbols), "page-empty", F.col("page_no"), none("int"), F.lit(0), none("string"))
    odd = row(count_anomalies(symbols_by_label(symbols, frames), ["doc_id", "page_no"]), "count-differs", F.col("page_no"), F.col("label"), F.col("n"), F.col("mode"))
    totals = documents.join(symbols.groupBy("doc_id").agg(F.count("*").alias("found")), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    wrong = row(totals.where(reconcile(F.col("expect_total"), F.col("found"))["missing"].isNotNull()), "total-differs", none("int"), none("int"), F.col("found"), F.col("expect_total"))
    fonts = lost_fonts.agg(F.array_join(F.array_sort(F.collect_list("font")), ",").alias("fonts"))
    lost = row(symbols.select("doc_id").distinct().withColumn("fonts", fonts.scalar()).where("fonts <> ''"), "font-missing", none("int"), none("int"), none("long"), F.col("fonts"))
    return empty.unionByName(odd).unionByName(wrong).unionByName(lost)
