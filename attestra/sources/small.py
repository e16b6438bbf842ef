"""Small sources and sinks: the recogniser's dictionary, the change log, results and stored parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch) of a file of one character a line: class 0 is the blank (empty), the last one a space."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "ch"))
    n = whole.agg(F.max("i")).first()[0]
    ends = spark.createDataFrame([(0, ""), ((n if n is not None else -1) + 2, " ")], "idx int, ch string")
    return whole.select((F.col("i") + 1).cast("int").alias("idx"), "ch").unionByName(ends)


def change_log(spark: SparkSession, entries: list[tuple[str, list[tuple[str, str]]]]) -> DataFrame:
    """(version, day, seq, items) of (version, [(type, text)]), newest first. A version is a day, or a day and a number
    (2024-05-01-10), ordered by its parts."""
    log = spark.createDataFrame(entries, "version string, items array<struct<type: string, text: string>>")
    day = F.try_to_date(F.regexp_extract("version", r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    seq = F.coalesce(F.expr(r"try_cast(regexp_extract(version, r'^\d{4}-\d{1,2}-\d{1,2}-(\d+)$', 1) as int)"), F.lit(1))
    return log.select("version", day.alias("day"), seq.alias("seq"), "items").orderBy(F.desc("day"), F.desc("seq"))


def unseen(log: DataFrame, seen: tuple[str, int] | None) -> DataFrame:
    """Entries newer than the (day, seq) last seen; all of them if none was."""
    return log if seen is None else log.where((F.col("day") > F.lit(seen[0]).cast("date")) | ((F.col("day") == F.lit(seen[0]).cast("date")) & (F.col("seq") > seen[1])))


def write_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results as parquet, json or tsv; nested columns are kept by the first two only."""
    w = df.write.mode("overwrite")
    w.csv(path, sep="\t", header=True) if kind == "tsv" else w.format(kind).save(path)


def report_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with a column `row`, a table row of the columns, escaped; cells of other types are cast to text."""
    from attestra.functions.text import html_escape

    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.withColumn("row", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def html_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(html): one table row for each row."""
    return report_cells(rows, columns).select(F.col("row").alias("html"))


def stale(used: Column, current: Column) -> Column:
    """Whether a result was made under another parameter than the current one; null and 0 both mean none."""
    return ~F.nullif(used, F.lit(0)).eqNullSafe(F.nullif(current, F.lit(0)))
