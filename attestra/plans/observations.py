"""The whole verification over tables made from `part`: a brand is a document, a size a page, a part a symbol.

A part's number is its value. What is printed, read a second time, found in the text layer or blurred departs from it
for some numbers, so that every kind of verdict but those of a skewed page occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.plans.catalog import query
from attestra.plans.verify import verify
from attestra.session import table

DIGITS = "0123456789"
#: Vectors: a digit is one place of sixteen, a blurred glyph four digits in equal parts, and the second font's digits are
#: mostly made of the places that no glyph has.
_PLACES = 16


def _unit(parts: dict[int, float]) -> list[float]:
    return [parts.get(i, 0.0) for i in range(_PLACES)]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that verify() asks for."""
    k, page = F.col("p_partkey"), ["doc_id", "page_no"]
    seq = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")) - 1
    value = F.lpad((k % 10000).cast("string"), 4, "0")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page_no"), k.alias("k"), seq.alias("seq"), value.alias("value"))
    k = F.col("k")
    p = p.withColumn("printed", F.when(k % 7 == 0, F.concat(F.substring("value", 1, 3), ((k % 10 + 1) % 10).cast("string"))).otherwise(F.col("value")))
    y = F.lit(300.0) + 400.0 * F.col("seq")
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), y.alias("y"))
    corners = F.array(corner(500.0, y), corner(700.0, y), corner(700.0, y + 80), corner(500.0, y + 80))
    ids = [*page, "seq"]
    digits = F.array(*(F.array(*(F.lit(x) for x in _unit({i: 1.0}))) for i in range(10)))
    blurred = F.array(*(F.lit(x) for x in _unit(dict.fromkeys(range(4), 0.5))))
    g = p.select(*ids, "k", "printed", F.explode(F.array(F.struct(F.lit("lo").alias("res"), F.lit(1).alias("f")), F.struct(F.lit("hi").alias("res"), F.lit(2).alias("f")))).alias("r"), "value")
    g = g.select(*ids, "k", "r.*", F.posexplode(F.split("printed", "")).alias("j", "c")).where("c <> ''")
    lost = (k % 19 == 0) & (F.col("j") == 3) & (F.col("res") == "lo")
    v = F.when(lost, blurred).otherwise(F.get(digits, F.col("c").cast("int")))
    g = g.select(*ids, "res", F.lit("below").alias("side"), ((380 + 14 * F.col("j")) * F.col("f")).alias("x"), (10 * F.col("f")).alias("y"), (10 * F.col("f")).alias("w"), (20 * F.col("f")).alias("h"), v.alias("v"))
    again = F.when(k % 11 == 0, F.concat(F.lit("0"), F.substring("printed", 2, 9))).otherwise(F.col("printed"))
    read = p.select(*ids, F.lit("below").alias("side"), F.lit(0).alias("line_no"), F.when(k % 13 == 0, 0.5).otherwise(0.95).alias("score"), F.explode(F.create_map(F.lit("lo"), "printed", F.lit("hi"), again)).alias("res", "raw"))
    words = p.where(k % 5 == 0).select(*page, F.lit(585.0).alias("x"), (y + 92).alias("y"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h"), F.when(k % 3 == 0, "9999").otherwise(F.col("printed")).alias("s"))
    second = lambda i: _unit({i: 0.6, 10 + i % 6: 0.8})
    templates = [(font, h, c, make(i)) for font, make in (("Arial", lambda i: _unit({i: 1.0})), ("Calibri", second)) for h in (20, 40) for i, c in enumerate(DIGITS)]
    return {
        "document": p.groupBy("doc_id").agg((F.count("*") + F.max(k) % 2).cast("int").alias("expect_total")),
        "page": p.groupBy(*page).agg(F.lit(1600).alias("width"), (1000 + 400 * F.count("*")).alias("height"), (F.first("page_no") % 2 == 0).alias("rerenderable")),
        "barcode_obs": p.select(*ids, F.lit("Code128").alias("fmt"), F.col("value").alias("text"), corners.alias("corners")),
        "path": p.select(*page, F.lit("fill").alias("paint"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), y.alias("x1"), y.alias("y1")),
        "glyph": g,
        "read": read,
        "pdf_word": words,
        "template": spark.createDataFrame(templates, "font string, h_bucket int, ch string, v array<double>"),
        "char_metric": spark.createDataFrame([(f, c, 1.0, False) for f in ("Arial", "Calibri") for c in DIGITS], "font string, ch string, rel double, descends boolean"),
    }


_VERDICTS = """
    p AS (SELECT p_brand AS doc_id, p_size AS page_no, p_partkey AS k, count(*) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - 1 AS seq, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS value FROM part),
    o AS (SELECT *, CASE WHEN k % 7 = 0 THEN substring(value, 1, 3) || CAST((k % 10 + 1) % 10 AS VARCHAR) ELSE value END AS ocr, k % 19 = 0 AS blurred FROM p WHERE seq < 64),
    g AS (SELECT *, substring(ocr, pos + 1, 1) AS c, CASE WHEN blurred AND pos = 3 THEN 'blurred' ELSE substring(ocr, pos + 1, 1) END AS cluster FROM (SELECT *, unnest(range(4)) AS pos FROM o)),
    n AS (SELECT doc_id, cluster, c, count(*) AS n FROM g GROUP BY ALL),
    s AS (SELECT doc_id, cluster, max(n) AS most, sum(n) AS total, max_by(c, n) AS first FROM n GROUP BY ALL),
    l AS (SELECT doc_id, cluster, CASE WHEN most >= 2 AND most / total >= 0.8 AND (SELECT count(*) FROM n WHERE n.doc_id = s.doc_id AND n.cluster = s.cluster AND n.n = most) = 1 THEN first ELSE '?' END AS label FROM s),
    h AS (SELECT doc_id, k, string_agg(label, '' ORDER BY pos) AS shape, bool_or(label <> '?' AND label <> c) AS apart FROM g JOIN l USING (doc_id, cluster) GROUP BY ALL),
    t AS (SELECT o.*, shape, apart, CASE WHEN k % 11 = 0 THEN '0' || substring(ocr, 2) ELSE ocr END AS ocr2, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN '9999' ELSE ocr END END AS layer,
                 CASE WHEN blurred AND page_no % 2 = 1 THEN substring(ocr, 1, 3) || '?' ELSE ocr END AS template FROM o JOIN h USING (doc_id, k)),
    v AS (SELECT *, CASE WHEN layer <> ocr THEN 'text-layer' WHEN ocr2 <> ocr THEN 'readings-differ' WHEN shape LIKE '%?%' AND apart THEN 'partial-shape-conflict'
                         WHEN shape NOT LIKE '%?%' AND shape <> ocr THEN 'tracks-differ' WHEN shape LIKE '%?%' AND template LIKE '%?%' THEN 'single-track'
                         WHEN template LIKE '%?%' AND k % 13 = 0 THEN 'low-score' WHEN template LIKE '%?%' THEN 'template-unread' WHEN ocr = value THEN 'match' ELSE 'differs-from-value' END AS reason_code FROM t),
    w AS (SELECT *, CASE reason_code WHEN 'match' THEN 'OK' WHEN 'differs-from-value' THEN 'NG' ELSE 'CHECK' END AS verdict FROM v)"""


@query(f"WITH {_VERDICTS} SELECT doc_id, page_no, seq, value, ocr, ocr2, layer AS pdf_text, shape, template, reason_code, verdict FROM w")
def verify_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole verification, from observations to verdicts."""
    rows = verify(tables(spark, sf_dir))["rows"]
    return rows.select("doc_id", "page_no", F.col("seq").cast("long").alias("seq"), "value", "ocr", "ocr2", "pdf_text", "shape", "template", "reason_code", "verdict")


@query(f"""
    WITH {_VERDICTS}, d AS (SELECT doc_id, count(*) + max(k) % 2 AS expected FROM p GROUP BY doc_id),
    c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'NG') AS ng, count(*) FILTER (WHERE verdict = 'CHECK') AS chk FROM w GROUP BY doc_id)
    SELECT doc_id, n, ng, chk, CASE WHEN ng + chk = 0 AND expected = n THEN 'ok' ELSE 'bad' END AS level FROM c JOIN d USING (doc_id)""")
def verify_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and release level of each document of the whole verification."""
    return verify(tables(spark, sf_dir))["summary"].select("doc_id", "n", "ng", "chk", "level")
