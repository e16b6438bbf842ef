"""Queries over the driver's tables, one or more for each operator, with the SQL that states the same result.

The tables hold no symbols or glyphs, so each operator runs on the table of the nearest shape, as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text as X
from attestra.functions import vectors as V
from attestra.operators import clusters, lines, regions, sequential, summary, templates
from attestra.operators.verdict import judge, verdict
from attestra.session import table
from attestra.sources.small import stale

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


@query(r"""
    WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '/([a-z][a-z])/', 1), '') AS value, coalesce(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS reading,
                      lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) AS body FROM pages),
    pw AS (SELECT page_id, w, count(*) AS n FROM (SELECT page_id, unnest(string_split(body, ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
    lw AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
    pn AS (SELECT page_id, sqrt(sum(n * n)) AS l FROM pw GROUP BY page_id), ln AS (SELECT lang, sqrt(sum(n * n)) AS l FROM lw GROUP BY lang),
    s AS (SELECT page_id, lang, sum(pw.n * lw.n) AS s FROM pw JOIN lw USING (w) GROUP BY ALL),
    c AS (SELECT page_id, lang, s / (pn.l * ln.l) AS c FROM s JOIN pn USING (page_id) JOIN ln USING (lang)),
    r AS (SELECT page_id, lang, c, row_number() OVER o AS k, lead(c) OVER o AS d FROM c WINDOW o AS (PARTITION BY page_id ORDER BY c DESC, lang)),
    t AS (SELECT page_id, CASE WHEN d IS NOT NULL AND c - d >= 0.02 AND c >= 0.30 THEN lang ELSE '?' END AS template, coalesce(c - d, 0) AS margin FROM r WHERE k = 1),
    j AS (SELECT page_id, value, reading, coalesce(template, '?') AS template, round(coalesce(margin, 0), 6) AS margin FROM p LEFT JOIN t USING (page_id)),
    v AS (SELECT *, CASE WHEN reading = '' THEN 'no-text' WHEN template <> '?' AND template <> reading THEN 'tracks-differ' WHEN template = '?' THEN 'single-track'
                         WHEN reading = value THEN 'match' ELSE 'differs-from-value' END AS reason_code FROM j)
    SELECT page_id, value, reading, template, margin, reason_code,
           CASE reason_code WHEN 'no-text' THEN 'NOTEXT' WHEN 'match' THEN 'OK' WHEN 'differs-from-value' THEN 'NG' ELSE 'CHECK' END AS verdict FROM v""")
def verify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the language in a page's address agree with two independent readings of it: its markup, and its words
    against a profile of each language?"""
    p = table(spark, sf_dir, "pages").select(
        "page_id", F.coalesce(F.regexp_extract("url", "/([a-z][a-z])/", 1), F.lit("")).alias("value"), F.coalesce(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit("")).alias("reading"), "html"
    )
    words = lambda col: F.filter(F.split(F.lower(col), " "), lambda w: w != "")
    pw = p.select("page_id", F.explode(words(F.regexp_replace("html", "<[^>]*>", " "))).alias("w")).groupBy("page_id", "w").agg(F.count("*").alias("n"))
    lw = table(spark, sf_dir, "documents").select("lang", F.explode(words(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    norm = lambda df, key: df.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{key}_l"))
    s = pw.join(lw.withColumnRenamed("n", "m"), "w").groupBy("page_id", "lang").agg(F.sum(F.col("n") * F.col("m")).alias("s"))
    c = s.join(norm(pw, "page_id"), "page_id").join(norm(lw, "lang"), "lang").select("page_id", "lang", (F.col("s") / (F.col("page_id_l") * F.col("lang_l"))).alias("c"))
    order = Window.partitionBy("page_id").orderBy(F.desc("c"), "lang")
    t = c.withColumn("k", F.row_number().over(order)).withColumn("d", F.lead("c").over(order)).where("k = 1")
    t = t.select("page_id", F.when(F.col("d").isNotNull(), templates.accepted(F.col("lang"), F.col("c"), F.col("c") - F.col("d"), similarity=0.30)).otherwise("?").alias("template"), F.coalesce(F.col("c") - F.col("d"), F.lit(0.0)).alias("margin"))
    rows = p.drop("html").join(t, "page_id", "left").withColumn("template", F.coalesce("template", F.lit("?")))
    none = F.lit(None)
    v = verdict(F.col("value"), F.col("reading"), F.col("reading"), none.cast("string"), F.lit(1.0), F.lit(""), F.col("template"), none.cast("array<int>"), none.cast("string"), none.cast("string"))
    return rows.select("page_id", "value", "reading", "template", F.round(F.coalesce("margin", F.lit(0.0)), 6).alias("margin"), v["reason_code"].alias("reason_code"), v["verdict"].alias("verdict"))


@query("""
    WITH h AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 500) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT *, CAST(sum(n) OVER r AS DOUBLE) AS nb, CAST(sum(level * n) OVER r AS DOUBLE) AS sb, CAST(sum(n) OVER a AS DOUBLE) AS nt, CAST(sum(level * n) OVER a AS DOUBLE) AS st
          FROM h WINDOW r AS (PARTITION BY l_returnflag ORDER BY level ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY l_returnflag)),
    v AS (SELECT *, nb * (nt - nb) * pow(sb / nb - (st - sb) / (nt - nb), 2) AS v FROM s WHERE nb < nt)
    SELECT l_returnflag, level AS threshold FROM v QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, level) = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.floor(F.col("l_extendedprice") / 500).alias("level")).agg(F.count("*").alias("n"))
    return V.otsu(h, ["l_returnflag"])


@query("""
    WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), m AS (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1)
    SELECT l_orderkey, c.n, m.n AS mode FROM c, m WHERE c.n <> m.n""")
def mode_count_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return summary.count_anomalies(counts, []).select("l_orderkey", "n", "mode")


@query("""
    WITH g AS (SELECT user_id, value, event_id, CASE WHEN value - lag(value) OVER o > 3.0 THEN 1 ELSE 0 END AS cut FROM events WINDOW o AS (PARTITION BY user_id ORDER BY value, event_id)),
    r AS (SELECT user_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g),
    n AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id, run, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) = 1""")
def gap_runs_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    return lines.longest_run(lines.runs(e, ["user_id"], ["value", "event_id"], F.col("value"), F.col("value"), F.lit(3.0)), ["user_id"])


@query("""
    WITH g AS (SELECT user_id, value, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events),
    l AS (SELECT user_id, greatest(2 * (list_sort(list(gap)))[len(list(gap)) // 2 + 1], 1.0) AS lim FROM g WHERE gap IS NOT NULL GROUP BY user_id)
    SELECT event_id, user_id, CAST(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM g LEFT JOIN l USING (user_id)""")
def word_break_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    gaps = e.withColumn("gap", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("value", "event_id")))
    limit = V.upper_median_of(gaps, ["user_id"], "gap", "m").select("user_id", F.greatest(2 * F.col("m"), F.lit(1.0)).alias("limit"))
    return lines.runs(e.join(limit, "user_id", "left"), ["user_id"], ["value", "event_id"], F.col("value"), F.col("value"), F.col("limit")).select("event_id", "user_id", "run")


@query("""
    WITH g AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, epoch_us(ts) AS t FROM events),
    c AS (SELECT *, CASE WHEN t - lag(t) OVER o > 3600000000 THEN 1 ELSE 0 END AS cut FROM g WINDOW o AS (PARTITION BY user_id, day ORDER BY t, event_id))
    SELECT event_id, CAST(sum(cut) OVER (PARTITION BY user_id, day ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM c""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return lines.runs(e, ["user_id", "day"], ["t", "event_id"], F.col("t"), F.col("t"), F.lit(3_600_000_000), "block").select("event_id", "block")


@query("SELECT l_returnflag, (list_sort(list(l_quantity)))[len(list(l_quantity)) // 2 + 1] AS median FROM lineitem GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.upper_median_of(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "median")


_FIRSTS = "SELECT label AS ch, min_by(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings GROUP BY label"


@query(f"""
    WITH t AS ({_FIRSTS}), s AS (SELECT vec_id, ch, list_dot_product(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, t),
    r AS (SELECT vec_id, ch, s, lead(s) OVER o AS d, row_number() OVER o AS k FROM s WINDOW o AS (PARTITION BY vec_id ORDER BY s DESC, ch))
    SELECT vec_id, ch AS best, round(s, 6) AS top, round(s - d, 6) AS margin FROM r WHERE k = 1""")
def nearest_template_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    # One template for each of the table's few labels.
    t = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("t")).select(F.col("label").alias("ch"), "t")
    pairs = _with_each(e, t).select("vec_id", "ch", V.dot(F.col("embedding"), F.col("t")).alias("s"))
    near = templates.nearest_two(pairs, ["vec_id"], "ch", F.col("s"), "ch")
    return near.select("vec_id", "best", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"))


def _with_each(df: DataFrame, small: DataFrame) -> DataFrame:
    """Every row with every row of a table that has one for each label: the table is a scalar subquery, one array.
    Templates are an alphabet, which doesn't grow with the input."""
    packed = small.agg(F.collect_list(F.struct(*small.columns)).alias("_all")).scalar()
    return df.withColumn("_all", packed).withColumn("_one", F.explode("_all")).select(*df.columns, "_one.*")


@query("""
    WITH f AS (SELECT 'A' AS font, label AS ch, min_by(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings GROUP BY label
               UNION ALL SELECT 'B', label, max_by(CAST(embedding AS DOUBLE[]), vec_id) FROM embeddings GROUP BY label),
    s AS (SELECT label, vec_id, font, max(list_dot_product(CAST(embedding AS DOUBLE[]), v)) AS top FROM embeddings, f GROUP BY ALL),
    r AS (SELECT label, font, sum(top) / count(*) AS fit FROM s GROUP BY ALL),
    k AS (SELECT label, font, fit, lead(fit) OVER o AS second, row_number() OVER o AS k FROM r WINDOW o AS (PARTITION BY label ORDER BY fit DESC, font))
    SELECT label, font, round(fit, 6) AS fit, CASE WHEN fit < 0.83 THEN 'poor-fit' WHEN fit - second < 0.01 THEN 'ambiguous-font' END AS why FROM k WHERE k = 1""")
def font_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    t = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("A"), F.max_by("embedding", "vec_id").alias("B"))
    t = t.select(F.col("label").alias("ch"), F.explode(F.create_map(F.lit("A"), "A", F.lit("B"), "B")).alias("font", "t"))
    top = _with_each(e, t).groupBy("label", "vec_id", "font").agg(F.max(V.dot(F.col("embedding"), F.col("t"))).alias("top"))
    fit = top.groupBy("label", "font").agg((F.sum("top") / F.count("*")).alias("fit")).withColumn("text", F.lit(""))
    return templates.choose_font(fit, ["label"], ("A", "B")).select("label", "font", F.round("fit", 6).alias("fit"), "why")


_SQL_SPACE = "[\\x09-\\x0D\\x20\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


@query(f"SELECT doc_id, CAST(length(regexp_replace(text, '{_SQL_SPACE}', '', 'g')) AS BIGINT) AS n FROM documents")
def normalised_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.norm(F.col("text"))).cast("long").alias("n"))


@query("""
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL),
    s AS (SELECT user_id, max(n) AS most, CAST(sum(n) AS BIGINT) AS total, max_by(event_type, n) AS first FROM c GROUP BY user_id),
    k AS (SELECT user_id, count(*) AS k FROM c JOIN s USING (user_id) WHERE n = most GROUP BY user_id)
    SELECT user_id, CASE WHEN most >= 2 AND k = 1 AND most / total >= 0.3 THEN first ELSE '?' END AS label, round(most / total, 6) AS confidence FROM s JOIN k USING (user_id)""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.vote(table(spark, sf_dir, "events"), ["user_id"], "event_type", purity=0.3).withColumn("confidence", F.round("confidence", 6))


_BOXES = "SELECT o_custkey AS user_id, o_orderkey AS frame_idx, CAST(month(o_orderdate) AS DOUBLE) AS x0, month(o_orderdate) + o_totalprice / 10000 AS x1, CAST(day(o_orderdate) AS DOUBLE) - 15 AS y0, CAST(day(o_orderdate) AS DOUBLE) AS y1 FROM orders"


@query(f"""
    WITH b AS ({_BOXES}), p AS (SELECT event_id, user_id, value AS cx, CAST(hour(ts) AS DOUBLE) AS cy FROM events),
    m AS (SELECT event_id, frame_idx FROM p JOIN b USING (user_id) WHERE cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1
          QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY (x1 - x0) * (y1 - y0), y0, x0, frame_idx) = 1)
    SELECT event_id, coalesce(frame_idx, -1) AS label FROM p LEFT JOIN m USING (event_id)""")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    month, day = F.month("o_orderdate").cast("double"), F.dayofmonth("o_orderdate").cast("double")
    boxes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("frame_idx"), month.alias("x0"), (month + F.col("o_totalprice") / 10000).alias("x1"), (day - 15).alias("y0"), day.alias("y1"))
    points = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("cx"), F.hour("ts").cast("double").alias("cy"))
    return regions.smallest_container(points, boxes, ["user_id"], ["event_id"]).select("event_id", "label")


@query("""
    WITH p AS (SELECT event_id, user_id, value AS cx, CAST(hour(ts) AS DOUBLE) AS cy FROM events),
    j AS (SELECT a.event_id, b.cx - a.cx AS dx, b.cy - a.cy AS dy, (b.cx + a.cx) / 2 AS mx, (b.cy + a.cy) / 2 AS my FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND a.event_id <> b.event_id)
    SELECT event_id, round(greatest(0.0, coalesce(max(mx) FILTER (WHERE abs(dx) > abs(dy) AND dx < 0), 0.0)), 6) AS "left", round(greatest(0.0, coalesce(max(my) FILTER (WHERE abs(dx) <= abs(dy) AND dy < 0), 0.0)), 6) AS top,
           round(least(1000.0, coalesce(min(mx) FILTER (WHERE abs(dx) > abs(dy) AND dx >= 0), 1000.0)), 6) AS "right", round(least(1000.0, coalesce(min(my) FILTER (WHERE abs(dx) <= abs(dy) AND dy >= 0), 1000.0)), 6) AS bottom
    FROM j GROUP BY event_id""")
def midline_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("cx"), F.hour("ts").cast("double").alias("cy"))
    out = regions.neighbour_clip(items, ["user_id"], "event_id", F.lit(1000.0), F.lit(1000.0))
    return out.select("event_id", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")))


_CODE = "CASE event_type WHEN 'click' THEN 0 ELSE length(event_type) END"


@query(f"""
    WITH e AS (SELECT user_id, ts, event_id, value, {_CODE} AS c, chr(CAST(64 + ({_CODE}) AS INTEGER)) AS ch FROM events), l AS (SELECT *, lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e),
    k AS (SELECT * FROM l WHERE c <> 0 AND (p IS NULL OR p <> c)), u AS (SELECT DISTINCT user_id FROM e)
    SELECT user_id, coalesce(string_agg(ch, '' ORDER BY ts, event_id), '') AS raw, round(coalesce(avg(value), 0), 4) AS score FROM u LEFT JOIN k USING (user_id) GROUP BY user_id""")
def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "click", 0).otherwise(F.length("event_type"))
    path = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("c"), "value"))).alias("p"))
    classes = F.array(F.lit(""), *(F.lit(chr(64 + i)) for i in range(1, 33)))
    out = V.ctc_decode(F.col("p.c"), F.col("p.value"), classes)
    return path.select("user_id", out["raw"].alias("raw"), F.round(out["score"], 4).alias("score"))


_NEXT_PART = "SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part"


def _next_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), after.alias("b")).where("b is not null")


@query(f"""
    SELECT p_partkey, i, CASE WHEN i < length(a) THEN substring(a, i + 1, 1) ELSE '·' END AS a, CASE WHEN i < length(b) THEN substring(b, i + 1, 1) ELSE '·' END AS b
    FROM (SELECT *, unnest(range(greatest(length(a), length(b)))) AS i FROM ({_NEXT_PART}) WHERE b IS NOT NULL)
    WHERE i >= least(length(a), length(b)) OR substring(a, i + 1, 1) <> substring(b, i + 1, 1)""")
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _next_parts(spark, sf_dir).select("p_partkey", F.explode(X.positional_diff(F.col("a"), F.col("b"))).alias("d"))
    return d.where("not d.same").select("p_partkey", F.col("d.i").cast("long").alias("i"), "d.a", "d.b")


@query(f"""
    WITH p AS (SELECT p_partkey, replace(a, 'a', '?') AS lo, replace(b, 'e', '?') AS hi FROM ({_NEXT_PART}) WHERE b IS NOT NULL),
    c AS (SELECT p_partkey, i, substring(lo, i + 1, 1) AS l, CASE WHEN i < length(hi) THEN substring(hi, i + 1, 1) ELSE '?' END AS h FROM (SELECT *, unnest(range(length(lo))) AS i FROM p))
    SELECT p_partkey, string_agg(CASE WHEN l <> '?' THEN l ELSE h END, '' ORDER BY i) AS merged, count(*) FILTER (WHERE l = '?' AND h <> '?') AS filled,
           count(*) FILTER (WHERE l <> '?' AND h <> '?' AND l <> h) AS conflicts FROM c GROUP BY p_partkey""")
def resolution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _next_parts(spark, sf_dir).select("p_partkey", F.replace("a", F.lit("a"), F.lit("?")).alias("lo"), F.replace("b", F.lit("e"), F.lit("?")).alias("hi")).where("lo <> ''")
    ones = lambda c: F.transform(X.characters(F.col(c)), lambda x: F.lit(1.0))
    m = X.merge_resolutions(F.col("lo"), F.col("hi"), ones("lo"), ones("hi"), F.lit(True))
    return p.select("p_partkey", m["text"].alias("merged"), F.size(m["filled"]).cast("long").alias("filled"), F.size(X.conflict_positions(F.col("lo"), F.col("hi"))).cast("long").alias("conflicts"))


@query("""
    WITH r AS (SELECT d.doc_id, lang AS value, CASE WHEN n_chars < 200 THEN '' ELSE lang END AS ocr, CASE WHEN quality = 0 THEN '' WHEN source = 'src1' THEN 'xx' ELSE lang END AS ocr2,
                      CASE WHEN toxic = 1 THEN source END AS pdf_text, least(n_chars / 1000.0, 1.0) AS score, CASE WHEN source = 'src2' THEN 'zz' WHEN source = 'src3' THEN 'z?' WHEN source = 'src4' THEN '' ELSE lang END AS shape,
                      CASE WHEN source IN ('src4', 'src5', 'src6') THEN '??' WHEN source = 'src7' THEN '' ELSE lang END AS template, CASE WHEN source = 'src8' THEN 1 ELSE 0 END AS conflict, CASE WHEN source = 'src6' THEN 'poor-fit' END AS why
               FROM documents d LEFT JOIN labels USING (doc_id)),
    c AS (SELECT *, CASE WHEN ocr = '' THEN 'no-text' WHEN ocr2 = '' THEN 'second-empty' WHEN pdf_text <> ocr THEN 'text-layer' WHEN ocr2 <> ocr THEN 'readings-differ' WHEN conflict = 1 THEN 'resolutions-differ'
                         WHEN shape = 'z?' THEN 'partial-shape-conflict' WHEN shape = 'zz' THEN 'tracks-differ' WHEN shape = '' AND template = '??' THEN 'single-track'
                         WHEN score < 0.8 AND template IN ('', '??') THEN 'low-score' WHEN template IN ('', '??') AND why IS NOT NULL THEN 'template-not-applicable' WHEN template = '??' THEN 'template-unread'
                         WHEN template = '' THEN 'template-incomplete' WHEN ocr = value THEN 'match' ELSE 'differs-from-value' END AS reason_code FROM r)
    SELECT doc_id, reason_code, CASE reason_code WHEN 'no-text' THEN 'NOTEXT' WHEN 'match' THEN 'OK' WHEN 'differs-from-value' THEN 'NG' ELSE 'CHECK' END AS verdict FROM c""")
def verdict_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    src, lang = F.col("source"), F.col("lang")
    rows = d.select(
        "doc_id", lang.alias("value"), F.when(F.col("n_chars") < 200, "").otherwise(lang).alias("ocr"), F.when(F.col("quality") == 0, "").when(src == "src1", "xx").otherwise(lang).alias("ocr2"),
        F.when(F.col("toxic") == 1, src).alias("pdf_text"), F.least(F.col("n_chars") / 1000, F.lit(1.0)).alias("score"), F.when(src == "src2", "zz").when(src == "src3", "z?").when(src == "src4", "").otherwise(lang).alias("shape"),
        F.when(src.isin("src4", "src5", "src6"), "??").when(src == "src7", "").otherwise(lang).alias("template"), F.when(src == "src8", F.array(F.lit(0))).alias("conflict"), F.when(src == "src6", "poor-fit").alias("why"), F.lit(None).cast("string").alias("early"),
    )
    return judge(rows).select("doc_id", "reason_code", "verdict")


@query("""
    WITH v AS (SELECT source, CASE quality WHEN 1 THEN 'OK' WHEN 0 THEN 'NG' ELSE 'CHECK' END AS v, coalesce(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE v = 'NG') AS ng, count(*) FILTER (WHERE v = 'CHECK') AS chk, CAST(sum(t) AS BIGINT) AS w FROM v GROUP BY source)
    SELECT source, n, ng, chk, CASE WHEN ng + chk + w = 0 THEN 'ok' ELSE 'bad' END AS level FROM s""")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select("source", "toxic", F.when(F.col("quality") == 1, "OK").when(F.col("quality") == 0, "NG").otherwise("CHECK").alias("verdict"))
    return summary.summarize(rows, ["source"], F.count_if(F.col("toxic") == 1), F.lit(True))


@query("""
    WITH c AS (SELECT c_custkey, c_nationkey AS expected, count(o_orderkey) AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, coalesce(expected, 0) <> 0 AS counted, CASE WHEN coalesce(expected, 0) <> 0 AND expected <> found THEN expected - found END AS missing FROM c""")
def count_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("found"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("r", summary.reconcile(F.col("c_nationkey"), F.coalesce("found", F.lit(0))))
    return c.select("c_custkey", "r.counted", "r.missing")


@query("""
    WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS h, l_discount * 100 AS y, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
    b AS (SELECT k, (list_sort(list(y + h)))[len(list(h)) // 2 + 1] AS base, 0.08 * (list_sort(list(h)))[len(list(h)) // 2 + 1] AS tol FROM g GROUP BY k),
    o AS (SELECT g.*, base, abs(y + h - base) <= tol AS on_base FROM g JOIN b USING (k)),
    t AS (SELECT k, max(h) FILTER (WHERE on_base) AS top FROM o GROUP BY k),
    c AS (SELECT k, (list_sort(list(h)))[len(list(h)) // 2 + 1] AS cap FROM o JOIN t USING (k) WHERE on_base AND h >= 0.85 * top GROUP BY k)
    SELECT k AS l_orderkey, count(*) AS n, count(*) FILTER (WHERE h / cap < 0.85) AS small, count(*) FILTER (WHERE y + h - base > 0.12 * cap) AS deep FROM o JOIN c USING (k) GROUP BY k""")
def baseline_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(0).alias("line_no"), F.col("l_quantity").alias("h"), (F.col("l_discount") * 100).alias("y"))
    c = lines.line_classes(g, ["l_orderkey"])
    return c.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("rel") < 0.85).alias("small"), F.count_if("descends").alias("deep"))


@query("""
    WITH a AS (SELECT c_custkey AS user_id, 5.0 + c_nationkey AS x1, 90 * (c_nationkey % 4) AS angle FROM customer), w AS (SELECT user_id, event_type AS s, value AS x, CAST(hour(ts) AS DOUBLE) AS y FROM events),
    j AS (SELECT user_id, s, CASE WHEN angle IN (180, 270) THEN -1 ELSE 1 END AS sg, CASE WHEN angle IN (0, 180) THEN y ELSE x END AS l, CASE WHEN angle IN (0, 180) THEN x ELSE y END AS p FROM a JOIN w USING (user_id) WHERE x + 0.5 BETWEEN 0 AND x1 AND y + 0.5 BETWEEN 2 AND 20)
    SELECT user_id, string_agg(s, ' ' ORDER BY floor(sg * floor(10 * l + 0.5) + 0.0), sg * p, s) AS words FROM j GROUP BY user_id""")
def word_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = F.struct(F.lit(0.0).alias("x0"), F.lit(2.0).alias("y0"), (F.lit(5.0) + F.col("c_nationkey")).alias("x1"), F.lit(20.0).alias("y1"))
    areas = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), rect.alias("rect"), (F.pmod("c_nationkey", F.lit(4)) * 90).alias("angle"))
    words = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("s"), F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    return regions.words_in_areas(areas, words, ["user_id"], ["user_id"])


@query("""
    WITH g AS (SELECT l_returnflag, CAST(l_quantity AS INTEGER) AS y, CAST(round(l_discount * 100) AS INTEGER) AS x, count(*) AS n FROM lineitem GROUP BY ALL),
    a AS (SELECT f.l_returnflag, y.y, x.x FROM (SELECT DISTINCT l_returnflag FROM g) f, (SELECT DISTINCT y FROM g) y, (SELECT DISTINCT x FROM g) x),
    d AS (SELECT a.*, coalesce(n, 0) AS n FROM a LEFT JOIN g USING (l_returnflag, y, x)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag, y ORDER BY x) AS s FROM d)
    SELECT l_returnflag, y, x, CAST(sum(s) OVER (PARTITION BY l_returnflag, x ORDER BY y) AS BIGINT) AS total FROM r""")
def integral_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x")).agg(F.count("*").alias("n"))
    # The grid's axes are a few dozen levels each.
    axes = g.agg(F.collect_set("y").alias("ys"), F.collect_set("x").alias("xs"), F.collect_set("l_returnflag").alias("fs"))
    cells = axes.select(F.explode("fs").alias("l_returnflag"), "ys", "xs").select("l_returnflag", F.explode("ys").alias("y"), "xs").select("l_returnflag", "y", F.explode("xs").alias("x"))
    d = cells.join(g, ["l_returnflag", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    r = d.withColumn("s", F.sum("n").over(Window.partitionBy("l_returnflag", "y").orderBy("x")))
    return r.select("l_returnflag", "y", "x", F.sum("s").over(Window.partitionBy("l_returnflag", "x").orderBy("y")).alias("total"))


@query("""
    SELECT o_custkey AS doc_id, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (x1 - x0) * (y1 - y0), y0, x0, x1, o_orderkey) - 1 AS INTEGER) AS frame_idx
    FROM (SELECT o_custkey, o_orderkey, 0.0 AS x0, CAST(day(o_orderdate) AS DOUBLE) AS y0, o_totalprice / 100 AS x1, day(o_orderdate) + o_totalprice / 200 AS y1 FROM orders WHERE o_orderstatus <> 'F')
    WHERE x1 - x0 > 120 * 400 / 72.0 AND y1 - y0 > 60 * 400 / 72.0""")
def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofmonth("o_orderdate").cast("double")
    paths = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page_no"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "fill").otherwise("stroke").alias("paint"),
        F.lit(0.0).alias("x0"), day.alias("y0"), (F.col("o_totalprice") / 100).alias("x1"), (day + F.col("o_totalprice") / 200).alias("y1"),
    )
    f = regions.frames_of_paths(paths)
    key = paths.select("doc_id", "o_orderkey", "x0", "y0", "x1", "y1", "paint").where("paint <> 'fill'").drop("paint")
    return f.join(key, ["doc_id", "x0", "y0", "x1", "y1"]).select("doc_id", "o_orderkey", "frame_idx")


@query("SELECT p_partkey, l_orderkey, coalesce(nullif(l_linenumber, 0), -1) <> coalesce(nullif(p_size, 0), -1) AS stale FROM lineitem JOIN part ON l_partkey = p_partkey")
def stale_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select("p_partkey", "l_orderkey", stale(F.col("l_linenumber"), F.col("p_size")).alias("stale"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def empty_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda name: table(spark, sf_dir, name).select("doc_id", F.lit(1).alias("page_no"))
    return summary.empty_pages(page("documents"), page("labels")).select("doc_id")


def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user without those within 2.0 of an event kept before, in their order of ids."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return sequential.first_of_neighbours(e, ["user_id"], ["event_id"], ["value"], 2.0)


@query()
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leader clusters of the vectors of a label, in the order of ids; the threshold suits the table's low similarities."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.lit(1.0).alias("h"), F.col("embedding").alias("v"))
    return clusters.cluster(e, ["label"], ["vec_id"], ["vec_id"], similarity=0.3)


@query("""
    WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '_', 'g') AS text FROM benchmark),
    b AS (SELECT a.item_id, a.text AS a, b.text AS b FROM t a JOIN t b ON b.item_id = a.item_id + 1)
    SELECT item_id, CASE WHEN length(a) = length(b) THEN hamming(a, b) ELSE levenshtein(a, b) END AS count, CASE WHEN length(a) <> length(b) THEN levenshtein(a, b) END AS dist FROM b""")
def align_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the texts of items with neighbouring ids depart from each other."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "_").alias("a"))
    b = t.join(t.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    m = b.withColumn("m", X.char_mismatches(F.col("a"), F.col("b")))
    return m.select("item_id", F.col("m.count").cast("long").alias("count"), F.col("m.dist").cast("long").alias("dist"))
