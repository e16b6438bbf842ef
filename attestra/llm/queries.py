"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import byte_bpe, chat_trees, decontaminate, hnsw_dedup, license_scan, ngram_join, quality_bayes, token_records, url_rules, warc_revisit
from attestra.llm.common import stored
from attestra.session import table


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = token_records.read_records(manifest, {"ids_crc32": ("long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))})
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = {"ids_sha256": ("string", lambda ids, _: byte_bpe.digest(ids)), "decoded_sha256": ("string", lambda _, raw: byte_bpe.digest(raw))}
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests)


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve(warc_revisit.captures(table(spark, sf_dir, "pages")))
    told = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "canonical_url", "status", "response_id", F.unix_seconds("response_ts").alias("response_second"), told.alias("headers"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def op6_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_bayes.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "p_low_quality", "p_toxic", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["is_phrase"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = stored(chat_trees.chain(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)), "messages")
    out = chat_trees.format_paths(messages, chat_trees.best_paths(messages, unique=True), unique=True)
    told, loss = chat_trees.read_back(F.col("formatted")), chat_trees.under_loss(F.col("formatted"), F.col("loss"))
    out = out.select(F.col("tree_id").alias("conv_id"), told.alias("told"), loss.alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.array_join(F.transform("told", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("told").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars"
    )


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_ngram_join": op2_ngram_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_warc_revisit": op4_warc_revisit,
    "op5_decontamination": op5_decontamination,
    "op6_hnsw_dedup": op6_hnsw_dedup,
    "op7_quality_bayes": op7_quality_bayes,
    "op8_license_scan": op8_license_scan,
    "op9_url_rules": op9_url_rules,
    "op10_chat_trees": op10_chat_trees,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows: list[tuple]) -> str:
    """Rows of numbers, truth values and strings as SQL."""
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


_GRAMS = [(i, label, kind, k, n, p, " ".join(w[p : p + k])) for i, label, kind, k, n, w in license_scan.template_rows(license_scan.PHRASES, license_scan.NOTICES | license_scan.TEXTS) for p in range(n)]
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.b AS component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id""",
    "op4_warc_revisit": r"""
        WITH u AS (SELECT page_id, length(coalesce(url, '')) AS n, md5(coalesce(html, '')) AS tag, length(coalesce(html, '')) AS size,
                          regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['h', 'p', 'q']) AS x FROM pages),
        c AS (SELECT page_id, n, tag, size, regexp_replace(regexp_replace(translate(x.h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(?:80|443)$', ''), '^www\.', '') AS h,
                     regexp_replace(x.p, '/+$', '') AS p, array_to_string(list_sort([t FOR t IN string_split(x.q, '&') IF t <> '' AND NOT starts_with(t, 'utm_')]), '&') AS q FROM u),
        k AS (SELECT page_id, tag, size, page_id + 1000 * n AS again, CASE WHEN h <> '' THEN h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical_url FROM c),
        m AS (SELECT r.page_id AS a, max(f.page_id) AS b FROM k r JOIN k f ON r.canonical_url = f.canonical_url AND f.page_id < r.again GROUP BY r.page_id)
        SELECT 2 * r.page_id + 1 AS record_id, r.canonical_url, CASE WHEN f.page_id IS NULL THEN 'no-response' WHEN f.tag = r.tag THEN 'etag' ELSE 'mismatch' END AS status,
               2 * f.page_id AS response_id, f.page_id AS response_second,
               CASE WHEN f.tag = r.tag THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || f.size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || r.tag END AS headers
        FROM k r LEFT JOIN m ON m.a = r.page_id LEFT JOIN k f ON f.page_id = m.b""",
    "op5_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM benchmark),
        m AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM m)),
        places AS (SELECT doc_id, w, k.m, unnest(range(1, len(w) - k.m + 2)) AS i FROM d, (SELECT DISTINCT m FROM m) k WHERE len(w) >= k.m),
        met AS (SELECT doc_id, i, p.m, item_id FROM places p JOIN win ON p.m = win.m AND array_to_string(p.w[p.i:p.i + p.m - 1], ' ') = win.s),
        hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM met) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM met) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
               sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_hnsw_dedup": r"""
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        m AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, m.b AS component_id, m.b = vec_id AS kept
        FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op8_license_scan": rf"""
        WITH t(template, label, is_phrase, k, n, place, g) AS (VALUES {_values(_GRAMS)}),
        d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
        g AS (SELECT doc_id, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t))),
        v AS (SELECT doc_id, template, pos, place, pos - place AS diagonal FROM g JOIN t USING (k, g)),
        i AS (SELECT DISTINCT template, label, is_phrase, k, n FROM t),
        x AS (SELECT doc_id, template, diagonal, min(pos) AS a, max(pos) AS b FROM v GROUP BY ALL),
        c AS (SELECT x.*, CASE WHEN is_phrase OR diagonal - lag(diagonal) OVER o > {license_scan.STEP} OR abs(a - lag(b) OVER o) > n OR lag(b) OVER o IS NULL THEN 1 ELSE 0 END AS cut
              FROM x JOIN i USING (template) WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
        r AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM c),
        s AS (SELECT doc_id, template, run, min(pos) AS a, max(pos) AS b, count(DISTINCT place) AS met FROM v JOIN r USING (doc_id, template, diagonal) GROUP BY ALL),
        f AS (SELECT doc_id, label, is_phrase, a, a + k - 1 + b - a AS z, met / greatest(n, b - a + 1) AS share FROM s JOIN i USING (template)
              WHERE CASE WHEN is_phrase THEN met = n WHEN n < {license_scan.WHOLE} THEN met / greatest(n, b - a + 1) >= 1 ELSE met / greatest(n, b - a + 1) >= {license_scan.COVERAGE} END)
        SELECT d.doc_id, CAST(len(any_value(w)) AS BIGINT) AS n_words, count(a) FILTER (WHERE is_phrase) AS n_base, min(a) FILTER (WHERE is_phrase) AS first_word, max(a) FILTER (WHERE is_phrase) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
        FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""",
    "op9_url_rules": rf"""
        WITH RECURSIVE given(n, h, p, v) AS (VALUES {_values([(i, *r) for i, r in enumerate(url_rules.RULES)])}),
        u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
        fits AS (SELECT r, max_by(h || p, 100 * length(h || p) - n) AS rule, max_by(v, 100 * length(h || p) - n) AS v FROM u JOIN given ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
        parts AS (SELECT r, [x FOR x IN list_distinct(['scheme=' || regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)] || ['host=' || x FOR x IN string_split(host, '.')]
                         || ['path=' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE x END FOR x IN string_split(regexp_replace(path, '\.([A-Za-z]{{1,5}})$', '/.\1'), '/')]
                         || ['query=' || string_split(x, '=')[1] FOR x IN string_split(regexp_extract(url, '\?([^#]*)', 1), '&')]) IF NOT ends_with(x, '=')] AS t FROM u),
        lab AS (SELECT r, t, v FROM fits JOIN parts USING (r) WHERE len(t) > 0),
        least AS (SELECT greatest({url_rules.MIN_COUNT}, ceil({url_rules.MIN_SUPPORT} * count(*))) AS k FROM lab),
        one AS (SELECT x, list(r) AS rows FROM (SELECT r, unnest(t) AS x FROM lab) GROUP BY x HAVING count(*) >= (SELECT k FROM least)),
        sets AS (SELECT [x] AS items, rows FROM one
                 UNION ALL SELECT list_append(s.items, x), list_intersect(s.rows, one.rows) FROM sets s JOIN one ON x > s.items[-1]
                 WHERE len(list_intersect(s.rows, one.rows)) >= (SELECT k FROM least) AND len(list_intersect(s.rows, one.rows)) < len(s.rows)),
        by_v AS (SELECT v, list(r) AS rows FROM lab GROUP BY v),
        counted AS (SELECT items, v, len(list_intersect(s.rows, b.rows)) AS met, len(s.rows) AS n FROM sets s, by_v b),
        rules AS (SELECT items, v, met / n AS c FROM counted WHERE met >= (SELECT k FROM least) AND met / n >= {url_rules.MIN_CONFIDENCE}),
        kept AS (SELECT * FROM rules a WHERE NOT EXISTS (SELECT 1 FROM rules b WHERE a.v = b.v AND b.c >= a.c AND len(b.items) < len(a.items) AND list_has_all(a.items, b.items))),
        best AS (SELECT r, max({{'c': c, 'k': len(items), 'v': v}}) AS b FROM parts JOIN kept ON list_has_all(t, items) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(fits.v, best.b.v, '{url_rules.DEFAULT}') AS verdict FROM u LEFT JOIN fits USING (r) LEFT JOIN best USING (r)""",
    "op10_chat_trees": r"""
        WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, len(role) + len(text) + 14 + len(regexp_replace(role || text, '[^\\#<:]', '', 'g')) AS n FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
