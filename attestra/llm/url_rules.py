"""URL filters: given rules by host and path, and association rules mined from labelled URLs.

A URL is a set of tokens (scheme, host labels, path segments, ending, query keys). Spark's FP-growth mines frequent
token sets together with the label. Tokens that the same labelled URLs have are one item there, so that a site with
long paths doesn't multiply its token sets. Rules below a confidence go, and so does a rule that a shorter one makes
needless. The rest are matched by an inverted index from token to the items of rules: a rule fits when a token of
each of its items is met.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import dictionary, lower_ascii, stored

#: (host, path, verdict) of the given rules.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Least share and least number of labelled URLs that a mined rule rests on, its least confidence, and the verdict of
#: URLs that no rule fits.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, DEFAULT = 0.01, 3, 0.9, "allow"


def host_of(url: Column) -> Column:
    """Lower-cased host; empty where there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Path up to the query or fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; path segments of digits are one token, as are segments' endings. Null: none."""
    url = F.coalesce(url, F.lit(""))
    named = lambda sign, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(sign), x))
    plain = F.regexp_replace(path_of(url), r"\.([A-Za-z]{1,5})\z", "/.$1")
    return F.array_distinct(
        F.concat(
            named("scheme=", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
            named("host=", F.split(host_of(url), r"\.")),
            named("path=", F.transform(F.split(plain, "/"), lambda x: F.when(x.rlike(r"^[0-9]+\z"), "#").otherwise(x))),
            named("query=", F.transform(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: F.substring_index(x, "=", 1))),
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> list[tuple[list[list[str]], str, float]]:
    """Association rules (items, verdict, confidence) from (tokens array, verdict string); an item is a list of tokens.

    Rows without tokens or verdict are left out; no rows, no rules. A rule rests on min_count rows at least, and on a
    share of min_support. It stays if no part of its items yields its verdict with as much confidence. An item has all
    tokens that exactly the same rows have, any of which stands for it: that is every rule that its tokens could
    make one by one, written once. The number of rules is bounded by the supports, not by the number of URLs.
    """
    spark = labelled.sparkSession
    rows = labelled.where("verdict is not null and size(tokens) > 0").select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "verdict")
    rows = stored(rows, "labelled")
    least = max(min_count, ceil(min_support * rows.count()))
    seen = rows.select("row", F.explode("tokens").alias("token"))
    # Rows are told apart by two hashes, summed as decimals, and their number.
    total = lambda salt: F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(20,0)"))
    items = seen.groupBy("token").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).where(F.col("n") >= least)
    items = stored(items.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("all")).select(F.col("all")[0].alias("item"), "all"), "items")
    names = {r["item"]: r["all"] for r in items.toLocalIterator()}  # bounded by a row's tokens over the least support
    baskets = seen.join(items.withColumnRenamed("item", "token"), "token").groupBy("row").agg(F.collect_list("token").alias("items")).join(rows.select("row", "verdict"), "row")
    baskets = stored(baskets.select(F.concat("items", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items")), "baskets")
    n = baskets.count()
    if not n:
        return []
    growth = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), numPartitions=max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = stored(growth.fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_label = found.withColumn("label", F.filter("items", lambda x: x.startswith("verdict="))).where("size(label) = 1 and size(items) > 1")
    with_label = with_label.select(F.array_except("items", "label").alias("items"), F.substring(F.col("label")[0], 9, 1 << 20).alias("verdict"), F.col("freq").alias("both"))
    rules = with_label.join(found, "items").withColumn("confidence", F.col("both") / F.col("freq")).where(F.col("confidence") >= min_confidence)
    best: dict[tuple[str, tuple], float] = {}
    kept = []
    for r in sorted(rules.select("items", "verdict", "confidence").toLocalIterator(), key=lambda r: (len(r["items"]), r["items"])):
        items = sorted(r["items"])
        if all(best.get((r["verdict"], x), 0.0) < r["confidence"] for n in range(1, len(items)) for x in combinations(items, n)):
            best[r["verdict"], tuple(items)] = r["confidence"]
            kept.append(([names[x] for x in items], r["verdict"], r["confidence"]))
    return kept


def judge(urls: DataFrame, rules: list[tuple[str, str, str]] | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every URL.

    A given rule (host, path, verdict) fits its host and all subdomains if the path starts with its path; the
    longest, then the first, wins. URLs with a given rule are the labels from which association rules are mined;
    a URL without one gets the verdict of the most confident mined rule that fits (then of the one with more
    items, then the last verdict by name), and `default` if none does. Null URLs have an empty host and path.
    Repeated rows and null ids are judged row by row; further columns are ignored.

    Given and mined rules are joined by host suffix and by token; both lists are broadcast up to a bound
    on their rows. Every URL moves once for the given rules and once for the mined ones, without its page.
    """
    spark: SparkSession = urls.sparkSession
    rules = RULES if rules is None else rules
    rows = urls.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("row", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    given = dictionary(spark, [(i, h, p, v, h + p) for i, (h, p, v) in enumerate(rules)], "n int, on string, prefix string, verdict string, rule string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rows.withColumn("on", F.explode(suffixes)).join(given, "on", "left")
    won = F.max(F.when(F.col("path").startswith(F.col("prefix")), F.struct(F.length("rule").alias("l"), (-F.col("n")).alias("n"), "rule", F.col("verdict").alias("v"))))
    ruled = fits.groupBy("row", "page_id", "url", "host", "path").agg(won.alias("won"))
    ruled = ruled.select("row", "page_id", "host", "path", F.col("won.rule").alias("rule"), F.col("won.v").alias("given"), tokens(F.col("url")).alias("tokens"))
    ruled = stored(ruled, "ruled")
    mined = mine(ruled.select("tokens", F.col("given").alias("verdict")), min_support, min_confidence, min_count)
    index = [(t, i, k, len(items), verdict, confidence, " ".join(x[0] for x in items)) for i, (items, verdict, confidence) in enumerate(mined) for k, item in enumerate(items) for t in item]
    index = dictionary(spark, index, "token string, n int, item int, n_items int, verdict string, confidence double, mined string")
    met = ruled.where("rule is null").select("row", F.explode("tokens").alias("token")).join(index, "token")
    met = met.groupBy("row", "n").agg(F.size(F.collect_set("item")).alias("hits"), *(F.first(c).alias(c) for c in ("n_items", "verdict", "confidence", "mined")))
    met = met.where("hits = n_items").groupBy("row").agg(F.max(F.struct("confidence", "n_items", "verdict", "mined")).alias("best"))
    out = ruled.drop("tokens").join(met, "row", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))
