"""Streams of results: a running summary of documents as their verdicts arrive in files.

Documents are verified one file at a time elsewhere; this is an extension for continuous feeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERDICTS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("expect_total", T.LongType())])


def verdict_stream(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Rows (doc_id, verdict, at, expect_total) of the result files that appear in a folder."""
    return spark.readStream.schema(VERDICTS).format(kind).load(path)


def by_window(verdicts: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, verdict, n): counts by time window; rows later than the watermark are left out."""
    w = verdicts.withWatermark("at", late).groupBy(F.window("at", width), "verdict").agg(F.count("*").alias("n"))
    return w.select("window.start", "window.end", "verdict", "n")


def when_complete(verdicts: DataFrame, wait_seconds: int | None = None, late: str = "1 hour") -> DataFrame:
    """(doc_id, n, ng, chk, level): one row for a document as soon as it has as many verdicts as it expects.

    State is five numbers for a document, and goes when its row has been given. With wait_seconds, a document that gets nothing for
    as long in event time ends incomplete: its row tells what came, its level is bad, and the state doesn't grow with the
    stream; rows later than the watermark are left out then, and rows without a time wait from the watermark on. Without it,
    every row counts, and incomplete documents are kept. Rows without a document are left out; null verdicts are
    neither OK nor NG.
    """
    out = T.StructType([T.StructField("doc_id", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("n", "ng", "chk")), T.StructField("level", T.StringType())])
    kept = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "ng", "ok", "expected", "last")])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ng, ok, expected, last = state.get if state.exists else (0, 0, 0, 0, 0)
        ended = state.hasTimedOut
        for b in [] if ended else batches:
            n, ng, ok = n + len(b), ng + int((b.verdict == "NG").sum()), ok + int((b.verdict == "OK").sum())
            expected, last = (max(x, int(c.fillna(0).max())) for x, c in ((expected, b.expect_total), (last, b.ms)))
        if ended or (expected and n >= expected):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"doc_id": [key[0]], "n": [n], "ng": [ng], "chk": [n - ng - ok], "level": ["ok" if ok == n == expected else "bad"]})
            return
        state.update((n, ng, ok, expected, last))
        if wait_seconds is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1000 * wait_seconds)

    rows = verdicts.where("doc_id is not null").withColumn("ms", F.unix_millis("at"))
    rows = rows if wait_seconds is None else rows.withWatermark("at", late)
    timeout = GroupStateTimeout.NoTimeout if wait_seconds is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("doc_id").applyInPandasWithState(update, out, kept, "append", timeout)
