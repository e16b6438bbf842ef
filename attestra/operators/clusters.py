"""Shape clusters of a document's glyphs, and the character that their readings vote for.

Leader clustering depends on the order of glyphs, so a document's glyphs are scanned in one task; its memory holds one
document. Documents are independent of each other, and spread over tasks. Votes and labels are plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.text import at


def leaders(vectors: np.ndarray, heights: np.ndarray, similarity: float = K.SIMILARITY, votes: int = K.VOTES) -> np.ndarray:
    """Cluster number of each row, in order of appearance.

    A row joins the most similar cluster of comparable height (the first among equals) if that is similar enough, and
    moves its unit centre and height by running means; else it founds one. Then clusters of fewer than `votes` members
    are taken in, in order, by the most similar cluster with as many votes, under the same conditions; a cluster that
    has taken in others counts them from then on, its centre stays.
    """
    n, width = vectors.shape
    centres, sizes, counts = np.zeros((max(n, 1), width), np.float32), np.zeros(max(n, 1)), np.zeros(max(n, 1), int)
    made, of = 0, np.full(n, -1)
    for i in range(n):
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(sizes[:made] != 0, heights[i] / sizes[:made], 0)
        s = np.where((ratio >= K.SIZE_LOW) & (ratio <= K.SIZE_HIGH), centres[:made].astype(float) @ vectors[i].astype(float), -1)
        j = int(s.argmax()) if made else -1
        if made and s[j] >= similarity:
            k = counts[j]
            c = ((centres[j].astype(float) * k + vectors[i]) / (k + 1)).astype(np.float32).astype(float)
            centres[j] = c / (np.sqrt((c * c).sum()) or 1e-6)
            sizes[j], counts[j] = (sizes[j] * k + heights[i]) / (k + 1), k + 1
        else:
            j, made = made, made + 1
            centres[j], sizes[j], counts[j] = vectors[i], heights[i], 1
        of[i] = j
    for c in range(made):
        if not 0 < counts[c] < votes:
            continue
        ratio = sizes[c] / np.where(sizes[:made] != 0, sizes[:made], np.nan)
        s = np.where((counts[:made] >= votes) & (np.arange(made) != c) & (ratio >= K.SIZE_LOW) & (ratio <= K.SIZE_HIGH), centres[:made].astype(float) @ centres[c].astype(float), -1)
        j = int(s.argmax())
        if s[j] >= similarity:
            of[of == c] = j
            counts[j] += counts[c]
            counts[c] = 0
    return of


def cluster(glyphs: DataFrame, by: list[str], order: list[str], keep: list[str], similarity: float = K.SIMILARITY, votes: int = K.VOTES, height: str = "h", vector: str = "v") -> DataFrame:
    """(by, keep, cluster_id): leaders() over each document's glyphs in the given order."""
    schema = glyphs.select(*by, *keep).schema.add("cluster_id", "integer")

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        of = leaders(np.stack(g[vector].to_numpy()).astype(np.float32), g[height].to_numpy(float), similarity, votes)
        return g[[*by, *keep]].assign(cluster_id=of)

    needed = list(dict.fromkeys([*by, *keep, *order, height, vector]))
    return glyphs.select(*needed).groupBy(*by).applyInPandas(scan, schema)


def vote(members: DataFrame, by: list[str], voice: str, least: int = K.VOTES, purity: float = K.PURITY) -> DataFrame:
    """(by..., label, confidence): the voice of most members, or `?`.

    Null voices don't vote. A label needs `least` votes, more than any other, and a share of `purity`. confidence is
    the share of the first, also under `?`; without votes it is 0. Counts are combined
    before the shuffle; a group then has one number for each distinct voice.
    """
    n = members.groupBy(*by, voice).agg(F.count(voice).alias("_n")).groupBy(*by)
    v = n.agg(F.max("_n").alias("most"), F.sum("_n").alias("total"), F.max_by(voice, F.struct("_n", voice)).alias("first"), F.collect_list("_n").alias("_counts"))
    alone = F.size(F.filter("_counts", lambda x: x == F.col("most"))) == 1
    share = F.when(F.col("total") > 0, F.col("most") / F.col("total")).otherwise(0.0)
    label = F.when((F.col("most") >= least) & alone & (share >= purity), F.col("first")).otherwise("?")
    return v.select(*by, label.alias("label"), share.alias("confidence"))


def shape_reading(glyphs: DataFrame, readings: DataFrame, similarity: float = K.SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Shape readings (doc_id, bc_id, shape, shape_confidence, labels), and glyphs with their cluster and label.

    glyphs: doc_id, bc_id, pos, h, v. readings: doc_id, bc_id, ocr. A row whose number of glyphs is that of its
    characters votes for each glyph's character. Rows are taken by bc_id, glyphs by pos.
    """
    members = cluster(glyphs, ["doc_id"], ["bc_id", "pos"], ["bc_id", "pos"], similarity)
    n = F.count("*").over(Window.partitionBy("doc_id", "bc_id"))
    m = members.withColumn("_n", n).join(readings.select("doc_id", "bc_id", F.coalesce("ocr", F.lit("")).alias("_t")), ["doc_id", "bc_id"], "left")
    m = m.withColumn("_voice", F.when(F.col("_n") == F.length("_t"), at(F.col("_t"), F.col("pos"))))
    labels = vote(m, ["doc_id", "cluster_id"], "_voice")
    out = m.select("doc_id", "bc_id", "pos", "cluster_id").join(labels, ["doc_id", "cluster_id"], "left")
    out = out.withColumn("label", F.coalesce("label", F.lit("?"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    rows = out.groupBy("doc_id", "bc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "confidence"))).alias("labels"))
    rows = rows.select("doc_id", "bc_id", F.array_join("labels.label", "").alias("shape"), F.array_min("labels.confidence").alias("shape_confidence"), "labels")
    return rows, out


def cluster_count(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by).agg(F.countDistinct("cluster_id").alias("n_clusters"))


def doubtful(labels: Column, reading: Column, template: Column, wrong: Column) -> Column:
    """array<struct<pos, bad, doubt>>: glyphs to look at. bad: the template reads another character than the value (or,
    without a template, the text does: give wrong accordingly); doubt: no sure label, one that differs from the text,
    or unread by the template."""
    return F.transform(
        labels,
        lambda x: F.struct(
            x["pos"].alias("pos"),
            F.array_contains(wrong, x["pos"]).alias("bad"),
            ((x["label"] == "?") | (x["confidence"] < 0.95) | ~x["label"].eqNullSafe(at(reading, x["pos"])) | F.coalesce(at(template, x["pos"]) == "?", F.lit(False))).alias("doubt"),
        ),
    )
