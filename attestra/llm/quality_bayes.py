"""Quality classifier with hierarchical empirical Bayes over sites.

A linear classifier gives each document its log-odds of a fault (low quality, toxicity), from hashed words and word
beginnings and a few traits of style. Grouped sums of these chances over all documents give each host and each
path of a host a rate. Rates are shrunk: a host's toward the global one, a path's toward its host's, as strongly as
the rates scatter less than chance alone would have it (moments of a beta-binomial). What a path's posterior rate
says beyond the global one is added to the document's log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import stored
from attestra.llm.word_hash import ALNUM, blocks, prefixes, words

#: Labelled documents that the classifier is fitted on at most, chosen by a hash of their id, and hashed features that it
#: uses of each fault at most, the most telling ones. Together they bound what reaches the driver: two bytes for each
#: feature of a document that is one of these.
MAX_TRAIN, MAX_FEATURES = 20_000, 2048
#: Hashed features; the length of word beginnings in bytes; chances of low
#: quality and of toxicity from which a document is rejected.
BITS, PREFIX, REJECT = 18, 5, (0.5, 0.2)
EPOCHS, STEPS, RATE, BATCH, L2, TELLING = 12, 1500, 0.3, 64, 1e-4, 20.0
STYLES = ("upper", "symbols", "bars", "digits", "repeats", "variety", "word_bytes", "words")
_FAULTS = ("low_quality", "toxic")
_TALLY = ("low_0", "low_1", "bad_0", "bad_1")


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end text, owner, feature, styles): distinct hashed features by text, and a row of STYLES for each."""
    for a, b, part, offsets in blocks(texts):
        h, starts, ends, bounds = words(part, offsets, ALNUM)
        owner = np.repeat(np.arange(b - a), np.diff(bounds))
        hashed = np.concatenate([h, prefixes(part, starts, ends, PREFIX)]) >> np.uint64(64 - BITS)
        pairs = np.unique((np.tile(owner, 2).astype(np.int64) << BITS) | hashed.astype(np.int64))
        per = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offsets])
        size, n = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(bounds), 1)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        kinds = [(part >= 65) & (part <= 90), np.isin(part, np.frombuffer(b"!%$&*#", np.uint8)), part == 124, (part >= 48) & (part <= 57)]
        whole = pairs >> BITS
        styles = np.stack(
            [
                *(per(k) / size for k in kinds),
                np.bincount(owner[same], minlength=b - a) / n,
                np.bincount(whole, minlength=b - a) / (2 * n),
                np.bincount(owner, weights=ends - starts, minlength=b - a) / n / 10,
                np.log1p(np.diff(bounds)) / 10,
            ],
            axis=1,
        )
        yield a, b, whole, (pairs & ((1 << BITS) - 1)).astype(np.int32), styles


def _logits(weights: np.ndarray, owner: np.ndarray, feature: np.ndarray, styles: np.ndarray, n: int) -> np.ndarray:
    """One column for each fault."""
    out = styles @ weights[1 << BITS : -1] + weights[-1]
    for k in range(weights.shape[1]):
        out[:, k] += np.bincount(owner, weights=weights[feature, k], minlength=n)
    return out


def _telling(counts: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """Features whose presence goes with a fault, or against it, beyond chance: G statistic over TELLING, in 3 texts or
    more, the `most` highest. counts: texts with each feature, without and with the fault; of: all such texts."""
    total, n, g = counts.sum(0), of.sum(), np.zeros(counts.shape[1])
    for c in (0, 1):
        for seen, all_ in ((counts[c], total), (of[c] - counts[c], n - total)):
            expected = np.maximum(all_ * of[c] / max(n, 1), 1e-12)
            g += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0)
    found = np.flatnonzero((g > TELLING) & (total >= 3))
    return np.sort(found[np.argsort(-g[found], kind="stable")[:most]])


def fit(sets: list[np.ndarray], styles: np.ndarray, targets: np.ndarray, telling: list[np.ndarray], size: int, seed: int = 5) -> np.ndarray:
    """Weights of features (numbered below size), of styles and of the bias, by adaptive gradients; a column for each fault.

    targets may hold nan where a label is missing; telling has the features that a fault may use. A fault without both
    classes gets no weight but its prior.
    """
    weights = np.zeros((size + styles.shape[1] + 1, targets.shape[1]))
    rng = np.random.default_rng(seed)
    for k in range(targets.shape[1]):
        known = np.flatnonzero(~np.isnan(targets[:, k]))
        y = targets[known, k]
        share = y.mean() if len(y) else 0.0
        weights[-1, k] = np.log((share + 1e-4) / (1 - share + 1e-4))
        if not 0 < share < 1:
            continue
        use = np.zeros(size, bool)
        use[telling[k]] = True
        own = [sets[i][use[sets[i]]] for i in known]
        middle, spread = styles[known].mean(0), styles[known].std(0) + 1e-6
        x = (styles[known] - middle) / spread
        w, square = np.zeros(size + x.shape[1] + 1), np.full(size + x.shape[1] + 1, 1e-2)
        w[-1] = weights[-1, k]
        for _ in range(max(EPOCHS, STEPS * BATCH // len(own))):
            order = rng.permutation(len(own))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                owner = np.repeat(np.arange(len(part)), [len(own[i]) for i in part])
                feature = np.concatenate([own[i] for i in part]).astype(np.int64)
                z = x[part] @ w[size:-1] + w[-1] + np.bincount(owner, weights=w[feature], minlength=len(part))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                rows, back = np.unique(feature, return_inverse=True)
                at = np.concatenate([rows, np.arange(size, len(w))])
                step = np.concatenate([np.bincount(back, weights=error[owner], minlength=len(rows)), x[part].T @ error, [error.sum()]]) + L2 * w[at]
                square[at] += step**2
                w[at] -= RATE * step / np.sqrt(square[at])
        weights[:size, k], weights[size:-1, k] = w[:size], w[size:-1] / spread
        weights[-1, k] = w[-1] - (middle * weights[size:-1, k]).sum()
    return weights


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted on at most max_train labelled documents, those of the smallest hashes of their ids.

    labels: doc_id, quality (0: low) and toxic (1: toxic). Of several labels of an id the worst counts, and nulls
    don't; of several texts of an id one counts. Features are counted where the texts are. What reaches the driver is
    one row of counts for each of the 2**BITS features, and then of each document the numbers of its telling features.
    """
    spark = docs.sparkSession
    l = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("double").alias("low"), F.max("toxic").cast("double").alias("bad"))
    l = l.where("low is not null or bad is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train ids: a bound that holds at any size of the input.
    chosen = _rows(docs, id_col, text_col).join(F.broadcast(l), "doc_id").select("doc_id", "text", "low", "bad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, owner, feature, styles in features(batch.column(1)):
                at = np.searchsorted(owner, np.arange(b - a + 1))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "low": part.column(2),
                        "bad": part.column(3),
                        "features": pa.array([feature[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                        "styles": pa.array([x.tobytes() for x in styles], pa.binary()),
                    }
                )

    got = chosen.mapInArrow(run, "doc_id long, low double, bad double, features binary, styles binary")
    got = stored(got.groupBy("doc_id").agg(F.min(F.struct("features", "styles", "low", "bad")).alias("x")).select("doc_id", "x.*"), "features")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(0)]
            flat, size = np.concatenate([np.zeros(0, np.int32), *sets]), 1 << BITS
            n = np.array([len(x) for x in sets])
            out = [np.bincount(flat[np.repeat(np.asarray(batch.column(k)) == c, n)], minlength=size) for k in (1, 2) for c in (0, 1)]
            some = np.flatnonzero(np.bincount(flat, minlength=size))
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in out)], names=["feature", *_TALLY])

    classes = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c in ("low", "bad") for v in (0, 1)]
    of = np.array(got.agg(*classes).first(), float).reshape(2, 2)
    rows = got.select("features", F.coalesce("low", F.lit(-1.0)).alias("low"), F.coalesce("bad", F.lit(-1.0)).alias("bad")).mapInArrow(tally, "feature long, " + ", ".join(f"{c} long" for c in _TALLY))
    rows = rows.groupBy("feature").agg(*(F.sum(c).alias(c) for c in _TALLY)).toArrow()  # at most 2**BITS rows
    counts = np.zeros((4, 1 << BITS))
    counts[:, rows.column("feature").to_numpy()] = [rows.column(c).to_numpy() for c in _TALLY]
    chosen_by = [_telling(counts[2 * k : 2 * k + 2], of[k], MAX_FEATURES) for k in (0, 1)]
    names = np.unique(np.concatenate(chosen_by))
    sent = spark.sparkContext.broadcast(names)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, np.int32)
        number[sent.value] = np.arange(len(sent.value))
        for batch in batches:
            sets = [number[np.frombuffer(x.as_buffer(), np.int32)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0].astype("<u2").tobytes() for x in sets], pa.binary()), *batch.columns[2:]], names=["doc_id", "features", "styles", "low", "bad"])

    got = got.mapInArrow(narrow, "doc_id long, features binary, styles binary, low double, bad double").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    sets = [np.frombuffer(got.column("features")[i].as_buffer(), "<u2") for i in order.tolist()]
    styles = np.array([np.frombuffer(got.column("styles")[i].as_buffer()) for i in order.tolist()]).reshape(len(sets), len(STYLES))
    targets = np.stack([got.column(c).to_numpy(zero_copy_only=False)[order].astype(float) for c in ("low", "bad")], axis=1)
    compact = fit(sets, styles, targets, [np.searchsorted(names, x) for x in chosen_by], len(names))
    weights = np.zeros(((1 << BITS) + len(STYLES) + 1, len(_FAULTS)))
    weights[names], weights[1 << BITS :] = compact[: len(names)], compact[len(names) :]
    return weights


def document_odds(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, low_quality, toxic): the classifier's log-odds; one pass over the texts."""
    # Only a few features tell; the other weights are zero and don't travel.
    some = np.flatnonzero(weights.any(1))
    shape, sent = weights.shape, docs.sparkSession.sparkContext.broadcast((some, weights[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(shape)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = [_logits(w, owner, feature, styles, b - a) for a, b, owner, feature, styles in features(batch.column(1))]
            out = np.concatenate([np.zeros((0, shape[1])), *out])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "host": batch.column(2), "path": batch.column(3)} | {f: out[:, k] for k, f in enumerate(_FAULTS)})

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return _rows(docs, id_col, text_col, text(host).alias("host"), text(path).alias("path")).mapInArrow(run, "doc_id long, host string, path string, low_quality double, toxic double")


def _chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _odds(chance: Column) -> Column:
    return F.log(chance / (1 - chance))


def _strength(rates: DataFrame, sums: str, size: str, prior: str) -> float:
    """How many documents a prior weighs: the moments of beta-binomial groups around their priors.

    The weighted scatter of the groups' rates is what chance explains plus what the groups differ by; with prior
    mean p and strength s the latter is p (1 - p) / (s + 1). No difference beyond chance gives a strength of 1e6.
    """
    p, n, x = F.col(prior), F.col(size), F.col(sums)
    row = rates.where(n > 1).agg(F.sum((x - n * p) ** 2 / n).alias("scatter"), F.sum(p * (1 - p)).alias("chance"), F.sum((n - 1) * p * (1 - p)).alias("more")).first()
    extra = (row["scatter"] or 0.0) - (row["chance"] or 0.0)
    return 1e6 if extra <= 0 or not row["more"] else float(np.clip(row["more"] / extra - 1, 1.0, 1e6))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, reject: tuple[float, float] = REJECT, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, p_low_quality, p_toxic, kept) of every document.

    host and path name a document's site (by default its source, and its language within it); null ones are
    empty. A null or empty text is judged by its styles and its site. Repeated rows and null ids are judged row
    by row; further columns are ignored. Without labels, or with one class only, a fault has its prior chance.
    An empty table gives no rows. The rates of sites are sums over all documents, pre-aggregated, and joined
    back by site; Spark broadcasts them if they are small and splits a hot site's rows otherwise.
    """
    weights = train(docs, labels, max_train, id_col, text_col)
    odds = stored(document_odds(docs, weights, F.col("source") if host is None else host, F.col("lang") if path is None else path, id_col, text_col), "odds")
    sites = odds.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(_chance(F.col(f))).alias(f) for f in _FAULTS))
    sites = stored(sites, "sites")
    hosts = sites.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f).alias(f"host_{f}") for f in _FAULTS))
    total = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_{f}").alias(f) for f in _FAULTS)).first()
    post = sites.join(hosts, "host")
    for f in _FAULTS:
        p = min(max((total[f] or 0.0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
        hosts = hosts.withColumn("prior", F.lit(p))
        s = _strength(hosts, f"host_{f}", "host_n", "prior")
        post = post.withColumn("prior", (F.col(f"host_{f}") + s * p) / (F.col("host_n") + s))
        t = _strength(post, f, "n", "prior")
        post = post.withColumn(f"rate_{f}", (F.col(f) + t * F.col("prior")) / (F.col("n") + t)).withColumn(f"shift_{f}", _odds(F.col(f"rate_{f}")) - float(np.log(p / (1 - p))))
    out = odds.join(post.select("host", "path", *(f"shift_{f}" for f in _FAULTS)), ["host", "path"])
    out = out.select("doc_id", "host", "path", *(_chance(F.col(f) + F.col(f"shift_{f}")).alias(f"p_{f}") for f in _FAULTS))
    return out.withColumn("kept", (F.col("p_low_quality") < reject[0]) & (F.col("p_toxic") < reject[1]))
