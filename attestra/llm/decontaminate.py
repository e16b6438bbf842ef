"""Benchmark decontamination by winnowing.

Of a text's word k-gram hashes, winnowing keeps the minimum of every window of w consecutive ones (all of them at
ties). Two texts that share k + w - 1 words in a row share a whole window, hence a kept hash, so joining kept
hashes of documents and items finds every such span. A joined pair of positions fixes a diagonal; it is extended
to both sides while words agree, and a run is a hit if it holds a whole window of the contamination rule.

Items shorter than that window are one window each: for each such length m, all m-word grams of a document are
joined with the items of that length (k = m, w = 1), which is winnowing's own limit case.

Where the items are too many for every task, a filter of fixed size over their kept hashes goes there instead, and
documents send the windows that their passing hashes stand for. Those are joined with the items' by the kept hash
and the whole window, so that neither a common k-gram nor a long item gathers in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.common import BROADCAST_ROWS, stored
from attestra.llm.word_hash import ALNUM, blocks, grams, words

SPAN, GRAM = 13, 5
#: Words of all items up to which the items go to every task; beyond it, kept hashes are joined by a shuffle.
LOCAL_WORDS = 2_000_000
#: Bits of the filter, as a power of two.
FILTER_BITS = 27
_FOUND = "struct<n_words: bigint, n_hit: bigint, items: array<string>>"
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])


def winnowed(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, k-gram hashes) that are the minimum of a window of w k-grams inside one text.

    bounds: first word of each text, closed by the number of words.
    """
    g = grams(hashes, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    least, width = g, 1
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:n] == owner[k + w - 2 : k + w - 2 + n]
    most = np.zeros(len(g) + w - 1, np.uint64)
    most[w - 1 : w - 1 + n] = np.where(inside, least, 0)
    width = 1
    while width < w:
        step = min(width, w - width)
        most = np.maximum(most[:-step], most[step:])
        width += step
    at = np.flatnonzero((most[: len(g)] == g) & (most[: len(g)] > 0))
    return at, g[at]


class Items:
    """Kept hashes of the items, sorted, for each pair (k, w) that the items' lengths ask for."""

    def __init__(self, rows: list[tuple[object, np.ndarray]], span: int, gram: int):
        self.span, self.rows = span, [(i, h) for i, h in rows if len(h)]
        self.levels: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for j, (_, h) in enumerate(self.rows):
            groups.setdefault((gram, span - gram + 1) if len(h) >= span else (len(h), 1), []).append(j)
        for level, members in groups.items():
            kept = [(j, *winnowed(self.rows[j][1], np.array([0, len(self.rows[j][1])]), *level)) for j in members]
            hashes = np.concatenate([h for _, _, h in kept])
            order = np.argsort(hashes, kind="stable")
            item = np.concatenate([np.full(len(a), j) for j, a, _ in kept])
            self.levels[level] = hashes[order], item[order], np.concatenate([a for _, a, _ in kept])[order]

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs (item, first word, end word) of a block of texts that hold a whole window of an item."""
        found: list[tuple[int, int, int]] = []
        for level, (keys, items, places) in self.levels.items():
            at, h = winnowed(hashes, bounds, *level)
            a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = np.flatnonzero(b > a)
            reached: dict[tuple[int, int], int] = {}
            for s in some:
                for c in range(a[s], b[s]):
                    j, p = int(items[c]), int(at[s])
                    diagonal = p - int(places[c])
                    if reached.get((j, diagonal), -1) > p:
                        continue
                    text = int(np.searchsorted(bounds, p, "right")) - 1
                    first, end = self._extend(hashes, int(bounds[text]), int(bounds[text + 1]), self.rows[j][1], diagonal, p)
                    reached[j, diagonal] = max(end, p + 1)
                    if end - first >= min(self.span, len(self.rows[j][1])):
                        found.append((j, first, end))
        return found

    @staticmethod
    def _extend(doc: np.ndarray, low: int, high: int, item: np.ndarray, diagonal: int, p: int) -> tuple[int, int]:
        """The longest run of equal words on a diagonal around p, inside the text and the item."""
        low, high = max(low, diagonal), min(high, diagonal + len(item))
        same = doc[low:high] == item[low - diagonal : high - diagonal]
        if not same[p - low]:
            return p, p
        left, right = np.flatnonzero(~same[: p - low]), np.flatnonzero(~same[p - low :])
        return (low + int(left[-1]) + 1 if len(left) else low), (p + int(right[0]) if len(right) else high)


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """Whether the words hit are one in `share`, or more, of a document's words."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def _item_rows(ids: list, texts: pa.Array) -> list[tuple[object, np.ndarray]]:
    out = []
    for a, b, part, offsets in blocks(texts):
        h, _, _, bounds = words(part, offsets, ALNUM)
        out += [(ids[i], h[bounds[i - a] : bounds[i - a + 1]]) for i in range(a, b)]
    return out


def _report(items: Items, texts: pa.Array) -> pa.StructArray:
    """One value for each text: its words, the words inside hits, and the items hit."""
    counts, hit, names = [], [], []
    for a, b, part, offsets in blocks(texts):
        h, _, _, bounds = words(part, offsets, ALNUM)
        mark = np.zeros(len(h) + 1, np.int64)
        of: dict[int, set] = {}
        for j, first, end in items.hits(h, bounds):
            mark[first] += 1
            mark[end] -= 1
            of.setdefault(int(np.searchsorted(bounds, first, "right")) - 1, set()).add(items.rows[j][0])
        inside = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
        counts.append(np.diff(bounds))
        hit.append(inside[bounds[1:]] - inside[bounds[:-1]])
        names += [sorted(map(str, of.get(i, ()))) for i in range(b - a)]
    empty = np.zeros(0, np.int64)
    return pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *counts])), pa.array(np.concatenate([empty, *hit])), pa.array(names, pa.list_(pa.string()))], fields=list(_ARROW_FOUND))


def flagged(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, text_col: str = "text", local_words: int = LOCAL_WORDS) -> DataFrame:
    """docs with a column `contamination`: struct<n_words long, n_hit long, items array<string>>.

    Words are runs of ASCII letters (folded), digits and non-ASCII characters. A window is `span` consecutive
    words of an item, or a shorter item as a whole; n_hit counts the words inside any occurrence of a window,
    and items names the items that have one, sorted as strings. benchmark: item_id and text; further columns are
    ignored, those of docs are kept. A null or wordless text has no words and is hit by nothing, a null or wordless
    item hits nothing, an item without an id is left out, repeated items count once and repeated documents are
    reported as often as they occur. Empty tables give no hits, or no rows.

    The items are counted first. Up to local_words words they go to each task and documents are read once,
    without a shuffle. Beyond, windows of both sides are joined by a shuffle, after a filter. The words of a window are
    then known by two 64-bit hashes.
    """
    bench = benchmark.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    columns = docs.columns
    at = columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("contamination", T._parse_datatype_string(_FOUND))])
    if size > 2 * local_words:  # a word and its separator take two characters at least
        return _by_join(docs, bench, span, gram, text_col, schema)
    local = bench.toPandas()
    rows = docs.sparkSession.sparkContext.broadcast((local["item_id"].tolist(), pa.array(local["text"].tolist(), pa.large_string())))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(_item_rows(*rows.value), span, gram)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _report(items, batch.column(at))], names=[*columns, "contamination"])

    return docs.mapInArrow(near, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", local_words: int = LOCAL_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>) of every document, as flagged() finds them."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return flagged(docs, benchmark, span, gram, "text", local_words).select("doc_id", "contamination.*")


def _windows(h: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, kept hash, hash) of every window of w k-grams inside one text; the kept hash is its least."""
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0], g[:0]
    least = np.lib.stride_tricks.sliding_window_view(g, w).min(axis=1)
    at = np.arange(n)
    inside = np.searchsorted(bounds, at, "right") == np.searchsorted(bounds, at + k + w - 2, "right")
    return at[inside], least[inside], grams(h, k + w - 1)[inside]


def _levels(words_of_items: DataFrame, span: int, gram: int) -> list[tuple[int, int]]:
    """(k, w) for the lengths of items that there are, at most span."""
    lengths = sorted(r[0] for r in words_of_items.select(F.least("n", F.lit(span))).distinct().toLocalIterator())
    return [(gram, span - gram + 1) if n == span else (n, 1) for n in lengths if n]


def _filter(items: DataFrame) -> np.ndarray:
    """Bits of the kept hashes, FILTER_BITS of them whatever the number of items."""
    place = items.select(F.col("kept").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place"))
    got = place.groupBy(F.expr("int(shiftright(place, 6))").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(place & 63)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _by_join(docs: DataFrame, bench: DataFrame, span: int, gram: int, text_col: str, schema: T.StructType) -> DataFrame:
    spark, columns = docs.sparkSession, [f.name for f in schema.fields[:-1]]
    # Rows are numbered in a table, so that every later reading finds the same numbers.
    docs = stored(docs.select(F.monotonically_increasing_id().alias("_row"), *columns), "numbered")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(words(part, offsets, ALNUM)[3]) for _, _, part, offsets in blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))], names=["id", "n"])

    def sent(levels: list[tuple[int, int]], passing: Broadcast | None) -> Callable:
        """Windows (id, m, first, kept, window) of rows (id, text); with passing, those whose kept hash passes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None if passing is None else passing.value
            for batch in batches:
                for a, b, part, offsets in blocks(batch.column(1)):
                    h, _, _, bounds = words(part, offsets, ALNUM)
                    ids, counts = batch.column(0).slice(a, b - a), np.diff(bounds)
                    for k, w in levels:
                        first, kept, whole = _windows(h, bounds, k, w)
                        of = np.searchsorted(bounds, first, "right") - 1
                        # An item's own level is that of its length; a document has windows of all levels.
                        if bits is None:
                            take = np.minimum(counts[of], span) == k + w - 1
                        else:
                            place = kept & np.uint64(64 * len(bits) - 1)
                            take = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                        first, kept, whole, of = first[take], kept[take], whole[take], of[take]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(np.full(len(of), k + w - 1, np.int32)), pa.array(first - bounds[of]), pa.array(kept.view(np.int64)), pa.array(whole.view(np.int64))], names=["id", "m", "first", "kept", "window"])

        return run

    windows = "m int, first long, kept long, window long"
    items = bench.select(F.col("item_id").alias("id"), "text")
    kind = items.schema["id"].dataType.simpleString()
    levels = _levels(items.mapInArrow(count, f"id {kind}, n long"), span, gram)
    right = stored(items.mapInArrow(sent(levels, None), f"id {kind}, {windows}").select(F.col("id").alias("item_id"), "m", "kept", "window").distinct(), "items")
    bits = spark.sparkContext.broadcast(_filter(right))
    rows = docs.select(F.col("_row").alias("id"), F.col(text_col).cast("string").alias("text"))
    left = stored(rows.mapInArrow(sent(levels, bits), f"id long, {windows}").withColumnRenamed("id", "_row"), "windows")
    key = ["m", "kept", "window"]
    hits = left.join(right.select(key).distinct(), key, "left_semi")
    # Windows that follow each other on a text are one run; its words count once.
    order = Window.partitionBy("_row").orderBy("first", "m")
    until = F.max(F.col("first") + F.col("m")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("first") + F.col("m") - F.greatest("first", F.coalesce(until, F.lit(0)))
    n_hit = hits.select("_row", "first", "m").distinct().withColumn("new", F.greatest(F.lit(0), new)).groupBy("_row").agg(F.sum("new").alias("n_hit"))
    named = left.select("_row", *key).distinct().join(right, key).select("_row", F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stored(n_hit.join(named, "_row"), "found")
    found = F.broadcast(found) if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else found
    at = columns.index(text_col)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(words(part, offsets, ALNUM)[3]) for _, _, part, offsets in blocks(batch.column(at))]
            n = pa.array(np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.StructArray.from_arrays([n, *batch.columns[-2:]], fields=list(_ARROW_FOUND))], names=[*columns, "contamination"])

    none = F.array().cast("array<string>")
    joined = docs.join(found, "_row", "left").select(*columns, F.coalesce("n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("items", none).alias("_items"))
    return joined.mapInArrow(close, schema)
