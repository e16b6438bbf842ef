"""Embedding near-duplicates by hierarchical navigable small-world graphs, one for each shard of a label.

Equal directions are one class first, so copies cost nothing. A label's classes are dealt into shards of about SHARD
vectors; each shard's graph (Malkov and Yashunin 2018) is built once and stored, and every class of the label queries
every shard of it, in blocks of queries. Each task first audits a beam against brute force on a sample of its queries,
by the links that they have with others, and doubles it until the audit finds every one. A query is then a range
search: its own beam widens on until the farthest vector in it lies below the threshold. Candidates near the
threshold are verified in double precision. Links are counted and merged as they are found, not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import connected_components, stored

COSINE = 0.98
SHARD, QUERIES = 4096, 8192
#: Neighbours of a vector in a layer, beam while building, first beam of a query, queries audited in a task.
M, BUILD_BEAM, BEAM, AUDIT = 12, 32, 32, 256
#: How far single precision may be off; partitions of the search at most.
SLACK, PARTITIONS = 1e-5, 100_000


def _top(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest scores of each row, highest first."""
    if score.shape[1] > n:
        part = np.argpartition(-score, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-score, axis=1, kind="stable")


class Graph:
    """A layered neighbour graph of unit vectors, built and searched for many vectors at a time."""

    def __init__(self, vectors: np.ndarray, m: int = M, beam: int = BUILD_BEAM, seed: int = 1):
        self.x, n = vectors.astype(np.float32), len(vectors)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
        order = np.argsort(-levels, kind="stable")  # a layer's members are a prefix, so the top is built first
        self.x, self.names = self.x[order], order
        self.counts = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
        self.near: list[np.ndarray] = []
        for k in range(len(self.counts) - 1, -1, -1):
            self.near.insert(0, self._layer(self.counts[k], 2 * m if k == 0 else m, beam, k))
        self.near[0] = self._reach_all(self.near[0])

    def _layer(self, n: int, width: int, beam: int, k: int) -> np.ndarray:
        """Neighbours in a layer: what a beam search finds among the members before, and back links."""
        near = np.full((n, width), -1, np.int32)
        done = min(n, 2 * width)
        self._connect(near, np.arange(done), np.tile(np.arange(done), (done, 1)))
        while done < n:
            step = np.arange(done, min(n, 2 * done))
            start = self._enter(self.x[step], k, done)
            found, _ = self._beam(self.x[step], near[:done], start, beam)
            # Members of the same step don't see each other's links yet; they are compared block by block.
            own = np.empty((len(step), min(width, len(step))), np.int64)
            for a in range(0, len(step), 512):
                score = self.x[step[a : a + 512]] @ self.x[step].T
                own[a : a + 512] = step[_top(score, step, own.shape[1])]
            self._connect(near, step, np.concatenate([found, own], axis=1))
            done += len(step)
        return near

    def _connect(self, near: np.ndarray, rows: np.ndarray, found: np.ndarray) -> None:
        """Give rows their neighbours among found, then offer each link back."""
        width = near.shape[1]
        for a in range(0, len(rows), 256):
            near[rows[a : a + 256]] = self._select(rows[a : a + 256], found[a : a + 256], width)
        src, to = np.repeat(rows, width), near[rows].reshape(-1)
        src, to = src[to >= 0], to[to >= 0]
        score = np.einsum("nd,nd->n", self.x[src], self.x[to])
        order = np.lexsort((-score, to))
        src, to = src[order], to[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
        rank = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        back = np.full((len(first), width), -1, np.int64)
        take = rank < width
        back[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(to))))[take], rank[take]] = src[take]
        ends = to[first]
        for a in range(0, len(ends), 256):
            part = ends[a : a + 256]
            near[part] = self._select(part, np.concatenate([near[part], back[a : a + 256]], axis=1), width)

    def _select(self, rows: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
        """Of found, nearest first, those that are nearer to their row than to one taken before; others fill up."""
        found = np.sort(found, axis=1)
        again = np.zeros(found.shape, bool)
        again[:, 1:] = found[:, 1:] == found[:, :-1]
        bad = again | (found < 0) | (found == rows[:, None])
        to = np.where(bad, -2, np.einsum("nd,nkd->nk", self.x[rows], self.x[np.maximum(found, 0)]))
        top = _top(to, found, min(found.shape[1], 3 * width))
        found, to = np.take_along_axis(found, top, 1), np.take_along_axis(to, top, 1)
        v = self.x[np.maximum(found, 0)]
        among = np.einsum("nkd,nld->nkl", v, v)
        taken, nearest = np.zeros(found.shape, bool), np.full(found.shape, -2.0)
        for c in range(found.shape[1]):
            good = (to[:, c] > nearest[:, c]) & (to[:, c] > -2) & (taken.sum(1) < width)
            taken[:, c] = good
            nearest = np.where(good[:, None], np.maximum(nearest, among[:, :, c]), nearest)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :width]
        out = np.full((len(rows), width), -1, np.int32)
        out[:, : order.shape[1]] = np.where(np.take_along_axis(to, order, 1) > -2, np.take_along_axis(found, order, 1), -1)
        return out

    def _reach_all(self, near: np.ndarray) -> np.ndarray:
        """near with columns added so that a walk from member 0 reaches every member."""
        n = len(near)
        spare = np.full((n, 2), -1, np.int32)
        seen, edge = np.zeros(n, bool), np.zeros(1, np.int64)
        seen[0] = n > 0
        while n:
            while len(edge):
                more = np.unique(np.concatenate([near[edge].reshape(-1), spare[edge].reshape(-1)]))
                edge = more[(more >= 0)]
                edge = edge[~seen[edge]]
                seen[edge] = True
            lost = np.flatnonzero(~seen)
            if not len(lost):
                break
            # The nearest member that is reached and has a place left takes in a lost one, which leads on to others.
            i = lost[0]
            free = np.flatnonzero(seen & (spare < 0).any(1))
            j = free[(self.x[free] @ self.x[i]).argmax()]
            spare[j, np.flatnonzero(spare[j] < 0)[0]] = i
            seen[i], edge = True, np.array([i])
        return np.concatenate([near, spare], axis=1)

    def _enter(self, q: np.ndarray, k: int, limit: int) -> np.ndarray:
        """Where a search of layer k begins: the nearest member that greedy descent finds in the layers above."""
        at = np.zeros(len(q), np.int64)
        for level in range(len(self.counts) - 1, k, -1):
            near = self.near[level - k - 1] if len(self.near) < len(self.counts) else self.near[level]
            for _ in range(64):
                options = np.concatenate([at[:, None], near[at]], axis=1)
                score = np.where(options >= 0, np.einsum("nd,nkd->nk", q, self.x[np.maximum(options, 0)]), -2)
                best = options[np.arange(len(q)), score.argmax(1)]
                if (best == at).all():
                    break
                at = best
        return np.where(at < limit, at, 0)

    def _beam(self, q: np.ndarray, near: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, scores) of the best beam found for each query, best first; -1 where there are fewer."""
        n, limit = len(q), len(near)
        beam = min(beam, limit)
        ids = np.full((n, beam), -1, np.int64)
        score = np.full((n, beam), -2, np.float32)
        ids[:, 0], score[:, 0] = start, np.einsum("nd,nd->n", q, self.x[start])
        seen = np.zeros((n, limit), bool)
        seen[np.arange(n), start] = True
        open_ = np.zeros((n, beam), bool)
        open_[:, 0] = True
        live, step = np.arange(n), max(1, beam // 32)  # a wide beam opens more members at a time
        while len(live):
            order = np.argpartition(-np.where(open_[live], score[live], -3), min(step, beam) - 1, axis=1)[:, :step]
            ready = np.take_along_axis(open_[live], order, 1)
            open_[live[:, None], order] = False
            more = np.where(ready[:, :, None], near[np.maximum(ids[live[:, None], order], 0)], -1).reshape(len(live), -1).astype(np.int64)
            if step > 1:
                more = np.sort(more, axis=1)
                more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            bad = (more < 0) | (more >= limit)
            more = np.where(bad, 0, more)
            bad |= seen[live[:, None], more]
            at = np.nonzero(~bad)
            seen[live[at[0]], more[at]] = True
            s = np.where(bad, -2, np.einsum("nd,nkd->nk", q[live], self.x[more])).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(bad, -1, more)], axis=1)
            all_score = np.concatenate([score[live], s], axis=1)
            all_open = np.concatenate([open_[live], ~bad], axis=1)
            top = _top(all_score, all_ids, beam)
            ids[live], score[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_score, all_open))
            live = live[open_[live].any(1)]
        return ids, score

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, member, score) of pairs found at a score of `least` or more, for some queries at a time.

        The beam of a query that it fills is doubled. One of half the members or more reads them all.
        """
        q = q.astype(np.float32)
        todo, near, n = np.arange(len(q)), self.near[0], len(self.x)
        while len(todo):
            full, rows = [todo[:0]], max(16, min(512, (1 << 15) // beam))
            for a in range(0, len(todo), rows):
                part = todo[a : a + rows]
                if 2 * beam >= n:
                    score = q[part] @ self.x.T
                    r, c = np.nonzero(score >= least)
                    yield part[r], self.names[c], score[r, c]
                    continue
                ids, score = self._beam(q[part], near, self._enter(q[part], 0, len(near)), beam)
                wide = score[:, -1] >= least
                full.append(part[wide])
                r, c = np.nonzero((score >= least) & ~wide[:, None])
                yield part[r], self.names[ids[r, c]], score[r, c]
            todo, beam = np.concatenate(full), 2 * beam

    def pack(self) -> dict[str, bytes]:
        """The graph as bytes, for unpack()."""
        widths = np.array([[len(x), x.shape[1]] for x in self.near], np.int32)
        return {"sizes": widths.tobytes(), "x": self.x.tobytes(), "names": self.names.astype(np.int32).tobytes(), "near": b"".join(x.astype(np.int32).tobytes() for x in self.near)}

    @classmethod
    def unpack(cls, sizes: bytes, x: bytes, names: bytes, near: bytes) -> Graph:
        self = cls.__new__(cls)
        widths, self.names, at = np.frombuffer(sizes, np.int32).reshape(-1, 2), np.frombuffer(names, np.int32), 0
        self.x, self.counts, self.near = np.frombuffer(x, np.float32).reshape(len(self.names), -1), widths[:, 0].tolist(), []
        flat = np.frombuffer(near, np.int32)
        for n, w in widths.tolist():
            self.near.append(flat[at : at + n * w].reshape(n, w))
            at += n * w
        return self


def _pairs(graph: Graph, vectors: np.ndarray, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, vector) pairs of cosine >= least, for some queries at a time; those near it are computed again in double precision."""
    for a, b, score in graph.within(queries, least - SLACK, beam):
        near = np.flatnonzero(score < least + SLACK)
        good = np.ones(len(a), bool)
        for s in range(0, len(near), 1 << 16):
            i = near[s : s + (1 << 16)]
            good[i] = np.einsum("nd,nd->n", queries[a[i]], vectors[b[i]]) >= least
        yield a[good], b[good]


def audited(graph: Graph, vectors: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None, audit: int = AUDIT, beam: int = BEAM) -> dict:
    """The beam at which a sample of queries finds all its links, and what the audits saw.

    own: of each query, the vector that is itself, or -1; that isn't a link. wanted counts the sample's links by brute
    force, recall is the share of them that each beam tried found; without links there is none, and the beam stays.
    """
    sample = np.sort(np.random.default_rng(7).permutation(len(queries))[:audit])
    q, v = np.nonzero(queries[sample] @ vectors.T >= least)
    own = np.full(len(queries), -1) if own is None else own
    other = own[sample[q]] != v
    wanted = (q[other] * len(vectors) + v[other]).astype(np.int64)
    report = {"beam": beam, "audited": len(sample), "wanted": len(wanted), "recall": []}
    while len(wanted):
        found = [a.astype(np.int64) * len(vectors) + b for a, b in _pairs(graph, vectors, queries[sample], least, report["beam"])]
        report["recall"].append(float(np.isin(wanted, np.concatenate(found)).mean()))
        if report["recall"][-1] == 1 or report["beam"] >= len(vectors):
            break
        report["beam"] *= 2
    return report


def search(vectors: np.ndarray, queries: np.ndarray, least: float, own: np.ndarray | None = None, audit: int = AUDIT, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, dict]:
    """(query, vector) pairs of cosine >= least, and the audits' report. All rows are unit vectors in double precision."""
    graph = Graph(vectors)
    report = audited(graph, vectors, queries, least, own, audit, beam)
    found = list(_pairs(graph, vectors, queries, least, report["beam"]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]), report


class _Merged:
    """Components of nodes, from pairs that arrive in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def near_duplicates(vectors: DataFrame, least: float = COSINE, shard: int = SHARD, queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of one label link at a cosine of `least` or more. A label or vector that is null, a zero vector, and one
    with null or non-finite components link with nothing; so do vectors of different lengths. n_links counts the
    other rows linked directly, component_id is the smallest id reachable, kept says whether it is the row's own.
    Rows that repeat an id count as rows of their own. A row without an id gets no component and isn't kept.
    Further columns are ignored; an empty table gives no rows.

    Rows of one direction are gathered by an aggregate that is combined before the shuffle. Queries of a label
    are dealt in blocks to each of its shards, so the largest task holds one shard's graph and one block.
    """
    return with_audits(vectors, least, shard, queries, id_col, vector_col, label_col)[0]


def with_audits(vectors: DataFrame, least: float = COSINE, shard: int = SHARD, queries: int = QUERIES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """near_duplicates(), and one row for each search task: (task, beam, audited, wanted, recall array<double>).

    recall has the share of the sample's links with others that each beam tried has found, the last one kept.
    """
    x = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    good = F.coalesce(F.col("label").isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists(x, lambda y: y != 0), F.lit(False))
    # The largest component first, so that neither tiny nor huge vectors leave the range of a double.
    top = F.array_max(F.transform(x, F.abs))
    rows = rows.withColumn("good", good).withColumn("v", F.when(F.col("good"), F.transform(x, lambda y: y / top)))
    rows = rows.withColumn("v", F.transform("v", lambda y: y / norm)).withColumn("key", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.col("label"), F.array_join("v", ",")), 256)))
    rows = stored(rows.select("vec_id", "label", "v", "key"), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("id"), F.count("*").alias("members"))
    classes = stored(classes.select("key", "label", F.size("v").alias("width"), "v", "id", "members", F.xxhash64("key").alias("hash")), "classes")
    counts = classes.groupBy("label", "width").agg(F.count("*").alias("n"))
    counts = stored(counts.select("label", "width", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("n") / queries).cast("int").alias("blocks")), "counts")
    dealt = classes.join(counts, ["label", "width"]).withColumn("shard", F.pmod(F.col("hash"), F.col("shards"))).withColumn("block", F.pmod(F.shiftright("hash", 20), F.col("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    name = lambda *last: F.concat_ws(",", "label", F.col("width").cast("string"), *(F.col(c).cast("string") for c in last))
    work = counts.agg(F.sum(F.col("shards").cast("long")).alias("graphs"), F.sum(F.col("shards").cast("long") * F.col("blocks")).alias("tasks")).first()

    def build(t: pa.Table) -> pa.Table:
        v = _matrix(t.column("v"))
        of = {"graph": t.column("graph")[0].as_py(), "blocks": t.column("blocks")[0].as_py(), **Graph(v).pack(), "v": v.tobytes()}
        of |= {"keys": t.column("key").to_pylist(), "ids": t.column("id").to_pylist(), "members": t.column("members").to_pylist()}
        return pa.table({k: pa.array([of[k]], kind) for k, kind in _GRAPH.items()})

    # Few bytes but much work in each task: as many partitions as graphs or tasks, which grow with the vectors.
    graphs = dealt.select(name("shard").alias("graph"), "blocks", "key", "v", "id", "members").repartition(min(PARTITIONS, work["graphs"] or 1), "graph")
    graphs = stored(graphs.groupBy("graph").applyInArrow(build, "graph string, blocks int, sizes binary, x binary, names binary, near binary, v binary, keys array<string>, ids array<long>, members array<long>"), "graphs")
    n = min(PARTITIONS, work["tasks"] or 1)
    graphs = graphs.withColumn("block", every("blocks")).withColumn("task", F.concat_ws(",", "graph", F.col("block").cast("string"))).repartition(n, "task")
    asked = dealt.withColumn("shard", every("shards")).select(name("shard", "block").alias("task"), "key", "v", "id").repartition(n, "task")

    def run(asks: pa.Table, graph: pa.Table) -> pa.Table:
        if not len(asks) or not len(graph):
            return _answer()
        g = {k: graph.column(k)[0] for k in _GRAPH}
        q = _matrix(asks.column("v"))
        v = np.frombuffer(g["v"].as_buffer()).reshape(-1, q.shape[1])
        made = Graph.unpack(*(g[k].as_buffer() for k in ("sizes", "x", "names", "near")))
        number = {k: i for i, k in enumerate(g["keys"].as_py())}
        own = np.array([number.get(k, -1) for k in asks.column("key").to_pylist()])
        members, links, merged = np.asarray(g["members"].values), np.zeros(len(q)), _Merged(len(v) + len(q))
        report = audited(made, v, q, least, own)
        for a, b in _pairs(made, v, q, least, report["beam"]):
            other = own[a] != b
            links += np.bincount(a[other], weights=members[b[other]], minlength=len(q))
            merged.add(a + len(v), b)
        ids = np.concatenate([np.array([np.nan if i is None else i for i in g["ids"].as_py()], object), np.array(asks.column("id").to_pylist(), object)])
        return _answer(asks.column("key"), links.astype(np.int64), ids, merged.label, asks.column("task")[0].as_py(), report)

    found = asked.groupBy("task").cogroup(graphs.groupBy("task")).applyInArrow(run, "key string, links long, src long, dst long, task string, beam int, audited int, wanted long, recall array<double>")
    found = stored(found, "links")
    audits = found.where("task is not null").select("task", "beam", "audited", "wanted", "recall")
    found = found.where("task is null")
    merged = connected_components(found.where("src is not null").select("src", "dst"))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    out = classes.select("key", "id", "members").join(linked, "key", "left").join(merged.select(F.col("id").alias("id"), "component_id"), "id", "left")
    out = out.select("key", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    out = rows.select("vec_id", "key").join(out, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), audits


_GRAPH = {
    "graph": pa.string(), "blocks": pa.int32(), "sizes": pa.binary(), "x": pa.binary(), "names": pa.binary(), "near": pa.binary(), "v": pa.binary(),
    "keys": pa.list_(pa.string()), "ids": pa.list_(pa.int64()), "members": pa.list_(pa.int64()),
}


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, float).reshape(len(column), -1)


def _answer(keys: pa.ChunkedArray | None = None, links: np.ndarray | None = None, ids: np.ndarray | None = None, label: np.ndarray | None = None, task: str | None = None, report: dict | None = None) -> pa.Table:
    """Link counts of the queries, pairs of ids that connect what the links connect, and the audits' report."""
    kinds = {"key": pa.string(), "links": pa.int64(), "src": pa.int64(), "dst": pa.int64(), "task": pa.string(), "beam": pa.int32(), "audited": pa.int32(), "wanted": pa.int64(), "recall": pa.list_(pa.float64())}
    if keys is None:
        return pa.table({k: pa.array([], t) for k, t in kinds.items()})
    rows = [{"key": k, "links": n} for k, n in zip(keys.to_pylist(), links.tolist(), strict=True) if n]
    at = np.flatnonzero(label != np.arange(len(label)))
    known = lambda i: None if ids[i] is None or ids[i] != ids[i] else int(ids[i])
    heads: dict[int, int] = {}
    for i in range(len(label)):  # the first member with an id stands for its component
        if label[i] not in heads and known(i) is not None:
            heads[label[i]] = known(i)
    rows += [{"src": known(i), "dst": heads[label[i]]} for i in [*at.tolist(), *np.unique(label[at]).tolist()] if known(i) is not None and known(i) != heads[label[i]]]
    rows.append({"task": task, "beam": report["beam"], "audited": report["audited"], "wanted": report["wanted"], "recall": report["recall"]})
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})
