"""Byte-level byte-pair encoding and decoding by merge ranks.

A text is cut into pieces by a pattern. Of each piece, a segment tree over byte positions holds at a leaf the
rank of the pair that starts there, and at every inner node the least rank below and, for equal ranks, the
leftmost. A merge takes the root, joins two neighbours in a linked list of live positions and updates at most
three leaves, so a piece of n bytes takes O(n log n) steps even when it is one long run.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a worker keeps, in each of two generations, and the longest piece that is kept.
CACHE_PIECES = 300_000
CACHE_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTree:
    """Minimum of (rank, position) over positions, with point updates; keys are rank * span + position."""

    def __init__(self, keys: list[int], none: int):
        self.size = size = 1 << max(0, (len(keys) - 1).bit_length())
        self.none = none
        self.nodes = nodes = [none] * size + keys + [none] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def least(self) -> int:
        return self.nodes[1]

    def put(self, position: int, key: int) -> None:
        nodes = self.nodes
        i = position + self.size
        nodes[i] = key
        while i > 1:
            j = nodes[i ^ 1]
            if j < key:
                key = j
            i >>= 1
            if nodes[i] == key:
                return
            nodes[i] = key


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of least rank until no pair has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    span = n + 1
    none = 1 << 62
    get = ranks.get
    keys = [none if (r := get(piece[i : i + 2])) is None else r * span + i for i in range(n - 1)]
    tree = PairTree(keys, none)
    put, nodes = tree.put, tree.nodes
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n - 1))  # start of the token before
    while (best := nodes[1]) != none:
        i = best % span
        j = end[i]
        stop = end[i] = end[j]
        if j < n - 1 or stop < n:
            put(j, none)
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            put(i, none if r is None else r * span + i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            r = get(piece[h:stop])
            put(h, none if r is None else r * span + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Pieces(dict):
    """Decimal ids of pieces; a piece that isn't there is encoded, and kept if it is short."""

    def __init__(self, ranks: dict[bytes, int], old: dict[str, str]):
        super().__init__()
        self.ranks, self.old = ranks, old

    def __missing__(self, piece: str) -> str:
        found = self.old.get(piece) or " ".join(map(str, encode_piece(piece.encode(), self.ranks)))
        if len(piece) <= CACHE_CHARS:
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder of whole texts; ids of short pieces are kept between texts, as decimal text.

    Two generations bound the cache: a full one becomes the old one, and the one before is dropped.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces = ranks, regex.compile(pattern).findall
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.known = _Pieces(ranks, {})

    def encode(self, text: str | None) -> str:
        """Ids in decimal, joined by one space; a null text is empty."""
        if not text:
            return ""
        out = " ".join(map(self.known.__getitem__, self.pieces(text)))
        if len(self.known) > CACHE_PIECES:
            self.known.old = {}
            self.known = _Pieces(self.ranks, self.known)
        return out

    def decode(self, decimal: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, decimal.split(" "))) if decimal else b""


_kept: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """The codec that this worker keeps from task to task, with the ids of pieces that it has seen; one at a time."""
    if (path, pattern) not in _kept:
        _kept.clear()
        _kept[path, pattern] = Codec(read_ranks(path), pattern)
    return _kept[path, pattern]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, derive: dict[str, tuple[str, Callable[[str, bytes], object]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids again: (doc_id, n_tokens, ids array<int>, decoded binary).

    docs: id_col (long) and text_col (string); further columns are ignored, repeated rows are encoded as often
    as they occur, a null id stays null, a null or empty text has no ids and decodes to no bytes. No rows, no
    result. With derive, a dict of column name to (long, string, binary or array<int>; function of the decimal
    ids and the decoded bytes), those columns stand in the place of ids and decoded. ranks_path is read by each
    worker and has to be at the same place on every machine. One pass over the texts, no shuffle.
    """
    spec = derive or {"ids": ("array<int>", lambda ids, _: [int(x) for x in ids.split()]), "decoded": ("binary", lambda _, raw: raw)}
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in batches:
            counts: list[int] = []
            columns: dict[str, list] = {k: [] for k in spec}
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                raw = codec.decode(ids)
                counts.append(ids.count(" ") + 1 if ids else 0)
                for k, (_, fn) in spec.items():
                    columns[k].append(fn(ids, raw))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())} | {k: pa.array(v, kinds[spec[k][0]]) for k, v in columns.items()})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, " + ", ".join(f"{k} {t}" for k, (t, _) in spec.items()))


def digest(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()
