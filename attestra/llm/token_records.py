"""Token-ID output as length-delimited binary records with an offset index beside each shard.

A shard `NAME.rec` is a run of frames

    length uint64 | masked crc32 of the length | payload | masked crc32 of the payload

and a payload is `doc_id int64 | flags uint8 | ids`, little-endian throughout. Flag 1: the id is null; flag 2:
ids are uint32, else uint16 (chosen by the vocabulary's size). `NAME.idx` holds a row INDEX for each record, so
that a reader fetches records in any order without a scan of the shard, and ends in the number of records, the
shard's bytes and a masked checksum of all before. Checksums are CRC-32 as of zlib, rotated and offset so that a
checksum stored inside checked data doesn't cancel out.

Tasks write shards to the shared folder under a name of their own for each attempt. The manifest, which Spark commits,
names one attempt of each shard with its sizes and the checksum of its index; files of other attempts are never
read. Any file system that pyarrow opens by URI will do.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import scratch_path, stored

MANIFEST = "shard long, path string, first_id long, n_records long, n_tokens long, n_bytes long, index_crc long"
INDEX = np.dtype([("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
#: Distinct words whose ids a worker keeps, in each of two generations.
CACHE_WORDS = 300_000
CACHE_CHARS = 64
#: Words of Latin letters, each of which is one code point in either case; and such a word with ASCII signs behind it, apostrophes
#: apart, which are cut from it and are tokens of their own.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_SIGNED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@[-`{-~]+)").fullmatch


def masked(crc: int) -> int:
    """Rotation and offset of a checksum, as record files commonly store it."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(zlib.crc32(head)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, where the next frame begins); ValueError if a checksum doesn't fit or the data end early."""
    head = data[at : at + 8]
    if len(head) < 8 or masked(zlib.crc32(head)) != int.from_bytes(data[at + 8 : at + 12], "little"):
        raise ValueError(f"broken length at {at}")
    end = at + 12 + int.from_bytes(head, "little")
    payload = data[at + 12 : end]
    if end + 4 > len(data) or masked(zlib.crc32(payload)) != int.from_bytes(data[end : end + 4], "little"):
        raise ValueError(f"broken payload at {at}")
    return payload, end + 4


def index_bytes(rows: list[tuple], n_bytes: int) -> bytes:
    """An index file: rows INDEX, the number of records, the shard's bytes, and the checksum."""
    body = np.array(rows, INDEX).tobytes() + len(rows).to_bytes(8, "little") + n_bytes.to_bytes(8, "little")
    return body + masked(zlib.crc32(body)).to_bytes(4, "little")


def read_index(system: fs.FileSystem, name: str) -> tuple[np.ndarray, int, int]:
    """(rows, bytes of the shard, checksum) of an index file; ValueError if it or the shard's length isn't as written."""
    with system.open_input_stream(f"{name}.idx") as f:
        data = f.read()
    body, crc = data[:-4], int.from_bytes(data[-4:], "little")
    if len(data) < 20 or masked(zlib.crc32(body)) != crc or (len(body) - 16) % INDEX.itemsize:
        raise ValueError(f"{name}.idx is broken")
    index, n_bytes = np.frombuffer(body[:-16], INDEX), int.from_bytes(body[-8:], "little")
    ends = index["offset"] + index["length"]
    if len(index) != int.from_bytes(body[-16:-8], "little") or (index["offset"] != np.concatenate([[0], ends[:-1]])[: len(index)]).any():
        raise ValueError(f"{name}.idx doesn't list a whole shard")
    if (int(ends[-1]) if len(ends) else 0) != n_bytes or system.get_file_info(f"{name}.rec").size != n_bytes:
        raise ValueError(f"{name}.rec isn't as long as its index says")
    return index, n_bytes, crc


def record(frame_: bytes, row: np.void, name: str) -> tuple[int | None, np.ndarray]:
    """(id, token ids) of a record; ValueError if it isn't the one that the row of the index is about."""
    payload, end = unframe(frame_)
    flags, doc_id = payload[8], int.from_bytes(payload[:8], "little", signed=True)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9)
    if end != len(frame_) or doc_id != row["doc_id"] or (flags & 1) != row["is_null"] or len(ids) != row["n_tokens"]:
        raise ValueError(f"{name}: the index doesn't fit")
    return None if flags & 1 else doc_id, ids


class _Words(dict):
    """Ids of words, as bytes; a word that isn't there is encoded, and kept if it is short.

    Most unseen words are plain: Latin letters only. The tokenizer's pipeline does nothing to them but fold case
    and rename bytes, so they go to its merge model at once. That is proved for the file at hand on probe words;
    where it fails, every word takes the pipeline.
    """

    def __init__(self, tokenizer, kind: str, old: dict[str, bytes], plain: dict[int, str] | None = None):
        super().__init__({"": b""})
        self.tokenizer, self.kind, self.old = tokenizer, kind, old
        self.encode, self.merge = tokenizer.encode, tokenizer.model.tokenize
        self.plain = self._probed() if plain is None else plain

    def _probed(self) -> dict[int, str]:
        letters = [c for c in map(chr, range(256)) if _PLAIN(c)]
        try:
            names = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c.lower())[0][0] for c in letters}
            words = [a + b + c for a, b, c in zip(letters, letters[7:] + letters[:7], letters[31:] + letters[:31], strict=True)] + ["Encyclopaedia", "Überfluß"]
            same = all([x.id for x in self.merge(w.translate(names))] == self.encode(w, add_special_tokens=False).ids for w in words)
        except Exception:  # a tokenizer without these parts
            same = False
        return names if same else {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            if self.plain and (parts := _SIGNED(word)):
                ids = self[parts[1]] + self[parts[2]]
            elif self.plain and _PLAIN(word):
                ids = array(self.kind, [x.id for x in self.merge(word.translate(self.plain))]).tobytes()
            else:
                ids = array(self.kind, self.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids


class WordCachedEncoder:
    """Ids of whole texts by a tokenizers file, with the ids of short words kept between texts.

    The tokenizer has to fold case and drop white space, as that of the query does, so that no token crosses a
    blank; then a text's ids are those of its parts between blanks. Two generations bound the cache.
    """

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), {"<u2": "H", "<u4": "I"}[dtype]
        self.known = _Words(self.tokenizer, self.kind, {})

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
                continue
            if text.isascii() and "<|" not in text:  # a special token is matched before case is folded
                text = text.lower()
            yield b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))
            if len(self.known) > CACHE_WORDS:
                self.known.old = {}
                self.known = _Words(self.tokenizer, self.kind, self.known, self.known.plain)


_encoders: dict[tuple[str, int], tuple[WordCachedEncoder, str]] = {}


def _encoder(path: str, end_id: int | None) -> tuple[WordCachedEncoder, str]:
    """The encoder that this worker keeps from task to task, and the type of its ids."""
    key = path, end_id or 0
    if key not in _encoders:
        from tokenizers import Tokenizer

        wide = max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True), key[1] + 1) > 1 << 16
        _encoders[key] = WordCachedEncoder(path, "<u4" if wide else "<u2"), "<u4" if wide else "<u2"
    return _encoders[key]


def write_records(docs: DataFrame, tokenizer: str, end_id: int | None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending id order; returns the manifest, one row per shard.

    docs: id_col (long) and text_col (string); further columns are ignored. A null text counts as empty and
    yields a record with the end id alone. A null id is kept, flagged, and sorts first; repeated ids are
    written as often as they occur, in an order that their texts decide, so the same rows give the same files. No
    rows: no shard. Texts of any length are encoded whole; one record needs memory in proportion to its text.
    Ids that many rows share (null, say) are spread over shards by text, and equal rows by where they are read.
    Manifest: shard, path, first_id, n_records, n_tokens, n_bytes, index_crc; shards in the order of their number
    hold ids in ascending order.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.spark_partition_id())
    rows = rows.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        encoder, dtype = _encoder(tokenizer, end_id)
        wide = dtype == "<u4"
        tail = np.array([] if end_id is None else [end_id], dtype).tobytes()
        system, base = fs.FileSystem.from_uri(path)
        out, index, at, tokens, first = None, [], 0, 0, None
        name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids = batch.column(0)
            for doc_id, data in zip(ids.to_pylist(), encoder(batch.column(1).to_pylist()), strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out, first = system.open_output_stream(f"{base}/{name}.rec"), doc_id
                data += tail
                n = len(data) // (4 if wide else 2)
                framed = frame((doc_id or 0).to_bytes(8, "little", signed=True) + bytes([(doc_id is None) + 2 * wide]) + data)
                out.write(framed)
                index.append((doc_id or 0, doc_id is None, at, len(framed), n))
                at, tokens = at + len(framed), tokens + n
        if out is None:
            return
        out.close()
        listed = index_bytes(index, at)
        with system.open_output_stream(f"{base}/{name}.idx") as f:
            f.write(listed)
        row = (shard, f"{path}/{name}", first, len(index), tokens, at, int.from_bytes(listed[-4:], "little"))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], names=[c.split()[0] for c in MANIFEST.split(", ")])

    return stored(rows.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame, derive: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """Read shards back, checking every checksum, as (shard, doc_id, start, n_tokens, ids) by manifest row.

    start counts the ids of all records before, over all shards. ids is array<int>; with derive, a dict of
    column name to (long, int, string, binary or array<int>; function of a numpy array of ids), those columns stand in its place, so that long
    sequences need not leave the reading task. A broken frame raises ValueError, and so does an index or a shard that
    isn't the one that the manifest tells of, by numbers of records, tokens and bytes and by checksum.
    """
    spark = manifest.sparkSession
    spec = derive or {"ids": ("array<int>", lambda x: x.astype("<i4"))}
    # One row per shard, whose number is that of the write tasks; the running sum needs them in one order.
    totals = sorted(tuple(r) for r in manifest.select("shard", "path", "n_tokens", "n_records", "n_bytes", "index_crc").toLocalIterator())
    starts, at = [], 0
    for r in totals:
        starts.append((*r, at))
        at += r[2]
    shards = spark.createDataFrame(starts, "shard long, path string, n_tokens long, n_records long, n_bytes long, index_crc long, start long")
    if starts:
        shards = shards.repartition(len(starts))
    schema = "shard long, doc_id long, start long, n_tokens long, " + ", ".join(f"{k} {t}" for k, (t, _) in spec.items())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
        for batch in batches:
            for shard, path, n_tokens, n_records, n_bytes, index_crc, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                index, *told = read_index(system, name)
                if [len(index), int(index["n_tokens"].sum()), *told] != [n_records, n_tokens, n_bytes, index_crc]:
                    raise ValueError(f"{name} isn't the shard that the manifest tells of")
                with system.open_input_stream(f"{name}.rec") as f:
                    for a in range(0, len(index), 500):
                        rows = {k: [] for k in ("shard", "doc_id", "start", "n_tokens", *spec)}
                        for r in index[a : a + 500]:
                            doc_id, ids = record(f.read(int(r["length"])), r, name)
                            rows["shard"].append(shard)
                            rows["doc_id"].append(doc_id)
                            rows["start"].append(start)
                            rows["n_tokens"].append(len(ids))
                            for k, (_, fn) in spec.items():
                                rows[k].append(fn(ids))
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[spec.get(k, ("long",))[0]]) for k, v in rows.items()})

    return shards.mapInArrow(read, schema)


class ShuffledReader:
    """Records of one shard in any order, by its index: reader[i] is (doc_id, ids)."""

    def __init__(self, path: str):
        self.system, self.name = fs.FileSystem.from_uri(path)
        self.index, _, _ = read_index(self.system, self.name)
        self.file = self.system.open_input_file(f"{self.name}.rec")

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        r = self.index[i]
        self.file.seek(int(r["offset"]))
        return record(self.file.read(int(r["length"])), r, self.name)

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in np.random.default_rng(seed).permutation(len(self)):
            yield self[int(i)]
