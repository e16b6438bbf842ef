"""Sources of pages: files by kind, rasters in formats that need no library, and the tables that stand for the rest.

Rendering vector documents, decoding symbols, recognising text and drawing fonts need libraries that aren't part of
this package. Their results enter as tables (see attestra.plans.verify for the columns).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = "path string, page_no int, width int, height int, pixels binary, error string"
ENDINGS = {"pdf": (".pdf",), "tiff": (".tif", ".tiff")}


def kind_of(name: Column, mime: Column | None = None) -> Column:
    """pdf, tiff or image, by the ending of a name in any case or by the MIME type."""
    low, mime = F.lower(name), F.lower(F.lit("") if mime is None else F.coalesce(mime, F.lit("")))
    is_a = lambda kind: (F.coalesce(low, F.lit("")).rlike("(" + "|".join(re.escape(e) for e in ENDINGS[kind]) + ")$")) | mime.contains(kind)
    return F.when(is_a("pdf"), "pdf").when(is_a("tiff"), "tiff").otherwise("image")


def portable_map(data: bytes) -> list[np.ndarray]:
    """Pages of a binary PGM or PPM file, several in a row allowed; colour keeps the red channel."""
    pages, at = [], 0
    head = re.compile(rb"\s*P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
    while m := head.match(data, at):
        channels, w, h, most = 1 if m[1] == b"5" else 3, int(m[2]), int(m[3]), int(m[4])
        if most > 255:
            raise ValueError("16-bit maps aren't read")
        n = w * h * channels
        plane = np.frombuffer(data, np.uint8, n, m.end()).reshape(h, w, channels)[:, :, 0]
        pages.append((plane.astype(np.uint16) * 255 // most).astype(np.uint8) if most != 255 else plane.copy())
        at = m.end() + n
    if not pages:
        raise ValueError("not a portable map")
    return pages


def unpack_bits(data: bytes) -> bytes:
    """Run-length decoding by signed counts: copies of the next bytes, or repeats of one; -128 does nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n >= 0:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > -128:
            out += data[at + 1 : at + 2] * (1 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Dictionary decoding of codes of 9 to 12 bits, highest bit first; a code grows one entry before it has to."""
    clear, end = 256, 257
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    words, width, last = list(start), 9, b""
    out, held, bits = [], 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == end:
            break
        if code == clear:
            words, width, last = list(start), 9, b""
            continue
        if code > len(words) or (code == len(words) and not last):
            raise ValueError("a code that isn't there")
        word = words[code] if code < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return b"".join(out)


def tiff(data: bytes) -> list[np.ndarray | Exception]:
    """Pages of a TIFF in strips of 1 or 8 bits, plain, run-length, LZW or deflate compressed; what a page couldn't be
    read for stands in its place."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at, pages, seen = struct.unpack(order + "I", data[4:8])[0], [], set()
    while at and at not in seen:
        seen.add(at)
        try:
            tags, after = directory(data, at, order)
        except struct.error:
            break
        try:
            pages.append(_strips(data, tags))
        except Exception as x:
            pages.append(x)
        at = after
    return pages


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """(values by tag, place of the next directory or 0) of whole-number tags."""
    sizes, codes = {1: 1, 2: 1, 3: 2, 4: 4}, {1: "B", 2: "B", 3: "H", 4: "I"}
    (n,), tags = struct.unpack(order + "H", data[at : at + 2]), {}
    for e in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack(order + "HHI", data[e : e + 8])
        if kind in sizes:
            place = e + 8 if sizes[kind] * count <= 4 else struct.unpack(order + "I", data[e + 8 : e + 12])[0]
            tags[tag] = struct.unpack(f"{order}{count}{codes[kind]}", data[place : place + sizes[kind] * count])
    after = data[at + 2 + 12 * n : at + 6 + 12 * n]
    return tags, struct.unpack(order + "I", after)[0] if len(after) == 4 else 0


#: Numbers of compressions in the format.
_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def _strips(data: bytes, tags: dict) -> np.ndarray:
    w, h, bits, channels = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(277, (1,))[0]
    unpack, photometric = _UNPACK.get(tags.get(259, (1,))[0]), tags.get(262, (1,))[0]
    if unpack is None or bits not in (1, 8) or tags.get(284, (1,))[0] != 1:
        raise ValueError("compression, depth or planes aren't read")
    raw = b"".join(unpack(data[a : a + n]) for a, n in zip(tags[273], tags[279], strict=True))
    if bits == 1:
        wide = (w + 7) // 8
        rows = np.unpackbits(np.frombuffer(raw, np.uint8, wide * h).reshape(h, wide), axis=1)[:, :w] * 255
    else:
        rows = np.frombuffer(raw, np.uint8, w * h * channels).reshape(h, w, channels)
        if tags.get(317, (1,))[0] == 2:  # each sample is stored as its step from the one before
            rows = np.cumsum(rows, axis=1, dtype=np.uint8)
        if photometric == 3:
            rows = (np.array(tags[320][: 1 << bits]) >> 8).astype(np.uint8)[rows]
        rows = rows[:, :, 0]
    return (255 - rows if photometric == 0 else rows).astype(np.uint8)


def png(data: bytes) -> np.ndarray:
    """The red channel of a PNG on white, turned as its EXIF block says; interlaced ones aren't read."""
    at, found = 8, {}
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a broken part")
        found.setdefault(kind, []).append(body)
        at += 12 + n
    if b"IHDR" not in found or b"IDAT" not in found:
        raise ValueError("not a whole PNG")
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", found[b"IHDR"][0])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if interlaced or channels is None:
        raise ValueError("interlaced or unknown colours")
    wide, step = (w * channels * depth + 7) // 8, max(1, channels * depth // 8)
    lines = np.frombuffer(zlib.decompress(b"".join(found[b"IDAT"])), np.uint8, h * (wide + 1)).reshape(h, wide + 1)
    raw, above = np.zeros((h, wide), np.uint8), np.zeros(wide, np.uint8)
    for y in range(h):
        above = raw[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 16:
        raw, depth = raw[:, ::2], 8
    if depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(h, -1, depth)
        raw = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
    px = raw[:, : w * channels].reshape(h, w, channels)
    if colour == 3:
        palette = np.frombuffer(found[b"PLTE"][0], np.uint8).reshape(-1, 3)[:, 0]
        alpha = np.full(len(palette), 255, np.uint8)
        some = np.frombuffer(b"".join(found.get(b"tRNS", [])), np.uint8)
        alpha[: len(some)] = some
        red, alpha = palette[px[:, :, 0]], alpha[px[:, :, 0]]
    else:
        red = px[:, :, 0].astype(int) * 255 // ((1 << depth) - 1)
        alpha = px[:, :, -1] if channels in (2, 4) else np.full((h, w), 255)
    out = np.floor(red.astype(float) * alpha / 255 + 255 - alpha.astype(float) + 0.5).astype(np.uint8)
    return turned(out, _orientation(found[b"eXIf"][0]) if b"eXIf" in found else 1)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of a PNG from its filtered bytes and the line above."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out, up = [0] * step + line.tolist(), [0] * step + above.tolist()
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if kind == 1:
            more = a
        elif kind == 3:
            more = (a + b) // 2
        else:
            _, _, more = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
        out[i] = (out[i] + more) & 255
    return np.array(out[step:], np.uint8)


def _orientation(exif: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    try:
        return directory(exif, struct.unpack(order + "I", exif[4:8])[0], order)[0].get(274, (1,))[0] if order else 1
    except struct.error:
        return 1


def orientation(data: bytes) -> int:
    """The orientation (1 to 8) that the EXIF part of a JPEG's header tells; 1 if it tells none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _orientation(data[at + 10 : at + 2 + n])
        at += 2 + n
    return 1


def turned(raster: np.ndarray, how: int) -> np.ndarray:
    """A raster as it is to be seen, of one stored in orientation `how`."""
    out = raster.T if how in (5, 6, 7, 8) else raster
    out = out[:, ::-1] if how in (2, 3, 6, 7) else out
    return np.ascontiguousarray(out[::-1] if how in (3, 4, 7, 8) else out)


def _pages(data: bytes) -> list[np.ndarray | Exception]:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return [png(data)]
    if data[:2] == b"\xff\xd8":
        raise ValueError(f"JPEG isn't decoded (orientation {orientation(data)})")
    return portable_map(data) if data[:1] == b"P" else tiff(data)


def read_pages(files: DataFrame) -> DataFrame:
    """Pages of files (path, content), as PAGE_SCHEMA; grey, one byte a pixel.

    A page that can't be read is a row with its error, as is a file of another format (page 0) or without pages; the
    other pages stay. Null contents count as empty files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content) if content is not None else b""
                try:
                    pages = _pages(data)
                    rows += [(path, i + 1, p.shape[1], p.shape[0], p.tobytes(), None) if isinstance(p, np.ndarray) else (path, i + 1, None, None, None, str(p)) for i, p in enumerate(pages)]
                    if not pages:
                        raise ValueError("no pages")
                except (ValueError, KeyError, struct.error, zlib.error) as x:
                    rows.append((path, 0, None, None, None, str(x)))
            out = pd.DataFrame(rows, columns=["path", "page_no", "width", "height", "pixels", "error"])
            yield out.astype({"page_no": "Int32", "width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, length, content) of files; Spark prunes the content where it isn't asked for."""
    return spark.read.format("binaryFile").load(path).select("path", kind_of(F.col("path")).alias("kind"), "length", "content")


def segment(crops: DataFrame, key: list[str]) -> DataFrame:
    """(key, x, y, w, h, v) of the glyphs of crops (key, width, height, pixels)."""
    from attestra.functions.pixels import glyphs

    schema = crops.select(*key).schema
    for name in ("x", "y", "w", "h"):
        schema = schema.add(name, T.IntegerType())
    schema = schema.add("v", T.ArrayType(T.FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                raster = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width))
                rows += [(*(getattr(r, k) for k in key), *g[:4], g[4].tolist()) for g in glyphs(raster)]
            yield pd.DataFrame(rows, columns=[*key, "x", "y", "w", "h", "v"])

    return crops.where("pixels is not null").select(*key, "width", "height", "pixels").mapInPandas(run, schema)
