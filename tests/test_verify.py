import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import regions
from attestra.plans.verify import verify
from attestra.sources import rasters, small
from attestra.streaming import results

CHARS = "0123456789"


def vectors():
    rng = np.random.default_rng(8)
    v = rng.random((len(CHARS), 576)).astype(np.float32) - 0.5
    return v / np.linalg.norm(v, axis=1)[:, None]


def document(spark, texts, doc="d", expect=None):
    """Tables of a page with one linear symbol above each text, in a column; texts: (value, printed, second reading)."""
    v = vectors()
    obs, glyphs, reads = [], [], []
    for i, (value, printed, again) in enumerate(texts):
        x, y = 500.0, 300.0 + 400 * i
        obs.append((doc, 1, i, "Code128", value, [(x, y), (x + 200, y), (x + 200, y + 80), (x, y + 80)]))
        for res, k in (("lo", 1), ("hi", 2)):
            for j, c in enumerate(printed):
                # The crop begins at 1.5 widths to the left of the symbol.
                glyphs.append((doc, 1, i, res, "below", (300 + 14 * j) * k, 10 * k, 10 * k, 20 * k, v[CHARS.index(c)].tolist()))
            reads.append((doc, 1, i, res, "below", 0, printed if res == "lo" else again, 0.95))
    t = {
        "document": spark.createDataFrame([(doc, expect)], "doc_id string, expect_total int"),
        "page": spark.createDataFrame([(doc, 1, 1600, 2400, True)], "doc_id string, page_no int, width int, height int, rerenderable boolean"),
        "barcode_obs": spark.createDataFrame(obs, "doc_id string, page_no int, seq int, fmt string, text string, corners array<struct<x: double, y: double>>"),
        "path": spark.createDataFrame([], "doc_id string, page_no int, paint string, x0 double, y0 double, x1 double, y1 double"),
        "glyph": spark.createDataFrame(glyphs, "doc_id string, page_no int, seq int, res string, side string, x int, y int, w int, h int, v array<float>"),
        "read": spark.createDataFrame(reads, "doc_id string, page_no int, seq int, res string, side string, line_no int, raw string, score double"),
        "pdf_word": spark.createDataFrame([], "doc_id string, page_no int, x double, y double, w double, h double, s string"),
    }
    own = [("Arial", b, c, v[i].tolist()) for b in (20, 40) for i, c in enumerate(CHARS)]
    noise = np.random.default_rng(9).random((len(CHARS), 576))
    other = [("Calibri", b, c, (noise[i] / np.linalg.norm(noise[i])).astype(float).tolist()) for b in (20, 40) for i, c in enumerate(CHARS)]
    t["template"] = spark.createDataFrame(own + other, "font string, h_bucket int, ch string, v array<float>")
    t["char_metric"] = spark.createDataFrame([(f, c, 1.0, False) for f in ("Arial", "Calibri") for c in CHARS], "font string, ch string, rel double, descends boolean")
    return t


def test_verdicts_of_a_document(spark):
    t = document(spark, [("1234", "1234", "1234"), ("12 35", "1234", "1234"), ("1243", "1243", "1234"), ("5678", "5678", "5678"), ("99", "999", "999")], expect=6)
    out = verify(t)
    got = {r.seq: r for r in out["rows"].collect()}
    assert [(got[i].verdict, got[i].reason_code) for i in range(4)] == [("OK", "match"), ("NG", "differs-from-value"), ("CHECK", "readings-differ"), ("OK", "match")]
    assert got[0].template == "1234" and got[0].tpl_font == "Arial" and got[0].template_note.kind == "match" and got[1].wrong == [3]
    # Three glyphs for two characters: the template isn't read, so there is no OK.
    assert got[4].verdict == "CHECK" and got[4].template is None
    assert {c.check for c in got[0].checks} >= {"readings", "template", "filled"}
    w = [(r.code, r.found, r.wanted) for r in out["warnings"].collect()]
    assert w == [("total-differs", 5, "6")]
    s = out["summary"].first()
    assert (s.n, s.ng, s.chk, s.level) == (5, 1, 2, "bad")


def test_text_layer_frames_and_missing_fonts(spark):
    t = document(spark, [("1234", "1234", "1234"), ("5678", "5678", "5678")], expect=2)
    k = 400 / 72
    t["path"] = spark.createDataFrame([("d", 1, "stroke", 100.0, 200.0, 100 + 125 * k, 200 + 65 * k), ("d", 1, "stroke", 900.0, 200.0, 900 + 126 * k, 200 + 65 * k)], t["path"].schema)
    t["pdf_word"] = spark.createDataFrame([("d", 1, 510.0, 390.0, 60.0, 20.0, "9999")], t["pdf_word"].schema)
    out = verify(t)
    got = {r.seq: r for r in out["rows"].collect()}
    assert got[0].reason_code == "text-layer" and got[1].verdict == "OK" and got[1].pdf_text is None
    assert {(r.code, r.label, r.found) for r in out["warnings"].collect()} == {("count-differs", 2, 0)}
    t = document(spark, [("1234", "1234", "1234")], expect=1)
    t["template"] = t["template"].where("font = 'Arial'")
    out = verify(t)
    r = out["rows"].first()
    assert r.verdict == "CHECK" and r.why == "font-missing" and [w.wanted for w in out["warnings"].collect()] == ["Calibri"]


def test_an_enlarged_raster_fills_nothing(spark):
    t = document(spark, [("12", "12", "12")])
    blurred = F.when((F.col("res") == "lo") & (F.col("x") < 305), F.array_repeat(F.lit(0.0416667).cast("float"), 576)).otherwise(F.col("v"))
    t["glyph"] = t["glyph"].withColumn("v", blurred)
    wide = verify(t)["rows"].first()
    t["page"] = t["page"].withColumn("rerenderable", F.lit(False))
    raster = verify(t)["rows"].first()
    assert "?" in raster.template and raster.verdict == "CHECK" and any(c.check == "evidence" for c in raster.checks)
    assert wide.filled[0] == 0 and wide.template == "12"


def pgm(a):
    return b"P5\n# made here\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def tiff(pages):
    out, at = b"II*\x00", 4
    body = [b""]
    offset = 8
    chunks = []
    for i, (a, compression) in enumerate(pages):
        tags = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 8), (259, 3, compression), (262, 3, 1), (273, 4, offset), (277, 3, 1), (279, 4, a.size)]
        ifd = offset + a.size
        nxt = ifd + 2 + 12 * len(tags) + 4 if i + 1 < len(pages) else 0
        after = nxt + pages[i + 1][0].size if nxt else 0
        chunks.append(a.tobytes() + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", after))
        offset = nxt
    del out, at, body
    return b"II*\x00" + struct.pack("<I", 8 + pages[0][0].size) + b"".join(chunks)


def test_rasters(spark):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    files = spark.createDataFrame([("a.pgm", bytearray(pgm(a) + pgm(a[:2]))), ("b.tif", bytearray(tiff([(a, 1), (a, 5)]))), ("c", bytearray(b"junk")), ("d", None)], "path string, content binary")
    got = {(r.path, r.page_no): r for r in rasters.read_pages(files).collect()}
    assert (got["a.pgm", 1].width, got["a.pgm", 2].height, bytes(got["b.tif", 1].pixels)) == (4, 2, a.tobytes())
    assert got["b.tif", 2].error and got["c", 0].error and got["d", 0].error and len(got) == 6
    r = spark.range(1).select(*(rasters.kind_of(F.lit(n), F.lit(m)).alias(f"c{i}") for i, (n, m) in enumerate([("A.PDF", ""), ("x", "application/pdf"), ("x.TIFF", None), ("y.png", "")]))).first()
    assert tuple(r) == ("pdf", "pdf", "tiff", "image")


def packed_lzw(data):
    """Codes of a plain encoder, as the format has them."""
    words, out, last = {bytes([i]): i for i in range(256)}, [(256, 9)], b""
    n = 258

    def width():
        return min(12, max(9, n.bit_length()))

    for c in data:
        word = last + bytes([c])
        if word in words:
            last = word
            continue
        out.append((words[last], width()))
        words[word], n, last = n, n + 1, bytes([c])
        if n >= 4094:
            out.append((256, width()))
            words, n = {bytes([i]): i for i in range(256)}, 258
    out += [(words[last], width()), (257, width())] if last else [(257, width())]
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_compressions():
    rng = np.random.default_rng(2)
    for n in (0, 1, 300, 20000):
        data = bytes(rng.integers(0, 3, n, dtype=np.uint8))
        assert rasters.unpack_lzw(packed_lzw(data)) == data
    assert rasters.unpack_bits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])
    a = rng.integers(0, 255, (5, 7), dtype=np.uint8)
    step = np.diff(a, axis=1, prepend=0).astype(np.uint8)
    for number, pack in ((5, packed_lzw), (8, zlib.compress), (32946, zlib.compress), (32773, lambda d: b"".join(bytes([len(d[i : i + 9]) - 1]) + d[i : i + 9] for i in range(0, len(d), 9)))):
        for predictor, rows in ((1, a), (2, step)):
            body = pack(rows.tobytes())
            tags = [(256, 7), (257, 5), (258, 8), (259, number), (262, 1), (273, 8), (277, 1), (279, len(body)), (317, predictor)]
            at = 8 + len(body)
            data = b"II*\x00" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
            assert (rasters.tiff(data)[0] == a).all()


def png(a, colour, depth, filters, more=()):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, channels = a.shape
    raw = a.reshape(h, -1) if depth == 8 else np.stack([np.packbits(np.unpackbits(r.reshape(-1, 1), axis=1)[:, -depth:].reshape(-1)) for r in a.reshape(h, -1)])
    step, lines, above = max(1, channels * depth // 8), [], np.zeros(raw.shape[1], int)
    for y, line in enumerate(raw.astype(int)):
        kind = filters[y % len(filters)]
        left, corner = np.concatenate([[0] * step, line[:-step]]), np.concatenate([[0] * step, above[:-step]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        less = [0, left, above, (left + above) // 2, near][kind]
        lines.append(bytes([kind]) + ((line - less) % 256).astype(np.uint8).tobytes())
        above = line
    parts = [part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)), *(part(*m) for m in more), part(b"IDAT", zlib.compress(b"".join(lines))), part(b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts)


def exif(how):
    return b"MM\x00*" + struct.pack(">IHHHIHHI", 8, 1, 274, 3, 1, how, 0, 0)


def test_images(spark):
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (rasters.png(png(rgb, 2, 8, [0, 1, 2, 3, 4])) == rgb[:, :, 0]).all()
    rgba = np.concatenate([rgb, rng.integers(0, 256, (6, 5, 1), dtype=np.uint8)], axis=2)
    alpha = rgba[:, :, 3].astype(float)
    assert (rasters.png(png(rgba, 6, 8, [4])) == np.floor(rgb[:, :, 0] * alpha / 255 + 255 - alpha + 0.5)).all()
    bits = rng.integers(0, 2, (4, 11, 1), dtype=np.uint8)
    assert (rasters.png(png(bits, 0, 1, [0, 2])) == bits[:, :, 0] * 255).all()
    palette = (b"PLTE", bytes([9, 0, 0, 200, 0, 0]))
    assert (rasters.png(png(bits, 3, 1, [0], [palette])) == np.where(bits[:, :, 0] == 1, 200, 9)).all()
    a = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    for how, want in ((1, [[0, 1, 2], [3, 4, 5]]), (3, [[5, 4, 3], [2, 1, 0]]), (6, [[3, 0], [4, 1], [5, 2]]), (8, [[2, 5], [1, 4], [0, 3]]), (2, [[2, 1, 0], [5, 4, 3]]), (4, [[3, 4, 5], [0, 1, 2]]), (5, [[0, 3], [1, 4], [2, 5]]), (7, [[5, 2], [4, 1], [3, 0]])):
        assert rasters.png(png(a, 0, 8, [0], [(b"eXIf", exif(how))])).tolist() == want
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", 8 + len(exif(6))) + b"Exif\0\0" + exif(6) + b"\xff\xda"
    assert rasters.orientation(jpeg) == 6 and rasters.orientation(b"\xff\xd8\xff\xda") == 1 and rasters.orientation(b"") == 1
    files = spark.createDataFrame([("a.png", bytearray(png(rgb, 2, 8, [1]))), ("b.png", bytearray(png(rgb, 2, 8, [1])[:-30])), ("c.jpg", bytearray(jpeg))], "path string, content binary")
    got = {r.path: r for r in rasters.read_pages(files).collect()}
    assert (got["a.png"].width, got["a.png"].height) == (5, 6) and got["b.png"].error and "orientation 6" in got["c.jpg"].error


def test_drawn_paths(spark):
    view = [1.0, 0.0, 0.0, -1.0, 0.0, 1000.0]
    ops = [("save", []), ("transform", [0.0, 1.0, -1.0, 0.0, 500.0, 0.0]), ("path", [10.0, 20.0, 110.0, 70.0]), ("closeStroke", []), ("stroke", []), ("restore", []), ("restore", []), ("path", [0.0, 0.0, 5.0, 5.0]), ("fill", []), ("stroke", []), ("path", [1.0, 1.0, 2.0, 2.0]), ("beginForm", None), ("eoFillStroke", []), ("endForm", []), ("path", [1.0]), ("stroke", [])]
    rows = [("d", 1, i, op, a, view) for i, (op, a) in enumerate(ops)] + [("d", 2, 0, "transform", [1.0], view), ("d", 2, 1, "path", [0.0, 0.0, 9.0, 9.0], view), ("d", 2, 2, "stroke", [], view)]
    got = regions.paths_of_draws(spark.createDataFrame(rows, "doc_id string, page_no int, n int, op string, args array<double>, view array<double>")).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(1, "stroke", 1.0, 998.0, 2.0, 999.0), (1, "stroke", 430.0, 890.0, 480.0, 990.0)]


def test_segmented_crops(spark):
    page = np.full((60, 120), 255, np.uint8)
    page[20:40, 10:18] = 0
    page[20:40, 40:48] = 0
    g = rasters.segment(spark.createDataFrame([("d", 120, 60, bytearray(page.tobytes())), ("e", None, None, None)], "k string, width int, height int, pixels binary"), ["k"]).collect()
    assert [(r.k, r.x, r.h, len(r.v)) for r in g] == [("d", 10, 20, 576), ("d", 40, 20, 576)]


def test_small_sources_and_sinks(spark, tmp_path):
    (tmp_path / "keys.txt").write_bytes("一\r\nb".encode())
    assert [(r.idx, r.ch) for r in small.dictionary(spark, str(tmp_path / "keys.txt")).orderBy("idx").collect()] == [(0, ""), (1, "一"), (2, "b"), (3, " ")]
    log = small.change_log(spark, [("2024-05-01-2", [("fix", "x")]), ("2024-05-01-10", []), ("2024-04-30", [])])
    assert [r.version for r in log.collect()] == ["2024-05-01-10", "2024-05-01-2", "2024-04-30"]
    assert small.unseen(log, ("2024-05-01", 2)).count() == 1 and small.unseen(log, None).count() == 3
    df = spark.createDataFrame([("a<b", 1)], "s string, n int")
    for kind in ("parquet", "json", "tsv"):
        small.write_results(df, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).first().s == "a<b" and spark.read.parquet(str(tmp_path / "parquet")).first().n == 1
    assert small.html_report(df, ["s", "n"]).first().html == "<tr><td>a&lt;b</td><td>1</td></tr>"
    r = spark.range(1).select(*(small.stale(F.lit(a).cast("int"), F.lit(b).cast("int")).alias(f"c{i}") for i, (a, b) in enumerate([(None, 0), (3, 3), (3, None), (2, 3)]))).first()
    assert tuple(r) == (False, False, True, True)


@pytest.mark.parametrize("name", ["windows", "complete"])
def test_streams(spark, tmp_path, name):
    rows = [("d", "OK", 0, 2), ("e", "NG", 1, 1), ("d", "OK", 700, 2), ("f", "OK", 5, 9)]
    for i, (d, v, s, n) in enumerate(rows):
        df = spark.createDataFrame([(d, v, n)], "doc_id string, verdict string, expect_total long").withColumn("at", F.timestamp_seconds(F.lit(s)))
        df.write.mode("append").json(str(tmp_path / f"in{i}"))
    stream = results.verdict_stream(spark, str(tmp_path / "in*"))
    out = results.by_window(stream) if name == "windows" else results.when_complete(stream)
    q = out.writeStream.outputMode("complete" if name == "windows" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table(name).collect()}
    if name == "windows":
        assert {(r[2], r[3]) for r in got} == {("OK", 2), ("OK", 1), ("NG", 1)}
    else:
        assert got == {("d", 2, 0, 0, "ok"), ("e", 1, 1, 0, "bad")}


@pytest.mark.parametrize("wait", [86_400, None])
def test_documents_that_stay_incomplete(spark, tmp_path, wait):
    rows = [("late", "OK", 3, 5), ("two", "OK", None, 10), ("two", "OK", 2, 20), ("two", None, None, 30), ("one", "OK", 1, 40), (None, "OK", 1, 50), ("clock", "CHECK", 9, 400_000)]
    for i, (d, v, n, s) in enumerate(rows):
        df = spark.createDataFrame([(d, v, n)], "doc_id string, verdict string, expect_total long").withColumn("at", F.timestamp_seconds(F.lit(s)))
        df.coalesce(1).write.json(str(tmp_path / f"in{i}"))
    stream, name = results.when_complete(results.verdict_stream(spark, str(tmp_path / "in*")), wait), f"ended_{wait}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    ended = {("late", 1, 0, 0, "bad")} if wait else set()
    assert {tuple(r) for r in spark.table(name).collect()} == {("two", 3, 0, 1, "bad"), ("one", 1, 0, 0, "ok")} | ended
