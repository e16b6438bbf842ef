"""Raster functions in numpy, for use inside Arrow functions. A raster is an array of bytes, high by wide."""

from __future__ import annotations

import numpy as np

from attestra import constants as K

EDGE = K.DESCRIPTOR_EDGE


def grey(rgb: np.ndarray) -> np.ndarray:
    """The red channel; a raster of one channel as it is."""
    return rgb if rgb.ndim == 2 else rgb[:, :, 0]


def ink(rgb: np.ndarray) -> np.ndarray:
    """Whether a pixel is dark by luma."""
    luma = rgb.astype(float) if rgb.ndim == 2 else rgb[:, :, :3].astype(float) @ np.array([0.299, 0.587, 0.114])
    return luma < 160


def threshold(g: np.ndarray) -> int:
    """The level that separates the histogram with most variance between classes, the lowest at ties; 0 for one level."""
    h = np.bincount(g.reshape(-1), minlength=256).astype(float)
    below, value = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        v = below * above * (value / below - (value[-1] - value) / above) ** 2
    v = np.where((below > 0) & (above > 0), v, -1)
    return int(v.argmax()) if v.max() >= 0 else 0


def binarize(g: np.ndarray) -> np.ndarray:
    """255 for letters, 0 for ground."""
    return np.where(g > threshold(g), 0, 255).astype(np.uint8)


def components(bw: np.ndarray) -> np.ndarray:
    """Rows x, y, w, h, area of the 8-connected parts, in the order of their first pixel by rows.

    Runs of a row are found at once and joined to those of the row above by union-find.
    """
    on = np.pad(bw > 0, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(on, axis=1)
    ys, xs = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    n = len(ys)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    row = np.searchsorted(ys, np.arange(bw.shape[0] + 1))
    for y in range(1, bw.shape[0]):
        a, b = row[y - 1], row[y]
        while a < row[y] and b < row[y + 1]:
            if xs[a] <= ends[b] and xs[b] <= ends[a]:
                i, j = root(a), root(b)
                parent[max(i, j)] = min(i, j)
            if ends[a] < ends[b]:
                a += 1
            else:
                b += 1
    if not n:
        return np.zeros((0, 5), int)
    names, of = np.unique([root(i) for i in range(n)], return_inverse=True)
    m = len(names)
    x0, x1, y0, y1 = np.full(m, bw.shape[1]), np.zeros(m, int), np.full(m, bw.shape[0]), np.zeros(m, int)
    np.minimum.at(x0, of, xs)
    np.maximum.at(x1, of, ends)
    np.minimum.at(y0, of, ys)
    np.maximum.at(y1, of, ys)
    return np.stack([x0, y0, x1 - x0, y1 - y0 + 1, np.bincount(of, weights=ends - xs).astype(int)], axis=1)


def _shares(n: int, m: int) -> np.ndarray:
    """How much of each of n source cells each of m target cells covers, rows summing to 1."""
    edges = np.arange(m + 1) * (n / m)
    cells = np.arange(n)
    cover = np.clip(np.minimum(cells + 1, edges[1:, None]) - np.maximum(cells, edges[:-1, None]), 0, None)
    total = cover.sum(1, keepdims=True)
    return np.divide(cover, total, out=np.zeros_like(cover), where=total > 0)


def area_resize(src: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Area-weighted mean; the nearest source pixel if both sides grow."""
    h, w = src.shape
    if h < high and w < wide:
        return src[np.minimum(h - 1, (np.arange(high) * (h / high)).astype(int))][:, np.minimum(w - 1, (np.arange(wide) * (w / wide)).astype(int))].astype(np.float32)
    return (_shares(h, high) @ src.astype(float) @ _shares(w, wide).T).astype(np.float32)


def descriptor(plane: np.ndarray) -> np.ndarray | None:
    """Unit vector of a glyph put in the middle of a square and scaled to 24 by 24; None if it is blank."""
    h, w = plane.shape
    side = max(h, w)
    square = np.zeros((side, side), np.float32)
    top, left = (side - h) >> 1, (side - w) >> 1
    square[top : top + h, left : left + w] = plane
    v = area_resize(square, EDGE, EDGE).reshape(-1)
    length = np.sqrt((v.astype(float) ** 2).sum())
    return None if length < 1e-6 else (v / length).astype(np.float32)


def glyphs(raster: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(x, y, w, h, vector) of the glyphs of a crop, from the left.

    Parts of a size that no letter has go first; then those whose height departs from the height that most parts
    share, the first of equally common ones.
    """
    bw = binarize(grey(raster))
    high, wide = bw.shape
    c = components(bw)
    x, y, w, h, area = c.T
    c = c[(h <= 0.85 * high) & (w <= 0.4 * wide) & (w <= 3 * h) & (h >= 3) & (area >= 12)]
    if not len(c):
        return []
    h = c[:, 3]
    peers = ((h[None, :] >= 0.8 * h[:, None]) & (h[None, :] <= 1.25 * h[:, None])).sum(1)
    base = h[peers.argmax()]
    c = c[(h >= 0.55 * base) & (h <= 1.8 * base) & (c[:, 2] <= 2.5 * base)]
    found = [(int(x), int(y), int(w), int(h), descriptor(bw[y : y + h, x : x + w])) for x, y, w, h, _ in c]
    return sorted((g for g in found if g[4] is not None), key=lambda g: g[0])


def ink_sums(raster: np.ndarray) -> np.ndarray:
    """Sums of ink over all rectangles from the origin."""
    dark = ink(raster)
    out = np.zeros((dark.shape[0] + 1, dark.shape[1] + 1), np.int64)
    out[1:, 1:] = dark.cumsum(0).cumsum(1)
    return out


def ink_inside(sums: np.ndarray, b: list[float]) -> int:
    """Dark pixels that a box touches, inside the page."""
    high, wide = sums.shape[0] - 1, sums.shape[1] - 1
    x0, y0 = max(0, int(np.floor(b[0]))), max(0, int(np.floor(b[1])))
    x1, y1 = min(wide, int(np.ceil(b[2]))), min(high, int(np.ceil(b[3])))
    return 0 if x1 <= x0 or y1 <= y0 else int(sums[y1, x1] - sums[y0, x1] - sums[y1, x0] + sums[y0, x0])


def crop(raster: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """Pixels from the truncated corner on, as many as the truncated extent, one at least."""
    x, y = int(x0), int(y0)
    return raster[y : y + max(1, int(y1 - y0)), x : x + max(1, int(x1 - x0))]


def upright(raster: np.ndarray, angle: float) -> np.ndarray:
    """A crop turned so that its symbol's axis runs from left to right; angle is a multiple of 90."""
    return np.rot90(raster, (int(np.floor(angle + 0.5)) % 360) // 90)


def enlarge(raster: np.ndarray, least: int = K.RASTER_WIDTH) -> np.ndarray:
    """A raster of at least so many columns, by linear interpolation between pixel centres."""
    h, w = raster.shape[:2]
    if w >= least:
        return raster
    f = least / w
    out = raster.astype(float)
    for axis, n in ((0, h), (1, w)):
        at = np.clip((np.arange(int(np.floor(n * f + 0.5))) + 0.5) / f - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, n - 1), axis) * part
    return np.floor(out + 0.5).astype(np.uint8)


def tight(raster: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The crop around glyph boxes x, y, w, h with a margin of 0.28 upper median heights; unchanged without boxes."""
    if not boxes:
        return raster
    b = np.array(boxes)
    m = int(np.floor(0.28 * sorted(b[:, 3])[len(b) // 2] + 0.5))
    high, wide = raster.shape[:2]
    x0, y0 = max(0, b[:, 0].min() - m), max(0, b[:, 1].min() - m)
    x1, y1 = min(wide, (b[:, 0] + b[:, 2]).max() + m), min(high, (b[:, 1] + b[:, 3]).max() + m)
    return raster[y0:y1, x0:x1]


def side_by_side(raster: np.ndarray, lines: list[list[tuple[int, int, int, int]]]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The lines of a block cut out and put in one row on white, and the glyph boxes there."""
    heights = sorted(b[3] for line in lines for b in line)
    middle = heights[len(heights) // 2]
    pad, gap = int(np.floor(0.3 * middle + 0.5)), int(np.floor(0.9 * middle + 0.5))
    high, wide = raster.shape[:2]
    parts = []
    for line in lines:
        b = np.array(line)
        parts.append((max(0, b[:, 0].min() - pad), max(0, b[:, 1].min() - pad), min(wide, (b[:, 0] + b[:, 2]).max() + pad), min(high, (b[:, 1] + b[:, 3]).max() + pad)))
    tall = max(p[3] - p[1] for p in parts)
    out = np.full((tall, sum(p[2] - p[0] for p in parts) + gap * (len(parts) - 1)), 255, np.uint8)
    at, boxes = 0, []
    for (x0, y0, x1, y1), line in zip(parts, lines, strict=True):
        down = int(np.floor((tall - (y1 - y0)) / 2 + 0.5))
        out[down : down + y1 - y0, at : at + x1 - x0] = grey(raster)[y0:y1, x0:x1]
        boxes += [(x - x0 + at, y - y0 + down, w, h) for x, y, w, h in line]
        at += x1 - x0 + gap
    return out, boxes


def reading_input(raster: np.ndarray) -> np.ndarray:
    """A crop as input of a text recogniser: three equal planes of height 48, scaled to -1..1."""
    h, w = raster.shape[:2]
    low, most = K.READ_WIDTHS
    width = int(min(most, max(low, np.floor(K.READ_HEIGHT * w / h + 0.5))))
    plane = area_resize(grey(raster), K.READ_HEIGHT, width) if h >= K.READ_HEIGHT or w >= width else grey(raster)[(np.arange(K.READ_HEIGHT) * h // K.READ_HEIGHT)][:, (np.arange(width) * w // width)]
    return np.repeat(((plane.astype(np.float32) / 255 - 0.5) / 0.5)[None, None], 3, axis=1)
