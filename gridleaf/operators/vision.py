"""Pixel operators as Arrow batches: features of patches, image statistics, OCR preprocessing.

All are plain numpy, exact where the formula is (densities, gray levels, thresholds,
histogram equalisation, Laplacian); edges, contours and lines are approximations of
what a vision library computes, kept behind the same feature names. Rasters are rows
(page_id, height, width, channels, data) with row-major bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boxes import merge_detections, reading_order


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return px[:, :, 0]
    return np.rint(px[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int, padding: int = 2) -> np.ndarray:
    """The box and its padding, clamped to the image."""
    return image[max(0, y - padding) : min(image.shape[0], y + h + padding), max(0, x - padding) : min(image.shape[1], x + w + padding)]


def density(patch: np.ndarray, limit: int = 127) -> dict[str, float]:
    if not patch.size:
        return {"dark_ratio": 0.0, "light_ratio": 0.0, "mean_intensity": 0.0, "std_intensity": 0.0}
    dark = float((patch < limit).mean())
    return {"dark_ratio": dark, "light_ratio": 1 - dark, "mean_intensity": float(patch.mean()), "std_intensity": float(patch.std())}


def edges(patch: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Gradient magnitudes over high, and those over low that touch them."""
    if min(patch.shape, default=0) < 3:
        return np.zeros(patch.shape, bool)
    p = np.pad(patch.astype(np.int64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    m = np.abs(gx) + np.abs(gy)
    strong, weak = m > high, m > low
    while True:
        s = np.pad(strong, 1)
        near = np.any([s[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0) & weak
        if (near == strong).all():
            return strong
        strong = near


def labels(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask's rows with their 8-connected part: (row, first column, column after, part), parts from 0 in reading order."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n = len(row)
    up = np.arange(n)
    # runs of the row above that touch: from the first that ends at start or later to the last that starts at end or before
    width = mask.shape[1] + 2 if mask.ndim == 2 else 2
    lo = np.searchsorted(row * width + end, (row - 1) * width + start)
    hi = np.searchsorted(row * width + start, (row - 1) * width + end, "right")
    count = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), count)
    b = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    while len(a):  # link roots, the greater to the less, and halve the paths until no link is left
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
        left = up[a] != up[b]
        a, b = a[left], b[left]
    return row, start, end, np.unique(up, return_inverse=True)[1] if n else up


def components(mask: np.ndarray) -> list[int]:
    """Sizes of the 8-connected parts of a mask, largest first."""
    _, start, end, part = labels(mask)
    return sorted(np.bincount(part, end - start).astype(int).tolist(), reverse=True) if len(part) else []


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (x, y) points, in order around it."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered: list) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ordered = points.tolist()
    return np.array(half(ordered) + half(ordered[::-1]))


def polygon_area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0], corners[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def vertices(corners: np.ndarray, tolerance: float = 0.02) -> int:
    """Corners left when those nearer to the line of their neighbours than the tolerance (of the way around) go, nearest first."""
    around = float(np.hypot(*(np.roll(corners, -1, 0) - corners).T).sum())
    left = [tuple(c) for c in corners.tolist()]
    while len(left) > 3:
        off = []
        for i, (x, y) in enumerate(left):
            (ax, ay), (bx, by) = left[i - 1], left[(i + 1) % len(left)]
            off.append(abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / max(1e-9, np.hypot(bx - ax, by - ay)))
        i = int(np.argmin(off))
        if off[i] > tolerance * around:
            break
        left.pop(i)
    return len(left)


def contours(mask: np.ndarray) -> list[tuple[tuple[int, int, int, int], np.ndarray, int]]:
    """(bounding box, hull corners, pixels) of each 8-connected part, in reading order."""
    row, start, end, part = labels(mask)
    out = []
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(int(part.max()) + 2 if len(part) else 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = order[a:b]
        points = np.concatenate([np.stack([start[own], row[own]], 1), np.stack([end[own] - 1, row[own]], 1)])
        x, y = points.min(0).tolist()
        x1, y1 = points.max(0).tolist()
        out.append(((x, y, x1 - x + 1, y1 - y + 1), hull(points), int((end[own] - start[own]).sum())))
    return out


def contour_features(patch: np.ndarray) -> dict[str, float]:
    """Dark parts: their number, the largest one's area and hull area, its share of the patch, and its convexity.

    The area is the number of the part's pixels, that of the hull is of the polygon around their middles,
    widened by half a pixel on every side, so a filled rectangle has convexity 1.
    """
    found = contours(patch < 127)
    if not found:
        return {"contour_count": 0, "largest_contour_area": 0.0, "hull_area": 0.0, "contour_area_ratio": 0.0, "convexity": 0.0}
    _, corners, n = max(found, key=lambda c: c[2])
    wide = np.concatenate([corners + d for d in ((-0.5, -0.5), (-0.5, 0.5), (0.5, -0.5), (0.5, 0.5))])
    around = polygon_area(hull(wide))
    return {"contour_count": len(found), "largest_contour_area": float(n), "hull_area": around, "contour_area_ratio": n / patch.size, "convexity": n / around if around else 0.0}


def is_diagonal(angle: float) -> bool:
    a = angle % 180
    return 30 <= a <= 60 or 120 <= a <= 150


def cross_score(patch: np.ndarray) -> tuple[float, int]:
    """(share of diagonal strokes, strokes): a stroke is a straight run of edge pixels at one of 12 angles."""
    e = edges(patch)
    rows, cols = np.nonzero(e)
    least = max(3, min(patch.shape, default=0) // 3)
    if len(rows) < least:
        return 0.0, 0
    strokes = []
    for angle in range(0, 180, 15):
        t = np.deg2rad(angle)
        rho = np.rint(cols * np.sin(t) - rows * np.cos(t)).astype(int)
        strokes += [angle] * int((np.bincount(rho - rho.min()) >= least).sum())
    return (sum(map(is_diagonal, strokes)) / len(strokes) if strokes else 0.0), len(strokes)


def features(patch: np.ndarray) -> dict[str, float]:
    """The inputs of the rule vote, and the densities."""
    d = density(patch)
    c = contour_features(patch)
    cross, lines = cross_score(patch)
    return d | {"contour_count": c["contour_count"], "contour_area_ratio": c["contour_area_ratio"], "edge_density": float(edges(patch).mean()) if patch.size else 0.0, "cross_pattern_score": cross, "line_count": lines}


_FEATURES = "page_id long, box_id long, dark_ratio double, light_ratio double, mean_intensity double, std_intensity double, contour_count long, contour_area_ratio double, edge_density double, cross_pattern_score double, line_count long"


def box_features(boxes_with_raster: DataFrame) -> DataFrame:
    """Features of boxes (page_id, box_id, x, y, w, h) joined with their page's raster columns."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                patch = crop(gray(r.data, r.height, r.width, r.channels), r.x, r.y, r.w, r.h)
                rows.append({"page_id": r.page_id, "box_id": r.box_id} | features(patch))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FEATURES.split(", ")])

    return boxes_with_raster.select("page_id", "box_id", "x", "y", "w", "h", "height", "width", "channels", "data").mapInPandas(run, _FEATURES)


def laplacian_variance(image: np.ndarray) -> float:
    if not image.size:
        return 0.0
    p = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def image_stats(rasters: DataFrame) -> DataFrame:
    """page_id, width, height, contrast, brightness, blur_score: the inputs of quality.image."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                g = gray(r.data, r.height, r.width, r.channels)
                rows.append((r.page_id, r.width, r.height, float(g.std()), float(g.mean()), laplacian_variance(g)))
            yield pd.DataFrame(rows, columns=["page_id", "width", "height", "contrast", "brightness", "blur_score"])

    return rasters.mapInPandas(run, "page_id long, width int, height int, contrast double, brightness double, blur_score double")


def equalise(image: np.ndarray) -> np.ndarray:
    """Histogram equalisation of gray levels."""
    hist = np.bincount(image.ravel(), minlength=256)
    cum = hist.cumsum()
    low = cum[np.flatnonzero(hist)[0]] if image.size else 0
    if image.size == low:
        return image.copy()
    return np.rint(np.clip((cum - low) * 255.0 / (image.size - low), 0, 255)).astype(np.uint8)[image]


def otsu(image: np.ndarray) -> int:
    """The threshold of the largest variance between the two classes."""
    p = np.bincount(image.ravel(), minlength=256) / max(1, image.size)
    w = p.cumsum()
    m = (p * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num((m[-1] * w - m) ** 2 / (w * (1 - w)))
    return int(between.argmax())


def preprocess(rasters: DataFrame, enhance: bool = True, denoise: bool = True) -> DataFrame:
    """Black and white pages for OCR: gray, equalised, a 3 x 3 median against noise, thresholded."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                g = gray(r.data, r.height, r.width, r.channels)
                g = equalise(g) if enhance else g
                if denoise and min(g.shape) >= 3:
                    p = np.pad(g, 1, mode="edge")
                    g = np.median([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)], axis=0).astype(np.uint8)
                out.append((r.page_id, r.height, r.width, 1, np.where(g > otsu(g), 255, 0).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["page_id", "height", "width", "channels", "data"])

    return rasters.mapInPandas(run, "page_id long, height int, width int, channels int, data binary")


def detect_boxes(rasters: DataFrame, detector=None) -> DataFrame:
    """(page_id, box_id, x, y, w, h) by a detector function image -> [(x, y, w, h)]; the default finds dark frames.

    A detector that fails gives its page no box, as one bad page must not end a batch.
    """
    find = detector or frames

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    got = list(find(gray(r.data, r.height, r.width, r.channels)))
                except Exception:
                    got = []
                out += [(r.page_id, i, *map(int, b)) for i, b in enumerate(got)]
            yield pd.DataFrame(out, columns=["page_id", "box_id", "x", "y", "w", "h"])

    return rasters.mapInPandas(run, "page_id long, box_id long, x long, y long, w long, h long")


def frames(image: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Bounding boxes of connected dark parts, top to bottom."""
    row, start, end, part = labels(image < 127)
    if not len(part):
        return []
    n = int(part.max()) + 1
    x, x1, y, y1 = np.full(n, image.shape[1]), np.zeros(n, int), np.full(n, image.shape[0]), np.zeros(n, int)
    np.minimum.at(x, part, start)
    np.maximum.at(x1, part, end)
    np.minimum.at(y, part, row)
    np.maximum.at(y1, part, row + 1)
    return sorted(zip(x.tolist(), y.tolist(), (x1 - x).tolist(), (y1 - y).tolist(), strict=True), key=lambda b: (b[1], b[0]))


def sized_frames(width: tuple[int, int] = (20, 40), height: tuple[int, int] = (20, 40)):
    """A detector of dark frames whose sides are in the configured ranges."""
    return lambda image: [b for b in frames(image) if width[0] <= b[2] <= width[1] and height[0] <= b[3] <= height[1]]


def contour_boxes(min_area: int = 300, max_area: int = 2000):
    """A detector of edge contours whose hull keeps four corners or more, of an area and an aspect ratio in bounds."""

    def find(image: np.ndarray) -> list[tuple[int, int, int, int]]:
        out = []
        for box, corners, _ in contours(edges(image)):
            w, h = box[2:]
            if min_area < w * h < max_area and 0.8 < w / h < 1.2 and len(corners) >= 4 and vertices(corners) >= 4:
                out.append(box)
        return out

    return find


def detect_checkboxes(rasters: DataFrame, width: tuple[int, int] = (20, 40), height: tuple[int, int] = (20, 40)) -> DataFrame:
    """(page_id, box_id, x, y, w, h): frames of the configured sides, and those contours that no frame overlaps; ids in order of centres."""
    ones = detect_boxes(rasters, sized_frames(width, height))
    twos = detect_boxes(rasters, contour_boxes(width[0] * height[0], width[1] * height[1]))
    both = merge_detections(ones, twos.withColumn("box_id", F.col("box_id") + (1 << 32)))
    return reading_order(both).select("page_id", (F.col("position") - 1).alias("box_id"), "x", "y", "w", "h")
