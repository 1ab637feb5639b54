"""Raster kernels over tiles (tile, height, width, pixels).

Spark deals the tiles; each kernel is a short NumPy function of one tile, whose
size is bounded by the tile grid. What can be a join or an aggregate over pixels
is one (see ``pixels`` and ``raster``).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cytofold.operators.graph import local_components
from cytofold.shipping import on_executors


def map_tiles(tiles: DataFrame, kernel: Callable[..., np.ndarray], **options) -> DataFrame:
    """``kernel(image, **options)`` of every tile, other columns as they are. Tiles
    with null pixels stay null."""

    def run(parts):
        for part in parts:
            out = [None if p is None else np.asarray(kernel(np.asarray(p, float).reshape(h, w), **options), float).ravel() for p, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            yield part.assign(pixels=out)

    on_executors(tiles.sparkSession)
    return tiles.mapInPandas(run, tiles.schema)


def _along(img: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    r = len(kernel) // 2
    wide = np.pad(img, [(r, r) if a == axis else (0, 0) for a in range(2)], mode="symmetric")
    return np.apply_along_axis(np.convolve, axis, wide, kernel[::-1], "valid")


def gaussian(img: np.ndarray, sigma: float, order: tuple[int, int] = (0, 0)) -> np.ndarray:
    """Gaussian smoothing or derivative (0 to 2 along y and x), mirrored at the edges."""
    if sigma <= 0:
        return img
    r = int(4 * sigma + 0.5)
    t = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-t * t / (2 * sigma * sigma))
    g /= g.sum()
    shapes = (g, -t / sigma**2 * g, (t * t / sigma**4 - 1 / sigma**2) * g)
    return _along(_along(img, shapes[order[0]][::-1], 0), shapes[order[1]][::-1], 1)


def vesselness(img: np.ndarray, sigmas=(1.0, 2.0), beta: float = 0.5, gamma: float | None = None, bright: bool = True) -> np.ndarray:
    """Largest ridge response over the scales, from the eigenvalues of the scaled Hessian."""
    best = np.zeros(img.shape)
    for s in sigmas:
        yy, xx, xy = (gaussian(img, s, o) * s * s for o in ((2, 0), (0, 2), (1, 1)))
        mean, root = (yy + xx) / 2, np.hypot((yy - xx) / 2, xy)
        a, b = mean - root, mean + root
        small, large = np.where(np.abs(a) < np.abs(b), a, b), np.where(np.abs(a) < np.abs(b), b, a)
        size = np.sqrt(small**2 + large**2)
        half = size.max() / 2 if gamma is None else gamma
        with np.errstate(divide="ignore", invalid="ignore"):
            v = np.exp(-((small / large) ** 2) / (2 * beta**2)) * (1 - np.exp(-(size**2) / (2 * (half or 1) ** 2)))
        v[(large >= 0) if bright else (large <= 0)] = 0
        best = np.maximum(best, np.nan_to_num(v))
    return best


def equalised(img: np.ndarray, block: int = 64, clip: float = 0.01, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive equalisation: clipped histograms of a grid of
    blocks, their curves blended linearly between block centres."""
    lo, hi = img.min(), img.max()
    if hi == lo:
        return np.zeros(img.shape)
    level = np.minimum(((img - lo) / (hi - lo) * bins).astype(int), bins - 1)
    ny, nx = (max(1, -(-n // block)) for n in img.shape)
    curves = np.zeros((ny, nx, bins))
    for i in range(ny):
        for j in range(nx):
            h = np.bincount(level[i * block : (i + 1) * block, j * block : (j + 1) * block].ravel(), minlength=bins).astype(float)
            top = max(1.0, clip * h.sum())
            spare = np.maximum(h - top, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(h, top) + spare / bins) / h.sum()

    def weights(n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) / block - 0.5, 0, k - 1)
        low = np.minimum(at.astype(int), max(k - 2, 0))
        return low, np.minimum(low + 1, k - 1), at - low

    y0, y1, fy = weights(img.shape[0], ny)
    x0, x1, fx = weights(img.shape[1], nx)
    pick = lambda y, x: curves[y[:, None], x[None, :], level]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    return top * (1 - fy)[:, None] + (pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx) * fy[:, None]


def otsu_threshold(values: np.ndarray, bins: int = 256) -> float:
    n, edges = np.histogram(values, bins)
    c = (edges[1:] + edges[:-1]) / 2
    w, s = np.cumsum(n), np.cumsum(n * c)
    with np.errstate(divide="ignore", invalid="ignore"):
        between = w[:-1] * (w[-1] - w[:-1]) * (s[:-1] / w[:-1] - (s[-1] - s[:-1]) / (w[-1] - w[:-1])) ** 2
    return float(c[np.nanargmax(between)]) if np.isfinite(between).any() else float(values.flat[0])


def triangle_threshold(values: np.ndarray, bins: int = 256) -> float:
    """Bin furthest from the line between the histogram's peak and its longer tail's end."""
    n, edges = np.histogram(values, bins)
    c = (edges[1:] + edges[:-1]) / 2
    used = np.flatnonzero(n)
    peak, low, high = int(n.argmax()), used[0], used[-1]
    end = low if peak - low > high - peak else high
    if end == peak:
        return float(c[peak])
    k = np.arange(min(peak, end), max(peak, end) + 1)
    line = n[peak] + (n[end] - n[peak]) * (k - peak) / (end - peak)
    return float(c[k[np.argmax((line - n[k]) * 1.0)]])


def li_threshold(values: np.ndarray, tolerance: float = 1e-6) -> float:
    """Fixed point of minimum cross entropy, for values shifted to be positive."""
    low = values.min()
    x = values - low
    if x.max() == 0:
        return float(low)
    t, last = x.mean(), -1.0
    while abs(t - last) > tolerance * x.max():
        last, over = t, x > t
        back, front = x[~over].mean(), x[over].mean() if over.any() else t
        t = (back - front) / (np.log(back) - np.log(front)) if back > 0 and front != back else front / 2
    return float(t + low)


def log_mask(img: np.ndarray, factor: float = 1.0) -> np.ndarray:
    """1 where the image exceeds ``factor`` times the smaller of Otsu's and the
    triangle threshold of the logarithm of its positive values."""
    positive = img[img > 0]
    if not positive.size:
        return np.zeros(img.shape)
    logs = np.log10(positive)
    return img > factor * 10 ** min(otsu_threshold(logs), triangle_threshold(logs))


def thinned(img: np.ndarray) -> np.ndarray:
    """One-pixel skeleton of a mask by alternating parallel peels (Zhang and Suen)."""
    m = np.pad(img > 0, 1)
    while True:
        before = m.sum()
        for half in range(2):
            n = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(x.astype(int) for x in n)
            turns = sum((~n[k] & n[(k + 1) % 8]).astype(int) for k in range(8))
            up, right, down, left = n[0], n[2], n[4], n[6]
            free = ~(up & right & down) & ~(right & down & left) if half == 0 else ~(up & right & left) & ~(up & down & left)
            m = m & ~((count >= 2) & (count <= 6) & (turns == 1) & free)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def edge_distance(img: np.ndarray) -> np.ndarray:
    """Distance of each mask pixel to the nearest background pixel of the tile:
    along columns first, then rows as far as the largest distance left can be improved."""
    mask = img > 0
    h, w = mask.shape
    far = float(h + w) ** 2
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, -far, at), axis=0)
    below = np.minimum.accumulate(np.where(mask, far, at)[::-1], axis=0)[::-1]
    column = np.minimum(np.minimum(at - above, below - at) ** 2, far)
    best = column.copy()
    for k in range(1, w):
        if k * k >= best.max():
            break
        np.minimum(best[:, k:], column[:, :-k] + k * k, out=best[:, k:])
        np.minimum(best[:, :-k], column[:, k:] + k * k, out=best[:, :-k])
    return np.sqrt(best)


def watershed(img: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Labels flooded from the markers over the positive pixels, lowest image value
    first, ties by arrival; 4-neighbours."""
    labels = markers.astype(int).copy()
    inside = img > 0
    heap = [(-img[y, x], k, y, x) for k, (y, x) in enumerate(zip(*np.nonzero(labels), strict=True))]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < img.shape[0] and 0 <= u < img.shape[1] and inside[v, u] and not labels[v, u]:
                labels[v, u] = labels[y, x]
                age += 1
                heapq.heappush(heap, (-img[v, u], age, v, u))
    return labels


def split_touching(img: np.ndarray, h: float = 0.5) -> np.ndarray:
    """Touching objects of a mask apart: markers are the peaks of the edge distance that stand out."""
    d = edge_distance(img)
    wide = np.pad(d, 1)
    n = [wide[1 + a : 1 + a + d.shape[0], 1 + b : 1 + b + d.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)]
    peak = (d > h) & (d >= np.max(n, axis=0))
    return watershed(d, _labelled(peak))


def _labelled(mask: np.ndarray) -> np.ndarray:
    """8-connected labels from 1, in order of their first pixel."""
    h, w = mask.shape
    number = np.where(mask.ravel(), np.cumsum(mask.ravel()) - 1, -1).reshape(h, w)
    pairs = []
    for here, there in ((number[:, :-1], number[:, 1:]), (number[:-1], number[1:]), (number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])):
        both = (here >= 0) & (there >= 0)
        pairs.append(np.c_[here[both], there[both]])
    a, b = np.concatenate(pairs).T
    labels = np.zeros(mask.shape, int)
    labels[mask] = np.unique(local_components(int(mask.sum()), a, b), return_inverse=True)[1] + 1
    return labels


def stretched(img: np.ndarray, low: float = 1.0, high: float = 99.0, dark: bool = False) -> np.ndarray:
    """Values from 0 at the low percentile to 1 at the high one, the other way round for dark objects; 0 if both are equal."""
    a, b = np.percentile(img, (low, high))
    out = np.clip((img - a) / (b - a), 0, 1) if b > a else np.zeros(img.shape)
    return 1 - out if dark else out


def blobs(img: np.ndarray, sigmas=(1.0, 2.0), threshold: float = 0.1, stretch: bool = False, dark: bool = False) -> np.ndarray:
    """Labels of disks around the peaks of the scale-normalised Laplacian, strongest
    first; a pixel keeps its first disk. ``stretch`` scales the tile by its percentiles first."""
    img = stretched(img, dark=dark) if stretch or dark else img
    stack = np.stack([-(gaussian(img, s, (2, 0)) + gaussian(img, s, (0, 2))) * s * s for s in sigmas])
    wide = np.pad(stack, 1, constant_values=-np.inf)
    around = np.max([wide[1 + c : 1 + c + stack.shape[0], 1 + a : 1 + a + img.shape[0], 1 + b : 1 + b + img.shape[1]] for c in (-1, 0, 1) for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    peaks = sorted(zip(*np.nonzero((stack >= around) & (stack > threshold)), strict=True), key=lambda p: (-stack[p], p))
    labels = np.zeros(img.shape, int)
    yy, xx = np.indices(img.shape)
    for k, (s, y, x) in enumerate(peaks, 1):
        r = max(2, int(sigmas[s] * np.sqrt(2)))
        labels[(labels == 0) & ((yy - y) ** 2 + (xx - x) ** 2 <= r * r)] = k
    return labels


BRANCHES = "tile long, branch int, src int, dst int, kind int, length double, chord double, thickness double, component int"


def branch_table(tiles: DataFrame) -> DataFrame:
    """Branches of the skeleton of every tile's mask: ends (pixel index), kind (0
    isolated, 1 with a free end, 2 between junctions, 3 closed), length along the
    path, chord, twice the median edge distance, and connected component."""

    def run(parts):
        for part in parts:
            rows = []
            for tile, p, h, w in zip(part["tile"], part["pixels"], part["height"], part["width"], strict=True):
                if p is not None:
                    rows += [(tile, k, *b) for k, b in enumerate(branches_of(np.asarray(p, float).reshape(h, w)))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BRANCHES.split(", ")])

    on_executors(tiles.sparkSession)
    return tiles.select("tile", "pixels", "height", "width").mapInPandas(run, BRANCHES)


def branches_of(img: np.ndarray) -> list[tuple]:
    skeleton, depth = thinned(img), edge_distance(img)
    w = img.shape[1]
    pixels = {(int(y), int(x)) for y, x in zip(*np.nonzero(skeleton), strict=True)}
    part = _labelled(skeleton)
    # a diagonal step counts only where no straight pair of steps does the same
    near = {
        (y, x): sorted(
            (y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)
            if (a or b) and (y + a, x + b) in pixels and not (a and b and ((y + a, x) in pixels or (y, x + b) in pixels))
        )
        for y, x in pixels
    }
    nodes = {p for p in pixels if len(near[p]) != 2}
    for k in set(part[part > 0].tolist()):  # a closed loop has no node of its own
        loop = [p for p in pixels if part[p] == k]
        if not nodes & set(loop):
            nodes.add(min(loop))
    out, used = [], set()
    for start in sorted(nodes):
        if not near[start]:
            continue
        for step in near[start]:
            if (start, step) in used:
                continue
            path = [start, step]
            while path[-1] not in nodes:
                path.append(next(q for q in near[path[-1]] if q != path[-2]))
            used |= {(path[0], path[1]), (path[-1], path[-2])}
            free = [len(near[p]) == 1 for p in (path[0], path[-1])]
            kind = 3 if path[0] == path[-1] else 0 if all(free) else 1 if any(free) else 2
            length = sum(float(np.hypot(a[0] - b[0], a[1] - b[1])) for a, b in zip(path, path[1:], strict=False))
            chord = float(np.hypot(path[0][0] - path[-1][0], path[0][1] - path[-1][1]))
            out.append((path[0][0] * w + path[0][1], path[-1][0] * w + path[-1][1], kind, length, chord, 2 * float(np.median([depth[p] for p in path])), int(part[path[0]])))
    return out
