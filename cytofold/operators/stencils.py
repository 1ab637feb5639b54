"""Smoothing, ridges and blobs of images of any size: kernels over blocks with a border (see ``blocks``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.operators import blocks as B
from cytofold.operators.tiles import gaussian


def _reach(known: np.ndarray, radius: int) -> np.ndarray:
    """Pixels with a known one in the square of ``radius`` around them; the border of that width is not filled in."""
    for axis in (0, 1):
        total = np.cumsum(known, axis=axis, dtype=np.int64)
        total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis)
        n = known.shape[axis]
        lo, hi = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
        known = (np.take(total, hi, axis) - np.take(total, lo, axis)) > 0
    return known


def smoothed(px: DataFrame, key: str, sigma: float, order: tuple[int, int] = (0, 0), size: int = B.SIZE) -> DataFrame:
    """(key, y, x, value, height, width): Gaussian smoothing or derivative (0 to 2 along
    y and x), mirrored at the image's edges. Pixels that ``px`` lacks are 0; pixels that
    the kernel, which ends at 4 sigma (``size`` at most), leaves without any of ``px`` have no row."""
    r = int(4 * sigma + 0.5)

    def kernel(window: np.ndarray) -> np.ndarray:
        known = ~np.isnan(window)
        return np.where(_reach(known, r), gaussian(np.where(known, window, 0.0), sigma, order), np.nan)

    blocks = B.stencil(B.to_blocks(px, key, size, "value", np.nan), key, r, kernel, size, np.nan)
    return B.to_pixels(blocks, key, size, None)


def _hessian(window: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of the scaled Hessian, smaller and larger by size."""
    yy, xx, xy = (gaussian(window, s, o) * s * s for o in ((2, 0), (0, 2), (1, 1)))
    mean, root = (yy + xx) / 2, np.hypot((yy - xx) / 2, xy)
    a, b = mean - root, mean + root
    first = np.abs(a) < np.abs(b)
    return np.where(first, a, b), np.where(first, b, a)


def ridges(px: DataFrame, key: str, sigmas: tuple[float, ...] = (1.0, 2.0), beta: float = 0.5, gamma: float | None = None, bright: bool = True, size: int = B.SIZE) -> DataFrame:
    """(key, y, x, value): the largest ridge response over the scales, from the eigenvalues
    of the scaled Hessian. ``gamma`` is half the largest Hessian norm of the image at the
    scale if not given, which takes a pass of its own. All scales share the borders of one exchange."""
    r = int(4 * max(sigmas) + 0.5)

    def each(window: np.ndarray, place: B.Place):
        known = ~np.isnan(window)
        image = np.where(known, window, 0.0)
        cut = np.s_[r : r + place.h, r : r + place.w]
        for s in sigmas:
            small, large = _hessian(image, s)
            yield _reach(known, int(4 * s + 0.5))[cut], small[cut], large[cut]

    def norms(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        most = [float(np.where(seen, np.hypot(small, large), 0.0).max(initial=0.0)) for seen, small, large in each(window, place)]
        return pd.DataFrame({f"n{k}": [v] for k, v in enumerate(most)})

    def response(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        best = np.full((place.h, place.w), np.nan)
        for half, (seen, small, large) in zip(place.carried["halves"], each(window, place), strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                v = np.exp(-((small / large) ** 2) / (2 * beta**2)) * (1 - np.exp(-(small**2 + large**2) / (2 * (half or 1.0) ** 2)))
            v[(large >= 0) if bright else (large <= 0)] = 0
            best = np.fmax(best, np.where(seen, np.nan_to_num(v), np.nan))
        return pd.DataFrame({"data": [best.tobytes()]})

    blocks = B.to_blocks(px, key, size, "value", np.nan)
    if gamma is None:
        made = B.over_windows(blocks, key, r, norms, ", ".join(f"n{k} double" for k in range(len(sigmas))), size, np.nan)
        halves = made.groupBy(key).agg(F.array(*(F.max(f"n{k}") / 2 for k in range(len(sigmas)))).alias("halves"))
        blocks = blocks.join(halves, key)
    else:
        blocks = blocks.withColumn("halves", F.array(*(F.lit(float(gamma)) for _ in sigmas)))
    return B.to_pixels(B.over_windows(blocks, key, r, response, "data binary", size, np.nan, True, (), ("halves",)), key, size, None).select(key, "y", "x", "value")


def blob_peaks(px: DataFrame, key: str, sigmas: tuple[float, ...] = (1.0, 2.0), threshold: float = 0.1, dark: bool = False, size: int = B.SIZE) -> DataFrame:
    """(key, y, x, scale, strength): maxima above ``threshold`` of the negative scaled
    Laplacian among the neighbours in place and scale (``scale`` counts the sigmas from 0).
    Pixels that ``px`` lacks are 0; with ``dark`` values count from 1 downwards."""
    r = int(4 * max(sigmas) + 0.5) + 1

    def kernel(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        image = 1 - window if dark else window
        stack = np.stack([-(gaussian(image, s, (2, 0)) + gaussian(image, s, (0, 2))) * s * s for s in sigmas])
        # beyond the image there is nothing to be lower than
        for axis, (first, n, whole) in enumerate(((place.y0, place.h, place.height), (place.x0, place.w, place.width)), 1):
            at = np.arange(first - r, first + n + r)
            stack = np.where(np.expand_dims((at >= 0) & (at < whole), (0, 3 - axis)), stack, -np.inf)
        near = stack[:, r - 1 : r + 1 + place.h, r - 1 : r + 1 + place.w]
        wide = np.pad(near, ((1, 1), (0, 0), (0, 0)), constant_values=-np.inf)
        own = near[:, 1:-1, 1:-1]
        around = np.max([wide[c : c + len(sigmas), a : a + place.h, b : b + place.w] for c in range(3) for a in range(3) for b in range(3)], axis=0)
        k, y, x = np.nonzero((own >= around) & (own > threshold))
        return pd.DataFrame({"y": (y + place.y0).astype(np.int32), "x": (x + place.x0).astype(np.int32), "scale": k.astype(np.int32), "strength": own[k, y, x]})

    return B.over_windows(B.to_blocks(px, key, size), key, r, kernel, "y int, x int, scale int, strength double", size).select(key, "y", "x", "scale", "strength")


def blob_disks(px: DataFrame, key: str, sigmas: tuple[float, ...] = (1.0, 2.0), threshold: float = 0.1, overlap: float | None = 0.5, dark: bool = False, size: int = B.SIZE) -> DataFrame:
    """(key, y, x, blob, strength): the pixels of disks around the peaks of the scale space,
    strongest first (ties: smaller scale, then first pixel); a pixel keeps its first disk.
    ``blob`` is the code of the peak, (y * 2**20 + x) * 64 and its scale.

    With ``overlap`` a disk goes that shares more than this part of the smaller disk's area
    with one that stays and is stronger. The disk's radius is sigma * sqrt(2), painted with whole pixels, 2 at least."""
    from cytofold.operators.relief import first_served, pixel_code

    peaks = blob_peaks(px, key, sigmas, threshold, dark, size).withColumn("id", pixel_code() * 64 + F.col("scale"))
    radii = [float(s * 2**0.5) for s in sigmas]
    order = F.struct((-F.col("strength")).alias("s"), F.col("scale"), F.col("id"))
    if overlap is not None:
        of = lambda c: F.element_at(F.array(*(F.lit(r) for r in radii)), F.col(f"{c}.scale") + 1)
        p, q, d = of("a"), of("b"), F.hypot(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x"))
        least, most = F.least(p, q), F.greatest(p, q)
        turn = lambda own, other: own * own * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (d * d + own * own - other * other) / (2 * d * own))))
        kite = F.sqrt(F.greatest(F.lit(0.0), (p + q - d) * (d + p - q) * (d - p + q) * (d + p + q))) / 2
        part = F.when(d >= p + q, 0.0).when(d <= most - least, 1.0).otherwise((turn(p, q) + turn(q, p) - kite) / (float(np.pi) * least * least))
        peaks = first_served(peaks, key, int(2 * max(radii)) + 1, order, part > overlap)
    paint = [max(2, int(r)) for r in radii]
    disks = [[(y, x) for y in range(-n, n + 1) for x in range(-n, n + 1) if y * y + x * x <= n * n] for n in paint]
    steps = F.element_at(F.array(*(F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in disk)) for disk in disks)), F.col("scale") + 1)
    extent = px.groupBy(key).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    sent = peaks.join(extent, key).withColumn("s", F.explode(steps)).select(key, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "height", "width", F.struct((-F.col("strength")).alias("s"), F.col("scale"), F.col("id")).alias("first"))
    sent = sent.where("y >= 0 and x >= 0 and y < height and x < width")
    return sent.groupBy(key, "y", "x").agg(F.min("first").alias("first")).select(key, "y", "x", F.col("first.id").alias("blob"), (-F.col("first.s")).alias("strength"))
