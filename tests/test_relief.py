"""Distance, maxima, spacing and floods against brute force, with seams of blocks through the images."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.operators import blocks as B
from cytofold.operators import relief as R


def random_mask(seed, h=40, w=50, share=0.75):
    draw = np.random.default_rng(seed)
    mask = draw.random((h, w)) < share
    for _ in range(3):
        y, x, r = draw.integers(0, h), draw.integers(0, w), draw.integers(3, 9)
        yy, xx = np.indices((h, w))
        mask |= (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    return mask


def pixels_of(spark, images, value=None):
    rows = []
    for k, img in images.items():
        h, w = img.shape
        for y, x in zip(*np.nonzero(~np.isnan(img) if img.dtype == float else img), strict=True):
            rows.append((k, int(y), int(x), float(img[y, x]), h, w))
    return spark.createDataFrame(rows, "image string, y int, x int, value double, height int, width int")


def arrays(df, images, column):
    out = {k: np.full(i.shape, np.nan) for k, i in images.items()}
    for r in df.collect():
        assert np.isnan(out[r["image"]][r["y"], r["x"]])
        out[r["image"]][r["y"], r["x"]] = np.nan if r[column] is None else r[column]
    return out


def distances(mask, sy=1.0, sx=1.0):
    yy, xx = np.nonzero(~mask)
    out = np.full(mask.shape, np.nan)
    for y, x in zip(*np.nonzero(mask), strict=True):
        out[y, x] = np.sqrt((((yy - y) * sy) ** 2 + ((xx - x) * sx) ** 2).min()) if len(yy) else np.nan
    return out


@pytest.mark.parametrize("spacing", [(1.0, 1.0), (0.325, 0.65)])
def test_distance_transform(spark, spacing):
    images = {"a": random_mask(1), "b": random_mask(2, 30, 30, 0.97), "full": np.ones((5, 7), bool), "one": np.eye(6, dtype=bool), "line": np.ones((1, 40), bool)}
    images["line"][0, 31] = False
    images["b"][10:20] = True
    px = pixels_of(spark, images)
    got = arrays(R.distance_transform(px.unionByName(px.limit(50)), "image", *spacing), images, "distance")
    for k, mask in images.items():
        np.testing.assert_allclose(got[k], distances(mask, *spacing), atol=1e-12)


def test_distance_of_long_runs_and_odd_keys(spark):
    wide = np.ones((3, 25_000), bool)  # runs longer than an Arrow batch
    wide[1, 4_000] = False
    px = pixels_of(spark, {"w": wide}).withColumn("image", F.struct(F.col("image"), F.lit(None).cast("int").alias("n")))
    got = {(r.y, r.x): r.distance for r in R.distance_transform(px, "image").collect()}
    assert len(got) == 74_999 and got[1, 24_999] == 20_999 and got[0, 4_000] == 1 and abs(got[2, 0] - np.hypot(1, 4000)) < 1e-9
    assert R.distance_transform(px.where("false"), "image").collect() == []


def peaks_plainly(f, spacing, least):
    h, w = f.shape
    value = np.where(np.isnan(f), -np.inf, f)
    found = []
    for y in range(h):
        for x in range(w):
            around = value[max(0, y - spacing) : y + spacing + 1, max(0, x - spacing) : x + spacing + 1]
            if value[y, x] > least and value[y, x] >= around.max():
                found.append((-value[y, x], y, x))
    kept = []
    for v, y, x in sorted(found):
        if all(max(abs(y - b), abs(x - c)) > spacing for _, b, c in kept):
            kept.append((v, y, x))
    return {(y, x) for _, y, x in kept}


@pytest.mark.parametrize("spacing", [1, 3])
def test_spaced_peaks(spark, spacing):
    images = {k: distances(random_mask(k)) for k in (3, 4)} | {5: np.floor(np.random.default_rng(5).random((40, 30)) * 4), 6: np.ones((9, 9))}
    images = {str(k): i for k, i in images.items()}
    got = R.spaced_peaks(pixels_of(spark, images), "image", spacing, 0.5, size=8).collect()
    for k, f in images.items():
        assert {(r.y, r.x) for r in got if r.image == k} == peaks_plainly(f, spacing, 0.5)


def rebuilt_plainly(f, h):
    limit = np.where(np.isnan(f), -np.inf, f)
    now = limit - h
    while True:
        wide = np.pad(now, 1, constant_values=-np.inf)
        new = np.maximum(now, np.minimum(limit, np.max([wide[a : a + f.shape[0], b : b + f.shape[1]] for a in range(3) for b in range(3)], axis=0)))
        if (new == now).all():
            return new
        now = new


def maxima_plainly(v):
    """Pixels of the 8-connected plateaus without a higher neighbour."""
    h, w = v.shape
    seen, out = np.zeros(v.shape, bool), set()
    for y, x in zip(*np.nonzero(v > -np.inf), strict=True):
        if seen[y, x]:
            continue
        stack, part, top = [(y, x)], [], True
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            part.append((int(a), int(b)))
            for c in range(max(0, a - 1), min(h, a + 2)):
                for d in range(max(0, b - 1), min(w, b + 2)):
                    if v[c, d] > v[a, b]:
                        top = False
                    elif v[c, d] == v[a, b] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        if top:
            out |= set(part)
    return out


@pytest.mark.parametrize("h", [0.5, 1.5])
def test_h_maxima(spark, h):
    draw = np.random.default_rng(7)
    snake = np.full((20, 40), np.nan)  # a low way through many blocks from one peak to another
    snake[::4] = 5.0
    snake[2::8, -1] = snake[1::8, -1] = snake[3::8, -1] = snake[6::8, 0] = snake[5::8, 0] = snake[7::8, 0] = 5.0
    snake[0, 0], snake[16, 39] = 9.0, 5.4
    images = {"d": distances(random_mask(8, share=0.9)), "r": np.round(draw.random((33, 41)) * 3, 1), "flat": np.ones((10, 10)), "snake": snake}
    got = R.h_maxima(pixels_of(spark, images), "image", h, size=8).collect()
    for k, f in images.items():
        assert {(r.y, r.x) for r in got if r.image == k} == maxima_plainly(rebuilt_plainly(f, h)), k


def flooded_plainly(f, markers):
    """Edges in the order of their height and codes from what is flooded."""
    label, heap = dict(markers), []

    def reach(y, x):
        for b, c in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= b < f.shape[0] and 0 <= c < f.shape[1] and not np.isnan(f[b, c]) and (b, c) not in label:
                ends = sorted([(y << 20) + x, (b << 20) + c])
                heapq.heappush(heap, (max(f[y, x], f[b, c]), *ends, (b, c), label[y, x]))

    for y, x in markers:
        reach(y, x)
    while heap:
        *_, p, k = heapq.heappop(heap)
        if p not in label:
            label[p] = k
            reach(*p)
    return label


@pytest.mark.parametrize("size", [8, 256])
def test_watershed(spark, size):
    draw = np.random.default_rng(9)
    images, markers = {}, {}
    for k in range(4):
        f = -distances(random_mask(20 + k)) if k < 2 else np.where(draw.random((40, 50)) < 0.9, np.floor(draw.random((40, 50)) * (3 if k == 2 else 1000)), np.nan)
        images[str(k)] = f
        at = np.argwhere(~np.isnan(f))
        markers[str(k)] = {tuple(map(int, p)): n + 1 for n, p in enumerate(at[draw.choice(len(at), 9 if k else 1, replace=False)])}
    rows = [(k, *p, n) for k, own in markers.items() for p, n in own.items()]
    got = R.watershed(pixels_of(spark, images), spark.createDataFrame(rows, "image string, y int, x int, marker long"), "image", size=size).collect()
    for k, f in images.items():
        mine = {(r.y, r.x): r.marker for r in got if r.image == k}
        assert len(mine) == sum(r.image == k for r in got)
        assert mine == flooded_plainly(f, markers[k]), k


def test_split_objects(spark):
    yy, xx = np.indices((40, 60))
    disks = ((yy - 15) ** 2 + (xx - 15) ** 2 <= 64) | ((yy - 15) ** 2 + (xx - 28) ** 2 <= 64)
    disks |= (yy == 35) & (xx > 40) | (yy == 2) & (xx == 50)
    px = pixels_of(spark, {"i": disks})
    for options in ({"spacing": 3}, {"spacing": 3, "h": 0.5}, {"spacing": 3, "erosion": 2}):
        got = R.split_objects(px, "image", size=16, **options).collect()
        assert {(r.y, r.x) for r in got} == set(zip(*(a.tolist() for a in np.nonzero(disks)), strict=True))
        label = {(r.y, r.x): r.marker for r in got}
        assert label[15, 15] != label[15, 28] and len(set(label.values())) == 4
        assert all(label[15, x] == label[15, 15] for x in range(8, 21)) and label[35, 41] == label[35, 59] == (35 << 20) + 41
    assert len({r.marker for r in R.split_objects(px, "image", spacing=3, smallest=2, size=16).collect()}) == 3


@pytest.mark.parametrize("mirror", [True, False])
def test_windows_are_the_image_with_a_border(spark, mirror):
    draw = np.random.default_rng(3)
    images = {"a": draw.random((21, 37)), "b": draw.random((3, 50)), "c": draw.random((8, 8))}
    blocks = B.to_blocks(pixels_of(spark, images), "image", 8)
    total = lambda w: sum(np.roll(w, (a, b), (0, 1)) * (a + 2.5 * b + 9) for a in range(-5, 6) for b in range(-5, 6))
    got = arrays(B.to_pixels(B.stencil(blocks, "image", 5, total, 8, mirror=mirror), "image", 8, None), images, "value")
    for k, img in images.items():
        wide = np.pad(img, 5, mode="symmetric") if mirror else np.pad(img, 5, constant_values=np.nan)
        np.testing.assert_allclose(got[k], total(wide)[5:-5, 5:-5])
    same = arrays(B.to_pixels(blocks, "image", 8), images, "value")
    assert all((same[k] == images[k]).all() for k in images)


def parts_plainly(pixels, eight):
    left, out = set(pixels), []
    while left:
        stack, part = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            part.add((y, x))
            for b in (-1, 0, 1):
                for c in (-1, 0, 1):
                    if (eight or b == 0 or c == 0) and (y + b, x + c) in left:
                        left.remove((y + b, x + c))
                        stack.append((y + b, x + c))
        out.append(part)
    return out


def test_split_query_equals_whole_images(spark):
    from cytofold.plans import relief_queries as Q

    sf = "/root/testdata/sf0.001"
    px = Q._plots(spark, sf).toPandas()
    got = Q.i18_split_objects(spark, sf).toPandas()
    code = lambda p: (p[0] << 20) + p[1]
    for k, own in px.groupby("image"):
        mask = np.zeros((int(own["height"].iloc[0]), int(own["width"].iloc[0])), bool)
        mask[own["y"], own["x"]] = True
        depth = distances(mask)
        first = sorted((-depth[min(p)], code(min(p)), min(p)) for p in parts_plainly(maxima_plainly(rebuilt_plainly(depth, 0.5)), True))
        kept = []
        for v, _, p in first:
            if -v > 1.0 and all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) > 3 for q in kept):
                kept.append(p)
        label = flooded_plainly(-depth, {p: code(p) for p in kept})
        for part in parts_plainly({(int(y), int(x)) for y, x in np.argwhere(mask)} - label.keys(), False):
            label |= {p: code(min(part)) for p in part}
        sizes = np.unique(list(label.values()), return_counts=True)
        enough = set(sizes[0][sizes[1] >= 4].tolist())
        mine = got[got["image"] == k]
        assert dict(zip(zip(mine["y"], mine["x"], strict=True), mine["marker"], strict=True)) == {p: m for p, m in label.items() if m in enough}
