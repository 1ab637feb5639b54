"""Blobs, thresholds and stencils over blocks against kernels of whole images."""

import numpy as np
import pytest

from cytofold.operators import raster as T
from cytofold.operators import stencils as S
from cytofold.operators import tiles as K
from cytofold.plans import relief_queries as Q
from tests.test_relief import arrays, pixels_of


def spots(seed, h=45, w=60, n=25):
    draw = np.random.default_rng(seed)
    img = np.zeros((h, w))
    for _ in range(n):
        img[draw.integers(0, h), draw.integers(0, w)] += draw.integers(5, 60)
    return K.gaussian(img, 1.5) + draw.random((h, w)) * 0.001


def test_stencils_across_seams(spark):
    images = {"a": spots(1), "b": spots(2, 17, 40)}
    px = pixels_of(spark, images)
    got = arrays(S.smoothed(px, "image", 1.6, (0, 1), size=16), images, "value")
    ridge = arrays(S.ridges(px, "image", (1.0, 2.0), size=16), images, "value")
    for k, img in images.items():
        np.testing.assert_allclose(got[k], K.gaussian(img, 1.6, (0, 1)), atol=1e-12)
        np.testing.assert_allclose(ridge[k], K.vesselness(img, (1.0, 2.0)), atol=1e-9)
    sparse = S.smoothed(px.where("image = 'b' and y = 8 and x = 20"), "image", 1.0, size=16).collect()
    assert {(r.y, r.x) for r in sparse} == {(y, x) for y in range(4, 13) for x in range(16, 25)} and abs(sum(r.value for r in sparse) - images["b"][8, 20]) < 1e-9


def overlap_of(a, b, radii):
    p, q, d = radii[a[0]], radii[b[0]], np.hypot(a[1] - b[1], a[2] - b[2])
    if d >= p + q:
        return 0.0
    if d <= abs(p - q):
        return 1.0
    area = sum(r * r * np.arccos(np.clip((d * d + r * r - s * s) / (2 * d * r), -1, 1)) for r, s in ((p, q), (q, p)))
    return (area - np.sqrt(max(0, (p + q - d) * (d + p - q) * (d - p + q) * (d + p + q))) / 2) / (np.pi * min(p, q) ** 2)


def disks_of(img, sigmas, threshold, overlap):
    """Labels of the whole image, one disk after the other, and the numbers of peaks and disks."""
    radii, n = [s * 2**0.5 for s in sigmas], len(sigmas)
    stack = np.stack([-(K.gaussian(img, s, (2, 0)) + K.gaussian(img, s, (0, 2))) * s * s for s in sigmas])
    wide = np.pad(stack, 1, constant_values=-np.inf)
    around = np.max([wide[c : c + n, a : a + img.shape[0], b : b + img.shape[1]] for c in range(3) for a in range(3) for b in range(3)], axis=0)
    peaks = sorted(zip(*map(np.ndarray.tolist, np.nonzero((stack >= around) & (stack > threshold))), strict=True), key=lambda p: (-stack[p], p))
    kept = []
    for p in peaks:
        if overlap is None or all(overlap_of(p, o, radii) <= overlap for o in kept):
            kept.append(p)
    label = np.full(img.shape, -1)
    yy, xx = np.indices(img.shape)
    for s, y, x in kept:
        r = max(2, int(radii[s]))
        label[(label < 0) & ((yy - y) ** 2 + (xx - x) ** 2 <= r * r)] = ((y << 20) + x) * 64 + s
    return label, len(peaks), len(kept)


@pytest.mark.parametrize("overlap", [None, 0.0])
def test_blobs(spark, overlap):
    wide = np.zeros((60, 60))
    wide[30, 30] = 4000.0
    wide = K.gaussian(wide, 5)
    wide[33, 36] += 30  # a small disk inside a large one
    sigmas, images = (1.0, 1.5, 2.5, 5.0), {"a": spots(3), "b": spots(4, 21, 70, 60), "c": wide, "none": np.zeros((5, 5))}
    got = S.blob_disks(pixels_of(spark, images), "image", sigmas, 0.05, overlap, size=32).collect()
    left = []
    for k, img in images.items():
        label, n, kept = disks_of(img, sigmas, 0.05, overlap)
        left.append(n - kept)
        mine = np.full(img.shape, -1)
        for r in got:
            if r.image == k:
                mine[r.y, r.x] = r.blob
        assert (mine == label).all(), k
    assert any(left) == (overlap is not None)


def test_blob_query_equals_whole_images(spark):
    sf = "/root/testdata/sf0.001"
    px = Q._spots(spark, sf).toPandas()
    got = Q.i12_blob_disks(spark, sf).toPandas()
    assert len(got)
    for k, part in px.groupby("image"):
        img = np.zeros((int(part["height"].iloc[0]), int(part["width"].iloc[0])))
        img[part["y"], part["x"]] = part["value"]
        mine = np.full(img.shape, -1)
        own = got[got["image"] == k]
        mine[own["y"], own["x"]] = own["blob"]
        assert (mine == disks_of(img, Q.SIGMAS, 0.1, 0.5)[0]).all()


def test_li_and_log_thresholds(spark):
    draw = np.random.default_rng(6)
    images = {"two": np.where(draw.random((20, 30)) < 0.3, draw.normal(60, 4, (20, 30)), draw.normal(20, 3, (20, 30))), "skew": draw.gamma(2, 9, (25, 25)), "flat": np.full((3, 3), 7.0), "pair": np.array([[1.0, 1.0, 9.0]])}
    px = pixels_of(spark, images)
    got = {r.image: r.threshold for r in T.intensity_threshold(px, "image", "li", 64).collect()}
    for k, img in images.items():
        lo, width = img.min(), (img.max() - img.min()) / 64
        if not width:
            assert got[k] == lo
            continue
        n = np.histogram(img, 64, (img.min(), img.max()))[0]
        c = (np.arange(64) + 0.5) * width
        t = (n * c).sum() / n.sum()
        for _ in range(60):
            low = c <= t
            back, front = (n * c)[low].sum() / n[low].sum(), (n * c)[~low].sum() / n[~low].sum()
            t = (back - front) / (np.log(back) - np.log(front))
        assert abs(got[k] - lo - t) < 1e-9, k
    logs = {r.image: r.threshold for r in T.log_threshold(px, "image", 1.0, 64).collect()}
    for k in ("two", "skew"):
        v = np.log10(images[k][images[k] > 0])
        assert abs(np.log10(logs[k]) - min(K.otsu_threshold(v, 64), K.triangle_threshold(v, 64))) < 1e-9
    mask = T.log_mask(px, "image", 1.0, 64)
    assert mask.where("image = 'two'").count() == (images["two"] > logs["two"]).sum()
