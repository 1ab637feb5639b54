"""Branches of pixel tables against a walk over one tile at a time."""

import numpy as np
import pytest

from cytofold.operators import skeleton as S
from cytofold.operators import tiles as K
from tests.test_relief import pixels_of, random_mask


def shapes():
    ring = np.zeros((12, 12), bool)
    ring[2, 3:9] = ring[9, 3:9] = ring[3:9, 2] = ring[3:9, 9] = True
    tail = np.zeros((12, 30), bool)
    tail[:, :12] = ring
    tail[5, 9:28] = True
    cross = np.zeros((9, 9), bool)
    cross[4] = cross[:, 4] = True
    dots = np.zeros((8, 8), bool)
    dots[1, 1] = dots[5, 5] = dots[5, 6] = True
    long = np.zeros((6, 700), bool)
    long[1] = True
    long[0, 350] = True
    return {"ring": ring, "tail": tail, "cross": cross, "dots": dots, "long": long} | {f"r{k}": K.thinned(random_mask(30 + k, share=0.4).astype(float)) for k in range(3)}


@pytest.mark.parametrize("wide", [False, True])
def test_branches(spark, wide):
    images = shapes()
    masks = {k: np.pad(i, 1)[:-2, 1:-1] | i | np.pad(i, 1)[2:, 1:-1] for k, i in images.items()} if wide else images
    got = S.branches(pixels_of(spark, images), "image", pixels_of(spark, masks)).collect()
    for k, img in images.items():
        code = lambda p: (p // img.shape[1] << 20) + p % img.shape[1]
        depth = K.edge_distance(masks[k].astype(float))
        part = K._labelled(img)
        first = {int(n): min((int(y) << 20) + int(x) for y, x in np.argwhere(part == n)) for n in np.unique(part[part > 0])}
        real, K_thinned, K_depth = [], K.thinned, K.edge_distance
        K.thinned, K.edge_distance = (lambda i: i > 0), (lambda i: depth)
        try:
            real = K.branches_of(img.astype(float))
        finally:
            K.thinned, K.edge_distance = K_thinned, K_depth
        expected = sorted((code(a), code(b), kind, round(n, 6), round(c, 6), first[p], round(t, 6)) for a, b, kind, n, c, t, p in real)
        mine = sorted((r.src, r.dst, r.kind, round(r.length, 6), round(r.chord, 6), r.component, round(r.thickness, 6)) for r in got if r.image == k)
        assert mine == expected, k


def test_branches_scaled_and_empty(spark):
    px = pixels_of(spark, {"x": np.eye(5, dtype=bool)})
    (row,) = S.branches(px, "image", sy=3.0, sx=4.0).collect()
    assert (row.kind, row.length, row.chord, row.src, row.dst) == (0, 20.0, 20.0, 0, (4 << 20) + 4)
    assert S.branches(px.where("false"), "image").collect() == []
