import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.operators import aggregate, pixels, ranking, raster, tiles


def table(spark, images):
    rows = [(k, "o", 1, int(y), int(x), float(img[y, x]), *img.shape, k) for k, img in enumerate(images) for y, x in zip(*np.nonzero(img), strict=True)]
    return spark.createDataFrame(rows, "cell_id long, organelle string, label int, y int, x int, value double, height int, width int, object_id long")


def shapes():
    ring = np.zeros((9, 9))
    ring[1:8, 1:8] = 1
    ring[3:6, 3:6] = 0
    ring[4, 4] = 1
    two = np.zeros((6, 6))
    two[0:2, 0:2] = two[2:5, 2:5] = 1
    return [np.ones((1, 1)), np.ones((4, 7)), ring, two, np.pad(np.eye(5), 1)]


def flood(mask, four):
    left, parts = {(y, x) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        stack, own = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            own.add((y, x))
            near = [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (abs(a) + abs(b) == 1 if four else a or b)]
            for p in near:
                if p in left:
                    left.remove(p)
                    stack.append(p)
        parts.append(own)
    return parts


def test_euler_and_filled_area(spark):
    px = table(spark, shapes())
    euler = {r.cell_id: r.euler_number for r in pixels.euler_number(px).collect()}
    filled = {r.object_id: (r.n, r.n_filled) for r in pixels.area_filled(px).collect()}
    for k, img in enumerate(shapes()):
        holes = [p for p in flood(np.pad(img, 1) == 0, True) if (0, 0) not in p]
        assert euler[k] == len(flood(img, False)) - len(holes)
        assert filled[k] == (int(img.sum()), int(img.sum()) + sum(map(len, holes)))


def test_perimeter_of_a_rectangle(spark):
    got = {r.cell_id: r.perimeter for r in pixels.perimeter(table(spark, shapes())).collect()}
    assert got[1] == 2 * (3 + 6)  # sides between corner centres
    assert got[0] == 0


def test_labels_erosion_dilation(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((10, 12)) > 0.5 for _ in range(4)]
    px = table(spark, images)
    for eight in (False, True):
        rows = raster.label_pixels(px, "cell_id", eight).collect()
        for k, img in enumerate(images):
            groups = {}
            for r in rows:
                if r.cell_id == k:
                    groups.setdefault(r.root, set()).add((r.y, r.x))
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, flood(img, not eight)))
    small = {(r.cell_id, r.y, r.x) for r in raster.erode(px, "cell_id", 1).collect()}
    large = {(r.cell_id, r.y, r.x) for r in raster.dilate(px, "cell_id", 1).collect()}
    for k, img in enumerate(images):
        wide = np.pad(img, 1)
        win = np.stack([wide[1 + a : 11 + a, 1 + b : 13 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        assert {(y, x) for c, y, x in small if c == k} == set(zip(*np.nonzero(win.all(0)), strict=True))
        assert {(y, x) for c, y, x in large if c == k} == set(zip(*np.nonzero(win.any(0)), strict=True))


def test_polygon_and_fractal(spark):
    points = spark.createDataFrame([(1, k, y, x) for k, (y, x) in enumerate([(0, 0), (0, 4), (3, 4), (3, 0)])], "m long, i int, y int, x int")
    assert pixels.polygon_area(points, ["m"]).first().mesh_area == 12
    full = table(spark, [np.ones((32, 32))])
    assert pixels.fractal_dimension(full).first().fractal_dimension == pytest.approx(2.0)
    assert pixels.fractal_dimension(table(spark, [np.ones((8, 8))])).first().fractal_dimension is None


def test_weighted_hu_ignores_place_and_quarter_turns(spark):
    rng = np.random.default_rng(2)
    img = np.zeros((12, 12))
    img[2:8, 3:9] = rng.random((6, 6)) + 0.1
    rows = pixels.weighted_hu(table(spark, [img, np.roll(img, (3, 2), (0, 1)), np.rot90(img)])).orderBy("cell_id").collect()
    for k in range(7):
        a, b, c = (r[f"moments_weighted_hu_{k}"] for r in rows)
        assert a == pytest.approx(b, rel=1e-6, abs=1e-15) and abs(a) == pytest.approx(abs(c), rel=1e-6, abs=1e-15)


def test_kernels():
    rng = np.random.default_rng(3)
    flat = np.full((20, 20), 3.0)
    assert np.allclose(tiles.gaussian(flat, 2), 3) and np.allclose(tiles.gaussian(flat, 2, (2, 0)), 0, atol=1e-2)
    ramp = np.tile(np.arange(30.0), (30, 1))
    assert np.allclose(tiles.gaussian(ramp, 1.5, (0, 1))[10:20, 10:20], 1, atol=1e-2)
    line = np.zeros((31, 31))
    line[15] = 1
    v = tiles.vesselness(tiles.gaussian(line, 1))
    assert v[15].min() > 10 * v[5].max() and not tiles.vesselness(-line).any() or v[15].min() > 0
    e = tiles.equalised(rng.random((50, 70)), 16)
    assert e.shape == (50, 70) and 0 <= e.min() and e.max() <= 1 + 1e-9
    both = np.r_[rng.normal(0, 0.3, 500), rng.normal(5, 0.3, 300)]
    assert 0.5 < tiles.otsu_threshold(both) < 4.5 and 0.5 < tiles.li_threshold(both) < 4.5
    mask = rng.random((15, 17)) > 0.3
    back = np.argwhere(~mask)
    want = np.array([[0 if not mask[y, x] else min(math.hypot(y - a, x - b) for a, b in back) for x in range(17)] for y in range(15)])
    assert np.allclose(tiles.edge_distance(mask), want)
    bar = np.zeros((9, 20))
    bar[3:6, 2:18] = 1
    skeleton = tiles.thinned(bar)
    assert skeleton.any(axis=0).sum() >= 13 and skeleton.sum(axis=0).max() == 1
    disks = np.zeros((20, 34))
    yy, xx = np.indices(disks.shape)
    disks[(yy - 10) ** 2 + (xx - 10) ** 2 <= 64] = 1
    disks[(yy - 10) ** 2 + (xx - 23) ** 2 <= 64] = 1
    apart = tiles.split_touching(disks)
    assert apart[10, 5] != apart[10, 28] and ((apart > 0) == (disks > 0)).all()
    spots = np.zeros((40, 40))
    spots[10, 10] = spots[28, 25] = 30
    found = tiles.blobs(tiles.gaussian(spots, 2), (1.5, 2.0, 3.0), 0.05)
    assert found[10, 10] != found[28, 25] and found[10, 10] and found[28, 25]


def test_branches(spark):
    cross = np.zeros((11, 11))
    cross[5, 1:10] = cross[1:10, 5] = 1
    frame = np.zeros((9, 9))
    frame[1:8, 1:8] = 1
    frame[2:7, 2:7] = 0
    df = spark.createDataFrame([(0, 11, 11, cross.ravel().tolist()), (1, 9, 9, frame.ravel().tolist()), (2, 3, 3, None)], "tile long, height int, width int, pixels array<double>")
    rows = tiles.branch_table(df).collect()
    assert sum(r.kind == 1 for r in rows if r.tile == 0) == 4
    assert [r.kind for r in rows if r.tile == 1] == [3] and [r.chord for r in rows if r.tile == 1] == [0.0]
    smooth = tiles.map_tiles(df, tiles.gaussian, sigma=1.0).orderBy("tile").collect()
    assert np.allclose(smooth[0].pixels, tiles.gaussian(cross, 1.0).ravel()) and smooth[2].pixels is None


def test_seeded_choices_and_checks(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(90)], "g int, id long")
    once = {tuple(r) for r in ranking.seeded_sample(rows, ["g"], ["id"], 5).collect()}
    more = rows.unionByName(spark.createDataFrame([(9, 1)], "g int, id long"))
    again = {tuple(r) for r in ranking.seeded_sample(more.repartition(5), ["g"], ["id"], 5).where("g < 9").collect()}
    assert once == again and len(once) == 15
    px = rows.crossJoin(spark.range(4).select(F.col("id").alias("p")))
    assert ranking.limit_objects(px, ["g"], "id", 2).count() == 3 * 2 * 4
    with pytest.raises(ValueError):
        aggregate.require_unique(rows, ["g"])
    bad = {r["check"]: r.n_bad for r in aggregate.check_outputs(rows, ["g"], ["g", "nope"], "g", "g", 20).collect()}
    assert bad == {"missing_columns": 1, "duplicate_keys": 3, "extra_channels": 2, "groups_over_cap": 3}
