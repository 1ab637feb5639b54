"""Cell and raster operators against brute force on small images."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytofold.operators import aggregate as A
from cytofold.operators import joins, network, pixels, raster, sets, tiles
from cytofold.sources import attention, tables
from tests.test_rasters import flood, shapes, table


def noisy(n=4, side=24, seed=3, share=0.45):
    rng = np.random.default_rng(seed)
    return [(rng.random((side, side)) < share).astype(float) for _ in range(n)]


def coordinates(rows, key="cell_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], set()).add((r["y"], r["x"]))
    return out


# --- labelling ---


@pytest.mark.parametrize("eight", [False, True])
def test_labels_across_squares(spark, eight):
    images = noisy()
    out = raster.label_pixels(table(spark, images), "cell_id", eight, block=5).collect()
    for k, img in enumerate(images):
        parts = {}
        for r in out:
            if r.cell_id == k:
                parts.setdefault(r.root, set()).add((r.y, r.x))
        assert sorted(map(sorted, parts.values())) == sorted(map(sorted, flood(img, not eight)))
        assert all(root == min(y * (1 << 20) + x for y, x in p) for root, p in parts.items())


def test_labels_of_any_key(spark):
    rows = [("a key", 0, 0), ("a key", 0, 1), ("a key", 9, 9), (None, 0, 0), ("b", 1 << 19, 1 << 19)]
    df = spark.createDataFrame([*rows, rows[0]], "k string, y int, x int")
    out = {(r.k, r.y, r.x): r.root for r in raster.label_pixels(df, "k", block=4).collect()}
    assert len(out) == 5 and out["a key", 0, 0] == out["a key", 0, 1] == 0 and out["b", 1 << 19, 1 << 19] == (1 << 39) + (1 << 19)
    big = spark.createDataFrame([((1 << 62) + 1, 3, 3), (1 << 62, 3, 4)], "k long, y int, x int")
    assert len({(r.k, r.root) for r in raster.label_pixels(big, "k").collect()}) == 2
    assert raster.label_pixels(df.limit(0), "k").count() == 0


def slow_open(img, steps):
    out = np.zeros_like(img)
    for y in range(-3, img.shape[0] + 3):
        for x in range(-3, img.shape[1] + 3):
            at = [(y + a, x + b) for a, b in steps]
            if all(0 <= v < img.shape[0] and 0 <= u < img.shape[1] and img[v, u] for v, u in at):
                for v, u in at:
                    out[v, u] = 1
    return out


def slow_close(img, steps):
    h, w = img.shape
    wide = np.zeros_like(img)
    for y, x in zip(*np.nonzero(img), strict=True):
        for a, b in steps:
            if 0 <= y + a < h and 0 <= x + b < w:
                wide[y + a, x + b] = 1
    inside = lambda v, u: 0 <= v < h and 0 <= u < w and wide[v, u]
    return np.array([[float(all(inside(y + a, x + b) for a, b in steps)) for x in range(w)] for y in range(h)])


def slow_fill(img):
    out = img.copy()
    ys, xs = np.nonzero(img)
    if not len(ys):
        return out
    y0, y1, x0, x1 = ys.min(), ys.max(), xs.min(), xs.max()
    for part in flood(1 - img[y0 : y1 + 1, x0 : x1 + 1], True):
        if not any(y in (0, y1 - y0) or x in (0, x1 - x0) for y, x in part):
            for y, x in part:
                out[y + y0, x + x0] = 1
    return out


def test_opening_closing_and_filling(spark):
    images = noisy(3, 16, 5, 0.6)
    px = table(spark, images)
    square = [(y, x) for y in range(2) for x in range(2)]
    for steps in (square, raster.disk(1)):
        got = coordinates(raster.opened(px, "cell_id", steps).collect())
        assert [got.get(k, set()) for k in range(3)] == [set(zip(*map(list, np.nonzero(slow_open(i, steps))), strict=True)) for i in images]
    got = coordinates(raster.closed(px, "cell_id", raster.disk(2)).collect())
    assert [got.get(k, set()) for k in range(3)] == [set(zip(*map(list, np.nonzero(slow_close(i, raster.disk(2)))), strict=True)) for i in images]
    got = coordinates(raster.fill_holes(px, "cell_id").collect())
    assert [got.get(k, set()) for k in range(3)] == [set(zip(*map(list, np.nonzero(slow_fill(i))), strict=True)) for i in images]


def test_cleaned_masks(spark):
    images = [np.kron(i, np.ones((3, 3))) for i in noisy(2, 10, 7, 0.55)]
    px = table(spark, images)
    square = [(y, x) for y in range(2) for x in range(2)]
    got = coordinates(raster.tubular_mask(px, "cell_id", 30, fill=True).collect())
    for k, img in enumerate(images):
        parts = [p for p in flood(slow_open(slow_fill(img), square), True) if len(p) >= 30]
        assert got.get(k, set()) == set().union(*parts)
    got = coordinates(raster.round_mask(px, "cell_id", 25, closing=2).collect())
    for k, img in enumerate(images):
        mask = slow_fill(slow_close(slow_open(img, raster.disk(1)), raster.disk(2)))
        parts = flood(mask, True)
        deep = [p for p in parts if any(all((y + a, x + b) in p for a, b in raster.disk(2)) for y, x in p)]
        assert got.get(k, set()) == set().union(*[p for p in deep or parts if len(p) >= 25])


def test_thresholds_of_objects(spark):
    rng = np.random.default_rng(4)
    img = np.zeros((30, 30))
    img[2:10, 2:12] = 50 + rng.integers(0, 30, (8, 10))
    img[4:7, 4:8] += 60
    img[15:28, 14:27] = 120 + rng.integers(0, 40, (13, 13))
    img[20:24, 18:22] += 80
    img[0, 29] = 200
    values = img + 1
    px = table(spark, [values])
    hist = raster.histogram(px, "cell_id")
    otsu = raster.otsu(hist, "cell_id").first().otsu
    triangle = raster.triangle(hist, "cell_id").first().triangle
    assert math.isclose(otsu, tiles.otsu_threshold(values.ravel())) and math.isclose(triangle, tiles.triangle_threshold(values.ravel()))
    assert math.isclose(raster.intensity_threshold(px, "cell_id", "ave").first().threshold, (otsu + triangle) / 2)
    assert raster.intensity_threshold(px, "cell_id", "median").first().threshold == np.median(values)
    got = coordinates(raster.masked_objects(px, "cell_id", "otsu", least=20).collect())[0]
    want = set()
    for part in flood(values > otsu, True):
        if len(part) >= 20:
            own = np.array([values[p] for p in part])
            want |= {p for p in part if values[p] > 0.98 * tiles.otsu_threshold(own)}
    assert got == want and want
    flat = table(spark, [np.full((3, 3), 7.0)])
    assert raster.intensity_threshold(flat, "cell_id").first().threshold == 7 and raster.above_threshold(flat, "cell_id").count() == 0
    with pytest.raises(ValueError):
        raster.intensity_threshold(px, "cell_id", "none")


def test_smoothing_and_ridges_equal_the_kernels(spark):
    rng = np.random.default_rng(12)
    images = [rng.normal(0, 1, (24, 19)), np.where(np.abs(np.arange(24)[:, None] - 0.5 * np.arange(30)[None, :] - 4) < 1.2, 9.0, 1.0)]
    px = table(spark, images)
    for order in ((0, 0), (2, 0), (0, 1), (1, 1)):
        out = {(r.cell_id, r.y, r.x): r.value for r in raster.smoothed(px, "cell_id", 1.3, order).collect()}
        for k, img in enumerate(images):
            want = tiles.gaussian(img, 1.3, order)
            assert np.allclose([[out[k, y, x] for x in range(img.shape[1])] for y in range(img.shape[0])], want, atol=1e-9)
    for bright in (True, False):
        out = {(r.cell_id, r.y, r.x): r.value for r in raster.ridges(px, "cell_id", (1.0, 1.5), bright=bright).collect()}
        for k, img in enumerate(images):
            want = tiles.vesselness(img, (1.0, 1.5), bright=bright)
            assert np.allclose([[out[k, y, x] for x in range(img.shape[1])] for y in range(img.shape[0])], want, atol=1e-6)


def test_equalisation_equals_the_kernel(spark):
    rng = np.random.default_rng(13)
    images = [rng.gamma(2, 20, (37, 29)).round(), rng.normal(9, 1, (8, 8)), np.full((5, 7), 4.0)]
    out = {(r.cell_id, r.y, r.x): r.value for r in raster.equalised(table(spark, images), "cell_id", block=12, clip=0.05, bins=32).collect()}
    for k, img in enumerate(images):
        want = tiles.equalised(img, 12, 0.05, 32)
        assert np.allclose([[out[k, y, x] for x in range(img.shape[1])] for y in range(img.shape[0])], want, atol=1e-9)


def test_skeletons_equal_the_kernel(spark):
    images = [*noisy(2, 20, 15, 0.8), np.kron(noisy(1, 6, 16, 0.6)[0], np.ones((4, 4))), np.pad(np.ones((5, 14)), 2), np.ones((1, 1))]
    got = coordinates(raster.thinned(table(spark, images), "cell_id").collect())
    for k, img in enumerate(images):
        assert got.get(k, set()) == set(zip(*map(list, np.nonzero(tiles.thinned(img))), strict=True))


def test_three_classes_and_dark_blobs(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(20, 4, 200), rng.normal(90, 6, 150), rng.normal(160, 5, 100)]).round().reshape(18, 25)
    px = table(spark, [values, np.full((3, 3), 2.0)])
    hist = raster.histogram(px, "cell_id", bins=32)
    out = {r.cell_id: r for r in raster.multi_otsu(hist, "cell_id").collect()}
    n, edge = np.histogram(values, 32)
    c = (edge[:-1] + edge[1:]) / 2
    spread = {(a, b): sum((n[k] * c[k]).sum() ** 2 / n[k].sum() for k in (slice(0, a + 1), slice(a + 1, b + 1), slice(b + 1, None))) for a in range(31) for b in range(a + 1, 31) if n[a] and n[b] and n[b + 1 :].sum()}
    a, b = max(spread, key=lambda k: (round(spread[k], 6), -k[0], -k[1]))
    assert math.isclose(out[0].low, c[a]) and math.isclose(out[0].high, c[b]) and out[1].low is None
    assert math.isclose(raster.intensity_threshold(px, "cell_id", "multiotsu", 32).where("cell_id = 0").first().threshold, c[a])
    img = np.full((21, 21), 9.0)
    img[8:13, 8:13] = 1
    assert tiles.blobs(img, (2.0,), 0.2, dark=True)[10, 10] > 0 and tiles.blobs(img, (2.0,), 0.2, stretch=True)[10, 10] == 0
    assert tiles.stretched(np.ones((2, 2))).sum() == 0


def test_tile_kernels_by_brute_force():
    for img in [*noisy(3, 17, 9, 0.7), np.ones((5, 6)), np.zeros((4, 4))]:
        mask = img > 0
        back = np.argwhere(~mask)
        far = img.shape[0] + img.shape[1]
        want = np.array([[0 if not mask[y, x] else min([math.hypot(y - a, x - b) for a, b in back], default=far) for x in range(img.shape[1])] for y in range(img.shape[0])])
        assert np.allclose(tiles.edge_distance(img), want)
        labels = tiles._labelled(mask)
        parts = flood(img, False)
        assert labels.max() == len(parts) and all(len({labels[p] for p in part}) == 1 for part in parts)
        firsts = [min(np.flatnonzero(labels.ravel() == k)) for k in range(1, labels.max() + 1)]
        assert firsts == sorted(firsts)


# --- shapes ---


def slow_hull(pixels_):
    points = sorted({p for y, x in pixels_ for p in ((2 * y - 1, 2 * x), (2 * y + 1, 2 * x), (2 * y, 2 * x - 1), (2 * y, 2 * x + 1))})
    sides = []
    for a in points:
        for b in points:
            if a != b:
                turn = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in points]
                if min(turn) >= 0:
                    sides.append((a, b))
    ys, xs = [y for y, _ in pixels_], [x for _, x in pixels_]
    inside = lambda y, x: all((b[0] - a[0]) * (2 * x - a[1]) - (b[1] - a[1]) * (2 * y - a[0]) >= 0 for a, b in sides)
    return sum(inside(y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1))


def test_convex_area(spark):
    images = [*shapes(), *noisy(3, 9, 11, 0.2)]
    out = {r.cell_id: r.area_convex for r in pixels.area_convex(table(spark, images)).collect()}
    for k, img in enumerate(images):
        assert out[k] == slow_hull(list(zip(*map(list, np.nonzero(img)), strict=True)))
    assert out[1] == 28 and pixels.area_convex(table(spark, images).limit(0)).count() == 0


def test_crofton_and_orientation(spark):
    images = [np.ones((1, 1)), np.ones((2, 9)), np.ones((9, 2)), np.eye(6), np.eye(6)[::-1].copy()]
    out = {r.cell_id: r for r in pixels.shape(table(spark, images)).join(pixels.perimeter_crofton(table(spark, images)), list(pixels.OBJECT)).collect()}
    assert math.isclose(out[0].perimeter_crofton, math.pi / 4 * (2 + math.sqrt(2)))
    assert math.isclose(abs(out[1].orientation), math.pi / 2) and math.isclose(out[2].orientation, 0, abs_tol=1e-9)
    assert math.isclose(out[3].orientation, math.pi / 4) and math.isclose(out[4].orientation, -math.pi / 4)


def test_cell_features_of_the_first_part(spark):
    img = np.zeros((12, 12))
    img[1:6, 1:9] = 1
    img[9:11, 9:11] = 1
    px = table(spark, [img]).withColumn("organelle", F.lit("cell"))
    (row,) = pixels.cell_features(px, "cell", 0.5, 0.5).collect()
    assert row.cell_area == 40 * 0.25 and row.cell_solidity == 1 and row.cell_extent == 1
    assert math.isclose(row.cell_perimeter, 0.5 * (2 * (5 + 8) - 4)) and math.isclose(abs(row.cell_orientation), math.pi / 2)
    assert math.isclose(row.cell_circularity, 4 * math.pi * 10 / 11**2) and row.cell_hu_moment_0 > 0
    assert pixels.cell_features(px.limit(0)).count() == 0


# --- cells of a known form: disks, and squares that overlap ---


def known_cell(spark):
    yy, xx = np.indices((80, 80))
    radius = np.hypot(yy - 40, xx - 40)
    masks = {"cell": radius < 38, "nucleus": radius < 8, "organelleA": np.zeros((80, 80), bool), "organelleB": np.zeros((80, 80), bool)}
    rows = [("c", o, 1, int(y), int(x)) for o in ("cell", "nucleus") for y, x in np.argwhere(masks[o])]
    for o, label, y0, y1, x0, x1 in (("organelleA", 1, 20, 26, 20, 26), ("organelleA", 2, 54, 60, 54, 60), ("organelleB", 1, 23, 29, 23, 29), ("organelleB", 2, 10, 14, 40, 44)):
        rows += [("c", o, label, y, x) for y in range(y0, y1) for x in range(x0, x1)]
    return spark.createDataFrame([(*r, 1.0, 80, 80) for r in rows], "cell_id string, organelle string, label int, y int, x int, value double, height int, width int")


def test_location_in_a_known_cell(spark):
    px, s = known_cell(spark), 0.325
    out = {(r.organelle, r.label): r for r in pixels.localized(px, "cell", "nucleus", s, s).collect()}
    assert len(out) == 4
    yy, xx = np.indices((80, 80))

    def rim(r):
        mask = np.hypot(yy - 40, xx - 40) < r
        return np.argwhere(mask & ~(np.roll(mask, 1, 0) & np.roll(mask, -1, 0) & np.roll(mask, 1, 1) & np.roll(mask, -1, 1)))

    for key, (cy, cx) in {("organelleA", 1): (22.5, 22.5), ("organelleB", 2): (11.5, 41.5)}.items():
        r = out[key]
        edge, nucleus = (s * np.hypot(*(rim(k) - (cy, cx)).T).min() for k in (38, 8))
        assert math.isclose(r.distance_from_cell_edge, edge) and math.isclose(r.distance_from_nucleus, nucleus)
        assert math.isclose(r.distance_from_nucleus_centroid, s * math.hypot(cy - 40, cx - 40)) and math.isclose(r.angle_from_nucleus, math.atan2(cy - 40, cx - 40))
        assert math.isclose(r.normalized_radial_position, nucleus / (nucleus + edge))
    none = pixels.localized(px.where("organelle <> 'nucleus'"), "cell", "nucleus").first()
    assert none.distance_from_nucleus is None and none.normalized_radial_position is None and none.distance_from_cell_edge is not None
    one = pixels.localization_summary(pixels.localized(px.where("organelle <> 'organelleA' or label = 1"), "cell", "nucleus")).where("organelle = 'organelleA'").collect()
    assert len(one) == 4 and all(r["count"] == 1 and r["std"] == 0 and r["mean"] == r["median"] == r["min"] == r["max"] == r["sum"] for r in one)


def test_contacts_of_a_known_cell(spark):
    px = known_cell(spark).where("organelle like 'organelle%'")
    (row,) = pixels.contacts(px, 0.325, 0.325).collect()
    assert math.isclose(row.overlap_area, 9 * 0.325**2) and math.isclose(row.overlap_frac_a, 9 / 72) and math.isclose(row.overlap_frac_b, 9 / 52)
    assert [r.n_contacts for r in pixels.contact_sites(px).collect()] == [1]
    with pytest.raises(ValueError, match="different shapes"):
        pixels.contacts(px.withColumn("height", F.when(F.col("organelle") == "organelleA", 20).otherwise(30)))
    assert pixels.contacts(px.where("organelle = 'organelleA'")).count() == 0


def test_networks_by_object(spark):
    skeleton = spark.createDataFrame([("c", "o", 1, 0, x) for x in range(4)] + [("c", "o", 2, 5, 5)], "cell_id string, organelle string, component int, y int, x int")
    objects = spark.createDataFrame([("c", "o", 0, x, 7 if x < 2 else 8) for x in range(4)], "cell_id string, organelle string, y int, x int, label int")
    labels = network.component_labels(skeleton, objects)
    assert [tuple(r) for r in labels.collect()] == [("c", "o", 1, 7)]  # a tie, and a component outside all objects
    branches = spark.createDataFrame([("c", "o", 1, 0, 1, 1, 3.0, 3.0, 1.0), ("c", "o", 1, 1, 2, 2, 4.0, 2.0, 3.0)], "cell_id string, organelle string, component int, src int, dst int, kind int, length double, chord double, thickness double")
    (row,) = network.object_networks(branches, labels).collect()
    assert (row.label, row.num_branches, row.num_nodes, row.num_endpoints) == (7, 2, 3, 0) and math.isclose(row.average_degree, 4 / 3)
    assert row.branch_length == 3.5 and row.branch_thickness == 2 and row.tortuosity == 1.5
    px = skeleton.select("cell_id", "y", "x")
    assert [tuple(r) for r in network.skeleton_counts(px, "cell_id").collect()] == [("c", 5, 2)]
    assert network.without_specks(px, "cell_id").count() == 4


# --- sources and joins ---


def test_attention_layouts(spark):
    old = spark.createDataFrame([("e1", "A1", "7", "g", "er", 1, 5), ("e1", "A1", "x", "g", "er", 1, 500)], "experiment string, well string, segmentation string, gene string, viz_channel string, channel_rank int, rank int")
    new = spark.createDataFrame(
        [("e2", "A/2", "8.0", "g", "b", "top", 2), ("e2", "A/2", "9", "g", "a", "top", 2), ("e2", "A/2/0", "10.5", "g", "c", "bottom", 1)],
        "experiment string, well string, segmentation string, gene string, channel string, rank_type string, rank int",
    )
    out = attention.attention_table([attention.attention_rows(old, "fluorescent", 100), attention.attention_rows(new, "fluorescent", 100)])
    got = sorted((r.viz_channel, r.channel_rank, r.segmentation, r.well_canonical) for r in out.collect())
    assert got == [("a", 2, 9, "A/2/0"), ("b", 3, 8, "A/2/0"), ("c", 1, None, "A/2/0"), ("er", 1, 7, "A/1/0")]
    control = attention.attention_rows(new.drop("gene"), "phase", 100, control=True).collect()
    assert len(control) == 2 and all(r.gene == "NTC" and r.viz_channel == "Phase" and r.channel_rank == 1 for r in control)
    with pytest.raises(ValueError):
        attention.attention_table([])


def test_label_metadata_and_failures(spark, tmp_path):
    labels = spark.createDataFrame([("p", "er_seg", "frangi", 2.0, None, 5), ("p", "x", "blob", None, None, None)], "position string, label string, method string, sigma double, size double, n_objects long")
    assert [tuple(r) for r in attention.label_metadata(labels, ["sigma", "size"]).collect()] == [("p", "er_seg", "er", "frangi", '{"sigma":2.0}', 5), ("p", "x", "x", "blob", "{}", 0)]
    runs = spark.createDataFrame([("e", "a", 1, "COMPLETED"), ("e", "b", 2, "FAILED"), ("e", "b", 2, "FAILED"), ("e", "c", 3, None)], "experiment string, phase string, base_job_id int, state string")
    attention.write_failures(runs, str(tmp_path / "f"))
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()) == [("e", "b", "2"), ("e", "c", "3")]


def test_checks_that_must_fail(spark):
    cells = spark.createDataFrame([("e", "a", 1.0), ("e", "z", None)], "experiment string, channel string, v double")
    known = spark.createDataFrame([("e", "a", "gfp")], "experiment string, channel string, physical string")
    assert joins.resolve_channel(cells, known, "experiment", "channel").count() == 2 and joins.resolve_channel(cells, known, "experiment", "channel", "drop").count() == 1
    with pytest.raises(ValueError, match="'z'"):
        joins.resolve_channel(cells, known, "experiment", "channel", "fail")
    boxes = spark.createDataFrame([(1, None), (2, None)], "id int, box string")
    with pytest.raises(ValueError):
        tables.require_boxes(boxes, "box")
    assert tables.require_boxes(boxes.limit(0), "box").count() == 0
    long = spark.createDataFrame([("a", "a"), (None, "a")], "channel string, bucket string")
    with pytest.raises(Exception, match="no channel"):
        sets.own_channel_features(long, "channel", "bucket").collect()


def test_metadata_and_configuration(spark, tmp_path):
    features = spark.createDataFrame([(1, 2.0, "old"), (2, None, "old")], "cell_id long, f double, well string")
    meta = spark.createDataFrame([("1", "new")], "cell_id string, well string")
    assert sorted(tuple(r) for r in joins.attach_metadata(features, meta, "cell_id", 0.0).collect()) == [("1", 2.0, "new"), ("2", 0.0, None)]
    (tmp_path / "c.yaml").write_text("e1:\n  - channel: GFP\n    label: er\n")
    assert tables.read_yaml(spark, str(tmp_path / "c.yaml")) == {"e1": [{"channel": "GFP", "label": "er"}]}
    rows = spark.range(100)
    from cytofold.operators.ranking import preview_rows

    assert preview_rows(rows, ["id"], 7).collect() == preview_rows(rows.repartition(5), ["id"], 7).collect()


def test_nearest_edge_pixels_by_brute_force(spark):
    rng = random.Random(5)
    centres = [(f"c{k % 7}", "o", k, rng.uniform(0, 50), rng.uniform(0, 50)) for k in range(60)] + [("none", "o", 1, 1.0, 1.0)]
    edges = [(f"c{k % 7}", rng.randint(0, 50), rng.randint(0, 50)) for k in range(300)]
    c = spark.createDataFrame(centres, "cell_id string, organelle string, label int, centroid_y double, centroid_x double")
    e = spark.createDataFrame(edges, "cell_id string, y int, x int")
    got = {(r.cell_id, r.label): r.d for r in pixels.edge_distances(c, e, "d", 1.0, 0.5).collect()}
    want = {(i, n): min(math.hypot(y - a, x - 0.5 * b) for j, a, b in edges if j == i) for i, _, n, y, x in centres if i != "none"}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("hot_rows", [None, 40, 1_000_000])
def test_statistics_of_groups_of_all_sizes(spark, hot_rows):
    from cytofold.operators import aggregate

    rng = random.Random(6)
    rows = [(rng.choice("aaaaaabc"), k % 2, rng.choice([None, 1.0, 1.0, rng.gauss(0, 1e3), float(k)])) for k in range(901)]
    rows += [("same", 0, 3.0)] * 300 + [("one", 1, 5.0), ("none", 1, None), (None, 0, 1.0)] + [("even", 0, float(k)) for k in range(100)]
    out = aggregate.summarise(spark.createDataFrame(rows, "g string, h int, value double"), ["g", "h"], (*aggregate.SIX, "count"), hot_rows=hot_rows)
    got = {(r.g, r.h): r for r in out.collect()}
    want = {}
    for g, h, v in rows:
        if g is not None:
            want.setdefault((g, h), []).append(v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        v, r = [x for x in values if x is not None], got[key]
        assert r["count"] == len(v) and (r.median is None if not v else math.isclose(r.median, float(np.median(v)), abs_tol=1e-12))
        assert r["sum"] is None if not v else math.isclose(r["sum"], sum(v), abs_tol=1e-9) and r["min"] == min(v) and r["max"] == max(v)


def test_quantile_with_an_outlier_narrows_again(spark):
    rng = np.random.default_rng(14)
    values = np.r_[rng.random(30_001), 1e12, -5.0, [0.25] * 500]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("two", None)], "k string, value double").repartition(4)
    for q in (0.5, 0.1, 0.999):
        got = {r.k: r.quantile for r in A.narrowed_quantile(df, ["k"], q=q, bins=64).collect()}
        assert math.isclose(got["k"], np.quantile(values, q)) and got["one"] == 3 and math.isclose(got["two"], 1 + q)


def test_summary_with_a_hot_group(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), (F.col("id") * 7919 % 3001).cast("double").alias("value"))
    plain = {r.k: r for r in A.summarise(df, ["k"], hot_rows=None).collect()}
    split = {r.k: r for r in A.summarise(df, ["k"], hot_rows=500).collect()}
    assert plain.keys() == split.keys() and all(math.isclose(plain[k][c], split[k][c]) for k in plain for c in A.SIX)


def test_star_with_the_largest_node_as_centre(spark, monkeypatch):
    from cytofold.operators import graph

    monkeypatch.setattr(graph, "HUBS_FROM", 100)
    edges = spark.range(2_000).select(F.lit(5_000).cast("long").alias("src"), F.col("id").alias("dst")).unionByName(spark.range(3).select((F.col("id") + 6_000).alias("src"), (F.col("id") + 6_001).alias("dst")))
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(2_000)} | {5_000: 0} | {k: 6_000 for k in range(6_000, 6_004)}


def test_ranks_and_caps_of_hot_keys_are_split(spark, monkeypatch):
    from pyspark.sql import Window

    from cytofold.operators import ranking as R

    rows = spark.range(6_000).select((F.col("id") * 7919 % 6007).alias("v"), F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 3 == 0, "h").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k")).repartition(6)
    plain = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"))))
    got = R.rank_in(rows, ["k"], F.desc("v"), hot_rows=500)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    monkeypatch.setattr(R, "SMALL_CAP", 100)
    capped = R.keep_first(rows, ["k"], F.desc("v"), n=700)
    assert sorted(map(str, capped.collect())) == sorted(map(str, plain.where("rank <= 700").drop("rank").collect()))
    assert R.rank_in(rows.where("false"), ["k"], "v", hot_rows=5).collect() == []
