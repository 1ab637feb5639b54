"""One small case for each finding of a review that would have failed before."""

import builtins
import dis
import importlib
import math
import pkgutil
import random
import types

import numpy as np
import pytest

import cytofold
from cytofold import catalog
from cytofold.operators import graph, joins, pixels, relief
from cytofold.operators.graph import spread
from cytofold.plans import relief_queries

SF = "/root/testdata/sf0.001"


def test_edge_distances_are_roots_of_squares(spark):
    ys, xs = (g.ravel() / 3 for g in np.meshgrid(np.arange(40), np.arange(40)))
    differ = np.flatnonzero(np.hypot(ys, xs) != np.sqrt(ys * ys + xs * xs))[:50]
    assert len(differ)
    c = spark.createDataFrame([("c", "o", int(k), float(ys[k]), float(xs[k])) for k in differ], "cell_id string, organelle string, label int, centroid_y double, centroid_x double")
    e = spark.createDataFrame([("c", 0, 0)], "cell_id string, y int, x int")
    got = {r.label: r.d for r in pixels.edge_distances(c, e, "d").collect()}
    assert got == {int(k): math.sqrt(ys[k] * ys[k] + xs[k] * xs[k]) for k in differ}


def test_label_names_carry_the_marker(spark):
    out = catalog.QUERIES["p21_label_names"](spark, SF)
    assert "c_mktsegment AS marker" in catalog.ORACLES["p21_label_names"]
    assert out.where("marker is not null").count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["a04_cells_to_guides", "a05_cells_to_channels", "a06_cells_to_genes"])
def test_statistics_of_groups_read_the_objects_once(spark, name):
    assert not [f for f in catalog.QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]


def test_objects_are_made_long_after_their_aggregate(spark):
    plan = _plan(catalog.QUERIES["a08_long_statistics"](spark, SF))
    assert 0 <= plan.find("Generate") < plan.find("Aggregate")


def test_branches_are_spread_by_their_number(spark):
    assert "RepartitionByExpression" in _plan(catalog.QUERIES["a03_branches_to_cells"](spark, SF))
    assert spread(spark.range(1_000), 1_000, "id", per_task=100).rdd.getNumPartitions() == 10


def test_affected_experiments_do_not_gather_their_rows(spark):
    plan = catalog.QUERIES["p27_unit_correction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_crowded_points_are_met_in_small_cells(spark):
    rng = random.Random(3)
    at = lambda: (rng.randint(0, 1), round(rng.gauss(50, 15), 1), round(rng.gauss(0, 9), 1))
    queries, points = [(k, *at()) for k in range(300)], [(k, *at()) for k in range(1_500)]
    schema = "{} long, g int, x double, y double"
    q, p = spark.createDataFrame(queries, schema.format("query_id")), spark.createDataFrame(points, schema.format("point_id"))
    out = joins.nearest_within(q, p, ["g"], 20.0)
    want = {}
    for k, g, x, y in queries:
        best = min((math.sqrt((x - b) ** 2 + (y - c) ** 2), i) for i, a, b, c in points if a == g)
        if best[0] <= 20.0:
            want[k] = best
    got = {r.query_id: (r.distance, r.point_id) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=1e-12) for k in want)
    # the levels before the last are done
    assert _plan(out).count("Union") == 1


def test_pixels_of_images_are_spread_before_they_are_made(spark):
    assert _plan(relief_queries._plots(spark, SF)).count("RepartitionByExpression") == 2
    out = catalog.QUERIES["fn07_distance"](spark, SF)
    assert _plan(out).count("RepartitionByExpression") == 2 and not out.inputFiles()


def test_hulls_and_corners_are_counted_many_objects_at_a_time(spark):
    convex, euler = (_plan(catalog.QUERIES[q](spark, SF)) for q in ("fm10_area_convex", "fm10_euler_number"))
    assert "MapInArrow" in convex and "FlatMapGroupsInPandas" not in convex
    # the pixels are made, the corners of all are not
    assert euler.count("Generate") == 2 and "RepartitionByExpression" in euler


def test_components_across_ranges(spark):
    rng = random.Random(8)
    pairs = [(k, k + rng.choice((0, 1, 2, 3, 60))) for k in rng.sample(range(2_000), 1_100)] + [(5, 1_999), (2_500, 7), (2_500, 9), (3_000, 3_000), (7, None)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if b is not None:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for per_task in (100, 10_000):
        got = graph.connected_components_in_ranges(edges, per_task=per_task).collect()
        assert len(got) == len(parent) and {r.node: r.component for r in got} == {a: root(a) for a in parent}
    assert graph.connected_components_in_ranges(edges.limit(0)).count() == 0


def _global_names(code):
    yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            yield from _global_names(inner)


def test_functions_name_only_what_their_module_has():
    missing = []
    for found in pkgutil.walk_packages(cytofold.__path__, "cytofold."):
        module = importlib.import_module(found.name)
        known = vars(module) | vars(builtins)
        missing += [(found.name, n) for n in _global_names(compile(open(module.__file__).read(), module.__file__, "exec")) if n not in known]
    assert not missing


def test_spread_medians_of_the_objects(spark):
    out = {r.organelle: r.n_features for r in catalog.QUERIES["a19_spread_medians"](spark, SF).collect()}
    assert out and set(out.values()) == {4}


def test_metadata_of_orders_join_their_objects(spark):
    out = catalog.QUERIES["j01_attach_metadata"](spark, SF)
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert out.count() == orders and 0 < out.where("priority is null").count() < orders


def test_angles_are_those_of_sql(spark):
    # Java's atan2 puts both into the next wedge
    c = spark.createDataFrame([("c", "o", 1, 2.4444444444444446, 0.4444444444444444), ("d", "o", 1, 0.4, 1.35)], "cell_id string, organelle string, label int, centroid_y double, centroid_x double")
    n = spark.createDataFrame([("c", 5, 3), ("c", 6, 3), ("c", 6, 4), ("d", 0, 6), ("d", 1, 6)], "cell_id string, y int, x int")
    got = {r.cell_id: r.angle_from_nucleus for r in pixels.nucleus_direction(c, n, 0.5, 0.25).collect()}
    assert got == {"c": math.atan2(2.4444444444444446 - 17 / 6, 0.4444444444444444 - 10 / 12), "d": math.atan2(0.4 - 0.25, 1.35 - 1.5)}


def _jobs(spark, run) -> int:
    """How many jobs ``run`` starts."""
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_objects_are_split_in_few_jobs(spark):
    assert _jobs(spark, lambda: catalog.QUERIES["i18_split_objects"](spark, SF).count()) < 25


def test_maxima_are_found_in_few_jobs(spark):
    assert _jobs(spark, lambda: catalog.QUERIES["i18_h_maxima"](spark, SF).count()) < 25


def _masks(spark):
    draw = np.random.default_rng(11)
    yy, xx = np.indices((40, 60))
    disks = np.zeros((40, 60), bool)
    for y, x, r in zip(draw.integers(0, 40, 25), draw.integers(0, 60, 25), draw.integers(2, 6, 25), strict=True):
        disks |= (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    masks = {"disks": disks, "dense": draw.random((40, 60)) < 0.93, "sparse": draw.random((40, 60)) < 0.4, "full": np.ones((9, 9), bool)}
    rows = [(k, int(y), int(x), *m.shape) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    # some twice, some without a place
    return spark.createDataFrame([*rows, *rows[::7], ("disks", None, 3, 40, 60)], "image string, y int, x int, height int, width int").repartition(4).cache()


@pytest.mark.parametrize("options", [{"spacing": 3, "h": 0.5, "smallest": 4}, {"spacing": 1, "erosion": 1}])
def test_split_objects_are_alike_in_squares_and_blocks(spark, options):
    px = _masks(spark)
    rows = lambda df: sorted(map(tuple, df.select("image", "y", "x", "marker").collect()))
    want = rows(relief._split_by_blocks(px.where("y is not null").distinct(), "image", **{"least": 1.0, "h": 0.0, "erosion": 0, "smallest": 0, "size": 16} | options))
    for square, most in ((512, 250_000), (8, 250_000), (16, 60)):
        assert rows(relief.split_objects(px, "image", size=16, square=square, most=most, **options)) == want


def test_a_peak_in_the_first_corner_keeps_its_object(spark):
    disks = [(y, x) for y in range(20) for x in range(40) if y * y + x * x <= 64 or y * y + (x - 14) ** 2 <= 64]
    px = spark.createDataFrame([("i", y, x, 20, 40) for y, x in disks], "image string, y int, x int, height int, width int")
    for most in (0, 250_000):
        label = {(r.y, r.x): r.marker for r in relief.split_objects(px, "image", spacing=3, size=16, square=16, most=most).collect()}
        assert label.keys() == set(disks) and label[0, 0] == 0 and label[0, 14] == 14


def test_h_maxima_are_alike_in_squares_and_blocks(spark):
    px = _masks(spark)
    depth = relief.distance_transform(px, "image").withColumnRenamed("distance", "value").where("value is not null").checkpoint()
    rows = lambda df: sorted(map(tuple, df.select("image", "y", "x", "root").collect()))
    want = rows(relief._h_maxima_by_blocks(depth, "image", 0.75, "value", 16))
    for square, most in ((512, 250_000), (8, 250_000), (16, 60)):
        assert rows(relief.depth_maxima(px, "image", 0.75, 16, square=square, most=most)) == want
        assert rows(relief.h_maxima(depth, "image", 0.75, size=16, square=square, most=most)) == want
