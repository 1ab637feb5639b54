"""Queries over the pixel stand-in: shapes, intensities, contacts, profiles, networks, rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofold.operators import network as W
from cytofold.operators import pixels as P
from cytofold.operators import raster as T
from cytofold.operators import tiles as K
from cytofold.plans.registry import Registry, rounded
from cytofold.plans.stand_in import PIXELS_SQL, pixels, table

query = Registry()


@query(
    f"""WITH {PIXELS_SQL}, m AS (
      SELECT cell_id, organelle, label, count(*) AS n, avg(y * 0.5::DOUBLE) AS centroid_y, avg(x * 0.25::DOUBLE) AS centroid_x,
        var_pop(y * 0.5::DOUBLE) + 0.25::DOUBLE / 12 AS a, var_pop(x * 0.25::DOUBLE) + 0.0625::DOUBLE / 12 AS c, covar_pop(y * 0.5::DOUBLE, x * 0.25::DOUBLE) AS b,
        count(*)::DOUBLE / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS extent FROM px GROUP BY ALL
    ), e AS (SELECT *, (a + c) / 2 + sqrt(greatest(0, pow((a - c) / 2, 2) + b * b)) AS e0, greatest(0, (a + c) / 2 - sqrt(greatest(0, pow((a - c) / 2, 2) + b * b))) AS e1 FROM m)
    SELECT cell_id, organelle, label, n * 0.125::DOUBLE AS area, round(centroid_y, 6) AS centroid_y, round(centroid_x, 6) AS centroid_x, round(extent, 6) AS extent,
      round(4 * sqrt(e0), 6) AS axis_major_length, round(4 * sqrt(e1), 6) AS axis_minor_length, round(sqrt(4 * n * 0.125::DOUBLE / pi()), 6) AS equivalent_diameter_area FROM e"""
)
def fm_shape(spark, sf_dir):
    out = P.shape(pixels(spark, sf_dir), 0.5, 0.25)
    return rounded(out.select(*P.OBJECT, "area", "centroid_y", "centroid_x", "extent", "axis_major_length", "axis_minor_length", "equivalent_diameter_area"))


@query(
    f"""WITH {PIXELS_SQL}, f AS (
      SELECT cell_id, organelle, label, avg(value) AS m, max(value) AS hi, min(value) AS lo, stddev_pop(value) AS sd, quantile_cont(value, 0.5) AS med,
        quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, sum(value) AS s FROM px GROUP BY ALL
    ), d AS (SELECT cell_id, organelle, label, quantile_cont(abs(value - med), 0.5) AS mad FROM px JOIN f USING (cell_id, organelle, label) GROUP BY ALL)
    SELECT cell_id, organelle, label, round(m, 6) AS intensity_mean, round(sd, 6) AS intensity_std, round(med, 6) AS intensity_median, round(q3 - q1, 6) AS intensity_iqr,
      round(mad, 6) AS intensity_mad, s AS intensity_integrated, hi - lo AS intensity_range, round(sd / nullif(m, 0), 6) AS intensity_cv FROM f JOIN d USING (cell_id, organelle, label)"""
)
def fm_intensity(spark, sf_dir):
    out = P.intensity(pixels(spark, sf_dir))
    return rounded(out.select(*P.OBJECT, "intensity_mean", "intensity_std", "intensity_median", "intensity_iqr", "intensity_mad", "intensity_integrated", "intensity_range", "intensity_cv"))


@query()
def fm_weighted_hu(spark, sf_dir):
    return P.weighted_hu(pixels(spark, sf_dir))


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT DISTINCT cell_id, organelle, y, x FROM px), s AS (SELECT cell_id, organelle, count(*) AS n FROM m GROUP BY ALL),
    p AS (SELECT a.cell_id, a.organelle AS oa, b.organelle AS ob, count(*) AS n FROM m a JOIN m b USING (cell_id, y, x) WHERE a.organelle < b.organelle GROUP BY ALL)
    SELECT p.cell_id, oa AS organelle_a, ob AS organelle_b, p.n * 0.125::DOUBLE AS overlap_area, round(p.n / a.n, 9) AS overlap_frac_a, round(p.n / b.n, 9) AS overlap_frac_b
    FROM p JOIN s a ON a.cell_id = p.cell_id AND a.organelle = oa JOIN s b ON b.cell_id = p.cell_id AND b.organelle = ob"""
)
def fc_contacts(spark, sf_dir):
    return rounded(P.contacts(pixels(spark, sf_dir), 0.5, 0.25), 9)


@query()
def fc_contact_sites(spark, sf_dir):
    return P.contact_sites(pixels(spark, sf_dir))


@query()
def fl03_nucleus_direction(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return P.nucleus_direction(P.shape(px.where("organelle = 'a'"), 0.5, 0.25), px.where("organelle = 'b'"), 0.5, 0.25)


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT DISTINCT cell_id, organelle, y, x FROM px), s(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
    n AS (SELECT m.*, y + dy AS ny, x + dx AS nx FROM m, s WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)
    SELECT DISTINCT n.cell_id, n.organelle, n.y, n.x FROM n LEFT JOIN m k ON k.cell_id = n.cell_id AND k.organelle = n.organelle AND k.y = n.ny AND k.x = n.nx WHERE k.y IS NULL"""
)
def fl_boundary(spark, sf_dir):
    return P.boundary(pixels(spark, sf_dir))


@query(
    f"""WITH {PIXELS_SQL}, c AS (SELECT cell_id, organelle, label, avg(y) AS cy, avg(x) AS cx FROM px WHERE organelle = 'b' GROUP BY ALL),
    m AS (SELECT DISTINCT cell_id, y, x FROM px WHERE organelle = 'a'), s(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
    n AS (SELECT m.*, y + dy AS ny, x + dx AS nx FROM m, s WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
    e AS (SELECT DISTINCT n.cell_id, n.y, n.x FROM n LEFT JOIN m k ON k.cell_id = n.cell_id AND k.y = n.ny AND k.x = n.nx WHERE k.y IS NULL)
    SELECT c.cell_id, organelle, label, round(min(sqrt(pow(cy - y, 2) + pow(cx - x, 2))), 6) AS distance_from_cell_edge,
      round(CASE WHEN min(sqrt(pow(cy - y, 2) + pow(cx - x, 2))) = 0 THEN 0.5 ELSE 1 / (1 + min(sqrt(pow(cy - y, 2) + pow(cx - x, 2)))) END, 6) AS position
    FROM c JOIN e ON e.cell_id = c.cell_id GROUP BY ALL"""
)
def fl_edge_distance(spark, sf_dir):
    px = pixels(spark, sf_dir)
    centre = P.shape(px.where("organelle = 'b'")).select(*P.OBJECT, "centroid_y", "centroid_x")
    d = P.edge_distances(centre, P.boundary(px.where("organelle = 'a'")), "distance_from_cell_edge")
    one = F.when(F.col("distance_from_cell_edge") == 0, 0.0).otherwise(1.0)
    return rounded(d.withColumn("position", P.radial_position(one, F.col("distance_from_cell_edge"))))


_RADIAL_SQL = "q AS (SELECT DISTINCT cell_id, organelle, sqrt(pow(y - 3.5::DOUBLE, 2) + pow(x - 3.5::DOUBLE, 2)) / 5 AS r, atan2(y - 3.5::DOUBLE, x - 3.5::DOUBLE) AS theta, y, x FROM px)"


def _polar(spark, sf_dir):
    y, x = F.col("y") - 3.5, F.col("x") - 3.5
    return pixels(spark, sf_dir).select("cell_id", "organelle", "y", "x", (F.sqrt(F.pow(y, 2) + F.pow(x, 2)) / 5).alias("r"), F.atan2(y, x).alias("theta")).distinct()


@query(
    f"""WITH {PIXELS_SQL}, {_RADIAL_SQL}, k AS (SELECT cell_id, organelle, CASE WHEN r < 0.2 THEN 0 WHEN r < 0.4 THEN 1 WHEN r < 0.6000000000000001::DOUBLE THEN 2 WHEN r < 0.8 THEN 3 ELSE 4 END AS b FROM q)
    SELECT cell_id, organelle, {", ".join(f"round(count(*) FILTER (b = {k}) / count(*), 9) AS radial_frac_bin{k}" for k in range(5))} FROM k GROUP BY ALL"""
)
def fr_radial_fractions(spark, sf_dir):
    return rounded(P.radial_fractions(_polar(spark, sf_dir)), 9)


@query(
    f"""WITH {PIXELS_SQL}, {_RADIAL_SQL}, k AS (SELECT cell_id, organelle, least(floor((theta + pi()) / (2 * pi() / 8)), 7) AS b FROM q),
    c AS (SELECT cell_id, organelle, [{", ".join(f"count(*) FILTER (b = {k})" for k in range(8))}] AS n FROM k GROUP BY ALL)
    SELECT cell_id, organelle, round(list_stddev_pop(n) / list_avg(n), 6) AS radial_anisotropy FROM c"""
)
def fr_radial_anisotropy(spark, sf_dir):
    return rounded(P.radial_anisotropy(_polar(spark, sf_dir)))


@query(
    f"""WITH {PIXELS_SQL}, s(size) AS (VALUES (1), (2), (4)) SELECT cell_id, organelle, size, count(DISTINCT (y // size) * 100 + x // size) AS boxes FROM px, s GROUP BY ALL"""
)
def fn11_box_counts(spark, sf_dir):
    return P.box_counts(pixels(spark, sf_dir), (1, 2, 4))


def _branches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("cell_id"), F.lit("net").alias("organelle"), (F.col("l_partkey") % 4).alias("src"), (F.col("l_suppkey") % 4).alias("dst"),
        (F.col("l_linenumber") % 3).alias("kind"), F.col("l_quantity").alias("length"), (F.col("l_quantity") - F.col("l_linenumber")).alias("chord"), (F.col("l_partkey") % 2).alias("component"),
    )


@query(
    """WITH b AS (SELECT l_orderkey AS cell_id, l_partkey % 4 AS src, l_suppkey % 4 AS dst, l_linenumber % 3 AS kind, l_quantity AS length, l_partkey % 2 AS component FROM lineitem),
    n AS (SELECT cell_id, unnest([src, dst]) AS node, kind FROM b), d AS (SELECT cell_id, node, count(*) AS degree FROM n WHERE kind > 0 GROUP BY ALL),
    e AS (SELECT DISTINCT cell_id, node FROM n WHERE kind = 1 EXCEPT SELECT cell_id, node FROM n WHERE kind = 2),
    c AS (SELECT cell_id, max(s) AS longest FROM (SELECT cell_id, component, sum(length) AS s FROM b GROUP BY ALL) GROUP BY cell_id)
    SELECT b.cell_id, 'net' AS organelle, count(*) AS num_branches, sum(length) AS total_branch_length,
      coalesce(any_value(dd.n), 0) AS num_nodes, round(coalesce(any_value(dd.a), 0), 6) AS average_degree, coalesce(any_value(ee.n), 0) AS num_endpoints, any_value(longest) AS largest_connected_component_size
    FROM b LEFT JOIN (SELECT cell_id, count(*) AS n, avg(degree) AS a FROM d GROUP BY cell_id) dd USING (cell_id)
    LEFT JOIN (SELECT cell_id, count(*) AS n FROM e GROUP BY cell_id) ee USING (cell_id) LEFT JOIN c USING (cell_id) GROUP BY b.cell_id"""
)
def fn_network_summary(spark, sf_dir):
    return rounded(W.network_summary(_branches(spark, sf_dir)))


@query("SELECT l_orderkey AS cell_id, l_linenumber % 3 AS kind, round(CASE WHEN l_quantity = l_linenumber THEN 1 ELSE l_quantity / (l_quantity - l_linenumber) END, 6) AS tortuosity FROM lineitem")
def fn08_tortuosity(spark, sf_dir):
    return rounded(W.tortuosity(_branches(spark, sf_dir)).select("cell_id", "kind", "tortuosity"))


@query(
    """WITH s AS (SELECT n_nationkey AS k, min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 64 AS width FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
    h AS (SELECT k, least(floor((c_acctbal - lo) / width), 63)::INTEGER AS bin FROM customer JOIN s ON k = c_nationkey) SELECT k, bin, count(*) AS n FROM h GROUP BY ALL"""
)
def i07_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("value"))
    return T.histogram(rows, "k", bins=64).select("k", "bin", "n")


@query()
def i07_otsu(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("value"))
    return T.otsu(T.histogram(rows, "k", bins=64), "k")


@query(
    f"""WITH {PIXELS_SQL}, s AS (SELECT cell_id, organelle, label FROM px GROUP BY ALL HAVING count(*) * 0.5 BETWEEN 3 AND 5)
    SELECT cell_id, organelle, label, y, x FROM px JOIN s USING (cell_id, organelle, label)"""
)
def i20_size_filter(spark, sf_dir):
    return T.size_filter(pixels(spark, sf_dir), list(P.OBJECT), 0.5, 3.0, 5.0).select(*P.OBJECT, "y", "x")


@query(
    f"""WITH RECURSIVE {PIXELS_SQL}, m AS (SELECT cell_id, y, x, cell_id * (1::BIGINT << 40) + y * (1::BIGINT << 20) + x AS id FROM px WHERE organelle = 'a'),
    e AS (SELECT a.id AS s, b.id AS t FROM m a JOIN m b ON a.cell_id = b.cell_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r AS (SELECT id AS s, id AS t FROM m UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s)
    SELECT cell_id, y, x, min(t) AS root FROM m JOIN r ON r.s = m.id GROUP BY ALL"""
)
def i21_label_pixels(spark, sf_dir):
    out = T.label_pixels(pixels(spark, sf_dir).where("organelle = 'a'"), "cell_id")
    return out.withColumn("root", F.col("cell_id") * (1 << 40) + F.col("root"))


@query(
    """WITH i AS (SELECT p_partkey AS image, p_size * 100 AS height, (p_partkey % 7 + 1) * 300 AS width FROM part),
    t AS (SELECT *, unnest(range(0, greatest(1, ceil((height - 64) / 448.0))::BIGINT)) AS ty FROM i), u AS (SELECT *, unnest(range(0, greatest(1, ceil((width - 64) / 448.0))::BIGINT)) AS tx FROM t)
    SELECT image, ty::INTEGER AS ty, tx::INTEGER AS tx, (ty * 448)::INTEGER AS y0, least(ty * 448 + 512, height)::INTEGER AS y1,
      CASE WHEN ty = greatest(1, ceil((height - 64) / 448.0)) - 1 THEN height ELSE ty * 448 + 448 END::INTEGER AS core_y1,
      CASE WHEN tx = greatest(1, ceil((width - 64) / 448.0)) - 1 THEN width ELSE tx * 448 + 448 END::INTEGER AS core_x1 FROM u"""
)
def i22_tile_grid(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 100).alias("height"), ((F.col("p_partkey") % 7 + 1) * 300).cast("int").alias("width"))
    g = T.tile_grid(images, 512, 64)
    return g.select("image", *(F.col(c).cast("int").alias(c) for c in ("ty", "tx", "y0", "y1", "core_y1", "core_x1")))


@query(
    """WITH a AS (SELECT s_nationkey AS seam, s_suppkey AS at, s_suppkey % 5 AS label FROM supplier), b AS (SELECT c_nationkey AS seam, c_custkey AS at, c_custkey % 4 AS label FROM customer)
    SELECT DISTINCT 'A' || a.seam AS tile_a, a.label AS label_a, 'B' || b.seam AS tile_b, b.label AS label_b FROM a JOIN b ON a.seam = b.seam AND abs(a.at - b.at) <= 1 WHERE a.label > 0 AND b.label > 0"""
)
def j16_seam_pairs(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("seam"), F.concat(F.lit("A"), "s_nationkey").alias("tile"), F.col("s_suppkey").alias("at"), (F.col("s_suppkey") % 5).alias("label"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("seam"), F.concat(F.lit("B"), "c_nationkey").alias("tile"), F.col("c_custkey").alias("at"), (F.col("c_custkey") % 4).alias("label"))
    return T.seam_pairs(a, b)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 60 * 100 + l_linenumber AS s, l_orderkey % 60 * 100 + l_partkey % 9 + 50 AS t FROM lineitem WHERE l_linenumber > 0 AND l_quantity > 40),
    b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s, s AS t FROM b UNION SELECT r.s, b.t FROM r JOIN b ON r.t = b.s) SELECT s AS label, min(t) AS merged FROM r GROUP BY s"""
)
def i23_stitch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    tile = (F.col("l_orderkey") % 60).alias("tile_a")
    edges = li.select(tile, F.col("l_linenumber").cast("long").alias("label_a"), tile.alias("tile_b"), (F.col("l_partkey") % 9 + 50).alias("label_b"))
    offsets = li.select((F.col("l_orderkey") % 60).alias("tile")).distinct().withColumn("offset", F.col("tile") * 100)
    return T.stitch(edges, offsets)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS s, l_orderkey * 100 + l_partkey % 9 + 50 AS t FROM lineitem WHERE l_linenumber > 0),
    b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s, s AS t FROM b UNION SELECT r.s, b.t FROM r JOIN b ON r.t = b.s) SELECT s AS label, min(t) AS merged FROM r GROUP BY s"""
)
def i23_stitch_orders(spark, sf_dir):
    """One tile for each order, all of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("tile_a"), F.col("l_linenumber").cast("long").alias("label_a"), F.col("l_orderkey").alias("tile_b"), (F.col("l_partkey") % 9 + 50).alias("label_b"))
    offsets = li.select(F.col("l_orderkey").alias("tile")).distinct().withColumn("offset", F.col("tile") * 100)
    return T.stitch(edges, offsets)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 100 + l_linenumber AS s, CASE WHEN l_partkey % 2 = 0 THEN (l_orderkey + 1) * 100 + l_partkey % 7 + 1 ELSE l_orderkey * 100 + l_linenumber END AS t FROM lineitem WHERE l_partkey % 2 = 0),
    b AS (SELECT s, t FROM e UNION SELECT t, s FROM e), r AS (SELECT s, s AS t FROM b UNION SELECT r.s, b.t FROM r JOIN b ON r.t = b.s) SELECT s AS label, min(t) AS merged FROM r GROUP BY s"""
)
def i23_stitch_seams(spark, sf_dir):
    """One tile for each order; half of the labels go on into the next order's tile."""
    li = table(spark, sf_dir, "lineitem")
    on = F.col("l_partkey") % 2 == 0
    edges = li.select(F.col("l_orderkey").alias("tile_a"), F.col("l_linenumber").cast("long").alias("label_a"), (F.col("l_orderkey") + on.cast("int")).alias("tile_b"), F.when(on, F.col("l_partkey") % 7 + 1).otherwise(F.col("l_linenumber")).cast("long").alias("label_b"))
    offsets = edges.select(F.explode(F.array("tile_a", "tile_b")).alias("tile")).distinct().withColumn("offset", F.col("tile") * 100)
    return T.stitch(edges, offsets)


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT DISTINCT cell_id, y, x FROM px) SELECT a.cell_id, a.y, a.x FROM m a JOIN m b ON a.cell_id = b.cell_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
    GROUP BY ALL HAVING count(*) = 9"""
)
def i25_erode(spark, sf_dir):
    return T.erode(pixels(spark, sf_dir), "cell_id", 1)


@query(
    f"""WITH {PIXELS_SQL}, k(a) AS (VALUES (-1), (0), (1)),
    c AS (SELECT DISTINCT cell_id, organelle, label, 2 * y + k.a AS y, 2 * x + j.a AS x FROM px, k, k j)
    SELECT cell_id, organelle, label, sum(CASE WHEN abs(y % 2) + abs(x % 2) = 1 THEN -1 ELSE 1 END)::BIGINT AS euler_number FROM c GROUP BY ALL"""
)
def fm10_euler_number(spark, sf_dir):
    return P.euler_number(pixels(spark, sf_dir))


@query(
    f"""WITH {PIXELS_SQL}, m AS (SELECT DISTINCT cell_id, organelle, label, y, x FROM px),
    b AS (SELECT a.cell_id, a.organelle, a.label, a.y, a.x FROM m a LEFT JOIN m n ON a.cell_id = n.cell_id AND a.organelle = n.organelle AND a.label = n.label AND abs(a.y - n.y) + abs(a.x - n.x) = 1
      GROUP BY ALL HAVING count(n.y) < 4),
    c AS (SELECT a.cell_id, a.organelle, a.label, a.y, a.x, 1 + 2 * count(*) FILTER (abs(a.y - n.y) + abs(a.x - n.x) = 1) + 10 * count(*) FILTER (abs(a.y - n.y) = 1 AND abs(a.x - n.x) = 1) AS code
      FROM b a LEFT JOIN b n ON a.cell_id = n.cell_id AND a.organelle = n.organelle AND a.label = n.label AND abs(a.y - n.y) <= 1 AND abs(a.x - n.x) <= 1 GROUP BY ALL)
    SELECT cell_id, organelle, label, round(sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END), 6) AS perimeter
    FROM c GROUP BY ALL"""
)
def fm18_perimeter(spark, sf_dir):
    return rounded(P.perimeter(pixels(spark, sf_dir)))


@query()
def fm06_area_filled(spark, sf_dir):
    return P.area_filled(pixels(spark, sf_dir).where("organelle = 'a'"), "cell_id")


def _tiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("tile"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


@query()
def i01_equalised_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.equalised, block=4)


@query()
def i03_gaussian_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.gaussian, sigma=1.0)


@query()
def i04_vesselness_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.vesselness, sigmas=(1.0, 2.0))


@query()
def i06_log_mask_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.log_mask)


@query()
def i12_blob_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.blobs, sigmas=(1.0, 1.5))


@query()
def i18_watershed_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.split_touching)


@query()
def i19_thinned_tiles(spark, sf_dir):
    return K.map_tiles(_tiles(spark, sf_dir), K.thinned)


@query()
def fn04_branches(spark, sf_dir):
    return K.branch_table(_tiles(spark, sf_dir))


QUERIES, ORACLES = query.queries, query.oracles
