"""Queries over images that grow with the tables: distances, maxima that stand out, touching objects, branches of skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytofold.operators import network as W
from cytofold.operators import raster as T
from cytofold.operators import relief as R
from cytofold.operators import skeleton as K
from cytofold.operators import stencils as S
from cytofold.operators.graph import spread
from cytofold.plans.registry import Registry, rounded
from cytofold.plans.stand_in import PIXELS_SQL, pixels, table

query = Registry()

# --- one image a nation, 200 pixels high and 200 wide for every 2,500 customers; a customer is a disk of radius 2 to 4 ---

_DISK = [(dy, dx) for dy in range(-4, 5) for dx in range(-4, 5) if dy * dy + dx * dx <= 16]


def _painted(spark, sf_dir):
    """The pixels of the disks, those of several more than once, and how many there are."""
    customers = table(spark, sf_dir, "customer")
    rows = customers.count() * 30  # a disk has 30 pixels on average
    c = customers.select("c_custkey", F.col("c_nationkey").alias("image"), F.pmod(F.round(F.abs("c_acctbal") * 100).cast("long"), F.lit(192)).alias("y0"), (F.pmod(F.col("c_custkey") * 7919, F.lit(191)) + 4).alias("x0"))
    width = c.agg((F.floor(F.max("c_custkey") / 2500) * 200 + 200).cast("int").alias("width"))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _DISK)))
    px = spread(c, rows, "c_custkey").withColumn("s", step).where("s.dy * s.dy + s.dx * s.dx <= (2 + c_custkey % 3) * (2 + c_custkey % 3)")
    px = px.select("image", (F.col("y0") + 4 + F.col("s.dy")).cast("int").alias("y"), (F.col("x0") + F.floor(F.col("c_custkey") / 2500) * 200 + F.col("s.dx")).cast("int").alias("x"))
    # the extent is one row
    return px.crossJoin(F.broadcast(width)).withColumn("height", F.lit(200)), rows


def _plots(spark, sf_dir):
    px, rows = _painted(spark, sf_dir)
    return spread(px, rows, "image", "y", "x").distinct()


_PLOTS_SQL = """plots AS (SELECT DISTINCT c_nationkey AS image, (round(abs(c_acctbal) * 100)::BIGINT % 192 + 4 + a.d)::INTEGER AS y, ((c_custkey * 7919) % 191 + 4 + (c_custkey // 2500) * 200 + b.d)::INTEGER AS x
    FROM customer, range(-4, 5) a(d), range(-4, 5) b(d) WHERE a.d * a.d + b.d * b.d <= pow(2 + c_custkey % 3, 2)),
  extent AS (SELECT max(c_custkey) // 2500 * 200 + 200 AS width FROM customer),
  s4(dy, dx) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
  rim AS (SELECT DISTINCT image, (y + dy)::INTEGER AS y, (x + dx)::INTEGER AS x FROM plots, s4, extent WHERE y + dy BETWEEN 0 AND 199 AND x + dx BETWEEN 0 AND width - 1 EXCEPT SELECT image, y, x FROM plots),
  deep AS (SELECT p.image, p.y, p.x, min(sqrt(pow(p.y - r.y, 2) + pow(p.x - r.x, 2))) AS depth FROM plots p JOIN rim r ON p.image = r.image AND r.y BETWEEN p.y - 60 AND p.y + 60 AND r.x BETWEEN p.x - 60 AND p.x + 60 GROUP BY ALL)"""


@query(f"WITH {_PLOTS_SQL} SELECT image, y, x, round(depth, 6) AS distance FROM deep")
def fn07_distance(spark, sf_dir):
    """The nearest background pixel lies beside the mask, at most 60 pixels away here."""
    return rounded(R.distance_transform(_plots(spark, sf_dir), "image").select("image", "y", "x", "distance"))


def _depth(spark, sf_dir):
    return R.distance_transform(_plots(spark, sf_dir), "image").withColumnRenamed("distance", "value")


@query(
    f"""WITH RECURSIVE {_PLOTS_SQL}, g AS (SELECT image, y * (1::BIGINT << 20) + x AS p, y, x, depth FROM deep),
    e AS (SELECT a.image, a.p AS s, b.p AS t, a.depth AS ds, b.depth AS dt FROM g a JOIN g b ON a.image = b.image AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND a.p <> b.p),
    top AS (SELECT image, p, depth FROM g ANTI JOIN (SELECT image, s AS p FROM e WHERE dt > ds) h USING (image, p)),
    r AS (SELECT image, p AS s, depth AS m, p AS t, depth AS dt FROM top UNION SELECT r.image, r.s, r.m, e.t, e.dt FROM r JOIN e ON r.image = e.image AND e.s = r.t WHERE e.dt >= r.m - 0.75 AND r.dt <= r.m),
    good AS (SELECT image, s FROM r GROUP BY image, s HAVING max(dt) <= any_value(m)), q AS (SELECT r.image, t, min(t) OVER (PARTITION BY r.image, r.s) AS root FROM r JOIN good USING (image, s))
    SELECT DISTINCT image, (t >> 20)::INTEGER AS y, (t & 1048575)::INTEGER AS x, root FROM q"""
)
def i18_h_maxima(spark, sf_dir):
    """Maxima of the distance that rise by 0.75; the SQL follows the ways from each maximum that stay within 0.75 of it."""
    px, rows = _painted(spark, sf_dir)
    return R.depth_maxima(px, "image", 0.75, size=64, rows=rows)


@query(
    f"""WITH RECURSIVE {_PLOTS_SQL}, top AS (SELECT a.image, a.y, a.x, any_value(a.depth) AS depth FROM deep a JOIN deep b ON a.image = b.image AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2
      WHERE a.depth > 1 GROUP BY ALL HAVING max(b.depth) <= any_value(a.depth)),
    pairs AS (SELECT a.image, a.y, a.x, b.y AS by_, b.x AS bx FROM top a JOIN top b ON a.image = b.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (a.depth, -a.y, -a.x) > (b.depth, -b.y, -b.x)),
    lost AS (SELECT 0 AS k, image, y, x, 1 AS kept FROM top ANTI JOIN (SELECT image, by_ AS y, bx AS x FROM pairs) p USING (image, y, x)
      UNION ALL SELECT k + 1, image, y, x, kept FROM (
        WITH known AS (SELECT * FROM lost),
          gone AS (SELECT DISTINCT known.k, p.image, p.by_ AS y, p.bx AS x FROM known JOIN pairs p USING (image, y, x) WHERE kept = 1),
          open_ AS (SELECT t.image, t.y, t.x FROM top t ANTI JOIN known USING (image, y, x) ANTI JOIN gone USING (image, y, x)),
          free AS (SELECT o.image, o.y, o.x FROM open_ o ANTI JOIN (SELECT p.image, p.by_ AS y, p.bx AS x FROM pairs p JOIN open_ USING (image, y, x)) w USING (image, y, x))
        SELECT k, image, y, x, kept FROM known UNION ALL SELECT k, image, y, x, 0 FROM gone ANTI JOIN known USING (image, y, x) UNION ALL SELECT (SELECT max(k) FROM known), image, y, x, 1 FROM free) z
      WHERE k < 12)
    SELECT image, y, x, round(depth, 6) AS value FROM top JOIN (SELECT DISTINCT image, y, x FROM lost WHERE k = 12 AND kept = 1) l USING (image, y, x)"""
)
def i18_peaks(spark, sf_dir):
    """Peaks of the distance, none within two pixels of a higher one that stays."""
    return rounded(R.spaced_peaks(_depth(spark, sf_dir), "image", 2, 1.0, size=64))


@query()
def i18_split_objects(spark, sf_dir):
    """Touching disks apart. SQL has no flood; tests compare it with a flood by a heap."""
    px, rows = _painted(spark, sf_dir)
    return R.split_objects(px, "image", spacing=3, least=1.0, h=0.5, smallest=4, size=64, rows=rows)


# --- branches: mask b of every crop as a skeleton ---

_BRANCHES_SQL = f"""{PIXELS_SQL}, m AS (SELECT cell_id, y, x, y * (1::BIGINT << 20) + x AS p FROM px WHERE organelle = 'b'),
    n8 AS (SELECT a.cell_id, a.p AS u, b.p AS v, a.y, a.x, b.y AS vy, b.x AS vx FROM m a JOIN m b ON a.cell_id = b.cell_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.p <> b.p),
    e AS (SELECT n8.cell_id, u, v, sqrt(pow(n8.y - vy, 2) + pow(n8.x - vx, 2)) AS step FROM n8 LEFT JOIN m k ON n8.y <> vy AND n8.x <> vx AND k.cell_id = n8.cell_id AND (k.y = vy AND k.x = n8.x OR k.y = n8.y AND k.x = vx) WHERE k.p IS NULL),
    r AS (SELECT cell_id, p AS s, p AS t FROM m UNION SELECT r.cell_id, r.s, n8.v FROM r JOIN n8 ON r.cell_id = n8.cell_id AND r.t = n8.u), part AS (SELECT cell_id, s AS p, min(t) AS component FROM r GROUP BY ALL),
    deg AS (SELECT m.cell_id, m.p, count(e.v) AS n FROM m LEFT JOIN e ON e.cell_id = m.cell_id AND e.u = m.p GROUP BY ALL),
    kind AS (SELECT cell_id, p, component, n, n <> 2 OR p = component AND bool_and(n = 2) OVER (PARTITION BY cell_id, component) AS node FROM deg JOIN part USING (cell_id, p)),
    w AS (SELECT e.cell_id, u AS s, v AS f, u AS prev, v AS cur, step AS length, [u, v] AS ps FROM e JOIN kind k ON k.cell_id = e.cell_id AND k.p = u AND k.node
      UNION ALL SELECT w.cell_id, s, f, cur, e.v, length + step, list_append(ps, e.v) FROM w JOIN kind k ON k.cell_id = w.cell_id AND k.p = w.cur AND NOT k.node JOIN e ON e.cell_id = w.cell_id AND e.u = w.cur AND e.v <> w.prev),
    b AS (SELECT w.cell_id, s AS src, cur AS dst, length, ps, a.component, CASE WHEN s = cur THEN 3 WHEN a.n = 1 AND z.n = 1 THEN 0 WHEN a.n = 1 OR z.n = 1 THEN 1 ELSE 2 END AS kind,
      sqrt(pow((s >> 20) - (cur >> 20), 2) + pow((s & 1048575) - (cur & 1048575), 2)) AS chord
      FROM w JOIN kind a ON a.cell_id = w.cell_id AND a.p = s JOIN kind z ON z.cell_id = w.cell_id AND z.p = cur WHERE z.node AND (s < cur OR s = cur AND f <= prev))"""


@query(
    f"""WITH RECURSIVE {_BRANCHES_SQL}, free AS (SELECT g.cell_id, g.y, g.x FROM (SELECT DISTINCT cell_id, y, x FROM grid) g ANTI JOIN m USING (cell_id, y, x)),
    depth AS (SELECT m.cell_id, m.p, min(sqrt(pow(m.y - f.y, 2) + pow(m.x - f.x, 2))) AS d FROM m JOIN free f USING (cell_id) GROUP BY ALL),
    on_ AS (SELECT cell_id, src, dst, length, unnest(ps) AS p, row_number() OVER () AS k FROM b), t AS (SELECT on_.cell_id, k, 2 * quantile_cont(d, 0.5) AS thickness FROM on_ JOIN depth USING (cell_id, p) GROUP BY ALL)
    SELECT b.cell_id, src, dst, kind, round(length, 6) AS length, round(chord, 6) AS chord, component, round(thickness, 6) AS thickness FROM (SELECT *, row_number() OVER () AS k FROM b) b JOIN t USING (cell_id, k)"""
)
def fn04_branch_table(spark, sf_dir):
    mask = pixels(spark, sf_dir).where("organelle = 'b'").select("cell_id", "y", "x", "height", "width")
    return rounded(K.branches(mask, "cell_id", mask))


@query(
    f"""WITH RECURSIVE {_BRANCHES_SQL}, ends AS (SELECT cell_id, kind, unnest([src, dst]) AS node FROM b),
    d AS (SELECT cell_id, node, count(*) AS n FROM ends WHERE kind > 0 GROUP BY ALL), dd AS (SELECT cell_id, count(*) AS num_nodes, avg(n) AS average_degree FROM d GROUP BY ALL),
    f AS (SELECT DISTINCT cell_id, node FROM ends WHERE kind = 1 EXCEPT SELECT cell_id, node FROM ends WHERE kind = 2), ff AS (SELECT cell_id, count(*) AS num_endpoints FROM f GROUP BY ALL),
    c AS (SELECT cell_id, component, sum(length) AS l FROM b GROUP BY ALL), cc AS (SELECT cell_id, max(l) AS longest FROM c GROUP BY ALL)
    SELECT b.cell_id, 'b' AS organelle, count(*) AS num_branches, round(sum(length), 6) AS total_branch_length, coalesce(any_value(num_nodes), 0) AS num_nodes, round(coalesce(any_value(average_degree), 0), 6) AS average_degree,
      coalesce(any_value(num_endpoints), 0) AS num_endpoints, round(any_value(longest), 6) AS largest_connected_component_size, round(avg(CASE WHEN chord = 0 THEN 1 ELSE length / chord END), 6) AS tortuosity
    FROM b LEFT JOIN dd USING (cell_id) LEFT JOIN ff USING (cell_id) LEFT JOIN cc USING (cell_id) GROUP BY b.cell_id"""
)
def fn05_skeleton_networks(spark, sf_dir):
    """Network measures of the branches found in the pixels."""
    b = K.branches(pixels(spark, sf_dir).where("organelle = 'b'"), "cell_id").withColumn("organelle", F.lit("b"))
    mean = W.tortuosity(b).groupBy(*W.NET).agg(F.avg("tortuosity").alias("tortuosity"))
    return rounded(W.network_summary(b).join(mean, list(W.NET)))


# --- blobs and thresholds ---

#: Scales of the disks.
SIGMAS = (1.0, 1.5, 2.0)


def _spots(spark, sf_dir):
    """A pixel for each customer, as bright as its key tells, on the same images."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("image"), F.pmod(F.round(F.abs("c_acctbal") * 100).cast("long"), F.lit(200)).cast("int").alias("y"), F.pmod(F.col("c_custkey") * 7919, F.lit(199)).alias("x0"))
    width = c.agg((F.floor(F.max("c_custkey") / 2500) * 200 + 200).cast("int").alias("width"))
    px = c.select("image", "y", (F.col("x0") + F.floor(F.col("c_custkey") / 2500) * 200).cast("int").alias("x"), (F.col("c_custkey") % 5 + 1).cast("double").alias("value"))
    return px.groupBy("image", "y", "x").agg(F.sum("value").alias("value")).crossJoin(F.broadcast(width)).withColumn("height", F.lit(200))


@query()
def i12_blob_disks(spark, sf_dir):
    """SQL has no convolution of this size; a test paints the disks of whole images one after the other."""
    return S.blob_disks(_spots(spark, sf_dir), "image", SIGMAS, 0.1, 0.5, size=64)


_VALUES_SQL = "vals AS (SELECT s_nationkey AS k, floor(abs(s_acctbal))::DOUBLE AS value FROM supplier UNION ALL SELECT c_nationkey, floor(abs(c_acctbal) / 7)::DOUBLE FROM customer)"
_HIST_SQL = """w AS (SELECT k, min(value) AS lo, (max(value) - min(value)) / 64 AS width FROM {0} GROUP BY k),
    g AS (SELECT k, least(floor((value - lo) / width), 63)::INTEGER AS bin FROM {0} JOIN w USING (k)), h AS (SELECT k, bin, count(*) AS n FROM g GROUP BY ALL)"""


def _values(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    return s.select(F.col("s_nationkey").alias("k"), F.floor(F.abs("s_acctbal")).cast("double").alias("value")).unionByName(c.select(F.col("c_nationkey").alias("k"), F.floor(F.abs("c_acctbal") / 7).cast("double").alias("value")))


@query(
    f"""WITH RECURSIVE {_VALUES_SQL}, {_HIST_SQL.format("vals")}, c AS (SELECT k, n, (bin + 0.5) * width AS c FROM h JOIN w USING (k)),
    t AS (SELECT 0 AS i, k, sum(n * c) / sum(n) AS t FROM c GROUP BY k
      UNION ALL SELECT i + 1, k, (a - b) / (ln(a) - ln(b)) FROM (SELECT i, k, sum(n * c) FILTER (c <= t) / sum(n) FILTER (c <= t) AS a, sum(n * c) FILTER (c > t) / sum(n) FILTER (c > t) AS b FROM t JOIN c USING (k) WHERE i < 60 GROUP BY i, k) z)
    SELECT k, round(lo + t, 5) AS threshold FROM t JOIN w USING (k) WHERE i = 60"""
)
def i09_li_threshold(spark, sf_dir):
    return rounded(T.intensity_threshold(_values(spark, sf_dir), "k", "li", 64), 5)


@query(
    f"""WITH {_VALUES_SQL}, logs AS (SELECT k, log10(value) AS value FROM vals WHERE value > 0), {_HIST_SQL.format("logs")}, c AS (SELECT k, bin, n, lo + (bin + 0.5) * width AS c FROM h JOIN w USING (k)),
    o AS (SELECT a.k, a.bin, any_value(a.c) AS c, sum(b.n) FILTER (b.bin <= a.bin) AS n1, sum(b.n * b.c) FILTER (b.bin <= a.bin) AS s1, sum(b.n) FILTER (b.bin > a.bin) AS n2, sum(b.n * b.c) FILTER (b.bin > a.bin) AS s2 FROM c a JOIN c b USING (k) GROUP BY a.k, a.bin),
    otsu AS (SELECT k, arg_max(c, (round(n1 * n2 * pow(s1 / n1 - s2 / n2, 2), 6), -bin)) AS otsu FROM o WHERE n2 > 0 GROUP BY k),
    p AS (SELECT k, arg_max(bin, (n, -bin)) AS p, max(n) AS np, min(bin) AS a, max(bin) AS z, arg_min(n, bin) AS na, arg_max(n, bin) AS nz FROM h GROUP BY k), e AS (SELECT *, CASE WHEN p - a > z - p THEN a ELSE z END AS e, CASE WHEN p - a > z - p THEN na ELSE nz END AS ne FROM p),
    tail AS (SELECT e.*, unnest(range(least(p, e), greatest(p, e) + 1)) AS bin FROM e), d AS (SELECT tail.k, tail.bin, CASE WHEN e = p THEN np ELSE np + (ne - np) * (tail.bin - p) / (e - p)::DOUBLE END - coalesce(n, 0) AS d FROM tail LEFT JOIN h ON h.k = tail.k AND h.bin = tail.bin),
    tri AS (SELECT k, arg_max(bin, (round(d, 9), -bin)) AS bin FROM d GROUP BY k)
    SELECT k, round(pow(10, least(otsu, lo + (bin + 0.5) * width)), 5) AS threshold FROM otsu JOIN tri USING (k) JOIN w USING (k)"""
)
def i06_log_threshold(spark, sf_dir):
    return rounded(T.log_threshold(_values(spark, sf_dir), "k", 1.0, 64), 5)


QUERIES, ORACLES = query.queries, query.oracles
