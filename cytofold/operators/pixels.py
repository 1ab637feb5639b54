"""Measurements over a pixel table (cell_id, organelle, label, y, x, value).

Shapes, intensities, contacts, distances and radial profiles are aggregates and
equi-joins over pixels, so a cell never has to be in one task as a whole.
Spacing is the pixel size (sy, sx) in microns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from cytofold.operators.graph import connected_components

OBJECT = ("cell_id", "organelle", "label")
# Whole compartments and sessions that make no contact pair.
COMPARTMENTS = ("cell_membrane", "cell", "cp_cell_membrane", "cp_cell")
SAME_SIGNAL = ("focus3d", "phase2d")
# Masks that are not located in their cell; the metrics that are summarised.
NOT_LOCALIZED = ("nuclei", "nuclear_seg", "cell_membrane")
LOCATED = ("distance_from_cell_edge", "distance_from_nucleus", "distance_from_nucleus_centroid", "normalized_radial_position")
#: Pairs of a centroid and a boundary pixel that a task works on at once.
PAIRS = 2_000_000
#: Edges of the five radial shells as doubles print them; the last shell is closed.
SHELLS = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)


def shape(px: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """Shape metrics of each object from its pixel coordinates.

    Axes come from the central second moments (plus 1/12 of a pixel's side
    squared for its own extent): length 4 * sqrt(eigenvalue). Orientation is the
    angle from the row axis to the major axis, -pi/2 to pi/2."""
    y, x = F.col("y") * sy, F.col("x") * sx
    m = px.groupBy(*OBJECT).agg(
        F.count("*").alias("n"), F.avg(y).alias("centroid_y"), F.avg(x).alias("centroid_x"),
        F.var_pop(y).alias("_yy"), F.var_pop(x).alias("_xx"), F.covar_pop(y, x).alias("_xy"),
        ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("_box"),
    )
    a, c, b = F.col("_yy") + sy * sy / 12, F.col("_xx") + sx * sx / 12, F.col("_xy")
    root = F.sqrt(F.greatest(F.lit(0.0), F.pow((a - c) / 2, 2) + b * b))
    area = F.col("n") * (sy * sx)
    out = m.withColumns({"area": area, "inertia_eigval_0": (a + c) / 2 + root, "inertia_eigval_1": F.greatest(F.lit(0.0), (a + c) / 2 - root)})
    major, minor = 4 * F.sqrt("inertia_eigval_0"), 4 * F.sqrt("inertia_eigval_1")
    out = out.withColumns({"axis_major_length": major, "axis_minor_length": minor, "extent": F.col("n") / F.col("_box"), "equivalent_diameter_area": F.sqrt(4 * F.col("area") / math.pi)})
    half, low = F.col("axis_major_length") / 2, F.when(F.col("axis_minor_length") == 0, 0.1).otherwise(F.col("axis_minor_length")) / 2
    # Ramanujan's first approximation of an ellipse's perimeter
    tiny = 1e-12 * (a + c)
    perimeter = math.pi * (3 * (half + low) - F.sqrt((3 * half + low) * (half + 3 * low)))
    out = out.withColumns(
        {
            "eccentricity": F.sqrt(1 - F.col("inertia_eigval_1") / F.col("inertia_eigval_0")),
            "aspect_ratio": F.col("axis_major_length") / F.when(F.col("axis_minor_length") == 0, 1.0).otherwise(F.col("axis_minor_length")),
            "perimeter_approx": perimeter,
            "solidity_approx": F.col("extent"),
            # equal spreads, but for rounding: an eighth turn, by the sign of the covariance
            "orientation": F.when(F.abs(c - a) <= tiny, F.when(b > tiny, math.pi / 4).otherwise(-math.pi / 4)).otherwise(F.atan2(F.when(F.abs(b) <= tiny, 0.0).otherwise(2 * b), a - c) / 2),
        }
    )
    round_ = 4 * math.pi * F.col("area") / F.pow(F.when(F.col("perimeter_approx") == 0, 1.0).otherwise(F.col("perimeter_approx")), 2)
    return out.withColumn("circularity_approx", round_).drop("_yy", "_xx", "_xy", "_box")


def intensity(px: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """Intensity metrics of each object; the deviation is the population's, percentiles interpolate.

    The median absolute deviation needs the median first, so it is a second
    aggregate over the pixels joined with it."""
    v = F.col("value")
    q = lambda p: F.percentile(v, F.lit(p))
    first = px.groupBy(*OBJECT).agg(
        F.avg(v).alias("intensity_mean"), F.max(v).alias("intensity_max"), F.min(v).alias("intensity_min"), F.stddev_pop(v).alias("intensity_std"),
        q(0.5).alias("intensity_median"), q(0.25).alias("intensity_q25"), q(0.75).alias("intensity_q75"), F.sum(v).alias("intensity_integrated"),
        (F.sum(v * F.col("y")) / F.nullif(F.sum(v), F.lit(0.0)) * sy).alias("centroid_weighted_y"),
        (F.sum(v * F.col("x")) / F.nullif(F.sum(v), F.lit(0.0)) * sx).alias("centroid_weighted_x"),
    )
    spread = px.join(first.select(*OBJECT, "intensity_median"), list(OBJECT)).groupBy(*OBJECT).agg(F.percentile(F.abs(v - F.col("intensity_median")), F.lit(0.5)).alias("intensity_mad"))
    out = first.join(spread, list(OBJECT))
    return out.withColumns(
        {
            "intensity_iqr": F.col("intensity_q75") - F.col("intensity_q25"),
            "intensity_range": F.col("intensity_max") - F.col("intensity_min"),
            "intensity_cv": F.col("intensity_std") / F.nullif(F.col("intensity_mean"), F.lit(0.0)),
        }
    )


def weighted_hu(px: DataFrame) -> DataFrame:
    """Seven invariants of the intensity-weighted central moments of each object, null for weight 0."""
    w = F.col("value")
    centre = px.groupBy(*OBJECT).agg(F.sum(w).alias("_m"), (F.sum(w * F.col("y")) / F.nullif(F.sum(w), F.lit(0.0))).alias("_cy"), (F.sum(w * F.col("x")) / F.nullif(F.sum(w), F.lit(0.0))).alias("_cx"))
    dy, dx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    orders = [(p, q) for p in range(4) for q in range(4) if 2 <= p + q <= 3]
    power = lambda c, n: F.lit(1.0) if n == 0 else F.pow(c, F.lit(float(n)))
    eta = [(F.sum(w * power(dy, p) * power(dx, q)) / F.pow(F.first("_m"), F.lit(1 + (p + q) / 2))).alias(f"_n{p}{q}") for p, q in orders]
    n = px.join(centre.where("_m <> 0"), list(OBJECT)).groupBy(*OBJECT).agg(*eta)
    c = {f"{p}{q}": F.col(f"_n{p}{q}") for p, q in orders}
    s, d = c["20"] + c["02"], c["20"] - c["02"]
    a, b = c["30"] + c["12"], c["21"] + c["03"]
    e, f = c["30"] - 3 * c["12"], 3 * c["21"] - c["03"]
    hu = [
        s,
        d * d + 4 * c["11"] * c["11"],
        e * e + f * f,
        a * a + b * b,
        e * a * (a * a - 3 * b * b) + f * b * (3 * a * a - b * b),
        d * (a * a - b * b) + 4 * c["11"] * a * b,
        f * a * (a * a - 3 * b * b) - e * b * (3 * a * a - b * b),
    ]
    return n.select(*OBJECT, *(h.alias(f"moments_weighted_hu_{k}") for k, h in enumerate(hu)))


def boundary(px: DataFrame) -> DataFrame:
    """Pixels of each (cell, organelle) mask with a differing 4-neighbour inside the crop.

    ``height`` and ``width`` columns give the crop; its own edge is no boundary.
    Each pixel names its neighbours in the crop, and those the mask lacks count."""
    mask = px.select("cell_id", "organelle", "y", "x", "height", "width").distinct()
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    near = mask.select("*", F.explode(steps).alias("s")).select("cell_id", "organelle", "y", "x", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"), "height", "width")
    near = near.where("ny >= 0 and nx >= 0 and ny < height and nx < width")
    have = mask.select("cell_id", "organelle", F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(have, ["cell_id", "organelle", "ny", "nx"], "left_anti").select("cell_id", "organelle", "y", "x").distinct()


def edge_distances(centroids: DataFrame, edges: DataFrame, name: str, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """(cell_id, organelle, label, name): distance from each centroid (microns) to the
    nearest boundary pixel of its cell; cells without a boundary have no row.

    A cell's centroids and boundary, which its crop bounds, meet in one task, many
    cells at a time; a batch's pairs are worked on in parts of PAIRS."""
    from cytofold.operators.raster import in_groups

    own = centroids.select(*(F.col(c).alias(c) for c in OBJECT), F.lit(0).alias("_rim"), F.col("centroid_y").cast("double").alias("_y"), F.col("centroid_x").cast("double").alias("_x"))
    rim = edges.select("cell_id", (F.col("y") * float(sy)).alias("_y"), (F.col("x") * float(sx)).alias("_x")).distinct()
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in OBJECT[1:]]
    both = own.unionByName(rim.select("cell_id", *none, F.lit(1).alias("_rim"), "_y", "_x"))

    def nearest(part: pa.Table) -> pa.Table:
        rim, y, x = (part.column(c).to_numpy() for c in ("_rim", "_y", "_x"))
        start = np.flatnonzero(part.column("_new").to_numpy())
        end = np.r_[start[1:], len(rim)]
        split = start + np.add.reduceat(1 - rim, start)  # centroids come first
        cell = np.repeat(np.arange(len(start)), split - start)
        point = np.flatnonzero((rim == 0) & np.repeat(end > split, end - start))
        cell = cell[(end > split)[cell]]
        n = (end - split)[cell]
        out = np.zeros(len(point))
        upto = np.cumsum(n)
        done = 0
        while done < len(point):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, side="right")))
            k = np.s_[done:stop]
            head = np.cumsum(n[k]) - n[k]
            at = np.arange(n[k].sum()) - np.repeat(head - split[cell[k]], n[k])
            dy, dx = y[at] - np.repeat(y[point[k]], n[k]), x[at] - np.repeat(x[point[k]], n[k])
            out[k] = np.minimum.reduceat(dy * dy + dx * dx, head)
            done = stop
        # the root of the squares, as SQL takes it: hypot differs in the last digit, which decides at the edge of a shell
        return part.select(list(OBJECT)).take(pa.array(point)).append_column(name, pa.array(np.sqrt(out)))

    schema = StructType([*own.select(*OBJECT).schema.fields, StructField(name, DoubleType())])
    return in_groups(both, ["cell_id"], ["_rim", "_y", "_x"], nearest, schema)


def nucleus_direction(centroids: DataFrame, nucleus: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """cell_id, organelle, label, distance_from_nucleus_centroid, angle_from_nucleus (atan2 of dy and dx) of each object.

    ``nucleus``: cell_id, y, x of its pixels. Cells without a nucleus have no row.
    The angle is the C library's, as SQL takes it: Java's differs in the last digit, which decides at the edge of a wedge."""

    @F.pandas_udf(DoubleType())
    def angle(dy: pd.Series, dx: pd.Series) -> pd.Series:
        return pd.Series([math.atan2(a, b) for a, b in zip(dy, dx, strict=True)], dtype=float)

    n = nucleus.select("cell_id", "y", "x").distinct().groupBy("cell_id").agg((F.avg("y") * sy).alias("_ny"), (F.avg("x") * sx).alias("_nx"))
    dy, dx = F.col("centroid_y") - F.col("_ny"), F.col("centroid_x") - F.col("_nx")
    found = centroids.join(n, "cell_id").select(*OBJECT, F.hypot(dy, dx).alias("distance_from_nucleus_centroid"), dy.alias("_dy"), dx.alias("_dx"))
    return found.select(*OBJECT, "distance_from_nucleus_centroid", F.when(F.col("_dy").isNotNull() & F.col("_dx").isNotNull(), angle("_dy", "_dx")).alias("angle_from_nucleus"))


def radial_position(to_nucleus: Column, to_edge: Column) -> Column:
    """0 at the nucleus, 1 at the cell's edge, 0.5 if both distances are 0, null without a nucleus."""
    total = to_nucleus + to_edge
    return F.when(total == 0, 0.5).otherwise(to_nucleus / total)


def _overlap(mask: DataFrame) -> DataFrame:
    """(cell_id, y, x, organelle_a, organelle_b) of each pixel that a pair of organelles shares."""
    b = mask.withColumnRenamed("organelle", "organelle_b")
    pair = mask.withColumnRenamed("organelle", "organelle_a").join(b, ["cell_id", "y", "x"]).where("organelle_a < organelle_b")
    signal = lambda c: F.coalesce(*(F.when(F.col(c).contains(s), s) for s in SAME_SIGNAL))
    return pair.where(~F.coalesce(signal("organelle_a") != signal("organelle_b"), F.lit(False)))


def _contact_mask(px: DataFrame) -> DataFrame:
    return px.where(~F.col("organelle").isin(*COMPARTMENTS)).select("cell_id", "organelle", "y", "x").distinct()


def contact_sites(px: DataFrame) -> DataFrame:
    """cell_id, organelle_a, organelle_b, n_contacts: 4-connected parts of each pair's overlap, pairs as in ``contacts``."""
    pair = _overlap(_contact_mask(px))
    at = lambda y, x: F.struct("cell_id", "organelle_a", "organelle_b", y.alias("y"), x.alias("x"))
    y, x = F.col("y"), F.col("x")
    spots = pair.select(at(y, x).alias("src"), F.explode(F.array(at(y + 1, x), at(y, x + 1))).alias("dst"))
    own = pair.select(at(y, x).alias("src"), at(y, x).alias("dst"))  # parts of one pixel
    edges = spots.join(own.select("dst"), "dst", "left_semi").select("src", "dst").unionByName(own)
    roots = connected_components(edges).select("component.*").distinct()
    return roots.groupBy("cell_id", "organelle_a", "organelle_b").agg(F.count("*").alias("n_contacts"))


def mask_box(px: DataFrame) -> DataFrame:
    """(cell_id, organelle, y0, y1, x0, x1): first and last row and column of each mask; an empty mask has no row."""
    return px.groupBy("cell_id", "organelle").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def mask_shapes(px: DataFrame) -> DataFrame:
    """(cell_id, n_shapes) of cells whose masks differ in height or width."""
    return px.groupBy("cell_id").agg(F.count_distinct(F.struct("height", "width")).alias("n_shapes")).where("n_shapes > 1")


def require_one_shape(px: DataFrame) -> DataFrame:
    """``px``, or an error that names cells whose masks differ in shape: a join of
    pixels would take them for masks of one crop."""
    wrong = mask_shapes(px).limit(5).collect()
    if wrong:
        raise ValueError(f"masks of different shapes in cells {[r['cell_id'] for r in wrong]}")
    return px


def localized(px: DataFrame, cell: str, nucleus: str, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """Where each object lies: cell_id, organelle, label, distance_from_cell_edge,
    distance_from_nucleus, distance_from_nucleus_centroid, angle_from_nucleus,
    normalized_radial_position. ``cell`` and ``nucleus`` name the masks; what needs
    one that the cell lacks is null. Whole compartments are no objects."""
    objects = px.where(~F.col("organelle").isin(cell, nucleus, *NOT_LOCALIZED))
    centre = shape(objects, sy, sx).select(*OBJECT, "centroid_y", "centroid_x")
    rim = boundary(px.where(F.col("organelle").isin(cell, nucleus)))
    out = centre.select(*OBJECT)
    for mask, name in ((cell, "distance_from_cell_edge"), (nucleus, "distance_from_nucleus")):
        out = out.join(edge_distances(centre, rim.where(F.col("organelle") == mask), name, sy, sx), list(OBJECT), "left")
    out = out.join(nucleus_direction(centre, px.where(F.col("organelle") == nucleus), sy, sx), list(OBJECT), "left")
    return out.withColumn("normalized_radial_position", radial_position(F.col("distance_from_nucleus"), F.col("distance_from_cell_edge")))


def localization_summary(located: DataFrame) -> DataFrame:
    """(cell_id, organelle, metric, sum, mean, median, std, min, max, count) of the four
    located metrics that have a value; the deviation of a single value is 0."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in LOCATED))
    rows = located.select("cell_id", "organelle", F.inline(pairs)).where("value is not null")
    made = [F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count")]
    return rows.groupBy("cell_id", "organelle", "metric").agg(*made)


def contacts(px: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """cell_id, organelle_a, organelle_b, overlap_area, overlap_frac_a, overlap_frac_b
    of each pair (a < b) of organelles that share pixels in a cell.

    Whole compartments make no pair, nor do two signals of one source. Masks of
    one cell must have one height and width, if the table has them."""
    mask = _contact_mask(require_one_shape(px) if {"height", "width"} <= set(px.columns) else px)
    size = mask.groupBy("cell_id", "organelle").agg(F.count("*").alias("_size"))
    pair = _overlap(mask)
    shared = pair.groupBy("cell_id", "organelle_a", "organelle_b").agg(F.count("*").alias("_n"))
    out = shared
    for k in "ab":
        out = out.join(size.select("cell_id", F.col("organelle").alias(f"organelle_{k}"), F.col("_size").alias(f"_size_{k}")), ["cell_id", f"organelle_{k}"])
    return out.select(
        "cell_id", "organelle_a", "organelle_b", (F.col("_n") * (sy * sx)).alias("overlap_area"),
        (F.col("_n") / F.col("_size_a")).alias("overlap_frac_a"), (F.col("_n") / F.col("_size_b")).alias("overlap_frac_b"),
    )


def spatial_features(px: DataFrame, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """``contacts`` with ``n_contacts``, the connected parts of each pair's overlap."""
    return contacts(px, sy, sx).join(contact_sites(px), ["cell_id", "organelle_a", "organelle_b"])


def radial_fractions(px: DataFrame) -> DataFrame:
    """Share of each mask's pixels in five shells of ``r`` (clipped to 0 to 1), one column for each."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r")))
    shell = [(r >= lo) & ((r < hi) if k < 4 else F.lit(True)) for k, (lo, hi) in enumerate(zip(SHELLS, SHELLS[1:], strict=False))]
    return px.where(F.col("r").isNotNull()).groupBy("cell_id", "organelle").agg(*((F.count_if(s) / F.count("*")).alias(f"radial_frac_bin{k}") for k, s in enumerate(shell)))


def radial_anisotropy(px: DataFrame, wedges: int = 8) -> DataFrame:
    """Population deviation over mean of the pixel counts in equal wedges of ``theta`` (-pi to pi), empty wedges included."""
    k = F.least(F.floor((F.col("theta") + math.pi) / (2 * math.pi / wedges)), F.lit(wedges - 1)).cast("int")
    counts = [F.count_if(k == j).cast("double") for j in range(wedges)]
    mean = sum(counts[1:], counts[0]) / wedges
    spread = F.sqrt(sum(((c - mean) * (c - mean) for c in counts[1:]), (counts[0] - mean) * (counts[0] - mean)) / wedges)
    return px.where(F.col("theta").isNotNull()).groupBy("cell_id", "organelle").agg((spread / mean).alias("radial_anisotropy"))


def radial_features(located: DataFrame) -> DataFrame:
    """(cell_id, organelle, radial_frac_bin0 to 4, radial_anisotropy) of the objects of
    ``localized``: the shares of shells of their normalised position, and the spread over wedges of their angle.
    Objects without a position are left out, organelles of cells without one (no
    nucleus, no edge) have no row."""
    r = located.withColumn("r", F.col("normalized_radial_position")).withColumn("theta", F.col("angle_from_nucleus"))
    return radial_fractions(r).join(radial_anisotropy(r), ["cell_id", "organelle"], "left")


def box_counts(px: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Occupied boxes of each mask for each box size."""
    rows = px.select("cell_id", "organelle", "y", "x", F.explode(F.array(*(F.lit(s) for s in sizes))).alias("size"))
    box = F.struct(F.floor(F.col("y") / F.col("size")), F.floor(F.col("x") / F.col("size")))
    return rows.groupBy("cell_id", "organelle", "size").agg(F.count_distinct(box).alias("boxes"))


def fractal_dimension(px: DataFrame, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 32), least: int = 4) -> DataFrame:
    """Slope of log boxes against log 1/size; null with fewer than ``least`` sizes up to half of the mask's extent."""
    extent = px.groupBy("cell_id", "organelle").agg((F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")) + 1).alias("_extent"))
    used = box_counts(px, sizes).join(extent, ["cell_id", "organelle"]).where(F.col("size") * 2 <= F.col("_extent"))
    slope = F.regr_slope(F.log(F.col("boxes").cast("double")), F.log(1 / F.col("size")))
    return used.groupBy("cell_id", "organelle").agg(F.when(F.count("*") >= least, slope).alias("fractal_dimension"))


def neighbours(px: DataFrame, keys: list[str], steps: tuple[tuple[int, int], ...], name: str) -> DataFrame:
    """keys, y, x of every pixel and ``name``: how many of its neighbours at the given steps are in the same mask."""
    mask = px.select(*keys, "y", "x").distinct()
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))
    sent = mask.select(*keys, "y", "x", F.explode(moves).alias("_s")).select(*keys, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))
    votes = sent.groupBy(*keys, "y", "x").agg(F.count("*").alias(name))
    return mask.join(votes, [*keys, "y", "x"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
DIAGONAL = ((-1, -1), (-1, 1), (1, -1), (1, 1))


def perimeter(px: DataFrame) -> DataFrame:
    """Perimeter of each object in pixels: its border pixels weighed by how the
    border goes on around them (straight 1, diagonal the root of 2, a bend the mean of both)."""
    keys = list(OBJECT)
    border = neighbours(px, keys, FOUR, "_n4").where("_n4 < 4").select(*keys, "y", "x")
    both = neighbours(border, keys, FOUR, "_n4").join(neighbours(border, keys, DIAGONAL, "_nd"), [*keys, "y", "x"])
    root = math.sqrt(2)
    # public scikit-image weights of 1 + 2 * straight + 10 * diagonal neighbours on the border
    code = 1 + 2 * F.col("_n4") + 10 * F.col("_nd")
    weight = F.when(code.isin(5, 7, 15, 17, 25, 27), 1.0).when(code.isin(21, 33), root).when(code.isin(13, 23), (1 + root) / 2).otherwise(0.0)
    return both.groupBy(*keys).agg(F.sum(weight).alias("perimeter"))


def perimeter_crofton(px: DataFrame) -> DataFrame:
    """Perimeter of each object in pixels by Crofton's formula in four directions:
    how often lines along rows, columns and both diagonals leave the object."""
    keys = list(OBJECT)
    mask = px.select(*keys, "y", "x").distinct()
    leaves = {}
    for k, step in enumerate(((0, 1), (1, 0), (1, 1), (1, -1))):
        leaves[f"_l{k}"] = neighbours(mask, keys, (step,), f"_l{k}")
    out = mask
    for name, df in leaves.items():
        out = out.join(df, [*keys, "y", "x"])
    count = [F.sum(1 - F.col(name)) for name in leaves]
    straight, diagonal = math.pi / 4, math.pi / (4 * math.sqrt(2))
    return out.groupBy(*keys).agg((straight * (count[0] + count[1]) + diagonal * (count[2] + count[3])).alias("perimeter_crofton"))


def area_convex(px: DataFrame) -> DataFrame:
    """(cell_id, organelle, label, area_convex): pixels whose centres lie in the convex
    hull of the middles of the object's pixel sides. An object's pixels, bounded by
    its crop, meet in one task; many objects are worked on at once."""
    from cytofold.operators.raster import in_groups

    mask = px.where("y is not null and x is not null").select(*OBJECT, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    schema = StructType([*mask.select(*OBJECT).schema.fields, StructField("area_convex", LongType())])

    def count(part: pa.Table) -> pa.Table:
        start = np.flatnonzero(part.column("_new").to_numpy())
        area = hull_pixels(part.column("y").to_numpy(), part.column("x").to_numpy(), start)
        return part.select(list(OBJECT)).take(pa.array(start)).append_column("area_convex", pa.array(area))

    return in_groups(mask, list(OBJECT), ["y", "x"], count, schema)


def _hull_side(group: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points (group, at, value) of the lower convex hull of each of ``n`` groups of points,
    sorted by group and place. Every step takes the next point of all groups at once."""
    head = np.searchsorted(group, np.arange(n + 1))
    size = np.diff(head)
    stack, top = np.empty(len(at), np.int64), np.zeros(n, np.int64)  # a group's stack lies where its points lie
    order = np.argsort(-size, kind="stable")
    longer = len(size) - np.searchsorted(np.sort(size), np.arange(size.max(initial=0)), side="right")
    for k in range(size.max(initial=0)):
        own = order[: longer[k]]
        point = head[own] + k
        turn = np.arange(len(own))
        while True:
            turn = turn[top[own[turn]] > 1]
            g, p = own[turn], point[turn]
            b, a = stack[head[g] + top[g] - 1], stack[head[g] + top[g] - 2]
            above = (value[b] - value[a]) * (at[p] - at[a]) >= (value[p] - value[a]) * (at[b] - at[a])
            turn = turn[above]
            if not len(turn):
                break
            top[own[turn]] -= 1
        stack[head[own] + top[own]] = point
        top[own] += 1
    kept = stack[np.arange(len(at)) - np.repeat(head[:-1], size) < np.repeat(top, size)]
    return group[kept], at[kept], value[kept]


def hull_pixels(y: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each object, whose pixels begin at ``start`` and are sorted by y and x, the pixels in the hull of
    the side middles of its pixels; in doubled coordinates all are whole numbers."""
    n = len(start)
    if not n:
        return np.zeros(0, np.int64)
    own = np.repeat(np.arange(n), np.diff(np.r_[start, len(y)]))
    first = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(y) != 0)])
    last = np.r_[first[1:], len(y)] - 1
    row, obj = 2 * y[first], own[first]
    # every row from an object's first to its last, also those without pixels
    a = np.flatnonzero(np.r_[True, np.diff(obj) != 0])
    low, high = row[a] // 2, row[np.r_[a[1:], len(row)] - 1] // 2
    n_rows = high - low + 1
    asked = np.repeat(np.arange(n), n_rows)
    r = 2 * (np.arange(n_rows.sum()) - np.repeat(np.cumsum(n_rows) - n_rows, n_rows) + np.repeat(low, n_rows))
    least = r.min() - 2
    wide = int(r.max() - least + 4)

    def side(middle: np.ndarray) -> np.ndarray:
        """The least even column at or right of the hull's left side in each row asked for."""
        g, at, v = np.repeat(obj, 3), np.repeat(row, 3) + np.tile([-1, 0, 1], len(row)), np.repeat(middle, 3) - np.tile([0, 1, 0], len(row))
        by = np.lexsort((v, at, g))
        g, at, v = g[by], at[by], v[by]
        one = np.r_[True, (np.diff(g) != 0) | (np.diff(at) != 0)]  # of one place the outer point
        g, at, v = _hull_side(g[one], at[one], v[one], n)
        j = np.searchsorted(g * wide + at - least, asked * wide + r - least, side="right")
        i = j - 1
        return -((-(v[i] * (at[j] - at[i]) + (v[j] - v[i]) * (r - at[i]))) // (2 * (at[j] - at[i])))

    left, right = side(2 * x[first]), -side(-2 * x[last])
    return np.bincount(asked, np.maximum(0, right - left + 1), n).astype(np.int64)


def cell_features(px: DataFrame, cell: str = "cell", sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """cell_id and the features of the first 8-connected part, in reading order, of
    each cell's mask: area, perimeter, axes, aspect ratio, solidity, extent,
    orientation, circularity and seven Hu moments (in pixels). The perimeter is in
    pixels times the mean of the spacings, which are equal in practice."""
    from cytofold.operators.raster import label_pixels

    parts = label_pixels(px.where(F.col("organelle") == cell), "cell_id", eight=True)
    first = parts.groupBy("cell_id").agg(F.min("root").alias("root"))
    own = parts.join(first, ["cell_id", "root"], "left_semi").select("cell_id", F.lit(cell).alias("organelle"), F.lit(1).alias("label"), "y", "x", F.lit(1.0).alias("value"))
    keys = list(OBJECT)
    out = shape(own, sy, sx).join(perimeter(own), keys).join(area_convex(own), keys).join(weighted_hu(own), keys)
    length = F.col("perimeter") * ((sy + sx) / 2)
    low = F.when(F.col("axis_minor_length") > 0, F.col("axis_minor_length")).otherwise(1.0)
    return out.select(
        "cell_id", F.col("area").alias("cell_area"), length.alias("cell_perimeter"), F.col("axis_major_length").alias("cell_axis_major_length"), low.alias("cell_axis_minor_length"),
        (F.col("axis_major_length") / low).alias("cell_aspect_ratio"), (F.col("n") / F.col("area_convex")).alias("cell_solidity"), F.col("extent").alias("cell_extent"),
        F.col("orientation").alias("cell_orientation"), F.when(length > 0, 4 * math.pi * F.col("area") / (length * length)).otherwise(1.0).alias("cell_circularity"),
        *(F.col(f"moments_weighted_hu_{k}").alias(f"cell_hu_moment_{k}") for k in range(7)),
    )


def euler_number(px: DataFrame) -> DataFrame:
    """Objects less holes (pixels touching at corners are one): corners less sides plus faces of the pixel squares."""
    from cytofold.operators.raster import in_groups

    mask = px.where("y is not null and x is not null").select(*OBJECT, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    schema = StructType([*mask.select(*OBJECT).schema.fields, StructField("euler_number", LongType())])

    def count(part: pa.Table) -> pa.Table:
        start = np.flatnonzero(part.column("_new").to_numpy())
        y, x = part.column("y").to_numpy(), part.column("x").to_numpy()
        own = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(y)]))
        high, wide = int(y.max() - y.min()) + 2, int(x.max() - x.min()) + 2
        code = (own * high + y - y.min()) * wide + x - x.min()
        different = lambda *steps: np.bincount(np.unique(np.concatenate([code + s for s in steps])) // (high * wide), minlength=len(start))
        number = different(0) - different(0, 1) - different(0, wide) + different(0, 1, wide, wide + 1)
        return part.select(list(OBJECT)).take(pa.array(start)).append_column("euler_number", pa.array(number.astype(np.int64)))

    return in_groups(mask, list(OBJECT), ["y", "x"], count, schema)


def area_filled(px: DataFrame, key: str = "object_id") -> DataFrame:
    """(key, n, n_filled): pixels of each object without and with its holes, the
    4-connected background parts that do not reach the edge of its bounding box."""
    from cytofold.operators.raster import label_pixels

    mask = px.select(key, "y", "x").distinct()
    box = mask.groupBy(key).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    grid = box.select(key, "y0", "y1", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("y")).select("*", F.explode(F.sequence("x0", "x1")).alias("x"))
    empty = grid.join(mask, [key, "y", "x"], "left_anti")
    parts = label_pixels(empty, key).join(box, key)
    edge = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    holes = parts.groupBy(key, "root").agg(F.count("*").alias("_n"), F.max(edge).alias("_edge")).where("not _edge").groupBy(key).agg(F.sum("_n").alias("_holes"))
    return box.select(key, "n").join(holes, key, "left").select(key, "n", (F.col("n") + F.coalesce("_holes", F.lit(0))).alias("n_filled"))


def polygon_area(points: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Area of the closed polygon of each key's points in order (shoelace)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    last = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ny, nx = F.coalesce(F.lead("y").over(w), F.first("y").over(last)), F.coalesce(F.lead("x").over(w), F.first("x").over(last))
    crossed = points.withColumn("_c", F.col("x") * ny - nx * F.col("y"))
    return crossed.groupBy(*keys).agg((F.abs(F.sum("_c")) / 2).alias("mesh_area"))


def mesh_summary(areas: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation and sum of the mesh areas of each key."""
    return areas.groupBy(*keys).agg(F.avg("mesh_area").alias("mesh_area_mean"), F.stddev_samp("mesh_area").alias("mesh_area_std"), F.sum("mesh_area").alias("mesh_area_sum"))
