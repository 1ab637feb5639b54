"""Raster steps over tiles and pixel tables: histograms and thresholds, size
filter, labelling, erosion, tile grids and stitching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from cytofold.operators.graph import connected_components, connected_components_in_ranges, ensure_checkpoint_dir, local_components
from cytofold.operators.stencils import ridges, smoothed  # noqa: F401
from cytofold.shipping import on_executors


def histogram(values: DataFrame, key: str, value: str = "value", bins: int = 256) -> DataFrame:
    """(key, bin, n, lo, width): counts in equal bins between each key's least and
    largest value, the last bin closed. Keys of one value only have width 0."""
    span = values.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    joined = values.where(F.col(value).isNotNull()).join(span, key)
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return joined.groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first(width).alias("width"))


def otsu(hist: DataFrame, key: str) -> DataFrame:
    """Threshold of largest between-class variance: the centre of its bin, the first of equals."""
    centre = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    up = Window.partitionBy(key).orderBy("bin")
    down = Window.partitionBy(key).orderBy(F.desc("bin"))
    h = hist.withColumn("c", centre)
    h = h.withColumns({"w1": F.sum("n").over(up), "s1": F.sum(F.col("n") * F.col("c")).over(up), "wr": F.sum("n").over(down), "sr": F.sum(F.col("n") * F.col("c")).over(down)})
    # the second class begins in the next occupied bin
    h = h.withColumns({"w2": F.lead("wr").over(up), "s2": F.lead("sr").over(up)})
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    scored = h.withColumn("v", F.col("w1") * F.col("w2") * gap * gap)
    best = scored.where("v is not null").groupBy(key).agg(F.max_by(F.struct("c", "bin"), F.struct("v", (-F.col("bin")).alias("_b"))).alias("b"))
    return best.select(key, F.col("b.c").alias("otsu"), F.col("b.bin").alias("otsu_bin"))


def size_filter(pixels: DataFrame, keys: list[str], pixel_area: float, least: float, most: float | None = None) -> DataFrame:
    """Pixels of objects whose area lies within the limits."""
    area = F.count("*") * pixel_area
    ok = pixels.groupBy(*keys).agg(area.alias("_area")).where((F.col("_area") >= least) & (F.col("_area") <= (most if most is not None else float("inf"))))
    return pixels.join(ok.select(*keys), keys, "left_semi")


def label_pixels(mask: DataFrame, key: str, eight: bool = False, block: int = 512) -> DataFrame:
    """(key, y, x, root): connected pixels of each key share a root, the smallest
    y * 2**20 + x among them. Coordinates are from 0 to 2**20; keys are of any type.

    Squares of ``block`` pixels are labelled whole, many small ones at a time; only
    what touches a square's border goes through the joins of ``connected_components``."""
    spark = mask.sparkSession
    ensure_checkpoint_dir(spark)
    on_executors(spark)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    px = mask.select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).where("y is not null and x is not null").distinct()
    px = px.withColumns({"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})

    def label(part: pa.Table) -> pa.Table:
        """Whole squares at once; a square's number stands above the codes of its pixels."""
        y, x = part.column("y").to_numpy(), part.column("x").to_numpy()
        code = (y << 20) + x
        wide, a, b = ((np.cumsum(part.column("_new").to_numpy()) - 1) << 41) + code, [], []
        for dy, dx in steps:
            want = wide + dy * (1 << 20) + dx
            at = np.minimum(np.searchsorted(wide, want), len(wide) - 1)
            hit = np.flatnonzero((wide[at] == want) & (x + dx >= 0) & (x + dx < 1 << 20))
            a.append(hit)
            b.append(at[hit])
        root = local_components(len(code), np.concatenate(a), np.concatenate(b))
        edge = (y % block == 0) | (x % block == 0) | (y % block == block - 1) | (x % block == block - 1)
        return part.drop_columns(["_new"]).append_column("_part", pa.array(code[root])).append_column("_edge", pa.array(edge))

    made = StructType([*px.schema.fields, StructField("_part", LongType()), StructField("_edge", BooleanType())])
    local = in_groups(px, [key, "_by", "_bx"], ["y", "x"], label, made).checkpoint()
    node = F.struct(F.col(key).alias("key"), F.col("_part").alias("part"))
    rim = local.where("_edge")
    sent = rim.select(key, "_by", "_bx", node.alias("src"), F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))).alias("_to"))
    sent = sent.select(key, F.col("_by").alias("_cy"), F.col("_bx").alias("_cx"), "src", "_to.y", "_to.x")
    met = sent.join(rim.select(key, "y", "x", "_by", "_bx", node.alias("dst")), [key, "y", "x"]).where("_by <> _cy or _bx <> _cx")
    comps = connected_components(met.select("src", "dst").distinct()).select(F.col("node.key").alias(key), F.col("node.part").alias("_part"), F.col("component.part").alias("_root"))
    out = local.join(comps, [key, "_part"], "left")
    return out.select(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce("_root", "_part").alias("root"))


def in_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table], pa.Table], schema: StructType, least: int = 0) -> DataFrame:
    """``work`` on whole groups of ``keys``, sorted by ``order``, as many at a time as an Arrow
    batch, or ``least`` rows, holds; ``_new`` marks the first row of each. So small groups cost no call each."""
    on_executors(df.sparkSession)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_new").to_numpy(zero_copy_only=False))
            if len(begins) and (held or begins[-1]) and sum(b.num_rows for b in held) + begins[-1] >= least:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks()).to_batches()
                held = [batch.slice(begins[-1])]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.withColumn("_new", first).mapInArrow(run, schema)


def relabel(labelled: DataFrame, key: str) -> DataFrame:
    """(key, y, x, label): labels from 1 in each key, in order of their first pixel."""
    order = Window.partitionBy(key).orderBy("root")
    names = labelled.select(key, "root").distinct().withColumn("label", F.row_number().over(order))
    return labelled.join(names, [key, "root"]).select(key, "y", "x", "label")


def sized_objects(mask: DataFrame, key: str, least: int, eight: bool = False) -> DataFrame:
    """(key, y, x, root) of connected parts of ``least`` pixels or more."""
    labelled = label_pixels(mask, key, eight)
    enough = labelled.groupBy(key, "root").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return labelled.join(enough.select(key, "root"), [key, "root"], "left_semi").select(key, "y", "x", "root")


def fill_holes(mask: DataFrame, key: str) -> DataFrame:
    """Pixels of each key's mask and of the 4-connected background parts that do not
    reach the edge of the mask's bounding box."""
    px = mask.select(key, "y", "x").distinct()
    box = px.groupBy(key).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    grid = box.select("*", F.explode(F.sequence("y0", "y1")).alias("y")).select("*", F.explode(F.sequence("x0", "x1")).alias("x"))
    parts = label_pixels(grid.join(px, [key, "y", "x"], "left_anti"), key).join(box, key)
    edge = (F.col("y") == F.col("y0")) | (F.col("y") == F.col("y1")) | (F.col("x") == F.col("x0")) | (F.col("x") == F.col("x1"))
    open_ = parts.where(edge).select(key, "root").distinct()
    return px.unionByName(parts.join(open_, [key, "root"], "left_anti").select(key, "y", "x"))


def moved(mask: DataFrame, key: str, steps: list[tuple[int, int]], least: int = 1) -> DataFrame:
    """Pixels that at least ``least`` of the moved copies of the mask cover: 1 dilates
    by the steps, their number erodes by the mirrored steps."""
    px = mask.select(key, "y", "x").distinct()
    to = F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps))
    sent = px.select(key, F.explode(to).alias("_p")).select(key, "_p.y", "_p.x")
    return sent.distinct() if least == 1 else sent.groupBy(key, "y", "x").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key, "y", "x")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]


def opened(mask: DataFrame, key: str, steps: list[tuple[int, int]]) -> DataFrame:
    """Union of all copies of the structuring element that lie in the mask."""
    inside = moved(mask, key, [(-y, -x) for y, x in steps], len(steps))
    return moved(inside, key, steps)


def closed(mask: DataFrame, key: str, steps: list[tuple[int, int]]) -> DataFrame:
    """Dilation and then erosion. ``mask`` has height and width; beyond the image is background in both."""
    size = mask.groupBy(key).agg(F.max("height").alias("_h"), F.max("width").alias("_w"))
    wide = moved(mask, key, steps).join(size, key).where("y >= 0 and x >= 0 and y < _h and x < _w")
    kept = moved(wide, key, [(-y, -x) for y, x in steps], len(steps)).join(size, key).where("y >= 0 and x >= 0 and y < _h and x < _w")
    return kept.select(key, "y", "x")


def tubular_mask(mask: DataFrame, key: str, least: int = 5, size: int = 2, fill: bool = False) -> DataFrame:
    """Cleaned mask of elongated structures: holes filled if asked for, opened by a
    square of ``size``, 4-connected parts below ``least`` pixels dropped."""
    px = fill_holes(mask, key) if fill else mask
    px = opened(px, key, [(y, x) for y in range(size) for x in range(size)]) if size else px
    return sized_objects(px, key, least).select(key, "y", "x")


def round_mask(mask: DataFrame, key: str, least: int = 20, opening: int = 1, closing: int = 3, depth: int = 2) -> DataFrame:
    """Cleaned mask of round structures: opened and closed by disks, holes filled,
    4-connected parts kept that are deeper than ``depth`` somewhere (all of a key's,
    if none is) and have ``least`` pixels. ``mask`` has height and width."""
    size = mask.groupBy(key).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    px = opened(mask, key, disk(opening)) if opening else mask.select(key, "y", "x").distinct()
    if closing:
        px = fill_holes(closed(px.join(size, key), key, disk(closing)), key)
    labelled = label_pixels(px, key)
    near = disk(depth)
    deep = moved(px, key, near, len(near))
    seeded = labelled.join(deep, [key, "y", "x"], "left_semi").select(key, "root").distinct()
    none = labelled.select(key).distinct().join(seeded.select(key).distinct(), key, "left_anti")
    kept = labelled.join(seeded, [key, "root"], "left_semi").unionByName(labelled.join(none, key, "left_semi").select(key, "root", "y", "x"))
    enough = kept.groupBy(key, "root").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return kept.join(enough.select(key, "root"), [key, "root"], "left_semi").select(key, "y", "x")


def inside_eroded(labels: DataFrame, mask: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Label pixels that lie in ``mask`` eroded by n pixels (square); the whole mask is eroded, so tiles leave no trace."""
    return labels.join(erode(mask, key, n), [key, "y", "x"], "left_semi")


def gated(px: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    """Pixels inside the gate's mask."""
    return px.join(gate.select(key, "y", "x").distinct(), [key, "y", "x"], "left_semi")


#: The eight neighbours in turn, from the one above.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def thinned(mask: DataFrame, key: str) -> DataFrame:
    """(key, y, x) of the one-pixel skeletons of the masks by alternating parallel
    peels (Zhang and Suen). A round asks every pixel for its neighbours by one
    grouped sum a peel; rounds end when none goes, after about half the width of
    the thickest part. Each round is checkpointed."""
    ensure_checkpoint_dir(mask.sparkSession)
    now = mask.select(key, "y", "x").distinct().checkpoint()
    left, before = now.count(), -1
    while left != before:
        for half in (0, 1):
            to = F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(RING)))
            around = now.select(key, F.explode(to).alias("_p")).groupBy(key, F.col("_p.y").alias("y"), F.col("_p.x").alias("x")).agg(F.sum("_p.bit").alias("_code"))
            set_ = [F.col("_code").bitwiseAND(1 << k) != 0 for k in range(8)]
            count = sum((s.cast("int") for s in set_[1:]), set_[0].cast("int"))
            turns = sum(((~set_[k] & set_[(k + 1) % 8]).cast("int") for k in range(1, 8)), (~set_[0] & set_[1]).cast("int"))
            up, right, down, side = set_[0], set_[2], set_[4], set_[6]
            kept = (up & right & down) | (right & down & side) if half == 0 else (up & right & side) | (up & down & side)
            # a pixel without neighbours has no code and stays
            gone = around.where((count >= 2) & (count <= 6) & (turns == 1) & ~kept)
            now = now.join(gone, [key, "y", "x"], "left_anti")
        now, before = now.checkpoint(), left
        left = now.count()
    return now


def equalised(px: DataFrame, key: str, block: int = 64, clip: float = 0.01, bins: int = 256) -> DataFrame:
    """(key, y, x, value): contrast-limited adaptive equalisation of whole images. Each
    block's histogram is clipped, what is cut off spread over all bins, and summed
    up to a curve; a pixel takes the curves of the four blocks around it, weighted
    by their distance. An image of one value becomes 0."""
    span = px.groupBy(key).agg(F.min("value").cast("double").alias("_lo"), F.max("value").cast("double").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    level = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    rows = px.select(key, "y", "x", "value", "height", "width").join(span, key).withColumn("level", level).select(key, "y", "x", "height", "width", "level")
    at = [key, "_by", "_bx"]
    counts = rows.where("level is not null").groupBy(key, F.floor(F.col("y") / block).cast("int").alias("_by"), F.floor(F.col("x") / block).cast("int").alias("_bx"), "level").agg(F.count("*").alias("_n"))
    size = counts.groupBy(*at).agg(F.sum("_n").alias("_all"))
    top = F.greatest(F.lit(1.0), clip * F.col("_all"))
    cut = counts.join(size, at).withColumns({"_kept": F.least(F.col("_n").cast("double"), top), "_spare": F.greatest(F.col("_n") - top, F.lit(0.0))})
    spare = cut.groupBy(*at).agg(F.sum("_spare").alias("_spare"), F.first("_all").alias("_all"))
    # every level of every block, so that a pixel finds the curves of its neighbours
    grid = spare.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(cut.select(*at, "level", "_kept"), [*at, "level"], "left")
    up = Window.partitionBy(*at).orderBy("level")
    curve = grid.select(*at, "level", ((F.sum(F.coalesce("_kept", F.lit(0.0))).over(up) + F.col("_spare") * (F.col("level") + 1) / bins) / F.col("_all")).alias("_c"))

    def corners(c: str, size: str):
        n = F.ceil(F.col(size) / block)
        place = F.greatest(F.lit(0.0), F.least((F.col(c) + 0.5) / block - 0.5, (n - 1).cast("double")))
        low = F.least(F.floor(place), F.greatest(n - 2, F.lit(0)))
        part = place - low
        return F.array(F.struct(low.cast("int").alias("b"), (1 - part).alias("w")), F.struct(F.least(low + 1, n - 1).cast("int").alias("b"), part.alias("w")))

    sent = rows.withColumn("_p", F.explode(corners("y", "height"))).withColumn("_q", F.explode(corners("x", "width")))
    sent = sent.select(key, "y", "x", "level", F.col("_p.b").alias("_by"), F.col("_q.b").alias("_bx"), (F.col("_p.w") * F.col("_q.w")).alias("_w"))
    met = sent.join(curve, [*at, "level"], "left")
    return met.groupBy(key, "y", "x").agg(F.sum(F.coalesce(F.col("_w") * F.col("_c"), F.lit(0.0))).alias("value"))


def effectiveness(hist: DataFrame, key: str) -> DataFrame:
    """(key, effectiveness): share of the histogram's variance that lies between the
    two classes of Otsu's threshold; null if all values are equal."""
    c = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    at = hist.withColumn("c", c).join(otsu(hist, key), key)
    low = F.col("bin") <= F.col("otsu_bin")
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("c")), F.sum(F.col("n") * F.col("c") * F.col("c"))
    n1, s1 = F.sum(F.when(low, F.col("n"))), F.sum(F.when(low, F.col("n") * F.col("c")))
    m = at.groupBy(key).agg(n.alias("n"), s.alias("s"), q.alias("q"), n1.alias("n1"), s1.alias("s1"))
    gap = F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / F.nullif(F.col("n") - F.col("n1"), F.lit(0))
    between = F.col("n1") * (F.col("n") - F.col("n1")) / F.pow("n", F.lit(2.0)) * gap * gap
    total = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))
    return m.select(key, F.when(total > 0, between / total).alias("effectiveness"))


def triangle(hist: DataFrame, key: str) -> DataFrame:
    """(key, triangle): centre of the bin farthest from the line between the
    histogram's peak and the end of its longer tail, the first of equals."""
    peak = F.max_by("bin", F.struct("n", (-F.col("bin")).alias("_b")))
    ends = hist.groupBy(key).agg(peak.alias("_p"), F.max("n").alias("_np"), F.min("bin").alias("_a"), F.max("bin").alias("_z"), F.min_by("n", "bin").alias("_na"), F.max_by("n", "bin").alias("_nz"))
    left = F.col("_p") - F.col("_a") > F.col("_z") - F.col("_p")
    ends = ends.withColumns({"_e": F.when(left, F.col("_a")).otherwise(F.col("_z")), "_ne": F.when(left, F.col("_na")).otherwise(F.col("_nz"))})
    # empty bins of the tail count with height 0
    tail = ends.select("*", F.explode(F.sequence(F.least("_p", "_e"), F.greatest("_p", "_e"))).alias("bin"))
    span = hist.groupBy(key).agg(F.first("lo").alias("lo"), F.first("width").alias("width"))
    rows = tail.join(hist.select(key, "bin", "n"), [key, "bin"], "left").join(span, key)
    line = F.when(F.col("_e") == F.col("_p"), F.col("_np").cast("double")).otherwise(F.col("_np") + (F.col("_ne") - F.col("_np")) * (F.col("bin") - F.col("_p")) / (F.col("_e") - F.col("_p")))
    far = F.max_by(F.struct("bin", "lo", "width"), F.struct((line - F.coalesce("n", F.lit(0))).alias("_d"), (-F.col("bin")).alias("_b")))
    return rows.groupBy(key).agg(far.alias("_t")).select(key, (F.col("_t.lo") + (F.col("_t.bin") + 0.5) * F.col("_t.width")).alias("triangle"))


def multi_otsu(hist: DataFrame, key: str) -> DataFrame:
    """(key, low, high): the two thresholds, centres of their bins, that part the
    histogram into three classes with the largest variance between them, the first
    of equals; null with fewer than three occupied bins. Every pair of occupied bins
    of one key is tried, 256 of them at most by the histogram's size."""
    up = Window.partitionBy(key).orderBy("bin")
    c = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    h = hist.withColumn("c", c).withColumns({"w": F.sum("n").over(up), "s": F.sum(F.col("n") * F.col("c")).over(up)})
    whole = hist.withColumn("c", c).groupBy(key).agg(F.sum("n").alias("W"), F.sum(F.col("n") * F.col("c")).alias("S"))
    a = h.select(key, F.col("bin").alias("b1"), F.col("c").alias("c1"), F.col("w").alias("w1"), F.col("s").alias("s1"))
    b = h.select(key, F.col("bin").alias("b2"), F.col("c").alias("c2"), F.col("w").alias("w2"), F.col("s").alias("s2"))
    pairs = a.join(b, key).where("b1 < b2").join(whole, key).where("w2 < W")
    part = lambda s, w: F.pow(s, F.lit(2.0)) / w
    spread = part(F.col("s1"), F.col("w1")) + part(F.col("s2") - F.col("s1"), F.col("w2") - F.col("w1")) + part(F.col("S") - F.col("s2"), F.col("W") - F.col("w2"))
    best = F.max_by(F.struct("c1", "c2"), F.struct(spread.alias("v"), (-F.col("b1")).alias("x"), (-F.col("b2")).alias("y")))
    return whole.select(key).join(pairs.groupBy(key).agg(best.alias("_t")), key, "left").select(key, F.col("_t.c1").alias("low"), F.col("_t.c2").alias("high"))


def li(hist: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """(key, li): the threshold of least cross entropy between the values and the means
    of their two classes, a fixed point over the histogram's bin centres above its
    least value: the logarithmic mean of both class means, from the mean of all on.

    Counts and sums up to each bin are arrays of the histogram's bins, and the rounds
    one expression over them. Null if all values are equal."""
    off = (F.col("bin") + 0.5) * F.col("width")
    up = Window.partitionBy(key).orderBy("bin")
    upto = hist.withColumn("_s", F.sum(F.col("n") * off).over(up)).withColumn("_n", F.sum("n").over(up))
    # the last occupied bin at or before each place holds its sums
    place = upto.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "_n", "_s"))).alias("h"), F.max("_n").alias("N"), F.max("_s").alias("S"), F.first("lo").alias("lo"), F.max("width").alias("width"), F.max("bin").alias("last"))
    fill = F.aggregate(
        F.sequence(F.lit(0), F.col("last")),
        F.struct(F.lit(0).alias("k"), F.array().cast("array<struct<n:double,s:double>>").alias("a")),
        lambda acc, b: F.struct(
            F.when((acc["k"] < F.size("h")) & (F.get("h", acc["k"])["bin"] == b), acc["k"] + 1).otherwise(acc["k"]).alias("k"),
            F.concat(
                acc["a"],
                F.array(F.when((acc["k"] < F.size("h")) & (F.get("h", acc["k"])["bin"] == b), F.struct(F.get("h", acc["k"])["_n"].cast("double").alias("n"), F.get("h", acc["k"])["_s"].cast("double").alias("s"))).otherwise(F.get(acc["a"], b - 1))),
            ).alias("a"),
        ),
    )["a"]
    dense = place.where("width > 0").select(key, "lo", "width", "N", "S", "last", fill.alias("a"))

    def turn(t, _):
        low = F.get("a", F.greatest(F.lit(0), F.least(F.col("last") - 1, F.floor(t / F.col("width") - 0.5).cast("int"))))
        back, front = low["s"] / low["n"], (F.col("S") - low["s"]) / (F.col("N") - low["n"])
        return (back - front) / (F.ln(back) - F.ln(front))

    t = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("S") / F.col("N"), turn)
    return hist.select(key).distinct().join(dense.select(key, (F.col("lo") + t).alias("li")), key, "left")


def log_threshold(values: DataFrame, key: str, factor: float = 1.0, bins: int = 256) -> DataFrame:
    """(key, threshold): ``factor`` times the smaller of Otsu's and the triangle threshold
    of the decimal logarithms of the positive values. A key without positive values has no row."""
    logs = values.where("value > 0").select(key, F.log10("value").alias("value"))
    both = intensity_threshold(logs, key, "otsu", bins).withColumnRenamed("threshold", "_o").join(intensity_threshold(logs, key, "triangle", bins).withColumnRenamed("threshold", "_t"), key)
    return both.select(key, (factor * F.pow(F.lit(10.0), F.least("_o", "_t"))).alias("threshold"))


def log_mask(px: DataFrame, key: str, factor: float = 1.0, bins: int = 256) -> DataFrame:
    """Pixels (key, y, x, value) above their key's ``log_threshold``."""
    return px.join(log_threshold(px, key, factor, bins), key).where("value > threshold").select(px.columns)


def intensity_threshold(values: DataFrame, key: str, method: str = "otsu", bins: int = 256) -> DataFrame:
    """(key, threshold) by "otsu", "triangle", "li", "ave" (mean of Otsu's and the triangle's), "multiotsu" (the
    lower of two; Otsu's where there are not three values) or "median" (of the positive values)."""
    if method == "median":
        return values.groupBy(key).agg(F.coalesce(F.percentile(F.when(F.col("value") > 0, F.col("value")), F.lit(0.5)), F.max("value").cast("double")).alias("threshold"))
    hist = histogram(values, key, bins=bins)
    flat = hist.groupBy(key).agg(F.first("lo").alias("lo"), F.max("width").alias("width"))
    made = {"otsu": lambda: otsu(hist, key).select(key, F.col("otsu").alias("_t")), "triangle": lambda: triangle(hist, key).select(key, F.col("triangle").alias("_t"))}
    made["ave"] = lambda: made["otsu"]().withColumnRenamed("_t", "_o").join(made["triangle"](), key).select(key, ((F.col("_o") + F.col("_t")) / 2).alias("_t"))
    made["li"] = lambda: li(hist, key).withColumnRenamed("li", "_t")
    made["multiotsu"] = lambda: multi_otsu(hist, key).join(made["otsu"](), key, "left").select(key, F.coalesce("low", "_t").alias("_t"))
    if method not in made:
        raise ValueError(f"unknown threshold method {method!r}")
    # one value only: itself, so nothing lies above
    return flat.join(made[method](), key, "left").select(key, F.when(F.col("width") > 0, F.col("_t")).otherwise(F.col("lo")).alias("threshold"))


def above_threshold(px: DataFrame, key: str, method: str = "otsu", factor: float = 1.0, bins: int = 256) -> DataFrame:
    """Pixels (key, y, x, value) whose value exceeds ``factor`` times their key's threshold."""
    t = intensity_threshold(px, key, method, bins)
    return px.join(t, key).where(F.col("value") > F.col("threshold") * factor).select(px.columns)


def masked_objects(px: DataFrame, key: str, method: str = "triangle", adjust: float = 0.98, least: int = 100, bins: int = 256) -> DataFrame:
    """(key, y, x, root): pixels above a threshold of their own object, which is a
    4-connected part of ``least`` pixels above the key's threshold. The object's
    threshold is Otsu's times ``adjust``; a part of one pixel stays."""
    objects = sized_objects(above_threshold(px, key, method, 1.0, bins), key, least)
    own = objects.join(px.select(key, "y", "x", "value"), [key, "y", "x"]).withColumn("_object", F.struct(key, "root"))
    local = intensity_threshold(own.select("_object", "value"), "_object", "otsu", bins)
    size = own.groupBy("_object").agg(F.count("*").alias("_n"))
    kept = own.join(local, "_object").join(size, "_object").where((F.col("_n") < 2) | (F.col("value") > F.col("threshold") * adjust))
    return kept.select(key, "y", "x", "root")


def threshold_sweep(px: DataFrame, key: str, factors: list[float], method: str = "otsu", bins: int = 256) -> DataFrame:
    """(key, factor, n_above, share): what a grid of factors of the threshold would keep. One pass for all factors."""
    t = intensity_threshold(px, key, method, bins)
    joined = px.join(t, key)
    counts = [F.struct(F.lit(float(f)).alias("factor"), F.count_if(F.col("value") > F.col("threshold") * float(f)).alias("n_above")) for f in factors]
    out = joined.groupBy(key).agg(F.count("*").alias("_n"), F.array(*counts).alias("_c")) if factors else joined.groupBy(key).agg(F.count("*").alias("_n"), F.expr("array()").alias("_c"))
    return out.select(key, "_n", F.inline("_c")).select(key, "factor", "n_above", (F.col("n_above") / F.col("_n")).alias("share"))


def blended(tiles_px: DataFrame, grid: DataFrame, overlap: int) -> DataFrame:
    """(image, y, x, value): pixels of overlapping tiles (image, ty, tx, y, x, value in
    image coordinates) as one image. A pixel's weight rises from the tile's edge over
    the overlap along both axes, except at the image's own edge; weights are normalised."""
    box = grid.select("image", "ty", "tx", "y0", "y1", "x0", "x1", "height", "width")

    def ramp(c: str, lo: str, hi: str, size: str):
        up = F.when(F.col(lo) == 0, 1.0).otherwise(F.least(F.lit(1.0), (F.col(c) - F.col(lo) + 1) / (overlap + 1)))
        down = F.when(F.col(hi) >= F.col(size), 1.0).otherwise(F.least(F.lit(1.0), (F.col(hi) - F.col(c)) / (overlap + 1)))
        return up * down

    w = ramp("y", "y0", "y1", "height") * ramp("x", "x0", "x1", "width")
    rows = tiles_px.join(box, ["image", "ty", "tx"]).withColumn("_w", w)
    return rows.groupBy("image", "y", "x").agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("value"))


def core_pixels(tiles_px: DataFrame, grid: DataFrame) -> DataFrame:
    """Of overlapping tiles' pixels (image, ty, tx, y, x, ...) those in the tile's own core: each pixel of an image once."""
    box = grid.select("image", "ty", "tx", "core_y0", "core_y1", "core_x0", "core_x1")
    inside = "y >= core_y0 and y < core_y1 and x >= core_x0 and x < core_x1"
    return tiles_px.join(box, ["image", "ty", "tx"]).where(inside).select(tiles_px.columns)


def crops(boxes: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(crop, y, x, value): pixels of each box (crop, image, y0, x0, y1, x1; ends
    exclusive) in its own coordinates, from square tiles (image, ty, tx, width,
    pixels row by row). A box is sent to the tiles that cover it, no others are read."""
    at = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))
    sent = boxes.where("y1 > y0 and x1 > x0").withColumn("ty", F.explode(at("y0", "y1"))).withColumn("tx", F.explode(at("x0", "x1")))
    met = sent.join(tiles, ["image", "ty", "tx"])
    rows = met.select("crop", "y0", "x0", "y1", "x1", "ty", "tx", "width", F.posexplode("pixels").alias("_i", "value"))
    y, x = F.col("ty") * size + F.floor(F.col("_i") / F.col("width")), F.col("tx") * size + F.col("_i") % F.col("width")
    rows = rows.withColumns({"_y": y, "_x": x}).where("_y >= y0 and _y < y1 and _x >= x0 and _x < x1")
    return rows.select("crop", (F.col("_y") - F.col("y0")).cast("int").alias("y"), (F.col("_x") - F.col("x0")).cast("int").alias("x"), "value")


def erode(mask: DataFrame, key: str, n: int) -> DataFrame:
    """Pixels whose whole square of side 2n+1 lies in the mask; outside the crop is background."""
    steps = F.sequence(F.lit(-n), F.lit(n))
    px = mask.select(key, "y", "x").distinct()
    sent = px.select(key, "y", F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"))
    rows = sent.groupBy(key, "y", "x").agg(F.count("*").alias("_n")).where(F.col("_n") == 2 * n + 1)
    sent = rows.select(key, F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"), "x")
    return sent.groupBy(key, "y", "x").agg(F.count("*").alias("_n")).where(F.col("_n") == 2 * n + 1).select(key, "y", "x")


def dilate(mask: DataFrame, key: str, n: int) -> DataFrame:
    """Pixels within n steps (square) of the mask, clipped to height and width."""
    steps = F.sequence(F.lit(-n), F.lit(n))
    px = mask.select(key, "y", "x", "height", "width").distinct()
    wide = px.select(key, "y", F.explode(F.transform(steps, lambda d: F.col("x") + d)).alias("x"), "height", "width").distinct()
    tall = wide.select(key, F.explode(F.transform(steps, lambda d: F.col("y") + d)).alias("y"), "x", "height", "width").distinct()
    return tall.where("y >= 0 and x >= 0 and y < height and x < width").select(key, "y", "x", "height", "width")


def tile_grid(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """One row for each tile of each image (image, height, width): its span with
    overlap and the core that it owns. Cores cover the image without gaps."""
    step = tile - overlap
    count = lambda c: F.greatest(F.lit(1), F.ceil((F.col(c) - overlap) / step)).cast("int")
    out = images.withColumns({"ny": count("height"), "nx": count("width")})
    out = out.withColumn("ty", F.explode(F.expr("sequence(0, ny - 1)"))).withColumn("tx", F.explode(F.expr("sequence(0, nx - 1)")))
    made = {}
    for d, size, n, t in (("y", "height", "ny", "ty"), ("x", "width", "nx", "tx")):
        begin = F.col(t) * step
        made[f"{d}0"] = begin
        made[f"{d}1"] = F.least(begin + tile, F.col(size))
        made[f"core_{d}0"] = begin
        made[f"core_{d}1"] = F.when(F.col(t) == F.col(n) - 1, F.col(size)).otherwise(begin + step)
    return out.withColumns(made).drop("ny", "nx")


def stitch(edges: DataFrame, offsets: DataFrame) -> DataFrame:
    """(label, merged): global labels that meet across a seam and the smallest label of their group.

    ``edges`` (tile_a, label_a, tile_b, label_b) are touching local labels (0 is
    background); ``offsets`` (tile, offset) makes them global before they are compared."""
    a = offsets.select(F.col("tile").alias("tile_a"), F.col("offset").alias("_oa"))
    b = offsets.select(F.col("tile").alias("tile_b"), F.col("offset").alias("_ob"))
    pairs = edges.where("label_a > 0 and label_b > 0").join(a, "tile_a").join(b, "tile_b")
    named = pairs.select((F.col("label_a") + F.col("_oa")).alias("src"), (F.col("label_b") + F.col("_ob")).alias("dst")).where("src <> dst")
    return connected_components_in_ranges(named).select(F.col("node").alias("label"), F.col("component").alias("merged"))


def seam_pairs(right_edge: DataFrame, left_edge: DataFrame) -> DataFrame:
    """Labels of neighbouring tiles that touch across their seam, straight or diagonally.

    Both tables (seam, tile, at, label) hold the labels along the seam; shifts
    of -1, 0 and 1 make the diagonal an equi-join."""
    a = right_edge.where("label > 0").select("seam", F.col("tile").alias("tile_a"), F.col("label").alias("label_a"), F.explode(F.expr("array(at - 1, at, at + 1)")).alias("at"))
    b = left_edge.where("label > 0").select("seam", F.col("tile").alias("tile_b"), F.col("label").alias("label_b"), "at")
    return a.join(b, ["seam", "at"]).select("tile_a", "label_a", "tile_b", "label_b").distinct()
