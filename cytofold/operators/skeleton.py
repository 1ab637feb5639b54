"""Branches of skeletons as rows, from pixel tables.

Every step from a skeleton pixel to a neighbour is a directed edge; the edge after
it goes on from a pixel with two neighbours and ends at any other. Doubling the
reach of these pointers brings every edge to the last one of its path in as many
rounds as the logarithm of the longest path; what is known of a branch are then
grouped sums over its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir
from cytofold.operators.raster import RING, label_pixels
from cytofold.operators.relief import distance_transform, pixel_code


def skeleton_steps(skeleton: DataFrame, key: str) -> DataFrame:
    """(key, p, steps): the code y * 2**20 + x of each skeleton pixel and a bit for each
    neighbour it steps to, in the order of ``RING``. A diagonal step counts only where no
    straight pair of steps does the same."""
    px = skeleton.where("y is not null and x is not null").select(key, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    to = F.array(F.struct(F.col("y"), F.col("x"), F.lit(0).alias("bit")), *(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(RING)))
    seen = px.select(key, F.explode(to).alias("s")).groupBy(key, F.col("s.y").alias("y"), F.col("s.x").alias("x")).agg(F.sum("s.bit").alias("code"), F.max((F.col("s.bit") == 0).cast("int")).alias("own"))
    has = lambda k: F.col("code").bitwiseAND(1 << (k % 8)) != 0
    steps = sum((F.when(has(k) & ~(has(k - 1) | has(k + 1)), 1 << k).otherwise(0) for k in (1, 3, 5, 7)), F.col("code").bitwiseAND(0b01010101))
    return seen.where("own = 1").select(key, pixel_code().alias("p"), steps.cast("int").alias("steps"))


def branches(skeleton: DataFrame, key: str, mask: DataFrame | None = None, sy: float = 1.0, sx: float = 1.0, max_rounds: int = 40) -> DataFrame:
    """(key, src, dst, kind, length, chord, component) and, with ``mask``, thickness: one
    row a branch of the skeletons (key, y, x).

    A branch leads from one pixel with other than two neighbours to another, or to
    itself; a closed curve without such a pixel begins at its first one. src and dst are
    pixel codes, the smaller end first; kind is 0 between two free ends, 1 with one, 2
    between junctions, 3 closed; length adds up the steps and chord joins the ends, both
    scaled by sy and sx; component is the smallest code of the connected skeleton.
    thickness is twice the median distance to the background of ``mask`` (key, y, x,
    height, width) along the branch, its ends included. Single pixels have no branch."""
    ensure_checkpoint_dir(skeleton.sparkSession)
    steps = skeleton_steps(skeleton, key).checkpoint()
    parts = label_pixels(steps.select(key, F.shiftright("p", 20).alias("y"), F.col("p").bitwiseAND((1 << 20) - 1).alias("x")), key, eight=True)
    parts = parts.select(key, pixel_code().alias("p"), F.col("root").alias("component"))
    node = F.bit_count("steps") != 2
    closed = steps.join(parts, [key, "p"]).groupBy(key, "component").agg(F.max(node.cast("int")).alias("n")).where("n = 0").select(key, F.col("component").alias("p"), F.lit(True).alias("first"))
    pixel = steps.join(closed, [key, "p"], "left").select(key, "p", "steps", (node | F.coalesce("first", F.lit(False))).alias("node")).checkpoint()
    # an edge is 8 times its pixel and the number of its direction
    turn = F.explode(F.filter(F.array(*(F.lit(k) for k in range(8))), lambda k: F.getbit("steps", k) == 1)).alias("k")
    edge = pixel.select(key, F.col("p").alias("u"), F.col("node").alias("starts"), turn)
    shift = F.element_at(F.array(*(F.lit(dy * (1 << 20) + dx) for dy, dx in RING)), F.col("k") + 1)
    size = F.element_at(F.array(*(F.lit(float(((dy * sy) ** 2 + (dx * sx) ** 2) ** 0.5)) for dy, dx in RING)), F.col("k") + 1)
    edge = edge.select(key, (F.col("u") * 8 + F.col("k")).alias("id"), "u", (F.col("u") + shift).alias("v"), ((F.col("k") + 4) % 8).alias("back"), size.alias("step"), "starts")
    ahead = pixel.select(key, F.col("p").alias("v"), F.col("steps").alias("_s"), F.col("node").alias("_ends"))
    on = F.expr("_s - shiftleft(1, back)")
    edge = edge.join(ahead, [key, "v"]).select(key, "id", "u", "v", "step", "starts", F.when(~F.col("_ends"), F.col("v") * 8 + F.log2(on).cast("int")).alias("next")).checkpoint()
    # pointer: the last edge known on the path, and whether it is the last of all
    reach = edge.select(key, "id", F.coalesce("next", "id").alias("to"), F.col("next").isNull().alias("done")).checkpoint()
    for _ in range(max_rounds):
        going = reach.where("not done")
        if going.isEmpty():
            break
        there = reach.select(key, F.col("id").alias("to"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        further = going.select(key, "id", "to").join(there, [key, "to"]).select(key, "id", F.col("_to").alias("to"), F.col("_done").alias("done"))
        reach = reach.where("done").unionByName(further).checkpoint()
    else:
        raise RuntimeError(f"a path is longer than 2**{max_rounds} steps")
    path = edge.join(reach.select(key, "id", "to"), [key, "id"])
    one = path.groupBy(key, "to").agg(F.max(F.when(F.col("starts"), F.struct(F.col("u").alias("src"), F.col("v").alias("second")))).alias("a"), F.max(F.when(F.col("id") == F.col("to"), F.struct(F.col("v").alias("dst"), F.col("u").alias("last")))).alias("z"), F.sum("step").alias("length"))
    # each branch was walked both ways; the one from its smaller end stays
    one = one.select(key, "to", "a.src", "a.second", "z.dst", "z.last", "length").where("src < dst or src = dst and second <= last").checkpoint()
    free = pixel.where(F.bit_count("steps") == 1).select(key, "p", F.lit(1).alias("free"))
    for end in ("src", "dst"):
        one = one.join(free.select(key, F.col("p").alias(end), F.col("free").alias(f"_{end}")), [key, end], "left")
    ends = F.coalesce("_src", F.lit(0)) + F.coalesce("_dst", F.lit(0))
    kind = F.when(F.col("src") == F.col("dst"), 3).when(ends == 2, 0).when(ends == 1, 1).otherwise(2)
    y, x = (lambda c: F.shiftright(c, 20)), (lambda c: F.col(c).bitwiseAND((1 << 20) - 1))
    chord = F.hypot((y("src") - y("dst")) * sy, (x("src") - x("dst")) * sx)
    out = one.withColumns({"kind": kind, "chord": chord}).join(parts.withColumnRenamed("p", "src"), [key, "src"])
    names = [key, "src", "dst", "kind", "length", "chord", "component"]
    if mask is None:
        return out.select(*names)
    depth = distance_transform(mask, key, sy, sx).select(key, pixel_code().alias("p"), "distance")
    on_path = path.join(one.select(key, "to"), [key, "to"], "left_semi").select(key, "to", F.col("v").alias("p")).unionByName(one.select(key, "to", F.col("src").alias("p")))
    wide = on_path.join(depth, [key, "p"]).groupBy(key, "to").agg((2 * F.median("distance")).alias("thickness"))
    return out.join(wide, [key, "to"], "left").select(*names, "thickness")
