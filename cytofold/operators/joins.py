"""Joins: attach with preference, nearest neighbour in a radius, lookup, expansion, votes and adjacency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir, spread


def semi_either(cells: DataFrame, targets: DataFrame, first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    """Cells that a target names by the first keys or by the second.

    Two flags by two equi-joins with distinct keys instead of one join on an OR,
    which could only be a nested loop."""
    out = cells
    for k, keys in enumerate((first, second)):
        known = targets.select(*(F.col(c).alias(f"_{k}{c}") for c in keys)).where(" and ".join(f"_{k}{c} is not null" for c in keys)).distinct().withColumn(f"_hit{k}", F.lit(True))
        on = [F.col(c) == F.col(f"_{k}{c}") for c in keys]
        out = out.join(known, on, "left").drop(*(f"_{k}{c}" for c in keys))
    return out.where(F.coalesce("_hit0", F.lit(False)) | F.coalesce("_hit1", F.lit(False))).drop("_hit0", "_hit1")


def attach_one(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], order: Column | str) -> DataFrame:
    """Left join that adds ``columns`` of the first row of each key of ``right`` in the given order."""
    row = right.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return left.join(row, keys, "left").select(*left.columns, *(F.col(f"_row.{c}").alias(c) for c in columns))


def attach_preferred(left: DataFrame, right: DataFrame, group: list[str], preferred: str, fallback: str, right_id: str, value: str, order: str) -> DataFrame:
    """``value`` of the row of ``right`` whose ``right_id`` is the preferred id, else
    the fallback id; of duplicates the last by ``order``. ``matched_by`` says which key hit."""
    last = right.where(F.col(right_id).isNotNull()).groupBy(*group, right_id).agg(F.max_by(value, order).alias("_value"))
    out = left
    for k, key in enumerate((preferred, fallback)):
        side = last.select(*(F.col(g).alias(f"_g{k}{i}") for i, g in enumerate(group)), F.col(right_id).alias(f"_id{k}"), F.col("_value").alias(f"_v{k}"), F.lit(True).alias(f"_h{k}"))
        on = [F.col(g) == F.col(f"_g{k}{i}") for i, g in enumerate(group)] + [F.col(key) == F.col(f"_id{k}")]
        out = out.join(side, on, "left").drop(f"_id{k}", *(f"_g{k}{i}" for i in range(len(group))))
    by = F.when(F.col("_h0"), preferred).when(F.col("_h1"), fallback)
    chosen = F.when(F.col("_h0"), F.col("_v0")).otherwise(F.col("_v1"))
    return out.withColumns({value: chosen, "matched_by": by}).drop("_v0", "_v1", "_h0", "_h1")


def nearest_within(queries: DataFrame, points: DataFrame, group: list[str], radius: float, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """(query_id, point_id, distance): the nearest point within ``radius`` in the
    same group; ties to the smaller point_id; queries without one have no row.

    Of points at one place only the smallest id counts. Points are hashed into square
    cells, and a query looks into the nine cells around its own. The first side is the
    radius halved so often that a point's cell holds about two; who finds a point
    within the side is done, the others look again in cells of twice the side, up to the
    radius. So the pairs grow with the rows, not with their square, unless queries stand
    apart from crowded points. Rows with null coordinates take no part.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    at = lambda c, side: F.floor(F.col(c) / side).cast("long")
    near = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    cell = [*group, "_gx", "_gy"]
    p = points.where("x is not null and y is not null").groupBy(*group, F.col("x").alias("_px"), F.col("y").alias("_py")).agg(F.min(point_id).alias(point_id)).checkpoint()
    held = p.groupBy(*group, at("_px", radius).alias("_gx"), at("_py", radius).alias("_gy")).agg(F.count("*").alias("_n"))
    crowd = held.agg(F.sum(F.col("_n").cast("double") * F.col("_n")) / F.sum("_n")).first()[0] or 0.0
    deepest = min(24, max(0, math.ceil(math.log(max(crowd, 1.0) / 2, 4))))
    # queries with no point in any of their nine largest cells are out at once
    seen = held.select(*group, "_gx", "_gy", F.explode(near).alias("_s")).select(*group, (F.col("_gx") + F.col("_s.dx")).alias("_gx"), (F.col("_gy") + F.col("_s.dy")).alias("_gy")).distinct()
    q = queries.where("x is not null and y is not null").select(*group, F.col(query_id), F.col("x").alias("_qx"), F.col("y").alias("_qy"))
    q = q.withColumns({"_gx": at("_qx", radius), "_gy": at("_qy", radius)}).join(seen, cell, "left_semi").drop("_gx", "_gy").checkpoint()
    d = F.sqrt(F.pow(F.col("_qx") - F.col("_px"), 2) + F.pow(F.col("_qy") - F.col("_py"), 2))
    out = None
    for level in range(deepest, -1, -1):
        side = radius / 2**level
        around = q.withColumn("_s", F.explode(near)).select(*group, query_id, "_qx", "_qy", (at("_qx", side) + F.col("_s.dx")).alias("_gx"), (at("_qy", side) + F.col("_s.dy")).alias("_gy"))
        placed = p.withColumns({"_gx": at("_px", side), "_gy": at("_py", side)})
        # a little less than the side, so that rounding hides no nearer point in a cell beyond
        reach = radius if level == 0 else side * 0.999
        close = spread(around, 9 * q.count(), *cell).join(placed, cell).withColumn("distance", d).where(F.col("distance") <= reach)
        best = close.groupBy(query_id).agg(F.min(F.struct("distance", point_id)).alias("_best"))
        if level:
            best = best.checkpoint()
            q = q.join(best.select(query_id), query_id, "left_anti").checkpoint()
        out = best if out is None else out.unionByName(best)
    return out.select(query_id, F.col(f"_best.{point_id}").alias(point_id), F.col("_best.distance").alias("distance"))


def attach_exact_then_near(cells: DataFrame, features: DataFrame, keys: list[str], group: list[str], radius: float, cell_id: str = "cell_id", row_id: str = "row_id") -> DataFrame:
    """(cell_id, row_id, match): the first row of equal keys ("exact"), else the
    nearest in ``radius`` ("near"), else null."""
    first = features.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.min(row_id).alias("_exact"))
    exact = cells.join(first, keys, "left")
    rest = exact.where("_exact is null").select(*group, F.col(cell_id).alias("query_id"), "x", "y")
    near = nearest_within(rest, features.withColumnRenamed(row_id, "point_id"), group, radius).select(F.col("query_id").alias(cell_id), F.col("point_id").alias("_near"))
    match = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "near")
    return exact.join(near, cell_id, "left").select(cell_id, F.coalesce("_exact", "_near").alias(row_id), match.alias("match"))


def preferred_coordinates(own_x: Column, own_y: Column, other_x: Column, other_y: Column) -> tuple[Column, Column]:
    """The other session's coordinates where both are known, else the own ones."""
    both = other_x.isNotNull() & other_y.isNotNull()
    return F.when(both, other_x).otherwise(own_x), F.when(both, other_y).otherwise(own_y)


def resolve_channel(cells: DataFrame, channel_map: DataFrame, experiment: str, channel: str, unresolved: str = "keep") -> DataFrame:
    """``physical`` by (experiment, channel); ``resolved`` is false where the map
    has no entry. Such rows are kept, dropped ("drop") or an error that names a few
    pairs ("fail"). The map is hand-made configuration of a few thousand rows."""
    known = channel_map.groupBy(experiment, channel).agg(F.min("physical").alias("physical"))
    out = cells.join(known, [experiment, channel], "left").withColumn("resolved", F.col("physical").isNotNull())
    if unresolved == "fail":
        missing = out.where("not resolved").select(experiment, channel).distinct().limit(20).collect()
        if missing:
            raise ValueError(f"channels without an entry in the map: {[tuple(r) for r in missing]}")
    return out.where("resolved") if unresolved == "drop" else out


def attach_metadata(features: DataFrame, metadata: DataFrame, key: str, fill: float | None = None) -> DataFrame:
    """Features with the metadata of their key, those without any too. If the keys
    differ in type both are compared as text. Missing numbers among the features
    become ``fill`` if it is given, metadata stay null; a column that both have is the metadata's."""
    own = features.select(*(c for c in features.columns if c == key or c not in metadata.columns))
    if fill is not None:
        own = own.fillna(fill)
    if dict(own.dtypes)[key] != dict(metadata.dtypes)[key]:
        own, metadata = (df.withColumn(key, F.col(key).cast("string")) for df in (own, metadata))
    return own.join(metadata, key, "left")


def expand_channels(cells: DataFrame, channels: DataFrame, experiment: str) -> DataFrame:
    """One row of each cell for the phase channel (rank 1) and each other channel
    of its experiment, ranked by (shown, physical)."""
    w = Window.partitionBy(experiment).orderBy("shown", "physical")
    dim = channels.distinct().withColumn("channel_rank", F.row_number().over(w) + 1)
    phase = channels.select(experiment).distinct().select(experiment, F.lit("Phase").alias("shown"), F.lit("phase").alias("physical"), F.lit(1).alias("channel_rank"))
    return cells.join(dim.unionByName(phase), experiment)


def majority_label(pixels: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key, ties to the smallest, and its count."""
    votes = pixels.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("_n"))
    best = votes.groupBy(key).agg(F.max(F.struct("_n", (-F.col(label)).alias("_low"))).alias("_best"))
    return best.select(key, (-F.col("_best._low")).alias(label), F.col("_best._n").alias("votes"))
