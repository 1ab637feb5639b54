"""Network measures over branch tables (cell_id, organelle, branch, src, dst, kind, length, chord, component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NET = ("cell_id", "organelle")


def tortuosity(branches: DataFrame) -> DataFrame:
    """Branches with length over chord; 1 for a closed branch."""
    return branches.withColumn("tortuosity", F.when(F.col("chord") == 0, 1.0).otherwise(F.col("length") / F.col("chord")))


def node_degrees(branches: DataFrame) -> DataFrame:
    """(cell_id, organelle, node, degree) of the ends of branches that are no isolated stubs (kind above 0)."""
    return branches.where("kind > 0").select(*NET, F.explode(F.array("src", "dst")).alias("node")).groupBy(*NET, "node").agg(F.count("*").alias("degree"))


def endpoints(branches: DataFrame) -> DataFrame:
    """Nodes of branches with a free end (kind 1) that no junction-to-junction branch (kind 2) touches."""
    ends = branches.where("kind = 1").select(*NET, F.explode(F.array("src", "dst")).alias("node")).distinct()
    inner = branches.where("kind = 2").select(*NET, F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(inner, [*NET, "node"], "left_anti")


def skeleton_counts(skeleton: DataFrame, key: str) -> DataFrame:
    """(key, skeleton_pixel_count, num_skeleton_components) of skeleton pixels (key, y, x), 8-connected."""
    from cytofold.operators.raster import label_pixels

    return label_pixels(skeleton, key, eight=True).groupBy(key).agg(F.count("*").alias("skeleton_pixel_count"), F.count_distinct("root").alias("num_skeleton_components"))


def without_specks(skeleton: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Skeleton pixels in 4-connected parts of ``least`` pixels or more."""
    from cytofold.operators.raster import sized_objects

    return sized_objects(skeleton, key, least).select(key, "y", "x")


def component_labels(skeleton: DataFrame, objects: DataFrame) -> DataFrame:
    """(cell_id, organelle, component, label): the object that most pixels of a
    skeleton's component lie in, ties to the smallest label; components outside all objects have no row."""
    keys = [*NET, "component"]
    votes = skeleton.join(objects.select(*NET, "y", "x", "label"), [*NET, "y", "x"]).groupBy(*keys, "label").agg(F.count("*").alias("_n"))
    return votes.groupBy(*keys).agg(F.max_by("label", F.struct("_n", (-F.col("label")).alias("_low"))).alias("label"))


def object_networks(branches: DataFrame, labels: DataFrame) -> DataFrame:
    """Per skeleton component that lies in an object: label, branches, nodes of
    branches beyond isolated ones, endpoints no such branch has, mean degree of the
    nodes over all branches, and means of length, thickness and tortuosity."""
    keys = [*NET, "component"]
    base = tortuosity(branches).groupBy(*keys).agg(
        F.count("*").alias("num_branches"), F.avg("length").alias("branch_length"), F.avg("thickness").alias("branch_thickness"), F.avg("tortuosity").alias("tortuosity")
    )
    ends = branches.select(*keys, "kind", F.explode(F.array("src", "dst")).alias("node"))
    node = ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"), F.max((F.col("kind") > 0).cast("int")).alias("_junction"), F.max((F.col("kind") < 2).cast("int")).alias("_end"))
    counts = node.groupBy(*keys).agg(
        F.sum("_junction").alias("num_nodes"), F.count_if((F.col("_junction") == 0) & (F.col("_end") == 1)).alias("num_endpoints"),
        F.coalesce(F.avg(F.when(F.col("_junction") == 1, F.col("degree"))), F.lit(0.0)).alias("average_degree"),
    )
    return labels.join(base, keys).join(counts, keys)


def network_summary(branches: DataFrame, hull_area: DataFrame | None = None) -> DataFrame:
    """Per network: branches, nodes, endpoints, mean degree (0 if none), lengths,
    the longest component, and densities over ``hull_area`` (cell_id, organelle,
    area_convex) if given."""
    base = branches.groupBy(*NET).agg(F.count("*").alias("num_branches"), F.sum("length").alias("total_branch_length"))
    degree = node_degrees(branches).groupBy(*NET).agg(F.count("*").alias("num_nodes"), F.avg("degree").alias("average_degree"))
    ends = endpoints(branches).groupBy(*NET).agg(F.count("*").alias("num_endpoints"))
    longest = branches.groupBy(*NET, "component").agg(F.sum("length").alias("_length")).groupBy(*NET).agg(F.max("_length").alias("largest_connected_component_size"))
    out = base
    for part in (degree, ends, longest):
        out = out.join(part, list(NET), "left")
    out = out.fillna({"num_nodes": 0, "num_endpoints": 0, "average_degree": 0.0})
    if hull_area is not None:
        area = F.nullif(F.col("area_convex").cast("double"), F.lit(0.0))
        out = out.join(hull_area, list(NET), "left").withColumns({"network_length_density": F.col("total_branch_length") / area, "branching_density": F.col("num_branches") / area}).drop("area_convex")
    return out
