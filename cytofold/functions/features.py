"""Feature dimension: unit and category of a metric, parsing of feature names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the statistics.
STATISTICS = ("mean", "median", "std", "sum", "min", "max", "count")
CONTACT_METRICS = ("overlap_area", "overlap_frac_a", "overlap_frac_b", "n_contacts")

# Unit of each metric.
UNITS = {
    "area": "um^2",
    "perimeter": "um",
    "perimeter_crofton": "um",
    "axis_major_length": "um",
    "axis_minor_length": "um",
    "equivalent_diameter_area": "um",
    "area_convex": "um^2",
    "area_filled": "um^2",
    "solidity": "ratio",
    "extent": "ratio",
    "eccentricity": "ratio",
    "aspect_ratio": "ratio",
    "circularity": "ratio",
    "orientation": "radians",
    "area_fraction": "ratio",
    "euler_number": "count",
    "count": "count",
    "centroid_y": "um",
    "centroid_x": "um",
    "centroid_weighted_y": "um",
    "centroid_weighted_x": "um",
    "intensity_mean": "AU",
    "intensity_max": "AU",
    "intensity_min": "AU",
    "intensity_std": "AU",
    "intensity_median": "AU",
    "intensity_q25": "AU",
    "intensity_q75": "AU",
    "intensity_iqr": "AU",
    "intensity_mad": "AU",
    "intensity_integrated": "AU",
    "intensity_range": "AU",
    "intensity_cv": "ratio",
    "moments_weighted_hu_0": "ratio",
    "moments_weighted_hu_1": "ratio",
    "moments_weighted_hu_2": "ratio",
    "moments_weighted_hu_3": "ratio",
    "moments_weighted_hu_4": "ratio",
    "moments_weighted_hu_5": "ratio",
    "moments_weighted_hu_6": "ratio",
    "inertia_eigval_0": "ratio",
    "inertia_eigval_1": "ratio",
    "distance_from_cell_edge": "um",
    "distance_from_nucleus": "um",
    "distance_from_nucleus_centroid": "um",
    "normalized_radial_position": "ratio",
    "branch_length": "um",
    "branch_thickness": "um",
    "total_branch_length": "um",
    "tortuosity": "ratio",
    "num_branches": "count",
    "num_nodes": "count",
    "num_endpoints": "count",
    "branch_count": "count",
    "average_degree": "ratio",
    "branching_density": "1/um^2",
    "network_length_density": "um/um^2",
    "skeleton_pixel_count": "count",
    "num_skeleton_components": "count",
    "overlap_area": "um^2",
    "overlap_frac_a": "ratio",
    "overlap_frac_b": "ratio",
    "n_contacts": "count",
    "radial_anisotropy": "ratio",
}


def units(spark: SparkSession) -> DataFrame:
    """(metric, unit), a few dozen rows."""
    return spark.createDataFrame(list(UNITS.items()), "metric string, unit string")


def with_unit(df: DataFrame, metric: str = "metric") -> DataFrame:
    """``unit`` by a join with the fixed unit table (a few dozen rows, so it is
    broadcast); radial fractions are ratios, other metrics "unknown"."""
    known = F.broadcast(units(df.sparkSession).withColumnRenamed("metric", "_metric").withColumnRenamed("unit", "_unit"))
    joined = df.drop("unit").join(known, F.col(metric) == F.col("_metric"), "left")
    unit = F.coalesce("_unit", F.when(F.col(metric).startswith("radial_frac_bin"), "ratio"), F.lit("unknown"))
    return joined.withColumn("unit", unit).drop("_metric", "_unit")


def category(metric: Column) -> Column:
    """Feature category of a metric name."""
    return (
        F.when(metric.contains("intensity"), "intensity")
        .when(metric.contains("distance_from") | metric.contains("normalized_radial"), "localization")
        .when(metric.contains("radial_frac_bin") | metric.contains("radial_anisotropy"), "distribution")
        .otherwise("morphology")
    )


def parse_names(features: DataFrame, organelles: DataFrame) -> DataFrame:
    """(feature, organelle, metric, aggregation, category) from wide names.

    ``cell_`` and ``cp_cell_`` names are morphology of the cell;
    ``network_{organelle}_{metric}_{aggregation}`` of a network;
    ``contact_{a}__{b}_{metric}`` of a pair; others are
    ``{organelle}_{metric}_{aggregation}`` or ``{organelle}_count``. Of several
    organelles that fit, the longest; names with none keep organelle null and
    category "unknown". Every prefix that ends at an underscore is joined with
    the known organelles, so none is compared with all of them."""
    pattern = "_(" + "|".join(STATISTICS) + ")$"
    name = F.col("feature")
    kind = F.when(name.startswith("cell_"), "cell").when(name.startswith("cp_cell_"), "cp_cell").when(name.startswith("network_"), "network").when(name.startswith("contact_"), "contact").otherwise("object")
    tail = F.when(kind == "object", name).otherwise(F.substr(name, F.length(kind) + 2, F.length(name)))
    rows = features.select("feature").distinct().select("feature", kind.alias("_kind"), tail.alias("_tail"))
    own, measured = F.col("_kind").isin("cell", "cp_cell"), F.col("_kind").isin("network", "object")
    rows = rows.withColumn("aggregation", F.when(measured, F.nullif(F.regexp_extract("_tail", pattern, 1), F.lit(""))))
    rows = rows.withColumn("_rest", F.when(measured, F.regexp_replace("_tail", pattern, "")).otherwise(F.col("_tail")))
    parts = F.split("_rest", "_")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    known = organelles.select("organelle").distinct().withColumnRenamed("organelle", "_start")
    found = rows.where(measured).select("feature", F.explode(starts).alias("_start")).join(known, "_start").groupBy("feature").agg(F.max_by("_start", F.length("_start")).alias("_organelle"))
    out = rows.join(found, "feature", "left")
    suffix = "_(" + "|".join(CONTACT_METRICS) + ")$"
    whole = F.col("_rest") == F.col("_organelle")
    organelle = F.when(own, F.col("_kind")).when(F.col("_kind") == "contact", F.regexp_replace("_rest", suffix, "")).otherwise(F.col("_organelle"))
    metric = (
        F.when(F.col("_kind") == "contact", F.regexp_extract("_rest", suffix, 1))
        .when(whole, F.when((F.col("_kind") == "object") & (F.col("aggregation") == "count"), "count").otherwise(""))
        .when(F.col("_organelle").isNotNull(), F.substr("_rest", F.length("_organelle") + 2, F.length("_rest")))
        .otherwise(F.col("_rest"))
    )
    out = out.withColumns({"organelle": organelle, "metric": metric, "aggregation": F.when(whole & (F.col("_kind") == "object"), None).otherwise(F.col("aggregation"))})
    named = F.when(own, "cell_morphology").when(F.col("_kind").isin("network", "contact"), F.col("_kind")).when(F.col("organelle").isNull() | (F.col("metric") == ""), "unknown").otherwise(category(F.col("metric")))
    return out.withColumn("category", named).select("feature", "organelle", "metric", "aggregation", "category")
