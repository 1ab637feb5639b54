from pyspark.sql import functions as F

from cytofold.functions import features
from cytofold.functions import names as N


def test_parsed_names(spark):
    rows = [
        ("cell_area", "cell", "area", None, "cell_morphology"),
        ("cp_cell_solidity", "cp_cell", "solidity", None, "cell_morphology"),
        ("network_er_tubular_total_branch_length_mean", "er_tubular", "total_branch_length", "mean", "network"),
        ("network_er_num_nodes", "er", "num_nodes", None, "network"),
        ("contact_er__golgi_overlap_frac_a", "er__golgi", "overlap_frac_a", None, "contact"),
        ("contact_er__golgi", "er__golgi", "", None, "contact"),
        ("er_intensity_mean_std", "er", "intensity_mean", "std", "intensity"),
        ("er_tubular_distance_from_nucleus_max", "er_tubular", "distance_from_nucleus", "max", "localization"),
        ("er_radial_frac_bin0", "er", "radial_frac_bin0", None, "distribution"),
        ("er_count", "er", "count", None, "morphology"),
        ("er_mean", "er", "", None, "unknown"),
        ("erbium_area_sum", None, "erbium_area", "sum", "unknown"),
    ]
    made = spark.createDataFrame([(r[0],) for r in rows], "feature string")
    organelles = spark.createDataFrame([("er",), ("er_tubular",), ("golgi",)], "organelle string")
    assert sorted(map(tuple, features.parse_names(made, organelles).collect())) == sorted(rows)


def test_label_filter_and_reasons(spark):
    labels = spark.createDataFrame([(x,) for x in ("cell_mask", "nuclei", "cp_cell_mask", "er_seg", "cp1_er_seg", "CP2_x")], "label string")
    kept = lambda **k: sorted(r.label for r in labels.where(N.label_wanted(F.col("label"), **k)).collect())
    core = ["cell_mask", "cp_cell_mask", "nuclei"]
    assert kept() == sorted(r.label for r in labels.collect())
    assert kept(modality="phase") == sorted([*core, "er_seg"])
    assert kept(modality="fluorescent") == sorted([*core, "cp1_er_seg", "CP2_x"])
    assert kept(modality="phase", explicit=("CP2_x", "absent")) == sorted([*core, "CP2_x"])
    try:
        N.label_wanted(F.col("label"), "other")
        raise AssertionError
    except ValueError:
        pass
    pairs = spark.createDataFrame([("x", "phase"), ("x", "gfp_nuclei"), ("No label autofluor", "gfp"), ("no label (bleed)", "gfp"), ("no label, empty", "gfp"), ("no label", "gfp"), ("er", "gfp")], "v string, p string")
    assert [r.r for r in pairs.select(N.exclusion_reason(F.col("v"), F.col("p")).alias("r")).collect()] == [None, "DAPI registration", "autofluorescence", "bleedthrough", "empty well", "no label", None]
    assert [r.r is None for r in labels.select(N.skip_reason(F.concat("label", F.lit("_Prediction"))).alias("r")).collect()] == [False] * 6
    rows = spark.createDataFrame([("blob", "frangi", "tubular", "gfp"), (None, "threshold", "vesicular", "labelfree"), (None, None, "vesicular", "labelfree"), (None, None, "nucleoli", "phase2d")], "r string, c string, s string, t string")
    assert [x.m for x in rows.select(N.resolved_method(*(F.col(k) for k in "rcst")).alias("m")).collect()] == ["blob", "threshold", "blob", "frangi"]


def test_centre_crop(spark):
    rows = spark.createDataFrame([(1000, 1000, (244, 756, 244, 756)), (10000, 20000, (4500, 5500, 9000, 11000)), (300, 900, (0, 300, 194, 706))], "h int, w int, want array<int>".replace("array<int>", "struct<a:int,b:int,c:int,d:int>"))
    out = rows.select("want", N.centre_crop(F.col("h"), F.col("w"), 0.01).alias("box")).collect()
    assert [tuple(r.box) for r in out] == [tuple(r.want) for r in out]
