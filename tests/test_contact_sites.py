import math

from cytofold import catalog
from cytofold.operators import pixels as P

SF = "/root/testdata/sf0.001"


def test_contact_sites_and_nucleus_direction(spark):
    a = [(y, x) for y in range(3) for x in range(9)]
    b = [(0, 0), (0, 1), (1, 2), (2, 8), (9, 9)]  # (1, 2) touches (0, 1) by a corner only
    rows = [("c", "a", 1, y, x, 1.0) for y, x in a] + [("c", "b", 1, y, x, 1.0) for y, x in b] + [("c", "cell", 1, y, x, 1.0) for y, x in a]
    px = spark.createDataFrame(rows, "cell_id string, organelle string, label int, y int, x int, value double")
    assert [tuple(r) for r in P.contact_sites(px).collect()] == [("c", "a", "b", 3)]
    centres = spark.createDataFrame([("c", "a", 1, 3.0, 1.0), ("d", "a", 1, 0.0, 0.0)], "cell_id string, organelle string, label int, centroid_y double, centroid_x double")
    nucleus = spark.createDataFrame([("c", 0, 0), ("c", 2, 0)], "cell_id string, y int, x int")
    (row,) = P.nucleus_direction(centres, nucleus).collect()
    assert math.isclose(row.distance_from_nucleus_centroid, math.hypot(2, 1)) and math.isclose(row.angle_from_nucleus, math.atan2(2, 1))


def test_every_contact_has_sites(spark):
    pairs = ["cell_id", "organelle_a", "organelle_b"]
    sites = catalog.QUERIES["fc_contact_sites"](spark, SF)
    assert sites.select(*pairs).exceptAll(catalog.QUERIES["fc_contacts"](spark, SF).select(*pairs)).count() == 0
    assert sites.count() == catalog.QUERIES["fc_contacts"](spark, SF).count() and sites.where("n_contacts < 1").count() == 0
    assert catalog.QUERIES["fl03_nucleus_direction"](spark, SF).count() > 0
