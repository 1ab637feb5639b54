from pyspark.sql import functions as F

from cytofold import catalog

SF = "/root/testdata/sf0.001"


def test_every_order_is_a_tile(spark):
    out = catalog.QUERIES["i23_stitch_orders"](spark, SF)
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert out.select(F.floor(F.col("label") / 100)).distinct().count() == orders
    assert out.where("floor(label / 100) <> floor(merged / 100)").count() == 0
