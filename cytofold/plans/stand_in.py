"""Views of the supplied star-schema and vector tables as cells, objects, pixels
and points, so that every operator has rows to run on. Columns are selected at
the scan; nothing is cached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytofold.operators.graph import spread

METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
NAMES = [m.removeprefix("l_") for m in METRICS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, organelle, one column a metric): the objects before they are made long, all of a
    cell in one task. A quarter of the rows for grouped aggregates of the metrics."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("organelle"), *(F.col(m).alias(m.removeprefix("l_")) for m in METRICS))
    return spread(wide, li.count(), "cell_id")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, organelle, label, metric, value): a line item is an object of its order."""
    li = table(spark, sf_dir, "lineitem")
    pairs = F.array(*(F.struct(F.lit(m.removeprefix("l_")).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return li.select(F.col("l_orderkey").alias("cell_id"), F.col("l_returnflag").alias("organelle"), F.col("l_linenumber").alias("label"), F.inline(pairs))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells: guide is the customer, gene the nation, experiment the
    region, batch the year, channel the market segment; BUILDING is the control."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey)
    return joined.select(
        F.col("o_orderkey").alias("cell_id"), F.col("c_custkey").alias("guide"), F.col("n_name").alias("gene"), F.col("r_name").alias("experiment"),
        F.year("o_orderdate").alias("batch"), F.col("c_mktsegment").alias("channel"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is an 8 x 8 raster: organelle ``a`` where it is positive, ``b``
    where its size is above 0.1; labels are quadrants. Values are their
    thousandths as whole numbers, so sums are exact."""
    e = table(spark, sf_dir, "embeddings")
    px = spread(e.select(F.col("vec_id").alias("cell_id"), "embedding"), e.count() * 64, "cell_id").select("cell_id", F.posexplode("embedding").alias("i", "v")).select(
        "cell_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.floor(F.col("v").cast("double") * 1000).cast("double").alias("v")
    )
    pick = F.array(F.when(F.col("v") > 0, F.lit("a")), F.when(F.abs("v") > 100, F.lit("b")))
    named = px.select("cell_id", F.explode(F.filter(pick, lambda k: k.isNotNull())).alias("organelle"), (1 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)).cast("int").alias("label"), "y", "x", F.abs("v").alias("value"))
    return named.withColumns({"height": F.lit(8), "width": F.lit(8)})


#: The same views in DuckDB, as common table expressions.
OBJECTS_SQL = """objects AS (
  SELECT l_orderkey AS cell_id, l_returnflag AS organelle, l_linenumber AS label, m.metric, m.value FROM lineitem,
  LATERAL (VALUES ('quantity', l_quantity), ('extendedprice', l_extendedprice), ('discount', l_discount), ('tax', l_tax)) AS m(metric, value))"""
CELLS_SQL = """cells AS (
  SELECT o_orderkey AS cell_id, c_custkey AS guide, n_name AS gene, r_name AS experiment, year(o_orderdate)::INTEGER AS batch,
    c_mktsegment AS channel, o_totalprice AS value, o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PIXELS_SQL = """raw AS (
  SELECT vec_id AS cell_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings
), grid AS (
  SELECT cell_id, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, floor(e::DOUBLE * 1000)::DOUBLE AS v FROM raw
), px AS (
  SELECT cell_id, organelle, (1 + (y // 4) * 2 + (x // 4))::INTEGER AS label, y, x, abs(v) AS value
  FROM (SELECT *, 'a' AS organelle FROM grid WHERE v > 0 UNION ALL SELECT *, 'b' AS organelle FROM grid WHERE abs(v) > 100))"""
