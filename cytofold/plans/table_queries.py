"""Queries for joins, set operations and cleaning."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from cytofold.functions import features
from cytofold.operators import aggregate as A
from cytofold.operators import joins as J
from cytofold.operators import sets as U
from cytofold.operators.graph import ensure_checkpoint_dir
from cytofold.plans.registry import Registry, rounded
from cytofold.plans.stand_in import CELLS_SQL, OBJECTS_SQL, cells, objects, table
from cytofold.sources import tables as S

query = Registry()


@query(
    """WITH t AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)
    SELECT c_custkey, c_nationkey, c_mktsegment FROM customer c WHERE c_custkey IN (SELECT s_suppkey FROM t)
    OR EXISTS (SELECT 1 FROM t WHERE t.s_nationkey = c.c_nationkey AND t.s_suppkey = c.c_custkey % 100)"""
)
def j04_semi_either(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("slot"))
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").withColumn("slot", F.col("c_custkey") % 100)
    return J.semi_either(own, targets, ("c_custkey",), ("c_nationkey", "slot")).drop("slot")


@query(
    """WITH f AS (SELECT l_orderkey AS o_orderkey, arg_min(l_returnflag, l_linenumber * 1e12 + l_partkey * 1e6 + l_suppkey) AS l_returnflag FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, l_returnflag FROM orders LEFT JOIN f USING (o_orderkey)"""
)
def j05_annotate_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", (F.col("l_linenumber") * 1e12 + F.col("l_partkey") * 1e6 + F.col("l_suppkey")).alias("at"))
    return J.attach_one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), li, ["o_orderkey"], ["l_returnflag"], "at")


@query(
    """WITH r AS (SELECT s_nationkey AS g, s_suppkey % 40 AS id, s_acctbal AS v, s_suppkey AS seq FROM supplier),
    k AS (SELECT g, id, arg_max(v, seq) AS v FROM r GROUP BY ALL)
    SELECT c_custkey, CASE WHEN a.id IS NOT NULL THEN a.v ELSE b.v END AS v, CASE WHEN a.id IS NOT NULL THEN 'first_id' WHEN b.id IS NOT NULL THEN 'second_id' END AS matched_by
    FROM customer c LEFT JOIN k a ON a.g = c_nationkey AND a.id = c_custkey % 97 LEFT JOIN k b ON b.g = c_nationkey AND b.id = c_custkey % 53"""
)
def j06_attach_preferred(spark, sf_dir):
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") % 40).alias("id"), F.col("s_acctbal").alias("v"), F.col("s_suppkey").alias("at"))
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 97).alias("first_id"), (F.col("c_custkey") % 53).alias("second_id"))
    return J.attach_preferred(left, right, ["g"], "first_id", "second_id", "id", "v", "at").select("c_custkey", "v", "matched_by")


def _points(spark, sf_dir):
    q = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("g"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 500).cast("double").alias("y"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") % 25).cast("int").alias("g"), F.col("p_retailprice").alias("x"), (F.col("p_partkey") * 7 % 500).cast("double").alias("y"))
    return q, p


_POINTS_SQL = """q AS (SELECT c_custkey AS query_id, c_nationkey AS g, c_acctbal / 10 AS x, (c_custkey % 500)::DOUBLE AS y FROM customer),
    p AS (SELECT p_partkey AS point_id, (p_partkey % 25)::INTEGER AS g, p_retailprice AS x, (p_partkey * 7 % 500)::DOUBLE AS y FROM part)"""
_NEAR_SQL = """d AS (SELECT query_id, point_id, sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2)) AS distance FROM q JOIN p USING (g)),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rn FROM d WHERE distance <= 20)"""


@query(f"WITH {_POINTS_SQL}, {_NEAR_SQL} SELECT query_id, point_id, round(distance, 6) AS distance FROM n WHERE rn = 1")
def j08_nearest_within(spark, sf_dir):
    q, p = _points(spark, sf_dir)
    return rounded(J.nearest_within(q, p, ["g"], 20.0))


@query(
    f"""WITH {_POINTS_SQL}, {_NEAR_SQL}, e AS (SELECT g, (point_id % 1000) AS slot, min(point_id) AS point_id FROM p GROUP BY ALL)
    SELECT q.query_id AS cell_id, coalesce(e.point_id, n.point_id) AS row_id, CASE WHEN e.point_id IS NOT NULL THEN 'exact' WHEN n.point_id IS NOT NULL THEN 'near' END AS match
    FROM q LEFT JOIN e ON e.g = q.g AND e.slot = q.query_id LEFT JOIN n ON n.query_id = q.query_id AND n.rn = 1"""
)
def j07_exact_then_near(spark, sf_dir):
    q, p = _points(spark, sf_dir)
    own = q.select(F.col("query_id").alias("cell_id"), "g", "x", "y", F.col("query_id").alias("slot"))
    other = p.select(F.col("point_id").alias("row_id"), "g", "x", "y", (F.col("point_id") % 1000).alias("slot"))
    return J.attach_exact_then_near(own, other, ["g", "slot"], ["g"], 20.0)


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey < 20 AND c_custkey % 3 <> 0 THEN c_nationkey::DOUBLE ELSE c_acctbal END AS x,
    CASE WHEN c_nationkey < 20 AND c_custkey % 3 <> 0 THEN (c_custkey % 3)::DOUBLE ELSE 0.5::DOUBLE END AS y FROM customer"""
)
def j09_preferred_coordinates(spark, sf_dir):
    x, y = J.preferred_coordinates(
        F.col("c_acctbal"), F.lit(0.5), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey").cast("double")), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 3).cast("double"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", x.alias("x"), y.alias("y"))


@query(
    f"""WITH {CELLS_SQL}, m AS (SELECT DISTINCT experiment, channel, lower(channel) AS physical FROM cells WHERE channel <> 'MACHINERY' OR experiment = 'ASIA')
    SELECT cell_id, experiment, channel, physical, physical IS NOT NULL AS resolved FROM cells LEFT JOIN m USING (experiment, channel)"""
)
def j11_resolve_channel(spark, sf_dir):
    own = cells(spark, sf_dir).select("cell_id", "experiment", "channel")
    known = own.where("channel <> 'MACHINERY' or experiment = 'ASIA'").select("experiment", "channel", F.lower("channel").alias("physical")).distinct()
    return J.resolve_channel(own, known, "experiment", "channel").select("cell_id", "experiment", "channel", "physical", "resolved")


@query(
    """WITH d AS (SELECT DISTINCT n_regionkey, n_name AS shown, lower(n_name) AS physical FROM nation WHERE n_nationkey % 2 = 0),
    k AS (SELECT *, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY shown, physical) AS channel_rank FROM d
      UNION ALL SELECT DISTINCT n_regionkey, 'Phase', 'phase', 1 FROM d)
    SELECT c_custkey, n_regionkey, shown, physical, channel_rank::INTEGER AS channel_rank FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN k USING (n_regionkey)"""
)
def j12_expand_channels(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "customer").join(F.broadcast(n.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    channels = n.where("n_nationkey % 2 = 0").select("n_regionkey", F.col("n_name").alias("shown"), F.lower("n_name").alias("physical"))
    return J.expand_channels(own, channels, "n_regionkey").select("c_custkey", "n_regionkey", "shown", "physical", "channel_rank")


@query(
    """WITH v AS (SELECT l_partkey, l_linenumber, count(*) AS votes FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, l_linenumber) AS rn FROM v) SELECT l_partkey, l_linenumber, votes FROM r WHERE rn = 1"""
)
def j13_majority_label(spark, sf_dir):
    return J.majority_label(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber")


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def u01_union_schemas(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return U.union_all([c, s])


_FEATURES_SQL = "f AS (SELECT DISTINCT c_nationkey AS source, c_mktsegment AS feature FROM customer WHERE c_custkey % 11 < 3), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY feature) AS position FROM f)"


def _features(spark, sf_dir):
    from pyspark.sql import Window

    f = table(spark, sf_dir, "customer").where("c_custkey % 11 < 3").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("feature")).distinct()
    return f.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("feature")))


@query(f"WITH {_FEATURES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY source, position) AS rn FROM g) SELECT feature, source AS first_source, position::INTEGER AS first_position FROM r WHERE rn = 1")
def u02_features_in_any(spark, sf_dir):
    return U.features_in_any(_features(spark, sf_dir), "source", "feature", "position")


@query(
    f"""WITH {_FEATURES_SQL} SELECT feature, arg_min(position, source)::INTEGER AS position FROM g GROUP BY feature
    HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM g)"""
)
def u03_features_in_all(spark, sf_dir):
    return U.features_in_all(_features(spark, sf_dir), "source", "feature", "position")


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0")
def u04_missing_from(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("k"))
    return U.missing_from(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), have)


@query(
    f"""WITH {_FEATURES_SQL}, w AS (SELECT feature FROM f WHERE source = (SELECT min(source) FROM f)), p AS (SELECT DISTINCT source FROM f)
    SELECT source, feature FROM p, w EXCEPT SELECT source, feature FROM f"""
)
def s11_incomplete_positions(spark, sf_dir):
    return U.incomplete_positions(_features(spark, sf_dir), "source", "feature")


@query(
    f"""WITH {OBJECTS_SQL}, {CELLS_SQL}, l AS (SELECT o.cell_id, metric, lower(o.organelle) AS bucket, CASE WHEN channel < 'C' THEN 'a' WHEN channel < 'H' THEN 'n' ELSE 'r' END AS own, o.value FROM objects o JOIN cells USING (cell_id))
    SELECT cell_id, metric, 'max' AS agg, max(value) AS value FROM l WHERE bucket = own GROUP BY ALL"""
)
def u05_unified_fluorescence(spark, sf_dir):
    own = F.when(F.col("channel") < "C", "a").when(F.col("channel") < "H", "n").otherwise("r")
    long = objects(spark, sf_dir).join(cells(spark, sf_dir).select("cell_id", own.alias("own")), "cell_id").withColumns({"bucket": F.lower("organelle"), "agg": F.lit("max")})
    return U.unified_fluorescence(long, "cell_id", "metric", "agg", "own", "bucket")


@query("SELECT p_brand, string_agg(DISTINCT p_size % 3, ',' ORDER BY p_size % 3) AS physicals, count(DISTINCT p_size % 3) > 1 AS conflict FROM part GROUP BY p_brand")
def u06_channel_jobs(spark, sf_dir):
    return U.channel_jobs(table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 3).cast("string").alias("k")), "p_brand", "k")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE l_linestatus WHEN 'O' THEN 'um' ELSE 'um^2' END AS unit, l_extendedprice AS value FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN value * CASE unit WHEN 'um' THEN 0.5 ELSE 0.25 END ELSE value END AS value FROM l"""
)
def p27_unit_correction(spark, sf_dir):
    unit = F.when(F.col("l_linestatus") == "O", "um").otherwise("um^2")
    long = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("experiment"), unit.alias("unit"), F.col("l_extendedprice").alias("value"))
    affected = spark.createDataFrame([("A", False), ("R", True)], "experiment string, applied boolean")
    return U.unit_corrected(long, affected, {"um": 0.5, "um^2": 0.25}).select("l_orderkey", "l_linenumber", "l_partkey", "value")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, lower(l_returnflag) AS bucket, CASE l_linestatus WHEN 'O' THEN 'n' ELSE 'a' END AS channel FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey FROM l WHERE bucket = channel OR bucket = 'agnostic'"""
)
def p28_channel_mask(spark, sf_dir):
    long = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lower("l_returnflag").alias("bucket"), F.when(F.col("l_linestatus") == "O", "n").otherwise("a").alias("channel"))
    return U.own_channel_features(long, "channel", "bucket").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT DISTINCT l_returnflag AS metric FROM lineitem WHERE nullif(l_discount, 0) IS NOT NULL")
def p29_observed_features(spark, sf_dir):
    return U.observed_features(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("metric"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("value")))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'um^2' WHEN 1 THEN 'ratio' WHEN 2 THEN 'ratio' ELSE 'unknown' END AS unit,
    CASE p_size % 4 WHEN 0 THEN 'morphology' WHEN 1 THEN 'morphology' WHEN 2 THEN 'distribution' ELSE 'morphology' END AS category FROM part"""
)
def p13_units_and_categories(spark, sf_dir):
    metric = F.element_at(F.array(F.lit("area"), F.lit("tortuosity"), F.lit("radial_frac_bin3"), F.lit("other")), F.col("p_size") % 4 + 1)
    df = features.with_unit(table(spark, sf_dir, "part").select("p_partkey", metric.alias("metric")))
    return df.select("p_partkey", "unit", features.category(F.col("metric")).alias("category"))


@query(
    """WITH f AS (SELECT DISTINCT replace(lower(p_type), ' ', '_') || CASE p_size % 2 WHEN 0 THEN '_mean' ELSE '' END AS feature FROM part),
    r AS (SELECT feature, CASE WHEN feature LIKE '%\\_mean' ESCAPE '\\' THEN 'mean' END AS aggregation, regexp_replace(feature, '_(mean|median|std|sum|min|max|count)$', '') AS rest FROM f),
    o(organelle) AS (VALUES ('standard'), ('small'), ('small_plated'), ('promo_anodized'))
    SELECT feature, arg_max(organelle, length(organelle)) AS organelle,
      CASE WHEN max(organelle) IS NULL THEN rest WHEN max(length(organelle)) = length(rest) THEN '' ELSE substr(rest, max(length(organelle)) + 2) END AS metric,
      CASE WHEN coalesce(max(length(organelle)), 0) < length(rest) THEN aggregation END AS aggregation
    FROM r LEFT JOIN o ON starts_with(rest, organelle || '_') OR rest = organelle GROUP BY feature, rest, r.aggregation"""
)
def p15_parse_names(spark, sf_dir):
    name = F.concat(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, "_mean").otherwise(""))
    made = table(spark, sf_dir, "part").select(name.alias("feature")).distinct()
    organelles = spark.createDataFrame([(x,) for x in ("standard", "small", "small_plated", "promo_anodized")], "organelle string")
    return features.parse_names(made, organelles).drop("category")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def p08_duplicate_keys(spark, sf_dir):
    return A.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_returnflag = 'A' AS first, l_linestatus = 'F' AS second, count(*) AS n_cells FROM lineitem GROUP BY ALL")
def p07_system_coverage(spark, sf_dir):
    return A.system_coverage(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "A", F.col("l_linestatus") == "F")


@query(
    """SELECT 'missing_columns' AS "check", 1 AS n_bad UNION ALL SELECT 'duplicate_keys', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'extra_channels', count(DISTINCT l_returnflag) - 1 FROM lineitem UNION ALL SELECT 'groups_over_cap', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600)"""
)
def a19_check_outputs(spark, sf_dir):
    return A.check_outputs(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_orderkey", "nope"], "l_returnflag", "l_suppkey", 600)


@query(
    """SELECT event_type AS step, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS max, round(sum(value), 4) AS total
    FROM events GROUP BY event_type"""
)
def a21_timing_summary(spark, sf_dir):
    out = A.timing_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("step"), F.col("value").alias("seconds")))
    return rounded(out.withColumn("total", F.round("total", 4)))


@query(
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey FROM r WHERE k % 7 = 3"""
)
def s06_interleaved_slice(spark, sf_dir):
    return S.interleaved_slice(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3, 7).select("o_orderkey")


@query("SELECT DISTINCT split_part(p_type, ' ', 1) || '_seg' AS label, split_part(p_type, ' ', 1) AS organelle FROM part WHERE split_part(p_type, ' ', 1) <> 'PROMO'")
def s10_discover_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.concat(F.substring_index("p_type", " ", 1), F.lit("_seg")).alias("label"))
    return S.discover_labels(labels, ["PROMO_seg"], "^(.*)_seg$")


@query(
    """WITH e AS (SELECT n_nationkey AS position, m AS label FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer)),
    p AS (SELECT c_nationkey AS position, c_mktsegment AS label, max(c_custkey % 4) AS n FROM customer WHERE c_custkey % 13 < 2 GROUP BY ALL)
    SELECT position, label, CASE WHEN label = 'BUILDING' THEN 'protected' WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'with-data' END AS status FROM e LEFT JOIN p USING (position, label)"""
)
def s12_label_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position")).join(F.broadcast(c.select(F.col("c_mktsegment").alias("label")).distinct()))
    present = c.where("c_custkey % 13 < 2").select(F.col("c_nationkey").alias("position"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") % 4).alias("n_objects"))
    return S.label_status(expected, present, ["BUILDING"])


# The same operators over whole tables: what is missing follows from the balances.


def _balance(name, step):
    return F.floor(F.col(name) / step)


@query(
    """SELECT c_custkey, c_nationkey, c_mktsegment FROM customer c WHERE c_custkey IN (SELECT s_suppkey FROM supplier)
    OR EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND floor(s.s_acctbal / 100) = floor(c.c_acctbal / 100))"""
)
def j04_semi_either_whole(spark, sf_dir):
    targets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), _balance("s_acctbal", 100).alias("slot"))
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", _balance("c_acctbal", 100).alias("slot"))
    return J.semi_either(own, targets, ("c_custkey",), ("c_nationkey", "slot")).drop("slot")


_WHOLE_SQL = """f AS (SELECT DISTINCT c_mktsegment AS source, floor(c_acctbal / 500)::BIGINT AS feature FROM customer),
    g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY feature) AS position FROM f)"""


def _whole_features(spark, sf_dir):
    from pyspark.sql import Window

    f = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("source"), _balance("c_acctbal", 500).alias("feature")).distinct()
    return f.withColumn("position", F.row_number().over(Window.partitionBy("source").orderBy("feature")))


@query(f"WITH {_WHOLE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY source, position) AS rn FROM g) SELECT feature, source AS first_source, position::INTEGER AS first_position FROM r WHERE rn = 1")
def u02_features_in_any_whole(spark, sf_dir):
    return U.features_in_any(_whole_features(spark, sf_dir), "source", "feature", "position")


@query(
    f"""WITH {_WHOLE_SQL} SELECT feature, arg_min(position, source)::INTEGER AS position FROM g GROUP BY feature
    HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM g)"""
)
def u03_features_in_all_whole(spark, sf_dir):
    return U.features_in_all(_whole_features(spark, sf_dir), "source", "feature", "position")


@query("SELECT floor(c_acctbal)::BIGINT AS k FROM customer EXCEPT SELECT floor(s_acctbal)::BIGINT FROM supplier")
def u04_missing_from_whole(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").select(_balance("s_acctbal", 1).alias("k"))
    return U.missing_from(table(spark, sf_dir, "customer").select(_balance("c_acctbal", 1).alias("k")).distinct(), have)


@query(
    """WITH f AS (SELECT DISTINCT c_nationkey AS source, floor(c_acctbal / 10)::BIGINT AS feature FROM customer),
    w AS (SELECT feature FROM f WHERE source = (SELECT min(source) FROM f)), p AS (SELECT DISTINCT source FROM f)
    SELECT source, feature FROM p, w EXCEPT SELECT source, feature FROM f"""
)
def s11_incomplete_positions_whole(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), _balance("c_acctbal", 10).alias("feature")).distinct()
    return U.incomplete_positions(f, "source", "feature")


@query(
    """WITH c AS (SELECT c_nationkey AS position, floor(c_acctbal / 100)::BIGINT::VARCHAR AS label, greatest(floor(c_acctbal), 0)::BIGINT AS n FROM customer),
    e AS (SELECT n_nationkey AS position, label FROM nation, (SELECT DISTINCT label FROM c)), p AS (SELECT position, label, max(n) AS n FROM c GROUP BY ALL)
    SELECT position, label, CASE WHEN label = '0' THEN 'protected' WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'with-data' END AS status FROM e LEFT JOIN p USING (position, label)"""
)
def s12_label_status_whole(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("position"), _balance("c_acctbal", 100).cast("string").alias("label"), F.greatest(_balance("c_acctbal", 1), F.lit(0)).alias("n_objects"))
    expected = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position")).join(F.broadcast(c.select("label").distinct()))
    return S.label_status(expected, c, ["0"])


# --- linked cells: a part is a cell's experiment, a supplier its well; each well has two of three kinds ---

_LINKED_SQL = """linked AS (SELECT l_orderkey * 10 + l_linenumber AS cell, l_partkey % 40 AS experiment, l_suppkey % 9 AS well,
    list_extract(['cp', '4i', 'std'], ((l_partkey % 40 + (l_suppkey % 9) * (l_suppkey % 9) + l_linenumber % 2) % 3 + 1)::INTEGER) AS kind FROM lineitem)"""


def _one_kind_sql(priority: tuple[str, ...], where: str) -> str:
    rank = "list_position([" + ", ".join(f"'{k}'" for k in priority) + "], kind)"
    return f"""WITH {_LINKED_SQL}, r AS (SELECT *, {rank} AS rank FROM linked WHERE {where}), w AS (SELECT experiment, well, min(rank) AS best FROM r GROUP BY ALL),
    e AS (SELECT experiment, arg_min(best, well) AS chosen FROM w GROUP BY experiment)
    SELECT cell, r.experiment, r.well, kind FROM r JOIN w ON r.experiment = w.experiment AND r.well = w.well AND rank = best JOIN e ON e.experiment = r.experiment AND chosen = best"""


def _linked(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    experiment, well = F.col("l_partkey") % 40, F.col("l_suppkey") % 9
    kind = F.element_at(F.array(*(F.lit(k) for k in ("cp", "4i", "std"))), ((experiment + well * well + F.col("l_linenumber") % 2) % 3 + 1).cast("int"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), experiment.alias("experiment"), well.alias("well"), kind.alias("kind"))


@query(_one_kind_sql(("cp", "4i", "std"), "true"))
def s01_one_kind(spark, sf_dir):
    """The kind of an experiment's first well; wells that lack it are skipped."""
    return S.one_kind(_linked(spark, sf_dir), ("cp", "4i", "std"))


@query(_one_kind_sql(("4i", "cp", "std"), "well IN (0, 1, 2)"))
def s02_first_wells(spark, sf_dir):
    """Another order of kinds, and the first three wells only."""
    return S.one_kind(_linked(spark, sf_dir), ("4i", "cp", "std"), wells=(0, 1, 2))


QUERIES, ORACLES = query.queries, query.oracles


# --- counts kept between runs ---


@query(
    """WITH e AS (SELECT 'E' || (l_suppkey % 40) AS experiment, l_returnflag, l_orderkey FROM lineitem),
    k AS (SELECT DISTINCT experiment FROM e WHERE experiment <> 'E7' UNION SELECT 'E99')
    SELECT k.experiment, l_returnflag, count(l_orderkey) AS n FROM k LEFT JOIN e USING (experiment) GROUP BY ALL"""
)
def s14_cached_counts(spark, sf_dir):
    """The first run counts a part of the experiments; the second reads what is new, and one that has no rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/counts-{uuid4().hex}"
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("E"), F.col("l_suppkey") % 40).alias("experiment"), "l_returnflag", "l_linenumber")
    rows.repartition("experiment", "l_linenumber").drop("l_linenumber").write.partitionBy("experiment").parquet(f"{folder}/cells")
    cells = spark.read.schema("l_returnflag string, experiment string").parquet(f"{folder}/cells")
    wanted = rows.select("experiment").where("experiment <> 'E7'").distinct()
    S.cached_counts(wanted.where("experiment like '%3'"), cells, f"{folder}/counts", "experiment", ["l_returnflag"])
    return S.cached_counts(wanted.union(spark.createDataFrame([("E99",)], "experiment string")), cells, f"{folder}/counts", "experiment", ["l_returnflag"])
