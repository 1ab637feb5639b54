import pytest
from pyspark.sql import functions as F

from cytofold.sources import tables as S
from cytofold.streaming import incremental as I

SF = "/root/testdata/sf0.001"


def test_linked_cells_take_the_first_kind_of_each_well(spark, tmp_path):
    a = tmp_path / "cp.csv"
    b = tmp_path / "std.csv"
    a.write_text("well,segmentation_id,value\nA/1/0,1,0.5\nA/1/0,2,NaN\n")
    b.write_text("well,segmentation_id,value\nA/1/0,1,9\nA/2/0,7,1.5\n,8,2\n")
    df = S.read_linked_cells(spark, {"cp": str(a), "std": str(b)}, "well string, segmentation_id long, value double", ["cp", "4i", "std"])
    rows = {(r.well, r.segmentation_id): (r.kind, r.value) for r in df.collect()}
    assert rows == {("A/1/0", 1): ("cp", 0.5), ("A/1/0", 2): ("cp", None), ("A/2/0", 7): ("std", 1.5), (None, 8): ("std", 2.0)}
    with pytest.raises(ValueError):
        S.read_linked_cells(spark, {}, "well string", ["cp"])


def test_partitioned_tables(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("batch_id", F.col("l_returnflag"))
    S.write_batches(li, str(tmp_path / "b"))
    one = S.read_batches(spark, str(tmp_path / "b"), "A")
    assert one.count() == li.where("batch_id = 'A'").count()
    assert "PartitionFilters: [isnotnull(batch_id" in one._jdf.queryExecution().toString()
    assert set(S.feature_columns(spark, str(tmp_path / "b"))) == set(li.columns)
    S.write_by_channel(li.select("l_orderkey", F.lit("Live (Cell) Dye").alias("c")), str(tmp_path / "c"), "c")
    assert [p.name for p in (tmp_path / "c").iterdir() if p.is_dir()] == ["channel_safe=live_cell_dye"]
    values = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "cell_id long, value double")
    S.write_levels(str(tmp_path / "level"), values.select("cell_id"), values.limit(1), values)
    assert {r.cell_id: r.value for r in spark.read.parquet(str(tmp_path / "level/values")).collect()} == {1: None, 2: 2.0}


def test_interleaved_slices_partition_the_rows(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    parts = [[r.id for r in S.interleaved_slice(df, ["k", "id"], r, 3).collect()] for r in range(3)]
    want = [r.id for r in df.orderBy("k", "id").collect()]
    assert [sorted(p) for p in parts] == [sorted(want[r::3]) for r in range(3)]


def test_labels_and_config(spark):
    labels = spark.createDataFrame([("gfp_seg",), ("skip",), ("gfp_seg",), ("cy5_seg",)], "label string")
    assert {tuple(r) for r in S.discover_labels(labels, ["skip"], "^(.*)_seg$").collect()} == {("gfp_seg", "gfp"), ("cy5_seg", "cy5")}
    expected = spark.createDataFrame([("p", k) for k in "abcd"], "position string, label string")
    present = spark.createDataFrame([("p", "a", 3), ("p", "b", 0), ("p", "d", 5)], "position string, label string, n_objects long")
    got = {r.label: r.status for r in S.label_status(expected, present, ["d"]).collect()}
    assert got == {"a": "with-data", "b": "empty", "c": "missing", "d": "protected"}
    assert [r.label for r in S.uncounted(labels, labels.where("label = 'skip'"), "label").orderBy("label").collect()] == ["cy5_seg", "gfp_seg"]
    table = S.config_table(spark, {"e1": [{"channel": "GFP", "label": "x"}, {"channel": "BF"}, "note"], "e2": None}, "experiment string, channel string, label string")
    assert [tuple(r) for r in table.collect()] == [("e1", "GFP", "x")]
    assert S.merged_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"x": 5}}, {"a": {"y": None}, "b": None}) == {"a": {"x": 5, "y": 2}, "b": 1}


def test_counts_are_kept_between_runs(spark, tmp_path):
    cells, cache = tmp_path / "cells", str(tmp_path / "counts")
    rows = [("a", "KO")] * 3 + [("a", None)] + [("b", "KO"), ("b", "NTC")] + [("c/ d", "NTC")] * 2 + [(None, "KO")]
    spark.createDataFrame(rows, "exp string, kind string").write.partitionBy("exp").parquet(str(cells))
    data = spark.read.schema("kind string, exp string").parquet(str(cells))
    keys = lambda *k: spark.createDataFrame([(x, 1) for x in k], "exp string, other long")
    count = lambda *k, **o: sorted(map(tuple, S.cached_counts(keys(*k), data, cache, "exp", ["kind"], **o).collect()), key=str)
    assert count() == []
    assert count("a", "a", None, "") == [("a", "KO", 3), ("a", None, 1)]
    for f in (cells / "exp=a").glob("*.parquet"):
        f.write_bytes(b"a run that reads this fails")
    want = [("a", "KO", 3), ("a", None, 1), ("b", "KO", 1), ("b", "NTC", 1), ("c/ d", "NTC", 2), ("none", None, 0)]
    assert count("a", "b", "c/ d", "none") == want
    for f in cells.rglob("*.parquet"):
        f.write_bytes(b"nothing is read any more")
    assert count("none", "a") == [("a", "KO", 3), ("a", None, 1), ("none", None, 0)]
    assert count("a", "b", "c/ d", "none") == want
    spark.createDataFrame([("a", "NTC")], "exp string, kind string").write.partitionBy("exp").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(str(cells))
    data = spark.read.schema("kind string, exp string").parquet(str(cells))
    assert count("a", refresh=True) == [("a", "NTC", 1)] and count("b")[0] == ("b", "KO", 1)


def test_incremental_statistics(spark, tmp_path):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("value"), F.to_timestamp("l_shipdate").alias("ts"), F.col("l_orderkey").alias("id"))
    half = li.where("id % 2 = 0")
    half.write.parquet(str(tmp_path / "in/a"))
    schema = "k string, value double, ts timestamp, id long"
    seen = I.first_arrivals(I.read_arrivals(spark, str(tmp_path / "in/*"), schema), ["id"], "ts", "10000 days")
    for _ in range(2):
        I.run_available(seen, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == half.select("id").distinct().count()
    stats = I.merged_statistics(I.read_arrivals(spark, str(tmp_path / "in/*"), schema), ["k"])
    q = stats.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.k: (r.n, r.s) for r in half.groupBy("k").agg(F.count("*").alias("n"), F.sum("value").alias("s")).collect()}
    assert {r.k: (r["count"], r["sum"]) for r in spark.table("stats").collect()} == want
    counts = I.windowed_counts(I.read_arrivals(spark, str(tmp_path / "in/*"), schema), "ts", "30 days", "1 day", "k")
    assert counts.isStreaming and counts.columns == ["start", "k", "n", "total"]


def test_interleaved_slices_of_many_partitions(spark, tmp_path):
    n = 300_000
    spark.range(n).select("id", F.xxhash64("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 3).alias("pad")).write.parquet(str(tmp_path / "t"))
    df, before = spark.read.parquet(str(tmp_path / "t")), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        parts = [S.interleaved_slice(df, ["k"], r, 3).select("id") for r in range(3)]
        assert [p.count() for p in parts] == [n // 3] * 3
        assert parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().count() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
