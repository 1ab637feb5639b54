"""Sources and sinks: linked cell tables in CSV, label catalogues, partitioned
outputs, configuration and done-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytofold.functions.names import nan_to_null, safe_name
from cytofold.operators.graph import ensure_checkpoint_dir


def read_linked_cells(spark: SparkSession, paths: dict[str, str], schema: str, priority: Sequence[str], key: str = "well", renames: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Linked cell tables of one experiment, one CSV path for each kind, with a stated schema.

    A well is read from the first kind in ``priority`` that has it (extraction
    and consolidation rank the kinds differently, so the order is a parameter);
    columns that a kind lacks are null. ``kind`` says where a row came from."""
    frames = []
    for rank, kind in enumerate(k for k in priority if k in paths):
        df = spark.read.csv(paths[kind], header=True, schema=schema, enforceSchema=False)
        df = df.withColumnsRenamed((renames or {}).get(kind, {}))
        frames.append(df.withColumns({"kind": F.lit(kind), "_rank": F.lit(rank)}))
    if not frames:
        raise ValueError(f"none of {list(priority)} has a path")
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    best = every.groupBy(key).agg(F.min("_rank").alias("_best")).withColumnRenamed(key, "_key")
    joined = every.join(F.broadcast(best) if _few(best) else best, every[key].eqNullSafe(F.col("_key")))
    return nan_to_null(joined.where("_rank = _best").drop("_rank", "_best", "_key"))


def one_kind(rows: DataFrame, priority: Sequence[str], experiment: str = "experiment", well: str = "well", kind: str = "kind", wells: Sequence | None = None) -> DataFrame:
    """Rows of linked cells of one kind an experiment: a well counts with the first kind
    in ``priority`` that it has, an experiment with that of its first well, and wells of
    another kind are skipped. ``wells`` keeps these wells only, a filter that reaches the
    scan. Rows without an experiment, well or known kind are left out. Kinds are counted
    from three columns and joined back, so no experiment meets in one task."""
    if wells is not None:
        rows = rows.where(F.col(well).isin(*wells))
    place = F.array_position(F.array(*(F.lit(k) for k in priority)), F.col(kind))
    of_well = rows.where(place > 0).groupBy(experiment, well).agg(F.min(place).alias("_rank")).where(F.col(experiment).isNotNull() & F.col(well).isNotNull())
    chosen = of_well.groupBy(experiment).agg(F.min_by("_rank", well).alias("_chosen"))
    kept = of_well.join(chosen, experiment).where("_rank = _chosen").select(experiment, well, F.element_at(F.array(*(F.lit(k) for k in priority)), F.col("_rank").cast("int")).alias(kind))
    return rows.join(kept, [experiment, well, kind], "left_semi")


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """At most ``most`` rows? Looks at no more than that."""
    return df.limit(most + 1).count() <= most


def read_batches(spark: SparkSession, path: str, batch_id: str | None = None) -> DataFrame:
    """A partitioned table of batches; a batch id prunes partitions."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if batch_id is None else df.where(F.col("batch_id") == batch_id)


def write_batches(df: DataFrame, path: str, by: str = "batch_id", mode: str = "overwrite") -> None:
    """Partitioned output; rows are brought together by the key in as many tasks as
    their size needs, so a large batch is not one file."""
    df.hint("rebalance", F.col(by)).write.partitionBy(by).mode(mode).parquet(path)


def write_by_channel(df: DataFrame, path: str, channel: str) -> None:
    """One folder for each channel, under a name that is safe for files."""
    write_batches(df.withColumn("channel_safe", safe_name(F.col(channel))), path, "channel_safe")


def write_levels(path: str, obs: DataFrame, features: DataFrame, values: DataFrame) -> None:
    """A measured level as three tables: rows (obs), the feature dimension and long values in float32."""
    obs.write.mode("overwrite").parquet(f"{path}/obs")
    features.write.mode("overwrite").parquet(f"{path}/features")
    nan_to_null(values).withColumn("value", F.col("value").cast("float")).write.mode("overwrite").parquet(f"{path}/values")


def feature_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footers alone."""
    return spark.read.parquet(path).columns


def interleaved_slice(df: DataFrame, order: Sequence[str | Column], rank: int, ranks: int) -> DataFrame:
    """Rows rank, rank + ranks, ... of a total order. Numbers come from a sort by
    range and per-partition counts, not from one task. The sort is checkpointed:
    counts and rows must come from the same partitions, which a second sort (it
    samples, and adaptive execution merges partitions) need not give."""
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.sort(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint()
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ordered.join(F.broadcast(starts), "_part").where((F.col("_start") + F.col("_at")) % ranks == rank).drop("_part", "_at", "_start", "_n")


def discover_labels(labels: DataFrame, skip: Sequence[str], pattern: str) -> DataFrame:
    """(label, organelle): distinct stored label names that are not skipped, and what ``pattern`` extracts from them."""
    return labels.select("label").distinct().where(~F.col("label").isin(*skip)).select("label", F.regexp_extract("label", pattern, 1).alias("organelle"))


def label_status(expected: DataFrame, present: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """(position, label, status): protected, missing, empty or with-data; ``present`` has n_objects."""
    joined = expected.join(present.groupBy("position", "label").agg(F.max("n_objects").alias("_n")), ["position", "label"], "left")
    status = F.when(F.col("label").isin(*protected), "protected").when(F.col("_n").isNull(), "missing").when(F.col("_n") == 0, "empty").otherwise("with-data")
    return joined.select("position", "label", status.alias("status"))


def uncounted(requested: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requested keys that a saved table of counts lacks."""
    return requested.select(key).distinct().join(cached.select(key), key, "left_anti")


def cached_counts(requested: DataFrame, data: DataFrame, cache: str, key: str, by: Sequence[str], refresh: bool = False) -> DataFrame:
    """(key, by, n): rows of ``data`` for each requested key, counted once and kept in the table ``cache``.

    ``data`` is partitioned by ``key``, so the driver, which lists its folders, also
    holds the keys; a run reads the folders of the keys that the cache lacks and no
    others, or of all requested ones with ``refresh``. The cache is partitioned by
    key as well, and a key's folder is replaced as a whole, so a run that was cut off and
    repeated leaves no count twice. A requested key without rows is kept as
    one row with nulls in ``by`` and n = 0. Null and empty keys, which name no
    folder, are left out; keys in the cache that nobody requests stay there. What the
    cache says is believed: data that changed needs ``refresh``."""
    spark = data.sparkSession
    fields = [data.schema[key], *(data.schema[c] for c in by)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n long"
    wanted = requested.select(F.col(key).cast(data.schema[key].dataType).alias(key)).where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).distinct()
    try:
        known = spark.read.schema(schema).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    missing = wanted if refresh else uncounted(wanted, known, key)
    keys = [r[0] for r in missing.collect()]  # names of folders
    if keys:
        counts = data.where(F.col(key).isin(*keys)).groupBy(key, *by).agg(F.count("*").alias("n"))
        every = spark.createDataFrame([(k,) for k in keys], f"`{key}` {data.schema[key].dataType.simpleString()}").join(counts, key, "left").fillna(0, ["n"])
        every.repartition(key).write.partitionBy(key).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(cache)
    kept = spark.read.schema(schema).parquet(cache) if keys else known
    return kept.join(wanted, key, "left_semi").select(key, *by, "n")


def require_boxes(cells: DataFrame, box: str) -> DataFrame:
    """``cells`` with a known box; an error if there are rows and none has one."""
    seen = cells.agg(F.count("*").alias("n"), F.count(box).alias("known")).first()
    if seen["n"] and not seen["known"]:
        raise ValueError(f"no row has a {box}")
    return cells.where(F.col(box).isNotNull())


def read_yaml(spark: SparkSession, path: str) -> dict:
    """One configuration file (YAML), read by Spark from wherever it lies."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # a hand-written file
    return yaml.safe_load(text) or {}


def config_table(spark: SparkSession, config: dict[str, list[dict]], columns: str) -> DataFrame:
    """Rows of a configuration of lists by experiment, entries without a needed value left out."""
    names = [c.split()[0] for c in columns.split(",")]
    rows = [tuple([experiment, *(entry.get(n) for n in names[1:])]) for experiment, entries in config.items() for entry in entries or [] if isinstance(entry, dict) and all(entry.get(n) is not None for n in names[1:])]
    return spark.createDataFrame(rows, columns)


def merged_config(*layers: dict) -> dict:
    """Later layers win, nested sections are merged, None means not set."""
    out: dict = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, dict):
                out[key] = merged_config(out.get(key) if isinstance(out.get(key), dict) else {}, value)
            elif value is not None:
                out[key] = value
    return out
