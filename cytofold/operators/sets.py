"""Unions, intersections and splits of feature sets and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Experiments up to which the table of affected ones is broadcast; they are counted before.
BROADCAST = 100_000


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def features_in_any(features: DataFrame, source: str, feature: str, position: str) -> DataFrame:
    """(feature, position) of every feature in the order in which sources first name it."""
    return features.groupBy(feature).agg(F.min(F.struct(source, position)).alias("_at")).select(feature, F.col(f"_at.{source}").alias("first_source"), F.col(f"_at.{position}").alias("first_position"))


def features_in_all(features: DataFrame, source: str, feature: str, position: str) -> DataFrame:
    """Features that every source has, with their place in the first source."""
    n = features.agg(F.count_distinct(source).alias("n_sources"))
    each = features.groupBy(feature).agg(F.count_distinct(source).alias("_n"), F.min_by(position, source).alias("position"))
    return each.join(F.broadcast(n), F.col("_n") == F.col("n_sources")).select(feature, "position")


def missing_from(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct rows of ``expected`` that ``present`` lacks; nulls are equal."""
    return expected.distinct().exceptAll(present.select(*expected.columns).distinct())


def incomplete_positions(labels: DataFrame, position: str, label: str) -> DataFrame:
    """(position, label): labels of the first position that another position lacks."""
    first = labels.agg(F.min(position).alias("_first"))
    wanted = labels.join(F.broadcast(first), F.col(position) == F.col("_first")).select(label).distinct()
    # label sets are a few names, so every position names all of them; no broadcast is asked for
    every = labels.select(position).distinct().crossJoin(wanted)
    return every.join(labels.select(position, label).distinct(), [position, label], "left_anti")


def own_channel_features(long: DataFrame, channel: str, bucket: str) -> DataFrame:
    """Rows whose feature belongs to the cell's own channel or to none in
    particular. A row without a channel is an error: its features would vanish."""
    known = F.when(F.col(channel).isNull(), F.raise_error(F.lit("a cell has no channel"))).otherwise(F.col(channel))
    return long.where((F.col(bucket) == known) | (F.col(bucket) == "agnostic"))


def unified_fluorescence(long: DataFrame, cell: str, metric: str, agg: str, channel: str, bucket: str, value: str = "value") -> DataFrame:
    """One value for each (cell, metric, aggregation): that of the cell's own
    channel; of rows that repeat it with different values the largest, whatever their order."""
    return long.where(F.col(bucket) == F.col(channel)).groupBy(cell, metric, agg).agg(F.max(value).alias(value))


def channel_jobs(pairs: DataFrame, shown: str, physical: str) -> DataFrame:
    """Each shown channel with its physical channels and whether they conflict."""
    out = pairs.groupBy(shown).agg(F.array_sort(F.collect_set(physical)).alias("physicals"))
    return out.select(shown, F.array_join("physicals", ",").alias("physicals"), (F.size("physicals") > 1).alias("conflict"))


def observed_features(long: DataFrame, feature: str = "metric", value: str = "value") -> DataFrame:
    """Features with a value somewhere."""
    return long.where(F.col(value).isNotNull() & ~F.isnan(value)).select(feature).distinct()


def unit_corrected(long: DataFrame, affected: DataFrame, factors: dict[str, float], experiment: str = "experiment", unit: str = "unit", value: str = "value") -> DataFrame:
    """Values of affected experiments times the factor of their unit, once.

    ``affected`` (experiment, applied): experiments with the fault and whether
    their rows came corrected already."""
    factor = F.lit(1.0)
    for u, f in factors.items():
        factor = F.when(F.col(unit) == u, F.lit(float(f))).otherwise(factor)
    known = affected.groupBy(experiment).agg(F.max("applied").alias("_applied"))
    # experiments have very many rows each: a join by shuffle would give all of one to one task
    joined = long.join(F.broadcast(known) if known.limit(BROADCAST + 1).count() <= BROADCAST else known, experiment, "left")
    return joined.withColumn(value, F.when(F.col("_applied") == False, F.col(value) * factor).otherwise(F.col(value))).drop("_applied")  # noqa: E712
