"""Aggregation of long feature tables from objects to cells, guides and genes, and audits.

The long layout (key, metric, value) makes every level one grouped aggregate;
wide tables are made only for export. Groups with a null key are left out,
statistics skip null values; ``std`` is the sample deviation, null for one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir

SIX = ("mean", "median", "std", "sum", "min", "max")


def statistic(name: str, value: str = "value") -> Column:
    """One of the named statistics of a column; the median needs ``_placed`` rows."""
    c = F.col(value)
    middle = (F.col("_at") == F.floor((F.col("_of") + 1) / 2)) | (F.col("_at") == F.floor((F.col("_of") + 2) / 2))
    made = {
        "mean": lambda: F.avg(c), "median": lambda: F.avg(F.when(middle, c)), "std": lambda: F.stddev_samp(c), "sum": lambda: F.sum(c),
        "min": lambda: F.min(c), "max": lambda: F.max(c), "count": lambda: F.count(c),
    }
    return made[name]().alias(name)


def _placed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``_at``, ``_of``: the place of each value among the known ones of its group, and
    how many there are. Sorting a group costs far less than the map of its values
    that an exact percentile keeps."""
    group = Window.partitionBy(*keys)
    return rows.withColumns({"_at": F.row_number().over(group.orderBy(F.asc_nulls_last(value))), "_of": F.count(value).over(group)})


def narrowed_quantile(rows: DataFrame, keys: list[str], value: str = "value", q: float = 0.5, bins: int = 4_096, max_rounds: int = 64) -> DataFrame:
    """keys, quantile (interpolated) of groups of any size, a thousand of them at most.

    The two values around the quantile are ranks. A histogram of each group, combined
    before the shuffle, shows the bin that holds a rank; the next round looks only
    between that bin's least and largest value, until these are one value. No task
    puts values in order, however they are spread; a round reads the rows once."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    place = (F.col("_all") - 1) * q
    ranks = F.array(F.struct(F.lit(0).alias("_which"), (F.floor(place) + 1).alias("_rank")), F.struct(F.lit(1).alias("_which"), (F.ceil(place) + 1).alias("_rank")))
    state = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_all"))
    state = state.select("*", F.inline(ranks)).checkpoint()
    names = state.columns
    for _ in range(max_rounds):
        open_ = state.where("_lo < _hi")
        if open_.isEmpty():
            break
        width = (F.col("_hi") - F.col("_lo")) / bins
        at = F.when(F.col("_v") == F.col("_hi"), bins - 1).when((width > 0) & (F.col("_lo") + width > F.col("_lo")), F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
        near = known.join(F.broadcast(open_), keys).where("_v between _lo and _hi")
        hist = near.groupBy(*keys, "_which", "_all", "_rank", at.alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_which").orderBy("_bin"))
        held = hist.withColumn("_before", upto - F.col("_c")).where("_rank > _before and _rank <= _before + _c").withColumn("_rank", F.col("_rank") - F.col("_before"))
        state = state.where("_lo = _hi").unionByName(held.select(*names)).checkpoint()
    else:
        raise RuntimeError(f"a quantile was not found in {max_rounds} rounds")
    ends = state.groupBy(*keys).agg(F.min("_lo").alias("_a"), F.max("_lo").alias("_b"), F.first("_all").alias("_all"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("quantile"))


def summarise(long: DataFrame, keys: list[str], stats: tuple[str, ...] = SIX, value: str = "value", std_fill: bool = False, hot_rows: int | None = 1_000_000) -> DataFrame:
    """Statistics of ``value`` for each combination of ``keys``. With ``std_fill``
    the deviation of a single value is 0.

    For the median a group's values meet in one task in order. Groups that hold
    more than ``hot_rows`` rows and more than a thousandth of all are found by a
    count first and have theirs from ``narrowed_quantile``; None says that there are
    none, as for the objects of a cell."""
    rows = long.where(" and ".join(f"`{k}` is not null" for k in keys))
    made = [statistic(s, value) for s in stats]
    if "median" not in stats:
        out = rows.groupBy(*keys).agg(*made)
    else:
        out, hot = None, None
        if hot_rows is not None:
            # only the keys are read for the count
            sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size"))
            total, most = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
            least = max(hot_rows, total // 1_000)
            hot = F.broadcast(sizes.where(F.col("_size") > least).select(*keys)) if most > least else None
        cold = rows if hot is None else rows.join(hot, keys, "left_anti")
        out = _placed(cold, keys, value).groupBy(*keys).agg(*made)
        if hot is not None:
            large = rows.join(hot, keys, "left_semi")
            others = [statistic(s, value) for s in stats if s != "median"]
            whole = large.groupBy(*keys).agg(F.lit(1).alias("_one"), *others).join(narrowed_quantile(large, keys, value).withColumnRenamed("quantile", "median"), keys, "left")
            out = out.unionByName(whole.select(out.columns))
    return out.withColumn("std", F.coalesce("std", F.lit(0.0))) if std_fill and "std" in stats else out


def summarise_columns(wide: DataFrame, keys: list[str], columns: list[str], stats: tuple[str, ...] = ("mean",)) -> DataFrame:
    """keys, metric and ``stats`` (no median) for each of ``columns``: what ``summarise`` gives for the
    long table of these columns, from one row a key instead of one for each metric."""
    rows = wide.where(" and ".join(f"`{k}` is not null" for k in keys))
    made = rows.groupBy(*keys).agg(*(statistic(s, c).alias(f"{s} {c}") for c in columns for s in stats))
    each = (F.struct(F.lit(c).alias("metric"), *(F.col(f"`{s} {c}`").alias(s) for s in stats)) for c in columns)
    return made.select(*keys, F.inline(F.array(*each)))


def means_in_groups(wide: DataFrame, cell: list[str], columns: list[str], groups: DataFrame, group: str) -> DataFrame:
    """(group, cell, metric, value): means of each cell, and the group that ``groups`` (cell_id, group) names.

    A row holds all metrics until both are known and is kept in a checkpoint, since
    statistics of large groups read the rows several times."""
    ensure_checkpoint_dir(wide.sparkSession)
    rows = wide.where(" and ".join(f"`{k}` is not null" for k in cell))
    means = rows.groupBy(*cell).agg(*(F.avg(c).alias(c) for c in columns))
    kept = means.join(groups, "cell_id").select(group, *cell, *columns).checkpoint()
    return kept.select(group, *cell, F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns))))


def complexity(cells: DataFrame, dual: Column, area: Column, networks: Column, name: str = "score") -> DataFrame:
    """``cells`` with the expected work of each: 50 if it is imaged twice, up to 20 by its
    area as part of the largest one, and 5 for each network organelle. What is null
    counts as 0; if no area is above 0, none counts. The largest area is one row."""
    top = cells.agg(F.max(area).alias("_top"))
    part = F.when(F.col("_top") > 0, 20 * F.coalesce(area, F.lit(0.0)) / F.col("_top")).otherwise(0.0)
    score = 50 * F.coalesce(dual.cast("int"), F.lit(0)) + part + 5 * F.coalesce(networks, F.lit(0))
    return cells.join(F.broadcast(top)).withColumn(name, score).drop("_top")


def split_at_quantile(df: DataFrame, value: str, q: float = 0.4, name: str = "light") -> DataFrame:
    """``df`` with a flag: is ``value`` at most its quantile over all rows? Null values are neither."""
    one = df.select(F.lit(True).alias("_whole"), value)
    cut = narrowed_quantile(one, ["_whole"], value, q).select(F.col("quantile").alias("_cut"))
    return df.join(F.broadcast(cut), how="left").withColumn(name, F.col(value) <= F.col("_cut")).drop("_cut")


def objects_to_cells(objects: DataFrame) -> DataFrame:
    """(cell_id, organelle, metric) with six statistics and ``count`` of objects (rows, not values)."""
    keys = ["cell_id", "organelle", "metric"]
    rows = objects.where("cell_id is not null and organelle is not null and metric is not null")
    return _placed(rows, keys, "value").groupBy(*keys).agg(*(statistic(s) for s in SIX), F.count("*").alias("count"))


def long_statistics(summary: DataFrame, keys: list[str], stats: tuple[str, ...]) -> DataFrame:
    """One row for each statistic: keys, agg, value."""
    pairs = F.array(*(F.struct(F.lit(s).alias("agg"), F.col(s).cast("double").alias("value")) for s in stats))
    return summary.select(*keys, F.inline(pairs))


def cells_to_groups(cells: DataFrame, group: str, feature: list[str], stats: tuple[str, ...] = (*SIX, "count"), std_fill: bool = False) -> DataFrame:
    """Statistics of cell values for each guide, gene or other group and feature."""
    return summarise(cells, [group, *feature], stats, std_fill=std_fill)


def group_sizes(cells: DataFrame, group: str, inner: str | None = None) -> DataFrame:
    """n_cells of each group, and n_guides as distinct ``inner`` keys if one is named."""
    aggs = [F.count("*").alias("n_cells")] + ([F.count_distinct(inner).alias("n_guides")] if inner else [])
    return cells.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs)


def first_metadata(cells: DataFrame, group: str, columns: list[str], order: str) -> DataFrame:
    """For each group the first non-null value of each column by ``order``."""
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return cells.where(F.col(group).isNotNull()).groupBy(group).agg(*picks)


def area_fraction(cell_features: DataFrame, cell_area: DataFrame) -> DataFrame:
    """cell_id, organelle, area_fraction: summed object area over cell area (null for area 0)."""
    joined = cell_features.where("metric = 'area'").join(cell_area, "cell_id")
    return joined.select("cell_id", "organelle", (F.col("sum") / F.nullif(F.col("cell_area"), F.lit(0.0))).alias("area_fraction"))


def control_counts(cells: DataFrame, experiment: str, is_control: Column) -> DataFrame:
    """n_ko, n_ntc and n_total of each experiment."""
    flag = F.coalesce(is_control, F.lit(False))
    return cells.groupBy(experiment).agg(F.count_if(~flag).alias("n_ko"), F.count_if(flag).alias("n_ntc"), F.count("*").alias("n_total"))


def coverage(cells: DataFrame, keys: list[str], experiment: str) -> DataFrame:
    """For each channel pair: distinct experiments and cells."""
    return cells.groupBy(*keys).agg(F.count_distinct(experiment).alias("n_experiments"), F.count("*").alias("n_cells"))


def match_report(cells: DataFrame, experiment: str, channel: str, matched: Column) -> DataFrame:
    """Cells and matched cells by (experiment, channel), by experiment and in all; level 0, 1 and 3 say which."""
    rolled = cells.rollup(experiment, channel).agg(F.count("*").alias("n_cells"), F.count_if(F.coalesce(matched, F.lit(False))).alias("n_matched"), F.grouping_id().alias("level"))
    return rolled.withColumn("match_rate", F.col("n_matched") / F.col("n_cells"))


def null_audit(long: DataFrame, feature: str = "metric", value: str = "value") -> DataFrame:
    """Share of missing values (null or NaN) of each feature, and flags above 95 and 99 percent."""
    missing = F.avg((F.col(value).isNull() | F.isnan(value)).cast("int"))
    out = long.groupBy(feature).agg(F.count("*").alias("n"), missing.alias("missing"))
    return out.withColumns({"over_95": F.col("missing") > 0.95, "over_99": F.col("missing") > 0.99})


def null_audit_by(long: DataFrame, group: str, feature: str = "metric", value: str = "value") -> DataFrame:
    """(group, n, missing, n_over_95, n_over_99): share of missing values of each
    group, and in all (null group), and how many of its features pass either limit."""
    gone = F.col(value).isNull() | F.isnan(value)
    each = long.where(F.col(group).isNotNull()).groupBy(group, feature).agg(F.count("*").alias("n"), F.count_if(gone).alias("_gone"))
    whole = each.groupBy(feature).agg(F.sum("n").alias("n"), F.sum("_gone").alias("_gone")).withColumn(group, F.lit(None).cast(dict(long.dtypes)[group]))
    share = F.col("_gone") / F.col("n")
    both = each.unionByName(whole, allowMissingColumns=True)
    return both.groupBy(group).agg(F.sum("n").alias("n"), (F.sum("_gone") / F.sum("n")).alias("missing"), F.count_if(share > 0.95).alias("n_over_95"), F.count_if(share > 0.99).alias("n_over_99"))


def spread_medians(long: DataFrame, group: str, feature: str = "metric", value: str = "value") -> DataFrame:
    """(group, n_features, median_abs_mean, median_std): over the features of each
    group, medians of the mean's size and of the population deviation. Scaled tables have about 0 and 1."""
    each = long.where(F.col(group).isNotNull()).groupBy(group, feature).agg(F.abs(F.avg(value)).alias("_m"), F.stddev_pop(value).alias("_s"))
    return each.groupBy(group).agg(F.count("*").alias("n_features"), F.percentile("_m", F.lit(0.5)).alias("median_abs_mean"), F.percentile("_s", F.lit(0.5)).alias("median_std"))


def worst(audit: DataFrame, by: str, key: str, n: int = 10) -> DataFrame:
    """The n rows of largest ``by``, ties by key: a report, hence the limit."""
    return audit.orderBy(F.desc(by), key).limit(n)


def marker_table(cells: DataFrame, channel: str, experiment: str, is_control: Column) -> DataFrame:
    """Rows, KO, NTC and experiments of each channel."""
    flag = F.coalesce(is_control, F.lit(False))
    return cells.groupBy(channel).agg(
        F.count("*").alias("n_rows"), F.count_if(~flag).alias("n_ko"), F.count_if(flag).alias("n_ntc"), F.count_distinct(experiment).alias("n_experiments")
    )


def wide(long: DataFrame, key: str, name: Column, names: list[str], value: str = "value") -> DataFrame:
    """One column for each of ``names``; the names are given, so nothing is collected."""
    return long.withColumn("_name", name).groupBy(key).pivot("_name", names).agg(F.first(value, ignorenulls=True))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (all parts known) of more than one row and how many."""
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error that names a few duplicate keys."""
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"duplicate {keys}: {[tuple(r)[:-1] for r in found]}")
    return df


def system_coverage(cells: DataFrame, first: Column, second: Column) -> DataFrame:
    """Cells by whether their first and second (id, box) system is valid."""
    return cells.groupBy(F.coalesce(first, F.lit(False)).alias("first"), F.coalesce(second, F.lit(False)).alias("second")).agg(F.count("*").alias("n_cells"))


def check_outputs(rows: DataFrame, key: list[str], required: list[str], channel: str, cap_key: str, cap: int) -> DataFrame:
    """(check, n_bad) of an output table: duplicate keys, missing columns, channels
    beyond the first, groups above the cap. One scan for the counts of groups each."""
    spark = rows.sparkSession
    missing = spark.createDataFrame([("missing_columns", len([c for c in required if c not in rows.columns]))], "check string, n_bad long")
    dup = duplicate_keys(rows, key).agg(F.lit("duplicate_keys").alias("check"), F.count("*").alias("n_bad"))
    channels = rows.agg(F.lit("extra_channels").alias("check"), F.greatest(F.lit(0), F.count_distinct(channel) - 1).alias("n_bad"))
    over = rows.groupBy(cap_key).agg(F.count("*").alias("n")).where(F.col("n") > cap).agg(F.lit("groups_over_cap").alias("check"), F.count("*").alias("n_bad"))
    return missing.unionByName(dup).unionByName(channels).unionByName(over)


def timing_summary(steps: DataFrame, step: str = "step", seconds: str = "seconds") -> DataFrame:
    """Mean, median, largest and total seconds of each step."""
    out = summarise(steps, [step], ("count", "mean", "median", "max", "sum"), seconds)
    return out.withColumnsRenamed({"count": "n", "sum": "total"})
