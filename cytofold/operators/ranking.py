"""Caps, ranks, deduplication, sampling and per-batch scaling by window functions.

Every choice has a total order. Spark limits the rows of a small cap before the
shuffle; a large cap is taken in two levels, so a key with very many rows is split.
Ranks of all rows of such keys come from one sort of the table (``rank_in``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir

#: Caps up to here are applied by Spark in the map tasks already.
SMALL_CAP = 1_000
#: Parts of a key from which a larger cap is taken first.
LOTS = 64


def shuffle_order(*ids: str, seed: int = 42) -> Column:
    """A fixed pseudo-random order of rows by their ids."""
    return F.xxhash64(F.lit(seed), *ids)


def portable_order(*ids: str, seed: int = 42) -> Column:
    """As ``shuffle_order``, by a hash that other SQL engines have too."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order (a stratified cap, or keep-best). Null keys are one key.

    What is first in a key is first in its part of the key, so a cap above SMALL_CAP
    is taken in LOTS parts of every key before it is taken in the key: no task sorts
    a whole key, and LOTS * n rows meet at most. Rows are dealt to parts by their
    partition, which changes no result."""
    if n > SMALL_CAP:
        part = Window.partitionBy(*keys, "_lot").orderBy(*order)
        df = df.withColumn("_lot", F.spark_partition_id() % LOTS).withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_lot")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_first_known(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """``keep_first`` for rows whose keys are all known; others stay as they are."""
    known = " and ".join(f"`{k}` is not null" for k in keys)
    return keep_first(df.where(known), keys, *order).unionByName(df.where(f"not ({known})"))


def rank_in(df: DataFrame, keys: list[str], *order: Column | str, name: str = "rank", hot_rows: int | None = None) -> DataFrame:
    """Position from 1 within each key; null keys are one key.

    A key's rows meet in one task, unless ``hot_rows`` is given: keys with more rows
    than that, and more than a thousandth of all, are counted first (the keys alone)
    and ranked by a sort over all tasks: a row's rank is its place in its sorted
    partition and what earlier partitions hold of its key. That table has a row for
    each partition and two for a key at most, so it is broadcast."""
    plain = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if hot_rows is None:
        return plain(df)
    ensure_checkpoint_dir(df.sparkSession)
    key = F.struct(*(F.col(k) for k in keys))
    sizes = df.groupBy(key.alias("_key")).agg(F.count("*").alias("_size"))
    total, most = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    least = max(hot_rows, total // 1_000)
    if most <= least:
        return plain(df)
    hot = F.broadcast(sizes.where(F.col("_size") > least).select("_key"))
    rows = df.withColumn("_key", key)
    columns = [F.col(k) for k in keys]
    placed = rows.join(hot, "_key", "left_semi").repartitionByRange(*columns, *order).sortWithinPartitions(*columns, *order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lots = placed.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    lots = lots.select("_key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.join(F.broadcast(lots), ["_key", "_part"]).withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int"))
    return plain(rows.join(hot, "_key", "left_anti").drop("_key")).unionByName(ranked.select(*df.columns, name))


def channel_ranks(ranked: DataFrame, gene: str = "gene", channel: str = "channel", rank: str = "rank") -> DataFrame:
    """(gene, channel, channel_rank): channels of a gene in order of their best rank, then name."""
    best = ranked.groupBy(gene, channel).agg(F.min(rank).alias("_best"))
    w = Window.partitionBy(gene).orderBy("_best", channel)
    return best.select(gene, channel, F.row_number().over(w).alias("channel_rank"))


def drop_multiplets(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows of keys with exactly one distinct non-null label.

    Counted by a grouped aggregate and joined back, so one very common key does
    not gather all its rows in a task. Rows with a null key go."""
    one = df.groupBy(*keys).agg(F.min(label).alias("_low"), F.max(label).alias("_high")).where("_low = _high").select(*keys)
    return df.join(one, keys, "left_semi")


def batches(df: DataFrame, well: str, order: list[Column | str], size: int, hot_rows: int | None = None) -> DataFrame:
    """``batch``: number of the block of ``size`` rows within its well, in order; ``hot_rows`` as in ``rank_in``."""
    ranked = rank_in(df, [well], *order, name="_rank", hot_rows=hot_rows)
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


def zscore(long: DataFrame, batch: str, feature: str, value: str = "value", least_rows: int = 5, floor: float = 1e-8, clip: float = 10.0) -> DataFrame:
    """``z``: value scaled by mean and population deviation of its batch and
    feature, clipped; null if the deviation is tiny; unscaled in batches of fewer
    than ``least_rows`` rows (null values count as rows).

    Moments are a grouped aggregate joined back, never a window over a whole batch."""
    moments = long.groupBy(batch, feature).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count("*").alias("_n"))
    scaled = (F.col(value) - F.col("_mean")) / F.col("_std")
    z = F.when(F.col("_n") < least_rows, F.col(value)).when(F.col("_std") > floor, F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled)))
    return long.join(moments, [batch, feature]).withColumn("z", z).drop("_mean", "_std", "_n")


def prefix_offsets(tiles: DataFrame, group: str, order: list[str], count: str) -> DataFrame:
    """``offset``: sum of ``count`` over the tiles before it in its group."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)))


def relabel(df: DataFrame, clusters: DataFrame, gene: str, unassigned: str | None, control: str = "NTC") -> DataFrame:
    """``complex`` of each row's gene: the first cluster that lists it, controls
    as they are, others ``unassigned`` or dropped if that is None. ``clusters``
    (gene, complex, position) is a hand-made list of a few thousand rows."""
    first = clusters.groupBy("gene").agg(F.min_by("complex", "position").alias("_complex")).withColumnRenamed("gene", "_gene")
    joined = df.join(first, df[gene] == first._gene, "left")
    named = F.coalesce(F.when(F.col(gene) == control, F.lit(control)), F.col("_complex"), F.lit(unassigned))
    out = joined.withColumn("complex", named).drop("_gene", "_complex")
    return out if unassigned is not None else out.where(F.col("complex").isNotNull())


def seeded_sample(df: DataFrame, keys: list[str], ids: list[str], n: int, portable: bool = False) -> DataFrame:
    """n rows of each key (all, if fewer) in an order seeded by the key itself:
    the same key always yields the same rows, whatever else is in the table.
    ``portable`` orders by a hash that other SQL engines have too."""
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    seeded = F.md5(F.concat_ws("|", text, *(F.col(i).cast("string") for i in ids))) if portable else F.xxhash64(F.crc32(text.cast("binary")), *ids)
    return keep_first(df, keys, seeded, *ids, n=n)


def preview(df: DataFrame, ids: list[str], share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, the same ones each time."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1_000_000)) < int(share * 1_000_000))


def preview_rows(df: DataFrame, ids: list[str], n: int, seed: int = 42, portable: bool = False) -> DataFrame:
    """``n`` rows (a preview, hence the limit), the same ones each time; ``portable`` as in ``seeded_sample``."""
    return df.orderBy(portable_order(*ids, seed=seed) if portable else shuffle_order(*ids, seed=seed), *ids).limit(n)


def limit_objects(pixels: DataFrame, keys: list[str], label: str, n: int, portable: bool = False) -> DataFrame:
    """Pixels of at most n objects of each key, chosen among the distinct labels
    in an order seeded by the key."""
    chosen = seeded_sample(pixels.select(*keys, label).distinct(), keys, [label], n, portable)
    return pixels.join(chosen, [*keys, label], "left_semi")
