"""Attention-ranked cells: two layouts of the ranked tables brought to one, matched rows, failure lists and label metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytofold.functions.names import canonical_well, skip_reason
from cytofold.operators.ranking import channel_ranks


def attention_rows(rows: DataFrame, modality: str, top: int, channel_rank_max: int | None = None, control: bool = False) -> DataFrame:
    """Ranked cells of one table, in either layout, up to rank ``top``.

    The later layout names its channel ``channel`` and has no ``channel_rank``:
    the channels of a gene are then numbered by their best rank, ties by name.
    ``modality`` is "phase" (shown as "Phase", rank 1) or "fluorescent". Control
    tables keep top ranks only and get gene "NTC" if they name none."""
    out = rows
    if "viz_channel" not in out.columns and "channel" in out.columns:
        out = out.withColumnRenamed("channel", "viz_channel")
    if control:
        if "rank_type" in out.columns:
            out = out.where("rank_type = 'top'")
        if "gene" not in out.columns:
            out = out.withColumn("gene", F.lit("NTC"))
    if modality == "phase":
        out = out.withColumns({"viz_channel": F.lit("Phase"), "channel_rank": F.lit(1)})
    elif modality != "fluorescent":
        raise ValueError(f"unknown modality {modality!r}")
    elif "channel_rank" not in out.columns:
        out = out.join(channel_ranks(out, "gene", "viz_channel", "rank"), ["gene", "viz_channel"], "left")
    if channel_rank_max is not None and not control:
        out = out.where(F.col("channel_rank") <= channel_rank_max)
    return out.where(F.col("rank") <= top).withColumn("modality", F.lit(modality))


def attention_table(frames: list[DataFrame], experiments: list[str] | None = None) -> DataFrame:
    """All ranked cells, columns of any table kept (null where a table lacks them);
    ``well_canonical`` and ``segmentation`` as a whole number, null if it is none."""
    if not frames:
        raise ValueError("no ranked table")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if experiments is not None:
        out = out.where(F.col("experiment").isin(*experiments))
    number = F.col("segmentation").cast("string").try_cast("double")
    return out.withColumns({"well_canonical": canonical_well(F.col("well")), "segmentation": F.when(number == F.floor(number), F.floor(number))})


def matched_rows(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row of ``table`` for each row of ``wanted`` that names it, as often as it is named; wanted columns first."""
    return wanted.join(table, key).select(*wanted.columns, *(c for c in table.columns if c not in wanted.columns))


def failures(runs: DataFrame, ok: str = "COMPLETED") -> DataFrame:
    """(experiment, phase, base_job_id) of runs to repeat: any state but ``ok``, unknown ones too."""
    return runs.where(~F.coalesce(F.col("state") == ok, F.lit(False))).select("experiment", "phase", "base_job_id").distinct()


def write_failures(runs: DataFrame, path: str, ok: str = "COMPLETED") -> None:
    failures(runs, ok).write.mode("overwrite").option("header", True).csv(path)


def label_metadata(labels: DataFrame, parameters: list[str]) -> DataFrame:
    """(position, label, organelle, method, parameters, n_objects) of stored labels; the
    parameters that a label has are one JSON object, those that are null left out."""
    made = F.to_json(F.struct(*(F.col(p) for p in parameters)))
    return labels.select("position", "label", F.regexp_extract("label", "^(.*?)(_seg)?$", 1).alias("organelle"), "method", made.alias("parameters"), F.coalesce("n_objects", F.lit(0)).alias("n_objects"))


def channel_plan(channels: DataFrame, label_free: tuple[str, ...] = ("Phase2D", "Focus3D"), structures: tuple[str, ...] = ("tubular", "vesicular", "vesicular_dark")) -> DataFrame:
    """(experiment, channel_key, source_channel, structure, requires_mask) of what is segmented.

    Channels with a reason to be skipped are left out. Label-free channels have
    each of ``structures``, others the first. Nucleoli come from the first phase
    and the first focus channel by name, inside nuclei."""
    kept = channels.select("experiment", "channel").distinct().where(skip_reason(F.col("channel")).isNull())
    kinds: Column = F.when(F.col("channel").isin(*label_free), F.array(*(F.lit(s) for s in structures))).otherwise(F.array(F.lit(structures[0])))
    own = kept.select("experiment", F.col("channel").alias("channel_key"), F.col("channel").alias("source_channel"), F.explode(kinds).alias("structure"), F.lit(None).cast("string").alias("requires_mask"))
    low = F.lower("channel")
    found = channels.select("experiment", "channel").distinct().groupBy("experiment").agg(F.min(F.when(low.contains("phase"), F.col("channel"))).alias("phase2d"), F.min(F.when(low.contains("focus"), F.col("channel"))).alias("focus3d"))
    pairs = F.array(*(F.struct(F.lit(f"nucleoli_{s}").alias("channel_key"), F.col(s).alias("source_channel")) for s in ("phase2d", "focus3d")))
    nucleoli = found.select("experiment", F.inline(pairs)).where("source_channel is not null").withColumns({"structure": F.lit("nucleoli"), "requires_mask": F.lit("nuclei")})
    return own.unionByName(nucleoli)
