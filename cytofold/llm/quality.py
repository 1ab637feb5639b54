"""Quality selection by importance resampling.

Two generative bag-of-n-gram models over hashed word unigrams and bigrams, one
of the target (rows labelled as good) and one of the raw text, give each
document the log of its likelihood ratio. Adding Gumbel noise and keeping the k
largest draws k documents without replacement in proportion to the ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import bounded_sample, held_out, in_arrow, map_batches, mix, Powers, runs, span_hashes, texts_of

BUCKETS = 1 << 14

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features_of(text: str, powers: Powers, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and of every pair of neighbouring words (lower-cased ASCII, split at white space)."""
    data = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    start, end = runs(~_SPACE[data])
    word = span_hashes(data, start, end, powers)
    with np.errstate(over="ignore"):
        pair = mix(word[:-1] * np.uint64(3) + word[1:])
    return (np.concatenate([word, pair]) % np.uint64(buckets)).astype(np.int64)


@dataclass
class RatioModel:
    """log(target) - log(raw) of every bucket."""

    ratio: np.ndarray

    def weight(self, text: str, powers: Powers) -> float:
        at = features_of(text, powers, len(self.ratio))
        return float(self.ratio[at].sum()) if len(at) else 0.0


def _count(batches):
    powers, counts = Powers(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, y in zip(texts_of(batch.column("text")), batch.column("good").to_pylist(), strict=True):
            own = np.bincount(features_of(text, powers), minlength=BUCKETS)
            counts[0] += own
            if y:
                counts[1] += own
    at = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], ["bucket", "raw", "good"])


def fit_ratio(docs: DataFrame, labels: DataFrame, max_target: int = 20_000, smoothing: float = 1.0) -> RatioModel:
    """Target: rows labelled quality 1 that are not held out, about ``max_target``
    of them at most (a bound on the fit only; their ids are broadcast). Raw: all
    documents, every one of them. Without a target every ratio is 0."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    good = bounded_sample(good, F.col("doc_id"), max_target).withColumn("good", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    summed = in_arrow(rows, _count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    table = np.zeros((2, BUCKETS))
    for r in summed.collect():  # at most the number of buckets
        table[:, r["bucket"]] = r["raw"], r["good"]
    if not table[1].sum():
        return RatioModel(np.zeros(BUCKETS))
    logs = np.log((table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * BUCKETS))
    return RatioModel(logs[1] - logs[0])


def importance(docs: DataFrame, model: RatioModel, seed: int = 42) -> DataFrame:
    """doc_id, log_weight and key (log_weight plus Gumbel noise) of every row.

    The noise depends on ``seed``, doc_id and text alone, so reruns and lost
    executors change nothing. Null and empty texts have weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, powers = shared.value, Powers()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            weight = [own.weight(t, powers) for t in texts_of(batch.column("text"))]
            return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "u": batch.column("u"), "log_weight": pa.array(weight, pa.float64())})

        return each

    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)
    uniform = (bits + 0.5) / F.lit(float(1 << 53))
    scored = map_batches(docs.select("doc_id", uniform.alias("u"), "text"), make, "doc_id long, u double, log_weight double")
    return scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log("u"))).alias("key"))


def gumbel_top_k(scored: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """The ``k`` rows of largest key (ties to smaller doc_id, nulls last), exactly
    and without a sort of all rows in one task: two histograms of ``bins`` bins
    narrow down where the k-th key lies, and only rows of that bin are ranked."""
    row = scored.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    if row["n"] <= k:
        return scored
    if k <= 0:
        return scored.limit(0)
    lo, hi, left = row["lo"], row["hi"], k
    above, inside = None, scored
    for _ in range(2):
        if not hi > lo:
            break
        width = (hi - lo) / bins
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1)).cast("int")
        counts = {r["b"]: r for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b]["n"] >= left:
                break
            left -= counts[b]["n"]
        lo, hi = counts[b]["lo"], counts[b]["hi"]
        inside = scored.where(F.col("key").between(lo, hi))
    above = scored.where(F.col("key") > hi)
    edge = inside.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(left)
    return above.unionByName(edge)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """doc_id, log_weight, key of the documents drawn.

    ``share`` of all rows is drawn; by default the share of rows labelled good
    among those not held out (all rows, if nothing is labelled). A filter of the
    raw text, so rows repeat as they do in ``docs``; only doc_id and text are read."""
    from cytofold.operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    model = fit_ratio(docs, labels)
    scored = importance(docs, model, seed).checkpoint()
    if share is None:
        row = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("quality").alias("share")).first()
        share = 1.0 if row["share"] is None else row["share"]
    return gumbel_top_k(scored, round(share * scored.count()))
