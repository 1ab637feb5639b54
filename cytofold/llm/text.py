"""Shared pieces of the corpus operators: Arrow batch mapping, byte-level word
hashing and the bounded deterministic row sample used to fit models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir
from cytofold.shipping import on_executors

HASH_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
MASK64 = (1 << 64) - 1


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 modulo 5 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
    rows: int | None = None,
) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make()`` runs once in each task
    and returns the function applied to every non-empty batch, or to its parts
    of ``rows`` rows at most, which bounds what a worker holds as Python objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in pieces_of(batch, rows or max(1, batch.num_rows)):
                if (out := each(part)) is not None:
                    yield out

    return in_arrow(df, run, schema)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``, with the package sent to the executors before."""
    on_executors(df.sparkSession)
    return df.mapInArrow(run, schema)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the checkpoint folder, which all executors share: a table
    of wide rows that is read more than once is computed once, and lost executors do not lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def pieces_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``rows`` rows at most."""
    return (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def bounded_sample(df: DataFrame, key: Column, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows at most (all, if there are fewer), chosen by a hash of
    ``key``: deterministic, spread over all partitions and free of a sort. Used
    only to fit models; ``rows`` is a documented parameter of every caller."""
    n = df.count() if total is None else total
    if n <= rows:
        return df
    cut = int(rows / n * 1_000_000)
    return df.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) < cut)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            inverse = np.uint64(pow(int(HASH_BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, HASH_BASE)])
                self.down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, inverse)])
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (multiply and shift), so that all bits depend on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of ``data[start:end]`` (bytes), equal for equal contents:
    prefix sums of a polynomial give all of them without a loop."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edge[::2], edge[1::2]
