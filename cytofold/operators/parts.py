"""Work on whole parts of sparse images: pixels that hang together meet in one task,
many parts an Arrow batch, as sorted arrays instead of rasters. Parts are found in
squares; only those near a square's border go through joins, and only what is larger
than a task should hold is left to the ways over blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from cytofold.operators.graph import connected_components, ensure_checkpoint_dir, local_components, spread
from cytofold.operators.raster import in_groups
from cytofold.shipping import on_executors

#: Rows that are worked on at once; fewer would cost a call each.
AT_ONCE = 50_000
_HALF = ((0, 1), (1, -1), (1, 0), (1, 1))


@dataclass
class Pixels:
    """Pixels of whole parts in the order of ``wide``, the number of their group above their code y * 2**20 + x."""

    wide: np.ndarray
    height: np.ndarray
    width: np.ndarray
    value: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.code = self.wide & ((1 << 41) - 1)
        self.y, self.x = self.code >> 20, self.code & ((1 << 20) - 1)

    def __len__(self) -> int:
        return len(self.wide)

    def only(self, keep: np.ndarray) -> Pixels:
        return Pixels(self.wide[keep], self.height[keep], self.width[keep], None if self.value is None else self.value[keep])

    def near(self, dy: int, dx: int, who: np.ndarray | slice = np.s_[:]) -> np.ndarray:
        """The place of each pixel's neighbour, the number of all pixels where there is none."""
        n = len(self)
        if not n:
            return np.zeros(0, np.int64)
        want, x = self.wide[who] + (dy << 20) + dx, self.x[who] + dx
        at = np.minimum(np.searchsorted(self.wide, want), n - 1)
        return np.where((self.wide[at] == want) & (x >= 0) & (x < 1 << 20), at, n)

    def around(self) -> list[np.ndarray]:
        """Places of the eight neighbours."""
        n, out = len(self), []
        for dy, dx in _HALF:
            to = self.near(dy, dx)
            hit = np.flatnonzero(to < n)
            back = np.full(n, n)
            back[to[hit]] = hit
            out += [to, back]
        return out

    def cells(self, side: int) -> np.ndarray:
        """For each pixel the number of its part, parts being what cells of ``side`` pixels that touch hold together."""
        if not len(self):
            return np.zeros(0, np.int64)
        wide, at = np.unique((self.wide >> 41 << 41) + (self.y // side << 20) + self.x // side, return_inverse=True)
        cells = Pixels(wide, wide, wide)
        to = [cells.near(dy, dx) for dy, dx in _HALF]
        a, b = np.tile(np.arange(len(wide)), len(to)), np.concatenate(to)
        return local_components(len(wide), a[b < len(wide)], b[b < len(wide)])[at]


def _taken(part: pa.Table) -> tuple[Pixels, np.ndarray]:
    """The pixels of sorted groups and the row of each; of repeated ones the largest value and extent count."""
    column = lambda c: part.column(c).to_numpy()
    wide = ((np.cumsum(column("_new")) - 1) << 41) + (column("y") << 20) + column("x")
    row = np.flatnonzero(np.r_[True, wide[1:] != wide[:-1]])
    most = lambda c: np.maximum.reduceat(column(c), row)
    return Pixels(wide[row], most("height"), most("width"), most("_value") if "_value" in part.column_names else None), row


def by_parts(px: DataFrame, key: str, reach: int, work: Callable[[Pixels], tuple[np.ndarray, np.ndarray]], name: str, value: str | None = None, rows: int | None = None, square: int = 512, most: int = 250_000) -> tuple[DataFrame, DataFrame | None]:
    """(key, y, x, name) that ``work`` makes of whole parts, and the pixels of the parts above ``most`` pixels (None if there are none).

    ``px``: key, y, x, height, width and, if named, ``value`` (unknown ones are no pixels). Pixels within ``reach`` along
    both axes are in one part. ``work`` gets many parts at once and returns places of its pixels, in order, and a whole number for
    each. Repeated pixels count once; rows with a null place or outside the image are left out. ``rows`` may be rough.

    Squares are solved where they are; parts that may go on in another square are tied by
    the cells of ``reach`` pixels that touch across, brought together and solved then."""
    spark, side = px.sparkSession, max(1, reach)
    ensure_checkpoint_dir(spark)
    on_executors(spark)
    values = [] if value is None else [F.col(value).cast("double").alias("_value")]
    px = px.where("y >= 0 and x >= 0 and y < height and x < width").select(key, *(F.col(c).cast("long").alias(c) for c in ("y", "x", "height", "width")), *values)
    px = px if value is None else px.where("_value is not null and not isnan(_value)")
    px = px.withColumns({"_by": F.floor(F.col("y") / square), "_bx": F.floor(F.col("x") / square)})
    px = spread(px, px.count() if rows is None else rows, key, "_by", "_bx")
    at = [px.schema[key], StructField("y", IntegerType()), StructField("x", IntegerType())]
    more = [StructField(c, LongType()) for c in ("height", "width", "_part")] + ([] if value is None else [StructField("_value", DoubleType())])
    kind = pa.struct([(f.name, pa.float64() if f.name == "_value" else pa.int64()) for f in more])

    def made(part: pa.Table, p: Pixels, row: np.ndarray, found: np.ndarray) -> pa.Table:
        return pa.table({key: part.column(key).take(pa.array(row)), "y": pa.array(p.y.astype(np.int32)), "x": pa.array(p.x.astype(np.int32)), name: pa.array(found, pa.int64())})

    def packed(part: pa.Table, p: Pixels, row: np.ndarray, found: np.ndarray) -> pa.Table:
        """One row a square, since what is solved is only kept until the rest is."""
        number = p.wide >> 41
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]][: len(p)])
        data = [np.stack(z).tobytes() for z in zip(np.split(p.code, start[1:]), np.split(found, start[1:]), strict=True)][: len(start)]
        none = lambda t: pa.nulls(len(start), t)
        return pa.table({key: part.column(key).take(pa.array(row[start])), "y": none(pa.int32()), "x": none(pa.int32()), "_open": none(kind), "_solved": pa.array(data, pa.binary())})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(1)):
                code, found = np.frombuffer(data.as_buffer(), np.int64).reshape(2, -1)
                own = batch.column(0).take(pa.array(np.full(len(code), k)))
                yield from pa.table({key: own, "y": pa.array((code >> 20).astype(np.int32)), "x": pa.array((code & ((1 << 20) - 1)).astype(np.int32)), name: pa.array(found)}).to_batches()

    def first(part: pa.Table) -> pa.Table:
        p, row = _taken(part)
        cell = p.cells(side)
        near = np.zeros(len(p), bool)
        for z, end in ((p.y, p.height), (p.x, p.width)):
            near |= (z % square < 2 * side) & (z >= square)
            near |= (z % square >= square - 2 * side) & ((z // square + 1) * square < end)
        goes_on = np.zeros(len(p), bool)
        goes_on[cell[near]] = True
        least = np.full(len(p), len(p))
        np.minimum.at(least, cell, np.arange(len(p)))
        own, rest = np.flatnonzero(~goes_on[cell]), np.flatnonzero(goes_on[cell])
        whole = p.only(own)
        place, found = work(whole)
        open_ = p.only(rest)
        columns = {"height": open_.height, "width": open_.width, "_part": p.code[least[cell[rest]]], "_value": open_.value}
        extent = pa.StructArray.from_arrays([pa.array(columns[f.name]) for f in more], fields=list(kind))
        left = made(part, open_, row[rest], np.zeros(len(rest), np.int64)).drop_columns([name]).append_column("_open", extent).append_column("_solved", pa.nulls(len(rest), pa.binary()))
        return pa.concat_tables([packed(part, whole.only(place), row[own[place]], found), left])

    def second(part: pa.Table) -> pa.Table:
        p, row = _taken(part)
        place, found = work(p)
        return made(part, p.only(place), row[place], found)

    result = StructType([*at, StructField(name, LongType())])
    both = in_groups(px, [key, "_by", "_bx"], ["y", "x"], first, StructType([*at, StructField("_open", StructType(more)), StructField("_solved", BinaryType())]), AT_ONCE).checkpoint()
    solved = both.where("_solved is not null").select(key, "_solved").mapInArrow(unpacked, result)
    open_ = both.where("_open is not null").select(key, "y", "x", "_open.*")
    edge = F.lit(False)
    for c in ("y", "x"):
        edge = edge | (F.col(c) % square < 2 * side) | (F.col(c) % square >= square - 2 * side)
    cells = open_.where(edge).select(key, F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x") / side).alias("cx"), F.struct(F.col(key).alias("key"), F.col("_part").alias("part")).alias("src")).distinct().checkpoint()
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), *_HALF))))
    sent = cells.withColumn("s", steps).select(key, (F.col("cy") + F.col("s.dy")).alias("cy"), (F.col("cx") + F.col("s.dx")).alias("cx"), "src")
    met = sent.join(cells.withColumnRenamed("src", "dst"), [key, "cy", "cx"]).where("src <> dst")
    tied = connected_components(met.select("src", "dst").distinct()).select(F.col("node.key").alias(key), F.col("node.part").alias("_part"), F.col("component.part").alias("_to"))
    open_ = open_.join(tied, [key, "_part"], "left").withColumn("_root", F.coalesce("_to", "_part")).drop("_part", "_to").checkpoint()
    sizes = open_.groupBy(key, "_root").agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if not total:
        return solved, None
    large = None
    if largest > most:
        sizes = sizes.where(F.col("_n") > most).select(key, "_root")
        large = open_.join(sizes, [key, "_root"], "left_semi").drop("_root")
        open_ = open_.join(sizes, [key, "_root"], "left_anti")
    met = spread(open_.withColumns({c: F.col(c).cast("long") for c in ("y", "x")}), total, key, "_root")
    return solved.unionByName(in_groups(met, [key, "_root"], ["y", "x"], second, result, AT_ONCE)), large
