"""Images as tables of blocks, and kernels over blocks with a border.

A block is one row: key, by, bx (its place in the grid of its image), height and
width (of the image) and data, its pixels row by row as 64-bit floats; blocks at
the lower and right edge may be smaller. Blocks without a row hold only ``fill``.
A kernel sees its block with ``radius`` pixels more on every side: each block
sends its edge strips to its eight neighbours, so one shuffle moves the image
once and the strips beside it, whatever the radius of the kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytofold.shipping import on_executors

SIZE = 256
#: Bytes of blocks after which a task hands on what it sends, so that it never holds the strips of a whole batch.
SENT = 8 << 20
_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


@dataclass
class Place:
    """Where a window's block lies: its first pixel, its extent, the image's extent,
    and the values of the carried columns (None for a block without a row)."""

    y0: int
    x0: int
    h: int
    w: int
    height: int
    width: int
    carried: dict


def _fields(df: DataFrame, names: list[str], more: str) -> StructType:
    return StructType([*df.select(*names).schema.fields, *StructType.fromDDL(more).fields])


def to_blocks(px: DataFrame, key: str, size: int = SIZE, value: str = "value", fill: float = 0.0) -> DataFrame:
    """Blocks of a pixel table (key, y, x, value, height, width). Pixels that it lacks,
    and null values, are ``fill``; of repeated pixels the largest value counts. Rows
    with a null place or outside the image are left out."""
    on_executors(px.sparkSession)
    rows = px.where("y >= 0 and x >= 0 and y < height and x < width").select(key, "y", "x", F.col(value).cast("double").alias("value"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"))
    rows = rows.withColumns({"by": F.floor(F.col("y") / size).cast("int"), "bx": F.floor(F.col("x") / size).cast("int")})

    def dense(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[:1]
        by, bx, height, width = int(one["by"].iloc[0]), int(one["bx"].iloc[0]), int(part["height"].max()), int(part["width"].max())
        data = np.full((min(size, height - by * size), min(size, width - bx * size)), np.nan)
        # fmax leaves out what is unknown
        np.fmax.at(data, (part["y"].to_numpy() - by * size, part["x"].to_numpy() - bx * size), part["value"].to_numpy(float))
        data[np.isnan(data)] = fill
        return one[[key, "by", "bx"]].assign(height=np.int32(height), width=np.int32(width), data=[data.tobytes()])

    return rows.groupBy(key, "by", "bx").applyInPandas(dense, _fields(rows, [key, "by", "bx", "height", "width"], "data binary"))


def to_pixels(blocks: DataFrame, key: str, size: int = SIZE, fill: float | None = 0.0) -> DataFrame:
    """(key, y, x, value, height, width) of the pixels of all blocks that are not ``fill`` (None: of all; NaN never)."""
    on_executors(blocks.sparkSession)

    def run(parts):
        for part in parts:
            for row in part.itertuples(index=False):
                w = min(size, row.width - row.bx * size)
                v = np.frombuffer(row.data)
                at = np.flatnonzero(~np.isnan(v) if fill is None else (v != fill) & ~np.isnan(v))
                if len(at):
                    yield pd.DataFrame({key: [row[0]] * len(at), "y": at // w + row.by * size, "x": at % w + row.bx * size, "value": v[at], "height": row.height, "width": row.width})

    rows = blocks.select(key, "by", "bx", "height", "width", "data")
    return rows.mapInPandas(run, _fields(rows, [key], "y int, x int, value double, height int, width int"))


def _mirrored(first: int, last: int, size: int) -> np.ndarray:
    at = np.arange(first, last) % (2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def over_windows(blocks: DataFrame, key: str, radius: int, kernel: Callable[[np.ndarray, Place], pd.DataFrame | None], schema: str, size: int = SIZE, fill: float = 0.0, mirror: bool = True, carry: tuple[str, ...] = (), shared: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, by, bx, height, width and ``schema``) that ``kernel`` makes of every
    block's window, ``radius`` (``size`` at most) pixels larger on every side. Beyond the image the window is mirrored or,
    without ``mirror``, NaN. A block without a row has a window if a neighbour has
    one. Columns named in ``carry`` come to the kernel in the block's place, and those in
    ``shared``, which all blocks of an image have alike, even where the block has no row."""
    if radius > size:
        raise ValueError("the radius is larger than a block")
    on_executors(blocks.sparkSession)
    grid = [key, "by", "bx", "height", "width"]
    carried_names = [*carry, *shared]
    rows = blocks.select(*grid, "data", *carried_names)

    def send(parts):
        for part in parts:
            out, held = [], 0
            for row in part.itertuples(index=False):
                named = dict(zip(part.columns, row, strict=True))
                by, bx, height, width = (int(x) for x in row[1:5])
                h, w = min(size, height - by * size), min(size, width - bx * size)
                data = np.frombuffer(row[5]).reshape(h, w)
                for dy, dx in _AROUND:
                    ty, tx = by + dy, bx + dx
                    if min(ty, tx) < 0 or ty * size >= height or tx * size >= width or (dy or dx) and not radius:
                        continue
                    ys = {-1: (0, min(radius, h)), 0: (0, h), 1: (max(0, h - radius), h)}[dy]
                    xs = {-1: (0, min(radius, w)), 0: (0, w), 1: (max(0, w - radius), w)}[dx]
                    strip = data[ys[0] : ys[1], xs[0] : xs[1]]
                    own = [named[c] if not (dy or dx) or c in shared else None for c in carried_names]
                    out.append((row[0], ty, tx, height, width, by * size + ys[0], bx * size + xs[0], strip.shape[0], strip.tobytes(), not (dy or dx), *own))
                held += data.nbytes
                if held >= SENT:
                    yield pd.DataFrame(out, columns=[*grid, "_y", "_x", "_h", "_data", "_own", *carried_names])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=[*grid, "_y", "_x", "_h", "_data", "_own", *carried_names])

    sent = rows.mapInPandas(send, StructType([*_fields(rows, grid, "_y int, _x int, _h int, _data binary, _own boolean").fields, *rows.select(*carried_names).schema.fields]))

    def apply(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[:1][grid]
        by, bx, height, width = (int(x) for x in one.iloc[0, 1:])
        y0, x0 = by * size, bx * size
        h, w = min(size, height - y0), min(size, width - x0)
        top, left = max(0, y0 - radius), max(0, x0 - radius)
        seen = np.full((min(height, y0 + h + radius) - top, min(width, x0 + w + radius) - left), fill)
        for y, x, n, data in zip(part["_y"], part["_x"], part["_h"], part["_data"], strict=True):
            strip = np.frombuffer(data).reshape(n, -1)
            seen[y - top : y - top + n, x - left : x - left + strip.shape[1]] = strip
        if mirror:
            ys, xs = (_mirrored(a - radius, a + n + radius, full) - lo for a, n, full, lo in ((y0, h, height, top), (x0, w, width, left)))
            window = seen[ys[:, None], xs]
        else:
            window = np.full((h + 2 * radius, w + 2 * radius), np.nan)
            window[top - y0 + radius :, left - x0 + radius :][: seen.shape[0], : seen.shape[1]] = seen
        own = part[part["_own"]]
        carried = {c: (own[c].iloc[0] if len(own) else None) for c in carry} | {c: part[c].iloc[0] for c in shared}
        made = kernel(window, Place(y0, x0, h, w, height, width, carried))
        if made is None:
            return pd.DataFrame(columns=[*grid, *names])
        return pd.concat([one.loc[one.index.repeat(len(made))].reset_index(drop=True), made.reset_index(drop=True)], axis=1)

    made_schema = _fields(rows, grid, schema)
    names = made_schema.fieldNames()[len(grid) :]
    return sent.groupBy(key, "by", "bx").applyInPandas(apply, made_schema)


def stencil(blocks: DataFrame, key: str, radius: int, kernel: Callable[[np.ndarray], np.ndarray], size: int = SIZE, fill: float = 0.0, mirror: bool = True) -> DataFrame:
    """Blocks of ``kernel(window)``, an array of the window's shape whose border is cut off."""

    def cut(window: np.ndarray, place: Place) -> pd.DataFrame:
        out = np.asarray(kernel(window), float)[radius : radius + place.h, radius : radius + place.w]
        return pd.DataFrame({"data": [np.ascontiguousarray(out).tobytes()]})

    return over_windows(blocks, key, radius, cut, "data binary", size, fill, mirror)
