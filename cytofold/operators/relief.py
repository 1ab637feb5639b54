"""Relief of masks and images: distance to the background, maxima that stand out,
peaks with a least spacing, and floods from markers. No task holds an image: work
goes by whole parts, by runs of a column or row, by blocks with a border, and by joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cytofold.operators import blocks as B
from cytofold.operators.graph import ensure_checkpoint_dir, local_components, spread
from cytofold.operators.parts import Pixels, by_parts
from cytofold.operators.raster import label_pixels, moved
from cytofold.shipping import on_executors

# --- distance ---


def _row_minima(x: np.ndarray, g2: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For every place k of each run [start, end): the least g2[j] + (x[k] - x[j])**2 in its run.

    The place j of the minimum never goes back as k goes on (the lower envelope of
    parabolas of one width), so the middle place of every range is solved among the
    places its neighbours leave, all ranges of a level at once; levels are the
    logarithm of the longest run."""
    best = np.full(len(x), np.inf)
    a, b, lo, hi = start, end, start, end - 1
    while len(a):
        mid = (a + b) // 2
        n = hi - lo + 1
        head = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(head - lo, n)
        cost = g2[at] + (x[at] - np.repeat(x[mid], n)) ** 2
        best[mid] = np.minimum.reduceat(cost, head)
        where = np.minimum.reduceat(np.where(cost == np.repeat(best[mid], n), at, len(x)), head)
        left, right = mid > a, mid + 1 < b
        a, b, lo, hi = (np.concatenate([p[left], q[right]]) for p, q in ((a, mid + 1), (mid, b), (lo, where), (where, hi)))
    return best


def _run_distances(x: np.ndarray, width: np.ndarray, new: np.ndarray, g: np.ndarray, sx: float = 1.0) -> np.ndarray:
    """Distances along runs of rows, each begun by ``new``, whose columns found ``g``; inf if there is no background."""
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(x)][: len(start)]
    # a run with the pixels at its ends: background, unless they lie outside the image
    own = np.arange(len(x)) + 2 * np.repeat(np.arange(len(start)), end - start) + 1
    wide_x, wide_g = np.zeros(len(x) + 2 * len(start)), np.zeros(len(x) + 2 * len(start))
    wide_x[own], wide_g[own] = x, g
    a, b = own[start] - 1, own[end - 1] + 1
    wide_x[a], wide_x[b] = x[start] - 1, x[end - 1] + 1
    wide_g[a[x[start] == 0]] = np.inf
    wide_g[b[x[end - 1] == width[start] - 1]] = np.inf
    return np.sqrt(_row_minima(wide_x * sx, wide_g**2, a, b + 1)[own])


def _depths(p: Pixels) -> np.ndarray:
    """``distance_transform`` of whole parts in one task; inf if there is no background."""
    group = p.wide >> 41
    order = np.lexsort((p.y, p.x, group))
    y, x, g, height = p.y[order], p.x[order], group[order], p.height[order]
    start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1] + 1)][: len(p)])
    n = np.diff(np.r_[start, len(p)])
    first, last = np.repeat(y[start], n), np.repeat(y[start + n - 1], n)
    up, down = np.where(first > 0, y - first + 1.0, np.inf), np.where(last < height - 1, last - y + 1.0, np.inf)
    column = np.empty(len(p))
    column[order] = np.minimum(up, down)
    new = np.r_[True, (p.wide[1:] != p.wide[:-1] + 1) | (p.x[1:] == 0)][: len(p)]
    return _run_distances(p.x, p.width, new, column)


def distance_transform(mask: DataFrame, key: str, sy: float = 1.0, sx: float = 1.0) -> DataFrame:
    """(key, y, x, distance, height, width): Euclidean distance of every pixel of the mask
    to the nearest pixel of its image that the mask lacks; null if there is none.

    ``mask``: key, y, x, height, width; what lies outside the image is no background.
    Along each column a run of the mask knows its ends (windows); along each row the
    runs take the lower envelope of what their columns found. Nothing beyond the
    pixels at a run's ends can be nearer than they are, so a run of one row is the
    most that meets. Repeated pixels count once, rows with a null place not at all."""
    on_executors(mask.sparkSession)
    ensure_checkpoint_dir(mask.sparkSession)
    px = mask.where("y is not null and x is not null").groupBy(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("height").cast("int").alias("height"), F.max("width").cast("int").alias("width")).checkpoint()
    rows_in_all = px.count()
    px = spread(px, rows_in_all, key, "x").withColumn("_run", F.col("y") - F.row_number().over(Window.partitionBy(key, "x").orderBy("y")))
    run = Window.partitionBy(key, "x", "_run")
    first, last = F.min("y").over(run), F.max("y").over(run)
    up, down = F.when(first > 0, F.col("y") - first + 1), F.when(last < F.col("height") - 1, last - F.col("y") + 1)
    px = px.select(key, "y", "x", "height", "width", (F.least(up, down) * float(sy)).alias("_g"))
    px = spread(px, rows_in_all, key, "y")
    before = F.lag("x").over(Window.partitionBy(key, "y").orderBy("x"))
    px = px.withColumn("_new", before.isNull() | (before < F.col("x") - 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # begins with a run

        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            x, width, new = (t.column(c).to_numpy() for c in ("x", "width", "_new"))
            g = t.column("_g").fill_null(np.inf).to_numpy()
            found = _run_distances(x, width, new, g, sx)
            out = t.drop_columns(["_g", "_new"]).append_column("distance", pa.array(found, pa.float64(), mask=np.isinf(found)))
            yield from out.combine_chunks().to_batches()

        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            begins = np.flatnonzero(held.column("_new").to_numpy())
            if len(begins) and begins[-1] > 0:
                yield from solved(held.slice(0, begins[-1]))
                held = held.slice(begins[-1])
        if held is not None and held.num_rows:
            yield from solved(held)

    schema = StructType([*px.select(key, "y", "x", "height", "width").schema.fields, StructField("distance", DoubleType())])
    return px.mapInArrow(rows, schema).select(key, "y", "x", "distance", "height", "width")


# --- maxima ---


def window_maxima(surface: DataFrame, key: str, radius: int, least: float = 0.0, value: str = "value", size: int = B.SIZE) -> DataFrame:
    """(key, y, x, value): pixels above ``least`` that no pixel of the square of ``radius`` around them exceeds. ``surface`` has height and width."""

    def kernel(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        window = np.where(np.isnan(window), -np.inf, window)
        wide = window
        for axis in (0, 1):
            wide = np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis).max(-1)
        own = window[radius : radius + place.h, radius : radius + place.w]
        y, x = np.nonzero((own >= wide) & (own > least))
        return pd.DataFrame({"y": (y + place.y0).astype(np.int32), "x": (x + place.x0).astype(np.int32), "value": own[y, x]})

    blocks = B.to_blocks(surface, key, size, value, np.nan)
    return B.over_windows(blocks, key, radius, kernel, "y int, x int, value double", size, np.nan, False).select(key, "y", "x", "value")


def first_served(points: DataFrame, key: str, reach: int, before: Column, conflict: Column | None = None, max_rounds: int = 60) -> DataFrame:
    """Points (key, id, y, x, ...) that a pass in the order of ``before`` (a struct
    to be ascending, all different in a key) keeps, if a kept point drops all later
    ones in conflict: within ``reach`` along both axes and, if given, where
    ``conflict`` over the columns ``a`` and ``b`` (structs of both points) is true.

    The order of all points is not needed: in a round every point that is before all
    its undecided rivals is kept and theirs are dropped, as the sequential pass would
    do. Rivals are found in cells of the reach. Rounds are checkpointed; each decides
    at least the first point of every group of rivals."""
    ensure_checkpoint_dir(points.sparkSession)
    pts = points.withColumn("_order", before).checkpoint()
    row = F.struct(*(F.col(c) for c in pts.columns))
    side = reach + 1
    at = pts.select(F.col(key).alias("k"), F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x") / side).alias("cx"), row.alias("a"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    near = at.select("*", F.explode(steps).alias("s")).select("k", (F.col("cy") + F.col("s.dy")).alias("cy"), (F.col("cx") + F.col("s.dx")).alias("cx"), "a")
    rivals = near.join(at.withColumnRenamed("a", "b"), ["k", "cy", "cx"]).where("a._order < b._order").where((F.abs(F.col("a.y") - F.col("b.y")) <= reach) & (F.abs(F.col("a.x") - F.col("b.x")) <= reach))
    rivals = rivals if conflict is None else rivals.where(conflict)
    open_ = rivals.select("k", F.col("a.id").alias("first"), F.col("b.id").alias("second")).checkpoint()
    dropped = None
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        waits = open_.select("k", F.col("second").alias("first")).distinct()
        kept = open_.select("k", "first").distinct().join(waits, ["k", "first"], "left_anti")
        lost = open_.join(kept, ["k", "first"], "left_semi").select("k", F.col("second").alias("id")).distinct().checkpoint()
        dropped = lost if dropped is None else dropped.unionByName(lost)
        gone = lost.withColumnRenamed("id", "first")
        open_ = open_.join(gone, ["k", "first"], "left_anti").join(lost.withColumnRenamed("id", "second"), ["k", "second"], "left_anti").checkpoint()
    else:
        raise RuntimeError(f"points did not settle in {max_rounds} rounds")
    if dropped is None:
        return pts.drop("_order")
    return pts.join(dropped.withColumnRenamed("k", key), [key, "id"], "left_anti").drop("_order")


def spaced_peaks(surface: DataFrame, key: str, spacing: int = 1, least: float = 1.0, value: str = "value", size: int = B.SIZE) -> DataFrame:
    """(key, y, x, value): peaks above ``least``, highest first (ties: first pixel), none within ``spacing`` pixels along both axes of one kept before."""
    peaks = window_maxima(surface, key, spacing, least, value, size).withColumn("id", pixel_code())
    return first_served(peaks, key, spacing, F.struct((-F.col("value")).alias("v"), F.col("id"))).drop("id")


def pixel_code() -> Column:
    """y * 2**20 + x, one number for a place."""
    return F.col("y").cast("long") * (1 << 20) + F.col("x")


def _rebuilt(mark: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The largest array that is at most ``limit`` and reaches ``mark`` by steps to one of eight neighbours (NaN: no pixel)."""
    h, w = mark.shape
    now = np.pad(mark, 1, constant_values=-np.inf)
    limit = np.where(np.isnan(limit), -np.inf, limit)
    while True:
        last = now[1:-1, 1:-1].copy()
        wide = np.max([now[a : a + h, b : b + w] for a in range(3) for b in range(3)], axis=0)
        now[1:-1, 1:-1] = np.maximum(last, np.minimum(wide, limit))
        if (now[1:-1, 1:-1] == last).all():
            return last


def rebuilt(surface: DataFrame, key: str, h: float, value: str = "value", size: int = B.SIZE, max_rounds: int = 1_000) -> DataFrame:
    """Blocks (key, by, bx, height, width, data, rec) of the surface and of its grey
    reconstruction from the surface lowered by ``h``, 8-connected.

    A block is worked out until it stands still; then only the border pixels that
    rose go to its neighbours, and only blocks that got one are read into the next
    round and written again. Pixels outside the surface are NaN."""
    ensure_checkpoint_dir(surface.sparkSession)
    on_executors(surface.sparkSession)
    grid = [key, "by", "bx"]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        one = part[part["data"].notna()].iloc[:1]
        hh = min(size, int(one["height"].iloc[0]) - int(one["by"].iloc[0]) * size)
        limit = np.frombuffer(one["data"].iloc[0]).reshape(hh, -1)
        fresh = one["rec"].iloc[0] is None
        start = limit - h if fresh else np.frombuffer(one["rec"].iloc[0]).reshape(limit.shape)
        start = np.where(np.isnan(start), -np.inf, start)
        wide, outer = np.full((limit.shape[0] + 2, limit.shape[1] + 2), -np.inf), np.full((limit.shape[0] + 2, limit.shape[1] + 2), np.nan)
        wide[1:-1, 1:-1], outer[1:-1, 1:-1] = start, limit
        y0, x0 = int(one["by"].iloc[0]) * size - 1, int(one["bx"].iloc[0]) * size - 1
        for sent in part["strip"].dropna():
            rows = np.frombuffer(sent).reshape(-1, 3)
            at = rows[:, 0].astype(int) - y0, rows[:, 1].astype(int) - x0
            np.maximum.at(wide, at, rows[:, 2])
            outer[at] = wide[at]
        done = _rebuilt(wide, outer)[1:-1, 1:-1]
        rim = np.zeros(limit.shape, bool)
        rim[[0, -1]] = rim[:, [0, -1]] = True
        y, x = np.nonzero(rim & ~np.isnan(limit) & (fresh | (done > start)))
        rose = np.c_[y + y0 + 1, x + x0 + 1, done[y, x]].astype(float)
        return one[[*grid, "height", "width", "data"]].astype({"height": int, "width": int}).assign(rec=[np.where(np.isnan(limit), np.nan, done).tobytes()], rose=[rose.tobytes()])

    def send(parts):
        for part in parts:
            out = []
            for k, by, bx, rose in part.itertuples(index=False):
                rows = np.frombuffer(rose).reshape(-1, 3)
                y, x = rows[:, 0] - by * size, rows[:, 1] - bx * size
                for dy, dx in B._AROUND:
                    if dy or dx:
                        near = {-1: y == 0, 0: np.ones(len(y), bool), 1: y == size - 1}[dy] & {-1: x == 0, 0: np.ones(len(x), bool), 1: x == size - 1}[dx]
                        if near.any():
                            out.append((k, by + dy, bx + dx, rows[near].tobytes()))
                if len(out) >= 1_000:
                    yield pd.DataFrame(out, columns=[*grid, "strip"])
                    out = []
            yield pd.DataFrame(out, columns=[*grid, "strip"])

    blocks = B.to_blocks(surface, key, size, value, np.nan)
    none = F.lit(None).cast("binary")
    schema = B._fields(blocks, [*grid, "height", "width", "data"], "rec binary, rose binary")
    todo = blocks.select(*grid, "height", "width", "data", none.alias("rec"), none.alias("strip"))
    log, now = [], None
    for k in range(max_rounds):
        now = todo.groupBy(*grid).applyInPandas(work, schema).withColumn("round", F.lit(k)).checkpoint()
        log.append(now)
        strips = now.where(F.length("rose") > 0).select(*grid, "rose").mapInPandas(send, B._fields(now, grid, "strip binary"))
        hit = strips.select(*grid).distinct().checkpoint()
        if hit.isEmpty():
            break
        known = _latest(log, grid).join(hit, grid, "left_semi").select(*grid, "height", "width", "data", "rec", none.alias("strip"))
        sent = strips.join(known.select(*grid), grid, "left_semi")
        todo = known.unionByName(sent.select(*grid, *(F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("data", "binary"), ("rec", "binary"))), "strip"))
    else:
        raise RuntimeError(f"the reconstruction did not settle in {max_rounds} rounds")
    return _latest(log, grid).drop("rose", "round")


def _latest(log: list[DataFrame], grid: list[str]) -> DataFrame:
    every = log[0]
    for part in log[1:]:
        every = every.unionByName(part)
    if len(log) == 1:
        return every
    last = every.select(*grid, "round").groupBy(*grid).agg(F.max("round").alias("round"))
    return every.join(last, [*grid, "round"], "left_semi")


def _rising(p: Pixels, h: float) -> tuple[np.ndarray, np.ndarray]:
    """``h_maxima`` of whole parts in one task: places of their pixels, and for each the place of its maximum's first.

    The reconstruction goes on only from the pixels that rose."""
    n = len(p)
    near = p.around()
    now, limit = np.r_[p.value - h, -np.inf], p.value
    todo = np.arange(n)
    while len(todo):
        wide = np.max([now[to[todo]] for to in near], axis=0)
        to = np.maximum(now[todo], np.minimum(wide, limit[todo]))
        rose = to > now[todo]
        todo = todo[rose]
        now[todo] = to[rose]
        hit = np.zeros(n + 1, bool)
        for to in near:
            hit[to[todo]] = True
        todo = np.flatnonzero(hit[:n])
    top = np.r_[now[:n] >= np.max([now[to] for to in near], axis=0), False]
    slope = top[:n] & np.any([(now[to] == now[:n]) & ~top[to] for to in near], axis=0)
    a, b = np.tile(np.arange(n), len(near)), np.concatenate(near)
    tied = top[a] & top[b]
    root = local_components(n, a[tied], b[tied])
    # a part of a plateau that goes on to a pixel with a higher neighbour is no maximum
    bad = np.zeros(n, bool)
    bad[root[slope]] = True
    at = np.flatnonzero(top[:n] & ~bad[root])
    return at, root[at]


def h_maxima(surface: DataFrame, key: str, h: float, value: str = "value", size: int = B.SIZE, rows: int | None = None, square: int = 512, most: int = 250_000) -> DataFrame:
    """(key, y, x, root): the pixels, and by ``root`` the parts, in which maxima end that
    rise by ``h`` or more above the highest way to a higher pixel: the regional maxima of
    the surface rebuilt from itself lowered by ``h``. ``surface`` has height and width;
    pixels that it lacks are in no way, so parts are worked on by themselves (``by_parts``)."""
    if h <= 0:
        raise ValueError("h must be positive")

    def work(p: Pixels) -> tuple[np.ndarray, np.ndarray]:
        at, root = _rising(p, h)
        return at, p.code[root]

    found, large = by_parts(surface, key, 1, work, "root", value, rows, square, most)
    return found if large is None else found.unionByName(_h_maxima_by_blocks(large.withColumnRenamed("_value", value), key, h, value, size))


def depth_maxima(mask: DataFrame, key: str, h: float, size: int = B.SIZE, rows: int | None = None, square: int = 512, most: int = 250_000) -> DataFrame:
    """``h_maxima`` of the distances of a mask to the background, both from one exchange."""
    if h <= 0:
        raise ValueError("h must be positive")

    def work(p: Pixels) -> tuple[np.ndarray, np.ndarray]:
        p = replace(p, value=_depths(p))
        inside = np.flatnonzero(np.isfinite(p.value))
        q = p.only(inside)
        at, root = _rising(q, h)
        return inside[at], q.code[root]

    found, large = by_parts(mask, key, 1, work, "root", None, rows, square, most)
    if large is None:
        return found
    depth = distance_transform(large, key).withColumnRenamed("distance", "value").where("value is not null")
    return found.unionByName(_h_maxima_by_blocks(depth, key, h, "value", size))


def _h_maxima_by_blocks(surface: DataFrame, key: str, h: float, value: str, size: int) -> DataFrame:
    """``h_maxima`` of parts of any size: the surface is rebuilt block by block."""

    def kernel(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        value = np.where(np.isnan(window), -np.inf, window)
        around = lambda a: np.stack([a[1 + p : a.shape[0] - 1 + p, 1 + q : a.shape[1] - 1 + q] for p, q in B._AROUND if p or q])
        top = (value[1:-1, 1:-1] >= around(value).max(0)) & (value[1:-1, 1:-1] > -np.inf)
        own = value[2:-2, 2:-2]
        slope = ((around(value[1:-1, 1:-1]) == own) & ~around(top)).any(0)
        y, x = np.nonzero(top[1:-1, 1:-1])
        return pd.DataFrame({"y": (y + place.y0).astype(np.int32), "x": (x + place.x0).astype(np.int32), "slope": slope[y, x]})

    blocks = rebuilt(surface, key, h, value, size).drop("data").withColumnRenamed("rec", "data")
    top = B.over_windows(blocks, key, 2, kernel, "y int, x int, slope boolean", size, np.nan, False).select(key, "y", "x", "slope").checkpoint()
    # a part of a plateau that goes on to a pixel with a higher neighbour is no maximum
    parts = label_pixels(top, key, eight=True)
    bad = parts.join(top.where("slope"), [key, "y", "x"]).select(key, "root").distinct()
    return parts.join(bad, [key, "root"], "left_anti").select(key, "y", "x", "root")


# --- floods ---


def _order(w, lo, hi):
    return F.struct(w.alias("w"), lo.alias("lo"), hi.alias("hi"))


def _grown(n: int, level: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray, v: np.ndarray, marker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n pixels with edges (u, v; -1: elsewhere), each a part's number and that part's marker (0: none):
    parts without a marker join along their lowest edge, as long as both ends are here."""
    rank = np.empty(len(level), np.int64)
    rank[np.lexsort((hi, lo, level))] = np.arange(len(level))
    by_rank = np.argsort(rank)
    comp, known = np.arange(n), marker.copy()
    while True:
        # the lowest edge that leaves each part
        cu, cv = np.where(u >= 0, comp[u], -1), np.where(v >= 0, comp[v], -1)
        leaves = cu != cv
        least = np.full(n, len(level))
        for c in (cu, cv):
            at = leaves & (c >= 0)
            np.minimum.at(least, c[at], rank[at])
        hook = np.flatnonzero((least < len(level)) & (known == 0) & (comp == np.arange(n)))
        edge = by_rank[least[hook]]
        fine = (u[edge] >= 0) & (v[edge] >= 0)
        hook, edge = hook[fine], edge[fine]
        if not len(hook):
            return comp, known
        comp = local_components(n, np.r_[comp[u[edge]], np.arange(n)], np.r_[comp[v[edge]], comp])
        known = np.zeros(n)
        np.maximum.at(known, comp, marker)


def _contracted(surface: DataFrame, markers: DataFrame, key: str, size: int) -> DataFrame:
    """(key, y, x, value, comp, marker, open): each block joined as far as its own edges allow."""

    def kernel(window: np.ndarray, place: B.Place) -> pd.DataFrame:
        h, w = place.h, place.w
        number = np.full((h + 2, w + 2), -1)
        inside = ~np.isnan(window)
        own = np.zeros(inside.shape, bool)
        own[1:-1, 1:-1] = inside[1:-1, 1:-1]
        yy, xx = np.nonzero(own)
        if not len(yy):
            return None
        number[yy, xx] = np.arange(len(yy))
        code = (np.arange(h + 2)[:, None] + place.y0 - 1).astype(np.int64) * (1 << 20) + np.arange(w + 2) + place.x0 - 1
        ends = []
        for a, b in ((np.s_[:, :-1], np.s_[:, 1:]), (np.s_[:-1], np.s_[1:])):
            both = inside[a] & inside[b] & (own[a] | own[b])
            ends.append([np.maximum(window[a], window[b])[both], code[a][both], code[b][both], number[a][both], number[b][both]])
        level, lo, hi, u, v = (np.concatenate(z) for z in zip(*ends, strict=True))
        marker = np.zeros(len(yy))
        if place.carried["marks"] is not None:
            marks = np.frombuffer(place.carried["marks"]).reshape(h, w)
            marker = marks[yy - 1, xx - 1]
        comp, known = _grown(len(yy), level, lo, hi, u, v, marker)
        cu, cv = np.where(u >= 0, comp[u], -1), np.where(v >= 0, comp[v], -1)
        ku, kv = np.where(u >= 0, known[cu], 0), np.where(v >= 0, known[cv], 0)
        free = (cu != cv) & ~((ku > 0) & (kv > 0))
        open_ = np.zeros(len(yy), bool)
        for c in (u, v):
            open_[c[free & (c >= 0)]] = True
        codes = code[yy, xx]
        return pd.DataFrame({"y": (yy - 1 + place.y0).astype(np.int32), "x": (xx - 1 + place.x0).astype(np.int32), "value": window[yy, xx], "comp": codes[comp], "marker": known[comp].astype(np.int64), "open": open_})

    blocks = B.to_blocks(surface, key, size, "value", np.nan)
    extent = surface.groupBy(key).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    marks = B.to_blocks(markers.select(key, "y", "x", F.col("marker").cast("double").alias("value")).join(extent, key), key, size, "value", 0.0).select(key, "by", "bx", F.col("data").alias("marks"))
    both = blocks.join(marks, [key, "by", "bx"], "left")
    return B.over_windows(both, key, 1, kernel, "y int, x int, value double, comp long, marker long, open boolean", size, np.nan, False, ("marks",)).select(key, "y", "x", "value", "comp", "marker", "open")


def watershed(surface: DataFrame, markers: DataFrame, key: str, size: int = B.SIZE, max_rounds: int = 60) -> DataFrame:
    """(key, y, x, marker): floods from the markers over the pixels of ``surface``,
    lowest first: each pixel goes to the marker to which its way in the minimum
    spanning forest of the 4-connected pixels leads, an edge being as high as its
    higher pixel (ties: smaller codes of its pixels). Pixels no marker reaches have no row.

    ``surface``: key, y, x, value, height, width; ``markers``: key, y, x, marker (from 1
    to 2**53; several pixels may share one; of two on one pixel the larger counts).
    The forest grows by Boruvka's rounds: a part without a marker joins along its
    lowest edge. Blocks do this alone as long as that edge is their own, then only
    parts still open at a border go through joins; their number falls by half or more a round."""
    ensure_checkpoint_dir(surface.sparkSession)
    local = _contracted(surface, markers, key, size).checkpoint()
    node = F.struct(F.col(key).alias("k"), F.col("comp").alias("c"))
    rim = local.where("open").select(key, "y", "x", "value", node.alias("node"), "marker")
    step = F.explode(F.array(F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x"))))
    # an open pixel's partner may itself be closed to all its others, so partners come from all border pixels
    sent = rim.select(key, pixel_code().alias("_lo"), F.col("value").alias("_value"), F.col("node").alias("a"), F.col("marker").alias("ma"), step.alias("_to"))
    sent = sent.select(key, F.col("_to.y").alias("y"), F.col("_to.x").alias("x"), "_lo", "_value", "a", "ma")
    edges = sent.join(rim.withColumnRenamed("node", "b"), [key, "y", "x"]).where("a <> b and not (ma > 0 and marker > 0)")
    edges = edges.select("a", "b", _order(F.greatest("_value", "value"), F.col("_lo"), pixel_code()).alias("o"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "o"))
    open_ = both.groupBy("a", "b").agg(F.min("o").alias("o")).checkpoint()
    marked = rim.where("marker > 0").select(F.col("node").alias("n"), "marker").distinct().checkpoint()
    home = None  # part -> the part it has joined
    for _ in range(max_rounds):
        lowest = open_.join(marked.select(F.col("n").alias("a")), "a", "left_anti").groupBy("a").agg(F.min_by("b", "o").alias("b"))
        lowest = lowest.checkpoint()
        if lowest.isEmpty():
            break
        # a chain of lowest edges ends at a marked part or at two parts that chose each other
        back = lowest.select(F.col("a").alias("b"), F.col("b").alias("_back"))
        up = lowest.join(back, "b", "left").select("a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("b")).checkpoint()
        while True:
            further = up.select(F.col("a").alias("b"), F.col("b").alias("_next"))
            up = up.join(further, "b", "left").select("a", F.coalesce("_next", "b").alias("b"), (F.col("_next") != F.col("b")).alias("_moved")).checkpoint()
            if up.where("_moved").isEmpty():
                up = up.drop("_moved")
                break
            up = up.drop("_moved")
        moved = up.where("a <> b")
        to = lambda df, c: df.join(moved.select(F.col("a").alias(c), F.col("b").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        own = up.select(F.col("a").alias("n"), F.col("b").alias("root"))
        home = own if home is None else to(home, "root").unionByName(own.join(home.select("n"), "n", "left_anti"))
        home = home.checkpoint()
        open_ = to(to(open_, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.min("o").alias("o"))
        seen = marked.select(F.col("n").alias("a")).withColumn("_m", F.lit(1))
        open_ = open_.join(seen, "a", "left").join(seen.select(F.col("a").alias("b"), F.col("_m").alias("_n")), "b", "left").where("_m is null or _n is null").select("a", "b", "o").checkpoint()
    else:
        raise RuntimeError(f"the flood did not settle in {max_rounds} rounds")
    if home is None:
        return local.where("marker > 0").select(key, "y", "x", "marker")
    found = home.join(marked.withColumnRenamed("n", "root"), "root").select("n", F.col("marker").alias("_found"))
    flooded = local.withColumn("n", node).join(found, "n", "left")
    return flooded.withColumn("marker", F.when(F.col("marker") > 0, F.col("marker")).otherwise(F.col("_found"))).where("marker is not null").select(key, "y", "x", "marker")


def _served(p: Pixels, reach: int) -> np.ndarray:
    """``first_served`` of points of whole parts in one task, highest first: which of them are kept."""
    a, b = [], []
    for dy in range(reach + 1):
        for dx in range(-reach if dy else 1, reach + 1):
            to = p.near(dy, dx)
            hit = np.flatnonzero(to < len(p))
            a.append(hit)
            b.append(to[hit])
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    ahead = p.value[a] >= p.value[b]
    first, second = np.where(ahead, a, b), np.where(ahead, b, a)
    kept = np.ones(len(p), bool)
    while len(first):
        waits = np.zeros(len(p), bool)
        waits[second] = True
        kept[second[~waits[first]]] = False
        open_ = kept[first] & kept[second] & waits[first]
        first, second = first[open_], second[open_]
    return kept


def _peaks(p: Pixels, spacing: int, least: float, h: float) -> np.ndarray:
    """Places of the peaks from which ``split_objects`` floods, in whole parts with their depths."""
    if h > 0:
        at = np.unique(_rising(p, h)[1])
        at = at[p.value[at] > least]
    else:
        at, value = np.flatnonzero(p.value > least), np.r_[p.value, -np.inf]
        for dy in range(-spacing, spacing + 1):
            for dx in range(-spacing, spacing + 1):
                at = at[value[at] >= value[p.near(dy, dx, at)]]
    return at[_served(p.only(at), spacing)]


def _split(p: Pixels, spacing: int, least: float, h: float, erosion: int, smallest: int) -> tuple[np.ndarray, np.ndarray]:
    """``split_objects`` of whole parts in one task: places of the pixels, and for each the place of its object's first or peak."""
    n = len(p)
    p = replace(p, value=_depths(p))
    left, up = p.near(0, 1), p.near(1, 0)
    core, inner = np.arange(n), p
    if erosion:
        inside = np.r_[np.ones(n, bool), False]
        four = [left, up, p.near(0, -1), p.near(-1, 0)]
        for _ in range(erosion):
            inside[:n] &= np.all([inside[to] for to in four], axis=0)
        core = np.flatnonzero(inside[:n])
        inner = replace(p.only(core), value=None)
        inner = replace(inner, value=_depths(inner))
    finite = np.isfinite(inner.value)
    core = core[finite]
    peaks = core[_peaks(inner.only(finite), spacing, least, h)]
    # where there is no background there is no flood
    peaks = peaks[np.isfinite(p.value[peaks])]
    marker = np.zeros(n)
    marker[peaks] = peaks + 1
    u, v = np.tile(np.arange(n), 2), np.r_[left, up]
    u, v = u[v < n], v[v < n]
    comp, known = _grown(n, np.maximum(-p.value[u], -p.value[v]), p.code[u], p.code[v], u, v, marker)
    known = known[comp].astype(np.int64)
    mark = np.where(known > 0, known - 1, comp)
    at = np.arange(n)
    if smallest:
        at = at[np.bincount(mark, minlength=n)[mark] >= smallest]
    return at, mark[at]


def split_objects(mask: DataFrame, key: str, spacing: int = 1, least: float = 1.0, h: float = 0.0, erosion: int = 0, smallest: int = 0, size: int = B.SIZE, rows: int | None = None, square: int = 512, most: int = 250_000) -> DataFrame:
    """(key, y, x, marker): touching objects of a mask apart, flooded from the peaks of
    the distance to the background; ``marker`` is the pixel code of its peak.

    Peaks are above ``least`` and ``spacing`` apart; with ``h`` the first pixel of every
    maximum that stands out by ``h`` is taken before. With ``erosion`` the peaks are those of the mask eroded
    that often, the flood that of the whole mask. Connected parts without a peak are
    objects of their own, marked by their first pixel. Objects below ``smallest``
    pixels are dropped; those that remain keep their marks. ``mask`` has height and width.

    Distances, maxima and floods end where the mask does and peaks meet within ``spacing``, so what lies
    within it is solved together (``by_parts``), and only what one task should not hold goes by blocks."""

    def work(p: Pixels) -> tuple[np.ndarray, np.ndarray]:
        at, mark = _split(p, spacing, least, h, erosion, smallest)
        return at, p.code[mark]

    found, large = by_parts(mask, key, spacing, work, "marker", None, rows, square, most)
    return found if large is None else found.unionByName(_split_by_blocks(large, key, spacing, least, h, erosion, smallest, size))


def _split_by_blocks(mask: DataFrame, key: str, spacing: int, least: float, h: float, erosion: int, smallest: int, size: int) -> DataFrame:
    """``split_objects`` of parts of any size: every step is done for all of them, by runs, blocks and joins."""
    ensure_checkpoint_dir(mask.sparkSession)
    depth = distance_transform(mask, key).withColumnRenamed("distance", "value").where("value is not null").checkpoint()
    inner = depth
    if erosion:
        core = mask.select(key, "y", "x", "height", "width").distinct()
        for _ in range(erosion):
            cross = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
            core = moved(core, key, cross, 5).join(core, [key, "y", "x"])
        inner = distance_transform(core, key).withColumnRenamed("distance", "value").where("value is not null").checkpoint()
    if h > 0:
        firsts = _h_maxima_by_blocks(inner, key, h, "value", size).groupBy(key, "root").agg(F.min(pixel_code()).alias("marker"))
        peaks = inner.withColumn("marker", pixel_code()).join(firsts.select(key, "marker"), [key, "marker"], "left_semi").where(F.col("value") > least)
        peaks = first_served(peaks.select(key, "y", "x", "value", F.col("marker").alias("id")), key, spacing, F.struct((-F.col("value")).alias("v"), F.col("id"))).drop("id")
    else:
        peaks = spaced_peaks(inner, key, spacing, least, size=size)
    # markers begin at 1, codes at 0
    peaks = peaks.select(key, "y", "x", (pixel_code() + 1).alias("marker")).checkpoint()
    flooded = watershed(depth.withColumn("value", -F.col("value")), peaks, key, size).withColumn("marker", F.col("marker") - 1).checkpoint()
    rest = label_pixels(mask.join(flooded, [key, "y", "x"], "left_anti"), key).select(key, "y", "x", F.col("root").alias("marker"))
    every = flooded.unionByName(rest)
    if smallest:
        enough = every.groupBy(key, "marker").agg(F.count("*").alias("_n")).where(F.col("_n") >= smallest)
        every = every.join(enough.select(key, "marker"), [key, "marker"], "left_semi").select(key, "y", "x", "marker")
    return every
