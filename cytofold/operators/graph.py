"""Connected components of an edge table, as rounds of DataFrame joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.shipping import on_executors


def ensure_checkpoint_dir(spark) -> None:
    """Keep the folder the cluster names in ``spark.checkpoint.dir``; set a local
    one only where none is named and all work is on one machine, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(named)


def spread(df: DataFrame, rows: int, *keys: str, per_task: int = 250_000) -> DataFrame:
    """``df`` dealt by ``keys`` so that a task gets about ``per_task`` of ``rows`` rows, however many
    there are. ``rows`` is the number that the step after makes, and may be rough: a small file is
    read by one task, and few tasks hold all the rows that small ones make, so their memory would grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)), *keys)


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with links (a, b), all in one task: the smallest node that each one reaches."""
    parent = np.arange(n)

    def root(x: np.ndarray) -> np.ndarray:
        x = parent[x]
        while ((up := parent[x]) != x).any():
            x = up
        return x

    while len(a):
        left, right = root(a), root(b)
        open_ = left != right
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(parent, np.maximum(left, right), np.minimum(left, right))
    return root(np.arange(n))


#: Edges from which hubs are joined apart.
HUBS_FROM = 5_000


def join_one_row(rows: DataFrame, one: DataFrame, key: str, count: str, total: int | None = None, how: str = "left", share: int = 1_000) -> DataFrame:
    """``rows`` joined with ``one``, which has one row for a value of ``key`` and in
    ``count`` how many of ``rows`` have it. Values that more than 1 in ``share`` rows
    have, fewer than ``share`` of them at any size, meet their row by broadcast, so
    that no task gets all rows of such a value; the others by an ordinary join.
    ``rows`` is read more than once and should be a table or checkpoint."""
    total = rows.count() if total is None else total
    often = F.col(count) * share > total
    hot = one.where(often)
    warm = rows.join(F.broadcast(hot), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(~often), key, how)
    return warm.unionByName(cold)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Alternating large-star and small-star rounds; each round shrinks paths, so
    their number grows with the logarithm of the longest one. The minimum of a
    node's neighbours is a grouped aggregate with map-side combine, and both joins
    back to the edges are split where a hub has very many of them. Rows with
    a null end are left out; a self-loop yields its node; an empty table yields
    an empty one. Each round is checkpointed, so lost executors repeat little.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    start = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = start.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = _signature(now)
    for _ in range(max_rounds if seen[0] else 0):
        # large star: every larger neighbour of u is tied to the smallest node around u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        tied = both.join(low, "u") if seen[0] < HUBS_FROM else join_one_row(both, low, "u", "n", 2 * seen[0], "inner")
        large = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them; a hub may now be the larger end
        large = large if seen[0] < HUBS_FROM else large.checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        tied = large.join(low, "u") if seen[0] < HUBS_FROM else join_one_row(large, low, "u", "n", how="inner")
        tied = tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        now = tied.where("u <> v").distinct().checkpoint()
        last, seen = seen, _signature(now)
        if seen == last:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("root", "node").alias("component"))


def connected_components_in_ranges(edges: DataFrame, src: str = "src", dst: str = "dst", per_task: int = 250_000) -> DataFrame:
    """``connected_components`` of whole numbers of which most edges tie near ones, as labels of tiles in order.

    Edges are dealt by ranges of ``src``; a task solves its range, and only what it ties to
    nodes outside of the range goes through rounds of joins: one link for each such node and part.
    Rows with a null end are left out."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    on_executors(spark)
    known = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null").checkpoint()
    n = max(spark.sparkContext.defaultParallelism, -(-known.count() // per_task))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        u, v = (np.concatenate(c) for c in zip(*held, strict=True))
        node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        # nodes are in order, so the smallest place of a part is its smallest node
        part = node[local_components(len(node), at[: len(u)], at[len(u) :])]
        foreign = (node < u.min()) | (node > u.max())
        table = pa.table({"node": node, "part": part, "foreign": foreign})
        yield from table.to_batches(max_chunksize=50_000)

    # a node is in the range of one task at most
    found = known.repartitionByRange(n, "u").mapInArrow(solve, "node long, part long, foreign boolean").checkpoint()
    own, foreign = found.where("not foreign"), found.where("foreign")
    ties = foreign.select("node", F.col("part").alias("_p")).distinct()
    # a foreign node ties the parts that hold it: its own range's and all that name it
    met = ties.join(own.select("node", "part"), "node", "left")
    links = met.select(F.col("_p").alias("src"), F.coalesce("part", "node").alias("dst"))
    rest = connected_components(links.distinct()).select(F.col("node").alias("part"), F.col("component").alias("_c")).checkpoint()
    nodes = own.select("node", "part").unionByName(foreign.select("node").distinct().join(own.select("node"), "node", "left_anti").select("node", F.col("node").alias("part")))
    return nodes.join(rest, "part", "left").select("node", F.coalesce("_c", "part").alias("component"))


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
