"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks. A task receives a block, sorts its rows along
every dimension once, and then serves the queries that follow it. A query walks
each list from the end that the sign of its own component favours; the lists
that hold up its bound most are walked first. Rows met for the first time are
scored in full. The bound is the best score that a row not yet met could have
where the lists stand; the query stops when it cannot beat the k-th score.

A query that has met a large part of the block without stopping scores the rest
at once, together with the others like it, in one matrix product: walking on
would meet the same rows one by one. Blocks' results, k rows a query and block,
are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytofold.llm.text import in_arrow

EXACT = float(1 << 53)
NONE = np.iinfo(np.int64).min + 1  # its negative is a long too


class Block:
    """Rows (integers) with their ids, and the order of the rows along every dimension."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))  # one list a dimension
        self.high = float(np.abs(rows).max(initial=0))
        self.floats = rows.astype(np.float64)
        self.norm = math.sqrt(np.square(self.floats).sum(axis=1).max(initial=0))

    def numbers(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows) in floats, which are exact while scores are small, or else in Python's integers."""
        if float(np.abs(query).max(initial=0)) * self.high * self.rows.shape[1] < EXACT:
            return query.astype(np.float64), self.floats
        return query.astype(object), self.rows.astype(object)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    sort = np.lexsort((ids, -score))[:k]
    return score[sort], ids[sort]


def walk(q: np.ndarray, own: int, block: Block, x: np.ndarray, k: int, first: int, part: float) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(scores, ids, rows scored, stopped?) of the k best rows met by one query
    when its bound stops it, all lists end, or more rows are met than ``part`` of
    them times the square of the k-th score over the bound."""
    n = len(x)
    used = np.flatnonzero(q != 0)
    weight, up = q[used], q[used] > 0
    depth, step = np.zeros(len(used), np.int64), first
    seen, met = np.zeros(n, bool), 0
    score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = math.sqrt(float((weight * weight).sum()))
    while len(used) and n:
        heads = block.order[used, np.where(up, n - 1 - depth, depth)]
        share = weight * x[heads, used]  # what each list can still give
        bound = min(share.sum(), length * block.norm * (1 + 1e-9) + 1)
        if len(score) == k and score[-1] > bound:
            return score, ids, met, True
        # the farther the bound is from stopping, the sooner walking on is not worth it
        near = max(0.0, score[-1] / bound) if len(score) == k and bound > 0 else 1.0
        if met > part * near * near * n:
            break
        pick = np.argsort(-share)[: max(1, len(used) // 4)]
        place = np.minimum(depth[pick][:, None] + np.arange(step), n - 1)
        rows = block.order[used[pick][:, None], np.where(up[pick][:, None], n - 1 - place, place)].ravel()
        rows = np.unique(rows[~seen[rows]])
        seen[rows] = True
        met += len(rows)
        rows = rows[block.ids[rows] != own]
        score, ids = _best(np.r_[score, (x[rows] @ q).astype(np.int64)], np.r_[ids, block.ids[rows]], k)
        depth[pick] += step
        if (depth >= n).any():
            return score, ids, met, True  # a list has ended: every row was met
        step *= 2
    return score, ids, met, False


def score_all(q: np.ndarray, own: np.ndarray, block: Block, x: np.ndarray, k: int, cells: int = 1 << 23):
    """(position in q, score, id) of the k best rows of each query, by products of bounded size."""
    at, scores, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, cells // max(1, len(x)))
    for begin in range(0, len(q), step):
        score = (q[begin : begin + step] @ x.T).astype(np.int64)
        score[own[begin : begin + step, None] == block.ids[None, :]] = NONE
        cut = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(score), NONE)
        r, c = np.nonzero((score >= cut[:, None]) & (score != NONE))  # ties of the k-th too
        sort = np.lexsort((block.ids[c], -score[r, c], r))
        r, c = r[sort], c[sort]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, c = r[rank < k], c[rank < k]
        at.append(r + begin)
        scores.append(score[r, c])
        ids.append(block.ids[c])
    return np.concatenate(at), np.concatenate(scores), np.concatenate(ids)


def threshold_topk(query: np.ndarray, rows: np.ndarray | Block, query_ids: np.ndarray, row_ids: np.ndarray | None, k: int, first: int = 32, part: float = 0.5, count: list | None = None):
    """(query position, row id, score) of the k best rows of each query, ties to
    the smaller id, rows of the query's own id left out. Integer matrices. Rows
    met and whether the bound stopped the walk are added to ``count``."""
    block = rows if isinstance(rows, Block) else Block(rows, row_ids)
    q, x = block.numbers(query)
    at, scores, ids, rest = [], [], [], []
    for j in range(len(q)):
        score, found, met, stopped = walk(q[j], query_ids[j], block, x, k, first, part)
        if count is not None:
            count.append((met, stopped))
        if stopped:
            at.append(np.full(len(score), j))
            scores.append(score)
            ids.append(found)
        else:
            rest.append(j)
    if rest:
        where, score, found = score_all(q[rest], query_ids[rest], block, x, k)
        at.append(np.array(rest)[where])
        scores.append(score)
        ids.append(found)
    at, scores, ids = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (at, scores, ids))
    sort = np.lexsort((ids, -scores, at))
    return at[sort], ids[sort], scores[sort]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """id, v (floor of scale times each component, as double, in long). Rows with
    a null id, a null vector, or a null or non-finite component take no part."""
    x = F.col(vec_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ok = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite)
    return ok.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def exact_topk(vectors: DataFrame, k: int = 20, every: int = 20, block_rows: int = 16_384, query_rows: int = 4_096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is
    divisible by ``every``, the k best of all other rows by integer inner product
    (all, if fewer), ties to the smaller vec_id.

    Each row is sent once, to its block of ``block_rows`` on average; each query
    once to every block, where ``query_rows`` are served at a time. Vectors of
    different lengths have no inner product and do not meet. Rows that repeat a
    query with equal vector count as one query; rows under the query's own id are
    its own and no candidates; other repeated rows are each a candidate. Empty
    tables give an empty result. Scores must fit in a long.
    """
    from cytofold.operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(vectors.sparkSession)
    rows = integer_vectors(vectors).withColumn("dims", F.size("v")).where("dims > 0").checkpoint()
    blocks = max(1, math.ceil(rows.count() / block_rows))
    own = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(blocks)).cast("int")
    others = rows.select("dims", own.alias("block"), F.lit(0).alias("kind"), "id", "v")
    queries = rows.where(F.col("id") % every == 0).distinct()
    queries = queries.select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def serve(batches):
        key, held, block = None, [], None
        for batch in batches:
            keys = np.c_[tuple(batch.column(c).to_numpy() for c in ("dims", "block", "kind"))]
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                dims, number, kind = keys[begin].tolist()
                if key != (dims, number):
                    key, held, block = (dims, number), [], None
                run = batch.slice(begin, end - begin)
                ids, v = run.column("id").to_numpy(), run.column("v").flatten().to_numpy().reshape(-1, dims)
                if kind == 0:
                    held.append((ids, v))
                    continue
                if block is None and held:  # all rows of the block have come: sort them, once
                    block, held = Block(np.concatenate([x[1] for x in held]), np.concatenate([x[0] for x in held])), []
                for at in range(0, len(ids) if block else 0, query_rows):
                    mine = ids[at : at + query_rows]
                    where, found, score = threshold_topk(v[at : at + query_rows], block, mine, None, k)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[where]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    dealt = others.unionByName(queries).repartition("dims", "block").sortWithinPartitions("dims", "block", "kind")
    part = in_arrow(dealt, serve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
