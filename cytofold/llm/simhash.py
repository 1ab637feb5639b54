"""SimHash fingerprints and their exact near-duplicate groups.

Fingerprints are taken per document in Arrow batches. Distinct fingerprints are
dealt into groups; every pair of groups is one task, which cuts both sides into
tiles of equal population counts and compares tiles by exclusive-or and bit
counts. A pair of tiles is skipped if its population counts differ beyond the
radius: counts of the four 16-bit lanes are used, since the sum of their
differences is a lower bound of the differing bits as the total count is, only
closer. A task returns a spanning forest of the links it finds, never all
pairs, so large groups of near copies stay linear.

``similar_documents`` does the same with fingerprints of 128 bits, whose distance
tells a similarity of 0.8 from chance. At that radius population counts exclude
hardly anything; tiles are of equal numbers of shingles instead, since sets of
similarity s differ in size by a factor of s at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import map_batches
from cytofold.operators.graph import connected_components, ensure_checkpoint_dir, join_one_row
from cytofold.shipping import on_executors

SEED = 42
BLOCK = 1 << 20  # pairs compared at once
ROWS = 1024  # texts of a batch that are worked on at once


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits: bit b is set if it is set in over half the hashes of the text's shingles."""
    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.r_[0, ends[:-words]].tolist()
    view = memoryview(joined)
    hashes = [xxhash.xxh64_intdigest(view[s:e], SEED) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as signed long) of every row; null text counts as empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t or "", words) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), lambda: each, "doc_id long, fp long", ROWS)


class _Tiles:
    """Fingerprints in tiles of equal population counts of their four 16-bit lanes."""

    def __init__(self, fp: np.ndarray) -> None:
        lanes = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)
        code = lanes @ np.array([32**3, 32**2, 32, 1])
        order = np.argsort(code, kind="stable")
        self.fp = fp[order]
        _, self.start, self.size = np.unique(code[order], return_index=True, return_counts=True)
        self.counts = lanes[order][self.start].astype(np.int16)

    def rows(self, tiles: np.ndarray) -> np.ndarray:
        """Positions of all fingerprints of some tiles."""
        size = self.size[tiles]
        ends = np.cumsum(size)
        return np.arange(ends[-1]) + np.repeat(self.start[tiles] - ends + size, size)


class _Forest:
    """Spanning forest of links that arrive in blocks: each link kept joins two components."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def _root(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while ((up := self.parent[root]) != root).any():
            root = up
        self.parent[x] = root
        return root

    def add(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the links (p, q) those that are kept."""
        kept = [(p[:0], q[:0])]
        while len(p):
            left, right = self._root(p), self._root(q)
            open_ = left != right
            p, q, left, right = p[open_], q[open_], left[open_], right[open_]
            # every root takes one link to a smaller one at most: no cycles
            big, first = np.unique(np.maximum(left, right), return_index=True)
            self.parent[big] = np.minimum(left, right)[first]
            kept.append((p[first], q[first]))
        return np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept])


def links_between(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` between a and b (within
    a, if b is None): two arrays of fingerprints."""
    none = np.zeros(0, np.uint64)
    if not len(a) or b is not None and not len(b):
        return none, none
    x = _Tiles(a)
    y = x if b is None else _Tiles(b)
    offset = 0 if b is None else len(a)
    forest = _Forest(len(a) + (0 if b is None else len(b)))
    src, dst = [], []
    for i in range(len(x.start)):
        near = np.flatnonzero(np.abs(y.counts - x.counts[i]).sum(axis=1) <= radius)
        near = near[near >= i] if b is None else near
        if not len(near):
            continue
        others = y.rows(near)
        step = max(1, BLOCK // len(others))
        for begin in range(x.start[i], x.start[i] + x.size[i], step):
            own = np.arange(begin, min(begin + step, x.start[i] + x.size[i]))
            p, q = np.nonzero(np.bitwise_count(x.fp[own][:, None] ^ y.fp[others][None, :]) <= radius)
            p, q = own[p], others[q]
            if b is None:
                p, q = p[p < q], q[p < q]
            p, q = forest.add(p, q + offset)
            src.append(x.fp[p])
            dst.append(y.fp[q - offset])
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def near_links(fps: DataFrame, radius: int = 4, group_rows: int = 1 << 19, min_groups: int = 5) -> DataFrame:
    """(src, dst): links that connect all distinct ``fp`` within ``radius`` bits.

    Fingerprints are dealt by hash into G groups of ``group_rows`` at most on
    average; each of the G(G+1)/2 pairs of groups is one task and holds two
    groups. Each fingerprint is sent G times, so G stays at ``min_groups``
    until memory, not data, asks for more.
    """
    on_executors(fps.sparkSession)
    n = fps.count()
    groups = max(min_groups, math.ceil(n / group_rows))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(groups)).cast("int")
    others = F.sequence(F.lit(0), F.lit(groups - 1))
    sent = fps.select("fp", own.alias("g")).select("fp", "g", F.explode(others).alias("h"))
    sent = sent.select("fp", "g", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        fp, g = part["fp"].to_numpy().view(np.uint64), part["g"].to_numpy()
        a, b = part["a"].iat[0], part["b"].iat[0]
        src, dst = links_between(fp[g == a], None if a == b else fp[g == b], radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return sent.groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id of the documents reachable by links of
    ``radius`` bits or fewer, own row included. Equal texts share a fingerprint
    and so a component. Texts without words (null, empty, white space) have
    fingerprint zero and are linked like any other. Rows with a null doc_id are
    returned and linked, but never name a component unless it has no other id;
    repeated rows are returned as often as they occur. Only doc_id and text are read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, words).checkpoint()
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    links = near_links(least.select("fp"), radius).checkpoint()  # read twice by the components
    comps = connected_components(links)
    final = _smallest_ids(least, "fp", comps)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return join_one_row(rows, final, "fp", "n", how="inner").select("doc_id", hexed, "component_id")


def _smallest_ids(least: DataFrame, key: str, comps: DataFrame) -> DataFrame:
    """key, n, component_id: the smallest ``low`` of each key's component."""
    named = least.join(comps, least[key] == comps.node).select(key, "component", "low").checkpoint()
    smallest = named.groupBy("component").agg(F.min("low").alias("best"), F.count("*").alias("size"))
    moved = join_one_row(named, smallest, "component", "size", how="inner").select(key, "best")
    return least.join(moved, key, "left").select(key, "n", F.coalesce("best", "low").alias("component_id"))


def wide_fingerprint(text: str, words: int = 5) -> tuple[int, int, int]:
    """Two halves of 64 bits, and the number of different shingles. Bit b is set
    if it is set in over half the hashes of the different shingles, and at half
    of them if the first one has it, so that short texts have no bias."""
    tokens = text.encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0, 0, 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.r_[0, ends[: -min(words, len(tokens))]].tolist()
    view = memoryview(joined)
    hashes = [xxhash.xxh3_128_digest(view[s:e], SEED) for s, e in zip(starts, (ends[min(words, len(tokens)) - 1 :] - 1).tolist(), strict=True)]
    hashes = list(dict.fromkeys(hashes))
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    total = 2 * np.add.reduce(bits, axis=0, dtype=np.int64)
    low, high = np.packbits((total > len(hashes)) | (total == len(hashes)) & (bits[0] > 0), bitorder="little").view("<u8").tolist()
    return low, high, len(hashes)


def wide_links(a: np.ndarray, b: np.ndarray | None, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b or a) of a spanning forest of the links between a and
    b, or within a: rows (low, high, size) with ``radius`` differing bits at most
    and sizes within a factor of ``similarity``."""
    none = np.zeros(0, np.int64)
    if not len(a) or b is not None and not len(b):
        return none, none
    other = a if b is None else b
    at, to = np.argsort(a[:, 2], kind="stable"), np.argsort(other[:, 2], kind="stable")
    a, other, offset = a[at], other[to], 0 if b is None else len(a)
    size = other[:, 2]
    forest = _Forest(offset + len(other))
    low, high = np.ascontiguousarray(other[:, 0]), np.ascontiguousarray(other[:, 1])
    src, dst, tile = [none], [none], 256
    for begin in range(0, len(a), tile):
        own = a[begin : begin + tile]
        first, last = int(own[0, 2]), int(own[-1, 2])
        left = np.searchsorted(size, math.ceil(first * similarity - 1e-9)) if b is not None else begin
        right = np.searchsorted(size, math.floor(last / similarity + 1e-9), side="right")
        for near in range(left, right, BLOCK // tile):
            stop = min(right, near + BLOCK // tile)
            p, q = np.nonzero(np.bitwise_count(own[:, 0][:, None] ^ low[near:stop][None, :]) <= radius)
            q += near
            bits = np.bitwise_count(own[p, 0] ^ low[q]) + np.bitwise_count(own[p, 1] ^ high[q])
            sizes = own[p, 2].astype(np.float64), size[q].astype(np.float64)
            ok = (bits <= radius) & (np.minimum(*sizes) >= similarity * np.maximum(*sizes) - 1e-9)
            p, q = forest.add(p[ok] + begin, q[ok] + offset)
            src.append(at[p])
            dst.append(to[q - offset])
    return np.concatenate(src), np.concatenate(dst)


def similar_documents(docs: DataFrame, words: int = 5, radius: int = 24, similarity: float = 0.8, group_rows: int = 1 << 19, min_groups: int = 5) -> DataFrame:
    """doc_id, component_id of every row; component_id is the smallest doc_id
    reachable by links between near copies.

    Shingles of ``words`` words; two texts are linked if their fingerprints of 128
    bits differ in ``radius`` bits at most and their numbers of shingles by a factor
    of ``similarity`` at most. Sets of similarity 0.8 differ in 19 bits on average,
    with a deviation of 4; unrelated ones in 64, with 6. Texts without words are
    one group. Rows with a null doc_id are linked but never name a component
    unless it has no other id; repeated rows are returned as often as they occur.
    """
    ensure_checkpoint_dir(docs.sparkSession)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([wide_fingerprint(t or "", words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["doc_id", "low", "high", "size"])

    print_ = F.struct("low", "high", "size").alias("fp")
    rows = map_batches(docs.select("doc_id", "text"), lambda: each, "doc_id long, low long, high long, size long", ROWS).select("doc_id", print_).checkpoint()
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    groups = max(min_groups, math.ceil(least.count() / group_rows))
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(groups)).cast("int")
    sent = least.select("fp.*", own.alias("g")).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"))
    sent = sent.select("low", "high", "size", "g", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        fp, g = part[["low", "high", "size"]].to_numpy().astype(np.int64).view(np.uint64), part["g"].to_numpy()
        a, b = part["a"].iat[0], part["b"].iat[0]
        x, y = fp[g == a], None if a == b else fp[g == b]
        p, q = wide_links(x, y, radius, similarity)
        both = np.c_[x[p], (x if y is None else y)[q]].view(np.int64)
        return pd.DataFrame(both, columns=["l1", "h1", "n1", "l2", "h2", "n2"])

    found = sent.groupBy("a", "b").applyInPandas(compare, "l1 long, h1 long, n1 long, l2 long, h2 long, n2 long")
    node = lambda k: F.struct(F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high"), F.col(f"n{k}").alias("size"))
    links = found.select(node(1).alias("src"), node(2).alias("dst")).checkpoint()
    final = _smallest_ids(least, "fp", connected_components(links))
    return join_one_row(rows, final, "fp", "n", how="inner").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 5, radius: int = 24, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of its group of similar
    documents; all columns as they are. Rows that share a doc_id are one document
    and stay together; rows with a null doc_id stay."""
    groups = similar_documents(docs, words, radius, similarity)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
