"""Removal of byte strings that occur before, by Burrows-Wheeler transforms.

A byte is removed if a string of ``length`` bytes that covers it also starts
earlier. Documents are cut into stretches of windows that share an anchor (the
smallest hash of the shorter strings inside the window), so equal windows
always carry equal anchors. Anchors that occur once are dropped; stretches of
the others meet by anchor, and each bounded collection of them is indexed
column by column: every round inserts one symbol of each stretch, from its end
to its start, into the collection's Burrows-Wheeler transform and updates the
common prefixes of neighbours. Neighbours with ``length`` bytes in common are
equal windows; all but the earliest are marked.

An anchor of very many stretches is dealt to several collections; what is first
in one of them is compared again over all of them by a grouped minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytofold.llm.text import in_arrow, map_batches, mix
from cytofold.operators.graph import ensure_checkpoint_dir, join_one_row

ANCHOR = 32
STRINGS = 300  # of a collection, more only if one anchor has more
MOST_WINDOWS = 128  # of a stretch; longer ones (periodic text) are cut
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes (a power of two), by doubling."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    reach, factor = 1, _MULTIPLIER
    with np.errstate(over="ignore"):
        while reach < size:
            h = h[:-reach] * factor + h[reach:]
            factor = factor * factor
            reach *= 2
    return mix(h)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= size:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows, anchor there more than once?) of
    the stretches of a text of ``length`` bytes or more."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    hashes, span = string_hashes(data, ANCHOR), length - ANCHOR + 1
    low = sliding_min(hashes, span)
    change = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.r_[0, change]
    stop = np.r_[change, len(low)]
    if (stop - start).max() > MOST_WINDOWS:
        start = np.unique(np.concatenate([start, *(np.arange(a, b, MOST_WINDOWS) for a, b in zip(start, stop, strict=True) if b - a > MOST_WINDOWS)]))
        stop = np.r_[start[1:], len(low)]
    size = stop - start + span - 1
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
    times = np.add.reduceat(hashes[inside] == np.repeat(low[start], size), ends - size, dtype=np.int64)
    return low[start], start, stop - start, (times > 1).astype(np.int64)


def build(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(longer, lcp) of the sorted suffixes of the collection, built column by
    column: for each rank the rank of the suffix that is one symbol longer (-1 if
    there is none), and the common prefix with the suffix before. Rank i of the
    first ranks is the empty suffix of string i. Strings have 254 bytes at most.

    ``bwt`` holds the symbol before each suffix (0: none yet, or the string is
    complete). A round writes the next symbols, sorts the transform stably by
    symbol, which is where each suffix goes that is one symbol longer, and
    inserts the new suffixes there. A new suffix shares with its neighbour one
    symbol more than the shortest common prefix between the two they come from.
    """
    k = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, k)
    flat = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum(sizes)
    used = np.unique(flat)
    code = np.zeros(256, np.uint16 if len(used) > 254 else np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    bwt = np.zeros(k, code.dtype)
    lcp = np.zeros(k + 1, np.uint8)  # one more, so that ranges may end there
    place = np.zeros(k + len(flat), np.int32)
    counted = np.arange(k + len(flat), dtype=np.int32)
    who, at = np.arange(k), np.arange(k)  # strings with symbols left; where their longest suffix stands
    for done in range(int(sizes.max(initial=0))):
        left = sizes[who] > done
        if not left.all():
            who, at = who[left], at[left]
        bwt[at] = code[flat[ends[who] - 1 - done]]
        order = _by_symbol(bwt)
        n = len(order)
        place[order] = counted[:n]
        new = place[at].astype(np.int64)
        here = bwt[at]
        low, high = order[np.maximum(new - 1, 0)], order[np.minimum(new + 1, n - 1)]
        before = _between(lcp, low, at, (new > 0) & (bwt[low] == here))
        after = _between(lcp, at, high, (new < n - 1) & (bwt[high] == here))
        new += k
        old = np.ones(k + n + 1, bool)
        old[new] = False
        bwt, lcp = _insert(bwt, old[:-1]), _insert(lcp, old)
        lcp[new] = before
        lcp[new + 1] = after
        lcp[-1] = 0
        at = new
    longer = np.full(len(bwt), -1, np.int64)
    longer[_by_symbol(bwt)] = np.arange(k, len(bwt))
    return longer, lcp[:-1]


def _by_symbol(bwt: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes that a symbol precedes, by symbol and then rank."""
    return np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]


def _insert(x: np.ndarray, old: np.ndarray) -> np.ndarray:
    out = np.zeros(len(old), x.dtype)
    out[old] = x
    return out


def _between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray, same: np.ndarray) -> np.ndarray:
    """1 + the least lcp in (low, high] where ``same``, else 0."""
    out = np.zeros(len(low), np.uint8)
    at = np.flatnonzero(same)
    if len(at):
        pairs = np.empty(2 * len(at), np.int64)
        pairs[::2], pairs[1::2] = low[at] + 1, high[at] + 1
        out[at] = 1 + np.minimum.reduceat(lcp, pairs)[::2]
    return out


def repeated_windows(strings: Sequence[bytes], doc: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of all windows of ``length`` bytes; and whether an equal one starts earlier, by (doc, place)."""
    longer, lcp = build(strings)
    k = len(strings)
    group_of = np.cumsum(lcp < length)
    size = np.fromiter(map(len, strings), np.int64, k)
    live, rank, whos, windows, groups = np.arange(k), np.arange(k), [], [], []
    for n in range(1, int(size.max(initial=0)) + 1):
        more = size[live] >= n
        live, rank = live[more], longer[rank[more]]
        if n >= length:
            whos.append(live)
            windows.append(size[live] - n)
            groups.append(group_of[rank])
    who, window, group = np.concatenate(whos), np.concatenate(windows), np.concatenate(groups)
    place = pos[who] + window
    order = np.lexsort((place, doc[who], group))
    who, window, group, place = who[order], window[order], group[order], place[order]
    first = np.r_[True, group[1:] != group[:-1]]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (doc[who] != doc[who[lead]]) | (place != place[lead])
    return np.c_[who, window], later


class Collections:
    """Rows (h, share, dealt, doc_id, v, pos, part) sorted by anchor and share, in;
    marks out, each with doc_id and v: (kind 0, a, b): bytes a to b are removed;
    (kind 1, a, b, g1, g2): the window at a, of that fingerprint, is the first of
    its share of a dealt anchor. Marks of kind 0 have keys of their own there, which spread them."""

    def __init__(self, length: int, most: int = 6_000) -> None:
        self.length, self.most = length, most

    def __call__(self, batches):
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_pylist() for c in batch.columns])
            rows += batch.num_rows
            if rows >= self.most:
                cols = [sum((p[k] for p in held), []) for k in range(7)]
                key = (cols[0][-1], cols[1][-1])
                cut = rows
                while cut and (cols[0][cut - 1], cols[1][cut - 1]) == key:
                    cut -= 1
                if cut:
                    yield from self.collections([c[:cut] for c in cols])
                    held, rows = [[c[cut:] for c in cols]], rows - cut
                else:
                    held = [cols]
        if rows:
            yield from self.collections([sum((p[k] for p in held), []) for k in range(7)])

    def collections(self, cols: list[list]):
        """Marks of whole anchors' shares, about ``most`` rows at a time."""
        keys, begin = list(zip(cols[0], cols[1], strict=True)), 0
        while begin < len(keys):
            end = min(begin + self.most, len(keys))
            while end < len(keys) and keys[end] == keys[end - 1]:
                end += 1
            yield self.marks([c[begin:end] for c in cols])
            begin = end

    def marks(self, cols: list[list]) -> pa.RecordBatch:
        anchor, _, dealt, doc, version, pos, part = cols
        length, out = self.length, []
        first: dict[tuple, int] = {}
        for k in sorted(range(len(doc)), key=lambda k: (doc[k], pos[k])):
            own = first.setdefault((anchor[k], part[k], 0), k)
            if own != k and (doc[own], pos[own]) == (doc[k], pos[k]):
                first[anchor[k], part[k], k] = k  # another text of the doc_id: neither is earlier
            elif own != k:
                out.append((0, doc[k], version[k], pos[k], pos[k] + len(part[k]), -1 - doc[k], pos[k]))  # an equal stretch starts earlier
        shared: dict = {}
        for a, _, _ in first:
            shared[a] = shared.get(a, 0) + 1
        rows = [k for (a, p, _), k in first.items() if shared[a] > 1 or dealt[k] or len({p[i : i + length] for i in range(len(p) - length + 1)}) < len(p) - length + 1]
        # a collection takes as many rounds as its longest string has symbols: anchors of equal lengths go together
        longest: dict = {}
        for k in rows:
            longest[anchor[k]] = max(longest.get(anchor[k], 0), len(part[k]))
        rows.sort(key=lambda k: (longest[anchor[k]], anchor[k]))
        begin = 0
        while begin < len(rows):
            end = min(begin + STRINGS, len(rows))
            while end < len(rows) and anchor[rows[end]] == anchor[rows[end - 1]]:
                end += 1
            out += self.transformed([(anchor[k], dealt[k], doc[k], version[k], pos[k], part[k]) for k in rows[begin:end]])
            begin = end
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int32(), *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "doc_id", "v", "a", "b", "g1", "g2"])

    def transformed(self, rows: list[tuple]) -> list[tuple]:
        """Marks of one collection by its transform and common prefixes."""
        length, out = self.length, []
        _, dealt, doc, version, pos, part = zip(*rows, strict=True)
        at, later = repeated_windows(part, np.array(doc), np.array(pos), length)
        # runs of removed windows, stretch by stretch
        which, window = at[later, 0], at[later, 1]
        order = np.lexsort((window, which))
        which, window = which[order], window[order]
        cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (window[1:] > window[:-1] + length)]) if len(which) else np.zeros(0, int)
        last = np.r_[cut[1:], len(which)] - 1 if len(which) else cut
        for k, a, b in zip(which[cut].tolist(), window[cut].tolist(), window[last].tolist(), strict=True):
            out.append((0, doc[k], version[k], pos[k] + a, pos[k] + b + length, -1 - doc[k], pos[k] + a))
        for k, w in at[~later & np.array(dealt)[at[:, 0]]].tolist():
            g = xxhash.xxh3_128_intdigest(part[k][w : w + length])
            out.append((1, doc[k], version[k], pos[k] + w, pos[k] + w + length, (g >> 64) & ((1 << 63) - 1), (g & ((1 << 64) - 1)) - (1 << 63)))
        return out



def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, v, z: the text's bytes, compressed, since the shuffle's own codec hardly shrinks text."""

    def make():
        press = zstandard.ZstdCompressor(level=3)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("v"), pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())], ["doc_id", "v", "z"])

    return map_batches(docs, make, "doc_id long, v long, z binary")


def _dealt(h: np.ndarray, doc: np.ndarray, place: np.ndarray, share_rows: int, hot: int) -> tuple[np.ndarray, ...]:
    """(h, share, doc, place) of a batch's stretches. An anchor with more than
    ``hot`` stretches in the batch is known to repeat: its rows are cut into shares of
    their own, and one row of place -1 tells share 0, where the others meet."""
    share = np.zeros(len(h), np.int32)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(h)])
    told = []
    for a, n in zip(start[size > hot].tolist(), size[size > hot].tolist(), strict=True):
        told.append(h[order[a]])
        for part in np.array_split(order[a : a + n], -(-n // share_rows)):
            mark = mix(h[part[:1]].view(np.uint64) + doc[part[:1]].view(np.uint64) * _MULTIPLIER + place[part[:1]].view(np.uint64))
            share[part] = int(mark[0] >> np.uint64(33)) | 1
    told_h = np.array(told, np.int64)
    more = np.full(len(told), -1, np.int64)
    return np.r_[h, told_h], np.r_[share, np.zeros(len(told), np.int32)], np.r_[doc, more], np.r_[place, more]


def remove_repeats(docs: DataFrame, length: int = 100, share_rows: int | None = None, max_broadcast: int = 500_000, hot: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Bytes are those of the text in UTF-8 (null: empty). A byte is removed if a
    string of ``length`` bytes that covers it also starts earlier, in a row of
    smaller doc_id or before in the same row; strings are judged on the input.
    Rows with a null doc_id are returned whole and make nothing else repeat.
    Rows that repeat one doc_id and text are one document and have one result
    each; rows of one doc_id with different texts are documents of their own that
    take no part in each other's order (equal places are equal). Other columns
    are not read. Stretches of one anchor are dealt to collections of about
    ``share_rows`` rows, by default 2,000 (some 300 kB). Later copies of a whole text are left out of the search: by a
    broadcast list of up to ``max_broadcast`` ids, else by a join after the search for anchors.
    An anchor with more than ``hot`` stretches in one Arrow batch is dealt out there, before any shuffle.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be {ANCHOR} at least")
    share_rows = share_rows or 2_000
    ensure_checkpoint_dir(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    base = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), sha.alias("sha"), F.xxhash64("text").alias("v")).checkpoint()
    ids = base.where("doc_id is not null")
    # the text is part of a document's key only if some doc_id has several: a constant shuffles for nothing
    several = not ids.groupBy("doc_id").agg((F.min("v") != F.max("v")).alias("x")).where("x").isEmpty()
    version = F.xxhash64("text") if several else F.lit(0).cast("long")
    if not several:
        base = base.withColumn("v", F.lit(0).cast("long"))
    origin = base.groupBy("sha").agg(F.min("doc_id").alias("origin"), F.count("*").alias("n")).where("n > 1")
    base = join_one_row(base, origin, "sha", "n").drop("n")
    base = base.withColumn("copy", F.coalesce((F.col("doc_id") > F.col("origin")) & (F.col("n_bytes") >= length), F.lit(False))).drop("origin").checkpoint()
    copies = base.where("copy").select("doc_id", "v").distinct()
    few = copies.limit(max_broadcast + 1).count() <= max_broadcast
    searched = docs.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).select("doc_id", version.alias("v"), "text")
    if few:
        searched = searched.join(F.broadcast(copies), ["doc_id", "v"], "left_anti")

    def anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
        hs, ids, vs, places = [], [], [], []
        versions = batch.column("v").to_numpy()
        for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            h, start, count, twice = stretches(np.frombuffer(text.encode(), np.uint8), length)
            hs.append(h.view(np.int64))
            ids.append(np.full(len(h), doc, np.int64))
            vs.append(np.full(len(h), versions[k], np.int64))
            places.append((start << 9) | (twice << 8) | count)
        h, share, doc, place = _dealt(np.concatenate(hs), np.concatenate(ids), np.concatenate(places), share_rows, hot)
        v = np.concatenate([*vs, np.zeros(len(h) - sum(map(len, vs)), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, share, doc, v, place)], ["h", "share", "doc_id", "v", "place"])

    every = map_batches(searched, lambda: anchors, "h long, share int, doc_id long, v long, place long")
    # a stretch that holds its anchor twice may repeat itself
    met = Window.partitionBy("h", "share")
    weight = F.when(F.col("place") < 0, 1).otherwise(F.shiftright("place", 8).bitwiseAND(1) + 1)
    found = every.withColumn("n", F.sum(weight).over(met)).withColumn("told", F.min("place").over(met) < 0).where("place >= 0 and (n > 1 or share <> 0)")
    shares = F.ceil(F.col("n") / share_rows).cast("int")
    part_of = F.when(F.col("share") != 0, F.col("share")).when(shares > 1, F.pmod(F.xxhash64("doc_id", "place"), shares).cast("int")).otherwise(0)
    dealt = F.col("told") | (F.col("share") != 0) | (shares > 1)
    found = found.select("doc_id", "v", F.struct("h", part_of.alias("share"), dealt.alias("dealt"), F.shiftright("place", 9).alias("pos"), F.col("place").bitwiseAND(255).cast("int").alias("count")).alias("x"))
    if not few:
        found = found.join(copies, ["doc_id", "v"], "left_anti")
    wanted = found.groupBy("doc_id", "v").agg(F.collect_list("x").alias("xs"))

    def parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpress, rows = zstandard.ZstdDecompressor(), []
        for doc, v, z, xs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "v", "z", "xs")), strict=True):
            data = unpress.decompress(z)
            for x in xs:
                rows.append((x["h"], x["share"], x["dealt"], doc, v, x["pos"], data[x["pos"] : x["pos"] + x["count"] + length - 1]))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "share", "dealt", "doc_id", "v", "pos", "part"])

    # the compressed texts are joined twice, here and below; Spark shuffles them once
    packed = _packed(searched)
    texts = map_batches(packed.join(wanted, ["doc_id", "v"]), lambda: parts, "h long, share int, dealt boolean, doc_id long, v long, pos long, part binary")
    dealt_out = texts.repartition("h", "share").sortWithinPartitions("h", "share")
    marks = in_arrow(dealt_out, Collections(length), "kind int, doc_id long, v long, a long, b long, g1 long, g2 long")
    # what is first in one share of a dealt anchor is held against the other shares; other marks stand alone
    same = Window.partitionBy("g1", "g2")
    place = F.struct("doc_id", "a")
    spans = marks.withColumn("lead", F.min(F.when(F.col("kind") == 1, place)).over(same)).where((F.col("kind") == 0) | (place > F.col("lead")))
    spans = spans.groupBy("doc_id", "v").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpress, rows = zstandard.ZstdDecompressor(), []
        for z, spans_ in zip(batch.column("z").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data = unpress.decompress(z)
            runs: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in spans_):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, last = [], 0
            for a, b in runs:
                kept.append(data[last:a])
                last = b
            kept.append(data[last:])
            rows.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("v"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string()], strict=True))], ["doc_id", "v", "n_removed", "n_spans", "kept"])

    # rows that repeat a document give its line again
    changed = map_batches(packed.join(spans, ["doc_id", "v"]), lambda: cut, "doc_id long, v long, n_removed long, n_spans long, kept string").dropDuplicates(["doc_id", "v"])
    empty = hashlib.sha256(b"").hexdigest()
    return base.join(changed, ["doc_id", "v"], "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
