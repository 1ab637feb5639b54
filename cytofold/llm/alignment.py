"""Alignment of two tokenizers over the same texts.

Every byte of a text gets a label: a token of A ends there, a token of B, both,
or none. A regular expression scans the labels; each span up to a "both" label
is a group of A tokens and B tokens that cover the same bytes, and the labels
counted in it are its numbers of tokens. Every byte that is not "none" also ends
the overlap of exactly one A token with one B token, a link.

Both tokenizers end a token before a single space between two characters that
are no white space (A's pattern splits there; no piece of B holds a space after
another character, which is checked), so texts are cut there into units, and
each distinct unit of a slice of texts is encoded and labelled once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytofold.llm.text import in_arrow, pieces_of, texts_of
from cytofold.operators.graph import ensure_checkpoint_dir

CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters of text that are encoded at once; longer texts are cut into slices of about this length.
SLICE = 1 << 20
#: Documents of a batch that are worked on together.
ROWS = 512
#: The byte-level pattern of A (a fixed value): what is merged on its own.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What ends at a byte: nothing, a token of A, one of B, both.
LABELS = np.frombuffer(b".ab|", np.uint8)
SPAN = re.compile(rb"[^|]*\|")
#: Links whose counts are sent to every task; the others meet theirs in a join.
FREQUENT = 1 << 18
#: Encoders in use: a worker that serves many tasks loads them once.
_LOADED: dict[int, tuple] = {}


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from 256."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class TokenizerPair:
    """Contents of the two files; of fixed size, broadcast to the tasks."""

    a_json: str
    b_proto: bytes

    @classmethod
    def load(cls, a_path: str, b_path: str) -> TokenizerPair:
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            pair = cls(a.read(), b.read())
        if any(b" " in t[1:] and t.strip(b" ") for t in pair.encoders()[3]):
            raise ValueError("pieces with a space after another character are not supported")
        return pair

    def names(self) -> list[np.ndarray]:
        return self._loaded()[4]

    def encoders(self) -> tuple:
        """(A, bytes of its ids, B, bytes of its ids)"""
        return self._loaded()[:4]

    def _loaded(self) -> tuple:
        key = zlib.crc32(self.b_proto, zlib.crc32(self.a_json.encode()))
        if key not in _LOADED:
            import sentencepiece
            import tiktoken

            alphabet, model = byte_alphabet(), json.loads(self.a_json)["model"]
            merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            a_bytes = [b""] * (max(model["vocab"].values()) + 1)
            for token, k in model["vocab"].items():
                a_bytes[k] = bytes(alphabet[c] for c in token)
            merged = [model["vocab"][x + y] for x, y in merges]
            if merged != list(range(256, 256 + len(merges))):
                raise ValueError("ids of A do not follow its merges")
            # special tokens stand after the merges; without them their strings are plain text
            a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(a_bytes[: 256 + len(merges)])}, special_tokens={})
            b = sentencepiece.SentencePieceProcessor(model_proto=self.b_proto)
            names = [b.id_to_piece(k) for k in range(b.get_piece_size())]
            b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
            # ids as text, before another one of their group and as the last one
            names = [np.array([[f"{k},", f"{k}{end}"] for k in range(len(t))], object).T for t, end in ((a_bytes, "|"), (b_bytes, ";"))]
            _LOADED.clear()
            _LOADED[key] = (a, a_bytes, b, b_bytes, names)
        return _LOADED[key]


class Units:
    """Distinct units with their tokens, groups and links. ``ok`` is false, and
    everything empty, where the bytes of either tokenizer's tokens are not the unit's."""

    def __init__(self, pair: TokenizerPair, parts: list[str]) -> None:
        a, a_bytes, b, b_bytes = pair.encoders()
        raw = [f" {p}".encode() for p in parts]
        # units without white space at their ends are independent, so one call encodes them all; the others go one by one
        plain = np.array([not (p[0].isspace() or p[-1].isspace()) for p in parts], bool)
        joined = " ".join([p for p, k in zip(parts, plain.tolist(), strict=True) if k])
        size = np.array([len(r) for r in raw], np.int64)
        whole = b"".join([r for r, k in zip(raw, plain.tolist(), strict=True) if k])
        own = []  # of both: ids of the plain units, and the number of them in each unit
        for ids, table in ((a.encode_ordinary(f" {joined}"), a_bytes), (b.encode(joined, num_threads=1), b_bytes)):
            if not joined or b"".join([table[k] for k in ids]) != whole:
                own.clear()
                plain[:] = False
                break
            ends = np.cumsum([len(table[k]) for k in ids])
            own.append((ids, np.diff(np.searchsorted(ends, np.cumsum(size[plain]), side="right"), prepend=0)))
        rest = np.flatnonzero(~plain).tolist()
        self.ok = plain.copy()
        ids_a = [a.encode_ordinary(f" {parts[k]}") for k in rest]
        ids_b = b.encode([parts[k] for k in rest], num_threads=1) if rest else []
        for n, k in enumerate(rest):
            self.ok[k] = b"".join([a_bytes[x] for x in ids_a[n]]) == raw[k] == b"".join([b_bytes[x] for x in ids_b[n]])
        sides = []
        for side, (ids, table) in enumerate(((ids_a, a_bytes), (ids_b, b_bytes))):
            count = np.zeros(len(parts), np.int64)
            if plain.any():
                count[plain] = own[side][1]
            alone = [x if self.ok[k] else [] for k, x in zip(rest, ids, strict=True)]
            count[rest] = [len(x) for x in alone]
            flat = np.empty(count.sum(), np.int64)
            of_plain = np.repeat(plain, count)
            if plain.any():
                flat[of_plain] = own[side][0]
            flat[~of_plain] = list(chain.from_iterable(alone))
            length = np.array([len(t) for t in table], np.int64)
            sides.append((flat, count, np.cumsum(length[flat])))
        (flat_a, self.n_a, ends_a), (flat_b, self.n_b, ends_b) = sides
        size = np.where(self.ok, size, 0)
        ends = np.cumsum(size)
        label = np.zeros(int(size.sum()), np.uint8)
        label[ends_a - 1] += 1
        label[ends_b - 1] += 2
        # links: at a labelled byte the token that covers it is the number of tokens that ended before
        at = np.flatnonzero(label)
        of_a, of_b = (np.cumsum(bit)[at] - bit[at] for bit in ((label & 1).astype(np.int64), (label >> 1).astype(np.int64)))
        self.links = flat_a[of_a] << 32 | flat_b[of_b]
        self.link_end = np.searchsorted(at, ends)
        self.link_start = np.r_[0, self.link_end[:-1]].astype(np.int64)
        # groups: spans of labels up to a "both"
        spans = SPAN.findall(LABELS[label].tobytes())
        in_a, in_b = (np.array([s.count(x) + 1 for s in spans], np.int64) for x in (b"a", b"b"))
        group_end = np.searchsorted(np.flatnonzero(label == 3), ends)
        self.n_groups = np.diff(group_end, prepend=0)
        # as text, token by token: ids of A, then of B, in the order of the groups
        text_a, text_b = pair.names()
        order = np.empty(len(flat_a) + len(flat_b), object)
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        closes_a, closes_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        closes_a[last_a - 1] = closes_b[last_b - 1] = 1
        order[np.arange(len(flat_a)) + np.repeat(last_b - in_b, in_a)] = text_a[closes_a, flat_a]
        order[np.arange(len(flat_b)) + np.repeat(last_a, in_b)] = text_b[closes_b, flat_b]
        every, done = order.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        self.groups = ["".join(every[i:j]) for i, j in zip([0, *done], done, strict=False)]


def _slices(texts: list[str]) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Rows with their texts, about SLICE characters together; a longer text
    comes in parts of its own, and all but its last one say that more follows."""
    now: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        if now and held + len(text) > SLICE:
            yield now, False
            now, held = [], 0
        while len(text) > SLICE and (cut := CUT.search(text, SLICE)):
            yield [(row, text[: cut.start()])], True
            text = text[cut.end() :]
        now.append((row, text))
        held += len(text)
    if now:
        yield now, False


def _taken(pair: TokenizerPair, part: list[tuple[int, str]]) -> tuple[Units, np.ndarray, np.ndarray]:
    """Distinct units of a slice, the unit of every place, and where each row's places begin."""
    number: dict[str, int] = {}
    places: list[int] = []
    starts = []
    for _, text in part:
        starts.append(len(places))
        places += [number.setdefault(u, len(number)) for u in CUT.split(text)]
    return Units(pair, list(number)), np.array(places, np.int64), np.array(starts, np.int64)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all ranges one after the other, and the range of each."""
    n = end - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of], of


def _linked(units: Units, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the slice, link, times) of every distinct link of a row, sorted."""
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(places)]))
    code, often = np.unique(row * len(units.ok) + places, return_counts=True)
    row, unit = code // len(units.ok), code % len(units.ok)
    at, of = _spread(units.link_start[unit], units.link_end[unit])
    known, number = np.unique(units.links, return_inverse=True)
    code = row[of] * max(len(known), 1) + number[at]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    times = np.add.reduceat(often[of][order], first) if len(first) else np.zeros(0, np.int64)
    return code[first] // max(len(known), 1), known[code[first] % max(len(known), 1)], times


SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<long>, times array<int>"


def align(docs: DataFrame, pair: TokenizerPair) -> DataFrame:
    """One row a document: numbers of tokens, groups and links; ``groups`` as text,
    ``a1,a2|b1;a3|b2,b3`` with decimal ids in order (null without tokens); its
    distinct ``links`` (id of A times 2**32 plus id of B, sorted) and how many ``times`` it has each.

    Null and empty texts, and texts whose tokens do not give back their bytes,
    have no tokens. Texts of any length are worked on in slices; only a unit
    without single spaces is encoded as a whole. Repeated rows stay, a null
    doc_id too; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(pieces_of(x, ROWS) for x in batches):
            sums = np.zeros((4, batch.num_rows), np.int64)
            groups: list[list[str]] = [[] for _ in range(batch.num_rows)]
            links: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            good = np.ones(batch.num_rows, bool)
            for part, _ in _slices(texts_of(batch.column("text"))):
                units, places, starts = _taken(shared.value, part)
                rows = np.array([r for r, _ in part])
                for k, x in enumerate((units.n_a, units.n_b, units.n_groups, units.link_end - units.link_start)):
                    sums[k, rows] += np.add.reduceat(x[places], starts)
                good[rows] &= np.logical_and.reduceat(units.ok[places], starts)
                stops, flat = [*starts[1:].tolist(), len(places)], places.tolist()
                of, link, times = _linked(units, places, starts)
                ends = np.searchsorted(of, np.arange(len(rows) + 1))
                for n, (r, i, j) in enumerate(zip(rows.tolist(), starts.tolist(), stops, strict=True)):
                    groups[r] += [units.groups[u] for u in flat[i:j]]
                    links[r].append((link[ends[n] : ends[n + 1]], times[ends[n] : ends[n + 1]]))
            sums *= good
            texts = ["".join(g)[:-1] if g and fine else None for g, fine in zip(groups, good.tolist(), strict=True)]
            kept = [_added(x) if fine else _added([]) for x, fine in zip(links, good.tolist(), strict=True)]
            ends = pa.array(np.cumsum([0, *(len(x) for x, _ in kept)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in kept]), t)) for k, t in enumerate((pa.int64(), pa.int32()))]
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in sums), pa.array(texts, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return in_arrow(docs.select("doc_id", "text"), run, SCHEMA)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links and times of the parts of one text together."""
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    link, number = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return link, np.bincount(number, np.concatenate([n for _, n in parts]), len(link)).astype(np.int64)


def link_counts(aligned: DataFrame) -> DataFrame:
    """link, n (how many rows of ``aligned`` hold it), best (no link of the same id of A has more)."""
    ensure_checkpoint_dir(aligned.sparkSession)
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = counts.withColumn("a", F.shiftright("link", 32)).checkpoint()
    # one row for an id of A; its vocabulary, some 50,000 ids, bounds the broadcast
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` with n_best (its links, repeats counted, that are ``best``) and
    count_sum (``n`` of all of them) in place of links and times; other columns stay.

    Every task holds the ``frequent`` most frequent links, a bounded table. The other
    links are held by few rows each, so a join has no large key for them. ``aligned``
    is read more than once and should be a written table."""
    spark = aligned.sparkSession
    ensure_checkpoint_dir(spark)
    level = F.floor(F.log2("n") * 8).cast("int")
    known, least = 0, 1 << 20
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        known += row["count"]
        if known > frequent:
            break
        least = row["level"]
    else:
        least = -1
    top = counts.where(level >= least).orderBy("link").toArrow()
    shared = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("link", "n", "best")))
    kept = aligned.drop("n_best", "count_sum")
    rest = [f for f in kept.schema.fields if f.name not in ("links", "times")]
    schema = StructType([*rest, *StructType.fromDDL("n_best long, count_sum long, rare array<struct<link:long,times:int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = batch.column("links")
            link, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]
            at = np.minimum(np.searchsorted(known, link), max(len(known) - 1, 0))
            found = known[at] == link if len(known) else np.zeros(len(link), bool)
            sums = [np.r_[0, np.cumsum(np.where(found, x[at] * times if len(known) else 0, 0))] for x in (best, n)]
            sums = [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
            missing = np.flatnonzero(~found)
            rare = pa.StructArray.from_arrays([pa.array(link[missing], pa.int64()), pa.array(times[missing], pa.int32())], ["link", "times"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, ends), pa.int32()), rare)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *sums, rare], schema.names)

    scored = in_arrow(kept, run, schema)
    if least < 0:
        return scored.drop("rare")
    rows = scored.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    links = rows.select("_row", F.inline("rare")).join(counts.where(level < least), "link")
    more = links.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("_n"), F.sum(F.col("best").cast("long") * F.col("times")).alias("_best"))
    done = rows.join(more, "_row", "left")
    done = done.withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_n", F.lit(0)))
    return done.drop("_row", "_n", "_best", "rare")
