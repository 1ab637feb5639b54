"""Encoding into and decoding from the pieces of a SentencePiece model.

Encoding is a path through the lattice of pieces. A path has weight 0 if each
piece is whole and each neighbouring pair is compatible, that is if merging the
pair's characters by the model's scores gives back the same two pieces, and
minus infinity otherwise; exactly one path of a text has weight 0, and it is the
model's own merge result. So the encoding is a max-plus shortest path that can
start anywhere: a chunk of a text yields a transfer matrix from the pieces that
may lie across its left edge to those across its right edge, matrices multiply
associatively, and once the piece across every edge is known each chunk is
traced back on its own.

Pieces hold white space at their start only (checked when the model is loaded),
so words of ordinary documents are independent and are remembered by each task.
Texts are scanned by words; documents above ``giant_chars`` are cut into chunks
that different tasks scan.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cytofold.llm.text import map_batches, texts_of

SPACE = "▁"
#: Words and pairs that a model remembers, about 80 MB. A full table of pairs begins anew, one of words is
#: kept until the next is full. The tables live in the broadcast model, so a worker lets go of them with it.
WORDS_KEPT = 120_000
PAIRS_KEPT = 250_000
#: Rows of a batch that are worked on at once.
ROWS = 1024
#: Chunks of a giant text that are cut from one block of it.
CHUNKS = 64
State = tuple[int, int, int]  # start, end, piece


@dataclass
class PieceModel:
    """names: piece of every id; scores; kinds: n(ormal), b(yte), o(ther)."""

    names: list[str]
    scores: list[float]
    kinds: str
    unknown: int
    dummy_prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.ids = {p: k for k, p in enumerate(self.names) if self.kinds[k] == "n"}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(self.names) if self.kinds[k] == "b"}
        if any(SPACE in p[1:] and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces with white space inside or at their end are not supported")
        self.unit = self._units()
        self.words: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.made: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.characters = {p for p in self.ids if len(p) == 1}

    def _units(self) -> re.Pattern:
        """Parts of a text that no piece lies across: words, and in them letters apart from what is no letter.

        Letters that some piece holds beside another character are not told from it."""
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        mixed, found = set(), {""}
        while found:
            mixed |= found
            letters = re.compile(rf"[^\W\d_{re.escape(''.join(sorted(mixed)))}]+")
            found = {c for p in self.ids if (q := p.lstrip(SPACE)) and not letters.fullmatch(q) for run in letters.findall(q) for c in run}
        one, also = letters.pattern, rf"(?:[^\w{SPACE}{alone}]|[\d_{re.escape(''.join(sorted(mixed)))}])+"
        return re.compile(f"{SPACE}*(?:{one}|{also})|{SPACE}+" + f"|{alone}" * bool(alone))

    @cached_property
    def starts(self) -> dict[str, int]:
        """The id of every piece, and -1 for what only begins one."""
        return {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds the pieces that end at each position: their length and id."""
        machine = ahocorasick.Automaton()
        for p, k in self.ids.items():
            machine.add_word(p, (len(p), k))
        machine.make_automaton()
        return machine

    def __getstate__(self):
        return (self.names, self.scores, self.kinds, self.unknown, self.dummy_prefix)

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file (on the driver; the model has a fixed size and is broadcast)."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        kinds = "".join("b" if m.is_byte(k) else "o" if m.is_control(k) or m.is_unknown(k) or m.is_unused(k) else "n" for k in range(n))
        prefix = bool(m.encode("a", out_type=str)[0].startswith(SPACE))
        return cls([m.id_to_piece(k) for k in range(n)], [m.get_score(k) for k in range(n)], kinds, m.unk_id(), prefix)

    def shared(self, spark: SparkSession) -> Broadcast:
        """The model broadcast, once a context: encoding and decoding find one copy in a worker."""
        known = self.__dict__.get("_shared")
        if known is None or known[0] is not spark.sparkContext:
            known = self._shared = (spark.sparkContext, spark.sparkContext.broadcast(self))
        return known[1]

    def surface(self, text: str) -> str:
        """The text as pieces see it; the empty text stays empty."""
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def merges(self, text: str) -> Iterator[tuple[list[str], float]]:
        """Neighbours are merged, best score first, leftmost of equals: the parts after each merge, and its score; for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                piece = self.ids.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield parts, best

    def merged(self, text: str) -> list[str]:
        """What the merges of a short string leave."""
        parts = list(text)
        for parts, _ in self.merges(text):  # noqa: B007
            pass
        return parts

    def piece_at(self, text: str, start: int, end: int) -> int | None:
        """Its id; a character without a piece is -1 minus its code point."""
        piece = self.ids.get(text[start:end])
        return -1 - ord(text[start]) if piece is None and end == start + 1 else piece

    def follows(self, last: int | None, piece: int) -> bool:
        """May ``piece`` come after ``last`` (None: first of its text)? That is weight 0, else minus infinity."""
        if piece < 0:
            return True
        key = piece if last is None or last < 0 else (last + 1) << 20 | piece
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            right = self.names[piece]
            left = self.names[last] if key >> 20 else ""
            known = self.fits(left, right)
            self.pairs[key] = known
        return known

    def steps(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """Scores of the merges that make the piece, in their order and with an end below all, and its first and
        last part before each; None if the merges end otherwise."""
        known = self.made.get(piece, 0)
        if known == 0:
            scores: list[float] = []
            firsts, lasts = [piece[0]], [piece[-1]]
            for parts, score in self.merges(piece):
                scores.append(score)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self.made[piece] = ([*scores, -math.inf], firsts, lasts) if firsts[-1] == piece else None
        return known

    def fits(self, left: str, right: str) -> bool:
        """Do the merges of both strings together end with these two? ``left`` may be empty.

        Each side's merges go on as if it were alone, the better next one first and the left of equals,
        until what meets at the seam would be merged before both."""
        b = self.steps(right)
        if b is None or not left:
            return b is not None
        a = self.steps(left)
        if a is None:
            return False
        of, scores, i, j = self.ids.get, self.scores, 0, 0
        while True:
            x, y, piece = a[0][i], b[0][j], of(a[2][i] + b[1][j])
            if piece is not None and x < scores[piece] >= y:
                return False
            if x == y == -math.inf:
                return True
            if x >= y:
                i += 1
            else:
                j += 1

    def forward(self, text: str, start: int, end: int, last: int | None) -> dict[int, tuple[int, int | None]]:
        """Scan from ``start``, where ``last`` ends: for every position up to
        ``end`` that a path of weight 0 reaches, the start and id of its last piece."""
        reached: dict[int, tuple[int, int | None]] = {start: (start, last)}
        pairs, follows = self.pairs, self.follows
        if start < end and self.characters.issuperset(text[start:end]):
            for at, (size, piece) in self.automaton.iter(text, start, end):
                stop = at + 1
                if stop in reached or (own := reached.get(stop - size)) is None:
                    continue
                before = own[1]
                fits = pairs.get((before + 1) << 20 | piece if before is not None and before >= 0 else piece)
                if fits is None:
                    fits = follows(before, piece)
                if fits:
                    reached[stop] = (stop - size, piece)
            return reached
        # a character without a piece may stand anywhere
        starts = self.starts.get
        for begin in range(start, end):
            own = reached.get(begin)
            if own is None:
                continue
            before = own[1]
            base = 0 if before is None or before < 0 else (before + 1) << 20
            for stop in range(begin + 1, end + 1):
                string = text[begin:stop]
                piece = starts(string)
                if piece is None:
                    if stop == begin + 1 and stop not in reached:
                        reached[stop] = (begin, -1 - ord(string))
                    break
                if stop in reached:
                    continue
                if piece < 0:
                    if stop == begin + 1:
                        reached[stop] = (begin, -1 - ord(string))
                    continue
                fits = pairs.get(base | piece)
                if fits is None:
                    fits = follows(before, piece)
                if fits:
                    reached[stop] = (begin, piece)
        return reached

    @staticmethod
    def trace(reached: dict, start: int, end: int) -> list[int]:
        out = []
        while end > start:
            end, piece = reached[end]
            out.append(piece)
        return out[::-1]

    def as_ids(self, pieces: list[int]) -> list[int]:
        """Characters without a piece become the ids of their bytes, or the unknown id."""
        out: list[int] = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def word(self, unit: str) -> bytes:
        """Ids (int32) of a unit, remembered; a long unit is scanned in chunks."""
        if (found := self.former.get(unit)) is not None:
            pass
        elif len(unit) <= 256:
            pieces = self.trace(self.forward(unit, 0, len(unit), None), 0, len(unit))
        else:
            pieces = scan(self, unit, 128)
        if found is None:
            found = array("i", pieces if min(pieces, default=0) >= 0 else self.as_ids(pieces)).tobytes()
        if len(unit) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.former.clear()
                self.former.update(self.words)
                self.words.clear()
            self.words[unit] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        known, word = self.words.get, self.word
        return np.frombuffer(b"".join([known(u) or word(u) for u in self.unit.findall(self.surface(text))]), np.int32)

    def decode(self, ids: list[int]) -> str:
        table = self.table()
        text = b"".join([table[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            bytes_of = {"n": lambda p: p.replace(SPACE, " ").encode(), "b": lambda p: bytes([int(p[3:5], 16)]), "o": lambda p: b""}
            self._table = [bytes_of[self.kinds[k]](p) for k, p in enumerate(self.names)]
            if 0 <= self.unknown < len(self._table):
                self._table[self.unknown] = " ⁇ ".encode()
        return self._table


def states_at(model: PieceModel, text: str, cut: int) -> list[State]:
    """Pieces that may lie across ``cut`` or end there; at the start of a text the one state before any piece."""
    if cut <= 0:
        return [(0, 0, -1)]
    found = []
    for start in range(max(0, cut - model.longest), cut):
        for end in range(cut, min(len(text), start + model.longest) + 1):
            piece = model.piece_at(text, start, end)
            if piece is not None and model.follows(None, piece):
                found.append((start, end, piece))
    return found


def _breaks(text: str, a: int, b: int) -> list[int]:
    """Positions in [a, b] before which a word ends: no piece lies across them."""
    return [k for k in range(max(a, 1), min(b, len(text) - 1) + 1) if text[k] == SPACE and text[k - 1] != SPACE]


def _edges(text: str, a: int, b: int) -> tuple[int, int] | None:
    """First and last break of a chunk, if there is one."""
    first = next((k for k in range(max(a, 1), min(b, len(text) - 1) + 1) if text[k] == SPACE and text[k - 1] != SPACE), None)
    if first is None:
        return None
    return first, next(k for k in range(min(b, len(text) - 1), first - 1, -1) if text[k] == SPACE and text[k - 1] != SPACE)


def transfer(model: PieceModel, text: str, a: int, b: int) -> np.ndarray:
    """Matrix of chunk [a, b): entry states x exit states, true for weight 0 and
    false for minus infinity, so that the max-plus product is the boolean one."""
    entries, exits = states_at(model, text, a), states_at(model, text, b)
    out = np.zeros((len(entries), len(exits)), bool)
    limit = min(len(text), b + model.longest)
    edges = _edges(text, a, b)
    if edges:
        first, last = edges
        if last == b and last > first:  # the last whole word ends at the right edge
            last = max(k for k in _breaks(text, first, b - 1))
        begins = None if last == 0 else -1
        tail = model.forward(text, last, limit, begins) if last < b else None
    for i, (_, end, piece) in enumerate(entries):
        before = None if a <= 0 else piece
        if end >= b and a > 0:
            out[i] = [x == entries[i] for x in exits]
            continue
        if edges and first < b:
            if first not in model.forward(text, end, first, before):
                continue
            reached, least = tail, last
        else:
            reached, least = model.forward(text, end, limit, before), end
        out[i] = [s >= least and reached.get(e) == (s, p) for s, e, p in exits]
    return out


def chain(matrices: list[np.ndarray]) -> list[int]:
    """The state at each edge of the one path of weight 0, from prefix products.

    Products are taken pairwise in rounds of doubling reach (they are
    associative); then the path is followed back from the end."""
    prefix = [m.copy() for m in matrices]
    reach = 1
    while reach < len(prefix):
        prefix = [prefix[k] if k < reach else (prefix[k - reach].astype(np.float32) @ prefix[k].astype(np.float32)) > 0 for k in range(len(prefix))]
        reach *= 2
    state = int(np.flatnonzero(prefix[-1][0])[0])
    states = [state]
    for k in range(len(matrices) - 1, 0, -1):
        state = int(np.flatnonzero(prefix[k - 1][0] & matrices[k][:, state])[0])
        states.append(state)
    return [0, *states[::-1]]


def trace_chunk(model: PieceModel, text: str, a: int, b: int, entry: State, exit_: State) -> list[int]:
    """Pieces after ``entry`` up to and with ``exit_``."""
    if entry == exit_:
        return []
    start = 0 if a <= 0 else entry[1]
    before = None if a <= 0 else entry[2]
    edges = _edges(text, start, exit_[0])
    if not edges:
        return model.trace(model.forward(text, start, exit_[1], before), start, exit_[1])
    first, last = edges
    head = model.trace(model.forward(text, start, first, before), start, first)
    middle = [int(p) for p in _whole(model, text[first:last])]
    tail = model.trace(model.forward(text, last, exit_[1], -1), last, exit_[1])
    return head + middle + tail


def _whole(model: PieceModel, text: str) -> list[int]:
    """Pieces of whole words."""
    out: list[int] = []
    for m in model.unit.finditer(text):
        unit = m[0]
        out += model.trace(model.forward(unit, 0, len(unit), -1), 0, len(unit)) if len(unit) <= 256 else scan(model, unit, 128)
    return out


def scan(model: PieceModel, text: str, size: int) -> list[int]:
    """Pieces of one string, cut into chunks of ``size``: matrices, product, traces."""
    cuts = [*range(0, len(text), size), len(text)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < model.longest:
        del cuts[-2]
    matrices = [transfer(model, text, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    # at the end of the text only pieces that end there are states
    states = chain(matrices)
    out: list[int] = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out += trace_chunk(model, text, a, b, states_at(model, text, a)[states[k]], states_at(model, text, b)[states[k + 1]])
    return out


def encode(docs: DataFrame, model: PieceModel, giant_chars: int = 1 << 16, chunk_chars: int = 1 << 13) -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every row.

    Null and empty texts have no ids. Documents above ``giant_chars`` are cut
    into chunks of ``chunk_chars`` that are scanned, joined and traced as rows of
    their own; the result is the same. Repeated rows are returned as often as
    they occur; only doc_id and text are read."""
    shared = model.shared(docs.sparkSession)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [own.encode(t) for t in texts_of(batch.column("text"))]
            return _listed(batch.column("doc_id"), found)

        return each

    rows = docs.select("doc_id", "text")
    giant = F.coalesce(F.length("text"), F.lit(0)) > giant_chars
    plain = map_batches(rows.where(~giant), make, "doc_id long, ids array<int>", ROWS)
    large = _encode_giant(rows.where(giant), shared, chunk_chars)
    return plain.unionByName(large).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


def _listed(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "ids"])


def _encode_giant(rows: DataFrame, shared, size: int) -> DataFrame:
    model = shared.value
    pad = model.longest
    surface = F.translate("text", " ", SPACE)
    if model.dummy_prefix:
        surface = F.concat(F.lit(SPACE), surface)
    # equal rows are scanned once and handed out as often as they occur
    docs = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").groupBy("doc_id", "h", "text").agg(F.count("*").alias("times"))
    whole = docs.select(F.struct("doc_id", "h").alias("key"), "times", surface.alias("s"), F.length(surface).alias("n"))
    # a place in a text is found by counting its characters from the start: blocks of many chunks first, then chunks in them
    wide = size * CHUNKS
    last = lambda of: F.floor((F.col("n") - 1) / of).cast("int")
    block = whole.select("*", F.explode(F.sequence(F.lit(0), last(wide))).alias("j"))
    from_ = F.greatest(F.lit(0), F.col("j") * wide - pad)
    block = block.select("key", "times", "n", "j", from_.alias("from"), F.substr("s", from_ + 1, F.least(F.col("n"), (F.col("j") + 1) * wide + pad) - from_).alias("s"))
    cut = block.select("*", F.explode(F.sequence(F.col("j") * CHUNKS, F.least((F.col("j") + 1) * CHUNKS - 1, last(size)))).alias("k"))
    left = F.greatest(F.lit(0), F.col("k") * size - pad)
    right = F.least(F.col("n"), (F.col("k") + 1) * size + pad)
    chunks = cut.select("key", "times", "k", (F.col("k") * size - left).alias("a"), F.least(F.lit(size), F.col("n") - F.col("k") * size).alias("len"), F.substr("s", left - F.col("from") + 1, right - left).alias("part"))
    keyed = "key struct<doc_id:long,h:long>, k int"

    def matrices(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows_, cols, bits = shared.value, [], [], []
        for a, n, part in zip(*(batch.column(c).to_pylist() for c in ("a", "len", "part")), strict=True):
            m = transfer(own, part, a, a + n)
            rows_.append(m.shape[0])
            cols.append(m.shape[1])
            bits.append(np.packbits(m).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), pa.array(rows_, pa.int32()), pa.array(cols, pa.int32()), pa.array(bits, pa.binary())], ["key", "k", "r", "c", "bits"])

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        ms = [np.unpackbits(np.frombuffer(x, np.uint8), count=r * c).astype(bool).reshape(r, c) for x, r, c in zip(part["bits"], part["r"], part["c"], strict=True)]
        states = chain(ms)
        return pd.DataFrame({"doc_id": part["doc_id"], "h": part["h"], "k": part["k"], "entry": states[:-1], "exit": states[1:]})

    def traced(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = shared.value, []
        for a, n, part, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "len", "part", "entry", "exit")), strict=True):
            pieces = trace_chunk(own, part, a, a + n, states_at(own, part, a)[x], states_at(own, part, a + n)[y])
            out.append(np.array(own.as_ids(pieces), np.int32))
        lists = _listed(batch.column("k"), out).column(1)
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("times"), batch.column("k"), lists], ["key", "times", "k", "ids"])

    table = map_batches(chunks, lambda: matrices, f"{keyed}, r int, c int, bits binary")
    table = table.select("key.doc_id", "key.h", "k", "r", "c", "bits")
    states = table.groupBy("doc_id", "h").applyInPandas(joined, "doc_id long, h long, k int, entry int, exit int")
    states = states.select(F.struct("doc_id", "h").alias("key2"), F.col("k").alias("k2"), "entry", "exit")
    both = chunks.join(states, F.col("key").eqNullSafe(F.col("key2")) & (F.col("k") == F.col("k2"))).select("key", "times", "k", "a", "len", "part", "entry", "exit")
    parts = map_batches(both, lambda: traced, "key struct<doc_id:long,h:long>, times long, k int, ids array<int>")
    whole_ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"]))
    done = parts.groupBy("key").agg(F.first("times").alias("times"), whole_ids.alias("ids"))
    return done.select(F.col("key.doc_id").alias("doc_id"), "ids", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("doc_id", "ids")


def decode(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of ``ids`` (null ids:
    null). A column of that name is replaced. Ids outside the model raise an error."""
    shared = model.shared(encoded.sparkSession)
    kept = encoded.drop("decoded")

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_pylist()
            text = [own.decode(flat[a:b].tolist()) if known else None for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

        return each

    return map_batches(kept, make, StructType([*kept.schema.fields, StructField("decoded", StringType())]), ROWS)
