"""Benchmark decontamination by template windows.

Texts and benchmark items are brought to templates: numbers, names and units
become typed placeholders, other words are lower-cased. Windows of template
words are hash-joined. What stood in the placeholders is kept as slots: within
an item's match every benchmark value must map to one value of the document, so
a re-parameterised question is caught and a chance meeting of templates is not.

Whether a capitalised word that opens a sentence is a name cannot be told. Its
windows come twice, with the word as it is and as a name; a place in the item
counts if either form meets.

An item without a window of enough literal words (sums, lists of names) has no
template to go by: it is matched as a whole, word by word with its values, by
windows of values that together cover it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import Powers, in_arrow, map_batches, mix, pieces_of, span_hashes, texts_of

# Unit words, taken as a placeholder after a number.
UNITS = (
    "mm cm m km in ft yd mi miles mile meters metres meter metre kilometers kilometres inches inch feet foot yards "
    "mg g kg t lb lbs oz grams gram kilograms kilogram pounds pound tons tonnes ml l liters litres liter litre gallons gallon cups "
    "s sec seconds second min minutes minute h hr hours hour days day weeks week months month years year "
    "usd eur gbp dollars dollar euros euro cents cent percent degrees degree mph kmh kph v w kw a hz j kj cal kcal pa kpa"
).split()

LITERAL, NUMBER, NAME, UNIT = range(4)
_PLACE = mix(np.arange(1, 4, dtype=np.uint64))
_UPPER, _LOWER, _DIGIT, _BREAK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_BREAK[[ord(c) for c in ".!?:;\n\r\"|"]] = True


class Canonical:
    """Template words of texts: hash, kind and hash of the value of each."""

    def __init__(self) -> None:
        self.powers = Powers()
        units = [np.frombuffer(u.encode(), np.uint8) for u in UNITS]
        self.units = np.sort(np.concatenate([span_hashes(u, np.array([0]), np.array([len(u)]), self.powers) for u in units]))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, kind, value hash, and whether the word may be a name at the start of a sentence. A word is a run of letters (bytes above
        ASCII included) or a number, whose inner points and commas belong to it."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)
        upper, digit = _UPPER[data], _DIGIT[data]
        after_c3 = np.r_[False, data[:-1] == 0xC3]
        capital2 = after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = np.where(upper | capital2, data + np.uint8(32), data)
        letter = upper | _LOWER[data] | (data >= 0x80)
        inner = ((data == 44) | (data == 46)) & np.r_[False, digit[:-1]] & np.r_[digit[1:], False]
        kind_at = letter.astype(np.int8) + 2 * (digit | inner).astype(np.int8)
        edge = np.flatnonzero(np.r_[True, kind_at[1:] != kind_at[:-1]])
        stop = np.r_[edge[1:], len(data)]
        word = kind_at[edge] > 0
        start, end = edge[word], stop[word]
        value = span_hashes(low, start, end, self.powers)
        kind = np.where(kind_at[start] == 2, NUMBER, LITERAL).astype(np.int8)
        # a name begins with a capital, goes on in lower case and opens no sentence
        second = np.minimum(start + np.where(data[start] == 0xC3, 2, 1), len(data) - 1)
        capital = upper[start] | ((data[start] == 0xC3) & capital2[np.minimum(start + 1, len(data) - 1)])
        breaks = np.r_[0, np.cumsum(_BREAK[data])]
        opens = np.r_[True, breaks[start[1:]] > breaks[end[:-1]]]
        named = (kind == LITERAL) & capital & ~upper[second] & (end - start > 1)
        kind[named & ~opens] = NAME
        number_before = np.r_[False, kind[:-1] == NUMBER]
        if number_before.any():
            at = np.flatnonzero(number_before & (kind == LITERAL))
            kind[at[np.isin(value[at], self.units)]] = UNIT
        template = np.where(kind == LITERAL, value, _PLACE[np.maximum(kind, 1) - 1])
        return template, kind, value, named & opens

    def both_windows(self, template: np.ndarray, kind: np.ndarray, opener: np.ndarray, n: int, literals: int):
        """(positions, hashes, kinds) of the windows of n words, and of those with an opener again with it as a name."""
        yield *self.windows(template, kind, n, literals), kind
        if len(kind) >= n and opener.any():
            named = np.where(opener, np.int8(NAME), kind)
            at, w = self.windows(np.where(opener, _PLACE[NAME - 1], template), named, n, literals)
            held = np.r_[0, np.cumsum(opener)]
            has = held[at + n] > held[at]
            yield at[has], w[has], named

    def windows(self, template: np.ndarray, kind: np.ndarray, n: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows of n words with enough literal ones."""
        count = len(template) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.full(count, n, np.uint64)
            for k in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + template[k : k + count]
        literal = np.r_[0, np.cumsum(kind == LITERAL)]
        at = np.flatnonzero(literal[n:] - literal[:-n] >= literals)
        return at, mix(total[at])

    def exact_windows(self, value: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all windows of n words with their values."""
        count = len(value) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.full(count, n, np.uint64)
            for k in range(n):
                total = total * np.uint64(0x9E3779B97F4A7C15) + value[k : k + count]
        return mix(total ^ _EXACT)


def _slots(kind: np.ndarray, value: np.ndarray, at: int, n: int) -> list[int]:
    part = slice(at, at + n)
    return value[part][kind[part] != LITERAL].view(np.int64).tolist()


_WINDOW = "w long, pos int, slots array<long>"
_EXACT = np.uint64(0xD6E8FEB86659FD93)  # keeps windows of values apart from those of templates


def _least(n: int) -> int:
    return n - n * 2 // 5  # of five words, three are literal


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, w, pos, slots, n_item (windows of the item), size (words of a
    window: n, or all of a shorter item's), length (words of the item), exact.

    Whether a capitalised word that opens a sentence is a name cannot be told. Its
windows come twice, with the word as it is and as a name; a place in the item
counts if either form meets.

An item without a window of enough literal words has exact windows instead:
    as many as cover it, side by side and one at its end. Items with null id or
    text, and items of one word, have none."""

    def run(batches):
        canon = Canonical()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                template, kind, value, opener = canon.words(text)
                size = min(n, len(template))
                if size < 2:
                    continue
                forms = list(canon.both_windows(template, kind, opener, size, max(2, _least(size)) if size < n else _least(n)))
                n_item = len(np.unique(np.concatenate([at for at, _, _ in forms])))
                exact = not n_item
                if exact:
                    n_item = len(template) - size + 1
                    at = np.unique(np.r_[np.arange(0, n_item, size), n_item - 1])
                    forms = [(at, canon.exact_windows(value, size)[at], kind)]
                rows += [
                    (item, h, p, [] if exact else _slots(own, value, p, size), n_item, size, len(template), exact)
                    for at, w, own in forms
                    for p, h in zip(at.tolist(), w.view(np.int64).tolist(), strict=True)
                ]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["item_id", "w", "pos", "slots", "n_item", "size", "length", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    return in_arrow(rows, run, f"item_id long, {_WINDOW}, n_item int, size int, length int, exact boolean")


def document_windows(docs: DataFrame, n: int, sizes: list[int], exact_sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, w, pos, slots of the windows of every text: of templates in
    ``sizes``, of values in ``exact_sizes``. ``wanted``: sorted hashes to keep (a bounded broadcast); None keeps all for a shuffled join."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        canon, hashes = Canonical(), shared.value
        if hashes is not None:
            marks = np.zeros(1 << 22, bool)
            marks[(hashes >> np.uint64(42)).astype(np.int64)] = True
        # a few documents at a time: where many hold the same item, matches are many times the documents
        for batch in (part for whole in batches for part in pieces_of(whole, 256)):
            ids, ws, ps, ss = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                template, kind, value, opener = canon.words(text)
                forms = [(size, False, *form) for size in sizes for form in canon.both_windows(template, kind, opener, size, max(2, _least(size)) if size < n else _least(n))]
                forms += [(size, True, np.arange(len(w)), w, kind) for size in exact_sizes for w in [canon.exact_windows(value, size)]]
                for size, exact, at, w, own in forms:
                    if hashes is not None:
                        near = np.flatnonzero(marks[(w >> np.uint64(42)).astype(np.int64)])
                        near = near[hashes[np.minimum(np.searchsorted(hashes, w[near]), len(hashes) - 1)] == w[near]] if len(hashes) else near[:0]
                        at, w = at[near], w[near]
                    ids += [doc] * len(at)
                    ws += w.view(np.int64).tolist()
                    ps += at.tolist()
                    ss += [[]] * len(at) if exact else [_slots(own, value, p, size) for p in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ws, pa.int64()), pa.array(ps, pa.int32()), pa.array(ss, pa.list_(pa.int64()))], ["doc_id", "w", "pos", "slots"])

    return in_arrow(docs.where("doc_id is not null and text is not null").select("doc_id", "text"), run, f"doc_id long, {_WINDOW}")


def judge(pos: np.ndarray, item_pos: np.ndarray, slots: list, item_slots: list, n_item: int, size: int, length: int = 0) -> tuple[int, int, int, int]:
    """(windows matched in consistent slots, longest run of them, first and last
    word position in the document) of the best place where the item occurs.

    ``length``: words of the item. Matches are cut into places where they lie
    further apart than the item is long; those that lie as in the item are a
    place too, so that a verbatim copy stands alone among other copies. In a
    place each benchmark value takes the document value that it meets most
    often; windows with another value do not count.
    """
    order = np.lexsort((item_pos, pos))
    pos, item_pos = pos[order], item_pos[order]
    gaps = np.diff(pos)
    places = [x for wide in {n_item + size, max(length, n_item + size)} for x in np.split(np.arange(len(pos)), np.flatnonzero(gaps > wide) + 1)]
    shift = pos - item_pos
    lined = np.argsort(shift, kind="stable")
    places += np.split(lined, np.flatnonzero(np.diff(shift[lined])) + 1)
    best = (0, 0, 0, 0)
    for rows in places:
        votes: dict = {}
        for k in rows:
            for b, d in zip(item_slots[order[k]], slots[order[k]], strict=False):
                own = votes.setdefault(b, {})
                own[d] = own.get(d, 0) + 1
        takes = {b: max(own, key=lambda d: (own[d], d)) for b, own in votes.items()}
        good = [k for k in rows if all(takes[b] == d for b, d in zip(item_slots[order[k]], slots[order[k]], strict=False))]
        if not good:
            continue
        seen = np.unique(item_pos[good])
        run = max(len(x) for x in np.split(seen, np.flatnonzero(np.diff(seen) > 1) + 1))
        best = max(best, (len(seen), run, int(pos[good].min()), int(pos[good].max()) + size))
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, share: float = 0.5, run: int = 9, max_broadcast: int = 500_000) -> DataFrame:
    """One row for each document and benchmark item that it contains: doc_id,
    item_id, matched, n_item (windows), share, longest_run, first_word, last_word.

    A document contains an item if ``share`` of the item's windows of ``n``
    template words meet in consistent slots, or ``run`` windows in a row do (13
    words); an item without such windows (``benchmark_windows``) if all of its
    words stand in it in order. Other documents have no row. Rows with null id or text have none;
    repeated rows count once; an empty benchmark gives an empty result. Up to
    ``max_broadcast`` windows of the benchmark are broadcast as hashes; beyond
    that, all windows of the documents are joined by a shuffle.
    """
    from cytofold.operators.graph import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    items = benchmark_windows(benchmark, n).withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}).checkpoint()
    sizes_of = lambda exact: F.collect_set(F.when(F.col("exact") == exact, F.col("size")))
    facts = items.agg(F.count("*").alias("n"), sizes_of(False).alias("sizes"), sizes_of(True).alias("exact_sizes")).first()
    small = facts["n"] <= max_broadcast
    wanted = np.unique(items.select("w").toPandas()["w"].to_numpy(np.int64).view(np.uint64)) if small else None
    found = document_windows(docs, n, sorted(facts["sizes"]), sorted(facts["exact_sizes"]), wanted)
    every = found.join(F.broadcast(items) if small else items, "w")
    if facts["exact_sizes"]:
        every = every.checkpoint()  # the matches, used twice: documents are read once
    met = every.where(~F.col("exact"))
    match = F.struct("pos", "item_pos", "slots", "item_slots").alias("match")
    pairs = met.groupBy("doc_id", "item_id").agg(F.collect_set(match).alias("matches"), F.max("n_item").alias("n_item"), F.max("size").alias("size"), F.max("length").alias("length"))
    distinct = F.size(F.array_distinct(F.col("matches.item_pos")))
    maybe = pairs.where((distinct >= F.col("n_item") * share) | (distinct >= run))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for part in pieces_of(batch, 64):
                for r in part.to_pylist():
                    m = r["matches"]
                    found = judge(np.array([x["pos"] for x in m]), np.array([x["item_pos"] for x in m]), [x["slots"] for x in m], [x["item_slots"] for x in m], r["n_item"], r["size"], r["length"])
                    out.append((r["doc_id"], r["item_id"], r["n_item"], *found))
            frame = pd.DataFrame(out, columns=["doc_id", "item_id", "n_item", "matched", "longest_run", "first_word", "last_word"])
            return pa.RecordBatch.from_pandas(frame.astype({c: "int32" for c in frame.columns[2:]}), preserve_index=False)

        return each

    judged = map_batches(maybe, make, "doc_id long, item_id long, n_item int, matched int, longest_run int, first_word int, last_word int")
    part = (F.col("matched") / F.col("n_item")).alias("share")
    judged = judged.where((F.col("matched") >= F.col("n_item") * share) | (F.col("longest_run") >= run)).select(
        "doc_id", "item_id", "matched", "n_item", part, "longest_run", "first_word", "last_word"
    )
    if not facts["exact_sizes"]:
        return judged
    first = F.col("pos") - F.col("item_pos")
    covers = F.ceil(F.col("length") / F.col("size"))  # windows of the item: side by side, the last at its end
    spots = every.where("exact").groupBy("doc_id", "item_id", "n_item", "size", "length", first.alias("first_word")).agg(F.collect_set("item_pos").alias("at"))
    whole = spots.where(F.size("at") == covers).groupBy("doc_id", "item_id", "n_item", "length").agg(F.min("first_word").alias("first_word"))
    last = (F.col("first_word") + F.col("length")).alias("last_word")
    return judged.unionByName(whole.select("doc_id", "item_id", F.col("n_item").alias("matched"), "n_item", F.lit(1.0).alias("share"), F.col("n_item").alias("longest_run"), "first_word", last))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns as they are, that contain no benchmark item."""
    gone = contaminated(docs, benchmark, **options).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
