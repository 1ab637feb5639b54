"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams of one to three characters, of lower-cased words with a boundary mark,
are hashed into a fixed number of buckets. Counts per language are summed by
Spark; the log-probability matrix is broadcast. The texts of a batch become one
sparse matrix of n-gram counts (texts x buckets), which is multiplied with the
log-probabilities in numpy.

Languages go in blocks of a fixed number of columns, each of which is scored by
a step of its own that hands on the best language so far, so neither a broadcast
nor a worker grows with the number of languages.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import held_out, in_arrow, map_batches, mix, texts_of

BUCKETS = 1 << 14
ORDERS = 3


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every stretch of other characters than letters becomes one 0."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    ascii_letter = (points >= 97) & (points <= 122)
    other = points >= 128
    if other.any():
        seen = np.unique(points[other])
        marks = np.zeros(int(seen[-1]) + 1, bool)
        marks[[int(x) for x in seen if chr(x).isalpha()]] = True
        letter = ascii_letter.copy()
        letter[other] = marks[points[other]]
    else:
        letter = ascii_letter
    kept = letter | np.r_[True, letter[:-1]]
    return np.where(letter, points, np.uint32(0))[kept]


def buckets_of(points: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every n-gram that ends at each position; those across a word boundary are left out."""
    if len(points) < 2:
        return np.zeros(0, np.int64)
    out, gram = [], np.zeros(len(points), np.uint64)
    wide = points.astype(np.uint64)
    for n in range(1, ORDERS + 1):
        with np.errstate(over="ignore"):
            gram = (gram[:-1] if n > 1 else gram) * np.uint64(0x1000003D) + wide[n - 1 :] + np.uint64(n)
        if n == 1:
            ok = wide > 0
        else:
            ok = np.ones(len(gram), bool)
            for k in range(1, n - 1):  # a mark may stand first or last, not inside
                ok &= wide[k : len(wide) - n + 1 + k] > 0
            if n == 2:
                ok = (wide[:-1] > 0) | (wide[1:] > 0)
        out.append(gram[ok])
    return (mix(np.concatenate(out)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class LanguageModel:
    """languages in order; logs: float32 matrix of buckets x languages; prior: log share of each language."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its share of the posterior, tempered by the
        number of n-grams so that long texts do not all round to 1; ("und", 0)
        for null, for texts without a letter, and if nothing was learned."""
        grams = Grams([text])
        state = self.scored(grams, State.empty(1))
        return state.named(grams)[0]

    def blocks(self, size: int) -> list[LanguageModel]:
        """The model cut into blocks of ``size`` languages, a single one at least."""
        cuts = range(0, max(1, len(self.languages)), size)
        return [LanguageModel(self.languages[k : k + size], np.ascontiguousarray(self.logs[:, k : k + size]), self.prior[k : k + size]) for k in cuts]

    def scored(self, grams: Grams, state: State) -> State:
        """``state`` after this block's languages. The sum over the posterior is
        kept relative to the best total so far."""
        if not self.languages:
            return state
        total = grams.times(self.logs) + self.prior
        best = total.argmax(axis=1)
        top = total[np.arange(len(total)), best]
        scale = np.maximum(1.0, np.sqrt(grams.n))[:, None]
        high = np.maximum(top, state.top)
        with np.errstate(invalid="ignore"):
            before = np.where(np.isneginf(state.top), 0.0, state.sum * np.exp((state.top - high) / scale[:, 0]))
        after = np.exp((total - high[:, None]) / scale).sum(axis=1)
        wins = top > state.top  # the first language keeps a tie
        names = [self.languages[j] if w else old for j, w, old in zip(best.tolist(), wins.tolist(), state.name, strict=True)]
        return State(names, high, before + after)


@dataclass
class State:
    """For each text the best language so far, its total, and the posterior's sum relative to it."""

    name: list[str | None]
    top: np.ndarray
    sum: np.ndarray

    @staticmethod
    def empty(n: int) -> State:
        return State([None] * n, np.full(n, -np.inf), np.zeros(n))

    def named(self, grams: Grams) -> list[tuple[str, float]]:
        return [(name, 1.0 / total) if name and n else ("und", 0.0) for name, total, n in zip(self.name, self.sum.tolist(), grams.n.tolist(), strict=True)]


class Grams:
    """The n-grams of some texts as a sparse matrix: ``row``, ``bucket``, ``times``
    of its entries by row, and ``n`` n-grams in each text (0 without a letter). Long
    texts are counted piece by piece, so memory is bounded by the buckets."""

    def __init__(self, texts: list[str | None], buckets: int = BUCKETS, piece: int = 1 << 18) -> None:
        rows, at, times = [], [], []
        self.n = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self._counted(text or "", buckets, piece)
            if found is not None:
                rows.append(np.full(len(found[0]), k))
                at.append(found[0])
                times.append(found[1])
                self.n[k] = found[1].sum()
        self.row, self.bucket, self.count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, at, times))

    @staticmethod
    def _counted(text: str, buckets: int, piece: int) -> tuple[np.ndarray, np.ndarray] | None:
        points = letters_of(text)
        if not (points > 0).any():
            return None
        if len(points) <= piece:
            return np.unique(buckets_of(points, buckets), return_counts=True)
        total = np.zeros(buckets, np.int64)
        for begin in range(0, len(points), piece):  # n-grams that end in the piece
            head = points[max(0, begin - ORDERS + 1) : begin]
            total += np.bincount(buckets_of(points[max(0, begin - ORDERS + 1) : begin + piece], buckets), minlength=buckets)
            total -= np.bincount(buckets_of(head, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        return at, total[at]

    def times(self, logs: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
        """Product with a dense matrix of buckets x columns, about ``cells`` of it at a time."""
        out = np.zeros((len(self.n), logs.shape[1]))
        step = max(1, cells // max(1, logs.shape[1]))
        for begin in range(0, len(self.row), step):
            row = self.row[begin : begin + step]
            part = logs[self.bucket[begin : begin + step]] * self.count[begin : begin + step, None].astype(np.float32)
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
        return out


def _count(batches):
    """(lang, bucket, n) summed within the task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(texts_of(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(buckets_of(letters_of(text)), minlength=BUCKETS)
    for lang, own in counts.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])


def fit_language(docs: DataFrame, max_train: int = 5_000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from text and non-null lang of rows that are not held out.

    About ``max_train`` rows of each language are used (a bound on the fit only),
    so rare languages are learned from all their rows; priors come from all rows.
    Every language that occurs is learned; the matrix has ``BUCKETS`` numbers for
    each. Nothing to learn from gives a model without languages, which answers "und".
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted(sizes)
    often = {x: n for x, n in sizes.items() if n > max_train}
    sample = rows
    if often:
        cuts = F.create_map(*(F.lit(y) for x, n in often.items() for y in (x, int(max_train / n * 1_000_000))))
        cut = F.coalesce(cuts[F.col("lang")], F.lit(1_000_000))
        sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < cut)
    counted = in_arrow(sample.select("text", "lang"), _count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a language a row: its counts as one array of BUCKETS numbers at most
    packed = counted.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))
    column = {x: k for k, x in enumerate(languages)}
    logs = np.full((BUCKETS, len(languages)), -math.log(BUCKETS), np.float32)
    for r in packed.toLocalIterator():
        table = np.full(BUCKETS, smoothing)
        table[r["at"]] += r["n"]
        logs[:, column[r["lang"]]] = np.log(table / table.sum())
    share = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, logs, np.log(share / share.sum()))


def predict_language(docs: DataFrame, model: LanguageModel, block: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; lang and source are not
    read. Each step broadcasts ``block`` languages at most."""
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast(m) for m in model.blocks(block)]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").withColumns({"best": F.lit(None).cast("string"), "top": F.lit(float("-inf")), "total": F.lit(0.0)})
    for shared in parts[:-1]:
        rows = map_batches(rows, _step(shared, False), rows.schema)
    return map_batches(rows, _step(parts[-1], True), "doc_id long, held_out boolean, lang_pred string, score double")


def _step(shared, last: bool):
    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for begin in range(0, batch.num_rows, 1_000):
                part = batch.slice(begin, 1_000)
                grams = Grams(part.column("text").to_pylist())
                state = own.scored(grams, State(part.column("best").to_pylist(), part.column("top").to_numpy(), part.column("total").to_numpy()))
                if last:
                    found = state.named(grams)
                    new = {"lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64())}
                else:
                    new = {"text": part.column("text"), "best": pa.array(state.name, pa.string()), "top": pa.array(state.top), "total": pa.array(state.sum)}
                out.append(pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": part.column("held_out")} | new))
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return each

    return make
