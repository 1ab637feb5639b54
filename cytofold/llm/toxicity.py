"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs to Latin letters, digits and signs
of a word to the letters they stand for) and matched by one Aho-Corasick
automaton over all lexicon entries. Entries are word stems or whole words with
a weight; a match that lies inside an exception phrase does not count. The sum
of weights, normalised by the length of the text, goes through a logistic curve.

The lexicon, its weights, its exception phrases (an entry's word with a word
beside it, where that pair stands in clean texts) and the curve are learned from
labelled rows, so no language is built in. Empty and null texts have no match and get the curve's
value at zero.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import bounded_sample, held_out, in_arrow, map_batches, pieces_of, texts_of

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
        "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
        "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
        "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o",
    }
)
# Digits and signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# Phrases in which an entry of an English lexicon is harmless; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "loser bracket", "pond scum", "not stupid")

#: Signs are folded beside a letter; at the end of a word "!" is punctuation, and a number alone stays a number.
_LEET = re.compile(r"(?<![^\W_])[0134578@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$]+(?![^\W_])")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W\d_]+")
STEM_MIN, STEM_MAX = 4, 8
#: Rows of a batch that are worked on at once.
ROWS = 1024


def fold(text: str) -> str:
    """The text as the lexicon sees it."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    return _LEET.sub(lambda m: "".join(LEET[c] for c in m[0]), text)


def entries_of(text: str) -> set[str]:
    """Candidate entries of a folded text: stems ("idio") and whole words ("idiot$")."""
    found = set()
    for word in set(_WORD.findall(text)):
        n = len(word)
        found.update(word[:k] for k in range(STEM_MIN, min(n, STEM_MAX) + 1))
        if 3 <= n <= 16:
            found.add(word + "$")
    return found


@dataclass
class ToxicityModel:
    """weights: entry -> weight; curve: intercept, weight of the folded sum and of its density."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "exceptions": self.exceptions, "_automaton": None}

    def automaton(self):
        """Entries by their text; exception phrases share the automaton with weight None."""
        if self._automaton is None:
            table: dict[str, list] = {}
            for entry, weight in self.weights.items():
                table.setdefault(entry.rstrip("$"), []).append((entry.endswith("$"), weight))
            for phrase in self.exceptions:
                table.setdefault(fold(phrase), []).append((True, None))
            machine = ahocorasick.Automaton()
            for word, uses in table.items():
                machine.add_word(word, (len(word), uses))
            if table:
                machine.make_automaton()
            self._automaton = machine
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that count; of several that begin
        at one place the heaviest, none within an exception phrase."""
        best: dict[int, tuple[int, float]] = {}
        harmless: list[tuple[int, int]] = []
        machine = self.automaton()
        for last, (size, uses) in machine.iter(folded) if len(machine) else ():
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            for whole, weight in uses:
                if whole and end < len(folded) and folded[end].isalpha():
                    continue
                if weight is None:
                    harmless.append((start, end))
                elif start not in best or weight > best[start][1]:
                    best[start] = (end, weight)
        harmless.sort()
        kept, k, reach = [], 0, -1
        for start in sorted(best):
            # the farthest end of the phrases that begin at or before this match
            while k < len(harmless) and harmless[k][0] <= start:
                reach = max(reach, harmless[k][1])
                k += 1
            end, weight = best[start]
            if end > reach:
                kept.append((start, end, weight))
        return kept

    def neighbours(self, folded: str) -> set[str]:
        """Pairs (two words, as an exception phrase) of each matched word and the word before or after it."""
        found = self.matches(folded)
        if not found:
            return set()
        words = [(m.start(), m.end()) for m in _WORD.finditer(folded)]
        starts = [a for a, _ in words]
        pairs = set()
        for start, *_ in found:
            k = bisect_right(starts, start) - 1
            for a, b in ((k - 1, k), (k, k + 1)):
                if a >= 0 and b < len(words) and folded[words[a][1] : words[b][0]] == " ":
                    pairs.add(folded[words[a][0] : words[b][1]])
        return pairs

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for *_, w in self.matches(folded))
        words = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(total), math.log1p(100 * total / (words + 20))

    def score(self, text: str) -> float:
        """0 to 1, higher: more likely toxic."""
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _counts(batches: Iterable[pa.RecordBatch]):
    """Documents with each candidate entry, by label, summed within the task."""
    by = (Counter(), Counter())
    for batch in (part for whole in batches for part in pieces_of(whole, ROWS)):
        for text, y in zip(texts_of(batch.column("text")), batch.column("y").to_pylist(), strict=True):
            by[y].update(entries_of(fold(text)))
    # every count: whether an entry is toxic elsewhere, the task cannot know
    names = list(by[0].keys() | by[1].keys())
    for k in range(0, len(names), 50_000):
        part = names[k : k + 50_000]
        yield pa.RecordBatch.from_pydict(
            {"entry": part, "pos": [by[1][x] for x in part], "neg": [by[0][x] for x in part]},
            pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]),
        )


def _phrases(model: ToxicityModel):
    """For each batch, how many documents of each class hold each pair of an entry's word and a word beside it."""

    def count(batches: Iterable[pa.RecordBatch]):
        by = (Counter(), Counter())
        for batch in (part for whole in batches for part in pieces_of(whole, ROWS)):
            for text, y in zip(texts_of(batch.column("text")), batch.column("y").to_pylist(), strict=True):
                by[y].update(model.neighbours(fold(text)))
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"entry": names, "pos": [by[1][x] for x in names], "neg": [by[0][x] for x in names]},
            pa.schema([("entry", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]),
        )

    return count


def choose_entries(found: list[tuple[str, int, int]], toxic: int, clean: int, purity: float) -> dict[str, float]:
    """Weights of the chosen entries. An entry qualifies if, with the classes
    weighed equally, at least ``purity`` of its documents are toxic. Of nested
    stems the longest is kept that has 95 % of the documents of the shortest."""
    weight, pos = {}, {}
    for entry, p, n in found:
        p_rate, n_rate = (p + 0.1) / (toxic + 1), (n + 0.1) / (clean + 1)
        if p_rate / (p_rate + n_rate) >= purity:
            weight[entry], pos[entry] = math.log(p_rate / n_rate), p
    children: dict[str, list[str]] = {}
    for entry in weight:
        parent = entry[:-1] if len(entry) <= STEM_MAX or not entry.endswith("$") else entry[:STEM_MAX]
        children.setdefault(parent, []).append(entry)
    tops = [e for e in weight if not any(e[:k] in weight for k in range(STEM_MIN, len(e)))]
    chosen = {}
    for entry in tops:
        first = pos[entry]
        while longer := [x for x in children.get(entry, ()) if pos[x] >= 0.95 * first]:
            entry = max(longer, key=lambda x: (pos[x], x))
        chosen[entry] = weight[entry]
    return dict(sorted(chosen.items(), key=lambda x: (-pos[x[0]], x[0])))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge by Newton's method; classes weigh as they occur."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-2, 1e-2])
        gradient = a.T @ (p - y) + ridge * w
        w -= np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), gradient)
    return tuple(float(v) for v in w)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_train: int = 8_000, purity: float = 0.9, min_share: float = 0.005,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> ToxicityModel:
    """Learn from ``labels.toxic`` on rows that are not held out.

    At most about ``max_train`` labelled rows of each class are used (a bound on
    the fit only, which also makes their ids safe to broadcast; every row is scored). Rows with a null label, id or text are
    left out. An entry needs ``min_share`` of the toxic rows, three at least, so
    candidates number 1 / ``min_share`` times the entries of a toxic row at most.
    A phrase of two words is an exception if an entry matches in it, three clean
    rows hold it, and with the classes weighed equally ``purity`` of its rows are clean.
    Without rows of both classes the lexicon is empty and every score is 0.5 or less.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    marked = marked.where(~held_out(F.col("doc_id")))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [bounded_sample(marked.where(F.col("y") == y), F.col("doc_id"), max_train, sizes.get(y, 0)) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("y").cast("int").alias("y")).persist()
    try:
        toxic, clean = (int(v or 0) for v in rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first())
        if not toxic or not clean:
            return ToxicityModel({}, (-1.0, 1.0, 1.0), exceptions)
        counted = in_arrow(rows, _counts, "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        enough = counted.where(F.col("pos") >= max(3, math.ceil(min_share * toxic)))
        # rough purity first, so that what comes to the driver is a lexicon and not a vocabulary
        kept = enough.where((F.col("pos") + 0.1) / (toxic + 1) >= (F.col("neg") + 0.1) / (clean + 1))
        weights = choose_entries([tuple(r) for r in kept.collect()], toxic, clean, purity)
        counted = in_arrow(rows, _phrases(ToxicityModel(weights, (0.0, 0.0, 0.0), exceptions)), "entry string, pos long, neg long").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        p, n = (F.col("pos") + 0.1) / (toxic + 1), (F.col("neg") + 0.1) / (clean + 1)
        harmless = counted.where((F.col("neg") >= 3) & (n / (p + n) >= purity)).orderBy("entry").collect()
        exceptions = (*exceptions, *(r["entry"] for r in harmless))
        bare = ToxicityModel(weights, (0.0, 0.0, 0.0), exceptions)

        def features(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [bare.features(t) for t in texts_of(batch.column("text"))]
            return pa.RecordBatch.from_pydict({"a": [v[0] for v in x], "b": [v[1] for v in x], "y": batch.column("y")})

        # two numbers for each row of the fit
        points = map_batches(rows, lambda: features, "a double, b double, y int", ROWS).collect()
    finally:
        rows.unpersist()
    x = np.array([(r["a"], r["b"]) for r in points])
    return ToxicityModel(weights, fit_curve(x, np.array([r["y"] for r in points], float)), exceptions)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; other columns are not read.

    Null and empty texts have no match and get the score of an empty text; repeated
    rows are returned as often as they occur; time is linear in a text's length and matches."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column("text"))
            score = [own.score(t) for t in texts]
            return pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": pa.array([int(s >= 0.5) for s in score], pa.int32())}
            )

        return each

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, make, "doc_id long, held_out boolean, score double, predicted int", ROWS)


def drop_toxic(docs: DataFrame, model: ToxicityModel, cut: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose score is below ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda batch: batch.filter(pa.array([own.score(t) < cut for t in texts_of(batch.column("text"))], pa.bool_()))

    return map_batches(docs, make, docs.schema, ROWS)
