"""Secrets in texts: fixed patterns, and random strings by character Markov models.

Everything here is DataFrame expressions. Match positions come from marking the
matches in the text, splitting at the marks and adding up lengths. Candidate
strings that no pattern covers are scored by the log-likelihood ratio of two
first-order character models, one of random strings and one of ordinary
identifiers, both counted from labelled samples.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import bounded_sample

# Marks put around matches; texts that hold them get _OTHER in their place, which
# is as long and part of no pattern.
_EDGE, _INNER, _OTHER = "\x01", "\x02", "\x03"

# Kind, pattern in two groups (the second is the secret), least length of the second.
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"()(AKIA[A-Z0-9]{16,})", 20),
    ("hex", r"()([0-9a-f]{24,})", 24),
)
CANDIDATE = r"()([A-Za-z0-9+/_=-]{20,})"
RANDOM = "random"
RANKS = {kind: k for k, kind in enumerate([*(p[0] for p in PATTERNS), RANDOM])}
SPAN = "struct<start:int,rank:int,end:int,inner:int>"


def _clean(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    marked = plain.contains(_EDGE) | plain.contains(_INNER)
    return F.when(marked, F.translate(plain, _EDGE + _INNER, _OTHER * 2)).otherwise(plain)


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the edges of the matches of ``pattern``; a match holds the inner mark."""
    return F.split(F.regexp_replace(text, pattern, f"{_EDGE}$1{_INNER}$2{_EDGE}"), _EDGE, -1)


def _spans(pieces: Column, rank: int, least: int) -> Column:
    """Spans (code points, end exclusive) of the pieces that are matches with ``least`` characters in the second group."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        inner = F.instr(piece, _INNER)
        end = acc["at"] + F.length(piece) - F.when(inner > 0, 1).otherwise(0)
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), (acc["at"] + inner - 1).alias("inner"))
        long_enough = (inner > 0) & (F.length(piece) - inner >= least)
        return F.struct(end.alias("at"), F.when(long_enough, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    # an array grows by copying: pieces go in blocks, about as many as each has pieces
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    found = F.aggregate(_blocks(pieces), F.array(start), lambda acc, block: F.array_append(acc, F.aggregate(block, F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out")), step)))
    return F.when(F.size(pieces) > 1, F.flatten(F.transform(found, lambda b: b["out"]))).otherwise(none)


def _blocks(items: Column) -> Column:
    """An array cut into blocks, about as many as a block has items."""
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
    last = F.greatest(F.lit(0), F.ceil(F.size(items) / size).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, size))


#: Code points of a block of text; a string is cut from the blocks it lies in, since cutting from the text walks there from its start.
BLOCK = 1024


def _text_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), 0)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.greatest(F.lit(0), F.floor((end - 1) / BLOCK).cast("int") - first + 1))
    return F.when(end > start, F.substr(F.array_join(some, ""), start - first * BLOCK + 1, end - start)).otherwise("")


@dataclass
class MarkovModel:
    """ratio: for each pair of ASCII characters (128 x 128, row by row) the log
    of its probability among random strings over that among identifiers."""

    ratio: list[float]
    cut: float = 12.0
    cut_per_char: float = 0.5

    def score(self, string: Column) -> Column:
        """Log-likelihood ratio of a string of ASCII characters; positive: rather random."""
        table = F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratio)), ",").cast("array<double>")
        codes = F.transform(F.split(string, ""), F.ascii)
        return F.aggregate(
            codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when((acc["last"] < 0) | (c <= 0), F.lit(0.0)).otherwise(F.get(table, acc["last"] * 128 + c))).alias("sum")),
            lambda acc: acc["sum"],
        )


def fit_markov(samples: DataFrame, smoothing: float = 0.2) -> MarkovModel:
    """Learn from (string, label): label 1 random, 0 ordinary. Pairs with a
    character outside ASCII are left out. Without samples of both labels every
    ratio is 0 and no string is called random."""
    at = F.sequence(F.lit(1), F.length("string") - 1)
    pairs = samples.where(F.length("string") >= 2).select("label", "string", F.explode(at).alias("i"))
    coded = pairs.select("label", F.ascii(F.substr("string", "i", F.lit(1))).alias("a"), F.ascii(F.substr("string", F.col("i") + 1, F.lit(1))).alias("b"))
    counts = coded.where("a < 128 and b < 128").groupBy("label", "a", "b").count().collect()  # at most 2 x 128 x 128
    table = {0: [0.0] * 16384, 1: [0.0] * 16384}
    for r in counts:
        table[r["label"]][r["a"] * 128 + r["b"]] += r["count"]
    if not (any(table[0]) and any(table[1])):
        return MarkovModel([0.0] * 16384)
    used = {a for k in (0, 1) for a in range(128) if any(table[k][a * 128 : a * 128 + 128])}
    logs = {}
    for k in (0, 1):
        logs[k] = []
        for a in range(128):
            row = table[k][a * 128 : a * 128 + 128]
            total = sum(row) + smoothing * len(used)
            logs[k] += [math.log((x + smoothing) / total) for x in row]
    return MarkovModel([x - y for x, y in zip(logs[1], logs[0], strict=True)])


def labelled_samples(docs: DataFrame, max_docs: int = 20_000) -> DataFrame:
    """(string, label) from about ``max_docs`` documents (a bound on the fit
    only): what the fixed patterns call a secret has label 1, words of six and
    more letters, digits and underscores elsewhere have label 0, in a tenth of
    the documents, or in all of them if they are fewer than a thousand."""
    known = docs.where(F.col("text").isNotNull())
    total = known.count()
    rows = bounded_sample(known, F.col("doc_id"), max_docs, total).select("doc_id", _clean(F.col("text")).alias("text"))
    secret = None
    for kind, pattern, least in PATTERNS:
        got = rows.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), 2)).alias("string")).where(F.length("string") >= max(least, 16))
        secret = got if secret is None else secret.unionByName(got)
    plain = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0) if total >= 1_000 else rows
    bare = F.col("text")
    for _, pattern, _ in PATTERNS:
        bare = F.regexp_replace(bare, pattern, " ")
    words = plain.select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{5,})"), 1)).alias("string"))
    return secret.select("string", F.lit(1).alias("label")).unionByName(words.select("string", F.lit(0).alias("label")))


def find_spans(docs: DataFrame, model: MarkovModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs, ``base`` and ``added`` (arrays of spans), and ``clean`` (the text as searched)."""
    rows = docs.select(*keep, _clean(F.col("text")).alias("clean"))
    cut = rows.select("*", *(_pieces(F.col("clean"), p).alias(f"_{kind}") for kind, p, _ in PATTERNS), _pieces(F.col("clean"), CANDIDATE).alias("_candidate"))
    spans = [_spans(F.col(f"_{kind}"), RANKS[kind], least) for kind, _, least in PATTERNS]
    base = F.array_sort(F.concat(*spans))
    maybe = _spans(F.col("_candidate"), RANKS[RANDOM], 20)
    # blocks of base spans with what they reach, so that a candidate looks into few of them
    near = F.transform(_blocks(F.col("base")), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans")))
    found = cut.select(*keep, "clean", base.alias("base"), maybe.alias("_maybe"))
    blocks = F.when(F.size("_maybe") > 0, _text_blocks(F.col("clean")))
    found = found.withColumns({"_near": near, "_blocks": blocks})

    def random(span: Column) -> Column:
        size = span["end"] - span["start"]
        meets = lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"])
        free = ~F.exists(F.col("_near"), lambda n: (n["low"] < span["end"]) & (n["high"] > span["start"]) & F.exists(n["spans"], meets))
        ratio = model.score(_cut(F.col("_blocks"), span["start"], span["end"]))
        return free & (ratio >= F.greatest(F.lit(model.cut), model.cut_per_char * size))

    # named twice, the blocks stay a column; named in the lambda only, they would be made again for each candidate
    added = F.when((F.size("_maybe") > 0) & (F.size("_near") > 0) & (F.size("_blocks") > 0), F.filter("_maybe", random)).otherwise(F.col("_maybe"))
    return found.select(*keep, "clean", "base", added.alias("added"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in RANKS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row.

    Null and empty texts have no span (base_sha256 is that of the empty string);
    repeated rows are returned as often as they occur; other columns are not read.
    """
    found = find_spans(docs, model, ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == RANKS[kind])).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *(count(kind) for kind, *_ in PATTERNS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def redact_secrets(docs: DataFrame, model: MarkovModel, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in text replaced by ``mark``; of an assignment
    only the value. All other columns and texts without secrets stay as they
    are; n_chars, if there is one, follows the new text. Overlapping spans become one mark."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "text")
    found = find_spans(packed, model, ["_row"])
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct((s["inner"]).alias("s"), s["end"].alias("e"))))

    gaps = "array<struct<start:int,end:int>>"

    def step(acc: Column, span: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), span["s"].alias("end"))
        return F.struct(F.greatest(span["e"], acc["at"]).alias("at"), F.when(span["s"] >= acc["at"], F.array_append(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    # what stands before each mark; arrays grow by copying, so spans go in blocks
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(gaps).alias("out"))
    walk = lambda acc, block: F.array_append(acc, F.aggregate(block, F.struct(F.element_at(acc, -1)["at"].alias("at"), F.array().cast(gaps).alias("out")), step))
    some = F.size("_spans") > 0
    whole = found.select("_row", F.col("_row.text").alias("_text"), order.alias("_spans"))
    walked = whole.select("*", F.when(some, F.aggregate(_blocks(F.col("_spans")), F.array(begin), walk)).alias("_walk"), F.when(some, _text_blocks(F.col("_text"))).alias("_blocks"))
    before = F.transform(F.flatten(F.transform("_walk", lambda b: b["out"])), lambda g: F.concat(_cut(F.col("_blocks"), g["start"], g["end"]), F.lit(mark)))
    rest = _cut(F.col("_blocks"), F.element_at("_walk", -1)["at"], F.length("_text"))
    # named twice, the blocks and the walk stay columns
    text = F.when(some & (F.size("_walk") > 0) & (F.size("_blocks") > 0), F.concat(F.array_join(before, ""), rest)).otherwise(F.col("_text"))
    whole = walked
    kept = whole.select("_row", "_spans", text.alias("_new"))
    out = []
    for c in names:
        own = F.col("_row").getField(c)
        if c == "n_chars":
            own = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(own)
        out.append((F.col("_new") if c == "text" else own).alias(c))
    return kept.select(*out)
