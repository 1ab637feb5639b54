"""Spelling variants: words one edit apart, found on a trie with one error.

The trie of all words is a table of its nodes (the hash of a prefix). The child
of a node below which most words lie is its heavy one; the others, and a word
that ends at the node, are light. Of two words one edit apart that part at a node,
at least one goes by a light child. So only the words below light children are
entered a second time, with the error at the node: the character replaced by any
other or skipped, or the heavy character put in its place or before it. The small
subtrees are thereby merged into the large one, and a word is entered again at
most as often as it has light children above it, the logarithm of the number of
words at most. Entries that end at the same string are one edit apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytofold.llm.text import Powers, in_arrow, pieces_of, span_hashes
from cytofold.operators.graph import ensure_checkpoint_dir, join_one_row

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, shortest: int = 7, fewest: int = 2, lose_one_in: int = 31) -> DataFrame:
    """word, n: runs of letters of all texts, A-Z lower-cased, with a character
    left out of those whose hash with the doc_id ``lose_one_in`` divides (planted
    errors; 0: none). Words of ``shortest`` code points and ``fewest`` occurrences
    or more. Null texts hold none, a null doc_id counts as an empty one; shorter
    runs cannot become such words and are passed over."""
    run = F.explode(F.regexp_extract_all("text", F.lit(f"({RUN}{{{shortest},}})"))).alias("run")
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).withColumn("word", F.translate("run", UPPER, LOWER))
    if lose_one_in:
        lost = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(lost, F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.withColumn("word", F.when(lost % lose_one_in == 0, cut).otherwise(F.col("word"))).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def _prefixes(words: DataFrame) -> DataFrame:
    """id, d, node, ch: for each d the hash of the first d code points of the word with this id, and the next one (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in chain.from_iterable(pieces_of(x, 4096) for x in batches):
            own = batch.column("word").to_pylist()
            code = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32)
            size = np.array([len(w) for w in own])
            row = np.repeat(np.arange(len(own)), size + 1)
            depth = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
            begin = (np.cumsum(size) - size)[row]
            node = span_hashes(code, begin, begin + depth, powers).view(np.int64)
            ch = np.where(depth < size[row], np.r_[code, 0].astype(np.int32)[begin + depth], -1)
            ids = batch.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids, pa.array(depth, pa.int32()), pa.array(node), pa.array(ch, pa.int32())], ["id", "d", "node", "ch"])

    return in_arrow(words.select("id", "word"), run, "id long, d int, node long, ch int")


def light_places(words: DataFrame) -> DataFrame:
    """id, d, ch, heavy: where the word ``id`` leaves the heavy paths: after its
    first d code points it goes on with ``ch`` (-1: ends) and most words with ``heavy``.

    Two prefixes of one hash would share a heavy child, which changes what is light
    but no result. Children of more than a thousandth of all prefixes are joined apart."""
    rows = _prefixes(words).withColumn("edge", F.struct("node", "ch"))
    edges = rows.groupBy("edge").agg(F.count("*").alias("below")).checkpoint()
    goes_on = F.col("edge.ch") >= 0
    by_node = edges.groupBy(F.col("edge.node").alias("node")).agg(F.count("*").alias("children"), F.max(F.when(goes_on, F.struct("below", (-F.col("edge.ch")).alias("minus")))).alias("top"))
    by_node = by_node.where("children > 1 and top is not null").select("node", (-F.col("top.minus")).alias("heavy"))
    light = edges.join(by_node, F.col("edge.node") == F.col("node")).where("edge.ch <> heavy").select("edge", "below", "heavy").checkpoint()
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    return join_one_row(rows.select("id", "d", "edge"), light, "edge", "below", total, "inner").select("id", "d", F.col("edge.ch").alias("ch"), "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of minus n and word: the near word of largest n,
    ties to the smaller one) of each of ``words`` (id, word, n; all different) that
    has a near word, one with exactly one character inserted, deleted or replaced.

    Of two such words the light one, or both, are entered with the error at the node
    where they part. What the heavy character makes of the light word and what
    skipping makes of it are looked up among the words; light words that differ in
    the replaced character meet in a group, one for each character at most."""
    light = light_places(words).join(words, "id").select("id", "word", "n", "d", "ch", "heavy").checkpoint()
    head, tail, rest = F.substr("word", F.lit(1), F.col("d")), F.substr("word", F.col("d") + 2), F.substr("word", F.col("d") + 1)
    goes_on, heavy = F.col("ch") >= 0, F.chr("heavy")
    # a skipped character that comes twice is skipped where it comes last
    once = F.substr("word", F.col("d") + 2, F.lit(1)) != F.substr("word", F.col("d") + 1, F.lit(1))
    tried = F.array_compact(
        F.array(
            F.concat(head, heavy, rest),
            F.when(goes_on, F.concat(head, heavy, tail)),
            F.when(goes_on & once, F.concat(head, tail)),
        )
    )
    pairs = light.select("id", F.explode(tried).alias("other")).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    pairs = pairs.join(words, "id").select("word", "n", "other", "other_n")
    one = lambda word, n, other: pairs.select(F.col(word).alias("word"), F.lit(1).alias("k"), F.struct((-F.col(n)).alias("minus_n"), F.col(other).alias("word")).alias("best"))
    group = light.where(goes_on).groupBy("d", F.concat(head, tail).alias("left")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "word"))).alias("m")).where(F.size("m") > 1)
    met = group.select(F.posexplode("m").alias("at", "own"), "m").select("own.word", (F.size("m") - 1).alias("k"), F.when(F.col("at") == 0, F.get("m", F.lit(1))).otherwise(F.get("m", F.lit(0))).alias("best"))
    found = one("word", "other_n", "other").unionByName(one("other", "n", "word")).unionByName(met)
    return found.groupBy("word").agg(F.sum("k").cast("long").alias("n_near"), F.min("best").alias("best"))


def spelling_groups(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of each of ``words`` (word, n; all different).

    ``form`` is the near word of largest n (ties: the smallest by code points) if it
    occurs ``times`` times as often as the word or more, else null; ``root`` is the
    last word that forms lead to. A step multiplies n by ``times``, so the rounds
    that follow them, doubling their reach, are few. An empty table gives an empty one."""
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word", "n", F.monotonically_increasing_id().alias("id")).checkpoint()
    known = words.drop("id").join(near_words(words), "word", "left")
    often = -F.col("best.minus_n") >= F.col("n") * times
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.minus_n")).alias("form_n")).checkpoint()
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return known.join(roots.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
