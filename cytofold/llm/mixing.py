"""A mix of sources in stated shares, drawn by blocks of words.

The words of each source, documents in a pseudorandom order, are packed into
blocks of a fixed length. The mix is a row of slots, one for each drawn block,
cut into output shards; the slots of a shard draw their sources (a multinomial
count for each source and shard), and the j-th slot of a source takes the block
to which a pseudorandom permutation of the source's block numbers maps j. Slots
beyond a source's number of draws, which its target sets, go to sources that
drew too few, so that every source gets exactly its draws. Everything is
DataFrame expressions, grouped sums and joins on small keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytofold.operators.graph import ensure_checkpoint_dir, join_one_row

WORD = "[^\\x20\\x09-\\x0D]+"
#: Copies of one row that are packed together; more are dealt to several orders.
COPIES = 1_000
#: Documents (or dealt copies) whose places are numbered in one window.
BUCKET = 2_000
#: Rounds of the permutation.
ROUNDS = 12
#: Resolution of the draws.
UNIT = 1 << 40


def sized(docs: DataFrame) -> DataFrame:
    """source_key, source, doc_id, text_hash, size (words of the text, null: 0), n:
    the rows of ``docs``, equal ones together. The key is the source, never null."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select(key.alias("source_key"), "source", "doc_id", F.xxhash64("text").alias("text_hash"), size.alias("size"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source_key, source_no, n_rows, source_size, target of each source of ``sized`` rows.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum
    of all sizes; no target is above ``most`` times its source's size, and what
    lies above is shared anew by weight until none is. One row a source; a round
    is a grouped sum, and each but the last stops at least one source."""
    per = sizes.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_rows"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1
    table = F.array(*(F.lit(float(w)) for w in weights))
    now = per.withColumn("source_no", turn).withColumn("weight", F.element_at(table, (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))).drop("source").checkpoint()
    total = now.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0  # words for a weight of 1; a source whose share lies above its cap has its cap
    while True:
        free = F.col("weight") * F.lit(level) <= cap
        row = now.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, cap)).alias("c")).first()
        new = (total - (row["c"] or 0.0)) / row["w"] if row["w"] else level
        if new <= level:
            break
        level = new
    return now.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight")


def placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The rows of ``sizes`` with their source's number, size and target, in lots of
    COPIES equal rows at most (``n``, numbered by ``part``), with the place of their
    first word in the source's order: the sum of all lengths before it. Lengths are
    summed by buckets of the order first, so no window holds a whole source."""
    n_rows = sources.agg(F.sum("n_rows")).first()[0] or 0
    rows = join_one_row(sizes.drop("source"), sources, "source_key", "n_rows", n_rows, "inner").drop("source_key", "n_rows")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES))
    order = F.xxhash64("doc_id", "text_hash", "size", "part", F.lit(seed))
    rows = rows.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(max(1, n_rows // BUCKET)))).withColumn("length", F.col("size") * F.col("n"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("source_no", "bucket").agg(F.sum("length").alias("words"))
    start = start.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("order", "doc_id", "text_hash", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    rows = rows.join(start, ["source_no", "bucket"]).withColumn("offset", F.col("start") + F.col("inside"))
    return rows.select("source_no", "source_size", "target", "doc_id", "text_hash", "size", "part", "n", "offset")


def copies_of(rows: DataFrame) -> DataFrame:
    """One row for each row of the documents, numbered by ``copy`` among its equals."""
    each = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return each.withColumn("copy", F.col("part") * COPIES + F.col("k")).withColumn("offset", F.col("offset") + F.col("k") * F.col("size")).drop("k", "part", "n")


def packed(copies: DataFrame, block: int) -> DataFrame:
    """source_no, block, doc_id, text_hash, size, copy, at (place of its first word in the source's order), start, end: the words of each block, as ranges of words of documents."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    blocks = copies.where("size > 0").select("*", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("offset"))
    end = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("offset"))
    return blocks.select("source_no", "block", "doc_id", "text_hash", "size", "copy", F.col("offset").alias("at"), start.alias("start"), end.alias("end"))


def _found(points: DataFrame, x: Column, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """``points`` joined with the one row of ``ranges`` whose [low, high) holds x
    (an integer). Ranges are cut into cells of ``width``, so that a wide range is met by many keys."""
    cells = ranges.where(F.col(high) > F.col(low)).select("*", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))).alias("cell"))
    points = points.withColumn("x", x).withColumn("cell", F.floor(F.col("x") / width))
    return points.join(cells, "cell").where((F.col("x") >= F.col(low)) & (F.col("x") < F.col(high))).drop("cell", "x", low, high)


def _uniform(below: Column | int, *of: Column) -> Column:
    """A pseudorandom integer in [0, below)."""
    return F.pmod(F.xxhash64(*of), F.lit(below) if isinstance(below, int) else below)


def _permuted(index: Column, size: Column, *key: Column) -> Column:
    """The image of ``index`` under a permutation of 0..size-1 that ``key`` chooses.
    In each round the indexes x and r - x (modulo size) are swapped or not, by a bit
    that both of them share; so it is one to one for any size."""
    own = F.xxhash64(*key)

    def swapped(x: Column, k: Column) -> Column:
        other = F.pmod(_uniform(size, own, k) - x, size)
        return F.when(_uniform(2, own, -k - 1, F.greatest(x, other)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), index, swapped)


def drawn(sources: DataFrame, seed: int, shard_slots: int) -> DataFrame:
    """shard, slot, source_no, block: what each slot takes.

    ``sources``: source_no, draws, n_blocks. The slot's hash draws a source with a
    probability in proportion to its draws; counts by shard and source are
    multinomial. Their running sums over the shards number the slots of each source;
    numbers beyond its draws are dealt in order to the sources short of draws."""
    spark = sources.sparkSession
    running = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(running), F.lit(0))
    n_slots = sources.agg(F.sum("draws")).first()[0] or 0
    ranges = sources.withColumn("low", upto(F.col("draws"))).withColumn("high", F.col("low") + F.col("draws"))
    scale = lambda c: F.floor(F.col(c) / F.lit(max(1, n_slots)) * F.lit(UNIT))
    ranges = ranges.select("source_no", scale("low").alias("low"), scale("high").alias("high"))
    shard = F.floor(F.col("id") / shard_slots)
    slots = spark.range(n_slots).select(shard.alias("shard"), (F.col("id") - shard * shard_slots).alias("slot"))
    draw = _found(slots, _uniform(UNIT, F.lit(seed), F.col("shard"), F.col("slot")), ranges, "low", "high", max(1, UNIT * 1_000 // max(1, n_slots)))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = draw.groupBy("source_no", "shard").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).checkpoint()
    # sources over and short of their draws; both sums are the same
    drew = sources.select("source_no", "draws", "n_blocks").join(counts.groupBy("source_no").agg(F.sum("n").alias("drew")), "source_no", "left").withColumn("drew", F.coalesce("drew", F.lit(0)))
    over, short = F.greatest(F.lit(0), F.col("drew") - F.col("draws")), F.greatest(F.lit(0), F.col("draws") - F.col("drew"))
    drew = drew.withColumn("over_before", upto(over)).withColumn("short_before", upto(short)).checkpoint()
    nth = F.row_number().over(Window.partitionBy("source_no", "shard").orderBy("slot")) - 1
    own = draw.withColumn("nth", nth).join(counts.drop("n").join(drew, "source_no"), ["source_no", "shard"]).withColumn("j", F.col("first") + F.col("nth"))
    kept = own.where("j < draws").select("shard", "slot", "source_no", "j", "n_blocks")
    moved = own.where("j >= draws").select("shard", "slot", (F.col("over_before") + F.col("j") - F.col("draws")).alias("rank"))
    gaps = drew.select("source_no", "n_blocks", "drew", "short_before", F.col("short_before").alias("low"), (F.col("short_before") + short).alias("high"))
    moved = _found(moved, F.col("rank"), gaps, "low", "high", 1_000)
    moved = moved.select("shard", "slot", "source_no", (F.col("drew") + F.col("rank") - F.col("short_before")).alias("j"), "n_blocks")
    epoch = F.floor(F.col("j") / F.col("n_blocks"))
    block = _permuted(F.pmod("j", "n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), epoch)
    return kept.unionByName(moved).select("shard", "slot", "source_no", block.alias("block"))


class Mix:
    """sources: one row a source, with its target, blocks and draws. copies: one row
    a document. spans: shard, slot, source_no, block, doc_id, text_hash, size, copy,
    start, end: the words that each slot of the mix takes."""

    def __init__(self, sources: DataFrame, copies: DataFrame, spans: DataFrame) -> None:
        self.sources, self.copies, self.spans = sources, copies, spans

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document; ``taken`` counts its words as often as the mix takes them."""
        keys = ["source_no", "doc_id", "text_hash", "size", "copy"]
        own = self.copies.select(*keys, "source_size", "target", F.lit(0).cast("long").alias("words"))
        drawn_ = self.spans.select(*keys, F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), (F.col("end") - F.col("start")).alias("words"))
        sums = own.unionByName(drawn_).groupBy(*keys).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("words").alias("taken"))
        return sums.select("doc_id", "size", "source_size", "target", "taken")

    def texts(self, docs: DataFrame) -> DataFrame:
        """shard, slot, source_no, text: the words of each slot, joined by one space. A block holds few documents, so the groups are small."""
        rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), F.regexp_extract_all("text", F.lit(f"({WORD})")).alias("words")).dropDuplicates(["id", "text_hash"])
        own = self.spans.join(rows, (self.spans["text_hash"] == rows["text_hash"]) & self.spans["doc_id"].eqNullSafe(rows["id"])).drop(rows["text_hash"])
        words = F.slice("words", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
        parts = own.select("shard", "slot", "source_no", F.struct("at", words.alias("w")).alias("part"))
        return parts.groupBy("shard", "slot", "source_no").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["w"])), " ").alias("text"))


def mix(docs: DataFrame, block: int = 32, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 12, shard_slots: int = 1 << 16) -> Mix:
    """The mix of ``docs`` (doc_id, text, source; other columns are not read).

    A source of b blocks and size s is drawn round(target / s * b) times, all its
    blocks before any of them again; so its taken words differ from the target by a
    block or two, and no document gives more than ``most`` times its words. Texts
    null or without words have size 0 and give nothing; equal rows are copies of
    their own; null doc_ids and sources stay. All is chosen by hashes of the rows,
    so reruns agree however the table is cut. An empty table gives an empty mix."""
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = sized(docs).checkpoint()
    sources = source_targets(sizes, weights, most)
    n_blocks = F.ceil(F.col("source_size") / block)
    draws = F.least(F.floor(F.try_divide(F.col("target"), F.col("source_size")) * n_blocks + 0.5), n_blocks * most)
    sources = sources.withColumn("n_blocks", n_blocks).withColumn("draws", F.coalesce(F.when(n_blocks > 0, draws), F.lit(0))).checkpoint()
    rows = placed(sizes, sources.drop("n_blocks", "draws"), seed).checkpoint()
    copies = copies_of(rows)
    spans = drawn(sources, seed, shard_slots).join(packed(copies, block), ["source_no", "block"])
    return Mix(sources, copies, spans)
