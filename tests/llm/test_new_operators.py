"""The alignment of tokenizers, the mix of sources and spelling variants against brute force, and their edges."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cytofold.llm import alignment, mixing, queries, spelling
from cytofold.llm.text import written

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, n long, link string, root string"


def docs_of(spark, rows):
    """Rows (doc_id, text, source) with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenizerPair.load(queries.BYTE_MODEL, queries.PIECE_MODEL)


def aligned_plainly(pair, texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) with whole texts encoded by both libraries."""
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(pair.a_json)
    a.encode_special_tokens = True
    _, a_bytes, b, b_bytes = pair.encoders()
    found, holds = [], Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ends = []
        for ids, of in ((x, a_bytes), (y, b_bytes)):
            at, own = 0, []
            for k in ids:
                own.append((at, at + len(of[k]), k))
                at += len(of[k])
            ends.append(own)
        if not text or any(b"".join(of[k] for k in ids) != (" " + text).encode() for ids, of in ((x, a_bytes), (y, b_bytes))):
            found.append(None)
            continue
        both = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups, links, before = [], [], 0
        for end in both:
            own = [[t for t in side if before <= t[0] and t[1] <= end] for side in ends]
            groups.append("|".join(",".join(str(k) for *_, k in side) for side in own))
            links += [(p[2], q[2]) for p in own[0] for q in own[1] if p[0] < q[1] and q[0] < p[1]]
            before = end
        holds.update(set(links))
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (p, _), n in holds.items():
        most[p] = max(most[p], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(holds[k] == most[k[0]] for k in r[3]), sum(holds[k] for k in r[3]), r[4])
        for r in found
    ]


TRICKY = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "one two\nthree\t four\n\n five ", "<|endoftext|> and <s></s><unk>", "it's 12,345.67 №5 — naïve café",
    "▁odd▁", "x ▁y z", "日本語 テキスト 中文", "🙂🙃 ok", " no break here", "a\u001cb c", "same words same words same", "same words same words same", "é ö", "w" * 300 + " end", "\r\n \r\n x",
]
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_rows(docs, pair, frequent):
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    aligned = written(alignment.align(docs, pair).withColumn("groups_sha256", digest).drop("groups"))
    done = alignment.with_counts(aligned, alignment.link_counts(aligned), frequent)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in MEASURES)) for r in done.collect())


@pytest.mark.parametrize("frequent", [1 << 18, 20, 0])
def test_alignment_equals_whole_texts(spark, pair, frequent):
    texts = TRICKY + [r.text for r in table(spark).orderBy("doc_id").limit(40).collect()]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    rows += [rows[8], (None, "no id", "s")]
    plain = aligned_plainly(pair, [t for _, t, _ in rows])
    expected = sorted((r[0] is None, r[0] or 0, *p) for r, p in zip(rows, plain, strict=True))
    assert align_rows(docs_of(spark, rows).repartition(5), pair, frequent) == expected


def test_alignment_of_long_texts_in_parts(spark, pair, monkeypatch):
    # slices of 50 characters, in this process, give what whole texts give
    texts = [t or "" for t in TRICKY] + [" ".join(["long", "text", "café", "2024,"] * 40), "good words " * 20 + "▁ bad " + "more words " * 20]
    whole = aligned_plainly(pair, texts)
    monkeypatch.setattr(alignment, "SLICE", 50)
    links, groups, fine = defaultdict(list), defaultdict(list), defaultdict(lambda: True)
    for part, _ in alignment._slices(texts):
        units, places, starts = alignment._taken(pair, part)
        row, link, times = alignment._linked(units, places, starts)
        for k, (r, _) in enumerate(part):
            stop = starts[k + 1] if k + 1 < len(starts) else len(places)
            fine[r] &= bool(units.ok[places[starts[k] : stop]].all())
            links[r].append((link[row == k], times[row == k]))
            groups[r] += [units.groups[u] for u in places[starts[k] : stop]]
    for r, expected in enumerate(whole):
        good = groups[r] and fine[r]
        assert (hashlib.sha256("".join(groups[r])[:-1].encode()).hexdigest() if good else "") == expected[-1], texts[r]
        link, times = alignment._added(links[r] if good else [])
        assert times.sum() == expected[3] and len(set(link.tolist())) == len(link)


def test_alignment_of_nothing(spark, pair):
    assert align_rows(docs_of(spark, [(0, "x", "s")]).where("false"), pair, 5) == []
    assert align_rows(docs_of(spark, [(0, None, None), (1, "", None)]), pair, 5) == [(False, k, 0, 0, 0, 0, 0, 0, "") for k in (0, 1)]


# mix


def targets_plainly(size_of):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [s for s in size_of if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    stopped = set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = sum(size_of.values()) - sum(3 * size_of[s] for s in stopped)
        target = {s: 3 * size_of[s] if s in stopped else rest * weight[s] / sum(weight[t] for t in free) for s in names}
        above = {s for s in free if target[s] > 3 * size_of[s]}
        if not above:
            return target
        stopped |= above


def check_mix(docs, block=32):
    rows = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    of_source = defaultdict(int)
    for r in rows:
        of_source[r.source] += size(r.text)
    target = targets_plainly(of_source)
    found = mixing.mix(docs, block=block, shard_slots=64).taken().collect()
    mine = Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in found)
    assert mine == Counter((r.doc_id, size(r.text), of_source[r.source], round(target[r.source], 6)) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in found)
    return rows, found, target


def test_mix_of_documents(spark):
    docs = table(spark)
    rows, found, target = check_mix(docs)
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in found:
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 64 for s, t in target.items())
    again = mixing.mix(docs.repartition(7), shard_slots=64).taken().collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, found))
    assert sorted(map(key, mixing.mix(docs, seed=5, shard_slots=64).taken().collect())) != sorted(map(key, found))


def test_mix_with_a_hot_source_nulls_and_copies(spark):
    rows = [(k, f"word{k} " * (k % 7 * 3), "hot") for k in range(300)]
    rows += [(None, "the same row", "hot")] * 2500 + [(k, "a\tb\x0bc d e", None) for k in range(20)]
    rows += [(900, None, "only null"), (901, "", "z"), (902, "tiny", "z"), (903, "x " * 5000, "é"), (904, "x " * 400, "Z")]
    docs = docs_of(spark, rows)
    _, found, target = check_mix(docs, block=8)
    assert sum(r.taken for r in found if r.doc_id == 902) == 3  # its target is three times its size
    assert abs(sum(r.taken for r in found if r.doc_id is None or r.doc_id < 300 and r.source_size > 8000) - target["hot"]) <= 16
    copies = [r.taken for r in found if r.doc_id is None]
    assert len(copies) == 2500 and len(set(copies)) > 1


def test_mix_of_nothing(spark):
    docs = docs_of(spark, [(1, "x", "s")])
    assert mixing.mix(docs.where("false")).taken().collect() == []
    none = mixing.mix(docs_of(spark, [(1, None, None), (2, " ", "s")])).taken().collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in none) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_permutation_and_slots(spark):
    sizes = [1, 2, 3, 10, 997]
    df = spark.createDataFrame([(n, k, e) for n in sizes for e in range(2) for k in range(n)], "n long, k long, e long")
    image = df.select("n", "e", "k", mixing._permuted(F.col("k"), F.col("n"), F.col("e")).alias("to")).collect()
    for n in sizes:
        own = [[r.to for r in sorted(image, key=lambda r: r.k) if (r.n, r.e) == (n, e)] for e in range(2)]
        assert all(sorted(o) == list(range(n)) for o in own)
    assert own[0] != own[1] and own[0] != list(range(997))
    made = mixing.mix(table(spark), shard_slots=64)
    drawn = mixing.drawn(made.sources, 12, 64).collect()
    of_source = defaultdict(Counter)
    for r in drawn:
        of_source[r.source_no][r.block] += 1
    for s in made.sources.collect():
        own = of_source[s.source_no]
        assert sum(own.values()) == s.draws and (not own or max(own.values()) - min([own[b] for b in range(s.n_blocks)]) <= 1)
    assert len({(r.shard, r.slot) for r in drawn}) == len(drawn)
    shards = Counter(r.shard for r in drawn if r.source_no == 1)
    assert len(set(shards.values())) > 1  # counts of a shard are drawn


def test_mix_texts_are_the_words(spark):
    docs = table(spark)
    made = mixing.mix(docs, block=16, shard_slots=64)
    texts = {(r.shard, r.slot): r.text for r in made.texts(docs).collect()}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in docs.collect()}
    own = defaultdict(list)
    for r in made.spans.collect():
        own[r.shard, r.slot].append((r.at, words[r.doc_id][r.start : r.end]))
    assert texts == {k: " ".join(w for _, part in sorted(v) for w in part) for k, v in own.items()}
    assert max(len(t.split(" ")) for t in texts.values()) == 16


# spelling


def counted_plainly(rows, shortest=7, fewest=2):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}


def grouped_plainly(n, letters):
    found = {}
    for w in n:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near = [v for v in near if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        found[w] = (len(near), best if best is not None and n[best] >= 10 * n[w] else None)
    result = []
    for w, (k, form) in found.items():
        root = w
        while found[root][1]:
            root = found[root][1]
        result.append((w, n[w], k, form, None if form is None else n[form], root))
    return sorted(result, key=repr)


def spelled(words):
    done = spelling.spelling_groups(words)
    assert done.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    return sorted(map(tuple, done.collect()), key=repr)


def test_spelling_equals_brute_force(spark):
    rows = [tuple(r) for r in table(spark).select("doc_id", "text").collect()]
    n = counted_plainly(rows)
    expected = grouped_plainly(n, sorted({c for w in n for c in w}))
    assert sum(r[2] > 0 for r in expected) > 50
    assert sorted(map(tuple, queries.op13_spelling(spark, SF).collect()), key=repr) == expected


@pytest.mark.parametrize("seed", range(4))
def test_spelling_of_random_words(spark, seed):
    import random

    draw = random.Random(seed)
    letters = "ab" if seed % 2 else "abcé"
    n = {"".join(draw.choice(letters) for _ in range(draw.randrange(0, 9))): draw.choice([1, 2, 10, 30, 300, 5000]) for _ in range(400)}
    assert spelled(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)) == grouped_plainly(n, letters)


def test_spelling_counts_and_edges(spark):
    rows = [(k, "Straße STRASSEN naïveté ×÷×÷×÷× Überall überall überall_x a" + "b" * 9, "s") for k in range(40)] + [(None, None, None), (None, "", "s"), (None, "Wörter WÖRTER Wörters", "s")]
    rows += rows[:3]
    words = spelling.word_counts(docs_of(spark, rows))
    assert {r.word: r.n for r in words.collect()} == counted_plainly(rows)
    assert spelled(words.where("false")) == []
    long = "ab" * 5000
    n = {long: 50, long + "a": 3, long[:4000] + "x" + long[4001:]: 4, long[1:]: 2, "ordinary": 7}
    got = {r[0]: r[1:] for r in spelled(spark.createDataFrame(list(n.items()), "word string, n long"))}
    assert got[long] == (50, 3, None, None, long) and got[long + "a"][2:] == (long, 50, long) and got["ordinary"][1] == 0


def test_forms_lead_to_a_root(spark):
    n = {"abcdefg": 100_000, "abcdefgh": 9_000, "abcdefghi": 800, "abcdefghij": 70, "abcdefghijk": 6, "bcdefgh": 9_000}
    got = {r[0]: r for r in spelled(spark.createDataFrame(list(n.items()), "word string, n long"))}
    assert got["abcdefghijk"][3:] == ("abcdefghij", 70, "abcdefg")
    assert spelled(spark.createDataFrame(list(n.items()), "word string, n long")) == grouped_plainly(n, "abcdefghijk")
