"""Corpus operators against brute force, on small tables with awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from cytofold.llm import decontam, html_text, langid, quality, secret_scan, simhash, suffix_dedup, toxicity
from cytofold.llm import queries as Q
from tests.oracle import check

SF = "/root/testdata/sf0.001"
WORDS = "the quick brown fox jumps over lazy dogs while seven wizards box every cold morning near old harbour walls".split()


def awkward_rows(seed=1):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [text(rng.randint(1, 80)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t) for k, t in enumerate(base[:10])]  # copies
    rows += [(200 + k, t + " extra") for k, t in enumerate(base[:10])]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "\x01\x02 token=abcdef\x01"), (304, "été 😀 " * 30), (305, text(6000)), (305, text(3)), (0, base[0]), (None, base[1]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, 7) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double, fp long")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


# --- toxicity ---


def test_fold_and_matches():
    model = toxicity.ToxicityModel({"idiot$": 5.0, "stup": 4.0, "trash$": 3.0}, (-1.0, 1.0, 1.0))
    found = lambda t: [w for *_, w in model.matches(toxicity.fold(t))]
    assert found("an 1D10T") == [5.0] and found("an Id10t!") == [5.0]  # at the edges of a word too
    assert [toxicity.fold(x) for x in ("1diot", "@sshole", "a55", "5TUP1D!", "7 of 10", "$50", "b4")] == ["idiot", "asshole", "ass", "stupid!", "7 of 10", "$50", "ba"]
    assert found("stupidity") == [4.0] and found("unstupid") == []
    assert found("іdіоt") == [5.0]  # Cyrillic letters
    assert found("idiots") == []
    assert found("a trash can") == [] and found("trash cans, trash") == [3.0, 3.0]
    assert 0 <= model.score("") < 0.5 < model.score("idiot stupid trash idiot")


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = [rng.choice(WORDS) for _ in range(40)] + ([rng.choice(["grobian", "lumpaxx", "lumpazz"]) for _ in range(3)] if bad else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, labels(spark, marks))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(out[k].held_out == is_held_out(k) for k in out)
    assert all(out[k].predicted == y for k, _, y in marks)
    assert toxicity.drop_toxic(docs, model).count() == sum(1 - y for *_, y in marks)


def test_exceptions_are_learned_from_clean_rows(spark):
    rng = random.Random(13)
    rows, marks = [], []
    for k in range(800):
        bad, fish = k % 4 == 0, k % 20 == 1  # a twentieth of the rows, all clean
        words = [rng.choice(WORDS) for _ in range(30)] + ["clownish fool"] * (2 * bad) + ["clownish wrasse"] * fish
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks), purity=0.85)
    assert "clownish wrasse" in model.exceptions and "clownish fool" not in model.exceptions
    assert model.score("the clownish fool") > 0.5 > model.score("a clownish wrasse over the walls")


def slow_matches(model, folded):
    """Entries place by place: at each start the heaviest that fits, outside exception phrases."""
    whole = lambda a, b: (not a or not folded[a - 1].isalnum()) and (b == len(folded) or not folded[b].isalpha())
    harmless = []
    for phrase in map(toxicity.fold, model.exceptions):
        harmless += [(a, a + len(phrase)) for a in range(len(folded)) if folded.startswith(phrase, a) and whole(a, a + len(phrase))]
    out = []
    for a in range(len(folded)):
        if a and folded[a - 1].isalnum():
            continue
        fits = [(w, a + len(e.rstrip("$"))) for e, w in model.weights.items() if folded.startswith(e.rstrip("$"), a) and (e[-1] != "$" or whole(a, a + len(e) - 1))]
        if fits:
            weight = max(w for w, _ in fits)
            ends = [b for w, b in fits if w == weight]
            if not any(x <= a and b <= y for x, y in harmless for b in ends):
                out.append((a, weight))
    return out


def test_matches_against_brute_force():
    rng = random.Random(17)
    weights = {"idio": 3.5, "idiot$": 5.0, "mor": 1.5, "moron$": 4.0, "scum$": 2.0, "trash$": 3.0, "tra": 0.5}
    model = toxicity.ToxicityModel(weights, (-1.0, 1.0, 1.0), ("trash can", "pond scum", "not an idiot"))
    bits = ["idiot", "Idi0t", "m0ron", "morons", "scum", "pond", "trash", "can", "not", "an", "tra", "x", "5cum", ".", "-", "é"]
    for _ in range(400):
        folded = toxicity.fold("".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 14))))
        assert [(a, w) for a, _, w in model.matches(folded)] == slow_matches(model, folded)


def test_matches_within_phrases_by_one_sweep():
    rng = random.Random(8)
    words = ["damn", "dam", "big", "bigger", "fool", "proof"]
    phrases = ("damn big", "big fool", "fool proof dam", "bigger")
    model = toxicity.ToxicityModel({"dam": 1.0, "damn$": 2.0, "fool": 1.5, "big": 0.5}, (0.0, 1.0, 1.0), phrases)
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        inside = [(m.start(), m.start() + len(p)) for p in phrases for m in re.finditer(rf"(?=\b{p}\b)", text)]
        want = []
        for m in re.finditer(r"\w+", text):
            uses = [(w, len(e.rstrip("$"))) for e, w in model.weights.items() if (m[0] == e[:-1] if e.endswith("$") else m[0].startswith(e))]
            if uses:
                weight, size = max(uses)
                if not any(a <= m.start() and m.start() + size <= b for a, b in inside):
                    want.append((m.start(), m.start() + size, weight))
        assert model.matches(text) == want


def test_scoring_takes_time_in_proportion():
    model = toxicity.ToxicityModel({"fool": 1.5, "dam": 1.0}, (0.0, 1.0, 1.0), ("big fool",))
    took = []
    for n in (50_000, 100_000):
        began = time.process_time()
        model.score("big fool dam " * n)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.5 and took[1] < 20


def test_toxicity_edges(spark, docs):
    model = toxicity.fit_toxicity(docs, labels(spark))
    assert model.weights == {}
    out = toxicity.score_toxicity(docs, model)
    assert out.count() == docs.count() and out.where("predicted <> 0 or score is null").count() == 0
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    assert toxicity.drop_toxic(docs, model).schema == docs.schema


def test_toxicity_model_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(500):
        bad = k % 4 == 0
        words = [rng.choice(WORDS) for _ in range(20)] + ["grobian"] * bad + ["ordinary"] * (k % 20 < 2)  # ordinary: a tenth of either class
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, marks)
    one, many = (toxicity.fit_toxicity(docs.repartition(n), marked) for n in (1, 250))
    assert one.weights == many.weights and not any(x.startswith("ordi") for x in many.weights)
    assert np.allclose(one.curve, many.curve)


# --- SimHash ---


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows, radius=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius and part[a] != part[b]:
                part = [part[b] if p == part[a] else p for p in part]
    low = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            low[p] = min(i, low.get(p, i))
    return sorted(((i, f"{f:016x}", low.get(p)) for (i, _), f, p in zip(rows, fps, part, strict=True)), key=repr)


def test_simhash(spark, docs):
    out = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in out), key=repr) == slow_components(awkward_rows())
    assert simhash.near_duplicates(empty(spark)).count() == 0


def slow_similar(rows, words=5, radius=24, similarity=0.8):
    """(doc_id, component_id) of every row, pair by pair."""
    prints = []
    for _, text in rows:
        tokens = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        tokens = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in tokens]
        shingles = list(dict.fromkeys(b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1)))) if tokens else []
        hashes = [int.from_bytes(xxhash.xxh3_128_digest(x, 42), "little") for x in shingles]
        count = [sum(h >> b & 1 for h in hashes) * 2 for b in range(128)]
        fp = sum(1 << b for b in range(128) if count[b] > len(hashes) or hashes and count[b] == len(hashes) and hashes[0] >> b & 1)
        prints.append((fp, len(hashes)))
    part = list(range(len(rows)))
    for a, (x, m) in enumerate(prints):
        for b, (y, n) in enumerate(prints[:a]):
            if part[a] != part[b] and ((x ^ y).bit_count() <= radius and min(m, n) >= similarity * max(m, n) or (x, m) == (y, n)):
                part = [part[b] if p == part[a] else p for p in part]
    low = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            low[p] = min(i, low.get(p, i))
    return sorted(((i, low.get(p)) for (i, _), p in zip(rows, part, strict=True)), key=repr)


def near_copy_rows(seed=21):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    rows = []
    for k in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        rows.append((k, " ".join(words)))
        for j in range(rng.randint(0, 4)):  # copies with a word in forty or sixty changed
            rows.append((1000 * (j + 1) + k, " ".join(w if rng.random() > rng.choice([0.015, 0.025]) else rng.choice(vocabulary) for w in words)))
    return rows


def test_similar_documents(spark, docs):
    for rows in (awkward_rows(), near_copy_rows()):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in simhash.similar_documents(df).collect()), key=repr) == slow_similar(rows)
    rows = near_copy_rows(22) + [(10_000 + i, t) for i, t in near_copy_rows(23)]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    base = lambda i: i // 10_000 * 10_000 + i % 1000
    near = {i for i in sets if i != base(i) and len(sets[i] & sets[base(i)]) >= 0.8 * len(sets[i] | sets[base(i)])}
    assert {i for i in sets if i == base(i)} <= kept and len(near) > 30 and len(near & kept) <= 0.1 * len(near)
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0 and simhash.drop_near_duplicates(docs).schema == docs.schema


def test_wide_links_span_components():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    near = np.repeat(seeds, 6, axis=0)
    for k in range(8):
        near[:, k % 2] ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    x = np.c_[near, rng.integers(50, 90, len(near)).astype(np.uint64)]
    rng.shuffle(x)
    bits = np.bitwise_count(x[:, None, 0] ^ x[None, :, 0]).astype(int) + np.bitwise_count(x[:, None, 1] ^ x[None, :, 1])
    n = x[:, 2].astype(float)
    link = (bits <= 12) & (np.minimum.outer(n, n) >= 0.8 * np.maximum.outer(n, n) - 1e-9)

    def component(links):
        group = np.arange(len(x))
        for _ in range(len(x)):
            low = np.where(links, group[None, :], len(x)).min(axis=1)
            if (low == group).all():
                return group
            group = np.minimum(low, group)

    mine = np.eye(len(x), dtype=bool)
    half = len(x) // 2
    for a, b, i, j in ((x[:half], None, 0, 0), (x[half:], None, half, half), (x[:half], x[half:], 0, half)):
        p, q = simhash.wide_links(a, b, 12, 0.8)
        assert link[p + i, q + j].all() and len(p) < len(x)
        mine[p + i, q + j] = mine[q + j, p + i] = True
    assert (component(mine) == component(link)).all()


def test_links_span_components_of_random_fingerprints():
    rng = np.random.default_rng(0)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(80))]))
    rng.shuffle(near)
    a, b = near[: len(near) // 2], near[len(near) // 2 :]
    group = {int(x): int(x) for x in near}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    n = 0
    for x, y in (simhash.links_between(a, None, 4), simhash.links_between(b, None, 4), simhash.links_between(a, b, 4)):
        n += len(x)
        for s, d in zip(x.tolist(), y.tolist(), strict=True):
            assert (s ^ d).bit_count() <= 4
            group[root(s)] = root(d)
    assert n <= 3 * len(near)
    for x in near.tolist():
        for y in near.tolist():
            if (x ^ y).bit_count() <= 4:
                assert root(x) == root(y)


# --- secrets ---

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def slow_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def secret_rows():
    rng = random.Random(5)
    bits = ["token", "=", ":", " ", '"', "secret", "API_KEY", "apikey", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "é", "😀", "x", "password", "\x01", "\x02", "a.b", "\n"]
    return [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for k in range(400)] + awkward_rows()


def test_secrets(spark):
    rows = secret_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    model = secret_scan.fit_markov(secret_scan.labelled_samples(docs))
    out = secret_scan.scan_secrets(docs, model).collect()
    want = {}
    for i, t in rows:
        spans = slow_spans(t)
        key = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        counts = tuple(sum(k == n for k, *_ in spans) for n in ("assign", "access", "hex"))
        want.setdefault(i, []).append((*counts, hashlib.sha256(key.encode()).hexdigest()))
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256))
        base = [tuple(x.split(":")) for x in r.spans.split(",") if x and not x.startswith("random")]
        assert hashlib.sha256(",".join(":".join(x) for x in base).encode()).hexdigest() == r.base_sha256
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_random_strings_are_found_and_redacted(spark):
    rng = random.Random(9)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    samples = [("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)), 1) for _ in range(400)]
    samples += [("_".join(rng.choice(WORDS) for _ in range(3)), 0) for _ in range(2000)]
    model = secret_scan.fit_markov(spark.createDataFrame(samples, "string string, label int"))
    text = f"so the_quick_brown_fox_jumps_over_lazy_dogs 😀 {key} end token = 'hunter22x' ok"
    docs = spark.createDataFrame([(1, text, len(text)), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    row = secret_scan.scan_secrets(docs, model).where("doc_id = 1").first()
    assert row.n_random == 1 and f"random:{text.index(key)}:{text.index(key) + 40}" in row.spans
    out = {r.doc_id: r for r in secret_scan.redact_secrets(docs, model).collect()}
    assert out[1].text == text.replace(key, "[SECRET]").replace("hunter22x", "[SECRET]") and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "plain"
    assert secret_scan.fit_markov(spark.createDataFrame([], "string string, label int")).ratio == [0.0] * 16384


def test_redaction_of_overlapping_spans_against_brute_force(spark):
    rng = random.Random(31)
    rows = []
    for k in range(60):
        parts = [rng.choice(["😀 ", "token=", "secret: ", "é" * rng.randint(1, 1500), " ", "AKIA" + "7" * 17, "%032x" % rng.getrandbits(128), "x" * 8]) for _ in range(rng.randint(0, 30))]
        rows.append((k, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.MarkovModel([0.0] * 16384, cut=1.0)
    found = {r.doc_id: sorted((s.inner, s.end) for s in r.base) for r in secret_scan.find_spans(docs, model, ["doc_id"]).collect()}
    marks = 0
    for r in secret_scan.redact_secrets(docs, model).collect():
        text, at, out = rows[r.doc_id][1], 0, ""
        for a, b in found[r.doc_id]:
            if a >= at:
                out += text[at:a] + "[SECRET]"
                marks += 1
            at = max(at, b)
        assert r.text == out + text[at:]
    assert marks > 50


def test_redaction_takes_time_in_proportion(spark):
    model = secret_scan.MarkovModel([0.0] * 16384, cut=0.0, cut_per_char=0.0)
    took = []
    for n in (500, 20_000, 40_000):  # the first run compiles
        text = " ".join(f"token={k:06d}x {'GHJK' * 6}" for k in range(n))
        began = time.perf_counter()
        row = secret_scan.redact_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        took.append(time.perf_counter() - began)
        assert row.text == " ".join(["token=[SECRET] [SECRET]"] * n)
    assert took[2] < 3.2 * took[1] + 1


def test_texts_with_thousands_of_secrets(spark):
    rng = random.Random(10)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(24))
    name = lambda: "".join(rng.choice("GHJKLMNPQRSTUVWXYZ") for _ in range(24))
    text = " ".join(f"token={k:06d}x {hexed()} {name()} AKIA{k:016d}" for k in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    model = secret_scan.MarkovModel([0.0] * 16384, cut=0.0, cut_per_char=0.0)  # every candidate counts
    began = time.perf_counter()
    row = secret_scan.scan_secrets(docs, model).where("doc_id = 1").first()
    assert time.perf_counter() - began < 60
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in slow_spans(text))
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and row.n_random == 4000


def test_markov_tells_random_strings_from_names(spark):
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    name = lambda: "_".join(rng.choice(WORDS) for _ in range(rng.randint(4, 7)))
    model = secret_scan.fit_markov(spark.createDataFrame([(key(32), 1) for _ in range(500)] + [(name(), 0) for _ in range(3000)], "string string, label int"))
    held = [(k, f"see {key(rng.randint(24, 48))} here") for k in range(300)] + [(1000 + k, f"see {name()} here") for k in range(300)]
    out = {r.doc_id: r.n_random for r in secret_scan.scan_secrets(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert sum(out[k] for k in range(300)) >= 294 and sum(out[1000 + k] for k in range(300)) <= 3


def test_samples_of_a_small_table(spark):
    docs = spark.createDataFrame([(1, "token = 'a8Fk29sLq0Zx71mPw3Rt' in the ordinary settings"), (2, "ordinary words again")], "doc_id long, text string")
    assert {r.label for r in secret_scan.labelled_samples(docs).collect()} == {0, 1}


# --- language ---


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.predict_language(docs, langid.fit_language(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in out.collect())


def test_language_edges(spark, docs):
    model = langid.fit_language(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(docs, model).collect()}
    assert got[300] == got[301] == got[302] == "und" and got[304] == "en"
    assert langid.fit_language(empty(spark)).predict("words") == ("und", 0.0)
    assert model.predict("123 ... !") == ("und", 0.0)


def slow_language(train, texts):
    """Naive Bayes n-gram by n-gram; (best, share) of each text."""

    def grams(text):
        marked = re.sub(r"[\x00-\U0010ffff]", lambda m: m[0] if m[0].isalpha() and (m[0] >= "\x80" or "a" <= m[0] <= "z") else "\0", f" {text.lower()} ")
        marked = re.sub("\0+", "\0", marked)
        out = [(marked[k : k + n], n) for n in (1, 2, 3) for k in range(len(marked) - n + 1)]
        return [g for g, n in out if "\0" not in g[1:-1] and g not in ("\0", "\0\0")]

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram):
            h = (h * 0x1000003D + ord(c.replace("\0", chr(0))) + k + 1) % (1 << 64)
        return int(langid.mix(np.array([h], np.uint64))[0] % langid.BUCKETS)

    counts = {}
    for text, lang in train:
        for g in grams(text):
            own = counts.setdefault(lang, {})
            own[bucket(g)] = own.get(bucket(g), 0) + 1
    size = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    prior = {x: math.log(sum(y == x for _, y in train) / len(train)) for x in counts}
    out = []
    for text in texts:
        found = grams(text or "")
        total = {x: prior[x] + sum(math.log((counts[x].get(bucket(g), 0) + 0.5) / size[x]) for g in found) for x in sorted(counts)}
        best = max(total, key=lambda x: total[x])
        scale = max(1, math.sqrt(len(found)))
        share = sum(math.exp((v - total[best]) / scale) for v in total.values())
        out.append((best, 1 / share) if found else ("und", 0.0))
    return out


def test_language_against_brute_force(spark):
    rng = random.Random(14)
    sounds = {f"l{k}": [rng.choice("abcdeéñß") + rng.choice("mnrst") for _ in range(6)] for k in range(7)}
    make = lambda x: " ".join("".join(rng.choice(sounds[x]) for _ in range(3)) for _ in range(rng.randint(1, 9)))
    rows = [(k, make(x), x) for k in range(140) for x in [f"l{min(6, k % 9)}"]]
    rows += [(200, None, "l1"), (201, "42 + 1", "l2"), (202, "ÀB c", None), (None, make("l3"), None), (203, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t, x) for i, t, x in rows if x and t is not None and not is_held_out(i)]
    want = slow_language(train, [t for _, t, _ in rows])
    model = langid.fit_language(docs)
    for block in (256, 3, 1):  # all languages at once, and in steps
        out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_language(docs, model, block).collect()}
        assert len(out) == len(rows)
        for (i, _, _), (lang, score) in zip(rows, want, strict=True):
            assert out[i][0] == lang and abs(out[i][1] - score) < 1e-4


def test_rare_languages_and_very_long_texts(spark):
    rng = random.Random(15)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(12)), "en") for k in range(1000)]
    rows += [(2000 + k, " ".join(rng.choice(["zvq", "qzw", "vvzq"]) for _ in range(12)), "rare") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_language(docs, max_train=50)
    assert [r.lang_pred for r in langid.predict_language(docs, model).where("doc_id >= 2000").collect()] == ["rare"] * 8
    long = " ".join(rng.choice(WORDS) for _ in range(20_000))
    one, many = langid.Grams([long], piece=1 << 30), langid.Grams([long], piece=1000)
    assert (one.bucket == many.bucket).all() and (one.count == many.count).all() and model.predict(long)[0] == "en"


# --- suffix dedup ---


def slow_removal(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out[i] = (len(data), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_transform_and_prefixes():
    rng = random.Random(4)
    for alphabet in (b"ab", bytes(range(256))):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(30)] + [b"aaaa", b"aaaa"]
        longer, lcp = suffix_dedup.build(strings)
        suffixes = [b""] * len(lcp)
        for rank, s in enumerate(strings):
            for k in range(1, len(s) + 1):
                rank = longer[rank]
                suffixes[rank] = s[len(s) - k :]
            assert longer[rank] == -1
        assert suffixes == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1 : k + 1]
            same = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
            assert lcp[k] == same


@pytest.mark.parametrize("share_rows", [None, 2])
def test_suffix_dedup(spark, share_rows):
    rng = random.Random(6)
    phrases = ["a b c d e f g h i j k l m n o p q r s t u v w x y z ", "été " * 40, "xyz" * 50, "".join(rng.choice("abcdefgh ") for _ in range(150))]
    rows = [(k, "".join(rng.choice(phrases) + str(rng.random())[2:8] for _ in range(rng.randint(1, 9)))) for k in range(60)]
    rows += [(100, "q" * 900), (101, "ab" * 400), (102, rows[3][1]), (103, ""), (104, "short")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed int")
    out = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, 100, share_rows).collect()}
    assert out == slow_removal(rows, 100)


def test_suffix_dedup_edges(spark, docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.count() == docs.count() and out.where("n_removed < 0 or n_removed > n_bytes").count() == 0
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_suffix_dedup_of_one_id_with_two_texts(spark, few):
    rng = random.Random(7)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (2, b), (5, a), (5, f"zz {b} yy"), (5, a), (6, f"zz {b} yy"), (None, a)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast=few).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in out if r.doc_id)
    assert got == [(1, 400, 0, 0), (2, 400, 0, 0), (5, 400, 400, 1), (5, 400, 400, 1), (5, 406, 400, 1), (6, 406, 406, 1)]
    assert [r.n_removed for r in out if r.doc_id is None] == [0]


def test_suffix_dedup_of_hot_stretches(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(160))
    rows = [(k, str(rng.random()) * 3 + line[rng.randint(0, 9) :] + str(rng.random())) for k in range(150)]
    h, share, doc, place = suffix_dedup._dealt(np.repeat(np.arange(3), [1, 3, 9]), np.arange(13), np.arange(13) * 512, 4, 4)
    assert list(h) == [0, 1, 1, 1, *[2] * 10] and list(share[:4]) == [0] * 4 and share[4:13].all() and share[13] == 0
    assert len(set(share[4:13].tolist())) == 3 and place[13] == -1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs, 100, 20, hot=4).collect()}
    assert out == slow_removal(rows, 100)


# --- HTML ---


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>One  two\n three</p><p>Fo&amp;ur", "One two three\n\nFo&ur"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>A<br>b</p><aside>no</aside><p>c <b>d</b></article><footer>f</footer>", "T\n\nA b\n\nc d"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><main><p>keep &lt;this&gt;</p><!-- <p>not</p> --></main><div class='comments'><p>me too</p></div>", "keep <this>"),
        ("<article><div class='ad banner'>buy</div><p>x<div id=cookie-notice>ok?</div><p>y<form><p>mail</p></form><section id='comments'><p>first!</p></section></article>", "x\n\ny"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c</td><td>d</td></tr></table></article", "a\n\nb\n\nc\n\nd"),
        ("<article></article><footer>only</footer>", ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_long_page_without_article():
    links = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(30))
    body = "".join(f"<p>Paragraph {k} has a fair number of words in it, so it counts as text.</p>" for k in range(20))
    got = html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div></body>")
    assert got.startswith("Paragraph 0") and got.endswith("counts as text.") and got.count("\n\n") == 19


def test_text_beyond_boilerplate_is_kept():
    bar = "".join(f"<p><a href=/{k}>Share it here {k}</a></p>" for k in range(4))
    box = "<div class='related'>" + "".join(f"<p>Related story {k}</p>" for k in range(4)) + "</div>"
    body = [f"Paragraph {k} has a fair number of words in it, so it counts as text." for k in range(30)]
    want = ["The title", *body, "A closing line."]
    page = f"<body><h1>The title</h1>{bar}" + "".join(f"<p>{x}</p>" for x in body) + f"{box}<p>A closing line.</p><footer>f</footer></body>"
    assert html_text.main_text(page).split("\n\n") == want


def test_article_must_hold_most_of_the_text():
    body = [f"Paragraph {k} has a fair number of words in it." for k in range(8)]
    text = "<div class='text'>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    got = html_text.main_text(f"<body>{text}<article class='card'><p>A teaser</p></article></body>").split("\n\n")
    assert got == [*body, "A teaser"]
    assert html_text.main_text(f"<body>{text}<article class='card related'><p>A teaser</p></article></body>").split("\n\n") == body
    post = f"<article class='post category-social tag-comments'>{text}</article><div><p>A line beside it</p></div>"
    assert html_text.main_text(post).split("\n\n") == body


def test_parts_beside_an_article_have_surge_and_dive():
    words = lambda n: " ".join(f"word{k}" for k in range(n))
    second = f"<div><h2>Second part</h2><p>{words(60)}</p><p>The end.</p></div>"
    got = html_text.main_text(f"<p>Lone line<article><h1>T</h1><p>{words(100)}</p><p>Bye.</p></article>{second}<article><p>{words(90)}</article><p>Tail")
    assert got.split("\n\n") == ["T", words(100), "Bye.", "Second part", words(60), "The end.", words(90)]


def slow_surge_and_dive(lines, window=3, share=0.125, most=120):
    """The kept lines of a page without article, links or boilerplate, window by window."""
    lines = [x for x in lines if x]
    if not lines:
        return []
    threshold = min(most, share * max(sum(map(len, lines[k : k + window])) for k in range(len(lines))))
    surge = next(k for k in range(len(lines)) if sum(map(len, lines[k : k + window])) >= threshold)
    dive = next(k for k in reversed(range(len(lines))) if sum(map(len, lines[max(0, k + 1 - window) : k + 1])) >= threshold)
    return lines[surge : dive + 1]


def test_surge_and_dive_against_brute_force():
    rng = random.Random(12)
    cut = 0
    for _ in range(300):
        sizes = [rng.choice([0, 1, 4, 9, 30, 90, 400]) if rng.random() < 0.5 else rng.choice([1, 3, 5]) for _ in range(rng.randint(0, 30))]
        lines = ["".join(rng.choice("abc") for _ in range(n)) for n in sizes]
        want = slow_surge_and_dive(lines)
        cut += len(want) < sum(map(bool, lines))
        assert html_text.main_text("".join(f"<div class='x{k}'>{x}</div>" for k, x in enumerate(lines))) == "\n\n".join(want)
    assert cut > 50  # without surge and dive all lines would stay


def test_odd_pages_without_article():
    body = [f"Paragraph {k} of the story has a good number of words in it, so that it counts as running text." for k in range(9)]
    before, after = ["Top", "Start", "Log in", "Weather", "Sport"], ["Up", "Imprint", "Help", "About us", "2026"]
    page = "".join(f"<div class='q{k}'>{x}</div>" for k, x in enumerate([*before, *body, *after]))
    got = html_text.main_text(f"<body>{page}</body>").split("\n\n")
    assert [x for x in got if x in body] == body and got == [*before[-2:], *body, *after[:2]]  # what shares a window with text stays


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</p>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<div><b>" * 20_000 + "</div>x</span>" * 20_000, '<b class="q>' * 20_000])
def test_broken_markup_takes_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


def test_an_open_quote_is_no_text():
    assert html_text.main_text('x < y and <b class="q>oops</b> tail') == "x < y and oops tail"


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a", "x"), (None, None, "<p>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()) == [("", 0), ("a", 1), ("deep", 4)]


# --- decontamination ---


def test_decontamination(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, f"A train leaves {text(6)} at {10 + k} km per hour and {text(6)} meets Alice after {k + 3} hours {text(4)}.") for k in range(30)]
    items += [(90, None), (91, ""), (92, "two words"), (None, text(20))]
    docs, want = [], set()
    for k in range(200):
        own = text(60)
        if k % 4 == 0:
            item = items[k % 30]
            moved = item[1].replace("Alice", "Bob").replace(f"{10 + item[0]} km", "77 miles") if k % 8 else item[1]
            own = f"{text(20)}. {moved} {text(20)}"
            want.add((k, item[0]))
        elif k % 4 == 1:
            own += " " + " ".join(items[k % 30][1].split()[2:7])  # a short shared phrase is no leak
        docs.append((k, own, 1.0))
    docs += [(None, items[0][1], 0.0), (500, None, 0.0), (501, "", 0.0), (0, docs[0][1], 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, share double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (500_000, 0):  # broadcast hashes, then the shuffled join
        out = decontam.contaminated(df, bench, max_broadcast=limit).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want)
    assert decontam.drop_contaminated(df, bench).where("doc_id is not null").count() == 200 - len(want) + 2
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.contaminated(df.limit(0), bench).count() == 0


def test_items_without_literal_windows_are_found_whole(spark):
    items = ["Compute 12 + 34 - 5 * 7", "See Alice Bob Carol Dave Erin Frank", "1 2 3 4 5 6 7 8 9 10 11 12 13", "3.14 2.71"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(k, f"So it was: {item}. More of it.") for k, item in enumerate(items)]
    docs += [(10, "So: " + items[2] + " and again: " + items[2]), (11, "1 2 3 4 5 6 7 8 9 10"), (12, "Compute 12 + 34 - 5 * 8"), (13, "1 2 3 4 5 6 7 0 8 9 10 11 12 13"), (14, "See Alice Bob Carol Erin Dave Frank")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (500_000, 0):
        out = decontam.contaminated(df, bench, max_broadcast=limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in out) == [(0, 0), (1, 1), (2, 2), (3, 3), (10, 2)]
        assert all(r.share == 1 and r.matched == r.n_item for r in out)
        assert {r.doc_id: (r.first_word, r.last_word) for r in out}[2] == (3, 16)


def test_literal_clauses_apart_are_one_place(spark):
    rng = random.Random(5)
    numbers = lambda: " ".join(str(rng.randint(1, 999)) for _ in range(40))
    item = f"the quick brown fox {numbers()} over lazy dogs while {numbers()} every cold morning near"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"So said they: {item} at last."), (2, "the quick brown fox")], "doc_id long, text string")
    out = decontam.contaminated(df, bench).collect()
    assert [(r.doc_id, r.share) for r in out] == [(1, 1.0)]
    pos = np.array([0, 1, 2, 30, 31, 32, 60, 61, 62])
    assert decontam.judge(pos, pos, [[]] * 9, [[]] * 9, 9, 5, 67)[0] == 9


def test_names_at_the_start_of_sentences(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    story = [f"Alice {text(6)} 3 apples. Alice {text(5)}. Alice {text(4)} at 7 km." for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(story)), "item_id long, text string")
    docs = [(k, f"{text(9)}. {s.replace('Alice', 'Bob')} {text(9)}") for k, s in enumerate(story)]
    docs += [(10 + k, f"{text(9)}. {s.replace('Alice', 'alice')} {text(9)}") for k, s in enumerate(story)]
    docs += [(30, text(60)), (31, f"Bob {text(6)} 3 pears. Bob {text(5)}.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (500_000, 0):
        out = decontam.contaminated(df, bench, max_broadcast=limit).collect()
        got = {(r.doc_id, r.item_id): r for r in out}
        assert {(k, k) for k in range(6)} <= got.keys() and all(got[k, k].matched == got[k, k].n_item for k in range(6))
        assert not {30, 31} & {r.doc_id for r in out}


def slow_template(text):
    """(word in lower case, kind) of a text, word by word; an opener is what may be a name."""
    out, last = [], 0
    units = set(decontam.UNITS)
    for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+|\d(?:[\d]|[.,](?=\d))*", text):
        w, gap = m[0], text[last : m.start()]
        opens = not out or bool(re.search(r'[.!?:;\n\r"|]', gap))
        if w[0].isdigit():
            kind = "number"
        elif len(w) > 1 and w[0].isascii() and w[0].isupper() and not w[1].isupper():
            kind = "opener" if opens else "name"
        elif out and out[-1][1] == "number" and w.lower() in units:
            kind = "unit"
        else:
            kind = "literal"
        out.append((w.lower(), kind))
        last = m.end()
    return out


def slow_contaminated(docs, items, n=5, share=0.5, run=9):
    """Items of n words and more whose windows with three literal words stand in a document, window by window, in slots that agree."""

    def windows(words):
        for k in range(len(words) - n + 1):
            part = words[k : k + n]
            for opener in ("literal", "name"):
                kinds = [opener if kind == "opener" else kind for _, kind in part]
                if kinds.count("literal") >= 3:
                    yield k, tuple(w if kind == "literal" else kind for (w, _), kind in zip(part, kinds, strict=True)), tuple(w for (w, _), kind in zip(part, kinds, strict=True) if kind != "literal")

    found = set()
    for doc, text in docs:
        at = {}
        for _, key, slots in windows(slow_template(text)):
            at.setdefault(key, []).append(slots)
        for item, question in items:
            own = list(windows(slow_template(question)))
            votes = {}
            hits = [(k, a, b) for k, key, a in own for b in at.get(key, [])]
            for _, a, b in hits:
                for x, y in zip(a, b, strict=True):
                    votes.setdefault(x, {}).setdefault(y, 0)
                    votes[x][y] += 1
            takes = {x: max(v, key=lambda y: v[y]) for x, v in votes.items()}
            good = {k for k, a, b in hits if all(takes[x] == y for x, y in zip(a, b, strict=True))}
            longest = max((sum(1 for j in range(k, k + len(own)) if set(range(k, j + 1)) <= good) for k in good), default=0)
            if good and (len(good) >= share * len({k for k, *_ in own}) or longest >= run):
                found.add((doc, item))
    return found


def test_decontamination_against_brute_force(spark):
    rng = random.Random(19)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    pick = lambda: rng.choices([rng.choice(words), rng.choice(["Alice", "Bob", "Carol"]), str(rng.randint(2, 99)), f"{rng.randint(2, 99)} km", rng.choice(words) + "."], [12, 1, 1, 1, 1])[0]
    text = lambda n: " ".join(pick() for _ in range(n))
    items = [(k, f"{text(14)} {rng.choice(words)}") for k in range(12)]
    docs = []
    for k in range(90):
        own = text(rng.randint(5, 40)).split()
        if k % 3:
            part = rng.choice(items)[1].split()
            keep = rng.choice([3, 6, 8, 10, len(part)])
            begin = rng.randint(0, len(part) - keep)
            moved = {x: rng.choice(["Dave", "Erin"]) for x in ("Alice", "Bob", "Carol")} if k % 2 else {}
            at = rng.randint(0, len(own))
            own[at:at] = [moved.get(x, x) for x in part[begin : begin + keep]]
        docs.append((k, " ".join(own)))
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got, want = {(r.doc_id, r.item_id) for r in out}, slow_contaminated(docs, items)
    assert len(want) > 20 and got == want


def test_slots_must_be_consistent():
    pos = np.arange(6)
    same = decontam.judge(pos, pos, [[7]] * 6, [[1]] * 6, 6, 5)
    mixed = decontam.judge(pos, pos, [[7], [7], [7], [8], [9], [6]], [[1]] * 6, 6, 5)
    assert same[0] == 6 and mixed[0] == 3


# --- quality ---


def test_gumbel_top_k(spark):
    rng = random.Random(3)
    rows = [(k, 0.0, rng.choice([0.5, 1.0, rng.gauss(0, 10)])) for k in range(3000)]
    scored = spark.createDataFrame(rows, "doc_id long, log_weight double, key double")
    for k in (0, 1, 700, 1500, 2999, 3000, 9000):
        got = {r.doc_id for r in quality.gumbel_top_k(scored, k, bins=16).collect()}
        assert got == {r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:k]}


def test_quality_prefers_target(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.resample(docs, marks)
    again = quality.resample(docs, marks)
    assert kept.exceptAll(again).count() == 0
    share = kept.join(marks, "doc_id").groupBy("quality").count().collect()
    total = {r.quality: r["count"] for r in marks.groupBy("quality").count().collect()}
    n = {r.quality: r["count"] for r in share}
    assert n[1] / total[1] > 0.9 and n.get(0, 0) / total[0] < 0.5


def test_quality_edges(spark, docs):
    assert quality.resample(docs, labels(spark)).count() == docs.count()
    assert quality.resample(empty(spark), labels(spark)).count() == 0


# --- queries ---


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    check(spark, name, Q.QUERIES[name], Q.ORACLES[name], SF)
