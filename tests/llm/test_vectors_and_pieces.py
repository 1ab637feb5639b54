"""Top-k search and the piece encoder against brute force and the public library."""

import pickle
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cytofold.llm import pieces, topk
from cytofold.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(PIECE_MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def test_threshold_topk_with_ties():
    rng = np.random.default_rng(1)
    for n, dims, high in ((300, 4, 3), (1000, 16, 40), (5, 3, 2), (50, 2, 1 << 30)):
        x = rng.integers(-high, high + 1, (n, dims))
        ids = rng.permutation(n)
        q = np.arange(0, n, 7)
        at, found, score = topk.threshold_topk(x[q], x, ids[q], ids, 10, first=2)
        for k, row in enumerate(q):
            s = [int(v) for v in (x.astype(object) @ x[row].astype(object))]
            want = sorted((-s[j], ids[j]) for j in range(n) if j != row)[:10]
            assert [(-int(a), b) for a, b in zip(score[at == k], found[at == k], strict=True)] == want


def test_the_bound_stops_the_walk():
    rng = np.random.default_rng(4)
    ids = np.arange(6000)
    falling = np.floor(64 * rng.normal(size=(6000, 32)) * 0.6 ** np.arange(32)).astype(np.int64)  # most weight in few dimensions
    heavy = np.floor(64 * rng.normal(size=(6000, 12)) ** 3).astype(np.int64)  # long tails
    for x in (falling, heavy):
        count: list = []
        at, found, score = topk.threshold_topk(x[::100], x, ids[::100], ids, 20, count=count)
        assert np.mean([stopped for _, stopped in count]) > 0.9 and np.mean([met for met, _ in count]) < 0.4 * len(x)
        for k, row in enumerate(range(0, 6000, 100)):
            s = x @ x[row]
            want = sorted((-int(s[j]), j) for j in range(6000) if j != row)[:20]
            assert [(-int(a), int(b)) for a, b in zip(score[at == k], found[at == k], strict=True)] == want


def test_exact_topk_edges(spark):
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], 1, k) for k in range(130)]
    rows += [(200, None, 1, 1), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1), (240, [float("nan")] * 6, 1, 1), (260, [float("inf")] * 6, 1, 1), (None, [0.5] * 6, 1, 1)]
    rows += [(131, rows[3][1], 1, 1), (131, rows[3][1], 1, 1), (140, [0.5, 0.5], 1, 1), (141, [0.25, 0.5], 1, 1), (40, rows[40][1], 2, 2), (160, [], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score long")
    out = topk.exact_topk(df, k=20, every=20, block_rows=16, query_rows=3).collect()
    ok = [(i, [int(np.floor(64 * c)) for c in v]) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = {}
    for i, v in {(i, tuple(v)) for i, v in ok if i % 20 == 0 and v}:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in ok if j != i and len(w) == len(v))[:20]
        want[i] = [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(tuple(r))
    assert got == {k: v for k, v in want.items() if v}
    assert topk.exact_topk(df.limit(0)).count() == 0


TEXTS = st.text(st.sampled_from("abcdeinorst  THE\n.,0123é😀あ▁"), max_size=120)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_library(text):
    m, s = _shared()
    assert m.encode(text).tolist() == s.encode(text)
    if "▁" not in text:
        assert m.decode(m.encode(text).tolist()) == text


_CACHE = []


def _shared():
    if not _CACHE:
        _CACHE.extend((pieces.PieceModel.load(PIECE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)))
    return _CACHE


def test_scan_of_long_words(model, library):
    rng = random.Random(3)
    for n in (300, 2000, 5000):
        for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "aeé😀 ", "=", "0123456789 "):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            want = library.encode(text)
            assert model.encode(text).tolist() == want
            for size in (20, 64, 500):
                assert model.as_ids(pieces.scan(model, model.surface(text), size)) == want


def test_products_associate(model):
    text = model.surface("internationalization" * 8)
    cuts = [0, 40, 80, 120, len(text)]
    ms = [pieces.transfer(model, text, a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    times = lambda a, b: (a.astype(int) @ b.astype(int)) > 0
    left = times(times(times(ms[0], ms[1]), ms[2]), ms[3])
    right = times(ms[0], times(ms[1], times(ms[2], ms[3])))
    whole = pieces.transfer(model, text, 0, len(text))
    assert (left == right).all() and (left == whole).all()


def test_encode_rows(spark, model, library):
    rng = random.Random(4)
    words = "the internationalization of naïve words 123 and  spaces\n".split(" ")
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 300)))) for k in range(40)]
    rows += [(90, None), (91, ""), (92, "x" * 4000), (92, "x" * 4000), (None, " ".join(words * 60)), (93, " " * 900)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>")
    want = sorted((repr(i), library.encode(t or "")) for i, t in rows)
    for giant, chunk in ((1 << 16, 1 << 13), (400, 128)):
        out = pieces.encode(df, model, giant, chunk)
        assert sorted((repr(r.doc_id), list(r.ids)) for r in out.collect()) == want
    back = pieces.decode(pieces.encode(df, model), model).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in back) == sorted((repr(i), t or "") for i, t in rows)
    assert pieces.encode(df.limit(0), model).count() == 0


def test_giant_texts_of_many_blocks(spark, model, library):
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choice("abeinorst é😀") for _ in range(rng.randint(1, 9))) for _ in range(n))) for k, n in enumerate((3000, 2500, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pieces.encode(df, model, 400, 64).collect()  # blocks of 64 chunks of 64 characters
    assert {r.doc_id: list(r.ids) for r in out} == {i: library.encode(t) for i, t in rows}


def test_words_are_told_from_signs(model):
    """Of a word and the signs after it only the word is scanned anew; no piece lies across."""
    assert model.unit.findall("▁word,▁▁x²--▁12ab\n") == ["▁word", ",", "▁▁x", "²--", "▁12", "ab", "\n"]
    for piece in model.ids:
        assert len(model.unit.findall(piece)) == 1, piece


def test_seam_of_two_pieces_equals_their_merges(model):
    rng = random.Random(5)
    names = sorted(model.ids)
    for _ in range(4000):
        left, right = rng.choice(names), rng.choice(names)
        assert model.fits(left, right) == (model.merged(left + right) == [left, right])
    for left, right in [("aa", "aa"), ("▁▁", "▁▁"), ("▁", "▁▁▁"), ("--", "-"), ("", "bu"), ("", "the")]:
        assert model.fits(left, right) == (model.merged(left + right) == ([left, right] if left else [right]))


def test_tables_are_bounded_and_go_with_the_model(model, monkeypatch):
    """Words beyond the bound push out the oldest, and another model of a worker does not keep them."""
    monkeypatch.setattr(pieces, "WORDS_KEPT", 50)
    own = pickle.loads(pickle.dumps(model))
    assert not own.words and not own.pairs
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}q" for k in range(400))
    assert own.encode(text).tolist() == model.encode(text).tolist() == own.encode(text).tolist()
    assert len(own.words) <= 50 and len(own.former) <= 50
