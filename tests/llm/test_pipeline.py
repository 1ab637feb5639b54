"""Every stage takes effect on what its predecessor kept."""

import re

import sentencepiece

import corpus_pipeline
from cytofold.llm.queries import PIECE_MODEL
from tests.llm.test_text_operators import slow_similar, slow_spans

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        kept[name] = (before.collect(), docs.collect())
    before, after = kept["toxicity"]
    insult = re.compile(r"\b(idiot|moron|scum|loser|clown|stupid)\b", re.I)
    assert 0 < sum(bool(insult.search(r.text)) for r in before)
    assert sum(bool(insult.search(r.text)) for r in after) == 0 and len(after) > 0.85 * len(before)
    before, after = kept["simhash_near_dedup"]
    want = {i for i, c in slow_similar([(r.doc_id, r.text) for r in before]) if i == c}
    assert {r.doc_id for r in after} == want
    before, after = kept["benchmark_decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in before if any(t in r.text for t in items)}
    assert not leaked & {r.doc_id for r in after} and len(after) >= len(before) - len(leaked) - 2
    before, after = kept["secret_scan"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any(slow_spans(r.text) for r in after)
    assert sum(bool(slow_spans(r.text)) for r in before) == len({r.text for r in after} - {r.text for r in before})
    before, after = kept["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    text = {r.doc_id: r.text for r in before}
    assert {r.doc_id: list(r.ids) for r in after} == {i: library.encode(t) for i, t in text.items()}


def test_batches_are_worked_on_in_parts(spark):
    import pyarrow as pa

    from cytofold.llm.text import map_batches

    rows = map_batches(spark.range(0, 5000, 1, 1), lambda: lambda batch: pa.RecordBatch.from_pydict({"n": [batch.num_rows]}), "n long", 1024)
    assert sorted(r["n"] for r in rows.collect()) == [904, 1024, 1024, 1024, 1024]
