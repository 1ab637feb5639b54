"""Thin queries over the whole intended tables, one for each corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytofold.llm import alignment, decontam, html_text, langid, mixing, pieces, quality, secret_scan, simhash, spelling, suffix_dedup, topk, toxicity
from cytofold.llm.text import written


#: Model file of the encoder; any SentencePiece BPE model can take its place.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Vocabulary file of the byte-level tokenizer that is aligned with it.
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the hash of the text decoded from the ids."""
    model = pieces.PieceModel.load(PIECE_MODEL)
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), model)
    decoded = pieces.decode(encoded, model)
    return decoded.select("doc_id", "ids", "n_tokens", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = secret_scan.fit_markov(secret_scan.labelled_samples(docs))
    return secret_scan.scan_secrets(docs, model)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.fit_language(docs))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=100)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pair = alignment.TokenizerPair.load(BYTE_MODEL, PIECE_MODEL)
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    aligned = written(alignment.align(docs, pair).withColumn("groups_sha256", digest).drop("groups"))
    return alignment.with_counts(aligned, alignment.link_counts(aligned))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).taken()


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.word_counts(_table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash, op3_sentencepiece, op4_secrets, op5_language,
        op6_topk, op7_suffix_dedup, op8_html, op9_decontam, op10_quality,
        op11_alignment, op12_mixing, op13_spelling,
    )
}
#: DuckDB SQL where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}
