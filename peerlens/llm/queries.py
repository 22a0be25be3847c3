"""The registered queries of this package: each applies one operator, with
production parameters, to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerlens.llm import (decontaminate, html_extract, langid, lm, multi_index, packing, quality,
                          resample, vector_codes)
from peerlens.llm.near_dup import near_duplicates
from peerlens.llm.sharding import shard
from peerlens.llm.topk import topk
from peerlens.llm.url_filter import url_filter
from peerlens.session import parquet

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
             ("allow", "org/fr/")]
SHARDS = 8
HELD_OUT = 2                        # of the id's checksum modulo 4, for the classifiers
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def id_crc(modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id: as empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(parquet(spark, sf_dir, "pages"), URL_RULES)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(parquet(spark, sf_dir, "documents"), train=id_crc(7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(parquet(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                         "map_version")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(parquet(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(parquet(spark, sf_dir, "documents"),
                                      parquet(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(parquet(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "labels")
    model = quality.train(docs, labels, id_crc(4) != HELD_OUT)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (id_crc(4) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(parquet(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    models = langid.train(docs, id_crc(4) != HELD_OUT)
    return langid.predict(docs, models).select(
        "doc_id", (id_crc(4) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(parquet(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(parquet(spark, sf_dir, "embeddings"),
                                          F.col("id") % 50 == 0, k=5)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(parquet(spark, sf_dir, "embeddings")).drop("label")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sharding": op3_sharding,
    "op4_html_extraction": op4_html_extraction,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_topk": op10_topk,
    "op11_nearest": op11_nearest,
    "op12_vector_codes": op12_vector_codes,
    "op13_resampling": op13_resampling,
}
