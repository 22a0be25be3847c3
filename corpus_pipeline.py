"""From raw documents to packed training sequences, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written
as Parquet and read again as the next one's ``docs``.  All but the last keep
the columns of ``documents`` and drop rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peerlens.llm import decontaminate, langid, near_dup, packing, quality
from peerlens.llm.queries import HELD_OUT, id_crc, tokenizer_path
from peerlens.session import parquet, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects."""
    return langid.keep(docs, langid.train(docs, id_crc(4) != HELD_OUT))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose quality score is below the threshold."""
    labels = parquet(spark, sf_dir, "labels")
    return quality.keep(docs, quality.train(docs, labels, id_crc(4) != HELD_OUT))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document, the one with the smallest id, of each group."""
    return near_dup.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return decontaminate.clean(docs, parquet(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per sequence, with its token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]

#: The stages train models and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    docs = parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
