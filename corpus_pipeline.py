"""A training corpus from ``documents``: language, quality, exact and near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All stages but the last return the columns of documents, rows and texts unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelyard.llm import exact_dedup, lang_id, minhash_dedup, packing, quality_rules
from panelyard.llm._common import remove, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of the labelled documents.

    Null and empty texts and those without a letter go; repeated rows are judged alike. Without labelled texts all go.
    Very long texts are judged whole. Other columns pass through, whatever their names. An empty table stays empty.
    """
    return lang_id.accepted(docs, lang_id.train(docs), least=0.1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first quality rules keep, texts as they are. Null and empty texts go; repeated rows are judged alike.

    Very long texts are judged whole. Other columns pass through, whatever their names. An empty table stays empty.
    """
    return quality_rules.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, that with the largest id (a null id is the smallest); of rows that repeat it, one.

    Null counts as the empty text, very long texts are compared whole. Other columns pass through, whatever their names.
    An empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, that with the smallest id.

    Null ids and texts without a word are linked with nothing and stay. Very long texts are compared whole. Other
    columns pass through, whatever their names. An empty table stays empty.
    """
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens; null and empty texts are the end alone, null and repeated ids stay.

    Very long texts are cut into several pieces. Other columns are not read. An empty table gives an empty result.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096, cached_words=50_000)  # beside what earlier stages hold


STAGES = [("language", language), ("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: Language identification and tokenizing are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the stages' results are tables in the shared folder, so a lost executor costs no stage.

    A stage's table goes when the next one's is written; the last one's is the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    at = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
