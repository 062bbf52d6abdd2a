"""The corpus pipeline: documents in, packed training sequences out.

Each stage is one operator of streamql.llm and takes (spark, docs, sf_dir); between
stages the result is written as Parquet and read again. All but the last return the
columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamql.llm import common, jaccard, mixing, packing, quality, substring

#: A training sequence holds so many pieces at most, so that attention masks stay small.
DOCUMENTS = 64
#: Weights of the residuals of tokens, documents and attention cost in the last stage.
WEIGHTS = (1.0, 0.02, 0.02)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees fitted on labels.

    Each row is judged by its own text, so repeated rows and ids fare alike. A null, empty or
    wordless text fails. Without labels of both kinds the base rules alone decide. Empty
    table: empty result.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id.

    Near: five-word shingles with a Jaccard similarity of 0.8 or more, or SimHashes of these
    shingles that op6's index links. Every row is decided by its own text, so different texts
    under one doc_id each stand for themselves. A null doc_id comes last in its group. Of
    rows that share doc_id and text one stays; if they differ elsewhere, that with the
    smallest hash of all columns. Wordless texts are one group. Empty table: empty result.
    """
    return jaccard.survivors(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that a document with a smaller doc_id holds, too.

    n_chars follows the text. A document that loses all its words goes. Null and short texts
    and rows without doc_id stay as they are; rows that share a doc_id lose nothing to each
    other. Empty table: empty result.
    """
    return substring.dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is one more source, the last; a null text has size 0. Rows that repeat a
    doc_id, or have none, are drawn each for itself if their texts differ. Empty table: empty result.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences.

    A sequence holds at most packing.TOKENS tokens and DOCUMENTS pieces. A null or empty text
    is one piece, its end token. Rows that repeat are packed each. Empty table: empty result.
    """
    return packing.packed(docs, documents=DOCUMENTS, weights=WEIGHTS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The trees of the first stage can't be written as SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Of each stage only the result is kept, until the next one has its own."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before = common.made(spark)
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.released(spark, common.made(spark) - before - {docs._streamql_path} | ({last} if last else set()))
        last = docs._streamql_path
    return docs
