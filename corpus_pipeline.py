"""From raw documents to token ids: five stages, each over all rows that the one before it kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns
(doc_id, ids, n_tokens, decoded_ok). run() writes each stage's rows as Parquet to the folder of
spark.checkpoint.dir and reads them back as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import crf, minhash, secrets, sp_codec, wu_manber
from tramline.llm.shared import discard, store


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too few words in a known language go: those without text or words, numbers, codes and junk too.

    Rows without doc_id and repeated rows are judged each by itself; long texts are read whole; other columns, whatever their names,
    pass through; an empty table stays empty.
    """
    return crf.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays.

    Of rows of one doc_id one stays, the least by text and then by its other columns; rows without doc_id all stay, as do texts
    without a word. Other columns pass through; an empty table stays empty.
    """
    return minhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts stay, test items that are null or of few words match nothing. Long texts are searched whole, repeated rows go or
    stay together; other columns pass through; empty tables on either side lose nothing.
    """
    return wu_manber.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported secrets, identifiers and endpoints are blotted out; every document stays, a null text as null.

    Values are blotted out whole, however long. n_chars follows the new text. Repeated rows come out equal; other columns pass through; an
    empty table stays empty.
    """
    return secrets.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded_ok) of each row: its SentencePiece ids.

    Null and empty texts have none; rows without doc_id and repeated rows are encoded too; long texts in parts, with equal ids. Other
    columns are not read; an empty table gives no rows.
    """
    return sp_codec.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: SQL can't express the random field, the signatures or the merges of pieces; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
