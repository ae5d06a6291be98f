"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

1. ``language_id``: texts without letters, and those no language fits with a probability of ``LEAST`` or more, go;
   a missing lang is filled in.
2. ``near_duplicates``: one document of each group of near copies stays.
3. ``secret_scan``: secrets in texts are replaced by a mark; all documents stay.
4. ``source_mixing``: every document as often as its source's target asks for, which may be never.
5. ``best_fit_packing``: the token pieces of what is left, each with its sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowline.llm import langid, minhash, mixing, packing, secret_scan
from flowline.llm.common import spill, table

LEAST = 0.5
#: Bytes of an Arrow batch. Texts are long, and a worker and its JVM hold a few batches each, so far less than Spark's default.
BATCH = 8 << 20


def bounded(stage):
    """A stage whose Python workers get batches of bounded size."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is in a language the model knows, with a missing lang filled in.

    Rows with null or empty texts, or texts without a letter, go, and so do all rows if no row has a lang to learn
    from. Repeated rows are judged alike and all stay or go; whole texts count, however long; equal scores go to the
    language that sorts first. Of an empty table nothing is left. Columns of any name are kept as they are.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    named = langid.predict(docs, model, (lang, score)).where((F.col(lang) != langid.UND) & (F.col(score) >= LEAST))
    return named.withColumn("lang", F.coalesce("lang", lang)).drop(lang, score)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one of the smallest doc_id (null ids last), and of repeated rows one.

    Rows are told apart by doc_id and text, so a near copy goes whatever doc_id it shares. Null texts are in no group
    and stay; texts without words are copies of each other. Columns of any name are kept as they are.
    """
    return minhash.drop_near_duplicates(docs)


@bounded
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret in a text replaced by a mark and n_chars counted anew.

    Null and empty texts stay as they are, with n_chars null and 0; whole texts are read, however long. Repeated
    rows are changed alike. Other columns, of any name, are kept as they are.
    """
    return secret_scan.redact_documents(docs, secret_scan.train(docs))


@bounded
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: none to three times.

    A null source is a source of its own; null and empty texts have no words, and are repeated as their source is;
    repeated rows are drawn alike. Of an empty table nothing is left. Columns of any name are kept as they are.
    """
    return mixing.repeat_documents(docs)


@bounded
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all rows with their sequences; the columns are those of the packing, not of documents.

    Null and empty texts are a single end id; every row, repeated ones too, is packed for itself; long texts are cut
    into pieces. Of an empty table there are no pieces. Extra columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secrets),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tagger; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
