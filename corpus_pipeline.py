"""Corpus pipeline: quality classifier, line dedup, near-dedup, source mixing, SentencePiece encoding.

Each stage gets what the stage before kept, written as Parquet and read again, and returns the columns of documents but for
the last, which returns the encoded documents.  A stage begins by letting Spark delete the shuffle files of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probspark.llm import lines, mixing, pieces, quality, shingles
from probspark.llm._util import Staged, release, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the model is fitted on the labelled ones among them outside the held-out fold.

    Rows with a null doc_id are scored like any other; a scored row decides for all rows alike in doc_id and text.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    feats = quality.features(docs.select("doc_id", "text"))
    examples = Staged(quality.training_rows(feats, labels), "examples")
    model = quality.fit(examples.df)
    examples.drop()
    return quality.keep(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; n_chars is counted anew.  No document goes."""
    release(spark)
    return lines.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Texts without any word (null, empty, or emptied by the stage before) are one group, as they have one set.
    SimHash fingerprints of five-word shingles link at 4 or fewer differing bits, found by pigeonring as in op2, and so does an
    exact Jaccard similarity of 0.8 or more, which fingerprints alone would mostly miss.  Of rows with the doc_id that stays, one stays.
    """
    release(spark)
    return shingles.keep_first(docs, least=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    release(spark)
    return mixing.mixed(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_crc32, text_crc32, decoded_crc32, ids) of every document that is left, copies included."""
    release(spark)
    return pieces.round_trip(docs, pieces.model_path(), keep_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("pieces", pieces_stage),
]

#: Fitting, near-duplicate components and balanced sampling are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; stages are written in the cluster's shared folder.

    A stage's own tables and the stage before it go as soon as it is written.  An empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            written = Staged(stage(spark, docs, sf_dir), name)
            made.remove(written)
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
