"""A corpus pipeline of five stages; each works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's rows as
Parquet into the shared checkpoint folder and reads them again for the next;
a stage's rows are deleted when those of the next are written.

Defined results, in every stage: an empty table gives an empty one; columns
beyond those of documents are kept as they are, whatever their names (the last
stage returns its own); whole texts are processed at any length. Nulls, empty
texts, ties and repeated rows are told with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronogeo.llm import mixing, piece_codec, quality_rules, secret_links, simhash_pivots
from chronogeo.session import remove_table, written_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's verdict, reject go.

    Null and empty texts have no words and go; a null source is a host of its
    own; a repeated row is judged, and counted for its host, each time.
    """
    return quality_rules.keep_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the least doc_id.

    Null and empty texts are one class; of repeated rows, or rows that repeat
    the least doc_id within a class, one stays; rows without doc_id stay only
    where a class has no doc_id, one of them.
    """
    return simhash_pivots.first_rows(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts.

    No row goes; null and empty texts stay as they are; repeated rows are
    changed alike.
    """
    return secret_links.redact_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources takes it.

    Null and empty texts have size 0 and may be taken; a null source is a
    source of its own, a source without words gives no row; repeated rows are
    separate documents; reruns take the same.
    """
    return mixing.emit_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, one row per row; null and empty texts have none."""
    return piece_codec.coded(docs, keep=("doc_id", "lang", "source")).drop("exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can't express the fingerprints and encodings; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = written_table(stage(spark, docs, sf_dir))
        if before:
            remove_table(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
