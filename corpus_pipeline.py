"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``; where a stage
changes a text, n_chars follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import langid, lines, near, packing, queries, store, substring

#: Texts of a lower score are no prose in a learned language: the 10,000 test documents score 0.38 to 0.95,
#: texts in a script that no profile has 0.
LEAST_SCORE = 0.1


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and, in one struct, all other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("rest")] if others else []))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows with kept (the new text) and rest."""
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("kept").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c if c == "doc_id" else f"rest.{c}").alias(c))
    return rows.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts, too), or whose text is near no language's profile, go.

    Profiles are learned from all rows with a language. If no row has one, every document with a letter
    stays. Repeated rows and null doc_ids are judged by their text alone; an empty table stays empty.
    """
    return langid.accepted(docs, langid.profiles(docs), LEAST_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay only in the one of the largest doc_id.

    A null text becomes an empty one. Rows with a null doc_id stay as they are; rows that repeat a doc_id
    are one holder and lose the same lines. No row goes; an empty table stays empty.
    """
    return _restored(lines.LineIndex.build(docs).clean(_carried(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 over five-word shingles, the one of the smallest doc_id stays.

    Texts without words are linked with nothing and stay, and so do rows with a null doc_id. All rows that
    repeat the kept doc_id stay (later stages treat them as one document); an empty table stays empty.
    """
    gone = store.written(near.groups(docs, size=5, percent=80).where("component_id <> doc_id").select("doc_id"), "near-copies")
    return docs.join(store.sized(gone, 16), "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of a smaller doc_id has, too, are cut out.

    A null text becomes an empty one. Rows with a null doc_id neither lose words nor make others lose them;
    rows that repeat a doc_id lose the same passages. No row goes; an empty table stays empty.
    """
    return _restored(substring.without_repeats(_carried(docs), layout=True), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row for each piece of a document, as ``packing.pack`` returns it.

    An empty text is its end token alone; null doc_ids and repeated rows are packed each; an empty table
    makes no sequence.
    """
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the language profiles nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store.written(docs, name)
    return docs
