"""A training corpus from the documents table, in five stages.

Language ID, near-duplicates, personal data, the mix of sources, packing. Each stage takes (spark, docs, sf_dir), with
docs what the stage before it kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agestrata.llm import language, mixing, packing, privacy, shared, simhash


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language can't be told, go."""
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, or of texts with five-word similarity of 0.8 or more, the document of smallest
    doc_id stays."""
    return simhash.one_of_each(docs, similar=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind."""
    return privacy.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, a row for each."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("op10 language ID", tell_language),
    ("op5 SimHash near-dedup", drop_near_copies),
    ("op7 personal data", redact),
    ("op8 mixing sources", mix_sources),
    ("op2 packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written and read back before the next.

    Null, empty and letterless texts go at the first stage; of rows that repeat doc_id and text one stays; null ids, langs
    and sources take part like others; an empty table gives no rows; extra columns reach the last stage.
    """
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.written(docs, f"stage-{k}")
    return docs


#: The stages train models and tokenize, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None
