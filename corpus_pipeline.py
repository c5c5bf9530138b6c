"""From raw documents to a mixed, encoded corpus: five stages, each written before the next reads it.

SQL cannot express the first stage's model nor the ids of the last, so there is no
ORACLE_SQL; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm.exact_dedup import deduplicated
from timberline.llm.mixing import Mix
from timberline.llm.quality import held_out
from timberline.llm.queries import table, vocabulary
from timberline.llm.runtime import written
from timberline.llm.sentencepiece_trie import encoded
from timberline.llm.simhash import near_deduplicated
from timberline.llm.toxicity import Toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score accepts; held-out labels stay unread.

    Null and empty texts are clean; repeated rows share their fate; nothing goes by id,
    lang or source. In this and all stages rows may have null ids, other columns stay
    as they are, and an empty table gives one.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    return Toxicity(docs, labels).accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id.

    Null texts count as empty. Of rows that agree in id and text the first by a hash of
    all columns stays; a null id comes after all others.
    """
    return deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with 0.8 or more of their five-word shingles in common, the one with the smallest doc_id.

    Texts without words, null ones among them, are one group; a row without an id stays
    only where its group has no id.
    """
    return near_deduplicated(docs, similar=0.8, shingle=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them.

    A null source is a source of its own; texts without words have no size and come as
    often as their odds say; rows that share an id and a source are mixed together.
    """
    return Mix(docs).mixed(docs)


def as_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the SentencePiece ids of each document's whole text; null and empty texts have none."""
    return encoded(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "lang", "source", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", as_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
