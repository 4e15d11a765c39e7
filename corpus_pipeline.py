"""Corpus preparation: language ID, near-dedup, substring dedup, packing.

Each stage takes the documents its predecessor kept and returns the columns of documents, the last one the packed pieces.
Documents whose language stays undetermined go; of near copies the one with the smallest id stays; words
in passages repeated from documents with smaller ids are cut out; what remains is tokenized and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobspark.llm.common import NULL_ID, table
from lobspark.llm.langid import language_id
from lobspark.llm.packing import pack
from lobspark.llm.simhash import near_groups
from lobspark.llm.substring import substring_dedup
from lobspark.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined: no text, or no letter in it.

    Null labels teach nothing; where no row can be learned from, every document is undetermined; ties, long texts, repeated rows and an empty table
    as in ``identify``.
    """
    return language_id(docs, carry=docs.columns).where("lang_pred <> 'und'").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8): the smallest id, and of equal ids the smallest hash of the row.

    Near copies are found by the deletion variants of their SimHash fingerprints and, where more bits differ, by bands of smallest hashes.

    A null id counts as smaller than every other; of rows equal in all columns one stays; texts without words, or null, are one group; an empty table
    stays empty.
    """
    key, h = F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).alias("dedup_key"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("dedup_hash")
    light = docs.select("doc_id", "text", key, h)
    groups = near_groups(light, carry=["dedup_key", "dedup_hash"])
    keep = groups.groupBy("group").agg(F.min(F.struct("row.dedup_key", "row.dedup_hash")).alias("k")).select("k.*")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key, h)
    return row.join(keep, ["dedup_key", "dedup_hash"], "left_semi").dropDuplicates(["dedup_key", "dedup_hash"]).select("row.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words out that repeat a passage of fifty words from a document with a smaller id; texts without any stay as they are.

    A null text has no words and becomes empty; rows with equal ids never cut from each other; a text cut down to nothing stays as an empty one; an
    empty table stays empty.
    """
    d = substring_dedup(docs, carry=[c for c in docs.columns if c != "text"])
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: one row per piece.

    A null or empty text is the end token alone; longer documents than a sequence are cut; repeated rows are packed as often as they stand; an empty
    table gives no pieces.
    """
    return pack(docs).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", known_language), ("near_dedup", one_of_each_group), ("substring_dedup", without_repeats), ("packing", packed)]

#: Word pieces, 64-bit hashes and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
