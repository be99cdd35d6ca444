"""Documents to training sequences: language, exact copies, near copies, mix of sources, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starboard.llm.common import free_name, in_order_of, stored, with_row_key
from starboard.llm.exact_dedup import exact_dedup
from starboard.llm.language import confidence, identify_languages, is_known, least_confidence
from starboard.llm.mixing import mix_sources
from starboard.llm.packing import pack_documents
from starboard.llm.queries import documents, tokenizer_file
from starboard.llm.simhash import simhash_components


def with_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """Documents with a key for each row, and a hash of all columns that decides between rows with one id.

    The key only finds a row again: no order or choice follows it, as it changes with the files.
    """
    docs, row = with_row_key(docs)
    content = free_name(docs, "_content")
    return docs.withColumn(content, F.xxhash64(*(c for c in docs.columns if c != row))), row, content


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike all languages that the labels name, go; null texts are such.

    How much alike a text has to be is learned from the rows that the profiles are learned from. Texts are scored once;
    they are stored with their scores, and the threshold and the documents come from there.
    """
    name = free_name(docs, "language")
    found = stored(identify_languages(docs, name=name), "languages")
    learned = found.where(F.col("lang").isNotNull() & ~F.col(name)["held_out"] & (F.col(name)["grams"] > 0))
    least = least_confidence(learned.select(confidence(F.col(name)).alias("confidence")))
    return found.where(is_known(F.col(name), least)).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    keyed, row, content = with_keys(docs)
    kept = exact_dedup(keyed, order=("doc_id", content), row=row).where("kept").select(row)
    return keyed.join(kept, row).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links the one with the smallest doc_id stays."""
    keyed, row, content = with_keys(docs)
    found = simhash_components(keyed, order=("doc_id", content), row=row)
    kept = found.where(F.col("first")[row] == F.col(row)).select(row)
    return keyed.join(kept, row).select(*docs.columns)


def places_in_mix(keyed: DataFrame, row: str, content: str) -> DataFrame:
    """``row``, ``slot`` and ``place``; they follow the rows' contents alone, so that they can be found again."""
    return mix_sources(keyed, carry=(row,), by=(content,)).select(row, "slot", "place")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: files in order, rows in order within them."""
    keyed, row, content = with_keys(docs)
    places = places_in_mix(keyed, row, content).select(row, F.struct("slot", "place").alias("_mix"))
    at = free_name(docs, "_mix")
    joined = keyed.join(places.withColumnRenamed("_mix", at), row)
    return joined.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids in sequences. Each stretch of the mix is packed by itself, in its order.

    Sequence numbers follow the mix: that of a sequence stands where its first piece does. The places are found again from
    the rows, as the stage before returns documents only.
    """
    keyed, row, content = with_keys(docs)
    placed, position = in_order_of(keyed, row, places_in_mix(keyed, row, content), ("slot", "place"))
    return pack_documents(placed, tokenizer_file("word_bpe_49k.json"), position=position)


STAGES = [
    ("language", in_known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mix", mixed),
    ("pack", packed),
]

# Language profiles, SimHash and the tokenizer are not SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table ``documents``, each one's rows stored: pieces of the documents that stay, in sequences.

    Null, empty and letterless texts go in the first stage, and of equal rows one stays in the second. Of several rows
    with one id, or none, the content decides, so that two runs, and runs on the same rows in other files, agree on the
    documents and their mix. Whole texts are read, however long. Sources may be null. Other columns than those of
    documents are carried to the mix. An empty table gives no rows.
    """
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
