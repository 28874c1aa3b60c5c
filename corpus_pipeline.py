"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, as a table with the columns of documents, and its decisions take
effect; the last one returns the pieces of the packed sequences. The mixing stage writes its rows in training order;
packing finds that order again in the names and row numbers of the files, and returns sequences sorted by it.

Defined cases of every stage: null texts count as empty, are never toxic unless empty texts are, and are copies of
each other and of empty texts; documents without words have no near copies and are never mixed in; rows without an
id, or with one that others have, are kept apart by their place in the table; of rows that repeat, one stays after
exact deduplication; texts of any length are judged, compared, mixed and packed whole; further columns are kept,
whatever their names; an empty table, or labels that fit no document, give a table with the same columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courierlake.llm.exact_dedup import drop_exact_copies
from courierlake.llm.jaccard_join import similar_documents
from courierlake.llm.mixing import mixed_rows
from courierlake.llm.packing import pack_documents
from courierlake.llm.shared import discard, materialize, table, unused
from courierlake.llm.toxicity import fit_toxicity, score_toxicity

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = unused(docs.columns, "score")
    return score_toxicity(docs, model, carry=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_exact_copies(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: the one with the smallest id."""
    uid = unused(docs.columns, "uid")
    numbered = docs.withColumn(uid, F.monotonically_increasing_id())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col(uid))
    found = similar_documents(numbered.select(place.alias("place"), "text"), id_col="place")
    dropped = found.where(F.col("place") != F.col("component_id")).select(f"place.{uid}")
    return numbered.join(dropped, uid, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream in order: documents as often as their source's target asks for."""
    return mixed_rows(docs)


def place_in_files(docs: DataFrame) -> Column:
    """Grows along the rows of a table as they were written: number of the file, then of the row in it."""
    try:
        # Refused where docs is no table of files.
        docs.select("_metadata.row_index")
    except AnalysisException:
        return F.monotonically_increasing_id()
    number = lambda mark: F.coalesce(F.regexp_extract("_metadata.file_name", rf"{mark}(\d+)", 1).try_cast("bigint"), F.lit(0))
    return F.shiftleft(number("part-"), 42) + F.shiftleft(number("-c"), 32) + F.col("_metadata.row_index")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 tokens, in training order."""
    import public_tokenizers

    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), digests={"ids_crc32": F.crc32("ids")}, due=place_in_files(docs))
    packed = packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "due")
    return packed.orderBy("due", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix),
    ("packing", pack),
]

#: The stages learn, hash and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
