"""From raw documents to packed training sequences, in four stages.

Each stage takes what the one before it kept. The first three return whole rows of documents,
the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetable.llm.common import stored
from casetable.llm.exact_dedup import exact_dedup, one_space
from casetable.llm.jaccard_join import keep_one
from casetable.llm.ordinal import select_by_grade
from casetable.llm.packing import added_tokens, pack_documents, piece_length
from casetable.llm.queries import table, vocabulary

#: SQL cannot express a fitted classifier; the stages are tested one by one.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is good with a probability of at least one half; the model is fitted on ``labels``."""
    graded = select_by_grade(docs, table(spark, sf_dir, "labels"))
    return graded.where("graded.selected").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id, a null id last; of rows that share id and text one."""
    classes = stored(exact_dedup(docs), "classes").where("not kept")
    own = F.sha2(one_space(F.col("text")), 256)
    if not classes.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():  # usually there are none
        docs = docs.withColumn("_text", own).dropDuplicates(["doc_id", "_text"]).drop("_text")
    ids = classes.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    gone = stored(ids, "copies")  # written first: Spark then knows the size, and broadcasts only few
    same = F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (own == F.col("_gone_text"))
    return docs.join(
        gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text")), same, "left_anti"
    )


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id, a null id last; texts without words all stay.

    Rows that share an id are told apart by their texts, so unrelated texts of one id both stay.
    """
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    packed = pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), added_tokens(vocabulary("byte_bpe_50k.json")))
    return packed.select(
        "doc_id", "start", piece_length(F.col("ids")).alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
