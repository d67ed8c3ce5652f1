"""The stages that make a training corpus of ``documents``; each calls one operator of ``pageloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; every result is
written and read again. Rows are whole rows of ``documents``, in no order, until the last stage.

Defined results: a document with a null text passes every stage; rows of one doc_id are judged
each by itself, but that near-dedup keeps one row of a group; no document, no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, line_dedup, piece_codec, pieces, simhash, toxicity
from pageloom.session import stored, table

REJECTED_FROM = 0.5


def whole(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, from the struct ``row``."""
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. The model learns from the labels of the documents given."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return whole(docs, toxicity.scored(docs, model, docs.columns).where(F.col("score") < REJECTED_FROM))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand in an earlier document (or earlier in the same one) go; no document does.

    n_chars follows the text where a chunk went.
    """
    others = [c for c in docs.columns if c != "text"]
    found = line_dedup.dedup_lines(docs, others)
    n_chars = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[{"text": F.col("text"), "n_chars": n_chars}.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash (four-word shingles, four bits) the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words one in twenty or more lies in a passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return whole(docs, found.where(~F.col("contaminated")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number, and the SHA-256 of the text decoded from them."""
    found = piece_codec.there_and_back(docs, pieces.load(), ["doc_id"])
    return found.select("row.doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated), ("encoding", encode),
]

ORACLE_SQL = None    # neither learned scores nor components nor merges can be said in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
