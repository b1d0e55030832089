"""A corpus pipeline of five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents:

1. quality: documents that the quality classifier rejects go;
2. exact dedup: of equal texts the smallest id stays;
3. near dedup: of each group of near copies (five-word shingles, similarity of
   0.8 or more) the smallest id stays;
4. mixing: what the mix of sources to target weights takes, a row for each
   document and pass over its source;
5. encoding: the token ids of every text.

Nulls in any column, empty and repeated rows and empty tables are handled as the
operators say; columns beyond those of documents pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.llm.common import own_dir, table
from ashlar.llm.exact_dedup import drop_copies
from ashlar.llm.mixing import mixed_documents
from ashlar.llm.quality import good_documents
from ashlar.llm.sentencepiece_trie import encode, read_model
from ashlar.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score at least the threshold, as learned from labels and these docs."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each text (A-Z in either case)."""
    return drop_copies(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each group of near copies."""
    return drop_near_copies(docs, k=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: texts taken in a pass, n_chars to match."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and round_trip for every row."""
    out = encode(docs, read_model(spark), ["doc_id", "source"])
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("SentencePiece encoding", encoding),
]

#: Fitting, fingerprints and random draws can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    work = own_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{work}/{i}")
            docs = spark.read.parquet(f"{work}/{i}")
    return docs
