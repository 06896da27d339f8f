"""A corpus pipeline: language, near copies, repeated passages, source mix, packing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns rows. All but the last
return the columns of documents. Each stage's rows are written and read again as the next one's docs.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import langid, mixing, packing, rlz, simhash
from pagewright.llm._shared import remove, shared_folder

#: Language identification, hashes and tokenizers are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


#: Documents that go to one file, about; so files and tasks follow the data, however it was dealt out before.
FILE_DOCUMENTS = 10_000


def in_files(out: DataFrame, docs: DataFrame) -> DataFrame:
    """out, which has no more rows than docs or not many, in as many partitions as files are wanted."""
    return out.coalesce(max(1, math.ceil(docs.select("doc_id").count() / FILE_DOCUMENTS)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and scores 0.5 or more; no label is looked at in the decision."""
    return in_files(langid.accepted(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id (null sorts first)."""
    return in_files(simhash.keep_one(docs), docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word windows that start earlier too; those left without words go."""
    return in_files(rlz.without_repeats(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fill nine tenths of all tokens by the tree's weights, each once at most."""
    return in_files(mixing.taken(docs, share=0.9), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place in it."""
    return in_files(packing.query(docs), docs)


STAGES = [("language ID", language), ("near-dedup", near_copies), ("substring dedup", passages), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is a table in the shared folder until the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
            if i:
                remove(spark, f"{folder}/{i - 1}")
    return docs
