"""From raw documents to packed training sequences: five stages, each written and read again.

1. quality classifier: documents that importance resampling rejects go;
2. SimHash near-dedup: one document of each group of near copies stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: every secret's span is replaced by a mark, the document stays;
5. packing: the documents left are cut into sequences of token ids.

Stages 1 to 4 return the columns of their input. ``ORACLE_SQL`` is None, as SQL expresses neither the models nor
the hashes; tests/llm holds the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlake.llm import decontamination, importance, packing, secrets, simhash
from marketlake.llm.storage import materialise, ship_package, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return importance.select_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
