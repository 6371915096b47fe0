"""A corpus-cleaning pipeline of four operators, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticelu.llm import decontam, langid, packing, simhash
from latticelu.llm.common import materialize, read
from latticelu.llm.queries import tokenizer_path
from latticelu.shipping import ship


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go.  Fitted on the stage's own labelled rows."""
    ship(spark)
    model = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    return docs.filter(~langid.predict(spark, model, F.col("text"))["lang_rejected"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    ship(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test passage go."""
    ship(spark)
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into training sequences."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Tokenising, fingerprints and packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
