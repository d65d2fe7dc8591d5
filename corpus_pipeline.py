"""The corpus pipeline: language ID, toxicity, near-duplicates, decontamination, pieces.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that its predecessor kept;
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontam, langid, piece_fst, probminhash, toxicity
from flowloom.llm.common import shared_dir, table
from flowloom.llm.queries import TOXICITY, vocabulary

#: Share of the texts of known languages that may be called none of them.
LANGUAGE_LOSS = 0.005
#: The least score where labelled rows are too few to set one (under 1 / LANGUAGE_LOSS of them kept from the model). With
#: two families of two languages every winner has it, so only texts without a letter go then.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told stay: those that score like texts of a known language."""
    model, least = langid.calibrated(langid.training_rows(docs), LANGUAGE_LOSS, LEAST_LANGUAGE_SCORE)
    return langid.keep_identified(docs, model, least)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the chain doesn't call toxic stay."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), TOXICITY))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate class stays; rows without an id stay.

    Rows that share an id and a text stay once (the least by their columns); different texts of one id all stay.
    """
    gone = probminhash.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    kept = kept.groupBy("doc_id", F.sha2("text", 256)).agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row"))
    return kept.select("row.*").union(docs.where("doc_id is null"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no more of the benchmark than the rule allows stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, exact (decoding the ids gives the text back) of each text."""
    found = piece_fst.encode_exact(docs, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "exact")


STAGES = [("language", language), ("toxicity", civil), ("near-duplicates", distinct), ("decontamination", uncontaminated), ("pieces", pieces)]

#: Learned decisions, suffix arrays and shortest paths have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    work = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{work}/{k}-{name}")
        docs = spark.read.parquet(f"{work}/{k}-{name}")
    return docs
