"""A training-data pipeline over the documents table, stage by stage.

All stages but the last return the columns of documents (COLUMNS); other columns of an input are dropped. Rows without
doc_id stay: they are scored for toxicity, and neither compared nor matched. Rows that repeat a doc_id stay or go
together in the near-duplicate and decontamination stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.llm import bpe_codec, decontamination, near_dedup, substring_dedup, toxicity
from panelkiln.llm.sparkops import ensure_checkpoint_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of under 0.5 stay."""
    scored = toxicity.score(docs.select(*COLUMNS), toxicity.fitted(spark, docs, sf_dir))
    return scored.where("toxicity < 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    gone = near_dedup.near_duplicates(docs, width=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur before are cut out; n_chars follows the text. Rows whose whole text is cut go."""
    done = substring_dedup.remove_repeated(docs.select(*COLUMNS))
    done = done.where("span_hits = 0 OR trim(text) <> ''")
    return done.withColumn("n_chars", F.when(F.col("span_hits") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go."""
    judged = decontamination.judged(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(judged.where("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of each document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.encoded_with_digests(docs, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
#: Learned scores and tokenization are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what each stage returns is written to the shared folder and reread."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}-{name}"
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
