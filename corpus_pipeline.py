"""A corpus pipeline over documents: quality rules, near-duplicate removal, decontamination, pseudonyms, packing.

Each stage gets what the one before it kept, reads it whole, and its decisions take effect. All but the last
return the columns of documents; their output is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabricloom.llm import decontamination, jaccard, packing, pii, quality
from fabricloom.llm.common import Staged, aside
from fabricloom.llm.tokens import public_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and very short texts go."""
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of the smallest doc_id (null before all), and of several texts with
    that doc_id the one whose hash is least. Documents without words have no near duplicates; of them equal texts of
    one doc_id go but for one."""
    plain, restore = aside(docs)
    rows, group = jaccard.grouped(plain)
    first = group.where("x > 0").groupBy("group").agg(F.min(F.struct("doc", "th")).alias("one")).select("one.doc", "one.th", F.lit(True).alias("_first"))
    alone = group.where("x = 0").select("doc", "th", F.lit(True).alias("_first")).distinct()
    stays = first.unionByName(alone).dropDuplicates(["doc", "th"])
    kept = rows.join(stays.hint("shuffle_hash"), ["doc", "th"], "left_semi")
    return restore(kept.dropDuplicates(["doc", "th"]).select(plain.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, restore = aside(docs)
    found = decontamination.find(plain, benchmark)
    return restore(found.where(F.size("spans") == 0))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    plain, restore = aside(docs)
    out = restore(pii.pseudonymise(plain, pii.DEMO_KEY))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4,096 tokens."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("packing", pack),
]
ORACLE_SQL = None  # tokenization has no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        done = Staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = done.df, done
    return STAGES[-1][1](spark, docs, sf_dir)
