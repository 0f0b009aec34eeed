"""A corpus from documents to token files, as a chain of stored stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm import decontam, jaccard, langid, mixing, token_files
from martloom.llm.shared import scratch, stored, table


def keep_recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which language ID finds a language."""
    return langid.recognised(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each similarity group (five words, 0.8): of the smallest doc_id (nulls last), then text
    hash, then row key. Rows are told apart by a stored key, so doc_ids may repeat or be null."""
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    groups = jaccard.jaccard_groups(keyed.select(F.col("_row").alias("doc_id"), "text"), size=5, percent=80)
    # A row outside all groups is its own component; only rows of real groups are compared.
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"), "component_id")
    heads = others.select(F.col("component_id").alias("_row"), "component_id").distinct()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    members = stored(
        keyed.select("_row", place.alias("place")).join(others.unionAll(heads), "_row").select("component_id", "place"),
        "near-copies")
    first = members.groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place._row").alias("_row"))
    # Stored, so that its size is known: a small one is broadcast and the texts are not shuffled.
    gone = stored(members.select(F.col("place._row").alias("_row")).join(first, "_row", "left_anti"), "gone")
    return keyed.join(gone, "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.copied(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = scratch(spark, "pipeline-tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path, ids="crc32")


STAGES = [
    ("language_id", keep_recognised),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Language ID, similarity groups, and token files have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
