"""The registered query of each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm import alignment, chat, codebooks, decontam, hostrules, jaccard, langid, mixing, substrings, suffixes, token_files, vectors, warc
from martloom.llm.shared import scratch, stored, table
from martloom.llm.codebook_sql import codebook_statement
from martloom.llm.hostrules_sql import host_rules_statement
from martloom.llm.statements import STATEMENTS


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, stored, and read back."""
    control = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    return chat.digest(stored(chat.expand(rows.unionByName(extra)), "chat"))


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back: responses with their payloads, which give
    length and digest, and revisits by a pushed-down filter without any payload."""
    path = scratch(spark, "warc")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), path)
    responses = warc.read_warc(spark, path).where("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", "refers_to",
    )
    revisits = warc.read_warc(spark, path, payload="false").where("record_type = 'revisit'").select(
        "record_id", F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", "refers_to",
    )
    return responses.unionByName(revisits).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", warc.page_of("refers_to").alias("refers_to"),
    )


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary, end_id=2)
    return token_files.read_tokens(spark, path, ids="crc32")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 90 % of their three-word shingles."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the mix of their sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep=["doc_id"]).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every test item: the verified pairs."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        *[F.round(F.max(c), 6).alias(c) for c in ("score", "question", "answer")])


def embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of a label against each other."""
    return vectors.near_groups(table(spark, sf_dir, "embeddings"), least=0.93)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 20-word windows that start earlier."""
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start in two places."""
    kept = suffixes.without_repeats(table(spark, sf_dir, "documents"), size=400)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound vectors as product codes of 8 parts, with 16 entries a part after 6 rounds."""
    return codebooks.code_table(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6)


def host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules of every document and the verdict of its source's shrunk failure rate."""
    judged = hostrules.judge(table(spark, sf_dir, "documents"), host="source", min_words=50,
                             max_repeat_pct=50, max_host_rate=0.5)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under both tokenizers: groups, links, and corpus-wide pair counts."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op2_column_wise_suffixes": suffix_dedup,
    "op8_fm_index_substrings": substring_dedup,
    "op7_int8_tile_vectors": embedding_groups,
    "op6_block_max_decontamination": decontamination,
    "op10_hyperdimensional_language": language_id,
    "op3_entropy_balancing": source_mix,
    "op1_elias_fano_tokens": token_output,
    "op4_multi_order_jaccard": jaccard_join,
    "op5_prefix_target_chat": chat_formatting,
    "op9_warc_source": warc_archive,
    "op11_cross_tokenizer_counts": tokenizer_alignment,
    "op12_host_quality_rules": host_quality,
    "op13_equal_average_codes": vector_codes,
}

ORACLES = {name: STATEMENTS[name] for name in QUERIES if name in STATEMENTS}
ORACLES["op12_host_quality_rules"] = host_rules_statement(min_words=50, max_repeat_pct=50, max_host_rate=0.5)
ORACLES["op13_equal_average_codes"] = codebook_statement(parts=8, entries=16, rounds=6)
