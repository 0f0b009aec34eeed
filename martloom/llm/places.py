"""Places of segments: which are equal, which share a key with others, and their content where it is needed.

A segment travels as ``key, doc_id, text_hash, start, n, h``: its place, length and 64-bit content hash, never its
content. Equal segments have equal ``key``, ``n`` and ``h``. The places of a key meet in one task, as rows of fixed
width that Spark sorts and spills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "key long, doc_id long, text_hash long, start long, n int, h long"


def compared(rows: DataFrame) -> DataFrame:
    """``rows`` without segments that are alone under their key, after one shuffle, with ``first`` (one row of each
    group of equal segments, at its earliest place; null doc_ids last), ``later`` (places after the earliest),
    ``copied`` (an equal segment has another row), and of the key: ``distinct`` segments and their total ``size``."""
    equal = Window.partitionBy("key", "h", "n").orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash", "start")
    whole = Window.partitionBy("key")
    rows = rows.repartition("key").select(
        "*", F.row_number().over(equal).alias("_turn"), F.rank().over(equal).alias("_rank"),
        F.lead("n").over(equal).isNotNull().alias("_more"))
    first = F.col("_turn") == 1
    return rows.select(
        "key", "doc_id", "text_hash", "start", "n", first.alias("first"), (F.col("_rank") > 1).alias("later"),
        (F.col("_more") | ~first).alias("copied"), F.sum(first.cast("int")).over(whole).alias("distinct"),
        F.sum(F.when(first, F.col("n"))).over(whole).alias("size"),
    ).where("copied OR distinct > 1")


def matched(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text_hash``) joined to ``lists``, which has a row a document."""
    other = lists.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"}).hint("merge")
    same = F.col("text_hash").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    return docs.join(other, same, how).drop("_d", "_h")


def with_picks(docs: DataFrame, places: DataFrame, max_rows: int = 1 << 20) -> DataFrame:
    """``doc_id, text_hash, text, picks`` of the documents in ``places``, to cut those segments again. Up to
    ``max_rows`` documents, other texts are left out before the shuffle. Rows equal in doc_id and text all appear."""
    picks = places.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("key", "start", "n")).alias("picks"))
    wanted = places.select("text_hash").distinct()
    if wanted.count() <= max_rows:
        docs = docs.join(F.broadcast(wanted), "text_hash", "left_semi")
    return matched(docs, picks, "inner").select("doc_id", "text_hash", "text", "picks")


def per_document(spans: DataFrame) -> DataFrame:
    """``doc_id, text_hash, starts, stops`` of distinct ``spans``; they are bounded by the document's length."""
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("_s")).select(
        "doc_id", "text_hash", F.col("_s.start").alias("starts"), F.col("_s.stop").alias("stops"))
