"""Mixing sources to target weights by entropy balancing.

Each source is to give a share of all words. Targets above ``most`` times a source's size stop
there, and the excess is shared again by weight among the rest. Among all ways to weigh documents
whose source totals meet the targets, the one closest in relative entropy to the words as they are
gives each document the rate ``exp(lambda_source)``. The ``lambda`` are the maximum of the concave
dual ``sum(target * lambda - words * exp(lambda))``, found by Newton steps over the source table; that
table is aggregated from the documents on the map side, and one residual a step reaches the driver.

Rates are rounded into whole copies: with the documents of a source ordered by size, the k-th gets
``floor(rate) + [k * f rounds up]`` for the fraction ``f``. As the sizes are monotone, the words
taken differ from the target by less than the largest document. The order is not one window over
a source: counts per (source, size, hash bucket) give the start of each bucket of about 4096.

Defined results: a null text has size 0. A null source is a source of its own, ranked last. A null
doc_id is a row as any other. Rows that repeat are mixed each on its own. A source without words has target 0.
Empty tables give empty results. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.shared import WORD, stored

_BUCKET = 4096


def words_of(text: str) -> F.Column:
    """Words between ASCII white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """``_source, source_size, target`` from ``_source, _size``: weights 1, 2, 3, repeating, by the
    source's code points, null last."""
    sources = stored(sizes.groupBy("_source").agg(F.sum("_size").alias("source_size")), "sources")
    # A row per source: ranks by range partition and partition offsets.
    names = sources.sort(F.col("_source").asc_nulls_last())
    ranked = names.select("*", F.monotonically_increasing_id().alias("_m"))
    ranked = stored(ranked.select("*", F.shiftright("_m", 33).alias("_part"), F.expr("_m & 8589934591").alias("_k")), "ranked")
    parts = ranked.groupBy("_part").agg(F.count("*").alias("n"))
    offset = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("_start"))
    weighed = ranked.join(starts, "_part").select(
        "_source", "source_size", ((F.col("_start") + F.col("_k")) % 3 + 1).cast("double").alias("weight"))
    # Filling up: each round stops sources above their limit until none is.
    table = stored(weighed.withColumn("full", F.lit(False)), "targets")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        limit = F.col("source_size") * most
        used, weight = table.agg(
            F.sum(F.when(F.col("full"), limit)), F.sum(F.when(~F.col("full"), F.col("weight")))
        ).first()
        left = total - float(used or 0)
        share = F.when(F.col("full"), limit).otherwise(F.lit(left) * F.col("weight") / F.lit(weight or 1.0))
        above = ~F.col("full") & (share > limit)
        if not table.where(above).limit(1).count():
            return table.select("_source", "source_size", share.alias("target"))
        table = stored(table.withColumn("full", F.col("full") | above), "targets")


def entropy_rates(targets: DataFrame, tolerance: float = 1e-12, rounds: int = 200) -> DataFrame:
    """Adds ``rate`` = exp(lambda) by Newton steps on the dual; 0 for a target of 0."""
    step = (F.col("target") - F.col("_now")) / F.col("_now")
    state = targets.withColumn("lam", F.lit(0.0))
    for k in range(rounds):
        now = state.withColumn("_now", F.col("source_size") * F.exp("lam"))
        # The dual is concave; steps are bounded so that a far start cannot overflow.
        state = now.withColumn(
            "lam", F.when((F.col("target") > 0) & (F.col("_now") > 0), F.col("lam") + F.least(step, F.lit(2.0)))
            .otherwise(F.col("lam"))
        ).drop("_now")
        if k % 5 == 4:
            state = stored(state, "dual")
            miss = F.abs(F.col("source_size") * F.exp("lam") / F.col("target") - 1)
            worst = state.where("target > 0").agg(F.max(miss)).first()[0]
            if worst is None or worst <= tolerance:
                break
    return state.select(*targets.columns, F.when(F.col("target") > 0, F.exp("lam")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, most: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with the columns ``keep`` (all without it) and ``_size, _source_size, _target,
    _copies``. The kept columns are stored once beside size, source and hashes, and shuffled once; a
    text that is not kept is read once and goes no further."""
    keep = docs.columns if keep is None else keep
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = docs.select(
        *[F.col(f"`{c}`") for c in keep], words_of("text").alias("_size"),
        F.col("source").cast("string").alias("_source"), key.alias("_key"),
        F.xxhash64("doc_id", "text").alias("_hash"), F.xxhash64("text").alias("_tie"), F.col("doc_id").alias("_doc"),
    )
    sized = stored(sized, "sized")
    rates = entropy_rates(source_targets(sized.select("_source", "_size"), most)).select(
        F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n")).alias("_key"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        F.least(F.col("rate"), F.lit(float(most))).alias("_rate"),
    )
    # Bucket widths by the count of each size; all but the sizes of many documents have one bucket.
    per_size = sized.groupBy("_key", "_size").agg(F.count("*").alias("_n")).where(f"_n >= {_BUCKET}")
    wide = stored(per_size.select("_key", "_size", F.expr(f"1 + _n div {_BUCKET}").alias("_width")), "widths")
    placed = sized.join(F.broadcast(wide), ["_key", "_size"], "left").withColumn(
        "_bucket", F.expr("pmod(_hash, coalesce(_width, 1))"))
    # Starts by running totals of bucket counts.
    counts = placed.groupBy("_key", "_size", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_size", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_key", "_size", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")).join(rates, "_key")
    inside = Window.partitionBy("_key", "_size", "_bucket").orderBy("_hash", "_doc", "_tie")
    k = F.col("_start") + F.col("_rank")
    whole = F.floor("_rate")
    part = F.col("_rate") - whole
    copies = whole + F.floor(k * part + 0.5) - F.floor((k - 1) * part + 0.5)
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(starts, ["_key", "_size", "_bucket"])
        .select(*[F.col(f"`{c}`") for c in keep], "_size", "_source_size", "_target", copies.alias("_copies"))
    )


def copied(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns as given."""
    return mix(docs, most).withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(_copies as int))"))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
