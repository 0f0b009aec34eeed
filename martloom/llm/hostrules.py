"""Quality rules with host-level verdicts, in Spark SQL functions only.

Per document, base rules are computed inside the row, without a shuffle: words are runs of
``[^\\x20\\x09-\\x0D]``; ``word_chars`` counts their code points, ``n_symbols`` the characters of
``[#*$%&|<>]``, ``n_dup_lines`` the ``\\n``-split lines holding a word that equal an earlier such line
(lines with a word minus distinct ones), and ``n_repeat_words`` the word places covered by a 3-word
window that occurs twice or more in the text. Repeated windows are found by sorting the windows of
the text (with their places) and comparing neighbours, so a text of n words costs n log n, whatever its
length. A document fails the base rules when it has fewer than ``min_words`` words or when more than
``max_repeat_pct`` percent of its words are repeated.

Host verdicts: failures are counted per host (map-side partial sums, so a host with a third of all
rows is one row per task). The failure rates of the hosts are shrunk towards an empirical beta prior
fitted by moments over all hosts: with mean ``mu`` and population variance ``var`` of the host rates,
``kappa = mu (1 - mu) / var - 1`` (no shrinkage when that is not positive; every host at ``mu`` when
``var`` is 0), and a host's rate becomes ``(failed + mu kappa) / (docs + kappa)``. Hosts whose shrunk
rate exceeds ``max_host_rate`` are rejected. Only the two moments reach the driver; host verdicts are
joined back by a size-checked join (broadcast up to a bound, salted beyond it).

Defined results: a null text has no words and no lines (it fails the base rules). Documents with a null
host get no host verdict and are judged by the base rules alone; they are not part of the prior.
Repeated rows are judged one by one and counted as often as they occur. Extra columns are ignored;
the result has ``doc_id``, ``host`` and the rule columns. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.shared import sized_join, stored

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def base_rules(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    step1 = docs.select(
        "*", F.regexp_extract_all(t, F.lit(WORD), 0).alias("_words"),
        F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD)).alias("_lines"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    triples = F.arrays_zip(F.col("_words").alias("a"), F.slice("_words", 2, F.greatest(n, F.lit(1))).alias("b"),
                           F.slice("_words", 3, F.greatest(n, F.lit(1))).alias("c"))
    windows = F.slice(
        F.transform(triples, lambda z, i: F.struct(F.concat_ws(" ", z["a"], z["b"], z["c"]).alias("w"), i.alias("p"))),
        1, F.greatest(n - 2, F.lit(0)))
    step2 = step1.select(
        "*", F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.array_sort(windows).alias("_sorted"),
    )
    m = F.size("_sorted")
    after = F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(m, F.lit(1))), lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False)))
    step3 = step2.select("*", after.alias("_next"))
    near = F.zip_with("_next", F.concat(F.array(F.lit(False)), F.col("_next")), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    step4 = step3.select("*", F.slice(near, 1, F.greatest(m, F.lit(1))).alias("_rep"))
    places = F.filter(F.zip_with("_sorted", "_rep", lambda s, r: F.when(r, s["p"])), lambda p: p.isNotNull())
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2))))
    step5 = step4.select("*", F.size(covered).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    return step5.drop("_words", "_lines", "_sorted", "_next", "_rep").withColumn("base_failed", failed)


def host_verdicts(rated: DataFrame, max_host_rate: float = 0.5) -> DataFrame:
    """One row a host: docs, failed, shrunk failure rate and host_ok."""
    hosts = rated.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    moments = hosts.agg(F.avg(rate).alias("mu"), F.var_pop(rate).alias("var")).first()
    if moments is None or moments.mu is None:
        shrunk = rate
    elif moments.var == 0:
        shrunk = F.lit(float(moments.mu))
    else:
        kappa = max(moments.mu * (1 - moments.mu) / moments.var - 1, 0.0)
        shrunk = (F.col("failed") + F.lit(moments.mu * kappa)) / (F.col("docs") + F.lit(kappa))
    return hosts.select("host", "docs", "failed", shrunk.alias("host_rate")).withColumn(
        "host_ok", F.col("host_rate") <= F.lit(max_host_rate))


def judge(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = 50,
          max_repeat_pct: int = 50, max_host_rate: float = 0.5) -> DataFrame:
    """Per document: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate (null without a host) and kept."""
    rated = base_rules(docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("_text")),
                       "_text", min_words, max_repeat_pct).drop("_text")
    rated = stored(rated, "host-rules")
    hosts = stored(host_verdicts(rated, max_host_rate).select("host", "host_rate", "host_ok"), "host-verdicts")
    joined = sized_join(rated, hosts, "host")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "host_rate",
        (~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"),
    )
