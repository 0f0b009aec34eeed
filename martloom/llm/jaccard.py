"""N-gram Jaccard join with prefix filters under several global token orders.

1. A document's set is its distinct word shingles (64-bit hashes). Equal sets fall into one class,
   whose smallest doc_id stands for it; everything below works on class representatives.
2. Two sets of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` tokens under *every*
   global order, and three of the first ``n - ceil(t * n) + 3`` (or all they must share, if that is less). The
   first order is by corpus frequency (counted in a fixed table of hashed slots,
   2^18 numbers, whose size does not grow with the data), ties by hash. Only these prefixes are kept and
   dealt by token, and only tokens with two representatives or more stay as postings. The other
   orders are independent hash permutations: a candidate is compared as a whole only if the prefixes
   meet under each of them.
3. Candidates are verified on the whole sets, which are made again from the texts of the documents in
   some pair. First rounds of stars: each posting list has a head (the member with most list mates, then
   members by hash), and each representative is verified against the head it shares most lists with.
   Then, in lists that still hold two components or more, all pairs across components. A pair within one
   component cannot change the result, so no link is lost for membership, and a group of near copies is
   not expanded into its pairs.

Defined results: a null or white-space text has an empty set, belongs to no group and is its own
component. Null doc_ids are dropped (they cannot name a component). Rows that share a doc_id are
linked by it. Extra columns are ignored. Empty tables give empty results. Equality of shingles is
equality of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.groups import components
from martloom.llm.shared import stored
from martloom.llm.words import mixed, shingles, split_words, text_batches, word_hashes

_SLOTS = 1 << 18
#: Tokens a candidate pair shares in its first prefixes: chance rarely gives more than one or two.
_SHARED = 3
#: Rounds of stars before pairs across components.
_ROUNDS = 2
#: Seeds of the hash permutations used as second and third order.
_ORDERS = (0x51ED27, 0x2545F5)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _sets(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each row's text."""
    words, counts = split_words(batch.column("text"))
    hashes = word_hashes(words)
    ends = np.cumsum(counts)
    return [np.unique(shingles(hashes[e - n:e], size)) for e, n in zip(ends, counts)]


def _sums(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Two order-free sums of each set, which identify it."""
    return [
        np.array([mixed(r, seed).sum(dtype=np.uint64) for r in rows], np.uint64).view(np.int64) for seed in (1, 2)
    ]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64)))


def slot_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Sets per hashed token slot: summed per partition first, then per slot; at most 2^18 rows."""
    def count(batches):
        total = np.zeros(_SLOTS, np.int64)
        for batch in text_batches(batches):
            tokens = np.concatenate(_sets(batch, size))
            total += np.bincount((tokens % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    rows = _keyed(docs).select("text").mapInArrow(count, "slot long, n long")
    # As Arrow columns: row objects would take some 50 MB of the driver for a moment.
    summed = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SLOTS, np.int64)
    counts[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    return counts


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two sums that identify the set, and ``lead``: its prefix by frequency, rarest
    first. The set itself is not kept."""
    frequency = np.minimum(slot_counts(docs, size), np.iinfo(np.int32).max).astype(np.int32)
    counts = docs.sparkSession.sparkContext.broadcast(frequency)

    def sign(batches):
        table = counts.value
        for batch in text_batches(batches):
            rows = _sets(batch, size)
            leads = []
            for t in rows:
                p = int(prefix_length(np.int64(len(t)), percent)) + _SHARED - 1 if len(t) else 0
                common = table[(t % np.uint64(_SLOTS)).astype(np.int64)]
                leads.append(t[np.lexsort((mixed(t, 7), common))[:p]])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()),
                *[pa.array(x) for x in _sums(rows)], _lists(leads),
            ], ["doc_id", "n_shingles", "s1", "s2", "lead"])

    return _keyed(docs).mapInArrow(sign, "doc_id long, n_shingles long, s1 long, s2 long, lead array<long>")


def postings(reps: DataFrame) -> DataFrame:
    """``token, id, n, pos`` of prefix tokens that two representatives or more have, the ``mates`` of each in
    all its lists, and its ``root``, itself."""
    rows = reps.select("id", F.col("n").cast("int").alias("n"), F.posexplode("lead").alias("pos", "token"))
    whole = Window.partitionBy("token")
    rows = rows.select(
        "*", F.min("id").over(whole).alias("_low"), F.max("id").over(whole).alias("_high"),
        F.count("*").over(whole).alias("_size")).where("_low <> _high").drop("_low", "_high")
    rows = stored(rows, "shared-tokens")
    mates = rows.groupBy("id").agg(F.sum("_size").alias("mates"))
    return rows.drop("_size").join(mates, "id").withColumn("root", F.col("id"))


def still_open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists that hold two components or more, with the components known now."""
    rows = lists.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("component_id", "id"))
    whole = Window.partitionBy("token")
    rows = rows.select("*", F.min("root").over(whole).alias("_low"), F.max("root").over(whole).alias("_high"))
    return rows.where("_low <> _high").select(*lists.columns)


def _can_link(n_a: str, pos_a: str, n_b: str, pos_b: str, percent: int) -> F.Column:
    """Length and position filters of two sets that share a token at these places of their prefixes."""
    n_a, pos_a, n_b, pos_b = (F.col(c) for c in (n_a, pos_a, n_b, pos_b))
    # Seen before this token: at most the shorter prefix, so the overlap can still be enough.
    shared = F.least(pos_a, pos_b) + F.least(n_a - pos_a, n_b - pos_b)
    return (F.least(n_a, n_b).cast("long") * 100 >= F.greatest(n_a, n_b) * percent) & (
        (100 + percent) * shared.cast("long") >= percent * (n_a + n_b))


def _enough(met: DataFrame, percent: int) -> DataFrame:
    """``a, b, shared, rest, both`` of the pairs in ``met`` (a row per shared token: a, b, n_a, n_b) that share
    as many prefix tokens as a link must; ``rest`` bounds what can be shared beyond, ``both`` adds the sizes."""
    least = lambda n: F.expr(f"({percent} * cast({n} as long) + 99) div 100")
    # Rows that share a doc_id can differ in size: the most lenient sizes decide.
    return met.groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.least(F.lit(_SHARED), F.min(least("n_a")), F.min(least("n_b"))).alias("_need"),
        # The prefix that ends first in the order leaves only its own remainder to share.
        F.greatest(F.max(least("n_a")), F.max(least("n_b"))).alias("_most"), F.min(F.col("n_a") + F.col("n_b")).alias("both"),
    ).where("shared >= _need").select("a", "b", "shared", F.greatest(F.col("_most") - _SHARED, F.lit(0)).alias("rest"), "both")


def stars(lists: DataFrame, percent: int, turn: int = 0) -> DataFrame:
    """Each representative with the list head of another component it shares most lists with: pairs ``a, b``.
    The head has the most mates in turn 0; later turns take heads by hash."""
    rank = F.col("mates") if not turn else F.xxhash64("id", F.lit(turn))
    head = F.max(F.struct(rank.alias("rank"), "id", "n", "pos", "root")).over(Window.partitionBy("token"))
    met = lists.withColumn("head", head).where("root <> head.root").where(
        _can_link("n", "pos", "head.n", "head.pos", percent))
    met = met.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"))
    best = _enough(met, percent).groupBy("b").agg(F.min(F.struct((-F.col("shared")).alias("most"), "a")).alias("at"))
    return best.select("at.a", "b")


def across(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of different components whose prefixes share enough for a link. Every list two such
    sets share is here, so the shared tokens are complete."""
    side = lambda x: lists.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "root")])
    pairs = side("a").join(side("b"), "token").where("id_a < id_b AND root_a <> root_b")
    met = pairs.where(_can_link("n_a", "pos_a", "n_b", "pos_b", percent)).select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b")
    return _enough(met, percent).where(
        (100 + percent) * (F.col("shared") + F.col("rest")) >= percent * F.col("both")).select("a", "b")


def prefixes_meet(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the prefixes of two sets meet under each of the hash orders."""
    for seed in _ORDERS:
        # A permutation keeps equality, so the smallest hashes stand for their tokens.
        heads = [np.sort(mixed(t, seed))[:int(prefix_length(np.int64(len(t)), percent))] for t in (x, y)]
        if not len(np.intersect1d(*heads, assume_unique=True)):
            return False
    return True


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, counted on the whole sets. ``pairs`` should be
    a table; the sets of the documents in it are made from their texts, once per id and set."""
    def sets(batches):
        for batch in text_batches(batches):
            rows = _sets(batch, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x) for x in _sums(rows)], _lists(rows)], ["id", "s1", "s2", "tokens"])

    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "compared")
    found = _keyed(docs).join(wanted, "doc_id", "left_semi").mapInArrow(
        sets, "id long, s1 long, s2 long, tokens array<long>")
    found = found.repartition("id").dropDuplicates(["id", "s1", "s2"])
    side = lambda x: found.select(F.col("id").alias(x), F.col("tokens").alias(f"t_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def check(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                keep = []
                for x, y in zip(batch.column("t_a"), batch.column("t_b")):
                    x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                    meet = len(x) and len(y) and prefixes_meet(x, y, percent)
                    both = len(np.intersect1d(x, y, assume_unique=True)) if meet else 0
                    keep.append(bool(meet) and 100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(check, "a long, b long")


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document; links have Jaccard similarity of
    at least ``percent`` / 100 on shingles of ``size`` words. ``docs`` should be a table, as it is read
    several times."""
    signed = stored(signatures(docs, size, percent), "signatures")
    same_set = ["n_shingles", "s1", "s2"]
    reps = stored(
        signed.where("n_shingles > 0").groupBy(*same_set).agg(F.min("doc_id").alias("id"), F.first("lead").alias("lead")),
        "reps",
    )
    lists = stored(postings(reps.select("id", F.col("n_shingles").alias("n"), "lead")), "postings")
    links = None
    for turn in range(_ROUNDS):
        found = stored(verified(stored(stars(lists, percent, turn), "stars"), docs, size, percent), "verified")
        links = found if links is None else links.unionAll(found)
        lists = stored(still_open(lists, stored(components(links), "roots")), "postings")
    rest = stored(across(lists, percent), "rest")
    links = links.unionAll(stored(verified(rest, docs, size, percent), "verified"))
    same = signed.where("n_shingles > 0").join(reps.select(*same_set, "id"), same_set).where("doc_id <> id").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    # Copies hang on their representative after the components of representatives are known, unless
    # a doc_id stands in several rows.
    found = components(links.unionAll(same))
    return signed.select("doc_id", "n_shingles").join(
        found.withColumnRenamed("id", "doc_id"), "doc_id", "left"
    ).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
