"""Mixing sources to target weights by weighted fair queueing.

Every document's place in its shuffled source gives it a virtual finish time: the source's words up to and with it, over the
source's target. A source that may be taken several times goes on with further passes. All passes are put in the order of their
finish times and cut where the total budget is reached.

No step sorts a whole source or the corpus in one task: prefix sums are taken over hash buckets of a source and then within a
bucket, and the cut is found by two rounds of bucket sums before one exact sort of a single small bucket.

Defined cases: null text counts 0 words; a null source is a source of its own, last in order; rows are queued one by one, so rows
that repeat a doc_id, or are equal in all, are documents of their own; rows with a null doc_id are shuffled by their text; an empty
table gives no rows; extra columns are kept by apply_mix(), whatever their names, and ignored by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import table, word_count, written

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
#: Buckets of finish times in each of the two rounds.
SLOTS = 4096


def targets(sized: DataFrame, weights=WEIGHTS, passes: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """sized: _s (source key), size -> _s, source_size, target. One row a source; shares are levelled in one pass over the
    sources in order of how soon they reach their limit, which is where resharing by weight ends."""
    every, rank = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy("_s")
    per = sized.groupBy("_s").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(rank) - 1) % len(weights) + 1))
    per = per.withColumn("_limit", F.col("source_size") * passes)
    per = per.withColumn("_all", F.sum("source_size").over(every) if budget is None else F.lit(budget))
    order = W.orderBy(F.col("_limit") / F.col("_w"), "_s")
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    before = F.coalesce(F.sum("_limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_level", (F.col("_all") - before) / rest).withColumn("_full", F.col("_limit") <= F.col("_level") * F.col("_w"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_limit") / F.col("_w"), "_s", "_level"))).over(every)["_level"]
    return per.select("_s", "source_size", F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(F.col("_w") * level).alias("target"))


def finish(passed: Column) -> Column:
    return (passed * F.col("source_size") + F.col("_upto")) / F.col("target")


def source_key() -> Column:
    """'a...' sorts by code point and before 'b', which stands for null."""
    return F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))


def digest() -> Column:
    """By which a source is shuffled."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))


#: The order within a source; rows that tie in all of it are alike to the queue.
SHUFFLED = ("_h", "doc_id", "size")


class Queue:
    """What is known of all rows before they are queued: words by source and hash bucket, sources' targets, and the cut."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, passes: int = MOST_PASSES, budget: int | None = None):
        self.passes = passes
        sized = written(docs.select("doc_id", source_key().alias("_s"), word_count(F.col("text")).alias("size"), digest().alias("_h")))
        n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.digits = max(2, min(6, len(f"{max(1, n // 2000):x}")))  # of the hash: about two thousand rows of all in a bucket
        sized = sized.withColumn("_b", F.substring("_h", 1, self.digits))
        base = sized.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
        goal = targets(sized, weights, passes, budget)
        self.base = base.withColumn("_base", F.sum("_n").over(W.partitionBy("_s").orderBy("_b")) - F.col("_n")).drop("_n").join(goal, "_s")
        self.rows = written(self.placed(sized))
        self.cut = cut_at(self.rows, passes, total if budget is None else budget)

    def placed(self, sized: DataFrame) -> DataFrame:
        """Rows (_s, _b, _h, doc_id, size) with source_size, target and _upto: the source's words up to and with each."""
        within = W.partitionBy("_s", "_b").orderBy(*SHUFFLED).rowsBetween(W.unboundedPreceding, 0)
        return sized.join(self.base, ["_s", "_b"]).withColumn("_upto", F.col("_base") + F.sum("size").over(within)).drop("_b", "_base")

    def takes(self) -> Column:
        """How many times a placed row is taken; one without words never."""
        if self.cut is None:
            return F.lit(0)
        last = F.struct(F.lit(self.cut[0]), F.lit(self.cut[1]), F.lit(self.cut[2]), F.lit(self.cut[3]).cast("long"))
        return sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & (F.struct(finish(F.lit(e)), "_s", "_h", place_of_id()) <= last), 1).otherwise(0) for e in range(self.passes)), F.lit(0))


def place_of_id() -> Column:
    """A null doc_id comes before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, passes: int = MOST_PASSES, budget: int | None = None) -> DataFrame:
    """docs (doc_id, source, text) -> doc_id, size, source_size, target, taken (words, repeats counted)."""
    queue = Queue(docs, weights, passes, budget)
    return queue.rows.select("doc_id", "size", "source_size", "target", (F.col("size") * queue.takes()).cast("long").alias("taken"), "_s")


def cut_at(queued: DataFrame, passes: int, budget: int) -> tuple | None:
    """The last pass (finish time, source key, hash, doc_id) within the budget in finish order; None if there is none."""
    runs = queued.filter("target > 0 and size > 0").select("*", F.explode(F.array(*[F.lit(e) for e in range(passes)])).alias("_e")).withColumn("_f", finish(F.col("_e")))
    runs = runs.withColumns({"_slot": F.least(F.floor(F.col("_f") * SLOTS), F.lit(2 * SLOTS)).cast("int")})
    runs = runs.withColumn("_fine", F.least(F.floor((F.col("_f") * SLOTS - F.col("_slot")) * SLOTS), F.lit(SLOTS)).cast("int"))
    before = 0
    for c in ("_slot", "_fine"):
        sums = sorted(map(tuple, runs.groupBy(c).agg(F.sum("size")).collect()))  # 2 * SLOTS rows at most
        for slot, words in sums:
            if before + words > budget:
                break
            before += words
        else:
            slot = sums[-1][0] if sums else None
            before -= sums[-1][1] if sums else 0
        if slot is None:
            return None
        runs = runs.filter(F.col(c) == slot)
        if c == "_slot":
            first = slot
    tail = runs.select(F.struct("_f", "_s", "_h", place_of_id().alias("_i")).alias("_at"), "size")
    tail = tail.withColumn("_sum", F.sum("size").over(W.orderBy("_at").rangeBetween(W.unboundedPreceding, 0)) + before)
    got = tail.filter(F.col("_sum") <= budget).agg(F.max("_at").alias("m")).first()["m"]
    if got is None:  # the cut lies at the start of this fine slot
        return (first / SLOTS + slot / SLOTS / SLOTS, "", "", -(1 << 62))
    return tuple(got)


def apply_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with all their columns; a row taken k times is k rows, one not taken is none. Whole rows are placed
    in the queue as their sizes were, so each gets takes of its own; texts are exchanged once."""
    queue = Queue(docs, **how)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), "doc_id", source_key().alias("_s"), word_count(F.col("text")).alias("size"), digest().alias("_h"))
    placed = queue.placed(own.withColumn("_b", F.substring("_h", 1, queue.digits)))
    return placed.select("_own", F.explode(F.array_repeat(F.lit(0), queue.takes()))).select("_own.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("_s")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('a' || source, 'b') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, text, '')) AS h FROM documents),
p AS (SELECT s, sum(size)::BIGINT AS ss FROM d GROUP BY s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w, 3 * ss AS lim, (sum(ss) OVER ())::BIGINT AS al FROM p),
v AS (SELECT *, (al - coalesce(sum(lim) OVER (ORDER BY lim / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (ORDER BY lim / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, lim <= level * w AS fl FROM v),
t AS (SELECT s, ss, CASE WHEN fl THEN lim::DOUBLE ELSE w * (SELECT level FROM f WHERE NOT fl ORDER BY lim / w, s LIMIT 1) END AS target FROM f),
q AS (SELECT d.*, ss, target, sum(size) OVER (PARTITION BY d.s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d JOIN t ON t.s = d.s),
r AS (SELECT doc_id, s, h, size, (e * ss + upto)::DOUBLE / target AS f FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE target > 0 AND size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY f, s, h, doc_id) AS cs FROM r),
k AS (SELECT doc_id, count(*) AS n FROM c WHERE cs <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, ss AS source_size, target, (coalesce(k.n, 0) * size)::BIGINT AS taken FROM q LEFT JOIN k ON k.doc_id = q.doc_id
"""
