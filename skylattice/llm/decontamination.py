"""Benchmark decontamination as a prefix-filtered set join.

The benchmark's windows are the sets to be contained whole, so one token is a necessary prefix of each: its rarest word by the
corpus' own counts. Documents keep only positions of such words; each is joined to the windows whose rarest word it is, the
offset of that word bounds where the window can start, lengths bound where it can end, and the words there are compared exactly.

All of it is DataFrame expressions. The windows are broadcast only when their number is within MOST_BROADCAST; beyond that the
same joins run shuffled. Both ways give all hits. Defined cases: a null text has no words; null item texts and items without words
have no windows; rows are judged one by one, under a number of their own, so a null or repeated doc_id changes nothing; items that
repeat an item_id are one item with the windows of all its texts; an item with a null item_id hits words but is in no list and no
number of ids; repeated item texts each count; an empty table gives no rows; extra columns are ignored, and
kept by without_items(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import table, written
from skylattice.llm.url_filter import ascii_lower

#: What lies between words: every ASCII character but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = 10
#: Windows (of about 200 bytes) and words that may be broadcast or held as a literal set.
MOST_BROADCAST, MOST_LITERAL = 200_000, 50_000


def words(text: Column) -> Column:
    """The words in their own letters; comparisons lower-case A-Z."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAK), lambda w: w != "")


def windows_of(items: DataFrame, span: int = SPAN) -> DataFrame:
    """items (item_id, text) -> w (lower-cased words), n, items: every distinct window and the ids that hold it."""
    w = items.select("item_id", words(ascii_lower(F.col("text"))).alias("_w")).filter(F.size("_w") > 0).withColumn("n", F.least(F.size("_w"), F.lit(span)))
    one = w.select("item_id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("_w") - F.col("n") + 1), lambda i: F.slice("_w", i, F.col("n")))).alias("w"))
    return one.groupBy("w", "n").agg(F.collect_set("item_id").alias("items"))


def among(ws: Column, terms: list[str]) -> Column:
    """1-based positions of the words that are among the lower-cased terms (by full lower-casing: a superset of the exact ones)."""
    at = F.sequence(F.lit(1), F.size(ws))
    return F.when(F.size(ws) > 0, F.filter(at, lambda i: F.lower(F.element_at(ws, i)).isin(terms))).otherwise(F.array().cast("array<int>"))


def placed(docs: DataFrame, terms: DataFrame, literal: bool) -> DataFrame:
    """docs (ws) -> at: where terms (word) occur. Without a literal set by a shuffled join of all words, by _row."""
    if literal:
        return docs.select("*", among(F.col("ws"), [r[0] for r in terms.select(F.lower("word")).distinct().collect()]).alias("at"))
    found = docs.select("_row", F.posexplode("ws").alias("i", "_t")).select("_row", (F.col("i") + 1).alias("i"), F.lower("_t").alias("word"))
    found = found.join(terms.select(F.lower("word").alias("word")).distinct(), "word").groupBy("_row").agg(F.collect_set("i").alias("at"))
    return docs.join(found, "_row", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (carried columns, text), items (item_id, text) -> carried columns, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = written(windows_of(items, span))
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    n_windows, n_words = windows.count(), vocabulary.count()
    literal, small = n_words <= MOST_LITERAL, n_windows <= MOST_BROADCAST
    hint = F.broadcast if small else (lambda x: x)
    ws = docs.select(*carried, words(F.col("text")).alias("ws"))
    numbered = lambda df: df.withColumn("_row", F.monotonically_increasing_id())
    if not literal:  # the shuffled join of words goes by row, so rows are numbered in a table
        ws = written(numbered(ws))

    # rarity of the benchmark's words over the whole corpus
    if literal:
        terms = [r[0] for r in vocabulary.select(F.lower("word")).distinct().collect()]
        every = docs.select(F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), BREAK), lambda w: w.isin(terms))).alias("_t"))
    else:
        every = ws.select(F.explode("ws").alias("_t")).select(F.lower("_t").alias("_t"))
    counts = every.groupBy("_t").agg(F.count("*").alias("_n"))
    spots = windows.select("w", F.posexplode("w").alias("off", "word"))
    rank = spots.join(counts, F.lower("word") == F.col("_t"), "left").groupBy("w").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("c"), "word", "off")).alias("_r"))
    keyed = written(windows.join(rank, "w").select("w", "n", "items", F.concat_ws(" ", "w").alias("_text"), F.col("_r.word").alias("rare"), F.col("_r.off").alias("off")))

    # the words around a spot, from `base` on; of a word that only stands for itself none, as it may be a common one
    if literal:
        longer = [r[0] for r in keyed.filter("n > 1").select(F.lower("rare")).distinct().collect()]
        several = lambda i: F.lower(F.element_at("ws", i)).isin(longer) if longer else F.lit(False)
    else:
        several = lambda i: F.lit(True)
    base = lambda i: F.when(several(i), F.greatest(i - (span - 1), F.lit(1))).otherwise(i)
    around = F.transform("at", lambda i: F.struct(i.alias("pos"), base(i).alias("base"), F.element_at("ws", i).alias("word"), F.slice("ws", base(i), F.when(several(i), 2 * span - 1).otherwise(1)).alias("ctx")))
    scan = placed(ws, keyed.select(F.col("rare").alias("word")), literal).select(*[c for c in ws.columns if c != "ws"], F.size("ws").cast("long").alias("n_words"), around.alias("spots"))
    scan = written(numbered(scan) if literal else scan)
    seen = scan.select("_row", F.explode("spots").alias("c")).select("_row", "c.pos", "c.base", "c.ctx", ascii_lower(F.col("c.word")).alias("rare"))
    start = F.col("pos") - F.col("off")
    there = F.concat_ws(" ", F.slice("ctx", start - F.col("base") + 1, F.col("n")))
    fits = (F.lower(there) == F.lower("_text")) & (ascii_lower(there) == F.col("_text"))
    hits = seen.join(hint(keyed), "rare").filter(start >= F.col("base")).filter(fits).select("_row", F.struct(start.alias("s"), F.col("n").alias("n")).alias("span"), "items")
    per = hits.groupBy("_row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    none = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate("spans", none, lambda a, x: F.struct((a["k"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(a["end"], x["s"]))).alias("k"), F.greatest(a["end"], x["s"] + x["n"]).cast("long").alias("end")))["k"]
    per = per.select("_row", covered.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), ",").alias("_ids"))
    out = scan.select("_row", *carried, "n_words").join(per, "_row", "left")
    return out.select(*carried, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("_ids", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def without_items(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows whose text holds no window, with all their columns. Texts are told apart by 128 bits of hash."""
    hashed = [F.xxhash64("text").alias("_a"), F.xxhash64(F.lit(1), "text").alias("_b")]
    bad = decontaminate(docs.select(*hashed, "text"), items, span, ("_a", "_b")).filter("contaminated").select("_a", "_b").distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"), *hashed)
    return own.join(bad, ["_a", "_b"], "left_anti").select("_own.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, (len(w) - least(len(w), 10) + 2)::BIGINT), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i, unnest(list_transform(range(1, (len(w) - n + 2)::BIGINT), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id
"""
