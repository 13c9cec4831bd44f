"""Line dedup with a suffix array over line-ID sequences, built by distributed prefix doubling.

Every line has a 128-bit id. A suffix is what follows from a line to the end of its document. Round 0 gives the suffixes that begin
with a repeated line a rank: the number of suffixes in classes before theirs, so equal ranks are one interval of the suffix array.
Round k + 1 splits the intervals of round k by the rank of the suffix 2^k lines on: what was sorted by 2^k lines is sorted by
2^(k+1). A suffix whose first 2^(k+1) lines occur once, or that ends before, has found its place behind the others of its interval
and drops out. Rounds go on until no suffix is left, so there are as many as the longest repeated run has binary digits. Line ids
stand in for an order of lines, and ranks are exact: no hash of a run is ever taken.

Suffixes with one rank after round k are an interval whose longest common prefix is 2^k lines at least; the interval of any other
number of lines is told by two overlapping ranks. In every interval of `run_lines` lines or more the occurrence that comes first in
(doc_id, line) order stays, and the lines of the later ones go. The runs of a document are united to the longest stretches, the
maximal runs that are deleted; a single line goes as a later copy from `line_words` words on, so short lines alone stay.

No task holds a class: classes are counted with map-side aggregation, ranks within an interval are summed over blocks of BLOCK ranks
and then within a block, and the join back to the suffixes has one row a class on one side, so that a very common line is spread
by skew-join splitting. All is linear in the lines of a document.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; doc_id is the key, and of rows that
repeat a doc_id each line number counts once, with the line of the smallest id, and all rows lose the same line numbers; a
document with a null doc_id keeps all its lines and is no copy to others; an empty table gives no rows; very long texts take part
whole; extra columns are kept by dedup_lines(), whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import dropped, table, word_count, written

RUN_LINES, LINE_WORDS = 2, 8
BLOCK = 1 << 16


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ln, a, b (the line's id), w (its words)."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    lines = lines.select("doc_id", "ln", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), word_count(F.col("line")).alias("w")).alias("s"))
    return lines.groupBy("doc_id", "ln").agg(F.min("s").alias("s")).select("doc_id", "ln", "s.a", "s.b", "s.w")


def classes(suffixes: DataFrame, *key: str) -> DataFrame:
    """Of suffixes (doc_id, ln, key): the keys that repeat, how often, and the first suffix of each."""
    return suffixes.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "ln")).alias("first")).filter("n > 1")


def before(found: DataFrame, group: list[str], block: Column, order: list[str]) -> DataFrame:
    """Adds _r: how many suffixes are in classes of the same group that come earlier, block by block and then within a block."""
    some = found.withColumn("_block", block)
    sums = some.groupBy(*group, "_block").agg(F.sum("n").alias("_base"))
    sums = sums.withColumn("_base", F.sum("_base").over(W.partitionBy(*group).orderBy("_block")) - F.col("_base"))
    within = F.sum("n").over(W.partitionBy(*group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    return some.withColumn("_in", within).join(sums, [*group, "_block"]).withColumn("_r", F.col("_base") + F.col("_in")).drop("_block", "_base", "_in")


def placed(suffixes: DataFrame, found: DataFrame, key: list[str], rank: Column) -> DataFrame:
    """The suffixes of repeated classes with their rank, and whether an earlier suffix has it too."""
    ranks = found.select(*key, rank.alias("_rank"), "first")
    return suffixes.join(ranks, key).select("doc_id", "ln", F.col("_rank").alias("r"), (F.struct("doc_id", "ln") > F.col("first")).alias("later"))


def ahead(suffixes: DataFrame, by: int) -> DataFrame:
    """Adds r2: the rank of the suffix `by` lines on; suffixes without one go."""
    w = W.partitionBy("doc_id").orderBy("ln").rangeBetween(by, by)
    return suffixes.withColumn("r2", F.max("r").over(w)).filter("r2 is not null")


def first_round(lines: DataFrame) -> DataFrame:
    found = written(classes(lines, "a", "b"))
    one = before(found.withColumn("_g", F.lit(0)), ["_g"], F.shiftright("a", 48), ["a", "b"])
    out = written(placed(lines, one, ["a", "b"], F.col("_r")))
    dropped(found)
    return out


def next_round(suffixes: DataFrame, by: int) -> DataFrame:
    pairs = written(ahead(suffixes.select("doc_id", "ln", "r"), by))
    found = before(classes(pairs, "r", "r2"), ["r"], F.floor(F.col("r2") / BLOCK), ["r2"])
    out = written(placed(pairs, found, ["r", "r2"], F.col("r") + F.col("_r")))
    dropped(pairs)
    return out


def suffix_rounds(lines: DataFrame) -> list[DataFrame]:
    """lines (doc_id, ln, a, b) -> by round k the suffixes whose first 2^k lines repeat: doc_id, ln, r (their interval's first place
    among the suffixes of repeated lines), later."""
    rounds = [first_round(lines)]
    while rounds[-1].limit(1).count():
        rounds.append(next_round(rounds[-1], 1 << len(rounds) - 1))
    return rounds[:-1]


def later_runs(rounds: list[DataFrame], run_lines: int) -> list[DataFrame]:
    """doc_id, ln, size: the runs of `run_lines` lines or more that occur earlier, from every interval."""
    out = [r.filter("later").select("doc_id", "ln", F.lit(1 << k).alias("size")) for k, r in enumerate(rounds) if 1 << k >= run_lines]
    k = run_lines.bit_length() - 1
    if run_lines > 1 << k and k < len(rounds):  # between two rounds: two ranks that overlap
        pairs = ahead(rounds[k].select("doc_id", "ln", "r"), run_lines - (1 << k))
        out.append(placed(pairs, classes(pairs, "r", "r2"), ["r", "r2"], F.lit(0)).filter("later").select("doc_id", "ln", F.lit(run_lines).alias("size")))
    return out


def repeated_runs(docs: DataFrame, run_lines: int = RUN_LINES, line_words: int = LINE_WORDS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, end: the maximal runs of lines to delete, end excluded."""
    lines = written(lines_of(docs))
    rounds = suffix_rounds(lines.drop("w"))
    marks = later_runs(rounds, run_lines) if rounds and run_lines > 1 else []
    if rounds:
        alone = rounds[0].filter("later").join(lines.filter(F.col("w") >= line_words).select("doc_id", "ln"), ["doc_id", "ln"], "left_semi")
        marks.append(alone.select("doc_id", "ln", F.lit(1).alias("size")))
    else:
        marks.append(lines.select("doc_id", "ln", F.lit(1).alias("size")).limit(0))
    order = W.partitionBy("doc_id").orderBy("ln", "size")
    spans = reduce(DataFrame.union, marks).withColumn("_reach", F.max(F.col("ln") + F.col("size")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    spans = spans.withColumn("_run", F.sum(F.when(F.col("ln") <= F.col("_reach"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "_run").agg(F.min("ln").alias("start"), F.max(F.col("ln") + F.col("size")).alias("end")).drop("_run")


def dedup_lines(docs: DataFrame, run_lines: int = RUN_LINES, line_words: int = LINE_WORDS) -> DataFrame:
    """The documents with their later copies of line runs deleted, and n_lines, n_removed, n_runs (maximal deleted runs)."""
    per = repeated_runs(docs.select("doc_id", "text"), run_lines, line_words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    new = docs.select("doc_id", F.struct("*").alias("own")).join(per, "doc_id", "left")
    lines, runs = F.split("own.text", "\n"), F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>"))
    of = lambda c: F.transform(runs, lambda x: x[c])
    gaps = F.arrays_zip(F.concat(F.array(F.lit(0)), of("end")).alias("a"), F.concat(of("start"), F.array(F.size(lines))).alias("b"))
    # rows that repeat a doc_id can be shorter than its lines are
    kept = F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))))), "\n")
    gone = F.aggregate(runs, F.lit(0), lambda n, x: n + F.greatest(F.least(x["end"], F.size(lines)) - F.least(x["start"], F.size(lines)), F.lit(0)))
    count = lambda c: F.when(F.col("own.text").isNull(), 0).otherwise(c).cast("long")
    text = F.when(F.size(runs) == 0, F.col("own.text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns]
    counts = {"n_lines": count(F.size(lines)), "n_removed": count(gone), "n_runs": count(F.size(F.filter(runs, lambda x: x["start"] < F.size(lines))))}
    return new.select(*columns, *[v.alias(k) for k, v in counts.items()])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS ln, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w, lead(line) OVER (PARTITION BY doc_id ORDER BY ln) AS nx FROM l),
one AS (SELECT doc_id, ln FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, ln) AS r FROM m WHERE w >= 8) WHERE r > 1),
two AS (SELECT doc_id, ln FROM (SELECT *, row_number() OVER (PARTITION BY line, nx ORDER BY doc_id, ln) AS r FROM m WHERE nx IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, ln FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT doc_id, ln + 1 FROM two)),
k AS (SELECT l.doc_id, l.ln, l.line, gone.ln IS NOT NULL AS g FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.ln = gone.ln),
r AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY ln), false) AS s FROM k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g) AS n_removed, count(*) FILTER (s) AS n_runs, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT g), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id
"""
