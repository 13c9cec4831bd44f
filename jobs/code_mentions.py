"""Job 2: airport codes that reports mention, as include lists for scenarios.

Scenarios take their airports from include lists of four-letter codes. This job reads a table of texts (reports, notices, mail) and
finds the codes in them: words of four letters A-Z between white space and marks, in any case or, with ``as_written``, in capitals
only; with ``include``, only those of a list. For each source of texts and each code it writes how many texts name it, how often, the
smallest id of such a text, and whether it is listed, which takes ``least_texts`` texts. ``mentions`` is partitioned by feed (the
source, marked so that null and empty sources stay apart); each run replaces the feeds that it has, so a rerun gives the same; feeds that the table no longer has stay as they were.

Each text is split once; mentions and texts are counted together with partial sums before the shuffle, so neither a source that
holds most texts nor a word that is in most of them makes a large task. A feed is written as ``files`` files at most.

Null and empty texts name nothing; equal texts count each; a null id is a text of its own that names no smallest id; extra columns
are not read.

    python -m jobs.code_mentions --texts in/documents.parquet --out out/ --config jobs/code_mentions.json
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.scalar import is_icao
from skylattice.session import session, shared_folder
from skylattice.sources import readers

log = logging.getLogger("jobs.code_mentions")

#: Defaults of the config file.
SETTINGS = {"least_texts": 3, "as_written": False, "include": None, "files": 4}
MENTIONS = "source string, code string, n_texts long, n_mentions long, first_doc long, listed boolean, feed string"
#: What parts words: white space and marks.
BETWEEN = r"[\x20\x09-\x0D,;.:!?()\[\]\"'/|]+"


def codes_of(text: Column, as_written: bool = False) -> Column:
    """The codes in a text, in order and as often as they are named."""
    words = F.filter(F.split(text, BETWEEN), lambda w: w.rlike("^[A-Za-z]{4}$"))
    codes = words if as_written else F.transform(words, F.upper)
    return F.filter(codes, is_icao)


def mentions(texts: DataFrame, settings: dict) -> DataFrame:
    """texts (doc_id, source, text, ...) -> source, code, n_texts, n_mentions, first_doc, listed."""
    found = codes_of(F.col("text"), settings["as_written"])
    one = lambda codes, new: F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(new).alias("new")))
    # once for each mention, and once more for each text
    rows = texts.select("doc_id", "source", found.alias("codes")).select("doc_id", "source", F.explode(F.concat(one(F.col("codes"), 0), one(F.array_distinct("codes"), 1))).alias("m"))
    if settings["include"]:
        rows = rows.filter(F.col("m.code").isin(readers.include_list(settings["include"]) or []))
    per = rows.groupBy("source", F.col("m.code").alias("code")).agg(
        F.sum(F.col("m.new").cast("long")).alias("n_texts"), F.sum((1 - F.col("m.new")).cast("long")).alias("n_mentions"), F.min("doc_id").alias("first_doc")
    )
    return per.withColumn("listed", F.col("n_texts") >= settings["least_texts"])


def run(spark: SparkSession, texts: str, out: str, **settings) -> int:
    """Writes the mentions in the table at `texts` below `out`; returns the number of rows."""
    settings = SETTINGS | settings
    rows = mentions(spark.read.parquet(texts), settings).withColumn("feed", F.coalesce(F.concat(F.lit("of:"), "source"), F.lit("none")))
    dealt = rows.repartition("feed", F.pmod(F.hash("code"), F.lit(settings["files"])))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed").parquet(f"{out}/mentions")
    made = spark.read.schema(MENTIONS).parquet(f"{out}/mentions").agg(F.count("*").alias("n"), F.countDistinct("feed").alias("feeds")).first()
    log.info("read %s; wrote %s/mentions: now %d rows in %d feeds", texts, out, made["n"], made["feeds"])
    return made["n"]


def read_mentions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MENTIONS).parquet(f"{out}/mentions").select("source", "code", "n_texts", "n_mentions", "first_doc", "listed")


def job2_code_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole documents table, twice into one new folder; the mentions after the second run."""
    import uuid

    out = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", out)
    return read_mentions(spark, out)


ORACLE = r"""
WITH words AS (SELECT doc_id, source, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D,;.:!?()\[\]"''/|]+')) AS word FROM documents),
codes AS (SELECT doc_id, source, upper(word) AS code, count(*) AS n FROM words WHERE regexp_full_match(word, '[A-Za-z]{4}') GROUP BY 1, 2, 3)
SELECT source, code, count(*) AS n_texts, sum(n)::BIGINT AS n_mentions, min(doc_id) AS first_doc, count(*) >= 3 AS listed FROM codes GROUP BY 1, 2
"""


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Finds the airport codes that texts mention.")
    for name in ("--texts", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("code-mentions", args.master)
    try:
        run(spark, args.texts, args.out, **(readers.config(spark, args.config) if args.config else {}))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
