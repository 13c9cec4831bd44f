"""Job 1: traffic models kept up to date from leg lists that keep coming.

A file stream takes the leg files that are new since the last run (its checkpoint holds the mark), a bounded number of files a batch,
and ends when all are taken. Each batch adds departure counts (origin, bin, destination) to ``counts``, partitioned by departure date
and batch; a batch that is run again after a failure overwrites its own partitions with the same rows. After that the models of the
origins with new legs are written again from all their counts: departures a day and bin, and the destinations' shares of each bin,
smoothed and mixed with the destinations' global frequency where the settings say so. ``models`` is partitioned by origin.

A file is taken once; legs listed in two files count twice, as in a batch over both. Legs without a departure or without a code are
left out. A run without new files changes nothing. A run that was ended after its batches but before the models is made good by the next
one, which renews all origins of batches whose models are not written yet (``renewed`` names the last batch in them).

    python -m jobs.traffic_models --legs in/events.parquet --out out/ --checkpoint out/_checkpoint --config jobs/traffic_models.json
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import model
from skylattice.plans import standins
from skylattice.session import session, shared_folder
from skylattice.sources import readers, storage

log = logging.getLogger("jobs.traffic_models")

#: Defaults of the config file.
SETTINGS = {"minutes": 60, "zone_hours": 0, "alpha": 0.0, "backoff": 0.0, "files_per_batch": 1000}

MODELS = "bin int, destination int, n long, rate double, prob double, origin int"
COUNTS = "origin int, bin int, destination int, n long, dep_date date, batch long"


def counted(legs: DataFrame, settings: dict) -> DataFrame:
    """dep_date, origin, bin, destination, n of legs, whole or a micro-batch."""
    rows = model.binned(legs.dropna(subset=["origin", "destination", "firstseen"]), settings["minutes"], settings["zone_hours"])
    return rows.groupBy("dep_date", "origin", "bin", "destination").agg(F.count("*").alias("n"))


def modelled(counts: DataFrame, settings: dict) -> DataFrame:
    """origin, bin, destination, n, rate (departures of the bin a day), prob, from all counts."""
    days = counts.agg(F.countDistinct("dep_date").alias("days"))  # one row
    per = counts.groupBy("origin", "bin", "destination").agg(F.sum("n").alias("n"))
    of = model.W.partitionBy("origin", "bin")
    share = (F.col("n") + settings["alpha"]) / F.sum(F.col("n") + F.lit(float(settings["alpha"]))).over(of)
    out = per.join(F.broadcast(days)).withColumns({"rate": F.sum("n").over(of) / F.col("days"), "prob": share})
    if settings["backoff"] > 0:
        total = counts.groupBy("destination").agg(F.sum("n").alias("_n"))
        freq = total.withColumn("_f", F.col("_n") / F.sum("_n").over(model.W.rowsBetween(model.W.unboundedPreceding, model.W.unboundedFollowing)))
        out = out.join(freq, "destination").withColumn("prob", (1 - settings["backoff"]) * F.col("prob") + settings["backoff"] * F.col("_f") / F.sum("_f").over(of))
    return out.select("origin", "bin", "destination", "n", "rate", "prob")


def run(spark: SparkSession, legs: str, out: str, checkpoint: str, **settings) -> dict:
    """Takes what is new in the leg table at `legs` and renews the models below `out`. Returns batches and rows taken."""
    settings = SETTINGS | settings
    source = spark.readStream.schema(spark.read.parquet(legs).schema).option("maxFilesPerTrigger", settings["files_per_batch"])
    if storage.is_folder(spark, legs):
        source = source.parquet(legs)
    else:  # one file: a stream lists folders only
        folder, name = legs.rsplit("/", 1)
        source = source.option("pathGlobFilter", name).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        rows = counted(batch, settings).withColumn("batch", F.lit(number).cast("long"))
        # a day's counts of a batch are small: one file each
        rows.repartition("dep_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dep_date", "batch").parquet(f"{out}/counts")

    stream = standins.legs_of(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    taken = [p for p in stream.recentProgress if p.numInputRows]
    result = {"batches": len(taken), "rows": sum(p.numInputRows for p in taken)}
    log.info("read %s: %d rows in %d batches", legs, result["rows"], result["batches"])
    result["origins"] = renew(spark, out, settings)
    return result


def renew(spark: SparkSession, out: str, settings: dict) -> int:
    """Writes the models anew if there are batches that are not in them. A day more changes all rates, so all origins are written;
    each one's partition is replaced as a whole."""
    if not storage.exists(spark, f"{out}/counts"):
        return 0
    counts = spark.read.schema(COUNTS).parquet(f"{out}/counts")
    last = counts.agg(F.max("batch")).first()[0]
    done = spark.read.parquet(f"{out}/renewed").agg(F.max("batch")).first()[0] if storage.exists(spark, f"{out}/renewed") else None
    if last is None or done is not None and done >= last:
        return 0
    models = modelled(counts, settings)
    models.repartition("origin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("origin").parquet(f"{out}/models")
    spark.range(1).select(F.lit(last).alias("batch")).coalesce(1).write.mode("append").parquet(f"{out}/renewed")
    origins = counts.select("origin").distinct().count()
    log.info("wrote %s/models: %d origins, up to batch %d", out, origins, last)
    return origins


def read_models(spark: SparkSession, out: str) -> DataFrame:
    """The models; none before any leg was taken."""
    if not storage.exists(spark, f"{out}/models"):
        return spark.createDataFrame([], MODELS)
    return spark.read.schema(MODELS).parquet(f"{out}/models")


def job1_traffic_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole events table, twice into one new folder and checkpoint; the models after the second run."""
    import uuid

    out = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", out, f"{out}/_checkpoint")
    return read_models(spark, out)


ORACLE = (
    standins.heads("legs")
    + """, n AS (SELECT origin, hour(firstseen)::INTEGER AS bin, destination, count(*) AS n FROM legs WHERE origin IS NOT NULL AND destination IS NOT NULL AND firstseen IS NOT NULL GROUP BY 1, 2, 3)
SELECT origin, bin, destination, n, sum(n) OVER (PARTITION BY origin, bin)::DOUBLE / (SELECT count(DISTINCT firstseen::DATE) FROM legs) AS rate, n::DOUBLE / sum(n) OVER (PARTITION BY origin, bin) AS prob FROM n"""
)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Keeps traffic models up to date from new leg files.")
    for name in ("--legs", "--out", "--checkpoint"):
        parser.add_argument(name, required=True)
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--master")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session("traffic-models", args.master)
    try:
        run(spark, args.legs, args.out, args.checkpoint, **(readers.config(spark, args.config) if args.config else {}))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
