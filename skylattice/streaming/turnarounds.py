"""Turnarounds as legs arrive: what an aircraft did last is state of the stream, kept per aircraft."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skylattice.session import shared_folder

TURNAROUNDS = "flight_id long, aircraft_uid long, tat_min double"
#: Of the last leg of an aircraft: when it began, its number, when and where it ended (in microseconds).
LAST = "start long, flight_id long, end long, at int"


def last_leg() -> StatefulProcessor:
    """The processor, of a class that is sent as it is: the stream's own Python worker on the driver has no packages of the session."""

    class LastLeg(StatefulProcessor):
        """The legs of one aircraft. A batch's legs are put in order; a leg that began before the last one known is late: it gets no
        turnaround and doesn't take the last one's place. Legs without a start are left out."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", LAST)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
            legs = pd.concat(list(rows)).dropna(subset=["start"]).sort_values(["start", "flight_id"])  # one aircraft's legs of one batch
            last, out = self.last.get() if self.last.exists() else None, []
            for r in legs.itertuples(index=False):
                if last is not None and (r.start, r.flight_id) < (last[0], last[1]):
                    continue
                if last is not None and last[3] is not None and last[2] is not None and last[3] == r.origin:
                    out.append((r.flight_id, key[0], (r.start - last[2]) / 60e6))
                whole = lambda x: None if pd.isna(x) else int(x)
                last = (int(r.start), int(r.flight_id), whole(r.end), whole(r.destination))
            if last is not None:
                self.last.update(last)
            yield pd.DataFrame(out, columns=["flight_id", "aircraft_uid", "tat_min"])

        def close(self) -> None:
            pass

    return LastLeg()


def turnarounds(legs: DataFrame) -> DataFrame:
    """legs (flight_id, aircraft_uid, origin, destination, firstseen, lastseen), a stream -> flight_id, aircraft_uid, tat_min."""
    from pyspark.sql import functions as F

    rows = legs.select("flight_id", "aircraft_uid", "origin", "destination", *(F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("firstseen", "start"), ("lastseen", "end"))))
    return rows.groupBy("aircraft_uid").transformWithStateInPandas(last_leg(), TURNAROUNDS, "Append", "None")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(spark: SparkSession, legs: DataFrame, at: str) -> DataFrame:
    """Takes what is new in a stream of legs; all turnarounds so far, from the files below `at`."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = turnarounds(legs).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/_checkpoint").trigger(availableNow=True).start(f"{at}/turnarounds")
        stream.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(TURNAROUNDS).parquet(f"{at}/turnarounds")


def of_events(spark: SparkSession, folder: str) -> DataFrame:
    from skylattice.plans.standins import legs_of
    from skylattice.streaming.rates import leaf_stream

    return run(spark, legs_of(leaf_stream(spark, folder)), f"{shared_folder(spark)}/turnarounds-{uuid.uuid4().hex}")
