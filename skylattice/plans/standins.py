"""The domain's tables as deterministic projections of the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The polygon of a region, as latitudes and longitudes in turn.
CENTRAL_EUROPE = [56.64614, 16.24997, 45.91336, 18.14017, 45.32967, 1.96354, 54.99308, 0.46895]
LEVELS = "FL100,FL200,FL300"
PAIR_METRES = 60_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legs(spark, d) -> DataFrame:
    return legs_of(table(spark, d, "events"))


def legs_of(events: DataFrame) -> DataFrame:
    """Legs from the events table, whole or as a stream."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    first = F.col("ts").cast("timestamp")
    last = F.timestamp_micros(F.unix_micros(first) + F.round(F.col("value") * 60).cast("long") * 1000000)
    return e.select(F.col("event_id").alias("flight_id"), F.col("user_id").alias("aircraft_uid"), (F.col("k") % 5).alias("origin"), (F.floor(F.col("k") / 5) % 5).cast("int").alias("destination"), first.alias("firstseen"), last.alias("lastseen"))


def legs25(spark, d) -> DataFrame:
    return legs(spark, d).withColumns({"origin": (F.col("flight_id") * 7 % 25).cast("int"), "destination": ((F.col("flight_id") * 11 + 3) % 25).cast("int")})


def _point(key: str, offset: float):
    k = F.col(key)
    return (45 + offset + (k * 3701 % 9973) / 1000).alias("lat"), (5 + offset + (k * 7309 % 14983) / 1000).alias("lon")


def navpoints(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), *_point("c_custkey", 0.0), F.lit(9144.0).alias("alt"), F.lit(0).alias("is_airport"), F.col("c_custkey").cast("long").alias("ordinal"))


def airports(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), *_point("s_suppkey", 0.0005), F.lit(0.0).alias("alt"), F.lit(1).alias("is_airport"), F.col("s_suppkey").cast("long").alias("ordinal"))


def vertices(spark, d) -> DataFrame:
    """Airports A..., then points N..., with one ordinal."""
    a, n = airports(spark, d), navpoints(spark, d)
    name = lambda df, p, shift: df.withColumns({"ordinal": F.col("ordinal") + shift, "id": F.concat(F.lit(p), F.col("id").cast("string"))})
    return name(a, "A", 0).unionByName(name(n, "N", 10_000_000))


def arcs(spark, d) -> DataFrame:
    """u, v, w both ways: the lightest link of each pair of nodes."""
    li = table(spark, d, "lineitem")
    e = li.select((F.col("l_orderkey") % 200).cast("long").alias("u"), (F.col("l_suppkey") + 100 * (F.col("l_linenumber") % 2)).cast("long").alias("v"), (F.col("l_partkey") % 9 + 1).cast("long").alias("w"))
    one = e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    ways = F.array_distinct(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return one.select(F.explode(ways).alias("a"), "w").select("a.u", "a.v", "w")


def trajectories(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("flight_id"), (F.col("l_suppkey") % 10).alias("position"), F.col("l_linenumber").alias("time"), "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


TIES = ("time", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def aircrafts(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("aircraft_id"), F.col("c_acctbal").alias("x"))


def flights(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("flight_id"), (F.col("o_custkey") % 150).cast("long").alias("aircraft_id"), (F.col("o_orderkey") % 96).cast("long").alias("start_slot"))


# the same for the oracle, as the heads of WITH clauses
_P = "{k} * 3701 % 9973"
SQL = {
    "legs": """legs AS (SELECT event_id AS flight_id, user_id AS aircraft_uid, k % 5 AS origin, (k // 5) % 5 AS destination, ts AS firstseen, ts + to_microseconds(CAST(round(value * 60) AS BIGINT) * 1000000) AS lastseen
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "legs25": """legs25 AS (SELECT * REPLACE (CAST(flight_id * 7 % 25 AS INTEGER) AS origin, CAST((flight_id * 11 + 3) % 25 AS INTEGER) AS destination) FROM legs)""",
    "nav": "nav AS (SELECT c_custkey::BIGINT AS id, 45 + 0.0::DOUBLE + (c_custkey * 3701 % 9973)::DOUBLE / 1000 AS lat, 5 + 0.0::DOUBLE + (c_custkey * 7309 % 14983)::DOUBLE / 1000 AS lon, 9144.0::DOUBLE AS alt FROM customer)",
    "air": "air AS (SELECT s_suppkey::BIGINT AS id, 45 + 0.0005::DOUBLE + (s_suppkey * 3701 % 9973)::DOUBLE / 1000 AS lat, 5 + 0.0005::DOUBLE + (s_suppkey * 7309 % 14983)::DOUBLE / 1000 AS lon, 0.0::DOUBLE AS alt FROM supplier)",
    "arcs": """arcs AS (SELECT u, v, min(w) AS w FROM (SELECT (l_orderkey % 200)::BIGINT AS u, (l_suppkey + 100 * (l_linenumber % 2))::BIGINT AS v, (l_partkey % 9 + 1)::BIGINT AS w FROM lineitem
        UNION ALL SELECT (l_suppkey + 100 * (l_linenumber % 2))::BIGINT, (l_orderkey % 200)::BIGINT, (l_partkey % 9 + 1)::BIGINT FROM lineitem) GROUP BY u, v)""",
    "traj": "traj AS (SELECT l_orderkey AS flight_id, l_suppkey % 10 AS position, l_linenumber AS time, l_partkey, l_suppkey, l_shipdate, l_extendedprice FROM lineitem)",
}


def hav(a: str, b: str) -> str:
    h = f"pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)"
    return f"2 * asin(sqrt(greatest(0.0, least(1.0, {h}))))"


def slant(a: str, b: str) -> str:
    return f"sqrt(pow({hav(a, b)} * (6371008.8 + ({a}.alt + {b}.alt) / 2), 2) + pow({b}.alt - {a}.alt, 2))"


#: Pairs of the nearest points, for several oracles.
SQL["pairs"] = f"pairs AS (SELECT * FROM (SELECT a.id AS u, b.id AS v, {slant('a', 'b')} AS d FROM nav a JOIN nav b ON a.id < b.id AND abs(a.lat - b.lat) < 0.6) WHERE d <= 60000.0)"
SQL["sym"] = "sym AS (SELECT u, v, d FROM pairs UNION ALL SELECT v, u, d FROM pairs)"


def heads(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
