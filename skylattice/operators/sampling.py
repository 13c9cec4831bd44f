"""Synthetic days from the models, with draws that depend on seed and key only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.scalar import DEFAULT_SPEED, poisson, uniform
from skylattice.session import cut


def _stream(rows: DataFrame, name: str, round_no: int) -> tuple[Column, list[str]]:
    """The stream of a round of drawing, and the column that names the round, where there is one."""
    has = "round" in rows.columns
    return F.concat(F.lit(name), F.col("round").cast("string") if has else F.lit(str(round_no))), ["round"] * has


def counts(rates: DataFrame, scale: float, seed: int, round_no: int = 0) -> DataFrame:
    """origin, bin, n: departures drawn for each rate; of each row's own round where rates has that column."""
    stream, own = _stream(rates, "count", round_no)
    u = uniform(seed, stream, F.col("origin"), F.col("bin"))
    return rates.select("origin", "bin", *own, poisson(F.greatest(F.col("rate") * scale, F.lit(0.0)), u).alias("n"))


def events(drawn: DataFrame, day: str, minutes: int, seed: int, round_no: int = 0) -> DataFrame:
    """origin, bin, idx, departure: the departures one by one, at uniform instants of their bins."""
    stream, own = _stream(drawn, "instant", round_no)
    one = drawn.filter("n > 0").select("origin", "bin", *own, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    u = uniform(seed, stream, F.col("origin"), F.col("bin"), F.col("idx"))
    at = F.unix_micros(F.lit(f"{day} 00:00:00").cast("timestamp")) + ((F.col("bin") + u) * (minutes * 60e6)).cast("long")
    return one.withColumn("departure", F.timestamp_micros(at))


def thinned(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows without replacement."""
    return rows.withColumn("_u", uniform(seed, "drop", *[F.col(k) for k in key])).orderBy("_u", *key).limit(n).drop("_u")


def exact_events(rates: DataFrame, n: int, day: str, minutes: int, seed: int, scale: float = 1.0) -> DataFrame:
    """n departures: whole days are drawn until there are enough, then the surplus is dropped evenly. As many days as are likely to
    be enough are drawn together; those after there are enough don't count."""
    rates = rates.withColumn("rate", F.greatest(F.col("rate") * scale, F.lit(0.0)))
    mean = rates.agg(F.sum("rate")).first()[0] or 0.0
    if mean <= 0:
        raise ValueError("all rates are 0: there is nothing to draw from")
    days = math.ceil((n + 4 * math.sqrt(n)) / mean) + 1
    while True:
        drawn = cut(counts(rates.filter("rate > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))), 1.0, seed).filter("n > 0"))
        if (drawn.agg(F.sum("n")).first()[0] or 0) >= n:
            break
        days *= 2
    per = drawn.groupBy("round").agg(F.sum("n").alias("_n"))  # a row a day
    needed = per.withColumn("_before", F.sum("_n").over(W.orderBy("round")) - F.col("_n")).filter(F.col("_before") < n).select("round")
    return thinned(events(drawn.join(F.broadcast(needed), "round"), day, minutes, seed), n, seed, "round", "origin", "bin", "idx")


def guide_table(probs: DataFrame, *keys: str, value: str = "prob") -> DataFrame:
    """keys, destination, lo, hi, cell, size: each destination's share of [0, 1), listed in those of its group's cells that it reaches
    into; a group has as many cells as destinations. A draw looks up one cell and meets two or three shares there on average."""
    w = W.partitionBy(*keys).orderBy("destination") if keys else W.orderBy("destination")
    every = W.partitionBy(*keys) if keys else W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum(value).over(every)
    low = F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) / total
    high = F.when(F.lead("destination").over(w).isNull(), 1.0).otherwise(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)) / total)
    ends = probs.select(*keys, "destination", low.alias("lo"), high.alias("hi"), F.count("*").over(every).alias("size")).filter("lo < hi")
    cell = lambda c: F.least(F.floor(F.col(c) * F.col("size")), F.col("size") - 1)
    return ends.withColumn("cell", F.explode(F.sequence(cell("lo"), cell("hi"))))


def looked_up(rows: DataFrame, table: DataFrame, at: str, *keys: str) -> DataFrame:
    """rows with destination, lo and hi of the share that their number `at` in [0, 1) falls into."""
    sizes = table.select(*keys, "size").distinct()
    sized = rows.join(sizes, list(keys)) if keys else rows.join(F.broadcast(sizes.limit(1)))  # one row: all have the same size
    placed = sized.withColumn("cell", F.least(F.floor(F.col(at) * F.col("size")), F.col("size") - 1)).drop("size")
    found = placed.join(table.drop("size"), [*keys, "cell"]).filter((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")))
    return found.drop("cell")


def destinations(rows: DataFrame, probs: DataFrame, frequency: DataFrame, seed: int, *key: str, redraw: bool = True, compat: bool = False) -> DataFrame:
    """A destination for each row (origin, bin, key): from its origin and bin, else by global frequency. A draw that equals the
    origin is made again among the others, in the proportions that redrawing without end would give them; where there are no
    others it stays. compat: the global frequency always decides. Each draw is one look-up by an equi-join with a guide table."""
    u, v = (uniform(seed, f"dest{i}", *[F.col(k) for k in key]) for i in range(2))
    rows_, columns = rows.withColumns({"_u": u, "_v": v}), rows.columns
    own = guide_table(probs, "origin", "bin")
    everywhere = guide_table(frequency.select("destination", F.col("freq").alias("prob")))
    known = probs.select("origin", "bin").distinct()
    sides = [(rows_, everywhere, ())] if compat else [(rows_.join(known, ["origin", "bin"], "left_semi"), own, ("origin", "bin")), (rows_.join(known, ["origin", "bin"], "left_anti"), everywhere, ())]
    out = None
    for side, table, keys in sides:
        drawn = looked_up(side, table, "_u", *keys)
        if redraw:
            same = F.col("destination") == F.col("origin")
            # a second number over the shares of the others, put beyond the origin's own share where it reaches that
            share = F.col("hi") - F.col("lo")
            p = F.col("_v") * (1 - share)
            again = F.when(p < F.col("lo"), p).when(F.col("hi") >= 1.0, F.col("lo") * (1 - 2.0**-52)).otherwise(F.greatest(p + share, F.col("hi")))
            one = drawn.filter(~same | (share >= 1)).select(*columns, "destination")
            two = looked_up(drawn.filter(same & (share < 1)).withColumn("_w", again).drop("destination", "lo", "hi"), table, "_w", *keys)
            drawn = one.unionByName(two.select(*columns, "destination"))
        drawn = drawn.select(*columns, "destination")
        out = drawn if out is None else out.unionByName(drawn)
    return out


def bootstrapped(rows: DataFrame, pool: DataFrame, seed: int, *key: str, value: str = "duration_min", min_samples: int = 1, default: float | None = None) -> DataFrame:
    """A sample for each row (origin, destination, key): of its pair's pool, else of all samples, else `default`."""
    order = W.partitionBy("origin", "destination").orderBy(value, "flight_id")
    pairs = pool.withColumn("_i", F.row_number().over(order) - 1)
    sizes = pool.groupBy("origin", "destination").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_samples)
    own = pairs.join(sizes, ["origin", "destination"]).select(F.col("origin").alias("_o"), F.col("destination").alias("_d"), "_i", F.col(value).alias("_v"))
    # all samples, numbered by ranges of values and then within a range, so that no task sorts them all
    ordered = cut(pool.groupBy(value).agg(F.count("*").alias("_c")).repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    base = ordered.groupBy("_p").agg(F.sum("_c").alias("_n")).withColumn("_base", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")  # a row a partition
    ordered = ordered.withColumn("_to", F.sum("_c").over(W.partitionBy("_p").orderBy(value))).join(F.broadcast(base), "_p")
    every = ordered.select((F.col("_base") + F.col("_to") - F.col("_c")).alias("_lo"), (F.col("_base") + F.col("_to")).alias("_hi"), F.col(value).alias("_v"))
    values, total = ordered.agg(F.count("*"), F.sum("_c")).first()
    if not total:
        if default is None:
            raise ValueError(f"there is no {value} to draw from, and no default")
        return rows.withColumn(value, F.lit(float(default)))
    u = uniform(seed, "boot", *[F.col(k) for k in key])
    drawn = rows.join(sizes, ["origin", "destination"], "left").withColumn("_u", u)
    good = drawn.filter("_n is not null").withColumn("_at", F.floor(F.col("_u") * F.col("_n")))
    good = good.join(own, (F.col("origin") == F.col("_o")) & (F.col("destination") == F.col("_d")) & (F.col("_at") == F.col("_i")))
    rest = drawn.filter("_n is null").withColumn("_at", F.floor(F.col("_u") * total))
    step = max(1, total // values)  # a part of the ranks for each value there is, so that a draw meets one or two values
    spread = every.select("_lo", "_hi", "_v", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor((F.col("_hi") - 1) / step))).alias("_k"))
    rest = rest.withColumn("_k", F.floor(F.col("_at") / step)).join(spread, "_k").filter((F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi")))
    return good.select(*rows.columns, F.col("_v").alias(value)).unionByName(rest.select(*rows.columns, F.col("_v").alias(value)))


def speeds_of(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """flights (aircraft_id, ...) with speed_kts; unknown aircraft fly at the default."""
    return flights.join(aircraft.select("aircraft_id", "speed_kts"), "aircraft_id", "left").withColumn("speed_kts", F.coalesce(F.col("speed_kts").cast("double"), F.lit(DEFAULT_SPEED)))
