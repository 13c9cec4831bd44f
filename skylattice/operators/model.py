"""Traffic models from legs (flight_id, aircraft_uid, origin, destination, firstseen, lastseen): rates, destinations, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.scalar import clean_code, is_icao, laplace, minutes_between, speed_class, time_bin, uniform, zone_shift


def same_day(legs: DataFrame, day: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Legs that start and land on one day, by the text of the times: of one day, or of an inclusive range."""
    if (start is None) != (end is None):
        raise ValueError("a range needs both its ends")
    first, last = (F.substring(F.col(c).cast("string"), 1, 10) for c in ("firstseen", "lastseen"))
    which = first == day if day is not None else first.between(start, end) if start is not None else F.lit(True)
    return legs.filter((first == last) & which)


def cleaned(legs: DataFrame) -> DataFrame:
    """Codes trimmed and upper-cased; legs without both go."""
    return legs.withColumns({c: clean_code(F.col(c)) for c in ("origin", "destination")}).dropna(subset=["origin", "destination"])


def icao_only(legs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Legs between four-letter codes, both among `allowed` (icao) where given."""
    out = legs.filter(is_icao(F.col("origin")) & is_icao(F.col("destination")))
    if allowed is not None:
        for c in ("origin", "destination"):
            out = out.join(allowed.select(F.col("icao").alias(c)).distinct(), c, "left_semi")
    return out


def binned(legs: DataFrame, minutes: int, zone_hours: int = 0) -> DataFrame:
    local = zone_shift(F.col("firstseen"), zone_hours)
    return legs.withColumns({"dep_date": F.to_date(local), "bin": time_bin(local, minutes)})


def departure_rates(legs: DataFrame, minutes: int, start: str | None = None, end: str | None = None, zone_hours: int = 0) -> DataFrame:
    """origin, bin, rate: mean departures over all days of the range, days and bins without any included. Without a range the
    days are those that occur."""
    b = binned(legs, minutes, zone_hours)
    if start is not None:
        days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
        b = b.filter(F.col("dep_date").between(start, end))
        total = b.groupBy("origin", "bin").agg(F.count("*").alias("n"))
        rate = (F.col("n") / days).alias("rate")
    else:
        days = b.agg(F.countDistinct("dep_date").alias("days"))
        total = b.groupBy("origin", "bin").agg(F.count("*").alias("n")).join(F.broadcast(days))
        rate = (F.col("n") / F.col("days")).alias("rate")
    rates = total.select("origin", "bin", rate)
    full = legs.select("origin").distinct().select("origin", F.explode(F.sequence(F.lit(0), F.lit(1440 // minutes - 1))).alias("bin"))
    return full.join(rates, ["origin", "bin"], "left").select("origin", "bin", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def smoothed(rates: DataFrame, width: int) -> DataFrame:
    """Centred rolling mean over bins; an even width leans to earlier bins."""
    w = W.partitionBy("origin").orderBy("bin").rowsBetween(-(width // 2), (width - 1) // 2)
    return rates.withColumn("rate", F.avg("rate").over(w))


def private(rates: DataFrame, epsilon: float, seed: int) -> DataFrame:
    """Rates with two-sided exponential noise, not below 0."""
    u = uniform(seed, "laplace", F.col("origin"), F.col("bin"))
    return rates.withColumn("rate", F.greatest(F.col("rate") + laplace(u, 1.0 / epsilon), F.lit(0.0)))


def destination_frequency(legs: DataFrame) -> DataFrame:
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = legs.groupBy("destination").agg(F.count("*").alias("n"))
    return n.select("destination", (F.col("n") / F.sum("n").over(every)).alias("freq"))


def od_probabilities(legs: DataFrame, minutes: int, alpha: float = 0.0, backoff: float = 0.0, zone_hours: int = 0) -> DataFrame:
    """origin, bin, destination, prob: (n + alpha) over the destinations seen, mixed with their global frequency by `backoff`."""
    n = binned(legs, minutes, zone_hours).groupBy("origin", "bin", "destination").agg(F.count("*").alias("n"))
    of = W.partitionBy("origin", "bin")
    out = n.withColumn("prob", (F.col("n") + alpha) / F.sum(F.col("n") + F.lit(alpha)).over(of))
    if backoff > 0:
        out = out.join(F.broadcast(destination_frequency(legs)), "destination")
        out = out.withColumn("prob", (1 - backoff) * F.col("prob") + backoff * F.col("freq") / F.sum("freq").over(of))
    return out.select("origin", "bin", "destination", "prob")


def turnarounds(legs: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """flight_id, tat_min: minutes since the aircraft's previous leg, where that one ended here."""
    w = W.partitionBy("aircraft_uid").orderBy("firstseen", "flight_id")
    legs = legs.withColumns({"_end": F.lag("lastseen").over(w), "_at": F.lag("destination").over(w)})
    out = legs.filter(F.col("_at") == F.col("origin")).select("flight_id", minutes_between(F.col("_end"), F.col("firstseen")).alias("tat_min"))
    return out if least is None else out.filter(F.col("tat_min").between(least, most))


def durations(legs: DataFrame, least: float = 0.0, most: float = 1e9) -> DataFrame:
    d = minutes_between(F.col("firstseen"), F.col("lastseen"))
    return legs.select("flight_id", "origin", "destination", d.alias("duration_min")).filter(F.col("duration_min").between(least, most) & ~F.isnan("duration_min"))


def quantiles(rows: DataFrame, value: str, shares: list[float], bins: int = 1024, few: int = 4096) -> list[float | None]:
    """The exact quantiles of a column at the shares, interpolated between neighbours; nulls and NaN don't count; None where there is
    nothing.

    No value is sorted or shuffled: each pass counts all shares' intervals in bins, with partial sums, and goes on in the bins that
    hold the wanted ranks, until those hold so few values that they are looked at one by one, or only one."""
    x = F.col(value).cast("double")
    rows = rows.select(x.alias("x")).filter("x is not null and not isnan(x)")
    n, low, high = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    # of each share: the interval that holds the value of its lower rank, how many values are below it and in it
    open_ = {k: (low, high, 0, n) for k in range(len(shares))}
    found: dict[int, float] = {}
    while open_:
        for k in [k for k, (lo, hi, *_) in open_.items() if lo == hi]:
            found[k] = open_.pop(k)[0]
        small = {k: v for k, v in open_.items() if v[3] <= few}
        if small:
            inside = F.filter(F.array(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.lit(k)) for k, (lo, hi, *_) in small.items()]), lambda k: k.isNotNull())
            values: dict[int, list[float]] = {k: [] for k in small}
            for r in rows.select("x", F.explode(inside).alias("k")).collect():  # at most `few` a share
                values[r["k"]].append(r["x"])
            for k, (_, _, below, _) in small.items():
                found[k] = sorted(values[k])[int(at[k]) - below]
                open_.pop(k)
        if not open_:
            break
        place = lambda lo, hi: F.least(F.floor((F.col("x") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int")  # noqa: B023,E731
        placed = F.array(*[F.when((F.col("x") >= lo) & (F.col("x") <= hi), F.struct(F.lit(k).alias("k"), place(lo, hi).alias("bin"))) for k, (lo, hi, *_) in open_.items()])
        counted = rows.select("x", F.explode(F.filter(placed, lambda p: p.isNotNull())).alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_bin = sorted((r["p"]["k"], r["p"]["bin"], r["lo"], r["hi"], r["n"]) for r in counted.collect())  # at most `bins` a share
        for k, (_, _, below, _) in list(open_.items()):
            for share, _, lo, hi, count in by_bin:
                if share == k:
                    if below + count > int(at[k]):
                        open_[k] = (lo, hi, below, count)
                        break
                    below += count
    # the next rank's value is the same one again, or the next larger one
    ends = [(F.sum((F.col("x") <= found[k]).cast("long")), F.min(F.when(F.col("x") > found[k], F.col("x")))) for k in range(len(shares))]
    last = rows.agg(*(e for pair in ends for e in pair)).first()
    out = []
    for k, p in enumerate(at):
        up_to, larger = last[2 * k], last[2 * k + 1]
        after = found[k] if up_to > int(p) + 1 or larger is None else larger
        out.append(found[k] + (p - int(p)) * (after - found[k]))
    return out


def speed_classes(pool: DataFrame, value: str = "duration_min", out: str = "speed_kts") -> DataFrame:
    """A speed by the tertiles of all values, interpolated exactly."""
    low, high = quantiles(pool, value, [1 / 3, 2 / 3])
    return pool.withColumn(out, speed_class(F.col(value), F.lit(low).cast("double"), F.lit(high).cast("double")))


def duration_pools(pool: DataFrame, min_samples: int) -> DataFrame:
    """origin, destination, n, pooled, n_used, mean_used: pairs of too few samples stand for the pool of all."""
    per = pool.groupBy("origin", "destination").agg(F.count("*").alias("n"), F.avg("duration_min").alias("m"))
    every = pool.agg(F.count("*").alias("all_n"), F.avg("duration_min").alias("all_m"))
    few = F.col("n") < min_samples
    return per.join(F.broadcast(every)).select("origin", "destination", "n", few.alias("pooled"), F.when(few, F.col("all_n")).otherwise(F.col("n")).alias("n_used"), F.when(few, F.col("all_m")).otherwise(F.col("m")).alias("mean_used"))


def renormalised(df: DataFrame, value: str, *keys: str) -> DataFrame:
    w = W.partitionBy(*keys) if keys else W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum(value).over(w)
    return df.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(F.lit(0.0)))


def all_numeric(df: DataFrame, *columns: str) -> Column:
    """Whether every value of the columns is a number; an aggregate."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).cast("string").try_cast("double").isNotNull()
    return F.bool_and(ok)
