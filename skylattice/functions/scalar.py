"""Column formulas of the traffic model: cleaning, time bins, slots, speed classes, reproducible random numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing code.
BAD_TOKENS = ("", "NAN", "NONE", "NULL")
ICAO = "^[A-Z]{4}$"
#: Knots to metres a second as the routing uses it, and the speed of each class and of unknown aircraft.
KNOT, SPEEDS, DEFAULT_SPEED = 0.51444, (430, 450, 480), 450.0


#: Rate from which a distribution's lower end is passed over.
BAND = 500


def clean_code(c: Column) -> Column:
    """Trimmed and upper-cased; a missing mark is null."""
    t = F.upper(F.trim(c))
    return F.when(~t.isin(*BAD_TOKENS), t)


def is_icao(c: Column) -> Column:
    return F.coalesce(c.rlike(ICAO), F.lit(False))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def minutes_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(60000000.0)


def zone_shift(ts: Column, hours: int) -> Column:
    """A UTC time as the clock shows it at a fixed offset."""
    return ts + F.expr(f"INTERVAL '{int(hours)}' HOUR")


def time_bin(ts: Column, minutes: int) -> Column:
    """Bin of the day; the last one takes what is left where the width does not divide the day."""
    n = 1440 // minutes
    return F.greatest(F.lit(0), F.least(F.floor((F.hour(ts) * 60 + F.minute(ts)) / minutes), F.lit(n - 1))).cast("int")


def start_slot(ts: Column, slot_seconds: float) -> Column:
    """Slot of the UTC day, fractions of a second included."""
    day = 86400000000
    return F.floor(F.pmod(micros(ts), F.lit(day)) / F.lit(slot_seconds * 1e6)).cast("int")


def edge_slots(metres: Column, knots: Column, per_hour: float) -> Column:
    """Slots that an edge takes, one at least."""
    return F.when(knots <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(metres / (knots * KNOT) / (3600.0 / per_hour)))).cast("int")


def speed_class(x: Column, low: Column, high: Column) -> Column:
    return F.when(x < low, SPEEDS[0]).when(x < high, SPEEDS[1]).otherwise(SPEEDS[2])


def capacity(is_airport: Column, airport: int, enroute: int) -> Column:
    return F.when(is_airport, airport).otherwise(enroute)


def airport_flag(identifier: Column, listed: Column, any_listed: Column) -> Column:
    """Whether a vertex is an airport: its code is in the list, or, where the list is empty, looks like one."""
    return F.when(any_listed, F.coalesce(listed, F.lit(False))).otherwise(is_icao(F.upper(F.trim(identifier))))


def safe_int(c: Column) -> Column:
    """The whole number a text stands for, else -1."""
    return F.coalesce(c.cast("string").try_cast("double").cast("long"), F.lit(-1).cast("long"))


def clock(seconds: Column) -> Column:
    """H:MM:SS.ss; negative times are 0."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    return F.format_string("%d:%02d:%05.2f", F.floor(s / 3600), F.floor((s % 3600) / 60), s - F.floor(s / 3600) * 3600 - F.floor((s % 3600) / 60) * 60)


def grid_index(identifier: Column) -> tuple[Column, Column]:
    """y and x of a grid point's name."""
    return tuple(F.regexp_extract(identifier, r"_Y(\d+)X(\d+)$", i).try_cast("int") for i in (1, 2))


def uniform(seed: int, stream: str | Column, *key: Column) -> Column:
    """A number in [0, 1) that depends on seed, stream and key only, so a draw is the same on any partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(stream) if isinstance(stream, str) else stream, *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def poisson(rate: Column, u: Column) -> Column:
    """Inverse distribution function, summed term by term up to ten deviations over the mean. Terms are kept as logarithms, so a
    rate of any size has its mass; from BAND on the terms that are lower by twelve deviations are passed over, as they add nothing."""
    wide = F.when(rate < BAND, rate + 1).otherwise(12 * F.sqrt(rate))
    first = F.greatest(F.lit(0.0), F.floor(rate - wide)).cast("int")
    top = (F.ceil(rate + 10 * F.sqrt(rate)) + 20).cast("int")
    # the first term by Stirling's series where it isn't exp(-rate)
    n = F.greatest(first.cast("double"), F.lit(1.0))
    factorial = n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)
    log_first = F.when(first == 0, -rate).otherwise(first * F.log(rate) - rate - factorial)
    start = F.struct(log_first.alias("p"), F.exp(log_first).alias("s"), (first + F.when(u >= F.exp(log_first), 1).otherwise(0)).cast("int").alias("k"))

    def step(a, i):
        p = a["p"] + F.log(rate / i)
        s = a["s"] + F.exp(p)
        return F.struct(p.alias("p"), s.alias("s"), (a["k"] + F.when(u >= s, 1).otherwise(0)).alias("k"))

    return F.when(rate <= 0, 0).otherwise(F.aggregate(F.sequence(first + 1, top), start, step)["k"])


def laplace(u: Column, scale: float) -> Column:
    """Inverse distribution function of the two-sided exponential."""
    c = u - 0.5
    return -scale * F.signum(c) * F.log(F.greatest(1 - 2 * F.abs(c), F.lit(1e-300)))
