"""Readers of the domain's files: flight lists, airports, navigation texts, model artifacts, graphs, configurations.

CSV is read as text with fixed columns and cast tolerantly afterwards; column names are matched without regard to case, with
fallbacks by alias and by position.
"""

from __future__ import annotations

import csv
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.functions.scalar import BAD_TOKENS, ICAO, clean_code
from skylattice.operators.graph import graph
from skylattice.operators.model import all_numeric, cleaned, renormalised, same_day
from skylattice.sources import storage

#: The columns of a flight list.
FLIGHT_LIST = ("callsign", "number", "aircraft_uid", "typecode", "origin", "destination", "firstseen", "lastseen", "day", "latitude_1", "longitude_1", "altitude_1", "latitude_2", "longitude_2", "altitude_2")
KEPT = FLIGHT_LIST[:8]
#: Codes of the navigation text that are radio aids.
AID_CODES = (2, 3, 12, 13)


def text_csv(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if storage.is_folder(spark, path):
        reader = reader.option("pathGlobFilter", "*.csv")
    df = reader.csv(path)
    if columns is None:
        return df
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def resolve(df: DataFrame, wanted: dict[str, tuple[str, ...]], positional: bool = False) -> DataFrame:
    """Columns by name or alias, without regard to case, spaces, hyphens and underscores; by position where allowed."""
    plain = lambda s: re.sub(r"[\s_-]", "", s).lower()
    have, out = {plain(c): c for c in df.columns}, []
    for i, (name, aliases) in enumerate(wanted.items()):
        found = next((have[plain(a)] for a in (name, *aliases) if plain(a) in have), None)
        if found is None and positional and i < len(df.columns):
            found = df.columns[i]
        if found is None:
            raise ValueError(f"column {name} is missing; there are {', '.join(df.columns)}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def flight_list(spark: SparkSession, path: str, day: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Legs of one file or of all CSV files in a folder, filtered to a day or range, with clean codes."""
    if (start is None) != (end is None):
        raise ValueError("a range needs both its ends")
    if storage.is_folder(spark, path) and not any(n.endswith(".csv") for n in storage.names(spark, path)):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in KEPT))
    df = text_csv(spark, path, FLIGHT_LIST)
    return cleaned(same_day(df, day, start, end).select(*KEPT))


def parsed_times(legs: DataFrame) -> DataFrame:
    """Times as timestamps; legs with an unreadable one go."""
    return legs.withColumns({c: F.col(c).try_cast("timestamp") for c in ("firstseen", "lastseen")}).dropna(subset=["firstseen", "lastseen"])


def airports(spark: SparkSession, path: str, icao_only: bool = True) -> DataFrame:
    """icao, lat, lon: the first row of each code with readable coordinates. The code is icao_code, or ident, or gps_code, whichever
    column is first to hold anything at all."""
    df = text_csv(spark, path)
    have = {c.lower(): c for c in df.columns}
    codes = [c for c in ("icao_code", "ident", "gps_code") if c in have]
    filled = df.agg(*[F.count(have[c]).alias(c) for c in codes]).first() if codes else None
    use = next((c for c in codes if filled[c]), codes[0] if codes else None)
    if use is None:
        raise ValueError("no column holds airport codes")
    out = df.select(F.upper(F.trim(have[use])).alias("icao"), F.col(have["latitude_deg"]).try_cast("double").alias("lat"), F.col(have["longitude_deg"]).try_cast("double").alias("lon"), F.monotonically_increasing_id().alias("_o")).dropna()
    if icao_only:
        out = out.filter(F.col("icao").rlike(ICAO))
    return out.withColumn("_r", F.row_number().over(W.partitionBy("icao").orderBy("_o"))).filter("_r = 1").select("icao", "lat", "lon")


def icao_set(spark: SparkSession, path: str | None) -> DataFrame:
    """icao: all four-letter codes of the three code columns; none where there is no file."""
    if not path or not storage.exists(spark, path):
        return spark.createDataFrame([], "icao string")
    df = text_csv(spark, path)
    cols = [c for c in df.columns if c.lower() in ("icao_code", "ident", "gps_code")]
    return df.select(F.explode(F.array(*[F.upper(F.trim(c)) for c in cols])).alias("icao")).filter(F.col("icao").rlike(ICAO)).distinct()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, line: the lines of text files with their numbers from 0 in each file.

    A file is read in blocks by as many tasks as it has; a line's number is its place in its block and the number of lines in the
    file's blocks before. Only a row a block is counted and sent, no line is moved or sorted."""
    m = F.col("_metadata")
    rows = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(blocks.withColumn("_before", before), ["file", "_block"]).select("file", (F.col("_m") - F.col("_first") + F.col("_before")).alias("n"), F.regexp_replace("line", "\r$", "").alias("line"))


def _first_named(rows: DataFrame) -> DataFrame:
    first = rows.dropna(subset=["id", "lat", "lon"]).groupBy("id").agg(F.min(F.struct("file", "n", "lat", "lon")).alias("m"))
    return first.select("id", "m.lat", "m.lon", F.col("m.n").alias("ordinal"))


def fixes(spark: SparkSession, path: str) -> DataFrame:
    """id, lat, lon, ordinal (line number) of fix texts: 'lat lon name ...' lines up to one that starts with 99 in each file."""
    lines = numbered_lines(spark, path)
    stop = lines.filter(F.trim("line").startswith("99")).groupBy("file").agg(F.min("n").alias("_stop"))
    t = F.split(F.trim("line"), r"\s+")
    rows = lines.join(stop, "file", "left").filter(F.col("_stop").isNull() | (F.col("n") < F.col("_stop"))).filter(F.size(t) >= 3)
    return _first_named(rows.select("file", "n", t[0].try_cast("double").alias("lat"), t[1].try_cast("double").alias("lon"), F.upper(t[2]).alias("id")))


def aids(spark: SparkSession, path: str, ident_token: int = 8) -> DataFrame:
    """id, lat, lon of a navigation text; lines that start with 99 are passed over. The ident is token `ident_token` from 0, or the
    last one; 7 is where the format itself has it."""
    t = F.split(F.trim("line"), r"\s+")
    rows = numbered_lines(spark, path).filter(~F.trim("line").startswith("99") & (F.size(t) >= 3)).filter(t[0].try_cast("int").isin(*AID_CODES))
    ident = F.when(F.size(t) > ident_token, F.element_at(t, ident_token + 1)).otherwise(F.element_at(t, -1))
    return _first_named(rows.select("file", "n", t[1].try_cast("double").alias("lat"), t[2].try_cast("double").alias("lon"), F.upper(ident).alias("id")))


def navigation_file(spark: SparkSession, folder: str, name: str) -> str:
    """fix or nav data under either of its usual names."""
    for candidate in (f"{folder}/{name}.dat", f"{folder}/earth_{name}.dat"):
        if storage.exists(spark, candidate):
            return candidate
    raise FileNotFoundError(f"{folder}/{name}.dat")


def od_pairs(spark: SparkSession, path: str) -> DataFrame:
    df = text_csv(spark, path)
    have = {c.lower(): c for c in df.columns}
    if not {"origin", "destination"} <= set(have):
        return spark.createDataFrame([], "origin string, destination string")
    return df.select(*[clean_code(F.col(have[c])).alias(c) for c in ("origin", "destination")]).dropna().distinct()


def aircraft(spark: SparkSession, folder: str) -> DataFrame:
    for name in ("aircrafts.csv", "aircraft.csv"):
        if storage.exists(spark, f"{folder}/{name}"):
            df = resolve(text_csv(spark, f"{folder}/{name}"), {"aircraft_id": ("id", "airplane_id"), "speed_kts": ("speed", "speed_knots")}, positional=True)
            return df.select("aircraft_id", F.col("speed_kts").try_cast("double").alias("speed_kts")).dropna()
    raise FileNotFoundError(f"{folder}/aircrafts.csv")


def artifacts(spark: SparkSession, folder: str) -> dict:
    """The six model files: bin minutes, rates on all bins, shares that add up to 1, and pools with defaults where they are empty."""
    read = lambda name: text_csv(spark, f"{folder}/{name}.csv")
    num = lambda df, *cols: df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    meta = {r["artifact"]: int(float(r["bin_minutes"])) for r in read("metadata").collect() if r["bin_minutes"]}
    minutes = next((meta[k] for k in ("airport_bins", "od_time_model") if k in meta), next(iter(meta.values()), 15))
    rates = num(read("airport_bins"), "bin", "rate").withColumn("bin", F.col("bin").cast("int"))
    full = rates.select("origin").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(1440 // minutes - 1))))
    tat = num(read("tat_dist"), "tat_min").dropna()
    pool = num(read("od_dur_dist"), "duration_min", "speed_kts").dropna()
    pool = pool if pool.limit(1).count() else spark.createDataFrame([("", "", 90.0, 450.0)], "origin string, destination string, duration_min double, speed_kts double")
    freq = read("global_dest_freq")
    freq = freq.withColumnRenamed("index", "destination") if "destination" not in freq.columns else freq
    return {
        "bin_minutes": minutes,
        "airport_bins": full.join(rates, ["origin", "bin"], "left").select("origin", "bin", F.coalesce("rate", F.lit(0.0)).alias("rate")),
        "od_time_model": renormalised(num(read("od_time_model"), "bin", "prob").withColumn("bin", F.col("bin").cast("int")), "prob", "origin", "bin"),
        "tat_dist": tat if tat.limit(1).count() else spark.createDataFrame([(0.0,)], "tat_min double"),
        "od_dur_dist": pool,
        "global_dest_freq": renormalised(num(freq, "freq"), "freq"),
    }


def in_order(rows: DataFrame, mark: str) -> DataFrame:
    """ordinal: row numbers from 0 in the order of monotonically increasing ids, from the sizes of the partitions that gave them."""
    part = F.shiftright(mark, 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_base"))  # a row a partition
    out = rows.withColumn("_p", part).join(F.broadcast(base), "_p")
    return out.withColumn("ordinal", F.col("_base") + F.col(mark).bitwiseAND((1 << 33) - 1)).drop("_p", "_base", mark)


def assignment(spark: SparkSession, path: str) -> DataFrame:
    """id, sector as whole numbers; rows in which either isn't one go."""
    df = resolve(text_csv(spark, path), {"id": ("navaid_id", "vertex"), "sector": ("sector_id",)}, positional=True)
    return df.select(*[F.col(c).try_cast("double").cast("long").alias(c) for c in ("id", "sector")]).dropna()


def integer_edges(spark: SparkSession, path: str) -> DataFrame:
    """u < v, d with whole numbers as ends, of repeated edges (either way round) the last in the file."""
    df = resolve(text_csv(spark, path), {"u": ("source", "v0", "from"), "v": ("target", "v1", "to"), "d": ("dist_m", "dist", "weight")}, positional=True)
    # the order of the lines, in one file or in files that follow each other by name
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("m"))
    rows = df.select(*[F.col(c).try_cast("double").cast("long").alias(c) for c in ("u", "v")], F.col("d").try_cast("double").alias("d"), place.alias("ordinal"))
    return graph(rows.dropna(subset=["u", "v"]), "ordinal")


def vertex_file(spark: SparkSession, folder: str) -> DataFrame:
    """id, lat, lon, alt, is_airport, ordinal: the vertices with their places in the file."""
    v = resolve(text_csv(spark, f"{folder}/vertices.csv"), {"id": ("identifier",), "lat": ("latitude",), "lon": ("longitude",), "alt": ("altitude",), "is_airport": ("isairport",)})
    v = v.select(F.upper(F.trim("id")).alias("id"), *[F.col(c).try_cast("double").alias(c) for c in ("lat", "lon", "alt")], F.coalesce(F.col("is_airport").try_cast("int"), F.lit(0)).alias("is_airport"), F.monotonically_increasing_id().alias("_m"))
    return in_order(v, "_m")


def graph_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id, lat, lon, alt, is_airport, ordinal) and edges (u, v, d). Where every end of an edge is a number, ends are row
    numbers of the vertices."""
    v = vertex_file(spark, folder)
    e = resolve(text_csv(spark, f"{folder}/edges.csv"), {"u": ("v0", "source", "from"), "v": ("v1", "target", "to"), "d": ("dist", "dist_m", "distance", "weight")}, positional=True)
    e = e.select(F.upper(F.trim("u")).alias("u"), F.upper(F.trim("v")).alias("v"), F.col("d").try_cast("double").alias("d"))
    if e.agg(all_numeric(e, "u", "v").alias("x")).first()["x"]:
        n = v.select(F.col("ordinal").cast("long").alias("o"), "id")
        a, b = n.select(F.col("o").alias("ou"), F.col("id").alias("iu")), n.select(F.col("o").alias("ov"), F.col("id").alias("iv"))
        e = e.join(a, F.col("u").try_cast("double").cast("long") == F.col("ou")).join(b, F.col("v").try_cast("double").cast("long") == F.col("ov")).select(F.col("iu").alias("u"), F.col("iv").alias("v"), "d")
    return v, e


def checked_flights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Flights with strict ISO times, and the lines that give none: file, line_number (from 1, as an editor shows it), line, flight_id,
    reason (fields, time, or junk for a time with characters that no time has). Blank lines are neither."""
    lines = numbered_lines(spark, path)
    head = lines.filter("n = 0").select("line").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = next(csv.reader([head["line"].lstrip("\ufeff")]))
    schema = ", ".join(f"`{c.replace('`', '')}` string" for c in [*names, CORRUPT])
    body = lines.filter((F.col("n") > 0) & (F.trim("line") != ""))
    rows = body.withColumn("_p", F.from_csv("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).select(F.col("file").alias(MARKS[0]), (F.col("n") + 1).alias(MARKS[1]), F.col("line").alias(MARKS[2]), "_p.*")
    wanted = {"flight_id": ("id",), "aircraft_id": ("airplane_id",), "origin": ("from",), "destination": ("to",), "departure_time": ("departure",)}
    rows = resolve(rows, wanted | dict.fromkeys((*MARKS, CORRUPT), ())).withColumn("departure", F.try_to_timestamp("departure_time", F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))
    junk = F.coalesce(F.col("departure_time").rlike(r"[^0-9T:+\-Z.]"), F.lit(False))
    reason = F.when(F.col(CORRUPT).isNotNull(), "fields").when(F.col("departure").isNull() & junk, "junk").when(F.col("departure").isNull(), "time")
    rows = rows.withColumn("reason", reason)
    bad = rows.filter("reason is not null").select(*(F.col(m).alias(c) for m, c in zip(MARKS, ("file", "line_number", "line"))), "flight_id", "reason")
    return rows.filter("reason is null").drop(*MARKS, CORRUPT, "departure_time", "reason"), bad


#: Names of the columns that go with a line through parsing.
MARKS, CORRUPT = ("__file", "__number", "__text"), "__corrupt"


def flights(spark: SparkSession, path: str) -> DataFrame:
    """Flights with strict ISO times. Lines that don't give one are reported by file and number, and raise."""
    good, bad = checked_flights(spark, path)
    found = bad.orderBy("file", "line_number").limit(10).collect()
    if found:
        raise ValueError("unreadable flights: " + "; ".join(f"{r['file'].rsplit('/', 1)[-1]} line {r['line_number']} ({r['reason']}): {r['line'][:200]}" for r in found))
    return good


def filed(spark: SparkSession, path: str) -> DataFrame:
    df = resolve(text_csv(spark, path), {"flight_id": ("flight",), "position": ("vertex", "node"), "time": ("slot",)}, positional=True)
    return df.select("flight_id", F.upper(F.trim("position")).alias("position"), F.col("time").cast("double").cast("long").alias("time"))


def config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration with names taken alike with hyphens and underscores."""
    return {k.replace("-", "_"): v for k, v in json.loads(storage.read_text(spark, path)).items()}


def regions(cfg: dict, name: str = "REGION_{}", none: str | None = None) -> list[tuple[str, list[float]]]:
    """Names and polygons; regions without a name get one by their place, and `none` stands for a configuration without any. Scenario
    folders call them poly0, poly1, ... and world."""
    out = []
    for i, r in enumerate(cfg.get("considered_geographic_regions") or []):
        r = {k.replace("-", "_"): v for k, v in r.items()}
        out.append((r.get("region_name") or name.format(i), r.get("polygon") or []))
    return out or ([(none, [])] if none else [])


def include_list(spec: str | list | None, spark: SparkSession | None = None) -> list[str] | None:
    """Airports as a list, as text or in a file; None for none."""
    if not spec:
        return None
    if isinstance(spec, str):
        if spark is not None and re.fullmatch(r"[^\s,;]*[./][^\s,;]*", spec) and storage.exists(spark, spec):
            spec = storage.read_text(spark, spec)
        spec = re.split(r"[,\s;]+", spec)
    found = [s.strip().upper() for s in spec]
    return list(dict.fromkeys(s for s in found if re.fullmatch(ICAO, s))) or None


def is_missing(token: str | None) -> bool:
    return token is None or token.strip().upper() in BAD_TOKENS
