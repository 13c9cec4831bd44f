"""The whole scenario: model, graph, sectors, sampled days, routes, repair and files, in one session.

Parameters come from the command line, then the configuration, then the defaults. What a stage has written is kept when its
parameters and inputs are the same, unless forced; a stage that is made anew is written beside the old one and takes its place
when it is whole.

    python -m skylattice.plans.scenario --config c.json --legs in/ --airports airports.csv --out out/ [--seeds 1;2 ...]
"""

from __future__ import annotations

import argparse
import hashlib
import json
import warnings
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.scalar import DEFAULT_SPEED, start_slot
from skylattice.operators import fleet, graph, model, sampling, sectors, spatial
from skylattice.session import cut
from skylattice.sinks import writers
from skylattice.sources import readers, storage


@dataclass
class Parameters:
    start: str = "2019-06-01"
    end: str = "2019-06-30"
    bin_minutes: int = 15
    zone_hours: int = 0
    smoothing_width: int = 0
    alpha: float = 0.0
    backoff: float = 0.0
    epsilon: float = 0.0
    min_samples: int = 10
    tat_min: float = 20.0
    tat_max: float = 720.0
    scales: list = field(default_factory=lambda: [1.0])
    exact_flights: int = 0
    seeds: list = field(default_factory=lambda: [1])
    day: str = "2024-01-01"
    nx: int = 5
    ny: int = 5
    altitude: float = 9144.0
    #: grid, or points with edges by radius, gabriel or relative (neighbours)
    graph: str = "grid"
    levels: str = ""
    min_separation_m: float = -1.0
    solver: bool = False
    script: bool = False
    max_edge_m: float = 400_000.0
    nearest: int = 4
    connect: str = "closest"
    granularity: int = 4
    timespan: int = 24
    sector_size: int = 1
    convex: bool = False
    airport_capacity: int = 1000
    enroute_capacity: int = 1200
    force: bool = False

    @classmethod
    def of(cls, config: dict, given: dict | None = None) -> Parameters:
        """Names alike with hyphens and underscores; lists also as text with ';' or ','."""
        known = {f.name: f for f in fields(cls)}
        out: dict = {}
        for source in (config, given or {}):
            for k, v in source.items():
                name = k.replace("-", "_")
                if name in known and v is not None:
                    out[name] = listed(v) if name in ("scales", "seeds") else flag(v) if known[name].type == "bool" else v
        return cls(**out)


def listed(value) -> list:
    if isinstance(value, str):
        value = [float(x) if "." in x or "e" in x.lower() else int(x) for x in value.replace(";", ",").split(",") if x.strip()]
    return list(dict.fromkeys(value if isinstance(value, list | tuple) else [value]))


def flag(value) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "y", "on") if not isinstance(value, bool) else value


def dataset_name(scale: float, seed: int) -> str:
    return f"DATA_S{scale}_{seed}".replace(".", "p").replace("-", "m")


def grid(p: Parameters) -> list[tuple[float, int]]:
    """Scales and seeds, scale by scale."""
    return [(s, k) for s in p.scales for k in p.seeds]


def grid_table(scales: DataFrame, seeds: DataFrame) -> DataFrame:
    """scale, seed, place: the same of two tables."""
    every = scales.select("scale").distinct().crossJoin(seeds.select("seed").distinct())  # each pair is a row of the result
    return graph.first_appearance(every.withColumn("_k", F.struct("scale", "seed")), "_k", F.col("_k")).select("_k.scale", "_k.seed", F.col("id").alias("place"))


def made(spark: SparkSession, folder: str, mark: str, force: bool, write: Callable[[str], None]) -> bool:
    """Writes a stage's folder unless it is there with the same mark. The new folder is whole before it takes the old one's place."""
    if not force and storage.exists(spark, f"{folder}/parameters.txt") and storage.read_text(spark, f"{folder}/parameters.txt") == mark:
        return False
    fresh = f"{folder}.making"
    storage.remove(spark, fresh)
    write(fresh)
    storage.write_text(spark, f"{fresh}/parameters.txt", mark)
    storage.remove(spark, folder)
    storage.move(spark, fresh, folder)
    return True


def fingerprint(*tables: DataFrame | None) -> list:
    """Number of rows and an order-free sum of row hashes of each table."""
    row = lambda t: F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in t.columns]).cast("decimal(38,0)")
    return [None if t is None else [str(x) for x in t.agg(F.count("*"), F.sum(row(t))).first()] for t in tables]


def in_regions(ports: DataFrame, polygons: list[list[float]]) -> DataFrame:
    """Airports in any of the polygons; where none is, polygons don't count."""
    inside = ports.filter(geo.in_regions(F.col("lat"), F.col("lon"), polygons))
    if polygons and not inside.limit(1).count():
        warnings.warn("no airport lies in the regions; they are not used", stacklevel=2)
        return ports
    return inside


def models(legs: DataFrame, p: Parameters) -> dict[str, DataFrame]:
    rates = model.departure_rates(legs, p.bin_minutes, p.start, p.end, p.zone_hours)
    if p.smoothing_width > 1:
        rates = model.smoothed(rates, p.smoothing_width)
    if p.epsilon > 0:
        rates = model.private(rates, p.epsilon, p.seeds[0])
    pool = model.speed_classes(model.durations(legs, 5.0, 1440.0))
    return {
        "airport_bins": rates,
        "od_time_model": model.od_probabilities(legs, p.bin_minutes, p.alpha, p.backoff, p.zone_hours),
        "tat_dist": model.turnarounds(legs, p.tat_min, p.tat_max),
        "od_dur_dist": pool,
        "global_dest_freq": model.destination_frequency(legs),
    }


def linked(points: DataFrame, p: Parameters) -> DataFrame:
    """Edges among points by the scenario's rule."""
    if p.graph == "radius":
        return cut(spatial.radius_pairs(points, p.max_edge_m))
    return cut(spatial.open_pairs(points, p.max_edge_m, relative={"gabriel": False, "relative": True}[p.graph]))


def navigation(spark: SparkSession, ports: DataFrame, boxes: list, p: Parameters, points: DataFrame | None = None, polygons: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Grid points of the boxes with their neighbours, or given points (id, lat, lon, ordinal) of the regions with edges by rule;
    airports attached, everything joined up and, where levels are asked for, lifted to them."""
    up = geo.levels(p.levels) if p.levels else []
    altitude, names = geo.base_altitude(up) if up else p.altitude, ("id", "lat", "lon", "alt")
    air = ports.select(F.col("icao").alias("id"), "lat", "lon", F.lit(0.0).alias("alt"), F.lit(1).alias("is_airport"))
    if p.graph == "grid":
        grid_ = spatial.grid_points(spark, boxes, p.nx, p.ny, altitude)
        inner, edges = grid_.select(*names, F.lit(0).alias("is_airport")), spatial.grid_edges(grid_)
    else:
        inner = points.filter(geo.in_regions(F.col("lat"), F.col("lon"), polygons or [])).join(air.select("id"), "id", "left_anti")
        inner = inner.select("id", "lat", "lon", F.lit(float(altitude)).alias("alt"), F.lit(0).alias("is_airport"))
    v = air.unionByName(inner)
    ids = v.select(F.col("id").alias("name"), (1 - F.col("is_airport")).alias("o"))
    numbers = graph.first_appearance(ids, "name", F.col("o")).select(F.col("name"), F.col("id").alias("ordinal"))
    v = cut(v.join(numbers, v["id"] == numbers["name"]).drop("name"))
    if p.graph != "grid":
        if p.min_separation_m >= 0:
            v = cut(spatial.separated(v, p.min_separation_m))
        edges = linked(v.filter("is_airport = 0").select(*names), p)
    attached = spatial.knn_attach(v.filter("is_airport = 1").select(*names), v.filter("is_airport = 0").select(*names), p.nearest, p.max_edge_m)
    edges = edges.withColumn("ordinal", F.lit(0)).unionByName(attached.withColumn("ordinal", F.lit(1)))  # as they come in the file: the last one counts
    edges = cut(graph.graph(edges, "ordinal"))
    edges = cut(edges.unionByName(graph.bridges(v, edges, p.connect)))
    if not up:
        return v, edges
    high = spatial.expanded(v.select("id", "lat", "lon", "is_airport"), up)
    order = v.select(F.col("id").alias("base"), "ordinal")
    high = cut(high.join(order, "base").withColumn("ordinal", F.col("ordinal") * len(up) + F.greatest("level", F.lit(0))))
    return high.select(*names, "is_airport", "ordinal"), cut(spatial.lifted(edges, high))


def sampled(m: dict[str, DataFrame], p: Parameters, scale: float, seed: int) -> DataFrame:
    """Departures of a day with destination, duration, speed and turnaround drawn."""
    if p.exact_flights:
        drawn = sampling.exact_events(m["airport_bins"], p.exact_flights, p.day, p.bin_minutes, seed, scale)
    else:
        drawn = sampling.events(sampling.counts(m["airport_bins"], scale, seed), p.day, p.bin_minutes, seed).withColumn("round", F.lit(0))
    keyed = drawn.withColumn("key", F.concat_ws("-", "round", "origin", "bin", "idx"))
    to = sampling.destinations(keyed, m["od_time_model"], m["global_dest_freq"], seed, "key").select("key", "origin", "departure", "destination")
    timed = sampling.bootstrapped(to, m["od_dur_dist"], seed, "key", min_samples=p.min_samples, default=90.0)
    speeds = m["od_dur_dist"].groupBy("duration_min").agg(F.min("speed_kts").alias("speed_kts"))
    tat = m["tat_dist"].select(F.col("flight_id"), F.col("tat_min"), F.lit("").alias("origin"), F.lit("").alias("destination"))
    out = sampling.bootstrapped(timed, tat, seed + 1, "key", value="tat_min", default=0.0)
    out = out.join(speeds, "duration_min", "left").withColumn("speed_kts", F.coalesce(F.col("speed_kts").cast("double"), F.lit(DEFAULT_SPEED)))
    return out.select(F.lit("day").alias("scenario"), F.col("key").alias("idx"), "origin", "destination", "departure", "duration_min", "tat_min", F.col("speed_kts").cast("int").alias("speed_kts"))


def filed(flights: DataFrame, vertices: DataFrame, edges: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """Routes in slots and the flights with repaired aircraft. Flights with unknown or unlinked ends have no route and are left out.
    Trees are solved once for each speed and origin."""
    known = vertices.select("id")
    for c in ("origin", "destination"):
        flights = flights.join(known.withColumnRenamed("id", c), c, "left_semi")
    flights = cut(flights.withColumn("start_slot", start_slot(F.col("departure"), 3600.0 / p.granularity).cast("long")))
    weighted = cut(graph.slot_weights(edges, flights, p.granularity))
    steps = None
    for (k,) in sorted(map(tuple, flights.select("speed_kts").distinct().collect())):  # a row for each class of speed
        one = weighted.filter(F.col("speed_kts") == k).select("u", "v", "w")
        arcs = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).withColumn("w", F.col("w").cast("long"))
        mine = flights.filter(F.col("speed_kts") == k)
        tree = graph.shortest_costs(arcs, mine.select(F.col("origin").alias("src")).distinct())
        walk = graph.routes(tree, mine.select("flight_id", F.col("origin").alias("src"), F.col("destination").alias("dst")))
        steps = walk if steps is None else steps.unionByName(walk)
    rows = steps.join(flights.select("flight_id", "start_slot"), "flight_id").select("flight_id", "seq", F.col("node").alias("position"), (F.col("dist") + F.col("start_slot")).alias("time"))
    horizon = p.granularity * p.timespan
    rows = cut(graph.clamped(rows, horizon))
    spans = rows.groupBy("flight_id").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    fixed = cut(fleet.overlap_repair(flights.join(spans, "flight_id"), horizon))
    moved = rows.join(fixed.select("flight_id", "shift"), "flight_id").select("flight_id", "seq", "position", (F.col("time") + F.col("shift")).alias("time"))
    return moved, flights.drop("aircraft_id").join(fixed.select("flight_id", F.col("new_aircraft_id").alias("aircraft_id")), "flight_id")


def sector_tables(v: DataFrame, e: DataFrame, p: Parameters) -> tuple[DataFrame, DataFrame]:
    """id, capacity of all vertices, and id, sector: grown among the enroute vertices, airports alone."""
    enroute = v.filter("is_airport = 0")
    inner = e.join(enroute.select(F.col("id").alias("u")), "u", "left_semi").join(enroute.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "d")
    grouped = sectors.sectors(enroute.select("id", "ordinal"), inner, p.sector_size, p.convex).select("id", "sector")
    own = v.filter("is_airport = 1").select("id", F.concat(F.lit("SECTOR_SINGLE_"), "id").alias("sector"))
    size = F.when(F.col("is_airport") == 1, p.airport_capacity).otherwise(p.enroute_capacity)
    return v.select("id", size.alias("capacity")), cut(grouped.unionByName(own))


def run(spark: SparkSession, legs: DataFrame, ports: DataFrame, p: Parameters, out: str, boxes: list, points: DataFrame | None = None, polygons: list | None = None) -> list[str]:
    """Writes everything under a new or known folder and returns the names of the datasets."""
    ports = cut(in_regions(ports, polygons or []))
    inputs = [fingerprint(legs, ports, points), boxes, polygons]
    mark = hashlib.sha256(json.dumps([asdict(p) | {"force": None}, inputs], sort_keys=True, default=str).encode()).hexdigest()
    m = {k: cut(x) for k, x in models(legs, p).items()}
    v, e = navigation(spark, ports, boxes, p, points, polygons)
    capacities, assigned = sector_tables(v, e, p)

    def graph_stage(folder: str) -> None:
        writers.graph_files(folder, v, e)
        writers.sector_files(folder, capacities, assigned)
        report = graph.sector_connectivity(assigned, e).select("sector", "n_components", F.array_join(F.transform("sizes", lambda x: x.cast("string")), " ").alias("sizes"))
        writers.csv(report, f"{folder}/sector_connectivity.csv", "sector")
        writers.document(spark, f"{folder}/run_config.json", asdict(p))

    def model_stage(folder: str) -> None:
        writers.model_artifacts(folder, m, p.bin_minutes)
        writers.document(spark, f"{folder}/run_config.json", asdict(p))

    made(spark, f"{out}/model", mark, p.force, model_stage)
    made(spark, f"{out}/navgraph", mark, p.force, graph_stage)
    names = []
    for scale, seed in grid(p):
        name = dataset_name(scale, seed)
        folder = f"{out}/{name}"
        if not p.force and storage.exists(spark, f"{folder}/parameters.txt") and storage.read_text(spark, f"{folder}/parameters.txt") == mark:
            names.append(name)
            continue
        day = cut(fleet.rotation(sampled(m, p, scale, seed)))
        if day.limit(2).count() < 2:
            storage.remove(spark, folder)
            continue  # a day of one flight is none
        rows, flights = filed(day, v, e, p)

        def day_stage(folder: str, rows: DataFrame = rows, flights: DataFrame = flights, seed: int = seed) -> None:
            writers.synthetic_day(folder, flights)
            writers.csv(rows.select(F.col("flight_id").alias("Flight_ID"), F.col("position").alias("Position"), F.col("time").alias("Time")), f"{folder}/filed_flights.csv", "Flight_ID", "Time", whole=False)
            craft = flights.groupBy("aircraft_id").agg(F.min("speed_kts").alias("speed_kts"))
            if p.solver:
                lines = writers.edge_lines(e, v).select(F.col("V0").alias("u"), F.col("V1").alias("v"), F.col("D").cast("double").alias("d")).withColumn("line", F.concat_ws(",", "u", "v"))
                order = graph.first_appearance(lines, "line", F.col("line")).select("line", F.col("id").alias("ordinal"))
                ordered = lines.join(order, "line").drop("line")
                tables = writers.solver_tables(v, ordered, flights, rows, craft, capacities, assigned.join(v.select("id", "ordinal"), "id"))
                writers.solver_bundle(f"{folder}/solver", tables, seed)
            if p.script:
                writers.scenario(f"{folder}/scenario.scn", writers.scenario_lines(rows, flights, craft, v, writers.slot_seconds(None, p.granularity)))
            writers.document(spark, f"{folder}/run_config.json", asdict(p) | {"scale": scale, "seed": seed})

        made(spark, folder, mark, True, day_stage)
        names.append(name)
    writers.document(spark, f"{out}/manifest.json", {"datasets": names, "parameters": asdict(p)})
    return names


def main(argv: list[str] | None = None) -> list[str]:
    """The command line: files in, a scenario's folders out."""
    from skylattice.session import session, ship

    parser = argparse.ArgumentParser(prog="skylattice.plans.scenario")
    for name in ("config", "legs", "airports", "out", "fixes", "aids"):
        parser.add_argument(f"--{name}", required=name in ("legs", "airports", "out"))
    for f in fields(Parameters):
        parser.add_argument(f"--{f.name.replace('_', '-')}")
    given = vars(parser.parse_args(argv))
    spark = session("scenario")
    ship(spark)
    cfg = readers.config(spark, given["config"]) if given["config"] else {}
    kinds = {f.name: f.type for f in fields(Parameters)}
    own = {k: {"int": int, "float": float}.get(kinds[k], str)(x) for k, x in given.items() if k in kinds and x is not None}
    areas = readers.regions(cfg, "poly{}", "world")
    legs = readers.parsed_times(readers.flight_list(spark, given["legs"])).withColumn("flight_id", F.monotonically_increasing_id().cast("string"))
    found = [f(spark, given[k]) for k, f in (("fixes", readers.fixes), ("aids", readers.aids)) if given[k]]
    points = graph.keep_first(found[0].unionByName(found[1]) if len(found) > 1 else found[0], ["id"], "ordinal") if found else None
    boxes = [(name, geo.bounds(polygon) if polygon else (-60.0, -180.0, 75.0, 180.0)) for name, polygon in areas]
    return run(spark, cut(legs), readers.airports(spark, given["airports"]), Parameters.of(cfg, own), given["out"], boxes, points, [polygon for _, polygon in areas if polygon])


if __name__ == "__main__":
    main()
