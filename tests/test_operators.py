"""Library operators on small fixtures: invariants of what SQL can't express, edge cases, and every query against its SQL."""

import glob
import itertools
import json
import math
import os
import random

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.functions import geo, scalar
from skylattice.operators import fleet, graph, model, sampling, sectors, spatial
from skylattice.plans import catalogue, round_trips, scenario  # noqa: F401
from skylattice.sinks import writers
from skylattice.sources import readers

SF = "/root/testdata/sf0.001"


def points(spark, rows):
    return spark.createDataFrame([(i, float(a), float(b), float(c), 0, i) for i, a, b, c in rows], "id long, lat double, lon double, alt double, is_airport int, ordinal long")


def haversine(a, b):
    (p, q), (r, s) = a, b
    h = math.sin(math.radians(r - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(r)) * math.sin(math.radians(s - q) / 2) ** 2
    return 2 * geo.EARTH * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("metres", [1_000.0, 300_000.0, 5_000_000.0, 19_000_000.0])
def test_radius_join_anywhere_on_earth(spark, metres):
    r = random.Random(2)
    at = [(90, 0), (-90, 10), (89.9, 120), (89.9, -60), (0, 180), (0, -180), (0.001, 179.9999), (52.0, -179.99), (52.0, 179.99), (-89.99, 5)]
    at += [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(80)]
    at += [(a + r.uniform(-0.005, 0.005) if abs(a) < 89 else a, b) for a, b in at[10:40]]
    got = {(x["u"], x["v"]) for x in spatial.radius_pairs(points(spark, [(i, a, b, 0) for i, (a, b) in enumerate(at)]), metres).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(at)), 2) if haversine(at[i], at[j]) <= metres}
    off = {p for p in got ^ want if abs(haversine(at[p[0]], at[p[1]]) - metres) > 0.01}
    assert not off


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_sends_no_side_whole(spark):
    """Neither side goes through the driver, and a point's columns come along without a join with the pairs."""
    v = catalogue.S.navpoints(spark, SF)
    pairs = spatial.radius_pairs(v.withColumn("sector", F.floor(F.col("id") / 50)), 60_000.0, carry=("ordinal",), on=("sector",))
    assert "Broadcast" not in plan_of(spatial.radius_pairs(v, 60_000.0)) and "Broadcast" not in plan_of(pairs)
    want = {(r["u"], r["v"]) for r in spatial.radius_pairs(v, 60_000.0).collect() if r["u"] // 50 == r["v"] // 50}
    got = pairs.collect()
    assert want and {(r["u"], r["v"]) for r in got} == want and all(r["ordinal_u"] == r["u"] and r["ordinal_v"] == r["v"] for r in got)


def test_components_by_growing_radii(spark):
    """The same as over all links, at once and over several radii, with crowds, a gap that only the last radius bridges, and none."""
    r = random.Random(4)
    rows = [(i, 50 + r.uniform(0, 0.05), 10 + r.uniform(0, 0.05), r.choice([0, 9000])) for i in range(150)]
    rows += [(200 + i, 50 + r.uniform(0, 0.05), 10.19 + r.uniform(0, 0.05), 0) for i in range(60)] + [(300 + i, r.uniform(-80, 80), r.uniform(-180, 180), 0) for i in range(20)]
    v = points(spark, rows)
    for metres in (3_000.0, 12_000.0):
        want = {x["id"]: x["component"] for x in graph.components(v, spatial.radius_pairs(v, metres)).collect()}
        assert {x["id"]: x["component"] for x in graph.radius_components(v, metres).collect()} == want
    assert graph.radius_components(v.limit(0), 1_000.0).count() == 0


def test_boundaries_of_proximity_graphs(spark):
    # the third point is on the circle of the longest side, and just as far from both ends as they are from each other
    tri = spark.createDataFrame([(1, 2, 5.0), (1, 3, 3.0), (2, 3, 4.0)], "u long, v long, d double")
    assert graph.graph(spatial.gabriel(tri)).count() == 3
    even = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], "u long, v long, d double")
    assert spatial.relative_neighbours(even).count() == 3
    far = spark.createDataFrame([(1, 2, 5.0), (1, 3, 2.9), (2, 3, 4.0)], "u long, v long, d double")
    assert {(r["u"], r["v"]) for r in spatial.gabriel(far).collect()} == {(1, 3), (2, 3)}
    assert spatial.relative_neighbours(far, compat=True).count() == 3


def test_polygon_edges(spark):
    square, other = [0.0, 0.0, 0.0, 10.0, 10.0, 10.0, 10.0, 0.0], [20.0, 20.0, 20.0, 30.0, 30.0, 30.0]
    rows = [(5.0, 5.0), (15.0, 5.0), (0.0, 5.0), (10.0, 5.0), (21.0, 29.0), (29.0, 21.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    got = [r[0] for r in df.select(geo.in_regions(F.col("lat"), F.col("lon"), [square, other])).collect()]
    assert got == [True, False, True, False, True, False]
    with pytest.raises(ValueError):
        geo.pairs([1.0, 2.0, 3.0])
    assert geo.levels("[300, 100; 100]") == [(0, 100 * 100 * 0.3048, "FL100"), (1, 300 * 100 * 0.3048, "FL300")]


def test_attachment_keeps_the_nearest(spark):
    a = points(spark, [(1, 50, 10, 0), (2, 0, 0, 0)])
    p = points(spark, [(10, 50.01, 10, 0), (11, 50.02, 10, 0), (12, 50.5, 10, 0), (13, 51, 10, 0)])
    got = {(r["u"], r["v"]) for r in spatial.knn_attach(a, p, 3, 5_000.0).collect()}
    assert got == {(1, 10), (1, 11), (2, 10)}


def test_separation(spark):
    at = [(0, 50.0, 10.0, 1), (1, 50.01, 10.0, 1), (2, 50.02, 10.0, 0), (3, 51.0, 10.0, 0), (4, 51.05, 10.0, 0), (5, 51.1, 10.0, 0)]
    df = spark.createDataFrame([(i, a, b, 0.0, k, i) for i, a, b, k in at], "id long, lat double, lon double, alt double, is_airport int, ordinal long")
    assert {r["id"] for r in spatial.separated(df, 6_000.0).collect()} == {0, 1, 3, 5}


def ring(n):
    return [(i, (i + 1) % n) for i in range(n)]


def test_separation_of_a_long_chain(spark):
    """A chain in which each point waits for the one before, and a crowd in a random order; both as one by one."""
    r = random.Random(5)
    at = [(0.0, 0.004 * i) for i in range(3000)] + [(5 + r.uniform(0, 0.2), r.uniform(0, 0.2)) for _ in range(300)]
    rows = [(f"p{i}", a, b, 0.0, int(i % 97 == 3000 % 97 and i >= 3000), i if i < 3000 else 3000 + (i * 7919 % 300)) for i, (a, b) in enumerate(at)]
    got = {x["id"] for x in spatial.separated(spark.createDataFrame(rows, "id string, lat double, lon double, alt double, is_airport int, ordinal long"), 500.0).collect()}
    kept, cells = set(), {}
    for i, a, b, _, air, o in sorted(rows, key=lambda x: (1 - x[4], x[5], x[0])):
        c = (int(a / 0.01), int(b / 0.01))
        close = [k for x in (-1, 0, 1) for y in (-1, 0, 1) for k in cells.get((c[0] + x, c[1] + y), [])]
        if air or not any(haversine((a, b), k) <= 500.0 for k in close):
            kept.add(i)
            cells.setdefault(c, []).append((a, b))
    assert got == kept and len(kept) < 2000


def test_components_and_bridges(spark):
    rows = [(i, 50 + i * 0.1, 10, 0) for i in range(3)] + [(10 + i, 50 + i * 0.1, 12, 0) for i in range(3)] + [(20, 55, 11, 0)]
    v = points(spark, rows)
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (10, 11, 1.0), (11, 12, 1.0)], "u long, v long, d double")
    assert {r["id"]: r["component"] for r in graph.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 10: 10, 11: 10, 12: 10, 20: 20}
    for method in ("mst", "greedy", "closest"):
        b = graph.bridges(v, e, method)
        assert b.count() == 2
        assert graph.components(v, e.select("u", "v").union(b.select("u", "v")).withColumn("d", F.lit(1.0))).select("component").distinct().count() == 1
    assert graph.bridges(v.filter("id < 3"), e.filter("u < 3")).count() == 0


def check_groups(groups, links, size, order):
    assert sorted(x for g in groups for x in g) == sorted(order)
    for g in groups:
        seen, todo = {g[0]}, [g[0]]
        while todo:
            for y in links.get(todo.pop(), {}):
                if y in g and y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert seen == set(g)
        assert size is None or len(g) <= size


def grown(grow, order, links, size):
    """Groups of a dictionary of neighbours."""
    u, v, d = zip(*((a, b, w) for a, x in links.items() for b, w in x.items() if a < b))
    owner = grow(sectors.Net(len(order), np.array(u), np.array(v), np.array(d)), size)
    groups = {}
    for x, k in zip(order, owner):
        groups.setdefault(k, []).append(x)
    return [groups[k] for k in sorted(groups)]


def test_growth_of_sectors():
    r = random.Random(4)
    path = {i: {} for i in range(7)}
    for i in range(6):
        path[i][i + 1] = path[i + 1][i] = 1.0
    assert grown(sectors.grow_connected, list(range(7)), path, 3) == [[0, 1, 2], [3, 4, 5], [6]]
    star = {0: {i: 1.0 for i in range(1, 6)}} | {i: {0: 1.0} for i in range(1, 6)}
    assert grown(sectors.grow_connected, list(range(6)), star, 3) == [[0, 1, 2], [3], [4], [5]]
    for _ in range(15):
        n = 25
        links = {i: {} for i in range(n)}
        for _ in range(45):
            a, b = r.randrange(n), r.randrange(n)
            if a != b:
                links[a][b] = links[b][a] = float(r.randint(1, 5))
        check_groups(grown(sectors.grow_connected, list(range(n)), links, 4), links, 4, range(n))
        convex = grown(sectors.grow_convex, list(range(n)), links, 4)
        check_groups(convex, links, None, range(n))
    cycle = {i: {} for i in range(6)}
    for a, b in ring(6):
        cycle[a][b] = cycle[b][a] = 1.0
    assert sorted(map(sorted, grown(sectors.grow_convex, list(range(6)), cycle, 3))) == sorted(map(sorted, [[0, 1, 5], [2, 3, 4]]))


def test_sectors_are_numbered_by_seed(spark):
    v = points(spark, [(i, 50, 10, 0) for i in range(7)])
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "u long, v long, d double")
    got = {r["id"]: r["sector"] for r in sectors.sectors(v, e, 3).collect()}
    assert got == {i: f"SECTOR_{i // 3 + 1:06d}" for i in range(7)}


def test_sectors_of_a_radius_need_no_pairs(spark, monkeypatch):
    """Two crowds, one over the date line, points alone and two altitudes: the sectors of all links, which are not made."""
    r = random.Random(8)
    spots = [(r.uniform(50, 51.5), r.uniform(8, 10)) for _ in range(250)] + [(r.uniform(-1, 1), (179 + r.uniform(0, 2) + 180) % 360 - 180) for _ in range(150)] + [(80, 0), (-89.9, 3), (-89.9, -170)]
    v = points(spark, [(i * 7919 % 1009, a, b, 9000 * (i % 40 == 0)) for i, (a, b) in enumerate(spots)])
    want = sorted(map(tuple, sectors.sectors(v, spatial.radius_pairs(v, 30_000.0), 9).collect()))
    monkeypatch.setattr(spatial, "_met", None)
    got = sorted(map(tuple, sectors.radius_sectors(v, 30_000.0, 9).collect()))
    assert got == want and len({s for _, s, _ in got}) > 40
    assert sectors.radius_sectors(v.limit(0), 30_000.0, 9).count() == 0


def test_edges_of_sectors_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    v = points(spark, [(i, 50, 10, 0) for i in range(7)])
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "u long, v long, d double").mapInPandas(counted, "u long, v long, d double")
    assert sectors.sectors(v, e, 3, convex=True).count() == 7
    assert made.value == 6


def test_shortest_paths(spark):
    r = random.Random(6)
    e = {(min(a, b), max(a, b)): r.randint(1, 9) for a, b in ((r.randrange(20), r.randrange(20)) for _ in range(40)) if a != b} | {(90, 91): 2}
    arcs = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()] + [(b, a, w) for (a, b), w in e.items()], "u long, v long, w long")
    tree = graph.shortest_costs(arcs, spark.createDataFrame([(0,), (5,)], "src long"))
    dist = {(r["src"], r["node"]): r["dist"] for r in tree.collect()}
    far = {(s, s): 0 for s in (0, 5)}
    for _ in range(30):
        for s, ((a, b), w) in itertools.product((0, 5), e.items()):
            for x, y in ((a, b), (b, a)):
                if (s, x) in far and far[s, x] + w < far.get((s, y), 1e9):
                    far[s, y] = far[s, x] + w
    assert dist == far
    wanted = spark.createDataFrame([(f"F{n}", s, n) for s, n in far], "flight_id string, src long, dst long").withColumn("flight_id", F.concat_ws("-", "src", "flight_id"))
    walks = {}
    for x in graph.routes(tree, wanted.union(spark.createDataFrame([("no", 0, 91)], "f string, s long, d long"))).orderBy("flight_id", "seq").collect():
        walks.setdefault(x["flight_id"], []).append((x["node"], x["dist"]))
    assert "no" not in walks and len(walks) == len(far)
    for w in walks.values():
        for (a, da), (b, db) in itertools.pairwise(w):
            assert e[min(a, b), max(a, b)] == db - da


def test_slots_and_clamp(spark):
    df = spark.createDataFrame([(0.0, 450.0), (231498.0, 450.0), (231499.0, 450.0), (1000.0, 0.0)], "d double, k double")
    assert [r[0] for r in df.select(scalar.edge_slots(F.col("d"), F.col("k"), 1.0)).collect()] == [1, 1, 1, 1]
    assert [r[0] for r in df.select(scalar.edge_slots(F.col("d"), F.col("k"), 4.0)).collect()] == [1, 2, 2, 1]
    t = spark.createDataFrame([("a", 0, 95), ("a", 1, 100), ("b", 0, 3)], "flight_id string, seq int, time long")
    assert sorted((r["flight_id"], r["time"]) for r in graph.clamped(t, 96).collect()) == [("a", 91), ("a", 96), ("b", 3)]


def test_rotation():
    t = pd.Timestamp("2024-01-01")
    h = lambda x: t + pd.Timedelta(hours=x)
    rows = [("s", "0", "A", "B", h(0), 60.0, 60.0, 430), ("s", "1", "B", "A", h(2), 60.0, 30.0, 480), ("s", "2", "B", "A", h(2), 60.0, 30.0, 480), ("s", "3", "A", "B", h(3.4), 1.0, 1.0, 450)]
    out = fleet.rotate(pd.DataFrame(rows, columns=["scenario", "idx", "origin", "destination", "departure", "duration_min", "tat_min", "speed_kts"]))
    assert out["aircraft_id"].tolist() == ["AC000001", "AC000001", "AC000002", "AC000003"]
    assert out["speed_kts"].tolist() == [430, 430, 480, 450]


def test_overlap_repair():
    cols = ["flight_id", "aircraft_id", "start_slot", "first", "last"]
    f = pd.DataFrame([("a", "X", 0, 0, 10), ("b", "X", 5, 5, 12), ("c", "X", 90, 90, 96), ("d", "X", 95, 95, 99)], columns=cols)
    got = fleet.repair(f, 96).set_index("flight_id")
    assert got.loc["b", "shift"] == 6 and got.loc["c", "shift"] == 0
    assert got.loc["d", "new_aircraft_id"] == "X_0" and got.loc["d", "shift"] <= 0
    one = fleet.repair(f.iloc[:1], 96)
    assert one["shift"].tolist() == [0]


def test_rotation_and_repair_keep_their_promises(spark):
    got = catalogue.QUERIES["rotation"](spark, SF).toPandas()
    draws = catalogue.departures(spark, SF).toPandas()
    assert len(got) == len(draws)
    for _, g in got.sort_values("departure").groupby(["scenario", "aircraft_id"]):  # aircraft are numbered in each scenario
        for a, b in itertools.pairwise(g.itertuples()):
            assert a.destination == b.origin and a.departure < b.departure
    spans = catalogue.QUERIES["horizon_clamp"](spark, SF).groupBy("flight_id").agg(F.min("time").alias("a"), F.max("time").alias("z")).toPandas().set_index("flight_id")
    fixed = catalogue.QUERIES["overlap_repair"](spark, SF).toPandas()
    for _, g in fixed[fixed.new_aircraft_id == fixed.aircraft_id].groupby("aircraft_id"):
        s = sorted((spans.loc[r.flight_id, "a"] + r.shift, spans.loc[r.flight_id, "z"] + r.shift) for r in g.itertuples())
        assert all(x[1] < y[0] for x, y in itertools.pairwise(s))


def test_models(spark):
    rates = spark.createDataFrame([("A", b, float(b == 5)) for b in range(24)], "origin string, bin int, rate double")
    even = {r["bin"]: r["rate"] for r in model.smoothed(rates, 4).collect()}
    assert [b for b, v in even.items() if v > 0] == [4, 5, 6, 7]
    odd = spark.createDataFrame([("2024-01-01 23:59:00",)], "t string").select(scalar.time_bin(F.to_timestamp("t"), 37)).first()[0]
    assert odd == 37
    with pytest.raises(ValueError):
        model.same_day(rates, start="2024-01-01")
    with pytest.raises(ValueError):
        sampling.exact_events(rates.withColumn("rate", F.lit(0.0)), 5, "2024-01-01", 60, 1)
    got = sampling.exact_events(rates, 7, "2024-01-01", 60, 1)
    assert got.count() == 7


def test_draws_are_distributed_as_they_should_be(spark):
    u = spark.range(20000).select(scalar.uniform(1, "x", F.col("id")).alias("u"))
    n = u.select(scalar.poisson(F.lit(3.5), F.col("u")).alias("n")).agg(F.avg("n"), F.variance("n")).first()
    assert abs(n[0] - 3.5) < 0.1 and abs(n[1] - 3.5) < 0.2
    s = u.select(scalar.laplace(F.col("u"), 2.0).alias("x")).agg(F.avg("x"), F.variance("x")).first()
    assert abs(s[0]) < 0.1 and abs(s[1] - 8) < 0.6


def test_partitions_make_no_difference(spark):
    for name in ("poisson_counts", "first_appearance_ids", "rotation"):
        seen = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1], name


def test_destination_is_not_the_origin(spark):
    probs = spark.createDataFrame([("A", 0, "A", 0.5), ("A", 0, "B", 0.5)], "origin string, bin int, destination string, prob double")
    freq = spark.createDataFrame([("C", 1.0)], "destination string, freq double")
    rows = spark.createDataFrame([("A", 0, i) for i in range(200)] + [("Z", 3, 500)], "origin string, bin int, key int")
    got = sampling.destinations(rows, probs, freq, 1, "key").collect()
    assert {r["destination"] for r in got if r["origin"] == "A"} == {"B"} and {r["destination"] for r in got if r["origin"] == "Z"} == {"C"}
    assert {r["destination"] for r in sampling.destinations(rows, probs, freq, 1, "key", compat=True).collect()} == {"C"}


def test_readers(spark, tmp_path):
    head = ",".join(readers.FLIGHT_LIST)
    row = lambda o, d, a, b: f"x,1,ac,t,{o},{d},{a},{b},2024-01-01,,,,,,"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([head, row(" edDf ", "lfpg", "2024-01-01 10:00:00+00:00", "2024-01-01 11:00:00+00:00"), row("nan", "LFPG", "2024-01-01 10:00:00+00:00", "2024-01-01 11:00:00+00:00"), row("EDDF", "LFPG", "2024-01-01 23:00:00+00:00", "2024-01-02 01:00:00+00:00"), row("ED1", "LFPG", "bad", "bad")]))
    got = readers.flight_list(spark, str(tmp_path / "in"), day="2024-01-01")
    assert [(r["origin"], r["destination"]) for r in got.collect()] == [("EDDF", "LFPG")] and readers.parsed_times(got).count() == 1
    (tmp_path / "none").mkdir()
    assert readers.flight_list(spark, str(tmp_path / "none")).columns == list(readers.KEPT)
    (tmp_path / "ap.csv").write_text("ident,icao_code,gps_code,latitude_deg,longitude_deg\neddf,,XXXX,50,8.5\nEDDF,,,1,1\nK1,,,2,2\nLFPG,,,oops,2\n")
    assert [tuple(r) for r in readers.airports(spark, str(tmp_path / "ap.csv")).collect()] == [("EDDF", 50.0, 8.5)]
    assert {r[0] for r in readers.icao_set(spark, str(tmp_path / "ap.csv")).collect()} == {"EDDF", "LFPG", "XXXX"}
    assert readers.icao_set(spark, str(tmp_path / "nope.csv")).count() == 0
    (tmp_path / "fix.dat").write_text("I\n1101 Version\n\n 50.0  8.0 alpha ENRT\nx y z\n51.0 9.0 ALPHA\n52.0 9.5 BETA\n99\n53.0 9.0 GAMMA\n")
    assert [(r["id"], r["lat"]) for r in readers.fixes(spark, readers.navigation_file(spark, str(tmp_path), "fix")).orderBy("id").collect()] == [("ALPHA", 50.0), ("BETA", 52.0)]
    (tmp_path / "earth_nav.dat").write_text("I\n3 50.0 8.0 1 2 3 4 FFM ENRT name\n99 stop\n2 51.0 8.0 1 2\n4 1 1 1 1 1 1 XXX\n")
    assert {r["id"] for r in readers.aids(spark, readers.navigation_file(spark, str(tmp_path), "nav"), 7).collect()} == {"FFM", "2"}
    assert {r["id"] for r in readers.aids(spark, readers.navigation_file(spark, str(tmp_path), "nav")).collect()} == {"ENRT", "2"}
    (tmp_path / "od.csv").write_text("Origin,DESTINATION\neddf,lfpg\n")
    assert readers.od_pairs(spark, str(tmp_path / "od.csv")).count() == 1
    (tmp_path / "aircraft.csv").write_text("a,b\nAC1,450\n")
    assert readers.aircraft(spark, str(tmp_path)).first()["speed_kts"] == 450.0
    (tmp_path / "c.json").write_text(json.dumps({"bin-minutes": 15, "considered_geographic_regions": [{"region-name": "X", "polygon": [0, 0, 0, 1, 1, 1]}, {"polygon": [0, 0, 0, 1, 1, 1]}]}))
    cfg = readers.config(spark, str(tmp_path / "c.json"))
    assert cfg["bin_minutes"] == 15 and [n for n, _ in readers.regions(cfg)] == ["X", "REGION_1"]
    assert readers.include_list("eddf; LFPG,x\nEDDF") == ["EDDF", "LFPG"] and readers.include_list("x") is None
    good = tmp_path / "fl.csv"
    good.write_text("flight_id,aircraft_id,origin,destination,departure_time\nF1,A,EDDF,LFPG,2024-01-01T10:00:00+0000\n")
    assert readers.flights(spark, str(good)).count() == 1
    good.write_text("flight_id,aircraft_id,origin,destination,departure_time\nF1,A,EDDF,LFPG,10 o'clock\n")
    with pytest.raises(ValueError):
        readers.flights(spark, str(good))
    with pytest.raises(ValueError):
        readers.resolve(spark.range(1), {"nothing": ()})


def test_graph_files_round_trip(spark, tmp_path):
    v = points(spark, [(i, 50 + i, 10, 0) for i in range(3)]).withColumn("id", F.concat(F.lit("V"), F.col("id").cast("string")))
    e = spark.createDataFrame([("V0", "V1", 12.3456), ("V1", "V2", 7.0)], "u string, v string, d double")
    writers.graph_files(str(tmp_path), v, e)
    back, links = readers.graph_files(spark, str(tmp_path))
    assert back.count() == 3 and {(r["u"], r["v"], r["d"]) for r in links.collect()} == {("V0", "V1", 12.346), ("V1", "V2", 7.0)}
    with pytest.raises(ValueError):
        writers.graph_files(str(tmp_path / "x"), v.drop("alt"), e)


def test_solver_tables(spark):
    v = points(spark, [(i, 50, 10, 0) for i in range(4)]).withColumn("is_airport", (F.col("id") == 3).cast("int"))
    e = spark.createDataFrame([(2, 1, 5.0, 0), (1, 3, 6.0, 1)], "u long, v long, d double, ordinal long")
    f = spark.createDataFrame([("F1", "A1"), ("F2", "A1"), ("F9", "A2")], "flight_id string, aircraft_id string")
    filed = spark.createDataFrame([("F1", 2, 0), ("F1", 1, 3), ("F2", 3, 9)], "flight_id string, position long, time long")
    cap = v.select("id", F.lit(5).alias("capacity"))
    asg = v.select("id", (F.col("id") % 2).alias("sector"), "ordinal")
    t = writers.solver_tables(v, e, f, filed, spark.createDataFrame([("A1", 480)], "aircraft_id string, speed_kts int"), cap, asg)
    rows = lambda n: sorted(map(tuple, t[n].collect()))
    assert rows("_vertices") == [(0, 3), (1, 1), (2, 0), (3, 2)]
    assert rows("graph_edges") == [(0, 1, 5.0), (1, 2, 6.0)] and rows("airports") == [(2,)]
    assert rows("flights") == [(0, 0, 0), (0, 1, 3), (1, 2, 9)] and rows("airplanes") == [(0, 480)]
    assert len(rows("sectors")) == 4 and len(rows("navaid_sector_assignment")) == 4


def test_script_lines(spark):
    filed = spark.createDataFrame([("F1", "a", 4), ("F1", "a", 5), ("F1", "b", 8), ("F2", "x", 1)], "flight_id string, position string, time long")
    f = spark.createDataFrame([("F1", "A1"), ("F2", "A2")], "flight_id string, aircraft_id string")
    v = spark.createDataFrame([("A", 50.0, 8.0), ("B", 51.0, 9.0)], "id string, lat double, lon double")
    lines = [r["line"] for r in writers.scenario_lines(filed, f, spark.createDataFrame([("A1", 480)], "aircraft_id string, speed_kts int"), v, 900.0).orderBy("section", "t", "flight_id", "seq").collect()]
    assert lines[1:] == ["0:00:00.00>DEFWPT MY_A,50.000000,8.000000,FIX", "0:00:00.00>DEFWPT MY_B,51.000000,9.000000,FIX", "1:00:00.00>CRE F1 321 50.000000 8.000000 0 FL100 480", "1:00:00.00>ADDWPT F1 MY_A", "1:00:00.00>ADDWPT F1 MY_B", "1:00:00.00>F1 AT MY_B DO DEL F1"]
    assert (writers.slot_seconds(5), writers.slot_seconds(None, 4), writers.slot_seconds(manifest={"time_granularity": 60}), writers.slot_seconds()) == (5.0, 900.0, 60.0, 1.0)


def test_script_takes_its_trajectories_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    filed = spark.createDataFrame([("F1", "a", 0), ("F1", "b", 2)], "flight_id string, position string, time long").mapInPandas(counted, "flight_id string, position string, time long")
    f, a = spark.createDataFrame([("F1", "A1")], "flight_id string, aircraft_id string"), spark.createDataFrame([("A1", 480)], "aircraft_id string, speed_kts int")
    v = spark.createDataFrame([("a", 50.0, 10.0), ("b", 51.0, 10.0)], "id string, lat double, lon double")
    assert writers.scenario_lines(filed, f, a, v, 900.0).count() == 7
    assert seen.value == 2


def test_scenario_parameters(tmp_path):
    p = scenario.Parameters.of({"bin-minutes": 30, "seeds": "1;2"}, {"scales": [0.5, 1.0], "nx": None})
    assert p.bin_minutes == 30 and p.seeds == [1, 2] and p.scales == [0.5, 1.0] and p.nx == 5
    assert scenario.dataset_name(0.5, 3) == "DATA_S0p5_3" and scenario.dataset_name(-1.0, 0) == "DATA_Sm1p0_0"
    assert [scenario.flag(x) for x in ("yes", "0", True, None)] == [True, False, True, False]
    assert scenario.grid(p) == [(0.5, 1), (0.5, 2), (1.0, 1), (1.0, 2)]


def test_whole_scenario(spark, tmp_path):
    from skylattice.plans import standins

    legs = standins.legs(spark, SF).withColumns({c: F.concat(F.lit("AP"), F.col(c).cast("string")) for c in ("origin", "destination")})
    p = scenario.Parameters(scales=[0.2], seeds=[3], nx=3, ny=3, sector_size=3, granularity=4, start="2024-01-01", end="2024-01-30", bin_minutes=60)
    ports = spark.createDataFrame([(f"AP{i}", 50.0 + i, 8.0 + i) for i in range(5)], "icao string, lat double, lon double")
    out = scenario.run(spark, legs, ports, p, str(tmp_path / "out"), [("box", (49.0, 7.0, 56.0, 14.0))])
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert out == manifest["datasets"] == ["DATA_S0p2_3"]
    filed = spark.read.option("header", True).csv(str(tmp_path / "out/DATA_S0p2_3/filed_flights.csv"))
    assert filed.columns == ["Flight_ID", "Position", "Time"] and filed.count() > 0
    assert scenario.run(spark, legs, ports, p, str(tmp_path / "out"), [("box", (49.0, 7.0, 56.0, 14.0))]) == out  # what is there is kept
    assert os.path.isdir(tmp_path / "out/DATA_S0p2_3/flights.csv")


def test_scenario_is_made_again_when_asked_and_when_inputs_change(spark, tmp_path):
    from dataclasses import replace

    from skylattice.plans import standins

    legs = standins.legs(spark, SF).withColumns({c: F.concat(F.lit("AP"), F.col(c).cast("string")) for c in ("origin", "destination")}).limit(400)
    # one leg an aircraft: there is no turnaround to draw from
    legs = legs.withColumn("aircraft_uid", F.col("flight_id"))
    p = scenario.Parameters(scales=[1.0], seeds=[3], sector_size=3, granularity=4, start="2024-01-01", end="2024-01-30", bin_minutes=60, graph="gabriel", levels="100,200", min_separation_m=1000.0, exact_flights=12, solver=True, script=True, max_edge_m=900_000.0)
    ports = spark.createDataFrame([(f"AP{i}", 50.0 + i, 8.0 + i) for i in range(5)], "icao string, lat double, lon double")
    points = spark.createDataFrame([(f"P{i}", 49.0 + i * 37 % 60 / 10, 7.0 + i * 53 % 70 / 10, i) for i in range(40)], "id string, lat double, lon double, ordinal int")
    region = [[48.0, 6.0, 48.0, 15.0, 57.0, 15.0, 57.0, 6.0]]
    out, box = str(tmp_path / "out"), [("box", (49.0, 7.0, 56.0, 14.0))]
    stamp = lambda name: os.stat(f"{out}/{name}/parameters.txt").st_mtime_ns
    stages = ("model", "navgraph", "DATA_S1p0_3")
    assert scenario.run(spark, legs, ports, p, out, box, points, region) == ["DATA_S1p0_3"]
    flights = spark.read.option("header", True).csv(f"{out}/DATA_S1p0_3/flights.csv")
    assert flights.count() == 12
    vertices, edges = readers.graph_files(spark, f"{out}/navgraph")
    kinds = {r["alt"]: r["n"] for r in vertices.groupBy("alt").agg(F.count("*").alias("n")).collect()}
    assert kinds[0.0] == 5 and kinds[3048.0] == kinds[6096.0] > 5 and edges.count() > 40
    assert sorted(r["ordinal"] for r in vertices.collect()) == list(range(vertices.count()))
    bundle = next((tmp_path / "out/DATA_S1p0_3/solver").iterdir())
    assert {"flights.csv", "graph_edges.csv", "mappings", "transform_manifest.json"} <= {x.name for x in bundle.iterdir()}
    numbers = spark.read.json(f"{bundle}/mappings/id_maps/vertices")
    assert numbers.count() == vertices.count() and (tmp_path / "out/DATA_S1p0_3/scenario.scn").is_dir()
    assert spark.read.option("header", True).csv(f"{out}/navgraph/sector_connectivity.csv").count() > 0
    first = [stamp(s) for s in stages]
    scenario.run(spark, legs, ports, p, out, box, points, region)
    assert [stamp(s) for s in stages] == first
    scenario.run(spark, legs.filter("flight_id % 5 <> 0"), ports, replace(p, solver=False), out, box, points, region)
    assert all(a < b for a, b in zip(first, [stamp(s) for s in stages]))
    assert scenario.in_regions(ports, region).count() == 5
    with pytest.warns(UserWarning):
        assert scenario.in_regions(ports, [[0.0, 0.0, 0.0, 1.0, 1.0, 1.0]]).count() == 5


def test_a_stage_takes_the_place_of_the_old_one(spark, tmp_path):
    written, folder = [], str(tmp_path / "stage")

    def write(at):
        written.append(at)
        spark.range(len(written)).write.csv(f"{at}/rows")

    assert scenario.made(spark, folder, "a", False, write) and not scenario.made(spark, folder, "a", False, write)
    assert scenario.made(spark, folder, "a", True, write) and scenario.made(spark, folder, "b", False, write)
    assert spark.read.csv(f"{folder}/rows").count() == 3 and [x.name for x in tmp_path.iterdir()] == ["stage"]

    def broken(at):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        scenario.made(spark, folder, "c", False, broken)
    assert spark.read.csv(f"{folder}/rows").count() == 3


def test_counts_of_large_rates(spark):
    for rate in (3.0, 499.0, 501.0, 760.0, 1000.0, 50_000.0):
        term, total, want = (math.exp(-rate) if rate < 700 else 0.0), 0.0, {}
        us = (0.01, 0.3, 0.5, 0.9)
        log = -rate
        for k in range(int(rate + 12 * rate**0.5) + 30):
            total += math.exp(log)
            log += math.log(rate / (k + 1))
            for u in us:
                if u < total and u not in want:
                    want[u] = k
        got = spark.createDataFrame([(u,) for u in us], "u double").select("u", scalar.poisson(F.lit(rate), F.col("u")).alias("k")).collect()
        assert {r["u"]: r["k"] for r in got} == want, rate


def test_empty_pools(spark):
    rows = spark.createDataFrame([("k", "A", "B")], "key string, origin string, destination string")
    none = spark.createDataFrame([], "flight_id string, origin string, destination string, tat_min double")
    assert sampling.bootstrapped(rows, none, 1, "key", value="tat_min", default=0.0).first()["tat_min"] == 0.0
    with pytest.raises(ValueError):
        sampling.bootstrapped(rows, none, 1, "key", value="tat_min")


@pytest.mark.parametrize("values", [1, 7, 3000])
def test_draws_from_all_samples_by_rank(spark, values):
    """The sample of a rank, whether few values hold nearly all ranks or each has its own."""
    pool = [(i, "A", "B", float(i % values if i % 3 else 0)) for i in range(3000)]
    samples = spark.createDataFrame(pool, "flight_id long, origin string, destination string, duration_min double")
    rows = spark.range(2000).select(F.col("id").alias("key"), F.lit("A").alias("origin"), F.lit("B").alias("destination"))
    drawn = sampling.bootstrapped(rows, samples, 3, "key", min_samples=10_000)
    place = F.floor(sampling.uniform(3, "boot", F.col("key")) * len(pool))
    got = drawn.select(place.alias("at"), "duration_min").collect()
    order = sorted(p[3] for p in pool)
    assert len(got) == 2000 and all(order[r["at"]] == r["duration_min"] for r in got)


def test_small_rules(spark, tmp_path):
    v = points(spark, [(i, 50, 10, 0) for i in range(5)]).withColumn("is_airport", (F.col("id") == 3).cast("int"))
    named = v.withColumn("id", F.concat(F.lit("V"), F.col("id").cast("string")))
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(writers.airport_vertices(named)) == ["V3"]
    assert ids(writers.airport_vertices(named, spark.createDataFrame([(" v1",), ("V9",)], "code string"))) == ["V1"]
    assert ids(writers.airport_vertices(named, spark.createDataFrame([("2",), ("4",)], "code string"))) == ["V2", "V4"]
    assert ids(writers.airport_vertices(named.withColumn("is_airport", F.lit(0)))) == []
    groups = {r["id"]: r["sector"] for r in graph.chunks(v, 2).collect()}
    assert groups == {i: f"SECTOR_{i // 2 + 1:06d}" for i in range(5)}
    assert geo.base_altitude(geo.levels("100,200")) == 4572.0
    assert readers.regions({}, "poly{}", "world") == [("world", [])] and readers.regions({"considered_geographic_regions": [{"polygon": [1]}]}, "poly{}")[0][0] == "poly0"
    flagged = spark.createDataFrame([("EDDF", True, True), ("LFPG", False, True), ("LFPG", None, False), ("x1", None, False)], "id string, listed boolean, some boolean")
    assert [r[0] for r in flagged.select(scalar.airport_flag(F.col("id"), F.col("listed"), F.col("some"))).collect()] == [True, False, True, False]
    (tmp_path / "a.csv").write_text("Navaid_ID,Sector_ID\n1,2\nx,3\n4.0,5\n")
    assert sorted(map(tuple, readers.assignment(spark, str(tmp_path / "a.csv")).collect())) == [(1, 2), (4, 5)]
    (tmp_path / "e.csv").write_text("source,target,dist_m\n1,2,3.5\n1,x,3\n")
    assert [tuple(r) for r in readers.integer_edges(spark, str(tmp_path / "e.csv")).collect()] == [(1, 2, 3.5)]
    (tmp_path / "again.csv").write_text("v0,v1,dist\n1,2,3.5\n4,3,9\n2,1,7\n3,4,8.0\n5,5,1\n")
    assert sorted(map(tuple, readers.integer_edges(spark, str(tmp_path / "again.csv")).collect())) == [(1, 2, 7.0), (3, 4, 8.0)]
    (tmp_path / "list.txt").write_text("eddf lfpg")
    assert readers.include_list(str(tmp_path / "list.txt"), spark) == ["EDDF", "LFPG"]


def test_stream_equals_batch(spark):
    from skylattice.streaming import rates

    got = sorted(map(str, rates.hourly(spark, SF).collect()))
    batch = rates.windowed(spark.read.parquet(f"{SF}/events.parquet")).withColumn("start", F.col("start").cast("timestamp_ntz"))
    assert got == sorted(map(str, batch.collect()))


@pytest.fixture(scope="module")
def given():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def all_queries():
    import __spark_entry__

    found = __spark_entry__.queries()
    return {k: (found[k], sql) for k, sql in (catalogue.ORACLES | __spark_entry__.JOB_ORACLES).items()}


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_matches_its_sql(spark, given, name):
    plain = lambda v: "None" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    query, sql = all_queries()[name]
    got, want = query(spark, SF), given.execute(sql)
    names = [c[0] for c in want.description]
    cols = sorted(names)
    assert sorted(got.columns) == cols
    a = sorted(tuple(map(plain, r)) for r in got.select(*cols).collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall())
    assert a == b


def test_entry_point_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """A file read in many blocks has the numbers of its lines, with either line end; files are numbered by themselves."""
    lines = [f"{i} {'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_bytes("\r\n".join(lines[:500]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5 or rows.count() == 3500
        got = sorted((r["file"][-5:], r["n"], r["line"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == sorted([("a.txt", i, x) for i, x in enumerate(lines)] + [("b.txt", i, x) for i, x in enumerate(lines[:500])])


def test_bad_flight_lines_are_named(spark, tmp_path):
    f = tmp_path / "fl.csv"
    f.write_text("id,Aircraft-ID,from,to,departure\nF1,A,EDDF,LFPG,2024-01-01T10:00:00+0000\n\nF2,A,EDDF,LFPG,ten\nF3,A,EDDF\nF4,A,EDDF,LFPG,2024-13-01T10:00:00+0000\n")
    good, bad = readers.checked_flights(spark, str(f))
    assert [r["flight_id"] for r in good.collect()] == ["F1"]
    assert sorted((r["line_number"], r["flight_id"], r["reason"]) for r in bad.collect()) == [(4, "F2", "junk"), (5, "F3", "fields"), (6, "F4", "time")]
    with pytest.raises(ValueError, match="fl.csv line 4"):
        readers.flights(spark, str(f))


def test_exact_quantiles(spark):
    r = random.Random(4)
    for values in ([1.5], [2.0, 1.0], [r.gauss(0, 1e6) for _ in range(5000)], [float(r.randrange(7)) for _ in range(3000)], [1e-300, 1e300, 5.0, -1e300], [3.0] * 20 + [4.0]):
        shares = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
        got = model.quantiles(spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double"), "x", shares, bins=8, few=3)
        assert got == pytest.approx([float(q) for q in np.quantile(values, shares)], rel=1e-12)
    assert model.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_streamed_turnarounds_go_on_over_runs(spark, tmp_path):
    """State goes over from run to run; what comes late gets nothing and takes nobody's place."""
    import glob as g

    from skylattice.plans import standins
    from skylattice.streaming import turnarounds

    events = spark.read.parquet(f"{SF}/events.parquet")
    middle = events.selectExpr("percentile_approx(ts, 0.5)").first()[0]
    late = events.orderBy("ts").limit(1)
    parts = [events.filter(F.col("ts") < middle).join(late.select("event_id"), "event_id", "left_anti"), events.filter(F.col("ts") >= middle), late]
    (tmp_path / "in").mkdir()
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        os.link(g.glob(str(tmp_path / f"p{k}/*.parquet"))[0], tmp_path / "in" / f"{k}.parquet")
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        rows = turnarounds.run(spark, standins.legs_of(source), str(tmp_path / "state"))
    want = model.turnarounds(standins.legs_of(parts[0].unionByName(parts[1])))
    assert sorted((r["flight_id"], r["tat_min"]) for r in rows.collect()) == [(i, pytest.approx(t)) for i, t in sorted((r["flight_id"], r["tat_min"]) for r in want.collect())]


def test_regions_in_cells(spark):
    """The cell join is the literal expression, on corners, sides, regions over many cells and beside them."""
    r = random.Random(8)
    shapes = [[r.uniform(-60, 60) if k % 2 == 0 else r.uniform(-170, 170) for k in range(2 * r.randint(3, 7))] for _ in range(12)] + [[0.0, 0.0, 0.0, 10.0, 10.0, 10.0, 10.0, 0.0]]
    at = [(r.uniform(-65, 65), r.uniform(-180, 180)) for _ in range(150)] + [(0.0, 5.0), (10.0, 5.0), (5.0, 0.0), (5.0, 10.0), (0.0, 0.0), (10.0, 10.0), (90.0, 180.0)]
    df = points(spark, [(i, a, b, 0) for i, (a, b) in enumerate(at)])
    regions = spark.createDataFrame([(k, k % 2, s[::2], s[1::2]) for k, s in enumerate(shapes)] + [(99, 5, [80.0, 80.0, 81.0], [0.0, 1.0, 0.0]), (98, 6, [1.0, 2.0], [1.0, 2.0])], "region long, scenario long, lats array<double>, lons array<double>")
    want = {(row["id"], k) for k, s in enumerate(shapes) for row in df.filter(geo.in_polygon(F.col("lat"), F.col("lon"), s)).collect()}
    assert {(x["id"], x["region"]) for x in spatial.in_region_table(df, regions, step=7.0).collect()} == want
    kept = {}
    for x in spatial.kept_in_regions(df, regions).collect():
        kept.setdefault(x["scenario"], set()).add(x["id"])
    everywhere = set(range(len(at)))
    assert kept == {0: {i for i, k in want if k % 2 == 0}, 1: {i for i, k in want if k % 2}, 5: everywhere, 6: everywhere}


@pytest.mark.parametrize("width", [None, 2])
def test_costs_in_buckets_of_any_width(spark, width):
    r = random.Random(7)
    e = {(a, b): r.randint(1, 5) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(45)) if a < b}
    both = [(x, y, w) for (a, b), w in e.items() for x, y in ((a, b), (b, a))]
    tree = graph.shortest_costs(spark.createDataFrame(both, "u long, v long, w int"), spark.createDataFrame([(s,) for s in range(13)], "src long"), width)
    far = {(s, s): 0 for s in range(13)}
    for _ in range(13):
        for (s, x, d) in [(s, x, d) for (s, x), d in far.items()]:
            for a, b, w in both:
                if a == x and d + w < far.get((s, b), 1e9):
                    far[s, b] = d + w
    assert {(x["src"], x["node"]): x["dist"] for x in tree.collect()} == far
    assert graph.shortest_costs(spark.createDataFrame([], "u long, v long, w int"), spark.createDataFrame([(3,)], "src long")).count() == 1


def test_costs_from_all_nodes_by_tiles(spark):
    """A path, a random graph apart from it, in tiles of 7 nodes; and no arc at all."""
    r = random.Random(9)
    e = {(f"p{i:02d}", f"p{i + 1:02d}"): r.randint(1, 9) for i in range(4)} | {(f"r{a:02d}", f"r{b:02d}"): r.randint(1, 9) for a, b in ((r.randrange(12), r.randrange(12)) for _ in range(30)) if a != b}
    both = [(a, b, w) for (a, b), w in e.items()] + [(b, a, w) for (a, b), w in e.items()]
    arcs = spark.createDataFrame(both, "u string, v string, w long")
    far = {(a, a): 0 for a, _, _ in both}
    for _ in range(25):
        for s in {a for a, _, _ in both}:
            for a, b, w in both:
                if (s, a) in far and far[s, a] + w < far.get((s, b), 1e9):
                    far[s, b] = far[s, a] + w
    assert {(x["src"], x["node"]): x["dist"] for x in graph.all_costs(arcs, tile=7).collect()} == far
    assert graph.all_costs(arcs.limit(0)).count() == 0


def test_costs_end_with_the_wanted_nodes(spark):
    """Routes are the same when sources stop at their wanted nodes, which on a long path leaves most of it alone."""
    arcs = spark.createDataFrame([(a, b, 1 + min(a, b) % 2) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))] + [(0, 2, 3), (2, 0, 3)], "u long, v long, w long")
    wanted = spark.createDataFrame([(1, 0, 3), (2, 0, 3), (3, 9, 9), (5, 9, 99)], "flight_id long, src long, dst long")
    ends = wanted.select("src", F.col("dst").alias("node")).filter("node < 99")
    some, every = (graph.shortest_costs(arcs, wanted.select("src"), width, wanted=x) for width, x in ((1, ends), (None, None)))
    flown = lambda tree: sorted(map(tuple, graph.routes(tree, wanted).collect()))
    assert flown(some) == flown(every) and [x[2] for x in flown(some) if x[0] == 1] == [0, 2, 3]  # of equal costs by the smallest node before
    assert some.count() < every.count() == 20


def test_bridges_are_minimum_trees(spark):
    """Far and near groups, equal distances, names that are text."""
    r = random.Random(3)
    at = {f"p{i}": (r.uniform(-30, 30), r.uniform(-30, 30)) for i in range(9)} | {f"q{i}": (50.0, float(i)) for i in range(4)} | {"far": (-60.0, 170.0)}
    v = spark.createDataFrame([(k, *x, 0.0, 0, i) for i, (k, x) in enumerate(at.items())], "id string, lat double, lon double, alt double, is_airport int, ordinal long")
    e = spark.createDataFrame([("p0", "p1", 1.0), ("p1", "p2", 1.0), ("q0", "q1", 1.0)], "u string, v string, d double")
    links = sorted((haversine(at[a], at[b]), a, b) for a, b in itertools.combinations(sorted(at), 2))
    group = {k: k for k in at} | {"p1": "p0", "p2": "p0", "q1": "q0"}
    want = 0.0
    for d, a, b in links:  # the length of a minimum tree
        if group[a] != group[b]:
            want += d
            old = group[b]
            group = {k: group[a] if g == old else g for k, g in group.items()}
    got = graph.bridges(v, e, "closest").collect()
    assert len(got) == len(at) - 4 and sum(x["d"] for x in got) == pytest.approx(want)
    for method in ("mst", "greedy"):
        b = graph.bridges(v, e, method, k=1)
        assert b.count() == len(at) - 4
        assert graph.components(v, e.unionByName(b)).select("component").distinct().count() == 1


def test_numbers_of_vertices_without_their_pairs(spark, monkeypatch):
    at = [(i, 50 + (i * 37 % 101) / 40, 10 + (i * 53 % 97) / 30, 100.0 * (i % 3)) for i in range(1, 160)] + [(500, -50.0, 0.0, 0.0)]
    v = points(spark, at)
    for metres in (3_000.0, 25_000.0, 400_000.0):
        e = spatial.radius_pairs(v, metres).withColumn("ordinal", F.col("u") * 1_000_000 + F.col("v"))
        want = {tuple(r) for r in writers.vertex_numbers(e, v).collect()}
        monkeypatch.setattr(spatial, "radius_pairs", None)  # not needed any more
        assert {tuple(r) for r in writers.radius_vertex_numbers(v, metres).collect()} == want
        monkeypatch.undo()
    assert spatial.first_neighbours(v.limit(0), 1000.0).count() == 0


def test_flights_and_vertices_need_no_pairs(spark, monkeypatch):
    from skylattice.plans import round_trips

    monkeypatch.setattr(spatial, "radius_pairs", lambda *a, **k: pytest.fail("makes all pairs"))
    for f in (round_trips.airport_vertex_numbers, round_trips.solver_assignment):
        assert f(spark, "/root/testdata/sf0.001").count() > 0


def test_open_pairs_need_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    at = [(50 + rng.random(), 10 + rng.random() * 1.5) for _ in range(250)] + [(50.5, 10.5)] * 2 + [(51.3, 10 + i / 40) for i in range(30)] + [(-89.9, 20.0 * i) for i in range(9)]
    v = points(spark, [(i, a, b, 900.0) for i, (a, b) in enumerate(at)])
    pairs = spatial.radius_pairs(v, 45_000.0)
    rows = lambda df: {(r["u"], r["v"]) for r in df.select("u", "v").collect()}
    want = rows(spatial.gabriel(pairs)), rows(spatial.relative_neighbours(pairs))
    uneven = points(spark, [(i, 50 + i % 7 / 50, 10 + i % 5 / 50, 3000.0 * (i % 3)) for i in range(30)])
    assert rows(spatial.open_pairs(uneven, 45_000.0)) == rows(spatial.gabriel(spatial.radius_pairs(uneven, 45_000.0)))
    monkeypatch.setattr(spatial, "radius_pairs", lambda *a, **k: pytest.fail("makes all pairs"))
    assert (rows(spatial.open_pairs(v, 45_000.0)), rows(spatial.open_pairs(v, 45_000.0, relative=True))) == want
    assert spatial.open_pairs(v.limit(0), 1000.0).count() == 0


def test_regions_are_counted_where_points_meet_them(spark):
    v = points(spark, [(1, 50.0, 10.0, 0), (2, 58.0, 10.0, 0)])
    regions = spark.createDataFrame([(7, 1, [49.0, 51.0, 51.0, 49.0], [9.0, 9.0, 11.0, 11.0])], "region long, scenario long, lats array<double>, lons array<double>")
    found = spatial.in_region_table(v, regions)
    assert [tuple(r) for r in found.collect()] == [(1, 7)] and "hashpartitioning(id" not in plan_of(found)


def test_edges_in_files_that_follow_each_other(spark, tmp_path):
    """The last line wins over all files, and edges are written by more than one task."""
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 2000).alias("From"), F.lit(5000).alias("To"), F.col("id").alias("dist"))
    rows.write.option("header", True).csv(str(tmp_path / "e"))
    assert {r["d"] - r["u"] for r in readers.integer_edges(spark, str(tmp_path / "e")).collect()} == {2000.0}
    v = points(spark, [(i, 50, 10 + i / 1000, 0) for i in range(80)])
    e = spark.createDataFrame([(i, i + 1, 2.0, i, i + 1) for i in range(79)], "u long, v long, d double, ordinal_u long, ordinal_v long")
    assert "Join" not in plan_of(writers.edge_lines(e, v))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    writers.graph_files(str(tmp_path / "g"), v, e)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(str(tmp_path / "g/edges.csv/*.csv"))) > 1


def test_open_pairs_move_no_pair_of_points(spark):
    r = random.Random(3)
    p = spark.createDataFrame([(i, 45 + r.random(), 5 + r.random(), 0.0) for i in range(60)], "id long, lat double, lon double, alt double")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spatial.open_pairs(p, 60_000.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    last = plan[plan.index("ObjectHashAggregate") :]
    assert "Join" in last and "Exchange" not in last[: last.index("Join")]


def test_points_without_a_near_one(spark):
    import random

    r = random.Random(11)
    rows = [(i, 50 + r.random(), 10 + r.random() * 2, r.choice([0.0, 9144.0])) for i in range(500)]
    rows += [(1000 + i, 60 + i * 0.5, 179.99, 0.0) for i in range(4)] + [(1100, 60.0, -179.99, 0.0), (1101, 89.99, 0.0, 0.0), (1102, 89.99, 180.0, 0.0), (1103, None, 5.0, 0.0), (1104, 10.0, 10.0, 0.0), (1104, 10.0, 10.0, 0.0)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, alt double")
    pairs = {(p["u"], p["v"]) for metres in (8_000.0,) for p in spatial.radius_pairs(points, metres).filter(F.col("d") < metres).select("u", "v").collect()}
    ends = {x for p in pairs for x in p}
    got = sorted(x["id"] for x in spatial.alone(points, 8_000.0).collect())
    assert got == sorted(i for i, *_ in rows if i not in ends) and {1103, 1104} <= set(got) and not {1000, 1100, 1101} & set(got) and 20 < len(got) < 400


def test_isolated_points_make_no_pairs(spark, monkeypatch):
    from skylattice.plans import catalogue, round_trips

    monkeypatch.setattr(spatial, "radius_pairs", lambda *_, **__: pytest.fail("all pairs were asked for"))
    monkeypatch.setattr(catalogue.S, "navpoints", lambda *_: spark.createDataFrame([(1, 50.0, 10.0, 0.0), (2, 50.1, 10.0, 0.0), (3, 51.0, 10.0, 0.0)], "id long, lat double, lon double, alt double"))
    assert [x["id"] for x in round_trips.isolated_vertices(spark, "").collect()] == [3]


def test_regions_of_few_sides_are_compiled(spark, monkeypatch):
    r = random.Random(21)
    at = spark.createDataFrame([(i, r.uniform(40, 50), r.uniform(0, 10)) for i in range(300)], "id long, lat double, lon double")
    rows = [(k, [r.uniform(39, 51) for _ in range(n)], [r.uniform(-1, 11) for _ in range(n)]) for k, n in enumerate((3, 4, 7, 24, 2, 0, 5, 5))]
    regions = spark.createDataFrame([*rows, (7, [44.0, 44.0, 46.0], [2.0, 5.0, 5.0])], "region long, lats array<double>, lons array<double>")  # one of two parts
    few = spatial.in_region_table(at, regions.filter("region <> 3"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(_sides" not in plan(few)
    every = sorted(map(tuple, spatial.in_region_table(at, regions).collect()))
    monkeypatch.setattr(spatial, "UNROLLED", 0)
    assert "filter(_sides" in plan(spatial.in_region_table(at, regions))
    assert every == sorted(map(tuple, spatial.in_region_table(at, regions).collect())) and len(every) > 100
    assert sorted(map(tuple, few.collect())) == [x for x in every if x[1] != 3]


def test_nets_are_arrays_and_come_in_parts(spark):
    r = random.Random(31)
    links = sorted({tuple(sorted(r.sample(range(90), 2))) for _ in range(200)})
    u, v = np.array(links).T
    d = np.array([r.random() for _ in links])
    net = sectors.Net(90, u, v, d)
    both = sorted([(a, b, w) for (a, b), w in zip(links, d)] + [(b, a, w) for (a, b), w in zip(links, d)])
    a, b, w = (np.array(x) for x in zip(*both))
    places = np.arange(90) * 3 + 7  # some of all places
    part = sectors.Net.of(places, np.searchsorted(a, np.arange(91)), [places[b[i : i + 11]] for i in range(0, len(b), 11)], [w[i : i + 11] for i in range(0, len(b), 11)])
    assert (net.first, net.to, net.metres) == (part.first, part.to, part.metres)
    assert net.to.itemsize + net.metres.itemsize <= 12  # bytes a link and direction
    vertices = points(spark, [(i, 50, 10, 0) for i in range(200, 290)])
    edges = spark.createDataFrame([(200 + x, 200 + y, float(z)) for (x, y), z in zip(links, d) if (x < 40) == (y < 40)], "u long, v long, d double")
    want = sorted(map(tuple, sectors.sectors(vertices, edges, 6, convex=True).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, sectors.sectors(vertices, edges, 6, convex=True).collect())) == want and len(want) == 90 and len({x[1] for x in want}) > 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
