"""Spatial joins and navigation graphs over points (id, lat, lon, alt).

Radius joins are equi-joins on cells: bands of latitude of the radius' height, cut into cells as wide as the radius at the band's
widest latitude. A point is looked for in every cell that its circle touches, across the date line and around the poles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import EARTH, haversine, slant


def _cells(band: Column, height: float) -> Column:
    """Number of cells in a band; one at the poles."""
    low = F.abs(band * height - 90.0)
    widest = F.least(F.greatest(low, F.abs((band + 1) * height - 90.0)), F.lit(90.0))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(widest)) / height)).cast("int")


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height).cast("int")


def _at_home(df: DataFrame, s: str, height: float) -> DataFrame:
    """The rows with the cell of their point."""
    df = df.withColumn("_band", _band(F.col(f"lat{s}"), height))
    df = df.withColumn("_cell", F.floor(F.pmod(F.col(f"lon{s}") + 180.0, F.lit(360.0)) / 360.0 * _cells(F.col("_band"), height)).cast("int"))
    return df.withColumn("_cell", F.least(F.col("_cell"), _cells(F.col("_band"), height) - 1))


def _in_reach(df: DataFrame, s: str, height: float, turn: float) -> DataFrame:
    """The rows once for each cell that their point's circle touches."""
    df = df.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda x: _band(F.col(f"lat{s}"), height) + x)))
    n = _cells(F.col("_band"), height)
    # half the width of the circle in degrees of longitude; everything where it holds a pole
    ratio = F.sin(F.lit(turn)) / F.cos(F.radians(f"lat{s}"))
    reach = F.when((F.abs(f"lat{s}") + height >= 90.0) | (ratio >= 1) | F.lit(turn > 1.5), 180.0).otherwise(F.degrees(F.asin(ratio)) * (1 + 1e-9))
    first = F.floor((F.col(f"lon{s}") - reach + 180.0) / 360.0 * n)
    last = F.floor((F.col(f"lon{s}") + reach + 180.0) / 360.0 * n)
    touched = F.when(last - first + 1 >= n, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(first, last), lambda x: F.pmod(x, n).cast("int")))
    return df.withColumn("_cell", F.explode(touched))


def _turn(metres: float) -> tuple[float, float]:
    """A radius as an angle, and the height of its bands in degrees."""
    turn = min(metres / EARTH, math.pi)
    return turn, max(math.degrees(turn), 1e-9) * (1 + 1e-9)


def _beside(points: DataFrame, few: DataFrame, metres: float) -> DataFrame:
    """The points in cells that the circles of a few others touch: all within `metres` of those, and some beyond."""
    turn, height = _turn(metres)
    cells = _in_reach(few.select("lat", "lon"), "", height, turn).select("_band", "_cell").distinct()
    return _at_home(points, "", height).join(cells, ["_band", "_cell"], "left_semi").select(points.columns)


def _met(left: DataFrame, right: DataFrame, metres: float, apart: str | None, on: tuple[str, ...], ordered: bool = False, cells: bool = False) -> DataFrame:
    """All pairs not farther apart than `metres` by haversine, and some beyond: what meets in cells within the chord of the radius.
    ordered: only pairs with id_a < id_b. cells: with _band and _cell, the cell of the right point; all pairs of a right point are in one
    task, so a grouping by these and id_b moves no pair. The sides are dealt by cells and neither is ever sent whole to the driver or the
    tasks, as the left one has a row for each cell in reach, which the estimates of its size leave out."""
    turn, height = _turn(metres)
    a = _in_reach(left.select(*[F.col(c).alias(f"{c}_a") for c in left.columns]), "_a", height, turn)
    b = _at_home(right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns]), "_b", height)
    for c in on:
        a, b = a.withColumnRenamed(f"{c}_a", c), b.withColumnRenamed(f"{c}_b", c)
    cell = ["_band", "_cell", *on]
    if apart:
        kinds = lambda df, s: df.groupBy(*cell).agg(F.min(f"{apart}{s}").alias("_lo"), F.max(f"{apart}{s}").alias("_hi"))
        other = lambda s: (F.col("_lo") != F.col(f"{apart}{s}")) | (F.col("_hi") != F.col(f"{apart}{s}"))
        a = a.join(kinds(b, "_b"), cell).filter(other("_a")).drop("_lo", "_hi")
        b = b.join(kinds(a, "_a"), cell).filter(other("_b")).drop("_lo", "_hi")
    n_parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b, close = a.repartition(n_parts, *cell), b.repartition(n_parts, *cell), None
    if turn < 1:  # half the earth is no chord to measure by
        a, b = (df.withColumns({f"_x{s}": F.cos(F.radians(f"lat{s}")) * F.cos(F.radians(f"lon{s}")), f"_y{s}": F.cos(F.radians(f"lat{s}")) * F.sin(F.radians(f"lon{s}")), f"_z{s}": F.sin(F.radians(f"lat{s}"))}) for df, s in ((a, "_a"), (b, "_b")))
        apart_by = lambda c: (F.col(f"_{c}_a") - F.col(f"_{c}_b")) * (F.col(f"_{c}_a") - F.col(f"_{c}_b"))
        close = apart_by("x") + apart_by("y") + apart_by("z") <= (2 * math.sin(turn / 2) * (1 + 1e-9) + 1e-12) ** 2
    out = a.join(b.hint("shuffle_hash"), cell)
    out = out if cells else out.drop("_band", "_cell")
    out = out.filter("id_a < id_b") if ordered else out
    out = out.filter(F.col(f"{apart}_a") != F.col(f"{apart}_b")) if apart else out
    return out if close is None else out.filter(close).drop(*(f"_{c}{s}" for c in "xyz" for s in ("_a", "_b")))


def near(left: DataFrame, right: DataFrame, metres: float, apart: str | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (left columns with suffix _a, right ones with _b, metres d by haversine) not farther apart than `metres`. apart: a
    column whose values must differ; cells without such a pair are left out before points meet. on: columns that must be equal."""
    d = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return _met(left, right, metres, apart, on).withColumn("d", d).filter(F.col("d") <= metres)


def between(a: str = "_a", b: str = "_b") -> Column:
    """Distance with altitudes of a pair's two points."""
    return slant(*[F.col(f"{c}{a}") for c in ("lat", "lon", "alt")], *[F.col(f"{c}{b}") for c in ("lat", "lon", "alt")])


def radius_pairs(points: DataFrame, metres: float, carry: tuple[str, ...] = (), on: tuple[str, ...] = (), apart: str | None = None) -> DataFrame:
    """u < v, d: pairs not farther apart than `metres`, altitudes counted. carry: columns of the points that come along as <name>_u and
    <name>_v, so that what is known of a point needs no join with the pairs. on, apart: columns that must be equal, or differ."""
    p = points.select("id", "lat", "lon", "alt", *carry, *on, *([apart] if apart and apart not in carry else []))
    out = _met(p, p, metres * (1 + 1e-6), apart, on, ordered=True).withColumn("d", between()).filter(F.col("d") <= metres)
    return out.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), "d", *(F.col(f"{c}{s}").alias(f"{c}{e}") for c in carry for s, e in (("_a", "_u"), ("_b", "_v"))))


def first_neighbours(points: DataFrame, metres: float) -> DataFrame:
    """points (id, lat, lon, alt) -> id, first: the smallest id of another point not farther away than `metres`, altitudes counted, where
    there is one. Points look among the smallest ids first, so many that about eight are in reach, then those that found none among the
    next ones, twice as many, and so on: few of all pairs are made."""
    from skylattice.operators.graph import first_appearance
    from skylattice.session import cut

    p = points.select("id", "lat", "lon", "alt")
    place = first_appearance(p.select(F.col("id").alias("name")), "name", F.col("name")).select(F.col("name").alias("id"), F.col("id").alias("_place"))
    p = cut(p.join(place, "id"))
    side = metres / 111_000.0  # about the degrees of the radius; it decides how rounds are cut and no result
    n, held = p.count(), p.groupBy(F.floor(F.col("lat") / side), F.floor(F.col("lon") / side)).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 1.0
    low, size, rest, out = 0, max(1000, int(8 * n / (3 * held))), p.drop("_place"), []
    while low < n and not rest.isEmpty():
        some = p.filter((F.col("_place") >= low) & (F.col("_place") < low + size)).drop("_place")
        met = _met(rest, some, metres * (1 + 1e-6), None, ()).filter("id_a <> id_b").filter(between() <= metres)
        found = cut(met.groupBy(F.col("id_a").alias("id")).agg(F.min("id_b").alias("first")))
        out.append(found)
        rest, low, size = cut(rest.join(found, "id", "left_anti")), low + size, 2 * size
    every = p.select("id", F.col("id").alias("first")).limit(0) if not out else out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def alone(points: DataFrame, metres: float) -> DataFrame:
    """points (id, lat, lon, alt) -> id: those without another point nearer than `metres`, altitudes counted. Points look for one within
    a radius that holds a few others, those without any twice as far, and so on, so pairs are made of near points only."""
    from skylattice.session import cut

    p = cut(points.select("id", "lat", "lon", "alt"))
    side = metres / 111_000.0  # where rounds begin; it decides no result
    held = p.groupBy(F.floor(F.col("lat") / side), F.floor(F.col("lon") / side)).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 1.0
    r, rest, first = metres * min(1.0, math.sqrt(2 / held)), p, True
    while True:
        wide = r * (1 + 1e-6)
        met = _met(rest, p if first else _beside(p, rest, wide), wide, None, ()).filter("id_a <> id_b").filter(between() < metres)
        rest, first = cut(rest.join(met.select(F.col("id_a").alias("id")).distinct(), "id", "left_anti")), False
        if r >= metres or rest.isEmpty():
            return rest.select("id")
        r = min(2 * r, metres)


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v", "d").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))


def _without(pairs: DataFrame, blocked) -> DataFrame:
    """Pairs that no third neighbour of both blocks. blocked: of the distances (d, x.d, y.d), x and y shorter than d."""
    s = symmetric(pairs)
    x = s.select(F.col("u"), F.col("v").alias("c"), F.col("d").alias("dx"))
    y = s.select(F.col("u").alias("v"), F.col("v").alias("c"), F.col("d").alias("dy"))
    seen = pairs.join(x, "u").filter("dx < d").join(y, ["v", "c"]).filter("dy < d").filter(blocked(F.col("d"), F.col("dx"), F.col("dy")))
    return pairs.join(seen.select("u", "v").distinct(), ["u", "v"], "left_anti").select("u", "v", "d")


def gabriel(pairs: DataFrame) -> DataFrame:
    """Pairs whose circle holds no third point."""
    return _without(pairs, lambda d, x, y: x * x + y * y < d * d)


def relative_neighbours(pairs: DataFrame, compat: bool = False) -> DataFrame:
    """Pairs with no third point nearer to both. compat: all pairs, as if there were no rule."""
    return pairs if compat else _without(pairs, lambda d, x, y: F.greatest(x, y) < d)


def _bearing() -> Column:
    """The direction from a pair's right point to its left one."""
    a, b, turn = F.radians("lat_b"), F.radians("lat_a"), F.radians(F.col("lon_a") - F.col("lon_b"))
    return F.atan2(F.sin(turn) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn))


def _reaches(p: DataFrame, metres: float) -> list[tuple[float, DataFrame]]:
    """Radii with the points (id, lat, lon, alt, reach) that have no open link (with an empty circle on it) beyond their reach, which is
    within the radius. A nearer point whose direction is within 45 degrees lies in the circle of any link over sqrt(2) times as long, so
    a point is done when each of eight cones around it holds a point; the others look twice as far, up to `metres`."""
    from skylattice.session import cut

    side = metres / 111_000.0  # where rounds begin; it decides no result
    held = p.groupBy(F.floor(F.col("lat") / side), F.floor(F.col("lon") / side)).agg(F.count("*").alias("n")).agg(F.avg("n")).first()[0] or 1.0
    r, rest, out = metres * min(1.0, math.sqrt(8 / held)), p, []
    while True:
        wide = r * (1 + 1e-6)
        met = _met(_beside(p, rest, wide) if out else p, rest, wide, None, (), cells=True).filter("id_a <> id_b").withColumn("d", between("_b", "_a")).filter((F.col("d") <= r) & (F.col("d") > 0.001))
        cone = F.pmod(F.floor(_bearing() / (math.pi / 4)), F.lit(8))
        nearest_in = [F.min(F.when(cone == k, F.col("d"))).alias(f"_c{k}") for k in range(8)]
        full = met.groupBy("_band", "_cell", F.col("id_b").alias("id")).agg(*nearest_in).dropna()
        found = cut(full.select("id", F.least(1.5 * F.greatest(*[f"_c{k}" for k in range(8)]), F.lit(metres)).alias("reach")))
        out.append((min(1.5 * r, metres), rest.join(found, "id")))
        rest = cut(rest.join(found, "id", "left_anti"))
        if r >= metres or rest.isEmpty():
            return [*out, (metres, rest.withColumn("reach", F.lit(float(metres))))]
        r = min(2 * r, metres)


def open_pairs(points: DataFrame, metres: float, relative: bool = False) -> DataFrame:
    """gabriel() of radius_pairs(points, metres), or relative_neighbours() of it, without making all pairs: a point meets others within
    its reach only, and its neighbours are tried from the nearest on. Points at different altitudes are compared in all pairs."""
    from skylattice.session import cut

    p = cut(points.select("id", "lat", "lon", "alt"))
    low, high = p.agg(F.min("alt"), F.max("alt")).first()
    if low != high:
        return (relative_neighbours if relative else gabriel)(radius_pairs(p, metres))
    kind, scale, lists = dict(p.dtypes)["id"], EARTH + (high or 0.0), None
    found = [(r, cut(df)) for r, df in _reaches(p, metres)]
    every = found[0][1]
    for _, df in found[1:]:
        every = every.unionByName(df)
    for r, df in found:
        wide = r * (1 + 1e-6)
        met = _met(every if lists is None else _beside(every, df, wide), df, wide, None, (), cells=True).filter("id_a <> id_b").withColumn("d", between("_b", "_a")).filter("d <= reach_b")
        # a link is looked at from its smaller end, and only if it is in reach of both
        each = F.struct("d", F.col("id_a").alias("v"), F.radians("lat_a").alias("y"), F.radians("lon_a").alias("x"), ((F.col("id_b") < F.col("id_a")) & (F.col("d") <= F.col("reach_a"))).alias("ask"))
        some = met.groupBy("_band", "_cell", F.col("id_b").alias("u")).agg(F.collect_list(each).alias("near")).select("u", "near")
        lists = some if lists is None else lists.unionByName(some)

    def open_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near_ = batch.column("near")
            flat, ends = near_.flatten(), np.cumsum(pc.list_value_length(near_).to_numpy(zero_copy_only=False))
            d, y, x, ask = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("d", "y", "x", "ask"))
            rows, kept = [], []
            for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                by = a + np.argsort(d[a:b], kind="stable")
                live, j, size = by[ask[by].astype(bool)], 0, 16
                while len(live) and j < len(by):
                    c, v = by[None, j : j + size], live[:, None]
                    h = np.sin((y[v] - y[c]) / 2) ** 2 + np.cos(y[v]) * np.cos(y[c]) * np.sin((x[v] - x[c]) / 2) ** 2
                    far = 2 * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) * scale
                    shut = np.maximum(d[c], far) < d[v] if relative else d[c] * d[c] + far * far < d[v] * d[v]
                    live, j, size = live[~shut.any(axis=1)], j + size, min(2 * size, 1024)
                rows += [i] * len(live)
                kept.append(live)
            at = pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(pa.array(rows, pa.int64())), pc.struct_field(flat, "v").take(at), pc.struct_field(flat, "d").take(at)], ["u", "v", "d"])

    return lists.mapInArrow(open_links, f"u {kind}, v {kind}, d double")


def knn_attach(airports: DataFrame, points: DataFrame, k: int, metres: float) -> DataFrame:
    """u (airport), v (point), d: each airport's k nearest points within `metres`, and its nearest one in any case."""
    from pyspark.sql import Window as W

    a, p = airports.select("id", "lat", "lon", "alt"), points.select("id", "lat", "lon", "alt")
    order = W.partitionBy("id_a").orderBy("d", "id_b")
    some = near(a, p, metres).withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k).withColumn("s", between())
    some = some.filter(F.col("s") <= metres)
    alone = a.join(some.select(F.col("id_a").alias("id")).distinct(), "id", "left_anti")
    one = nearest(alone, p)
    return some.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.col("s").alias("d")).unionByName(one)


def nearest(left: DataFrame, right: DataFrame, metres: float = 50_000.0) -> DataFrame:
    """u, v, d: the nearest right point of each left one, by haversine, ties by id. Points are looked for within `metres`, and those
    without any within four times as much, and so on to the other side of the earth, so far points are met only by what has no
    near one."""
    from skylattice.session import cut

    a, b = left.select("id", "lat", "lon", "alt"), right.select("id", "lat", "lon", "alt")
    if not b.limit(1).count():
        a = a.limit(0)
    rest, out = cut(a), []
    while rest.limit(1).count():
        best = near(rest, b, metres).groupBy("id_a").agg(F.min(F.struct("d", F.col("id_b").alias("v"), between().alias("s"))).alias("m"))
        best = cut(best.select(F.col("id_a").alias("u"), F.col("m.v").alias("v"), F.col("m.s").alias("d")))
        out.append(best)
        if metres > math.pi * EARTH:
            break
        rest, metres = cut(rest.join(best.select(F.col("u").alias("id")), "id", "left_anti")), 4 * metres
    if not out:
        return a.select(F.col("id").alias("u")).limit(0).join(b.select(F.col("id").alias("v")).limit(0)).withColumn("d", F.lit(0.0))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def closest_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """u, v, d: one row, the closest pair of two sets, ties by ids. The radius starts at the distance of any one pair, and only
    pairs in reach of the cells are looked at."""
    a, b = left.select("id", "lat", "lon", "alt"), right.select("id", "lat", "lon", "alt")
    one = a.orderBy("id").first()
    start = b.agg(F.min(haversine(F.lit(one["lat"]), F.lit(one["lon"]), F.col("lat"), F.col("lon")))).first()[0] if one else None
    found = near(a, b, float(start) * (1 + 1e-6) + 1.0) if start is not None else near(a.limit(0), b.limit(0), 1.0)
    return found.groupBy().agg(F.min(F.struct("d", F.col("id_a").alias("u"), F.col("id_b").alias("v"))).alias("m")).select("m.u", "m.v", "m.d")


def nearest_k(points: DataFrame, k: int, metres: float = 50_000.0) -> DataFrame:
    """points (id, lat, lon) -> u < v, d: the links of each point to its k nearest others by haversine, ties by id. Points that have
    fewer in reach look again within four times as much."""
    from pyspark.sql import Window as W

    from skylattice.session import cut

    p = cut(points.select("id", "lat", "lon"))
    k = min(k, p.count() - 1)
    rest, out = p, None
    while k > 0:
        ranked = near(rest, p, metres).filter("id_a <> id_b").withColumn("rk", F.row_number().over(W.partitionBy("id_a").orderBy("d", "id_b"))).filter(F.col("rk") <= k)
        full = cut(ranked.withColumn("_n", F.count("*").over(W.partitionBy("id_a"))).filter(F.col("_n") == k).select("id_a", "id_b", "d"))
        out = full if out is None else out.unionByName(full)
        if metres > math.pi * EARTH:
            break
        rest, metres = cut(rest.join(full.select(F.col("id_a").alias("id")).distinct(), "id", "left_anti")), 4 * metres
        if rest.isEmpty():
            break
    kind = dict(points.dtypes)["id"]
    out = points.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, d double") if out is None else out
    return out.groupBy(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).agg(F.min("d").alias("d"))


def closest_pairs(wanted: DataFrame, points: DataFrame, metres: float = 50_000.0) -> DataFrame:
    """wanted (left, right: components), points (id, lat, lon, alt, component) -> left, right, u, v, d: of each two components the
    closest points by haversine, ties by ids, and their distance with altitudes. All pairs of components are looked at together,
    within `metres`, then those without a pair within four times as much, and so on."""
    from skylattice.session import cut

    p = points.select("id", "lat", "lon", "alt", "component")
    rest, out = cut(wanted.select("left", "right").distinct()), None
    while not rest.isEmpty():
        a = p.join(rest, F.col("component") == F.col("left")).drop("component")
        b = p.join(rest, F.col("component") == F.col("right")).drop("component")
        best = near(a, b, metres, on=("left", "right")).groupBy("left", "right").agg(F.min(F.struct("d", F.col("id_a").alias("u"), F.col("id_b").alias("v"), between().alias("s"))).alias("m"))
        best = cut(best.select("left", "right", "m.u", "m.v", F.col("m.s").alias("d")))
        out = best if out is None else out.unionByName(best)
        if metres > math.pi * EARTH:
            break
        rest, metres = cut(rest.join(best, ["left", "right"], "left_anti")), 4 * metres
    if out is None:
        kind = dict(points.dtypes)["id"]
        return wanted.select("left", "right", *(F.lit(None).cast(kind).alias(c) for c in ("u", "v")), F.lit(0.0).alias("d")).limit(0)
    return out


def lightest_out(points: DataFrame, metres: float) -> DataFrame:
    """points (id, lat, lon, group) -> group, d, u < v, gu, gv: the shortest link of each group to another one, by haversine, ties by
    ids, with both its groups. Groups without a neighbour in reach look again within four times as much; within a radius only
    cells that hold two groups are compared, so the inside of a large group costs nothing."""
    from skylattice.session import cut

    p = points.select("id", "lat", "lon", "group")
    rest, out = p, None
    while True:
        pairs = near(rest, p, metres, apart="group")
        ends = lambda c: (F.when(F.col("id_a") < F.col("id_b"), F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(F.col("id_a") < F.col("id_b"), F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
        (u, v), (la, lb), (oa, ob), (gu, gv) = (ends(c) for c in ("id", "lat", "lon", "group"))
        # distances from the smaller id to the larger one, so that both groups see the same number
        link = F.struct(haversine(la, oa, lb, ob).alias("d"), u.alias("u"), v.alias("v"), gu.alias("gu"), gv.alias("gv"))
        best = cut(pairs.groupBy("group_a").agg(F.min(link).alias("m")).select(F.col("group_a").alias("group"), "m.*"))
        out = best if out is None else out.unionByName(best)
        if metres > math.pi * EARTH:
            return out
        rest, metres = cut(rest.join(best.select("group"), "group", "left_anti")), 4 * metres
        if rest.isEmpty():
            return out


def grid_points(spark, boxes: list[tuple[str, tuple]], nx: int, ny: int, altitude: float, prefix: str = "GRID") -> DataFrame:
    """Tile centres of each named box (lat and lon minimum, then maximum)."""
    rows = [(name, *map(float, box)) for name, box in boxes]
    return grid_of(spark.createDataFrame(rows, "region string, lat0 double, lon0 double, lat1 double, lon1 double"), nx, ny, altitude, prefix)


def grid_of(boxes: DataFrame, nx: int, ny: int, altitude: float, prefix: str = "GRID") -> DataFrame:
    """Tile centres of boxes (region, lat0, lon0, lat1, lon1); names with what is no letter or digit as _."""
    clean = lambda s: "".join(c if c.isalnum() else "_" for c in s).upper()
    b = boxes.withColumn("region", F.upper(F.regexp_replace("region", r"[^\p{L}\p{N}]", "_")))
    g = b.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    lat = F.col("lat0") + (F.col("y") + 0.5) * (F.col("lat1") - F.col("lat0")) / ny
    lon = F.col("lon0") + (F.col("x") + 0.5) * (F.col("lon1") - F.col("lon0")) / nx
    name = F.format_string(f"{clean(prefix)}_%s_Y%02dX%02d", "region", "y", "x")
    return g.select(name.alias("id"), "region", "y", "x", lat.alias("lat"), lon.alias("lon"), F.lit(float(altitude)).alias("alt"))


def grid_edges(grid: DataFrame) -> DataFrame:
    """u < v, d between the eight neighbours of each grid point of a region."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    a = grid.withColumn("s", F.explode(steps)).select("region", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), *[F.col(c).alias(f"{c}_a") for c in ("id", "lat", "lon", "alt")])
    b = grid.select("region", "y", "x", *[F.col(c).alias(f"{c}_b") for c in ("id", "lat", "lon", "alt")])
    return a.join(b, ["region", "y", "x"]).filter("id_a < id_b").select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), between().alias("d"))


#: Regions of up to so many sides are tested by compiled terms.
UNROLLED = 24


def _met_regions(points: DataFrame, regions: DataFrame, step: float, by: tuple[str, ...]) -> DataFrame:
    """points, regions (*by, lats, lons; rows of equal keys are one region of several parts) -> points with the keys of the regions they
    are in, by the even-odd rule of geo.in_polygon. A region is one row in each cell of `step` degrees that its box meets, so a point
    meets it once, and first by its box; nothing is counted or moved after that."""
    n = F.size("lats")
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("lats", i).alias("y1"), F.get("lons", i).alias("x1"), F.get("lats", (i + 1) % n).alias("y2"), F.get("lons", (i + 1) % n).alias("x2")))
    parts = regions.filter(n >= 3).select(*by, F.array_min("lons").alias("_west"), F.explode(side).alias("s")).filter("s.y1 <> s.y2")
    flat = F.abs(F.col("s.y1") - F.col("s.y2")) < 1e-9  # where the place of the crossing depends on the guard of the formula
    whole = parts.groupBy(*by).agg(
        F.collect_list("s").alias("_sides"),
        F.min(F.least("s.y1", "s.y2")).alias("_south"),
        F.max(F.greatest("s.y1", "s.y2")).alias("_north"),
        F.min(F.when(flat, -361.0).otherwise(F.col("_west") - 1e-9)).alias("_west"),
        F.max(F.when(flat, 361.0).otherwise(F.greatest("s.x1", "s.x2") + 1e-9)).alias("_east"),
    )
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step)))
    whole = whole.withColumn("_band", cells("_south", "_north")).withColumn("_cell", cells("_west", "_east"))
    at = points.withColumns({"_band": F.floor(F.col("lat") / step), "_cell": F.floor(F.col("lon") / step)})
    n_parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = whole.repartition(n_parts, "_band", "_cell").join(at.repartition(n_parts, "_band", "_cell").hint("shuffle_hash"), ["_band", "_cell"])
    met = met.filter((F.col("lat") >= F.col("_south")) & (F.col("lat") <= F.col("_north")) & (F.col("lon") >= F.col("_west")) & (F.col("lon") <= F.col("_east")))
    crosses = lambda s: F.coalesce(((s["y1"] > F.col("lat")) != (s["y2"] > F.col("lat"))) & (F.col("lon") < (s["x2"] - s["x1"]) * (F.col("lat") - s["y1"]) / (s["y2"] - s["y1"] + 1e-15) + s["x1"]), F.lit(False))
    most = parts.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most <= UNROLLED:  # a term a side is compiled, a function over the list of sides is not
        odd = sum((F.when(crosses(F.get("_sides", F.lit(i))), 1).otherwise(0) for i in range(most)), F.lit(0))
    else:
        odd = F.size(F.filter("_sides", crosses))
    return met.filter(odd % 2 == 1).select(*points.columns, *by)


def in_region_table(points: DataFrame, regions: DataFrame, step: float = 1.0) -> DataFrame:
    """points (id, lat, lon), regions (region, lats, lons) -> id, region: every region that a point is in."""
    return _met_regions(points.select("id", "lat", "lon"), regions.select("region", "lats", "lons"), step, ("region",)).select("id", "region")


def kept_in_regions(points: DataFrame, regions: DataFrame, step: float = 1.0) -> DataFrame:
    """points (id, lat, lon), regions (scenario, region, lats, lons) -> scenario, id: the points in any region of a scenario; in a
    scenario whose regions hold no point at all the regions don't count, and all points are kept."""
    from skylattice.session import cut

    found = _met_regions(points.select("id", "lat", "lon"), regions.select("scenario", "region", "lats", "lons"), step, ("scenario", "region"))
    inside = cut(found.select("scenario", "id").distinct())
    own = regions.select("scenario").distinct()
    none = own.join(inside.select("scenario").distinct(), "scenario", "left_anti")
    return inside.unionByName(none.crossJoin(points.select("id")))  # all points of such a scenario are the result


def expanded(vertices: DataFrame, levels: list[tuple[int, float, str]]) -> DataFrame:
    """vertices (id, lat, lon, is_airport) -> id, base, lat, lon, alt, is_airport, level: airports once on the ground (level -1),
    other points once a level."""
    up = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(m)).alias("alt"), F.lit(t).alias("tag")) for i, m, t in levels])
    ground = F.array(F.struct(F.lit(-1).alias("level"), F.lit(0.0).alias("alt"), F.lit(None).cast("string").alias("tag")))
    v = vertices.withColumn("l", F.explode(F.when(F.col("is_airport") == 1, ground).otherwise(up)))
    name = F.concat_ws("_", F.col("id").cast("string"), F.col("l.tag"))
    return v.select(name.alias("id"), F.col("id").alias("base"), "lat", "lon", F.col("l.alt").alias("alt"), "is_airport", F.col("l.level").alias("level"))


def lifted(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges (u, v) of base points among their levels (vertices of expanded()): between levels at most one apart, from airports to
    all; distances anew."""
    side = lambda s: vertices.select(F.col("base").alias("u" if s == "_a" else "v"), *[F.col(c).alias(f"{c}{s}") for c in ("id", "lat", "lon", "alt", "level")])
    e = edges.select("u", "v").distinct().join(side("_a"), "u").join(side("_b"), "v")
    e = e.filter((F.col("level_a") < 0) | (F.col("level_b") < 0) | (F.abs(F.col("level_a") - F.col("level_b")) <= 1))
    return e.select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v"), between().alias("d")).dropDuplicates(["u", "v"])


def separated(points: DataFrame, metres: float) -> DataFrame:
    """Points kept when taken one by one, airports first and then by ordinal, each kept one removing the other points within
    `metres` of it, but no airport.

    A point waits for the earlier points near it. Each round settles what waits for nothing any more, and then, block by block of the
    map, goes through what is left of a block in order, which settles all points whose chain of waiting stays in it. Blocks are four
    times as wide in the next round, and only points that still wait are in them, so the rounds follow the logarithm of the
    longest chain's extent and not the number of its points."""
    from skylattice.session import cut

    kind = dict(points.dtypes)["id"]
    p = points.select("id", "lat", "lon", "ordinal", "is_airport").withColumn("rank", F.struct((1 - F.col("is_airport")).alias("a"), "ordinal", "id"))
    q = p.select("id", "lat", "lon", "rank", "is_airport")
    before = near(q, q, metres).filter("id_a <> id_b and rank_a < rank_b and is_airport_b = 0").groupBy(F.col("id_b").alias("id")).agg(F.collect_list("id_a").alias("waits"))
    state = cut(p.select("id", "lat", "lon", "rank").join(before, "id", "left"))
    new = state.filter("waits is null").select("id", F.lit(True).alias("kept"))
    waiting, settled, size = state.filter("waits is not null"), new, math.degrees(16 * metres / EARTH)

    def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict = {}
        done: dict = {}
        for i, waits, free, hit in zip(pdf["id"], pdf["waits"], pdf["free"], pdf["hit"]):
            seen = [known.get(j) for j in waits]
            known[i] = not hit if free else False if True in seen else None if None in seen else True
            if not free and known[i] is not None:
                done[i] = known[i]
        return pd.DataFrame({"id": pd.Series(list(done), dtype=pdf["id"].dtype), "kept": pd.Series(list(done.values()), dtype="bool")})

    while not waiting.isEmpty():
        now = new.select(F.col("id").alias("by"), "kept")
        each = waiting.select("id", F.explode("waits").alias("by")).join(now, "by", "left").groupBy("id").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.collect_list(F.when(F.col("kept").isNull(), F.col("by"))).alias("waits"))
        state = cut(waiting.drop("waits").join(each, "id"))
        free = F.col("hit") | (F.size("waits") == 0)
        waiting, new = state.filter(~free).drop("hit"), state.filter(free).select("id", (~F.col("hit")).alias("kept"))
        block = F.struct(F.floor(F.col("lat") / size), F.floor(F.col("lon") / size))
        placed = state.withColumns({"_b": block, "_k": F.col("rank"), "free": free})  # with what was settled just now
        # in order within a block: the kernel gets its rows sorted by their place
        sorted_ = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_b").orderBy("_k"))).select("_b", "_place", "id", "waits", "free", "hit")
        more = cut(sorted_.groupBy("_b").applyInPandas(lambda pdf: in_order(pdf.sort_values("_place")), f"id {kind}, kept boolean"))
        new = new.unionByName(more)
        settled, waiting, size = settled.unionByName(new), waiting.join(more.select("id"), "id", "left_anti"), 4 * size
    return points.join(settled.filter("kept").select("id"), "id", "left_semi")
