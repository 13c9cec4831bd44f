"""Sectors: connected groups of bounded size, grown component by component."""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from itertools import islice, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import EARTH
from skylattice.operators.graph import components, first_appearance
from skylattice.session import cut


class Net:
    """A component with its vertices numbered in order: of vertex i the neighbours to[first[i]:first[i + 1]], ascending. Arrays, as lists
    of numbers take some four times as much memory."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, d: np.ndarray):
        a, b, w = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
        by = np.lexsort((b, a))
        self._set(n, np.searchsorted(a[by], np.arange(n + 1)), [b[by]], [w[by]])

    def _set(self, n: int, first: np.ndarray, to: list[np.ndarray], metres: list[np.ndarray]) -> None:
        self.n, self.first, self.to, self.metres = n, array("q", first.astype(np.int64).tobytes()), array("i"), array("d")
        for out, kind, parts in ((self.to, np.int32, to), (self.metres, np.float64, metres)):
            while parts:
                out.frombytes(parts.pop(0).astype(kind).tobytes())

    @classmethod
    def of(cls, places: np.ndarray, first: np.ndarray, to: list[np.ndarray], metres: list[np.ndarray]) -> Net:
        """From the vertices' places, ascending, and both ways' links in order, in parts, which are used up; ends are places."""
        net, to = cls.__new__(cls), [np.searchsorted(places, to.pop(0)).astype(np.int32) for _ in range(len(to))]
        net._set(len(places), first, to, metres)
        return net

    def around(self, i: int) -> Iterator[tuple[int, float]]:
        for k in range(self.first[i], self.first[i + 1]):
            yield self.to[k], self.metres[k]

    def outward(self, seed: int, owner: array) -> Iterator[int]:
        """Free vertices in breadth-first order."""
        line, reached = [seed], {seed}
        for i in line:
            yield i
            fresh = [j for j, _ in self.around(i) if owner[j] < 0 and j not in reached]
            reached.update(fresh)
            line += fresh

    def between(self, start: int, ends: set[int]) -> set[int]:
        """All vertices on shortest paths from start to the ends: distances first, then a sweep back over them."""
        dist, settled, missing = {start: 0.0}, [], len(ends)
        heap, known = [(0.0, start)], set()
        while heap and missing:
            far, i = heapq.heappop(heap)
            if i in known:
                continue
            known.add(i)
            settled.append(i)
            missing -= i in ends
            for j, w in self.around(i):
                if far + w < dist.get(j, float("inf")):
                    dist[j] = far + w
                    heapq.heappush(heap, (far + w, j))
        on = ends & known
        for i in reversed(settled):
            if i in on:
                on |= {j for j, w in self.around(i) if j in known and dist[j] + w == dist[i]}
        return on


def grow_connected(net: Net, size: int) -> array:
    """The sector of each vertex: the first `size` free vertices outward from the first free one, and again."""
    owner, k = array("i", [-1]) * net.n, 0
    for seed in range(net.n):
        if owner[seed] < 0:
            for i in list(islice(net.outward(seed, owner), size)):
                owner[i] = k
            k += 1
    return owner


def grow_convex(net: Net, size: int) -> array:
    """Sectors in which all shortest paths between members stay: a vertex comes in only if the paths to all members run over
    members or free vertices, which come in with it, so a sector can get larger than `size`."""
    owner, k = array("i", [-1]) * net.n, 0
    for seed in range(net.n):
        if owner[seed] >= 0:
            continue
        members: set[int] = set()
        line, waiting = [seed], {seed}
        for i in line:
            if len(members) >= size:
                break
            waiting.discard(i)
            if owner[i] >= 0:
                continue
            with_it = net.between(i, members) - members - {i}
            if all(owner[j] < 0 for j in with_it):
                for j in (i, *sorted(with_it)):
                    owner[j] = k
                    members.add(j)
                for j in (i, *sorted(with_it)):
                    fresh = [x for x, _ in net.around(j) if owner[x] < 0 and x not in waiting]
                    waiting.update(fresh)
                    line += fresh
        k += 1
    return owner


class Disc:
    """Points of a region, numbered in order, whose neighbours are those within `metres`. They are looked for in the cells around a point
    and no pair is kept; a cell forgets points that have a sector."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, alt: np.ndarray, cell: np.ndarray, metres: float):
        self.n, self.metres, self.alt = len(lat), metres, alt
        self.y, self.x = np.radians(lat), np.radians(lon)
        own: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, cell.tolist())):
            own.setdefault(c, []).append(i)
        self.place = list(map(tuple, cell.tolist()))
        self.own = {c: np.array(v) for c, v in own.items()}
        self.cells: dict[tuple, np.ndarray] = {}

    def around(self, i: int, owner: np.ndarray, most: int, reached: set[int]) -> list[int]:
        """The first `most` free neighbours of i that were not reached, ascending."""
        c = self.place[i]
        if c not in self.cells:
            self.cells[c] = np.sort(np.concatenate([self.own[k] for k in product(*((x - 1, x, x + 1) for x in c)) if k in self.own]))
        free = self.cells[c]
        self.cells[c] = free = free[owner[free] < 0]
        out, at, step = [], 0, max(64, 16 * most)
        while at < len(free) and len(out) < most:
            j = free[at : at + step]
            h = np.sin((self.y[j] - self.y[i]) / 2) ** 2 + np.cos(self.y[i]) * np.cos(self.y[j]) * np.sin((self.x[j] - self.x[i]) / 2) ** 2
            arc = 2 * np.arcsin(np.sqrt(np.clip(h, 0.0, 1.0))) * (EARTH + (self.alt[i] + self.alt[j]) / 2)
            out += [k for k in j[np.hypot(arc, self.alt[j] - self.alt[i]) <= self.metres].tolist() if k not in reached]
            at, step = at + step, 2 * step
        return out[:most]


def grow_within(disc: Disc, size: int) -> np.ndarray:
    """grow_connected() of all links of a disc: of a vertex's neighbours only as many are looked for as the sector still takes."""
    owner, k = np.full(disc.n, -1, np.int64), 0
    for seed in range(disc.n):
        if owner[seed] < 0:
            line, reached = [seed], {seed}
            for i in line:
                if len(line) >= size:
                    break
                fresh = disc.around(i, owner, size - len(line), reached)
                reached.update(fresh)
                line += fresh
            owner[line] = k
            k += 1
    return owner


def regions(points: DataFrame, metres: float) -> DataFrame:
    """points (id, lat, lon, alt) with their cell (x, y, z, by cubes as wide as the radius) and region: cells that touch each other, so no
    link up to `metres` leads out of a region. Regions are components of the cells, which are few beside the points."""
    side = 2 * math.sin(min(metres * (1 + 1e-6) / EARTH, math.pi) / 2) * (1 + 1e-9) + 1e-12
    wide = math.ceil(2 / side) + 4
    flat = F.cos(F.radians("lat"))
    x, y, z = (F.floor((c + 1) / side) + 1 for c in (flat * F.cos(F.radians("lon")), flat * F.sin(F.radians("lon")), F.sin(F.radians("lat"))))
    placed = cut(points.withColumns({"x": x, "y": y, "z": z, "cell": (x * wide + y) * wide + z}))
    cells = cut(placed.select(F.col("cell").alias("id")).distinct())
    steps = [(a * wide + b) * wide + c for a, b, c in product((-1, 0, 1), repeat=3) if (a, b, c) > (0, 0, 0)]
    links = cells.select(F.col("id").alias("u"), F.explode(F.array(*(F.col("id") + s for s in steps))).alias("v")).join(cells.select(F.col("id").alias("v")), "v", "left_semi")
    return placed.join(components(cells, links).select(F.col("id").alias("cell"), F.col("component").alias("region")), "cell")


def radius_sectors(points: DataFrame, metres: float, size: int) -> DataFrame:
    """points (id, lat, lon, alt, ordinal) -> sectors() of all links up to `metres`, which are not made: a region is a group of its own
    and holds its points only. Negative altitudes are not meant."""
    kind = dict(points.dtypes)["id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ordinal", "id"])
        names = pd.Index(pdf["id"])
        owner = grow_within(Disc(*(pdf[c].to_numpy(float) for c in ("lat", "lon", "alt")), pdf[["x", "y", "z"]].to_numpy(np.int64), metres), size)
        _, seeds = np.unique(owner, return_index=True)
        return pd.DataFrame({"id": names, "seed": names[seeds[owner]]})

    placed = regions(points.select("id", "lat", "lon", "alt", "ordinal"), metres)
    grouped = placed.select("region", "id", "ordinal", "lat", "lon", "alt", "x", "y", "z").groupBy("region").applyInPandas(run, f"id {kind}, seed {kind}")
    return _with_numbers(points, cut(grouped))


def sectors(vertices: DataFrame, edges: DataFrame, size: int, convex: bool = False) -> DataFrame:
    """vertices (id, ordinal), edges (u, v, d) -> id, sector (numbered by its seed's ordinal). Components are independent, so each is
    a group of its own."""
    edges = cut(edges.select("u", "v", F.col("d").cast("double").alias("d")))
    place = first_appearance(vertices.select(F.col("id").alias("name"), "ordinal"), "name", F.col("ordinal")).select(F.col("name").alias("id"), F.col("id").alias("place"))
    at = cut(place.join(components(vertices, edges), "id"))
    at = cut(at.join(at.groupBy("component").agg(F.min("place").alias("g")), "component").select("id", "place", "g"))
    ends = edges.join(at.select(F.col("id").alias("u"), F.col("place").alias("a"), "g"), "u").join(at.select(F.col("id").alias("v"), F.col("place").alias("b")), "v")
    links = cut(ends.filter("a <> b").groupBy("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d")))
    own = at.select("g", F.col("place").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("d"))
    rows = own.unionByName(links).unionByName(links.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    grow = grow_convex if convex else grow_connected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted: of each vertex a row with no end, then its links. A component is held as arrays of its places, ends and lengths."""
        at, n_links, places, first, to, metres = None, 0, [], [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal n_links
            names = np.concatenate(places)
            net = Net.of(names, np.append(np.concatenate(first), n_links), to, metres)
            places.clear(), first.clear()
            owner = np.frombuffer(grow(net, size), np.int32)
            _, seeds = np.unique(owner, return_index=True)  # sectors are numbered by their first vertices
            for k in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(names[k : k + (1 << 16)]), pa.array(names[seeds[owner[k : k + (1 << 16)]]])], ["place", "seed"])
            n_links = 0

        for batch in batches:
            g, a, b, d = (batch.column(c).to_numpy() for c in ("g", "a", "b", "d"))
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(cuts, cuts[1:]):
                if y > x:
                    if g[x] != at and at is not None:
                        yield from done()
                    at, link = g[x], b[x:y] >= 0
                    places.append(a[x:y][~link])
                    first.append(n_links + np.cumsum(link)[~link])
                    to.append(b[x:y][link].astype(np.uint32) if b[x:y].max() < 1 << 32 else b[x:y][link])
                    metres.append(d[x:y][link])
                    n_links += int(link.sum())
        if at is not None:
            yield from done()

    grown = cut(rows.repartition("g").sortWithinPartitions("g", "a", "b").mapInArrow(run, "place long, seed long"))
    named = lambda c, out: at.select(F.col("place").alias(c), F.col("id").alias(out))
    return _with_numbers(vertices, cut(grown.join(named("place", "id"), "place").join(named("seed", "_seed"), "seed").select("id", F.col("_seed").alias("seed"))))


def _with_numbers(vertices: DataFrame, grouped: DataFrame) -> DataFrame:
    """grouped (id, seed) -> id, sector, seed."""
    seeds = vertices.join(grouped.select(F.col("seed").alias("id")).distinct(), "id", "left_semi")
    return grouped.join(numbered(seeds), "seed").select("id", F.format_string("SECTOR_%06d", F.col("number") + 1).alias("sector"), "seed")


def numbered(seeds: DataFrame) -> DataFrame:
    """seed, number: seeds by ordinal."""
    out = first_appearance(seeds.select(F.col("id").alias("seed"), "ordinal"), "seed", F.col("ordinal"))
    return out.select("seed", F.col("id").alias("number"))


def representatives(assignment: DataFrame) -> DataFrame:
    """assignment (id, sector, ordinal) -> sector, representative: its first vertex in file order."""
    return assignment.groupBy("sector").agg(F.min_by("id", F.struct("ordinal", "id")).alias("representative"))
