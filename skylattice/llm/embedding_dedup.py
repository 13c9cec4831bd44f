"""Embedding near-dedup with a random-projection tree forest.

Trees are grown on a bounded sample of distinct vectors (SAMPLE, a documented parameter): every node splits its sample at a
quantile of a random projection, and vectors within a spill band around the split go to both sides. All distinct vectors are then
routed down all trees, compared within leaves in blocks, and verified by exact cosines in double precision.

A pair that meets in several leaves counts in the first of them only: every vector carries the leaves it lies in, so a leaf can
tell which of its pairs have met before. So leaves return a count for each vector and a spanning forest of their links rather than
pairs, and nothing grows with the square of a group. Equal vectors are one class from the start.

Splits would part a group of near copies that is larger than a few leaves, so such groups are taken out first: `dense()` finds
them in the sample, and every vector within LEAST of a group's centre (its core) is compared with all that can be in its reach,
exactly and not by the trees. Core vectors within half that angle link with each other by geometry, so they are only counted; the
others of a group are compared in tiles of TILE rows a side, spread over tasks, which grows with the square of their number.

The index is approximate: a link is missed only if its vectors are parted in every tree. Defined cases: null, zero or non-finite
vectors, and vectors with null components, link with nothing; vectors of different lengths never link, and each length has a forest of
its own; extra columns are ignored; an empty table gives no rows. Each row of the input gets a row and is a vector of its
own: rows that repeat a vec_id, or have none, count as links of the others. A component is named by its smallest id that is not null;
`kept` of a row without an id is null, and a vector that only rows without an id hold is linked with its equal copies alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import mixed, table, written
from skylattice.llm.components import connected_components

LEAST, SAMPLE, TREES, SPILL, LEAF = 0.95, 20_000, 12, 0.06, 250
#: Groups of more leaves than this are dense; rows on a side of a tile.
DENSE, TILE = 4, 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=0)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> list:
    """A tree as nested [direction, low, high, left, right]; None is a leaf."""
    if depth == 0 or len(x) < 8:
        return None
    direction = unit(rng.standard_normal((1, x.shape[1])))[0]
    at = x @ direction
    low, high = np.quantile(at, [0.5 - SPILL, 0.5 + SPILL])
    return [direction, low, high, grow(x[at <= high], depth - 1, rng), grow(x[at >= low], depth - 1, rng)]


def route(tree: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """-> rows and the number of the leaf (by its path) of every place in the tree that a vector reaches."""
    rows, leaves, todo = [], [], [(tree, np.arange(len(x)), 1)]
    while todo:
        node, own, path = todo.pop()
        if node is None or not len(own):
            rows.append(own)
            leaves.append(np.full(len(own), path, np.int64))
            continue
        at = x[own] @ node[0]
        todo += [(node[3], own[at <= node[2]], 2 * path), (node[4], own[at >= node[1]], 2 * path + 1)]
    return np.concatenate(rows), np.concatenate(leaves)


def dense(x: np.ndarray, total: int, leaf: int, least: float) -> np.ndarray:
    """Centres of the groups that hold more than DENSE leaves of `total` vectors, as the sample x of them has it."""
    most, y, step = max(8.0, DENSE * leaf * len(x) / max(1, total)), x.astype(np.float32), 500
    near = lambda rows: sum(((y @ rows[a : a + step].T) >= least).sum(1) for a in range(0, len(rows), step))
    left, centres = near(y) if len(x) > most else np.zeros(len(x), np.int64), []
    free = np.ones(len(x), bool)
    while len(x) and left.max() > most:
        seed = int(left.argmax())
        members = free & (x @ x[seed] >= least)
        centre = unit(x[members].mean(0, keepdims=True))[0]
        core = free & (x @ centre >= least)
        if core.sum() > most:
            centres.append(centre)
        else:
            core = members
        core[seed] = True
        left = left - near(y[core & free])
        free &= ~core
        left[~free] = 0
    return np.array(centres).reshape(-1, x.shape[1])


INNER, OUTER, RIM = 0, 1, 2


def grouped(x: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """-> the group of whose core each vector is (-1: none), and row, group and kind of every membership. A pair is met in the first
    group that has one of the two in its core, so a core vector is on the rim of earlier groups only."""
    at = x @ centres.T
    core = np.where((at >= least).any(1), (at >= least).argmax(1), -1)
    angle = np.arccos(least)
    row, group = np.nonzero(at >= np.cos(min(np.pi, 2 * angle)) - 1e-9)
    kind = np.where(core[row] != group, RIM, np.where(at[row, group] >= np.cos(angle / 2) + 1e-9, INNER, OUTER))
    some = (kind != RIM) | (core[row] < 0) | (group < core[row])
    return core, row[some], group[some], kind[some]


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def memberships(centres: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, row, group, kind = grouped(unit(vectors_of(batch.column("v"))), centres, least)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(kind == INNER), batch.column("c").take(pa.array(row)), batch.column("n").take(pa.array(row))], ["g", "inner", "c", "n"])

    return run


def tiled(centres: np.ndarray, least: float, inner: list[int], other: list[int], tile: int):
    """inner, other: vectors of a group. Parts of the others come first, then those of the inner ones; a tile is a pair of parts of
    which the first is of others."""
    parts = [(-(-o // tile), -(-i // tile)) for i, o in zip(inner, other)]
    base = np.cumsum([0, *(o * (o + i) for o, i in parts)]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, row, group, kind = grouped(unit(vectors_of(batch.column("v"))), centres, least)
            h = mixed(batch.column("c").to_numpy().view(np.uint64))[row]
            for g in np.unique(group).tolist():
                o, i = parts[g]
                for own, within, first in ((kind != INNER, o, 0), (kind == INNER, i, o)):
                    mine = np.flatnonzero((group == g) & own)
                    if not len(mine) or not o:
                        continue
                    part = (h[mine] % np.uint64(within)).astype(np.int64) + first
                    for j in range(o + i if first == 0 else o):
                        to = base[g] + np.minimum(part, j) * (o + i) + np.maximum(part, j)
                        at = pa.array(row[mine])
                        yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(part <= j), pa.array(part >= j), pa.array(kind[mine] == RIM), batch.column("c").take(at), batch.column("n").take(at), batch.column("v").take(at)], ["tile", "left", "right", "rim", "c", "n", "v"])

    return run


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links of a block (rows, columns) join: places, rows first, and another place of the same part."""
    rows, columns = hit.shape
    a, b, none = np.arange(rows), np.arange(rows, rows + columns), rows + columns
    while True:
        b2 = np.minimum(b, np.where(hit, a[:, None], none).min(0))
        a2 = np.minimum(a, np.where(hit, b2, none).min(1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    label = np.concatenate([a, b])
    moved = np.flatnonzero(label != np.arange(none))
    return moved, label[moved]


def compared_tiles(least: float, block: int = 1024):
    """As compared(), for tiles of dense groups."""

    def tile_of(held):
        left, right, rim, c, n, x = (np.concatenate(v) for v in zip(*held))
        order = np.argsort(c, kind="stable")
        left, right, rim, c, n, x = (v[order] for v in (left, right, rim, c, n, x))
        one = bool((left & right).all())  # a part with itself
        linked, found = np.zeros(len(c), np.int64), []
        ls, rs = np.flatnonzero(left), np.flatnonzero(right)
        for s in range(0, len(ls), block):
            for u in range(s if one else 0, len(rs), block):
                p, q = ls[s : s + block], rs[u : u + block]
                at = x[p] @ x[q].T
                hit = at >= least
                i, j = np.nonzero(np.abs(at - least) <= 1e-9)
                hit[i, j] = np.einsum("ij,ij->i", x[p[i]], x[q[j]]) >= least
                hit &= ~(rim[p][:, None] & rim[q])
                if one and s == u:
                    hit = np.triu(hit, 1)
                linked[p] += hit @ n[q]
                linked[q] += n[p] @ hit
                both = np.concatenate([p, q])
                a, b = spanning(hit)
                found.append((both[a], both[b]))
        kept = forest_edges(len(c), *(np.concatenate(v) for v in zip(*found))) if found else []
        some = np.flatnonzero(linked)
        yield np.zeros(len(some), np.int8), c[some], linked[some]
        if kept:
            e = np.array(kept)
            yield np.ones(len(e), np.int8), c[e[:, 0]], c[e[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done():
            for kind, a, b in tile_of(held):
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a), pa.array(b)], ["kind", "c", "other"])

        for batch in batches:
            tile = batch.column("tile").to_numpy()
            flags = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("left", "right", "rim")]
            columns = [*flags, batch.column("c").to_numpy(), batch.column("n").to_numpy(), unit(vectors_of(batch.column("v"))) if len(tile) else None]
            cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if at is not None and tile[a] != at:
                    yield from done()
                    held = []
                at = int(tile[a])
                held.append([v[a:b] for v in columns])
        if held:
            yield from done()

    return run


def dense_links(usable: DataFrame, centres: np.ndarray, least: float) -> DataFrame:
    """usable (c, n, v) -> kind, c, other of all pairs with a vector in a core."""
    member = usable.mapInArrow(memberships(centres, least), "g int, inner boolean, c long, n long")
    inner, other = [0] * len(centres), [0] * len(centres)
    one = {}
    for r in member.groupBy("g", "inner").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min("c").alias("c")).collect():
        (inner if r["inner"] else other)[r["g"]] = r["k"]
        if r["inner"]:
            one[r["g"]] = (r["n"], r["c"])
    out = usable.mapInArrow(tiled(centres, least, inner, other, TILE), f"tile long, left boolean, right boolean, rim boolean, c long, n long, v {dict(usable.dtypes)['v']}")
    out = out.repartition("tile").sortWithinPartitions("tile").mapInArrow(compared_tiles(least), "kind byte, c long, other long")
    if one:
        whole = F.broadcast(usable.sparkSession.createDataFrame([(g, *v) for g, v in one.items()], "g int, _n long, _c long"))
        known = member.filter("inner").join(whole, "g")
        out = out.union(known.select(F.lit(0).cast("byte"), "c", F.col("_n") - F.col("n"))).union(known.filter("c <> _c").select(F.lit(1).cast("byte"), "c", "_c"))
    return out


def forest(sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> list:
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.ceil(np.log(max(1, total / leaf)) / -np.log(0.5 + SPILL))))
    return [grow(sample, depth, rng) for _ in range(trees)]


def routed(trees: list, centres: np.ndarray, least: float):
    """All but the vectors in a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(centres):
                batch = batch.filter(pa.array(grouped(unit(vectors_of(batch.column("v"))), centres, least)[0] < 0))
            if not batch.num_rows:
                continue
            vectors = batch.column("v")
            x = unit(vectors_of(vectors))
            found = [route(t, x) for t in trees]
            row = np.concatenate([r for r, _ in found])
            name = np.concatenate([leaf * len(trees) + k for k, (_, leaf) in enumerate(found)])
            order = np.lexsort((name % len(trees), row))  # a vector's leaves by tree
            row, name = row[order], name[order]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(name))
            yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(name), lists.take(pa.array(row)), vectors.take(pa.array(row))], ["c", "n", "leaf", "leaves", "v"])

    return run


def met_before(codes_a: np.ndarray, codes_b: np.ndarray, leaf: int, trees: int) -> np.ndarray:
    """Whether two vectors (rows of padded leaf lists in tree order) share a leaf that comes before `leaf`."""
    rank = lambda c: (c % trees, c)
    t, l = rank(leaf)
    earlier = lambda c: (c >= 0) & ((c % trees < t) | ((c % trees == t) & (c < l)))
    a = np.where(earlier(codes_a), codes_a, -1)
    b = np.where(earlier(codes_b), codes_b, -2)
    out = np.zeros(len(a), bool)
    for j in range(a.shape[1]):
        out |= (b == a[:, j : j + 1]).any(1)
    return out


def forest_edges(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Those of the links that join two parts; union-find over n places."""
    parent = list(range(n)) if parent is None else parent
    out = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def compared(trees: int, least: float, block: int = 1024):
    """Leaf by leaf, with the rows of a leaf together: counts of linked vectors (kind 0: c, number) and links (kind 1: c, other)."""

    def leaf_of(c, n, leaf, codes, x):
        order = np.argsort(c, kind="stable")
        c, n, codes, x = c[order], n[order], codes[order], unit(x[order].astype(np.float64))
        linked, i_all, j_all = np.zeros(len(c), np.int64), [], []
        for s in range(0, len(c), block):
            for u in range(s, len(c), block):
                hit = x[s : s + block] @ x[u : u + block].T >= least - 1e-9
                i, j = np.nonzero(np.triu(hit, 1) if s == u else hit)
                i, j = i + s, j + u
                for a in range(0, len(i), 200_000):
                    p, q = i[a : a + 200_000], j[a : a + 200_000]
                    exact = np.einsum("ij,ij->i", x[p], x[q]) >= least
                    p, q = p[exact], q[exact]
                    new = ~met_before(codes[p], codes[q], leaf, trees)
                    p, q = p[new], q[new]
                    linked += np.bincount(p, n[q], len(c)).astype(np.int64) + np.bincount(q, n[p], len(c)).astype(np.int64)
                    kept = forest_edges(len(c), p, q)
                    i_all += [e[0] for e in kept]
                    j_all += [e[1] for e in kept]
        kept = forest_edges(len(c), np.array(i_all, np.int64), np.array(j_all, np.int64))
        some = np.flatnonzero(linked)
        yield np.zeros(len(some), np.int8), c[some], linked[some]
        if kept:
            e = np.array(kept)
            yield np.ones(len(e), np.int8), c[e[:, 0]], c[e[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done():
            c, n, codes, x = (np.concatenate(v) for v in zip(*[(h[0], h[1], np.pad(h[2], ((0, 0), (0, max(k[2].shape[1] for k in held) - h[2].shape[1])), constant_values=-1), h[3]) for h in held]))
            for kind, a, b in leaf_of(c, n, at, codes, x) if len(c) > 1 else ():
                yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(a), pa.array(b)], ["kind", "c", "other"])

        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            c, n = batch.column("c").to_numpy(), batch.column("n").to_numpy()
            lists = batch.column("leaves")
            size = np.diff(lists.offsets.to_numpy())
            codes = np.full((len(leaf), int(size.max(initial=0))), -1)
            codes[np.repeat(np.arange(len(leaf)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
            x = batch.column("v").flatten().to_numpy().reshape(len(leaf), -1)
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if at is not None and leaf[a] != at:
                    yield from done()
                    held = []
                at = int(leaf[a])
                held.append((c[a:b], n[a:b], codes[a:b], x[a:b]))
        if held:
            yield from done()

    return run


def links(usable: DataFrame, total: int, least: float, trees: int, leaf: int, sample: int) -> DataFrame:
    """usable (c, n, v): `total` distinct vectors of one length -> kind, c, other."""
    chosen = usable.orderBy(F.xxhash64("c"), "c").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = unit(vectors_of(chosen))
    centres = dense(x, total, leaf, least)
    rest = x[grouped(x, centres, least)[0] < 0] if len(centres) else x
    grown = forest(rest, round(total * len(rest) / len(x)), trees, leaf)
    spread = usable.mapInArrow(routed(grown, centres, least), f"c long, n long, leaf long, leaves array<long>, v {dict(usable.dtypes)['v']}")
    out = spread.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(compared(len(grown), least), "kind byte, c long, other long")
    return out.union(dense_links(usable, centres, least)) if len(centres) else out


def dedup_embeddings(rows: DataFrame, least: float = LEAST, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """rows (vec_id long, embedding array) -> vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    base = rows.select("vec_id", F.when(sound, v).alias("v"))
    # equal vectors are one class, named by its smallest id; -0.0 and 0.0 are equal
    classed = base.filter("v is not null").select("vec_id", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))
    classes = written(classed.groupBy("v").agg(F.min("vec_id").alias("c"), F.count("*").alias("n")).select("c", "n", "v", F.size("v").alias("_d")))
    # vectors travel in the type they came in
    named, found = classes.drop("_d"), []
    sent = named.withColumn("v", F.col("v").cast(dict(rows.dtypes)["embedding"])) if dict(rows.dtypes)["embedding"] == "array<float>" else named
    for r in classes.groupBy("_d").count().filter("count > 1").orderBy("_d").collect():
        found.append(written(links(sent.filter(F.size("v") == r["_d"]), r["count"], least, trees, leaf, sample)))
    out = reduce(DataFrame.union, found) if found else written(spark.createDataFrame([], "kind byte, c long, other long"))
    counts = out.filter("kind = 0").groupBy("c").agg(F.sum("other").alias("_l"))
    comps = connected_components(out.filter("kind = 1").select(F.col("c").alias("a"), F.col("other").alias("b")))
    per = named.join(counts, "c", "left").join(comps.withColumnRenamed("node", "c"), "c", "left")
    per = per.select("v", "c", (F.coalesce("_l", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "c").alias("_comp"))
    # back to the vectors: by the digest of their components, with the vectors themselves left out
    key = F.sha2(F.to_json(F.struct("v")), 256)
    ids = base.select("vec_id", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct(F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))), 256)).alias("_k"))
    found = ids.join(per.select(key.alias("_k"), "_links", "_comp"), "_k", "left")
    out = found.select("vec_id", F.coalesce("_links", F.lit(0)).alias("n_links"), F.coalesce("_comp", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node WHERE r.comp < l.b),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c.comp AS component_id, c.comp = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id
"""
