"""N-gram Jaccard join on size-banded tiles with hashed bitmap signatures.

A document's set is its distinct 3-word shingles; two documents link at a Jaccard similarity of LEAST percent or more.

1. Meeting. Documents that can link share one of the first tenth of their shingles (and one more) in any common order. The order
   puts shingles that are frequent in the corpus last, by a fixed table of hashed counts over all documents, so that a common
   passage brings nothing together. The table is fine enough for passages of a few hundred documents of 0.5 GB to stand out. What meets is compared by size and a 256-bit sketch, and the candidates of a shingle are
   returned as a forest, not as pairs: members of a tight ball hang on its centre, and balls are joined wherever members of both
   could link. Equal sets within a task are one document from the start.
2. Tiles. The components of the candidates are cut into size bands, a tenth apart, and a band into blocks of a bounded number of
   documents and of members; a tile holds one band with the one below, or two blocks. Within a tile bitmaps bound each overlap from above by bit counts, and only what passes is
   intersected exactly as sorted arrays, unless both are linked already. Tiles return spanning links.
3. The components of the links are the result.

No pair is emitted but for a spanning link. Bitmaps and sizes are strict bounds, and so is the sketch for sets up to about 430
shingles. Beyond, a pair at the very limit is taken for unlike if more than 45 of 256 sampled bits differ where 13 are expected,
with a probability below 1e-12, which is that of a hash going wrong. (The strict bound alone lets nearly all long documents pass
from 1,200 shingles on: measured, its candidates need 10 times the input of disk.)

Defined cases: null and empty texts have an empty set and link with nothing; texts of fewer than three words are one shingle;
rows that repeat a doc_id are one document to the links and each get a row; a null doc_id links with nothing and has no component,
but its set is counted; an empty table gives no rows; extra columns are
kept by distinct_documents().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import hashed_words, inside, mixed, rolling, signed, split_words, steps, table, written
from skylattice.llm.components import connected_components

SHINGLE, LEAST, BUCKETS, SKETCH, DEVIATIONS = 3, 90, 1 << 22, 256, 9
#: Counts travel in slices of so many buckets. Groups of up to FEW documents are compared pair by pair, all of a batch at once.
SLICE, FEW = 1 << 16, 16
#: Candidates up to SMALL are one tile; blocks of larger ones hold about TILE documents, and none more than about MEMBERS members of
#: their sets, but for a single larger set. Sets travel to their tiles in batches of about BATCH_BYTES.
SMALL, TILE, MEMBERS, BATCH_BYTES = 200, 2000, 1 << 23, 16_000_000
TOKEN, DOCUMENT, LINK = 0, 1, 2


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """-> hashes of the shingles of all texts (with repeats), bounds."""
    bounds, words = split_words(texts, lower=True)
    h, _ = hashed_words(words)
    n = np.diff(bounds)
    ok = inside(bounds, size, len(h))
    x, row = rolling(h, size)[ok], np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    for short in range(1, size):
        own = np.flatnonzero(n == short)
        if len(own):
            s = mixed(h[bounds[own]] + np.uint64(short))
            for j in range(1, short):
                s = mixed(s + h[bounds[own] + j])
            x, row = np.concatenate([x, s]), np.concatenate([row, own])
    if (n < size).any():
        order = np.argsort(row, kind="stable")
        x, row = x[order], row[order]
    return x, np.searchsorted(row, np.arange(len(n) + 1))


def sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """-> each text's distinct shingles, ascending, and bounds."""
    x, bounds = shingles(texts, size)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[new], row[new]
    return x, np.searchsorted(row, np.arange(len(bounds)))


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def bucket_counts(size: int):
    """slice, n: the counts of a task, a compressed row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in steps(batches, "text"):
            x, _ = shingles(batch.column("text"), size)
            np.add.at(total, (mixed(x) % np.uint64(BUCKETS)).astype(np.int64), np.uint32(1))
        if total.any():
            for k in range(0, BUCKETS, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE], pa.int32()), pa.array([packed(total[k : k + SLICE])], pa.binary())], ["slice", "n"])

    return run


def slice_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by slice: slice, level of all tasks' counts together. The mean is the slice's own, which is a sample of the hash space."""

    def done():
        over = total / max(1.0, total.mean())
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(np.where(over < 2, 0, np.log2(np.maximum(over, 1))).astype(np.uint8))], pa.binary())], ["slice", "level"])

    at, total = None, None
    for batch in batches:
        for k, n in zip(batch.column("slice").to_pylist(), batch.column("n")):
            if k != at:
                if at is not None:
                    yield done()
                at, total = k, np.zeros(SLICE, np.int64)
            total += unpacked(n.as_py(), np.uint32, SLICE)
    if at is not None:
        yield done()


def frequency_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each bucket of shingles 0, or how many times over the mean it is counted, as a power of two from 2 times on."""
    rows = docs.select("text").mapInArrow(bucket_counts(size), "slice int, n binary").repartition("slice").sortWithinPartitions("slice").mapInArrow(slice_levels, "slice int, level binary").toArrow()
    levels = np.zeros(BUCKETS, np.uint8)
    for k, level in zip(rows.column("slice").to_pylist(), rows.column("level").to_pylist()):
        levels[k * SLICE : (k + 1) * SLICE] = unpacked(level, np.uint8, SLICE)
    return levels


def sketches(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit words of a set: of each SKETCH-th part of the hash space one bit of the smallest member."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    part = (x >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64)
    first = np.ones(len(x), bool)
    first[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    bit = (mixed(x[first]) >> np.uint64(63)).astype(np.uint8)
    bits = np.zeros((n, SKETCH), np.uint8)
    bits[row[first], part[first]] = bit
    return np.packbits(bits, axis=1).view(np.uint64)


PARTS = [f"s{i}" for i in range(SKETCH // 64)]
MET = "k long, kind byte, doc long, n int, " + ", ".join(f"{c} long" for c in PARTS)


def tokens(levels: np.ndarray, size: int, least: int):
    def batch_of(k, kind, doc, n, first=0, sketch=None):
        full = lambda v, t: pa.array(np.broadcast_to(v, len(doc)).astype(t))
        return pa.RecordBatch.from_arrays([pa.array(signed(np.ascontiguousarray(k))), full(kind, np.int8), pa.array(doc), full(n, np.int32), *(full(x, np.int64) for x in ([first] + [0] * (len(PARTS) - 1) if sketch is None else sketch.T))], ["k", "kind", "doc", "n", *PARTS])

    sent = packed(levels)  # nearly all are 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = unpacked(sent, np.uint8, BUCKETS)
        for batch in steps(batches, "text"):
            batch = batch.filter(batch.column("doc_id").is_valid())
            if not batch.num_rows:
                continue
            x, bounds = sets(batch.column("text"), size)
            doc, n = batch.column("doc_id").to_numpy(), np.diff(bounds)
            yield batch_of(mixed(doc.view(np.uint64)), DOCUMENT, doc, n)
            # equal sets: the smallest doc_id goes on
            digest = [xxhash.xxh3_128_digest(x[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            first: dict[bytes, int] = {}
            for i in np.argsort(doc, kind="stable").tolist():
                if n[i]:
                    first.setdefault(digest[i], i)
            on = np.array(sorted(first.values()), np.int64)
            same = np.array([i for i in range(len(doc)) if n[i] and doc[first[digest[i]]] != doc[i]], np.int64)
            other = doc[np.array([first[digest[i]] for i in same.tolist()], np.int64)] if len(same) else doc[:0]
            yield batch_of(mixed(doc[same].view(np.uint64)), LINK, doc[same], 0, other)
            row = np.repeat(np.arange(len(n)), n)
            live = np.zeros(len(n), bool)
            live[on] = True
            sketch = sketches(x, bounds).view(np.int64)
            pick = live[row]
            y, row = x[pick], row[pick]
            # frequent shingles last, the others by hash; x is ascending already
            order = np.lexsort((levels[(mixed(y) % np.uint64(BUCKETS)).astype(np.int64)], row))
            y, row = y[order], row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            head = place < n[row] - -(-least * n[row] // 100) + 1
            y, row = y[head], row[head]
            yield batch_of(y, TOKEN, doc[row], n[row], sketch=sketch[row])

    return run


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).astype(np.uint64)).sum(-1)  # of signed numbers it would count the absolute value


def allowed(n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """How many sketch bits may differ between sets of n and m that link: no more than members do, a strict bound, and of large sets
    no more than DEVIATIONS over the mean at this similarity."""
    p = (100 - least) / 200
    most = math.ceil(SKETCH * p + DEVIATIONS * math.sqrt(SKETCH * p * (1 - p)))
    return np.minimum(most, ((100 - least) * (n + m)) // (100 + least))


def could_link(n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= least * np.maximum(n, m)


def candidates(doc: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Links of a graph in which all that could link is connected."""
    rest, out = np.arange(len(doc)), []
    centres, radius, small, large = [], [], [], []
    while len(rest):
        c = rest[0]
        far = differ(sketch[rest], sketch[c])
        r = int(allowed(n[c], n[c], least)) // 8
        ball = far <= r
        own = rest[ball]
        out += [(int(doc[i]), int(doc[c])) for i in own[1:]]
        centres.append(c)
        radius.append(r)
        small.append(n[own].min())
        large.append(n[own].max())
        rest = rest[~ball]
    c, r, lo, hi = (np.array(x) for x in (centres, radius, small, large))
    label = np.arange(len(c))
    for i in range(len(c) - 1):
        j = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        near = differ(sketch[c[j]], sketch[c[i]]) <= allowed(hi[j], hi[i], least) + r[j] + r[i]
        near &= (100 * hi[j] >= least * lo[i]) & (100 * hi[i] >= least * lo[j])
        for k in j[near].tolist():
            if label[k] != label[i]:
                out.append((int(doc[c[k]]), int(doc[c[i]])))
                label[label == label[k]] = label[i]
    return out


def few_links(first: np.ndarray, size: np.ndarray, n: np.ndarray, sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of up to FEW documents, rows first[i] to first[i] + size[i]: -> rows a, b of the links of those that lie in the ball of their
    first document, and the groups that candidates() has to look at. Groups without a pair that could link are neither."""
    row = np.repeat(first, size)
    at = row + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = differ(sketch[at], sketch[row]) > allowed(n[row], n[row], least) // 8
    ball = np.bincount(np.repeat(np.arange(len(size)), size), out, len(size)) == 0
    own = np.repeat(ball, size) & (at > row)
    open_ = np.zeros(len(size), bool)
    for m in np.unique(size[~ball]).tolist():
        which = np.flatnonzero(~ball & (size == m))
        i, j = np.triu_indices(m, 1)
        a, b = first[which][:, None] + i, first[which][:, None] + j
        open_[which] = (could_link(n[a], n[b], least) & (differ(sketch[a], sketch[b]) <= allowed(n[a], n[b], least))).any(1)
    return at[own], row[own], np.flatnonzero(open_)


def met(least: int):
    """Sorted by kind and k: documents and links pass, and the documents of a shingle become a forest of candidates."""

    def done(x):
        k, doc, n, sketch = x[0], x[1], x[2], x[3:].T
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.append(first, len(k)))
        two = first[size == 2]
        ok = could_link(n[two], n[two + 1], least) & (differ(sketch[two], sketch[two + 1]) <= allowed(n[two], n[two + 1], least)) & (doc[two] != doc[two + 1])
        pairs = [np.stack([doc[two], doc[two + 1]], 1)[ok]]
        few = np.flatnonzero((size > 2) & (size <= FEW))
        a, b, rest = few_links(first[few], size[few], n, sketch, least)
        pairs.append(np.stack([doc[a], doc[b]], 1))
        rest = np.concatenate([few[rest], np.flatnonzero(size > FEW)])
        for a, m in zip(first[rest].tolist(), size[rest].tolist()):
            found = candidates(doc[a : a + m], n[a : a + m], sketch[a : a + m], least)
            if found:
                pairs.append(np.array(found))
        p = np.concatenate(pairs)
        p = np.unique(np.sort(p, 1), axis=0) if len(p) else p
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p), np.int8)), pa.array(p[:, 0]), pa.array(p[:, 1])], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            if (kind != TOKEN).any():
                own = batch.filter(pa.array(kind != TOKEN))
                is_doc = own.column("kind").to_numpy() == DOCUMENT
                yield pa.RecordBatch.from_arrays([own.column("kind"), own.column("doc"), pa.array(np.where(is_doc, own.column("n").to_numpy(), own.column("s0").to_numpy()))], ["kind", "a", "b"])
            x = np.stack([batch.column(c).to_numpy()[kind == TOKEN].astype(np.int64) for c in ("k", "doc", "n", *PARTS)])
            if not x.shape[1]:
                continue
            if held and held[-1][0, -1] == x[0, -1]:
                held.append(x)
                continue
            last = np.searchsorted(x[0], x[0, -1])
            whole = np.concatenate([*held, x[:, :last]], 1)
            held = [x[:, last:]]
            if whole.shape[1]:
                yield done(whole)
        if held:
            yield done(np.concatenate(held, 1))

    return run


TILED = "g long, band int, i int, j int, block int, below boolean, doc long, x binary"


def arrays(size: int, most: int = BATCH_BYTES):
    """Each set once for each of its tiles, of which there can be many: no batch holds all copies of its texts' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            x, bounds = sets(batch.column("text"), size)
            tiles, doc = batch.column("tiles"), batch.column("doc_id").to_numpy()
            count = np.diff(tiles.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), count)
            raw = [x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            flat = tiles.flatten()
            upto = np.cumsum(8 * np.diff(bounds)[row])
            edges = [0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(row)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    own = row[a:b]
                    yield pa.RecordBatch.from_arrays([*(flat.field(c).slice(a, b - a) for c in ("g", "band", "i", "j", "block", "below")), pa.array(doc[own]), pa.array([raw[r] for r in own.tolist()], pa.binary())], ["g", "band", "i", "j", "block", "below", "doc", "x"])

    return run


def overlap_needed(n: np.ndarray, m: int, least: int) -> np.ndarray:
    return -(-least * (n + m) // (100 + least))


def bitmaps(xs: list[np.ndarray]) -> np.ndarray:
    """A row of hashed bits for each set, about four bits a member of the largest."""
    width = 1 << max(6, (4 * max(len(x) for x in xs) - 1).bit_length())
    out = np.zeros((len(xs), width // 8), np.uint8)
    for i, x in enumerate(xs):
        at = (mixed(x) & np.uint64(width - 1)).astype(np.int64)
        np.bitwise_or.at(out[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def tile_links(doc: list[int], xs: list[np.ndarray], block: list[int], below: list[bool], cross: bool, least: int) -> list[tuple[int, int]]:
    """Spanning links of a tile. cross: only pairs of different blocks; two documents of the band below are never compared."""
    n = np.array([len(x) for x in xs])
    order = np.argsort(n, kind="stable")
    n, xs, doc = n[order], [xs[i] for i in order], [doc[i] for i in order]
    block, below = np.array(block)[order], np.array(below)[order]
    maps, label, out = bitmaps(xs), np.arange(len(xs)), []
    for i in range(len(xs) - 1):
        to = np.searchsorted(n, n[i] * 100 // least, "right")
        j = np.arange(i + 1, to)
        j = j[(label[j] != label[i]) & ~(below[j] & below[i])]
        if cross:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        need = overlap_needed(n[j], int(n[i]), least)
        most = n[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(1)
        j, need = j[most >= need], need[most >= need]
        most = n[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(1)
        for k, t in zip(j[most >= need].tolist(), need[most >= need].tolist()):
            if label[k] == label[i]:
                continue
            a, b = xs[i], xs[k]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if int((b[at] == a).sum()) >= t:
                out.append((doc[i], doc[k]))
                label[label == label[k]] = label[i]
    return out


def verified(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done():
            if len(held) < 2:
                return
            doc, x, block, below = zip(*held)
            links = tile_links(list(doc), [np.frombuffer(b, np.uint64) for b in x], list(block), list(below), at[2] != at[3], least)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("g", "band", "i", "j")))
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("doc", "x", "block", "below")))):
                if key != at:
                    yield from done()
                    at, held = key, []
                held.append(row)
        yield from done()

    return run


def tiles_of(members: DataFrame, least: int) -> DataFrame:
    """members (doc, g, n) -> doc_id, tiles: where each document is compared."""
    counted = members.join(members.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("t")), "g")
    whole = F.struct(F.lit(-1).alias("band"), F.lit(False).alias("below"))
    home = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / least))).cast("int")
    bands = F.array(F.struct(home.alias("band"), F.lit(False).alias("below")), F.struct((home + 1).alias("band"), F.lit(True).alias("below")))
    placed = counted.withColumn("b", F.explode(F.when((F.col("m") <= SMALL) & (F.col("t") <= MEMBERS), F.array(whole)).otherwise(bands))).select("doc", "g", "n", "b.band", "b.below")
    blocks = placed.groupBy("g", "band").agg(F.least(F.count("*"), F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / MEMBERS))).cast("int").alias("q"), F.sum(F.when(F.col("below"), 0).otherwise(1)).alias("own")).filter("own > 0").drop("own")
    placed = placed.join(blocks, ["g", "band"]).withColumn("block", F.pmod(F.hash("doc"), F.col("q")).cast("int"))
    one = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    tile = F.struct("g", "band", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "below")
    return one.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(tile).alias("tiles"))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    docs = docs.select("doc_id", "text")
    levels = frequency_levels(docs, size)
    meeting = docs.mapInArrow(tokens(levels, size, least), MET).repartition("k").sortWithinPartitions("kind", "k").mapInArrow(met(least), "kind byte, a long, b long")
    found = written(meeting)
    sizes = found.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc"), F.col("b").alias("n"))
    groups = connected_components(found.filter(F.col("kind") == TOKEN))
    members = written(groups.select(F.col("node").alias("doc"), F.col("component").alias("g")).join(sizes.groupBy("doc").agg(F.max("n").alias("n")), "doc"))
    # merged at every size: what is broadcast would grow with the documents
    tiled = docs.join(tiles_of(members, least).hint("merge"), "doc_id").mapInArrow(arrays(size), TILED)
    links = tiled.repartition("g", "band", "i", "j").sortWithinPartitions("g", "band", "i", "j", "doc").mapInArrow(verified(least), "a long, b long")
    comps = connected_components(links.union(found.filter(F.col("kind") == LINK).select("a", "b")))
    out = sizes.withColumnRenamed("doc", "node").join(comps, "node", "left").select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    lone = docs.filter("doc_id is null").mapInArrow(set_sizes(size), "doc_id long, n_shingles long").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lone)


def set_sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(sets(batch.column("text"), size)[1]), pa.int64())], ["doc_id", "n_shingles"])

    return run


def distinct_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each component, the smallest doc_id, and all their columns."""
    comps = jaccard_components(docs, **how)
    later = comps.filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, (len(w) - 1)::BIGINT), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.node WHERE r.comp < l.b),
c AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""
