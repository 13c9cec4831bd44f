"""Language-model scoring with a log-frequency Bloom filter.

Every bigram of the training documents is put into a Bloom filter once for each level of its count, a level being a power of two;
asking for level 1, 2, ... until a level is missing gives the count back, quantised. The filter has BITS bits an entry and so
grows with the corpus; it is cut by hash into segments, whose number follows from the bytes of the texts alone (SEGMENT_BYTES of
text a segment), so the bits, and with them the scores, do not depend on how the work is dealt out. A filter of at most PART_BYTES
is broadcast to the workers. A larger one stays where its segments were built: the chunks' pairs are sent to their segments,
probed there, and the levels sent back, which is one more exchange, linear in the corpus, and gives the same levels. Word counts
are exact, by a join on words.

Documents are read once: each step of a task becomes a chunk (its documents as codes of the chunk's own words), the counts of its
distinct words and of its distinct bigrams, in compressed arrays by hash segment. What is exchanged are these arrays. A step takes
CHUNK_BYTES of text, which bounds a worker's memory. A chunk's words are numbered by segment and hash, so counts come back to it in
the order of its words, without their numbers; ascending arrays are stored as differences, and all arrays byte by byte.

The model: (q + STRENGTH * p(w)) / (c(v) + STRENGTH) for word w after v, with q the lower edge of the bigram's level, c the word
counts and p the smoothed word probability of the base score; texts begin after a start mark and end with an end mark. As q is
the lower edge, probabilities after a word add up to 1 at most (but for false hits of the filter, about one in eighty look-ups);
what quantising takes away is not spread over other words.

Defined cases: a null text is empty and has the end mark only; a null doc_id counts as training; rows that repeat a doc_id are
documents of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import hashed_words, mixed, split_words, steps, table, written

BITS, PROBES, PART_BYTES, STRENGTH = 10, 4, 128 << 20, 100.0
SEGMENT_BYTES, LEAST_SEGMENTS = 128 << 20, 64
#: Text of a chunk, and what Arrow hands to a worker at once: a little less, so that a batch is a chunk.
CHUNK_BYTES, BATCH_BYTES = 4_000_000, 3_500_000
MOST = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Hashes of the marks; word hashes are 64 bits and don't meet them in practice.
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
CHUNK, WORDS, PAIRS, COUNTS, TOTAL, ASKED, LEVELS = range(7)
ROW = "kind byte, k long, seg int, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, compressed: ascending ones as differences, and of all first the lowest bytes, then the next ones, and so on."""
    head, parts = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        rising = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        flat = np.concatenate([a[:1], a[1:] - a[:-1]]) if rising else np.ascontiguousarray(a)
        parts.append(pa.compress(flat.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), codec="zstd", asbytes=True))
        head.append(struct.pack("<QQB", len(parts[-1]), a.nbytes, rising))
    return b"".join(head + parts)


def unpacked(data: bytes | pa.Buffer, *types) -> list[np.ndarray]:
    data = memoryview(data)
    at, out = 1 + 17 * data[0], []
    for i, t in enumerate(map(np.dtype, types)):
        size, full, rising = struct.unpack_from("<QQB", data, 1 + 17 * i)
        raw = pa.decompress(data[at : at + size], decompressed_size=full, codec="zstd") if full else b""
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(t.itemsize, -1).T).view(t).ravel()
        out.append(np.cumsum(a, dtype=t) if rising else a)
        at += size
    return out


def batch_of(kind: int, k: list, seg: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(k), pa.int8()), pa.array(k, pa.int64()), pa.array(seg, pa.int32()), pa.array(data, pa.binary())], ["kind", "k", "seg", "data"])


def pairs_of(h: np.ndarray, prev: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(prev * np.uint64(0x9E3779B97F4A7C15) + h)


def segment_of(x: np.ndarray, segments: int) -> np.ndarray:
    """The segment of words and pairs by their hashes."""
    return (x >> np.uint64(40)) % np.uint64(segments)


def by_segment(x: np.ndarray, segments: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Hashes -> their order by segment and `within` it (without: as they come), where each segment starts in it, and those that hold any."""
    seg = segment_of(x, segments)
    order = np.argsort(seg, kind="stable") if within is None else np.lexsort((within, seg))
    at = np.searchsorted(seg[order], np.arange(segments + 1))
    return order, at, np.flatnonzero(np.diff(at)).tolist()


def held_out(doc_ids: list) -> np.ndarray:
    return np.array([d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d in doc_ids], bool)


def context(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[starts] = START
    return prev


def chunks(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in steps(batches, "text", CHUNK_BYTES):
            bounds, words = split_words(batch.column("text"), lower=True)
            coded = words.dictionary_encode()
            names = np.append(hashed_words(coded.dictionary)[0], END)
            order, at, full = by_segment(names, segments, names)
            names, place = names[order], np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            n = np.diff(bounds)
            code = np.full(len(words) + len(n), place[-1], np.int32)
            code[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = place[coded.indices.to_numpy(zero_copy_only=False)]
            cuts = bounds + np.arange(len(bounds))
            ids = batch.column("doc_id").to_pylist()
            train = np.repeat(~held_out(ids), n + 1)
            yield batch_of(CHUNK, [number], [-1], [packed(np.array([d or 0 for d in ids], np.int64), np.array([d is None for d in ids], np.uint8), cuts, code, names)])
            count = np.bincount(code[train], minlength=len(names)).astype(np.uint32)
            yield batch_of(WORDS, [number] * len(full), full, [packed(names[at[s] : at[s + 1]], count[at[s] : at[s + 1]]) for s in full])
            h = names[code]
            pair, times = np.unique(pairs_of(h, context(h, cuts[:-1]))[train], return_counts=True)
            low = pair.astype(np.uint32)
            order, at, full = by_segment(pair, segments, low)
            yield batch_of(PAIRS, [number] * len(full), full, [packed(low[o], times[o].astype(np.uint32)) for s in full for o in [order[at[s] : at[s + 1]]]])
            number += 1

    return run


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, int, int, pa.Buffer]]]]:
    """Rows (kind, k, seg, data) that follow each other with one key; their data is not copied."""
    at, held = None, []
    for batch in batches:
        for g, kind, k, seg, data in zip(*(batch.column(c).to_pylist() for c in (key, "kind", "k", "seg")), batch.column("data")):
            if g != at:
                if held:
                    yield at, held
                at, held = g, []
            held.append((kind, k, seg, data.as_buffer()))
    if held:
        yield at, held


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of all chunks in a segment -> the sums, to each chunk in the order of its own words; and the segment's own sums."""
    for seg, held in groups(batches, "seg"):
        parts = [unpacked(data, np.uint64, np.uint32) for *_, data in held]
        seen, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.zeros(len(seen), np.uint64)
        np.add.at(total, which, np.concatenate([p[1] for p in parts]).astype(np.uint64))
        edges = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        yield batch_of(COUNTS, [k for _, k, _, _ in held], [seg] * len(held), [packed(total[which[a:b]]) for a, b in zip(edges, edges[1:])])
        yield batch_of(TOTAL, [int((total > 0).sum())], [seg], [str(int(total.sum())).encode()])


def levels_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(count.astype(np.float64))[1]


def probe_places(pair: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bits of a segment of `size` bits that stand for a pair at a level. pair: its low 32 bits."""
    with np.errstate(over="ignore"):
        a = mixed(pair.astype(np.uint64) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = mixed(a) | np.uint64(1)
        for i in range(PROBES):
            yield ((a + np.uint64(i) * b) >> np.uint64(11)) % np.asarray(size, np.uint64)


def filters(bits_each: int):
    """The bits of each segment; k is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, held in groups(batches, "seg"):
            parts = [unpacked(data, np.uint32, np.uint32) for *_, data in held]
            pair, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            level = levels_of(np.bincount(which, np.concatenate([p[1] for p in parts])))
            size = -(-int(level.sum()) * bits_each // 64) * 64
            bits = np.zeros(size, np.uint8)
            for j in range(1, int(level.max()) + 1):
                for place in probe_places(pair[level >= j], j, size):
                    bits[place] = 1
            yield batch_of(PAIRS, [size], [seg], [np.packbits(bits, bitorder="little").tobytes()])

    return run


class Filter:
    """Some segments of the filter, read-only."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.size = np.zeros(segments, np.int64)
        self.base = np.zeros(segments, np.int64)
        at, data = 0, []
        for seg, bits in parts.items():
            self.base[seg], self.size[seg] = at, 8 * len(bits)
            at += 8 * len(bits)
            data.append(np.frombuffer(bits, np.uint8))
        self.bits = np.concatenate(data) if data else np.empty(0, np.uint8)

    def levels(self, pair: np.ndarray) -> np.ndarray:
        """The quantised count of each pair (whole 64-bit hashes) whose segment is here, as its level; 0 for none."""
        seg = segment_of(pair, len(self.size)).astype(np.int64)
        out, live, j = np.zeros(len(pair), np.int64), np.flatnonzero(self.size[seg] > 0), 1
        low = (pair & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        while len(live):
            on = np.ones(len(live), bool)
            for place in probe_places(low[live], j, self.size[seg[live]]):
                place = place.astype(np.int64) + self.base[seg[live]]
                on &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live = live[on]
            out[live] = j
            j += 1
        return out


def decoded(chunk: bytes | pa.Buffer) -> tuple[np.ndarray, ...]:
    """doc_ids, which are null, bounds, the hash of every token, of its pair with the one before, and the chunk's words."""
    ids, null, cuts, code, names = unpacked(chunk, np.int64, np.uint8, np.int64, np.int32, np.uint64)
    h = names[code]
    return ids, null, cuts, code, names, pairs_of(h, context(h, cuts[:-1]))


def asked(segments: int):
    """Chunks -> their distinct pairs, ascending, and where they stand among them, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "k"):
            for _, k, _, chunk in held:
                pair = np.unique(decoded(chunk)[-1])
                order, at, full = by_segment(pair, segments)
                yield batch_of(ASKED, [k] * len(full), full, [packed(pair[o], o.astype(np.uint32)) for s in full for o in [order[at[s] : at[s + 1]]]])

    return run


def probed(segments: int):
    """A segment's bits, then the pairs that chunks ask for -> their levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        for batch in batches:
            for seg, kind, k, data in zip(*(batch.column(c).to_pylist() for c in ("seg", "kind", "k", "data"))):
                if kind == PAIRS:
                    at, found = seg, Filter(segments, {seg: data})
                    continue
                pair, place = unpacked(data, np.uint64, np.uint32)
                level = found.levels(pair) if seg == at else np.zeros(len(pair), np.int64)  # a segment that holds nothing
                some = level > 0
                yield batch_of(LEVELS, [k], [seg], [packed(place[some], level[some].astype(np.uint8))])

    return run


def scored(part, segments: int, n_train: int, n_distinct: int, n_docs: int):
    """Chunks with the counts of their words, together by chunk -> a row for each document. `part` broadcasts a Filter; without one
    the levels of the chunk's pairs come with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches, "k"):
            ids, null, cuts, code, names, pair = decoded(next(data for kind, *_, data in held if kind == CHUNK))
            count, own = np.zeros(len(names)), np.searchsorted(segment_of(names, segments), np.arange(segments + 1))
            distinct, which = np.unique(pair, return_inverse=True)
            level = np.zeros(len(distinct), np.int64) if part is None else part.value.levels(distinct)
            for kind, _, seg, data in held:
                if kind == COUNTS:
                    count[own[seg] : own[seg + 1]] = unpacked(data, np.uint64)[0]
                elif kind == LEVELS:
                    at, found = unpacked(data, np.uint32, np.uint8)
                    level[at] = found
            starts = cuts[:-1]
            c = count[code]
            word = (c + 1) / (n_train + n_distinct + 1)
            before = np.empty(len(c))
            before[1:] = c[:-1]
            before[starts] = n_docs
            level = level[which]
            q = np.where(level > 0, 2.0 ** (level - 1), 0.0)
            q = np.minimum(q, np.minimum(before, c))  # a pair is no more frequent than its words
            log = np.log10((q + STRENGTH * word) / (before + STRENGTH))
            add = lambda x: np.add.reduceat(x, starts)
            doc_ids = pa.array(ids, mask=null.astype(bool))
            out = held_out(doc_ids.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(out), pa.array(np.diff(cuts)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(ids), n_train)), pa.array(add(np.log10(word))), pa.array(add(log))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def segments_for(size: int) -> int:
    """A power of two that grows with the bytes of the texts."""
    out = LEAST_SEGMENTS
    while out * SEGMENT_BYTES < size:
        out *= 2
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are planned and run inside hold BATCH_BYTES of rows at once, not whole tasks; the setting comes back."""
    before = spark.conf.get(MOST)
    spark.conf.set(MOST, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(MOST, before)


def score_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    n_docs, size = docs.agg(F.count(F.when(training, 1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    segments = segments_for(size)
    of = lambda kind: base.filter(F.col("kind") == kind)
    with small_batches(spark):
        base = written(docs.select("doc_id", "text").mapInArrow(chunks(segments), ROW))
        counts = written(of(WORDS).repartition("seg").sortWithinPartitions("seg").mapInArrow(totals, ROW))
        built = written(of(PAIRS).repartition("seg").sortWithinPartitions("seg").mapInArrow(filters(bits), ROW))
    sums = counts.filter(F.col("kind") == TOTAL).select(F.sum("k"), F.sum(F.col("data").cast("string").cast("long"))).first()
    n_distinct, n_train = int(sums[0] or 0), int(sums[1] or 0)
    together, part = of(CHUNK).unionByName(counts.filter(F.col("kind") == COUNTS)), None
    if (built.agg(F.sum("k")).first()[0] or 0) <= 8 * PART_BYTES:
        got = built.select("seg", "data").toArrow()
        part = spark.sparkContext.broadcast(Filter(segments, dict(zip(got.column("seg").to_pylist(), got.column("data").to_pylist()))))
    else:
        asking = of(CHUNK).mapInArrow(asked(segments), ROW)
        together = together.unionByName(built.unionByName(asking).repartition("seg").sortWithinPartitions("seg", "kind").mapInArrow(probed(segments), ROW))
    return together.repartition("k").sortWithinPartitions("k", "kind").mapInArrow(scored(part, segments, n_train, n_distinct, n_docs), SCORES)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
