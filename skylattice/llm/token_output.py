"""Token ids in a word-aligned binary format (Simple-8b).

Each 64-bit word holds a 4-bit selector and as many ids of one width as fit in 60 bits; selector 0 is the escape, after which a
whole word holds one larger number. A block is a run of documents with their ids, numbers of ids and word offsets (of
every SEGMENT ids of a document, which start on a word of their own) in front, so that a reader decodes all words of a selector
at once and can start at any document.

Documents are range-partitioned and sorted by doc_id; every partition writes one file of blocks through Spark's own committer
(binary rows in Parquet, so that any store and lost executors are handled), with its partition number and block number.

Encoding caches the ids of space-delimited pieces: the byte-level pre-tokenizer always cuts before a single space that stands
between other characters, so the ids of ' word' are the same alone. A cached string is found by a hash and then compared byte by
byte, so ids never depend on what a worker has seen. Pieces of letters alone are one piece to the pre-tokenizer and go straight
to the tokenizer's model. Texts with two adjacent white-space characters are given to
the tokenizer whole, and so are texts that hold the content of an added token where such content is one id (`literal=False`,
the library's default and what the query asks for; `literal=True` takes it for plain text).

Defined cases: a null text is empty; a null doc_id comes first; rows that repeat a doc_id follow each other in text order; an
empty table gives no blocks; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice.llm.common import mixed, shared_dir, steps, table
from skylattice.llm.substring_dedup import Sums

#: What a cached string is: a piece with a space before it, one without, or a piece without the marks behind it.
PIECE, HEAD, STEM = 0, 1, 2
MAGIC, END_ID, BLOCK_IDS, SEGMENT, CACHED = b"S8B1", 2, 1 << 17, 512, 1_000_000
#: How many numbers of how many bits each selector from 1 on packs; selector 0 is the escape.
PACKS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([1, *(c for c, _ in PACKS)])
BLOCKS = "part int, seq int, n_docs int, n_ids long, data binary"


def rank_of(values):
    """How many of the widths that PACKS has are too narrow for a number, and one more for 0 bits; of a width: its own place."""
    widths = sorted({b for _, b in PACKS})
    if isinstance(values, int):
        return widths.index(values) + 1
    return sum((values >= np.uint64(1 << b)).astype(np.uint8) for b in [0, *widths])


#: rank_of() of the small numbers.
RANKS = rank_of(np.arange(1 << 17, dtype=np.uint64))


def cut_segments(bounds: np.ndarray) -> np.ndarray:
    """Bounds of the runs that are packed on their own: each document in pieces of SEGMENT numbers."""
    n = -(-np.diff(bounds) // SEGMENT)
    first = np.cumsum(n) - n
    starts = np.repeat(bounds[:-1], n) + SEGMENT * (np.arange(int(n.sum())) - np.repeat(first, n))
    return np.concatenate([starts, bounds[-1:]])


def ahead(m: np.ndarray, by: int) -> np.ndarray:
    """The larger of each place and the one `by` places on."""
    out = m.copy()
    np.maximum(m[:, :-by], m[:, by:], out=out[:, :-by])
    return out


def pack(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values (uint64) in runs values[bounds[i]:bounds[i + 1]] of 1 to SEGMENT numbers -> words, first word of each run and the end.

    All runs advance together: at every place the best selector is known beforehand from sliding maxima of bit widths, over rows
    that are padded with zeros, so that only the chain of jumps is left, one numpy step for a word of every run."""
    lengths = np.diff(bounds)
    if not len(lengths):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    pad = max(c for c, _ in PACKS)
    width = int(lengths.max()) + pad
    flat, bits = np.zeros(len(lengths) * width, np.uint64), np.zeros(len(lengths) * width, np.uint8)
    spot = np.arange(len(values)) + np.repeat(np.arange(len(lengths)) * width - bounds[:-1], lengths)
    flat[spot] = values
    bits[spot] = RANKS[values] if int(values.max()) < len(RANKS) else rank_of(values)
    bits = bits.reshape(len(lengths), width)
    most, kind = {1: bits}, np.zeros(bits.shape, np.uint8)
    for k, (c, b) in sorted(enumerate(PACKS, 1), key=lambda x: x[1][0]):
        p = 1 << (c.bit_length() - 1)
        q = 2
        while q <= p:
            if q not in most:
                most[q] = ahead(most[q // 2], q // 2)
            q *= 2
        m = most[p] if p == c else ahead(most[p], c - p)
        np.copyto(kind, k, where=m <= rank_of(b))
    step = COUNTS.astype(np.int16)[kind]
    at, live, hits = np.zeros(len(lengths), np.int64), np.arange(len(lengths)), []
    while len(live):
        hits.append(live * width + at)
        at = at + step[live, at]
        on = at < lengths[live]
        live, at = live[on], at[on]
    s = np.sort(np.concatenate(hits))
    sel = kind.ravel()[s].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(sel == 0, 2, 1))])
    words = np.zeros(ends[-1], np.uint64)
    for k in np.unique(sel).tolist():
        mine = np.flatnonzero(sel == k)
        if k == 0:
            words[ends[mine] + 1] = flat[s[mine]]
            continue
        c, b = PACKS[k - 1]
        w = np.full(len(mine), k << 60, np.uint64)
        for j in range(c):
            w |= flat[s[mine] + j] << np.uint64(b * j)
        words[ends[mine]] = w
    return words, ends[np.searchsorted(s, np.arange(len(lengths) + 1) * width)]


def unpack(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The inverse of pack(); lengths: numbers in each run."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    escapes = np.flatnonzero(sel == 0)
    if len(escapes):  # a raw word can look like an escape: walk along runs of them
        i = 0
        for e in escapes.tolist():
            if e >= i:
                raw[e + 1], i = True, e + 2
    head = np.flatnonzero(~raw)
    doc = np.searchsorted(first, head, "right") - 1
    count = COUNTS[sel[head]]
    before = np.cumsum(count) - count
    start = np.searchsorted(head, first[:-1])
    base = np.concatenate([before, [count.sum()]])[start]
    within = before - base[doc]
    left = lengths[doc] - within
    to = (np.cumsum(lengths) - lengths)[doc] + within
    out = np.zeros(int(lengths.sum()), np.uint64)
    for k in np.unique(sel[head]).tolist():
        own = sel[head] == k
        c, b = (1, 64) if k == 0 else PACKS[k - 1]
        mask = np.uint64((1 << b) - 1)
        full, last = np.flatnonzero(own & (left >= c)), np.flatnonzero(own & (left < c))
        w = words[head[full] + (k == 0)]
        for j in range(c):
            out[to[full] + j] = (w >> np.uint64(b * j)) & mask
        w = words[head[last]]
        for j in range(int(left[last].max(initial=0))):
            some = left[last] > j
            out[to[last][some] + j] = (w[some] >> np.uint64(b * j)) & mask
    return out


def to_block(doc_ids: list, values: np.ndarray, bounds: np.ndarray) -> bytes:
    words, first = pack(values, cut_segments(bounds))
    ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, struct.pack("<IQ", len(ids), len(words)), ids.tobytes(), null.tobytes(), np.diff(bounds).astype(np.int64).tobytes(), first.astype(np.int64).tobytes(), words.tobytes()])


def from_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """-> doc_ids, ids of all of them, bounds."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n, w = struct.unpack_from("<IQ", data, 4)
    at = 16
    ids = np.frombuffer(data, np.int64, n, at)
    null = np.frombuffer(data, np.uint8, n, at := at + 8 * n)
    lengths = np.frombuffer(data, np.int64, n, at := at + n)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    cuts = cut_segments(bounds)
    first = np.frombuffer(data, np.int64, len(cuts), at := at + 8 * n)
    words = np.frombuffer(data, np.uint64, w, at + 8 * len(cuts))
    doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
    return doc_ids, unpack(words, first, np.diff(cuts)), bounds


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A large_string array's bytes and where each string ends in them, after a leading 0."""
    if not len(strings):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return ends - ends[0], np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def hashed_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of a large_string array, from its buffers: sums of byte values with powers of an odd base. Unequal strings can
    be made to meet, so a hash is for finding only."""
    ends, data = bytes_of(strings)
    with np.errstate(over="ignore"):
        sums = Sums(BYTE_VALUES[data])
    return mixed(sums.of(ends[:-1], ends[1:]) + np.diff(ends).astype(np.uint64))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_letters() -> dict[int, str]:
    """The character by which the byte-level alphabet writes each byte: itself where it is a visible one of Latin-1, else one of
    those from 256 on, in order."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) if b in seen else chr(256 + sum(x not in seen for x in range(b))) for b in range(256) if b != 10}


class Cache:
    """Ids of strings, found by 64-bit hash in sorted arrays, a large and a small one. All ids are in one buffer and the strings
    themselves in another; a hash only finds a place, and a string is known where its bytes and kind are the same. Emptied when
    full."""

    def __init__(self):
        self.parts = [(np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4)))] * 2
        self.flat, self.text = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def find(self, h: np.ndarray, strings: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """-> place in `flat` (-1: unknown) and number of ids."""
        order = np.argsort(h)  # sorted look-ups stay near each other
        h = h[order]
        at, n, start, form = np.full(len(h), -1), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for keys, *found in self.parts:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[i] == h
                for to, what in zip((at, n, start, form), found):
                    to[ok] = what[i[ok]]
        back = np.empty(len(h), np.int64)
        back[order] = np.arange(len(h))
        at, n, start, form = at[back], n[back], start[back], form[back]
        ends, data = bytes_of(strings)
        size = np.diff(ends)
        there = np.flatnonzero((at >= 0) & (form == 4 * size + kind))
        same = gathered(self.text, start[there], size[there]) == gathered(data, ends[:-1][there], size[there])
        wrong = np.searchsorted(np.cumsum(size[there]), np.flatnonzero(~same), "right")
        known = np.zeros(len(at), bool)
        known[there] = True
        known[there[wrong]] = False
        at[~known] = -1
        return at, n

    def add(self, h: np.ndarray, strings: pa.Array, kind: int, new: np.ndarray, n: np.ndarray) -> np.ndarray:
        """new: the ids of all strings, n: their numbers. -> their places."""
        place = len(self.flat) + np.cumsum(n) - n
        ends, data = bytes_of(strings)
        start, form = len(self.text) + ends[:-1], 4 * np.diff(ends) + kind
        self.flat, self.text = np.concatenate([self.flat, new]), np.concatenate([self.text, data])
        big, small = self.parts
        small = self.merged(small, (h, place, n, start, form))
        if len(small[0]) > 150_000:
            big, small = self.merged(big, small), tuple(x[:0] for x in small)
        self.parts = [big, small]
        return place

    @staticmethod
    def merged(a, b):
        both = [np.concatenate(x) for x in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def __len__(self) -> int:
        return sum(len(k) for k, *_ in self.parts)


def gathered(flat: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[place[i]:place[i] + size[i]] one after the other."""
    upto = np.cumsum(size)
    shift = (place - (upto - size)).astype(np.int32 if len(flat) + int(size.sum()) < 1 << 31 else np.int64)
    return flat[np.repeat(shift, size) + np.arange(int(upto[-1]) if len(upto) else 0, dtype=shift.dtype)]


def joined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*parts))


class Encoder:
    """Whole texts to ids, with a bounded cache of the ids of space-delimited pieces."""

    #: Two adjacent white-space characters, by any reading of white space.
    LOOSE = r"[\s\v\p{Z}\x{85}\x{1c}-\x{1f}]{2}"

    #: Characters that are neither letters, digits nor white space.
    MARKS = ".,!?;:#$%&*|\"')]}…-"
    BARE = re.compile(r" ?\S+").fullmatch
    #: Letters of any version of Unicode: with a space or none before them they are one piece to the pre-tokenizer.
    LETTERS = r"^ ?[A-Za-zÀ-ÖØ-öø-ʯ]+$"

    def __init__(self, path: str, literal: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), Cache()
        self.tokenizer.encode_special_tokens = literal
        self.model, self.letters = self.tokenizer.model, byte_letters()
        #: Where the pipeline is the byte-level one alone, the model can be asked for single pieces.
        parts = json.loads(self.tokenizer.to_str())
        plain = parts["pre_tokenizer"] or {}
        self.direct = parts["normalizer"] is None and plain.get("type") == "ByteLevel" and plain.get("use_regex", True) and not plain.get("add_prefix_space", True)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: What may not be cut into pieces; any case where a token is matched on normalised text.
        self.added = [(t.content, t.normalized) for t in added if not (literal and t.special)]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """-> ids of all pieces and their numbers. Pieces without inner white space go as lines of one text, since a line feed
        between such pieces is always a token of its own."""
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        fed = np.array([x[:1] == "\n" and self.BARE(x[1:]) is not None and x[1] != " " for x in strings], bool)
        if fed.any():  # a line feed, then a piece
            rest, n = self.pieces([x[1:] if f else x for x, f in zip(strings, fed.tolist())])
            flat = np.append(rest, np.uint32(line))
            place, size = np.full((len(strings), 2), len(rest)), np.zeros((len(strings), 2), np.int64)
            place[:, 1], size[:, 1], size[fed, 0] = np.cumsum(n) - n, n, 1
            return gathered(flat, place.ravel(), size.ravel()), size.sum(1)
        bare = np.array([self.BARE(x) is not None for x in strings], bool)
        plain, rest = np.flatnonzero(bare), np.flatnonzero(~bare)
        n, parts = np.zeros(len(strings), np.int64), []
        for a in range(0, len(plain), 5000):
            some = plain[a : a + 5000]
            ids = np.array(self.whole(["\n".join([strings[i] for i in some.tolist()])])[0], np.uint32)
            ends = np.append(np.flatnonzero(ids == line), len(ids))
            n[some] = np.diff(np.concatenate([[-1], ends])) - 1
            parts.append(ids[ids != line])
        others = self.whole([strings[i] for i in rest.tolist()])
        n[rest] = [len(x) for x in others]
        flat = np.concatenate([np.empty(0, np.uint32), *parts, *(np.array(x, np.uint32) for x in others)])
        order = np.concatenate([plain, rest])
        start = np.zeros(len(strings), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return gathered(flat, start, n), n

    def words(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As pieces(); pieces of LETTERS go straight to the model."""
        one = pc.match_substring_regex(strings, self.LETTERS).to_numpy(zero_copy_only=False) if self.direct else np.zeros(len(strings), bool)
        own, rest = np.flatnonzero(one), np.flatnonzero(~one)
        ids, n = self.pieces(strings.take(pa.array(rest)).to_pylist())
        if not len(own):
            return ids, n
        names = "\n".join(strings.take(pa.array(own)).to_pylist()).encode().decode("latin-1").translate(self.letters).split("\n")
        parts, counts = [], []
        for a in range(0, len(names), 20_000):
            tokens = list(map(self.model.tokenize, names[a : a + 20_000]))
            counts.append(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            parts.append(np.fromiter([t.id for word in tokens for t in word], np.uint32, int(counts[-1].sum())))
        own_ids, own_n = np.concatenate(parts), np.concatenate(counts)
        size, place = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        size[own], size[rest] = own_n, n
        place[own], place[rest] = np.cumsum(own_n) - own_n, len(own_ids) + np.cumsum(n) - n
        return gathered(np.concatenate([own_ids, ids]), place, size), size

    def stemmed(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """-> ids of all strings, and their numbers. Marks behind a letter or digit are always tokens of
        their own, so only distinct stems that are not known yet are encoded."""
        stems = pc.utf8_rtrim(strings, self.MARKS)
        cut = pc.match_substring_regex(stems, r"[\p{L}\p{N}]$").to_numpy(zero_copy_only=False) & pc.not_equal(stems, strings).to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(cut)
        stem = pc.if_else(pa.array(cut), stems, strings).dictionary_encode()
        code, names = stem.indices.to_numpy(zero_copy_only=False).astype(np.int64), stem.dictionary
        h = mixed(hashed_strings(names) + np.uint64(STEM))  # kept apart from the pieces that encode() looks up
        at, n = self.cache.find(h, names, STEM)
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = names.take(pa.array(new))
            ids, n[new] = self.words(unknown)
            at[new] = self.cache.add(h[new], unknown, STEM, ids, n[new])
        tails = pc.utf8_slice_codeunits(strings.take(pa.array(marked)), 0)
        lengths = pc.utf8_length(stems.take(pa.array(marked))).to_pylist()
        tails = pa.array([x[k:] for x, k in zip(tails.to_pylist(), lengths)], pa.large_string()).dictionary_encode()
        tail_ids, tail_n = self.pieces(tails.dictionary.to_pylist())
        flat = np.concatenate([self.cache.flat, tail_ids])
        places = len(self.cache.flat) + np.cumsum(tail_n) - tail_n
        which = tails.indices.to_numpy(zero_copy_only=False)
        place, size = np.zeros((len(strings), 2), np.int64), np.zeros((len(strings), 2), np.int64)
        place[:, 0], size[:, 0] = at[code], n[code]
        place[marked, 1], size[marked, 1] = places[which], tail_n[which]
        return gathered(flat, place.ravel(), size.ravel()), size.sum(1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """-> ids of all texts, each with end_id behind it, and bounds."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        loose = pc.match_substring_regex(texts, self.LOOSE).to_numpy(zero_copy_only=False)
        for content, any_case in self.added:
            loose = loose | pc.match_substring(texts, content, ignore_case=any_case).to_numpy(zero_copy_only=False)
        own = np.flatnonzero(loose)
        plain = pc.if_else(pa.array(loose), "", texts)
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")  # a piece that starts with a line feed has no space before it
        pieces = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(pieces)])
        coded = parts.flatten().dictionary_encode()
        code, seen = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        heads, head_code = np.unique(code[cuts[:-1]], return_inverse=True)  # the first pieces have no space before them
        code[cuts[:-1]] = len(seen) + head_code
        h = hashed_strings(seen)
        if len(self.cache) + len(h) + len(heads) > CACHED:
            self.cache = Cache()
        found = []
        for kind, own_h, names in ((PIECE, h, seen), (HEAD, mixed(h[heads] + np.uint64(HEAD)), seen.take(pa.array(heads)))):
            at, n = self.cache.find(own_h, names, kind)
            new = np.flatnonzero(at < 0)
            if len(new):
                unknown = names.take(pa.array(new))
                if kind == HEAD:
                    ids, n[new] = self.words(unknown)
                else:
                    ids, n[new] = self.stemmed(pc.if_else(pc.starts_with(unknown, "\n"), unknown, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), unknown, pa.scalar("", pa.large_string()))))
                at[new] = self.cache.add(own_h[new], unknown, kind, ids, n[new])
            found.append((at, n))
        at, n = joined(*found)
        rest = self.whole([texts[i].as_py() for i in own.tolist()])
        rest_n = np.fromiter(map(len, rest), np.int64, len(rest))
        rest_at = len(self.cache.flat) + 1 + np.cumsum(rest_n) - rest_n
        flat = np.concatenate([self.cache.flat, [end_id], *rest]).astype(np.uint32)
        at, n = np.concatenate([at, rest_at]), np.concatenate([n, rest_n])
        code[cuts[own]] = len(seen) + len(heads) + np.arange(len(own))
        # every text's pieces, then the end
        ends = cuts[1:] + np.arange(len(texts))
        slot = np.arange(len(code)) + np.repeat(np.arange(len(texts)), pieces)
        place, size = np.full(len(code) + len(texts), len(self.cache.flat)), np.ones(len(code) + len(texts), np.int64)
        place[slot], size[slot] = at[code], n[code]
        upto = np.cumsum(size)
        return gathered(flat, place, size), np.concatenate([[0], upto[ends]])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder_of(path: str, literal: bool) -> Encoder:
    """One for each worker process, kept from task to task."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = Encoder(path, literal)
    return _encoders[path, literal]


def blocks_of(tokenizer_path: str, end_id: int, literal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(tokenizer_path, literal), TaskContext.get().partitionId(), 0
        for batch in steps(batches, "text", 9_000_000):
            ids, bounds = encoder.encode(batch.column("text"), end_id)
            doc_ids = batch.column("doc_id").to_pylist()
            cut = np.flatnonzero(np.diff(bounds[:-1] // BLOCK_IDS)) + 1
            edges = [0, *cut.tolist(), len(doc_ids)]
            rows = []
            for a, b in zip(edges, edges[1:]):
                own = bounds[a : b + 1] - bounds[a]
                rows.append((part, seq, b - a, int(own[-1]), to_block(doc_ids[a:b], ids[bounds[a] : bounds[b]].astype(np.uint64), own)))
                seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["part", "seq", "n_docs", "n_ids", "data"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, literal: bool = True) -> None:
    """docs (doc_id, text) -> files of blocks under path, ids in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(blocks_of(tokenizer_path, end_id, literal), BLOCKS).write.option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with the number of ids before each, by sums of partitions and then within one."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    whole = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n")).withColumn("_base", F.sum("_n").over(W.orderBy("part")) - F.col("_n")).drop("_n")
    sizes = blocks.select("part", "seq", "n_ids").withColumn("_in", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = sizes.join(whole, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("start"))
    return blocks.join(starts, ["part", "seq"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, start in zip(batch.column("data"), batch.column("start").to_pylist()):
            doc_ids, ids, bounds = from_block(data.as_py())
            raw, cuts = ids.astype("<u4"), bounds.tolist()
            crc = [zlib.crc32(raw[a:b].data) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + start, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, tokens (array of ids) of every document, from the files."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                doc_ids, ids, bounds = from_block(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "tokens"])

    return spark.read.schema(BLOCKS).parquet(path).select("data").mapInArrow(run, "doc_id long, tokens array<int>")


def encoded(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, literal: bool = True) -> DataFrame:
    """Writes the files and returns doc_id, start, n_tokens, ids_crc32 as read back from them."""
    import uuid

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id, literal)
    return read_blocks(spark, path).select("data", "start").mapInArrow(digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), default_tokenizer(), literal=False)
