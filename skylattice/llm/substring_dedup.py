"""Substring dedup with suffix automata of reference shards.

A word goes if a window of SPAN words around it also starts in a document with a smaller doc_id. Comparing every document with an
automaton of all others would be quadratic, so the corpus is cut into shards by content and each shard's automaton is sent to just
the documents that can match it:

1. Anchors. Each window's anchor is the smallest hash of the GRAM-word sequences in it, so equal windows have equal anchors. A
   document is a row of runs of windows with one anchor. Runs that a task sees twice are settled there: the later documents' are
   marked, and only the first goes on, so what is common in the corpus costs a row a task, not a row a document.
2. Shards. Runs meet by anchor; an anchor of one document only is dropped.
3. Automata. The words of what is left form the reference shard of an anchor. In order of doc_id each document's words are
   streamed through the suffix automaton of the words before it, for matching statistics: places where SPAN words or more match
   end a window to be removed. Then its own words are added, unless the automaton holds them already.
4. Marks are united for each document and its words are deleted.

Anchors of more than HOT runs (near copies of one passage) are dealt out window by window instead, where all that is equal is
settled in the tasks, so no shard grows with a common passage; a shard is streamed, and only its distinct runs are held. Texts are
shuffled by doc_id once (the second join reads the same exchange again). Hashes of 64 bits route and find; nothing is removed
before the words themselves have been compared, in the task's own texts or in a shard.

Defined cases: null and empty texts have no words; doc_id is the key: rows that repeat a doc_id repeat its text, don't count as
copies of each other, and each get the result; a null doc_id keeps all its words and is no reference; extra columns are kept by
dedup_substrings().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import STEP_BYTES, hashed_words, inside, mixed, signed, split_words, steps, table

SPAN, GRAM, HOT = 13, 5, 4000
BASE = np.uint64(0x9E3779B97F4A7C15)
#: p holds start, number and kind of a run or mark, in 32, 29 and 2 bits: most rows of all go through this exchange.
ROW = "k long, doc long, p long"
RUN, MARK, WINDOWS = 0, 1, 2


def place(start, n, kind):
    return start << 31 | n << 2 | kind


def placed(p):
    """-> start, number, kind."""
    return p >> 31, p >> 2 & (1 << 29) - 1, p & 3


class Sums:
    """Hashes of any stretch of words in constant time, by sums of word hashes with powers of an odd base."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), BASE)]))
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(h) - 1), inverse)]))[: len(h)]
            self.sum = np.concatenate([[np.uint64(0)], np.cumsum(h * back)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sum[end] - self.sum[start]) * self.power[start])


def runs_of(h: np.ndarray, bounds: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """-> start, number of windows, anchor, hash of all words, of every run of windows with one anchor."""
    n = len(h) - span + 1
    if n <= 0:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    sums = Sums(h)
    at = np.arange(len(h) - gram + 1)
    x = sums.of(at, at + gram)
    width = span - gram + 1
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[: len(x) - size], x[size:]), 2 * size
    if size < width:
        x = np.minimum(x[: len(x) - (width - size)], x[width - size :])
    ok = inside(bounds, span, len(h))
    at = np.flatnonzero(ok)
    x = x[at]
    new = np.ones(len(at), bool)
    new[1:] = (x[1:] != x[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    deep = np.arange(len(at)) - first[group]
    new |= deep % width == 0  # repetitive text: no run is longer than usual
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return start, count, x[first], sums.of(start, start + count + span - 1)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching stretches of one document as one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    shift = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])]) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - shift[last]


def same_words(code: np.ndarray, start: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the stretches of n word codes from start are those of m from other, pair by pair."""
    n = np.where(n == m, n, 0)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    wrong = code[np.repeat(start, n) + within] != code[np.repeat(other, n) + within]
    return (np.bincount(np.repeat(np.arange(len(n)), n)[wrong], minlength=len(n)) == 0) & (n > 0)


def settle(key: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows equal in key and whole: which are of the smallest doc, which of a later one, and a row of the former for each of the
    latter."""
    order = np.lexsort((doc, whole, key))
    k, w, d = key[order], whole[order], doc[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]) if len(k) else np.empty(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else order
    later = d > doc[head]
    return order[~later], order[later], head[later]


def rows(k, doc, start, n, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(k)), pa.array(doc), pa.array(place(start, n, kind))], ["k", "doc", "p"])


def marks(doc, start, end) -> pa.RecordBatch:
    doc, start, end = merged(doc, start, end)
    return rows(mixed(doc.view(np.uint64)), doc, start, end - start, np.full(len(doc), MARK))


def anchored(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 2 * STEP_BYTES):
            batch = batch.filter(batch.column("doc_id").is_valid())
            if not batch.num_rows:
                continue
            bounds, words = split_words(batch.column("text"))
            coded = words.dictionary_encode()
            code, h = coded.indices.to_numpy(zero_copy_only=False), hashed_words(words)[0]
            start, n, k, whole = runs_of(h, bounds, span, gram)
            row = np.searchsorted(bounds, start, "right") - 1
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            keep, gone, first = settle(k, whole, doc)
            equal = same_words(code, start[gone], n[gone] + span - 1, start[first], n[first] + span - 1)
            if not equal.all():  # one hash, other words: they go on
                keep, gone = np.concatenate([keep, gone[~equal]]), gone[equal]
            start = start - bounds[row]
            yield rows(k[keep], doc[keep], start[keep], n[keep], np.full(len(keep), RUN))
            yield marks(doc[gone], start[gone], start[gone] + n[gone] + span - 1)

    return run


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by kind, anchor and document: drops anchors of one document, and tells anchors of very many runs."""
    held: list[np.ndarray] = []

    def done(x):
        k, doc = x[0], x[1]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(k)))
        several = doc[first + size - 1] != doc[first]
        kind = np.repeat(np.where(size > HOT, WINDOWS, RUN), size)
        keep = np.repeat(several, size)
        start, n, _ = placed(x[2][keep])
        return rows(k[keep].view(np.uint64), doc[keep], start, n, kind[keep])

    for batch in batches:
        other = placed(batch.column("p").to_numpy())[2] == MARK
        if other.any():
            yield batch.filter(pa.array(other))
        x = np.stack([batch.column(c).to_numpy()[~other].astype(np.int64) for c in ("k", "doc", "p")])
        if not x.shape[1]:
            continue
        if held and held[-1][0, -1] == x[0, -1]:  # one anchor goes on
            held.append(x)
            continue
        last = np.searchsorted(x[0], x[0, -1])
        whole = np.concatenate([*held, x[:, :last]], 1)
        held = [x[:, last:]]
        if whole.shape[1]:
            yield done(whole)
    if held:
        yield done(np.concatenate(held, 1))


CONTEXT = "key long, doc long, p long, words binary"


def contexts(span: int):
    """Documents with their runs -> the words of each run (or of each window, where an anchor is common), settled as in anchored()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 2 * STEP_BYTES):
            key, doc, start, n, text = [], [], [], [], []
            mark = ([], [], [])
            for d, t, found in zip(*(batch.column(c) for c in ("doc_id", "text", "marks"))):
                found = found.values
                if found is None or not len(found):
                    continue
                d, words = d.as_py(), (t.as_py() or "").encode().split()
                for k, (s, m, kind) in zip(found.field("k").to_pylist(), map(placed, found.field("p").to_pylist())):
                    if kind == MARK:
                        mark[0].append(d)
                        mark[1].append(s)
                        mark[2].append(s + m)
                        continue
                    for a, c in ((s, m),) if kind == RUN else ((s + i, 1) for i in range(m)):
                        text.append(b" ".join(words[a : a + c + span - 1]))
                        key.append(k if kind == RUN else None)
                        doc.append(d)
                        start.append(a)
                        n.append(c)
            texts = pa.array(text, pa.large_binary())
            whole, _ = hashed_words(texts)
            exact = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key = np.array([signed(whole[i : i + 1])[0] if k is None else k for i, k in enumerate(key)], np.int64)
            doc, start, n = (np.array(x, np.int64) for x in (doc, start, n))
            keep, gone, _ = settle(key, exact, doc)
            more = [np.concatenate([np.array(a, np.int64), b]) for a, b in zip(mark, (doc[gone], start[gone], start[gone] + n[gone] + span - 1))]
            m = marks(*more)
            yield pa.RecordBatch.from_arrays([*m.columns, pa.nulls(m.num_rows, pa.binary())], ["key", "doc", "p", "words"])
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(doc[keep]), pa.array(place(start[keep], n[keep], RUN)), pa.array([text[i] for i in keep.tolist()], pa.binary())], ["key", "doc", "p", "words"])

    return run


class SuffixAutomaton:
    """All substrings of the word sequences added so far, and the first document of each, as documents come in order."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [None]

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                new = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                first.append(doc)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[new] = q if length[q] == length[p] + 1 else self.split(p, q, w)
                last = new
            else:
                last = self.split(last, q, w)

    def split(self, p: int, q: int, w: bytes) -> int:
        """The part of state q whose strings are no longer than those of p and w."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes], span: int, doc: int) -> list[int]:
        """Starts of the span-word windows that an earlier document has. The matching statistics are cut at span words."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        at = size = 0
        out = []
        for i, w in enumerate(words):
            while at and w not in nxt[at]:
                at = link[at]
                size = length[at]
            to = nxt[at].get(w)
            if to is None:
                size = 0
                continue
            at, size = to, size + 1
            if size >= span:
                while length[link[at]] >= span:
                    at = link[at]
                size = span
                if first[at] < doc:
                    out.append(i - span + 1)
        return out


class Shard:
    """One anchor's runs in order of doc_id: what is found of each, with the distinct runs of earlier documents held."""

    def __init__(self, span: int):
        self.span, self.doc, self.new = span, None, []
        # words added as they were found: equal words again are matched from end to end
        self.whole, self.waiting, self.automaton = set(), [], None

    def step(self, doc: int, start: int, n: int, words: bytes) -> list[tuple[int, int, int]]:
        """-> stretches of the document to remove."""
        if doc != self.doc:  # the last document's runs become reference
            for w, d in self.new:
                if w not in self.whole:
                    self.whole.add(w)
                    self.waiting.append((w, d))
            self.doc, self.new = doc, []
        if words in self.whole:
            return [(doc, start, start + n + self.span - 1)]
        out = []
        if self.whole:
            self.automaton = self.automaton or SuffixAutomaton()
            for w, d in self.waiting:
                self.automaton.add(w.split(b" "), d)
            self.waiting = []
            out = [(doc, start + s, start + s + self.span) for s in self.automaton.matches(words.split(b" "), self.span, doc)]
        if len(out) < n:
            self.new.append((words, doc))
        return out


def streamed(span: int):
    """Shard by shard, sorted by kind, key, doc: streams each document's words through the automaton of those before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for batch in batches:
            start, n, kind = placed(batch.column("p").to_numpy())
            mark, spans = kind == MARK, []
            if mark.any():
                yield pa.RecordBatch.from_arrays([batch.column("doc").filter(pa.array(mark)), pa.array(start[mark].astype(np.int32)), pa.array((start + n)[mark].astype(np.int32))], ["doc", "start", "end"])
                batch, start, n = batch.filter(pa.array(~mark)), start[~mark], n[~mark]
            for k, doc, a, m, words in zip(batch.column("key").to_pylist(), batch.column("doc").to_pylist(), start.tolist(), n.tolist(), batch.column("words").to_pylist()):
                if k != at:
                    shard, at = Shard(span), k
                spans += shard.step(doc, a, m, words)
            if spans:
                d, s, e = merged(*(np.array(x, np.int64) for x in zip(*spans)))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["doc", "start", "end"])

    return run


def repeated_spans(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """texts (doc_id, text) -> doc_id, spans: stretches of words (start, end) to remove."""
    gram, kind = max(1, min(GRAM, span - 1)), F.col("p").bitwiseAND(3)
    found = texts.mapInArrow(anchored(span, gram), ROW).repartition("k").sortWithinPartitions(kind, "k", "doc").mapInArrow(shared, ROW)
    per = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("k", "p")).alias("marks"))
    words = texts.join(per, "doc_id", "left").mapInArrow(contexts(span), CONTEXT)
    spans = words.repartition("key").sortWithinPartitions(kind, "key", "doc", "p").mapInArrow(streamed(span), "doc long, start int, end int")
    return spans.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        n, gone, kept = [], [], []
        for t, spans in zip(batch.column("text"), batch.column("spans")):
            words = (t.as_py() or "").encode().split()
            n.append(len(words))
            spans = spans.values
            if spans is not None and len(spans):
                s = sorted(zip(spans.field("start").to_pylist(), spans.field("end").to_pylist()))
                left, at = [], 0
                for a, b in s:
                    if a > at:
                        left += words[at:a]
                    at = max(at, b)
                words = left + words[at:]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])


def dedup_substrings(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, text (the words kept, joined by single spaces)."""
    texts = docs.select("doc_id", "text")
    return texts.join(repeated_spans(texts, span), "doc_id", "left").mapInArrow(removed, "doc_id long, n_words long, n_removed long, text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, (len(w) - 11)::BIGINT)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE doc_id > first),
t AS (SELECT doc_id, unnest(range(1, (len(w) + 1)::BIGINT)) AS p, unnest(w) AS x FROM d),
k AS (SELECT t.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY t.p) FILTER (gone.p IS NULL), '') AS kept FROM t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.p = gone.p GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
