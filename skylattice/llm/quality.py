"""Quality classifier from weak labels.

Heuristic labellers vote on every document: bad, fine, or no opinion; a labeller that can't judge a document isn't asked.
Expectation-maximisation over the counts of vote patterns, which are few however many documents there are, estimates for each
labeller how often it gives each answer on bad and on fine documents, the share of bad ones, and from these a posterior for every
pattern. That a labeller holds no opinion is an answer too, so labellers with one kind of vote have rates that can be told. The
posteriors of a bounded sample then train a linear scorer on hashed word features, which decides on all documents. Insults are a
second target with labellers of their own. Where a labelled table is given it is one more labeller of each target.

The lists of insults are of one language, LISTED, and share no word. They are asked about texts in LISTED only (all texts, where no
labels are given or the table has no column `lang`). In other languages insults are learned from given labels, by the hashed
features: word, shape and first letters.

The sample, a documented parameter: SAMPLE documents of the lowest hash of doc_id and text, half of them labelled ones where there
are as many; documents that nobody was asked about train nothing. Of the hashed features those are used that go with the
posteriors by CLEAR standard errors, the clearest MOST_FEATURES at most. Junk is a matter of shares (numbers over the root of the
length), and features that go against it count too; insults are seen by features that go with them only, by number (up to three),
by whether there are two, and by share.

Defined cases: a null or empty text has no words, gets the scorers' intercepts only, and is rejected, as `keep` asks for at least
one word; rows are judged one by one, whatever their doc_id, so a null or repeated doc_id changes nothing, but that a null one has
no label; labels of a doc_id that repeat are united in favour of junk and of insults; a null label is none; an empty table gives
no rows; very long texts are one step of a task each; extra columns are kept by apply_quality(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from skylattice.llm.common import dropped, split_words, steps, table, written

DIMENSIONS, SAMPLE, PREFIX = 1 << 17, 8000, 5
CLEAR, MOST_FEATURES = 5.0, 1000
#: A document is rejected from these scores on.
MOST = {"junk": 0.5, "toxic": 0.2}
#: Common insults, in two lists, and their language.
LISTED = "en"
INSULTS = (
    ("idiot", "moron", "stupid", "loser", "clown", "scum", "pathetic"),
    ("trash", "disgusting", "worthless", "dumb", "jerk", "imbecile"),
)
LABELLERS = {"junk": ("symbols", "shouting", "pipes", "stutter", "variety", "prose", "labels"), "toxic": ("insults", "slurs", "labels")}
#: Answers: no opinion, and not asked.
NONE, ASIDE = 2, 3
SYMBOLS = r"[#$%&*=~^<>\\{}@+_]{2,}"
#: A word as ordinary prose has it.
PLAIN = r"^[(\"'«„“]?\p{L}?[\p{Ll}\p{M}\p{Lo}'’-]*[.,;:!?)\"'»”“]?$"


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """bounds, code of every word, distinct words."""
    bounds, words = split_words(texts)
    d = words.dictionary_encode()
    return bounds, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.cast(pa.string())


def sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])


def stems(words: pa.Array) -> pa.Array:
    """Lower case without marks at both ends."""
    return pc.utf8_lower(pc.utf8_trim(words, "#$%&*!?.,;:|'\"()[]{}<>-_=+~^@/\\"))


def stuttered(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    same = np.concatenate([[False], code[1:] == code[:-1]]) if len(code) else np.empty(0, bool)
    at = bounds[:-1]
    same[at[at < len(same)]] = False
    return same


def voted(share: np.ndarray, junk: float, fine: float) -> np.ndarray:
    """1: bad, 0: fine, NONE."""
    return np.where(share >= junk, 1, np.where(share <= fine, 0, NONE))


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h and the labellers' answers on each target, as base-4 digits."""
    for batch in steps(batches, "text"):
        bounds, code, words = coded(batch.column("text"))
        n = np.diff(bounds)
        flag = lambda x: sums(pc.fill_null(x, False).to_numpy(zero_copy_only=False)[code] if len(code) else np.empty(0), bounds)
        share = lambda k: k / np.maximum(n, 1)
        stem = stems(words)
        doc = np.repeat(np.arange(len(n)), n)
        distinct = np.bincount(np.unique(doc * max(1, len(words)) + code) // max(1, len(words)), minlength=len(n))
        only = lambda x, most: voted(share(x), most, -1)
        again = sums(stuttered(code, bounds), bounds)
        variety = distinct / np.sqrt(np.maximum(n, 1))
        junk = [
            only(flag(pc.match_substring_regex(words, SYMBOLS)), 0.15),
            only(flag(pc.and_(pc.utf8_is_upper(words), pc.greater(pc.utf8_length(words), 1))), 0.3),
            only(flag(pc.equal(words, "|")), 0.08),
            only(again, 0.2),
            np.where(n < 40, ASIDE, np.where(variety < 2.5, 1, NONE)),
            voted(share(n - flag(pc.match_substring_regex(words, PLAIN)) + again), 0.2, 0.1),
        ]
        listed = batch.column("listed").to_numpy(zero_copy_only=False)
        toxic = [np.where(listed, flag(pc.is_in(stem, pa.array(x, stem.type))) > 0, ASIDE) for x in INSULTS]
        pack = lambda v: pa.array(sum(x.astype(np.int32) * 4**i for i, x in enumerate(v)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pack(junk), pack(toxic)], ["doc_id", "h", "n_words", "junk", "toxic"])


def expectation_maximisation(patterns: dict[int, int], k: int, rounds: int = 100) -> tuple[dict[int, float], np.ndarray, float]:
    """patterns: base-4 code of k answers -> documents. -> the posterior of bad by pattern; rate[j, y, a], how often labeller j
    answers a (0, 1 or NONE) on documents that are bad (y = 1) or fine (0); the share of bad documents.

    It starts from the shares of votes for bad; one document is added to every count, so that no rate is 0. Answers ASIDE count
    nowhere. Labellers are taken as independent within a class."""
    codes = np.array(sorted(patterns), np.int64)
    w = np.array([patterns[c] for c in codes], float)
    v = codes[:, None] // 4 ** np.arange(k) % 4
    post = ((v == 1).sum(1) + 0.2) / ((v < NONE).sum(1) + 1.0)
    rate, prior = np.empty((k, 2, 3)), 0.2
    for _ in range(rounds):
        for y, p in enumerate((1 - post, post)):
            for a in range(3):
                rate[:, y, a] = ((w * p)[:, None] * (v == a)).sum(0) + 1
        rate /= rate.sum(2, keepdims=True)
        prior = float((w @ post + 1) / (w.sum() + 2))
        says = np.concatenate([np.log(rate[:, 1] / rate[:, 0]), np.zeros((k, 1))], 1)
        post = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + says[np.arange(k), v].sum(1))))
    return dict(zip(codes.tolist(), post.tolist())), rate, prior


def buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each distinct word [word, 3]: its shape, its stem and the stem's first letters."""
    shape = words
    for what, to in ((r"\p{Lu}{2,}", "AA"), (r"\p{Ll}+", "a"), (r"[0-9]+", "0")):
        shape = pc.replace_substring_regex(shape, what, to)
    stem = stems(words)
    columns = (pc.binary_join_element_wise("s", shape, ""), pc.binary_join_element_wise("w", stem, ""), pc.binary_join_element_wise("p", pc.utf8_slice_codeunits(stem, 0, PREFIX), ""))
    out = []
    for c in columns:
        d = c.dictionary_encode()
        seen = d.dictionary.to_pylist()
        out.append(np.fromiter((xxhash.xxh32_intdigest(x) % (DIMENSIONS - 1) for x in seen), np.int64, len(seen))[d.indices.to_numpy(zero_copy_only=False)])
    return np.stack(out, 1) if len(words) else np.empty((0, 3), np.int64)


#: The last bucket counts words that repeat the one before.
STUTTER = DIMENSIONS - 1


def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its columns but the text, and its features and their numbers."""
    for batch in steps(batches, "text"):
        bounds, code, words = coded(batch.column("text"))
        n, f = np.diff(bounds), buckets(words)
        doc = np.repeat(np.arange(len(n)), n)
        again = stuttered(code, bounds)
        key = np.concatenate([(doc[:, None] * DIMENSIONS + f[code]).ravel(), doc[again] * DIMENSIONS + STUTTER])
        u, c = np.unique(key, return_counts=True)
        cuts = pa.array(np.searchsorted(u // DIMENSIONS, np.arange(len(n) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (u % DIMENSIONS, c)]
        own = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(n, pa.int64()), *lists], [*own, "n_words", "at", "count"])


def scale(n: np.ndarray) -> np.ndarray:
    """What numbers of features are divided by: the noise of a sum over n words grows as its root."""
    return np.sqrt(n + 10.0)


#: What a scorer sees of the number c of a feature in a document of n words.
VIEWS = {
    "junk": (lambda c, n: c / scale(n),),
    "toxic": (lambda c, n: np.minimum(c, 3.0), lambda c, n: (c >= 2) * 1.0, lambda c, n: 5 * c / scale(n)),
}


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and number of every feature of a batch of sparse(), and the rows' lengths."""
    at, count = batch.column("at"), batch.column("count")
    row = np.repeat(np.arange(batch.num_rows), np.diff(at.offsets.to_numpy()))
    return row, at.flatten().to_numpy(), count.flatten().to_numpy().astype(float), batch.column("n_words").to_numpy()


#: Evidence is summed in whole numbers of this part, so that the order of tasks can't tell.
GRAIN = 1 << 20


def evidence(means: dict[str, float]):
    """Of every feature: the sum of its values x (VIEWS' first) times how far the posterior is over its mean, and that of x * x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means), 2, DIMENSIONS))
        for batch in batches:
            row, col, c, n = entries(batch)
            for k, (t, m) in enumerate(means.items()):
                y = batch.column(f"y_{t}").to_numpy(zero_copy_only=False)[row]  # not asked: nan
                x = np.where(np.isnan(y), 0, VIEWS[t][0](c, n[row]))
                total[k, 0] += np.bincount(col, np.rint(x * np.nan_to_num(y - m) * GRAIN), DIMENSIONS)
                total[k, 1] += np.bincount(col, np.rint(x * x * GRAIN), DIMENSIONS)
        for k, t in enumerate(means):
            seen = np.flatnonzero(total[k, 1])
            yield pa.RecordBatch.from_arrays([pa.array([t] * len(seen), pa.string()), pa.array(seen, pa.int32()), *(pa.array(total[k, i, seen].astype(np.int64)) for i in (0, 1))], ["target", "bucket", "s", "q"])

    return run


def telling(rows: DataFrame, means: dict[str, float], least: float = CLEAR, most: int = MOST_FEATURES) -> dict[str, np.ndarray]:
    """The buckets whose values go with the posteriors (of junk: or against them) by `least` standard errors, the clearest `most`;
    ascending."""
    found = rows.mapInArrow(evidence(means), "target string, bucket int, s long, q long").groupBy("target", "bucket").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    out = {}
    for t, m in means.items():
        z = F.col("s") / GRAIN / F.sqrt(F.col("q") / GRAIN * max(1e-9, m * (1 - m)))
        clear = found.filter(F.col("target") == t).select("bucket", (F.abs(z) if t == "junk" else z).alias("z")).filter(F.col("z") >= least)
        out[t] = np.array(sorted(r[0] for r in clear.orderBy(F.desc("z"), "bucket").limit(most).collect()), np.int64)
    return out


def among(buckets: np.ndarray):
    """Rows of sparse() with these features only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, col, c, _ = entries(batch)
            some = np.isin(col, buckets)
            cuts = pa.array(np.searchsorted(row[some], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[some].astype(np.int32))) for x in (col, c)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n_words"), *lists], ["h", "n_words", "at", "count"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on posteriors y, by Newton's steps. The last column of x is 1."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-4
    for _ in range(rounds):
        bend, slope = np.diag(ridge), ridge * w
        for a in range(0, len(x), 512):  # the driver has little memory
            rows = x[a : a + 512].astype(float)
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
            bend += (rows.T * (p * (1 - p))) @ rows
            slope += rows.T @ (p - y[a : a + 512])
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 10 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(target: str, at: np.ndarray, row: np.ndarray, col: np.ndarray, count: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, numbers of features (document, bucket, number), lengths and posteriors -> buckets, weights [view, bucket], intercept."""
    views = [f(count, n[row]) for f in VIEWS[target]]
    if not len(n):
        return at, np.zeros((len(views), len(at))), 0.0
    place = np.full(DIMENSIONS, -1)
    place[at] = np.arange(len(at))
    own = np.flatnonzero(place[col] >= 0)
    x = np.zeros((len(n), len(views) * len(at) + 1), np.float32)
    x[:, -1] = 1
    for k, view in enumerate(views):
        x[row[own], k * len(at) + place[col[own]]] = view[own]
    w, b = logistic(x, y)
    return at, w.reshape(len(views), -1), b


def scores(texts: pa.Array, models: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Number of words, and the score of each target, of every text."""
    bounds, code, words = coded(texts)
    n, f, again = np.diff(bounds), buckets(words), stuttered(code, bounds)
    # junk: one view, linear in the words
    at, w, b = models["junk"]
    weight = np.zeros(DIMENSIONS)
    weight[at] = w[0]
    junk = sums(weight[f].sum(1)[code], bounds) + weight[STUTTER] * sums(again, bounds)
    out = {"junk": junk / scale(n) + b}
    # insults: by the numbers of few features
    at, w, b = models["toxic"]
    place = np.full(DIMENSIONS, -1, np.int32)
    place[at] = np.arange(len(at))
    slot = place[f]
    some = np.flatnonzero((slot >= 0).any(1)[code])
    hit = slot[code[some]]
    doc = np.searchsorted(bounds, some, "right") - 1
    key = (doc[:, None] * len(at) + hit)[hit >= 0]
    if place[STUTTER] >= 0:
        key = np.concatenate([key, (np.searchsorted(bounds, np.flatnonzero(again), "right") - 1) * len(at) + place[STUTTER]])
    u, c = np.unique(key, return_counts=True)
    own, which = u // max(1, len(at)), u % max(1, len(at))
    out["toxic"] = b + sum(np.bincount(own, w[k][which] * view(c, n[own]), len(n)) for k, view in enumerate(VIEWS["toxic"]))
    return n, {t: 1 / (1 + np.exp(-np.clip(z, -40, 40))) for t, z in out.items()}


def identified(docs: DataFrame) -> DataFrame:
    return docs.withColumn("h", F.xxhash64("doc_id", "text"))


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> dict:
    """docs (doc_id, text, lang if there), labels (doc_id, quality, toxic) -> models {target: (buckets, weights, intercept)}, and
    what was found of the labellers: {target: {labeller: its rates of bad votes on bad and on fine documents}}, and the share of
    bad documents."""
    listed = F.lit(True) if labels is None or "lang" not in docs.columns else F.coalesce(F.col("lang") == LISTED, F.lit(False))
    base = identified(docs.select("doc_id", "text", listed.alias("listed")))
    ballots = base.mapInArrow(votes, "doc_id long, h long, n_words long, junk int, toxic int").filter("n_words > 0")
    names = LABELLERS if labels is not None else {t: v[:-1] for t, v in LABELLERS.items()}
    if labels is None:
        ballots = ballots.withColumn("labelled", F.lit(False))
    else:
        told = labels.groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("_junk"), F.max("toxic").cast("int").alias("_toxic"))
        ballots = ballots.join(told, "doc_id", "left").withColumn("labelled", F.col("_junk").isNotNull() | F.col("_toxic").isNotNull())
        ballots = ballots.withColumns({t: F.col(t) + 4 ** (len(v) - 1) * F.coalesce(f"_{t}", F.lit(ASIDE)) for t, v in names.items()})
    ballots = written(ballots.select("h", "junk", "toxic", "labelled"))
    post, found = {}, {}
    for t, v in names.items():
        post[t], rate, share = expectation_maximisation(dict(map(tuple, ballots.groupBy(t).count().collect())) or {0: 1}, len(v))
        found[t] = {name: (r[1, 1], r[0, 1]) for name, r in zip(v, rate)} | {"share": share}
    # rows that repeat doc_id and text are one document of the sample
    once = ballots.groupBy("h").agg(F.max(F.struct("labelled", "junk", "toxic")).alias("b")).select("h", "b.*")
    first = lambda some, k: once.filter(some).orderBy("h").limit(k)
    half = first("labelled", sample // 2).collect()
    rest = first("not labelled", sample - len(half)).collect()
    if len(half) + len(rest) < sample:
        half = first("labelled", sample - len(rest)).collect()
    ballot, means = sorted((r["h"], *(post[t][r[t]] if r[t] != 4 ** len(v) - 1 else None for t, v in names.items())) for r in [*half, *rest]), {}
    for k, t in enumerate(names, 1):
        known = [r[k] for r in ballot if r[k] is not None]
        means[t] = sum(known) / max(1, len(known))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ballot, "h long, y_junk double, y_toxic double"))
    rows = base.join(chosen, "h").select("h", "y_junk", "y_toxic", "text").mapInArrow(sparse, "h long, y_junk double, y_toxic double, n_words long, at array<int>, count array<int>")
    rows = written(rows.dropDuplicates(["h"]))
    at = telling(rows, means)
    got = rows.select("h", "n_words", "at", "count").mapInArrow(among(np.union1d(*at.values())), "h long, n_words long, at array<int>, count array<int>").toArrow().combine_chunks()
    models, posteriors = {}, {r[0]: r[1:] for r in ballot}
    batches = got.sort_by("h").to_batches()  # sums must not depend on the order of tasks
    row, col, c, n = entries(batches[0]) if batches else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
    y = np.array([posteriors[h] for h in batches[0].column("h").to_pylist()] if batches else [], float).reshape(-1, len(names))
    for k, t in enumerate(names):
        some = ~np.isnan(y[:, k])  # somebody was asked
        place, own = np.cumsum(some) - 1, some[row]
        models[t] = train(t, at[t], place[row[own]], col[own], c[own], n[some], y[some, k])
    for done in (ballots, rows):
        dropped(done)
    return {"models": models, "labellers": found}


def judge(docs: DataFrame, models: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, junk_score, toxic_score, keep, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n, s = scores(batch.column("text"), models)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s["junk"]), pa.array(s["toxic"])], ["doc_id", "n_words", "junk_score", "toxic_score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, junk_score double, toxic_score double")
    return out.withColumn("keep", kept("n_words", "junk_score", "toxic_score"))


def kept(n: str, junk: str, toxic: str):
    return (F.col(n) > 0) & (F.col(junk) < MOST["junk"]) & (F.col(toxic) < MOST["toxic"])


def apply_quality(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows that are kept, with all their columns. Texts pass through the scorer, so nothing is joined back."""
    models, names = fit(docs, labels)["models"], []
    for c in ("n", "junk", "toxic"):  # no name that the table has already
        while (name := f"_{c}{len(names)}") in docs.columns or name in names:
            c += "_"
        names.append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n, s = scores(batch.column("text"), models)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(s["junk"]), pa.array(s["toxic"])], [*batch.schema.names, *names])

    schema = StructType([*docs.schema, *(StructField(c, t()) for c, t in zip(names, (LongType, DoubleType, DoubleType)))])
    return docs.mapInArrow(run, schema).filter(kept(*names)).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels"))["models"])
