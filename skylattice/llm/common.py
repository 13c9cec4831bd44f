"""Shared helpers: tables, durable intermediates, word splitting and hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.session import shared_folder

#: White space of the word contracts, as a regular-expression class body.
WHITE = r"\x20\x09-\x0D"
#: Text bytes that one numpy step works on at once; bounds a Python worker's memory.
STEP_BYTES = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one is made where none is set, a cluster has to name it."""
    return shared_folder(spark)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Removes what written() made, once nothing reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    white = [chr(x) for x in (32, 9, 10, 11, 12, 13)]
    edges = sum((f(text, F.lit(1)).isin(white).cast("long") for f in (F.left, F.right)), F.lit(0))
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, f"[{WHITE}]+")) - edges).cast("long")


# --- Arrow and numpy --------------------------------------------------------------------------------


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column holds about `most` bytes in each; a single longer text is one step."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if len(part) else [0, 0]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """offsets, words: words[offsets[i]:offsets[i + 1]] are the maximal runs without ASCII white space of text i (null: none)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        words, bounds = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]
    # words, not texts, become lower case: Arrow's function mixes up texts that are a slice of a batch, as those of steps() are
    return bounds.astype(np.int64), pc.ascii_lower(words) if lower else words


def hashed_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A 64-bit hash of every word and the distinct words; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    seen = coded.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    return h[coded.indices.to_numpy(zero_copy_only=False)] if len(seen) else np.empty(0, np.uint64), coded.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; its length is len(h) - n + 1, or 0."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            out = mixed(out) + h[j : len(h) - n + 1 + j]
    return mixed(out)


def inside(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the total - n + 1 positions start n words of one text."""
    size = max(0, total - n + 1)
    ok = np.ones(size + 1, bool)
    ends = bounds[1:]
    for j in range(1, n):
        at = ends - j
        ok[at[(at >= 0) & (at < size)]] = False
    return ok[:size]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
