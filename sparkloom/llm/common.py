"""Shared ground of the corpus operators: the shared folder, word hashing and the chunk exchange.

Word rule: words are maximal runs of bytes other than space and ``\\t \\n \\v \\f \\r``.  ``bytes.split`` follows
exactly this rule, so texts travel to Python as binary and are never decoded where words suffice.
"""

from __future__ import annotations

import ctypes
import math
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_FOLDER = "/tmp/checkpoints/sparkloom"
MAX_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- the shared folder
def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode and only when it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


#: Folders that this process has named in the shared folder.
_MADE: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    _MADE.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean(spark: SparkSession) -> None:
    """Remove what this process has settled.  Frames that the operators returned read it, so call this when they have been used."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- memory of Python workers
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, beside a JVM that takes its whole heap."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


# ---------------------------------------------------------------- words and hashes
class _Hashes(dict):
    """Word -> 64-bit hash; forgets everything when full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Codes(dict):
    """Word -> its place among 128-bit digests."""

    def __init__(self):
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.digests += xxhash.xxh3_128_digest(word)
        return code

    def room(self) -> None:
        """Forget everything when full; between chunks only, so that places hold while one is read."""
        if len(self) > 100_000:
            self.clear()
            self.digests.clear()


_HASHES, _CODES = _Hashes(), _Codes()
#: Odd factors, two for each lane of a digest.
_K = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_C = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each position; positions without n words are left out."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    h = words[:size].copy()
    for j in range(1, n):
        h *= _K[0]
        h += words[j : j + size]
    return _mixed(h, 0)


def grams_at(words: np.ndarray, at: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """``gram_hashes`` at some positions only."""
    h = words[at]
    for j in range(1, n):
        h *= _K[lane]
        h += words[at + j]
    return _mixed(h, lane)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _C[lane]
    h ^= h >> np.uint64(32)
    return h


def fold_set(sorted_hashes: np.ndarray) -> bytes:
    """128-bit digest of a sorted array of hashes."""
    return xxhash.xxh3_128_digest(sorted_hashes.tobytes())


# ---------------------------------------------------------------- chunks of documents
def total_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def chunk_size(size: int, least: int) -> int:
    """Bytes of a chunk: at least ``least``, and so many that chunks times ranges, which bounds the blocks sent, stays in proportion to the input."""
    return max(least, math.isqrt(64 * size))


def n_chunks(size: int, chunk_bytes: int) -> int:
    return max(1, math.ceil(size / chunk_bytes))


def in_chunks(docs: DataFrame, id_col: str, text_col: str, chunks: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, id, body) and, as c0, c1, ..., the columns to carry: a chunk holds the documents whose id hashes to it, so its make-up depends on the data alone.

    Every use of this frame inside one query shares one exchange.  A null id is dealt by its text.
    """
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)).otherwise(F.xxhash64(text_col, F.lit(1)))
    return docs.select(
        F.coalesce(F.pmod(key, F.lit(chunks)).cast("int"), F.lit(0)).alias("chunk"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)],
    )


class Words:
    """The words of a chunk laid end to end; document i has positions starts[i] to starts[i + 1]."""

    def __init__(self, table, lower: bool = False):
        self.bodies = table["body"].to_pylist()
        parts, sizes = [], []
        _CODES.room()
        for body in self.bodies:
            words = (body.lower() if lower else body).split()
            parts.append(np.fromiter(map(_CODES.__getitem__, words), np.int32, len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.codes = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.hashes = self._lane(0)
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)
        ids = table["id"]
        self.null = np.array(ids.is_null()).astype(bool)
        self.ids = ids.fill_null(MAX_ID).to_numpy().astype(np.int64)

    def _lane(self, lane: int) -> np.ndarray:
        return np.frombuffer(bytes(_CODES.digests), np.uint64)[lane::2][self.codes]

    @cached_property
    def second(self) -> np.ndarray:
        """The other half of each word's digest; ask for it before the words of another chunk are read."""
        return self._lane(1)


# ---------------------------------------------------------------- packed hashes
def pack(h48: np.ndarray) -> bytes:
    """Six bytes for each 48-bit hash."""
    return (h48 & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (h48 >> np.uint64(32)).astype(np.uint16).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)


def bucket_edges(sorted_h48: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of the 48-bit hash space begins in a sorted array."""
    edges = np.array([(b << 48) // buckets + ((b << 48) % buckets > 0) for b in range(buckets + 1)], np.uint64)
    return np.searchsorted(sorted_h48, edges)
