"""What the text operators share: reading, cutting lineage, skew-proof lookups, shingles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TaskContext.get() is not None:
    # Python workers are used again and again: large buffers should go back to the system when freed.
    try:
        _libc = ctypes.CDLL("libc.so.6")
        _libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        _libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())

#: A null doc_id takes part as this id, the smallest there is.
NULL_ID = -(2**63)
#: Spaces of the contracts: blank and the controls 09 to 0D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_null(name: str = "doc_id") -> Column:
    """The id with null as the smallest value, so that joins on it lose no row."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def null_again(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is set and
    all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all machines share")
        folder = spark.conf.get("pitchside.scratch", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="pitchside-")
            spark.conf.set("pitchside.scratch", folder)
    return f"{folder}/{spark.sparkContext.applicationId}"


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It ends the lineage: a lost executor costs a new read, never a second computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about size bytes, as Python objects take several times their room."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def map_arrow(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch of about 4 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := f(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


#: At most so many keys can hold a share of 1 / HEAVY_KEYS of the rows each.
HEAVY_KEYS = 2000


#: A table of so many ids with small columns is sent to every task (2 MB or so); a larger one is shuffled.
FEW_KEYS = 50_000


def weight_of(found: DataFrame, n: str) -> tuple[int, int, int]:
    """All counted rows of found's keys, those of the largest key, and the number of keys."""
    return tuple(x or 0 for x in found.agg(F.sum(n), F.max(n), F.count(F.lit(1))).first())


def lookup(rows: DataFrame, found: DataFrame, key: str, n: str, weight: tuple[int, int, int] | None = None) -> DataFrame:
    """Join rows with found (one row per key; column n: how many rows the key has).

    Keys with a 1 / HEAVY_KEYS share of all counted rows are HEAVY_KEYS at most, so a broadcast
    of them is bounded whatever the size of the data; they never meet in one task. The rest goes
    through an ordinary shuffle in which no key is large. found must be cheap to read again, and its
    other columns small. weight: weight_of(found, n), where known.
    """
    total, most, _ = weight or weight_of(found, n)
    least = max(1000, -(-total // HEAVY_KEYS))
    if most < least:
        return rows.join(found.drop(n).hint("shuffle_merge"), key)
    heavy = F.broadcast(found.where(F.col(n) >= least).drop(n))
    light = found.where(F.col(n) < least).drop(n)
    return rows.join(heavy, key).unionByName(rows.join(light.hint("shuffle_merge"), key))


# --- words and shingles, hashed for a whole batch at a time -------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
_WORD = np.zeros(256, bool)
_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers.get("up", ())) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.ones(m, np.uint64)
            a[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (one more at the end).

    A word is a run of letters and digits (every code point above 127 counts as one), lower-cased.
    """
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    is_word = np.zeros(len(buf) + 1, bool)
    is_word[1:] = _WORD[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start])
    return h, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def shingle_hashes(texts: list[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, in order and with repeats, and their offsets.

    A text of 1 to k - 1 words has one shingle of all its words; one without words has none.
    """
    w, at = word_hashes(texts)
    n = np.diff(at)
    c = np.uint64(0xD1342543DE82EF95)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), many)
    first = np.arange(len(doc)) - offsets[doc] + at[doc]
    h = np.zeros(len(doc), np.uint64)
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    short = n[doc] < k
    for j in range(k):
        word = padded[first + j]
        if short.any():
            word = np.where(short & (j >= n[doc]), np.uint64(0), word)
        h = h * c + word + np.uint64(j + 1)
    return mix(h), offsets


def pieces(texts: list[str | None], size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size code points together, so that a task's memory stays flat."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
