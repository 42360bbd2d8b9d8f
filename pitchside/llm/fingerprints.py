"""Document fingerprints by MinHash.

Shingles are runs of five words. A signature is, for each of PERMS universal hash functions, the
least hash over a text's shingles, all of a batch at once in numpy. The likeness of two signatures
is the share of equal parts. Similar documents are found by joining bands of the signatures in
Spark, and the true Jaccard likeness of the shingle sets verifies each link; class_id names the class
that these links make.

A text of one to four words has one shingle of all of them; a null or empty text, or one without
words, has none, a signature of only the largest value, and likeness 1 to any such text. Equal
texts have equal fingerprints. A document's successor is the next in descending order of doc_id
(rows with one id in order of the first START_CHARS characters of their text); the last's is the first, and a single document's is
itself. A null doc_id is the smallest. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import (
    cut,
    id_or_null,
    lookup,
    map_arrow,
    mix,
    null_again,
    pieces,
    shingle_hashes,
    slices,
    table,
)
from pitchside.llm.near import link, shingle_sets, text_classes

PERMS = 64
BANDS = 16
SIMILARITY = 0.8
START_CHARS = 32
#: Bytes of text that a range of neighbouring documents holds, about, and how many ranges there are at
#: most: beyond 3 TB ranges grow, as the driver holds a quantile for each.
RANGE_BYTES = 32_000_000
MOST_RANGES = 100_000
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 1024, dtype=np.uint64)


def signatures(texts: list[str | None], perms: int = PERMS) -> np.ndarray:
    """One row of perms 32-bit parts for each text."""
    out = [_signatures(*shingle_hashes(texts[a:b]), perms) for a, b in pieces(texts)]
    return np.concatenate(out) if out else np.zeros((0, perms), np.uint32)


def _signatures(h: np.ndarray, offsets: np.ndarray, perms: int) -> np.ndarray:
    sig = np.full((len(offsets) - 1, perms), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for p in range(perms):
            v = ((h * _A[p] + _B[p]) >> np.uint64(32)).astype(np.uint32)
            sig[full, p] = np.minimum.reduceat(v, starts)
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.shape[1] // bands
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h ^ sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows in descending order of id, a range of ids to a task: id, packed text, bucket, ghost.

    Ids are cut into ranges of about RANGE_BYTES of text at quantiles. The first row of the range
    that follows comes along as a ghost, so that every row has its successor behind it and each text
    is shuffled once, compressed. Rows with one id are in one range, which is sorted with spilling and
    read as a stream.
    """
    spark = docs.sparkSession
    rows = docs.select(id_or_null().alias("id"), "text").withColumn("x", F.col("id").cast("double"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(MOST_RANGES, -(-size // RANGE_BYTES)))
    cuts = rows.approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    splits = [-float("inf"), *sorted({*cuts} or {0.0}), float("inf")]
    tagged = Bucketizer(splits=splits, inputCol="x", outputCol="at").transform(rows)
    tagged = tagged.withColumn("bucket", F.col("at").cast("int"))
    tops = tagged.groupBy("bucket").agg(F.max("id").alias("top")).orderBy(F.desc("bucket")).collect()
    before = [(r["bucket"], r["top"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(before, "bucket int, top long, before int"))
    ghost = F.when(F.col("id") == F.col("top"), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("ghost")))
    places = F.array_compact(F.array(F.struct("bucket", F.lit(0).alias("ghost")), ghost))
    start = F.left(F.coalesce("text", F.lit("")), F.lit(START_CHARS)).alias("start")

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        small = zstandard.ZstdCompressor(level=3)
        packed = [small.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        return batch.set_column(1, "packed", pa.array(packed, pa.binary()))

    return (
        map_arrow(tagged.join(heads, "bucket").select("id", "text", start, F.inline(places)), pack, "id long, packed binary, start string, bucket int, ghost int")
        .repartitionById(len(splits) - 1, F.col("bucket"))
        .sortWithinPartitions("bucket", "ghost", F.desc("id"), "start", "packed")
        .select("id", "packed", "bucket", "ghost")
    )


def signed(docs: DataFrame, perms: int = PERMS) -> DataFrame:
    """For each row: id, n_chars, edited_sha256, own and edited (signatures), near_edited, near_next, node."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
        """Ids, texts and following texts of runs of rows."""
        held = None  # a row whose successor is not known yet: bucket, id, text
        for batch in (part for whole in batches for part in slices(whole, 2_000_000)):
            ids, texts, following = [], [], []
            for i, packed, bucket, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = zstandard.decompress(packed).decode("utf-8", "surrogatepass")
                if held and held[0] == bucket:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                held = None if ghost else (bucket, i, text)
            yield ids, texts, following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in pairs(batches):
            for a, b in pieces(texts):
                t, f = texts[a:b], following[a:b]
                e = [edited(x, y) for x, y in zip(t, f, strict=True)]
                own, other = signatures(t, perms), signatures(e, perms)
                # the next text's signature is the next row's, but for the last of a run
                odd = [i for i, x in enumerate(f) if i + 1 == len(f) or x is not t[i + 1]]
                after = np.roll(own, -1, axis=0)
                after[odd] = signatures([f[i] for i in odd], perms)
                as_bytes = [x.encode("utf-8", "surrogatepass") for x in e]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()),
                        pa.array([len(x) for x in t], pa.int64()),
                        pa.array([hashlib.sha256(x).digest() for x in as_bytes], pa.binary()),
                        pa.array([x.astype(">u4").tobytes() for x in own], pa.binary()),
                        pa.array([x.astype(">u4").tobytes() for x in other], pa.binary()),
                        pa.array((own == other).mean(axis=1)),
                        pa.array((own == after).mean(axis=1)),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in t], pa.binary()),
                    ],
                    ["id", "n_chars", "edited_sha256", "own", "edited", "near_edited", "near_next", "sha"],
                )

    out = neighbours(docs).mapInArrow(
        run,
        "id long, n_chars long, edited_sha256 binary, own binary, edited binary, near_edited double, near_next double, sha binary",
    )
    sha = F.lower(F.hex("sha"))
    return out.withColumn("node", F.xxhash64(F.lit(0), sha)).withColumn("check", F.xxhash64(F.lit(1), sha)).drop("sha")


def fingerprint(docs: DataFrame, perms: int = PERMS, bands: int = BANDS, similarity: float = SIMILARITY) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, class_id
    (the least doc_id of the documents that verified links connect it with)."""
    rows = cut(signed(docs, perms))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, perms).astype(np.uint32)
        full = (sig != 0xFFFFFFFF).any(axis=1)
        keys = band_keys(sig[full], bands)
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), pa.array(keys.ravel()))
        keep = pa.array(full)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), lists], ["node", "id", "keys"])

    banded = map_arrow(rows.select("node", "id", "own"), run, "node long, id long, keys array<long>")
    found = text_classes(docs, rows.select("id", "node", "check"), banded, similarity)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return lookup(rows, found.select("node", "copies", F.col("c").alias("class")), "node", "copies").select(
        null_again("id").alias("doc_id"),
        "n_chars",
        text("edited_sha256"),
        F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        null_again("class").alias("class_id"),
    )


def similar_pairs(docs: DataFrame, similarity: float = SIMILARITY, perms: int = PERMS, bands: int = BANDS) -> DataFrame:
    """a, b and likeness: verified links of each bucket's documents to its least one, and what joins
    the classes that these leave apart.

    Ids must be distinct. Texts without words are left out.
    """
    rows = docs.select(id_or_null().alias("id"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        sig = signatures(texts, perms)
        keep = np.flatnonzero((sig != 0xFFFFFFFF).any(axis=1))
        keys = band_keys(sig[keep], bands)
        ids = batch.column(0).take(pa.array(np.repeat(keep, bands)))
        return pa.RecordBatch.from_arrays([ids, pa.array(keys.ravel())], ["id", "key"])

    banded = cut(map_arrow(rows, run, "id long, key long"))
    return link(banded, lambda ids: shingle_sets(rows.join(ids, "id", "left_semi")), similarity).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"
    ).distinct()


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))


QUERIES = {"op4_minhash_fingerprints": op4}
