"""Line deduplication with two Bloom filters.

Every line becomes its document's id and the first 128 bits of the SHA-256 of its key. The key space
is cut into slices of about SLICE_KEYS lines, as many as the corpus needs, and each slice builds two
filters in a task of its own: bits met once and bits met twice. The pair is a saturating counter for
each bit, so a key of two documents is never missed. The lines are then tested against the twice
filter of their slice; only suspected repeats are shuffled by key, where the documents that hold a key
are counted exactly and the occurrence that stays is chosen. A last pass drops the lines. No filter
grows with the corpus, and none passes the driver.

A key is the line without blanks and controls 09 to 0D at its ends, A-Z lower-cased. Keys of less
than MIN_CHARS code points never count. Null and empty texts are one empty line, and become empty
texts. Rows with one doc_id are one document; a null doc_id is the smallest id. Every input row
gives one row; the other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import (
    SPACE,
    cut,
    id_or_null,
    lookup,
    map_arrow,
    mix,
    table,
)

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_KEY = 8
PROBES = 3
#: Keys of a slice of the key space (a power of two), and lines that a task holds before it sends keys on.
SLICE_KEYS = 2**20
HELD = 2**20
_BLANK = SPACE.encode()


def line_keys(text: str | None) -> list[bytes | None]:
    """The key of each line, None for one too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        k = line.strip(_BLANK).lower()
        if len(k) < MIN_CHARS or not k.isascii() and len(k.decode("utf-8", "surrogatepass")) < MIN_CHARS:
            k = None
        out.append(k)
    return out


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)]).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> 3).ravel(), (1 << (at & 7)).astype(np.uint8).ravel())


class TwoFilters:
    """Bits met once and bits met twice."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, h: np.ndarray) -> None:
        """One hash for each document and key."""
        keys, n = np.unique(h, return_counts=True)
        at = _probes(keys, self.bits)
        again = (n > 1) | _has(self.once, at)
        _set(self.twice, at[:, again])
        _set(self.once, at)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """id and key (the digest) of every distinct line key of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys = [digest(k) for k in {*line_keys(t)} if k is not None]
            ids += [i] * len(keys)
            found += keys
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "key"])

    return map_arrow(docs.select(id_or_null().alias("id"), "text"), run, "id long, key binary")


def _heads(keys: pa.Array) -> np.ndarray:
    """The first 64 bits of each key."""
    return np.frombuffer(b"".join(keys.to_pylist()), np.uint64)[::2].copy()


def twice_filters(lines: DataFrame, slices: int) -> DataFrame:
    """slice and twice: the filter of the keys met twice, of each slice of the key space.

    A task sends a key on once for every HELD lines it reads, with a mark if it met it again, so a
    line of many documents is no hot key of its slice.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            at = np.concatenate([p[0] for p in parts])
            h, first, n = np.unique(np.concatenate([p[1] for p in parts]), return_index=True, return_counts=True)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(h.view(np.int64)), pa.array(n > 1)], ["slice", "h", "again"])

        for batch in batches:
            parts.append((batch.column(0).to_numpy(), _heads(batch.column(1))))
            if sum(len(p[1]) for p in parts) >= HELD:
                yield flush()
        if parts:
            yield flush()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = number = None
        for batch in batches:
            at = batch.column(0).to_numpy()
            h, again = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            for s in np.unique(at).tolist():  # a partition is one slice
                if s != number:
                    if filters:
                        yield _filter_row(number, filters)
                    number, filters = s, TwoFilters(BITS_PER_KEY * SLICE_KEYS)
                own = at == s
                filters.add(np.repeat(h[own], 1 + again[own]))
        if filters:
            yield _filter_row(number, filters)

    return (
        lines.select("slice", "key")
        .mapInArrow(local, "slice int, h long, again boolean")
        .repartitionById(slices, F.col("slice"))
        .sortWithinPartitions("slice")
        .mapInArrow(build, "slice int, twice binary")
    )


def _filter_row(number: int, filters: TwoFilters) -> pa.RecordBatch:
    packed = zstandard.compress(filters.twice.tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([packed], pa.binary())], ["slice", "twice"])


def suspected(lines: DataFrame, filters: DataFrame) -> DataFrame:
    """The lines whose key the twice filter of their slice has; a large slice is tested in several tasks."""
    sizes = cut(lines.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.ceil(F.col("n") / (2 * SLICE_KEYS)).cast("int")))
    own = lookup(lines, sizes, "slice", "n").select(
        "slice", F.pmod(F.xxhash64("id"), "copies").cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "key"
    )
    each = filters.join(sizes, "slice").select(
        "slice", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.col("twice").alias("key")
    )

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = None
        for batch in batches:
            kind, keys = batch.column(0).to_numpy(), batch.column(2)
            edges = [0, *np.flatnonzero(kind == 0).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b and kind[a] == 0:  # a slice begins with its filter
                    twice, a = np.frombuffer(zstandard.decompress(keys[a].as_py()), np.uint8), a + 1
                if a < b:
                    hit = _has(twice, _probes(_heads(keys.slice(a, b - a)), 8 * len(twice)))
                    yield batch.slice(a, b - a).select([1, 2]).filter(pa.array(hit))

    return (
        own.unionByName(each)
        .repartition("slice", "salt")
        .sortWithinPartitions("slice", "salt", "kind")
        .select("kind", "id", "key")
        .mapInArrow(test, "id long, key binary")
    )


def lines_to_drop(docs: DataFrame) -> DataFrame:
    """id and the digests of the keys whose lines the document loses; ids without any are left out."""
    lines = cut(keyed_lines(docs))
    slices = int(max(1, -(-lines.count() // SLICE_KEYS)))
    lines = lines.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int"))
    rows = cut(suspected(lines, cut(twice_filters(lines, slices))).distinct())
    repeated = cut(
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
        .where(F.col("n") >= MIN_DOCS)
    )
    return (
        lookup(rows, repeated, "key", "n")
        .where(F.col("id") < F.col("keep"))
        .groupBy("id")
        .agg(F.collect_list("key").alias("drop"))
    )


def _kept(text: str | None, drop: list[bytes] | None) -> tuple[str, int, int]:
    """What stays of a text, its lines, and the lines it loses."""
    text = text or ""
    if not drop:
        return text, text.count("\n") + 1, 0
    gone, lines = set(drop), text.split("\n")
    left = [x for x, k in zip(lines, line_keys(text), strict=True) if k is None or digest(k) not in gone]
    return "\n".join(left), len(lines), len(lines) - len(left)


def _with_drops(docs: DataFrame) -> DataFrame:
    """The columns of docs by position, and the digests of the lines each row loses at the end."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = id_or_null(f"c{docs.columns.index('doc_id')}")
    drops = lines_to_drop(docs).hint("shuffle_hash")
    return plain.withColumn("id", key).join(drops, "id", "left").drop("id")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated lines dropped from text (and n_chars, where there is one, made anew)."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)
        columns = batch.columns[:-1]
        texts = [_kept(t, d)[0] for t, d in pairs]
        columns[at] = pa.array(texts, batch.column(at).type)
        if "n_chars" in names:
            i = names.index("n_chars")
            columns[i] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.column(i).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(_with_drops(docs), run, docs.schema)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of what stays, of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [_kept(t, d) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([x[1] for x in got], pa.int64()),
                pa.array([x[2] for x in got], pa.int64()),
                pa.array([hashlib.sha256(x[0].encode("utf-8", "surrogatepass")).hexdigest() for x in got]),
            ],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    return map_arrow(
        _with_drops(docs.selectExpr("cast(doc_id as bigint) doc_id", "text")),
        run,
        "doc_id long, n_lines long, n_dropped long, kept_sha256 string",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


QUERIES = {"op1_line_dedup": op1}
SQL = {
    "op1_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM lines),
repeated AS (
  SELECT line_key, max(doc_id) AS keep FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, r.keep IS NOT NULL AND k.doc_id <> r.keep AS gone
  FROM keyed k LEFT JOIN repeated r ON k.line_key = r.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
