"""Near-duplicate classes by ProbMinHash.

A document's shingles (runs of five words) weigh 1 + ln(times they occur). Every shingle sends
arrivals of a Poisson process, whose rate is its weight, to random registers; a register keeps the
shingle of its first arrival, and a shingle stops once its next arrival is later than the latest
register. The share of equal registers then estimates the probability Jaccard likeness. Bands of
registers give candidates; the shingle sets of candidates, whole, decide: two documents are linked
if their Jaccard likeness is SIMILARITY or more. Classes are the connected components.

Equal texts are one document until the end, so a group of copies costs one signature's pairs. A
null text is an empty one. A text of one to four words has one shingle of all of them; one without
words is in a class with its exact copies only. Bands, shingle sets, links and classes go by text,
never by doc_id: rows with a null or repeated doc_id are as alike as their texts are. A null doc_id
is the smallest id. class_id names a class by its least doc_id, so classes that share a null or
repeated least id share that name too. Every input row gives one output row; other columns are not
read, and drop_near_duplicates keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
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
    table,
)
from pitchside.llm.near import text_classes, text_hash

REGISTERS = 96
BANDS = 24
SIMILARITY = 0.8
_STEP = 0x9E3779B97F4A7C15


def weighted(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document: document, hash, weight."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    return doc[first], h[first], 1 + np.log(times)


def prob_minhash(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle in each of m registers of each document (0 where it has none)."""
    sig = np.zeros(n_docs * m, np.uint64)
    first = np.full(n_docs * m, np.inf)
    t = np.zeros(len(h))
    j = 0
    while len(h):
        j += 1
        r = mix(h + np.uint64(j * _STEP % 2**64))
        t = t - np.log(((r >> np.uint64(32)).astype(float) + 0.5) / 2.0**32) / w
        at = doc * m + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        sooner = t < first[at]
        if sooner.any():
            at, ts, hs = at[sooner], t[sooner], h[sooner]
            np.minimum.at(first, at, ts)
            won = first[at] == ts
            sig[at[won]] = hs[won]
        latest = np.zeros(n_docs)
        there = np.unique(doc)
        latest[there] = first.reshape(n_docs, m)[there].max(axis=1)
        on = t < latest[doc]
        doc, h, w, t = doc[on], h[on], w[on], t[on]
    return sig.reshape(n_docs, m)


def signed(docs: DataFrame) -> DataFrame:
    """id, node and check (hashes of the text), n (distinct shingles) and bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        n, sigs = [], []
        for a, b in pieces(texts):
            doc, h, w = weighted(*shingle_hashes(texts[a:b]))
            n.append(np.bincount(doc, minlength=b - a))
            sigs.append(prob_minhash(doc, h, w, b - a))
        n, sig = np.concatenate(n), np.concatenate(sigs)
        rows = REGISTERS // BANDS
        bands = np.zeros((len(sig), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(sig), b + 1, np.uint64)
            for r in range(rows):
                key = mix(key ^ sig[:, b * rows + r])
            bands[:, b] = key
        each = lambda x: pa.ListArray.from_arrays(
            np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())
        )
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(n, pa.int32()), each(bands.view(np.int64))],
            ["id", "node", "check", "n", "bands"],
        )

    rows = docs.select(id_or_null().alias("id"), text_hash(0).alias("node"), text_hash(1).alias("check"), "text")
    return map_arrow(rows, run, "id long, node long, check long, n int, bands array<long>")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Each row's id and node; and each text's node, rep (least id), copies, c and first."""
    rows = cut(signed(docs))
    banded = rows.where("n > 0").select("node", "id", F.col("bands").alias("keys"))
    return rows.select("id", "node"), text_classes(docs, rows, banded, similarity)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and copy_of (the least with its text)."""
    rows, found = classes(docs)
    return lookup(rows, found.drop("first"), "node", "copies").select(
        null_again("id").alias("doc_id"), null_again("c").alias("class_id"), null_again("rep").alias("copy_of")
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, with one row of each class: the one with the least id."""
    _, found = classes(docs)
    kept = found.where("node = first").select("node", F.col("rep").alias("id"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    keyed = plain.withColumn("id", id_or_null(f"c{docs.columns.index('doc_id')}"))
    keyed = keyed.withColumn("text", F.col(f"c{docs.columns.index('text')}")).withColumn("node", text_hash(0)).drop("text")
    return (
        keyed.join(kept.hint("shuffle_hash"), ["node", "id"], "left_semi")
        .dropDuplicates(["node", "id"])
        .drop("node", "id")
        .toDF(*docs.columns)
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op7_prob_minhash": op7}
