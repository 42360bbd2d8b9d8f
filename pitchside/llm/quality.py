"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its text. The weights are learnt from preference
pairs (a document labelled good is preferred to one labelled bad) by the logistic loss on feature
differences. A quantile of the training documents' strengths is the cut: as many lie below it as
the labels call bad. Scores are a logistic function of the strength that is CUT at that quantile.

The fit reads at most SAMPLE labelled documents, taken by a hash of their ids, and PAIRS pairs;
that bound is a parameter. Scoring reads every whole text. Only the text is an input of a score.

Null texts count as empty; an empty text has the score of its (all zero) features. Where labels
are missing, empty or of one kind only, every strength is 0 and every document scores 0.5 and
is kept. A document labelled more than once counts as good if at least half of its labels are.
Repeated rows and null ids are scored like any other; the extra columns of a table are kept by
filter_documents and not read otherwise.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import map_arrow, pieces, shingle_hashes, table, word_hashes

SAMPLE = 20_000
PAIRS = 50_000
CUT = 0.3

#: Byte classes whose shares of a text are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "bang": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~+=<>",
    "bracket": b"()[]{}",
    "quote": b"'\"`",
    "slash": b"/\\_-:;",
}
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES.values()):
    _CLASS[list(_c)] = _i
_N = len(CLASSES) + 1
N_FEATURES = 3 * _N + 12


def features(texts: list[str | None]) -> np.ndarray:
    """One row of N_FEATURES numbers for each text."""
    out = [_features(texts[a:b]) for a, b in pieces(texts)]
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


def _distinct_share(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    return np.bincount(ds[new], minlength=len(n)) / np.maximum(n, 1)


def _features(texts: list[str | None]) -> np.ndarray:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(p) for p in parts])
    doc = np.repeat(np.arange(len(parts)), size)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    kind = _CLASS[buf]
    counts = np.bincount(doc * _N + kind, minlength=len(parts) * _N).reshape(-1, _N)
    n = np.maximum(size, 1)[:, None]
    share = counts / n
    words, at = word_hashes(texts)
    n_words = np.diff(at)
    shingles, s_at = shingle_hashes(texts, 3)
    lines = counts[:, list(CLASSES).index("line")] + (size > 0)
    letters = counts[:, 0] + counts[:, 1] + counts[:, -1]
    per_word = letters / np.maximum(n_words, 1)
    rest = np.stack(
        [
            np.log1p(size),
            np.log1p(n_words),
            _distinct_share(words, at),
            _distinct_share(shingles, s_at),
            per_word,
            np.abs(per_word - 6),
            np.log1p(n_words / np.maximum(lines, 1)),
            counts[:, 0] / np.maximum(letters, 1),
            np.minimum(counts[:, 5] / np.maximum(n_words, 1), 1),
            np.log1p(lines),
            (size == 0).astype(float),
            (n_words < 20).astype(float),
        ],
        axis=1,
    )
    return np.concatenate([share, np.log1p(1000 * share), share > 0.01, rest], axis=1).astype(float)


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut)
        if self.weights.any():
            z += np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from preference pairs by Newton steps on the penalised logistic loss."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - centre) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d)
    penalty = 1e-3 * pairs * np.eye(d)
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -50, 50)))
        gradient = diff.T @ p - penalty @ w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff + penalty
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    return Model(centre, scale, w, float(np.quantile(strength, len(bad) / len(y))), 1.0)


def in_fold(doc_id) -> object:
    """Whether a row is held out of the fit: crc32 of its id as text, modulo 5, is 0."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled documents that are not held out."""
    doc_id = F.col("doc_id").cast("long")
    chosen = (
        labels.select(doc_id.alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~in_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(2).to_pylist())
        flat = pa.array(x.ravel())
        rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), rows], ["doc_id", "good", "x"]
        )

    rows = map_arrow(
        docs.select(doc_id.alias("doc_id"), "text")
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "good", "text"),
        run,
        "doc_id long, good int, x array<double>",
    )
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].to_list(), float).reshape(-1, N_FEATURES)
    return fit_pairs(x, got["good"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(features(batch.column(1).to_pylist()))
        held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(held), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )

    return map_arrow(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text"),
        run,
        "doc_id long, held_out boolean, score double, predicted int",
    )


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model keeps."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(features(batch.column(at).to_pylist()))
        return batch.filter(pa.array(s >= CUT))

    return map_arrow(docs, run, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality_ranking": op5}
