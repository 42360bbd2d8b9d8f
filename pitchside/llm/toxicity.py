"""Toxicity scores by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic documents and unlabelled ones, which hold toxic ones too. Its
risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) with the logistic loss l: the
part of the unlabelled documents less the toxic ones' share among them stands for the clean ones,
and is held at 0 from below, where the step goes back up (or a flexible model drives it under 0 by
memorising). The prior is the toxic share of the labelled documents, or DEFAULT_PRIOR where the
labels show one kind only. Scores are a logistic function that is CUT where the same risk with the
loss 0 or 1 is least on the sample.

Features are hashed words and word beginnings (PREFIXES, in bytes of the lower-cased text), each as
the square root of its share of the text's words; so words that nobody has seen count by the way they
begin. Only features of LEAST_DOCS toxic documents that are LIFT times as frequent there as in
unlabelled ones have weights. MODELS classifiers see different unlabelled documents, and their
strengths are averaged.

The fit reads at most POSITIVES toxic and UNLABELLED other documents, taken by a hash of their ids,
from rows that are not held out, of at most FIT_BYTES bytes each; these bounds are parameters of the
fit alone. Scoring reads every whole text, and only the text.

Null texts count as empty; an empty text has the score of no features. Without toxic labels, without
unlabelled documents or with empty tables all scores are alike, and below CUT. A document labelled
more than once is toxic if at least half of its labels say so. Repeated rows and null ids are scored
like any other; extra columns are not read.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import cut, map_arrow, mix, pieces, powers, table
from pitchside.llm.quality import in_fold

POSITIVES = 4_000
UNLABELLED = 10_000
FIT_BYTES = 200_000
MODELS = 2
LEAST_DOCS = 6
LIFT = 3.0
BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
CUT = 0.5
DEFAULT_PRIOR = 0.1
#: Passes over the sample, documents of a step, step width and weight decay.
EPOCHS = 200
BATCH = 512
STEP = 0.5
PENALTY = 1e-6
#: Words below which shares are taken of this number.
FEW_WORDS = 20
#: Bytes of words: letters, digits and all of other scripts.
LETTER = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])




class Rows(NamedTuple):
    """A sparse matrix: row offsets, columns and values."""

    at: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.of(), self.value * weights[self.column], minlength=len(self.at) - 1)


def features(texts: list[str | None], used: np.ndarray | None = None) -> Rows:
    """Each text's words and their beginnings, in BITS bits, by the root of their share of its words;
    where used is given, those of them that it marks."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    is_word = np.zeros(len(buf) + 1, bool)
    is_word[1:] = LETTER[buf]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=len(parts))
    keys = []
    for k in (0, *PREFIXES):
        a, b, of = (start, end, doc) if not k else (start[end - start > k], (start + k)[end - start > k], doc[end - start > k])
        h = mix((total[b] - total[a]) * down[a] + np.uint64(k))
        h >>= np.uint64(64 - BITS)
        if used is not None:
            of, h = of[used[h]], h[used[h]]
        keys.append((of.astype(np.uint64) << np.uint64(BITS)) | h)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row = (key >> np.uint64(BITS)).astype(np.int64)
    value = np.sqrt(count / np.maximum(words, FEW_WORDS)[row])
    return Rows(np.searchsorted(row, np.arange(len(parts) + 1)), (key & np.uint64(2**BITS - 1)).astype(np.int32), value.astype(np.float32))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        used = self.weights != 0
        out = [features(texts[a:b], used).times(self.weights) for a, b in pieces(texts)]
        return _logistic((np.concatenate(out) if out else np.zeros(0)) + self.bias)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _taken(x: Rows, rows: np.ndarray) -> Rows:
    n = x.at[rows + 1] - x.at[rows]
    at = np.concatenate([[0], np.cumsum(n)])
    entries = np.repeat(x.at[rows] - at[:-1], n) + np.arange(at[-1])
    return Rows(at, x.column[entries], x.value[entries])


def risks(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The toxic and the clean part of the risk, before the clean one is held at 0."""
    return prior * float(np.logaddexp(0, -z_p).mean()), float(np.logaddexp(0, z_u).mean()) - prior * float(np.logaddexp(0, z_p).mean())


def fit_unlabelled(p: Rows, u: Rows, prior: float, columns: int, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic steps (Adagrad) on the non-negative risk."""
    rng = np.random.default_rng(seed)
    n_p, n_u = len(p.at) - 1, len(u.at) - 1
    w, b = np.zeros(columns), float(np.log(prior / (1 - prior)))
    seen, seen_b = np.full(columns, 1e-8), 1e-8
    batches = max(1, n_u // BATCH)
    for _ in range(epochs):
        by_p, by_u = rng.permutation(n_p), rng.permutation(n_u)
        for k in range(batches):
            own_p, own_u = (_taken(x, np.resize(by, max(len(by), batches))[k::batches]) for x, by in ((p, by_p), (u, by_u)))
            z_p, z_u = own_p.times(w) + b, own_u.times(w) + b
            s_p, s_u = _logistic(z_p) / len(z_p), _logistic(z_u) / len(z_u)
            if risks(z_p, z_u, prior)[1] >= 0:
                g_p, g_u = -np.full(len(z_p), prior / len(z_p)), s_u  # both parts
            else:
                g_p, g_u = prior * s_p, -s_u  # the clean part, upwards
            g = np.bincount(own_p.column, g_p[own_p.of()] * own_p.value, minlength=columns)
            g += np.bincount(own_u.column, g_u[own_u.of()] * own_u.value, minlength=columns)
            g += PENALTY * w
            g_b = g_p.sum() + g_u.sum()
            seen += g * g
            seen_b += g_b * g_b
            w -= STEP * g / np.sqrt(seen)
            b -= STEP * g_b / np.sqrt(seen_b)
    return w, float(b)


def least_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The middle of the strengths at which the risk with the loss 0 or 1 is least."""
    cuts = np.unique(np.concatenate([z_p, z_u]))
    missed = np.searchsorted(np.sort(z_p), cuts) / len(z_p)
    above = 1 - np.searchsorted(np.sort(z_u), cuts) / len(z_u)
    risk = prior * missed + np.maximum(0, above - prior * (1 - missed))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[max(best[0] - 1, 0)] + cuts[best[-1]]) / 2


def fit_rows(toxic: Rows, unlabelled: Rows, prior: float) -> Model:
    """The model of samples of toxic and of unlabelled documents, with weights for the columns they have."""
    weights = np.zeros(2**BITS, np.float32)
    prior = float(np.clip(prior, 1e-4, 0.95))
    n_p, n_u = len(toxic.at) - 1, len(unlabelled.at) - 1
    used = np.unique(np.concatenate([toxic.column, unlabelled.column]))
    if not len(used) or not n_p or not n_u:
        return Model(weights, float(np.log(min(prior, 0.4) / (1 - min(prior, 0.4)))))
    p, u = (Rows(x.at, np.searchsorted(used, x.column), x.value) for x in (toxic, unlabelled))
    models = []
    for i in range(MODELS):
        own = np.arange(n_u)[i::MODELS] if n_u >= MODELS else np.arange(n_u)
        models.append(fit_unlabelled(p, _taken(u, own), prior, len(used), seed=i))
    w = np.mean([w for w, _ in models], axis=0).astype(np.float32)
    weights[used] = w
    return Model(weights, -least_risk(p.times(w), u.times(w), prior))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """The model of bounded samples of the documents that are not held out.

    Features are counted and chosen in tasks; the driver gets the chosen ones of each sampled document.
    """
    doc_id = F.col("doc_id").cast("long")
    judged = (
        labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~in_fold(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).alias("toxic"))
    )
    n, n_toxic = judged.agg(F.count(F.lit(1)), F.count_if("toxic")).first()
    prior = n_toxic / n if 0 < n_toxic < n else DEFAULT_PRIOR

    def some(ids: DataFrame, most: int, kind: str) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(kind).alias("kind"))

    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    chosen = some(judged.where("toxic").select("doc_id"), positives, "p").unionByName(
        some(rows.select("doc_id").where(~in_fold(F.col("doc_id"))).distinct(), unlabelled, "u")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _batch(batch, features(batch.column(2).to_pylist()))

    schema = "doc_id long, kind string, columns array<int>, values array<float>"
    texts = rows.where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(chosen), "doc_id")
    sample = cut(map_arrow(texts.groupBy("doc_id", "kind").agg(F.min("text")), run, schema))  # one text for each id
    sizes = {r["kind"]: r["count"] for r in sample.groupBy("kind").count().collect()}
    n_p, n_u = sizes.get("p", 0), sizes.get("u", 0)
    in_kind = [F.count_if(F.col("kind") == k).alias(k) for k in "pu"]
    counts = sample.select("kind", F.explode("columns").alias("column")).groupBy("column").agg(*in_kind)
    found = counts.where((F.col("p") >= LEAST_DOCS) & (F.col("p") * max(n_u, 1) >= LIFT * n_p * F.col("u"))).select("column").toPandas()
    used = np.zeros(2**BITS, bool)
    used[found["column"].to_numpy(np.int64)] = True

    def chosen_only(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _rows_of(batch)
        keep = used[x.column]
        return _batch(batch, Rows(np.concatenate([[0], np.cumsum(keep)])[x.at], x.column[keep], x.value[keep]))

    got = map_arrow(sample, chosen_only, schema).toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    return fit_rows(*(_rows_of(got.filter(pa.compute.equal(got.column("kind"), k)).combine_chunks()) for k in "pu"), prior)


def _batch(batch: pa.RecordBatch, x: Rows) -> pa.RecordBatch:
    """doc_id and kind of a batch with features."""
    at = pa.array(x.at.astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((x.column, pa.int32()), (x.value, pa.float32()))]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "kind", "columns", "values"])


def _rows_of(rows: pa.RecordBatch | pa.Table) -> Rows:
    columns, values = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column("columns"), rows.column("values")))
    n = pa.compute.list_value_length(columns).to_numpy(zero_copy_only=False)
    return Rows(np.concatenate([[0], np.cumsum(n)]).astype(np.int64), columns.flatten().to_numpy(), values.flatten().to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(batch.column(1).to_pylist())
        held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
        )

    return map_arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op11_toxicity": op11}
