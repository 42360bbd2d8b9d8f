"""Boosted trees of outcomes (softmax) and totals (squared error), for all folds of a walk-forward at once.

Rows are binned once and written. Every level of a round of trees is one pass over that table: a task sums
gradients by model, output, node, feature and bin, the sums are added as a tree, and the driver picks the
splits; what it holds is as large as the models, whatever the number of rows. A row of fold f trains the
models of later folds and the final model, so one pass serves them all. Scores are stored with the rows
every KEPT rounds, so a pass applies a few rounds of trees only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.sources.scratch import cut

BINS = 32
KEPT = 5
#: Rows that are summed at once, and cells of one count: as many features share it as their bins allow.
CHUNK, CELLS = 65_536, 8_192
#: Weight of the squared leaf values, and the least sum of second derivatives of a leaf.
PENALTY = 1.0
LEAST_HESSIAN = 1.0


@dataclass
class Trees:
    """Trees in heap order: splits [round, output, node] by feature and bin (the last bin that goes left), values [round, output, leaf]."""

    columns: list[str]
    edges: list[list[float]]
    classes: int
    base: np.ndarray
    features: np.ndarray
    bins: np.ndarray
    values: np.ndarray

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Scores of each class and the total, from bins."""
        x, out = np.asfortranarray(x), np.tile(self.base, (len(x), 1))
        for f, b, v in zip(self.features, self.bins, self.values, strict=True):
            out += np.stack([v[k][_leaf(x, f[k], b[k])] for k in range(len(v))], axis=1)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """df with p (a probability for each class), prediction (the likeliest class) and total."""
        names = df.columns
        at = [names.index(c) for c in self.columns]
        out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", p array<double>, prediction double, total double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = binned(np.stack([_numbers(batch.column(i)) for i in at], axis=1), self.edges)
                s = self.outputs(x)
                p = softmax(s[:, : self.classes])
                lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(p.argmax(1).astype(float)), pa.array(s[:, -1])], [*names, "p", "prediction", "total"])

        return df.mapInArrow(run, out)

    def to_json(self) -> str:
        parts = {k: getattr(self, k).tolist() for k in ("base", "features", "bins", "values")}
        return json.dumps({"columns": self.columns, "edges": self.edges, "classes": self.classes} | parts)

    @classmethod
    def from_json(cls, text: str) -> Trees:
        d = json.loads(text)
        arrays = {"base": float, "features": np.int32, "bins": np.int32, "values": float}
        return cls(d["columns"], d["edges"], d["classes"], *[np.array(d[k], t) for k, t in arrays.items()])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _leaf(x: np.ndarray, feature: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The place in its level of each row after all splits of a tree (so far); a node without a split sends all left.

    Every node's side is asked of all rows, column by column, and the sides on a row's path are kept: faster than to follow each row.
    """
    path: list[np.ndarray] = []
    node = np.zeros(len(x), np.int64)
    for level in range(int(np.log2(len(feature) + 1))):
        at = range(2**level - 1, 2 ** (level + 1) - 1)
        sides = [x[:, feature[i]] > int(bins[i]) if feature[i] >= 0 else np.zeros(len(x), bool) for i in at]
        for right in reversed(path):
            sides = [p ^ (right & (p ^ q)) for p, q in zip(sides[::2], sides[1::2], strict=True)]
        path.append(sides[0])
        node = 2 * node + sides[0]
    return node


def _gradients(s: np.ndarray, y: np.ndarray, total: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives [row, model, output]."""
    p = softmax(s[:, :, :classes])
    g, h = np.empty_like(s), np.ones_like(s)
    g[:, :, :classes] = p - (np.arange(classes)[:, None] == y).T[:, None, :]
    g[:, :, classes:] = s[:, :, classes:] - total[:, None, None]
    h[:, :, :classes] = np.maximum(p * (1 - p), 1e-6)
    return g, h


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width, as rows of bytes."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    flat = column.cast(pa.binary(width))
    return np.frombuffer(flat.buffers()[1], np.uint8).reshape(-1, width)[flat.offset : flat.offset + len(flat)]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least so many rows (the last: what is left)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _shared(sizes: list[int], most: int) -> list[list[int]]:
    """Features in groups whose bins have at most so many combinations (a feature alone may have more)."""
    groups: list[list[int]] = []
    for j in range(len(sizes)):
        if groups and int(np.prod([sizes[i] for i in groups[-1]])) * sizes[j] <= most:
            groups[-1].append(j)
        else:
            groups.append([j])
    return groups


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """feature (-1: none), bin and leaf values of both sides, from sums [..., feature, bin, (g, h)]."""
    left = sums.cumsum(axis=-2)
    whole = left[..., :1, -1:, :]
    right = whole - left
    worth = lambda t: t[..., 0] ** 2 / (t[..., 1] + PENALTY)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 1] < LEAST_HESSIAN) | (right[..., 1] < LEAST_HESSIAN)] = -np.inf
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.argmax(axis=-1)
    feature, bins = best // gain.shape[-1], best % gain.shape[-1]
    some = np.take_along_axis(flat, best[..., None], -1)[..., 0] > 1e-9
    sides = np.take_along_axis(left.reshape(*flat.shape, 2), best[..., None, None], -2)[..., 0, :]
    whole = whole[..., 0, 0, :]
    sides = np.where(some[..., None], sides, whole)
    value = lambda t: -t[..., 0] / (t[..., 1] + PENALTY)
    return np.where(some, feature, -1), np.where(some, bins, BINS), np.stack([value(sides), value(whole - sides)], axis=-1)


def prepared(
    df: DataFrame, columns: list[str], label: str, total: str, fold: Column, keep: list[str], place: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, list[list[float]]]:
    """The binned rows, written: x, y, total, fold (0: trained on by all) and the columns of keep; and the bins' edges.

    place adds what fold needs, to rows that hold x in place of the columns: bytes are moved and sorted, not numbers.
    """
    at = [i / BINS for i in range(1, BINS)]
    edges = [sorted({float(v) for v in q}) for q in df.fillna(0.0, columns).approxQuantile(columns, at, 0.005)]
    others = [c for c in df.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for batch in batches:
            x = binned(np.stack([_numbers(batch.column(i)) for i in range(n)], axis=1), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[n:]], ["x", *others])

    rows = df.select(*columns, *others).mapInArrow(run, ", ".join(["x binary", *[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others]]))
    rows = place(cut(rows)) if place else rows
    return cut(rows.select("x", F.col(label).cast("int").alias("y"), F.col(total).cast("double").alias("total"), F.coalesce(fold, F.lit(0)).cast("int").alias("fold"), *keep)), edges


def boosted_folds(
    df: DataFrame, columns: list[str], fold: Column, folds: int, label: str = "label", total: str = "goals", keep: tuple[str, ...] = ("match_id",),
    classes: int = 3, trees: int = 20, depth: int = 4, rate: float = 0.1, place: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[list[Trees], DataFrame]:
    """A model for each fold (of the rows of the folds before it) and the final one of all rows; and the written
    rows with scores: s [model * (classes + 1) + output].

    fold is null or 0 for rows that only train, and may use what place adds to the rows. trees rounds of one tree for each output.
    """
    rows, edges = prepared(df, columns, label, total, fold, list(keep), place)
    models, outputs, features = folds + 1, classes + 1, len(columns)
    mean = [F.avg(F.when(F.col("fold") < m, F.col("total"))) for m in range(1, folds + 1)]
    base = np.zeros((models, outputs))
    base[:, -1] = [v or 0.0 for v in rows.agg(*mean, F.avg("total")).first()]
    scored = rows
    everything: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    sizes = [len(e) + 1 for e in edges]

    def read(batch: pa.RecordBatch, recent: list, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bins and scores [row, model, output], column by column in memory; rows as they are or in order."""
        order = np.arange(batch.num_rows) if order is None else order
        x = np.asfortranarray(_bytes(batch.column("x"), features)[order])
        s = np.empty((models, outputs, len(x))).transpose(2, 0, 1)
        s[:] = batch.column("s").flatten().to_numpy().reshape(-1, models, outputs)[order] if "s" in batch.schema.names else base
        for f, b, v in recent:
            for m in range(models):
                for k in range(outputs):
                    s[:, m, k] += v[m, k][_leaf(x, f[m, k], b[m, k])]
        return x, s

    def sums(recent: list, f: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        shape = (models, outputs, 2**level, features, BINS, 2)
        groups = _shared(sizes, max(CELLS >> level, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros((models, outputs, 2, 2**level * int(np.prod([sizes[j] for j in group])))) for group in groups]
            for batch in _chunks(batches, CHUNK):
                own = batch.column("fold").to_numpy(zero_copy_only=False)
                order = np.argsort(own, kind="stable")
                own = own[order]
                x, s = read(batch, recent, order)
                number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[order]  # noqa: B023, E731
                g, h = _gradients(s, number("y"), number("total"), classes)
                cells = [np.ravel_multi_index([x[:, j] for j in group], [sizes[j] for j in group]) for group in groups]
                for m in range(models):
                    n = np.searchsorted(own, m, side="right") if m < folds else len(own)
                    for k in range(outputs):
                        node = _leaf(x[:n], f[m, k][: 2**level - 1], b[m, k][: 2**level - 1])
                        for count, cell in zip(counts, cells, strict=True):
                            size = count.shape[-1]
                            at = node * (size >> level) + cell[:n]
                            count[m, k, 0] += np.bincount(at, g[:n, m, k], minlength=size)
                            count[m, k, 1] += np.bincount(at, h[:n, m, k], minlength=size)
            out = np.zeros(shape)
            for group, count in zip(groups, counts, strict=True):
                count = count.reshape(models, outputs, 2, 2**level, *[sizes[j] for j in group])
                for i, j in enumerate(group):
                    alone = count.sum(axis=tuple(4 + o for o in range(len(group)) if o != i))
                    out[:, :, :, j, : sizes[j]] = np.moveaxis(alone, 2, -1)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        needed = [c for c in ("x", "y", "total", "fold", "s") if c in scored.columns]
        parts = scored.select(*needed).mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(bytes(r["sums"])))
        return parts.treeReduce(lambda p, q: p + q).reshape(shape)

    for number in range(trees):
        f, b = np.full((models, outputs, 2**depth - 1), -1), np.full((models, outputs, 2**depth - 1), BINS)
        v = np.zeros((models, outputs, 2**depth))
        for level in range(depth):
            at = slice(2**level - 1, 2 ** (level + 1) - 1)
            f[:, :, at], b[:, :, at], sides = best_splits(sums(pending, f, b, level))
            if level == depth - 1:
                v = rate * sides.reshape(models, outputs, 2**depth)
        pending.append((f, b, v))
        everything.append((f, b, v))
        if len(pending) == KEPT or number == trees - 1:
            names = [*rows.columns, "s"]
            out = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema.fields) + ", s array<double>"

            def store(batches: Iterator[pa.RecordBatch], recent: list = [*pending], names: list[str] = names) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    s = read(batch, recent)[1].ravel()
                    lists = pa.ListArray.from_arrays(np.arange(0, s.size + 1, models * outputs, dtype=np.int32), pa.array(s))
                    yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], lists], names)

            scored, pending = cut(scored.mapInArrow(store, out)), []
    if not trees:
        scored = rows.withColumn("s", F.array(*[F.lit(float(v)) for v in base.ravel()]))
    of = lambda i, m: np.stack([t[i][m] for t in everything])
    return [Trees(columns, edges, classes, base[m], of(0, m).astype(np.int32), of(1, m).astype(np.int32), of(2, m)) for m in range(models)], scored


def fold_scores(scored: DataFrame, folds: int, classes: int = 3) -> DataFrame:
    """fold, n_train, n_test, brier, accuracy and rmse: each fold by its own model."""
    own = F.slice("s", (F.col("fold") - 1) * (classes + 1) + 1, F.lit(classes + 1))
    rows = scored.select("fold", "y", "total", F.slice(own, 1, classes).alias("c"), F.element_at(own, -1).alias("t"))
    e = F.transform("c", lambda v: F.exp(v - F.array_max("c")))
    rows = rows.where("fold > 0").withColumn("e", e).withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)))
    brier = F.aggregate(F.transform("p", lambda v, i: F.pow(v - (i == F.col("y")).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    hit = (F.array_position("c", F.array_max("c")) - 1 == F.col("y")).cast("double")
    tested = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"), F.round(F.avg(brier), 4).alias("brier"), F.round(F.avg(hit), 4).alias("accuracy"), F.round(F.sqrt(F.avg(F.pow(F.col("t") - F.col("total"), 2))), 4).alias("rmse")
    )
    before = scored.groupBy().agg(*[F.count_if(F.col("fold") < k).alias(f"n{k}") for k in range(1, folds + 1)])
    before = before.select(F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"n{k}").alias("n_train")) for k in range(1, folds + 1)])).alias("n")).select("n.*")
    return before.join(tested, "fold").select("fold", "n_train", "n_test", "brier", "accuracy", "rmse")


def fold_summary(scores: DataFrame) -> DataFrame:
    """One row: the mean and the deviation (of the whole population) of each metric over the folds."""
    both = [f(c).alias(f"{n}_{c}") for c in ("brier", "accuracy", "rmse") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return scores.agg(F.count(F.lit(1)).alias("folds"), *both).select("folds", *[F.round(f"{n}_{c}", 4).alias(f"{n}_{c}") for c in ("brier", "accuracy", "rmse") for n in ("mean", "std")])
