"""Removal of passages that an earlier document has, by sorted suffixes.

Every string of WIDTH bytes has an anchor: of its substrings of GRAM bytes the one with the least
hash. Equal strings have equal anchors at equal places, so the strings of one anchor form a region
of the text, and only regions whose anchor is in two documents can hold a repeat.

1. Each chunk of documents sends the distinct hashes of its anchors, dealt by hash, and learns
   which of them other documents have too.
2. It sends the regions of those anchors, equal ones once with their least document, dealt by hash.
   There the suffixes from the anchor on, and what stands before it read backwards, are put in
   order by deep-shallow sorting. The common prefixes of neighbours in the two orders give, for
   every place of a string around its anchor, the classes of equal strings and the least document
   of each class.
3. The chunk learns which of its strings an earlier document has, and drops the bytes they cover.

Texts, hashes, regions and answers travel packed and compressed. An anchor in many chunks
(HOT_CHUNKS) is taken apart: its strings are dealt by their own content, one by one.

Null and empty texts have no bytes. Matches never cross documents; strings are judged on the input.
Rows with one doc_id are one document, so they never remove each other's bytes; a null doc_id is
the smallest. Each input row gives one output row; the other columns are kept by dedup_passages.
Hashes of 64 bits stand for equal regions within a chunk; everything else compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import NULL_ID, cut, id_or_null, mix, pieces, powers, table
from pitchside.llm.suffix_sort import deep_shallow

WIDTH = 50
GRAM = 16
#: Code points of text of a chunk, about, and bytes of text for each partition of hashes.
CHUNK_CHARS = 8_000_000
PART_BYTES = 8_000_000
HOT_CHUNKS = 1_000
_PLACES = WIDTH - GRAM + 1


def _pack(x: np.ndarray) -> bytes:
    """Numbers, byte planes apart, compressed."""
    x = np.ascontiguousarray(x)
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"", 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class Chunk:
    """The bytes of some documents, in order of their ids, and the anchors of all their strings."""

    def __init__(self, blob: bytes):
        rows = pa.ipc.open_stream(zstandard.decompress(blob)).read_all()
        ids = np.array(rows.column("id").to_pylist(), np.int64)
        texts = rows.column("text").to_pylist()
        self.row = np.argsort(ids, kind="stable")
        parts = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in self.row]
        self.ids = ids[self.row]
        self.ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
        self.begins = self.ends - [len(p) for p in parts]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        found = [self._anchors(a, b) for a, b in self._stretches()]
        if found:
            self.at, self.low, self.high, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            self.at = self.low = self.high = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.at, side="right")

    def _stretches(self, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
        """Ranges of whole documents of about size bytes."""
        begin = 0
        for i, end in enumerate(self.ends):
            if end - self.begins[begin] >= size or i == len(self.ends) - 1:
                yield begin, i + 1
                begin = i + 1

    def _anchors(self, a: int, b: int):
        """Anchor places, first and last string of each, and hashes, of documents a to b."""
        base, end = self.begins[a], self.ends[b - 1]
        h = self.bytes[base:end].astype(np.uint64)
        if len(h) < WIDTH:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0, np.uint64)
        factor, span = 0x9E3779B97F4A7C15 | 1, 1
        while span < GRAM:  # hashes of twice as many bytes
            h = h[:-span] * np.uint64(factor) + h[span:]
            factor, span = factor * factor % 2**64, 2 * span
        h = mix(h)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= _PLACES:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < _PLACES:
            least = np.minimum(least[: len(least) - (_PLACES - span)], least[_PLACES - span :])
        fits = np.zeros(len(least) + 1, np.int32)
        first, last = self.begins[a:b] - base, self.ends[a:b] - base - WIDTH + 1
        whole = last > first
        np.add.at(fits, first[whole], 1)
        np.add.at(fits, last[whole], -1)
        string = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
        at = (least[string] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        end_ = np.append(new[1:], len(at)) - 1 if len(at) else new
        return at[new] + base, string[new] + base, string[end_] + base, h[at[new]] >> np.uint64(16)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, whether two documents here have them, and each anchor's number."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.ids[self.doc[order]]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        number = np.cumsum(new) - 1
        several = np.zeros(int(new.sum()), bool)
        several[number[1:][~new[1:] & (d[1:] != d[:-1])]] = True
        inverse = np.empty(len(h), np.int64)
        inverse[order] = number
        return h[new], several, inverse

    def strings_hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes between places."""
        up, down = powers(len(self.bytes) + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[begin]) * down[begin])


class Regions:
    """The regions of a chunk that may hold repeats, those that are sent, and to where."""

    def __init__(self, chunk: Chunk, parts: int, answers: dict[int, bytes]):
        h, _, number = chunk.distinct()
        level = np.zeros(len(h), np.uint8)  # 0: of one document only, 1: of several, 2: hot
        for p, sel in dealt(h, parts):
            level[sel] = _unpack(answers[p], np.uint8)
        level = level[number]
        warm, hot = np.flatnonzero(level == 1), np.flatnonzero(level == 2)
        n = chunk.high[hot] - chunk.low[hot] + 1
        single = np.repeat(chunk.low[hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(hot) else np.zeros(0, np.int64)
        anchor = np.concatenate([warm, np.repeat(hot, n)])
        self.at, self.doc = chunk.at[anchor], chunk.doc[anchor]
        self.low = np.concatenate([chunk.low[warm], single])
        self.high = np.concatenate([chunk.high[warm], single])
        order = np.argsort(self.low, kind="stable")  # documents in order of their ids
        self.at, self.doc, self.low, self.high = (x[order] for x in (self.at, self.doc, self.low, self.high))
        content = chunk.strings_hash(self.low, self.high + WIDTH)
        shape = ((self.at - self.low) * 64 + self.high - self.low).astype(np.uint64)
        _, self.first, self.same = np.unique(mix(content + shape * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
        where = np.where(level[anchor][order] == 2, content, chunk.hash[anchor][order])
        self.part = (where[self.first] % np.uint64(parts)).astype(np.int64)

    def sent(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        """Partition and numbers of the regions it gets."""
        order = np.argsort(self.part, kind="stable")
        ends = np.searchsorted(self.part[order], np.arange(parts + 1))
        for p in np.unique(self.part).tolist():
            yield p, order[ends[p] : ends[p + 1]]


def dealt(h: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Partition and the places of its hashes in h, which is in order."""
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.unique(part).tolist():
        yield p, order[ends[p] : ends[p + 1]]


def _rows(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "chunk", kind]
    types = [pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _send_hashes(chunk: Chunk, number: int, parts: int) -> pa.RecordBatch:
    h, several, _ = chunk.distinct()
    out = []
    for p, sel in dealt(h, parts):
        step = np.diff(h[sel], prepend=np.uint64(0))
        out.append((p, number, np.uint32(len(sel)).tobytes() + np.packbits(several[sel]).tobytes() + _pack(step)))
    return _rows("hashes", out)


def _read_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    flags = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n // 8), 4), count=n).astype(bool)
    return np.cumsum(_unpack(blob[4 + -(-n // 8) :], np.uint64), dtype=np.uint64), flags


def _find_shared(rows: pa.Table, hot_chunks: int) -> pa.Table:
    """For each chunk's hashes of one partition: 0, 1 in several documents, 2 in many chunks."""
    got = [_read_hashes(b) for b in rows.column("hashes").to_pylist()]
    h, flags = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    _, same, n = np.unique(h, return_inverse=True, return_counts=True)
    several = np.bincount(same, weights=flags) > 0
    level = np.where(n > hot_chunks, 2, ((n > 1) | several).astype(np.uint8)).astype(np.uint8)[same]
    ends = np.cumsum([len(g[0]) for g in got])
    blobs = [_pack(level[e - len(g[0]) : e]) for e, g in zip(ends, got, strict=True)]
    return pa.table({"part": rows.column("part"), "chunk": rows.column("chunk"), "answer": pa.array(blobs, pa.binary())})


def _send_regions(chunk: Chunk, number: int, parts: int, answers: dict[int, bytes]) -> pa.Table:
    r = Regions(chunk, parts, answers)
    out = []
    for p, sel in r.sent(parts):
        i = r.first[sel]
        low, n = r.low[i], r.high[i] - r.low[i] + WIDTH
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        raw = np.uint32(len(i)).tobytes() + (r.at[i] - low).astype(np.uint8).tobytes() + (r.high[i] - low).astype(np.uint8).tobytes()
        raw += chunk.ids[r.doc[i]].astype(np.int64).tobytes() + chunk.bytes[at].tobytes()
        out.append((p, number, zstandard.compress(raw, 3)))
    return pa.Table.from_batches([_rows("regions", out)])


def _sort_regions(rows: pa.Table) -> pa.Table:
    """For each region a bit for every place before its anchor: whether an earlier document has the string that begins there."""
    before, last, docs, flat, counts = [], [], [], [], []
    for blob in rows.column("regions").to_pylist():
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        counts.append(n)
        before.append(np.frombuffer(raw, np.uint8, n, 4))
        last.append(np.frombuffer(raw, np.uint8, n, 4 + n))
        docs.append(np.frombuffer(raw, np.int64, n, 4 + 2 * n))
        flat.append(np.frombuffer(raw, np.uint8, -1, 4 + 10 * n))
    alpha = np.concatenate(before).astype(np.int64)
    beta = alpha - np.concatenate(last)
    doc, flat = np.concatenate(docs), np.concatenate(flat)
    size = alpha - beta + WIDTH
    start = np.cumsum(size) - size
    masks = _masks(alpha, beta, doc, flat, start, size)
    ends = np.cumsum(counts)
    blobs = [_pack(masks[e - n : e]) for e, n in zip(ends, counts, strict=True)]
    return pa.table({"part": rows.column("part"), "chunk": rows.column("chunk"), "answer": pa.array(blobs, pa.binary())})


def _masks(alpha, beta, doc, flat, start, size) -> np.ndarray:
    n = len(alpha)
    after = np.zeros((n, WIDTH), np.uint8)
    ahead = np.zeros((n, _PLACES - 1), np.uint8)
    padded = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
    for a in range(0, n, 65_536):
        s = slice(a, a + 65_536)
        right = size[s] - alpha[s]
        j = np.arange(WIDTH)
        after[s] = np.where(j < right[:, None], padded[(start[s] + alpha[s])[:, None] + j], 0)
        j = np.arange(_PLACES - 1)
        ahead[s] = np.where(j < alpha[s][:, None], padded[np.maximum((start[s] + alpha[s] - 1)[:, None] - j, 0)], 0)
    order_r, lcp_r = deep_shallow(after)
    order_l, lcp_l = deep_shallow(ahead)
    masks = np.zeros(n, np.uint64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(_PLACES):
        valid = np.flatnonzero((beta <= a) & (a <= alpha))
        if not len(valid):
            continue
        right_class[order_r] = np.cumsum(lcp_r < WIDTH - a)
        left_class[order_l] = np.cumsum(lcp_l < a) if a else 0
        both = right_class[valid] * (n + 1) + left_class[valid]
        order = np.lexsort((doc[valid], both))
        b, d = both[order], doc[valid][order]
        new = np.ones(len(b), bool)
        new[1:] = b[1:] != b[:-1]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        masks[valid[order[least < d]]] |= np.uint64(1 << a)
    return masks


def _covered(chunk: Chunk, parts: int, answers: dict[int, bytes], masks: dict[int, bytes]) -> np.ndarray:
    """Which bytes of the chunk go."""
    r = Regions(chunk, parts, answers)
    mask = np.zeros(len(r.first), np.uint64)
    for p, sel in r.sent(parts):
        mask[sel] = _unpack(masks[p], np.uint64)
    # an equal region of an earlier document here; of the same document: what the first one has
    every = mask[r.same]
    own = chunk.ids[r.doc]
    every[own[r.first][r.same] < own] = np.uint64(2**64 - 1)
    gone = np.zeros(len(chunk.bytes) + WIDTH + 1, np.int32)
    for a in range(_PLACES):
        begin = r.at - a
        hit = begin[(begin >= r.low) & (begin <= r.high) & ((every >> np.uint64(a)) & np.uint64(1) > 0)]
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WIDTH, -1)
    return np.cumsum(gone)[: len(chunk.bytes)] > 0


def removed(docs: DataFrame, schema: str, finish, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """finish(texts' rows, kept bytes, removed bytes and spans of each) for each chunk.

    docs: id and text, then columns that only travel along.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, -(-size // PART_BYTES), min(16, -(-size // 1_000_000))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in pieces(batch.column(1).to_pylist(), CHUNK_CHARS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(a, b - a))
                blob = zstandard.compress(sink.getvalue(), 6)
                n += 1
                number = xxhash.xxh3_64_intdigest(blob, seed=task * 65_536 + n) >> 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "rows"]
                )

    packed = cut(docs.mapInArrow(pack, "chunk long, rows binary"), "none")
    chunks = max(1, -(-size // CHUNK_CHARS))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield _send_hashes(Chunk(blob), number, parts)

    shared = cut(
        packed.mapInArrow(hashes, "part int, chunk long, hashes binary")
        .repartition(parts, "part")
        .groupBy("part")
        .applyInArrow(lambda t: _find_shared(t, hot_chunks), "part int, chunk long, answer binary"),
        "none",
    )

    def regions(rows: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("part").to_pylist(), answers.column("answer").to_pylist(), strict=True))
        number = rows.column("chunk")[0].as_py()
        return _send_regions(Chunk(rows.column("rows")[0].as_py()), number, parts, got)

    def by_chunk(df: DataFrame):
        return df.repartition(int(chunks), "chunk").groupBy("chunk")

    masks = cut(
        by_chunk(packed)
        .cogroup(by_chunk(shared))
        .applyInArrow(regions, "part int, chunk long, regions binary")
        .repartition(parts, "part")
        .groupBy("part")
        .applyInArrow(_sort_regions, "part int, chunk long, answer binary"),
        "none",
    )

    def apply(rows: pa.Table, answers: pa.Table) -> pa.Table:
        got: list[dict[int, bytes]] = [{}, {}]
        for kind, part, answer in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "answer")), strict=True):
            got[kind][part] = answer
        blob = rows.column("rows")[0].as_py()
        chunk = Chunk(blob)
        gone = _covered(chunk, parts, *got)
        kept, n_removed, spans = [b""] * len(chunk.ids), [0] * len(chunk.ids), [0] * len(chunk.ids)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = chunk.begins[chunk.begins < chunk.ends]
        edge[inner] = gone[inner]
        for i, a, b in zip(chunk.row.tolist(), chunk.begins.tolist(), chunk.ends.tolist(), strict=True):
            kept[i] = chunk.bytes[a:b][~gone[a:b]].tobytes()
            n_removed[i] = int(gone[a:b].sum())
            spans[i] = int(edge[a:b].sum())
        return finish(pa.ipc.open_stream(zstandard.decompress(blob)).read_all(), kept, n_removed, spans)

    both = shared.select(F.lit(0).alias("kind"), "part", "chunk", "answer").unionByName(
        masks.select(F.lit(1).alias("kind"), "part", "chunk", "answer")
    )
    return by_chunk(packed).cogroup(by_chunk(both)).applyInArrow(apply, schema)


def passage_report(docs: DataFrame, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what stays, of each row."""

    def finish(rows: pa.Table, kept: list[bytes], n_removed: list[int], spans: list[int]) -> pa.Table:
        return pa.table(
            {
                "doc_id": pa.array([None if i == NULL_ID else i for i in rows.column("id").to_pylist()], pa.int64()),
                "n_bytes": pa.array([len(k) + n for k, n in zip(kept, n_removed, strict=True)], pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            }
        )

    return removed(
        docs.select(id_or_null().alias("id"), "text"),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        finish,
        hot_chunks,
    )


def dedup_passages(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, without the passages that an earlier document has.

    Bytes that a cut leaves as no whole character are dropped from the text.
    """
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = id_or_null(f"c{names.index('doc_id')}").alias("id")

    def finish(rows: pa.Table, kept: list[bytes], n_removed: list[int], spans: list[int]) -> pa.Table:
        columns = rows.columns[2:]
        columns[at] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.Table.from_arrays(columns, names)

    return removed(plain.select(key, F.col(f"c{at}").alias("text"), *plain.columns), docs.schema, finish)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2}
