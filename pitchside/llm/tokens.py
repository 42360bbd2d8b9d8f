"""BPE encoding and decoding through a distinct-word table.

Documents are read in chunks of about CHUNK_CHARS characters. Every chunk gives its distinct words
(runs between white space, which this tokenizer never joins across), dealt by a hash of the word,
so that all chunks' rows of one word meet in one partition; there each distinct word is encoded
once with the tokenizers library. The ids go back to the chunks and are joined to the words by
position, and each document's ids are put together. Decoding joins every id with its piece; the
id-to-piece table is as small as the vocabulary and broadcast. Texts, words and ids travel packed
and compressed, a chunk's share to a row.

The chunks of a lost executor are made again from its input, so docs should read from files (as
after cut()), not from rows in an order that changes from run to run.

The vocabulary file is a parameter, read from the machine's own folder of public tokenizers on
each executor. Null and empty texts have no ids and decode to the empty text. Each input row gives
one output row, repeated rows and null ids too; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import map_arrow, pieces, table

#: Code points of text that a chunk holds, about: what one task keeps in memory.
CHUNK_CHARS = 8_000_000
#: Bytes of text whose distinct words one partition of the word table holds, about.
WORDS_BYTES = 16_000_000
#: Controls that Python's split() takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def words(text: str | None) -> list[str]:
    """The runs of a text between white space: this tokenizer joins nothing across it."""
    if not text:
        return []
    if _ODD.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def shared_pieces(spark: SparkSession, path: str) -> Broadcast:
    """The pieces of the vocabulary in the order of their ids, special tokens with them."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    rows = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        rows[i] = piece
    return spark.sparkContext.broadcast(rows)


def decode_ids(ids: pa.ListArray, rows: list[str]) -> pa.Array:
    """The text of each list of ids: its pieces with a space between, as the library's decode()."""
    got = pa.array(rows, pa.string()).take(ids.flatten())
    at = pc.cumulative_sum(pc.fill_null(pc.list_value_length(ids), 0)).to_numpy()
    lists = pa.ListArray.from_arrays(np.concatenate([[0], at]).astype(np.int32), got)
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of rows with doc_id and ids (no ids: the empty text)."""
    rows = shared_pieces(encoded.sparkSession, path or vocabulary_path())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), decode_ids(batch.column(1), rows.value)], ["doc_id", "text"]
        )

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: its number and its rows, compressed."""
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in pieces(batch.column(1).to_pylist(), CHUNK_CHARS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(a, b - a))
            blob = zstandard.compress(sink.getvalue(), 6)
            n += 1
            chunk = xxhash.xxh3_64_intdigest(blob, seed=task * 65_536 + n) >> 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "rows"]
            )


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def _chunk_words(texts: list[str | None], parts: int) -> dict[int, list[str]]:
    """The distinct words of a chunk in order, by the partition of the word table they go to."""
    found: set[str] = set()
    for t in texts:
        found.update(words(t))
    out: dict[int, list[str]] = {}
    for w in sorted(found):
        out.setdefault(zlib.crc32(w.encode()) % parts, []).append(w)
    return out


def _pack_ids(ids: list[bytes]) -> bytes:
    n = np.array([len(x) // 4 for x in ids], "<u4").tobytes()
    return zstandard.compress(n + b"".join(ids), 3)


def _unpack_ids(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    at = 4 * n + np.concatenate([[0], 4 * np.cumsum(np.frombuffer(raw, "<u4", n))])
    at = at.astype(np.int64).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _by_chunk(docs: DataFrame, path: str, schema: str, finish) -> DataFrame:
    """Encode and decode every row; finish(doc_ids, ids as bytes, decoded) makes a table of rows."""
    shared = shared_pieces(docs.sparkSession, path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, parts = max(1, -(-size // CHUNK_CHARS)), max(1, -(-size // WORDS_BYTES))
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_pack, "chunk long, rows binary")
        .repartition(int(chunks), "chunk")
    )

    def chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for p, ws in _chunk_words(_unpack(blob).column("text").to_pylist(), parts).items():
                    packed = zstandard.compress("\n".join(ws).encode(), 3)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p], pa.int32()), pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())],
                        ["part", "chunk", "words"],
                    )

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a word are in one partition, so no word is encoded twice."""
        known: dict[str, bytes] = {}
        for batch in batches:
            for part, chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = zstandard.decompress(blob).decode().split("\n")
                new = [w for w in ws if w not in known]
                for w, e in zip(new, _tokenizer(path).encode_batch(new, add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, "<u4").tobytes()
                packed = _pack_ids([known[w] for w in ws])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())],
                    ["part", "chunk", "ids"],
                )

    encoded = (
        dealt.mapInArrow(chunk_words, "part int, chunk long, words binary")
        .repartition(int(parts), "part")
        .mapInArrow(encode_words, "part int, chunk long, ids binary")
        .repartition(int(chunks), "chunk")
    )

    def put_together(packed: pa.Table, tables: pa.Table) -> pa.Table:
        blobs = dict(zip(tables.column("part").to_pylist(), tables.column("ids").to_pylist(), strict=True))
        rows = _unpack(packed.column("rows")[0].as_py())
        texts = rows.column("text").to_pylist()
        ids: dict[str, bytes] = {}
        for p, ws in _chunk_words(texts, parts).items():
            ids.update(zip(ws, _unpack_ids(blobs[p], len(ws)), strict=True))
        out = []
        for a, b in pieces(texts, CHUNK_CHARS // 8):
            got = [b"".join(map(ids.__getitem__, words(t))) for t in texts[a:b]]
            n = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(got), "<u4").astype(np.int32))
            decoded = decode_ids(pa.ListArray.from_arrays(n, flat), shared.value).to_pylist()
            out.append(finish(rows.column("doc_id").slice(a, b - a), got, decoded))
        return pa.concat_tables(out)

    return dealt.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(put_together, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the text that they decode to, of each row."""

    def finish(doc_id, ids, texts) -> pa.Table:
        lists = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        return pa.table(
            {
                "doc_id": doc_id,
                "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
                "ids": pa.array(lists, pa.list_(pa.int32())),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            }
        )

    return _by_chunk(docs, path or vocabulary_path(), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", finish)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, of each row."""

    def finish(doc_id, ids, texts) -> pa.Table:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.table(
            {
                "doc_id": doc_id,
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([sha(x) for x in ids], pa.string()),
                "decoded_sha256": pa.array([sha(x.encode("utf-8", "surrogatepass")) for x in texts], pa.string()),
            }
        )

    return _by_chunk(docs, path or vocabulary_path(), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10}
