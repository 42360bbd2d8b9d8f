"""A Merkle manifest of a dataset: roots of sources, one root of all, and a proof for every row.

Rows become leaves, which are put in order of source and id and dealt to ranges. A fragment is a
sparse forest: nodes keyed by level and index. Fragments form a monoid: their sum is the union of
their nodes, in which every sibling run that is complete is replaced by its parent; the arity of a
run is known from the number of leaves. Of a range of neighbours only the nodes at its two edges
stay unresolved, a few for each level. The fragments are summed as a tree, FAN at a time, in rounds
written to the shared folder; a run completed there spans ranges, and its children are kept for the
proofs. Roots of sources are the leaves of a second tree, built the same way.

A last pass goes through the ranges again: it resolves the range's own runs once more, looks the
spanning ones up and folds every leaf's siblings to the root. No range, fragment or source passes the
driver, and none grows with a source or a group of equal rows.

Leaf: SHA-256 of doc_id, source, lang, n_chars and text, each `-` if null, else its UTF-8 bytes, `:` and
the value. Leaves of a source ascend by doc_id, null first, then by leaf, so rows with one id have a
defined order and equal rows are equal leaves. A null source is a source of its own and comes first.
A row without doc_id is not tampered with. An empty table has no rows and no root. Other columns are
not read, so extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import cut, table
from pitchside.llm.ranks import placed, salted

ARITY = 3
#: Leaves of a range, about, and fragments summed in one task.
LEAVES = 50_000
FAN = 64
#: Levels of a tree of 2**63 leaves.
LEVELS = 40
NODES = "kind string, s string, n long, level int, i long, part int, digests array<binary>"

Nodes = dict[int, dict[int, bytes]]


def hashed(digests: list[bytes]) -> bytes:
    """The node above some digests, which count as hexadecimal text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def settle(nodes: Nodes, n: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Replace every complete run among the nodes of a tree of n leaves by its parent.

    Yields level, number and children of each run. What is left is the sum's normal form.
    """
    level, width = 0, n
    while width > 1:
        here = nodes.get(level, {})
        for run in sorted({i // ARITY for i in here}):
            span = range(ARITY * run, min(ARITY * (run + 1), width))
            if all(i in here for i in span):
                children = [here.pop(i) for i in span]
                nodes.setdefault(level + 1, {})[run] = hashed(children)
                yield level, run, children
        level, width = level + 1, -(-width // ARITY)


def height(n: int) -> int:
    """The level of the root over n leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def _rows(found: list[tuple]) -> pa.Table:
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()))
    names = ("kind", "s", "n", "level", "i", "part", "digests")
    columns = list(zip(*found, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def _unresolved(s: str, n: int, nodes: Nodes, part: int) -> Iterator[tuple]:
    top = height(n)
    for level, here in nodes.items():
        for i, digest in here.items():
            yield "root" if level == top else "node", s, n, level, i, part, [digest]


def _own(rows: pa.Table, starts: pa.Table) -> Iterator[tuple[dict, pa.Table]]:
    """For each tree in a range: its row of starts, and its leaves in order."""
    rows = rows.sort_by("at")
    base = rows.column("at")[0].as_py() if rows.num_rows else 0
    for start in starts.to_pylist():
        yield start, rows.slice(start["first"] - base, start["cnt"])


class Tree:
    """The Merkle trees, one for each s, over leaves: s, the columns of order, leaf, and others.

    nodes: the rows of the spanning runs. roots: s, n and root of each tree.
    """

    def __init__(self, leaves: DataFrame, order: list[str]):
        self.rows, self.starts, parts = placed(leaves, "s", order, LEAVES)
        fan = FAN

        def fragment(rows: pa.Table, starts: pa.Table) -> pa.Table:
            out: list[tuple] = []
            for start, own in _own(rows, starts):
                nodes: Nodes = {0: dict(enumerate(own.column("leaf").to_pylist(), start["begin"]))}
                for _ in settle(nodes, start["n"]):
                    pass
                out += _unresolved(start["s"], start["n"], nodes, start["part"])
            return _rows(out)

        def merge(rows: pa.Table) -> pa.Table:
            trees: dict[str, tuple[int, Nodes]] = {}
            part = 0
            for r in rows.to_pylist():
                part = r["part"] // fan
                trees.setdefault(r["s"], (r["n"], {}))[1].setdefault(r["level"], {})[r["i"]] = r["digests"][0]
            out: list[tuple] = []
            for s, (n, nodes) in trees.items():
                out += [("run", s, n, level, i, part, children) for level, i, children in settle(nodes, n)]
                out += _unresolved(s, n, nodes, part)
            return _rows(out)

        found = self.rows.select("part", "at", "leaf").groupBy("part").cogroup(self.starts.groupBy("part")).applyInArrow(fragment, NODES)
        rounds = [cut(found)]
        while parts > 1:
            parts = -(-parts // fan)
            rounds.append(cut(rounds[-1].where("kind = 'node'").groupBy(F.expr(f"part div {fan}")).applyInArrow(merge, NODES)))
        nodes = rounds[0]
        for r in rounds[1:]:
            nodes = nodes.unionByName(r)
        self.runs = nodes.where("kind = 'run'").select("s", "level", F.col("i").alias("run"), "digests")
        self.roots = nodes.where("kind = 'root'").select("s", "n", F.col("digests")[0].alias("root"))

    def proved(self, f: Callable[[dict, pa.Table, list], pa.Table], schema: str, more: DataFrame | None = None) -> DataFrame:
        """f of each tree in each range: its row of starts (and of more, by s), its leaves, and for each
        leaf the (place, siblings) of every level."""
        power = F.pow(F.lit(ARITY), F.col("level")).cast("long")
        spanned = (
            self.starts.where("cnt < n")
            .select("part", "s", "begin", "cnt", "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"))
            .where(power < F.col("n"))
            .withColumn("width", power * ARITY)
            .select("part", "s", "level", F.explode(F.expr("array_distinct(array(begin div width, (begin + cnt - 1) div width))")).alias("run"))
            .join(self.runs, ["s", "level", "run"])
            .groupBy("part", "s")
            .agg(F.collect_list(F.struct("level", "run", "digests")).alias("spanning"))
        )
        starts = self.starts.join(spanned, ["part", "s"], "left")
        if more is not None:
            starts = starts.join(more, "s")

        def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
            return pa.concat_tables([f(start, own, list(_paths(start, own))) for start, own in _own(rows, starts)])

        return self.rows.groupBy("part").cogroup(starts.groupBy("part")).applyInArrow(run, schema)


def _paths(start: dict, own: pa.Table) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For each leaf of a range the (place, siblings) of its runs, from its own to the top one."""
    nodes: Nodes = {0: dict(enumerate(own.column("leaf").to_pylist(), start["begin"]))}
    runs = {(level, run): children for level, run, children in settle(nodes, start["n"])}
    for r in start["spanning"] or []:
        runs[r["level"], r["run"]] = r["digests"]
    top = height(start["n"])
    last: list[tuple[int, list[tuple[int, list[bytes]]]]] = [(-1, [])] * (top + 1)  # the path from each level, of the node met last

    def path(level: int, i: int) -> list[tuple[int, list[bytes]]]:
        if level == top:
            return []
        if last[level][0] != i:
            children, at = runs[level, i // ARITY], i % ARITY
            last[level] = i, [(at, children[:at] + children[at + 1 :]), *path(level + 1, i // ARITY)]
        return last[level][1]

    for i in range(start["begin"], start["begin"] + own.num_rows):
        yield path(0, i)


def _field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents with such a text."""
    fields = [_field(F.col("doc_id").cast("long")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars")), _field(text)]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Folding starts at the tampered leaf where crc32 of doc_id is even (its text has lost its line
    breaks), else at the original one.
    """
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    broken = even & F.contains("text", F.lit("\n"))
    leaves = cut(
        salted(
            docs.select(
                F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("s"),
                F.col("doc_id").cast("long").alias("doc_id"),
                leaf(F.col("text")).alias("leaf"),
                F.when(broken, leaf(F.translate("text", "\n", ""))).alias("tampered"),
            )
        )
    )
    sources = Tree(leaves, ["doc_id", "leaf"])
    subroots = cut(salted(sources.roots.select(F.lit("").alias("s"), F.col("s").alias("source"), F.col("root").alias("leaf"))))
    whole = Tree(subroots, ["source"])

    def upper(start: dict, own: pa.Table, paths: list) -> pa.Table:
        rows = [[{"place": at, "siblings": siblings} for at, siblings in p] for p in paths]
        kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.binary()))]))
        roots = pa.array([start["root"]] * own.num_rows, pa.binary())
        return pa.table([own.column("source"), own.column("leaf"), roots, pa.array(rows, kind)], names=["s", "subroot", "root", "upper"])

    above = whole.proved(
        upper, "s string, subroot binary, root binary, upper array<struct<place:int,siblings:array<binary>>>", whole.roots.select("s", "root")
    )

    def proof(start: dict, own: pa.Table, paths: list) -> pa.Table:
        up = [(u["place"], u["siblings"]) for u in start["upper"]]
        proofs, folded = [], []
        for first, changed, path in zip(own.column("leaf").to_pylist(), own.column("tampered").to_pylist(), paths, strict=True):
            node, said = changed or first, sha256()
            for at, siblings in (*path, *up):
                said.update("".join(d.hex() for d in siblings).encode())
                node = hashed([*siblings[:at], node, *siblings[at:]])
            proofs.append(said.hexdigest())
            folded.append(node.hex())
        root = start["root"].hex()
        columns = {
            "doc_id": own.column("doc_id"),
            "leaf": [d.hex() for d in own.column("leaf").to_pylist()],
            "subroot": [start["subroot"].hex()] * own.num_rows,
            "root": [root] * own.num_rows,
            "proof_sha256": proofs,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
        return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.bool_() if k == "verified" else pa.string()) for k, v in columns.items()})

    return sources.proved(
        proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", cut(above)
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merkle_manifest": op13}


def crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of an ASCII string, for a SQL without such a function."""
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, zero: xor(x // 2, 3988292384 * (x % 2)))"
    codes = f"list_transform(string_split({value}, ''), lambda y: ascii(y)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS changed
  FROM documents),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM leaves),
nodes AS (
  SELECT s, 0 AS level, i, leaf AS h, n FROM numbered
  UNION ALL
  SELECT s, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY s, level, i // 3, n),
subroots AS (
  SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3, n),
runs AS (
  SELECT s, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY s, level, i // 3
  UNION ALL
  SELECT NULL, level, i // 3, list(h ORDER BY i) FROM upper_nodes WHERE n > 1 GROUP BY level, i // 3),
folds AS (
  SELECT doc_id, s, i AS leaf_i, false AS up, 0 AS level, i, n, changed AS h, '' AS proof FROM numbered
  UNION ALL
  SELECT f.doc_id, f.s, f.leaf_i, f.up OR f.n = 1,
    CASE WHEN f.n > 1 THEN f.level + 1 ELSE 0 END,
    CASE WHEN f.n > 1 THEN f.i // 3 ELSE b.i END,
    CASE WHEN f.n > 1 THEN (f.n + 2) // 3 ELSE b.n END,
    CASE WHEN f.n > 1 THEN sha256(array_to_string(list_concat(r.hs[:f.i % 3], [f.h], r.hs[f.i % 3 + 2:]), '')) ELSE f.h END,
    CASE WHEN f.n > 1 THEN f.proof || array_to_string(list_concat(r.hs[:f.i % 3], r.hs[f.i % 3 + 2:]), '') ELSE f.proof END
  FROM folds f
  LEFT JOIN runs r ON f.n > 1 AND r.level = f.level AND r.run = f.i // 3 AND r.s IS NOT DISTINCT FROM CASE WHEN f.up THEN NULL ELSE f.s END
  LEFT JOIN subroots b ON f.s = b.s
  WHERE NOT (f.up AND f.n = 1))
SELECT l.doc_id, l.leaf, b.h AS subroot, u.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM folds f
JOIN numbered l ON l.s = f.s AND l.i = f.leaf_i
JOIN subroots b ON b.s = f.s
JOIN (SELECT h FROM upper_nodes WHERE n = 1) u ON true
WHERE f.up AND f.n = 1
"""
}
