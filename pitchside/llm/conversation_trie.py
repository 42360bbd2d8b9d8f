"""The prefix trie of conversations by an LCP-aware external mergesort.

A turn becomes a digest of its role and text (16 bytes) and a number of words; conversations are rebuilt
from these, so texts never move. A conversation is the string of its digests. Tasks sort runs of such
strings and keep with each its LCP, the number of turns that it shares with the one before it; the runs
are written out. Ranges of the strings are then dealt to tasks, each of which merges its pieces of the
runs by a loser tree: of two candidates the one with the longer LCP to the last winner is the smaller,
and only with equal LCPs are turns compared, from there on. The merged stream needs one stack, the open
path: a string with LCP l finishes all nodes deeper than l.

The first and the last path of a range may go on in its neighbours. They stay open: a range leaves two
strings with the sums of their nodes, and these are merged by the same stack, FAN ranges at a time, in
rounds written to the shared folder. Children of such nodes wait for the name of their parent and get it
by a join.

Nothing grows with a key. Places of turns come from ranges over all turns, so a conversation may hold any
share of the rows. A string has at most HEAD turns, or GROW times as many for as long as another
conversation shares all of them; the turns after it belong to no other conversation, and their nodes follow
row by row. Equal strings are one string with the number, the least and the hash of its members, which is
read from packed pieces of their ordered ids.

Turns are ordered by turn, null first, then by digest where turns repeat; null roles and texts are empty.
Rows without conv_id take no part. c % 20 has the sign of c. An empty table has no nodes, not even a root.
Other columns are not read. Words are runs of characters other than blank and 09 to 0D.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm.common import cut, lookup, table
from pitchside.llm.manifest import crc32_sql
from pitchside.llm.ranks import parts_of, placed, salted

#: Turns that are borrowed at most, and the step between conversations that lend them.
BORROWED = 4
LENDER = 20
#: Turns of a string at first, and the factor for those that are shared whole.
HEAD = 64
GROW = 8
#: Rows of a range of turns or ids, strings of a run and of a range, ranges merged in one task.
ROWS = 200_000
RUN = 20_000
STRINGS = 50_000
FAN = 32
#: Characters of a packed piece of ids.
PIECE = 1_000_000
WIDTH = 16
NOTHING = sha256(b"").hexdigest()


# --- rebuilding -----------------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, turn, digest and words of every row with a conv_id."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(both.cast("binary"), 256)), 1, WIDTH).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """c, d, digest and words of every rebuilt turn; and c and turns of every conversation."""
    ordered, starts, _ = placed(cut(salted(turns_of(conversations))), "c", ["turn", "digest"], ROWS)
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % BORROWED).cast("int")
    place = F.col("begin") + F.col("at") - F.col("first")
    lent = ordered.join(starts.where(f"begin < {BORROWED}"), ["part", "c"]).withColumn("i", place).where(f"i < {BORROWED - 1}")
    convs = starts.where("begin = 0").select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % LENDER).alias("lender"))
    borrowed = cut(
        convs.where("h > 0")
        .join(lent.select(F.col("c").alias("lender"), "i", "digest", "words"), "lender")
        .where("i < h")
        .select("c", (F.col("i") + 1).alias("d"), "digest", "words")
    )
    got = borrowed.groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    known = convs.join(got, "c", "left").select("c", "n", "h", F.coalesce("m", F.lit(0)).alias("m"))
    own = (
        ordered.join(starts.select("part", "c", "first", "begin").join(known.select("c", "h", "m"), "c"), ["part", "c"])
        .withColumn("i", place)
        .where("i >= h")
        .select("c", (F.col("i") + 1 + F.col("m") - F.col("h")).alias("d"), "digest", "words")
    )
    lengths = known.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))
    return cut(own.unionByName(borrowed)), cut(lengths)


def string_lengths(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """c, turns and kept: how many turns its string has. No conversation shares more than kept - 1 turns
    with one whose kept is less than its turns."""
    k, longest = HEAD, lengths.agg(F.max("turns")).first()[0] or 0
    long = lengths.where(F.col("turns") >= k)
    found = [lengths.where(F.col("turns") < k).withColumn("kept", F.col("turns"))]
    while k <= longest:
        heads = (
            turns.where(F.col("d") <= k)
            .join(long, "c")
            .groupBy("c", "turns")
            .agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("d", "digest"))), lambda x: F.hex(x["digest"]))).cast("binary"), 256).alias("head"))
        )
        heads = cut(heads)
        shared = heads.groupBy("head").agg((F.count(F.lit(1)) > 1).alias("shared"))
        heads = heads.join(shared, "head").select("c", "turns", "shared")
        more = F.col("shared") & (F.col("turns") >= k * GROW)
        found.append(heads.where(~more).select("c", "turns", F.when(F.col("shared"), F.col("turns")).otherwise(F.lit(k)).alias("kept")))
        long = cut(heads.where(more).select("c", "turns"))
        k *= GROW
        if k <= longest and long.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def ends_of(strings: DataFrame) -> DataFrame:
    """s, n, c (the least) and ends of each s, from its ids c."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), 0
        last, ids, size = None, [], 0

        def row() -> pa.RecordBatch:
            values = ([last], [part], [piece], [len(ids)], [ids[0]], [",".join(map(str, ids))])
            types = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["s", "part", "piece", "n", "c", "ids"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (s != last or size >= PIECE):
                    held.append(row())
                    piece, ids, size = piece + 1, [], 0
                last = s
                ids.append(c)
                size += 21
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if ids:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, least, said = None, 0, 0, sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([n]), pa.array([least]), pa.array([said.hexdigest()])], ["s", "n", "c", "ends"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for s, more, c, ids in zip(*(batch.column(x).to_pylist() for x in ("s", "n", "c", "ids")), strict=True):
                if s != last:
                    if n:
                        held.append(row())
                    last, n, least, said = s, 0, c, sha256()
                said.update((("," if n else "") + ids).encode())
                n += more
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if n:
            yield row()

    pieces = strings.repartitionByRange(parts_of(strings, ROWS), "s", "c").sortWithinPartitions("s", "c").select("s", "c")
    pieces = pieces.mapInArrow(packed, "s binary, part int, piece int, n long, c long, ids string")
    return pieces.repartition("s").sortWithinPartitions("s", "part", "piece").mapInArrow(hashed, "s binary, n long, c long, ends string")


# --- sorting --------------------------------------------------------------------------------------


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of turns that two strings begin with, if they share so many for certain."""
    i, end = known * WIDTH, min(len(a), len(b))
    while i < end and a[i : i + WIDTH] == b[i : i + WIDTH]:
        i += WIDTH
    return i // WIDTH


def merged(runs: list[list[tuple[int, bytes, object]]]) -> Iterator[tuple[int, bytes, object]]:
    """Sorted runs of (LCP, string, anything) as one, by a loser tree that compares from the LCP on."""
    runs = [r for r in runs if r]
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    lcp = [0] * len(runs)
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs' next strings; both LCPs are to the last string given out."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = runs[a][at[a]][1], runs[b][at[b]][1]
        shared = shared_turns(x, y, lcp[a])
        i = shared * WIDTH
        a, b = (a, b) if x[i : i + WIDTH] <= y[i : i + WIDTH] else (b, a)
        lcp[b] = shared
        return a, b

    winners = [*range(len(runs)), *[-1] * (k - len(runs))]
    width = k
    while width > 1:
        width //= 2
        pairs = [play(winners[2 * i], winners[2 * i + 1]) for i in range(width)]
        winners = [w for w, _ in pairs]
        loser[width : 2 * width] = [x for _, x in pairs]
    best = winners[0] if runs else -1
    while best >= 0:
        _, string, more = runs[best][at[best]]
        yield lcp[best], string, more
        leaf, run = best, best
        at[run] += 1
        if at[run] < len(runs[run]):
            lcp[run] = runs[run][at[run]][0]
        else:
            run = -1
        node = (leaf + k) // 2
        while node:
            run, loser[node] = play(run, loser[node])
            node //= 2
        best = run


def sorted_runs(strings: DataFrame) -> DataFrame:
    """The strings in sorted runs: run and no (its place there), lcp, and their other columns."""
    names = [f.name for f in strings.schema.fields]
    at = names.index("string")
    schema = "run long, no int, lcp int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in strings.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column(at).to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            lcps = [0, *(shared_turns(keys[a], keys[b]) for a, b in zip(order, order[1:], strict=False))]
            n = len(order)
            own = [pa.array([(part << 32) + number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(lcps, pa.int32())]
            rows = rows.take(pa.array(order))
            yield from pa.table([*own, *rows.columns], names=["run", "no", "lcp", *names]).to_batches(10_000)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN:
                yield from flush()
                held, number = [], number + 1
        if sum(b.num_rows for b in held):
            yield from flush()

    return strings.mapInArrow(run, schema)


# --- nodes ----------------------------------------------------------------------------------------

SUMS = "n long, least long, children long, leaves long, saved long, ends string, words long"
OUT = (
    "kind string, part int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    f"key binary, string binary, lcp int, side int, sums array<struct<{','.join(x.replace(' ', ':', 1) for x in SUMS.split(', ')) }>>"
)
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_key(string: bytes, depth: int) -> bytes:
    return sha256(string[: depth * WIDTH]).digest()


class Sums:
    """What is known of a node so far; waiting: its finished children, who lack its name."""

    __slots__ = ("children", "ends", "leaves", "least", "n", "saved", "waiting", "words")

    def __init__(self, words: int, n: int = 0, least: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None):
        self.words, self.n, self.least, self.children, self.leaves, self.saved, self.ends = words, n, least, children, leaves, saved, ends
        self.waiting: list[dict] = []

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        if other.least is not None:
            self.least = other.least if self.least is None else min(self.least, other.least)

    def row(self) -> dict:
        return {"n": self.n, "least": self.least, "children": self.children, "leaves": self.leaves, "saved": self.saved, "ends": self.ends, "words": self.words}


class OpenPath:
    """The stack of the merged stream. finish: no range lies before or after it, so all nodes end in it;
    named: other ranges' nodes may wait for the names of its nodes."""

    def __init__(self, part: int, finish: bool, named: bool):
        self.part, self.finish, self.named = part, finish, named
        self.path: list[Sums] = []
        self.first: bytes | None = None
        self.last = b""
        self.left: dict[int, Sums] = {}
        self.edge = -1  # nodes down to this depth begin the range

    def read(self, lcp: int, string: bytes, sums: Iterable[tuple[int, Sums]]) -> Iterator[dict]:
        """Take the next string, and what it adds to the nodes at some depths of its path (all of them
        below lcp)."""
        if self.first is None:
            self.first, self.edge, lcp = string, len(string) // WIDTH if not self.finish else -1, -1
        else:
            yield from self.close(lcp)
        self.last = string
        for depth, own in sums:
            if depth <= lcp:
                self.path[depth].add(own)
            else:
                self.path.append(own)

    def close(self, lcp: int) -> Iterator[dict]:
        """Finish the nodes deeper than lcp."""
        while len(self.path) > lcp + 1:
            depth, node = len(self.path) - 1, self.path.pop()
            if depth <= self.edge:
                self.left[depth] = node
                self.edge = depth - 1
                continue
            for row in node.waiting:
                yield row | {"parent_conv_id": node.least}
            if self.named:
                yield {"kind": "name", "conv_id": node.least, "key": prefix_key(self.last, depth)}
            row = {
                "kind": "node", "conv_id": node.least, "depth": depth, "parent_conv_id": None, "n_convs": node.n, "n_children": node.children,
                "n_leaves": node.leaves if node.children else 1, "saved_tokens": node.saved + (node.n - 1) * node.words, "ends_sha256": node.ends or NOTHING,
            }
            if depth:
                parent = self.path[-1]
                parent.add(Sums(0, node.n, node.least, 1, row["n_leaves"], row["saved_tokens"]))
                parent.waiting.append(row)
            else:
                yield row

    def rest(self) -> Iterator[dict]:
        """At the end of the range: its open strings, and the nodes that wait for theirs."""
        if self.first is None:
            return
        if self.finish:
            yield from self.close(-1)
            return
        common = shared_turns(self.first, self.last)
        depth = len(self.first) // WIDTH
        sides = [(0, self.first, 0, [self.path[d] if d <= common else self.left[d] for d in range(depth + 1)])]
        if self.last != self.first:
            sides.append((1, self.last, common, self.path[common + 1 :]))
        for side, string, lcp, nodes in sides:
            begin = lcp + 1 if side else 0
            for d, node in enumerate(nodes, begin):
                key = prefix_key(string, d) if node.waiting else None
                for row in node.waiting:
                    yield row | {"kind": "waiting", "key": key}
            yield {"kind": "open", "part": self.part, "side": side, "string": string, "lcp": lcp, "sums": [x.row() for x in nodes]}


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def trie_nodes(runs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes; nodes that wait, by key; and names: key and conv_id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, fan = runs.sparkSession, FAN
    schema = to_arrow_schema(spark.createDataFrame([], OUT).schema)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[tuple[int, bytes, tuple]]] = {}
        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("run", "lcp", "string", "words", "n", "c", "ends", "more"))
            for run, lcp, string, *more in zip(*columns, strict=True):
                own = pieces.setdefault(run, [])
                own.append((lcp if own else 0, string, more))
        path = OpenPath(TaskContext.get().partitionId(), False, False)
        out: list[dict] = []
        for lcp, string, (words, n, c, ends, more) in merged(list(pieces.values())):
            depth = len(string) // WIDTH
            new = [(d, Sums(words[d - 1] if d else 0)) for d in range(lcp + 1 if path.first is not None else 0, depth)]
            new.append((depth, Sums(words[depth - 1] if depth else 0, n, c, int(more), int(more), 0, None if more else ends)))
            out += path.read(lcp, string, new)
            if len(out) >= 10_000:
                yield from _table(out, schema).to_batches()
                out = []
        out += path.rest()
        yield from _table(out, schema).to_batches()

    def merge(finish: bool):
        def run(rows: pa.Table) -> pa.Table:
            rows = sorted(rows.select(["part", "side", "string", "lcp", "sums"]).to_pylist(), key=lambda r: (r["part"], r["side"]))
            path = OpenPath(rows[0]["part"] // fan, finish, True)
            out: list[dict] = []
            for r in rows:
                begin = r["lcp"] + 1 if r["side"] else 0
                sums = [(d, Sums(**x)) for d, x in enumerate(r["sums"], begin)]
                lcp = r["lcp"] if r["side"] else shared_turns(path.last, r["string"])
                out += path.read(lcp, r["string"], sums)
            out += path.rest()
            return _table(out, schema)

        return run

    ranges = runs.repartitionByRange(parts, "string").sortWithinPartitions("run", "no")
    rounds = [cut(ranges.mapInArrow(local, OUT))]
    parts = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1
    while True:
        finish = parts <= fan
        rounds.append(cut(rounds[-1].where("kind = 'open'").groupBy(F.expr(f"part div {fan}")).applyInArrow(merge(finish), OUT)))
        if finish:
            break
        parts = -(-parts // fan)
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    waiting = out.where("kind = 'waiting'").select("key", *[x for x in NODE if x != "parent_conv_id"])
    return out.where("kind = 'node'").select(*NODE), waiting, out.where("kind = 'name'").select("key", F.col("conv_id").alias("parent_conv_id"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    turns, lengths = rebuilt(conversations)
    kept = cut(string_lengths(turns, lengths))
    cuts = kept.where("kept < turns")
    cuts = cut(cuts) if not cuts.isEmpty() else None
    heads, tails = turns, None
    if cuts is not None:
        # a long conversation is a hot key here, so its few facts come to the rows by a checked broadcast
        sized = turns.groupBy("c").agg(F.count(F.lit(1)).alias("rows_of")).join(cuts, "c")
        after = lookup(turns, sized, "c", "rows_of")
        tails = after.where("d > kept")
        heads = turns.join(kept.where("kept = turns").select("c"), "c", "left_semi").unionByName(after.where("d <= kept").select(*turns.columns))
    strings = (
        heads.groupBy("c")
        .agg(F.array_sort(F.collect_list(F.struct("d", "digest", "words"))).alias("all"))
        .join(kept, "c", "right")
        .select(
            "c",
            F.coalesce(F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["digest"])), "")), F.lit(b"")).alias("string"),
            F.coalesce(F.transform("all", lambda x: x["words"]), F.array().cast("array<int>")).alias("words"),
            (F.col("kept") < F.col("turns")).alias("more"),
        )
        .withColumn("s", F.unhex(F.sha2("string", 256)))
    )
    strings = cut(strings)
    single = cut(strings.join(ends_of(strings.select("s", "c")), ["s", "c"]).drop("s"))
    runs = cut(sorted_runs(single))
    nodes, waiting, names = trie_nodes(runs, parts_of(runs, STRINGS))
    counted = cut(waiting.groupBy("key").agg(F.count(F.lit(1)).alias("rows_of")).join(names, "key"))
    out = nodes.unionByName(lookup(waiting, counted, "key", "rows_of").select(*NODE))
    if tails is not None:
        last = F.col("d") == F.col("turns")
        out = out.unionByName(
            tails.select(
                F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
            )
        )
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_conversation_trie": op12}
SQL = {
    "op12_conversation_trie": f"""
WITH turns AS (
  SELECT conv_id AS c, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) - 1 AS i FROM turns),
convs AS (SELECT c, {crc32_sql("c::VARCHAR")} % {BORROWED} AS h FROM (SELECT DISTINCT c FROM turns)),
both_parts AS (
  SELECT v.c, 0 AS part, n.i, n.t, n.words FROM convs v JOIN numbered n ON n.c = v.c - v.c % {LENDER} AND n.i < v.h
  UNION ALL
  SELECT v.c, 1, n.i, n.t, n.words FROM convs v JOIN numbered n ON n.c = v.c AND n.i >= v.h),
rebuilt AS (SELECT c, t, words, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d FROM both_parts),
paths AS (
  SELECT c, d, words, string_agg(t, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM rebuilt
  UNION ALL
  SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(d) AS len FROM paths GROUP BY c),
nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256
  FROM paths JOIN lengths USING (c) GROUP BY p, d),
counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND starts_with(k.p, n.p)) AS n_children FROM nodes n)
SELECT a.conv_id, a.d::BIGINT AS depth, any_value(u.conv_id) AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  count(*) FILTER (b.n_children = 0)::BIGINT AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, a.ends_sha256
FROM counted a
JOIN counted b ON b.d >= a.d AND starts_with(b.p, a.p)
LEFT JOIN nodes u ON u.d = a.d - 1 AND starts_with(a.p, u.p)
GROUP BY a.p, a.conv_id, a.d, a.n_convs, a.n_children, a.ends_sha256
"""
}
