"""Links between similar documents: candidates by bands, exact verification, classes.

Candidates are documents that share a bucket of a band. Within a bucket every document is compared
with the least one (a star, as many pairs as members). Where the documents of one bucket are then
still in different classes, they are compared bucket by bucket: those outside the bucket's largest
class with all its members, so no link is lost and no bucket is capped. Buckets of more than SMALL
that share documents are taken together, so that their documents are compared once and not once for
each band, in blocks. Where that makes more than WHOLE documents, the buckets are parted first by a
second band (then a third ...) that their members share: similar documents share many bands, so most
meet in one of the parts, and the parts of documents that met by chance are small. What is large
still after DEPTH bands is compared whole. Two similar documents may share a single band, so buckets
that were parted are compared last, as they were, where they still hold several classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import FEW_KEYS, cut, id_or_null, lookup, map_arrow, pieces, shingle_hashes, slices, weight_of

#: Documents of a bucket that is compared at once, and of a block of a larger one.
SMALL = 200
BLOCK_ROWS = 1_000
#: Documents of joined buckets that are compared at once: each is copied to WHOLE / BLOCK_ROWS blocks at most.
WHOLE = 20_000
#: Bands by which a large bucket is split before it is compared in blocks.
DEPTH = 3
#: Pairs that read one copy of a document's shingle set.
SALT_ROWS = 1_000
#: Bits of a bitmap of ids for each id, and in all (128 MB) at most.
BITS_PER_ID, MOST_BITS = 16, 2**30


def shared_buckets(bands: DataFrame) -> DataFrame:
    """The rows of bands (key, id, path) in buckets of several, with the bucket's least id a and size n."""
    found = cut(
        bands.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("a")).where("rows > 1").withColumn("n", F.col("rows"))
    )
    return cut(lookup(bands, found, "key", "rows").select("key", "id", "path", "a", "n"))


def stars(shared: DataFrame) -> DataFrame:
    """a, b: each member of a bucket with its least, once."""
    return shared.where("id <> a").select("a", F.col("id").alias("b")).distinct()


def shingle_sets(texts: DataFrame, keep: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """id and the sorted distinct shingle hashes of id, text; keep: takes some rows of a batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if keep:
            batch = keep(batch)
        out, values = [], batch.column(1).to_pylist()
        for a, b in pieces(values):
            h, at = shingle_hashes(values[a:b])
            out += [np.unique(h[i:j]).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "grams"])

    return map_arrow(texts, run, "id long, grams binary")


def jaccard(a: bytes, b: bytes) -> float:
    """Likeness of two sorted sets; of two empty ones 1."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def verified(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose shingle sets are as similar as that, with the likeness.

    A document with many pairs has its set copied once for every SALT_ROWS of them.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        j = np.array([jaccard(x, y) for x, y in zip(a, b, strict=True)])
        keep = pa.array(j >= similarity)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(j).filter(keep)],
            ["a", "b", "likeness"],
        )

    pairs = cut(pairs.select("a", "b"))
    hubs = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("copies", F.ceil(F.col("n") / SALT_ROWS).cast("int")))
    weight = weight_of(hubs, "n")
    left = grams.withColumnRenamed("id", "a").withColumnRenamed("grams", "grams_a")
    right = grams.withColumnRenamed("id", "b").withColumnRenamed("grams", "grams_b")
    on = ["a"]
    if weight[1] > SALT_ROWS:
        on = ["a", "salt"]
        pairs = lookup(pairs, hubs, "a", "n", weight).withColumn("salt", F.pmod(F.xxhash64("b"), "copies").cast("int")).drop("copies")
        left = left.join(hubs.hint("shuffle_merge"), "a").select("a", "grams_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    both = pairs.join(left.hint("shuffle_merge"), on).join(right.hint("shuffle_merge"), "b")
    return map_arrow(both.select("a", "b", "grams_a", "grams_b"), run, "a long, b long, likeness double")


def components(links: DataFrame) -> DataFrame:
    """id and c, the least id of its class, for every id of links (a, b).

    First each document's links to smaller ones become one to the least of them, and those are linked
    with it: as connected as before, with about one link a document in place of one for each band.
    Least labels then spread along the links and labels jump to their label's label, until none
    changes; the rounds grow with the logarithm of the longest chain. Hubs and the labels of large
    classes are looked up without meeting in one task.
    """
    ends = cut(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    least = cut(ends.groupBy("hi").agg(F.min("lo").alias("least"), F.count(F.lit(1)).alias("n")))
    tied = (
        lookup(ends, least, "hi", "n")
        .select(F.col("least").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))
        .where("a <> b")
        .distinct()
    )
    # every id is its own neighbour too
    both = cut(tied.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u in "ab" for v in "ab"])).alias("e")).select("e.*").distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("c"), F.count(F.lit(1)).alias("n")))
    weight = weight_of(label, "n")
    few = weight[2] <= FEW_KEYS
    while True:
        seen = label.select(F.col("u").alias("v"), F.col("c").alias("cv"), "n")
        near = (
            (both.join(F.broadcast(seen.drop("n")), "v") if few else lookup(both, seen, "v", "n", weight))
            .groupBy("u")
            .agg(F.min("cv").alias("to"), F.max(F.when(F.col("u") == F.col("v"), F.col("cv"))).alias("old"), F.count(F.lit(1)).alias("n"))
        )
        far = label.select(F.col("u").alias("to"), F.col("c").alias("far"))
        if few:
            jumped = near.join(F.broadcast(far), "to")
        else:
            near = cut(near)
            sizes = near.groupBy("to").agg(F.count(F.lit(1)).alias("members"))
            jumped = lookup(near, far.join(sizes.hint("shuffle_merge"), "to"), "to", "members", weight_of(sizes, "members"))
        new = cut(jumped.select("u", F.least("to", "far").alias("c"), "n", "old"))
        changed = new.where("c <> old").limit(1).count()
        label = new.drop("old")
        if not changed:
            return label.select(F.col("u").alias("id"), "c")


def _mixed(shared: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes: key, id, path, a, c, n, main (the largest class).

    The least of a bucket has been compared with all of them, so it is left out.
    """
    plain = shared.where("id <> a and n > 2").select("key", "id", "path", "a", (F.col("n") - 1).alias("n"))
    members = cut(_with_class(plain, label))
    return cut(lookup(members, _main_classes(members).drop("n"), "key", "rows"))


def _main_classes(members: DataFrame) -> DataFrame:
    """key, rows and n (its members), main (its largest class) of the keys of members (key, c) that hold several."""
    return cut(
        members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("key")
        .agg(F.sum("m").alias("rows"), F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("classes"))
        .where("classes > 1")
        .select("key", "rows", F.col("rows").alias("n"), F.col("top.c").alias("main"))
    )


def _with_class(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with c, the class of id (the id itself where label lacks it)."""
    few = label.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    found = F.broadcast(label.select("id", "c")) if few else label.select("id", "c").hint("shuffle_merge")
    return rows.join(found, "id", "left").withColumn("c", F.coalesce("c", "id"))


def _compared(mixed: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """a, b, likeness: links between classes in the buckets of mixed.

    The documents outside a bucket's main class meet all its members by their whole shingle sets;
    what comes back is one link for each of them and class. A bucket of more than BLOCK_ROWS is dealt
    into blocks, and those documents go to each.
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = F.array(F.struct(F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind")))
    to_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.lit(1).alias("kind")))
    asks = F.col("c") != F.col("main")
    placed = mixed.withColumn("blocks", blocks).select(
        "key", "id", "c", (asks & (F.col("blocks") == 1)).alias("ask"), F.explode(F.when(asks & (F.col("blocks") > 1), F.concat(own, to_all)).otherwise(own)).alias("at")
    )
    rows = placed.select("key", "at.*", "id", "c", "ask").join(grams.hint("shuffle_merge"), "id").select("key", "block", "kind", "id", "c", "ask", "grams")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, block = None, None
        for batch in (part for whole in batches for part in slices(whole)):
            found: list[tuple] = []
            for key, at, kind, i, c, ask, grams_ in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (key, at) != place:
                    if block:
                        found += block.asked()
                    place, block = (key, at), _Block(similarity)
                mine = np.frombuffer(grams_, np.uint64)
                if kind == 0:
                    block.rows.append((i, c, mine, ask))
                else:
                    found += block.links(i, c, mine)
            yield _links(found)
        if block:
            yield _links(block.asked())

    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "kind").mapInArrow(compare, "a long, b long, likeness double")


def _links(found: list[tuple]) -> pa.RecordBatch:
    a, b, likeness = zip(*found, strict=True) if found else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(likeness, pa.float64())], ["a", "b", "likeness"])


class _Block:
    """Documents of a bucket, to be compared with single ones: rows are id, class, shingle set, asks."""

    def __init__(self, similarity: float):
        self.rows: list[tuple] = []
        self.similarity = similarity
        self.flat: np.ndarray | None = None

    def links(self, i: int, c: int, mine: np.ndarray) -> list[tuple]:
        """A link (i, other, likeness) to each class but c that has a similar document."""
        if not self.rows:
            return []
        if self.flat is None:
            self.flat = np.concatenate([r[2] for r in self.rows])
            self.size = np.array([len(r[2]) for r in self.rows])
            self.begin = np.cumsum(self.size) - self.size
            self.ids, self.classes = np.array([r[0] for r in self.rows]), np.array([r[1] for r in self.rows])
        n = len(mine)
        near = np.flatnonzero((self.classes != c) & (np.minimum(self.size, n) >= self.similarity * np.maximum(self.size, n)))
        if not len(near):
            return []
        at = np.searchsorted(mine, self.flat)
        common = np.add.reduceat(mine[np.minimum(at, n - 1)] == self.flat, self.begin)[near]
        j = common / (self.size[near] + n - common)
        alike = near[j >= self.similarity]
        _, first = np.unique(self.classes[alike], return_index=True)
        return list(zip([i] * len(first), self.ids[alike[first]].tolist(), j[j >= self.similarity][first].tolist(), strict=True))

    def asked(self) -> list[tuple]:
        return [x for i, c, mine, ask in self.rows if ask for x in self.links(i, c, mine)]


def link(bands: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """a, b, likeness: links that connect every two similar documents that share a bucket.

    bands: id and key. sets: shingle sets (id, grams) for a table of ids, or of more.
    """
    shared = level = shared_buckets(bands.select("key", "id", F.array("key").alias("path")))
    grams = cut(sets(shared.select("id").distinct()))
    links = cut(verified(stars(shared), grams, similarity))
    parted: DataFrame | None = None
    for depth in range(DEPTH + 1):
        mixed = _mixed(level, components(links))
        some, many = mixed.agg(F.count_if(F.col("n") <= SMALL), F.count_if(F.col("n") > SMALL)).first()
        if some:
            links = cut(links.unionByName(_compared(mixed.where(F.col("n") <= SMALL), grams, similarity)))
        if not many:
            break
        large = mixed.where(F.col("n") > SMALL)
        joined = components(large.select("a", F.col("id").alias("b"))).withColumnRenamed("c", "g")
        members = cut(large.select("id", "c").distinct().join(joined.hint("shuffle_merge"), "id").select(F.col("g").alias("key"), "id", "c"))
        members = cut(lookup(members, _main_classes(members), "key", "rows"))
        whole = F.lit(True) if depth == DEPTH else F.col("n") <= WHOLE
        links = cut(links.unionByName(_compared(members.where(whole), grams, similarity)))
        rest = members.where(~whole)
        if depth == DEPTH or not rest.limit(1).count():
            break
        if parted is None:  # deeper parts lie within these
            parted = cut(large.select("id", "key").join(rest.select("id").distinct(), "id", "left_semi").select("key").distinct())
        parts = (
            large.select("id", "path").join(rest.select("id").distinct(), "id", "left_semi")
            .join(shared.select("id", F.col("key").alias("next")).hint("shuffle_merge"), "id")
            .where("not array_contains(path, next)")
            .select("id", F.array_sort(F.concat("path", F.array("next"))).alias("path"))
            .select("id", F.xxhash64("path").alias("key"), "path")
            .distinct()
        )
        level = shared_buckets(parts)
        links = cut(links.unionByName(verified(stars(level), grams, similarity)))
    if parted is not None:
        mixed = _mixed(shared.join(parted.hint("shuffle_merge"), "key", "left_semi"), components(links))
        links = cut(links.unionByName(_compared(mixed, grams, similarity)))
    return links


def bitmap_of(ids: DataFrame, by: list[str], bits: int) -> np.ndarray:
    """A bitmap of hashes of the columns by: what it lacks is not among them."""
    slot = F.pmod(F.xxhash64(*by), F.lit(bits))
    rows = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros((bits // 32_768 + 2, 4_096), np.uint8)
    for row in rows.toLocalIterator():  # as large as one bitmap
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """id and shingle hashes of (at least) the rows of docs (id, text and by) whose columns by are in ids.

    No text is shuffled. The bitmap follows the number of ids up to MOST_BITS; beyond it more
    documents pass and are computed for nothing.
    """
    ids = cut(ids)
    bits = min(MOST_BITS, 1 << max(20, (BITS_PER_ID * ids.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids, by, bits))
    slot = F.pmod(F.xxhash64(*by), F.lit(bits))
    placed = docs.select("id", "text", F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, bit = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        hit = (shared.value[bucket, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return batch.filter(pa.array(hit.astype(bool)))

    return shingle_sets(placed, keep)


# --- classes of texts -----------------------------------------------------------------------------


def text_hash(salt: int):
    """64 bits of the text's SHA-256; other bits for another salt."""
    return F.xxhash64(F.lit(salt), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def text_classes(docs: DataFrame, rows: DataFrame, banded: DataFrame, similarity: float) -> DataFrame:
    """For each distinct text of docs: node, rep (least id), copies, c and first.

    rows: id, node and check (two hashes of the text) of each row of docs, cheap to read again.
    banded: node, id and keys (bucket of each band) of the rows with words. c is the least id of the
    class, first the node of its text of that id.
    """
    texts = cut(
        rows.groupBy("node").agg(
            F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("low"), F.max("check").alias("high")
        )
    )
    if texts.where("low <> high").limit(1).count():
        raise ValueError("two texts have one hash")  # less than one chance in 30,000 for 30 million texts
    texts = texts.drop("low", "high")
    # one row stands for each distinct text
    bands = cut(
        banded.join(texts.select("node", F.col("rep").alias("id")), ["node", "id"], "left_semi")
        .select(F.col("node").alias("id"), F.explode("keys").alias("key"))
        .distinct()
    )
    named = docs.select(text_hash(0).alias("id"), id_or_null().alias("doc"), "text")

    def sets(ids: DataFrame) -> DataFrame:
        wanted = ids.join(texts.select(F.col("node").alias("id"), F.col("rep").alias("doc")).hint("shuffle_merge"), "id")
        return sets_of(named, wanted, ["id", "doc"]).dropDuplicates(["id"])

    label = components(link(bands, sets, similarity))
    placed = cut(
        _with_class(texts.withColumnRenamed("node", "id"), label).select(F.col("id").alias("node"), "rep", "copies", F.col("c").alias("g"))
    )
    least = cut(placed.groupBy("g").agg(F.min(F.struct("rep", "node")).alias("least"), F.count(F.lit(1)).alias("m")))
    return cut(lookup(placed, least, "g", "m").select("node", "rep", "copies", F.col("least.rep").alias("c"), F.col("least.node").alias("first")))
