import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from pitchside.llm import manifest, ranks
from tests.llm.conftest import SCHEMA


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def truth(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows by whole lists."""
    sources = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        changed = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        sources[source].append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, changed)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in sources[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for j, (i, first, changed) in enumerate(sources[s]):
            node, proof = changed, ""
            for tree, k in ((trees[s], j), (top, at)):
                for nodes in tree[:-1]:
                    run = nodes[k - k % 3 : k - k % 3 + 3]
                    proof += "".join(run[: k % 3] + run[k % 3 + 1 :])
                    node = digest(*run[: k % 3], node, *run[k % 3 + 1 :])
                    k //= 3
            out.append((i, first, trees[s][-1][0], top[-1][0], digest(proof), node, node == top[-1][0]))
    return Counter(out)


def result(docs):
    got = manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return Counter(tuple(r) for r in got.collect())


def test_manifest_of_odd_rows(docs, no_docs, rows):
    assert result(docs) == truth(rows)
    assert not result(no_docs)


@pytest.mark.parametrize("count", [1, 10])
def test_few_rows(spark, count):
    rows = [(i, f"a\n{i}", "en", f"s{i % 2}", 3, i, "k", 0.5, "c", "w") for i in range(count)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == truth(rows)


def test_many_ranges_and_rounds(spark, monkeypatch):
    """A source with a third of all rows, many equal rows and many small sources over many ranges."""
    monkeypatch.setattr(manifest, "LEAVES", 40)
    monkeypatch.setattr(manifest, "FAN", 3)
    rng = random.Random(3)
    rows = [(i, f"text {i}\nend", "en", "hot" if i % 3 == 0 else f"s{rng.randrange(60)}", i, i, "k", 0.5, "c", "w") for i in range(900)]
    rows += [(None, "same", None, "hot", None, 1, "k", 0.5, "c", "w")] * 200
    rng.shuffle(rows)
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == truth(rows)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_merging_is_associative():
    """Fragments of any cuts, summed in any order, come to the same forest."""
    rng = random.Random(4)
    for n in (1, 2, 7, 28, 100):
        leaves = [sha256(bytes([i])).digest() for i in range(n)]
        whole = {0: dict(enumerate(leaves))}
        runs = {(level, i) for level, i, _ in manifest.settle(whole, n)}
        parts = [{0: {i: leaves[i]}} for i in range(n)]
        met = set()
        while len(parts) > 1:
            a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
            both = {level: {**a.get(level, {}), **b.get(level, {})} for level in {*a, *b}}
            met |= {(level, i) for level, i, _ in manifest.settle(both, n)}
            parts.append(both)
        tidy = lambda f: {level: here for level, here in f.items() if here}
        assert tidy(parts[0]) == tidy(whole) and met == runs
        assert list(tidy(whole)) == [manifest.height(n)]


def test_equal_keys_are_dealt_to_ranges(spark, tmp_path):
    """No range grows with a key or with equal rows."""
    from pitchside.llm.common import cut
    from pyspark.sql import functions as F

    rows = cut(ranks.salted(spark.range(2000).select(F.lit("one").alias("s"), F.lit(1).alias("doc_id"))))
    ordered, starts, parts = ranks.placed(rows, "s", ["doc_id"], 100)
    assert 10 <= parts <= 20
    assert ordered.groupBy("part").count().agg(F.max("count")).first()[0] < 400
    got = starts.orderBy("part").collect()
    assert [r["begin"] for r in got] == [sum(x["cnt"] for x in got[:i]) for i in range(len(got))]
    assert {r["n"] for r in got} == {2000}
