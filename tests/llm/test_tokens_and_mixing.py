import hashlib
from collections import Counter

import numpy as np
import pytest

from pitchside.llm import mixing, tokens


def test_tokens_are_those_of_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    t = Tokenizer.from_file(path)
    extra = ["<|endoftext|>a<|startoftext|> b", "ΣΑΣ İstanbul ẞ é", "don't '9's 12３", "a\x1cb\x85c　d"]
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(extra)], "doc_id long, text string")
    got = tokens.report(docs.select("doc_id", "text").union(more)).collect()
    assert len(got) == len(rows) + len(extra)

    def truth(i, x):
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()))

    want = [truth(i, x) for i, x, *_ in rows] + [truth(1000 + i, x) for i, x in enumerate(extra)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ids_decode_again(docs, rows):
    encoded = tokens.encode(docs)
    texts = {r["doc_id"]: r["text"] for r in tokens.decode(encoded).collect()}
    for r in encoded.collect():
        if r["doc_id"] is not None:
            assert hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"]
            assert len(r["ids"]) == r["n_tokens"]


def test_no_tokens(no_docs):
    assert tokens.report(no_docs).count() == 0


def test_targets_stop_at_their_cap():
    got = mixing.targets([("b", 100), ("a", 10), (None, 50), ("c", 0)])
    assert [g[0] for g in got] == ["a", "b", "c", None]
    assert sum(g[2] for g in got) == pytest.approx(1.5 * 160)
    assert all(t <= 2 * n + 1e-9 for _, n, t in got)
    assert got[0][2] == 20
    assert mixing.targets([]) == []


def test_splitting_tree_is_exact():
    q = np.array([100, 7, 0, 33])
    got = mixing.split_quotas(q, 8)
    assert (got.sum(axis=1) == q).all()
    assert got.sum(axis=0).max() - got.sum(axis=0).min() <= 3
    assert (got == mixing.split_quotas(q, 8)).all()


def test_plan_meets_targets(docs, no_docs, rows):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for s, rs in by.items():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 0.5, s
    again = mixing.plan(docs.repartition(5)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.plan(no_docs).count() == 0


def test_mix_repeats_whole_rows(docs, no_docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    there, n = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    assert not set(n) - set(there)
    assert max(n[r] / there[r] for r in n) == 2
    assert mixing.mix(no_docs).count() == 0


def test_op8_against_sql_and_a_plain_tree(spark, tmp_path):
    """Words by SQL; the copies in each shard by the tree and permutation in plain Python."""
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(700)]
    rows += [(None, "a null id", "s1"), (3, None, "s2"), rows[5], rows[5]]
    path = tmp_path.as_uri()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    before = mixing.BLOCK_WORDS, mixing.SHARD_BYTES, mixing.TOP_NODES
    mixing.BLOCK_WORDS, mixing.SHARD_BYTES, mixing.TOP_NODES = 100, 5_000, 4
    try:
        got = mixing.op8(spark, path).collect()
        m = mixing.Mix(spark.read.parquet(f"{path}/documents.parquet"))
        blocks = m.handed.collect()
    finally:
        mixing.BLOCK_WORDS, mixing.SHARD_BYTES, mixing.TOP_NODES = before
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path[7:]}/documents.parquet/*.parquet'")
    want = db.sql(mixing.CONTRACT_SQL).fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(key((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"])) for r in got) == sorted(map(key, want))
    assert all((r["taken"] > 0) <= (r["shards"] != "") for r in got)
    assert all(r["taken"] >= r["size"] * (r["shards"].count(",") if r["shards"] else 0) for r in got)
    # shards draw disjoint places, and as many of each source as the tree gives them
    names = sorted({b["s"] for b in blocks}, key=lambda s: (s == "", s))
    quotas = np.array([sum(len(b["drawn"] or []) for b in blocks if b["s"] == s) for s in names])
    shares = mixing.split_quotas(quotas, m.shards)
    assert m.shards > 4 and (shares.sum(axis=1) == quotas).all()
    assert shares.sum(axis=0).max() - shares.sum(axis=0).min() <= np.log2(m.shards) + 1
    counts = Counter((b["s"], d["shard"]) for b in blocks for d in b["drawn"] or [])
    assert counts == Counter({(s, k): n for s, row in zip(names, shares.tolist(), strict=True) for k, n in enumerate(row) if n})


def test_draws_follow_the_tree(spark):
    quotas = np.array([40, 3, 0, 77])
    got = mixing.draws(spark, ["=a", "=b", "=c", ""], quotas, 9).collect()
    assert Counter(r["s"] for r in got) == {"=a": 40, "=b": 3, "": 77}
    assert len({(r["s"], r["place"]) for r in got}) == 120
    want = mixing.split_quotas(quotas, 9)
    assert Counter((r["s"], r["shard"]) for r in got) == Counter({(s, k): n for s, row in zip(["=a", "=b", "=c", ""], want.tolist(), strict=True) for k, n in enumerate(row) if n})
