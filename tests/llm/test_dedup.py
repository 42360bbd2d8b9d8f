import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pitchside.llm import line_dedup, near, prob_minhash, suffix_dedup
from pitchside.llm.common import NULL_ID, shingle_hashes
from pitchside.llm.near import components
from pitchside.llm.suffix_sort import BlindTrie, deep_shallow

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def place(i):
    return NULL_ID if i is None else i


def line_truth(rows):
    held = defaultdict(set)
    keyed = [(i, [(x, x.strip(BLANK).translate(LOWER)) for x in (t or "").split("\n")]) for i, t, *_ in rows]
    for i, lines in keyed:
        for _, k in lines:
            if len(k) >= 20:
                held[k].add(place(i))
    out = []
    for i, lines in keyed:
        left = [x for x, k in lines if len(held.get(k, ())) < 3 or place(i) == max(held[k])]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def passage_truth(rows):
    first = {}
    texts = [(place(i), (t or "").encode()) for i, t, *_ in rows]
    for i, b in texts:
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for (i, b), (doc_id, *_) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_lines_against_brute_force(docs, rows):
    got = Counter(tuple(r) for r in line_dedup.line_report(docs).collect())
    assert got == line_truth(rows)
    assert sum(n for (*_, dropped, _), n in got.items() if dropped) > 3


def test_lines_in_many_slices(docs, rows):
    """Filters of 64 keys each, nearly full, and slices tested in several tasks: the same result."""
    before = line_dedup.SLICE_KEYS, line_dedup.HELD
    line_dedup.SLICE_KEYS, line_dedup.HELD = 8, 16
    try:
        got = Counter(tuple(r) for r in line_dedup.line_report(docs).collect())
    finally:
        line_dedup.SLICE_KEYS, line_dedup.HELD = before
    assert got == line_truth(rows)


def test_lines_keep_columns(docs, rows):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert out.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())


def test_no_documents(no_docs):
    assert line_dedup.line_report(no_docs).count() == 0
    assert suffix_dedup.passage_report(no_docs).count() == 0
    assert prob_minhash.near_duplicates(no_docs).count() == 0


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    every = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    parts = [np.concatenate([every[i::3], every[:500]]) for i in range(3)]
    filters = []
    for p in parts:
        f = line_dedup.TwoFilters(1 << 20)
        for i in range(0, len(p), 100):
            f.add(p[i : i + 100])
        filters.append(f)
    once, twice = filters[0].once, filters[0].twice
    for f in filters[1:]:
        twice = twice | f.twice | (once & f.once)
        once = once | f.once
    hit = line_dedup._has(twice, line_dedup._probes(every, 1 << 20))
    assert hit[:500].all()
    assert hit[500:].mean() < 0.05


@pytest.mark.parametrize("hot", [1000, 0])
def test_passages_against_brute_force(docs, rows, hot):
    got = Counter(tuple(r) for r in suffix_dedup.passage_report(docs, hot).collect())
    assert got == passage_truth(rows)


def test_passages_keep_columns(docs, rows):
    out = suffix_dedup.dedup_passages(docs)
    assert out.columns == docs.columns
    assert out.count() == len(rows)


def test_deep_shallow_is_a_sort():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (500, 50)).astype(np.uint8)
    rows[100:300, :44] = rows[0, :44]  # long common prefixes: blind tries
    rows[300:320] = rows[1]
    order, lcp = deep_shallow(rows)
    texts = [rows[i].tobytes() for i in order]
    assert texts == sorted(r.tobytes() for r in rows)
    for a in range(1, len(texts)):
        n = next((j for j in range(50) if texts[a][j] != texts[a - 1][j]), 50)
        assert lcp[a] == n


def test_blind_trie_orders():
    words = [b"abcd", b"abce", b"abxd", b"zzzz", b"abcd", b"aacd"]
    trie = BlindTrie()
    for i, w in enumerate(words):
        trie.insert(w, i)
    assert [words[i] for i in trie.items()] == sorted(words)
    assert BlindTrie().items() == []


def test_prob_minhash_estimates():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 2**63, 400, dtype=np.uint64), rng.integers(1, 2**63, 100, dtype=np.uint64)
    h = np.concatenate([a, a[:300], b])
    doc = np.repeat([0, 1], [400, 400])
    sig = prob_minhash.prob_minhash(doc, h, np.ones(800), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.05
    one = prob_minhash.prob_minhash(np.zeros(1, int), np.array([7], np.uint64), np.ones(1), 1)
    assert (one == 7).all()


def row_truth(rows):
    """Each row's class and id, and each class's least id, by all pairs of texts (ids don't count)."""
    grams = []
    for _, t, *_ in rows:
        h, _ = shingle_hashes([t])
        grams.append(set(h.tolist()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, t, *_) in enumerate(rows):
        for y in range(x):
            _, u, *_ = rows[y]
            both = len(grams[x] & grams[y])
            alike = grams[x] and grams[y] and both >= 0.8 * (len(grams[x]) + len(grams[y]) - both)
            if alike or (t or "") == (u or ""):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    least = {}
    for x, (i, *_) in enumerate(rows):
        least[root(x)] = min(least.get(root(x), 2**63), place(i))
    return [(root(x), place(i)) for x, (i, *_) in enumerate(rows)], least


def class_truth(rows):
    """Least id of each id's class, where ids are distinct."""
    found, least = row_truth(rows)
    return {i: least[c] for c, i in found}


def test_near_duplicates_against_all_pairs(docs, rows):
    got = prob_minhash.near_duplicates(docs).collect()
    found, least = row_truth(rows)
    assert sorted((place(r["doc_id"]), place(r["class_id"])) for r in got) == sorted((i, least[c]) for c, i in found)
    kept = prob_minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(place(r["doc_id"]) for r in kept.collect()) == sorted(least.values())


def test_links_outside_a_star_are_found(spark, tmp_path):
    """A chain: each is close to the next only, so the star around the least one misses most links."""
    words = [f"t{i}" for i in range(300)]
    chain = [" ".join(words[3 * i : 3 * i + 60]) for i in range(25)]
    chain_rows = [(i, t) for i, t in enumerate(chain)]
    path = tmp_path.as_uri() + "/chain"
    spark.createDataFrame(chain_rows, "doc_id long, text string").write.parquet(path)
    got = prob_minhash.near_duplicates(spark.read.parquet(path)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == class_truth(chain_rows)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["c"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_rows_of_one_id_are_as_alike_as_their_texts(spark, tmp_path):
    """Ids that are null or repeated: unrelated texts stay, near copies of any of them are found."""
    text = lambda x: " ".join(f"{x}{i}" for i in range(80))
    rows = [(None, text(x)) for x in "abcde"] + [(7, text(x)) for x in "fghij"]
    rows += [(20 + n, text(x) + " more") for n, x in enumerate("abcdefghij")]
    path = tmp_path.as_uri() + "/ids"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted(r["text"] for r in prob_minhash.drop_near_duplicates(docs).collect()) == sorted(t for _, t in rows[:10])
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(docs).collect()}
    assert got == {None: None, 7: 7} | {20 + n: None if n < 5 else 7 for n in range(10)}


def test_large_buckets_lose_no_link(spark, tmp_path, monkeypatch):
    """Pairs of near copies among texts that share half of their words: by joined buckets, then by further bands."""
    from pitchside.llm import near

    base = [f"b{i}" for i in range(70)]
    rows = []
    for k in range(30):
        own = [f"k{k}x{i}" for i in range(40)]
        rows += [(2 * k, " ".join(base + own)), (2 * k + 1, " ".join(base + own + ["end"]))]
    path = tmp_path.as_uri() + "/large"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    monkeypatch.setattr(near, "SMALL", 3)
    for whole, depth in ((1000, 3), (4, 1)):
        monkeypatch.setattr(near, "WHOLE", whole)
        monkeypatch.setattr(near, "DEPTH", depth)
        got = prob_minhash.near_duplicates(spark.read.parquet(path)).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == class_truth(rows)


def test_similar_documents_of_a_single_band_in_a_parted_bucket(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 3)
    monkeypatch.setattr(near, "WHOLE", 5)
    grams = lambda i: np.sort(np.arange(20, dtype=np.uint64) + np.uint64(1000 * (i // 2)) + np.uint64(i % 2)).tobytes()
    sets = spark.createDataFrame([(i, grams(i)) for i in range(30)], "id long, grams binary")
    bands = spark.createDataFrame([(i, 7) for i in range(30)] + [(i, 100 + i) for i in range(30)], "id long, key long")
    got = near.link(bands, lambda ids: sets, 0.8)
    assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in got.collect()} == {(i, i + 1) for i in range(0, 30, 2)}
