"""The pipeline against the same stages by brute force, on a small table."""

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pitchside.llm import mixing, quality, tokens  # noqa: E402
from pitchside.llm.common import cut  # noqa: E402
from tests.llm.test_dedup import BLANK, LOWER, class_truth  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    path = tmp_path_factory.mktemp("sf").as_uri()
    words = [f"{a}{b}" for a in ("ri", "sto", "lan", "mer") for b in ("ver", "ne", "den", "cury", "ta")]
    text = lambda n: ". ".join(" ".join(rng.choice(words, 8)) for _ in range(n))
    rows = []
    for i in range(120):
        t = f"{text(5)}\nA boilerplate line that many documents share\n{text(3)}" if i % 6 == 0 else text(8)
        t = " | ".join(f"{w.upper()}###!!" for w in rng.choice(words, 40)) if i % 5 == 1 else t
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
    rows += [(200 + i, rows[i][1] + (" more" if i % 2 else ""), "en", "s0", 1) for i in range(0, 30, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 5 != 1), 0) for i in range(120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {(r["doc_id"]): r for r in docs.collect()}
        docs = cut(stage(spark, docs, path))
        held[name] = (before, docs.collect())
        if name != "encoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    before, after = held["quality classifier"]
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for i in range(120) if i % 5 != 1)
    assert not any(i in kept for i in range(120) if i % 5 == 1 and zlib.crc32(str(i).encode()) % 5)
    before, after = held["line dedup"]
    seen = {}
    for i, r in before.items():
        for x in r["text"].split("\n"):
            k = x.strip(BLANK).translate(LOWER)
            if len(k) >= 20:
                seen.setdefault(k, set()).add(i)
    for r in after:
        lines = [x for x in before[r["doc_id"]]["text"].split("\n") if len(seen.get(k := x.strip(BLANK).translate(LOWER), ())) < 3 or r["doc_id"] == max(seen[k])]
        assert r["text"] == "\n".join(lines) and r["n_chars"] == len(r["text"])
    before, after = held["near-duplicates"]
    assert {r["doc_id"] for r in after} == set(class_truth([(i, r["text"]) for i, r in before.items()]).values())
    before, after = held["mixing"]
    size = lambda t: len(t.split())
    totals = {}
    for r in before.values():
        totals[r["source"]] = totals.get(r["source"], 0) + size(r["text"])
    longest = max(size(r["text"]) for r in before.values())
    for s, _, target in mixing.targets(list(totals.items())):
        assert abs(sum(size(r["text"]) for r in after if r["source"] == s) - target) <= longest
    _, after = held["encoding"]
    t = tokens._tokenizer(tokens.vocabulary_path())
    assert sorted((r["doc_id"], r["ids"]) for r in after) == sorted((r["doc_id"], t.encode(r["text"], add_special_tokens=False).ids) for r in held["mixing"][1])


def test_run_is_the_stages(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert got.count() > 50
    assert quality.CUT == 0.3


def test_stages_on_odd_rows(spark, docs, no_docs, rows, tmp_path):
    """Null, empty and repeated rows, null ids, columns with clashing names; and an empty table."""
    path = tmp_path.as_uri()
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for table, n in ((docs, len(rows)), (no_docs, 0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            before = at.count()
            at = cut(stage(spark, at, path))
            if name != "encoding":
                assert at.columns == docs.columns and at.count() <= 2 * before, name
        assert at.count() <= 2 * n
    assert at.count() == 0


def test_ranking_weights_are_the_best():
    """No step in any direction lowers the penalised logistic loss of the same pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + rng.normal(size=200) > 0).astype(int)
    model = quality.fit_pairs(x, y, pairs=2000, seed=7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(7)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-9), -8, 8)
    pairs = [(a, b) for a, b in zip(draw.choice(good, 2000), draw.choice(bad, 2000), strict=True)]

    def loss(w):
        return sum(np.log1p(np.exp(-float((z[a] - z[b]) @ w))) for a, b in pairs) + 0.5 * 1e-3 * 2000 * float(w @ w)

    best = loss(model.weights)
    for i in range(4):
        for step in (1e-3, -1e-3):
            w = model.weights.copy()
            w[i] += step
            assert loss(w) >= best - 1e-9
    assert model.cut == pytest.approx(np.quantile(z @ model.weights, len(bad) / len(y)))
