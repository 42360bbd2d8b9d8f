import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from pitchside.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables here")
def test_held_out_documents(spark):
    got = toxicity.op11(spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    both = got.merge(labels, on="doc_id")
    both = both[both["held_out"]]
    assert (both["held_out"] == both["doc_id"].map(held)).all()
    assert ((both["score"] >= 0.5) == (both["predicted"] == 1)).all()
    toxic, clean = both[both["toxic"] == 1], both[both["toxic"] == 0]
    assert toxic["predicted"].mean() > 0.9
    assert clean["predicted"].mean() < 0.01


def test_features_are_shares_of_words_and_beginnings():
    x = toxicity.features(["alpha alpha beta", None, "", "alphabet"])
    assert list(np.diff(x.at)) == [3, 0, 0, 5]  # alpha, alph, beta; the word and its beginnings
    own = dict(zip(x.column[: x.at[1]].tolist(), x.value[: x.at[1]].tolist(), strict=True))
    assert sorted(round(v * v * toxicity.FEW_WORDS) for v in own.values()) == [1, 2, 2]
    assert len({*own} & {*x.column[x.at[3] :].tolist()}) == 1  # alph
    long = toxicity.features(["A b " * 100_000 + "é" * 50_000])
    assert len(long.column) == 8


def test_whole_and_used_features_score_alike():
    rng = np.random.default_rng(2)
    w = np.zeros(2**toxicity.BITS, np.float32)
    texts = ["idiot words here", "", None, "calm words " * 500]
    w[toxicity.features(texts).column[::2]] = rng.normal(size=len(toxicity.features(texts).column[::2]))
    want = 1 / (1 + np.exp(-(toxicity.features(texts).times(w) - 0.3)))
    np.testing.assert_allclose(toxicity.Model(w, -0.3).score(texts), want, rtol=1e-6)


def test_risk_and_cut():
    z_p, z_u = np.array([1.0, -2.0]), np.array([0.5, -1.0, -3.0])
    l = lambda z: np.log1p(np.exp(-z))  # noqa: E731, E741
    toxic, clean = toxicity.risks(z_p, z_u, 0.2)
    assert toxic == pytest.approx(0.2 * l(z_p).mean())
    assert clean == pytest.approx(l(-z_u).mean() - 0.2 * l(-z_p).mean())
    u = np.concatenate([np.full(20, 2.0), np.linspace(-3, -1, 80)])
    assert -1 < toxicity.least_risk(np.full(10, 2.0), u, 0.2) < 2


def test_unlabelled_toxic_documents_are_found(spark):
    """Only half of the toxic documents are confirmed; the others are among the unlabelled ones."""
    rng = np.random.default_rng(0)
    clean = [" ".join(f"w{rng.integers(300)}" for _ in range(60)) for _ in range(1000)]
    toxic = [c + " " + " ".join(f"vile{rng.integers(40)}" for _ in range(5)) for c in clean[:250]]
    texts = toxic + clean[250:]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1) for i in range(125)] + [(i, 1, 0) for i in range(250, 625)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    s = model.score(texts)
    assert (s[125:250] >= toxicity.CUT).mean() > 0.97 and (s[250:] < toxicity.CUT).mean() > 0.97
    calm, vile = model.score(["w1 " * 60, "w1 " * 50 + " ".join(f"vile{i}x" for i in range(10, 20))])
    assert vile > 3 * calm  # known by the beginnings of its words only


def test_odd_rows(spark, docs, no_docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 0), (500, 1, 1)], none.schema)
    for labels in (none, odd, odd.where("toxic = 1"), odd.where("toxic = 0")):
        model = toxicity.fit(docs, labels)
        got = toxicity.score(docs, model).toPandas()
        assert len(got) == len(rows)
        assert got["score"].between(0, 1).all() and (got["predicted"] == 0).all()
        ids = [None if pd.isna(i) else int(i) for i in got["doc_id"]]
        assert got["held_out"].tolist() == [held(i) for i in ids]
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).count() == 0
