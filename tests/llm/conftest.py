import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, c0 string, words string"


def _text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared lines and passages, nulls, empty and long texts, repeats."""
    rng = random.Random(5)
    line = "This long boilerplate line is in many documents, word for word."
    passage = _text(rng, 30)
    texts = [_text(rng, 60) for _ in range(20)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].replace("w1", "w2", 1), texts[3].upper()]
    texts += [f"{_text(rng, 20)}\n{line if i % 2 else '  ' + line.upper() + '  '}\n{_text(rng, 5)}" for i in range(6)]
    texts += [f"{_text(rng, 15)} {passage} {_text(rng, 15)}" for _ in range(4)]
    texts += ["", None, " ", "\n\n", "one", "one two three", "é" * 60, "漢字 " * 40, "a" * 3000, _text(rng, 4000), line, "\x00 nul \x00", "x\ty\x0bz\x1cq r"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 7 else None, None if t is None else len(t), i * 2, "k", 0.5, "c", "w") for i, t in enumerate(texts)]
    out += [out[4], (4, texts[4], "de", "s9", 1, 1, None, None, None, None)]  # repeated rows
    out += [(None, texts[5], None, None, None, None, None, None, None, None), (None, "another null id " * 10, None, "s1", None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("docs").as_uri() + "/documents"
    spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
