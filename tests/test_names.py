import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pitchside.functions import cleaning as C
from pitchside.functions import matching as M
from pitchside.operators import upkeep as U
from pitchside.plans import names as N


def misspelt(rng, name):
    out = list(name)
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and len(out) > 1:
            out.pop(min(at, len(out) - 1))
        else:
            out.insert(at, rng.choice("abcdef "))
    return "".join(out)


@pytest.fixture(scope="module")
def known():
    rng = random.Random(2)
    parts = ["ann", "bob", "united", "city", "rovers", "ab", "a", "dynamo", "sporting", "real"]
    return sorted({" ".join(rng.choice(parts) + rng.choice(["", "ski", "son", "o"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)} | {"x", "xy", "aaaaaaa", "éé"})


def test_candidates_miss_no_similar_name(spark, known):
    rng = random.Random(5)
    asked = sorted({misspelt(rng, n) for n in known} | {"x", "y", "", "aaaaaaaa", "xz", "xy", "漢字漢字"})
    want = {(a, k) for a in asked for k in known if a and SequenceMatcher(None, a, k).ratio() >= 0.88}
    names = spark.createDataFrame([(a,) for a in asked if a], "name string")
    canonical = spark.createDataFrame([(k,) for k in known], "canonical string")
    pairs = M.candidate_pairs(names, canonical, [])
    assert {(r["name"], r["canonical"]) for r in M.ratios(pairs).collect()} == want
    assert pairs.count() < 0.1 * len(asked) * len(known)
    best = {}
    for a, k in sorted(want):
        r = SequenceMatcher(None, a, k).ratio()
        if r > best.get(a, ("", 0))[1]:
            best[a] = (k, r)
    twice = spark.createDataFrame([(a,) for a in asked] * 2 + [(None,)], "name string")
    got = M.closest_names(twice, canonical).collect()
    assert len(got) == 2 * len(best) and {r["name"]: (r["canonical"], r["ratio"]) for r in got} == best


def test_candidates_among_many_names_are_few(spark):
    """Two thousand names, each misspelt: about one pair in a thousand is compared."""
    rng = random.Random(7)
    name = lambda: " ".join("".join(rng.choice("aabcdeefghiijklmnoopqrstuuvwxyz") for _ in range(rng.randrange(4, 8))) for _ in range(2))
    known = sorted({name() for _ in range(2_000)})
    wrong = [(n[:3] + "z" + n[3:],) for n in known]
    pairs = M.candidate_pairs(spark.createDataFrame(wrong, "name string"), spark.createDataFrame([(k,) for k in known], "canonical string"), [])
    assert len(known) <= pairs.count() < 0.002 * len(known) ** 2


def walk(rows, least=0.88):
    """The sequential rule: names in order, each an alias of a known one or new."""
    out = {}
    for group in {g for _, g, _ in rows}:
        known, done = {}, set()
        for _, _, name in sorted((n, g, x) for n, g, x in rows if g == group and x and x.strip()):
            k = M.bare(name)
            if k in done:
                continue
            done.add(k)
            to, how = next(((c, "abbreviation") for c in known if U.stands_for(k, c)), (None, "new"))
            if to is None:
                ranked = [(SequenceMatcher(None, k, c).ratio(), -i, c) for i, c in enumerate(known)]
                if ranked and max(ranked)[0] >= least:
                    to, how = max(ranked)[2], "fuzzy"
            if to is None:
                to, known[k] = k, " ".join(name.split())
            out[group, k] = (known[to], how)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_aliases_are_those_of_the_walk(spark, seed):
    rng = random.Random(seed)
    first, last = ["jannik", "jan", "carlos", "karl", "ana"], ["sinner", "sinners", "alcaraz", "alcara", "konta", "contta"]
    rows = []
    for i in range(80):
        f, n = rng.choice(first), rng.choice(last)
        name = rng.choice([f"{f} {n}", f"{f[0]}. {n}", f"{n} {f[0]}.", f"{n}, {f}", f"{n},{f[0]}.", f"  {f}  {n.title()}", f"{f} x {n}", n, misspelt(rng, f"{f} {n}"), ""])
        rows.append((i, rng.choice(["tennis", "darts"]), name))
    rows += [(80, "tennis", None), (81, None, "lone name")]
    got = U.learned_aliases(spark.createDataFrame(rows, "n int, sport string, name string"), "sport", "name", ["n"])
    named = [r for r in rows if r[1] is not None]
    assert {(r["sport"], r["key"]): (r["canonical"], r["how"]) for r in got.where(F.col("sport").isNotNull()).collect()} == walk(named)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_pairs_that_share_words_are_all_found(spark, block):
    rng = random.Random(4)
    words = ["red", "blue", "green", "pale", "dark", "an"]
    rows = [(i // 2 if i < 20 else i, rng.choice(["x", "y", "y", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(4))) if i % 11 else None) for i in range(120)]
    own = [(i, k, {w for w in (name or "").split() if len(w) >= 3}) for i, k, name in rows if k]
    want = sorted((a, b, len(s & t)) for a, k, s in own for b, j, t in own if k == j and a < b and s & t)
    df = spark.createDataFrame(rows, "i long, k string, name string")
    got = M.sharing_pairs(df, ["k"], "i", C.tokens(F.col("name")), block)
    assert sorted((r["a"], r["b"], r["n_shared"]) for r in got.collect()) == want
    assert len(want) > 400


def test_pairs_of_copies_are_spread_over_tasks(spark, tmp_path):
    """Four names of 1,500 copies each: no task gets most of their pairs."""
    n = 6_000
    df = spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand"), F.col("id") % 4).alias("p_brand"), F.lit("TIN").alias("p_type"), F.lit(1).alias("p_size"), F.lit("pale red").alias("p_name"))
    df.coalesce(1).write.parquet(f"{tmp_path.as_uri()}/part.parquet")
    got = [r["n"] for r in N.set_04_overlap(spark, tmp_path.as_uri()).groupBy(F.spark_partition_id().alias("task")).agg(F.count("a").alias("n")).collect()]
    assert sum(got) == 4 * 1500 * 1499 // 2
    assert max(got) < 0.7 * sum(got)
