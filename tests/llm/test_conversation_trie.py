import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchside.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, c long, d int, key binary, words string"


def truth(rows):
    """The contract's rows by prefixes in a dictionary."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lender = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = own.get(lender, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [out[k] for k in children[p]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), sum(k[5] for k in kids) or 1,
            sum(k[6] for k in kids) + (len(members[p]) - 1) * words, sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
    return Counter(out.values())


def result(spark, rows):
    full = [(*r, 1, 1, b"x", "w") for r in rows]
    got = trie.trie(spark.createDataFrame(full, SCHEMA)).select(*trie.NODE)
    return Counter(tuple(r) for r in got.collect())


def some(seed, convs, lengths, vocabulary):
    rng = random.Random(seed)
    out = []
    for c in convs:
        for t in range(rng.choice(lengths)):
            out.append((c, t, rng.choice(["user", "assistant"]) if vocabulary > 2 else "user", f"say {rng.randrange(vocabulary)} \t words"))
    rng.shuffle(out)
    return out


ODD = [
    (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (5, 1, "a", "b"), (7, 3, "u", "x " * 5000), (7, 2, None, "é\x1cz"), (None, 1, "user", "lost"),
    (20, 0, "user", "hello there"), (21, 0, "user", "hello there"), (22, 9, "user", "own"), (-5, 1, "user", "below"), (-40, 1, "user", "x"), (-59, 2, "user", "x"),
    (0, 0, "us", "er1"), (1, 0, "user", "1"), (203, 0, "user", "only"), (205, 0, "user", "only"), (206, 0, "user", "only"), (2**62, 0, "user", "far"),
]


def test_odd_rows(spark):
    """Nulls, ties, repeats, turnless conversations, missing lenders, long texts, clashing columns."""
    assert result(spark, ODD) == truth(ODD)
    assert not result(spark, [])
    assert not result(spark, [(None, 1, "user", "lost")])


@pytest.mark.parametrize("seed", range(2))
def test_many_ranges_rounds_and_long_strings(spark, monkeypatch, seed):
    for name, value in {"HEAD": 3, "GROW": 2, "ROWS": 60, "RUN": 17, "STRINGS": 12, "FAN": 2, "PIECE": 60}.items():
        monkeypatch.setattr(trie, name, value)
    rows = some(seed, range(150), [1, 2, 3, 4, 6, 9], 2)
    long = [(t, "user", f"long {t}") for t in range(40)]
    rows += [(c, *x) for c in (400, 420, 440) for x in long[: 20 + c % 17]]  # share all of their strings for long
    rows += [(c, 0, "user", "same") for c in range(1000, 1150)]  # equal conversations
    assert result(spark, rows) == truth(rows)


def test_one_hot_conversation(spark, monkeypatch):
    """Most rows are one conversation: its string is cut, and its other turns follow row by row."""
    monkeypatch.setattr(trie, "HEAD", 4)
    monkeypatch.setattr(trie, "ROWS", 50)
    rows = [(3, t, "user", f"log {t}") for t in range(600)] + some(9, range(20, 60), [1, 2], 3)
    assert result(spark, rows) == truth(rows)


def strings(draw_from=b"ab"):
    return st.lists(st.lists(st.sampled_from(list(draw_from)), max_size=5).map(lambda x: b"".join(bytes([i]) * trie.WIDTH for i in x)), max_size=12, unique=True)


@settings(max_examples=200, deadline=None)
@given(strings(), st.integers(1, 5), st.randoms())
def test_merging_runs(all_strings, runs, rng):
    """The loser tree gives all strings in order, each with the turns that it shares with the one before."""
    dealt = [[] for _ in range(runs)]
    for s in all_strings:
        dealt[rng.randrange(runs)].append(s)
    sorted_runs = []
    for own in dealt:
        own.sort()
        sorted_runs.append([(trie.shared_turns(a, b), b, b) for a, b in zip([b"", *own], own)])
    got = list(trie.merged(sorted_runs))
    want = sorted(all_strings)
    assert [s for _, s, _ in got] == want == [x for _, _, x in got]
    assert [n for n, _, _ in got] == [trie.shared_turns(a, b) for a, b in zip([b"", *want], want)]


def test_comparisons_begin_at_the_lcp(monkeypatch):
    """Shared turns are compared once, not once for every string of a run."""
    compared = []
    plain = trie.shared_turns
    monkeypatch.setattr(trie, "shared_turns", lambda a, b, known=0: compared.append(plain(a, b, known) - known) or plain(a, b, known))
    stem = bytes(trie.WIDTH) * 1000
    runs = [[(1000 if i else 0, stem + bytes([2 * i + r]) * trie.WIDTH, None) for i in range(50)] for r in range(2)]
    assert len(list(trie.merged(runs))) == 100
    assert sum(compared) == 1000  # the stem, once
