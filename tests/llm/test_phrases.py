"""Passages that stand earlier, and collocations, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import collocations, passage_dedup
from promptsieve.llm.automaton import Automaton

from . import brute

WORDS = [f"w{i}" for i in range(40)] + ["É", "é", "Word", "word"]


def test_automaton():
    for trial in range(200):
        draw = random.Random(trial)
        symbols, width = draw.randint(1, 4), draw.randint(1, 5)
        make = lambda low: [draw.randrange(low, symbols) for _ in range(draw.randint(0, 20))]
        known = [make(0) for _ in range(draw.randint(1, 6))]
        asked = known + [make(-1) for _ in range(4)]
        first: dict = {}
        at = 0
        for s in known:
            for i in range(width - 1, len(s)):
                first.setdefault(tuple(s[i + 1 - width : i + 1]), at + i)
            at += len(s)
        automaton = Automaton(known, symbols)
        ends = np.cumsum([len(s) for s in asked])
        begin = ends - [len(s) for s in asked]
        state = automaton.matches(np.array([c for s in asked for c in s], np.int64), begin, ends, width)
        want = [first.get(tuple(s[max(0, i + 1 - width) : i + 1])) for s in asked for i in range(len(s))]
        assert [automaton.first[s] if s >= 0 else None for s in state] == want


def _texts() -> dict:
    draw = random.Random(7)
    some = lambda n: draw.choices(WORDS, k=n)
    passages = [some(30) for _ in range(5)]
    texts: dict = {None: " ".join(passages[0]), 1: None, 2: "", 3: " \t\n", 4: "one two"}
    for k in range(5, 160):
        own = some(draw.randint(0, 40))
        for p in draw.choices(passages, k=draw.randint(0, 2)):
            own += p[draw.randint(0, 5) :] + some(draw.randint(0, 10))
        texts[k] = draw.choice([" ", "\n", " \t"]).join(own)
    texts |= {200: texts[10], 201: texts[10], 203: "a " * 90, 204: "x " + "a b " * 60, 205: "y" * 90_000 + " z" * 30}
    common = " ".join(some(25))
    texts |= {k: f"{k} {k + 1} {common} {k * 7}" for k in range(300, 420)}
    return texts


@pytest.mark.parametrize(
    "params",
    [
        passage_dedup.Params(window=8, gram=3, shard=1 << 12, hot=4096),
        passage_dedup.Params(window=8, gram=3, shard=60, hot=4096),
        passage_dedup.Params(window=8, gram=3, shard=60, hot=16),
        passage_dedup.Params(),
    ],
)
def test_passages(spark, params):
    """Broadcast and shards; crowded grams worked off window by window."""
    texts = _texts()
    rows = [(k, t, "clash", 1) for k, t in texts.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words string, mark int").repartition(3)
    found = passage_dedup.remove_passages(frame, params)
    assert found.columns == ["doc_id", "text", "mark", "n_words", "n_removed"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in found.collect()}
    assert got == brute.passages(texts, params.window)


def test_passages_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [("b", long), ("b", long), ("a", long + " more"), (None, None), ("a", "other")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    found = passage_dedup.remove_passages(frame)
    assert sorted((r.doc_id or "", r.n_words, r.n_removed) for r in found.collect()) == [
        ("", 0, 0), ("a", 1, 0), ("a", 31, 0), ("b", 30, 30), ("b", 30, 30),
    ]
    assert sorted(r.n_removed for r in passage_dedup.remove_passages(frame.limit(2)).collect()) == [0, 0]
    assert passage_dedup.remove_passages(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("ranked", "buffer"), [(1 << 16, 1 << 21), (6, 500), (0, 1 << 21)])
def test_collocations(spark, ranked, buffer):
    draw = random.Random(9)
    pool = ["the", "The", "of", "new york", "new york city", "a\tb", "é", "É", "x-y", "c d e f g"] + [f"u{i}" for i in range(30)]
    rows = [
        (draw.choice(["en", "de", None, "und"]), draw.choice([" ", " ", ", ", "\n"]).join(draw.choices(pool, k=draw.randint(0, 30))))
        for _ in range(300)
    ]
    rows += [("en", None), ("xx", ""), ("yy", "a " * 3000), ("de", "w " * 40 + "!" + "v" * 70_000)]
    frame = spark.createDataFrame(rows, "lang string, text string")
    frame = frame.withColumns({c: F.lit(1) for c in ("key", "own", "phrase", "a")}).repartition(3)
    params = collocations.Params(least=12, top=25, ranked=ranked, buffer=buffer)
    found = collocations.collocations(frame, params)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute.collocations(rows, 12, 25)
    assert collocations.collocations(frame.limit(0), params).count() == 0


def test_tiles_and_coordinates():
    draw = np.random.default_rng(0)
    left = np.concatenate([draw.integers(0, 300, 80_000), draw.integers(0, 1 << 16, 5_000)])
    right = np.concatenate([draw.integers(512, 700, 80_000), draw.integers(0, 1 << 16, 5_000)])
    want = {}
    for pair in zip(left.tolist(), right.tolist()):
        want[pair] = want.get(pair, 0) + 1
    got: dict = {}
    for a, b, n in [*collocations.tiles(left, right)]:
        for x, y, m in zip(a.tolist(), b.tolist(), n.tolist()):
            assert (x, y) not in got
            got[x, y] = m
    assert got == want
    got = {}
    for x, y, m in zip(*(v.tolist() for v in collocations.coordinates(left.astype(np.uint64), right.astype(np.uint64)))):
        got[x, y] = got.get((x, y), 0) + m
    assert got == want


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2^63 long before the counts do; checked on the formula's own types."""
    row = spark.sql(
        "SELECT cast(9e12 as decimal(19,0)) * cast(9e12 as decimal(19,0)) * cast(1000 as decimal(4,0)) AS up,"
        " cast(9e12 as decimal(19,0)) * cast(7e12 as decimal(19,0)) AS down"
    ).selectExpr("up div down AS score")
    assert row.first()[0] == 1000 * 9 * 10**12 * 9 * 10**12 // (9 * 10**12 * 7 * 10**12)
