"""Near copies, repeated substrings, shared lines and near vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptsieve.llm import embedding_dedup, line_dedup, minmax_dedup, substring_dedup
from promptsieve.llm.components import components
from promptsieve.llm.suffix_array import common_prefixes, repeated, suffix_array

from . import brute

DOCS = "doc_id long, text string, extra int"
WORDS = [f"w{i}" for i in range(300)]


def _texts(seed: int, n: int = 60) -> dict:
    draw = random.Random(seed)
    texts: list[str | None] = [None, "", "  \n ", "one", "one", "two words", "Two  WORDS", "x" * 500]
    base = [[draw.choice(WORDS) for _ in range(draw.randint(20, 120))] for _ in range(8)]
    while len(texts) < n:
        own = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 5, 9])):
            own[draw.randrange(len(own))] = draw.choice(WORDS)
        texts.append(" ".join(own))
    draw.shuffle(texts)
    return dict(enumerate(texts))


def _frame(spark, texts: dict):
    return spark.createDataFrame([(k, t, 1) for k, t in texts.items()], DOCS)


@pytest.mark.parametrize(("width", "block"), [(4, 256), (5, 4)])
def test_near_duplicates(spark, width, block):
    texts = _texts(width)
    sizes, group = brute.near(texts, width, 80)
    found = minmax_dedup.near_duplicates(
        _frame(spark, texts), minmax_dedup.Params(width=width, block=block)
    ).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        k: (sizes[k], group[k], group[k] == k) for k in texts
    }


def test_hub_of_copies(spark):
    """Copies linked only through their original, in tasks of a few documents."""
    draw = random.Random(3)
    base = [draw.choice(WORDS) for _ in range(200)]
    texts = {100: " ".join(base)}
    for k in range(40):
        own = list(base)
        for place in range(4):
            own[5 * k % 190 + place] = f"other{k}-{place}"
        own[(7 * k + 90) % 200] = f"more{k}"
        texts[k] = " ".join(own)
    _, group = brute.near(texts, 5, 80)
    found = minmax_dedup.near_duplicates(_frame(spark, texts), minmax_dedup.Params(block=8)).collect()
    assert {r.doc_id: r.component_id for r in found} == group


def test_rows_without_or_with_equal_ids(spark):
    long = " ".join(WORDS[:30])
    rows = [(None, long, 1), (None, long, 1), (5, long, 1), (5, long, 1), (7, long, 1), (8, None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    found = minmax_dedup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [
        (-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True), (7, 5, False), (8, 8, True),
    ]
    one = minmax_dedup.one_of_each(docs)
    assert one.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in one.collect()) == [-1, 5, 8]
    assert minmax_dedup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [1 << 19, 300])
def test_repeated_substrings(spark, shard):
    texts = _texts(11, 40)
    texts[100], texts[101] = "ab" * 300, "é" * 150 + "tail"
    texts[102] = "front " + "é" * 150
    params = substring_dedup.Params(length=60, gram=12, run=64, shard=shard)
    docs = _frame(spark, texts).withColumn("n_bytes", F.lit("clash"))
    found = substring_dedup.remove_repeats(docs, params, with_text=True).collect()
    want = dict(zip(texts, brute.repeats(list(texts.values()), 60)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 for r in found)


def test_repeated_rows_repeat(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, "short", 0)], DOCS)
    found = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in found) == [(5, 0), (300, 300), (300, 300)]
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array():
    draw = np.random.default_rng(4)
    for trial in range(150):
        text = draw.integers(1, draw.integers(2, 6), draw.integers(1, 90))
        text = np.append(np.tile(text, 1 + trial % 3), 0).astype(np.uint16)
        order = suffix_array(text, int(text.max()) + 1)
        want = sorted(range(len(text)), key=lambda i: tuple(text[i:]))
        assert list(order) == want
        shared, before = common_prefixes(text, order)
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert (shared[b], before[b]) == (n, a)
        many = [bytes(text[i : i + 4].tobytes()) for i in range(len(text) - 3)]
        assert list(repeated(text, int(text.max()) + 1, 4)[: len(many)]) == [many.count(m) > 1 for m in many]


def test_shared_lines(spark):
    draw = random.Random(8)
    pool = ["Common line", " common LINE\t", "rare", "", "x", "É", "é"] + [f"line {i}" for i in range(30)]
    texts: dict = {k: "\n".join(draw.choices(pool, k=draw.randint(1, 12))) for k in range(40)}
    texts |= {90: None, 91: "", 92: "\n\n", 93: "Common line", 94: "y" * 50_000 + "\ncommon line\r"}
    docs = _frame(spark, texts).withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(1))
    for params in (line_dedup.Params(min_docs=10), line_dedup.Params(min_docs=4, batches=7, fan=3)):
        found = line_dedup.dedup_lines(docs, params)
        assert found.columns == ["doc_id", "text", "extra", "h1", "n_lines", "n_dropped"]
        got = {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in found.collect()}
        assert got == brute.lines(texts, params.min_docs)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_long_documents_share_their_lines(spark):
    """Many lines to drop in each document, at its start, inside and at its end."""
    shared = [f"shared line {i}" for i in range(6000)]
    draw = random.Random(5)
    texts: dict = {}
    for k in range(12):
        own = shared + [f"own {k} {i}" for i in range(500)] + ["SHARED line 1"] * 20
        draw.shuffle(own)
        texts[k] = "\n".join(own)
    texts[12] = "\n".join(shared)
    found = line_dedup.dedup_lines(_frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, brute.sha(r.text)) for r in found} == brute.lines(texts, 10)


def test_repeated_rows_are_documents(spark):
    docs = spark.createDataFrame([(1, "a\nb", 0)] * 9 + [(None, "a", 0), (None, None, 0)], DOCS)
    found = line_dedup.dedup_lines(docs).collect()
    assert sorted((r.text, r.n_dropped) for r in found) == [("", 0), ("", 1)] + [("b", 1)] * 9


def test_near_vectors(spark):
    draw = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        for center in draw.normal(size=(6, 24)):
            for _ in range(12):
                v = center + draw.normal(size=24) * draw.choice([0.0, 0.02, 0.1, 0.14, 0.2])
                rows.append((len(rows), [float(x) for x in v.astype(np.float32)], label))
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [None] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    links = []
    good = {}
    for k, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[k] = (label, np.array(v) / np.linalg.norm(v))
    for a in good:
        for b in good:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                if good[a][1] @ good[b][1] >= 0.98:
                    links.append((a, b))
    group = brute.groups([r[0] for r in rows], links)
    want = {k: (sum(k in pair for pair in links), group[k], group[k] == k) for k in group}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for tile in (1024, 16):
        found = embedding_dedup.near_duplicates(frame, embedding_dedup.Params(tile=tile)).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == want
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_copies_of_a_vector(spark):
    """Copies in several tiles, repeated rows, one vec_id with two vectors, clashing columns."""
    base, far = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(k, base, "x") for k in range(50, 90)] + [(60, base, "x")] * 5
    rows += [(5, [1.0, 0.0, 0.05, 0.1], "x"), (6, far, "x"), (7, far, "x"), (8, base, "y"), (9, far, None)]
    rows += [(100, base, "z"), (100, far, "z"), (101, base, "z"), (102, far, "z"), (None, base, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    frame = frame.withColumns({"row": F.lit(1), "h1": F.lit("h"), "many": F.lit(None), "v": F.lit("v")})
    for tile in (8192, 1):
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in
                 embedding_dedup.near_duplicates(frame, embedding_dedup.Params(tile=tile)).collect()}
        assert all(found[k] == (40, 5, False) for k in range(50, 90)) and found[5] == (40, 5, True)
        assert (found[6], found[7]) == ((1, 6, True), (1, 6, False))
        assert (found[8], found[9], found[None]) == ((0, 8, True), (0, 9, True), (0, None, True))
        assert (found[100], found[101], found[102]) == ((2, 100, True), (1, 100, False), (1, 100, False))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = brute.groups({n for pair in links for n in pair}, links)
    assert {r.node: r.component for r in components(frame).collect()} == want
    assert components(frame.limit(0)).count() == 0
