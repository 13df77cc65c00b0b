"""Classifiers, language model, decontamination, chat windows and the pipeline."""

import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promptsieve.llm import chat, context_tree, decontaminate, factorization, mixing, quality, toxicity
from promptsieve.llm.queries import QUERIES

from . import brute

SF_DIR = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
DOCS = "doc_id long, text string, n_chars long, score string"


def _labelled(seed: int, bad, n: int = 2000) -> list[tuple]:
    """Texts of noise words with two terms, each in half of them; `bad` says when."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        own = draw.choices([f"w{i}" for i in range(300)], k=25)
        a, b = draw.random() < 0.5, draw.random() < 0.5
        own += ["insult"] * a + ["group"] * b
        draw.shuffle(own)
        rows.append((k, " ".join(own), int(bad(a, b))))
    return rows


@pytest.mark.parametrize(
    ("bad", "labelled", "least"),
    [(lambda a, b: a and b, 1500, 0.99), (lambda a, b: a != b, 1500, 0.97), (lambda a, b: a and b, 200, 0.9)],
)
def test_pairs_are_learned(spark, bad, labelled, least):
    """Also a pair neither of whose terms says anything alone; production parameters."""
    rows = _labelled(1, bad)
    docs = spark.createDataFrame([(k, t, len(t), "clash") for k, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k < labelled], "doc_id long, label int")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    assert found.columns == docs.columns
    got = {r.doc_id: r.score for r in found.collect()}
    held = [(got[k] >= 0.5) == bool(y) for k, _, y in rows if k >= labelled]
    assert np.mean(held) > least


@pytest.mark.parametrize("batch", [64, 4096])
def test_training_against_dense_matrices(batch):
    """Sparse batches give what whole matrices give."""
    draw = np.random.default_rng(6)
    x = draw.random((150, 30)) < 0.2
    x[:5] = False
    y = (x[:, 0] ^ x[:, 1]).astype(np.float32)
    params = factorization.Params(batch=batch, alone=5, steps=40, free=10)
    buckets = 3 * np.concatenate([np.flatnonzero(r) for r in x])
    got = factorization.fit(buckets, x.sum(1), y, 100, params)
    want = brute.machine(x.astype(np.float32), y, params)
    seen = 3 * np.flatnonzero(x.any(axis=0))
    assert got[0] == pytest.approx(want[0], abs=2e-3)
    assert np.allclose(got[1][seen], want[1], atol=2e-3) and np.allclose(got[2][seen], want[2], atol=2e-3)
    assert np.count_nonzero(np.delete(got[1], seen)) == 0


def test_training_holds_few_bytes_a_feature():
    """The driver's memory pays for the sample: arrays of all features exist once, as numbers
    that are as narrow as they can be."""
    draw = np.random.default_rng(8)
    rows, each = 16_384, 64
    buckets = np.sort(draw.integers(0, 64, (rows, each)) + 64 * np.arange(each), axis=1).astype(np.int32).ravel()
    label = (draw.random(rows) < 0.5).astype(np.float32)
    tracemalloc.start()
    try:
        factorization.fit(buckets, np.full(rows, each), label, 64 * each, factorization.Params(alone=2, steps=6, free=2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 12 * len(buckets)


def test_sample_is_gathered_row_by_row():
    lists = [pa.array([[3, 5], [], [7]], pa.list_(pa.int32())), pa.array([[1]], pa.list_(pa.int32()))]
    bins = np.arange(100, 108, dtype=np.int32).reshape(4, 2)
    features, counts = factorization._gathered(lists, bins)
    assert features.tolist() == [3, 5, 100, 101, 102, 103, 7, 104, 105, 1, 106, 107]
    assert counts.tolist() == [4, 2, 3, 3] and not lists


def test_clashing_columns_and_repeated_labelled_rows(spark):
    rows = _labelled(3, lambda a, b: a, 300)
    docs = spark.createDataFrame([(k % 10, t, len(t), "x") for k, t, _ in rows], DOCS)
    docs = docs.withColumns({c: F.lit(c) for c in ("_label", "_key", "label", "key", "buckets", "row")})
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, label int")
    params = factorization.Params(sample=50, structure=False)
    sample = []
    real = factorization.fit
    try:
        factorization.fit = lambda f, c, y, *rest: (sample.append(len(y)), real(f, c, y, *rest))[1]
        model = factorization.train(docs, labels, params)
    finally:
        factorization.fit = real
    assert sample == [50]
    found = toxicity.score(docs, model)
    assert found.columns == [c for c in docs.columns if c != "score"] + ["score"] and found.count() == 300


def test_sum_of_squares_identity():
    draw = np.random.default_rng(1)
    model = factorization.Model(
        factorization.Params(rank=3), np.zeros((0, 0)), 0.3, draw.normal(size=9), draw.normal(size=(9, 3))
    )
    active = [0, 2, 5, 8]
    raw = 0.3 + model.w[active].sum() + sum(
        model.v[i] @ model.v[j] for n, i in enumerate(active) for j in active[n + 1 :]
    )
    got = model.score(np.zeros(4, int), np.array(active), 1)
    assert got[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_classifier_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "", 0, "x"), (None, "some words", 10, "x"), (4, "w " * 40_000, 80_000, "x"), (4, "w", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, label int")
    some = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (None, 1), (2, None), (2, 7)], "doc_id long, label int")
    for operator in (quality, toxicity):
        for labels in (none, some):
            model = operator.train(docs, labels)
            scores = [r.score for r in operator.score(docs, model).collect()]
            assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
            assert operator.score(docs.limit(0), model).count() == 0
    assert quality.train(docs.limit(0), some).w.sum() == 0


@needs_tables
@pytest.mark.parametrize(
    ("name", "label", "accuracy", "recall"), [("op3_quality", "quality", 0.97, 0.97), ("op8_toxicity", "toxic", 0.93, 0.6)]
)
def test_held_out(spark, name, label, accuracy, recall):
    """Of the 14 toxic documents held out here, 9 hold a plain insult."""
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = QUERIES[name](spark, SF_DIR)
    assert found.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    got = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() >= accuracy
    assert got[got[label] == 1]["predicted"].mean() >= recall


def test_language_model(spark):
    draw = random.Random(5)
    syllables = ["ta", "ro", "min", "ka", "É", "lu "]
    texts = {k: "".join(draw.choices(syllables, k=draw.randint(1, 60))) for k in range(300)}
    texts |= {900: None, 901: "", 902: " \n\t", 903: "Unseen zzz", 904: "ta " * 30_000, 905: "UNSEEN ZZZ"}
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, score string")
    train = F.col("doc_id") % 10 != 0
    for params in (context_tree.Params(), context_tree.Params(depth=2, share=0.01, known=0.05)):
        got = {r.doc_id: r for r in context_tree.score(docs, train, params).collect()}
        want = brute.base_scores(texts, {k for k in texts if k % 10})
        for k, (n, known, tokens, base) in want.items():
            assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (n, known, tokens)
            assert got[k].base_score == pytest.approx(base)
            assert got[k].score <= 0
        held = [k for k in texts if k % 10 == 0 and k < 300]
        assert sum(got[k].score for k in held) > sum(len((texts[k]).encode()) for k in held) * -0.5
        assert got[900].score == got[901].score == got[902].score
        assert got[903].score == got[905].score < -5
    assert context_tree.score(docs.limit(0), train).count() == 0
    blind = context_tree.score(docs, F.lit(False)).where("doc_id = 903").first()
    assert blind.score == pytest.approx(-11 * 8 * np.log10(2)) and blind.n_known == 0


def test_blocks_of_rare_grams_are_listed_in_parts():
    """A block's grams are numbered a part at a time: a worker holds about twice the grams."""
    draw = np.random.default_rng(9)
    schema = pa.schema({"block": "int64", "first": "int64", "keys": pa.list_(pa.int64()), "lens": "binary", "places": "binary"})
    blocks = context_tree._Blocks(schema)
    texts = [draw.integers(0, 1 << 18, 1 << 17).astype(np.uint64) for _ in range(8)]
    counts = np.array([0, 1000, 0, (1 << 17) - 1000])
    keys, sums, size = {}, {}, sum(map(len, texts))
    tracemalloc.start()
    try:
        for k, text in enumerate(texts):
            assert not list(blocks.add(4 * k, counts, text))
        for batch in blocks.flush():
            row = batch.to_pylist()[0] if batch.column("keys").null_count else None
            if row is None:
                keys[batch.column("first")[0].as_py()] = batch.column("keys").flatten().to_numpy()
            else:
                sums[row["first"]] = row["lens"], row["places"]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    listed = np.concatenate([keys[first] for first in sorted(keys)])
    assert sorted(listed) == np.unique(np.concatenate(texts)).tolist()
    parts = pa.table({"first": list(sums), "lens": [x[0] for x in sums.values()], "places": [x[1] for x in sums.values()]})
    found = context_tree._add_up(parts, pa.table({"place": np.arange(len(listed)), "log": listed.astype(float)}))
    got = dict(zip(found["row"].to_pylist(), found["rest"].to_pylist()))
    for k, text in enumerate(texts):
        assert [got[4 * k + j] for j in range(4)] == [0, text[:1000].sum(), 0, text[1000:].sum()]
    assert most < 24 * size


def test_context_tree_is_a_distribution():
    """The chances of all 256 bytes add up to one in any context, and the weights are those
    of the recursion written out."""
    draw = np.random.default_rng(3)
    text = draw.choice(np.frombuffer(b"abcab ab", np.uint8), 400)
    context, at, byte = [], [], []
    for d in range(3):
        for i in range(2, len(text)):
            context.append(int.from_bytes(bytes(text[i - d : i]), "big"))
            at.append(d)
            byte.append(text[i])
    context, at, byte = np.array(context, np.uint64), np.array(at), np.array(byte)
    tree = context_tree.Tree.fit(2, context, at, byte, np.ones(len(byte)))
    for before in (b"ab", b"zz", b"za"):
        grams = np.uint64(int.from_bytes(before, "big") << 8) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.log10(grams)).sum() == pytest.approx(1)

    def kt(bits):
        p, n = 1.0, [0, 0]
        for b in bits:
            p *= (n[b] + 0.5) / (sum(n) + 1)
            n[b] += 1
        return p

    short = text[:30]
    first = [(bytes(short[i - 1 : i]), short[i] >> 7 & 1, short[i] >> 4 & 1) for i in range(1, 30)]
    bits = [f[2] for f in first]  # one decision by hand: depth 0 against depth 1
    apart = np.prod([kt([b for c, _, b in first if c == k]) for k in {f[0] for f in first}])
    assert np.exp(context_tree._log_kt(np.array([bits.count(0)]), np.array([bits.count(1)])))[0] == pytest.approx(kt(bits))
    assert 0 < 0.5 * kt(bits) / (0.5 * kt(bits) + 0.5 * apart) < 1


def test_rare_contexts_are_nodes(spark):
    """A phrase met three times in a megabyte has nodes at all depths, and the scores are
    those of one tree of all contexts met twice."""
    texts = ["ab cd " * 4000] * 40 + ["zqxjvk wyq"] * 3 + ["zqxjvk wyq ab", "qq zqxjvk", "zqx", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.score for r in context_tree.score(docs, F.col("doc_id") < 43).collect()}

    def grams(text):
        data = b"\n" * 5 + " ".join(brute.words(text)).encode() + b"\n"
        return [int.from_bytes(data[i : i + 6], "big") for i in range(len(data) - 5)]

    counts = Counter(g for text in texts[:43] for g in grams(text))
    keys, n = np.array(list(counts), np.uint64), np.array(list(counts.values()))
    rows = []
    for d in range(6):
        context = keys >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)
        total = Counter()
        for c, k in zip(context, n):
            total[c] += k
        rows += [(c, d, k & np.uint64(255), m) for c, k, m in zip(context, keys, n) if total[c] > 1 or not d]
    context, at, byte, n = (np.array(x) for x in zip(*rows))
    tree = context_tree.Tree.fit(5, context.astype(np.uint64), at, byte.astype(np.int64), n)
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(tree.log10(np.array(grams(text), np.uint64)).sum())
    assert got[42] > -6


ITEM = "A farmer named Tom has 5 red apples and gives Anna 3 kg of them, how many apples does Tom keep after 2 days?"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"before it. {ITEM} and after", True),
        (ITEM.upper(), True),
        (ITEM.replace("Tom", "Jim").replace("Anna", "Sue").replace("5", "17").replace("3 kg", "4 lb"), True),
        (ITEM.replace("Tom keep", "Bob keep").replace("named Tom", "named Jim"), True),  # mostly as written
        ("A farmer named Jim has 7 red cars and gives Sue 4 cm of them, how few cars does Bob lose after 2 weeks?", False),
        ("Some farmer has apples. " * 30, False),
        (None, False),
        ("", False),
        (("filler words here " * 5000) + ITEM, True),
    ],
)
def test_decontamination(spark, text, found):
    docs = spark.createDataFrame([(1, text, 1), (2, "clean text of some words", 1), (None, None, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(8, ITEM), (7, ITEM), (9, None), (10, "too short"), (11, "")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_ids) for r in got] == ([(1, [7])] if found else [])
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == 3 - found
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 3
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


QUESTION = (
    "Maria Lopez drove 12 km from Boston to Salem in 3 hours with her sister Anna , then she bought "
    "forty two apples for 5 dollars and gave 7 of them to Peter Smith before the long trip home"
)


@pytest.mark.parametrize(
    ("item", "text", "coverage"),
    [
        (QUESTION, QUESTION.lower(), 1.0),
        (QUESTION, QUESTION.replace("12 km", "15km").replace("3 hours", "4h"), 1.0),
        (QUESTION, QUESTION.replace("Maria Lopez", "Ben").replace("Peter Smith", "Karl Otto Braun"), 1.0),
        (QUESTION, QUESTION.replace("forty two", "sixteen").replace("12 km", "two hundred miles"), 1.0),
        (QUESTION, QUESTION.replace("7 of", "eight of").replace("5 dollars", "9"), 1.0),
        (QUESTION, "so " + " ".join(QUESTION.split()[4:15]) + " indeed", 0.2),  # eleven words of it
        (QUESTION, "so " + " ".join(QUESTION.split()[4:12]) + " indeed", None),
        ("What is 2+2?", "Quiz\nWhat is 2+2?\nfour", 1.0),
        ("What is 2+2?", "I know what is 2+2? yes", None),
        ("What is 2+2?", "What is 3+3?", None),
    ],
)
def test_templates(spark, item, text, coverage):
    docs = spark.createDataFrame([(1, "some words before\n" + text + "\nand some after")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "another question about nothing at all")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    if coverage is None:
        assert not got
    else:
        assert [r.item_ids for r in got] == [[7]]
        assert got[0].coverage == 1 if coverage == 1 else got[0].coverage >= coverage


def test_decontamination_against_brute_force(spark):
    draw = random.Random(12)
    plain = "the old river stone bridge under tall green trees near market people often walk slowly".split()
    def token():
        return draw.choice([draw.choice(plain)] * 4 + ["7", "forty", "two", "km", "5kg", "hours", "Anna", "Bo", "Éva", "end.", "(so", "%"])
    items = {k: " ".join(token() for _ in range(draw.choice([2, 4, 6, 12, 25]))) for k in range(25)}
    texts: dict = {0: None, 1: "", 2: " \n"}
    for k in range(3, 90):
        own = [token() for _ in range(draw.randint(0, 25))]
        if k % 3:
            part = items[draw.randrange(25)].split()
            low = draw.randint(0, len(part) // 3)
            part = [draw.choice(["9", "Carl"]) if w in ("7", "Anna") and draw.random() < 0.5 else w for w in part[low:]]
            own += [draw.choice(["", "", "\n"]) + part[0], *part[1:]] if part else []
        texts[k] = " ".join(own) + draw.choice(["", "\n tail"])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontaminate.find_items(docs, bench).collect()
    want = brute.benchmark_items(texts, items)
    assert {(int(r.name), r.item_id): round(r.coverage, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 30


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (  # new numbers that coincide
            "Tom sold 5 red apples to Anna for 3 dollars then 7 green pears to Bill for 9 euros",
            "Jim sold 4 red apples to Sue for 4 pounds then 8 green pears to Carl for 4 euros",
        ),
        (  # one number for two quantities
            "Tom counted 2 boys near the old river bridge while Anna watched 3 girls under a tall tree for 2 days before Bill left 4 dogs behind",
            "Jim counted 3 boys near the old river bridge while Sue watched 6 girls under a tall tree for 5 days before Carl left 7 dogs behind",
        ),
    ],
)
def test_coincidences_are_no_contradiction(spark, item, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert [(r.doc_id, r.item_ids) for r in got] == [(1, [7])] and got[0].coverage > 0.8


def _spoken(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, _, role, text in rows:
        own = out.setdefault(conv, ["", "", 0])
        own[0] += f"{role or ''}\n{text or ''}\n"
        own[1] += (text or "") if role == "assistant" else ""
        own[2] += 1
    return {c: (n, brute.sha(t), len(x), brute.sha(x)) for c, (t, x, n) in out.items()}


def test_chat_round_trip(spark):
    draw = random.Random(9)
    pieces = ["\\", "<", ">", "</turn>\n", "<turn user>", "word ", "é", "\n", "\\<", "### x ", "\x00"]
    rows = [
        (conv, turn, draw.choice(["user", "assistant", "system", "a>b\\", None]), "".join(draw.choices(pieces, k=draw.randint(0, 40))))
        for conv in [*range(30), None]
        for turn in range(draw.randint(1, 25))
    ]
    rows += [(77, 0, "system", "be good"), (77, 1, "user", None), (77, 2, "assistant", "long " * 3000), (77, 3, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    params = chat.Params(budget=40, history=15)
    windows = chat.format_chats(turns, params).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == _spoken(rows)
    for w in windows.collect():
        found = list(chat._TURN.finditer(w.text))
        assert w.tokens <= 40 or len(found) - w.repeated == 1
        if w.window and w.conv_id == 77:
            assert found[0][1] == "system"
    again = chat.read_back(chat.format_chats(turns.limit(0), params))
    assert again.count() == 0


def test_repeated_turns_are_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ordered = [rows[3], rows[1], rows[2], rows[0]]
    got = chat.read_back(chat.format_chats(turns)).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == _spoken(ordered)[1]


@needs_tables
def test_pipeline(spark):
    """Stage by stage, each against plain Python on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 400")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    items = [brute.words(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = docs.columns
    for (_, stage), kind in zip(corpus_pipeline.STAGES, ("quality", "lines", "near", "items", "mix")):
        before_docs, before = docs, {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF_DIR), "test")
        after = {r.doc_id: r for r in docs.collect()}
        if kind == "mix":
            known = {r.doc_id: r for r in mixing.mix_sources(before_docs).collect()}
            assert set(known) == set(before) and set(after) == {k for k, r in known.items() if r.taken}
            assert docs.columns == [*kept, *mixing.MIX]
            for k, r in after.items():
                assert r.size == len(brute.words(before[k])) and 0 < r.taken <= 3 * r.size
                assert (r.text, r.taken, r.spans) == (before[k], known[k].taken, known[k].spans)
            continue
        assert docs.columns == kept
        if kind == "quality":
            right = [(k in after) == (labels[k] == 1) for k in before if k in labels]
            assert np.mean(right) > 0.97
        elif kind == "lines":
            want = {k: v[2] for k, v in brute.lines(before, 10).items()}
            assert {k: brute.sha(r.text) for k, r in after.items()} == want
        elif kind == "near":
            group = brute.near(before, 5, 80)[1]
            assert set(after) == {k for k, g in group.items() if k == g}
        else:
            holds = {k for k, t in before.items() if any(" ".join(i) in " ".join(brute.words(t)) for i in items)}
            assert set(after) == set(before) - holds
