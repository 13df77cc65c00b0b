"""Queries against their SQL, on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

import check
from promptsieve.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def _compare(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for file in os.listdir(folder):
        path = f"{folder}/{file}" + ("/*.parquet" if os.path.isdir(f"{folder}/{file}") else "")
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{path}'")
    frame = queries.QUERIES[name](spark, folder)
    columns = sorted(frame.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in cursor.description]
    assert sorted(theirs) == columns
    order = [theirs.index(c) for c in columns]
    want = sorted(tuple(check._plain(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(check._plain(r[c]) for c in columns) for r in frame.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query(spark, name):
    _compare(spark, SF_DIR, name)


@pytest.mark.parametrize("rows", [0, 1])
def test_mixing_odd_rows(spark, tmp_path, rows):
    """Null and empty texts, a null source, sources of very different sizes, equal sizes."""
    texts = [(i, "w " * (i % 7), f"s{i % 3}") for i in range(200)]
    texts += [(1000 + i, "a\tb\n" * 400, "s1") for i in range(30)]
    texts += [(2000, None, "s0"), (2001, "", None), (2002, "one two", None), (2003, None, "void"), (2004, "x " * 9000, "Z")]
    frame = spark.createDataFrame(texts if rows else [], "doc_id long, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    _compare(spark, str(tmp_path), "op2_mixing")
    if rows:
        found = queries.QUERIES["op2_mixing"](spark, str(tmp_path)).toPandas()
        assert (found["taken"] <= 3 * found["size"]).all()
        taken = found.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
        assert (abs(taken["taken"] - taken["target"]) <= 0.02 * taken["target"] + 64).all()
        assert abs(found["taken"].sum() - found["size"].sum()) < 0.01 * found["size"].sum()


def test_the_mix_can_be_rebuilt(spark):
    """The words a document gives are its passes and spans, cut from the text."""
    from pyspark.sql import functions as F

    from promptsieve.llm.mixing import MIX, Params, mix_documents, mix_sources, mixed_words

    rows = [(i, " ".join(f"w{i}-{k}" for k in range(i % 90)), f"s{i * i % 5}", 1) for i in range(300)]
    rows += [(5000, "long " * 3000, None, 1), (None, "no id", "s1", 1), (None, None, "s1", 1), (7, rows[7][1], "s4", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken int").withColumn("row", F.lit("x"))
    params = Params(block=16, shard=2000)
    mixed = mix_documents(docs, params)
    assert mixed.columns == ["doc_id", "text", "source", "row", *MIX]
    words = mixed_words(F.col("text"), F.col("passes"), F.col("spans"))
    taken = 0
    for r in mixed.withColumn("words", words).collect():
        own = r.text.split()
        want = own * r.passes + [w for s in r.spans for w in own[s.first : s.stop]]
        assert r.words == want and len(want) == r.taken > 0
        assert all(s.stop <= t.first for s, t in zip(r.spans, r.spans[1:]))
        taken += r.taken
    assert taken == mix_sources(docs, params).agg(F.sum("taken")).first()[0]
    assert mix_documents(docs.limit(0), params).count() == 0


def test_sainte_lague(spark):
    """Against dealing seats one by one to the highest quotient."""
    from promptsieve.llm.mixing import sainte_lague

    for seats in (0, 1, 7, 100, 1001):
        weights = [53.0, 24.0, 23.0, 0.0, 100.0, 1.0, 24.0]
        rows = [(0, i, w, seats) for i, w in enumerate(weights)]
        found = sainte_lague(spark.createDataFrame(rows, "g int, p int, w double, n long"), "g", "p", "w", "n")
        won = [0] * len(weights)
        for _ in range(seats):
            won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
        assert {r.p: r.won for r in found.collect()} == dict(enumerate(won))
