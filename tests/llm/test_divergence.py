"""Divergence of sources against its SQL, with tiles of every shape."""

import duckdb
import pandas as pd
import pytest

from lodestrand.llm import divergence, queries

SF = "/root/testdata/sf0.001"
KIND = "text string, lang string, source string, term string, n long, block int, member int"


def by_sql(rows, least=30):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:3] for r in rows], columns=["text", "lang", "source"], dtype="string"))
    return {r for r in con.execute(queries.ORACLE["op11_divergence"].replace("HAVING sum(docs) >= 30", f"HAVING sum(docs) >= {least}")).fetchall()}


@pytest.mark.parametrize("shape", [{}, {"block": 1, "chunk": 1, "span": 1}, {"block": 3, "chunk": 7, "span": 2}, {"block": 7, "chunk": 1000, "span": 1}])
def test_documents(spark, shape):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source")
    expected = by_sql([tuple(r) for r in docs.collect()], 5)
    assert {tuple(r) for r in divergence.source_divergence(docs, least_docs=5, **shape).collect()} == expected
    assert {r[2] for r in expected} == {"pair", "term"}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source")
    assert {tuple(r) for r in queries.op11_divergence(spark, SF).collect()} == by_sql([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    texts = [None, "", "123 --", "Äpfel ÄPFEL äpfel A a", "a\u0000b K K", "x " * 50_000, "naïve—dash 𝒳𝒴"]
    rows = [(t, lang, source, "c", 1, 0, 0) for t in texts for lang in (None, "", "en") for source in (None, "s", "S", "té")]
    rows += [("only here", "xx", "one", "c", 1, 0, 0), ("a b", "yy", "p", "c", 1, 0, 0), (None, "yy", "q", "c", 1, 0, 0)] + [("a b", "zz", "p", "c", 1, 0, 0)] * 3
    docs = spark.createDataFrame(rows, KIND)
    for least in (1, 2, 30):
        assert {tuple(r) for r in divergence.source_divergence(docs, least_docs=least, block=2, chunk=2).collect()} == by_sql(rows, least)


def test_no_rows(spark):
    assert divergence.source_divergence(spark.createDataFrame([], KIND)).collect() == []


def test_shares_beyond_double_precision():
    import numpy as np

    n, total = np.array([9_007_199_254_740_993, 12, 10**15]), np.array([9_007_199_254_740_995, 7_000_000_000_000, 10**15])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]
