import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{at}")
        docs = spark.read.parquet(f"{tmp_path}/{at}")
        now = {r["doc_id"] for r in docs.collect()}
        assert now <= before
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and len(now) >= 0.7 * len(before)
            before = now
        else:
            assert now == before


def test_registered():
    assert "pipeline" in __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))


def test_packed_rows_hold_their_token_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    rows = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert rows and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in rows)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, extra columns that clash with what the stages use, and an empty table."""
    good = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(6).collect()
    rows = [(r["doc_id"], r["text"], -5.0, -6.0, 1, "s", 2) for r in good] + [(good[0]["doc_id"], good[0]["text"], -5.0, -6.0, 1, "s", 2), (900, None, -5.0, -6.0, 1, "s", 2), (901, "", -5.0, -6.0, 1, "s", 2), (None, "word " * 30_000, -5.0, -6.0, 1, "s", 2)]
    ddl = "doc_id long, text string, quality_score double, toxicity_score double, _quality int, component string, _n long"
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "packing":
            continue
        assert made.schema == docs.schema
        found = sorted(map(tuple, made.collect()), key=repr)
        if name == "near_dedup":
            assert len(found) == len(set(found)) and {None, 900} <= {r[0] for r in found} and 901 not in {r[0] for r in found}
        else:
            assert set(found) <= set(rows) and all(found.count(r) == rows.count(r) for r in found)
    packed = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows}
    assert sum(r["start"] == 0 for r in packed) == len(rows)


def test_same_as_sql(spark):
    import os

    import duckdb

    from lodestrand.llm import queries

    duck = duckdb.connect()
    for name in os.listdir(SF):
        duck.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        rows = sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)
        assert rows == sorted(duck.execute(f"select {', '.join(columns)} from ({sql})").fetchall(), key=repr), name
