from pyspark.sql import functions as F

from lodestrand.llm.samples import labelled_sample


def test_bound_holds_for_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", F.lit(True), 3).collect()
    assert sorted((r["doc_id"], r["text"], r["label"]) for r in rows) == [(1, "text 0", 0), (2, "other", 1), (3, "", 1)]
