from pyspark.sql import functions as F
from tessera.llm.lang_id import lang_id

from tests.llm import cases


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = docs.where("doc_id % 2 = 0")
    mixed = learn.unionByName(docs.where("doc_id % 2 = 1").withColumn("lang", F.lit(None).cast("string")))
    found = lang_id(mixed).withColumnRenamed("lang", "found").join(docs.where("doc_id % 2 = 1 and length(text) > 50"), "doc_id")
    right, n = found.agg(F.sum((F.col("found") == F.col("lang")).cast("int")), F.count("*")).first()
    assert right / n > 0.97


def test_all_rows_stay(spark):
    rows = {r.doc_id: r for r in lang_id(cases.edges(spark)).collect() if r.doc_id is not None}
    assert lang_id(cases.edges(spark)).count() == len(cases.EDGES)
    for i in (1, 2):
        assert (rows[i].lang, rows[i].bits_per_byte, rows[i].margin) == (None, 0, None)
    assert rows[7].lang == "de" and rows[8].lang == "en"


def test_no_labels_and_one_label(spark):
    unlabelled = cases.edges(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in lang_id(unlabelled).collect()} == {None}
    one = cases.edges(spark).withColumn("lang", F.lit("en"))
    assert {(r.lang, r.margin) for r in lang_id(one).where("doc_id > 3").collect()} == {("en", None)}
    assert lang_id(cases.empty(spark)).collect() == []


def test_ties_go_to_the_first_language(spark):
    rows = [(1, "abc abc", "b", "s", 1, None, None, None, None), (2, "abc abc", "a", "s", 1, None, None, None, None)]
    assert {(r.lang, r.margin) for r in lang_id(spark.createDataFrame(rows, cases.SCHEMA)).collect()} == {("a", 0.0)}
