"""Language detection: texts that weren't learned from, and odd rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators import languages
from docweave.session import table

SF = "/root/testdata/sf0.01"


def test_texts_not_learned_from(spark):
    docs = table(spark, SF, "documents")
    learn = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    profile, names = languages.profiles(docs.where(learn))
    got = languages.detected(docs.where(~learn), profile, names).join(docs, "doc_id").select(F.avg((F.col("code") == F.col("lang")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert got.n > 400 and got.right > 0.98


def test_parts_of_texts(spark):
    docs = table(spark, SF, "documents")
    profile, names = languages.profiles(docs)
    parts = docs.select("doc_id", "lang", F.substring("text", 1, 60).alias("text")).where("length(text) >= 40")
    right = languages.detected(parts, profile, names).join(parts, "doc_id").agg(F.avg((F.col("code") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gram", T.StringType())])
    known = [(i, "a", "lalala lolo lala lulu la lo", "x") for i in range(3)] + [(9, "b", "kiki kuku keke kik kek", "x"), (10, None, "mm mm", "x"), (11, "b", None, "x")]
    profile, names = languages.profiles(spark.createDataFrame(known, schema))
    assert names == ["a", "b"] and profile.count() <= languages.GRAMS
    asked = [(1, None, None, "x"), (2, None, "", "x"), (3, None, "lala lala", "x"), (4, None, "12345 67890 !!!! ???? 12", "x"), (5, None, "Lala LOLO lulu lala!!", "x"), (6, None, "kuku kuku kiki kuku keke " * 5000, "x"), (None, None, "lalala lolo lulu lolo", "x"), (7, None, " \n" * 30 + "kiki", "x")]
    got = {r.doc_id: (r.code, r.confidence) for r in languages.detected(spark.createDataFrame(asked, schema), profile, names).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "unknown", 2: "unknown", 3: "unknown", 4: "unknown", 5: "a", 6: "b", None: "a", 7: "unknown"}
    assert all((v[1] is None) == (v[0] == "unknown") for v in got.values()) and got[6][1] == 1.0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None, "some text of words")], "doc_id long, lang string, text string")
    profile, names = languages.profiles(docs)
    assert names == [] and [r.code for r in languages.detected(docs, profile, names).collect()] == ["unknown"]
    assert languages.detected(docs.limit(0), profile, names).collect() == []


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE", 2)
    docs = spark.createDataFrame([(i, "a", "abc") for i in range(50)], "doc_id long, lang string, text string")
    profile, _ = languages.profiles(docs)
    assert {r.gram for r in profile.collect()} == {"_ab", "abc", "bc_"}
