"""Places of skills in texts, and what stands around them."""

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import matching as M


def test_places():
    assert M.place("javascript and java.", "java") == (15, 4) and M.place("javascript", "java") is None
    assert M.place("we use .net, c++ and node.js", "c++") == (13, 3) and M.place("we use .net", "net") == (8, 3)
    assert M.place("foo-bar x bar", "bar") == (10, 3) and M.place("machine  -\nlearning", "machine learning") == (0, 19)


def test_first_places_by_any_form(spark):
    forms = spark.createDataFrame([("machine learning", 1, "Machine Learning"), ("ml", 1, "Machine Learning"), ("a b c d e f", 2, "Long")], "surface string, skill_id int, canonical string")
    docs = spark.createDataFrame([(1, "x" * 300 + " ML then machine learning"), (2, "a b c d e f"), (3, None), (4, "")], "id long, text string")
    got = {(r.id, r.skill): (r.text[r.at : r.at + r.n], r.at) for r in M.first_places(docs, "id", "text", forms).collect()}
    assert got == {(1, "machine learning"): ("ML", 100), (2, "long"): ("a b c d e f", 0)}
    assert M.extracted(docs, "id", "text", forms).count() == 2 and M.extracted(docs, "id", "text", forms.limit(0)).count() == 0


def test_context(spark):
    cases = {
        "First part. Built it with Spark and SQL. Then more.": ("Spark", "Built it with Spark and SQL"),
        "using Spark and": ("Spark", "Spark"),
        "one two three four five six seven eight nine ten eleven twelve Spark thirteen fourteen fifteen sixteen seventeen eighteen": ("Spark", "ten eleven twelve Spark thirteen fourteen fifteen"),
    }
    for text, (word, want) in cases.items():
        df = spark.createDataFrame([(text, text.index(word), len(word))], "t string, a int, n int")
        assert df.select(T.context_of(F.col("t"), F.col("a"), F.col("n")).alias("c")).first().c == want
