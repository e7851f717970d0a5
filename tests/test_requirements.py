from pyspark.sql import functions as F

from millrace.operators.requirements import labelled_title


def test_labelled_title(spark):
    rows = [
        (None, "Bluefen Labs, Dunfall\nPosition: Shift Planner (m/f)\nmore", "Shift Planner mf"), (" ", "About us\nJOB TITLE: Welder\nPosition: none", "Welder"), ("Clerk", "Position: Welder", "Clerk"),
        (None, "Role: QA\nSeeking: a Nurse!", "a Nurse"), (None, "ab\nFirst line\nthen", "First line"), (None, None, None), (None, "", None),
    ]
    df = spark.createDataFrame(rows, "title string, text string, want string")
    assert [(r.got, r.want) for r in df.select(labelled_title(F.col("title"), F.col("text")).alias("got"), "want").collect() if r.got != r.want] == []
