import math
import random

from pyspark.sql import functions as F

from millrace.llm.ranking import best_scores, top_n_per_group


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), rng.randint(0, 5) / 5, f"c{rng.randint(0, 9)}", i, "salt", "pos") for i in range(500)]
    rows += rng.sample(rows, 50)  # repeated rows are one item
    df = spark.createDataFrame(rows, "g string, s double, c string, id long, salt string, pos string")
    got = top_n_per_group(df, ["g"], [F.col("s").desc(), F.col("c").asc(), F.col("id").asc()], 10, "id", 4)
    assert got.columns == df.columns
    want = []
    for g in "ab":
        want += sorted({r for r in rows if r[0] == g}, key=lambda r: (-r[1], r[2], r[3]))[:10]
    assert sorted(r.id for r in got.collect()) == sorted(r[3] for r in want)


def test_best_scores(spark):
    schema = "score_id long, session_id string, candidate_id string, final_pre_llm double, ingested_at int"
    rows = [(1, "s1", "c2", 0.5, 1), (1, "s1", "c2", 0.5, 2), (2, "s1", "c1", 0.5, 1), (3, "s1", None, 0.5, 1), (4, "s1", "c0", None, 1), (5, "s1", "c0", math.nan, 1), (6, "s9", "c0", 1.0, 1), (7, "s2", "c0", 1.0, 1), (8, None, "c0", 1.0, 1), (9, "s3", "c9", 0.9, 1)]
    sessions = spark.createDataFrame([("s1", "j1"), ("s1", "j1"), ("s2", None), ("s3", "j1")], "session_id string, job_id string")
    scores = spark.createDataFrame(rows, schema)
    assert {(r.job_id, r.score_id) for r in best_scores(scores, sessions, 3).collect()} == {("j1", 9), ("j1", 3), ("j1", 2)}
    assert best_scores(scores.limit(0), sessions, 3).count() == 0
    assert best_scores(scores, sessions.limit(0), 3).count() == 0
