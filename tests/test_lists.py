"""Lookups, evidence, sinks and requirement parsing by hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import criteria as C
from millrace.operators import evidence as E
from millrace.operators import lookups as L


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    assert [(r.id, r._message) for r in L.by_id(df, "id", "1").collect()] == [(1, "found")]
    assert [(r.id, r._message) for r in L.by_id(df, "id", 9).collect()] == [(None, "not found: 9")]
    assert [(r.pos, r.id, r.name) for r in L.of_ids(df, "id", [2, 9, 1]).orderBy("pos").collect()] == [(0, 2, "b"), (2, 1, "a")]
    assert L.guarded(df, 3).count() == 3
    with pytest.raises(ValueError):
        L.guarded(df, 2)
    with pytest.raises(ValueError):
        L.guarded(df, 3, "  ")


def test_evidence(spark):
    row = spark.createDataFrame([(["java", "sql"], "Wrote SQL reports", "ce_pair", 0.8, " ".join(map(str, range(12))))], "req array<string>, text string, source string, conf double, long string")
    r = row.select(E.best_skill(F.col("req"), F.col("text")).alias("a"), E.best_skill(F.col("req"), F.lit("x")).alias("b"), E.best_skill(F.array().cast("array<string>"), F.lit("x")).alias("c"), E.statement_confidence(F.col("source"), F.col("conf")).alias("d"), E.statement_confidence(F.lit("text_match"), F.lit(0.05)).alias("e"), E.middle_quote(F.col("long")).alias("f")).first()
    assert (r.a, r.b, r.c, round(r.d, 6), r.e, r.f) == ("sql", "java", "relevant experience", 0.9, 0.0, "3 4 5 6 7 8")
    items = [(1, "text_match", "sql", 0.6), (1, "ce_pair", "go", 0.95), (1, "skill_inference", "go", 0.75), (1, "text_match", "c", 0.45)]
    ev = E.collected(spark.createDataFrame(items, "id int, source string, skill string, confidence double").withColumn("section", F.lit("x")))
    assert [r.confidence for r in ev.orderBy(F.col("confidence").desc()).collect()] == [0.95, 0.75, 0.6]  # 0.45 is left out
    best = E.best_example(ev, "id", spark.createDataFrame([(1, "sql")], "id int, skill string")).first()
    assert (best.skill, best.source) == ("sql", "text_match")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, float("nan"), None, ["a", "b"]), (2, False, 0.5, "x", [])], "id int, ok boolean, s double, t string, l array<string>")
    safe = {r.id: r for r in sinks.json_safe(df).collect()}
    assert (safe[1].ok, safe[1].s, safe[1].t) == (1, None, "") and safe[2].s == 0.5
    sinks.write_csv(df.filter("id = 2"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().s == "0.500000"
    sinks.write_json(df, str(tmp_path / "j"))
    table = sinks.written_with(spark.read.json(str(tmp_path / "j")), str(tmp_path / "j2"), {"added": F.lit(1)})
    assert table.count() == 2 and table.first().added == 1
    up = sinks.upserted(df.select("id", "t"), spark.createDataFrame([(2, "new"), (3, "n")], "id int, t string"), "id")
    assert sorted(map(tuple, up.collect()), key=str) == [(1, None), (2, "new"), (3, "n")]
    assert [r.id for r in sinks.deleted(df, spark.createDataFrame([(1,)], "id int"), "id").collect()] == [2]
    assert df.select(sinks.rendered(F.lit("h"), F.col("l")).alias("r")).first().r == "--- h ---\na\nb"
    got = sinks.assembled(spark.createDataFrame([(1, 7, 0.5, True), (1, 8, 0.9, False)], "g int, id int, s double, ok boolean"), "id", "g", F.lit("job"), "s", [F.col("s").desc()], ["ok"]).first()
    body = json.loads(got.body)
    assert body["schema"] == "2.1" and [c["id"] for c in body["candidates"]] == [8, 7] and body["batch"] == {"n": 2, "mean": 0.7, "top": 0.9}
    raw = spark.createDataFrame([(1, "a"), (2, "b")], "g int, x string")
    assert {r.g: r.body[:9] for r in sinks.with_fallback(spark.createDataFrame([(1, '{"made":1')], "g int, body string"), raw, "g").collect()} == {1: '{"made":1', 2: '{"g":2,"x'}
    lines = sinks.top_three(spark.createDataFrame([(i, f"n{i}", 1 / i) for i in (4, 2, 3, 1)], "r int, n string, s double"), "r", "n", "s").collect()
    assert [r.line for r in lines] == ["1. n1 (100.00)", "2. n2 (50.00)", "3. n3 (33.33)"]


JD = """Software Engineer Position

We are looking for a skilled software engineer with experience in:
- Python programming
- Database design and SQL

Requirements:
- Bachelor's degree in Computer Science or related field
- 3+ years of software development experience
"""


def test_posting(spark):
    df = spark.createDataFrame([(JD,), (None,), ("Position: Night Nurse!\nDuties: hold the ward together\nLocation: Norrheim harbour",)], "t string")
    rows = df.select(*[c.alias(k) for k, c in C.posting_fields(F.col("t")).items()]).collect()
    assert rows[0].job_title == "we are looking for a skilled software engineer with experience in" or "engineer" in rows[0].job_title
    assert rows[0].experience_required.startswith("in: - python programming") and "3+ years" not in rows[0].experience_required
    assert rows[2].job_title == "night nurse" and rows[2].responsibilities == "duties: hold the ward together location: norrheim harbour" and rows[2].location == "norrheim harbour"


def test_tokens_and_summaries(spark):
    df = spark.createDataFrame([(x,) for x in ("Must have experience with Python and React", "team lead", "c++", "a, b", "", None, "node.js", "12 years")], "v string")
    v = F.col("v")
    got = [tuple(r) for r in df.select(C.is_sentence(v), C.is_prose(v), C.is_clean_token(v), C.safe_int(v)).collect()]
    assert got[0] == (True, True, False, 0) and got[1] == (False, False, True, 0) and got[2][2] and not got[3][2] and got[4] == (False, False, False, 0) == got[5] and not got[6][2] and got[7][3] == 12
    made = df.limit(1).select(C.summary(F.lit("Nurse"), F.lit(None).cast("string"), F.lit(3), F.lit(" Dunfall "), F.array(F.lit("a"), F.lit(" ")), duties=F.array(F.lit("Run"), F.lit("Hold."))).alias("s"), C.digest(F.array(F.lit("b"), F.lit("a'c")), F.array().cast("array<string>"), F.lit(None).cast("int")).alias("h")).first()
    assert made.s == "We are seeking a Nurse. The role requires 3+ years of experience. Location: Dunfall Key responsibilities: Run. Hold. a"
    import hashlib

    assert made.h == hashlib.md5("|".join([str(sorted(["b", "a'c"])), "[]", "0"]).encode()).hexdigest()[:12]


def test_lists_of_skills(spark):
    forms = spark.createDataFrame([(1, "python", "python"), (1, "python", "py"), (2, "react", "react.js")], "skill_id int, canonical string, surface string")
    df = spark.createDataFrame([(1, ["Py", " API ", None, "React . js", "x"], ["PYTHON", "go", "rest"]), (2, None, [])], "id int, must array<string>, nice array<string>")
    got = {r.id: (r.must, r.nice) for r in C.hygiene(df, "id", "must", "nice", forms).collect()}
    assert got == {1: (["openapi", "python", "react", "rest", "swagger", "x"], ["go"]), 2: ([], [])}
    typed = spark.createDataFrame([(1, 0, "Must have experience with Python and React.js"), (1, 1, "You should have a calm and tidy way about you."), (1, 2, "Py"), (1, 3, "knots"), (1, 4, " ")], "id int, pos int, v string")
    rows = {(r.pos, r.kind, r.skill) for r in C.clean_skills(typed, "id", "v", forms).collect()}
    assert rows == {(0, "extracted", "python"), (0, "extracted", "react"), (1, "rejected", None), (2, "listed", "python"), (3, "as typed", "knots")}
