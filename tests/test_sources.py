import time

from pyspark.sql import functions as F

from millrace.operators import narrate, plugins, retrieval
from millrace.sources import files, schemas
from millrace.streaming import windows


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\fthree\ffour")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("")

    def parser(content):
        if content.startswith(b"\xff"):
            raise ValueError("bad")
        return files.plain_text(content)

    out = files.parsed_files(spark, str(tmp_path), parser)
    rows = sorted((r.path.rsplit("/", 1)[1], r.page, r.text, r.status) for r in out.collect())
    assert rows == [("a.txt", 0, "one", "ok"), ("a.txt", 1, "two", "ok"), ("a.txt", 2, "three", "ok"), ("b.txt", 0, "ValueError: bad", "failed")]
    out.write.parquet(str(tmp_path / "cache.pq"))
    cache = spark.read.parquet(str(tmp_path / "cache.pq"))

    def never(content):
        raise AssertionError

    again = files.parsed_files(spark, str(tmp_path / "*.txt"), never, cache=cache)
    assert again.count() == 4 and again.filter("status = 'failed'").count() == 1


def test_upload_list(spark):
    df = spark.createDataFrame([("a.pdf", 1), ("a.pdf", 1), ("b.PDF", 2), ("c.txt", 3)], "name string, size int")
    assert [r.name for r in files.upload_list(df).collect()] == ["a.pdf", "b.PDF"]


def test_markdown(spark):
    df = spark.createDataFrame([(1, "## Head\n\ntext")], "id int, md string")
    assert [(r.line, r.is_header, r.y) for r in files.markdown_elements(df, "id", "md").orderBy("pos").collect()] == [("Head", True, 0), ("text", False, 40)]


def test_domain_files(spark, tmp_path):
    (tmp_path / "sales.json").write_text('{"crm": ["crm", "customer relations"], "x": []}')
    (tmp_path / "bad.json").write_text('{"crm": [')
    rows = {(r.domain, r.canonical, r.surface) for r in schemas.domain_files(spark, str(tmp_path)).collect()}
    assert rows == {("sales", "crm", "crm"), ("sales", "crm", "customer relations")}


def test_json_or_empty(spark):
    df = spark.createDataFrame([('{"misc": "a"}',), ('{"misc": "a"',), ("not available",), (None,), ("",)], "j string")
    assert [r.m for r in df.select(schemas.json_or_empty("j", schemas.PARSED)["misc"].alias("m")).collect()] == ["a", None, None, None, None]


def test_plugins(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "a", None, "aaaa"])], "id int, t string")
    vectors = df.select("id", plugins.encoded(F.col("t"), lambda: lambda ts: [[len(t), 1.0] for t in ts]).alias("v"))
    assert sorted(list(r.v) for r in vectors.collect()) == [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [4.0, 1.0]]
    scored = plugins.rescored(df.withColumn("s", F.coalesce(F.length("t"), F.lit(0))), "id", "t", "s", "q", lambda: lambda pairs: [0.0 for _ in pairs], 2)
    assert sorted((r.id, r.pair_score) for r in scored.collect()) == [(0, 0.5), (3, 0.5)]


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    query = windows.counts(windows.event_stream(spark, str(tmp_path / "in"), 10)).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.window.start, r.event_type, r.n, r.total)
    assert sorted(map(key, spark.table("seen").collect())) == sorted(map(key, windows.counts(events).collect()))


def test_kept_tasks(spark):
    now = int(time.time())
    df = spark.createDataFrame([(1, now - 10), (2, now - 7200)], "id int, t long").withColumn("created_at", F.timestamp_seconds("t"))
    assert [r.id for r in windows.kept_tasks(df).collect()] == [1]


def test_bm25_edges(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c")], "id int, t string")
    got = {r.id: r.bm25 for r in retrieval.bm25(df, "id", "t", "a a zz").collect()}
    assert got[1] > 0 and got[2] == got[3] == got[4] == 0
    assert retrieval.hybrid_rank(df, "id", "t", "a").count() == 4
    assert {r.bm25 for r in retrieval.bm25(df, "id", "t", " ").collect()} == {0.0}
    assert retrieval.bm25(df.limit(0), "id", "t", "a").count() == 0


def test_polish(spark):
    df = spark.createDataFrame([("the the plan .. 1 skills",), ("21 skills here",), ("",)], "t string")
    assert [r.o for r in df.select(narrate.polished(F.col("t")).alias("o")).collect()] == ["the plan. 1 skill.", "21 skills here.", ""]
