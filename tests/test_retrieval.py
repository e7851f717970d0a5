"""Ranking with plug-ins, positions both ways, nearest vectors and BM25 of many queries against brute force."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import retrieval as R


def letters():
    return lambda texts: [[t.count("a"), t.count("b"), 1.0] for t in texts]


def pairs():
    return lambda both: [float(len(t)) - 5 for _, t in both]


def test_hybrid_rank_with_plug_ins(spark):
    texts = ["alpha beta", "beta beta gamma", None, "", "delta", "alpha"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r for r in R.hybrid_rank(df, "id", "text", "alpha beta", letters, pairs, 2).collect()}
    assert len(got) == 6 and sorted(r.rank for r in got.values()) == [1, 2, 3, 4, 5, 6]
    q = np.array([3.0, 1.0, 1.0])  # "alpha beta" has three a and one b
    for i, t in enumerate(texts):
        v = np.array([(t or "").count("a"), (t or "").count("b"), 1.0])
        assert abs(got[i].dense - q @ v / np.linalg.norm(q) / np.linalg.norm(v)) < 1e-8
    cross = [r for r in got.values() if r.tier == "cross"]
    assert len(cross) == 2 and all(abs(r.cross - 1 / (1 + math.exp(5 - len(texts[r.id] or "")))) < 1e-8 and r.final == r.cross and r.rationale.startswith("pair score") for r in cross)
    assert all(r.final == r.rrf_norm and r.rationale.startswith("fused score") for r in got.values() if r.tier == "fusion")
    plain = R.hybrid_rank(df, "id", "text", "alpha beta").collect()
    assert [r.id for r in sorted(plain, key=lambda r: r.rank)][0] == 0
    assert R.hybrid_rank(df.limit(0), "id", "text", "alpha").count() == 0


def test_both_ways_of_ranking(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("s"))
    one, many = R.ranked(df, "s", "id", n=500), R.ranked(df.repartition(5), "s", "id")
    assert sorted(map(tuple, one.select("id", "pos").collect())) == sorted(map(tuple, many.select("id", "pos").collect()))


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(120)] + [(200, [0.0, 0.0, 0.0]), (201, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    for block in (2, 2000):
        got = sorted((r.query_key, r.pos, r.id, r.score) for r in R.nearest(df, "id", "v", df.filter("id % 10 = 0"), 3, block=block).collect())
        want = []
        known = {i: np.array(v) for i, v in rows if v}
        for q in sorted(i for i in known if i % 10 == 0):
            cos = lambda a, b: round(float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300)), 6) + 0.0
            best = sorted((-cos(known[q], v), i) for i, v in known.items() if i != q)[:3]
            want += [(q, p + 1, i, -s + 0.0) for p, (s, i) in enumerate(best)]
        assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))


def test_bm25_of_many_queries(spark):
    docs = ["red fox runs", "red red wolf", "", None, "the fox and the wolf", "blue"]
    queries = ["red fox", "wolf wolf", "nothing"]
    d = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    got = {(r.q, r.id): r.score for r in R.bm25_many(d, "id", "text", spark.createDataFrame([(q,) for q in queries], "q string"), "q", "q").collect()}
    words = [re.findall("[a-z0-9]+", t or "") for t in docs]
    mean, n, want = sum(map(len, words)) / len(words), len(words), {}
    for q in queries:
        for i, ws in enumerate(words):
            s = sum(k * math.log((n - (df := sum(t in w for w in words)) + 0.5) / (df + 0.5) + 1) * ws.count(t) * 2.5 / (ws.count(t) + 1.5 * (0.25 + 0.75 * len(ws) / mean)) for t, k in Counter(q.split()).items() if t in ws)
            if s:
                want[q, i] = round(s, 6)
    assert got == want
