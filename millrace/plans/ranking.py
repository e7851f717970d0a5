"""Queries of retrieval: one requirement text against all documents, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..session import spread, written
from ..sources import schemas as S
from .skills import RESUME
from .texts import sql_trim

#: The requirement text of these queries; an engine's caller passes their own.
REQUIREMENT = "Senior engineer for intake pipeline and reporting mart; solid grounding in payload signing, queue depth tuning and cache eviction planning, payload signing on call rota"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term comes in each document."""
    return R.term_frequencies(_docs(spark, sf_dir), "doc_id", "text")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term comes."""
    return R.document_frequencies(_docs(spark, sf_dir), "doc_id", "text")


def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score against the requirement and its position."""
    scores = written(R.bm25(_docs(spark, sf_dir), "doc_id", "text", REQUIREMENT), "bm25")
    return R.ranked(scores, "bm25", "doc_id", n=scores.count())


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 best."""
    return R.bm25(_docs(spark, sf_dir), "doc_id", "text", REQUIREMENT).orderBy(F.col("bm25").desc(), "doc_id").limit(25)


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and coverage rankings fused, scaled to [0, 1]."""
    docs = _docs(spark, sf_dir)
    both = written(R.both_scores(docs, "doc_id", "text", REQUIREMENT), "scores")
    return R.min_max(R.fused(both, "doc_id", ["bm25", "dense"], n=both.count()), "rrf", "rrf_norm").select("doc_id", "rrf", "rrf_norm")


def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: fusion, re-scoring of the top ten, two tiers sorted together."""
    return R.hybrid_rank(_docs(spark, sf_dir), "doc_id", "text", REQUIREMENT)


def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 100, against all."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return R.nearest(v, "vec_id", "embedding", v.filter(F.col("vec_id") % 100 == 0), 5)


def bm25_by_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each posting the ten best resumes by BM25 of its title against their text: many requirements at once."""
    r = S.resumes(spark, sf_dir, "experience", "education", "skills", "misc", "raw_text")
    many = lambda c: F.array_join(F.flatten(c), " ")
    text = T.resume_text(F.col("raw_text"), many(F.transform("experience", lambda e: F.array(e["title"], e["company"]))), many("experience.bullets"), F.array_join("skills.skill", " "), F.array_join("education.degree", " "), F.col("misc"))
    jobs = spark.read.parquet(f"{sf_dir}/job_postings.parquet").filter("title IS NOT NULL").select("job_id", "title")
    # postings share titles: each distinct title is matched once
    top = R.bm25_many(r.select("resume_id", text.alias("text")), "resume_id", "text", jobs.select("title").distinct(), "title", "title", 10)
    return jobs.join(top, "title").select("job_id", "resume_id", "score", "pos")


QUERIES = {f.__name__: f for f in (term_frequency, document_frequency, bm25_rank, bm25_topk, rrf_fuse, hybrid_rank, cosine_nearest, bm25_by_job)}

_WORDS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
_TERMS = ", ".join(f"('{t}', {n})" for t, n in R._query_terms(REQUIREMENT))
_BM25 = f"""
    q AS (SELECT * FROM (VALUES {_TERMS}) AS v(term, qtf)),
    d AS (SELECT doc_id, coalesce({_WORDS.format(c="text")}, []) AS ws FROM documents),
    st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
    df AS (SELECT q.term, q.qtf, count(tf.doc_id) AS df FROM q LEFT JOIN tf USING (term) GROUP BY ALL),
    sc AS (SELECT tf.doc_id, sum(df.qtf * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len(d.ws) / st.mean))) AS s FROM tf JOIN df USING (term) JOIN d ON d.doc_id = tf.doc_id CROSS JOIN st GROUP BY ALL),
    bm AS (SELECT d.doc_id, round(coalesce(sc.s, 0.0), 9) AS bm25, round((SELECT count(*) FROM q WHERE list_contains(d.ws, q.term)) / (SELECT count(*) FROM q), 9) AS dense FROM d LEFT JOIN sc USING (doc_id)),
    pos AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, doc_id) - 1 AS p1, row_number() OVER (ORDER BY dense DESC, doc_id) - 1 AS p2 FROM bm),
    rf AS (SELECT *, round(1.0 / (61 + p1) + 1.0 / (61 + p2), 12) AS rrf FROM pos),
    mm AS (SELECT *, round(CASE WHEN max(rrf) OVER () - min(rrf) OVER () < 1e-9 THEN 0.5 ELSE (rrf - min(rrf) OVER ()) / (max(rrf) OVER () - min(rrf) OVER ()) END, 9) AS rrf_norm FROM rf),
    tp AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, doc_id) <= 10 AS top FROM mm),
    ce AS (SELECT *, CASE WHEN top THEN round(1 / (1 + exp(-(6 * dense - 3))), 9) ELSE 0.0 END AS "cross" FROM tp),
    fi AS (SELECT *, CASE WHEN "cross" > 0 THEN "cross" ELSE rrf_norm END AS final FROM ce)
"""
_PARTS = [
    "array_to_string(flatten(list_transform(p.experience, lambda e: [e.title, e.company])), ' ')", "array_to_string(flatten(list_transform(p.experience, lambda e: e.bullets)), ' ')",
    "array_to_string(list_transform(p.skills, lambda e: e.skill), ' ')", "array_to_string(list_transform(p.education, lambda e: e.degree), ' ')", "p.misc",
]
_TEXT = f"coalesce(nullif(concat_ws(' ', {', '.join(f'nullif({sql_trim(c)}, {chr(39) * 2})' for c in _PARTS)}), ''), p.raw_text)"
_UNIT = "round(round(CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-9 THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 9), 2)"
SQL = {
    "term_frequency": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format(c="text")} AS ws FROM documents), e AS (SELECT doc_id, len(ws)::INT AS length, unnest(ws) AS term FROM d)
        SELECT doc_id, term, count(*) AS tf, first(length) AS length FROM e GROUP BY doc_id, term
    """,
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_WORDS.format(c='text')})) AS term FROM documents) GROUP BY term",
    "bm25_rank": f"WITH {_BM25} SELECT doc_id, bm25, p1 AS pos FROM pos",
    "bm25_topk": f"WITH {_BM25} SELECT doc_id, bm25 FROM pos WHERE p1 < 25",
    "rrf_fuse": f"WITH {_BM25} SELECT doc_id, rrf, rrf_norm FROM mm",
    "hybrid_rank": f"""WITH {_BM25} SELECT doc_id, bm25, dense, rrf_norm, "cross", final, row_number() OVER (ORDER BY final DESC, doc_id) AS rank, round(final * 100, 2) AS display, CASE WHEN "cross" > 0 THEN 'cross' ELSE 'fusion' END AS tier,
        CASE WHEN "cross" > 0 THEN printf('pair score %.3f (BM25 %.2f, dense %.2f)', round("cross", 3), {_UNIT.format(c="bm25")}, {_UNIT.format(c="dense")}) ELSE printf('fused score %.3f (BM25 %.2f, dense %.2f)', round(rrf_norm, 3), {_UNIT.format(c="bm25")}, {_UNIT.format(c="dense")}) END AS rationale FROM fi""",
    "cosine_nearest": """
        SELECT q.vec_id AS query_key, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id)::INT AS pos
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY pos <= 5
    """,
    "bm25_by_job": f"""
        WITH {RESUME}, x AS (SELECT resume_id, {_TEXT} AS text FROM r), w AS (SELECT resume_id, coalesce({_WORDS.format(c="text")}, []) AS ws FROM x), n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
        tf AS (SELECT resume_id, term, count(*) AS tf FROM (SELECT resume_id, unnest(ws) AS term FROM w) GROUP BY ALL),
        df AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf CROSS JOIN n GROUP BY term, n),
        q AS (SELECT title, term, count(*) AS qtf FROM (SELECT title, unnest({_WORDS.format(c="title")}) AS term FROM (SELECT DISTINCT title FROM job_postings WHERE title IS NOT NULL)) GROUP BY ALL),
        s AS (SELECT title, resume_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w.ws) / n.mean))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN w USING (resume_id) CROSS JOIN n GROUP BY title, resume_id),
        t AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, resume_id)::INT AS pos FROM s QUALIFY pos <= 10)
        SELECT job_id, resume_id, score, pos FROM job_postings JOIN t USING (title)
    """,
}
