"""Queries of lists: orders, lookups by id, evidence of three sources, nested exports, places of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..operators import evidence as E
from ..operators import lookups as L
from ..sources import schemas as S
from .cohorts import _S, _scores, _valid
from .skills import QUERIES as _SKILLS
from .skills import RESUME
from .skills import SQL as _SKILLS_SQL


def _session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).filter("session_id IS NOT NULL").withColumn("final_pre_llm", F.when(~F.isnan("final_pre_llm"), F.col("final_pre_llm")))


def listed_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each session with the place they are listed at: ranked ones by rank, the others behind by semantic score."""
    s = _session_scores(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy(F.col("final_pre_llm").desc(), "score_id")
    ranked = s.withColumn("rank", F.when(F.col("final_pre_llm").isNotNull(), F.row_number().over(w)).otherwise(F.lit(0)))
    return L.numbered(ranked, [*L.by_rank(F.col("rank"), F.col("semantic_score")), F.col("score_id")], ["session_id"]).select("session_id", "score_id", "rank", "place")


def listed_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each session by coverage, ties by final and semantic score, then by candidate."""
    s = _session_scores(spark, sf_dir)
    order = L.by_metric(F.col("coverage"), F.col("final_pre_llm"), F.col("semantic_score"), name=F.coalesce("candidate_id", F.lit("")))
    return L.numbered(s, [*order, F.col("score_id")], ["session_id"]).select("session_id", "score_id", "place")


def listed_by_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each session by semantic score alone."""
    return L.numbered(_session_scores(spark, sf_dir), [F.col("semantic_score").desc_nulls_last(), F.col("score_id")], ["session_id"]).select("session_id", "score_id", "place")


def resume_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One resume by its id."""
    return L.by_id(S.table(spark, sf_dir, "resumes").select("resume_id", "filename"), "resume_id", 1).select("resume_id", "filename", F.col("_message").alias("message"))


def compared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three resumes in the order asked."""
    return L.of_ids(S.table(spark, sf_dir, "resumes").select("resume_id", "filename"), "resume_id", [3, 1, 2, 5]).select("pos", "resume_id", "filename")


def gaps_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bonus of a line for the space above it: the distance from the last place known before, by 24, up to 1, times 0.15. Places stand in the line
    items' quantities; those of returned items count as unknown."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("y"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("tie"))
    above = F.last("y", ignorenulls=True).over(Window.partitionBy("page").orderBy("line", "tie").rowsBetween(Window.unboundedPreceding, -1))
    bonus = F.round(0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("y") - F.col("above")) / 24.0), 6)
    return li.withColumn("above", above).select("page", "line", F.coalesce(bonus, F.lit(0.0)).alias("bonus"))


def text_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a page joined to elements: the upper median of sizes, the most frequent kind (the first by name of equal ones), whether any is marked."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_quantity").alias("size"), F.col("l_linestatus").alias("font"), (F.col("l_returnflag") == "A").alias("bold"))
    fonts = li.groupBy("page", "font").agg(F.count("*").alias("n")).groupBy("page").agg(F.max_by("font", F.struct("n", -F.ascii("font"))).alias("font"))
    out = li.groupBy("page").agg(F.sort_array(F.collect_list("size")).alias("sizes"), F.bool_or("bold").alias("bold"), F.count_if("bold").alias("n_bold"))
    return out.select("page", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")).alias("size"), "bold", "n_bold").join(fonts, "page")


def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary of two clusters of places on a page: three places or more on each side of the middle, whose means lie over a fifth of the width apart."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("x")).distinct()
    ends = li.groupBy("page").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = li.join(ends, "page").withColumn("left", F.col("x") < (F.col("lo") + F.col("hi")) / 2)
    side = lambda f, left: f(F.when(F.col("left") == left, F.col("x")))
    two = placed.groupBy("page", "lo", "hi").agg(F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr"), side(F.avg, True).alias("ml"), side(F.avg, False).alias("mr"), side(F.max, True).alias("el"), side(F.min, False).alias("er"))
    good = two.filter((F.col("nl") >= 3) & (F.col("nr") >= 3) & (F.col("mr") - F.col("ml") > 0.2 * (F.col("hi") - F.col("lo"))))
    return good.select("page", ((F.col("el") + F.col("er")) / 2).alias("boundary"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.resumes(spark, sf_dir, "skills")
    return r.select("resume_id", F.explode(F.array_distinct(F.filter(F.transform("skills.skill", F.lower), lambda x: x != ""))).alias("skill"))


def evidence_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for each resume: of its pair score (its best final score stands in), inferred skills, and mentions of its own skills in bullets."""
    r = S.resumes(spark, sf_dir, "experience", "skills")
    pair = _valid(_scores(spark, sf_dir)).groupBy("candidate_id").agg(F.max("final_pre_llm").alias("pair"))
    required = F.sort_array(F.array_distinct(F.filter(F.transform("skills.skill", F.lower), lambda x: x != "")))
    first = F.get("experience", F.lit(0))
    base = r.select("resume_id", "candidate_id", required.alias("required"), first["title"].alias("role"), first["company"].alias("company"), first["description"].alias("description")).join(pair, "candidate_id")
    bullets = r.select("resume_id", F.lit("experience").alias("section"), F.array_join(F.flatten("experience.bullets"), " ").alias("text")).filter("text <> ''")
    parts = (E.of_pairs(base, "resume_id", "pair", "required", "role", "company", "description"), E.of_inference(_SKILLS["skill_inference"](spark, sf_dir), "resume_id"), E.of_texts(bullets, "resume_id", _wanted(spark, sf_dir)))
    return E.collected(*parts).select("resume_id", "source", "skill", "confidence", "section", "text", "statement")


def best_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best piece of evidence of each resume."""
    return E.best_example(evidence_of_three(spark, sf_dir), "resume_id", _wanted(spark, sf_dir)).select("resume_id", "source", "skill", "confidence", "section")


def export_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each session as one nested JSON text with its counts."""
    s = _valid(_scores(spark, sf_dir)).filter("session_id IS NOT NULL")
    top = s.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("final_pre_llm").desc(), "score_id"))).filter("n <= 3")
    return sinks.assembled(top, "score_id", "session_id", F.col("session_id"), "final_pre_llm", [F.col("final_pre_llm").desc(), F.col("score_id")], ["coverage"])


_QUERIES = (listed_by_rank, listed_by_coverage, listed_by_semantic, resume_lookup, compared_ids, gaps_above, text_elements, page_columns, evidence_of_three, best_examples, export_sessions)
QUERIES = {f.__name__: f for f in _QUERIES}

_N = f"{_S}, n AS (SELECT score_id, session_id, candidate_id, semantic_score, coverage, CASE WHEN NOT isnan(final_pre_llm) THEN final_pre_llm END AS f FROM s WHERE session_id IS NOT NULL)"
_LOW = "list_filter(list_transform(p.skills, lambda x: lower(x.skill)), lambda x: x <> '')"
_TOLD = "coalesce(e.title, '') || ' experience at ' || coalesce(e.company, '') || CASE WHEN coalesce(e.description, '') <> '' THEN ': ' || left(e.description, 100) || '...' ELSE '' END"
_EVIDENCE = f"""
    WITH {RESUME}, {_S}, pr AS (SELECT candidate_id, max(final_pre_llm) AS pair FROM v GROUP BY candidate_id), q AS (SELECT resume_id, candidate_id, list_sort(list_distinct({_LOW})) AS req, p.experience[1] AS e, p FROM r),
    inf AS ({_SKILLS_SQL["skill_inference"]}),
    a AS (SELECT resume_id, 'ce_pair' AS source, coalesce(list_filter(req, lambda s: contains(lower(concat_ws(' ', e.title, e.description)), s))[1], req[1]) AS skill, least(0.95::DOUBLE, pair) AS confidence, 'experience' AS section, {_TOLD} AS text FROM q JOIN pr USING (candidate_id) WHERE pair > 0.5 AND e.title IS NOT NULL AND len(req) > 0),
    b AS (SELECT resume_id, 'skill_inference', skill, score, section, 'Found in ' || section || ' section' FROM inf),
    w AS (SELECT resume_id, unnest(req) AS skill, array_to_string(flatten(list_transform(p.experience, lambda x: x.bullets)), ' ') AS t FROM q),
    c AS (SELECT resume_id, 'text_match', skill, 0.6::DOUBLE, 'experience', 'Named in experience' FROM w WHERE t <> '' AND contains(lower(t), skill)),
    ev AS (SELECT *, round((CASE WHEN source = 'ce_pair' AND confidence > 0.7 THEN least(0.95, confidence + 0.1) WHEN source = 'text_match' THEN greatest(0.0, confidence - 0.1) ELSE confidence END)::DOUBLE, 6) AS statement FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE confidence >= 0.6)
"""
SQL = {
    "listed_by_rank": f"""
        WITH {_N}, k AS (SELECT *, CASE WHEN f IS NOT NULL THEN row_number() OVER (PARTITION BY session_id ORDER BY f DESC NULLS LAST, score_id) ELSE 0 END::INT AS rank FROM n)
        SELECT session_id, score_id, rank, row_number() OVER (PARTITION BY session_id ORDER BY nullif(rank, 0) ASC NULLS LAST, semantic_score DESC NULLS LAST, score_id)::INT AS place FROM k
    """,
    "listed_by_coverage": f"WITH {_N} SELECT session_id, score_id, row_number() OVER (PARTITION BY session_id ORDER BY coverage DESC NULLS LAST, f DESC NULLS LAST, semantic_score DESC NULLS LAST, coalesce(candidate_id, ''), score_id)::INT AS place FROM n",
    "listed_by_semantic": f"WITH {_N} SELECT session_id, score_id, row_number() OVER (PARTITION BY session_id ORDER BY semantic_score DESC NULLS LAST, score_id)::INT AS place FROM n",
    "resume_lookup": "SELECT r.resume_id, r.filename, CASE WHEN r.resume_id IS NULL THEN 'not found: 1' ELSE 'found' END AS message FROM (SELECT '1' AS id) AS a LEFT JOIN resumes AS r ON r.resume_id::VARCHAR = a.id",
    "compared_ids": "SELECT pos, resume_id, filename FROM (VALUES (0, 3), (1, 1), (2, 2)) AS a(pos, id) JOIN resumes ON resume_id = id",
    "gaps_above": "WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS y, l_partkey, l_suppkey, l_extendedprice FROM lineitem), a AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY page ORDER BY line, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l) SELECT page, line, coalesce(round(CASE WHEN y IS NOT NULL AND above IS NOT NULL THEN 0.15::DOUBLE * least(1.0, greatest(0.0, y - above) / 24.0) END, 6), 0.0) AS bonus FROM a",
    "text_elements": """
        WITH f AS (SELECT page, font FROM (SELECT l_orderkey AS page, l_linestatus AS font, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, font) = 1)
        SELECT l_orderkey AS page, list_sort(list(l_quantity))[count(*) // 2 + 1] AS size, bool_or(l_returnflag = 'A') AS bold, count(*) FILTER (l_returnflag = 'A') AS n_bold, any_value(font) AS font FROM lineitem JOIN f ON f.page = l_orderkey GROUP BY l_orderkey
    """,
    "page_columns": """
        WITH l AS (SELECT DISTINCT l_suppkey AS page, l_partkey AS x FROM lineitem), e AS (SELECT page, min(x) AS lo, max(x) AS hi FROM l GROUP BY page), p AS (SELECT *, x < (lo + hi) / 2 AS lft FROM l JOIN e USING (page)),
        t AS (SELECT page, lo, hi, count(*) FILTER (lft) AS nl, count(*) FILTER (NOT lft) AS nr, avg(x) FILTER (lft) AS ml, avg(x) FILTER (NOT lft) AS mr, max(x) FILTER (lft) AS el, min(x) FILTER (NOT lft) AS er FROM p GROUP BY ALL)
        SELECT page, (el + er) / 2 AS boundary FROM t WHERE nl >= 3 AND nr >= 3 AND mr - ml > 0.2 * (hi - lo)
    """,
    "evidence_of_three": f"{_EVIDENCE} SELECT resume_id, source, skill, confidence, section, text, statement FROM ev",
    "best_examples": f"""{_EVIDENCE} SELECT resume_id, source, ev.skill, confidence, section FROM ev LEFT JOIN (SELECT resume_id, unnest(req) AS skill, 1 AS crit FROM q) AS k USING (resume_id, skill)
        QUALIFY row_number() OVER (PARTITION BY resume_id ORDER BY coalesce(crit, 0) DESC, confidence DESC, CASE source WHEN 'ce_pair' THEN 3 WHEN 'skill_inference' THEN 2 ELSE 1 END DESC, ev.skill, section) = 1""",
}
