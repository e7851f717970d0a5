"""Queries on scores: cohort positions, summaries, comparisons, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cohort as C
from ..sources import schemas as S
from .skills import RESUME


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered score once."""
    s = S.table(spark, sf_dir, "resume_scores")
    return s.groupBy("score_id").agg(*[F.first(c).alias(c) for c in s.columns if c not in ("score_id", "ingested_at")])


def _valid(df: DataFrame) -> DataFrame:
    return df.filter(F.col("final_pre_llm").isNotNull() & ~F.isnan("final_pre_llm"))


def cohort_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, percentile, gap from the top and whether above the median, of each score within its session."""
    out = C.positions(_scores(spark, sf_dir).select("score_id", "session_id", "final_pre_llm"), "session_id", "final_pre_llm")
    return out.select("score_id", "session_id", "mine", "rank", "percentile", "gap_from_top", "above_median")


def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session: how many, lowest, highest, mean and median score, mean coverage, how many have matching skills."""
    s = _valid(_scores(spark, sf_dir))
    told = (
        s.groupBy("session_id")
        .agg(F.count("*").alias("n"), F.min("final_pre_llm").alias("lowest"), F.max("final_pre_llm").alias("highest"), F.round(F.avg("final_pre_llm"), 12).alias("mean"), F.round(F.avg("coverage"), 12).alias("coverage"), F.count_if("has_match_skills").alias("n_match"))
    )
    middle = C.medians(s.filter("session_id IS NOT NULL"), "session_id", "final_pre_llm").select(F.col("session_id").alias("_s"), F.round("median", 9).alias("median"))
    return told.join(middle, F.col("session_id") == F.col("_s"), "left").drop("_s")


def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier, recommendation, display and composite score of each score."""
    s = _valid(_scores(spark, sf_dir))
    return s.select("score_id", C.tier(F.col("final_pre_llm")).alias("tier"), C.recommendation(F.col("final_pre_llm"), F.coalesce("coverage", F.lit(0.0))).alias("recommendation"), C.composite(F.col("semantic_score"), F.col("final_pre_llm"), F.col("coverage")).alias("composite"))


def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What semantic score, final score (for a pair scorer) and coverage add to each composite score, and its strength."""
    s = _valid(_scores(spark, sf_dir))
    return s.select("score_id", C.contributions(F.col("semantic_score"), F.col("final_pre_llm"), F.col("coverage")).alias("c")).select("score_id", "c.*")


def interpolated_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate of percentile and rank from median, top and size of the session."""
    s = _valid(_scores(spark, sf_dir)).select("score_id", "session_id", "final_pre_llm")
    stats = C.medians(s, "session_id", "final_pre_llm")
    e = C.interpolated(F.col("final_pre_llm"), F.col("median"), F.col("top"), F.col("n"))
    return s.join(stats, "session_id").select("score_id", e["percentile"].alias("percentile"), e["rank"].alias("rank"))


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores scaled to [0, 1] within their session; 0.5 where all are equal."""
    s = _valid(_scores(spark, sf_dir)).select("score_id", "session_id", "final_pre_llm")
    ends = s.groupBy("session_id").agg(F.min("final_pre_llm").alias("lo"), F.max("final_pre_llm").alias("hi"))
    scaled = F.when(F.col("hi") - F.col("lo") < 1e-9, F.lit(0.5)).otherwise((F.col("final_pre_llm") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return s.join(ends, "session_id").select("score_id", F.round(scaled, 6).alias("scaled"))


def _shortlist(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    best = Window.partitionBy("session_id").orderBy(F.col("final_pre_llm").desc(), "candidate_id", "score_id")
    return _valid(_scores(spark, sf_dir)).filter("session_id IS NOT NULL").withColumn("position", F.row_number().over(best)).filter(F.col("position") <= n)


def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each session, with the session's job and status if it is known."""
    sessions = S.table(spark, sf_dir, "ranking_sessions").select("session_id", "job_id", F.lower(F.trim("status")).alias("status"))
    return _shortlist(spark, sf_dir).join(sessions, "session_id", "left").select("session_id", "candidate_id", "position", "final_pre_llm", "job_id", "status")


def pairwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of each session's three best, with winner, margin and differences."""
    roles = S.resumes(spark, sf_dir, "experience").groupBy("candidate_id").agg(F.max(F.coalesce(F.size("experience"), F.lit(0))).alias("roles"))
    rows = _shortlist(spark, sf_dir).join(roles, "candidate_id", "left").withColumn("roles", F.coalesce("roles", F.lit(0)))
    return C.compared(rows, "session_id", "candidate_id", "position", "final_pre_llm", "matched_required_skills", "roles")


def export_flat_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat export of scores: fixed decimals, lists joined by |, missing skills by set difference."""
    want = S.table(spark, sf_dir, "jd_criteria").filter("job_id IS NOT NULL").select("job_id", F.explode("must_have_skills").alias("s")).filter("s IS NOT NULL").groupBy("job_id").agg(F.sort_array(F.collect_set("s")).alias("want"))
    jobs = S.table(spark, sf_dir, "ranking_sessions").select("session_id", "job_id")
    s = _valid(_scores(spark, sf_dir)).join(jobs, "session_id", "left").join(want, "job_id", "left")
    matched = F.coalesce("matched_required_skills", F.array().cast("array<string>"))
    return s.select("score_id", "candidate_id", F.format_string("%.6f", "final_pre_llm").alias("final"), F.format_string("%.6f", F.coalesce("coverage", F.lit(0.0))).alias("coverage"), F.concat_ws("|", matched).alias("matched"), F.concat_ws("|", F.array_except(F.coalesce("want", F.array().cast("array<string>")), matched)).alias("missing"))


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by status as written and unified, with those whose summary can't be parsed."""
    s = S.table(spark, sf_dir, "ranking_sessions")
    return s.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("summary_json").isNotNull() & F.try_parse_json("summary_json").isNull()).alias("n_bad"), F.sum("candidates_count").cast("long").alias("candidates"))


def task_ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events no older than an hour before the last one: what a task registry keeps."""
    e = S.table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 HOUR")).select("event_id", "user_id", "event_type")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON properties, summed by type; what can't be parsed counts as empty."""
    e = S.table(spark, sf_dir, "events").select("event_type", S.json_or_empty("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"), F.count_if(F.col("p.k").isNull()).alias("n_empty"))


QUERIES = {f.__name__: f for f in (cohort_position, cohort_summary, score_breakdown, score_contributions, interpolated_percentile, minmax_norm, shortlist, pairwise_compare, export_flat_csv, session_status, task_ttl_filter, event_props)}

_S = "s AS (SELECT DISTINCT score_id, session_id, candidate_id, semantic_score, coverage, has_match_skills, matched_required_skills, final_pre_llm FROM resume_scores), v AS (SELECT * FROM s WHERE final_pre_llm IS NOT NULL AND NOT isnan(final_pre_llm))"
_TOP = "t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY final_pre_llm DESC, candidate_id ASC NULLS FIRST, score_id)::INT AS position FROM v WHERE session_id IS NOT NULL QUALIFY position <= 3)"
SQL = {
    "cohort_position": f"""
        WITH {_S}, m AS (SELECT score_id, session_id, final_pre_llm, floor(1000 * final_pre_llm + 0.5) / 1000 AS mine FROM v WHERE session_id IS NOT NULL),
        st AS (SELECT session_id, count(*) AS n, max(final_pre_llm) AS top, quantile_cont(final_pre_llm, 0.5) AS median FROM m GROUP BY session_id),
        vals AS (SELECT session_id, final_pre_llm, count(*) AS c FROM m GROUP BY ALL), pts AS (SELECT DISTINCT session_id, mine FROM m),
        rk AS (SELECT p.session_id, p.mine, 1 + coalesce(sum(c), 0) AS rank FROM pts p LEFT JOIN vals x ON x.session_id = p.session_id AND x.final_pre_llm > p.mine + 0.0005 GROUP BY ALL)
        SELECT score_id, m.session_id, mine, rank::BIGINT AS rank, round(100.0::DOUBLE * (n - rank + 1)::DOUBLE / n, 6) AS percentile, round(CASE WHEN greatest(0.0, 100 * top - 100 * mine) < 1e-6 THEN 0.0 ELSE greatest(0.0, 100 * top - 100 * mine) END, 6) AS gap_from_top, 100 * mine > 100 * median AS above_median
        FROM m JOIN rk USING (session_id, mine) JOIN st ON st.session_id = m.session_id
    """,
    "cohort_summary": f"WITH {_S} SELECT session_id, count(*) AS n, min(final_pre_llm) AS lowest, max(final_pre_llm) AS highest, round(avg(final_pre_llm), 12) AS mean, round(quantile_cont(final_pre_llm, 0.5), 9) AS median, round(avg(coverage), 12) AS coverage, count(*) FILTER (has_match_skills) AS n_match FROM v GROUP BY session_id",
    "score_breakdown": f"""
        WITH {_S} SELECT score_id, CASE WHEN final_pre_llm >= 0.8 THEN 'excellent' WHEN final_pre_llm >= 0.6 THEN 'strong' WHEN final_pre_llm >= 0.4 THEN 'moderate' ELSE 'limited' END AS tier,
        CASE WHEN final_pre_llm >= 0.80 AND coalesce(coverage, 0) >= 0.70 THEN 'advance' WHEN final_pre_llm >= 0.55 AND coalesce(coverage, 0) >= 0.50 THEN 'consider' ELSE 'hold' END AS recommendation,
        round(0.5::DOUBLE * coalesce(semantic_score, 0) + 0.3::DOUBLE * final_pre_llm + 0.2::DOUBLE * coalesce(coverage, 0), 9) AS composite FROM v
    """,
    "score_contributions": f"""
        WITH {_S}, p AS (SELECT score_id, coalesce(semantic_score, 0) AS a, final_pre_llm AS b, coalesce(coverage, 0) AS c FROM v)
        SELECT score_id, round(0.5::DOUBLE * a, 9) AS semantic, round(0.3::DOUBLE * b, 9) AS pair, round(0.2::DOUBLE * c, 9) AS lexical,
        CASE WHEN round(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c, 9) >= 0.7 THEN 'strong' WHEN round(0.5::DOUBLE * a + 0.3::DOUBLE * b + 0.2::DOUBLE * c, 9) >= 0.4 THEN 'moderate' ELSE 'weak' END AS signal FROM p
    """,
    "interpolated_percentile": f"""
        WITH {_S}, st AS (SELECT session_id, count(*) AS n, max(final_pre_llm) AS top, quantile_cont(final_pre_llm, 0.5) AS median FROM v GROUP BY session_id),
        p AS (SELECT score_id, n, round(coalesce(CASE WHEN final_pre_llm >= top THEN 100.0 WHEN median = 0 THEN 50.0 WHEN final_pre_llm >= median THEN 50 + 50 * (final_pre_llm - median) / nullif(top - median, 0) ELSE 50 * final_pre_llm / median END, 50.0)::DOUBLE, 6) AS percentile FROM v JOIN st USING (session_id))
        SELECT score_id, percentile, (floor((100 - percentile) / 100 * n) + 1)::INT AS rank FROM p
    """,
    "minmax_norm": f"WITH {_S}, e AS (SELECT session_id, min(final_pre_llm) AS lo, max(final_pre_llm) AS hi FROM v GROUP BY session_id) SELECT score_id, round(CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (final_pre_llm - lo) / (hi - lo) END, 6) AS scaled FROM v JOIN e USING (session_id)",
    "shortlist": f"WITH {_S}, {_TOP} SELECT t.session_id, candidate_id, position, final_pre_llm, j.job_id, lower(trim(j.status, ' ')) AS status FROM t LEFT JOIN ranking_sessions j USING (session_id)",
    "pairwise_compare": f"""
        WITH {_S}, {_TOP}, {RESUME}, ro AS (SELECT candidate_id, max(coalesce(len(p.experience), 0)) AS roles FROM r GROUP BY candidate_id),
        x AS (SELECT t.session_id, t.candidate_id, position, final_pre_llm AS sc, coalesce(matched_required_skills, []) AS k, coalesce(roles, 0)::INT AS ro FROM t LEFT JOIN ro USING (candidate_id)),
        pr AS (SELECT a.session_id, a.candidate_id AS a, b.candidate_id AS b, a.sc AS sa, b.sc AS sb, round(abs(a.sc - b.sc) * 100, 2) AS margin, a.ro AS ra, b.ro AS rb,
            list_sort(list_distinct(list_filter(a.k, lambda z: NOT list_contains(b.k, z)))) AS oa, list_sort(list_distinct(list_filter(b.k, lambda z: NOT list_contains(a.k, z)))) AS ob FROM x a JOIN x b ON a.session_id = b.session_id AND a.position < b.position)
        SELECT session_id, a, b, CASE WHEN sa >= sb THEN a ELSE b END AS winner, margin, array_to_string(list_filter([
            CASE WHEN margin > 5 THEN format('score differs by {{:.2f}} points', margin) END, CASE WHEN len(oa) > 0 THEN 'first only: ' || array_to_string(oa[1:3], ', ') END,
            CASE WHEN len(ob) > 0 THEN 'second only: ' || array_to_string(ob[1:3], ', ') END, CASE WHEN abs(ra - rb) > 1 THEN 'roles: ' || ra || ' and ' || rb END], lambda z: z IS NOT NULL)[1:3], '; ') AS differences FROM pr
    """,
    "export_flat_csv": f"""
        WITH {_S}, w AS (SELECT job_id, list_sort(list_distinct(list(s))) AS want FROM (SELECT job_id, unnest(must_have_skills) AS s FROM jd_criteria WHERE job_id IS NOT NULL) WHERE s IS NOT NULL GROUP BY job_id)
        SELECT score_id, candidate_id, format('{{:.6f}}', final_pre_llm) AS final, format('{{:.6f}}', coalesce(coverage, 0.0)::DOUBLE) AS coverage, array_to_string(coalesce(matched_required_skills, []), '|') AS matched,
            array_to_string(list_filter(coalesce(want, []), lambda x: NOT list_contains(coalesce(matched_required_skills, []), x)), '|') AS missing
        FROM v LEFT JOIN ranking_sessions j USING (session_id) LEFT JOIN w ON w.job_id = j.job_id
    """,
    "session_status": "SELECT lower(trim(status, ' ')) AS status, count(*) AS n, count(*) FILTER (summary_json IS NOT NULL AND NOT json_valid(summary_json)) AS n_bad, sum(candidates_count)::BIGINT AS candidates FROM ranking_sessions GROUP BY 1",
    "task_ttl_filter": "SELECT event_id, user_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "event_props": "SELECT event_type, count(*) AS n, sum((CASE WHEN json_valid(props) THEN props END ->> '$.k')::BIGINT)::BIGINT AS k, count(*) FILTER ((CASE WHEN json_valid(props) THEN props END ->> '$.k') IS NULL) AS n_empty FROM events GROUP BY event_type",
}
