"""Queries on skills: taxonomy, extraction, normalization, coverage and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference as I
from ..operators import matching as M
from ..operators import normalizing as N
from ..sources import schemas as S


def taxonomy_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surface form with the skill it stands for."""
    return S.taxonomy(spark, sf_dir)


def skill_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of the taxonomy named in each document."""
    return M.extracted(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", S.taxonomy(spark, sf_dir))


def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed must-have skill by equal or contained form, with the confidence."""
    typed = S.table(spark, sf_dir, "jd_criteria").select("criteria_id", F.posexplode("must_have_skills").alias("pos", "value"))
    return M.normalized(typed, "value", S.taxonomy(spark, sf_dir)).select("criteria_id", "pos", "skill_id", "canonical", "confidence")


def skill_normalize_as_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed must-have skill cleaned up, then by equal, contained or similar form, with the confidence and the normal form."""
    typed = S.table(spark, sf_dir, "jd_criteria").select("criteria_id", F.posexplode("must_have_skills").alias("pos", "value"))
    return N.normalized_as_typed(typed, "value", S.taxonomy(spark, sf_dir)).drop("value")


def _candidate_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = S.resumes(spark, sf_dir, "skills").select("candidate_id", F.explode("skills.skill").alias("s")).select("candidate_id", F.lower(F.trim("s")).alias("s")).filter("s <> ''")
    return skills.groupBy("candidate_id").agg(F.sort_array(F.collect_set("s")).alias("have"))


def _job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = S.table(spark, sf_dir, "jd_criteria").filter("job_id IS NOT NULL").select("job_id", F.explode("must_have_skills").alias("s")).select("job_id", F.lower(F.trim("s")).alias("s")).filter("s <> ''")
    return typed.groupBy("job_id").agg(F.sort_array(F.collect_set("s")).alias("want"))


def skill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate scored for a job: the share of the job's skills they have, those matched and those missing."""
    jobs = S.table(spark, sf_dir, "ranking_sessions").filter("job_id IS NOT NULL").select("session_id", "job_id").distinct()
    scored = S.table(spark, sf_dir, "resume_scores").select("session_id", "candidate_id").join(jobs, "session_id").select("job_id", "candidate_id").distinct()
    both = scored.join(_job_skills(spark, sf_dir), "job_id").join(_candidate_skills(spark, sf_dir), "candidate_id", "left")
    have = F.coalesce("have", F.array().cast("array<string>"))
    return both.select("job_id", "candidate_id", M.coverage(have, F.col("want")).alias("coverage"), F.array_join(F.array_intersect("want", have), "|").alias("matched"), F.array_join(F.array_except("want", have), "|").alias("missing"))


def skills_wanted_not_had(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills some job wants and no candidate lists, with the number of jobs: an anti join."""
    want = _job_skills(spark, sf_dir).select("job_id", F.explode("want").alias("skill"))
    had = _candidate_skills(spark, sf_dir).select(F.explode("have").alias("skill")).distinct()
    return want.join(had, "skill", "left_anti").groupBy("skill").agg(F.count("*").alias("n_jobs"))


def skill_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Must-have, nice-to-have and their overlap made disjoint, must first."""
    lower = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
    sets = M.three_sets(lower(F.col("must_have_skills")), lower(F.col("nice_to_have_skills")), F.array().cast("array<string>"))
    return S.table(spark, sf_dir, "jd_criteria").select("criteria_id", sets.alias("s")).select("criteria_id", F.array_join("s.required", "|").alias("must"), F.array_join("s.nice", "|").alias("nice"), F.col("s.conflicts").alias("conflicts"))


RULES = I.rules()
WEIGHTS = [(section, weight, i) for i, (section, weight) in enumerate(I.SECTION_WEIGHTS.items())]


def skill_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills inferred from what resumes tell, by rules in buckets and weights of sections."""
    r = S.resumes(spark, sf_dir, "experience", "education", "projects", "skills", "misc")
    texts = {
        "skills": F.array_join("skills.skill", " "), "experience": F.array_join(F.flatten("experience.bullets"), " "), "projects": F.array_join(F.transform("projects", lambda p: F.concat_ws(" ", p["name"], p["summary"])), " "),
        "education": F.array_join(F.transform("education", lambda e: F.concat_ws(" ", e["degree"], e["school"])), " "), "misc": F.col("misc"),
    }
    sections = r.select("resume_id", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(w).alias("weight"), F.lit(o).alias("ord"), F.lower(texts[s]).alias("text")) for s, w, o in WEIGHTS])).alias("x")).select("resume_id", "x.*").filter("text <> ''")
    return I.inferred(sections, "resume_id", RULES)


QUERIES = {f.__name__: f for f in (taxonomy_forms, skill_extract, skill_normalize, skill_normalize_as_typed, skill_gaps, skills_wanted_not_had, skill_sets, skill_inference)}

_FORMS = "f AS (SELECT surface, max(skill_id) AS skill_id, arg_max(canonical, skill_id) AS canonical FROM (SELECT skill_id, canonical, unnest(list_distinct(list_transform(list_prepend(canonical, coalesce(variants, [])), lambda x: lower(x)))) AS surface FROM skill_taxonomy) GROUP BY surface)"
_W = "list_filter(list_transform(string_split_regex(lower({c}), '[^a-z0-9+#.-]+'), lambda w: regexp_replace(w, '^[.-]+|[.-]+$', '', 'g')), lambda w: w <> '')"
#: Resumes parsed as in the sources: one struct p, null where the text isn't JSON as a whole.
RESUME = """r AS (SELECT resume_id, candidate_id, json_transform(CASE WHEN json_valid(parsed_data_json) THEN parsed_data_json END,
    '{"experience":[{"title":"VARCHAR","company":"VARCHAR","dates":"VARCHAR","description":"VARCHAR","bullets":["VARCHAR"]}],"education":[{"degree":"VARCHAR","school":"VARCHAR","year":"VARCHAR"}],"projects":[{"name":"VARCHAR","summary":"VARCHAR","technologies":["VARCHAR"]}],"skills":[{"skill":"VARCHAR"}],"misc":"VARCHAR","raw_text":"VARCHAR"}') AS p FROM resumes)"""
_HAVE = f"{RESUME}, h AS (SELECT candidate_id, list_sort(list_distinct(list(s))) AS have FROM (SELECT candidate_id, lower(trim(unnest(list_transform(p.skills, lambda x: x.skill)), ' ')) AS s FROM r) WHERE s <> '' GROUP BY candidate_id)"
_WANT = "w AS (SELECT job_id, list_sort(list_distinct(list(s))) AS want FROM (SELECT job_id, lower(trim(unnest(must_have_skills), ' ')) AS s FROM jd_criteria WHERE job_id IS NOT NULL) WHERE s <> '' GROUP BY job_id)"
_CLEAN = "trim(regexp_replace(lower(value), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_L = "list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> ''))"
_ORDERED = "list_filter({x}, lambda a, i: list_position({x}, a) = i)"
_RULES = ", ".join(f"('{a}', '{b}', {c}, '{d}')" for a, b, c, d in RULES)
SQL = {
    "taxonomy_forms": f"WITH {_FORMS} SELECT surface, skill_id, canonical FROM f",
    "skill_extract": f"""
        WITH {_FORMS}, g AS (SELECT array_to_string({_W.format(c="surface")}, ' ') AS gram, skill_id, canonical FROM f),
        d AS (SELECT doc_id, {_W.format(c="text")} AS ws FROM documents WHERE text IS NOT NULL),
        e AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM d, unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(1, 1 + (SELECT max(len(string_split(gram, ' '))) FROM g))) AS b(n) WHERE i + n - 1 <= len(ws))
        SELECT DISTINCT doc_id, skill_id, canonical FROM e JOIN g USING (gram)
    """,
    "skill_normalize": f"""
        WITH {_FORMS}, v AS (SELECT criteria_id, (unnest(range(1, len(must_have_skills) + 1)) - 1)::INT AS pos, unnest(must_have_skills) AS value FROM jd_criteria),
        c AS (SELECT criteria_id, pos, {_CLEAN} AS v FROM v), x AS (SELECT DISTINCT v FROM c WHERE v <> ''),
        ex AS (SELECT v, skill_id, canonical, 1.0 AS confidence FROM x JOIN f ON v = surface),
        pa AS (SELECT DISTINCT v, array_to_string(ws[i : j], ' ') AS surface FROM (SELECT v, string_split(v, ' ') AS ws FROM x WHERE v NOT IN (SELECT v FROM ex)), unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(1, len(ws) + 1)) AS b(j) WHERE j >= i),
        co AS (SELECT v, skill_id, canonical, 0.8 AS confidence FROM pa JOIN f USING (surface) WHERE length(surface) >= 3 AND length(surface) * 2 >= length(v) QUALIFY row_number() OVER (PARTITION BY v ORDER BY length(surface) DESC, skill_id) = 1),
        m AS (SELECT * FROM ex UNION ALL SELECT * FROM co)
        SELECT criteria_id, pos, skill_id, canonical, coalesce(confidence, 0.0)::DOUBLE AS confidence FROM c LEFT JOIN m USING (v)
    """,
    "skill_gaps": f"""
        WITH {_HAVE}, {_WANT}, j AS (SELECT DISTINCT s.job_id, c.candidate_id FROM resume_scores c JOIN ranking_sessions s USING (session_id) WHERE s.job_id IS NOT NULL),
        b AS (SELECT j.job_id, j.candidate_id, want, coalesce(have, []) AS have FROM j JOIN w USING (job_id) LEFT JOIN h USING (candidate_id))
        SELECT job_id, candidate_id, round(len(list_filter(want, lambda x: list_contains(have, x))) / len(want), 6) AS coverage, array_to_string(list_filter(want, lambda x: list_contains(have, x)), '|') AS matched, array_to_string(list_filter(want, lambda x: NOT list_contains(have, x)), '|') AS missing FROM b
    """,
    "skills_wanted_not_had": f"WITH {_HAVE}, {_WANT} SELECT skill, count(*) AS n_jobs FROM (SELECT job_id, unnest(want) AS skill FROM w) WHERE skill NOT IN (SELECT unnest(have) FROM h) GROUP BY skill",
    "skill_sets": f"""
        WITH s AS (SELECT criteria_id, list_filter(list_transform(coalesce(must_have_skills, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '') AS a, list_filter(list_transform(coalesce(nice_to_have_skills, []), lambda x: lower(trim(x, ' '))), lambda x: x IS NOT NULL AND x <> '') AS b FROM jd_criteria),
        d AS (SELECT criteria_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS m, list_filter(b, lambda x, i: list_position(b, x) = i) AS n FROM s)
        SELECT criteria_id, array_to_string(m, '|') AS must, array_to_string(list_filter(n, lambda x: NOT list_contains(m, x)), '|') AS nice, len(list_filter(m, lambda x: list_contains(n, x)))::INT AS conflicts FROM d
    """,
    "skill_inference": f"""
        WITH {RESUME}, s AS (
            SELECT resume_id, 'skills' AS section, 1.0 AS weight, 0 AS ord, lower(array_to_string(list_transform(p.skills, lambda x: x.skill), ' ')) AS text FROM r
            UNION ALL SELECT resume_id, 'experience', 1.0, 1, lower(array_to_string(flatten(list_transform(p.experience, lambda x: x.bullets)), ' ')) FROM r
            UNION ALL SELECT resume_id, 'projects', 0.95, 2, lower(array_to_string(list_transform(p.projects, lambda x: concat_ws(' ', x.name, x.summary)), ' ')) FROM r
            UNION ALL SELECT resume_id, 'education', 0.75, 3, lower(array_to_string(list_transform(p.education, lambda x: concat_ws(' ', x.degree, x.school)), ' ')) FROM r
            UNION ALL SELECT resume_id, 'misc', 0.6, 4, lower(p.misc) FROM r),
        rules AS (SELECT * FROM (VALUES {_RULES}) AS v(skill, bucket, confidence, pattern)),
        h AS (SELECT resume_id, skill, section, weight, ord, max(confidence) FILTER (bucket <> 'neg') AS conf, arg_max(bucket, confidence) FILTER (bucket <> 'neg') AS bucket, bool_or(bucket = 'neg') AS neg FROM s JOIN rules ON regexp_matches(text, pattern) WHERE text <> '' GROUP BY ALL)
        SELECT resume_id, skill, section, bucket, round(least(1.0, conf * weight), 6)::DOUBLE AS score FROM h WHERE NOT neg AND conf IS NOT NULL QUALIFY row_number() OVER (PARTITION BY resume_id, skill ORDER BY round(least(1.0, conf * weight), 6) DESC, ord) = 1
    """,
}
