"""Queries on careers and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources import schemas as S
from .texts import sql_lines
from .skills import RESUME


def _text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each resume."""
    r = S.resumes(spark, sf_dir, "experience", "education")
    told = _text(F.array_join("experience.title", " "), F.array_join("experience.company", " "), F.array_join(F.flatten("experience.bullets"), " "), F.array_join("education.degree", " "))
    n = F.coalesce(F.size("experience"), F.lit(0))
    return P.seniority(r.select("resume_id", n.alias("n_roles"), told.alias("told")), "told", "n_roles").select("resume_id", "n_roles", "level")


def career_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises from one role to the next."""
    return P.progression(S.roles(spark, sf_dir), "resume_id")


def specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each resume specializes in."""
    r = S.resumes(spark, sf_dir, "experience", "projects", "skills")
    told = _text(F.array_join("experience.title", " "), F.array_join(F.flatten("experience.bullets"), " "), F.array_join("projects.summary", " "), F.array_join("skills.skill", " "))
    return P.specialization(r.select("resume_id", told.alias("told")), "told").drop("told")


def leadership_team_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leadership told of in roles."""
    return P.leadership(S.roles(spark, sf_dir), "resume_id")


def rare_qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare qualifications named in experience, education and projects."""
    r = S.resumes(spark, sf_dir, "experience", "education", "projects")
    told = _text(F.array_join("experience.title", " "), F.array_join(F.flatten("experience.bullets"), " "), F.array_join("education.degree", " "), F.array_join("projects.summary", " "))
    return r.select("resume_id", F.array_join(P.rare_qualifications(told), "|").alias("found"))


def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct technologies of each resume's projects, in the order of first mention."""
    return S.resumes(spark, sf_dir, "projects").select("resume_id", F.array_join(F.array_distinct(F.flatten(F.coalesce("projects.technologies", F.array().cast("array<array<string>>")))), "|").alias("technologies"))


def evidence_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each required skill of each resume, its best three pieces of evidence from bullets, projects and the skill list, by confidence, then source."""
    r = S.resumes(spark, sf_dir, "experience", "projects", "skills")
    skills = r.select("resume_id", F.explode(F.array_distinct(F.filter(F.transform("skills.skill", lambda x: F.lower(F.trim(x))), lambda x: x != ""))).alias("skill"))
    bullets = r.select("resume_id", F.explode(F.flatten("experience.bullets")).alias("text")).select("resume_id", F.lit("bullet").alias("source"), F.lit(0.8).alias("confidence"), F.lit(2).alias("priority"), "text")
    projects = r.select("resume_id", F.explode("projects").alias("p")).select("resume_id", F.lit("project").alias("source"), F.lit(0.8).alias("confidence"), F.lit(1).alias("priority"), F.concat_ws(" ", "p.summary", F.array_join("p.technologies", ", ")).alias("text"))
    listed = skills.select("resume_id", F.lit("list").alias("source"), F.lit(0.6).alias("confidence"), F.lit(0).alias("priority"), F.col("skill").alias("text"))
    texts = bullets.unionByName(projects).unionByName(listed).filter("text <> ''")
    pairs = skills.join(texts, "resume_id").filter(F.contains(F.lower("text"), F.col("skill")) & (F.col("confidence") >= 0.6))
    best = Window.partitionBy("resume_id", "skill").orderBy(F.col("confidence").desc(), F.col("priority").desc(), "text")
    return pairs.distinct().withColumn("pos", F.row_number().over(best)).filter("pos <= 3").select("resume_id", "skill", "source", "confidence", "text", "pos")


def evidence_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much there is to go by: points for experience, skills, projects, education and a parsable text, with a level."""
    has = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, 1).otherwise(0)
    r = S.resumes(spark, sf_dir, "experience", "skills", "projects", "education", "raw_text")
    points = has("experience") + has("skills") + has("projects") + has("education") + F.when(F.length("raw_text") > 0, 1).otherwise(0)
    return r.select("resume_id", points.alias("points"), F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low").alias("level"))


def section_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each resume: the share of each section in the characters of all, one decimal, and which are missing."""
    r = S.resumes(spark, sf_dir, "experience", "education", "projects", "skills", "misc")
    n = {
        "experience": F.length(F.array_join(F.flatten("experience.bullets"), " ")), "education": F.length(F.array_join("education.degree", " ")), "projects": F.length(F.array_join("projects.summary", " ")),
        "skills": F.length(F.array_join("skills.skill", " ")), "misc": F.length("misc"),
    }
    n = {k: F.coalesce(v, F.lit(0)) for k, v in n.items()}
    total = sum(n.values(), F.lit(0))
    return r.select("resume_id", *[F.floor(v * 1000.0 / F.greatest(total, F.lit(1)) + 0.5).alias(k) for k, v in n.items()])


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw text of each resume cut into sections at its headers: a running count of headers, then lines gathered in order."""
    lines = S.resumes(spark, sf_dir, "raw_text").select("resume_id", F.posexplode(F.split("raw_text", "\n")).alias("pos", "line")).select("resume_id", "pos", F.trim("line").alias("line")).filter("line <> ''")
    header = F.upper(F.regexp_replace("line", ":$", "")).isin("EXPERIENCE", "EDUCATION", "SKILLS", "SUMMARY", "PROJECTS")
    w = Window.partitionBy("resume_id").orderBy("pos")
    marked = lines.withColumn("header", header).withColumn("section", F.sum(F.col("header").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("resume_id", F.col("section").cast("int").alias("section")).agg(
        F.max(F.when(F.col("header"), F.lower(F.regexp_replace("line", ":$", "")))).alias("header"), F.count_if(~F.col("header")).alias("n_lines"), F.sum(F.when(~F.col("header"), F.length("line")).otherwise(0)).cast("long").alias("n_chars")
    )


def grouped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each document: a bullet or number starts one, other lines go on with it."""
    from ..functions import text as T

    lines = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    starts = F.col("line").rlike(r"^(?:[•●*-]|[0-9]{1,3}[.)])[ \t]") | (F.col("pos") == 0)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    items = lines.withColumn("item", F.sum(starts.cast("int")).over(w).cast("int"))
    return items.groupBy("doc_id", "item").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.min("pos").alias("first_pos"))


def value_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, upper median, ends and population deviation of a number by group: what fonts on a page are judged by."""
    li = S.table(spark, sf_dir, "lineitem")
    upper = F.element_at(F.sort_array(F.collect_list("l_quantity")), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), upper.alias("upper_median"), F.max("l_quantity").alias("highest"), F.min("l_quantity").alias("lowest"), F.round(F.stddev_pop("l_quantity"), 6).alias("deviation"))


def column_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbouring distinct values of a group that exceed twice its mean gap, with their midpoints: columns on a page."""
    values = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), F.floor("l_extendedprice").alias("x")).distinct()
    gaps = values.withColumn("next", F.lead("x").over(Window.partitionBy("page").orderBy("x"))).filter("next IS NOT NULL").withColumn("gap", F.col("next") - F.col("x"))
    mean = gaps.groupBy("page").agg(F.avg("gap").alias("mean"))
    return gaps.join(mean, "page").filter("gap > 2 * mean").select("page", ((F.col("x") + F.col("next")) / 2).alias("boundary"), "gap")


def profile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each resume its level, trend of titles, technical depth and stage of career."""
    r = S.resumes(spark, sf_dir, "projects", "experience")
    depth = P.technical_depth(F.col("projects"), F.flatten("experience.bullets"))
    level = seniority(spark, sf_dir).select("resume_id", "level")
    trend = P.progression(S.roles(spark, sf_dir), "resume_id").select("resume_id", "trend")
    out = r.select("resume_id", depth.alias("technical_depth")).join(level, "resume_id").join(trend, "resume_id", "left").withColumn("trend", F.coalesce("trend", F.lit("stable")))
    return out.withColumn("career_stage", P.career_stage(F.col("level"), F.col("trend")))


QUERIES = {f.__name__: f for f in (seniority, career_progression, specialization, leadership_team_size, rare_qualifications, profile_context, technologies, evidence_ranked, evidence_quality, section_share, sections, grouped_items, value_statistics, column_boundaries)}


def _hits(text: str, words) -> str:
    single, other = P.plain(words)
    parts = f"string_split_regex(lower({text}), '[^a-z0-9_]+')"
    out = f"len(list_filter({parts}, lambda w: w IN ({', '.join(map(repr, single))})))"
    # signs between words doubled, so that each match has its own
    doubled = f"regexp_replace(lower({text}), '([^a-z0-9_+./-])', '\\1\\1', 'g')"
    return out + (f" + len(regexp_extract_all({doubled}, '(?:^|[^a-z0-9_])(?:{'|'.join(w.replace(' ', '  ') for w in other)})(?:$|[^a-z0-9_])'))" if other else "")


def _first(names: list[str]) -> str:
    top = f"greatest({', '.join(names)})"
    return f"CASE WHEN {top} > 0 THEN CASE {' '.join(f'WHEN {n} = {top} THEN {n[2:]!r}' for n in names)} END END"


_EXP = "list_transform(p.experience, lambda x: x.{f})"
_BUL = "flatten(list_transform(p.experience, lambda x: x.bullets))"
_LV = ", ".join(f"{_hits('t', v)} AS c_{k}" for k, v in P.LEVELS.items())
_SP = ", ".join(f"{_hits('t', v)} AS c_{k}" for k, v in P.SPECIALIZATIONS.items())
_SPN = [f"c_{k}" for k in P.SPECIALIZATIONS]
_LEVEL = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '{P.pattern(w)}') THEN {i}" for i, w in enumerate(P.LEVELS.values())) + " END"
_ROLES = f"{RESUME}, ro AS (SELECT resume_id, (unnest(range(1, len(p.experience) + 1)) - 1)::INT AS pos, unnest(p.experience) AS e FROM r), e AS (SELECT resume_id, pos, e.title AS title, e.bullets AS bullets FROM ro)"
_RAREW = ", ".join(f"'{w}'" for w in P.RARE)
SQL = {
    "seniority": f"""
        WITH {RESUME}, t AS (SELECT resume_id, coalesce(len(p.experience), 0)::INT AS n, concat_ws(' ', array_to_string({_EXP.format(f="title")}, ' '), array_to_string({_EXP.format(f="company")}, ' '), array_to_string({_BUL}, ' '), array_to_string(list_transform(p.education, lambda x: x.degree), ' ')) AS t FROM r),
        c AS (SELECT resume_id, n, {_LV} FROM t),
        b AS (SELECT resume_id, n, coalesce({_first([f"c_{k}" for k in P.LEVELS])}, CASE WHEN n = 0 THEN 'intern' WHEN n <= 2 THEN 'junior' WHEN n <= 4 THEN 'mid' ELSE 'senior' END) AS b FROM c)
        SELECT resume_id, n AS n_roles, CASE WHEN b = 'intern' AND n > 1 THEN 'junior' WHEN b = 'junior' AND n > 3 THEN 'mid' WHEN b = 'mid' AND n > 5 THEN 'senior' ELSE b END AS level FROM b
    """,
    "career_progression": f"""
        WITH {_ROLES}, l AS (SELECT resume_id, pos, {_LEVEL} AS lv FROM e), s AS (SELECT *, lead(lv) OVER (PARTITION BY resume_id ORDER BY pos) AS nx FROM l),
        g AS (SELECT resume_id, count(*) AS n_roles, count(*) FILTER (nx > lv) AS promotions FROM s GROUP BY resume_id)
        SELECT *, CASE WHEN promotions >= 2 THEN 'ascending' WHEN promotions = 1 THEN 'moderate' ELSE 'stable' END AS trend, round(promotions / (2 * n_roles), 6) AS velocity FROM g
    """,
    "specialization": f"""
        WITH {RESUME}, t AS (SELECT resume_id, concat_ws(' ', array_to_string({_EXP.format(f="title")}, ' '), array_to_string({_BUL}, ' '), array_to_string(list_transform(p.projects, lambda x: x.summary), ' '), array_to_string(list_transform(p.skills, lambda x: x.skill), ' ')) AS t FROM r),
        c AS (SELECT resume_id, {_SP} FROM t),
        m AS (SELECT *, greatest({", ".join(_SPN)}) AS top, {" + ".join(_SPN)} AS total, {" + ".join(f"({n} > 0)::INT" for n in _SPN)} AS signals FROM c),
        k AS (SELECT *, least(top / 5.0, 1.0)::DOUBLE AS cf FROM m)
        SELECT resume_id, CASE WHEN cf >= 0.5 AND signals >= 2 THEN {_first(_SPN)} END AS "primary", CASE WHEN NOT (cf >= 0.5 AND signals >= 2) THEN 'unknown' WHEN top / total > 0.6 THEN 'specialist' ELSE 'generalist' END AS kind, CASE WHEN cf >= 0.5 AND signals >= 2 THEN cf ELSE 0.0 END AS confidence, signals FROM k
    """,
    "leadership_team_size": f"""
        WITH {_ROLES}, l AS (SELECT resume_id, unnest(list_prepend(title, coalesce(bullets, []))) AS line FROM e),
        g AS (SELECT resume_id, count(*) FILTER (regexp_matches(lower(line), '{P.pattern(P.LEADERSHIP)}')) AS n_indicators, round(coalesce(avg(try_cast(regexp_extract(lower(line), 'team of ([0-9]{{1,9}})', 1) AS INT)), 0.0), 6) AS mean_team, count(try_cast(regexp_extract(lower(line), 'team of ([0-9]{{1,9}})', 1) AS INT)) > 0 AS manages FROM l WHERE line IS NOT NULL GROUP BY resume_id)
        SELECT *, CASE WHEN n_indicators = 0 THEN 'none' WHEN n_indicators >= 3 THEN 'extensive' ELSE 'some' END AS level FROM g
    """,
    "rare_qualifications": f"""
        WITH {RESUME}, t AS (SELECT resume_id, concat_ws(' ', array_to_string({_EXP.format(f="title")}, ' '), array_to_string({_BUL}, ' '), array_to_string(list_transform(p.education, lambda x: x.degree), ' '), array_to_string(list_transform(p.projects, lambda x: x.summary), ' ')) AS t FROM r)
        SELECT resume_id, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(t), '[^a-z0-9_]+'), lambda w: w IN ({_RAREW})))), '|') AS found FROM t
    """,
    "technologies": f"WITH {RESUME}, t AS (SELECT resume_id, flatten(coalesce(list_transform(p.projects, lambda x: x.technologies), [])) AS ts FROM r) SELECT resume_id, array_to_string(list_filter(ts, lambda a, i: list_position(ts, a) = i), '|') AS technologies FROM t",
    "evidence_ranked": f"""
        WITH {RESUME}, s AS (SELECT DISTINCT resume_id, lower(trim(unnest(list_transform(p.skills, lambda x: x.skill)), ' ')) AS skill FROM r),
        t AS (SELECT resume_id, 'bullet' AS source, 0.8 AS confidence, 2 AS priority, unnest({_BUL}) AS text FROM r
            UNION ALL SELECT resume_id, 'project', 0.8, 1, concat_ws(' ', x.summary, array_to_string(x.technologies, ', ')) FROM (SELECT resume_id, unnest(p.projects) AS x FROM r)
            UNION ALL SELECT resume_id, 'list', 0.6, 0, skill FROM s WHERE skill <> ''),
        j AS (SELECT DISTINCT resume_id, skill, source, confidence, priority, text FROM s JOIN t USING (resume_id) WHERE skill <> '' AND text <> '' AND contains(lower(text), skill))
        SELECT resume_id, skill, source, confidence::DOUBLE AS confidence, text, row_number() OVER (PARTITION BY resume_id, skill ORDER BY confidence DESC, priority DESC, text)::INT AS pos FROM j QUALIFY pos <= 3
    """,
    "evidence_quality": f"""
        WITH {RESUME}, q AS (SELECT resume_id, (coalesce(len(p.experience), 0) > 0)::INT + (coalesce(len(p.skills), 0) > 0)::INT + (coalesce(len(p.projects), 0) > 0)::INT + (coalesce(len(p.education), 0) > 0)::INT + (coalesce(length(p.raw_text), 0) > 0)::INT AS points FROM r)
        SELECT resume_id, points, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS level FROM q
    """,
    "section_share": f"""
        WITH {RESUME}, n AS (SELECT resume_id, coalesce(length(array_to_string({_BUL}, ' ')), 0) AS experience, coalesce(length(array_to_string(list_transform(p.education, lambda x: x.degree), ' ')), 0) AS education, coalesce(length(array_to_string(list_transform(p.projects, lambda x: x.summary), ' ')), 0) AS projects,
            coalesce(length(array_to_string(list_transform(p.skills, lambda x: x.skill), ' ')), 0) AS skills, coalesce(length(p.misc), 0) AS misc FROM r), t AS (SELECT *, greatest(experience + education + projects + skills + misc, 1) AS total FROM n)
        SELECT resume_id, {", ".join(f"floor({c} * 1000.0::DOUBLE / total + 0.5)::BIGINT AS {c}" for c in ("experience", "education", "projects", "skills", "misc"))} FROM t
    """,
    "sections": f"""
        WITH {RESUME}, l AS (SELECT resume_id, unnest(range(1, len(ls) + 1)) AS pos, trim(unnest(ls), ' ') AS line FROM (SELECT resume_id, string_split(p.raw_text, chr(10)) AS ls FROM r)),
        h AS (SELECT *, upper(regexp_replace(line, ':$', '')) IN ('EXPERIENCE', 'EDUCATION', 'SKILLS', 'SUMMARY', 'PROJECTS') AS header FROM l WHERE line <> ''),
        s AS (SELECT *, sum(header::INT) OVER (PARTITION BY resume_id ORDER BY pos)::INT AS section FROM h)
        SELECT resume_id, section, max(CASE WHEN header THEN lower(regexp_replace(line, ':$', '')) END) AS header, count(*) FILTER (NOT header) AS n_lines, sum(CASE WHEN header THEN 0 ELSE length(line) END)::BIGINT AS n_chars FROM s GROUP BY resume_id, section
    """,
    "grouped_items": f"""
        WITH l AS (SELECT doc_id, {sql_lines("text")} AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS line FROM l),
        i AS (SELECT *, sum((regexp_matches(line, '^(?:[•●*-]|[0-9]{{1,3}}[.)])[ \\t]') OR pos = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS item FROM e)
        SELECT doc_id, item, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, min(pos) AS first_pos FROM i GROUP BY doc_id, item
    """,
    "value_statistics": "SELECT l_orderkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, list_sort(list(l_quantity))[(count(*) // 2 + 1)] AS upper_median, max(l_quantity) AS highest, min(l_quantity) AS lowest, round(stddev_pop(l_quantity), 6) AS deviation FROM lineitem GROUP BY l_orderkey",
    "column_boundaries": """
        WITH v AS (SELECT DISTINCT l_suppkey AS page, floor(l_extendedprice)::BIGINT AS x FROM lineitem), g AS (SELECT *, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM v), k AS (SELECT page, x, nx, nx - x AS gap FROM g WHERE nx IS NOT NULL)
        SELECT page, (x + nx) / 2 AS boundary, gap FROM k QUALIFY gap > 2 * avg(gap) OVER (PARTITION BY page)
    """,
}
SQL["profile_context"] = f"""
    WITH {RESUME}, s AS ({SQL["seniority"]}), c AS ({SQL["career_progression"]}),
    d AS (SELECT resume_id, coalesce(list_sum(list_transform(p.projects, lambda x: (coalesce(len(x.technologies), 0) >= 3)::INT + coalesce(regexp_matches(lower(x.summary), '{"|".join(P.DEPTH_OF_PROJECTS)}'), false)::INT)), 0)
        + coalesce(len(list_filter({_BUL}, lambda b: regexp_matches(lower(b), '{"|".join(P.DEPTH_OF_ROLES)}'))), 0) AS n FROM r),
    a AS (SELECT resume_id, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'moderate' ELSE 'basic' END AS technical_depth, level, coalesce(trend, 'stable') AS trend FROM d JOIN s USING (resume_id) LEFT JOIN c USING (resume_id))
    SELECT *, CASE WHEN level IN ('intern', 'junior') THEN 'early' WHEN level = 'mid' AND trend = 'ascending' THEN 'growing' WHEN level IN ('senior', 'lead', 'staff') THEN 'established' ELSE 'mid' END AS career_stage FROM a
"""
