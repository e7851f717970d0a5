"""Queries of requirement parsing: fields of postings, lists of forms, tokens and prose, summaries and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import criteria as C
from ..sources import schemas as S
from .skills import _FORMS
from .texts import sql_trim


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "job_postings").select("job_id", "description")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "jd_criteria").select("criteria_id", F.posexplode("must_have_skills").alias("pos", "value"))


def posting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven fields of each posting."""
    return _postings(spark, sf_dir).select("job_id", *[c.alias(k) for k, c in C.posting_fields(F.col("description")).items()]).na.fill("")


def form_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list fields of each posted form, at commas if there are any, else at line ends; and the number in its title."""
    raw = S.table(spark, sf_dir, "jd_criteria_raw")
    return raw.select("post_id", *[F.array_join(C.list_of(F.col(c), c == "keywords"), "|").alias(c) for c in ("must_have_skills", "industry_experience", "keywords")], C.safe_int(F.col("position_title")).alias("number"))


def token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each typed skill whether it is a sentence, prose to extract from, a clean token."""
    v = F.col("value")
    return _typed(spark, sf_dir).select("criteria_id", "pos", C.is_sentence(v).alias("is_sentence"), C.is_prose(v).alias("is_prose"), C.is_clean_token(v).alias("is_clean"))


def criteria_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each criteria the number of skills, and how many are sentences, prose and clean tokens."""
    c = S.table(spark, sf_dir, "jd_criteria").select("criteria_id", F.coalesce(F.size("must_have_skills"), F.lit(0)).alias("must"), F.coalesce(F.size("nice_to_have_skills"), F.lit(0)).alias("nice"), F.coalesce(F.length("jd_summary"), F.lit(0)).alias("summary_length"))
    kinds = token_kinds(spark, sf_dir).groupBy("criteria_id").agg(*[F.count_if(k).alias(k) for k in ("is_sentence", "is_prose", "is_clean")])
    return c.join(kinds, "criteria_id", "left").na.fill(0)


def criteria_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each criteria form asks in sentences, with its digest."""
    c = S.table(spark, sf_dir, "jd_criteria")
    lists = (F.col("must_have_skills"), F.col("nice_to_have_skills"))
    drop = lambda x: F.filter(x, lambda v: v.isNotNull())
    return c.select("criteria_id", C.summary(F.col("position_title"), F.col("seniority_level"), F.col("experience_min_years"), F.col("location"), *lists).alias("summary"), C.digest(drop(lists[0]), drop(lists[1]), F.col("experience_min_years")).alias("jd_hash"))


def criteria_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both skill lists of each criteria in canonical form; what is a must is no wish."""
    c = S.table(spark, sf_dir, "jd_criteria").select("criteria_id", "must_have_skills", "nice_to_have_skills")
    return C.hygiene(c, "criteria_id", "must_have_skills", "nice_to_have_skills", S.taxonomy(spark, sf_dir)).select("criteria_id", F.array_join("must", "|").alias("must"), F.array_join("nice", "|").alias("nice"))


def criteria_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills of each typed value: named in a sentence, listed, as typed, or none."""
    return C.clean_skills(_typed(spark, sf_dir), "criteria_id", "value", S.taxonomy(spark, sf_dir))


def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten fixed skills of which a form stands anywhere in a posting."""
    return _postings(spark, sf_dir).select("job_id", F.explode(C.top_skills(F.col("description"))).alias("s")).select("job_id", "s.skill_id", "s.label")


_QUERIES = (posting_fields, form_lists, token_kinds, criteria_stats, criteria_summary, criteria_hygiene, criteria_skills, top_skills)
QUERIES = {f.__name__: f for f in _QUERIES}


def _collapsed(c: str) -> str:
    return sql_trim(f"regexp_replace({c}, '[{T.WS}]+', ' ', 'g')")


def _section(name: str) -> str:
    tries = [_collapsed(f"regexp_replace({sql_trim(rf'''regexp_extract(low, '({start}[\s\S]*?)(?:{stop}|\z)', 1)''')}, '{C.LABEL}', '')") for start, stop in C.SECTIONS[name]]
    return f"coalesce({', '.join(f'CASE WHEN length({t}) > 10 THEN {t} END' for t in tries)}, '')"


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '[^{T.W}{T.WS}-]', '', 'g')"


_TITLES = [_bare(sql_trim(rf"regexp_extract(low, '{label}[:{T.WS}]+([^\n]+)', 1)")) for label in C.TITLES]
_FIRST = sql_trim("string_split(low, chr(10))[1]")
_WORDS = f"len(list_filter(string_split_regex({{c}}, '[{T.WS}]+'), lambda w: w <> ''))"


def _kind(c: str, what: str) -> str:
    words, ends, low = _WORDS.replace("{c}", c), f"regexp_matches({sql_trim(c)}, '[.!?]$')", f"lower({c})"
    if what == "sentence":
        return f"coalesce(length({c}) >= 20 AND (regexp_matches({low}, '{C.TELLS_SENTENCE}') OR ({words} > 6 AND {ends})), false)"
    if what == "prose":
        return f"coalesce({words} > 4 AND (regexp_matches({low}, '{C.TELLS_PROSE}') OR ({words} > 6 AND {ends})), false)"
    bad = f"contains({c}, '.') OR contains({c}, '  ') OR length({c}) - length(replace({c}, ' ', '')) > 2 OR regexp_matches({low}, '{C.NO_TOKEN}')"
    return f"coalesce({c} <> '' AND length({c}) <= 50 AND NOT ({bad}) AND ({low} IN ({', '.join(map(repr, C.KNOWN_TOKENS))}) OR ({words} <= 2 AND NOT regexp_matches({c}, '[.!?,;:]'))), false)"


def _list(c: str, newlines: bool = False) -> str:
    a, b = ("chr(10)", "','") if newlines else ("','", "chr(10)")
    parts = f"CASE WHEN contains({c}, {a}) THEN string_split({c}, {a}) WHEN contains({c}, {b}) THEN string_split({c}, {b}) ELSE [{c}] END"
    return f"array_to_string(list_filter(list_transform({parts}, lambda x: {sql_trim('x')}), lambda x: x IS NOT NULL AND x <> ''), '|')"


_V = "v AS (SELECT criteria_id, (unnest(range(1, len(must_have_skills) + 1)) - 1)::INT AS pos, unnest(must_have_skills) AS value FROM jd_criteria)"
_KINDS = f"{_kind('value', 'sentence')} AS is_sentence, {_kind('value', 'prose')} AS is_prose, {_kind('value', 'clean')} AS is_clean"


def _given(c: str) -> str:
    return f"nullif({sql_trim(c)}, '')"


def _join(c: str) -> str:
    return f"array_to_string(list_filter({c}, lambda x: x IS NOT NULL AND {sql_trim('x')} <> ''), ' ')"


def _repr(c: str) -> str:
    quoted = "CASE WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || x || '\"' ELSE '''' || replace(x, '''', '\\''') || '''' END"
    return f"'[' || coalesce(array_to_string(list_transform(list_sort(list_filter({c}, lambda x: x IS NOT NULL)), lambda x: {quoted}), ', '), '') || ']'"


_SQUEEZED = sql_trim(f"regexp_replace(regexp_replace(v, '[{T.WS}]*([.,;:!?])[{T.WS}]*', '\\1', 'g'), '[{T.WS}]*([/-])[{T.WS}]+|[{T.WS}]+([/-])', '\\1\\2', 'g')")
_TOP = ", ".join(f"('{k}', '{f[0].title()}', '{form}')" for k, f in C.TOP.items() for form in f)
SQL = {
    "posting_fields": f"""
        WITH l AS (SELECT job_id, {sql_trim("lower(description)")} AS low FROM job_postings), f AS (SELECT job_id, low, {", ".join(f"{_section(n)} AS {k}" for k, n in C.FIELDS.items())} FROM l)
        SELECT job_id, coalesce({", ".join(f"CASE WHEN length({t}) > 3 THEN {t} END" for t in _TITLES)}, CASE WHEN length({_FIRST}) < 100 AND length({_FIRST}) > 3 THEN {_bare(_FIRST)} END, '') AS job_title,
            experience_required, coalesce(nullif(skills_required, ''), experience_required) AS skills_required, responsibilities, education, company_description, location FROM f
    """,
    "form_lists": f"SELECT post_id, {_list('must_have_skills')} AS must_have_skills, {_list('industry_experience')} AS industry_experience, {_list('keywords', True)} AS keywords, coalesce(try_cast(regexp_replace(position_title, '[^0-9-]', '', 'g') AS INT), 0) AS number FROM jd_criteria_raw",
    "token_kinds": f"WITH {_V} SELECT criteria_id, pos, {_KINDS} FROM v",
    "criteria_stats": f"""
        WITH {_V}, k AS (SELECT criteria_id, count(*) FILTER (is_sentence) AS is_sentence, count(*) FILTER (is_prose) AS is_prose, count(*) FILTER (is_clean) AS is_clean FROM (SELECT criteria_id, {_KINDS} FROM v) GROUP BY criteria_id)
        SELECT c.criteria_id, coalesce(len(must_have_skills), 0)::INT AS must, coalesce(len(nice_to_have_skills), 0)::INT AS nice, coalesce(length(jd_summary), 0)::INT AS summary_length, coalesce(is_sentence, 0) AS is_sentence, coalesce(is_prose, 0) AS is_prose, coalesce(is_clean, 0) AS is_clean FROM jd_criteria AS c LEFT JOIN k USING (criteria_id)
    """,
    "criteria_summary": f"""
        SELECT criteria_id, {_collapsed(f'''concat_ws(' ', CASE WHEN {_given("position_title")} IS NOT NULL THEN 'We are seeking a ' || concat_ws(' ', {_given("seniority_level")}, {_given("position_title")}) || '.' END, CASE WHEN experience_min_years > 0 THEN 'The role requires ' || experience_min_years || '+ years of experience.' END,
            'Location: ' || {_given("location")}, nullif(concat_ws(' ', {_join("must_have_skills")}, {_join("nice_to_have_skills")}), ''))''')} AS summary,
            substr(md5(concat_ws('|', {_repr("must_have_skills")}, {_repr("nice_to_have_skills")}, coalesce(experience_min_years, 0)::VARCHAR)), 1, 12) AS jd_hash FROM jd_criteria
    """,
    "criteria_hygiene": f"""
        WITH {_FORMS}, t AS (SELECT criteria_id, 'must' AS f, unnest(must_have_skills) AS v FROM jd_criteria UNION ALL SELECT criteria_id, 'nice', unnest(nice_to_have_skills) FROM jd_criteria),
        s AS (SELECT criteria_id, f, lower({_SQUEEZED}) AS v FROM t), k AS (SELECT criteria_id, s.f, coalesce(lower(canonical), v) AS v FROM s LEFT JOIN f ON f.surface = s.v),
        w AS (SELECT DISTINCT criteria_id, f, unnest(CASE WHEN v = 'api' THEN ['openapi', 'swagger', 'rest'] ELSE [v] END) AS v FROM k WHERE v <> ''),
        g AS (SELECT criteria_id, list_sort(coalesce(list(v) FILTER (f = 'must'), [])) AS m, list_sort(coalesce(list(v) FILTER (f = 'nice'), [])) AS n FROM w GROUP BY criteria_id)
        SELECT criteria_id, coalesce(array_to_string(m, '|'), '') AS must, coalesce(array_to_string(list_filter(n, lambda x: NOT list_contains(m, x)), '|'), '') AS nice FROM jd_criteria LEFT JOIN g USING (criteria_id)
    """,
    "top_skills": f"SELECT DISTINCT job_id, skill_id, label FROM job_postings JOIN (VALUES {_TOP}) AS t(skill_id, label, form) ON contains(lower(description), form)",
}
