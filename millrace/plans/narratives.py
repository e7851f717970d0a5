"""Queries on requirement texts and on texts made about candidates; exports; event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cohort as C
from ..operators import matching as M
from ..operators import narrate as N
from ..operators import criteria as C4
from ..operators import requirements as R
from ..session import spread_work
from ..sources import schemas as S
from .skills import _FORMS, _W

OPENINGS = ("{name} stands out for this role", "{name} fits this role in part", "For this role {name} is one to look at")


def jd_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each posting, from its text where none is given."""
    return S.table(spark, sf_dir, "job_postings").select("job_id", R.jd_title(F.col("title"), F.col("description")).alias("title"))


def jd_titles_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of each posting, one behind a label in its text before the first line."""
    return S.table(spark, sf_dir, "job_postings").select("job_id", R.labelled_title(F.col("title"), F.col("description")).alias("title"))


def must_have_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills each posting's text requires, by mentions and what stands around them."""
    jobs = S.table(spark, sf_dir, "job_postings").select("job_id", "description")
    named = M.extracted(jobs, "job_id", "description", S.taxonomy(spark, sf_dir)).select("job_id", F.lower("canonical").alias("surface")).distinct()
    return R.must_have(spread_work(named.join(jobs, "job_id")), "job_id", "description", "surface")


def jd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement text made of each criteria form, and whether its summary is prose."""
    c = S.table(spark, sf_dir, "jd_criteria")
    made = R.jd_text(F.col("position_title"), F.col("experience_min_years"), F.col("must_have_skills"), F.col("nice_to_have_skills"), F.col("location"), F.col("jd_summary"))
    return c.select("criteria_id", made.alias("jd_text"), R.looks_like_sentence(F.col("jd_summary")).alias("is_prose"))


def variant_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening chosen for each candidate."""
    return S.table(spark, sf_dir, "resumes").select("resume_id", N.variant(F.col("candidate_id"), "opening", OPENINGS).alias("opening"))


def analysis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short text about each score: tier, coverage, matched skills, recommendation; polished."""
    s = S.table(spark, sf_dir, "resume_scores")
    s = s.groupBy("score_id").agg(*[F.first(c).alias(c) for c in ("candidate_id", "final_pre_llm", "coverage", "matched_required_skills")]).filter("final_pre_llm IS NOT NULL AND NOT isnan(final_pre_llm)")
    n = F.coalesce(F.size("matched_required_skills"), F.lit(0))
    cover = F.coalesce("coverage", F.lit(0.0))
    text = N.joined(
        F.concat(F.lit("Overall the match is "), C.tier(F.col("final_pre_llm")), F.lit(".")),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" skills of those required are shown, such as "), F.array_join(F.slice("matched_required_skills", 1, 3), ", "), F.lit("."))).otherwise(F.lit("No required skill is shown.")),
        F.when(cover >= 0.8, F.lit("Coverage is high.")).when(cover >= 0.6, F.lit("Coverage is good.")).when(cover >= 0.4, F.lit("Coverage is moderate.")).otherwise(F.lit("Coverage is low.")),
        F.concat(F.lit("Recommendation: "), C.recommendation(F.col("final_pre_llm"), cover)),
    )
    return s.select("score_id", N.polished(text).alias("text"))


def near_duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that nearly repeat one of the two before."""
    return N.near_repeats(N.sentences(S.table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence length and variety of words of each resume's summary."""
    r = S.table(spark, sf_dir, "resumes").select("resume_id", S.json_or_empty("processed_data_json", S.PROCESSED)["summary"].alias("summary"))
    return N.readability(N.sentences(r, "resume_id", "summary"), "resume_id")


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested export of each posting as one JSON text, with its schema version and parsed lists."""
    j = S.table(spark, sf_dir, "job_postings")
    listed = lambda c: F.coalesce(S.json_or_empty(c, "array<string>"), F.array().cast("array<string>"))
    body = F.struct(F.lit("2.1").alias("schema"), F.struct(F.coalesce("job_id", F.lit("")).alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("company", F.lit("")).alias("company")).alias("job"), F.struct(F.size(listed("requirements_json")).alias("requirements"), F.size(listed("nice_to_have_json")).alias("nice_to_have")).alias("counts"))
    return j.select("job_id", F.to_json(body).alias("body"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type in windows of an hour (an extension; the streaming package has the same over a stream)."""
    from ..streaming.windows import counts

    return counts(S.table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


QUERIES = {f.__name__: f for f in (jd_titles, jd_titles_labelled, must_have_scoring, jd_texts, variant_select, analysis_text, near_duplicate_sentences, readability, export_json, event_windows)}

_WS = "[ \\t\\n\\x0B\\f\\r]"
_SENT = "list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])" + _WS + "+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"
_CHOICES = ", ".join(f"'{t}'" for t in OPENINGS)
_WORD = f"[{T.W}]"
SQL = {
    "jd_titles": "WITH l AS (SELECT job_id, title, list_filter(list_transform(string_split_regex(description, '\\r\\n|\\n|\\r'), lambda x: trim(x, ' ')), lambda x: length(x) BETWEEN 4 AND 99) AS ls FROM job_postings) SELECT job_id, coalesce(nullif(trim(title, ' '), ''), ls[1]) AS title FROM l",
    "must_have_scoring": f"""
        WITH {_FORMS}, g AS (SELECT array_to_string({_W.format(c="surface")}, ' ') AS gram, canonical FROM f), d AS (SELECT job_id, description, {_W.format(c="description")} AS ws FROM job_postings WHERE description IS NOT NULL),
        e AS (SELECT DISTINCT job_id, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM d, unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(1, 1 + (SELECT max(len(string_split(gram, ' '))) FROM g))) AS b(n) WHERE i + n - 1 <= len(ws)),
        s AS (SELECT DISTINCT job_id, lower(canonical) AS surface FROM e JOIN g USING (gram)), p AS (SELECT job_id, surface, length(surface) AS k, lower(description) AS low, string_split(lower(description), surface) AS parts FROM s JOIN job_postings USING (job_id)),
        o AS (SELECT *, list_filter(range(1, len(parts)), lambda j: NOT regexp_matches(CASE WHEN parts[j] = '' AND j > 1 THEN right(surface, 1) ELSE right(parts[j], 1) END, '{_WORD}') AND NOT regexp_matches(CASE WHEN parts[j + 1] = '' AND j + 1 < len(parts) THEN left(surface, 1) ELSE left(parts[j + 1], 1) END, '{_WORD}')) AS js FROM p WHERE len(parts) > 1),
        q AS (SELECT *, len(js) AS n, list_transform(list_transform(js, lambda j: list_sum(list_transform(parts[1:j], lambda x: length(x))) + (j - 1) * k), lambda a: substr(low, (greatest(a - 100, 0) + 1)::BIGINT, (least(a, 100) + k + 50)::BIGINT)) AS ar FROM o WHERE len(js) > 0),
        r AS (SELECT job_id, surface, n::INT AS n, round((least(0.15::DOUBLE * n, 0.6) + 0.25 * len(list_filter(ar, lambda c: regexp_matches(c, '{C4.REQUIRED}'))) - 0.4 * len(list_filter(ar, lambda c: regexp_matches(c, '{C4.WISHED}'))) + CASE WHEN contains(left(low, length(low) // 2), surface) THEN 0.15 ELSE 0 END)::DOUBLE, 6) AS score FROM q)
        SELECT job_id, surface, n, score, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, surface)::INT AS pos FROM r WHERE score > 0.3 QUALIFY pos <= 8
    """,
    "jd_texts": """
        WITH l AS (SELECT *, array_to_string(list_filter(must_have_skills, lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), ', ') AS m, array_to_string(list_filter(nice_to_have_skills, lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), ', ') AS n FROM jd_criteria)
        SELECT criteria_id, concat_ws(chr(10), CASE WHEN position_title <> '' THEN 'Position: ' || position_title END, CASE WHEN experience_min_years > 0 THEN 'Experience: ' || experience_min_years || '+ years' END, CASE WHEN m <> '' THEN 'Must have: ' || m END, CASE WHEN n <> '' THEN 'Nice to have: ' || n END, CASE WHEN location <> '' THEN 'Location: ' || location END, jd_summary) AS jd_text,
            coalesce((len(list_filter(string_split_regex(trim(jd_summary, ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) > 6 AND regexp_matches(jd_summary, '[.!?]')) OR (length(jd_summary) >= 20 AND regexp_matches(lower(jd_summary), '(?:^|[^a-z])(?:we|you|should|must|looking|with|need)(?:$|[^a-z])')), false) AS is_prose FROM l
    """,
    "variant_select": f"SELECT resume_id, [{_CHOICES}][(('0x' || substr(md5(concat_ws('_', candidate_id, 'opening')), 1, 8))::BIGINT % {len(OPENINGS)} + 1)] AS opening FROM resumes",
    "analysis_text": """
        WITH s AS (SELECT DISTINCT score_id, final_pre_llm AS f, coalesce(coverage, 0) AS c, coalesce(matched_required_skills, []) AS m FROM resume_scores WHERE final_pre_llm IS NOT NULL AND NOT isnan(final_pre_llm))
        SELECT score_id, concat_ws(' ', 'Overall the match is ' || CASE WHEN f >= 0.8 THEN 'excellent' WHEN f >= 0.6 THEN 'strong' WHEN f >= 0.4 THEN 'moderate' ELSE 'limited' END || '.',
            CASE WHEN len(m) > 0 THEN len(m) || CASE WHEN len(m) = 1 THEN ' skill' ELSE ' skills' END || ' of those required are shown, such as ' || array_to_string(m[1:3], ', ') || '.' ELSE 'No required skill is shown.' END,
            CASE WHEN c >= 0.8 THEN 'Coverage is high.' WHEN c >= 0.6 THEN 'Coverage is good.' WHEN c >= 0.4 THEN 'Coverage is moderate.' ELSE 'Coverage is low.' END,
            'Recommendation: ' || CASE WHEN f >= 0.80 AND c >= 0.70 THEN 'advance' WHEN f >= 0.55 AND c >= 0.50 THEN 'consider' ELSE 'hold' END || '.') AS text FROM s
    """,
    "near_duplicate_sentences": f"""
        WITH s AS (SELECT doc_id, {_SENT.format(c="text")} AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS sentence FROM s),
        w AS (SELECT *, list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS w FROM e), l AS (SELECT *, lag(w, 1) OVER (PARTITION BY doc_id ORDER BY pos) AS a, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w WHERE len(w) > 0),
        j AS (SELECT doc_id, pos, sentence, greatest(coalesce(len(list_intersect(w, a)) / len(list_distinct(w || a)), 0.0), coalesce(len(list_intersect(w, b)) / len(list_distinct(w || b)), 0.0)) AS alike FROM l)
        SELECT doc_id, pos, sentence, round(alike, 6) AS alike FROM j WHERE alike > 0.8
    """,
    "readability": f"""
        WITH s AS (SELECT resume_id, {_SENT.format(c="(CASE WHEN json_valid(processed_data_json) THEN processed_data_json END ->> '$.summary')")} AS ls FROM resumes), e AS (SELECT resume_id, regexp_extract_all(lower(unnest(ls)), '[a-z0-9]+') AS w FROM s),
        g AS (SELECT resume_id, count(*) AS n_sentences, sum(len(w)) AS n, flatten(list(w)) AS ws FROM e GROUP BY resume_id)
        SELECT resume_id, n_sentences, round(n / n_sentences, 6)::DOUBLE AS mean_words, round(len(list_distinct(ws)) / greatest(n, 1), 6)::DOUBLE AS variety FROM g
    """,
    "export_json": """
        SELECT job_id, to_json({'schema': '2.1', 'job': {'id': coalesce(job_id, ''), 'title': coalesce(title, ''), 'company': coalesce(company, '')}, 'counts': {
            'requirements': CASE WHEN json_valid(requirements_json) THEN coalesce(json_array_length(requirements_json), 0) ELSE 0 END, 'nice_to_have': CASE WHEN json_valid(nice_to_have_json) THEN coalesce(json_array_length(nice_to_have_json), 0) ELSE 0 END}})::VARCHAR AS body FROM job_postings
    """,
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
