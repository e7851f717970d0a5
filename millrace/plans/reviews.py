"""Queries on reviews: batch summaries, contexts of skills, sections of postings, blocks on pages, provenance of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction as X
from ..operators import matching as M
from ..operators import narrate as N
from ..sources import schemas as S
from .cohorts import _S, _TOP, _scores, _shortlist, _valid
from .extractions import _CASES
from .narratives import _SENT, analysis_text
from .narratives import SQL as _NARRATIVES
from .profiles import SQL as _PROFILES
from .profiles import evidence_ranked
from .skills import _FORMS, _W
from .texts import sql_lines, sql_trim


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each session: the three best candidates in order, how many scores are valid, how many are missing, a note."""
    top = _shortlist(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "candidate_id"))), lambda x: F.coalesce(x["candidate_id"], F.lit("?"))), ", ").alias("best"))
    counts = _scores(spark, sf_dir).filter("session_id IS NOT NULL").groupBy("session_id").agg(F.count_if(F.col("final_pre_llm").isNotNull() & ~F.isnan("final_pre_llm")).alias("n_valid"), F.count_if(F.col("final_pre_llm").isNull() | F.isnan("final_pre_llm")).alias("n_failed"))
    note = F.when(F.col("n_failed") > 0, F.concat(F.col("n_failed").cast("string"), F.lit(" without a score"))).otherwise(F.lit("complete"))
    return counts.join(top, "session_id", "left").withColumn("note", note)


def newest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions numbered within their job, newest first, those without a date last."""
    w = Window.partitionBy("job_id").orderBy(F.col("created_at").desc_nulls_last(), "session_id")
    return S.table(spark, sf_dir, "ranking_sessions").filter("job_id IS NOT NULL").select("job_id", "session_id", F.row_number().over(w).alias("pos"))


def skill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the first mention of each skill in each document, by whatever form it is named, and a short quote of it."""
    placed = M.first_places(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", S.taxonomy(spark, sf_dir))
    context = placed.select("doc_id", "skill", F.explode(F.array(T.context_of(F.col("text"), F.col("at"), F.col("n")))).alias("context"))
    return context.select("doc_id", "skill", "context", T.quote_of(F.col("context")).alias("quote"))


def posting_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each posting by the section that the last header before them opened; 'body' before the first."""
    lines = S.table(spark, sf_dir, "job_postings").select("job_id", F.posexplode(T.lines(F.col("description"))).alias("pos", "line")).withColumn("header", X.canonical_header(F.col("line")))
    last = F.last("header", ignorenulls=True).over(Window.partitionBy("job_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("section", F.coalesce(last, F.lit("body"))).filter("header IS NULL").groupBy("job_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("n_chars"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of a page, read by top and left, grouped into blocks: a step of 5 down or of 20 across starts one. Positions stand in the line items' numbers."""
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("top"), F.floor(F.col("l_extendedprice") / 1000).alias("x"))
    w = Window.partitionBy("page").orderBy("top", "x", "line")
    step = li.withColumn("new", F.coalesce((F.col("top") - F.lag("top").over(w) >= 5) | (F.abs(F.col("x") - F.lag("x").over(w)) >= 20), F.lit(True)))
    marked = step.withColumn("block", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.groupBy("page", "block").agg(F.count("*").alias("n"), F.min("x").alias("left"), F.min("top").alias("top"))


def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of evidence by source, with their mean confidence, and how many skills have some."""
    return evidence_ranked(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.col("pos") == 1).alias("n_best"))


def sentence_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of sentence is used in the texts about scores, and in how many texts."""
    rows = N.sentences(analysis_text(spark, sf_dir), "score_id", "text")
    kind = F.when(F.col("sentence").startswith("Overall"), "tier").when(F.col("sentence").startswith("Coverage"), "coverage").when(F.col("sentence").startswith("Recommendation"), "recommendation").otherwise("skills")
    return rows.groupBy(kind.alias("kind"), "pos").agg(F.count("*").alias("n"), F.round(F.avg(F.length("sentence")), 6).alias("mean_length"))


def skill_phrase_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nice-to-have skills matched with a candidate-independent list: by equal words, else, only where none is equal, by their letters and digits alone."""
    typed = S.table(spark, sf_dir, "jd_criteria").select("criteria_id", F.posexplode("nice_to_have_skills").alias("pos", "value")).filter("trim(value) <> ''")
    forms = S.taxonomy(spark, sf_dir)
    squashed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    loose = forms.groupBy(squashed(F.col("surface")).alias("_q")).agg(F.max("skill_id").alias("loose"))
    out = typed.join(forms.select("surface", F.col("skill_id").alias("strict")), F.lower(F.trim("value")) == F.col("surface"), "left").withColumn("_q", squashed(F.col("value"))).join(loose, "_q", "left")
    return out.select("criteria_id", "pos", F.coalesce("strict", "loose").alias("skill_id"), F.when(F.col("strict").isNotNull(), "words").when(F.col("loose").isNotNull(), "letters").otherwise("none").alias("by"))


def valid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivered score once, without those null or NaN."""
    return _valid(_scores(spark, sf_dir)).select("score_id", "session_id", "candidate_id", "final_pre_llm")


QUERIES = {f.__name__: f for f in (batch_summary, newest_sessions, skill_context, posting_sections, text_blocks, evidence_counts, sentence_provenance, skill_phrase_fallback, valid_scores)}

# the steps of a context in the other dialect, one table behind the other
_PLACE = "'(?s)^(.*?(?:^|[^a-z0-9+#.-])[.-]*)(' || replace(regexp_replace(gram, '([.+])', '\\\\\\1', 'g'), ' ', '[.-]*[^a-z0-9+#.-][^a-z0-9+#]*') || ')[.-]*(?:$|[^a-z0-9+#.-])'"
_WSP = "[ \\t\\n\\x0B\\f\\r]"
_LOOSE_FIRST, _LOOSE_LAST = "".join(f"(?:{w} )?" for w in T.LOOSE), "".join(f"(?: {w})?" for w in reversed(T.LOOSE))
SQL = {
    "batch_summary": f"""
        WITH {_S}, {_TOP}, b AS (SELECT session_id, string_agg(coalesce(candidate_id, '?'), ', ' ORDER BY position) AS best FROM t GROUP BY session_id),
        c AS (SELECT session_id, count(*) FILTER (final_pre_llm IS NOT NULL AND NOT isnan(final_pre_llm)) AS n_valid, count(*) FILTER (final_pre_llm IS NULL OR isnan(final_pre_llm)) AS n_failed FROM s WHERE session_id IS NOT NULL GROUP BY session_id)
        SELECT c.*, best, CASE WHEN n_failed > 0 THEN n_failed || ' without a score' ELSE 'complete' END AS note FROM c LEFT JOIN b USING (session_id)
    """,
    "newest_sessions": "SELECT job_id, session_id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC NULLS LAST, session_id)::INT AS pos FROM ranking_sessions WHERE job_id IS NOT NULL",
    "skill_context": f"""
        WITH {_FORMS}, g AS (SELECT array_to_string({_W.format(c="surface")}, ' ') AS gram, canonical FROM f), d AS (SELECT doc_id, {_W.format(c="text")} AS ws FROM documents WHERE text IS NOT NULL),
        e AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM d, unnest(range(1, len(ws) + 1)) AS a(i), unnest(range(1, 1 + (SELECT max(len(string_split(gram, ' '))) FROM g))) AS b(n) WHERE i + n - 1 <= len(ws)),
        n AS (SELECT DISTINCT doc_id, lower(canonical) AS skill, gram FROM e JOIN g USING (gram)),
        p AS (SELECT doc_id, skill, text, length(regexp_extract(lower(text), {_PLACE}, 1)) AS pl, length(regexp_extract(lower(text), {_PLACE}, 2)) AS n FROM n JOIN documents USING (doc_id)),
        f1 AS (SELECT * FROM p WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, skill ORDER BY pl, n) = 1),
        f2 AS (SELECT *, CASE WHEN pl - 80 < 19 THEN 0 ELSE pl - 80 END AS a0, substr(text, pl + 1, n) AS held FROM f1),
        f3 AS (SELECT *, regexp_extract(substr(text, a0 + 1, pl - a0), '[^.]*$', 0) || held || regexp_extract(substr(text, pl + n + 1, 80), '^[^.]*\\.?', 0) AS w0 FROM f2),
        f4 AS (SELECT *, regexp_replace({sql_trim("w0")}, '^[.,;:]+|[.,;:]+$', '', 'g') AS w1 FROM f3),
        f5 AS (SELECT *, regexp_replace(regexp_replace(w1, '^(?i:{_LOOSE_FIRST})', ''), '(?i:{_LOOSE_LAST})$', '') AS c FROM f4),
        f6 AS (SELECT *, list_filter(string_split_regex(c, '[{T.WS}]+'), lambda x: x <> '') AS ws, list_filter(string_split_regex(held, '[{T.WS}]+'), lambda x: x <> '') AS own FROM f5),
        f7 AS (SELECT *, list_filter(range(1, greatest(len(ws) - len(own) + 1, 1) + 1), lambda i: ws[i : i + len(own) - 1] = own)[1] AS i FROM f6),
        f8 AS (SELECT doc_id, skill, CASE WHEN length(c) <= 80 THEN c WHEN i IS NOT NULL THEN array_to_string(ws[greatest(i - 3, 1) : i + len(own) + 2], ' ') WHEN len(ws) > 12 THEN array_to_string(ws[len(ws) // 2 - 3 : len(ws) // 2 + 4], ' ') ELSE c END AS context FROM f7),
        w AS (SELECT *, list_filter(string_split_regex(trim(context, ' '), '{_WSP}+'), lambda x: x <> '') AS ws FROM f8)
        SELECT doc_id, skill, context, CASE WHEN len(ws) <= 8 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[1:6], ' ') END AS quote FROM w
    """,
    "posting_sections": f"""
        WITH l AS (SELECT job_id, {sql_lines("description")} AS ls FROM job_postings WHERE description IS NOT NULL), e AS (SELECT job_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM l),
        h AS (SELECT *, CASE {_CASES} END AS header FROM e), s AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'body') AS section FROM h)
        SELECT job_id, section, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM s WHERE header IS NULL GROUP BY job_id, section
    """,
    "text_blocks": """
        WITH p AS (SELECT l_orderkey AS page, l_linenumber AS line, l_quantity AS top, floor(l_extendedprice / 1000)::BIGINT AS x FROM lineitem),
        s AS (SELECT *, coalesce(top - lag(top) OVER w >= 5 OR abs(x - lag(x) OVER w) >= 20, true) AS new FROM p WINDOW w AS (PARTITION BY page ORDER BY top, x, line)),
        b AS (SELECT *, sum(new::INT) OVER (PARTITION BY page ORDER BY top, x, line ROWS UNBOUNDED PRECEDING)::INT AS block FROM s)
        SELECT page, block, count(*) AS n, min(x) AS "left", min(top) AS top FROM b GROUP BY page, block
    """,
    "evidence_counts": f"SELECT source, count(*) AS n, round(avg(confidence), 6) AS confidence, count(*) FILTER (pos = 1) AS n_best FROM ({_PROFILES['evidence_ranked']}) GROUP BY source",
    "sentence_provenance": f"""
        WITH t AS ({_NARRATIVES["analysis_text"]}), l AS (SELECT {_SENT.format(c="text")} AS ls FROM t), e AS (SELECT (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS sentence FROM l)
        SELECT CASE WHEN starts_with(sentence, 'Overall') THEN 'tier' WHEN starts_with(sentence, 'Coverage') THEN 'coverage' WHEN starts_with(sentence, 'Recommendation') THEN 'recommendation' ELSE 'skills' END AS kind, pos, count(*) AS n, round(avg(length(sentence)), 6) AS mean_length FROM e GROUP BY ALL
    """,
    "skill_phrase_fallback": f"""
        WITH {_FORMS}, t AS (SELECT criteria_id, (unnest(range(1, len(nice_to_have_skills) + 1)) - 1)::INT AS pos, unnest(nice_to_have_skills) AS value FROM jd_criteria),
        q AS (SELECT regexp_replace(lower(surface), '[^a-z0-9]', '', 'g') AS q, max(skill_id) AS loose FROM f GROUP BY 1)
        SELECT criteria_id, pos, coalesce(f.skill_id, q.loose) AS skill_id, CASE WHEN f.skill_id IS NOT NULL THEN 'words' WHEN q.loose IS NOT NULL THEN 'letters' ELSE 'none' END AS "by"
        FROM t LEFT JOIN f ON lower(trim(value, ' ')) = surface LEFT JOIN q ON q.q = regexp_replace(lower(value), '[^a-z0-9]', '', 'g') WHERE trim(value, ' ') <> ''
    """,
    "valid_scores": f"WITH {_S} SELECT score_id, session_id, candidate_id, final_pre_llm FROM v",
}
