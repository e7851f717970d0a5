"""Queries of text normalization over the documents and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction as E
from ..sources import schemas as S
from .skills import RESUME
from ..session import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _scalar(name: str, f, sql: str) -> None:
    """A query (doc_id, out) of a column function over the documents' texts. Long results are compared by their digest."""

    def query(spark: SparkSession, sf_dir: str, f=f) -> DataFrame:
        return _docs(spark, sf_dir).select("doc_id", f(F.col("text")).alias("out"))

    query.__doc__ = f.__doc__
    QUERIES[name] = query
    SQL[name] = f"SELECT doc_id, {sql} AS out FROM documents"


# the same steps in the other dialect
def sql_steps(expr: str, steps) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return expr


def sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{T.WS}]+|[{T.WS}]+$', '', 'g')"


_WS = "[ \\t\\n\\x0B\\f\\r]"
def sql_lines(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '\\r\\n|\\n|\\r'), lambda x: {sql_trim('x')}), lambda x: x <> '')"


_BOILER = "regexp_matches(lower(x), '^(?:{kinds})$')"
# a joined line: pairs of lines that could go on in the next, taken from the left
_JOINED = """
    SELECT doc_id, CASE WHEN ls IS NOT NULL THEN coalesce(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i = 1 THEN '' WHEN marks[i:i] = 'K' THEN ' ' ELSE chr(10) END || x), ''), '') END AS joined FROM (
        SELECT doc_id, ls, regexp_replace(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i < len(ls) AND NOT regexp_matches(x, '[.!?:;]$') AND regexp_matches(ls[i + 1], '^\\p{Ll}') THEN '1' ELSE '0' END), ''), '1[01]', 'TK', 'g') AS marks
        FROM (SELECT doc_id, """ + sql_lines("text") + """ AS ls FROM documents))
"""
_UNIFIED = "regexp_replace(translate({c}, '●▪▫◦‣⁃∙', '•••••••'), '(?m)^[ \\t]*[-*][ \\t]+', '• ', 'g')"

_scalar("preprocess_text", T.preprocessed, sql_trim(sql_steps(sql_trim("lower(text)"), T.PREPROCESSED)))
_scalar("dense_preprocess", T.for_dense_models, sql_trim(sql_steps(sql_trim("text"), T.FOR_DENSE)))
_scalar("dehyphenate", T.dehyphenated, sql_steps("text", T.DEHYPHENATED))
_scalar("normalize_bullets", T.unified_bullets, _UNIFIED.format(c="text"))
_scalar("boilerplate_filter", T.without_boilerplate, f"array_to_string(list_filter({sql_lines('text')}, lambda x: NOT {_BOILER.format(kinds='|'.join(T.BOILERPLATE))}), chr(10))")
_scalar(
    "scrub_pii",
    T.scrubbed,
    "array_to_string(list_filter("
    + sql_lines(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(\\+?1[-. ]?)?\\(?[0-9]{3}\\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}', '[PHONE]', 'g'), 'https?://[^ \\t\\n\\x0B\\f\\r]+', '[URL]', 'g'), 'www\\.[^ \\t\\n\\x0B\\f\\r]+', '[URL]', 'g')"
    )
    + f", lambda x: NOT {_BOILER.format(kinds='|'.join(T.SCRUBBED))}), ' ')",
)
_scalar("fix_spacing", T.fixed_spacing, sql_trim(sql_steps("text", T.SPACING)))
_scalar("fix_bullets", T.fixed_bullets, sql_steps("text", T.BULLETS))
_DOUBLED = (f"(^|[^{T.W}])(st|nd|rd|th)(nd|rd|th|st)([^{T.W}]|$)", "$1$2$4")  # taken twice, as neighbours share a character
_scalar("fix_ordinals", T.fixed_ordinals, sql_steps("text", ((r"([0-9]+)(st|nd|rd|th)(nd|rd|th|st)", "$1$2"), _DOUBLED, _DOUBLED, (r"(st|nd|rd|th)[●•*-]+", "$1"), (f"([0-9]+)[{T.WS}]+(st|nd|rd|th)([^{T.W}]|$)", "$1$2$3"))))


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint chunks of 393 words."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("pos", "chunk"))


SQL["chunk_words"] = f"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(trim(text, ' '), '{_WS}+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, i::INT AS pos, array_to_string(ws[i * 393 + 1 : i * 393 + 393], ' ') AS chunk FROM w, unnest(range(0, ceil(len(ws) / 393.0)::BIGINT)) AS r(i)
"""


def line_frequency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document without those that come more than three times in it, whatever their case: headers and footers."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    times = F.count("*").over(Window.partitionBy("doc_id", F.lower("line")))
    return lines.withColumn("times", times).filter("times <= 3").drop("times")


def line_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that come in more than three documents, with the number of those: corpus-wide headers and footers."""
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.transform(T.lines(F.col("text")), F.lower))).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n_docs")).filter("n_docs > 3")


SQL["line_frequency_filter"] = f"""
    WITH l AS (SELECT doc_id, {sql_lines("text")} AS ls FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS line FROM l)
    SELECT doc_id, pos, line FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, lower(line)) <= 3
"""
SQL["line_frequencies"] = f"""
    WITH l AS (SELECT doc_id, unnest(list_distinct(list_transform({sql_lines("text")}, lambda x: lower(x)))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT line, count(*) AS n_docs FROM l GROUP BY line HAVING count(*) > 3
"""


def line_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line: whether it is a bullet, its header key, the title and company it splits into, and its dates."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    cut = T.title_and_company(F.col("line"))
    return lines.select("doc_id", "pos", F.col("line").rlike(r"^[•●*-]\s").alias("is_bullet"), T.header_key(F.col("line")).alias("header_key"), cut["title"].alias("title"), cut["company"].alias("company"), T.dates_of(F.col("line")).alias("dates"))


def _sql_cut(which: int) -> str:
    clean = "regexp_replace({x}, '^[ ,|-]+|[ ,|-]+$', '', 'g')"
    cases = ""
    for sep in T.SEPARATORS:
        at = f"instr(lower(w), '{sep}')"
        part = f"left(w, ({at} - 1)::BIGINT)" if which == 0 else f"substr(w, ({at} + {len(sep)})::BIGINT)"
        cases += f" WHEN {at} > 0 THEN {clean.format(x=part)}"
    return f"CASE{cases} ELSE {'w' if which == 0 else repr('')} END"


SQL["line_fields"] = f"""
    WITH l AS (SELECT doc_id, {sql_lines("text")} AS ls FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS line FROM l),
    w AS (SELECT *, regexp_replace(trim(line, ' '), '^[-|•]+|[-|•]+$', '', 'g') AS w, regexp_extract(line, '{T.DATE_RANGE}', 0) AS span, regexp_extract_all(line, '\\b((?:19|20)[0-9]{{2}})\\b', 1) AS ys FROM e)
    SELECT doc_id, pos, regexp_matches(line, '^[•●*-][ \\t]') AS is_bullet, trim(regexp_replace(regexp_replace(lower(line), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '{_WS}+', ' ', 'g'), ' ') AS header_key,
        {_sql_cut(0)} AS title, {_sql_cut(1)} AS company,
        CASE WHEN span <> '' THEN span ELSE array_to_string(list_filter(ys, lambda y, i: list_position(ys, y) = i)[1:2], ' - ') END AS dates
    FROM w
"""


def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the posted keyword fields between commas, semicolons and slashes, each once a post, where it came first, whatever its case."""
    posts = spark.read.parquet(f"{sf_dir}/jd_criteria_raw.parquet").select("post_id", T.split_tokens(F.col("keywords")).alias("vs"))
    low = F.transform("vs", F.lower)
    return posts.select("post_id", F.posexplode("vs").alias("pos", "item"), low.alias("low")).filter(F.array_position("low", F.lower("item")) == F.col("pos") + 1).select("post_id", "pos", "item")


SQL["first_occurrence"] = f"""
    WITH v AS (SELECT post_id, list_filter(list_transform(string_split_regex(keywords, '[,;/]'), lambda x: {sql_trim('x')}), lambda x: x <> '') AS vs FROM jd_criteria_raw WHERE keywords IS NOT NULL),
    e AS (SELECT post_id, (unnest(range(1, len(vs) + 1)) - 1)::INT AS pos, unnest(vs) AS item FROM v)
    SELECT post_id, pos, item FROM e QUALIFY row_number() OVER (PARTITION BY post_id, lower(item) ORDER BY pos) = 1
"""


def canonical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The must-have skills of each criteria in lower case, trimmed, without repeats, sorted, as one string."""
    skills = F.sort_array(F.array_distinct(F.filter(F.transform("must_have_skills", lambda x: F.lower(T.trimmed(x))), lambda x: x.isNotNull() & (x != ""))))
    return spark.read.parquet(f"{sf_dir}/jd_criteria.parquet").select("criteria_id", F.array_join(skills, "|").alias("skills"), F.substring(F.md5(F.concat_ws("|", F.lower("position_title"), F.array_join(skills, "|"))), 1, 12).alias("jd_hash"))


SQL["canonical_list"] = f"""
    WITH s AS (SELECT criteria_id, position_title, array_to_string(list_sort(list_distinct(list_filter(list_transform(must_have_skills, lambda x: lower({sql_trim('x')})), lambda x: x IS NOT NULL AND x <> ''))), '|') AS skills FROM jd_criteria)
    SELECT criteria_id, skills, substr(md5(concat_ws('|', lower(position_title), skills)), 1, 12) AS jd_hash FROM s
"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names made of the resumes' file names."""
    return spark.read.parquet(f"{sf_dir}/resumes.parquet").select("resume_id", T.name_from_file(F.col("filename")).alias("display_name"))


SQL["file_names"] = """
    WITH b AS (SELECT resume_id, trim(regexp_replace(trim(translate(regexp_replace(filename, '\\.[^.]*$', ''), '_-', '  '), ' '), ' +', ' ', 'g'), ' ') AS b FROM resumes)
    SELECT resume_id, coalesce(nullif(array_to_string(list_transform(string_split(b, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ''), 'Unknown Candidate') AS display_name FROM b
"""


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped lines joined pairwise."""
    return _docs(spark, sf_dir).select("doc_id", T.joined_lines(F.col("text")).alias("out"))


SQL["joined_lines"] = "SELECT doc_id, joined AS out FROM (" + _JOINED + ")"


def preprocess_resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts composed, words and lines joined, one bullet sign, one space for any white space."""
    composed = _docs(spark, sf_dir).select("doc_id", T.composed(F.col("text")).alias("text"))
    return composed.select("doc_id", T.preprocessed_resume(F.col("text")).alias("out"))


def cleaned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without garbled ordinals, bullets and spaces; those of contact data or without any word are left out."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return E.cleaned(lines, "line").select("doc_id", "pos", "item")


def resume_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each resume: its summary, notes and misc where there are any, else the raw text; and the same preprocessed."""
    r = S.resumes(spark, sf_dir, "experience", "skills", "misc", "raw_text")
    roles = F.array_join(F.transform("experience", lambda e: F.concat_ws(" ", e["title"], e["company"], F.array_join(e["bullets"], " "))), " ")
    parts = (roles, F.array_join(F.transform("skills", lambda s: s["skill"]), " "), F.col("misc"))
    return r.select("resume_id", F.md5(T.resume_text(F.col("raw_text"), *parts)).alias("text_md5"), F.md5(T.canonical_resume_text(*parts)).alias("canonical_md5"))


def _column_queries() -> tuple:
    return (chunk_words, line_frequency_filter, line_frequencies, line_fields, first_occurrence, canonical_list, file_names, joined_lines, preprocess_resume_text, cleaned_items, resume_texts)


QUERIES |= {f.__name__: f for f in _column_queries()}


def _resume_texts_sql() -> str:
    none = "''"
    parts = [
        "array_to_string(list_transform(p.experience, lambda e: concat_ws(' ', e.title, e.company, array_to_string(e.bullets, ' '))), ' ')",
        "array_to_string(list_transform(p.skills, lambda e: e.skill), ' ')", "p.misc",
    ]
    joined = f"coalesce(nullif(concat_ws(' ', {', '.join(f'nullif({sql_trim(c)}, {none})' for c in parts)}), ''), p.raw_text)"
    canonical = sql_trim(sql_steps(sql_trim(f"lower(concat_ws(' ' || chr(10) || ' ', {', '.join(f'nullif({c}, {none})' for c in parts)}))"), T.PREPROCESSED))
    return f"WITH {RESUME} SELECT resume_id, md5({joined}) AS text_md5, md5({canonical}) AS canonical_md5 FROM r"


SQL["resume_texts"] = _resume_texts_sql()
