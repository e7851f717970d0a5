"""Queries that make records out of the documents' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extraction as X
from ..sources import schemas as S
from .texts import sql_lines, _WS, _sql_cut


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line of each document is."""
    return _lines(spark, sf_dir).withColumns(X.classes(F.col("line"))).drop("line")


def extracted_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles found in documents: title, company, dates, number of bullets."""
    return X.roles(_lines(spark, sf_dir), "doc_id")


def education_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open an entry of education, numbered in their document."""
    lines = _lines(spark, sf_dir).withColumns({k: v for k, v in X.classes(F.col("line")).items() if k in ("is_school", "is_degree", "is_training")})
    opens = (F.col("is_school") | F.col("is_degree")) & ~F.col("is_training")
    return X.blocks(lines.withColumn("_open", opens), "doc_id", F.col("_open")).filter("_open").select("doc_id", "pos", "block", "line")


def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name at the head of each document, if there is one."""
    return S.table(spark, sf_dir, "documents").select("doc_id", X.person_name(T.lines(F.col("text"))).alias("name")).filter("name IS NOT NULL")


def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines with the section they open, by equal words."""
    return _lines(spark, sf_dir).select("doc_id", "pos", X.canonical_header(F.col("line")).alias("section")).filter("section IS NOT NULL")


def section_headers_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines with the section they open, misspelt ones included."""
    return X.nearest_header(_lines(spark, sf_dir), "line").filter("section IS NOT NULL").select("doc_id", "pos", "section")


def skill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of lines that list skills, each once a document, where it came first, whatever its case."""
    listed = S.table(spark, sf_dir, "documents").select("doc_id", F.flatten(F.transform(F.filter(T.lines(F.col("text")), lambda x: F.lower(x).startswith("skills:")), lambda x: T.split_tokens(F.substring(x, F.lit(8), F.length(x))))).alias("vs"))
    return listed.select("doc_id", F.posexplode("vs").alias("pos", "item"), F.transform("vs", F.lower).alias("low")).filter(F.array_position("low", F.lower("item")) == F.col("pos") + 1).select("doc_id", "pos", "item")


def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of elements on pages of two columns; positions stand in the line items' numbers."""
    li = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line")).agg(F.max("l_quantity").alias("y"), F.max(F.floor(F.col("l_extendedprice") / 100)).alias("x"))
    return X.reading_order(li, "page", "x", "y", "line").select("page", "line", "column", "ord")


QUERIES = {f.__name__: f for f in (line_classes, extracted_roles, education_lines, person_names, section_headers, section_headers_fuzzy, skill_items, page_order)}

_E = f"l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, (unnest(range(1, len(ls) + 1)) - 1)::INT AS pos, unnest(ls) AS line FROM l)"
_YEAR = "regexp_matches(line, '(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])')"
_IS = {
    "is_bullet": "regexp_matches(line, '^[•●*-][ \\t]')", "is_contact": f"regexp_matches(lower(line), '{X.CONTACT}')", "is_training": f"regexp_matches(lower(line), '{X._word(X.TRAINING)}')",
    "is_role": f"regexp_matches(lower(line), '{X._word(X.JOBS)}') AND (regexp_matches(line, ' (?:-|–|—|\\||at|@) |, ') OR {_YEAR} OR (length(line) <= 40 AND regexp_matches(line, '[^ \\t][ \\t]+[^ \\t]'))) AND NOT regexp_matches(lower(line), '{X.CONTACT}') AND NOT regexp_matches(lower(line), '{X._word(X.TRAINING)}') AND length(line) <= 120",
    "is_school": f"regexp_matches(lower(line), '(?:{X.SCHOOLS})')", "is_degree": f"regexp_matches(lower(line), '{X._word(X.DEGREES)}')",
    "is_coherent": "length(line) >= 2 AND regexp_matches(line, '[A-Za-z0-9_]') AND NOT regexp_matches(line, '(?:st|nd|rd|th){2,}|[●•*-]{3,}|^[●•*-]+$')",
}
_KEY = f"trim(regexp_replace(regexp_replace(lower(line), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'), '{_WS}+', ' ', 'g'), ' ')"
_DATES = f"CASE WHEN regexp_extract(line, '{T.DATE_RANGE}', 0) <> '' THEN regexp_extract(line, '{T.DATE_RANGE}', 0) ELSE array_to_string(list_filter(regexp_extract_all(line, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y, i: list_position(regexp_extract_all(line, '\\b((?:19|20)[0-9]{{2}})\\b', 1), y) = i)[1:2], ' - ') END"
_TABOO = X._word("|".join([X.JOBS, "experience|education|skills|summary|profile|curriculum|vitae|resume|hiring|dear|kind|regards|good|morning|hello|senior|junior|staff|principal"]))
_CASES = " ".join(f"WHEN {_KEY} IN ({', '.join(repr(a) for a in v.split('|'))}) THEN '{k}'" for k, v in X.HEADERS.items())
SQL = {
    "line_classes": f"WITH {_E} SELECT doc_id, pos, {', '.join(f'{v} AS {k}' for k, v in _IS.items())} FROM e",
    "extracted_roles": f"""
        WITH {_E}, m AS (SELECT *, {_IS["is_role"]} AND NOT {_IS["is_bullet"]} AS op, {_IS["is_bullet"]} AS bu FROM e), b AS (SELECT *, sum(op::INT) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS block FROM m),
        w AS (SELECT *, regexp_replace(trim(line, ' '), '^[-|•]+|[-|•]+$', '', 'g') AS w FROM b WHERE block > 0)
        SELECT doc_id, block, max({_sql_cut(0)}) FILTER (op) AS title, max({_sql_cut(1)}) FILTER (op) AS company, max({_DATES}) FILTER (op) AS dates, count(*) FILTER (bu) AS n_bullets FROM w GROUP BY doc_id, block
    """,
    "education_lines": f"WITH {_E}, m AS (SELECT *, ({_IS['is_school']} OR {_IS['is_degree']}) AND NOT {_IS['is_training']} AS op FROM e), b AS (SELECT *, sum(op::INT) OVER (PARTITION BY doc_id ORDER BY pos)::INT AS block FROM m) SELECT doc_id, pos, block, line FROM b WHERE op",
    "person_names": f"WITH l AS (SELECT doc_id, {sql_lines('text')} AS ls FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, list_filter(ls[1:10], lambda x: regexp_matches(x, '^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ''’-]+(?: [A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ''’-]*){{1,3}}$') AND NOT regexp_matches(lower(x), '{_TABOO}'))[1] AS name FROM l) SELECT doc_id, name FROM n WHERE name IS NOT NULL",
    "section_headers": f"WITH {_E}, s AS (SELECT doc_id, pos, CASE {_CASES} END AS section FROM e) SELECT * FROM s WHERE section IS NOT NULL",
    "skill_items": f"""
        WITH l AS (SELECT doc_id, list_filter({sql_lines("text")}, lambda x: starts_with(lower(x), 'skills:')) AS ls FROM documents WHERE text IS NOT NULL),
        v AS (SELECT doc_id, flatten(list_transform(ls, lambda x: list_filter(list_transform(string_split_regex(substr(x, 8), '[,;/]'), lambda y: trim(y, ' ')), lambda y: y <> ''))) AS vs FROM l),
        e AS (SELECT doc_id, (unnest(range(1, len(vs) + 1)) - 1)::INT AS pos, unnest(vs) AS item FROM v) SELECT doc_id, pos, item FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY pos) = 1
    """,
    "page_order": """
        WITH p AS (SELECT l_orderkey AS page, l_linenumber AS line, max(l_quantity) AS y, max(floor(l_extendedprice / 100)::BIGINT) AS x FROM lineitem GROUP BY ALL),
        d AS (SELECT DISTINCT page, x FROM p), g AS (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM d),
        k AS (SELECT page, nx - x AS gap, (x + nx) / 2 AS mid FROM g WHERE nx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY nx - x DESC, (x + nx) / 2 DESC) = 1),
        e AS (SELECT page, min(x) AS lo, max(x) AS hi FROM p GROUP BY page),
        c AS (SELECT page, CASE WHEN gap > greatest(0.15 * (hi - lo), 50.0) AND abs(mid - (lo + hi) / 2) <= 0.35 * (hi - lo) THEN mid END AS cut FROM k JOIN e USING (page)),
        q AS (SELECT p.*, CASE WHEN x >= cut THEN 1 ELSE 0 END AS "column" FROM p LEFT JOIN c USING (page))
        SELECT page, line, "column", row_number() OVER (PARTITION BY page ORDER BY "column", y, x, line)::INT AS ord FROM q
    """,
}
