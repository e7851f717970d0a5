"""Queries of sections and records: what a document's lines are, the sections they make, the records in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from ..operators import sections as Sec
from ..sources import schemas as S


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", "text")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each document with their labels and items."""
    return Sec.sectioned(_docs(spark, sf_dir), "doc_id", "text")


def section_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the characters of its core sections, and whether it counts as parsed."""
    s = document_sections(spark, sf_dir).withColumn("n", F.length(F.array_join("items", " ")))
    total = {c: F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)) for c in Sec.CORE}
    out = s.groupBy("doc_id").agg(F.count("*").alias("sections"), *[v.alias(k) for k, v in total.items()])
    ok = (F.col("experience") + F.col("skills") + F.col("education")) > 0
    return out.withColumn("parsing_ok", ok).withColumn("parse_reason", F.when(ok, "ok").otherwise("no_canonical_sections"))


def missing_core_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core sections that a document with any section doesn't have: an anti join on (document, label)."""
    s = document_sections(spark, sf_dir).select("doc_id", "label").distinct()
    wanted = s.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, Sec.CORE))).alias("label"))
    return wanted.join(s, ["doc_id", "label"], "left_anti")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document rendered as plain text, a line '--- header ---' before each section's items."""
    s = document_sections(spark, sf_dir).select("doc_id", F.struct("ord", F.concat(F.lit("--- "), "header", F.lit(" ---\n"), F.array_join("items", "\n")).alias("t")).alias("s"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["t"]), "\n").alias("rendered"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each document: name, roles, education, projects, skills, the rest."""
    return R.records(_docs(spark, sf_dir), "doc_id", "text")


def resume_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles found in each resume's raw text, one row each, named by its file where the text names nobody."""
    raw = S.resumes(spark, sf_dir, "raw_text").join(S.table(spark, sf_dir, "resumes").select("resume_id", "filename"), "resume_id")
    found = R.records(raw, "resume_id", "raw_text", "filename")
    return found.select("resume_id", "candidate_name", F.posexplode("experience").alias("pos", "e")).select("resume_id", "candidate_name", "pos", "e.title", "e.company", "e.dates", F.size("e.bullets").alias("n_bullets"))


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of contents a document has, by its headers and contents, its first fifteen lines for contact data."""
    s = document_sections(spark, sf_dir).select("doc_id", F.lower("header").alias("h"), F.lower(F.array_join("items", " ")).alias("t"))
    told = {k: F.bool_or(F.col("h").rlike(h) | F.col("t").rlike(c)) for k, (h, c) in Sec._HAS.items()}
    has = s.groupBy("doc_id").agg(F.count("*").alias("total_sections"), *[v.alias(k) for k, v in told.items()])
    head = F.slice(T.lines(F.col("text")), 1, 15)
    reach = F.exists(head, lambda x: x.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}") | F.lower(x).rlike("street|avenue|road|drive|phone|email|address"))
    return has.join(_docs(spark, sf_dir).select("doc_id", F.coalesce(reach, F.lit(False)).alias("has_contact_info")), "doc_id")


def line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line whether it looks like an inline header, is clearly content, opens a role, and the family of its words."""
    kinds = "struct<score:double,inline:boolean,content:boolean,role:boolean,family:string>"

    @F.pandas_udf(kinds)
    def told(lines):
        import pandas as pd

        return pd.DataFrame([(round(Sec.header_score(x), 6), Sec.inline_header(x), Sec.clearly_content(x), R.is_role(x), Sec.family_of(x)) for x in lines], columns=["score", "inline", "content", "role", "family"])

    distinct = _lines(spark, sf_dir).select("line").distinct()
    return distinct.withColumn("k", told("line")).select(F.md5("line").alias("line_md5"), "k.*")


_QUERIES = (document_sections, section_lengths, missing_core_sections, document_text, document_records, resume_records, document_summary, line_roles)
QUERIES = {f.__name__: f for f in _QUERIES}
SQL: dict[str, str] = {}
