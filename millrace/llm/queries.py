"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import bpe, entries, one_form, packing, pii, ranking, residue, splitting


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best scores of each job."""
    return ranking.best_scores(_read(spark, sf_dir, "resume_scores"), _read(spark, sf_dir, "ranking_sessions"), 10)


def p2_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each typed skill with the skill of the taxonomy that it means."""
    return entries.map_values(_read(spark, sf_dir, "jd_criteria"), "criteria_id", ["must_have_skills", "nice_to_have_skills"], _read(spark, sf_dir, "skill_taxonomy"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those that aren't equal to a canonical name."""
    names = _read(spark, sf_dir, "skill_taxonomy").select(F.col("canonical").alias("value"))
    return p2_mapped(spark, sf_dir).join(names, "value", "left_anti").select("criteria_id", "field_name", "pos", "skill_id")


def p2_unlisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no skill of the taxonomy, for whoever keeps it."""
    return entries.unlisted(p2_mapped(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values that aren't in the consistent form."""
    return one_form.consistent_values(_read(spark, sf_dir, "resumes")).select("resume_id", "path")


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values with their consistent form."""
    return one_form.consistent_values(_read(spark, sf_dir, "resumes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of personal information in the resumes' texts."""
    return pii.personal_information(_read(spark, sf_dir, "resumes")).select("resume_id", "json_column", "path", "kind", "start_pos")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold some, with placeholders."""
    return pii.redacted_texts(_read(spark, sf_dir, "resumes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String values longer than 2,000 characters: those that come out as pieces."""
    return p5_pieces(spark, sf_dir).filter("piece = 0").select("item_kind", "item_key", "path")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their pieces."""
    return splitting.split_resumes(_read(spark, sf_dir, "resumes"), _read(spark, sf_dir, "job_postings"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(_read(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or piece of one, in a container of 1,024 tokens."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are or hold leftovers of templates, filler, error pages or script notices."""
    return residue.residue(_read(spark, sf_dir, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without those."""
    return residue.without_residue(_read(spark, sf_dir, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_mapped, p2_unlisted, p3_found, p3_values, p4_found, p4_redacted, p5_found, p5_pieces, p7_ids, p8_containers, p9_found, p9_kept)}

SQL: dict[str, str] = {
    "p1_found": """
        WITH s AS (SELECT DISTINCT score_id, session_id, candidate_id, final_pre_llm FROM resume_scores WHERE final_pre_llm IS NOT NULL AND NOT isnan(final_pre_llm)),
        j AS (SELECT DISTINCT session_id, job_id FROM ranking_sessions WHERE job_id IS NOT NULL)
        SELECT job_id, score_id FROM s JOIN j USING (session_id)
        QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY final_pre_llm DESC, candidate_id ASC NULLS FIRST, score_id ASC) <= 10
    """,
    "p5_found": """
        WITH r AS (SELECT resume_id, CASE WHEN json_valid(parsed_data_json) THEN parsed_data_json END AS j FROM resumes),
        t AS (SELECT resume_id, x.fullkey AS k, x.atom ->> '$' AS v FROM r, json_tree(r.j) AS x WHERE x.type = 'VARCHAR')
        SELECT 'resume' AS item_kind, resume_id::VARCHAR AS item_key, replace(substr(k, 3), '"', '') AS path FROM t WHERE length(v) > 2000
        UNION ALL
        SELECT 'job_posting', job_id, 'description' FROM job_postings WHERE length(description) > 2000
    """,
}
