"""Explicit schemas of JSON columns, and readers that treat what can't be parsed as an empty object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

PARSED = (
    "experience array<struct<title:string,company:string,dates:string,description:string,bullets:array<string>>>, education array<struct<degree:string,school:string,year:string>>, "
    "projects array<struct<name:string,summary:string,technologies:array<string>>>, skills array<struct<skill:string>>, misc string, raw_text string"
)
PROCESSED = "summary string, notes array<string>, fallback_flags array<string>"


def json_or_empty(column: str, schema: str) -> Column:
    """The column parsed with the schema; null where the text isn't JSON as a whole."""
    return F.when(F.try_parse_json(column).isNotNull(), F.from_json(column, schema))


def resumes(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """resume_id, candidate_id and the given fields of parsed_data_json. Fields not asked for aren't parsed."""
    df = spread(spark.read.parquet(f"{sf_dir}/resumes.parquet").select("resume_id", "candidate_id", "parsed_data_json"))
    parsed = df.select("resume_id", "candidate_id", json_or_empty("parsed_data_json", PARSED).alias("p"))
    return parsed.select("resume_id", "candidate_id", *[F.col(f"p.{f}").alias(f) for f in fields])


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resume_id, pos, title, company, dates, description, bullets): one row for each entry of experience."""
    return resumes(spark, sf_dir, "experience").select("resume_id", F.posexplode("experience").alias("pos", "e")).select("resume_id", "pos", "e.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "job_postings") else df  # texts, on which the work is


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(skill_id, canonical, surface): every surface form of each skill, in lower case; of equal forms the highest skill_id holds."""
    t = table(spark, sf_dir, "skill_taxonomy")
    forms = t.select("skill_id", "canonical", F.explode(F.array_distinct(F.transform(F.concat(F.array("canonical"), F.coalesce("variants", F.array().cast("array<string>"))), lambda x: F.lower(x)))).alias("surface"))
    return forms.groupBy("surface").agg(F.max("skill_id").alias("skill_id"), F.max_by("canonical", "skill_id").alias("canonical"))


def domain_files(spark: SparkSession, path: str) -> DataFrame:
    """(domain, canonical, surface) of taxonomy files: one JSON object of canonical -> list of forms each. Files that can't be
    parsed, and entries that aren't lists, give nothing; a folder without files an empty frame."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("domain"), "value")
    parsed = raw.select("domain", F.from_json(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), "map<string,array<string>>").alias("m"))
    return parsed.select("domain", F.explode("m").alias("canonical", "forms")).select("domain", "canonical", F.explode("forms").alias("surface"))
