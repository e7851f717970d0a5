"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.values import split_values

FIELDS = ("must_have_skills", "industry_experience", "keywords")


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every field, those of fields with one value included."""
    return split_values(spark.read.parquet(f"{sf_dir}/jd_criteria_raw.parquet"), "post_id", FIELDS).drop("n_values")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value of a field that holds two or more."""
    all_values = split_values(spark.read.parquet(f"{sf_dir}/jd_criteria_raw.parquet"), "post_id", FIELDS)
    return all_values.filter(F.col("n_values") >= 2).select("post_id", "field_name", "pos", "item")


QUERIES = {f.__name__: f for f in (p6_found, p6_values)}
SQL: dict[str, str] = {}
