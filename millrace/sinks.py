"""Sinks: exports as JSON and CSV, rendered text, tables that are added to, overwritten or rid of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .session import written

SCHEMA_VERSION = "2.1"


def json_safe(df: DataFrame) -> DataFrame:
    """df as JSON can hold it: booleans as 0 and 1, NaN and infinite numbers as null, texts without null."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, t.BooleanType):
            out[f.name] = c.cast("int")
        elif isinstance(f.dataType, (t.DoubleType, t.FloatType)):
            out[f.name] = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, t.StringType):
            out[f.name] = F.coalesce(c, F.lit(""))
    return df.withColumns(out)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row."""
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A header and a line a row; lists joined by |, doubles with six decimals."""
    flat = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, t.ArrayType):
            flat[f.name] = F.array_join(F.transform(f"`{f.name}`", lambda x: x.cast("string")), "|")
        elif isinstance(f.dataType, (t.DoubleType, t.FloatType)):
            flat[f.name] = F.format_string("%.6f", F.col(f"`{f.name}`").cast("double"))
    df.withColumns(flat).write.mode(mode).option("header", True).csv(path)


def written_with(df: DataFrame, path: str, columns: dict[str, Column]) -> DataFrame:
    """The table at the path with columns added to what df gives: written beside it first, as a table can't be overwritten while it is read."""
    beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.withColumns(columns).write.parquet(beside)
    df.sparkSession.read.parquet(beside).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the rows of changes in place of those of the same key, and added where there are none: an anti join and a union."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """table without the rows of the keys."""
    return table.join(keys.select(key), key, "left_anti")


def rendered(header: Column, items: Column) -> Column:
    """A section as plain text: its header between dashes, then its items, one a line."""
    return F.concat(F.lit("--- "), header, F.lit(" ---\n"), F.array_join(items, "\n"))


def top_three(ranked: DataFrame, rank: str, name: str, score: str) -> DataFrame:
    """The three first of a ranking as lines of a summary."""
    first = ranked.orderBy(rank, name).limit(3)
    return first.select(F.format_string("%d. %s (%.2f)", F.col(rank), F.col(name), 100 * F.col(score)).alias("line"))


def assembled(candidates: DataFrame, key: str, cohort: str, job: Column, score: str, order: list[Column], fields: list[str]) -> DataFrame:
    """(cohort, body): one nested JSON text a cohort: schema version, job, counts and mean, then the candidates in order, each with its rank.

    A cohort is one text, so that it must fit a row; write the candidates by `write_json` where cohorts are large.
    """
    from pyspark.sql import Window

    safe = json_safe(candidates.select(cohort, key, score, *fields, job.alias("_job")))
    ranked = safe.withColumn("rank", F.row_number().over(Window.partitionBy(cohort).orderBy(*order)))
    one = F.struct(F.col("rank"), F.col(key), F.col(score), *fields)
    body = F.struct(F.lit(SCHEMA_VERSION).alias("schema"), F.first("_job").alias("job"), F.struct(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.max(score).alias("top")).alias("batch"), F.sort_array(F.collect_list(one)).alias("candidates"))
    return ranked.groupBy(cohort).agg(F.to_json(body).alias("body"))


def with_fallback(body: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """body where it could be made; else the raw row as JSON."""
    return raw.select(key, F.to_json(F.struct("*")).alias("_raw")).join(body, key, "left").select(key, F.coalesce("body", "_raw").alias("body"))


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """df written once in the shared folder."""
    return written(df, name)
