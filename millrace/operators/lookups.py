"""Lookups, guards and orders of result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The rows whose key, as a string, is the value; where there are none, one row of nulls. Column _message tells which it is."""
    asked = df.sparkSession.createDataFrame([(str(value),)], "_id string")
    found = df.withColumn("_id", F.col(key).cast("string")).filter(F.col("_id") == str(value)).withColumn("_message", F.lit("found"))
    return asked.join(found, "_id", "left").withColumn("_message", F.coalesce("_message", F.concat(F.lit("not found: "), F.col("_id"))))


def of_ids(df: DataFrame, key: str, ids: Sequence[object], most: int = 3) -> DataFrame:
    """The first row of each of the first `most` ids, in the order asked (column pos): what is compared side by side."""
    asked = df.sparkSession.createDataFrame([(i, str(v)) for i, v in enumerate(list(dict.fromkeys(map(str, ids)))[:most])], "pos int, _id string")
    first = Window.partitionBy("_id").orderBy(*[F.col(c) for c in df.columns if c != key][:1] or [F.col("_id")])
    rows = df.withColumn("_id", F.col(key).cast("string")).filter(F.col("_id").isin(*[str(v) for v in ids])).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return asked.join(rows, "_id").drop("_id")


def guarded(df: DataFrame, most: int = 25, requirement: str | None = None) -> DataFrame:
    """df if it has at most `most` rows and there is a requirement text; else a ValueError, before any work is done."""
    if requirement is not None and not requirement.strip():
        raise ValueError("the requirement text is empty")
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a batch has at most {most} items")
    return df


def by_rank(rank: Column, score: Column) -> list[Column]:
    """The order of a list: by rank, those without one (null or 0) last, then the higher score."""
    return [F.nullif(rank, F.lit(0)).asc_nulls_last(), score.desc_nulls_last()]


def by_metric(metric: Column, *ties: Column, name: Column) -> list[Column]:
    """The order by one metric descending; ties by further ones descending, then by name."""
    return [metric.desc_nulls_last(), *[t.desc_nulls_last() for t in ties], name.asc()]


def numbered(df: DataFrame, order: Sequence[Column], partition: Sequence[str], name: str = "place") -> DataFrame:
    """df with the place of each row in the order within its partition, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
