"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, item: str, subgroups: int = 16) -> DataFrame:
    """Keeps the n first items of each group; all of a smaller group. Adds nothing and drops no column.

    group: columns of the group (null is a group of its own). order: a total order of items, ties broken by an identifier.
    item: the identifier; rows that share it within a group are one item, of which one row stays. They have to agree in what the
    order looks at (those that don't take a place each before they are merged).

    A group is hashed on the identifier into subgroups. Rows of the n first places of a subgroup are kept, repeated ones on
    one place; each task does so with its own rows before the first shuffle, which thus carries at most n places a subgroup and task.
    Then repeated rows are merged, and the survivors ranked: at most n * subgroups rows of a group, however many it had.
    Empty input gives empty output. Columns named like the two helper columns are kept apart.
    """
    salt, pos = _free(df, "salt"), _free(df, "pos")
    first = Window.partitionBy(*group, salt).orderBy(*order)
    last = Window.partitionBy(*group).orderBy(*order)
    salted = df.withColumn(salt, F.pmod(F.xxhash64(item), F.lit(subgroups)))
    best = salted.withColumn(pos, F.dense_rank().over(first)).filter(F.col(pos) <= n).drop(pos)  # limited by group before the exchange too
    # hash partitioning on (group, salt) also serves the grouping on (group, salt, item): no further shuffle
    rest = [c for c in df.columns if c not in {*group, item}]
    one = best.groupBy(*group, salt, item).agg(*[F.first(c).alias(c) for c in rest]) if rest else best.dropDuplicates([*group, salt, item])
    return one.drop(salt).withColumn(pos, F.row_number().over(last)).filter(F.col(pos) <= n).drop(pos).select(*df.columns)


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = "_" + name
    return name


def best_scores(scores: DataFrame, sessions: DataFrame, n: int = 10, subgroups: int = 16) -> DataFrame:
    """(job_id, score_id) of the n best scores of each job.

    Scores whose final_pre_llm is null or NaN, whose session is unknown or has no job take no part. Order: final_pre_llm
    descending, candidate_id ascending (null first), score_id ascending. A session given twice for one job counts once.
    """
    good = scores.filter(F.col("final_pre_llm").isNotNull() & ~F.isnan("final_pre_llm") & F.col("session_id").isNotNull() & F.col("score_id").isNotNull())
    jobs = sessions.filter(F.col("job_id").isNotNull() & F.col("session_id").isNotNull()).select("session_id", "job_id").distinct()
    # the sessions are broadcast only if Spark's own size limit allows it; else a sort-merge join, split by AQE where skewed
    joined = good.select("session_id", "score_id", "candidate_id", "final_pre_llm").join(jobs, "session_id")
    order = [F.col("final_pre_llm").desc(), F.col("candidate_id").asc(), F.col("score_id").asc()]
    return top_n_per_group(joined.drop("session_id"), ["job_id"], order, n, "score_id", subgroups).select("job_id", "score_id")
