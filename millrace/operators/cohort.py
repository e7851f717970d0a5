"""Positions within a cohort, cohort statistics, comparison of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier(score: Column) -> Column:
    """A label for a score in [0, 1]."""
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "strong").when(score >= 0.4, "moderate").otherwise("limited")


def recommendation(score: Column, coverage: Column) -> Column:
    """advance, consider or hold, by score and coverage together."""
    return F.when((score >= 0.80) & (coverage >= 0.70), "advance").when((score >= 0.55) & (coverage >= 0.50), "consider").otherwise("hold")


def composite(semantic: Column, pair: Column, lexical: Column) -> Column:
    """The weighted score 0.5 semantic + 0.3 pair + 0.2 lexical; a missing part counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round(0.5 * zero(semantic) + 0.3 * zero(pair) + 0.2 * zero(lexical), 9)


def contributions(semantic: Column, pair: Column, lexical: Column) -> Column:
    """struct(semantic, pair, lexical, signal): what each part adds to the weighted score, and whether that is strong (0.7), moderate (0.4) or weak."""
    zero = lambda c, w: F.round(w * F.coalesce(c, F.lit(0.0)), 9)
    total = composite(semantic, pair, lexical)
    return F.struct(zero(semantic, 0.5).alias("semantic"), zero(pair, 0.3).alias("pair"), zero(lexical, 0.2).alias("lexical"), F.when(total >= 0.7, "strong").when(total >= 0.4, "moderate").otherwise("weak").alias("signal"))


def medians(scores: DataFrame, cohort: str, score: str, cells: int = 1000) -> DataFrame:
    """(cohort, n, top, median): the exact median of each cohort, in two passes. First the scores are counted by cell of 1/1000 (combined before
    the shuffle; scores of a range of 1 make at most 1,001 cells a cohort), which tells the cells of the middle ranks; then the values of
    those cells alone are counted. No buffer or task holds a cohort."""
    placed = scores.withColumn("_cell", F.floor(cells * F.col(score)))
    counted = placed.groupBy(cohort, "_cell").agg(F.count("*").alias("_c"), F.max(score).alias("_max"))
    whole, before = Window.partitionBy(cohort), Window.partitionBy(cohort).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"n": F.sum("_c").over(whole), "top": F.max("_max").over(whole), "_before": F.coalesce(F.sum("_c").over(before), F.lit(0))})
    counted = counted.withColumns({"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)})
    middle = counted.filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_c") > F.col("_lo"))).drop("_c", "_max")
    values = placed.join(middle, [cohort, "_cell"]).groupBy(cohort, "_cell", "n", "top", "_before", "_lo", "_hi", score).agg(F.count("*").alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(cohort, "_cell").orderBy(score))
    at = lambda rank: F.min(F.when(F.col("_end") > F.col(rank), F.col(score)))
    ends = values.withColumn("_end", end).groupBy(cohort, "n", "top").agg(at("_lo").alias("_a"), at("_hi").alias("_b"))
    return ends.select(cohort, "n", "top", (F.col("_a") + (F.col("_b") - F.col("_a")) * 0.5).alias("median"))


def positions(scores: DataFrame, cohort: str, score: str, tolerance: float = 0.0005, cells: int = 1000) -> DataFrame:
    """scores with mine (rounded to 0.1 %, halves up), rank, percentile, gap_from_top and above_median within the cohort.

    rank is one more than the scores of the cohort that exceed mine by more than the tolerance. Mine lies on a grid, and of a score
    only the last grid point it exceeds so matters: scores are counted by that point (combined before the shuffle), so that
    the window over a cohort has at most two rows a grid point, however many scores. Rows without a score or cohort take no part.
    """
    s = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(cohort).isNotNull()).withColumn("_k", F.floor(cells * F.col(score) + 0.5)).withColumn("mine", F.col("_k") / cells)
    exceeds = lambda k: k / F.lit(cells) + tolerance < F.col(score)
    k = F.floor(cells * F.col(score) - cells * tolerance) + 1
    last = F.when(exceeds(k), k).when(exceeds(k - 1), k - 1).otherwise(k - 2)  # the division may be off by one
    counts = s.groupBy(cohort, last.alias("_at")).agg(F.count("*").alias("_n"))
    points = s.select(cohort, F.col("_k").alias("_at")).distinct()
    axis = counts.withColumn("_point", F.lit(0)).unionByName(points.select(cohort, "_at", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_point")))
    above = Window.partitionBy(cohort).orderBy(F.col("_at").desc(), "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = axis.withColumn("rank", 1 + F.sum("_n").over(above)).filter("_point = 1").select(cohort, F.col("_at").alias("_k"), "rank")
    out = s.join(ranks, [cohort, "_k"]).join(medians(s, cohort, score), cohort).drop("_k")
    gap = F.greatest(F.lit(0.0), 100 * F.col("top") - 100 * F.col("mine"))
    return out.withColumns(
        {
            "percentile": F.round(100.0 * (F.col("n") - F.col("rank") + 1) / F.col("n"), 6),
            "gap_from_top": F.round(F.when(gap < 1e-6, F.lit(0.0)).otherwise(gap), 6),
            "above_median": 100 * F.col("mine") > 100 * F.col("median"),
        }
    )


def interpolated(score: Column, median: Column, top: Column, n: Column) -> Column:
    """struct(percentile, rank): 50 at the median, 100 at the top, straight between; 50 where the median is 0."""
    p = F.when(score >= top, F.lit(100.0)).when(median == 0, F.lit(50.0)).when(score >= median, 50 + 50 * (score - median) / F.when(top > median, top - median)).otherwise(50 * score / F.when(median != 0, median))
    p = F.round(F.coalesce(p, F.lit(50.0)), 6)
    return F.struct(p.alias("percentile"), (F.floor((100 - p) / 100 * n) + 1).cast("int").alias("rank"))


def compared(rows: DataFrame, cohort: str, key: str, position: str, score: str, skills: str, roles: str) -> DataFrame:
    """All pairs i < j of a short list (three a cohort): winner, margin in points, up to three differences."""
    a = rows.select(cohort, F.col(key).alias("a"), F.col(position).alias("i"), F.col(score).alias("sa"), F.col(skills).alias("ka"), F.col(roles).alias("ra"))
    b = rows.select(cohort, F.col(key).alias("b"), F.col(position).alias("j"), F.col(score).alias("sb"), F.col(skills).alias("kb"), F.col(roles).alias("rb"))
    margin = F.round(F.abs(F.col("sa") - F.col("sb")) * 100, 2)
    only = lambda x, y: F.array_except(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))
    notes: Sequence[Column] = (
        F.when(margin > 5, F.format_string("score differs by %.2f points", margin)),
        F.when(F.size(only(F.col("ka"), F.col("kb"))) > 0, F.concat(F.lit("first only: "), F.array_join(F.slice(F.sort_array(only(F.col("ka"), F.col("kb"))), 1, 3), ", "))),
        F.when(F.size(only(F.col("kb"), F.col("ka"))) > 0, F.concat(F.lit("second only: "), F.array_join(F.slice(F.sort_array(only(F.col("kb"), F.col("ka"))), 1, 3), ", "))),
        F.when(F.abs(F.col("ra") - F.col("rb")) > 1, F.concat(F.lit("roles: "), F.col("ra").cast("string"), F.lit(" and "), F.col("rb").cast("string"))),
    )
    pairs = a.join(b, cohort).filter("i < j")
    winner = F.when(F.col("sa") >= F.col("sb"), F.col("a")).otherwise(F.col("b"))
    return pairs.select(cohort, "a", "b", winner.alias("winner"), margin.alias("margin"), F.array_join(F.slice(F.filter(F.array(*notes), lambda x: x.isNotNull()), 1, 3), "; ").alias("differences"))
