"""Evidence for required skills from three sources, the best example, and how far a statement can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The least confidence of evidence, that of a mention in a text, the most of a pair score, and the order of sources.
LEAST, MENTION, MOST, SOURCES = 0.6, 0.6, 0.95, {"ce_pair": 3, "skill_inference": 2, "text_match": 1}
_NONE = "cast(null as string)"


def best_skill(required: Column, context: Column) -> Column:
    """The first required skill that the context holds, whatever its case, else the first; 'relevant experience' if none is required."""
    held = F.filter(required, lambda s: F.lower(context).contains(F.lower(s)))
    return F.coalesce(F.get(held, F.lit(0)), F.get(required, F.lit(0)), F.lit("relevant experience"))


def experience_text(role: Column, company: Column, description: Column) -> Column:
    """What a role is told of as: title, company and the start of its description."""
    head = F.concat(F.coalesce(role, F.lit("")), F.lit(" experience at "), F.coalesce(company, F.lit("")))
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(head, F.lit(": "), F.left(description, F.lit(100)), F.lit("..."))).otherwise(head)


def middle_quote(c: Column, words: int = 8, size: int = 6) -> Column:
    """The text if it has at most that many words, else the `size` in its middle."""
    ws = F.filter(F.split(c, f"[{T.WS}]+"), lambda x: x != "")
    n = F.size(ws)
    return F.when(n <= words, c).otherwise(F.array_join(F.slice(ws, F.greatest(F.floor(n / 2).cast("int") - 3, F.lit(0)) + 1, F.lit(size)), " "))


def statement_confidence(source: Column, confidence: Column) -> Column:
    """What a claim may be trusted: pair scores over 0.7 a tenth more, up to 0.95; mentions a tenth less; else as it is."""
    return F.when((source == "ce_pair") & (confidence > 0.7), F.least(F.lit(MOST), confidence + 0.1)).when(source == "text_match", F.greatest(F.lit(0.0), confidence - 0.1)).otherwise(confidence)


def of_pairs(candidates: DataFrame, key: str, score: str, required: str, role: str, company: str, description: str) -> DataFrame:
    """Evidence of a pair score over 0.5, on the first role, for the required skill it fits best."""
    told = experience_text(F.col(role), F.col(company), F.col(description))
    skill = best_skill(F.col(required), F.concat_ws(" ", role, description))
    good = candidates.filter((F.col(score) > 0.5) & F.col(role).isNotNull() & (F.size(required) > 0))
    return good.select(key, F.lit("ce_pair").alias("source"), skill.alias("skill"), F.least(F.lit(MOST), F.col(score)).alias("confidence"), told.alias("text"), F.lit("experience").alias("section"), F.col(company).alias("company"), F.col(role).alias("role"), middle_quote(told).alias("micro_quote"))


def of_inference(inferred: DataFrame, key: str) -> DataFrame:
    """Evidence of inferred skills (key, skill, section, score)."""
    return inferred.select(key, F.lit("skill_inference").alias("source"), "skill", F.col("score").alias("confidence"), F.concat(F.lit("Found in "), "section", F.lit(" section")).alias("text"), "section", F.expr(_NONE).alias("company"), F.expr(_NONE).alias("role"), F.expr(_NONE).alias("micro_quote"))


def of_texts(sections: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Evidence of required skills (key, skill) named in sections (key, section, text), whatever their case."""
    met = sections.join(wanted, key).filter(F.lower("text").contains(F.lower("skill")))
    return met.select(key, F.lit("text_match").alias("source"), "skill", F.lit(MENTION).alias("confidence"), F.concat(F.lit("Named in "), "section").alias("text"), "section", F.expr(_NONE).alias("company"), F.expr(_NONE).alias("role"), T.quote_of(F.col("text")).alias("micro_quote"))


def collected(*sources: DataFrame) -> DataFrame:
    """All evidence of the sources with a confidence of 0.6 or more, and what a claim on it may be trusted."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.filter(F.col("confidence") >= LEAST).withColumn("statement", F.round(statement_confidence(F.col("source"), F.col("confidence")), 6))


def best_example(evidence: DataFrame, key: str, required: DataFrame) -> DataFrame:
    """The best piece of evidence of each key: of a required skill (key, skill) if there is any; by confidence, then source, then skill and section."""
    critical = evidence.join(required.select(key, "skill", F.lit(1).alias("_critical")), [key, "skill"], "left").withColumn("_critical", F.coalesce("_critical", F.lit(0)))
    source = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])[F.col("source")]
    w = Window.partitionBy(key).orderBy(F.col("_critical").desc(), F.col("confidence").desc(), source.desc(), "skill", "section")
    return critical.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_critical")
