"""Templated text about a candidate, chosen by hashes and thresholds, and its polishing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variant(identity: Column, context: str, templates: Sequence[str]) -> Column:
    """One of the templates, always the same for the same identity and context: the first 32 bits of an MD5 modulo their number."""
    n = F.conv(F.substring(F.md5(F.concat_ws("_", identity, F.lit(context))), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*[F.lit(t) for t in templates]), (n % len(templates)).cast("int"))


def joined(*sentences: Column) -> Column:
    """The sentences that aren't null, one after another."""
    return F.concat_ws(" ", *sentences)


def polished(text: Column) -> Column:
    """Doubled words cut, numbers of one in the singular, one space between words, none before punctuation, one full stop at the end."""
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_])([A-Za-z]+)(?: \1)+(?![A-Za-z0-9_])", "$1")
    text = F.regexp_replace(text, r"(?<![0-9.,])1 (skill|role|year|project|candidate|point)s(?![A-Za-z])", "1 $1")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" +([,.;:!?])", "$1")
    text = F.trim(F.regexp_replace(text, r"\.{2,}", "."))
    return F.when(text.rlike("[.!?]$") | (text == ""), text).otherwise(F.concat(text, F.lit(".")))


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, sentence): the sentences of a text, cut behind . ! ? and white space."""
    cut = F.filter(F.transform(F.split(F.regexp_replace(F.col(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    return df.select(key, F.posexplode(cut).alias("pos", "sentence"))


def near_repeats(rows: DataFrame, key: str, at_least: float = 0.8) -> DataFrame:
    """Sentences whose set of words is at least that similar (Jaccard) to that of one of the two before."""
    ws = rows.withColumn("_w", F.array_distinct(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), F.lit(0)))).filter(F.size("_w") > 0)
    w = Window.partitionBy(key).orderBy("pos")
    alike = lambda n: F.size(F.array_intersect("_w", F.lag("_w", n).over(w))) / F.size(F.array_union("_w", F.lag("_w", n).over(w)))
    return ws.withColumn("_a", F.greatest(F.coalesce(alike(1), F.lit(0.0)), F.coalesce(alike(2), F.lit(0.0)))).filter(F.col("_a") > at_least).select(key, "pos", "sentence", F.round("_a", 6).alias("alike"))


def readability(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_sentences, mean_words, variety): mean words a sentence, distinct words to all."""
    ws = rows.select(key, F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z0-9]+"), F.lit(0)).alias("_w"))
    g = ws.groupBy(key).agg(F.count("*").alias("n_sentences"), F.sum(F.size("_w")).alias("_n"), F.flatten(F.collect_list("_w")).alias("_all"))
    return g.select(key, "n_sentences", F.round(F.col("_n") / F.col("n_sentences"), 6).alias("mean_words"), F.round(F.size(F.array_distinct("_all")) / F.greatest(F.col("_n"), F.lit(1)), 6).alias("variety"))
