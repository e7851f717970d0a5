"""Requirement texts: sections, required skills, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .criteria import REQUIRED, WISHED

def jd_title(title: Column, text: Column) -> Column:
    """The title if given, else the text's first line of 4 to 99 characters."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 4) & (F.length(x) <= 99))
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.get(lines, F.lit(0)))


#: What a title stands behind, in the order tried.
TITLE_LABELS = ("job title", "position", "role", "we are looking for", "seeking", "hiring")


def labelled_title(title: Column, text: Column) -> Column:
    """The title if given, else what stands behind the first label of TITLE_LABELS that gives over three characters without punctuation,
    else the text's first line as in jd_title."""
    behind = [F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, rf"(?i)\b{x}[:\s]+([^\n]+)", 1)), r"(?U)[^\w\s-]", "")) for x in TITLE_LABELS]
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), *[F.when(F.length(b) > 3, b) for b in behind], jd_title(title, text))


def must_have(skills: DataFrame, key: str, text: str, surface: str, most: int = 8) -> DataFrame:
    """(key, surface, n, score, pos): the skills a text requires, the best few.

    skills holds a row for each skill named in a text, with the text. A score is 0.15 a mention as a whole word up to 0.6, 0.25 for each
    mention with a word of requiring in the 100 characters before or 50 behind, less 0.4 for each with one of wishing, and 0.15 if the
    skill stands in the first half. Scores above 0.3 are kept; a skill named by a variant alone would have 0.3 at most.
    """
    word, low, skill = f"[{T.W}]", F.lower(F.col(text)), F.col(surface)
    k = F.length(skill)

    def contexts(parts: Column) -> Column:
        """What stands around each mention whose neighbours are no word characters; parts is the text cut at the skill."""
        before = lambda j: F.when((F.get(parts, j) == "") & (j > 0), F.right(skill, F.lit(1))).otherwise(F.right(F.get(parts, j), F.lit(1)))
        behind = lambda j: F.when((F.get(parts, j + 1) == "") & (j + 2 < F.size(parts)), F.left(skill, F.lit(1))).otherwise(F.left(F.get(parts, j + 1), F.lit(1)))
        whole = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda j: (F.size(parts) > 1) & ~before(j).rlike(word) & ~behind(j).rlike(word))
        at = lambda j: F.aggregate(F.slice(parts, F.lit(1), j + 1), F.lit(0), lambda a, x: a + F.length(x)) + j * k
        return F.transform(F.transform(whole, at), lambda p: F.substring(low, F.greatest(p - 100, F.lit(0)) + 1, F.least(p, F.lit(100)) + k + 50))

    def told(around: Column) -> Column:
        count = lambda words: F.size(F.filter(around, lambda c: c.rlike(words)))
        first_half = F.left(low, F.floor(F.length(low) / 2).cast("int")).contains(skill)
        score = F.round(F.least(0.15 * F.size(around), F.lit(0.6)) + 0.25 * count(REQUIRED) - 0.4 * count(WISHED) + F.when(first_half, 0.15).otherwise(0.0), 6)
        return F.struct(F.size(around).alias("n"), score.alias("score"))

    parts = F.split(low, F.concat(F.lit("\\Q"), skill, F.lit("\\E")), -1)
    one = T.let(parts, lambda p: T.let(contexts(p), told))
    # exploded, so that the filter behind isn't pushed into the expression and makes it be computed again
    scored = skills.select(key, surface, F.explode(F.array(one)).alias("_t")).select(key, surface, "_t.n", "_t.score").filter("n > 0 AND score > 0.3")
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col(surface))
    return scored.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= most)


def jd_text(title: Column, years: Column, must: Column, nice: Column, location: Column, summary: Column) -> Column:
    """A requirement text made of a form's fields, a labelled line for each that is filled."""
    line = lambda label, c: F.when(c != "", F.concat(F.lit(label + ": "), c))
    listed = lambda c: F.array_join(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), ", ")
    return F.concat_ws("\n", line("Position", title), F.when(years > 0, F.concat(F.lit("Experience: "), years.cast("string"), F.lit("+ years"))), line("Must have", listed(must)), line("Nice to have", listed(nice)), line("Location", location), summary)


def looks_like_sentence(c: Column) -> Column:
    """Whether a field was filled with prose: over six words and a full stop, or twenty characters and a telling word."""
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))
    return F.coalesce(((words > 6) & c.rlike("[.!?]")) | ((F.length(c) >= 20) & F.lower(c).rlike("(?:^|[^a-z])(?:we|you|should|must|looking|with|need)(?:$|[^a-z])")), F.lit(False))
