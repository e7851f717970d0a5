"""Profiles of careers: seniority, progression, specialization, leadership."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell a level, from the lowest to the highest.
LEVELS = {
    "intern": ("intern", "internship", "trainee", "apprentice"),
    "junior": ("junior", "entry", "associate", "assistant", "new grad", "recent grad", "graduate"),
    "mid": ("mid", "middle", "intermediate", "developer", "engineer", "analyst", "specialist"),
    "senior": ("senior", "principal", "lead", "architect", "expert", "consultant"),
    "lead": ("lead", "team lead", "tech lead", "manager", "head of", "director"),
    "staff": ("staff", "distinguished", "fellow", "chief", "vp", "vice president"),
}
# Words of specializations.
SPECIALIZATIONS = {
    "backend": ("backend", "server", "api", "microservices", "database", "sql", "postgresql", "mysql", "mongodb", "redis", "node.js", "java", "python", "go", "rust", "c++"),
    "frontend": ("frontend", "front-end", "ui", "ux", "user interface", "user experience", "web", "html", "css", "javascript", "typescript", "react", "angular", "vue", "svelte"),
    "devops": ("devops", "dev-ops", "ci/cd", "deployment", "kubernetes", "docker", "aws", "azure", "gcp", "terraform", "ansible", "jenkins", "monitoring", "logging"),
    "data": ("data", "analytics", "machine learning", "ml", "ai", "artificial intelligence", "statistics", "python", "r", "sql", "tableau", "power bi", "tensorflow", "pytorch", "scikit-learn"),
    "mobile": ("mobile", "ios", "android", "swift", "kotlin", "flutter", "react native", "ionic"),
    "security": ("security", "cybersecurity", "penetration", "vulnerability", "threat", "risk", "compliance"),
}
# Words of leading, of rare qualifications, of technical depth in projects and in roles.
LEADERSHIP = ("led", "managed", "mentored", "coached", "trained", "guided", "directed", "oversaw", "supervised", "coordinated", "facilitated", "team of", "group of", "department")
RARE = ("phd", "doctorate", "patent", "publication", "published", "research", "thesis", "dissertation", "conference", "speaker", "keynote", "award", "honor", "distinction", "excellence")
DEPTH_OF_PROJECTS = ("architecture", "scalable", "distributed", "microservices")
DEPTH_OF_ROLES = ("architected", "designed", "implemented", "optimized")


def plain(words: Sequence[str]) -> tuple[list[str], list[str]]:
    """Words of letters and digits, and those with spaces or signs, quoted for a regular expression."""
    return [w for w in words if w.isalnum()], [re.sub(r"([.+])", r"\\\1", w) for w in words if not w.isalnum()]


def pattern(words: Sequence[str]) -> str:
    """A regular expression of whole words, ASCII, for lower-case text."""
    single, other = plain(words)
    return rf"(?:^|[^a-z0-9_])(?:{'|'.join([*single, *other])})(?:$|[^a-z0-9_])"


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many words of the text are among the words; phrases and words with signs are counted as well."""
    low = F.lower(text)
    single, other = plain(words)
    count = lambda ws: F.regexp_count(low, F.lit(rf"(?<![a-z0-9_])(?:{'|'.join(ws)})(?![a-z0-9_])"))
    return F.coalesce(count(single) + count(other) if other else count(single), F.lit(0))


def first_of(counts: Mapping[str, Column]) -> Column:
    """The first name with the highest count; null if all are 0."""
    best = F.greatest(*counts.values())
    out = F.lit(None).cast("string")
    for name, n in reversed(counts.items()):
        out = F.when(n == best, F.lit(name)).otherwise(out)
    return F.when(best > 0, out)


def seniority(df: DataFrame, text: str, n_roles: str, name: str = "level") -> DataFrame:
    """df with the level most told of; by the number of roles if none is; then raised where many roles contradict it.

    The counts are columns of their own, so that each is taken once a row.
    """
    n = F.col(n_roles)
    counted = df.withColumns({f"_{k}": hits(F.col(text), v) for k, v in LEVELS.items()})
    told = first_of({k: F.col(f"_{k}") for k in LEVELS})
    counted = counted.withColumn("_base", F.coalesce(told, F.when(n == 0, "intern").when(n <= 2, "junior").when(n <= 4, "mid").otherwise("senior")))
    base = F.col("_base")
    level = F.when((base == "intern") & (n > 1), "junior").when((base == "junior") & (n > 3), "mid").when((base == "mid") & (n > 5), "senior").otherwise(base)
    return counted.withColumn(name, level).drop("_base", *[f"_{k}" for k in LEVELS])


def title_level(title: Column) -> Column:
    """0-based level of a title: the lowest level of which it has a word; null for none."""
    out = F.lit(None).cast("int")
    for i, (_, words) in reversed(list(enumerate(LEVELS.items()))):
        out = F.when(F.lower(title).rlike(pattern(words)), F.lit(i)).otherwise(out)
    return out


def progression(roles: DataFrame, key: str) -> DataFrame:
    """(key, n_roles, promotions, trend, velocity): rises of the title's level from one entry to the next, in the order given."""
    w = Window.partitionBy(key).orderBy("pos")
    steps = roles.withColumn("_level", title_level(F.col("title"))).withColumn("_next", F.lead("_level").over(w))
    out = steps.groupBy(key).agg(F.count("*").alias("n_roles"), F.count_if(F.col("_next") > F.col("_level")).alias("promotions"))
    trend = F.when(F.col("promotions") >= 2, "ascending").when(F.col("promotions") == 1, "moderate").otherwise("stable")
    return out.withColumn("trend", trend).withColumn("velocity", F.round(F.col("promotions") / (2 * F.col("n_roles")), 6))


def specialization(df: DataFrame, text: str) -> DataFrame:
    """df with primary, kind, confidence, signals: the specialization most told of, if told often enough and beside another."""
    counted = df.withColumns({f"_{k}": hits(F.col(text), v) for k, v in SPECIALIZATIONS.items()})
    counts = {k: F.col(f"_{k}") for k in SPECIALIZATIONS}
    top, total = F.greatest(*counts.values()), sum(counts.values(), F.lit(0))
    signals = sum((F.when(n > 0, 1).otherwise(0) for n in counts.values()), F.lit(0))
    confidence = F.least(top / F.lit(5.0), F.lit(1.0))
    enough = (confidence >= 0.5) & (signals >= 2)
    out = {
        "primary": F.when(enough, first_of(counts)),
        "kind": F.when(~enough, "unknown").when(top / total > 0.6, "specialist").otherwise("generalist"),
        "confidence": F.when(enough, confidence).otherwise(F.lit(0.0)),
        "signals": signals,
    }
    return counted.withColumns(out).drop(*[f"_{k}" for k in SPECIALIZATIONS])


def leadership(roles: DataFrame, key: str) -> DataFrame:
    """(key, n_indicators, level, mean_team, manages): titles and bullets that tell of leading, and sizes of teams told."""
    lines = roles.select(key, F.explode(F.concat(F.array("title"), F.coalesce("bullets", F.array().cast("array<string>")))).alias("line")).filter("line IS NOT NULL")
    size = F.regexp_extract(F.lower("line"), r"team of ([0-9]{1,9})", 1).try_cast("int")
    out = lines.groupBy(key).agg(F.count_if(F.lower("line").rlike(pattern(LEADERSHIP))).alias("n_indicators"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 6).alias("mean_team"), (F.count(size) > 0).alias("manages"))
    return out.withColumn("level", F.when(F.col("n_indicators") == 0, "none").when(F.col("n_indicators") >= 3, "extensive").otherwise("some"))


def rare_qualifications(text: Column) -> Column:
    """The rare qualifications a text names, sorted."""
    words = RARE
    return F.sort_array(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w.isin(*words))))


def technical_depth(projects: Column, bullets: Column) -> Column:
    """high, moderate or basic, by projects with three technologies, projects and bullets that tell of design: four or more, two or more, fewer."""
    told = lambda text, words: F.lower(text).rlike("|".join(words))
    of_projects = F.aggregate(projects, F.lit(0), lambda n, p: n + F.when(F.size(p["technologies"]) >= 3, 1).otherwise(0) + F.when(told(p["summary"], DEPTH_OF_PROJECTS), 1).otherwise(0))
    n = F.coalesce(of_projects, F.lit(0)) + F.coalesce(F.size(F.filter(bullets, lambda b: told(b, DEPTH_OF_ROLES))), F.lit(0))
    return F.when(n >= 4, "high").when(n >= 2, "moderate").otherwise("basic")


def career_stage(level: Column, trend: Column) -> Column:
    """early, growing, established or mid, by the level and the trend of titles."""
    return F.when(level.isin("intern", "junior"), "early").when((level == "mid") & (trend == "ascending"), "growing").when(level.isin("senior", "lead", "staff"), "established").otherwise("mid")
