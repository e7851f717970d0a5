"""Requirements out of postings and criteria forms: sections, lists, prose or tokens, summaries, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching as M

# Words that end a section of a posting.
_HEADS = {"experience": "skills|responsibilities|education|requirements|qualifications", "asked": "requirements|qualifications|education|responsibilities"}
_ALL = "requirements|qualifications|experience|skills|responsibilities"
# For each field of a posting the words it starts with, tried in this order, and the words that end it.
SECTIONS = {
    "experience": [(w, _HEADS["experience"]) for w in ("experience", "years? of experience", "required experience", "experience level")] + [(w, _HEADS["asked"]) for w in ("experience in", "with experience in", "looking for", "seeking", "candidate with")],
    "skills": [(w, "responsibilities|education|requirements|qualifications|experience") for w in ("skills", "technical skills", "required skills", "qualifications")] + [(w, _HEADS["asked"]) for w in ("experience in", "with experience in", "looking for", "proficiency in")] + [("knowledge of", "responsibilities|education|requirements|qualifications|experience")] + [(w, _HEADS["asked"]) for w in ("must have", "should have", "candidate should")],
    "responsibilities": [(w, "education|requirements|qualifications|experience|skills") for w in ("responsibilities", "duties", "what you''ll do", "key responsibilities")],
    "education": [(w, _ALL) for w in ("education", "degree", "educational requirements", "academic")],
    "company": [(w, _ALL + "|education") for w in ("about us", "company", "our team", "we are")],
    "location": [(w, _ALL + "|education|company") for w in ("location", "based in", "remote", "office")],
}
FIELDS = {"experience_required": "experience", "skills_required": "skills", "responsibilities": "responsibilities", "education": "education", "company_description": "company", "location": "location"}
LABEL = rf"^(?:experience|skills|responsibilities|education|company|location)[:{T.WS}]*"
# What a job's title stands behind, in the order tried.
TITLES = ("job title", "position", "role", "we are looking for", "seeking", "hiring")
# What tells that a field holds a sentence, of 20 characters or more; of more than four words; and that a token is none.
TELLS_SENTENCE = "we are|we''re|looking for|should be|must have|experience with|knowledge of|proficiency in|familiar with|comfortable with|working with|you will|the candidate|responsible for|ability to|understanding of|essential|required|preferred"
TELLS_PROSE = "must have|should have|need to|able to|experience with|experience in|knowledge of|proficiency in|familiar with|working with|required|preferred|understanding of|we are|looking for|responsible for|will be|you will|the candidate"
NO_TOKEN = "we are|we''re|looking for|should be|must have|experience with|knowledge of|proficiency in|familiar with|comfortable with|working with|using|for|and|or"
KNOWN_TOKENS = ("sql server", "asp.net", "c++", "c#", "node.js", "react native", "spring boot", "ruby on rails", "chart.js", "ci/cd")
# A broad skill and what it stands for.
BROAD = {"api": ("openapi", "swagger", "rest")}
# Ten skills looked for anywhere in a posting, by their forms.
TOP = {
    "SKILL_001": ("react", "reactjs", "react.js"), "SKILL_002": ("python", "python3"), "SKILL_003": ("javascript", "js", "ecmascript"), "SKILL_004": ("java",), "SKILL_005": ("sql", "mysql", "postgresql", "database"),
    "SKILL_006": ("aws", "amazon web services", "cloud"), "SKILL_007": ("docker", "containerization"), "SKILL_008": ("kubernetes", "k8s"), "SKILL_009": ("git", "version control"), "SKILL_010": ("machine learning", "ml", "ai", "artificial intelligence"),
}
# What stands around a skill that is required, or a mere wish.
REQUIRED = r"required[:\s]|must[\s-]?have|essential|mandatory|requirements?[:\s]|qualifications?[:\s]|we\srequire|strong\s(?:knowledge|experience|skills?)|proven\s(?:experience|track)|proficiency\sin|expert\sin|hands[\s-]?on\sexperience"
WISHED = r"nice[\s-]?to[\s-]?have|preferred|bonus|plus|advantageous|desirable|ideally|would\sbe\s(?:nice|great|good)|familiarity\swith|exposure\sto"


def _py(pattern: str) -> str:
    """A pattern without the doubled quotes of SQL."""
    return pattern.replace("''", "'")


def collapsed(c: Column) -> Column:
    return T.trimmed(F.regexp_replace(c, f"[{T.WS}]+", " "))


def section_of(text: Column, name: str) -> Column:
    """The section of a lower-case posting: from the first of its words that gives over ten characters to the next head; '' for none."""
    raw = F.array(*[F.regexp_extract(text, rf"({_py(start)}[\s\S]*?)(?:{stop}|\z)", 1) for start, stop in SECTIONS[name]])
    tries = F.transform(raw, lambda x: collapsed(F.regexp_replace(T.trimmed(x), LABEL, "")))
    return F.coalesce(F.get(F.filter(tries, lambda t: F.length(t) > 10), F.lit(0)), F.lit(""))


def title_of(text: Column) -> Column:
    """The title in a lower-case posting: behind the first label that gives over three characters, else its first line of 4 to 99; '' for none."""
    bare = lambda c: F.regexp_replace(c, rf"[^{T.W}{T.WS}-]", "")
    behind = F.transform(F.array(*[F.regexp_extract(text, rf"{label}[:{T.WS}]+([^\n]+)", 1) for label in TITLES]), lambda x: bare(T.trimmed(x)))
    first = T.trimmed(F.get(F.split(text, "\n"), F.lit(0)))
    return F.coalesce(F.get(F.filter(behind, lambda t: F.length(t) > 3), F.lit(0)), F.when((F.length(first) < 100) & (F.length(first) > 3), bare(first)), F.lit(""))


def posting_fields(text: Column) -> dict[str, Column]:
    """The seven fields of a posting. Where no skills are given, its experience stands in for them."""
    low = T.trimmed(F.lower(text))
    out = {"job_title": title_of(low)} | {field: section_of(low, name) for field, name in FIELDS.items()}
    out["skills_required"] = F.when(out["skills_required"] != "", out["skills_required"]).otherwise(out["experience_required"])
    return out


def safe_int(c: Column, default: int = 0) -> Column:
    """The digits and signs of a text as a number; the default where they make none."""
    return F.coalesce(F.regexp_replace(c, "[^0-9-]", "").try_cast("int"), F.lit(default))


def list_of(c: Column, prefer_newlines: bool = False) -> Column:
    """A text as a list: at commas if it has any, else at line ends (or the other way round), trimmed, without empty ones."""
    by = lambda sep: F.split(c, sep)
    first, second = ("\n", ",") if prefer_newlines else (",", "\n")
    parts = F.when(c.contains(first), by(first)).when(c.contains(second), by(second)).otherwise(F.array(c))
    return F.filter(F.transform(parts, T.trimmed), lambda x: x.isNotNull() & (x != ""))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, f"[{T.WS}]+"), lambda x: x != ""))


def is_sentence(c: Column) -> Column:
    """Whether a field is prose, said only if sure: 20 characters and telling words, or over six words and an end of sentence."""
    return F.coalesce((F.length(c) >= 20) & (F.lower(c).rlike(_py(TELLS_SENTENCE)) | ((n_words(c) > 6) & T.trimmed(c).rlike("[.!?]$"))), F.lit(False))


def is_prose(c: Column) -> Column:
    """Whether a skill is written as a sentence, to extract skills from: over four words and telling ones, or over six and an end of sentence."""
    return F.coalesce((n_words(c) > 4) & (F.lower(c).rlike(_py(TELLS_PROSE)) | ((n_words(c) > 6) & T.trimmed(c).rlike("[.!?]$"))), F.lit(False))


def is_clean_token(c: Column) -> Column:
    """Whether a skill is a clean token: up to 50 characters and two words, without a full stop, telling words or punctuation; or a known one of several words."""
    low = F.lower(c)
    bad = c.contains(".") | c.contains("  ") | (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) > 2) | low.rlike(_py(NO_TOKEN))
    return F.coalesce((c != "") & (F.length(c) <= 50) & ~bad & (low.isin(*KNOWN_TOKENS) | ((n_words(c) <= 2) & ~c.rlike("[.!?,;:]"))), F.lit(False))


def _listed(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (T.trimmed(x) != ""))


def summary(title: Column, seniority: Column, years: Column, location: Column, *lists: Column, education: Column | None = None, duties: Column | None = None) -> Column:
    """What a criteria form asks, in sentences: title and seniority, years, education, place, duties, then all listed values."""
    given = lambda c: F.nullif(T.trimmed(c), F.lit(""))
    sentence = F.array_join(F.transform(_listed(duties), T.trimmed), ". ") if duties is not None else F.lit(None).cast("string")
    parts = (
        F.when(given(title).isNotNull(), F.concat(F.lit("We are seeking a "), F.concat_ws(" ", given(seniority), given(title)), F.lit("."))),
        F.when(years > 0, F.concat(F.lit("The role requires "), years.cast("string"), F.lit("+ years of experience."))),
        F.concat(F.lit("Education requirements: "), given(education)) if education is not None else F.lit(None).cast("string"),
        F.concat(F.lit("Location: "), given(location)),
        F.when(sentence != "", F.concat(F.lit("Key responsibilities: "), sentence, F.when(sentence.endswith("."), "").otherwise("."))),
        F.nullif(F.concat_ws(" ", *[F.array_join(_listed(x), " ") for x in lists]), F.lit("")),
    )
    return collapsed(F.concat_ws(" ", *parts))


def _repr(values: Column) -> Column:
    """A sorted list as it is printed for the digest: ['a', 'b'], in double quotes where a value holds a single one alone."""
    quoted = lambda x: F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(values), quoted), ", "), F.lit("]"))


def digest(must: Column, nice: Column, years: Column) -> Column:
    """The first twelve digits of the MD5 of both lists, sorted, and the years."""
    none = F.array().cast("array<string>")
    return F.substring(F.md5(F.concat_ws("|", _repr(F.coalesce(must, none)), _repr(F.coalesce(nice, none)), F.coalesce(years, F.lit(0)).cast("string"))), 1, 12)


def squeezed(c: Column) -> Column:
    """A skill with one space for several and none around punctuation, hyphens and slashes."""
    return T.trimmed(F.regexp_replace(F.regexp_replace(c, f"[{T.WS}]*([.,;:!?])[{T.WS}]*", "$1"), f"[{T.WS}]*([/-])[{T.WS}]+|[{T.WS}]+([/-])", "$1$2"))


def hygiene(criteria: DataFrame, key: str, must: str, nice: str, surfaces: DataFrame) -> DataFrame:
    """(key, must, nice): both lists in canonical form, a broad skill by what it stands for, without repeats, sorted; what is a must is no wish.

    Each distinct squeezed value is looked up once; the surfaces may be broadcast if Spark finds them small. Composed forms are the
    caller's matter (`composed`).
    """
    none = F.array().cast("array<string>")
    both = criteria.select(key, F.explode(F.array(F.struct(F.lit("must").alias("f"), F.coalesce(must, none).alias("vs")), F.struct(F.lit("nice").alias("f"), F.coalesce(nice, none).alias("vs")))).alias("x"))
    rows = both.select(key, "x.f", F.explode_outer("x.vs").alias("v")).withColumn("v", F.lower(squeezed(F.col("v"))))
    forms = surfaces.select(F.col("surface").alias("v"), F.lower("canonical").alias("_c"))
    known = rows.join(forms, "v", "left").withColumn("v", F.coalesce("_c", "v"))
    wide = F.lit(None).cast("array<string>")
    for broad, narrow in BROAD.items():
        wide = F.when(F.col("v") == broad, F.array(*map(F.lit, narrow))).otherwise(wide)
    single = known.select(key, "f", F.explode_outer(F.coalesce(wide, F.array("v"))).alias("v"))
    keep = lambda f: F.array_sort(F.collect_set(F.when((F.col("f") == f) & (F.col("v") != ""), F.col("v"))))
    out = single.groupBy(key).agg(keep("must").alias("must"), keep("nice").alias("nice"))
    return out.withColumn("nice", F.array_except("nice", "must"))


def clean_skills(values: DataFrame, key: str, value: str, surfaces: DataFrame) -> DataFrame:
    """(key, pos, kind, skill): the skills of typed values (key, pos, value). A sentence gives the skills named in it, in order of name; without any, if it has
    up to four words, itself; else it is rejected (skill null). Anything else is looked up, and kept as it is if it isn't listed."""
    v = values.select(key, "pos", T.trimmed(F.col(value)).alias("_v")).filter("_v <> ''").withColumn("_prose", is_prose(F.col("_v")))
    prose = v.filter("_prose").withColumn("_id", F.struct(key, "pos"))
    named = M.extracted(prose, "_id", "_v", surfaces).select(f"_id.{key}", "_id.pos", F.lower("canonical").alias("skill"))
    from_prose = prose.select(key, "pos", "_v").join(named, [key, "pos"], "left").select(key, "pos", F.when(F.col("skill").isNull(), "rejected").otherwise("extracted").alias("kind"), "skill")
    forms = surfaces.select(F.col("surface").alias("_s"), F.lower("canonical").alias("_c"))
    token = v.filter("NOT _prose").withColumn("_s", F.lower("_v")).join(forms, "_s", "left")
    return from_prose.unionByName(token.select(key, "pos", F.when(F.col("_c").isNull(), "as typed").otherwise("listed").alias("kind"), F.coalesce("_c", "_s").alias("skill")))


def top_skills(text: Column) -> Column:
    """array of (skill_id, label) of the ten fixed skills of which a form stands anywhere in the text."""
    low = F.lower(text)
    has = lambda forms: F.greatest(*[low.contains(f) for f in forms], F.lit(False))
    return F.filter(F.array(*[F.when(has(forms), F.struct(F.lit(k).alias("skill_id"), F.lit(forms[0].title()).alias("label"))) for k, forms in TOP.items()]), lambda x: x.isNotNull())
