"""Records out of lines: what a line is, blocks that a header line opens, names, canonical section headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that tell what a line is.
JOBS = "engineer|developer|manager|director|analyst|consultant|specialist|scientist|architect|lead|intern|founder|designer|technician|administrator|supervisor|coordinator|advisor|executive|programmer|officer|assistant|associate|nurse|writer|editor|planner|operator|inspector|facilitator|owner"
TRAINING = "seminar|workshop|bootcamp|boot camp|webinar|orientation|conference|symposium|summit|forum"
SCHOOLS = "university|college|school|academy|institute|polytechnic|universität|universidad|université|högskolan|école"
DEGREES = "bachelor|master|mba|phd|diploma|certificate|doctorate|bsc|msc|beng|meng|licence en|ausbildung"
HEADERS = {
    "experience": "experience|work experience|professional experience|employment|employment history|work history",
    "education": "education|academic background|qualifications|education and training",
    "skills": "skills|technical skills|core skills|key skills|competencies",
    "projects": "projects|personal projects|key projects",
    "summary": "summary|profile|objective|about me|professional summary",
    "requirements": "requirements|what you bring|your profile|must have",
}
CONTACT = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|https?://|www\.|(?:^|[^0-9])\+?[0-9][0-9 ()./-]{7,}[0-9]"


def _word(words: str) -> str:
    return rf"(?:^|[^a-z])(?:{words})(?:$|[^a-z])"


def classes(line: Column) -> dict[str, Column]:
    """What a line is: each a boolean. A role header names a job and has a separator, a year or at most 40 characters of two words or more."""
    low = F.lower(line)
    year = line.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:$|[^0-9])")
    separated = line.rlike(r" (?:-|–|—|\||at|@) |, ")
    contact, training = low.rlike(CONTACT), low.rlike(_word(TRAINING))
    bullet = line.rlike(r"^[•●*-][ \t]")
    short = (F.length(line) <= 40) & line.rlike(r"[^ \t][ \t]+[^ \t]")
    return {
        "is_bullet": bullet,
        "is_contact": contact,
        "is_training": training,
        "is_role": low.rlike(_word(JOBS)) & (separated | year | short) & ~contact & ~training & (F.length(line) <= 120),
        "is_school": low.rlike(f"(?:{SCHOOLS})"),
        "is_degree": low.rlike(_word(DEGREES)),
        "is_coherent": (F.length(line) >= 2) & line.rlike("[A-Za-z0-9_]") & ~line.rlike(r"(?:st|nd|rd|th){2,}|[●•*-]{3,}|^[●•*-]+$"),
    }


def blocks(lines: DataFrame, key: str, opens: Column) -> DataFrame:
    """lines with block: the number of opening lines up to and with each; 0 before the first."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.sum(opens.cast("int")).over(w).cast("int"))


def roles(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, title, company, dates, n_bullets): an entry for each role header, with the bullets behind it."""
    marked = lines.withColumns({k: v for k, v in classes(F.col("line")).items() if k in ("is_role", "is_bullet")})
    opens = F.col("is_role") & ~F.col("is_bullet")
    cut = T.title_and_company(F.col("line"))
    head = blocks(marked.withColumn("_open", opens), key, F.col("_open")).filter("block > 0")
    out = head.groupBy(key, "block").agg(F.max(F.when(F.col("_open"), F.struct(cut["title"].alias("title"), cut["company"].alias("company"), T.dates_of(F.col("line")).alias("dates")))).alias("h"), F.count_if("is_bullet").alias("n_bullets"))
    return out.select(key, "block", "h.title", "h.company", "h.dates", "n_bullets")


def person_name(lines: Column) -> Column:
    """The first of ten lines that is two to four capitalized words of letters, none of which is a job or a header word; null if none is."""
    taboo = _word("|".join([JOBS, "experience|education|skills|summary|profile|curriculum|vitae|resume|hiring|dear|kind|regards|good|morning|hello|senior|junior|staff|principal"]))
    return F.get(F.filter(F.slice(lines, 1, 10), lambda x: x.rlike(r"^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]+(?: [A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]*){1,3}$") & ~F.lower(x).rlike(taboo)), F.lit(0))


def canonical_header(line: Column) -> Column:
    """The section a header line opens, by its words; null if it is none of those known."""
    key = T.header_key(line)
    out = F.lit(None).cast("string")
    for name, aliases in reversed(HEADERS.items()):
        out = F.when(key.isin(*aliases.split("|")), F.lit(name)).otherwise(out)
    return out


def nearest_header(headers: DataFrame, column: str, at_least: float = 0.9) -> DataFrame:
    """headers with section: by equal words, else by the closest alias if the ratio of matching blocks is high enough.

    Distinct headers only go to Python; the ratio (2 M / T, as difflib has it) has no built-in counterpart.
    """
    aliases = [(a, k) for k, v in HEADERS.items() for a in v.split("|")]
    longest = int(max(len(a) for a, _ in aliases) * (2 / at_least - 1))  # no longer line can reach the ratio

    @F.pandas_udf("string")
    def closest(keys: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(key: str | None) -> str | None:
            best, found = at_least, None
            for a, k in aliases:
                m = SequenceMatcher(None, key or "", a)
                if m.real_quick_ratio() >= best and m.quick_ratio() >= best and ((r := m.ratio()) > best or found is None and r >= best):
                    best, found = r, k
            return found

        return keys.map(one)

    distinct = headers.select(T.header_key(F.col(column)).alias("_k")).filter((F.col("_k") != "") & (F.length("_k") <= longest)).distinct()
    return headers.withColumn("_k", T.header_key(F.col(column))).join(distinct.withColumn("section", closest("_k")), "_k", "left").drop("_k")


def reading_order(elements: DataFrame, page: str, x: str, y: str, tie: str | None = None, least_gap: float = 50.0) -> DataFrame:
    """elements with column (0 left, 1 right) and ord: left column by y and x, then the right one.

    A page has two columns if the widest gap between neighbouring x exceeds 15 % of its width and least_gap, with its middle within
    35 % of the page's.
    """
    w = Window.partitionBy(page).orderBy(x)
    gaps = elements.select(page, x).distinct().withColumn("_next", F.lead(x).over(w)).filter("_next IS NOT NULL").withColumn("_gap", F.col("_next") - F.col(x))
    ends = elements.groupBy(page).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    widest = gaps.groupBy(page).agg(F.max(F.struct(F.col("_gap"), ((F.col(x) + F.col("_next")) / 2).alias("_mid"))).alias("_g")).join(ends, page)
    width = F.col("_hi") - F.col("_lo")
    cut = F.when((F.col("_g._gap") > F.greatest(0.15 * width, F.lit(least_gap))) & (F.abs(F.col("_g._mid") - (F.col("_lo") + F.col("_hi")) / 2) <= 0.35 * width), F.col("_g._mid"))
    placed = elements.join(widest.select(page, cut.alias("_cut")), page, "left").withColumn("column", F.when(F.col(x) >= F.col("_cut"), 1).otherwise(0)).drop("_cut")
    return placed.withColumn("ord", F.row_number().over(Window.partitionBy(page).orderBy("column", y, x, *([tie] if tie else []))))


# Parts of addresses, anywhere in a line, by which it is taken for contact data.
ADDRESS_PARTS = "street|avenue|road|drive|lane|blvd|ave|st|rd|dr"
# Two letters of states, anywhere in a short part of a line between bars or bullets.
STATE_PARTS = "ca|ny|tx|fl|il|pa|oh|ga|nc|mi"
_MAIL, _TELEPHONE = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"(?U)\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b"


def has_contact(line: Column) -> Column:
    """Whether a line gives a way to reach somebody: mail, telephone, profile, address; or two such parts between bars or bullets."""
    low = F.lower(line)
    reach = lambda x: x.rlike(_MAIL) | x.rlike(_TELEPHONE)
    parts = F.transform(F.split(line, "[|•]"), T.trimmed)
    near = F.size(F.filter(parts, lambda p: reach(p) | ((F.length(p) < 30) & F.lower(p).rlike(STATE_PARTS))))
    profile = line.rlike(r"https?://|www\.") & low.rlike("linkedin|github")
    return reach(line) | profile | low.rlike(ADDRESS_PARTS) | line.rlike(r"(?U)[A-Za-z\s],\s*[A-Za-z]{2}\s*[0-9]{5}\b") | (line.rlike("[|•]") & (near >= 2))


def coherent(text: Column) -> Column:
    """Whether a text has a word and no garbled ordinals or rows of bullets."""
    return (F.length(text) >= 2) & text.rlike(f"[{T.W}]") & ~text.rlike(rf"(?:st|nd|rd|th){{2,}}|[●•*-]{{3,}}|(?<![{T.W}])(?:st|nd|rd|th)$|^[●•*-]+$")


def cleaned(lines: DataFrame, column: str) -> DataFrame:
    """lines with item: the cleaned line; rows whose line is short contact data, or has nothing coherent left, are left out."""
    line = F.col(column)
    item = line
    for step in (T.fixed_ordinals, T.fixed_bullets, T.fixed_spacing, T.without_nonsense):
        item = step(item)
    kept = lines.filter(~(has_contact(line) & (F.length(line) < 100)))
    # exploded, so that the filter behind isn't pushed into the expression and makes it be computed again
    return kept.select("*", F.explode(F.array(item)).alias("item")).filter(coherent(F.col("item")))
