"""Text normalization as column expressions. Null gives null unless stated otherwise. Words are of any script: letters, numbers and _."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and word characters of any script, as they stand within a class of either dialect.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
W = r"\p{L}\p{N}_"
# Lines that carry no content; the last kind counts as a header, but isn't scrubbed with personal data.
SCRUBBED = ("resume|cv|curriculum vitae", "personal information|contact information", "objective|summary|profile", "references available upon request", r"page [0-9]+ of [0-9]+", "confidential|private")
BOILERPLATE = (*SCRUBBED, "draft|template")
SEPARATORS = (" at ", " @ ", " - ", " – ", " — ", " | ", ", ")
#: Years and spans of them, as written in resumes.
DATE_RANGE = r"(?i)(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* |[0-9]{1,2}/)?(?:19|20)[0-9]{2} ?(?:-|–|—|to) ?(?:(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* |[0-9]{1,2}/)?(?:19|20)[0-9]{2}|present|current|now)"


def _sub(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def let(value: Column, of) -> Column:
    """of(value), with the value computed once a row, however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def trimmed(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return _sub(c, f"^[{WS}]+|[{WS}]+$", "")


# The steps of each normalization, (pattern, by), in this order.
PREPROCESSED = ((f"[{WS}]+", " "), (rf"[^{W}{WS}.,;:!?-]", ""), (r"[.,;:!?]+", " "), (f"[{WS}]+", " "))
FOR_DENSE = ((f"[{WS}]+", " "), (rf"[^{W}{WS}.#+/-]", " "), (f"[{WS}]+", " "))
DEHYPHENATED = ((rf"([{W}]+)-[{WS}]*\n[{WS}]*([{W}]+)", "$1$2"),)
BULLETS = ((f"^[•▪▫*-]+[{WS}]*", "● "), (f"●[{WS}]*●[{WS}]*", "● "), (f"^●([^{WS}])", "● $1"), ("(st|nd|rd|th)●", "$1 ●"))
SPACING = ((f"[{WS}]+", " "), (r" ([,.;:!?])", "$1"), (r"([,.;:!?]) ?([a-zA-Z])", "$1 $2"), (r" ?\( ?", " ("), (r" ?\) ?", ") "))
NONSENSE = (("(st|nd|rd|th)(nd|rd|th|st)[●•*-]*", "$1"), (rf"(?<![{W}])(?:st|nd|rd|th)(?![{W}])(?![{WS}]+[{W}])", ""), ("[●•*-]{2,}", "●"))


def _steps(c: Column, steps) -> Column:
    for pattern, by in steps:
        c = _sub(c, pattern, by)
    return c


def preprocessed(c: Column) -> Column:
    """Lower case, one space for any white space, only letters and numbers of any script, _, space and .,;:!?-, then punctuation to spaces."""
    return trimmed(_steps(trimmed(F.lower(c)), PREPROCESSED))


def for_dense_models(c: Column) -> Column:
    """Case kept; everything but word characters, white space and . # + / - becomes a space; white space collapsed."""
    return trimmed(_steps(trimmed(c), FOR_DENSE))


def dehyphenated(c: Column) -> Column:
    """Words broken at a line end joined again."""
    return _steps(c, DEHYPHENATED)


def unified_bullets(c: Column) -> Column:
    """All bullet glyphs, and - or * at a line start, as one."""
    return _sub(F.translate(c, "●▪▫◦‣⁃∙", "•••••••"), r"(?m)^[ \t]*[-*][ \t]+", "• ")


def lines(c: Column) -> Column:
    """The trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), trimmed), lambda x: x != "")


def split_tokens(c: Column) -> Column:
    """Values between commas, semicolons and slashes, trimmed, the empty ones left out."""
    return F.filter(F.transform(F.split(c, "[,;/]"), trimmed), lambda x: x != "")


def is_boilerplate(line: Column, kinds=BOILERPLATE) -> Column:
    return F.lower(line).rlike(f"^(?:{'|'.join(kinds)})$")


def without_boilerplate(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~is_boilerplate(x)), "\n")


def scrubbed(c: Column) -> Column:
    """Addresses of mail and web and telephone numbers by placeholders, boilerplate lines dropped, the rest in one line."""
    c = _sub(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    c = _sub(c, r"(\+?1[-. ]?)?\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}", "[PHONE]")
    c = _sub(_sub(c, r"https?://[^\s]+", "[URL]"), r"www\.[^\s]+", "[URL]")
    return F.array_join(F.filter(lines(c), lambda x: ~is_boilerplate(x, SCRUBBED)), " ")


def joined_lines(c: Column) -> Column:
    """A line that doesn't end a sentence is joined with the next one if that starts in lower case; each line takes part once.

    Lines that could be joined with the next are marked in a string, on which a regular expression takes pairs from the left.
    """


    def flags(ls: Column) -> Column:
        return F.transform(ls, lambda x, i: F.when((i + 1 < F.size(ls)) & ~x.rlike(r"[.!?:;]$") & F.coalesce(F.get(ls, i + 1).rlike(r"^\p{Ll}"), F.lit(False)), "1").otherwise("0"))

    def joined(ls: Column, marks: Column) -> Column:  # T takes the next line, K is taken, in pairs from the left
        return F.array_join(F.transform(ls, lambda x, i: F.concat(F.when(i == 0, "").when(F.get(marks, i) == "K", " ").otherwise("\n"), x)), "")

    return let(lines(c), lambda ls: let(F.split(F.regexp_replace(F.array_join(flags(ls), ""), "1[01]", "TK"), ""), lambda marks: joined(ls, marks)))


def word_chunks(c: Column, size: int = 393) -> Column:
    """Disjoint chunks of that many words (512 tokens at 1.3 a word)."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    n = F.ceil(F.size(words) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def fixed_ordinals(c: Column) -> Column:
    """Ordinals that extraction garbled: doubled endings, endings cut off or run into bullets."""
    c = _sub(c, r"([0-9]+)(st|nd|rd|th)(nd|rd|th|st)", "$1$2")
    c = _sub(c, rf"(?<![{W}])(st|nd|rd|th)(nd|rd|th|st)(?![{W}])", "$1")
    c = _sub(c, r"(st|nd|rd|th)[●•*-]+", "$1")
    return _sub(c, rf"([0-9]+)[{WS}]+(st|nd|rd|th)(?![{W}])", "$1$2")


def fixed_bullets(c: Column) -> Column:
    """One bullet sign, with a space behind it, not doubled, and parted from an ordinal before it."""
    return _steps(c, BULLETS)


def fixed_spacing(c: Column) -> Column:
    """One space for any white space, none before punctuation, one behind it before a letter, and one around brackets."""
    return trimmed(_steps(c, SPACING))


def without_nonsense(c: Column) -> Column:
    """Doubled and stray ordinal endings, and rows of bullets, removed."""
    return trimmed(_steps(c, NONSENSE))


def composed(c: Column) -> Column:
    """Compatibility forms resolved and accents composed (NFKC). Spark has no built-in; only texts beyond ASCII go to Python, in Arrow batches."""

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.when(F.length(c) == F.octet_length(c), c).otherwise(nfkc(c))


def preprocessed_resume(c: Column) -> Column:
    """Composed, words joined at line ends, wrapped lines joined, one bullet sign, one space for any white space. The text is composed first, so
    hand over a column that is (`composed`)."""
    return trimmed(_sub(unified_bullets(joined_lines(dehyphenated(c))), f"[{WS}]+", " "))


def canonical_resume_text(*sections: Column) -> Column:
    """The sections that aren't empty, joined and preprocessed."""
    return preprocessed(F.concat_ws(" \n ", *[F.nullif(x, F.lit("")) for x in sections]))


def resume_text(raw: Column, *sections: Column) -> Column:
    """The sections that aren't empty, in the order given, joined by a space; the raw text where none is."""
    joined = F.concat_ws(" ", *[F.nullif(trimmed(x), F.lit("")) for x in sections])
    return F.coalesce(F.nullif(joined, F.lit("")), raw)


def header_key(c: Column) -> Column:
    """A header as it is looked up: lower case, without signs at its ends."""
    return F.trim(_sub(_sub(F.lower(c), r"^[^a-z0-9]+|[^a-z0-9]+$", ""), r"\s+", " "))


def title_and_company(c: Column) -> Column:
    """struct(title, company), cut at the first separator of SEPARATORS, in their order, that occurs; else no company."""
    working = F.regexp_replace(F.trim(c), r"^[-|•]+|[-|•]+$", "")
    cut = F.lit(None).cast("struct<title:string,company:string>")
    clean = lambda x: F.regexp_replace(x, r"^[ ,|-]+|[ ,|-]+$", "")
    for sep in reversed(SEPARATORS):
        at = F.instr(F.lower(working), sep)
        cut = F.when(at > 0, F.struct(clean(F.substring(working, F.lit(1), at - 1)).alias("title"), clean(F.substring(working, at + len(sep), F.length(working))).alias("company"))).otherwise(cut)
    return F.coalesce(cut, F.struct(working.alias("title"), F.lit("").alias("company")))


def dates_of(c: Column) -> Column:
    """The first span of years; else the first two years; else the only one; else empty."""
    span = F.regexp_extract(c, DATE_RANGE, 0)
    years = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)[0-9]{2})(?![A-Za-z0-9_])"), F.lit(1)))
    return F.when(span != "", span).otherwise(F.array_join(F.slice(years, 1, 2), " - "))


def name_from_file(c: Column) -> Column:
    """A display name from a file name: no extension, _ and - as spaces, words capitalized; 'Unknown Candidate' for none."""
    base = F.trim(F.translate(F.regexp_replace(c, r"\.[^.]*$", ""), "_-", "  "))
    return F.coalesce(F.nullif(F.initcap(F.regexp_replace(base, r"\s+", " ")), F.lit("")), F.lit("Unknown Candidate"))


def quote_of(c: Column, words: int = 8, fallback: int = 6) -> Column:
    """The text if it has at most that many words, else its first few."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")
    return F.when(F.size(parts) <= words, F.array_join(parts, " ")).otherwise(F.array_join(F.slice(parts, 1, fallback), " "))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


# Words that a context doesn't start or end with.
LOOSE = ("and", "with", "using", "via", "through")


def context_of(text: Column, at: Column, n: Column, chars: int = 80) -> Column:
    """What stands around the n characters of a text from position `at` (0-based): up to 80 on each side, from the last full stop before to the first
    behind where there are some, without loose words at the ends; of over 80 in all, three words on each side of the place."""
    start = F.when(at - chars < 19, F.lit(0)).otherwise(at - chars)
    before, held, behind = F.substring(text, start + 1, at - start), F.substring(text, at + 1, n), F.substring(text, at + n + 1, F.lit(chars))
    whole = F.concat(F.regexp_extract(before, "[^.]*$", 0), held, F.regexp_extract(behind, r"^[^.]*\.?", 0))
    ends = F.regexp_replace(trimmed(whole), "^[.,;:]+|[.,;:]+$", "")
    first = F.regexp_replace(ends, "^(?i:" + "".join(f"(?:{w} )?" for w in LOOSE) + ")", "")
    bare = F.regexp_replace(first, "(?i:" + "".join(f"(?: {w})?" for w in reversed(LOOSE)) + ")$", "")

    def cut(c: Column, ws: Column, own: Column) -> Column:
        k = F.size(own)
        place = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - k + 1, F.lit(1))), lambda i: F.slice(ws, i, k) == own), F.lit(0))
        first = F.greatest(place - 3, F.lit(1))
        near = F.array_join(F.slice(ws, first, F.least(place + k + 2, F.size(ws)) - first + 1), " ")
        middle = F.array_join(F.slice(ws, F.floor(F.size(ws) / 2).cast("int") - 3, F.lit(8)), " ")
        return F.when(F.length(c) <= chars, c).when(place.isNotNull(), near).when(F.size(ws) > 12, middle).otherwise(c)

    words = lambda c: F.filter(F.split(c, f"[{WS}]+"), lambda x: x != "")
    return let(bare, lambda c: let(words(c), lambda ws: let(words(held), lambda own: cut(c, ws, own))))
