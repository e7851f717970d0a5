"""Sections of a document out of its lines: scores of headers, segmentation with fallbacks, canonical labels, repairs.

A document's lines are a list; every step is a function of lists, as each depends on what the step before did with the same
document. `sectioned` runs the chain on Arrow batches, a document at a time, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What section headers are called, by the label they stand for.
SYNONYMS = {
    "experience": "experience|work experience|employment|career history|work history|professional experience|roles|professional background|employment history",
    "skills": "skills|technical skills|core competencies|competencies|expertise|proficiencies|technical proficiencies|toolset|technology skills",
    "education": "education|academic background|qualifications|academic qualifications|educational background|educational attainment|college|university|secondary education|high school|tertiary education|academic history",
    "projects": "projects|project experience|project work|key projects|notable projects|portfolio projects",
    "certifications": "certifications|licenses|professional certifications|accreditations",
    "awards": "awards|honors|achievements|recognition|accomplishments|distinctions",
    "summary": "summary|professional summary|career summary|profile|professional profile|personal statement|objective|career objective|career objectives",
    "contact": "contact|contact information|contact info|personal information|personal details|address|phone|email",
    "training": "training|professional development|courses|workshops|seminars|seminars and training experiences|training experiences",
    "references": "references|professional references|character references|referees",
    "languages": "languages|language skills|linguistic skills|foreign languages",
    "interests": "interests|hobbies|personal interests|activities|extracurricular",
    "volunteer": "volunteer|volunteer work|volunteer experience|community service",
    "leadership": "leadership|leadership roles|leadership experience|leadership positions",
}
# What contents tell of a label, in the order of priority.
HINTS = {
    "experience": "experience|work history|employment|professional experience|responsible for|managed|developed|engineer|company|intern|team lead|product|project manager|delivered",
    "skills": "skills|technical|technologies|tech stack|frameworks|tools|proficient|expertise|competencies|languages|platforms|libraries",
    "education": "education|university|college|school|academy|bachelor|master|phd|gpa|degree|curriculum|diploma",
    "projects": "project|projects|built|designed|implemented|prototype|hackathon|case study",
    "certifications": "certification|certifications|certified|license|credential",
    "languages": "language|languages|fluent|bilingual|native|speak",
    "awards": "award|awards|honor|recognition|achievement|distinction",
    "volunteer": "volunteer|community|service|nonprofit|ngo|outreach",
    "summary": "summary|objective|profile|statement|overview",
    "contact": "contact|information|phone|email|address|linkedin",
}
# Families of words in short lines, tried in this order.
FAMILIES = {
    "experience": "experience|work experience|professional experience|employment|employment history|work history|career history|career|professional background|positions held|roles|work|job history|relevant experience|professional history|industry experience|history",
    "skills": "skills|technical skills|competencies|expertise|proficiencies|technologies|tools|tech stack|technical proficiencies|capabilities|programming languages|software|platforms|core competencies",
    "education": "education|academic background|academic qualifications|educational background|academic|qualifications",
    "projects": "projects|project experience|portfolio|key projects|notable projects",
    "certifications": "certifications|certificates|licenses|accreditations|credentials",
    "awards": "awards|honors|achievements|recognition|accomplishments|distinctions",
}
# Words that a line of up to 60 characters is taken for a header by.
INLINE = "experience|work experience|employment|professional experience|education|academic background|skills|technical skills|projects|project experience|certifications|achievements|awards|volunteer|activities|summary|objective|profile|languages|contact"
# Lines that are no content of a resume.
NOISE = r"(Page\s+)?\d+(\s+of\s+\d+)?$|(Resume|CV|Curriculum\s+Vitae)$|Tips?\s*:|Note\s*:|Remember\s*:|Keep\s+in\s+mind\s*:|supervisors?\s+after\s+completing\s+work\s+experience|This\s+is\s+a\s+sample|For\s+best\s+results|Make\s+sure\s+to|Include\s+your|Don't\s+forget\s+to"
# Headers that run into a line's text, by the kind they open.
EMBEDDED = (
    "EXPERIENCE|WORK EXPERIENCE|PROFESSIONAL EXPERIENCE", "EDUCATION|ACADEMIC BACKGROUND|QUALIFICATIONS", "SKILLS|TECHNICAL SKILLS|CORE COMPETENCIES", "PROJECTS|PROJECT EXPERIENCE|PROJECTS & PUBLICATIONS", "CERTIFICATIONS|CERTIFICATES|LICENSES",
)
# The score of a header line from which on it opens a section.
THRESHOLD = 0.44

LABEL_OF = {alias: label for label, aliases in SYNONYMS.items() for alias in aliases.split("|")}
_EMAIL, _URL, _PHONE = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), re.compile(r"https?://|www\."), re.compile(r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b")
_PAGE = re.compile(r"(?i)^(?:page\s+)?\d+(?:\s+of\s+\d+)?$")
_NOISE = re.compile(f"(?i){NOISE}")
_BULLET = re.compile(r"[•●*-]|\d+\.")
_SUFFIX = ("st", "nd", "rd", "th")


@dataclass(frozen=True)
class Section:
    header: str
    content: list[str] = field(default_factory=list)
    label: str = ""

    @property
    def text(self) -> str:
        return " ".join(self.content).strip()


@dataclass(frozen=True)
class Place:
    """Where and how a line is printed; what isn't known is None. margin and median are those of the line's page."""

    font: float | None = None
    bold: bool | None = None
    x: float | None = None
    y: float | None = None
    above: float | None = None
    margin: float | None = None
    median: float | None = None


# ---------------------------------------------------------------------------------------------- lines


def normalized_text(text: str) -> str:
    """Compatibility forms and ligatures resolved, spaced-out headers closed up, headers inside a line on a line of their own, hyphens at
    line ends removed, one bullet sign."""
    t = unicodedata.normalize("NFKC", text or "")
    t = re.sub(r"\b(?:[A-Z]\s){3,}[A-Z]\b", lambda m: "".join(m.group().split()), t)
    for names in EMBEDDED:
        t = re.sub(rf"(?i)(\S)\s+({names})\s+([A-Z])", r"\1\n\2\n\3", t)
    return re.sub(r"^[•▪▫*-]+\s*", "● ", re.sub(r"-\s*\n\s*", "", t)).strip()


def normalized_lines(lines: Iterable[str]) -> list[str]:
    return [part for line in lines for part in map(str.strip, normalized_text(line).split("\n")) if part]


def without_repeats(lines: Sequence[str], most: int = 3) -> list[str]:
    """lines without those that come more than `most` times, whatever their case: headers and footers of pages."""
    times: dict[str, int] = {}
    for x in lines:
        times[x.strip().lower()] = times.get(x.strip().lower(), 0) + 1
    return [x for x in lines if times[x.strip().lower()] <= most]


def cleaned_lines(lines: Iterable[str]) -> list[str]:
    """The lines without page numbers, document titles, instructions and single signs other than bullets."""
    return [x for x in map(str.strip, lines) if x and not _NOISE.match(x) and (len(x) >= 2 or x in "•-*")]


def has_contact(line: str) -> bool:
    """Whether a line gives a way to reach somebody: mail, telephone, profile, address; or two such parts between bars or bullets."""
    low = line.lower()
    if _EMAIL.search(line) or _PHONE.search(line) or _URL.search(line) and ("linkedin" in low or "github" in low):
        return True
    # Parts of addresses, anywhere in the line.
    if any(w in low for w in ("street", "avenue", "road", "drive", "lane", "blvd", "ave", "st", "rd", "dr")) or re.search(r"[A-Za-z\s],\s*[A-Za-z]{2}\s*\d{5}\b", line):
        return True
    parts = [p.strip() for p in re.split(r"[|•]", line)] if "|" in line or "•" in line else []
    # States, by two letters anywhere in a short part.
    near = lambda p: len(p) < 30 and any(s in p.lower() for s in ("ca", "ny", "tx", "fl", "il", "pa", "oh", "ga", "nc", "mi"))
    return sum(bool(_EMAIL.search(p) or _PHONE.search(p) or near(p)) for p in parts) >= 2


_ORDINALS = [(re.compile(a), b) for a, b in ((r"(\d+)(st|nd|rd|th)(nd|rd|th|st)", r"\1\2"), (r"\b(st|nd|rd|th)(nd|rd|th|st)\b", r"\1"), (r"(st|nd|rd|th)[●•*-]+", r"\1"), (r"(\d+)\s+(st|nd|rd|th)\b", r"\1\2"))]
_BULLETS = [(re.compile(a), b) for a, b in ((r"^[•▪▫*-]+\s*", "● "), (r"●\s*●\s*", "● "), (r"^●(\S)", r"● \1"), (r"(st|nd|rd|th)●", r"\1 ●"))]
_SPACING = [(re.compile(a), b) for a, b in ((r"\s+", " "), (r"\s+([,.;:!?])", r"\1"), (r"([,.;:!?])\s*([a-zA-Z])", r"\1 \2"), (r"\s*\(\s*", " ("), (r"\s*\)\s*", ") "))]
_NONSENSE = [(re.compile(a), b) for a, b in ((r"(st|nd|rd|th)(nd|rd|th|st)[●•*-]*", r"\1"), (r"\b(st|nd|rd|th)\b(?!\s+\w)", ""), (r"[●•*-]{2,}", "●"))]
_CORRUPT = re.compile(r"(?:st|nd|rd|th){2,}|[●•*-]{3,}|\b(?:st|nd|rd|th)$|^[●•*-]+$")


def coherent(text: str) -> bool:
    return len(text.strip()) >= 2 and not _CORRUPT.search(text) and bool(re.search(r"\w", text))


def cleaned_item(text: str) -> str:
    """An item without garbled ordinals, bullets and spaces; '' if it is a short line of contact data or nothing coherent is left."""
    if not text or len(text) < 100 and has_contact(text):
        return ""
    for group in (_ORDINALS, _BULLETS, _SPACING, _NONSENSE):
        for pattern, by in group:
            text = pattern.sub(by, text)
        text = text.strip() if group in (_SPACING, _NONSENSE) else text
    return text.strip() if coherent(text) else ""


def _ordinal(parts: Sequence[str], i: int, joiners: Sequence[str]) -> tuple[str, int]:
    """The ordinal that starts at part i ("1", "st", "and", "2", "nd") and the number of parts it takes; ('', 0) for none."""
    get = lambda k: parts[k].strip() if k < len(parts) else ""
    if not re.fullmatch(r"\d+", get(i)) or get(i + 1) not in _SUFFIX:
        return "", 0
    out, n = get(i) + get(i + 1), 2
    if get(i + 2).lower() in joiners:
        out, n = f"{out} {get(i + 2)}", 3
        if re.fullmatch(r"\d+", get(i + 3)):
            out, n = f"{out} {get(i + 3)}", 4
            if get(i + 4) in _SUFFIX:
                out, n = out + get(i + 4), 5
    return out, n


def joined_fragments(lines: Sequence[str]) -> list[str]:
    """Lines with ordinals and bullets that stand on lines of their own joined to what follows, and short lines with what goes on in lower case."""
    out, i = [], 0
    while i < len(lines):
        here, after = lines[i].strip(), lines[i + 1].strip() if i + 1 < len(lines) else None
        ordinal, n = _ordinal(lines, i, ("and", "&"))
        if n:
            out.append(ordinal)
        elif here in ("•", "●", "-", "*"):
            out.append("● " + (after or ""))
            n = 2
        elif after and len(here) < 50 and not here.endswith(".") and not after.startswith("•") and not after[0].isupper():
            out.append(f"{here} {after}")
            n = 2
        else:
            out.append(here)
            n = 1
        i += n
    return out


def _goes_on(here: str, after: str) -> bool:
    """Whether a fragment is continued by the next: a word or number cut off, or a scrap before a word in lower case."""
    if not here or not after:
        return False
    return here[-1].isalnum() and after[0].isalnum() and not after[0].isupper() or here.isdigit() and after in _SUFFIX or len(here) < 3 and here.isalnum() and after[0].islower()


def rebuilt_blocks(blocks: Sequence[str], ahead: int = 4) -> list[str]:
    """Text blocks of a page with fragments merged: ordinals, bullets with up to `ahead` blocks behind them, cut sentences."""
    out, i = [], 0
    while i < len(blocks):
        here = blocks[i].strip()
        rest = [b.strip() for b in blocks[i + 1 : i + 1 + ahead]]
        made, used = here, 1
        ordinal, n = _ordinal(blocks, i, ("and", "&", ","))
        if n:
            made, used = ordinal, n if " and " in ordinal or " & " in ordinal else 2
        elif here[:1] in ("•", "●", "-", "*") and here:
            behind = []
            for b in rest if len(here) == 1 else ():
                if re.match(r"[•●*-]", b):
                    break
                behind += [b] if b else []
            text = here[1:].strip() or " ".join(behind)
            made, used = f"● {text}", 1 if here[1:].strip() else max(1, min(len(text.split()), 3))
        elif rest and _goes_on(here, rest[0]):
            parts = [here]
            for b in rest:
                if not _goes_on(parts[-1], b):
                    break
                parts.append(b)
            made = " ".join(parts)
        out.append(made)
        i += used
    return out


def items(lines: Sequence[str]) -> list[str]:
    """The items of a section: a bullet or number opens one, a line in lower case or of under three words goes on with it."""
    groups: list[str] = []
    for line in filter(None, map(str.strip, joined_fragments(lines))):
        if groups and not _BULLET.match(line) and (not line[0].isupper() or len(line.split()) < 3):
            groups[-1] += " " + line
        else:
            groups.append(line)
    return [x for x in map(cleaned_item, groups) if x]


# ---------------------------------------------------------------------------------------------- headers


def header_key(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", (text or "").strip().lower()))


_JOINED = "|".join(LABEL_OF)
_LONGEST = max(map(len, LABEL_OF))  # a text twice as long has no ratio of 0.75 with any
_ANY_SYNONYM = re.compile("|".join(sorted({w for w in LABEL_OF if not any(o != w and o in w for o in LABEL_OF)})))  # those that hold no other


@lru_cache(maxsize=200_000)
def _likeness(core: str) -> str:
    """'equal', 'like' (one holds the other, or a ratio of 0.85), 'near' (0.75) or '': a text beside the synonyms."""
    plain = re.sub(r"[^a-z0-9\s]+", " ", core).strip()
    if plain in LABEL_OF or core in LABEL_OF:
        return "equal"
    if plain and (plain in _JOINED or _ANY_SYNONYM.search(plain)):
        return "like"
    best = max((r for s in LABEL_OF if (r := _ratio(plain or core, s, 0.75))), default=0.0) if len(plain or core) < 2 * _LONGEST else 0.0
    return "like" if best >= 0.85 else "near" if best >= 0.75 else ""


_MATCHERS = {s: SequenceMatcher(None, "", s) for s in LABEL_OF}  # each keeps the index of its synonym


def _ratio(a: str, synonym: str, least: float) -> float:
    """The ratio of matching blocks, 0 where it can't reach `least`."""
    if 2 * min(len(a), len(synonym)) < least * (len(a) + len(synonym)):
        return 0.0
    m = _MATCHERS[synonym]
    m.set_seq1(a)
    return m.ratio() if m.quick_ratio() >= least else 0.0


def header_score(line: str, at: Place = Place()) -> float:
    """How much a line looks like a header, from 0 to 1: its words, its print, its place. Without print data the words and case count more."""
    text = (line or "").strip()
    if not text:
        return 0.0
    plain_print = at.font in (None, 12.0) and not at.bold
    core = re.sub(r"\s+", " ", re.sub(r"^[\W_]+|[\W_]+$", "", re.sub(r":\s*$", "", re.sub(r"^[•●*\s-]*", "", text)).strip().lower())).strip()
    ends = bool(re.search(r"\.\s*$", text))
    score = {"equal": (0.55, 0.65), "like": (0.30, 0.40), "near": (0.0, 0.25), "": (0.0, 0.0)}[_likeness(core) if core else ""][plain_print]
    if at.font and at.font != 12.0 and at.y is not None and at.median:
        score += min(0.35, max(0.0, 0.35 * (min(2.0, at.font / at.median) - 1)))
    if at.y is not None and at.above is not None:
        score += 0.15 * min(1.0, max(0.0, at.y - at.above) / 24.0)
    parts = (
        (bool(at.bold), 0.15),
        (plain_print and text.endswith(":"), 0.20),
        (plain_print and len(text) <= 50 and (text.isupper() or text.istitle()), 0.15),
        (at.x is not None and at.margin is not None and abs(at.x - at.margin) <= 10.0, 0.10),
        (text.isupper() and len(text.split()) <= 5, 0.20),
        (bool(_EMAIL.search(text) or _URL.search(text) or _PHONE.search(text) or _PAGE.search(text)), -0.30),
        (len(text) > 100, -0.30),
        (ends, -0.15),
    )
    return max(0.0, min(1.0, score + sum(w for holds, w in parts if holds)))


def is_header(line: str, at: Place = Place()) -> bool:
    """Whether a line opens a section by its score; one that ends with a full stop doesn't."""
    return header_score(line, at) >= THRESHOLD and not re.search(r"\.\s*$", line.strip())


_INLINE = re.compile(INLINE)


def inline_header(line: str) -> bool:
    """Whether a line among others looks like a header: by its score, mostly capitals, or a header word in up to 60 characters."""
    text = re.sub(r"^[•●*\s-]+", "", line or "").strip()
    if not text:
        return False
    letters = sum(map(str.isalpha, text))
    capitals = len(text) <= 80 and len(text.split()) <= 8 and letters and sum(map(str.isupper, text)) / letters >= 0.6
    return header_score(text) >= THRESHOLD or bool(capitals) or len(text) <= 60 and bool(_INLINE.search(text.lower()))


# What only contents hold.
_DONE = "responsible for|managed|developed|created|implemented|achieved|improved|led|supervised|coordinated|worked|assisted|helped|supported|supervisors after completing work experience|tips|note|remember|keep in mind"
_CONTENT = re.compile(rf"(?i)^[•*-]|^\d+\.|\b\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|{_EMAIL.pattern}|{_PHONE.pattern}|{_DONE}")


def clearly_content(line: str) -> bool:
    """Whether a line can be no header: a bullet or number, long, with a date or contact, or with a word of doing."""
    return len(line) > 80 or bool(_CONTENT.search(line))


def label_of(header: str, content: Sequence[str] = ()) -> str:
    """The label of a section: by an equal header, one of a ratio of 0.9, or at least two (of experience three) telling words in contents of over 50 characters; else misc."""
    key = header_key(header)
    if key in LABEL_OF:
        return LABEL_OF[key]
    if near := _nearest(key):
        return near
    text = " ".join(content).lower()
    hits = {label: sum(w in text for w in words.split("|")) for label, words in HINTS.items()} if len(text) > 50 else {}
    best = max(hits, key=hits.__getitem__, default=None)
    return best if best and hits[best] >= (3 if best == "experience" else 2) else "misc"


@lru_cache(maxsize=200_000)
def _nearest(key: str) -> str | None:
    ratios = {s: _ratio(key, s, 0.9) for s in LABEL_OF} if key and len(key) < 2 * _LONGEST else {}
    best = max(ratios, key=ratios.__getitem__, default=None)
    return LABEL_OF[best] if best and ratios[best] >= 0.9 else None


# ---------------------------------------------------------------------------------------------- segmentation


def cut(lines: Sequence[str], opens: Callable[[int, str], str | None], first: str | None = "Resume Content") -> list[Section]:
    """lines as sections: opens gives the header that a line opens a section with, or None. Empty sections are left out; what goes before
    the first header has the header `first`."""
    out: list[Section] = []
    header, content = first, []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if line and (new := opens(i, line)) is not None:
            out += [Section(header.strip(), content)] if header and content else []
            header, content = new, []
        elif line or content:
            content = [*content, raw] if len(content) < 1 else (content.append(raw) or content)
    return out + ([Section(header.strip(), content)] if header and content else [])


def inline_sections(lines: Sequence[str]) -> list[Section]:
    return cut(lines, lambda i, line: line if inline_header(line) else None)


_ALIASES = [(re.compile(rf"\b{re.escape(a)}\b"), a) for a in LABEL_OF]
_ANY_ALIAS = re.compile("|".join(map(re.escape, LABEL_OF)))


def _aliased(lines: Sequence[str]) -> Callable[[int, str], str | None]:
    """The header of a line by an alias it is, starts with or, if short, holds; or by its form, if what follows isn't as short."""

    def opens(i: int, line: str) -> str | None:
        low = line.lower()
        for word, alias in _ALIASES if _ANY_ALIAS.search(low) else ():
            if low == alias or low.startswith((alias + ":", alias + " ")) or len(line) <= 60 and word.search(low):
                return alias.title()
        after = lines[i + 1].strip() if i + 1 < len(lines) else None
        if after is None or after and (after.isupper() or len(after.split()) <= 3):
            return None
        if line.endswith(":"):
            return line[:-1].strip() if len(line) <= 60 else None
        return line if len(line) <= 50 and (line.isupper() or line.istitle()) and len(line.split()) <= 6 else None

    return opens


def aliased_sections(lines: Sequence[str]) -> list[Section]:
    return cut(lines, _aliased(lines))


_FAMILY = {name: (frozenset(words.split("|")), re.compile(rf"(?i)\b(?:{words})\b")) for name, words in FAMILIES.items()}


def family_of(line: str) -> str | None:
    """The family whose word a line is or, if it is short, ends with a colon or is in capitals, holds."""
    low = line.lower()
    if len(line) > 60 and not line.endswith(":"):
        return None
    for name, (words, pattern) in _FAMILY.items():
        if low in words or low[-1:] == ":" and low[:-1] in words or (len(line) <= 40 or line.endswith(":") or line.isupper() or line.istitle()) and pattern.search(line):
            return name
    return None


def family_sections(lines: Sequence[str]) -> list[Section]:
    return cut(lines, lambda i, line: f.title() if (f := family_of(line)) else None)


def split_embedded(sections: Sequence[Section]) -> list[Section]:
    """Sections cut at headers that stand among their contents. One pass leaves none, so it is the fixpoint."""
    return [s for x in sections for s in cut(x.content, lambda i, line: line if inline_header(line) or is_header(line) else None, x.header)]


def _candidates(lines: Sequence[str], places: Sequence[Place]) -> list[tuple[int, str]]:
    """(line, header) of the header lines; of those at most two lines apart the best: by score, font, left place, later line."""
    kept: list[tuple[int, str, tuple]] = []
    for i, raw in enumerate(lines):
        line = raw.strip()
        at = places[i] if i < len(places) else Place()
        if line.startswith("##") and line.lstrip("#").strip():
            new = (i, line.lstrip("#").strip(), (1.0, 16.0, 0.0, i))
        elif is_header(line, at):
            new = (i, line, (round(header_score(line, at), 6), at.font or 0.0, -(at.x or 0.0), i))
        else:
            continue
        if kept and i - kept[-1][0] <= 2:
            kept[-1] = max(kept[-1], new, key=lambda c: c[2][:3] + (c[2][3] if c[2][:3] == kept[-1][2][:3] == new[2][:3] else 0,))
        else:
            kept.append(new)
    return [(i, h) for i, h, _ in kept]


def detected(lines: Sequence[str], places: Sequence[Place] = ()) -> list[Section]:
    """The sections of a document. By scored headers; where there are none, contact lines at the head, then aliases in lines, then
    families of words, then all as one."""
    headers = _candidates(lines, places)
    if not headers:
        n = 0
        for i, line in enumerate(lines[:15]):
            if has_contact(line) or n and i < n + 2:
                n = i + 1
        found = [Section("Contact Information", list(lines[:n]))] if n else []
        rest = lines[n:]
        found += next((s for f in (aliased_sections, family_sections) if len(s := f(rest)) > 1), [Section("Resume Content", list(rest))] if rest else [])
    else:
        found = []
        for k, (i, header) in enumerate(headers):
            end = headers[k + 1][0] if k + 1 < len(headers) else len(lines)
            content = [x for x in map(str.strip, lines[i + 1 : end]) if x]
            if k and len(content) < 2 and sum(map(len, content)) < 60:
                continue  # a header right before another
            if grouped := items(content):
                found.append(Section(header, grouped))
    return with_core(split_embedded(found), lines)


CORE = ("experience", "skills", "education")


def with_core(sections: Sequence[Section], lines: Sequence[str]) -> list[Section]:
    """Sections with labels; one that holds over 80 % of all as the only one is split again, core ones that are missing are looked for
    behind lines that are their headers."""
    out = [replace(s, label=label_of(s.header, s.content)) for s in sections]
    total = sum(len(x) for s in out for x in s.content)
    if len(out) == 1 and out[0].label == "experience" and total:
        inner = [y for x in out[0].content for y in x.split("\n")]
        parts = next((s for f in (aliased_sections, family_sections) if len(s := f(inner)) > 1), None)
        if parts:
            return [replace(s, label=label_of(s.header, s.content)) for s in parts]
    missing = {c for c in CORE if all(s.label != c for s in out)}
    if out and missing and (len(out) > 1 or total < 1000):
        marks = []
        for i, line in enumerate(lines):
            label = label_of(line.strip()) if line.strip() else None
            if label in missing:
                missing.discard(label)
                marks.append((i, line.strip(), label))
        for k, (i, header, label) in enumerate(marks):
            end = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
            if content := items([x.strip() for x in lines[i + 1 : end] if x.strip()]):
                out.append(Section(header, content, label))
    return out


# ---------------------------------------------------------------------------------------------- repairs

_LEVEL, _AREA = "senior|junior|lead|staff|principal|associate|assistant", r"software|web|mobile|data|full[- ]?stack|frontend|backend|devops|cloud|systems?"
_JOB = rf"\b(?:(?:{_LEVEL})?\s*(?:{_AREA})?\s*(?:engineer|developer|architect|analyst|manager|director|specialist|consultant|designer|scientist|administrator)|intern|internship|CEO|CTO|CFO|COO|VP|President|Founder)\b"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_TITLE, _DATED = re.compile(rf"(?i){_JOB}"), re.compile(rf"(?i){_MONTH}\s*(?:\d{{4}}|\d{{2}})|\d{{1,2}}/\d{{2,4}}|\d{{4}}\s*[-–—]\s*(?:\d{{4}}|present|current|now)|(?:present|current|now)\b")
_SPAN = re.compile(rf"(?i){_MONTH}\s*\d{{4}}\s*[-–—]\s*(?:{_MONTH})?\s*(?:\d{{4}}|present|current|now)")
_FIRM = re.compile(r"(?i)\b(?:Inc|LLC|Corp|Ltd|Limited|Company|Co\.|Corporation)\b")
_OPENS_EXPERIENCE = re.compile(r"(?i)^(?:(?:work|professional|relevant)\s+experience|experience|employment(?:\s+history)?|work\s+history|career(?:\s+history)?|e\s*x\s*p\s*e\s*r\s*i\s*e\s*n\s*c\s*e|w\s*o\s*r\s*k)\s*:?\s*$")
_TELLS_EXPERIENCE = re.compile(rf"(?i)\bwork(?:ed|ing)?\s+(?:at|for|with)\b|\b(?:19|20)\d{{2}}\s*[-–—]\s*(?:19|20)\d{{2}}|present|current\b|{_JOB}|\b(?:responsible for|managed|developed|designed|implemented|built|created|led|experience|employment|history)\b")
_TELLS_EDUCATION = re.compile(r"(?i)bachelor|master|phd|doctorate|degree|university|college|gpa|graduated")


def resplit(content: Sequence[str], name: str) -> list[Section]:
    """A section that swallowed experience, split: at its headers; else at the first title with a date, title before a date or firm, or span of
    dates; else at the first line that tells of experience, if most lines stand behind it. Unsplit if none is found."""
    whole = [Section(name.title(), list(content))]
    if not content or not _TELLS_EXPERIENCE.search(" ".join(content)):
        return whole
    by_header = cut(content, lambda i, line: "Experience" if _OPENS_EXPERIENCE.match(line) else None, name.title())
    if len(by_header) > 1:
        return by_header
    after = lambda i: content[i + 1].strip() if i + 1 < len(content) else ""
    passes = (
        (2, lambda i, x: _TITLE.search(x) and _DATED.search(x)),
        (2, lambda i, x: _TITLE.search(x) and (_DATED.search(after(i)) or _FIRM.search(after(i)))),
        (3, lambda i, x: _SPAN.search(x)),
    )
    at = next((i for start, holds in passes for i, x in enumerate(content) if i >= start and holds(i, x.strip())), None)
    if at is None:
        kept = 0
        for i, x in enumerate(content):
            if i and (_TITLE.search(x) or _DATED.search(x)):
                at = i
                break
            if not (_TELLS_EDUCATION.search(x) or i < 3) and kept >= 5:
                at = i
                break
            kept += 1
        if at is None or len(content) - at <= at:
            return whole
    return [Section("Education", list(content[:at])), Section("Experience", list(content[at:]))]


def by_label(sections: Iterable[Section]) -> dict[str, str]:
    """The texts of the sections of each label, joined."""
    out: dict[str, list[str]] = {}
    for s in sections:
        out.setdefault(s.label, []).extend(s.content)
    return {k: t for k, v in out.items() if (t := " ".join(v).strip())}


def repaired(sections: Sequence[Section], least: int = 100, bloated: int = 2000) -> list[Section]:
    """Sections of which education, or else misc, of over 2,000 characters is split again where experience has under 100."""
    texts = by_label(sections)
    have = len(texts.get("experience", ""))
    leak = next((k for k in ("education", "misc") if len(texts.get(k, "")) > bloated), None) if have < least else None
    if leak is None:
        return list(sections)
    told = lambda h: "experience" if re.search("experience|work|employment", h) else "education" if re.search("education|academic", h) else leak
    out: list[Section] = []
    for s in sections:
        parts = resplit(s.content, leak) if s.label == leak else [s]
        out += [replace(p, label=told(p.header.lower())) for p in parts] if len(parts) > 1 else [s]
    return out if len(by_label(out).get("experience", "")) > have else list(sections)


def checked(sections: Iterable[Section]) -> list[Section]:
    """Sections with each item cleaned up once more; empty ones are left out."""
    done = [replace(s, content=[x for x in map(cleaned_item, s.content) if x]) for s in sections]
    return [s for s in done if s.content]


def document_sections(text: str | None, places: Sequence[Place] = ()) -> list[Section]:
    """The whole chain on a text. Where no experience is found in it, the whole text stands in as one combined section."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    lines = cleaned_lines(without_repeats(normalized_lines(lines))) if not places else lines
    found = [replace(s, label=label_of(s.header, s.content)) for s in checked(detected(lines, places))]
    found = repaired(found)
    if lines and not by_label(found).get("experience"):
        found = [*found, Section("Combined Section", [" ".join(lines)], "experience")] if found else [Section("Combined Section", [" ".join(lines)], "misc")]
    return found


# ---------------------------------------------------------------------------------------------- buckets and summary

# Words of a header that settle its bucket, tried in turn.
_EARLY = (("skills", "skill|skills|technology|technologies|tool|tools"), ("education", "education|educational|academic|college|university|school|degree|bachelor|masters|phd"), ("misc", "training|trainings|seminar|seminars|workshop|workshops|objective|objectives|summary|profile|personal|contact"))
_TOLD_BY_TEXT = (("experience", "experience|responsibilities|work history"), ("skills", "skill|technologies|tech stack|proficient"), ("education", "university|college|school|bachelor|degree|education"))


def bucket_of(header: str, text: str = "") -> str:
    """experience, skills, education or misc: by words of the header, an alias all of whose words it has, or, without a real header, the text."""
    low = (header or "").strip().lower()
    words = set(re.findall(r"\b[a-z]+\b", low))
    for bucket, told in _EARLY:
        if not words.isdisjoint(told.split("|")):
            return bucket
    singular = lambda a: a[:-3] + "y" if a.endswith("ies") else a[:-1] if a.endswith("s") else a
    for bucket in CORE:
        for alias in SYNONYMS[bucket].split("|"):
            if set(alias.split()) <= words or singular(alias) in words or alias == "experience" and "experiences" in words:
                return bucket
    if low in ("resume content", "general information"):
        return next((b for b, told in _TOLD_BY_TEXT if any(w in text.lower() for w in told.split("|"))), "misc")
    return "misc"


def buckets(sections: Iterable[Section], skills_of: Callable[[str], Iterable[str]] = lambda t: (), loose: Iterable[str] = (), longest: int = 250) -> dict[str, str]:
    """The four texts experience, skills, education, misc. Skills named in a skills header count; of loose lines (up to 250 characters), those that
    bring a skill not there yet are added to skills, in order."""
    out: dict[str, list[str]] = {k: [] for k in (*CORE, "misc")}
    for s in sections:
        text = " ".join(x.strip() for x in s.content if x.strip())
        bucket = bucket_of(s.header, text)
        named = " ".join(sorted(set(skills_of(s.header)))) if bucket == "skills" else ""
        if both := " ".join(filter(None, (named, text))):
            out[bucket].append(both)
    have = set(skills_of(" ".join(out["skills"])))
    for line in map(str.strip, loose):
        if line and len(line) <= longest and (new := set(skills_of(line)) - have):
            out["skills"].append(line)
            have |= new
    return {k: " ".join(v).strip() for k, v in out.items()}


def status_of(texts: dict[str, str]) -> tuple[bool, str]:
    """(parsing_ok, reason): a document without any core text wasn't parsed."""
    ok = any(texts.get(k) for k in CORE)
    return ok, "ok" if ok else "no_canonical_sections"


# What tells that a document has contents of a kind, in headers and in contents.
_HAS = {
    "has_education": ("education", "degree|university|college|school|bachelor|master|phd|diploma|certification|graduated"),
    "has_experience": ("experience|employment|work|career", "experience|employment|work|position|job|company|employer|responsible for|managed|developed"),
    "has_skills": ("skill", "skills|competencies|proficient|expertise|technical|programming|software"),
}


def summary_of(sections: Sequence[Section], lines: Sequence[str]) -> dict[str, object]:
    """Counts, names of sections and what kinds of contents a document has."""
    headers, text = " ".join(s.header for s in sections).lower(), " ".join(s.text for s in sections).lower()
    reach = any(_EMAIL.search(x) or _PHONE.search(x) or re.search("street|avenue|road|drive|phone|email|address", x.lower()) for x in lines[:15])
    has = {k: bool(re.search(h, headers) or re.search(c, text)) for k, (h, c) in _HAS.items()}
    return {"total_sections": len(sections), "section_names": [s.header for s in sections], "has_contact_info": bool(reach), **has}


# ---------------------------------------------------------------------------------------------- on frames


def sectioned(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, header, label, items): the sections of each text. Null, empty and blank texts have none; rows are independent."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s) for i, t in enumerate(b.column(1).to_pylist()) for k, s in enumerate(document_sections(t))]
            cols = [b.column(0).take(pa.array([i for i, _, _ in rows], pa.int32())), pa.array([k for _, k, _ in rows], pa.int32())]
            cols += [pa.array([s.header for *_, s in rows], pa.string()), pa.array([s.label for *_, s in rows], pa.string()), pa.array([s.content for *_, s in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [key, "ord", "header", "label", "items"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ord int, header string, label string, items array<string>")
