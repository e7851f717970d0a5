"""Records out of a document's sections: roles, education, projects, skills, the person's name.

A record is a block of lines that a header line opens; it is then checked, and what fails goes to misc. The checks are tables of
rules, so that each can be read and tested by itself. `records` runs on Arrow batches, a document at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sections as S

# Words that tell a role, a school, a degree, training, a firm.
JOBS = "engineer|developer|manager|director|analyst|consultant|specialist|scientist|architect|lead|intern|founder|designer|technician|administrator|supervisor|coordinator|advisor|executive|programmer|product owner|qa|quality assurance|scrum master|devops|sre|software|hardware"
SCHOOLS = "university|college|school|academy|institute|polytechnic|technology"
DEGREES = "bachelor|master|mba|bs|ba|ms|phd|associate|diploma|certificate|b.s.|b.a.|m.s.|m.a.|high school|secondary|tertiary|doctorate|bsc|msc|jd|md"
TRAINING = "seminar|workshop|bootcamp|boot camp|course|training|webinar|talk|presentation|orientation|tour|conference|symposium|summit|forum"
FIRMS = " inc| llc| ltd| plc| gmbh| s.r.l| company| corporation| corp| co.| technologies| technology| systems| solutions| studios| studio| labs| partners| holdings| consulting| international| global| limited| enterprises"
SEPARATORS = (" at ", " @ ", " - ", " – ", " — ", " | ", ", ")
# Verbs of doing, at the start of a bullet; the first twelve also mark a title that is a sentence.
VERBS = "integrated|developed|designed|implemented|created|built|managed|led|worked|utilized|redesigned|rebuilt|wrote|collaborated|monitored|set|participated|formulated|presented|provide|organized|conducted|established|maintained|analyzed|configured|deployed|optimized|enhanced"
# Parts of sentences, headings and jobs that no title, or person's name, has.
SENTENCE_PARTS = "with test applications|to conduct|for future|within the"
HEADINGS = "role|roles|responsibilities|summary|objective|projects|activities"
NOT_NAMES = "coordinator|practicum|supervisor|manager|director|analyst|engineer|developer|specialist|consultant|architect|scientist|lead|intern|founder|designer|technician|administrator|officer|programmer|strategist|editor|writer|producer|tester|trainer|teacher|mentor|assistant|associate|executive|president|vice|chief|head|senior|junior|principal|staff"
NOT_NAME_LINES = "resume|cv|curriculum vitae|phone|email|address|objective|summary|profile|experience|education|skills|certifications|projects|achievements|university|college|school|company|inc|llc|corp|software"
ACADEMIC = "bsit|bscs|bs|ba|ma|ms|phd|mba"
# What shows that a line is no degree or school: addresses, objectives, activities.
NOT_EDUCATION = (
    r"\b(?:street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|circle|cir)\b|\b(?:city|state|province|region|country)\b|\b\d{4,5}\b|\b(?:ph|tel|phone|contact|address):",
    r"\b(?:seeking|looking to|aims to|willing to|eager to|want to|hope to|entry-level|entry level|position|role|job|opportunity|where i can|where i will|while contributing|while learning|student|applicant|candidate)\b",
    r"\b(?:provide|organize|assist|mentor|tutor|volunteer|coordinate|mentorship|tutoring|social events|activities|outreach|programming|freshman|underrepresented|majors|transition|1st year|2nd year|stimulate|creativity|fundamental concepts)\b",
)
PROJECT_WORDS = "project|course|class|design|development|system|application|app|tool|platform|programming|personal"

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
SPAN = re.compile(rf"(?i)(?:{_MONTH}\.?[\s/-]+\d{{2,4}}|\d{{1,2}}/\d{{2,4}}|\d{{4}})\s*(?:to|-|–|—)\s*(?:{_MONTH}\.?[\s/-]+\d{{2,4}}|present|current|\d{{4}})")
YEAR, DAY = re.compile(r"\b(?:19|20)\d{2}\b"), re.compile(rf"(?i)^{_MONTH}\s+\d{{1,2}}(?:\s*,\s*\d{{4}})?$")
_CONTACT = re.compile(r"(?i)@|https?://|www\.|linkedin\.|github\.|portfolio")
_BULLET = re.compile(r"^[•●▪‣◦∙*-]+\s*")
_WORDS_OF = {name: re.compile("|".join(map(re.escape, words.split("|")))) for name, words in (("job", JOBS), ("school", SCHOOLS), ("degree", DEGREES), ("training", TRAINING), ("firm", FIRMS), ("project", PROJECT_WORDS), ("not_name", NOT_NAMES), ("not_name_line", NOT_NAME_LINES), ("academic", ACADEMIC), ("sentence", SENTENCE_PARTS))}
_VERB, _TITLE_VERB = re.compile(rf"(?i)(?:{VERBS}) "), re.compile(rf"(?i)(?:{'|'.join(VERBS.split('|')[:12])}) ")
_NOT_EDUCATION = re.compile("(?i)" + "|".join(NOT_EDUCATION))


def tells(kind: str, text: str) -> bool:
    """Whether a text holds a word of the kind, also within another word."""
    return bool(_WORDS_OF[kind].search(text.lower()))


def _separated(text: str) -> bool:
    return any(s in text.lower() for s in SEPARATORS)


def dates_of(lines: Sequence[str]) -> str:
    """The first span of dates in the lines; else the first two different years; else the one; else ''."""
    text = " ".join(lines)
    if m := SPAN.search(text):
        return m.group().strip()
    return " - ".join(list(dict.fromkeys(YEAR.findall(text)))[:2])


def title_and_company(text: str) -> tuple[str, str]:
    """A line cut at the first separator, in the order of SEPARATORS, that it has."""
    line = text.strip().strip("-|•")
    for sep in SEPARATORS:
        at = line.lower().find(sep)
        if at >= 0:
            return line[:at].strip(" ,-|"), line[at + len(sep) :].strip(" ,-|")
    return line, ""


def looks_like_company(text: str) -> bool:
    return bool(text) and not tells("training", text) and (tells("firm", text) or len(text.split()) <= 6 and sum(w[:1].isupper() for w in text.split()) >= 2)


def is_role(line: str) -> bool:
    """Whether a line opens a role: a word of a job, with a separator, date or firm beside it, or in at most 40 characters two words or more."""
    text = re.sub(r"^[\s•●*-]+", "", line.strip())
    if not text or _CONTACT.search(line) or tells("training", text) or DAY.match(text) or not tells("job", text):
        return False
    told = _separated(text) or bool(SPAN.search(text) or YEAR.search(text)) or tells("firm", text)
    return told or len(text) <= 40 and len(text.split()) >= 2


def blocks(lines: Sequence[str], opens: Callable[[str], bool], ends: Callable[[str], bool] = lambda x: False) -> tuple[list[list[str]], list[str]]:
    """(blocks, lines that end one): a block is an opening line and those behind it; lines before the first belong to none."""
    out: list[list[str]] = []
    ended: list[str] = []
    inside = False
    for line in filter(None, map(str.strip, lines)):
        if ends(line) and not (inside and ends is _training_outside):
            ended.append(line)
            inside = False
        elif opens(line):
            out.append([line])
            inside = True
        elif inside:
            out[-1].append(line)
    return out, ended


def _training_outside(line: str) -> bool:
    return tells("training", line) and not is_role(line)


def merged_bullets(lines: Sequence[str]) -> list[str]:
    """The bullets of a role: a line with a mark opens one; without, it goes on with the one before unless that ended and this one, of some
    length, starts a sentence or, after an open end, is long and starts with a verb."""
    out: list[str] = []
    for line in map(str.strip, lines):
        if _CONTACT.search(line) or tells("training", line):
            continue
        mark = _BULLET.match(line)
        text = line[mark.end() :].strip() if mark else line
        if not text:
            continue
        verb, n = bool(_VERB.match(text)), len(text)
        ended = bool(out) and out[-1].endswith((".", "!", "?"))
        if mark or not out or (ended and n >= 20 and (verb and n > 20 or text[0].isupper() and n > 30)) or (not ended and verb and n > 40):
            out.append(text)
        else:
            out[-1] += " " + text
    return out


def experience_of(block: Sequence[str]) -> dict | None:
    """The role of a block; None if its title doesn't hold."""
    header, dates = block[0], dates_of(block)
    title, company = title_and_company(header.replace(dates, "").strip(" -–—|,") if dates else header)
    if not title:
        return None
    if not company:
        company = next((c for x in block[1:3] if looks_like_company(c := x.strip(" -•●"))), "")
    job, firm = tells("job", title), tells("firm", company) if company else False
    wrong = (
        bool(_CONTACT.search(header) or _CONTACT.search(title)),
        tells("training", title),
        title.lower().split()[0] in HEADINGS.split("|"),
        len(title) > 80,
        len(title) > 50 and title.endswith(".") and bool(_TITLE_VERB.match(title)),
        tells("sentence", title),
        not (job or dates or firm),
        len(title.split()) < 2 and not job,
        len(title) > 40 and not (_separated(header) or dates or firm or job),
    )
    if any(wrong):
        return None
    return {"title": title, "company": company, "dates": dates, "description": " ".join(block).strip(), "bullets": merged_bullets(block[1:])}


def education_of(block: Sequence[str]) -> dict | None:
    """The degree, school and year of a block; None if neither a degree (up to 100 characters) nor a school (up to 150) holds."""
    first = lambda holds: next((x.strip() for x in block if holds(x)), "")
    degree = first(lambda x: tells("degree", x))
    school = first(lambda x: tells("school", x)) or first(lambda x: x.strip() != degree and looks_like_company(x.strip()))
    degree = "" if len(degree) > 100 or _NOT_EDUCATION.search(degree) else degree
    school = "" if len(school) > 150 or _NOT_EDUCATION.search(school) else school
    if not (degree or school) or degree and school and len(degree) < 5 and len(school) < 5:
        return None
    return {"degree": degree, "school": school, "year": next((d for x in block if (d := dates_of([x]))), ""), "description": " ".join(block).strip()}


def skill_items(lines: Sequence[str]) -> list[str]:
    """The values between commas, semicolons, slashes, bullets and line ends, each once, as first written."""
    seen: dict[str, str] = {}
    for token in (t.strip() for x in lines for t in re.split(r"[,;/\n\r•●]+", x)):
        if token:
            seen.setdefault(token.lower(), token)
    return list(seen.values())


def _only_date(line: str) -> bool:
    m = SPAN.search(line)
    return bool(DAY.match(line)) or bool(m) and m.group().strip() == line


def is_project(line: str) -> bool:
    """Whether a line opens a project: two of a date, a word of projects, and three words with a capital; no verb of doing in front."""
    words = line.split()
    if len(line) < 15 or _VERB.match(line + " "):
        return False
    told = (bool(SPAN.search(line) or YEAR.search(line)), tells("project", line), len(words) >= 3 and sum(w[0].isupper() for w in words) >= 3)
    return sum(told) >= 2


def projects_of(lines: Sequence[str]) -> list[dict]:
    """The projects of a section's lines. Lines with a verb of doing are bullets, others make the summary (its first 500 characters, the length
    of that field); a title that came before, its dates aside, opens none again."""
    out: list[dict] = []
    seen: set[str] = set()
    now: dict | None = None
    for line in map(str.strip, lines):
        if not line:
            now = None
        elif line.lower().rstrip(":") in ("project", "projects"):
            continue
        elif is_project(line) and not _only_date(line) or now is None and not _only_date(line) and not _VERB.match(line + " ") and len(line) >= 15:
            header = is_project(line)
            name = line[: 150 if header else 100].strip()
            m = SPAN.search(name) if header else None
            bare = (name[: m.start()].strip(" ,-–—") if m else name).lower()
            now = None
            if bare not in seen and len(bare) >= 5:
                seen.add(bare)
                now = {"name": name, "summary": [], "bullets": [], "technologies": []}
                out.append(now)
        elif now is not None:
            now["bullets" if _VERB.match(line + " ") and not _only_date(line) else "summary"].append(" ".join(line.split()))
    return [{**p, "summary": " ".join(p["summary"])[:500]} for p in out]


def person_name(lines: Sequence[str]) -> str:
    """The first of ten lines that is a person's name: two to four words of letters, one with a capital, no job, school, acronym or heading."""
    for line in map(str.strip, lines[:10]):
        words = line.split()
        letters = all(w.replace("-", "").replace("'", "").isalpha() for w in words)
        if 2 <= len(words) <= 4 and letters and any(len(w) > 1 and w[0].isupper() and w[1:].islower() for w in words) and is_person(line) and not tells("not_name_line", line):
            return line
    return ""


def is_person(name: str) -> bool:
    """Whether a name holds no job, acronym of up to four letters, or degree."""
    return not (tells("not_name", name) or tells("academic", name) or any(len(w) <= 4 and w.isupper() for w in name.split()))


def name_of_file(path: str | None) -> str:
    base = os.path.splitext(path or "")[0].replace("_", " ").replace("-", " ")
    return " ".join(w.capitalize() for w in base.split()) or "Unknown Candidate"


def parsed(sections: Sequence[S.Section], lines: Sequence[str] = (), source_file: str | None = None, skills_of=lambda t: ()) -> dict:
    """The record of a document from its sections. Where a kind has none from its own sections, its bucket's text is tried; blocks that don't hold,
    and lines of training, go to misc."""
    texts = S.buckets(sections, skills_of)
    misc: list[str] = []
    of = lambda *words: [x.strip() for s in sections if any(w in s.header.lower() for w in words) for x in s.content if x.strip()]
    loose = lambda text: [x.strip() for x in re.split(r"[\n\r•●]+", text) if x.strip()]

    def build(found: list[str], opens, ends, make) -> list[dict]:
        made, ended = blocks(found, opens, ends)
        misc.extend(ended)
        rows = [(b, make(b)) for b in made]
        misc.extend(" ".join(b) for b, r in rows if r is None)
        return [r for _, r in rows if r]

    roles = lambda found: build(found, is_role, _training_outside, experience_of)
    schools = lambda found: build(found, lambda x: tells("school", x) or tells("degree", x), lambda x: tells("training", x), education_of)
    kinds = {
        "experience": (roles, of("experience", "work", "employment"), loose(texts["experience"])),
        "skills": (skill_items, of("skills", "competencies", "technologies"), [texts["skills"]]),
        "education": (schools, of("education", "academic", "school", "college", "university"), loose(texts["education"])),
    }
    out: dict = {}
    fallback = []
    for kind, (make, own, instead) in kinds.items():
        out[kind] = make(own)
        if not out[kind] and texts[kind]:
            out[kind] = make(instead)
            fallback += [kind] if out[kind] else []
    project = next((s for s in sections if "project" in s.header.lower()), None)
    out["projects"] = projects_of(project.content) if project else []
    ok, reason = S.status_of(texts)
    name = person_name(lines)
    return {**out, "misc": " ".join([texts["misc"], *misc]).strip(), "sections": texts, "candidate_name": name or name_of_file(source_file), "parsing_ok": ok, "parse_reason": reason, "section_fallback": fallback}


def parsed_text(text: str | None, source_file: str | None = None) -> dict:
    """The record of a text, through the whole chain of sections."""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    return parsed(S.document_sections(text), lines, source_file)


_ROLE = pa.struct([("title", pa.string()), ("company", pa.string()), ("dates", pa.string()), ("description", pa.string()), ("bullets", pa.list_(pa.string()))])
_EDUCATION = pa.struct([("degree", pa.string()), ("school", pa.string()), ("year", pa.string()), ("description", pa.string())])
_PROJECT = pa.struct([("name", pa.string()), ("summary", pa.string()), ("bullets", pa.list_(pa.string())), ("technologies", pa.list_(pa.string()))])
FIELDS = {
    "candidate_name": ("string", pa.string()), "experience": ("array<struct<title:string,company:string,dates:string,description:string,bullets:array<string>>>", pa.list_(_ROLE)), "education": ("array<struct<degree:string,school:string,year:string,description:string>>", pa.list_(_EDUCATION)),
    "projects": ("array<struct<name:string,summary:string,bullets:array<string>,technologies:array<string>>>", pa.list_(_PROJECT)), "skills": ("array<string>", pa.list_(pa.string())), "misc": ("string", pa.string()), "parsing_ok": ("boolean", pa.bool_()), "parse_reason": ("string", pa.string()), "section_fallback": ("array<string>", pa.list_(pa.string())),
}


def records(df: DataFrame, key: str, text: str, source_file: str | None = None) -> DataFrame:
    """(key, candidate_name, experience, education, projects, skills, misc, parsing_ok, parse_reason, section_fallback) of each text, null
    and empty ones with empty fields. source_file: the column that names a document where its text doesn't."""
    kind = df.schema[key].dataType.simpleString()
    spec = ", ".join([f"`{key}` {kind}", *(f"{n} {t}" for n, (t, _) in FIELDS.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(2).to_pylist()
            rows = [parsed_text(t, f) for t, f in zip(b.column(1).to_pylist(), files)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], t) for n, (_, t) in FIELDS.items())], [key, *FIELDS])

    return df.select(F.col(key), F.col(text), (F.col(source_file) if source_file else F.lit(None).cast("string")).alias("_file")).mapInArrow(run, spec)
