"""Sections and records by hand-made cases, and column functions against their counterparts on lists."""

import random

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import extraction as E
from millrace.operators import records as R
from millrace.operators import sections as S


def test_header_scores():
    for line in ("EXPERIENCE", "Work Experience", "Skills:", "EDUCATION", "Technical Skills", "Professional Summary"):
        assert S.is_header(line), line
    for line in ("", "Worked on many things in the north.", "jane@mail.example", "Page 2 of 3", "x" * 120, "Built the education portal and its tests for a bank in the north, then more."):
        assert not S.is_header(line), line
    at = S.Place(font=18.0, bold=True, x=10.0, y=100.0, above=60.0, margin=10.0, median=12.0)
    assert S.header_score("Whatever", at) == min(1.0, 0.35 * 0.5 + 0.15 + 0.15 + 0.10)
    assert abs(S.header_score("Experience", S.Place(font=13.0)) - 0.55) < 1e-9  # other print: no bonus for words without it


def test_kinds_of_lines():
    assert S.inline_header("CORE SKILLS AND TOOLS") and S.inline_header("My volunteer work") and not S.inline_header("a plain line of some length that says nothing at all in particular")
    assert S.clearly_content("• a bullet") and S.clearly_content("2. number") and S.clearly_content("in 2019 there") and not S.clearly_content("Education")
    assert S.family_of("Employment History") == "experience" and S.family_of("Tools:") == "skills" and S.family_of("He went to the market with a number of them and came back") is None


def test_labels():
    assert S.label_of("Work Experience") == "experience" and S.label_of("  ** Qualifications: ") == "education"
    assert S.label_of("Educatoin") == "misc" and S.label_of("Work Experiences") == "experience"  # a ratio of 0.9 or more
    assert S.label_of("Things", ["He managed and developed a product at the company, delivered on time"]) == "experience"
    assert S.label_of("Things", ["short"]) == "misc"


def test_buckets():
    parts = [S.Section("Work Experience", ["Software Engineer at Tech Corp"]), S.Section("Technical Skills", ["Python", "React", "SQL"]), S.Section("Education", ["BS Computer Science"]), S.Section("Projects", ["Built a web app"])]
    got = S.buckets(parts)
    assert got == {"experience": "Software Engineer at Tech Corp", "skills": "Python React SQL", "education": "BS Computer Science", "misc": "Built a web app"}
    of = lambda t: [w for w in ("go", "spark", "sql") if w in t.lower()]
    got = S.buckets([S.Section("Skills", ["SQL"])], of, ["knows sql", "Spark jobs", "more spark", "x" * 251 + " go", "go"])
    assert got["skills"] == "SQL Spark jobs go"
    assert S.bucket_of("resume content", "degree from a college") == "education" and S.bucket_of("Trainings attended") == "misc" and S.status_of(S.buckets([])) == (False, "no_canonical_sections")


def test_fragments_and_items():
    assert S.joined_fragments(["1", "st", "and", "2", "nd", "place", "•", "won a prize", "Short", "goes on", "Ends."]) == ["1st and 2nd", "place", "● won a prize", "Short goes on", "Ends."]
    assert S.rebuilt_blocks(["3", "rd", "•", "Led", "a team", "- done", "A sent", "ence of words"])[:2] == ["3rd", "● Led a team"]
    assert S.items(["- One item", "goes on", "- Second item of two", "A New Line Of Text"]) == ["● One item goes on", "● Second item of two", "A New Line Of Text"]
    assert S.cleaned_item("mail me: a@b.example") == "" and S.cleaned_item("●●●●") == "" and S.cleaned_item("the 2ndth  place ( won )") == "the 2nd place (won)"


def test_normalized_lines():
    assert S.normalized_lines(["E X P E R I E N C E", "ﬁne text EDUCATION University of X", "* bullet", "ta-\nble"]) == ["EXPERIENCE", "fine text", "EDUCATION", "University of X", "● bullet", "table"]
    assert S.cleaned_lines(["Page 2 of 3", "Resume", "x", "•", "Note: hold", "kept"]) == ["•", "kept"]
    assert S.without_repeats(["A", "a", "a", "a", "b"]) == ["b"]


def test_detection_and_its_fallbacks():
    text = "Jane Roe\njane@mail.example\n\nWORK EXPERIENCE\nSoftware Engineer at Foo GmbH\n- Built a thing for the bank in the north\n- Ran the night shift for two years\nEDUCATION\nBSc Informatics, a university in the south\nFinished with honours and a thesis\nTECHNICAL SKILLS\nPython, SQL, Spark\nAnd many other tools"
    assert {"experience", "education", "skills"} <= {s.label for s in S.document_sections(text)}
    lines = ["Experience", "was there for some time, as it were", "Skills: many", "python and more of it here"]
    assert [s.header for s in S.aliased_sections(lines)] == ["Experience", "Skills"]
    assert S.document_sections("nothing here tells of any kind of thing at all")[-1].header == "Combined Section" and S.document_sections(None) == [] == S.document_sections("") == S.document_sections(" \n ")
    (md,) = [s for s in S.detected(["## Skills", "Python and Spark and other things", "More of those things here"]) if s.header == "Skills"]
    assert md.label == "skills"


def test_resplit_and_repair():
    school = ["Bachelor of Arts, a university", "Graduated with a degree"]
    jobs = ["Senior Software Engineer, Foo Inc, Jan 2019 - Mar 2021", "Developed the billing of a bank"]
    assert [s.header for s in S.resplit([*school, *jobs], "education")] == ["Education", "Experience"]
    assert [s.content for s in S.resplit([*school, "Work Experience", *jobs], "education")] == [school, jobs]
    assert len(S.resplit(["a plain line", "another"], "education")) == 1
    big = S.Section("Education", [*school, *jobs, *["Developed a lot of things for many people there"] * 50], "education")
    assert {s.label for s in S.repaired([big])} == {"education", "experience"}
    small = S.Section("Education", [*school, *jobs], "education")
    assert S.repaired([small]) == [small]


def test_records_filter_training():
    sections = [
        S.Section("Professional Experience", ["Software Engineer at Tech Corp | Jan 2018 - Mar 2022", "Built scalable systems in Python and AWS."]),
        S.Section("Professional Experience", ["Role Based Access Control", "EADevOps team collaboration", "Jenkins job creation process"]),
        S.Section("Education", ["University of Somewhere", "Bachelor of Science in Computer Science", "2014 - 2018", "Net 25 Studio Tour - 2015"]),
    ]
    got = R.parsed(sections)
    assert got["experience"][0]["title"].lower().startswith("software engineer") and got["experience"][0]["dates"] == "Jan 2018 - Mar 2022"
    assert len(got["education"]) >= 1 and "Studio Tour" in got["misc"] and not any("Tour" in e["title"] for e in got["experience"])


def test_roles_and_education():
    assert R.is_role("Data Analyst, Foo Ltd") and R.is_role("Site Manager") and not R.is_role("Workshop for engineers") and not R.is_role("mail: engineer@x.example") and not R.is_role("An engineer is somebody who builds what others dream of")
    assert R.title_and_company("Nurse at Foo - Bar") == ("Nurse", "Foo - Bar") and R.dates_of(["from 1999 on, until 2004, 1999"]) == "1999 - 2004"
    assert R.merged_bullets(["- One", "goes on", "● Two.", "Developed another thing altogether here", "ok"]) == ["One goes on", "Two.", "Developed another thing altogether here ok"]
    assert R.education_of(["12 Quarry Road, State College"]) is None
    assert R.skill_items(["Python, SQL; python / Go", "• C"]) == ["Python", "SQL", "Go", "C"]


def test_projects_and_names():
    lines = ["Shop Platform Project, 2019 - 2020", "Developed the basket", "A shop for a friend", "Shop Platform Project, 2021 - 2022", "ignored as it has no project of its own", "", "Projects:", "Ward Planner Application System", "Built it"]
    got = R.projects_of(lines)
    assert [p["name"] for p in got][:1] == ["Shop Platform Project, 2019 - 2020"] and got[0]["bullets"] == ["Developed the basket"] and got[0]["summary"] == "A shop for a friend"
    assert R.person_name(["Curriculum Vitae", "Senior Engineer", "Jane Roe-Smith"]) == "Jane Roe-Smith" and R.person_name(["MBA Holder"]) == ""
    assert R.name_of_file("jane_roe-cv.pdf") == "Jane Roe Cv" and R.name_of_file(None) == "Unknown Candidate"


def test_frames(spark):
    df = spark.createDataFrame([(1, "EXPERIENCE\nSite Manager at Foo\nRan the depot in the north for years", "clash"), (2, None, "x"), (3, "", "x"), (1, "EXPERIENCE\nSite Manager at Foo\nRan the depot in the north for years", "clash")], "id long, text string, label string")
    assert sorted((r.id, r.label) for r in S.sectioned(df, "id", "text").collect())[0] == (1, "experience")
    got = {r.id: r for r in R.records(df, "id", "text").collect()}
    assert got[1].experience[0].title == "Site Manager" and got[2].candidate_name == "Unknown Candidate" and not got[3].parsing_ok
    assert S.sectioned(df.limit(0), "id", "text").count() == 0 == R.records(df.limit(0), "id", "text").count()


def test_columns_agree_with_lists(spark):
    rng = random.Random(4)
    parts = ["1", "st", "ndrd", " ●", "●●●", "*", "- ", "word", "Zürich", "東京", " ( ", ")", ",", ".", "  ", " ", "a@b.example", "555-123-4567", "Main Street", "x, CA 90210", "2 nd"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))).strip() for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, line string").filter("line <> ''")
    got = {r.id: r.item for r in E.cleaned(df, "line").collect()}
    want = {i: c for i, t in enumerate(texts) if (c := S.cleaned_item(t))}
    assert {k for k in want if want[k] != got.get(k)} == set() and len(got) == len(want)


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("Zürich résumé Москва 東京!  Été", "Grüß-\n  en", "Draft\nCV\nTemplate", "  x ")], "a string, b string, c string, d string")
    r = df.select(T.preprocessed(F.col("a")).alias("a"), T.for_dense_models(F.col("a")).alias("m"), T.dehyphenated(F.col("b")).alias("b"), T.scrubbed(F.col("c")).alias("c"), T.without_boilerplate(F.col("c")).alias("k"), T.trimmed(F.col("d")).alias("d"), T.composed(F.lit("ｅ́ﬁ")).alias("n")).first()
    assert r.a == "zürich résumé москва 東京 été" and r.m == "Zürich résumé Москва 東京 Été" and r.b == "Grüßen" and r.c == "Draft Template" and r.k == "" and r.d == "x" and r.n == "éfi"


def test_joined_lines(spark):
    lines = ["One line", "goes on", "and on", "Ends.", "not joined", "x", "über", "Last"]
    want, i = [], 0
    while i < len(lines):
        if i + 1 < len(lines) and lines[i][-1] not in ".!?:;" and lines[i + 1][0].islower():
            want.append(lines[i] + " " + lines[i + 1])
            i += 2
        else:
            want.append(lines[i])
            i += 1
    got = spark.createDataFrame([("\n".join(lines),), ("a\n" * 20000,), (None,), ("",)], "t string").select(T.joined_lines(F.col("t")).alias("o")).collect()
    assert got[0].o == "\n".join(want) and got[1].o.count("\n") == 9999 and got[2].o is None and got[3].o == ""
