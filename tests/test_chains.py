"""Chains of parsers, forms, taxonomies and configurations."""

import json
import time

from millrace.sources import files as X


def test_chain(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"EXPERIENCE\nSite Manager at Foo GmbH\nRan the depot in the north for two years, day and night\fpage two\fthree\ffour")
    (tmp_path / "b.pdf").write_bytes(b"short")
    (tmp_path / "c.pdf").write_bytes(b"\xff\xfe broken")
    (tmp_path / "d.pdf").write_bytes(b"slow file")

    def layout(data):
        if data.startswith(b"slow"):
            time.sleep(3)
        return X.plain_layout(data)

    def plain(data):
        if b"broken" in data:
            raise ValueError("broken")
        return X.plain_text(data)

    rows = {r.path[-5]: r for r in X.parsed_chain(spark, str(tmp_path), layout, plain, lambda d: ["a longer text that was recognized"], seconds=1.0).collect()}
    assert [rows[k].status for k in "abc"] == ["structured", "plain", "failed"] and rows["d"].status != "structured"  # its time ran out
    assert rows["b"].pages == ["a longer text that was recognized"] and {e.page for e in rows["a"].elements} == {0, 1, 2}
    parsed = X.parsed_chain(spark, str(tmp_path / "a.pdf"), most_pages=1)
    assert "experience" in {r.label for r in X.structured_sections(parsed).collect()}
    one = X.single_section(parsed).first()
    assert (one.header, one.n_lines) == ("Resume Content", 3)


def test_recognition():
    long, short = "x" * 250, "y" * 10
    read = lambda d: ["z" * 100, "z" * 5, "z" * 100]
    assert X.recognized([long, short], b"", read) == [long, short]
    assert X.recognized([short, short, short], b"", read) == ["z" * 100, short, short]
    assert X.recognized(["y" * 90], b"", read) == ["y" * 90, "z" * 5]
    assert X.recognized([short], b"", None) == [short]


def test_forms_and_texts(spark, tmp_path):
    (tmp_path / "jd.txt").write_text("line one\nline two")
    assert X.requirement_text(spark, str(tmp_path / "jd.txt")).first().text == "line one\nline two"
    assert X.requirement_text(spark, "we seek\na nurse").first().text == "we seek\na nurse" and X.requirement_text(spark, "/no/such/file.txt").first().text == "/no/such/file.txt"
    r = X.form(spark, {"position_title": " Nurse ", "experience_min_years": "3 years", "must_have_skills": "a, b,,c", "responsibilities": "run, fast\nhold", "keywords": ["x", "y, z"]}).first()
    assert (r.position_title, r.experience_min_years, r.must_have_skills, r.responsibilities, r.keywords, r.languages) == ("Nurse", 3, ["a", "b", "c"], ["run, fast", "hold"], ["x", "y, z"], [])


def test_taxonomy_and_configuration(spark, tmp_path):
    core = spark.createDataFrame([("tableau", "tableau"), ("sql", "sql")], "canonical string, surface string")
    domains = spark.createDataFrame([("data", "tableau", "tab"), ("bi", "tableau", "tableau desktop"), ("off", "sql", "sequel")], "domain string, canonical string, surface string")
    got = {(r.canonical, r.surface, r.domain) for r in X.assembled_taxonomy(core, domains, ["data", "bi"]).collect()}
    assert got == {("tableau", "tableau desktop", "bi"), ("sql", "sql", "core")}
    assert {r.domain for r in X.assembled_taxonomy(core, domains, []).collect()} == {"core"}
    (tmp_path / "c.json").write_text(json.dumps({"fuzzy": {"threshold": 0.8}}))
    (tmp_path / "bad.json").write_text("{bad")
    default = {"fuzzy": {"enabled": False, "threshold": 0.7}, "enabled_domains": []}
    assert X.domain_config(spark, str(tmp_path / "c.json"), default) == {"fuzzy": {"enabled": False, "threshold": 0.8}, "enabled_domains": []}
    assert X.domain_config(spark, str(tmp_path / "bad.json"), default) == default == X.domain_config(spark, str(tmp_path / "none.json"), default)
