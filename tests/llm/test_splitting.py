import json

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.splitting import pieces, split_resumes


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab .\n,é👩‍💻"), max_size=600), st.integers(20, 80), st.integers(0, 15))
def test_pieces(text, limit, overlap):
    out = list(pieces(text, limit, overlap))
    assert "".join(text[n:e] for _, n, e in out) == text
    for i, (s, n, e) in enumerate(out):
        assert e - s <= limit and s <= n < e and n - s <= overlap
        assert i == 0 or s >= out[i - 1][0]


def test_natural_boundaries():
    text = "\n\n".join("A sentence here. Another one there." for _ in range(40))
    for s, n, e in list(pieces(text, 200, 20))[1:]:
        assert text[n - 2 : n] == "\n\n"


def test_split_resumes(spark):
    resumes = spark.createDataFrame([(1, json.dumps({"raw_text": "w " * 1500, "misc": "x" * 2000})), (2, None), (3, "{bad" + "x" * 3000), (4, json.dumps({"misc": "ё" * 2001}))], "resume_id long, parsed_data_json string")
    jobs = spark.createDataFrame([("a", "y" * 2001), ("b", "y" * 2000), ("c", None), ("d", "")], "job_id string, description string")
    got = split_resumes(resumes, jobs).collect()
    assert {(r.item_kind, r.item_key, r.path) for r in got} == {("resume", "1", "raw_text"), ("resume", "4", "misc"), ("job_posting", "a", "description")}
    assert all(len(r.piece_text) <= 2000 for r in got)
    assert split_resumes(resumes.limit(0), jobs.limit(0)).count() == 0
