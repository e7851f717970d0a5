import json

import pyarrow as pa
import pytest

from millrace.llm.one_form import consistent_values, one_form

CASES = {
    "Doсumеnted": "Documented",
    "ＡＢＣ１２": "ABC12",
    "𝐪𝐮𝐞𝐬𝐭": "quest",
    "éa": "éa",
    "ﬁrst oﬃce": "first office",
    "МВA": "MBA",
    "Z‌eox­⁠﻿᠎": "Zeox",
    "x y　z ": "x y z ",
    "fivnјnaа7": "fivnjnaa7",
    "Sοmе": "Some",
}
SAME = ["Русский", "Ελληνικά", "👨‍👩‍👧", "می‌خواهم", "क्‍ष", "a\r\nb\tc", "“x” – ‘y’", "№ ½ ™ ²", "日本語、English", "SQLный", "", "Straße", "กำ"]


@pytest.mark.parametrize("odd", CASES)
def test_case(odd):
    assert one_form(pa.table({"v": [odd]}), "v")["one_form"][0].as_py() == CASES[odd]


def test_same_and_idempotent():
    values = [*SAME, *CASES.values(), None]
    assert one_form(pa.table({"v": pa.array(values, pa.string())}), "v")["one_form"].to_pylist() == values


def test_consistent_values(spark):
    docs = [json.dumps({"skills": [{"skill": "Ｑ"}, {"skill": "ok"}], "misc": "x y"}), None, "", "{cut", "[]", json.dumps({"misc": "\ud800"}), json.dumps({"misc": "a" * 50_000 + "ﬁ"})]
    df = spark.createDataFrame([(i, d, "clash") for i, d in enumerate(docs)], "resume_id long, parsed_data_json string, value string")
    assert sorted((r.resume_id, r.path) for r in consistent_values(df).collect()) == [(0, "misc"), (0, "skills[0].skill"), (6, "misc")]
    assert consistent_values(df.limit(0)).count() == 0
