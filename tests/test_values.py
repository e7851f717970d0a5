"""Splitting of packed fields: cases by hand, and a brute-force version on generated fields."""

import random

import pytest

from millrace.operators.values import split_values

CASES = {
    "a, b ,c": ["a", "b", "c"],
    ",a,, b,": ["a", "b"],
    '"x, y";z;"say ""hi"""': ["x, y", "z", 'say "hi"'],
    '["a", "b, c", "d \\"e\\"", "\\u00e9"]': ["a", "b, c", 'd "e"', "é"],
    "'p' 'q r'": ["p", "q r"],
    "x\\, y, z": ["x, y", "z"],
    "glass (tin, steel), wood": ["glass (tin, steel)", "wood"],
    "3,000+ seats,two": ["3,000+ seats", "two"],
    "- one, still one\n- two": ["one, still one", "two"],
    "1) one 2) two": ["one", "two"],
    "(1) one; (2) two": ["one", "two"],
    "• one\r\n• two": ["one", "two"],
    'so-called "hot" desks, b': ['so-called "hot" desks', "b"],
    "C-Lattice, .Fen hosting": ["C-Lattice", ".Fen hosting"],
    "oil/gas / rail": ["oil/gas", "rail"],
    "a    b": ["a", "b"],
    "alone": ["alone"],
    "a,a": ["a", "a"],
    "0, x": ["0", "x"],
}


def collect(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id int, f string, item string")
    out = {}
    for r in split_values(df, "id", ["f"], **kw).collect():
        out.setdefault(r.id, {})[r.pos] = r.item
        assert r.n_values >= 1
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_cases(spark):
    rows = [(i, text, "clash") for i, text in enumerate(CASES)]
    got = collect(spark, rows)
    for i, (text, items) in enumerate(CASES.items()):
        assert got.get(i) == items, text


def test_conjunctions_are_told_by_the_whole_table(spark):
    rows = [(1, "rail; telecom; food & drink; health and safety", ""), (2, "rail and telecom", ""), (3, "rail, health and safety", ""), (4, "x, telecom and rail", ""), (5, "x, y, and telecom", "")]
    got = collect(spark, rows)
    assert got[2] == ["rail", "telecom"]
    assert got[3] == ["rail", "health and safety"]
    assert got[4] == ["x", "telecom", "rail"]
    assert got[5] == ["x", "y", "telecom"]


def test_nothing(spark):
    assert collect(spark, [(1, None, ""), (2, "", ""), (3, " \t ", ""), (4, ",;,", "")]) == {}
    assert collect(spark, []) == {}


def test_long_field(spark):
    assert len(collect(spark, [(1, ",".join(f"v{i}" for i in range(20000)), "")])[1]) == 20000


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta gamma", "delta/x", "so (a, b)", "1,000 x", "a, b", "q;r"]
    rows, want = [], {}
    for i in range(60):
        items = [rng.choice(words) for _ in range(rng.randint(1, 6))]
        sep = rng.choice([", ", ";", " | ", "\t", "，", " • "])
        packed = sep.join('"' + w + '"' if any(c in w.replace("(a, b)", "").replace("1,000", "") for c in ",;") else w for w in items)
        rows.append((i, packed, ""))
        want[i] = items
    assert collect(spark, rows) == want
