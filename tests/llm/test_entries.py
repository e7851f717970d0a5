import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.entries import Matcher, Trie, allowance, map_values, unlisted

LIST = [(1, "Quemta", []), (2, "Quemta.js", []), (3, "grant spend reporting", ["gsr"]), (4, "Lovpli++", []), (5, "Lovpli", ["lvpl"]), (6, "banner rotation", [])]


def edits(a, b):
    """Edits with swaps of neighbours, none edited twice."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=8, unique=True), st.text("abc", min_size=1, max_size=8))
def test_search_is_brute_force(paths, query):
    trie = Trie()
    for i, p in enumerate(paths):
        trie.add(p, i)
    got = {e: d for e, (d, _) in trie.search(query, 2).items()}
    want = {i: d for i, p in enumerate(paths) if (d := edits(query, p)) <= min(2, allowance(len(p)))}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefgh", min_size=3, max_size=16), st.lists(st.tuples(st.sampled_from("ird"), st.integers(0, 20)), max_size=3))
def test_candidates_reach_every_allowed_path(path, changes):
    window = path
    for how, i in changes:
        i %= len(window) or 1
        window = window[:i] + ("x" if how != "d" else "") + window[i + (how != "i") :]
    got = {e: d for e, d, _ in Matcher([(1, path, [])]).candidates(window)}
    assert got == ({1: d} if (d := edits(window, path)) <= allowance(len(path)) else {})


def test_two_lost_characters():
    assert [e for e, _, _ in Matcher([(1, "abcdefg", [])]).candidates("abcde")] == [1]
    assert [e for e, _, _ in Matcher([(1, "abcdefghijklm", [])]).candidates("abcdefghij")] == [1]


def test_values():
    m = Matcher(LIST)
    for value, entry in {
        "QUEMTA": 1, "quemta js": 2, "Qeumta": 1, "5 years of Quemta.js": 2, "reporting of grant spend": 3, "reporting, grant spend": 3, "GSR": 3, "grantspendreporting": 3, "gran tspend reportin": 3, "Lovpli++ (advanced)": 4,
        "lovpli": 5, "LVPL": 5, "banner rotat.": 6, "banner_rotation": 6, "patience": -1, "???": -1, "banner making": -1, "": -1,
    }.items():
        assert m.match(value) == entry, value


def test_map_values(spark):
    df = spark.createDataFrame([(1, ["Quemta", None, " ", "nope"], None), (2, [], ["Qemta"]), (3, None, None), (1, ["Quemta", None, " ", "nope"], None)], "id long, must array<string>, nice array<string>")
    entries = spark.createDataFrame(LIST, "skill_id int, canonical string, variants array<string>")
    out = map_values(df, "id", ["must", "nice"], entries)
    assert sorted((r.id, r.field_name, r.pos, r.skill_id) for r in out.collect()) == [(1, "must", 0, 1), (1, "must", 0, 1), (1, "must", 3, -1), (1, "must", 3, -1), (2, "nice", 0, 1)]
    assert unlisted(out).collect()[0].n == 2
    assert map_values(df.limit(0), "id", ["must"], entries).count() == 0
    assert {r.skill_id for r in map_values(df, "id", ["must"], entries.limit(0)).collect()} == {-1}


def test_long_value():
    assert Matcher(LIST).match("x" * 100_000) == -1
    assert Matcher(LIST).match(" ".join(random.Random(0).choices(["foo", "bar"], k=5000)) + " Quemta") == 1
