import pytest

from pyspark.sql import functions as F

from millrace.llm.residue import TemplateTree, classify, may_be_residue, messages, mined, page_verdict, residue, template_of, unfilled_slot, without_residue

PAGES = {
    "Home | Jobs | About\nThe page could not be loaded. Refresh the page.\n© 2011 Some Company": "error",
    "Error 500: something went wrong on our side. Try again in a few minutes.": "error",
    "PLEASE TURN ON JAVASCRIPT TO VIEW THIS PROFILE.": "script",
    "Bitte aktivieren Sie JavaScript, um die Seite zu sehen.\nImprint · Privacy": "script",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.": "filler",
    "Sample text. Replace this text with your own.\nblah blah blah": "filler",
    "Traceback (most recent call last):\n  File \"x.py\", line 3, in f\nKeyError: 'a'": "error",
    "- Cut 404 errors on the job board by 44%.\nLed a team of nine.": None,
    "Wrote the notice shown when JavaScript is disabled in the portal.": None,
    "An ordinary sentence about work.": None,
    "Imprint · Privacy": None,
    "The page could not be loaded.\nShe has led the depot since 2009.": None,
}
SLOTS = ["Dear {{first_name}},", "Salary: <your salary range>", "At [Company] I was in charge of x.", "Contact (enter manager_name) for details.", "Signed, ${NAME}", "Location: [Stadt], den [Datum]", "In this role at TODO: describe role you will lead x.", "«Anrede» «Nachname»", "%%city%%"]
NO_SLOTS = ["Built a mail merge that fills {{first_name}} and {{city}}.", "Owned the REST route /jobs/{id}/candidates and its tests.", "Typed generics such as List<Shift> in the tool.", "Contact removed by the screening tool: [EMAIL], [PHONE].", "Published in two journals [1][2].", "Enter the depot by gate B (enter after 14:00 only by badge).", "Renamed __init__ and $HOME handling.", "up 17% [internal]", "a < b and c > d"]


@pytest.mark.parametrize("text", PAGES)
def test_pages(text):
    assert page_verdict(text) == PAGES[text]


def test_late_furniture_on_a_long_line():
    for end in ("Back to search results", "Imprint · Privacy"):
        for n in (10, 400):
            assert page_verdict("Lorem ipsum dolor sit amet. " * n + "asdf asdf dolor sit " + end) == "filler"
            assert page_verdict("Lorem ipsum dolor sit amet. " * n + "Qwv zzkt brfm plonk " + end) is None
            assert page_verdict("Lorem ipsum dolor sit amet. " * n + "Cras sed quam vel lor " + end) == "filler"


def test_what_passes_the_quick_test_is_all_that_is_not_content():
    for text in PAGES:
        for m in messages(text):
            t = template_of(m)
            assert may_be_residue(t) or classify(t) == "content", t


def test_verdicts_are_the_same_in_any_order_and_partitions(spark):
    texts = [*PAGES, "the error 500-1 page", "the error 500 page", "the error log page", "12 Quarry Lane", "12 Quarry 5", "12 Quarry lane", "Backend Developer\nThis page is temporarily unavailable."] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    runs = [sorted(tuple(r) for r in residue(d).collect()) for d in (df.coalesce(1), df.repartition(3), df.repartition(17), df.orderBy(F.rand(3)))]
    assert runs[0] == runs[1] == runs[2] == runs[3]
    kinds = {i: k for i, k, _ in runs[0]}
    assert all(kinds.get(i) == page_verdict(t) for i, t in enumerate(texts))
    assert kinds.get(texts.index("the error log page")) is None and kinds[len(texts) - 1] == "error"


def test_templates_are_counted_over_all_and_the_tree_is_emptied(spark):
    pages = spark.createDataFrame([([f"error # on {w}", "imprint"],) for w in "abcabc"], "templates array<string>").repartition(3)
    want = [("error # on a", 2, "error"), ("error # on b", 2, "error"), ("error # on c", 2, "error"), ("imprint", 6, "furniture")]
    for most in (1, 2, 1000):
        assert sorted(tuple(r) for r in mined(pages, most=most).collect()) == want
    tree = TemplateTree()
    tree.add("x y z")
    tree.add("x y", 2)
    tree.add("x y z")
    assert tree.size == 2 and sorted(tree.take()) == [("x y", 2), ("x y z", 2)] and tree.size == 0 and tree.take() == []


def test_faults_that_start_like_work():
    for text in ("Failed to load resource: the server responded with a status of 500", "Failed to open the document.", "Restricted to signed in users.", "JavaScript is disabled. Updated browsers only."):
        assert page_verdict(text) in ("error", "script"), text


def test_no_length_matters():
    assert page_verdict("Sample text goes here. " * 100 + "Imprint · Privacy Back to search results") == "filler"
    for n in (60, 61, 400):
        assert unfilled_slot("Some work.\nDear {{" + "a" * n + "}}, hello.")
        assert unfilled_slot("Some work.\nDear ${" + "a" * n + "}, hello.")
        assert unfilled_slot("Some work.\nDear <<" + "a" * n + ">>, hello.")


def test_slots():
    for s in SLOTS:
        assert unfilled_slot("Some work.\n" + s + "\nMore work."), s
    for s in NO_SLOTS:
        assert not unfilled_slot("Some work.\n- " + s + "\nMore work."), s


def test_slots_of_bullets_and_told_ones():
    for s in ("Managed {{team_size}} people.", "Increased sales by [X]% at [Company].", "Led <team name> for two years.", "Replaced {{old_system}} with a new one.", "Published {{number}} papers in journals.", "Wrote build scripts for [Company].", "Worked at {{company}} as {{title}}.", "Managed a team of {{n}} people.", "Interested in [Company]", "Dear {{first_name}}, attached is the mail merge output"):
        assert unfilled_slot("Some work.\n- " + s), s
    for s in ("Wrote a tool that renders {{a}}, {{b}} and {{c}} from a table.", "Documented placeholders such as ${name} for editors.", "Removed the {{city}} tag from letters.", "Checked how {{role}} and ${town} are replaced."):
        assert not unfilled_slot("Some work.\n- " + s), s
    assert page_verdict("Failed to load: error 500.") == "error"
    assert page_verdict("Failed connection. The page could not be loaded.") is None  # the first message has no listed wording
    assert page_verdict("Failed request: the page could not be loaded.") == "error"


def test_residue(spark):
    texts = [None, "", "  \n", "fine", "Dear {{x}},", "Oops! This page took a wrong turn.", "w " * 100_000 + "\nDear {{x}},"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    assert sorted((r.doc_id, r.kind) for r in residue(df).collect()) == [(4, "slot"), (5, "error"), (6, "slot")]
    assert sorted(r.doc_id for r in without_residue(df).collect()) == [0, 1, 2, 3]
    assert residue(df.limit(0)).count() == 0
