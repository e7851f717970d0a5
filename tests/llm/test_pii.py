import json
import random

import numpy as np
import pytest

from millrace.llm import pii

FIRST = ["Amara", "Bojan", "Celine", "Dorte", "Elif", "Fenna"]
LAST = ["Tarnquist", "Velborg", "Ostrander", "Kilmarth", "Pellworth", "Grunwick", "Hallström", "Novarro"]
TOWNS = ["Norrheim", "Dunfall"]


def document(rng):
    """A made-up resume's texts with their pieces: (kind, text of the piece)."""
    f, l = rng.choice(FIRST), rng.choice(LAST)
    name = rng.choice([f"{f} {l}", f"{l}, {f}", f"{f} {rng.choice('ABC')}. {l}", f"{f[0]}. {l}"])
    phone = rng.choice(["+44 20 7946 0123", "(617) 555-0143", "030/23125-849"])
    mail = f"{f.lower()}.{l.lower()}@mail.example"
    street = rng.choice([f"{rng.randint(1, 99)} Quarry Road", f"Calle del Olmo, {rng.randint(1, 99)}", f"Kranichstr. {rng.randint(1, 99)}", f"{rng.randint(1, 99)}, rue des Tanneurs"])
    ssn = f"000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
    lines = [("Ms " + name, [("name", name)]), (f"Reference: {name} ({phone})", [("name", name), ("phone", phone)]), (f"Address: {street}, {rng.choice(TOWNS)}", [("address", street)]), (f"SSN: {ssn}", [("id_number", ssn)]), (f"Email: {mail}", [("email", mail)]), (f"Mentored by {f} {l}.", [("name", f"{f} {l}")])]
    noise = ["Senior Test Engineer at Bluefen Labs", "Part number 000-12-4567 redesigned.", "Winner of the Amara Ostrander College prize 2021.", "Handled PO 88-1203-3697 worth 1,135,450.", "Moved the Quarry Road depot to Dunfall.", "Pinned the builder package to forms@2.58.1.", "01/2016 to 12/2021"]
    rows = [*rng.sample(lines, 4), *[(n, []) for n in rng.sample(noise, 4)]]
    rng.shuffle(rows)
    return [("parsed_data_json", "raw_text", "\n".join(t for t, _ in rows))], [p for _, ps in rows for p in ps]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    return pii.train([document(rng)[0] for _ in range(300)])


def test_held_out(model):
    rng = random.Random(6)
    docs = [document(rng) for _ in range(200)]
    found = pii.Finder(model).find([d for d, _ in docs])
    hit = got = want = 0
    for (doc, pieces), rows in zip(docs, found):
        mine = sorted((k, doc[t][2][a:b].rstrip(".")) for t, k, a, b in rows)
        want += len(pieces)
        got += len(mine)
        rest = list(mine)
        for p in pieces:
            if p in rest:
                rest.remove(p)
                hit += 1
    assert hit / want > 0.95 and hit / got > 0.95


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(0)
    unary = rng.normal(size=4)
    left, right = np.array([0, 1, 2]), np.array([1, 2, 3])  # a tree, where messages are exact
    weight = rng.normal(size=(3, 2, 2))
    odds = pii.propagate(unary, left, right, weight, 60)
    p = np.zeros((4, 2))
    for x in range(16):
        y = [x >> i & 1 for i in range(4)]
        s = np.exp(sum(u * v for u, v in zip(unary, y)) + sum(w[y[a], y[b]] for a, b, w in zip(left, right, weight)))
        for i in range(4):
            p[i, y[i]] += s
    assert np.allclose(odds, np.log(p[:, 1] / p[:, 0]), atol=1e-6)


def test_skip_edges_lift_an_unsure_token():
    unary, skip = np.array([2.0, -0.3]), np.array([[[0.5, -0.5], [-0.5, 0.5]]])
    alone = pii.propagate(unary, np.array([], int), np.array([], int), np.zeros((0, 2, 2)))
    assert alone[1] < 0 < pii.propagate(unary, np.array([0]), np.array([1]), skip)[1]


def test_queries(spark, model):
    texts = [json.dumps({"misc": "Ms Amara Velborg, SSN: 000-12-3456"}), None, "", "{cut", json.dumps({"misc": "x" * 100_000}), json.dumps({"misc": "Ms Amara Velborg, SSN: 000-12-3456"})]
    df = spark.createDataFrame([(i, t, None, "clash") for i, t in enumerate(texts)], "resume_id long, parsed_data_json string, processed_data_json string, kind string")
    got = sorted((r.resume_id, r.kind, r.start_pos) for r in pii.personal_information(df, model=model).collect())
    assert got == [(i, k, a) for i in (0, 5) for k, a in (("id_number", 23), ("name", 3))]
    assert {r.text for r in pii.redacted_texts(df, model=model).collect()} == {"Ms [NAME], SSN: [ID_NUMBER]"}
    assert pii.personal_information(df.limit(0), model=model).count() == 0
    assert pii.personal_information(df.limit(0)).count() == 0


def test_initials_and_forms_of_address(model):
    texts = ["Ms A. Velborg, Phone: 555-0123", "Name: M. Kilmarth", "Mentored by Amara Grunwick and M. Tarnquist.", "Référence : M. Bojan Ostrander, 020 7946 0123", "Zeugnis ausgestellt von Elif Novarro."]
    found = pii.Finder(model).find([[("parsed_data_json", "misc", t)] for t in texts])
    names = [[t[a:b] for _, k, a, b in rows if k == "name"] for t, rows in zip(texts, found)]
    assert names == [["A. Velborg"], ["M. Kilmarth"], ["Amara Grunwick", "M. Tarnquist"], ["Bojan Ostrander"], ["Elif Novarro"]]


def test_lower_case_names(model):
    texts = ["Ms bojan velborg, Phone: 555-0123", "Mentored by elif von novarro in 2019.", "Reference: kilmarth, amara (020 7946 0123)", "we met in the elif of dawn."]
    found = pii.Finder(model).find([[("parsed_data_json", "misc", t)] for t in texts])
    assert [[t[a:b] for _, k, a, b in rows if k == "name"] for t, rows in zip(texts, found)] == [["bojan velborg"], ["elif von novarro"], ["kilmarth, amara"], []]


def test_lower_case_names_behind_announcing_words(model):
    texts = ["Ms a. velborg, Phone: 555-0123", "Reference: b. kilmarth (020 7946 0123)", "Mr zuri pellworth, Phone: 555-0123", "we see p. twelve"]
    found = pii.Finder(model).find([[("parsed_data_json", "misc", t)] for t in texts])
    assert [[t[a:b] for _, k, a, b in rows if k == "name"] for t, rows in zip(texts, found)] == [["a. velborg"], ["b. kilmarth"], ["zuri pellworth"], []]


def test_an_equal_value_settles_an_unsure_number(model):
    doc = [("parsed_data_json", "misc", "SSN: 000-12-4567"), ("parsed_data_json", "raw_text", "Seen 000-12-4567 there.")]

    def found(weight, texts):
        m = pii.Model(model.unary, model.chain, model.skip, weight, model.spelt)
        m.score = lambda f: 3.0 if pii._h("!id_numberLid") in f else -0.5  # sure behind a label, unsure without
        return [(t, k) for t, k, _, _ in pii.Finder(m).find([texts])[0]]

    assert found(2.0, doc) == [(0, "id_number"), (1, "id_number")]
    assert found(0.0, doc) == [(0, "id_number")] and found(2.0, doc[1:]) == []


def test_weights_of_edges_are_learnt(model):
    assert model.skip != 0 and model.spelt != 0 and model.equal == 0  # no value comes twice in these documents


def test_long_numbers_are_candidates():
    long = "Passport number: " + "9" * 29
    assert ("id_number", 17, 46) in pii.candidates(long)


def test_a_number_of_both_forms_is_taken_once(model):
    (rows,) = pii.Finder(model).find([[("parsed_data_json", "misc", "Phone: (617) 555-0143")]])
    assert [k for _, k, _, _ in rows] == ["phone"]
