"""The stemmer on examples of its paper, and scores of names by stems."""

import pytest

from rowloom.functions import names, stemmer
from rowloom.operators import mapping

EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "allowance": "allow", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "a": "a", "is": "is", "y": "y", "": "",
}


@pytest.mark.parametrize("word", sorted(EXAMPLES))
def test_examples(word):
    assert stemmer.stem(word) == EXAMPLES[word]


def test_measure():
    for n, words in enumerate((["tr", "ee", "tree", "y", "by"], ["trouble", "oats", "trees", "ivy"], ["troubles", "private", "oaten", "orrery"])):
        assert {stemmer.measure(w) for w in words} == {n}


def test_scores_of_names(spark):
    df = spark.createDataFrame([("t", n) for n in ("customerEmails", "patient_diagnosis", "invoicePayments", "shipping_city", "key_id", "XMLOrderItems")], "table string, column string")
    got = {(r["column"], r["domain"]): (r["score"], r["rank"]) for r in mapping.score_columns(df).collect()}
    assert got == {
        ("customerEmails", "contact"): (0.8, 1), ("customerEmails", "person"): (0.8, 2), ("patient_diagnosis", "medical"): (0.8, 1), ("patient_diagnosis", "person"): (0.8, 2), ("invoicePayments", "finance"): (1.4, 1),
        ("shipping_city", "location"): (0.8, 1), ("shipping_city", "commerce"): (0.7, 2), ("XMLOrderItems", "commerce"): (1.4, 1),
    }
    for column in {c for c, _ in got}:
        assert mapping.stem_scores(column) == pytest.approx({d: s for (c, d), (s, _) in got.items() if c == column})
    assert names.tokens("XMLOrderItems") == ["xml", "order", "items"]
