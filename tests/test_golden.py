"""Problems of golden items, each made by one change to a good item."""

import json

import pytest

from docweave.operators import golden

GOOD = {
    "id": "S01", "type": "single_hop", "source": "x", "question": "What is it?", "history": [], "expected_resolution": [], "expected_docs": ["a.txt"], "expected_evidence": [{"doc": "a.txt", "contains": "word"}],
    "expected_facts": [{"fact": "f", "any_of": ["p"], "in_source": True}], "must_refuse": False, "tags": ["compound"], "review": {"status": "approved", "reviewed_by": "r", "reviewed_on": "d", "notes": ""},
}
TURNS = [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]


@pytest.mark.parametrize(
    ("change", "want"),
    [
        ({}, set()),
        ({"id": "S1"}, {("id", "of another form")}),
        ({"id": "M01"}, {("id", "doesn't go with the type")}),
        ({"question": "Why"}, {("question", "too short")}),
        ({"must_refuse": True}, {("must_refuse", "true for negative items only")}),
        ({"expected_facts": []}, {("expected_docs", "an answerable item expects documents, evidence and facts")}),
        ({"expected_docs": ["a.txt", "a.txt"]}, {("expected_docs", "repeated")}),
        ({"expected_docs": ["a.txt", "z.txt"]}, {("expected_docs[1]", "not in the manifest")}),
        ({"expected_evidence": [{"doc": "a.txt", "contains": "word"}, {"doc": "b.txt", "contains": "x"}]}, {("expected_evidence[1]", "of a document that isn't expected"), ("expected_evidence[1]", "too short")}),
        ({"tags": ["compound", "odd"]}, {("tags[1]", "unknown")}),
        ({"type": "multi_hop", "id": "M01"}, {("expected_docs", "two documents at least")}),
        ({"type": "follow_up", "id": "F01"}, {("history", "a follow-up has history and resolution")}),
        ({"type": "follow_up", "id": "F01", "history": TURNS, "expected_resolution": ["x"]}, set()),
        ({"type": "follow_up", "id": "F01", "history": TURNS[::-1], "expected_resolution": ["x"]}, {("history", "user and assistant take turns")}),
        ({"history": TURNS}, {("history", "of follow-ups only")}),
        ({"type": "negative", "id": "N01", "must_refuse": True}, {("expected_docs", "a negative item expects nothing")}),
        ({"type": "negative", "id": "N01", "must_refuse": True, "expected_docs": [], "expected_evidence": [], "expected_facts": []}, set()),
        ({"review": {"status": "needs_review", "reviewed_by": None, "reviewed_on": None, "notes": ""}}, {("review.status", "not reviewed")}),
        ({"review": {"status": "approved", "reviewed_by": None, "reviewed_on": "d", "notes": ""}}, {("review", "without reviewer or day")}),
    ],
)
def test_one_change(spark, change, want):
    lines = spark.createDataFrame([(json.dumps(GOOD | change),)], "raw string")
    got = golden.issues(golden.items(lines), spark.createDataFrame([("a.txt",), ("b.txt",)], "filename string")).collect()
    assert {(r.path, r.problem) for r in got} == want and len(got) == len(want)


def test_broken_and_repeated_items(spark):
    lines = spark.createDataFrame([(1, json.dumps(GOOD)), (2, json.dumps(GOOD)), (3, "{broken"), (4, None)], "line long, raw string")
    got = golden.issues(golden.items(lines, keep=("line",)), spark.createDataFrame([("a.txt",)], "filename string"), keep=("line",)).collect()
    assert {(r.line, r.path, r.problem) for r in got} == {(1, "id", "repeated"), (2, "id", "repeated"), (3, "", "not an item"), (4, "", "not an item")}
