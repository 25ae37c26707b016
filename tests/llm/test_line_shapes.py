"""Templates with leading, several and short fields, and the clean lines beside them (5)."""

import random

import pytest
from llm_fixtures import prose

from tessera.llm import line_dedup

SHAPES = {
    "leading": "Written by {} for our weekly letter to readers",
    "first": "{} wrote all of this for our weekly letter",
    "two": "Read more about {} on our other {} site today",
    "short": "Filed under news {}",
    "three": "{} sports news",
}


def name(i):
    return "".join(random.Random(i).choices("abcdefghiklmnoprstu", k=7))


@pytest.fixture(scope="module")
def cut(spark):
    """16 documents with a line of each shape, other lines of the same leaf and clean prose."""
    planted, clean, rows = {}, [], []
    for i in range(16):
        own = {k: t.format(name(10 * i), name(10 * i + 1)) for k, t in SHAPES.items()}
        beside = [f"Read more about {' '.join(name(700 + 20 * i + j) for j in range(7))}", f"Written by {prose(300 + i, 8)}", prose(900 + i, 3), prose(950 + i, 4), *(prose(1000 + 10 * i + j, 12 + j) for j in range(5))]
        planted[i], clean = own, clean + [(i, x) for x in beside]
        rows.append((i, "\n".join([*own.values(), *beside])))
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return planted, clean, out


@pytest.mark.parametrize("shape", SHAPES)
def test_fields_of_all_shapes_are_found(cut, shape):
    planted, _, out = cut
    found = sum(own[shape] not in out[i] for i, own in planted.items())
    assert found >= 0.9 * len(planted), (shape, found)


def test_clean_lines_stay(cut):
    _, clean, out = cut
    assert sum(x in out[i] for i, x in clean) >= 0.99 * len(clean)


def test_short_sentences_need_more_documents(spark):
    """Three documents do not make four shared words a template; eight do."""
    ends = ["why", "how", "who", "when", "where", "whose", "whom", "which"]
    for docs, left in ((3, True), (7, True), (8, False)):
        rows = [(i, f"I do not know {ends[i]}\n{prose(i, 20)}") for i in range(docs)]
        out = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(("I do not know" in r.text) == left for r in out), docs


def test_evidence_counts_a_line_once_a_document(spark):
    """A line that one document repeats is no more evidence; null and empty texts beside it change nothing."""
    rows = [(i, "\n".join([f"I do not know {x}"] * 9)) for i, x in enumerate(["why", "how", "who"])] + [(7, None), (8, ""), (None, "alone")]
    out = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(rows, key=str)
