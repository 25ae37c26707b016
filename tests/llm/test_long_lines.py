"""Long lines that recur in two documents (5)."""

from llm_fixtures import prose

from tessera.llm import line_dedup


def test_long_lines_of_two_documents_stay_in_one(spark):
    long, short, often = prose(7, 60), prose(8, 12), prose(9, 55)
    rows = [(i, "\n".join([prose(100 + i, 70), *([long, short] if i < 2 else []), *([often] if i > 1 else [])])) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.without_recurring_lines(docs, long_tokens=50).collect()}
    assert sum(long in r.text for r in out.values()) == 1
    assert sum(short in r.text for r in out.values()) == 2
    assert not any(often in r.text for r in out.values())
    assert sum(r._n_dropped for r in out.values()) == 1 + 3
    assert all(prose(100 + i, 70) in out[i].text for i in range(5))
    plain = line_dedup.without_recurring_lines(docs).collect()
    assert sum(long in r.text for r in plain) == 2
