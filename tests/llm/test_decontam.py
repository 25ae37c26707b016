"""Benchmark decontamination (1) against brute force."""

from llm_fixtures import ODD_ROWS, prose, shingles, words

from tessera.llm import decontam, queries


def held(doc, item):
    """(n_item_shingles, n_found), windows as long as the item if it is short."""
    k = min(5, len(words(item)))
    own = shingles(item, k) if k else set()
    have = shingles(doc, k) if k and len(words(doc)) >= k else set()
    return len(own), len(own & have)


def brute_force(docs, items):
    out = set()
    for d, text in docs:
        for i, item in set(items):
            n, k = held(text, item)
            if d is not None and i is not None and n and 10 * k >= 8 * n:
                out.add((d, i, n, k))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in df.collect())


def test_query_equals_sql(same):
    assert same(queries.op1_decontamination, queries.OP1_SQL)


def test_partial_and_scattered_items(spark, monkeypatch):
    item = prose(3, 24).split(" ")
    docs = [(0, prose(50, 3000) + " " + " ".join(item) + " " + prose(51, 4000)), (1, " ".join(item[:21])), (2, " ".join(item[:19])), (3, prose(9, 500)), (4, " ".join(item).upper())]
    docs.append((5, " ".join(" ".join(item[i : i + 5]) + f" gap{i}" for i in range(20))))
    items = [(1, " ".join(item)), (2, "two words"), (3, ""), (4, None), (None, " ".join(item)), (5, prose(70, 300)), (1, " ".join(item))]
    docs += [(6, "has two Words in it"), (7, "two"), (8, prose(71, 100) + " " + prose(70, 260))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_force(docs, items)
    assert {p[:2] for p in want} == {(0, 1), (1, 1), (4, 1), (5, 1), (6, 2), (8, 5)}
    assert found(decontam.contained_items(d, i)) == want
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 20)  # several passes give the same
    assert found(decontam.contained_items(d, i)) == want
    assert sorted(r.doc_id for r in decontam.decontaminated(d, i).collect()) == [2, 3, 7]


def test_odd_rows(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta"), (2, "x"), (3, None)], "item_id long, text string")
    want = brute_force([r[:2] for r in ODD_ROWS if r[0] is not None], [(1, "beta gamma delta epsilon zeta eta"), (2, "x")])
    assert sorted(set(found(decontam.contained_items(odd_documents, items)))) == want
    assert decontam.contained_items(no_documents, items).count() == 0
    assert decontam.contained_items(odd_documents, items.limit(0)).count() == 0
    left = decontam.decontaminated(odd_documents, items)
    assert left.columns == odd_documents.columns
    assert left.count() == len(ODD_ROWS) - sum(r[0] in {p[0] for p in want} for r in ODD_ROWS)


def test_rows_are_judged_by_their_own_text(spark):
    items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta")], "item_id long, text string")
    rows = [(1, "clean enough"), (1, "so beta gamma delta epsilon zeta eta it is"), (None, "beta gamma delta epsilon zeta eta"), (None, None)]
    left = decontam.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [(1, "clean enough"), (None, None)]))
    assert "Exchange" not in left._jdf.queryExecution().toString()
