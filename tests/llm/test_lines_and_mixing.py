"""Line dedup (5) and mixing (7) against SQL and plain Python."""

import hashlib
import math
import random

import pytest
from llm_fixtures import ODD_ROWS, prose, words
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, queries, spill


def test_line_query_equals_sql(same):
    rows = same(queries.op5_line_dedup, queries.OP5_SQL)
    assert rows


def test_mixing_query_equals_sql(same):
    assert same(queries.op7_mixing, queries.OP7_SQL)


@pytest.mark.parametrize("query", [queries.op5_line_dedup, queries.op7_mixing])
def test_main_path_is_native(query, spark, sf_dir, monkeypatch):
    """Every plan on the way, not only the last, runs in the JVM."""
    plans = []

    def spied(f):
        def spy(df, *a):
            plans.append(df._jdf.queryExecution().toString())
            return f(df, *a)

        return spy

    for module in (line_dedup, mixing):
        for name in ("saved", "checkpointed"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, spied(getattr(spill, name)))
    plans.append(query(spark, sf_dir)._jdf.queryExecution().toString())
    assert len(plans) > 2
    assert not any(w in p for p in plans for w in ("Python", "Pandas", "InArrow", "CartesianProduct", "NestedLoop"))


def test_templates_generalise_variable_fields(spark):
    def page(i):
        return f"{prose(i, 30)}\nPosted on day {i} by user u{i} in the forum\nRead more about {['cats', 'dogs', 'fish', 'birds'][i % 4]} on our other site today\n\n{prose(500 + i, 8)}"

    docs = spark.createDataFrame([(i, page(i)) for i in range(6)] + [(9, "Posted on day 3 by nobody\nunique words only here")], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.without_recurring_lines(docs).collect()}
    for i in range(6):
        assert out[i].text == f"{prose(i, 30)}\n\n{prose(500 + i, 8)}"
        assert (out[i]._n_lines, out[i]._n_dropped) == (5, 2)
    assert out[9].text.startswith("Posted on") and out[9]._n_dropped == 0


def test_several_templates_of_one_leaf(spark):
    """Three templates of nine tokens begin alike, among lines that are no template: all are found."""
    names = ["".join(random.Random(i).choices("abcdefghiklmnoprstu", k=6)) for i in range(60)]
    kinds = ["Read more about {} on our other site today", "Read more about new offers for {} this week", "Read more about this {} where good books end"]
    rows, planted = [], []
    for i in range(30):
        own = [kinds[k].format(names[2 * i + k % 2]) for k in range(3) if (i + k) % 2]
        planted += own
        rows.append((i, "\n".join([*own, f"Read more about {names[i]} {names[-i]} {names[i + 7]} {names[i + 9]} {names[i + 11]} {names[i + 13]}", prose(900 + i, 20)])))
    assert {len(p.split(" ")) for p in planted} == {9}
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = [x for t in out.values() for x in t if x in planted]
    assert len(left) <= 0.1 * len(planted), (len(left), len(planted))
    assert all(len(t) == 2 for t in out.values())  # the lines that differ in six tokens, and the prose, stay


def test_figures_are_no_template(spark):
    rows = [(i, f"x{i}\n{1990 + i} {i} {i} {i}\n{i} {i} {i} {i} {name}\n2024\n  Page {i} of 9\t\n{prose(40 + i, 12)}") for i, name in enumerate(["apple", "pear", "plum", "fig"])]
    out = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in out:
        assert r.text.split("\n") == [x for x in dict(rows)[r.doc_id].split("\n") if "Page" not in x]


def test_lines_of_odd_rows(odd_documents, no_documents):
    named = odd_documents.withColumns({"_n_lines": F.lit(1), "r": F.lit(2), "d1": F.lit(3), "drop": F.lit(4)})
    out = line_dedup.without_recurring_lines(named)
    assert sorted(out.columns) == sorted(set(named.columns) | {"_n_dropped"})
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(((d, t) for d, t, *_ in ODD_ROWS), key=str)  # nothing recurs in three documents
    assert line_dedup.without_recurring_lines(no_documents).count() == 0


def test_recurring_lines_in_odd_texts(spark):
    """Nulls, repeats of one row, and a very long line."""
    long, line = prose(3, 40_000), "this line stands in many of them"
    rows = [(None, line), (1, f"{line}\n{long}"), (2, None), (2, f"{long}\n\n{line}"), (3, long), (3, long), (3, long), (4, "alone"), (4, "alone"), (4, "alone")]
    out = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(None, ""), (1, ""), (2, None), (2, ""), (3, ""), (3, ""), (3, ""), *[(4, "alone")] * 3], key=str)


def copies_by_hand(rows, repeats=2.0, seed=mixing.SEED):
    """Copies of each document under a limit on repeats, in plain Python."""
    size = {r.doc_id: len(words(r.text)) for r in rows}
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    lo, hi = 0.0, 1.0
    ratio = max(total.values()) / min(total.values())
    for _ in range(mixing.STEPS):
        a = (lo + hi) / 2
        lo, hi = (lo, a) if ratio ** (1 - a) <= repeats else (a, hi)
    hi = 0.0 if ratio <= repeats else hi
    whole = sum(total.values())
    raised = {s: (t / whole) ** hi for s, t in total.items()}
    budget = max(total[s] / raised[s] for s in total)
    out = {}
    for s in total:
        full, rest = divmod(round(raised[s] * budget), total[s])
        draw = lambda r: (int(hashlib.md5(f"{seed}:{full}:{r.doc_id}".encode()).hexdigest()[:12], 16), str(r.doc_id))  # noqa: B023, E731
        before = 0
        for r in sorted((r for r in rows if r.source == s), key=draw):
            out[r.doc_id] = full + (before < rest)
            before += size[r.doc_id]
    return out


def shares(plan):
    return {r.source_key: r.weight for r in plan.collect()}


def test_targets_are_met(spark):
    rows = [(i, "w " * (3 + i % 7), s) for s, n in (("a", 400), ("b", 90), ("c", 20)) for i in range(n)]
    docs = spark.createDataFrame([(k, t, s) for k, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    tokens = mixing.source_tokens(docs).cache()
    size = {r.source_key: r.n for r in tokens.groupBy("source_key").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = {r.source_key: r for r in mixing.mixing_plan(tokens, max_repeats=3.0).collect()}
    assert sum(r.weight for r in plan.values()) == pytest.approx(1)
    assert plan["=a"].quota == size["=a"] and plan["=c"].quota / size["=c"] == pytest.approx(3, abs=1e-2)
    want = 0.8
    w = shares(mixing.mixing_plan(tokens, max_repeats=None, entropy=want))
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(want, abs=1e-6)
    capped = {r.source_key: r.quota for r in mixing.mixing_plan(tokens, max_repeats=1.0, budget=600).collect()}
    assert sum(capped.values()) == pytest.approx(600, abs=3) and all(capped[s] <= size[s] for s in capped)
    # the quota is filled document by document: the last one may reach over it
    out = mixing.with_copies(tokens, mixing.mixing_plan(tokens, max_repeats=3.0)).groupBy("source_key").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()
    for r in out:
        assert 0 <= r.n - plan[r.source_key].quota < 10


def test_mixing_odd_rows(odd_documents, no_documents):
    out = mixing.mixed(odd_documents)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert {str(r.doc_id) for r in rows} == {str(d) for d, *_ in ODD_ROWS}  # nothing is lost
    got = {str(r.doc_id): r for r in mixing.mixture(odd_documents).collect()}
    assert {d: r.source for d, r in got.items()} == {str(d): s for d, _, _, s in ODD_ROWS}  # null and "" stay apart
    assert [sum(str(x.doc_id) == d for x in rows) for d in got] == [r.copies * sum(str(x[0]) == d for x in ODD_ROWS) for d, r in got.items()]
    assert mixing.mixture(odd_documents).count() == len(rows)
    assert mixing.mixed(no_documents).count() == 0 and mixing.mixture(no_documents).count() == 0


def test_copies_form_whole_permutations(spark):
    """Positions of a source are 0, 1, ...; each copy is a permutation of its own, and every stretch holds the sources by their copies."""
    rows = [(i, "w " * (3 + i % 7), s) for s, n in (("a", 300), ("b", 90), (None, 20)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)] + [(0, "w", "a")] * 40 + [(None, "w w", "a")] * 30 + [(None, "w", "a")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mixture(docs, max_repeats=3.0).collect()
    size = {s: sum(r[2] == s for r in rows) for s in ("a", "b", None)}
    total = {s: sum(r.source == s for r in out) for s in size}
    for s, n in size.items():
        own = sorted((r for r in out if r.source == s), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(total[s]))
        copies = [[r for r in own if r.copy == c] for c in range(own[-1].copy + 1)]
        for c in copies[:-1]:
            assert sorted(str(r.doc_id) for r in c) == sorted(str(d) for d, _, x in rows if x == s) and len(c) == n
        for c in copies:
            assert [r.block for r in c] == sorted(r.block for r in c)
        assert len(copies) < 2 or [r.doc_id for r in copies[0]] != [r.doc_id for r in copies[1]]
    assert max(total.values()) < sum(total.values()) and max(r.copy for r in out) > 0
    mixed = sorted(out, key=lambda r: (r.at, r.source or ""))
    for k in range(50, len(mixed), 50):
        for s in size:
            assert abs(sum(r.source == s for r in mixed[:k]) - k * total[s] / len(mixed)) < 3
