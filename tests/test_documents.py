"""Pages, references, outcomes, the sink."""

import html
import itertools
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import arrays, references
from tessera.operators import pages as pg
from tessera.plans import queries as plans
from tessera.sources import sinks


def regions(spark, *texts, columns=("pos", "tag", "text", "depth")):
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(pg.page_regions(pages, 0.0).collect(), key=lambda r: (r.page_id, r.pos)):
        out[r.page_id].append(tuple(r[c] for c in columns))
    return list(out.values())


def texts(spark, *pages):
    return [[t for (t,) in page] for page in regions(spark, *pages, columns=("text",))]


def test_open_ends_run_to_the_end_of_the_page(spark):
    got = texts(
        spark,
        "<p>a</p><!-- open <p>hidden text</p>",
        "<p>kept</p><script>var x=1;",
        "<p title='a>b'>three",
        "<p>x<style>p{}",
        "<p>one<p title=\"open>two</p>three",
        "<p>a<!-->b<!--->c<!-- d --!>e",
        "<p>last<b",
        "<head><title>t</title><p>no head's element ends the head",
    )
    assert got == [["a"], ["kept"], ["three"], ["x"], ["one"], ["a b c e"], ["last"], ["no head's element ends the head"]]


def test_what_is_no_tag_is_text(spark):
    got = texts(spark, "<p>1 < 2 and <3> a<b", "<p>it's 'x' > y", "<p it's>quotes count after an equals sign only</p>", "<scripty>not a script</scripty>", "<!DOCTYPE html><?xml x?></ odd>seen", "<SCRIPT type='x'>no</script >yes")
    assert got == [["1 < 2 and <3> a"], ["it's 'x' > y"], ["quotes count after an equals sign only"], ["not a script"], ["seen"], ["yes"]]


def test_raw_text_holds_no_tags(spark):
    assert texts(spark, '<p>a<script>var s = "</p><p>b<!--";</script>c', "<title><b>t</b></title><p>d<iframe><p>e</iframe>f") == [["a c"], ["d f"]]


def test_depth_counts_open_blocks(spark):
    page = "top<div>a<p>b<p>c</div>tail<h1>d</h1></div></div><ul><li>e<li>f<div>g"
    assert regions(spark, page)[0] == [(0, "", "top", 0), (1, "div", "a", 1), (2, "p", "b", 1), (3, "p", "c tail", 1), (4, "h1", "d", 1), (6, "li", "e", 1), (7, "li", "f", 1), (8, "div", "g", 2)]


def test_very_long_tags_and_pages(spark):
    """No recursion in the patterns, and time that follows the length."""
    tag = "<p " + " ".join(f"a{i}='>{i}'" for i in range(50_000)) + ">kept"
    many = "".join(f"<div>{i}<b>x</b></div>" for i in range(20_000))
    began = time.time()
    got = regions(spark, tag, many, "<!--" * 50_000, "<" * 100_000, "<p x=" * 50_000)
    assert time.time() - began < 60
    assert [t for _, _, t, _ in got[0]] == ["kept"]
    assert len(got[1]) == 20_000 and {d for *_, d in got[1]} == {1}


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 300, 1000])
def test_running_totals(spark, n):
    values = [(i * 37) % 101 - 60 for i in range(n)]
    r = spark.createDataFrame([(values,)], "v array<bigint>").select(arrays.running_sum(F.col("v")).alias("s"), arrays.running_min(F.col("v")).alias("m")).first()
    assert r.s == list(itertools.accumulate(values)) and r.m == list(itertools.accumulate(values, min))
    assert spark.range(1).select(arrays.running_sum(F.lit(None).cast("array<bigint>")).alias("s")).first().s is None


def test_all_named_references(spark):
    """The whole table, each name once with text beside it; bare names by the longest match."""
    cases = [f"x&{name} y" for name in html.entities.html5] + [f"&{name}z" for name in references.BARE]
    cases += ["&notit; &notin; &amp;lt; &amp;amp; a&b &;& &# &nosuch; &ampamp;", "AT&T &copy2024", "&rsquo; &eacute; &mdash; &hellip;", "", "&"]
    rows = spark.createDataFrame(list(enumerate([*cases, None])), "i int, c string").repartition(3)
    got = {r.i: r.t for r in rows.select("i", references.read_references(F.col("c")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [html.unescape(c) for c in cases]
    assert got[len(cases)] is None


def test_references_count_as_what_they_name(spark):
    pages = spark.createDataFrame([(1, "<p>&hellip;&hellip;</p>")], "page_id long, html string")
    r = pg.page_regions(pages, 0.0).first()
    assert r.text == "……" and r.score == 2 / len("<p>&hellip;&hellip;</p>")


def test_pages_are_read_without_python(spark, sf_dir, capsys):
    for query in (plans.page_regions, plans.parse_outcome):
        query(spark, sf_dir).explain("formatted")
        assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))
    plans.page_regions(spark, sf_dir).explain("formatted")
    assert "Exchange" not in capsys.readouterr().out


def test_outcome_carries_results_and_folder(spark):
    rows = [(1, "<h1>Head</h1><p>one"), (2, None), (3, "<p>b"), (3, "<p>a"), (3, "<p>b"), (4, "<p>same"), (4, "<p>same"), (None, "<p>no id")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"blocks": F.lit(1), "found": F.lit(2), "request_id": F.lit(3)})
    requests = spark.createDataFrame([(10, 1), (11, None), (12, 99), (13, 2), (14, 3), (15, 4), (16, 1), (16, 1)], "request_id long, page_id long").withColumn("blocks", F.lit(0))
    out = pg.parse_outcome(requests, pages, 0.0, folder="/out/run-1").collect()
    assert len(out) == 8
    by = {r.request_id: r for r in out}
    assert [tuple(x) for x in by[10].results] == [(1, "h1", "Head", 4 / 13), (2, "p", "one", 0.5)]
    assert [(k, by[k].ok, by[k].output_dir, len(by[k].results)) for k in (10, 11, 12, 13)] == [(10, True, "/out/run-1", 2), (11, False, None, 0), (12, False, None, 0), (13, True, "/out/run-1", 0)]
    least = min(["<p>a", "<p>b"], key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())
    assert by[14].markdown == least[3:] and by[15].markdown == "same"
    assert pg.parse_outcome(requests, pages.limit(0)).where("ok").count() == 0
    assert pg.page_regions(pages.limit(0)).collect() == []


# -- the sink -----------------------------------------------------------------------------


def table(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "request_id long, markdown string")


def test_run_ids_stay_text(spark, tmp_path):
    out, ids = str(tmp_path / "runs"), ["007", "7", "1e3", "2026-01-01", "true", "a/b=c d", "é", ""]
    for run in ids:
        sinks.write_parsed(table(spark, run).withColumn("run_id", F.lit("given")), out, run)
    rows = sinks.read_parsed(spark, out)
    assert dict(rows.dtypes)["run_id"] == "string"
    assert sorted((r.run_id, r.markdown) for r in rows.collect()) == sorted((i, i) for i in ids)
    assert [(r.run_id, r.markdown) for r in sinks.read_parsed(spark, out, "007").collect()] == [("007", "007")]
    assert sinks.read_parsed(spark, out, "8").collect() == []
    with pytest.raises(ValueError):
        sinks.write_parsed(table(spark, "x"), out, None)


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "runs")
    sinks.write_parsed(table(spark, "old", "old too"), out, "r")
    failing = spark.range(0, 40, 1, 4).select(F.col("id").alias("request_id"), F.when(F.col("id") == 39, F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).cast("string").alias("markdown"))
    for run in ("r", "s"):
        with pytest.raises(PySparkException):
            sinks.write_parsed(failing, out, run)
    assert [r.markdown for r in sinks.read_parsed(spark, out, "r").orderBy("request_id").collect()] == ["old", "old too"]
    assert {r.run_id for r in sinks.read_parsed(spark, out).collect()} == {"r"}
    assert sinks.read_parsed(spark, out, "s").collect() == []


def test_a_run_is_seen_only_when_it_is_marked(spark, tmp_path, monkeypatch):
    """Rows of a writer that has written all and marked nothing are there, and count for nothing."""
    out = str(tmp_path / "runs")
    sinks.write_parsed(table(spark, "old"), out, "r")
    table(spark, "new").write.parquet(f"{out}/data/_attempt=a0")
    assert [r.markdown for r in sinks.read_parsed(spark, out).collect()] == ["old"]
    sinks.write_parsed(table(spark, "newer"), out, "r")
    assert [r.markdown for r in sinks.read_parsed(spark, out).collect()] == ["newer"]
    monkeypatch.setattr(sinks, "MAX_MARKS", 0)
    assert [r.markdown for r in sinks.read_parsed(spark, out).collect()] == ["newer"]
    assert [(r.run_id, r.n_rows) for r in sinks.runs(spark, out).collect()] == [("r", 1)]


def test_empty_runs_and_new_columns(spark, tmp_path):
    out = str(tmp_path / "runs")
    sinks.write_parsed(table(spark), out, "none")
    sinks.write_parsed(table(spark, "x").withColumn("more", F.lit(1)), out, "one")
    assert sinks.read_parsed(spark, out, "none").count() == 0
    assert [(r.markdown, r.more) for r in sinks.read_parsed(spark, out).collect()] == [("x", 1)]
