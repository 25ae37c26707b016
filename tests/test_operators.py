from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import pages as pg
from tessera.operators import registry, resolve, status
from tessera.sources import inventory, sinks


def values(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


# -- text ---------------------------------------------------------------------------------


def test_normalise_key(spark):
    raw = [None, "", "   ", "\tGo \n", " RUST ", "Python"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    out = {r.i: r.k for r in df.select("i", fx.normalise_key(F.col("v"), " TS ").alias("k")).collect()}
    assert out == {0: "ts", 1: "ts", 2: "", 3: "go", 4: "rust", 5: "python"}


def test_default_fill(spark):
    df = spark.createDataFrame([(None, False), (1, None)], "port int, share boolean")
    assert values(fx.default_fill(df, {"port": 7860, "share": False, "open": True}), "port", "share", "open") == {(7860, False, True), (1, False, True)}


def test_csv_list(spark):
    df = spark.createDataFrame([(None,), ("",), (" , ,",), (" a ,b,, c",), ("x",)], "v string")
    assert sorted(map(list, (r.l for r in df.select(fx.csv_list(F.col("v")).alias("l")).collect()))) == [[], [], [], ["a", "b", "c"], ["x"]]
    assert df.select(fx.csv_list(F.lit("a.b| c "), "|").alias("l")).first().l == ["a.b", "c"]


def test_links(spark):
    df = spark.createDataFrame([(None, None), ("", 1), ("http://h", 2)], "b string, p int")
    assert values(df.select(fx.derive_link(F.col("b"), "/x").alias("l"), fx.port_url(F.col("p")).alias("u")), "l", "u") == {(None, None), (None, "http://127.0.0.1:1"), ("http://h/x", "http://127.0.0.1:2")}
    assert df.select(fx.error_text(F.lit(""), F.lit(404)).alias("e")).first().e == "Request failed: 404"


def test_row_json_keeps_nulls_and_letters(spark):
    df = spark.createDataFrame([(1, None, "é")], "id int, url string, name string")
    assert fx.row_json(df, ["id", "url", "name"]).first().json == '{"id":1,"url":null,"name":"é"}'
    assert "\n" in fx.row_json(df, ["id"], pretty=True).first().json


# -- status -------------------------------------------------------------------------------


def test_no_evidence_is_false(spark):
    entities = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    evidence = spark.createDataFrame([("a", "ui", 1), ("a", None, 2), ("b", "src", 3), (None, "ui", 4)], "id string, kind string, n int").drop("n")
    out = status.evidence_rollup(entities, evidence, "id", {"any": F.lit(True), "ui": F.col("kind") == "ui"})
    assert values(out, "id", "any", "ui") == {("a", True, True), ("b", True, False), ("c", False, False)}
    empty = status.evidence_rollup(entities, evidence.limit(0), "id", {"any": F.lit(True)})
    assert values(empty, "any") == {(False,)}


def test_verdict_keeps_two_rule_sets(spark):
    df = spark.createDataFrame([(1, True, True, True), (2, True, True, False), (3, True, None, True), (4, False, False, False), (5, None, True, True)], "id int, e boolean, src boolean, ui boolean")
    texts = (F.lit("ready"), F.lit("incomplete"), F.lit("absent"))
    out = status.verdict(df, F.col("e"), [F.col("src"), F.col("ui")], texts, available=[F.col("src")])
    assert values(out, "id", "available", "message") == {(1, True, "ready"), (2, True, "incomplete"), (3, False, "incomplete"), (4, False, "absent"), (5, False, "absent")}


def test_variants(spark):
    df = spark.createDataFrame([("m", "ts"), ("m", "go"), ("m", "go"), ("n", None)], "p string, c string")
    parents = spark.createDataFrame([("m",), ("n",), ("o",)], "p string")
    out = {r.p: (r.variants, r.display) for r in status.variants(df, "p", "c", parents).collect()}
    assert out == {"m": (["go", "ts"], "go, ts"), "n": ([], "none"), "o": ([], "none")}


def test_status_rows_and_summary(spark):
    df = spark.createDataFrame([("x", True, None, "hi")], "id string, a boolean, b boolean, m string")
    rows = status.status_rows(df, ["id"], {"a": ("A", "available", "missing"), "b": ("B", "Compatibility only", "Missing"), "m": "Status"}).orderBy("ordinal").collect()
    assert [(r.label, r.value) for r in rows] == [("A", "available"), ("B", "Missing"), ("Status", "hi")]
    s = status.registry_summary(df, None, "a", "b").first()
    assert (s.n, s.ready, s.online) == (1, 1, 0)


# -- choosing -----------------------------------------------------------------------------

CANDIDATES = [
    ("work", "python", 0, None, None, "py"),
    ("work", "ts", 0, "/w/ts/dist/index.js", "node", "built"),
    ("work", "ts", 1, "/w/ts/src/index.ts", "tsx", "source"),
    ("work", "go", 0, "/w/go/bin/app", None, "bin"),
    ("work", "go", 1, None, "go", "go run"),
    ("work", "rust", 0, "/w/rust/release/app", None, "release"),
    ("work", "rust", 1, "/w/rust/debug/app", None, "debug"),
    ("work", "rust", 2, None, "cargo", "cargo run"),
]


def test_choose_candidate(spark):
    candidates = spark.createDataFrame(CANDIDATES, "module string, impl string, rank int, needs_path string, needs_tool string, command string")
    requests = spark.createDataFrame([("work", i) for i in ("python", "ts", "go", "rust", "zig")], "module string, impl string")

    def chosen(paths, tools):
        listing = spark.createDataFrame([(p,) for p in paths], "path string")
        names = spark.createDataFrame([(t,) for t in tools], "tool string")
        return {r.impl: r.command for r in resolve.choose_candidate(requests, candidates, listing, names).collect()}

    assert chosen(["/w/ts/src/index.ts", "/w/rust/debug/app"], ["tsx", "cargo"]) == {"python": "py", "ts": "source", "go": None, "rust": "debug", "zig": None}
    assert chosen(["/w/ts/dist/index.js", "/w/go/bin/app"], ["node", "go", "cargo"]) == {"python": "py", "ts": "built", "go": "bin", "rust": "cargo run", "zig": None}
    assert chosen([], []) == {"python": "py", "ts": None, "go": None, "rust": None, "zig": None}


def test_nearest_ancestor(spark):
    rows = [("/a/b/c/d/e/f.py", None), ("/a/b/c/d/e/f.py", "/set"), ("/a/b/c/d/e/f.py", ""), ("/x/y.py", None), ("/1/2/3/4/5/6", None), ("f", None), (None, None)]
    paths = spark.createDataFrame(rows, "path string, configured string")
    markers = spark.createDataFrame([("/a",), ("/a/b/c",), ("/a/b/c/d/e/f.py",), ("/a",), (None,)], "prefix string")
    out = values(resolve.nearest_ancestor(paths, markers), "path", "configured", "root")
    assert out == {
        ("/a/b/c/d/e/f.py", None, "/a/b/c"), ("/a/b/c/d/e/f.py", "/set", "/set"), ("/a/b/c/d/e/f.py", "", "/a/b/c"),
        ("/x/y.py", None, None), ("/1/2/3/4/5/6", None, "/1"), ("f", None, None),
    }
    assert values(resolve.nearest_ancestor(paths.select("path"), markers.where("prefix = '/'")), "root") == {(None,), ("/a",), ("/1",)}


# -- contracts ----------------------------------------------------------------------------


def test_registry_contract(spark):
    ocr = spark.createDataFrame([("ocr", "OCR", "ocr", True, True, True, False, False, "/m/ocr", "ok", None, None, 1)], "id string, name string, kind string, available boolean, source_available boolean, ui_available boolean, api_available boolean, web_available boolean, path string, message string, web_url string, api_url string, odd int")
    work = spark.createDataFrame([("work", "Work", "work", True, True, "/m/w", "ok", "go", ["go", "ts"])], "id string, name string, kind string, available boolean, web_available boolean, path string, message string, impl string, impls array<string>")
    video = spark.createDataFrame([("video", "Video", "video", False, "/m/v", "absent")], "id string, name string, kind string, available boolean, path string, message string")
    union = registry.registry_union([(0, ocr), (1, work), (2, video)])
    assert values(union, "ordinal", "id") == {(0, "ocr"), (1, "work"), (2, "video")}
    checked = registry.contract_check(union, registry.STATUS_REQUIRED, registry.STATUS_OPTIONAL)
    assert "impls" not in checked.columns and "odd" not in checked.columns
    assert {r.id: r.missing for r in checked.collect()} == {"ocr": [], "work": ["source_available", "ui_available", "api_available"], "video": ["source_available", "ui_available", "api_available", "web_available"]}
    r = registry.all_valid(checked).first()
    assert (r.n_valid, r.n_rejected, r.all_valid) == (1, 2, False)


def test_bounds(spark):
    df = spark.createDataFrame([("m1", 0.3), ("m9", 0.3), ("m2", 1.2), (None, 0.1)], "model string, threshold double")
    out = registry.contract_check(df, ["model", "absent"], allowed={"model": ["m1", "m2"]}, ranges={"threshold": (0, 1)})
    assert sorted((r.model or "", r.missing, r.broken, r.valid) for r in out.collect()) == [("", ["model", "absent"], [], False), ("m1", ["absent"], [], False), ("m2", ["absent"], ["threshold"], False), ("m9", ["absent"], ["model"], False)]


# -- pages --------------------------------------------------------------------------------

PAGES = [
    (1, '<head><title>t</title></head><body><script>var a="</p><p>no";</script><!-- <p>gone --><h1>Head &amp; &lt;b&gt;</h1><p>one <b>two</b><p>three<li>item</li></body>'),
    (2, ""),
    (3, None),
    (4, "<header>kept</header>plain"),
]


def test_page_regions(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    out = sorted((r.page_id, r.pos, r.tag, r.text) for r in pg.page_regions(pages, 0.0).collect())
    assert out == [(1, 1, "h1", "Head & <b>"), (1, 2, "p", "one two"), (1, 3, "p", "three"), (1, 4, "li", "item"), (4, 1, "header", "kept plain")]
    assert pg.page_regions(pages, 0.9).count() == 0


def test_parse_outcome_and_sink(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    requests = spark.createDataFrame([(10, 1), (11, None), (12, 99), (13, 2), (14, 3)], "request_id long, page_id long")
    df = pg.parse_outcome(requests, pages, 0.0)
    out = {r.request_id: r for r in df.collect()}
    assert len(out) == 5
    assert out[10].markdown == "# Head & <b>\n\none two\n\nthree\n\n- item"
    assert out[10].html.startswith("<h1>Head &amp; &lt;b&gt;</h1>")
    assert [out[k].message for k in (10, 11, 12, 13, 14)] == ["Parsed 4 regions.", "No input was given.", "Input not found: 99", "Parsed 0 regions.", "Parsed 0 regions."]
    assert [out[k].ok for k in (10, 11, 12, 13, 14)] == [True, False, False, True, True]
    sinks.write_parsed(df, str(tmp_path / "out"), "r1")
    sinks.write_parsed(df, str(tmp_path / "out"), "2")
    back = sinks.read_parsed(spark, str(tmp_path / "out"), "r1")
    assert values(back, "request_id", "ok", "markdown", "html", "message") == values(df, "request_id", "ok", "markdown", "html", "message")
    assert sinks.read_parsed(spark, str(tmp_path / "out")).count() == 10


# -- inventory ----------------------------------------------------------------------------


def test_inventory(spark, tmp_path):
    (tmp_path / "m" / "impl" / "go").mkdir(parents=True)
    (tmp_path / "m" / "impl" / "empty").mkdir()
    (tmp_path / "m" / "impl" / "go" / "app").write_text("x")
    listed = inventory.path_inventory(spark, str(tmp_path))
    assert [r.length for r in listed.collect()] == [1]
    paths = {(r.path.split("/m")[-1], r.is_dir) for r in inventory.present_paths(listed).collect() if r.path.count("/m/") or r.path.endswith("/m")}
    assert paths >= {("/impl/go/app", False), ("/impl/go", True), ("/impl", True), ("", True)}
    assert not any("empty" in p for p, _ in paths)


def test_a_pages_own_characters_never_cut(spark):
    rows = [(1, "<p>a\x01b</p><p>c\x01\x03d</p>"), (2, None), (3, "\x01\x02")]
    out = pg.page_regions(spark.createDataFrame(rows, "page_id long, html string"), 0.0).collect()
    assert sorted((r.page_id, r.text) for r in out) == [(1, "a\x01b"), (1, "c\x01\x03d"), (3, "\x01\x02")]


def test_numeric_references(spark):
    """Decimal and hexadecimal ones, once only; those that name no character, and what only looks like one."""
    cases = [("don&#8217;t", "don’t"), ("don&#x2019;t&#X41;&#0066;", "don’tAB"), ("&#128512;", "😀"), ("&#0;&#xD800;&#x110000;", "\ufffd" * 3), ("&#38;lt; &amp;#65; &#38;#65;", "&lt; &#65; &#65;"), ("&#; &#x; &#12", "&#; &#x; &#12"), ("&#60;b&#62;", "<b>")]
    pages = spark.createDataFrame([(i, f"<p>{html}</p>") for i, (html, _) in enumerate(cases)], "page_id long, html string")
    assert {r.page_id: r.text for r in pg.page_regions(pages, 0.0).collect()} == {i: text for i, (_, text) in enumerate(cases)}


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    df, out = spark.createDataFrame([(1, "text")], "request_id long, markdown string"), str(tmp_path / "runs")
    for run in ("a", "b", "a"):
        sinks.write_parsed(df, out, run)
    assert sorted((r.run_id, r.request_id, r.markdown) for r in sinks.read_parsed(spark, out).collect()) == [("a", 1, "text"), ("b", 1, "text")]
