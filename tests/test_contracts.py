"""Launch outcomes, nearest ancestors at scale, contracts, common types, indented JSON."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fx
from tessera.operators import registry, resolve
from tessera.plans import queries as plans

# -- launch -------------------------------------------------------------------------------


def test_launch_outcomes_in_order(spark):
    statuses = spark.createDataFrame(
        [("work", "go", True, True, "Work", "ready"), ("work", "ts", True, False, "Work", "ts is incomplete"), ("work", "rust", True, True, "Work", "ready"), ("gone", "go", False, False, "Gone", "not found at /m"), ("work", "go", None, None, None, None)],
        "module string, impl string, exists boolean, available boolean, title string, message string",
    )
    candidates = spark.createDataFrame([("work", "go", 1, None, "go", "go run"), ("work", "go", 0, "/bin/app", None, "app"), ("work", "ts", 0, None, None, "node"), ("gone", "go", 0, None, None, "x"), ("work", "rust", 0, None, "cargo", "cargo run")], "module string, impl string, rank int, needs_path string, needs_tool string, command string")
    requests = spark.createDataFrame([(1, "work", " GO ", 8005), (2, "work", "", None), (3, "work", "ts", 1), (4, "gone", "go", 1), (5, "work", "rust", 1), (6, "new", "go", 1), (7, None, None, 1)], "request_id long, module string, impl string, port int")
    paths, tools = spark.createDataFrame([("/x",)], "path string"), spark.createDataFrame([("go",)], "tool string")
    out = {r.request_id: (r.impl, r.ok, r.command, r.url, r.message) for r in resolve.launch_outcome(requests, statuses, candidates, paths, tools, "Go", 8002).collect()}
    assert out == {
        1: ("go", True, "go run", "http://127.0.0.1:8005", "Started Work (go) API on port 8005."),
        2: ("go", True, "go run", "http://127.0.0.1:8002", "Started Work (go) API on port 8002."),
        3: ("ts", False, None, None, "ts is incomplete"),
        4: ("go", False, None, None, "not found at /m"),
        5: ("rust", False, None, None, "No runnable command for impl 'rust' (missing toolchain or build)."),
        6: ("go", False, None, None, "Module new (go) was not found."),
        7: ("go", False, None, None, "Module ? (go) was not found."),
    }
    assert resolve.launch_outcome(requests.limit(0), statuses, candidates, paths, tools, "go", 1).collect() == []


def test_launch_query_reaches_all_texts(spark):
    said = {r.message.split(" ")[0] + " " + r.message.rsplit(" ", 1)[-1].strip("0123456789") for r in plans.launch_outcome(spark, "/root/testdata/sf0.01").collect()}
    assert said >= {"Module incomplete.", "No build).", "Started ."} or {s.split()[0] for s in said} >= {"Module", "No", "Started"}


# -- nearest ancestor ---------------------------------------------------------------------


def some_paths(seed, n):
    rng = random.Random(seed)
    host = lambda: "hot.example" if rng.random() < 0.9 else f"h{rng.randrange(40)}.example"
    return ["/".join([host(), *(str(rng.randrange(3 + 40 * k)) for k in range(rng.randrange(6)))]) for _ in range(n)]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_ancestors_with_an_index_and_without(spark, monkeypatch, bound):
    monkeypatch.setattr(resolve, "MAX_MARKERS", bound)
    monkeypatch.setattr(resolve, "HOT_ROWS", 200)
    paths = some_paths(1, 3000)
    marks = sorted({p.rsplit("/", 1)[0] for p in some_paths(2, 400)})

    def nearest(path):
        parts = path.split("/")
        above = ["/".join(parts[:k]) for k in range(1, len(parts))]
        marked = next((a for a in reversed(above) if a in set(marks)), None)
        return marked, marked or (above[-2] if len(above) >= 2 else None)

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(5)
    out = resolve.nearest_ancestor(table, spark.createDataFrame([(m,) for m in marks], "prefix string"), fallback_up=2)
    assert {(r.path, r.marked, r.root) for r in out.collect()} == {(p, *nearest(p)) for p in paths}
    assert out.count() == len(set(paths))


def test_a_host_of_most_paths_fills_no_task(spark, monkeypatch):
    """Without the index, rows of one host with 90 % of the paths are not brought together."""
    monkeypatch.setattr(resolve, "HOT_ROWS", 20)
    rng = random.Random(4)
    paths = [f"{'hot.example' if rng.random() < 0.9 else f'h{i % 400}.example'}/{i}/x" for i in range(20_000)]
    table = spark.createDataFrame([(p, None) for p in paths], "path string, configured string")
    placed = table.select("path", "configured", F.posexplode(resolve.ancestors(F.col("path"))).alias("depth", "prefix"))
    names = placed.select("prefix").distinct()
    hot, cool = resolve.split_hot(placed, names)
    assert 1 <= hot.count() <= 1000
    sizes = sorted(r["count"] for r in cool.repartition(16, "prefix").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_one_shuffle_of_paths(spark, capsys):
    paths = spark.createDataFrame([("a/b/c",), ("a/d",)], "path string")
    resolve.nearest_ancestor(paths, spark.createDataFrame([("a",)], "prefix string")).explain("formatted")
    plan = capsys.readouterr().out.split("\n\n")[0]
    assert plan.count(" Exchange") == 2 and plan.count("SortMergeJoin") == 0  # paths, and the markers' distinct


# -- bodies -------------------------------------------------------------------------------

FIELDS = {"port": registry.Field("bigint", 7860), "share": registry.Field("boolean", False), "name": registry.Field("string", required=True), "rate": registry.Field("double", nullable=True)}
BODIES = [
    ('{"name": "a"}', (7860, False, "a", None), [], [], True),
    ('{"name": "a", "port": 1, "share": true, "rate": 2}', (1, True, "a", 2.0), [], [], True),
    ('{"name": "a", "port": " 12 ", "share": "Yes", "rate": "2.5"}', (12, True, "a", 2.5), [], [], True),
    ('{"name": "a", "port": 3.0, "share": 0, "rate": null}', (3, False, "a", None), [], [], True),
    ('{"name": 1, "port": 3.5, "share": 2, "rate": "x"}', (None, None, None, None), [], ["port", "share", "name", "rate"], False),
    ('{"port": null, "share": [], "rate": {}}', (None, None, None, None), ["name"], ["port", "share", "rate"], False),
    ('{"name": "a", "port": "3.0"}', (None, False, "a", None), [], ["port"], False),
    ('{"name": "a", "port": 92233720368547758080}', (None, False, "a", None), [], ["port"], False),
    ('{"name": "é\\n", "odd.name": 1, "share": "maybe"}', (7860, None, "é\n", None), [], ["share"], False),
]
UNREADABLE = ['{"name": "a"}, {}', '{"name": "a"} }', '{"name": "a"}], [{}', None, "", "x", '{"name": ', "[1]", '"text"', "3", "null", '{"name": "a"} x']


def test_bodies_are_read_with_types_and_defaults(spark):
    rows = [(i, b[0]) for i, b in enumerate(BODIES)] + [(100 + i, b) for i, b in enumerate(UNREADABLE)]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("_x", F.lit(1))
    out = {r.id: r for r in registry.typed_contract(df, "body", FIELDS).collect()}
    for i, (_, values, missing, broken, valid) in enumerate(BODIES):
        r = out[i]
        assert ((r.port, r.share, r.name, r.rate), r.missing, r.broken, r.valid, r.unreadable) == (values, missing, broken, valid, False), BODIES[i]
    for i in range(len(UNREADABLE)):
        r = out[100 + i]
        assert (r.unreadable, r.valid, r.port, r.share, r.name, r.missing, r.broken) == (True, False, None, None, None, [], [])
    assert registry.typed_contract(df.limit(0), "body", FIELDS).collect() == []
    assert [r.valid for r in registry.typed_contract(df.where("id = 0"), "body", {}).collect()] == [True]


# -- lists of records ---------------------------------------------------------------------


def test_one_bad_record_fails_its_list(spark):
    kind = "id long, items array<struct<name:string,model:string,rate:double>>"
    rows = [(1, [("a", "m1", 0.5), ("b", None, None)]), (2, [("a", "m1", 0.5), (None, "m9", 1.5), None]), (3, []), (4, None), (5, [("a", "m2", 2.0)])]
    out = {r.id: r for r in registry.records_contract(spark.createDataFrame(rows, kind), "items", ["name"], {"model": ["m1", "m2"]}, {"rate": (0, 1)}).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert [tuple(x) for x in out[2].broken_at] == [(1, ["name"], ["model", "rate"]), (2, ["name"], [])]
    absent = registry.records_contract(spark.createDataFrame(rows, kind), "items", ["other"]).where("id = 1").first()
    assert not absent.valid and [x.missing for x in absent.broken_at] == [["other"], ["other"]]


# -- common types -------------------------------------------------------------------------


def test_common_types():
    one, text = T.IntegerType(), T.StringType()
    assert registry.common_type([one, T.LongType()]) == T.LongType()
    assert registry.common_type([one, T.FloatType()]) == T.DoubleType()
    assert registry.common_type([one, T.DecimalType(9, 2)]) == T.DoubleType()
    assert registry.common_type([one, text]) == text == registry.common_type([T.BooleanType(), one])
    assert registry.common_type([T.DateType(), T.TimestampType()]) == T.TimestampType()
    assert registry.common_type([T.NullType(), one]) == one and registry.common_type([]) == T.NullType()
    nested = registry.common_type([T.StructType([T.StructField("a", one)]), T.StructType([T.StructField("b", text), T.StructField("a", text)])])
    assert nested.simpleString() == "struct<a:string,b:string>"


def test_union_of_clashing_types(spark):
    a = spark.createDataFrame([(1, "7", (1, "x"), [1], True)], "n int, v string, s struct<p:int,q:string>, l array<int>, `odd.name` boolean")
    b = spark.createDataFrame([(2**40, 8, (2.5, 3), [0.5], {"k": 1})], "n long, v int, s struct<p:double,r:int>, l array<double>, `odd.name` map<string,int>")
    c = spark.createDataFrame([(None,)], "n int")
    parts = [(0, a), (1, b), (2, c)]
    rows = {r.ordinal: r for r in registry.registry_union(parts).collect()}
    assert [rows[k].n for k in range(3)] == [1, 2**40, None]
    assert [rows[k].v for k in range(3)] == ["7", "8", None]
    assert tuple(rows[0].s) == (1.0, "x", None) and tuple(rows[1].s) == (2.5, None, 3) and rows[2].s is None
    assert (rows[0].l, rows[1].l) == ([1.0], [0.5])
    assert (rows[0]["odd.name"], rows[1]["odd.name"]) == ("true", '{"k":1}')
    wide = registry.widened(parts)
    assert wide["n"] == (["int", "bigint"], "bigint") and wide["v"] == (["string", "int"], "string")
    assert set(wide) == {"n", "v", "s", "l", "odd.name"}


# -- indented JSON ------------------------------------------------------------------------


def test_indented_json_equals_the_standard_library(spark):
    texts = ["plain", "é世界 😀", 'q"b\\s/\n\r\t\b\f', "".join(map(chr, range(32))) + "\x7f", "", "\\/", None]
    kind = "name string, n long, flag boolean, list array<string>, rows array<struct<a:int,b:array<int>>>, empty array<int>, m map<string,string>, inner struct<`odd.name \"x\"`:string,z:double>"
    rows = [(t, i, i % 2 == 0, [t, "x"], [(i, [1, 2]), (None, []), None], [], {"k": t}, (t, i + 0.5)) for i, t in enumerate(texts)] + [(None,) * 8]
    df = spark.createDataFrame(rows, kind)

    def plain(v):
        return {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v

    for r in fx.row_json(df, df.columns, pretty=True).collect():
        wanted = {c: plain(r[c]) for c in df.columns}
        assert r.json == json.dumps(wanted, indent=2, ensure_ascii=False)


def test_indented_json_of_other_types(spark):
    df = spark.createDataFrame([(Decimal("1.50"), datetime.date(2026, 1, 2), None)], "d decimal(9,2), t date, n string")
    assert fx.row_json(df, ["d", "t", "n"], pretty=True).first().json == '{\n  "d": 1.50,\n  "t": "2026-01-02",\n  "n": null\n}'
