"""Choosing: the first viable candidate, the nearest marked ancestor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalise_key, port_url

#: Marked prefixes that are broadcast as an index (rows, and bytes of their text).
MAX_MARKERS, MAX_MARKER_BYTES = 200_000, 16 << 20
#: Beyond that, a prefix of more rows than this, and than a thousandth of all, is looked up by broadcast and not shuffled.
HOT_ROWS = 10_000


def first_viable(entities: DataFrame, candidates: DataFrame, on: str, viable: Column, order: list[Column], keep: list[str]) -> DataFrame:
    """``entities`` with the columns ``keep`` of their first viable candidate, null if there is none.

    A minimum over an order key, so candidates are summed up before the
    shuffle and never sorted.  ``order`` must be total for a definite result.
    """
    best = candidates.where(viable).groupBy(on).agg(F.min_by(F.struct(*keep), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))).alias("_best"))
    return entities.join(best, on, "left").select(*(entities[c] for c in entities.columns), *(F.col(f"_best.{c}").alias(c) for c in keep))


def needs_met(needs: Column, have: Column) -> Column:
    """Whether a need is met; no need is always met."""
    return needs.isNull() | F.coalesce(have, F.lit(False))


def choose_candidate(requests: DataFrame, candidates: DataFrame, inventory: DataFrame, tools: DataFrame) -> DataFrame:
    """For each request (module, impl) the first candidate whose path and tool are present.

    ``candidates`` are (module, impl, rank, needs_path, needs_tool, command),
    ``inventory`` is (path), ``tools`` is (tool).  Unknown requests get null.
    """
    paths = inventory.select(F.col("path").alias("needs_path"), F.lit(True).alias("_has_path")).distinct()
    names = tools.select(F.col("tool").alias("needs_tool"), F.lit(True).alias("_has_tool")).distinct()
    known = candidates.join(paths, "needs_path", "left").join(names, "needs_tool", "left")
    known = known.withColumn("_key", F.struct("module", "impl"))
    viable = needs_met(F.col("needs_path"), F.col("_has_path")) & needs_met(F.col("needs_tool"), F.col("_has_tool"))
    asked = requests.withColumn("_key", F.struct("module", "impl"))
    return first_viable(asked, known, "_key", viable, [F.col("rank"), F.col("command")], ["rank", "command"]).drop("_key")


def ancestors(path: Column) -> Column:
    """The ancestors of a path, the root ("/") first; the path itself is none of them."""
    parts = F.split(path, "/", -1)
    joined = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(F.size(parts) > 1, F.transform(joined, lambda a: F.when(a == "", F.lit("/")).otherwise(a))).otherwise(F.array().cast("array<string>"))


def split_hot(placed: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, cool): the prefixes of ``names`` that stand in very many rows of ``placed``, and the rows that have none of them.

    Counts are summed up in each task first.  Each row counts for one
    prefix, so at most a thousand prefixes hold over a thousandth of the rows.
    """
    sizes = placed.groupBy("prefix").agg(F.count("*").alias("n"))
    limit = max(HOT_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = names.join(sizes.where(F.col("n") > limit).select("prefix"), "prefix", "left_semi")
    # a hot prefix that is no marker must not be shuffled either
    return hot, placed.join(F.broadcast(sizes.where(F.col("n") > limit).select("prefix")), "prefix", "left_anti")


def marked_rows(placed: DataFrame, markers: DataFrame) -> list[DataFrame]:
    """The rows of ``placed`` (path, configured, depth, prefix) whose prefix is marked, as tables of the same columns.

    Few markers are an index that each task holds.  More are joined by their
    text, but for the hottest: those would bring the rows of a whole host to one
    task, and are looked up by broadcast.
    """
    names = markers.select("prefix").where("prefix is not null").distinct()
    size = names.agg(F.count("*").alias("n"), F.sum(F.octet_length("prefix")).alias("bytes")).first()
    columns = ["path", "configured", "depth", "prefix"]
    if size["n"] <= MAX_MARKERS and (size["bytes"] or 0) <= MAX_MARKER_BYTES:
        return [placed.join(F.broadcast(names), "prefix").select(*columns)]
    hot, cool = split_hot(placed, names)
    return [placed.join(F.broadcast(hot), "prefix").select(*columns), cool.join(names, "prefix").select(*columns)]


def nearest_ancestor(paths: DataFrame, markers: DataFrame, fallback_up: int = 5) -> DataFrame:
    """(path, configured, marked, root) for every different path (and setting).

    ``paths`` has ``path`` and, if there are settings, ``configured``; ``markers`` has
    ``prefix``.  ``root`` is the setting unless it is null or empty, else the
    closest ancestor that is a marker, else the ancestor ``fallback_up`` levels
    up, which a shallower path does not have (null).

    The ancestors of a path are looked up where the path is, and one aggregate
    by path keeps the longest that is marked: that is the only shuffle of paths
    while the index of markers can be broadcast.
    """
    if "configured" not in paths.columns:
        paths = paths.withColumn("configured", F.lit(None).cast("string"))
    paths = paths.select("path", "configured").where("path is not null")
    placed = paths.select("path", "configured", F.posexplode(ancestors(F.col("path"))).alias("depth", "prefix"))
    alone = paths.select("path", "configured", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("prefix"))
    rows = alone
    for found in marked_rows(placed, markers):
        rows = rows.unionByName(found)
    nearest = rows.groupBy("path", "configured").agg(F.max_by("prefix", "depth").alias("marked"))
    above = ancestors(F.col("path"))
    fallback = F.when(F.size(above) >= fallback_up, F.element_at(above, -fallback_up))
    return nearest.select("path", "configured", "marked", F.coalesce(F.nullif("configured", F.lit("")), F.col("marked"), fallback).alias("root"))


def launch_outcome(requests: DataFrame, statuses: DataFrame, candidates: DataFrame, inventory: DataFrame, tools: DataFrame, default_impl: str, default_port: int) -> DataFrame:
    """(request_id, module, impl, ok, command, url, message), one row per request.

    ``requests`` are (request_id, module, impl, port): an empty ``impl`` becomes the
    default, a null ``port`` too.  ``statuses`` are (module, impl, exists, available,
    title, message).  Tried in this order: the module or its variant is not there
    (the status message); no candidate can run; else the command that runs, and
    its address.  Nothing is started.

    A module that has no status was not found; of several status rows a flag holds if
    any has it, and the least texts count.
    """
    asked = requests.select("request_id", "module", normalise_key(F.col("impl"), default_impl).alias("impl"), F.coalesce("port", F.lit(default_port)).alias("port"))
    gates = statuses.groupBy("module", "impl").agg(F.bool_or("exists").alias("exists"), F.bool_or("available").alias("available"), F.min("title").alias("title"), F.min("message").alias("status"))
    met = choose_candidate(asked.join(gates, ["module", "impl"], "left"), candidates, inventory, tools)
    gate = F.coalesce(F.col("exists") & F.col("available"), F.lit(False))
    absent = F.concat(F.lit("Module "), F.coalesce(F.col("module").cast("string"), F.lit("?")), F.lit(" ("), "impl", F.lit(") was not found."))
    # fixed values: the texts of an outcome
    nothing = F.concat(F.lit("No runnable command for impl '"), "impl", F.lit("' (missing toolchain or build)."))
    started = F.concat(F.lit("Started "), F.coalesce("title", F.col("module").cast("string")), F.lit(" ("), "impl", F.lit(") API on port "), F.col("port").cast("string"), F.lit("."))
    ok = gate & F.col("command").isNotNull()
    message = F.when(~gate, F.coalesce("status", absent)).when(~ok, nothing).otherwise(started)
    return met.select("request_id", "module", "impl", ok.alias("ok"), F.when(ok, F.col("command")).alias("command"), F.when(ok, port_url(F.col("port"))).alias("url"), message.alias("message"))
