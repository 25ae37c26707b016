"""Mixing sources to target weights by temperature, in DataFrame functions only.

Token shares ``p`` of the sources are raised to an exponent, ``w ~ p**a``.  The
exponent is bisected until the mixture meets its target: the least ``a`` whose
mixture repeats no source more than ``max_repeats`` times, or the greatest whose
entropy is at least ``entropy`` nats.

The weights become token quotas of a budget.  Without a given budget it is the
least one at which every source is used whole at least once, so that mixing
repeats small sources and drops nothing.  A source's quota is realised as
permutations of its documents: as many whole ones as fit, and of one more
permutation the leading documents until the quota is filled.  A permutation is
dealt into about sqrt(n) blocks by hash; block totals are summed in order, and
only the block in which the quota ends is looked at document by document.
What comes out is one threshold per source, so texts are neither sorted nor
shuffled, however large a source is.

``mixture`` gives each copy its block and its position in the source's sequence
of permutations, from block counts and ranks inside blocks of about sqrt(n)
narrow rows; equal rows are counted first.  ``at``, the position as a share of
the source's copies, interleaves the sources: sorted by it, every stretch of the
mixture holds them by their numbers of copies.

Defined results for odd input: a null or empty text has 0 tokens; sources
without tokens have weight 0 and go out once, as they are; a null source is a
source, apart from ""; rows that repeat a ``doc_id`` stand or fall together, side by side; with a given budget
a document may have no copy, and then no row of the mixture; an empty table
gives no rows; extra columns pass through ``mixed`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.spill import bounded_broadcast, checkpointed, saved

#: Repeats of a source at most, and the seed of the permutations.
MAX_REPEATS = 2.0
SEED = 17
#: Halvings of the exponent's interval; each pass over the source table does HALVINGS of them.
STEPS, HALVINGS = 40, 5
#: Sources whose plan is broadcast to the documents; more are joined by a shuffle.
MAX_SOURCES = 100_000

_WORD = r"[^\x20\x09-\x0D]+"


def source_key(source):
    """A source as a key that is never null; null and "" are different sources."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_tokens(docs: DataFrame) -> DataFrame:
    """(id, source_key, n_tokens): one narrow row per document."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        source_key(F.col("source")).alias("source_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD)).cast("long").alias("n_tokens"),
    )


def _draw(epoch, seed: int):
    """48 pseudo-random bits of a document in one permutation."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("id"))), 1, 12), 16, 10).cast("long")


def _met(row, max_repeats: float | None, entropy: float | None) -> bool:
    return row["repeats"] <= max_repeats if entropy is None else row["entropy"] < entropy


def bisect_exponent(sources: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent that meets the target, by ``STEPS`` halvings of [0, 1].

    Each pass evaluates the midpoints of ``HALVINGS`` levels at once and returns
    one aggregated row per midpoint.
    """
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    p = sources.where("tokens > 0").select((F.col("tokens") / total).alias("p"))

    def evaluate(exponents: list[float]) -> dict[float, object]:
        a, pa = F.col("a"), F.pow("p", F.col("a"))
        rows = p.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a")).groupBy("a").agg(
            F.sum(pa).alias("z"), F.sum(pa * F.log("p")).alias("pl"), F.max(F.pow("p", a - 1)).alias("most"), F.max(F.pow("p", 1 - a)).alias("whole")
        )
        repeats = F.col("most") * (F.col("whole") if budget is None else F.lit(float(budget)) / total / F.col("z"))
        return {r["a"]: r for r in rows.select("a", repeats.alias("repeats"), (F.log("z") - a * F.col("pl") / F.col("z")).alias("entropy")).collect()}

    lo, hi = 0.0, 1.0
    if entropy is None and _met(evaluate([0.0])[0.0], max_repeats, entropy):
        return 0.0
    for _ in range(STEPS // HALVINGS):
        grid = [lo + (hi - lo) * k / 2**HALVINGS for k in range(1, 2**HALVINGS)]
        at = evaluate(grid)
        i, j = 0, 2**HALVINGS
        for _ in range(HALVINGS):
            k = (i + j) // 2
            i, j = (i, k) if _met(at[grid[k - 1]], max_repeats, entropy) else (k, j)
        lo, hi = lo + (hi - lo) * i / 2**HALVINGS, lo + (hi - lo) * j / 2**HALVINGS
    return hi if entropy is None else lo


def mixing_plan(tokens: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per source: source_key, tokens, weight, quota, whole permutations, and where the last one ends."""
    sources = checkpointed(tokens.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    a = bisect_exponent(sources, max_repeats, entropy, budget)
    live = sources.where("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0] or 1
    raised = F.pow(F.col("tokens") / total, F.lit(a))
    z, least = live.agg(F.sum(raised), F.max(F.col("tokens") / raised)).first()
    size = float(budget) if budget is not None else (least or 0.0) * (z or 0.0)
    quota = F.when(F.col("tokens") > 0, F.round(raised / (z or 1.0) * size).cast("long")).otherwise(F.lit(0).cast("long"))
    plan = sources.select("source_key", "tokens", "docs", (F.when(F.col("tokens") > 0, raised / (z or 1.0)).otherwise(0.0)).alias("weight"), quota.alias("quota"))
    plan = plan.select("*", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("long").alias("whole"))
    plan = plan.select("*", F.when(F.col("tokens") > 0, F.col("quota") - F.col("whole") * F.col("tokens")).otherwise(F.lit(0)).cast("long").alias("rest"), F.ceil(F.sqrt("docs")).cast("long").alias("n_blocks"))
    plan = checkpointed(plan)

    small = bounded_broadcast(plan.where("rest > 0").select("source_key", "whole", "rest", "n_blocks"), MAX_SOURCES)
    dealt = tokens.join(small, "source_key").withColumn("u", _draw(F.col("whole"), seed))
    dealt = dealt.withColumn("block", F.expr("shiftright(shiftright(u, 16) * n_blocks, 32)"))
    blocks = dealt.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = blocks.select("source_key", "block", "rest", before.alias("before")).where("before < rest").groupBy("source_key").agg(F.max("block").alias("block"), F.max_by("before", "block").alias("before"))
    last = bounded_broadcast(saved(last, "last-blocks"), MAX_SOURCES)
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source_key", "block").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = dealt.join(last, ["source_key", "block"]).select("source_key", "u", "id", "rest", (F.col("before") + inside).alias("upto")).where("upto < rest")
    ends = ends.groupBy("source_key").agg(F.max(F.struct("u", "id")).alias("end"))
    return plan.join(ends, "source_key", "left").select("source_key", "tokens", "docs", "weight", "quota", "whole", F.col("end.u").alias("end_u"), F.col("end.id").alias("end_id"))


def with_copies(tokens: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``tokens`` with ``copies``: how often each document goes out."""
    joined = tokens.join(bounded_broadcast(plan.select("source_key", "whole", "end_u", "end_id"), MAX_SOURCES), "source_key")
    u = _draw(F.col("whole"), seed)
    taken = F.coalesce((u < F.col("end_u")) | ((u == F.col("end_u")) & (F.col("id") <= F.col("end_id"))), F.lit(False))
    return joined.withColumn("copies", F.col("whole") + taken.cast("long")).drop("whole", "end_u", "end_id")


def arranged(copied: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per copy of ``copied`` (id, source_key, n_tokens, docs, copies): its permutation ``copy``, ``block``, ``position`` and ``at``."""
    n_blocks = F.ceil(F.sqrt("docs")).cast("long")
    rows = copied.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("u", _draw(F.col("copy"), seed))
    rows = rows.withColumn("block", F.shiftright(F.shiftright("u", 16) * n_blocks, 32))
    rows = saved(rows.groupBy(*rows.columns).agg(F.count("*").alias("equal")), "copies")
    sizes = rows.groupBy("source_key", "copy", "block").agg(F.sum("equal").alias("n"))
    before = sizes.select("source_key", "copy", "block", F.coalesce(F.sum("n").over(Window.partitionBy("source_key", "copy").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    total = bounded_broadcast(saved(rows.groupBy("source_key").agg(F.sum("equal").alias("in_source")), "source-copies"), MAX_SOURCES)
    inside = F.coalesce(F.sum("equal").over(Window.partitionBy("source_key", "copy", "block").orderBy("u", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(before, ["source_key", "copy", "block"]).join(total, "source_key")
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("equal") - 1)))
    each = each.withColumn("position", F.col("copy") * F.col("docs") + F.col("before") + F.col("inside") + F.col("k"))
    return each.withColumn("at", (F.col("position") + 0.5) / F.col("in_source")).drop("u", "equal", "inside", "before", "in_source", "k", "docs")


def mixture(docs: DataFrame, **target) -> DataFrame:
    """doc_id, source, n_tokens, quota of its source, copies, and copy, block, position, at: one row per copy."""
    tokens = saved(source_tokens(docs), "source-tokens")
    plan = saved(mixing_plan(tokens, **target), "mixing-plan")
    seed = target.get("seed", SEED)
    quotas = bounded_broadcast(plan.select("source_key", "quota", "docs"), MAX_SOURCES)
    rows = arranged(with_copies(tokens, plan, seed).join(quotas, "source_key"), seed)
    source = F.when(F.col("source_key") != "-", F.expr("substring(source_key, 2)"))
    return rows.select(F.nullif("id", F.lit("")).cast("bigint").alias("doc_id"), source.alias("source"), "n_tokens", "quota", "copies", "copy", "block", "position", "at")


def mixed(docs: DataFrame, **target) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture wants it; columns as they were."""
    tokens = saved(source_tokens(docs), "source-tokens")
    plan = saved(mixing_plan(tokens, **target), "mixing-plan")
    names = docs.columns
    whole_row = F.struct(*(docs[c] for c in names)).alias("_row")
    keyed = docs.select(whole_row).select("_row", F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")).alias("id"), source_key(F.col("_row.source")).alias("source_key"))
    out = with_copies(keyed, plan, target.get("seed", SEED)).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
