"""Evidence, verdicts and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evidence_rollup(entities: DataFrame, evidence: DataFrame, on: str | list[str], rules: dict[str, Column]) -> DataFrame:
    """``entities`` with one flag per rule: whether any of its evidence meets the condition.

    No evidence is false, never null.  Evidence is summed up per key before it
    meets the entities, so a key with much evidence costs one row in the join,
    and all rules share one pass.
    """
    keys = [on] if isinstance(on, str) else list(on)
    flags = evidence.groupBy(*keys).agg(*(F.bool_or(condition).alias(flag) for flag, condition in rules.items()))
    joined = entities.join(flags, keys, "left")
    return joined.withColumns({flag: F.coalesce(F.col(flag), F.lit(False)) for flag in rules})


def verdict(df: DataFrame, exists: Column, required: list[Column], texts: tuple[Column, Column, Column], available: list[Column] | None = None) -> DataFrame:
    """``df`` with ``message`` and ``available``.

    ``texts`` are for complete, incomplete and absent, tried in this order:
    everything exists and is as required; it exists; it does not.  The flag may
    ask for other things than the message: ``available`` is its own list.
    """

    def holds(conditions: list[Column]) -> Column:
        out = F.coalesce(exists, F.lit(False))
        for c in conditions:
            out = out & F.coalesce(c, F.lit(False))
        return out

    complete, partial, missing = texts
    message = F.when(holds(required), complete).when(F.coalesce(exists, F.lit(False)), partial).otherwise(missing)
    return df.withColumns({"available": holds(required if available is None else available), "message": message})


def variants(df: DataFrame, parent: str, child: str, parents: DataFrame | None = None) -> DataFrame:
    """(parent, variants, display): the sorted different children of each parent.

    A parent of ``parents`` without children has an empty list, shown as "none".
    """
    listed = df.where(F.col(child).isNotNull()).groupBy(parent).agg(F.sort_array(F.collect_set(child)).alias("variants"))
    if parents is not None:
        listed = parents.select(parent).distinct().join(listed, parent, "left")
    names = F.coalesce("variants", F.array().cast("array<string>"))
    return listed.select(parent, names.alias("variants"), F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("none")).alias("display"))


def status_rows(df: DataFrame, ids: list[str], labels: dict[str, tuple[str, str, str] | str]) -> DataFrame:
    """Wide status records as rows (ids, ordinal, label, value), in the order of ``labels``.

    A flag has (label, text if true, text if not); any other column just a label.
    """
    cells = []
    for k, (column, spec) in enumerate(labels.items()):
        if isinstance(spec, str):
            label, value = spec, F.col(column).cast("string")
        else:
            label, value = spec[0], F.when(F.col(column).eqNullSafe(True), F.lit(spec[1])).otherwise(F.lit(spec[2]))
        cells.append(F.struct(F.lit(k).alias("ordinal"), F.lit(label).alias("label"), value.alias("value")))
    return df.select(*ids, F.explode(F.array(*cells)).alias("_cell")).select(*ids, "_cell.*")


def registry_summary(df: DataFrame, by: str | list[str] | None = None, ready: str = "available", online: str | None = None) -> DataFrame:
    """Rows, ready rows and (only an exact true counts) online rows, overall or by group."""
    keys = [] if by is None else [by] if isinstance(by, str) else list(by)
    measures = [F.count("*").alias("n"), F.count_if(F.col(ready).eqNullSafe(True)).alias("ready")]
    if online is not None:
        measures.append(F.count_if(F.col(online).eqNullSafe(True)).alias("online"))
    return df.groupBy(*keys).agg(*measures)
