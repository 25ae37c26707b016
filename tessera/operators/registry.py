"""Tables of different shape under one contract."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a module status, required and optional.
STATUS_REQUIRED = ["id", "name", "kind", "available", "source_available", "ui_available", "api_available", "web_available", "path", "message"]
STATUS_OPTIONAL = ["web_url", "api_url"]


#: Number types from narrow to wide.
_WIDTH = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def common_type(types: list[T.DataType]) -> T.DataType:
    """The type that holds the values of all ``types``.

    One type stays; whole numbers go to the widest, numbers of which one has
    fractions to double; dates and timestamps to timestamp; structs field by field,
    in order of appearance; arrays by their elements; anything else to text, which
    every value has.
    """
    types = [t for t in dict.fromkeys(types) if t != T.NullType()]
    if len(types) <= 1:
        return types[0] if types else T.NullType()
    if all(t in _WIDTH for t in types):
        widest = max(types, key=_WIDTH.index)
        return T.DoubleType() if isinstance(widest, T.FloatType) else widest
    if all(t in _WIDTH or isinstance(t, T.DecimalType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in types):
        return T.TimestampType()
    if all(isinstance(t, T.StructType) for t in types):
        names = dict.fromkeys(f.name for t in types for f in t)
        return T.StructType([T.StructField(n, common_type([f.dataType for t in types for f in t if f.name == n])) for n in names])
    if all(isinstance(t, T.ArrayType) for t in types):
        return T.ArrayType(common_type([t.elementType for t in types]))
    return T.StringType()


def _as_type(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """``value`` as the common type; nested values are rebuilt, and become JSON where they must be text."""
    if have == want:
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        own = {f.name: f.dataType for f in have}
        fields = [(_as_type(value[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda x: _as_type(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value, {"ignoreNullFields": "false"})
    return value.cast(want)


def widened(parts: list[tuple[int, DataFrame]]) -> dict[str, tuple[list[str], str]]:
    """Columns whose type differs between the tables: their types in order of appearance, and the common one."""
    kinds: dict[str, list[T.DataType]] = {}
    for _, df in parts:
        for f in df.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    return {c: ([t.simpleString() for t in dict.fromkeys(types)], common_type(types).simpleString()) for c, types in kinds.items() if len(set(types)) > 1}


def registry_union(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """All tables under one schema; what a table lacks is null, its place in the list is ``ordinal``.

    A column that the tables hold in different types gets their ``common_type``;
    ``widened`` lists such columns.
    """
    kinds: dict[str, list[T.DataType]] = {}
    for _, df in parts:
        for f in df.schema:
            kinds.setdefault(f.name, []).append(f.dataType)
    common = {c: common_type(types) for c, types in kinds.items()}
    tagged = [df.select(*(_as_type(df[f"`{f.name}`"], f.dataType, common[f.name]).alias(f.name) for f in df.schema), F.lit(k).alias("ordinal")) for k, df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def contract_check(df: DataFrame, required: list[str], optional: list[str] = (), allowed: dict[str, list] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df`` with ``missing`` (required fields that are null), ``broken`` (fields out of bounds) and ``valid``.

    Rejected rows are kept, with their reasons.  Columns outside the contract
    are dropped where ``optional`` is given; a required column that the table does not have
    counts as null in every row.
    """
    def field(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None)

    def names(flags: dict[str, Column]) -> Column:
        listed = F.array(*(F.when(bad, F.lit(c)) for c, bad in flags.items())) if flags else F.array()
        return F.filter(listed.cast("array<string>"), lambda x: x.isNotNull())

    rules = {c: field(c).isNotNull() & ~field(c).isin(list(v)) for c, v in (allowed or {}).items()}
    rules |= {c: field(c).isNotNull() & ~field(c).between(*v) for c, v in (ranges or {}).items()}
    out = df.withColumns({"missing": names({c: field(c).isNull() for c in required}), "broken": names(rules)})
    out = out.withColumn("valid", (F.size("missing") == 0) & (F.size("broken") == 0))
    if optional:
        keep = [c for c in [*required, *optional, *(c for c in ("ordinal",) if c in df.columns)] if c in df.columns]
        out = out.select(*dict.fromkeys(keep), "missing", "broken", "valid")
    return out


def all_valid(checked: DataFrame, by: Column | None = None, name: str = "grp") -> DataFrame:
    """Valid and rejected rows, and whether a whole list is valid: overall or by group."""
    keys = [] if by is None else [by.alias(name)]
    return checked.groupBy(*keys).agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_rejected"), F.bool_and("valid").alias("all_valid"))


def records_contract(df: DataFrame, column: str, required: list[str], allowed: dict[str, list] | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df`` with ``broken_at`` and ``valid`` for a list of records in ``column`` (array<struct>).

    ``broken_at`` has (pos, missing, broken) of each record that breaks the contract, counted
    from 0; one such record fails its list.  Nothing is exploded.  A null record lacks
    all required fields; a null list is not valid, an empty one is.
    """
    have = set(df.schema[column].dataType.elementType.names)

    def field(x: Column, c: str) -> Column:
        return x[c] if c in have else F.lit(None)

    def names(flags: dict[str, Column]) -> Column:
        listed = F.array(*(F.when(bad, F.lit(c)) for c, bad in flags.items())) if flags else F.array()
        return F.filter(listed.cast("array<string>"), lambda n: n.isNotNull())

    def judged(x: Column, k: Column) -> Column:
        rules = {c: field(x, c).isNotNull() & ~field(x, c).isin(list(v)) for c, v in (allowed or {}).items()}
        for c, v in (ranges or {}).items():
            outside = field(x, c).isNotNull() & ~field(x, c).between(*v)
            rules[c] = rules[c] | outside if c in rules else outside
        return F.struct(k.cast("int").alias("pos"), names({c: field(x, c).isNull() for c in required}).alias("missing"), names(rules).alias("broken"))

    bad = F.filter(F.transform(F.col(column), judged), lambda r: (F.size(r["missing"]) > 0) | (F.size(r["broken"]) > 0))
    return df.withColumn("broken_at", bad).withColumn("valid", F.coalesce(F.size("broken_at") == 0, F.lit(False)) & F.col(column).isNotNull())


@dataclass(frozen=True)
class Field:
    """What a request body says under one name: its type (bigint, double, boolean or string), and what counts if it is absent."""

    type: str
    default: object = None
    required: bool = False
    nullable: bool = False


#: Texts that are read as a boolean.
TRUE_TEXTS, FALSE_TEXTS = ["1", "true", "t", "yes", "y", "on"], ["0", "false", "f", "no", "n", "off"]


def _typed(body: Column, name: str, spec: Field) -> tuple[Column, Column, Column]:
    """(kind, fits, value) of one field; ``kind`` is null if the body lacks it."""
    path = f"$['{name}']"
    kind = F.schema_of_variant(F.try_variant_get(body, path, "variant"))
    text = F.try_variant_get(body, path, "string")
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    if spec.type == "string":
        value, fits = text, kind == "STRING"
    elif spec.type == "boolean":
        said = F.lower(F.trim(text))
        value = F.when(said.isin(TRUE_TEXTS), True).when(said.isin(FALSE_TEXTS), False)
        fits = ((kind == "BOOLEAN") | (kind == "STRING") | number) & value.isNotNull()
    elif spec.type == "bigint":
        exact = F.trim(text).try_cast("decimal(38,9)")
        value = exact.try_cast("bigint")
        # a text must be a whole number as it stands, a number may be one with a point
        fits = ((number & (exact == F.floor(exact))) | ((kind == "STRING") & F.trim(text).rlike(r"^[+-]?[0-9]{1,19}$"))) & value.isNotNull()
    elif spec.type == "double":
        value = F.trim(text).try_cast("double")
        fits = (number | (kind == "STRING")) & value.isNotNull()
    else:
        raise ValueError(f"no rule for type {spec.type}")
    fits = F.coalesce(fits, F.lit(False)) | (F.lit(spec.nullable) & (kind == "VOID"))
    return kind, fits, F.when(fits, value)


def typed_contract(df: DataFrame, body: str, fields: dict[str, Field]) -> DataFrame:
    """``df`` with the ``fields`` of the JSON text ``body`` as typed columns, and ``missing``, ``broken``, ``unreadable``, ``valid``.

    Read on arrival, once, as a variant: a body that is null, no JSON or no object is
    ``unreadable`` and its fields are null; a field of another type is ``broken`` and
    null; one that is absent gets its default, or is ``missing`` if it is required.
    Numbers and booleans may be given as text that reads as such, as request bodies do.
    An explicit null is broken unless the field may be null.  No row is dropped.
    """
    # the parser stops after the first value, so the body is read inside a list and inside an object: what is left over fails one of them
    listed_body, member = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"b":'), body, F.lit("}")))
    parsed = df.withColumn("_body", F.when(member.isNotNull(), F.try_variant_get(listed_body, "$[0]", "variant")))
    readable = F.coalesce(F.schema_of_variant("_body").startswith("OBJECT"), F.lit(False))
    columns, missing, broken = {}, [], []
    for name, spec in fields.items():
        kind, fits, value = _typed(F.col("_body"), name, spec)
        columns[name] = F.when(readable, F.when(kind.isNull(), F.lit(spec.default).cast(spec.type)).otherwise(value)).cast(spec.type)
        broken.append(F.when(readable & kind.isNotNull() & ~fits, F.lit(name)))
        if spec.required:
            missing.append(F.when(readable & kind.isNull(), F.lit(name)))
    listed = lambda flags: F.filter((F.array(*flags) if flags else F.array()).cast("array<string>"), lambda n: n.isNotNull())
    out = parsed.withColumns(columns | {"missing": listed(missing), "broken": listed(broken), "unreadable": ~readable}).drop("_body")
    return out.withColumn("valid", ~F.col("unreadable") & (F.size("missing") == 0) & (F.size("broken") == 0))
