"""Text and link expressions; all stay inside the JVM."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space at either end, in the Unicode sense.
_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """``c`` without Unicode white space at its ends."""
    return F.regexp_replace(c, _ENDS, "")


def normalise_key(c: Column, default: str) -> Column:
    """Null or empty becomes ``default``; the result is stripped and lowered.

    A value of white space alone is not empty, so it becomes "" and not the default.
    """
    return F.lower(strip(F.coalesce(F.nullif(c, F.lit("")), F.lit(default))))


def default_fill(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Nulls of the named columns replaced; columns that are absent are added."""
    fill = {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(fill)


def csv_list(c: Column, sep: str = ",") -> Column:
    """Items of delimited text, each stripped, empty ones dropped; null gives an empty list."""
    parts = F.split(F.coalesce(c, F.lit("")), re.escape(sep), -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def derive_link(base: Column, suffix: str) -> Column:
    """``base`` and ``suffix`` joined; null if there is no base (null or empty)."""
    return F.concat(F.nullif(base, F.lit("")), F.lit(suffix))


def port_url(port: Column, host: str = "127.0.0.1") -> Column:
    """The local address of a port; null gives null."""
    return F.concat(F.lit(f"http://{host}:"), port.cast("string"))


#: What a JSON string escapes, the backslash first.
_ESCAPES = {c: json.dumps(c)[1:-1] for c in ["\\", '"', *map(chr, range(32))]}


def _quoted(c: Column) -> Column:
    """A JSON string: only quotes, backslashes and control characters are escaped."""
    text = c
    for char, escape in _ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    text = F.when(c.rlike(r'[\x00-\x1f"\\]'), text).otherwise(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def indented_json(value: Column, kind: T.DataType, depth: int = 0, indent: int = 2) -> Column:
    """``value`` as JSON text with one member a line, nulls kept, letters as they are.

    An expression made by walking the type: structs and maps become objects, arrays
    lists; empty ones stay on one line.  Numbers are written as Spark writes them in
    JSON; anything else (dates, decimals, ...) as the JSON writer of Spark has it.
    """
    pad, close = "\n" + " " * indent * (depth + 1), "\n" + " " * indent * depth

    def wrapped(items: Column, left: str, right: str) -> Column:
        return F.when(F.size(items) == 0, F.lit(left + right)).otherwise(F.concat(F.lit(left + pad), F.array_join(items, "," + pad), F.lit(close + right)))

    if isinstance(kind, T.StructType):
        members = F.array(*(F.concat(_quoted(F.lit(f.name)), F.lit(": "), indented_json(value[f.name], f.dataType, depth + 1, indent)) for f in kind)) if len(kind) else F.array().cast("array<string>")
        text = wrapped(members, "{", "}")
    elif isinstance(kind, T.ArrayType):
        text = wrapped(F.transform(value, lambda x: indented_json(x, kind.elementType, depth + 1, indent)), "[", "]")
    elif isinstance(kind, T.MapType):
        members = F.transform(F.map_entries(value), lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(": "), indented_json(e["value"], kind.valueType, depth + 1, indent)))
        text = wrapped(members, "{", "}")
    elif isinstance(kind, T.StringType):
        return _quoted(value)
    elif isinstance(kind, T.NullType):
        return F.lit("null")
    else:
        array = F.to_json(F.array(value))
        text = F.substring(array, F.lit(2), F.length(array) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def row_json(df: DataFrame, columns: list[str], pretty: bool = False, name: str = "json") -> DataFrame:
    """``df`` with the columns serialised as JSON; nulls stay in it, as nulls.

    ``pretty`` indents by two blanks, ``": "`` between name and value.
    """
    row = F.struct(*columns)
    if pretty:
        return df.withColumn(name, indented_json(row, df.select(row.alias("r")).schema["r"].dataType))
    return df.withColumn(name, F.to_json(row, {"ignoreNullFields": "false"}))


def error_text(text: Column, status: Column) -> Column:
    """The text of a failed request, or one made from its status if the text is empty."""
    made = F.lit("Request failed: ")  # fixed value
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(made, status.cast("string")))
