"""Character references of HTML text, read inside the JVM.

The names are the public HTML5 table as Python's standard library holds it;
nothing is listed here.
"""

from __future__ import annotations

import html.entities
import json
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let

#: A numeric character reference.
NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
_START = r"(?=&(?:[a-zA-Z]|#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});))"
_NAME = r"^&([a-zA-Z][a-zA-Z0-9]*;?)"

NAMES = dict(html.entities.html5)
#: Names that count without a semicolon; of several that fit the longest does.
BARE = {k: v for k, v in NAMES.items() if not k.endswith(";")}
_LONGEST = max(map(len, BARE))


def _by_letter(table: dict[str, str], name: Column) -> Column:
    """The character of ``name``: its first letter and length pick a short table, in which a map's lookup walks.

    The tables are one literal, which the optimizer folds once.
    """
    tree: dict[str, dict[str, dict[str, str]]] = defaultdict(lambda: defaultdict(dict))
    for k, v in sorted(table.items()):
        tree[k[0]][str(len(k))][k] = v
    folded = F.from_json(F.lit(json.dumps(tree)), "map<string,map<string,map<string,string>>>")
    return F.try_element_at(F.try_element_at(F.try_element_at(folded, F.substring(name, 1, 1)), F.length(name).cast("string")), name)


def _numeric(piece: Column) -> Column:
    """The character of the numeric reference that ``piece`` begins with; one that names none is U+FFFD."""
    decimal = F.regexp_extract(piece, r"^&#([0-9]+);", 1).try_cast("int")
    code = F.coalesce(decimal, F.conv(F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);", 1), 16, 10).try_cast("int"))
    none = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(none, F.lit("�")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _named(piece: Column, bare_names: bool) -> Column:
    """``piece`` with the name that it begins with read: a whole name, else the longest bare one, else as it is."""
    name = F.regexp_extract(piece, _NAME, 1)
    rest = lambda n: F.substring(piece, n + 2, F.length(piece))
    if not bare_names:
        return F.coalesce(F.concat(_by_letter({k: v for k, v in NAMES.items() if k not in BARE}, name), rest(F.length(name))), piece)
    whole = F.concat(_by_letter(NAMES, name), rest(F.length(name)))
    bare = [F.concat(_by_letter({k: v for k, v in BARE.items() if len(k) == n}, F.substring(name, 1, n)), rest(F.lit(n))) for n in range(_LONGEST, 1, -1) if any(len(k) == n for k in BARE)]
    return F.coalesce(whole, *bare, piece)


def read_references(text: Column, bare_names: bool = True) -> Column:
    """``text`` with each character reference read once; what is none stays as it is.

    Named references follow the longest match; numeric ones need their semicolon.
    Without ``bare_names`` named ones need theirs too, so that a reference that was
    cut off (``&amp`` at the end of a shortened text) stays as it is.
    """

    def read(piece: Column) -> Column:
        numeric = F.concat(_numeric(piece), F.regexp_replace(piece, "^" + NUMERIC, ""))
        return F.when(F.startswith(piece, F.lit("&#")), F.when(piece.rlike("^" + NUMERIC), numeric).otherwise(piece)).when(F.startswith(piece, F.lit("&")), _named(piece, bare_names)).otherwise(piece)

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, _START, -1), read), "")).otherwise(t))
