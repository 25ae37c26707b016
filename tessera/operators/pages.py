"""Web pages into scored text regions, and one outcome row per request.

A page is scanned once into comments, raw-text elements, tags and text, as the
HTML rules have it: an open comment, script or tag runs to the end of the page; a
``>`` inside a quoted attribute value ends no tag; a ``<`` that begins no tag is
text.  Each tag is then marked where it stands, so that every later step looks at
marks and never again at angle brackets.  All of it is expressions of one narrow
pass; nothing is shuffled before regions meet requests.

Defined results for odd input: a null or empty page has no regions; a page's own
control characters stay text; end tags without a start close nothing; of several
pages of one ``page_id`` requests get the one whose MD5 is least (equal ones are
one), while regions are those of every row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import let, running_min, running_sum
from tessera.functions.references import read_references

#: Elements whose content is no text of the page, and is not scanned for tags.
RAW = ["script", "style", "title", "iframe", "noembed", "noframes"]
#: What a head may hold; any other start tag ends it.
HEAD = ["meta", "link", "base", "style", "script", "title", "noscript", "template"]
#: A region begins at an opening block tag.  The first list needs end tags and so nests; those of the second are often left open.
NESTING = ["h1", "h2", "h3", "h4", "h5", "h6", "div", "article", "section", "nav", "ul", "ol", "dl", "table", "header", "footer", "main", "aside", "form", "pre", "blockquote", "figure"]
BLOCKS = [*NESTING, "p", "li", "dt", "dd", "tr", "td", "th"]

#: What follows a tag's name: a quote counts only after an equals sign.
_REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"
_COMMENT = r"!--(?:-?>|.*?(?:--!?>|\z))"
_RAW = "|".join(rf"{name}(?:[\s/]{_REST}|>|\z).*?(?:</{name}(?:[\s/][^>]*)?(?:>|\z)|\z)" for name in RAW)
_TAG = rf"[a-zA-Z]{_REST}|[/!?][^>]*(?:>|\z)"
#: All that begins with ``<``; what is a tag is group 1, after that character.
SCAN = rf"(?is)<(?:{_COMMENT}|{_RAW}|({_TAG}))"

#: U+0001 and what follows it mark a tag's begin and end and a cut; a page's own U+0001 is the first.
_OWN, _BEGIN, _END, _CUT = "\x01\x03", "\x01\x04", "\x01\x05", "\x01\x06"
_INSIDE = "[^\x01]*+(?:\x01\x03[^\x01]*+)*+"


def _marked(tag: str) -> str:
    """A pattern of marked tags whose text after ``<`` begins with ``tag`` and there ends its name."""
    return rf"{_BEGIN}<(?:{tag})(?=[\s/>\x01]){_INSIDE}{_END}"


def scanned(html: Column) -> Column:
    """``html`` with its tags marked; comments, raw-text elements and the head are a blank each."""
    marked = F.regexp_replace(F.replace(html, F.lit("\x01"), F.lit(_OWN)), SCAN, f"{_BEGIN}<$1{_END}")
    marked = F.replace(marked, F.lit(f"{_BEGIN}<{_END}"), F.lit(" "))
    body = rf"(?={_BEGIN}<(?!(?:{'|'.join(HEAD)})[\s/>\x01])[a-zA-Z])"
    return F.regexp_replace(marked, rf"(?is){_marked('head')}.*?(?:{_marked('/head')}|{body}|\z)", " ")


def _plain(marked: Column) -> Column:
    return F.replace(marked, F.lit(_OWN), F.lit("\x01"))


def _text(piece: Column, bare_names: bool) -> Column:
    """Visible text of a marked piece: tags out, references read, white space single."""
    text = _plain(F.regexp_replace(piece, rf"{_BEGIN}{_INSIDE}{_END}", " "))
    return F.trim(F.regexp_replace(read_references(text, bare_names), r"[ \t\n\x0B\f\r]+", " "))


def _depths(pieces: Column) -> Column:
    """How many nesting blocks are open where each piece begins, its own included.

    A piece's balance is its opening tag less the end tags in it; the running
    sum of balances, held at 0 from below by its running minimum, is the depth.
    """
    opened = lambda x: F.when(x.rlike(rf"(?i)^{_marked('|'.join(NESTING))}"), 1).otherwise(0).cast("bigint")
    closed = lambda x: F.regexp_count(x, F.lit(rf"(?i){_marked('/(?:' + '|'.join(NESTING) + ')')}")).cast("bigint")
    level = let(running_sum(F.transform(pieces, lambda x: opened(x) - closed(x))), lambda sums: F.zip_with(sums, running_min(sums), lambda s, low: s - F.least(low, F.lit(0))))
    before = F.slice(F.concat(F.array(F.lit(0).cast("bigint")), level), F.lit(1), F.size(pieces))
    return F.zip_with(before, F.transform(pieces, opened), lambda b, o: (b + o).cast("int"))


BLOCK_TYPE = "array<struct<pos:int,tag:string,text:string,score:double,depth:int>>"


def page_blocks(pages: DataFrame, threshold: float = 0.3, bare_names: bool = True) -> DataFrame:
    """(page_id, version, blocks) of each row: its regions with text and a score of at least ``threshold``, in order.

    ``version`` is the page's MD5.  Without ``bare_names`` a named reference needs its semicolon.
    """
    cut = F.split(F.regexp_replace(scanned(F.col("html")), rf"(?i)({_marked('|'.join(BLOCKS))})", _CUT + "$1"), _CUT, -1)

    def block(piece: Column, depth: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, rf"^{_BEGIN}<([a-zA-Z][a-zA-Z0-9]*)", 1))
        size = F.length(_plain(F.replace(F.replace(piece, F.lit(_BEGIN), F.lit("")), F.lit(_END), F.lit(""))))
        return F.struct(tag.alias("tag"), _text(piece, bare_names).alias("text"), size.alias("size"), depth.alias("depth"))

    def placed(b: Column, k: Column) -> Column:
        score = F.length(b["text"]) / F.when(b["size"] > 0, b["size"])
        return F.struct(k.cast("int").alias("pos"), b["tag"].alias("tag"), b["text"].alias("text"), score.alias("score"), b["depth"].alias("depth"))

    made = let(cut, lambda pieces: F.zip_with(pieces, _depths(pieces), block))
    kept = F.filter(F.transform(made, placed), lambda b: (b["text"] != "") & (b["score"] >= threshold))
    return pages.select("page_id", F.md5(F.col("html").cast("binary")).alias("version"), F.coalesce(kept, F.array().cast(BLOCK_TYPE)).cast(BLOCK_TYPE).alias("blocks"))


def page_regions(pages: DataFrame, threshold: float = 0.3, bare_names: bool = True) -> DataFrame:
    """(page_id, pos, tag, text, score, depth) of every region with text and a score of at least ``threshold``.

    The score is the share of visible characters among all characters of the
    region, ``depth`` the number of nesting blocks around its begin.  One narrow
    pass; nothing is shuffled.
    """
    # a plain explode would put a filter on the list's size below, and so make the list twice
    exploded = page_blocks(pages, threshold, bare_names).select("page_id", F.explode_outer("blocks").alias("b"))
    return exploded.where("b is not null").select("page_id", "b.*")


def _escaped(c):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


RESULT_TYPE = "array<struct<pos:int,tag:string,text:string,score:double>>"


def parse_outcome(requests: DataFrame, pages: DataFrame, threshold: float = 0.3, folder: str | None = None, bare_names: bool = True) -> DataFrame:
    """(request_id, page_id, ok, n_regions, markdown, html, results, output_dir, message), one row per request.

    ``requests`` are (request_id, page_id).  A request without a page, or with an
    unknown one, is not an error: ok is false, the outputs are empty, and the
    message says why.  ``results`` are the regions (pos, tag, text, score);
    ``output_dir`` is where the outputs of an accepted request go: ``folder``, and
    null where there is none, or where the request failed.
    """
    # a page's regions are one value all the way, so a page crosses the network once
    known = page_blocks(pages, threshold, bare_names).groupBy("page_id").agg(F.min_by("blocks", F.coalesce("version", F.lit(""))).alias("blocks"), F.lit(True).alias("found"))
    joined = requests.select("request_id", "page_id").join(known, "page_id", "left")
    blocks = F.coalesce("blocks", F.array().cast(BLOCK_TYPE))
    markdown = F.array_join(F.transform(blocks, lambda b: F.concat(F.when(b["tag"] == "h1", "# ").when(b["tag"] == "li", "- ").otherwise(""), b["text"])), "\n\n")
    name = lambda b: F.when(b["tag"] == "", "p").otherwise(b["tag"])
    html = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit("<"), name(b), F.lit(">"), _escaped(b["text"]), F.lit("</"), name(b), F.lit(">"))), "\n")
    ok = F.coalesce("found", F.lit(False))
    results = F.transform(blocks, lambda b: F.struct(b["pos"].alias("pos"), b["tag"].alias("tag"), b["text"].alias("text"), b["score"].alias("score"))).cast(RESULT_TYPE)
    message = F.when(F.col("page_id").isNull(), F.lit("No input was given.")).when(~ok, F.concat(F.lit("Input not found: "), F.col("page_id").cast("string")))
    message = message.otherwise(F.concat(F.lit("Parsed "), F.size(blocks).cast("string"), F.lit(" regions.")))
    return joined.select("request_id", "page_id", ok.alias("ok"), F.size(blocks).alias("n_regions"), markdown.alias("markdown"), html.alias("html"), results.alias("results"), F.when(ok, F.lit(folder)).alias("output_dir"), message.alias("message"))
