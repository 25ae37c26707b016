"""Line dedup by a log-template tree, in DataFrame functions only.

Lines are parsed by a tree of fixed depth: the number of tokens, then the
leading ``DEPTH`` tokens, where a token with a digit is a variable field
``<*>``.  Beside the path of constant leading tokens a line has one path for each
of them as a field.  Templates are found without any order of arrival:

* the line itself;
* the leaf's majority: at each position the token that more than half of the
  leaf's different lines have there; it covers lines that share at least
  ``SIMILARITY`` of their tokens with it;
* skeletons: a token is held if more than half of those lines of the leaf that
  have the same token before it (or after it) at that place have it too, two at
  least; all others are fields, and lines of one skeleton are a template if the
  fields are at most ``1 - SIMILARITY`` of the tokens, wherever they are;
* lines that differ in one field only: for every window of ``1 - SIMILARITY`` of
  the tokens (one at least) behind the leading ones, in steps of half a window, the
  lines that are equal outside that window are one template; so are lines of three
  tokens or more that are equal but for one leading token.

A template needs a constant token: columns of figures are no template.
Templates found in at least ``MIN_DOCS`` documents are recurring, and their lines
are dropped from every document.  The fewer constant tokens a template of several
lines has, the more often it must be found: its lines' documents times its
constant tokens are at least ``MIN_DOCS * EVIDENCE``, so that three sentences that
share four words stay.  With ``long_tokens``, templates of that many
tokens or more recur from ``LONG_DOCS`` documents on; below ``MIN_DOCS`` the document
of least ``doc_id`` keeps its lines.

Texts are normalised, masked and cut into lines once; a line is split into tokens
only if its leaf holds different lines of different documents.  Counts are summed
before they are shuffled; a very common line is counted by (line, document) and
never gathered.  Joins by leaf are left to adaptive execution to split.  Lines are
known by 128 bits, documents by 128 where lines are cut and by 64 where they are
counted, templates by 64.  A null ``doc_id`` comes before all others.

Defined results for odd input: a null text stays null and has no lines; lines
without tokens, or with variable fields only, are never dropped; a line counts
once per document; rows that repeat both ``doc_id`` and text count as one
document and are treated alike; an empty table gives no rows; extra columns
pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spill import bounded_broadcast, noted, removed, saved

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 3
LONG_DOCS = 2
#: Constant tokens from which on ``MIN_DOCS`` documents are evidence enough for a template of several lines.
EVIDENCE = 10
#: Lines of fewer tokens have no field but tokens with digits.
MIN_TOKENS = 3
#: Leaf keys that are broadcast to pick the lines to look into, majority tokens, and recurring lines
#: to drop (some 65 bytes a row as Spark hashes them, 26 MB); more are joined by a shuffle.
MAX_LEAVES = 400_000

_FIELD = "<*>"
_LINE = ["leaf", "a", "b"]
_TEMPLATE = ["kind", "t"]


def _doc_key():
    """A document's 128 bits."""
    return F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit("document"), "doc_id", "text").alias("d2")


def parsed_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, d1, d2, pos, line, n, leaf, a, b, fixed, w1, w2, ...) of every line that has a constant token.

    ``line`` has one blank between tokens and ``<*>`` for each token with a digit; ``fixed`` counts the
    other tokens; ``w1`` is the line on the path where its first token is a field, and so on.
    """
    blank, none, text = F.lit(" "), F.lit(""), F.col("text")
    odd = reduce(lambda x, y: x | y, (text.contains(c) for c in ("  ", "\t", "\r", "\x0b", "\x0c")))
    plain = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")).otherwise(text)
    # regular expressions only where they change something: inside the generator, each line is masked once
    mask = lambda x: F.trim(F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", _FIELD)).otherwise(x))
    lines = docs.select("doc_id", *_doc_key(), F.posexplode(F.transform(F.split(plain, "\n", -1), mask)).alias("pos", "line"))
    line = F.col("line")
    fixed = F.when(line.contains(_FIELD), F.replace(F.replace(line, F.lit(_FIELD), none), blank, none) != "").otherwise(line != "")
    lines = lines.where(fixed).withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", blank, none)) + 1)
    lead = F.substring_index("line", " ", depth)
    known = lines.select("*", F.xxhash64("n", lead).alias("leaf"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), F.split(lead, " ", -1).alias("lead"), F.xxhash64(F.expr("substr(line, length(%s) + 1)" % f"substring_index(line, ' ', {depth})")).alias("tail"))
    own = (F.get("lead", F.lit(i)) for i in range(depth))
    paths = [F.when((F.col("n") >= MIN_TOKENS) & (x != _FIELD), F.xxhash64(F.lit(i), "n", *(F.get("lead", F.lit(j)) for j in range(depth) if j != i), "tail")).alias(f"w{i + 1}") for i, x in enumerate(own)]
    return known.select(*lines.columns, *_LINE, _fixed(line, F.col("n")).alias("fixed"), *paths)


def _fixed(text, n):
    """Tokens without a digit among the ``n`` of a masked text."""
    return (n - (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(_FIELD), F.lit("")))) / len(_FIELD)).cast("int")


def _majority(lines: DataFrame, similarity: float) -> DataFrame:
    """Members (kind, t, leaf, a, b, fixed) of the templates that are their leaf's majority."""
    placed = lines.select(*_LINE, "n", F.posexplode(F.split("line", " ", -1)).alias("pos", "token"))
    counts = placed.groupBy("leaf", "pos", "token").agg(F.count("*").alias("c"))
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("lines"))
    kept = saved(counts.join(sizes, "leaf").where("2 * c > lines").select("leaf", "pos", "token"), "majorities")
    constant = kept.where(F.col("token") != _FIELD).groupBy("leaf").agg(F.count("*").cast("int").alias("fixed"))
    alike = placed.join(bounded_broadcast(kept, MAX_LEAVES), ["leaf", "pos", "token"]).groupBy(*_LINE).agg(F.count("*").alias("same"), F.count(F.when(F.col("token") != _FIELD, 1)).alias("own"), F.first("n").alias("n"))
    covered = alike.where((F.col("same") >= F.lit(similarity) * F.col("n") - 1e-9) & (F.col("own") > 0))
    return covered.join(constant, "leaf").select(F.lit(0).alias("kind"), F.col("leaf").alias("t"), *_LINE, "fixed")


def _skeletons(lines: DataFrame, similarity: float) -> DataFrame:
    """Members of skeletons: tokens that most lines with the same neighbour have are held, all others are fields."""
    wide = lines.where(F.floor(F.lit(1 - similarity + 1e-9) * F.col("n")) > 1)
    # what two of three lines have is their leaf's majority, so smaller leaves have no other templates
    large = lines.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 3").select("leaf")
    wide = wide.join(bounded_broadcast(saved(large, "large-leaves"), MAX_LEAVES), "leaf", "left_semi")
    tokens = F.split("line", " ", -1)
    # a pair stands at the place of its second token
    pair = F.expr("transform(sequence(1, n - 1), i -> struct(i AS pos, x[i - 1] AS before, x[i] AS token))")
    pairs = wide.select(*_LINE, "n", tokens.alias("x")).select(*_LINE, F.explode(pair).alias("p")).select(*_LINE, "p.*")
    counts = saved(pairs.groupBy("leaf", "pos", "before", "token").agg(F.count("*").alias("c")), "line-pairs")
    context = [counts.groupBy("leaf", "pos", side).agg(F.sum("c").alias(f"{side}_lines")) for side in ("before", "token")]
    held = counts.where("c > 1").join(context[0], ["leaf", "pos", "before"]).join(context[1], ["leaf", "pos", "token"])
    places = F.array_compact(F.array(F.when(F.expr("2 * c > before_lines"), F.col("pos")), F.when(F.expr("2 * c > token_lines"), F.col("pos") - 1)))
    held = saved(held.select("leaf", "pos", "before", "token", places.alias("held")).where(F.size("held") > 0), "held-tokens")
    own = pairs.join(bounded_broadcast(held, MAX_LEAVES), ["leaf", "pos", "before", "token"]).groupBy(*_LINE).agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    own = own.join(wide.select(*_LINE, "line", "n"), _LINE)
    fields = F.col("n") - F.size("held")
    own = own.where((fields > 0) & (fields <= F.lit(1 - similarity + 1e-9) * F.col("n")))
    kept = own.select(*_LINE, "n", F.transform(tokens, lambda x, i: F.when(F.array_contains("held", i), x).otherwise(_FIELD)).alias("x"))
    fixed = F.size(F.filter("x", lambda x: x != _FIELD))
    return kept.select(F.lit(1).alias("kind"), F.xxhash64("n", F.array_join("x", " ")).alias("t"), *_LINE, fixed.alias("fixed")).where("fixed > 0")


def _windows(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Members of what is left of lines without one window behind the leading tokens; only templates of two lines or more."""
    size = F.greatest(F.lit(1), F.floor(F.lit(1 - similarity + 1e-9) * F.col("n")).cast("int"))
    wide = lines.select(*_LINE, "line", "n", size.alias("m")).where(F.col("n") >= max(MIN_TOKENS, depth + 1))
    last = F.col("n") - F.col("m") + 1
    starts = F.array_distinct(F.concat(F.sequence(F.lit(depth + 1), last, F.greatest(F.lit(1), F.expr("m div 2"))), F.array(last)))
    cut = wide.where(last > depth).select(*_LINE, "line", "n", "m", F.explode(starts).alias("s"))
    left = F.expr("substring_index(line, ' ', s - 1)")
    right = F.expr("CASE WHEN n - s - m + 1 > 0 THEN substring_index(line, ' ', -(n - s - m + 1)) ELSE '' END")
    cut = cut.select(*_LINE, "n", "m", "s", left.alias("left"), right.alias("right"))
    keyed = cut.select(F.lit(2).alias("kind"), F.xxhash64("leaf", "s", "left", "right").alias("t"), *_LINE, _fixed(F.concat("left", "right"), F.col("n") - F.col("m")).alias("fixed"))
    keyed = saved(keyed.where("fixed > 0"), "line-windows")
    shared = keyed.groupBy(*_TEMPLATE).agg(F.count("*").alias("c")).where("c > 1").select(*_TEMPLATE)
    return keyed.join(saved(shared, "shared-windows"), _TEMPLATE).select(*_TEMPLATE, *_LINE, "fixed")


def _leading(rows: DataFrame, depth: int) -> DataFrame:
    """Members of the paths where one leading token is a field; only templates of two lines or more."""
    paths = F.array(*(f"w{i + 1}" for i in range(depth)))
    keyed = rows.where("fixed > 1").select(F.explode(paths).alias("t"), *_LINE, (F.col("fixed") - 1).alias("fixed")).where("t IS NOT NULL")
    shared = saved(keyed.groupBy("t").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("t"), "shared-paths")
    members = keyed.join(bounded_broadcast(shared, MAX_LEAVES), "t").select(F.lit(3).alias("kind"), "t", *_LINE, "fixed")
    return members.distinct()


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, long_tokens: int | None = None) -> DataFrame:
    """(d1, d2, drop): for each document with recurring lines, their sorted positions."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id") if dict(docs.dtypes)["doc_id"] == "void" else "doc_id", "text")
    is_long = F.lit(False) if long_tokens is None else F.col("n") >= long_tokens
    paths = ["fixed", *(f"w{i + 1}" for i in range(depth))]
    rows = saved(parsed_lines(docs, depth).select("doc_id", "d1", "d2", "pos", *_LINE, is_long.alias("long"), "line", "n", *paths), "line-keys")
    least = F.when(F.col("long"), min(LONG_DOCS, min_docs)).otherwise(min_docs)
    once = rows.groupBy(*_LINE, "long", "d1").agg(F.min("doc_id").alias("doc_id"))
    lines = once.groupBy(*_LINE, "long").agg(F.count("*").alias("docs"), F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.min(F.struct("doc_id", "d1")).alias("keep"))
    lines = saved(lines, "line-documents")
    leaves = lines.groupBy("leaf", "long").agg(F.count("*").alias("lines"), F.sum("docs").alias("docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = saved(leaves.where((F.col("lines") > 1) & (F.col("lo") != F.col("hi")) & (F.col("docs") >= least)).select("leaf").distinct(), "mixed-leaves")
    scratch: list[str] = []
    with noted(scratch):
        inside = rows.select(*_LINE, "line", "n").join(bounded_broadcast(mixed, MAX_LEAVES), "leaf", "left_semi").groupBy(*_LINE).agg(F.first("line").alias("line"), F.first("n").alias("n"))
        inside = saved(inside, "leaf-lines")
        members = _majority(inside, similarity).union(_skeletons(inside, similarity)).union(_windows(inside, similarity, depth)).union(_leading(rows, depth))
    members = saved(members.join(lines, _LINE), "template-lines")
    removed(docs.sparkSession, scratch, members)
    # a line in fewer than three documents has no others than its first and last, so lines are not gathered
    few = members.where(F.col("docs") < min_docs)
    own = few.select(*_TEMPLATE, F.explode(F.array("lo", "hi")).alias("d1"))
    if min_docs > 3:
        own = few.select(*_TEMPLATE, *_LINE).join(rows.select(*_LINE, "d1"), _LINE).select(*_TEMPLATE, "d1")
    several = own.distinct().groupBy(*_TEMPLATE).agg(F.count("*").alias("all"))
    templates = members.groupBy(*_TEMPLATE, "long").agg(F.max("docs").alias("most"), F.min("keep").alias("keep"), (F.sum("docs") * F.max("fixed")).alias("evidence"))
    templates = templates.join(several, _TEMPLATE, "left").where(F.col("evidence") >= min_docs * EVIDENCE)
    templates = saved(templates.select(*_TEMPLATE, "long", "keep", F.greatest("most", F.coalesce("all", F.lit(0))).alias("docs")).where(F.col("docs") >= least), "recurring-templates")

    everywhere = lines.where(F.col("docs") >= min_docs).select(*_LINE)
    recurring = members.select(*_TEMPLATE, *_LINE).join(templates.withColumnRenamed("docs", "all"), _TEMPLATE)
    everywhere = everywhere.union(recurring.where(F.col("all") >= min_docs).select(*_LINE)).distinct()
    found = rows.join(bounded_broadcast(saved(everywhere, "recurring-lines"), MAX_LEAVES), _LINE, "left_semi").select("d1", "d2", "pos")
    if long_tokens is not None:
        # below min_docs, the document of least id keeps its lines
        below = lines.where(F.col("long") & (F.col("docs") >= LONG_DOCS) & (F.col("docs") < min_docs)).select(*_LINE, "keep")
        below = below.union(recurring.where(F.col("all") < min_docs).select(*_LINE, "keep"))
        twice = rows.where("long").join(bounded_broadcast(saved(below, "long-lines"), MAX_LEAVES), _LINE).where(F.col("keep.d1") != F.col("d1")).select("d1", "d2", "pos")
        found = found.union(twice)
    return found.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def without_recurring_lines(docs: DataFrame, **knobs) -> DataFrame:
    """The rows of ``docs`` with recurring lines cut out of ``text``, plus _n_lines and _n_dropped.

    Columns of ``docs`` that already have one of these two names are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped")
    drop = dropped_lines(docs, **knobs)
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r"), *_doc_key())
    joined = keyed.join(drop, ["d1", "d2"], "left")
    lines = F.split("r.text", "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("r.text")).otherwise(kept)
    n_lines, n_dropped = (F.when(c.isNull(), 0).otherwise(F.size(c)).cast("long") for c in (lines, F.col("drop")))
    return joined.select(F.col("r").withField("text", text).alias("r"), n_lines.alias("_n_lines"), n_dropped.alias("_n_dropped")).select("r.*", "_n_lines", "_n_dropped")
