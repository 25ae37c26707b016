"""Spelling variants: words one edit apart, found in sorted rotations.

A word of L characters, ended by a marker, has L + 1 rotations (a permuterm
index).  Leave a rotation's last character out and what is left is a prefix:
the words that differ in that one character alone share it, and so does the
whole rotation of the word that lacks it.  So each word gives

* for each of its characters the prefix that skips it ("gap"), and
* each of its rotations as it is ("whole"),

all of them are sorted, and every run of equal prefixes is scanned once: gaps of
one run are replacements of each other, and a whole one is a deletion of the gaps
beside it.  Of a run of equal characters only the first counts for deletions, so
each pair of words meets exactly once.  A run holds one whole rotation and a
gap for each letter of the alphabet at most; of it only counts and best neighbours
leave, never pairs.

Rotations of more than ``LONG`` characters are known by SHA-256, so that a word of
thousands of letters costs its square in hashing, but not in memory or shuffle.
Words are numbered in code-point order, and the shuffle carries numbers.

Defined results for odd input: a null or empty text has no words; a null
``doc_id`` counts as empty text where slips are drawn; rows that repeat count each;
no word of enough length and number gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spill import saved
from tessera.llm.worker import forget

#: Letters, as the words are cut.
RUN = "[a-zÀ-ÿ]+"
#: Ends a word in its rotations; no letter.
MARK = "$"
#: Characters of a rotation that is sorted as it is.
LONG = 64

_UPPER, _LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))


def slipped_words(docs: DataFrame, every: int) -> DataFrame:
    """(word) for each run of letters of the whole texts; one in ``every`` lacks a letter.

    The hash crc32 of "<doc_id>:<run>" says which runs slip, and which letter goes.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.expr("cast(h % length(run) as int)")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, slipped).otherwise(F.col("run")).alias("word"))


def rotations(vocabulary: DataFrame) -> DataFrame:
    """(key, whole, first, n, id): a row for each skipped character and each whole rotation of each word.

    ``first`` tells the first of a run of equal characters.
    """
    size = F.length("word")
    rows = vocabulary.select("id", "word", "n", F.explode(F.sequence(F.lit(0), 2 * size)).alias("i"))
    whole = F.col("i") >= size
    at = F.when(whole, F.col("i") - size).otherwise(F.col("i"))  # characters before the cut or the gap
    behind = F.substring("word", at + F.when(whole, 1).otherwise(2), size)
    key = F.concat(behind, F.lit(MARK), F.substring("word", F.lit(1), at))
    first = (at == 0) | (F.substring("word", at + 1, F.lit(1)) != F.substring("word", at, F.lit(1)))
    return rows.select(F.when(F.length(key) > LONG, F.sha2(key.cast("binary"), 256)).otherwise(key).alias("key"), whole.alias("whole"), first.alias("first"), "n", "id")


def _scan(batches):
    """(id, n_near, best_n, best_id) of the words in each run of equal keys; rows arrive sorted by key, n from high to low, id."""
    forget()

    def neighbours(rows: pa.Table):
        n_rows = rows.num_rows
        key = rows.column("key").combine_chunks()
        new = np.ones(n_rows, bool)
        new[1:] = np.asarray(pa.compute.not_equal(key[1:], key[:-1]))
        run = np.cumsum(new) - 1
        shared = np.bincount(run)[run] > 1
        rows, run = rows.filter(pa.array(shared)), run[shared]
        if not rows.num_rows:
            return None
        whole, first = (rows.column(c).to_numpy().astype(bool) for c in ("whole", "first"))
        n, ids = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "id"))
        run = np.unique(run, return_inverse=True)[1]
        runs = int(run[-1]) + 1

        def ranked(chosen: np.ndarray, rank: int) -> np.ndarray:
            """The row of this rank among the chosen of each run, or -1."""
            at = np.flatnonzero(chosen)
            begin = np.searchsorted(run[at], np.arange(runs))
            stop = np.searchsorted(run[at], np.arange(runs), "right")
            return np.where(begin + rank < stop, at[np.minimum(begin + rank, max(len(at) - 1, 0))], -1) if len(at) else np.full(runs, -1)

        gaps = np.bincount(run, ~whole, runs).astype(np.int64)
        shorter, best, second = ranked(whole, 0), ranked(~whole, 0), ranked(~whole, 1)
        longer, longest = np.bincount(run, ~whole & first, runs).astype(np.int64), ranked(~whole & first, 0)
        row = np.arange(len(run))
        rival = np.where(best[run] == row, second[run], best[run])
        count = np.where(whole, longer[run], gaps[run] - 1)
        rival = np.where(whole, longest[run], rival)
        # a gap whose character can be taken out has the shorter word as a neighbour too
        met = ~whole & first & (shorter[run] >= 0)
        count = count + met
        word = shorter[run]
        better = met & ((rival < 0) | (n[word] > n[rival]) | ((n[word] == n[rival]) & (ids[word] < ids[rival])))
        rival = np.where(better, word, rival)
        some = count > 0
        return pa.record_batch([pa.array(x[some]) for x in (ids, count, n[rival], ids[rival])], names=["id", "n_near", "best_n", "best_id"])

    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = rows.column("key")
        # the last run may go on in the next batch
        other = np.flatnonzero(np.asarray(pa.compute.not_equal(key, key[-1])))
        edge = int(other[-1]) + 1 if len(other) else 0
        if edge and (out := neighbours(rows.slice(0, edge))) is not None:
            yield out
        rest = rows.slice(edge).combine_chunks()
    if rest is not None and (out := neighbours(rest)) is not None:
        yield out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of every word of ``vocabulary`` (id, word, n) that has a near one."""
    sorted_rows = rotations(vocabulary).repartition("key").sortWithinPartitions("key", F.desc("n"), "id")
    found = sorted_rows.mapInArrow(_scan, "id bigint, n_near bigint, best_n bigint, best_id bigint")
    best = F.max_by(F.struct("best_n", "best_id"), F.struct("best_n", -F.col("best_id")))
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("id", "n_near", "best.*")


def last_forms(steps: DataFrame) -> DataFrame:
    """(id, root) of each word of ``steps`` (id, up), following steps to their end.

    Numbers grow along a chain at least twofold, so it is short; each
    round doubles the stretch that is known, and a saved table cuts lineage.
    """
    known = saved(steps.select("id", F.col("up").alias("root")), "steps")
    while True:
        ahead = known.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        further = saved(known.join(ahead, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "steps")
        known = further.drop("moved")
        if not further.where("moved").limit(1).count():
            return known


def spelling_variants(words: DataFrame, least_chars: int = 5, least_count: int = 3, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words`` that is long and frequent enough.

    ``form`` is the near word of largest number, if that is at least ``factor`` times the word's own.
    """
    counts = words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    # ranges of words follow each other, so numbers do too
    vocabulary = saved(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    near = saved(near_words(vocabulary), "near-words")
    steps = vocabulary.join(near, "id").where(F.col("best_n") >= factor * F.col("n")).select("id", F.col("best_id").alias("up"))
    roots = last_forms(steps)
    named = vocabulary.select("id", "word")
    formed = near.join(vocabulary.select("id", "n"), "id").where(F.col("best_n") >= factor * F.col("n")).select("id", F.col("best_id").alias("form_id"), F.col("best_n").alias("form_n"))
    formed = formed.join(roots, "id").join(named.select(F.col("id").alias("form_id"), F.col("word").alias("form")), "form_id").join(named.select(F.col("id").alias("root"), F.col("word").alias("last")), "root")
    out = vocabulary.join(near.select("id", "n_near"), "id", "left").join(formed.select("id", "form", "form_n", "last"), "id", "left")
    return out.select("word", "form", F.coalesce("last", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
