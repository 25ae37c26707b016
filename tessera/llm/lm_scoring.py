"""Cross-entropy difference: how much more a text looks like the target than like all.

Two word n-gram models (``wordlm``), one of the target documents and one of all
documents (the background), share vocabulary, histories, order and smoothing,
and are counted in one pass; every pair is counted and the table grows with the
corpus.  The tables that the model is made of are deleted once used.  A document's score is the mean over its words of background minus
target log probability, so lower means closer to the target.

The target is ``labels.quality = 1``.  Rows whose crc32(doc_id) mod 5 is 0 are held
out of it, which is what the held-out accuracy test uses.

Defined results for odd input: a null or empty text has no tokens and score
0; a document without a label is background only; a null ``doc_id`` keeps its
row and is background only; repeated rows have a result each; an empty
table gives no rows, an empty target a model without counts; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spill import bounded_broadcast, saved, scratch, settled
from tessera.llm.wordlm import frequent_words, pair_counts, pair_model, text_log_probs, word_counts

#: Ids of target documents that are broadcast at most (8 MB); more are joined by a shuffle.
MAX_TARGET_IDS = 1_000_000

def held_out(doc_id: str = "doc_id"):
    """True for the rows that no model may learn a label from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents whose label puts them into the target."""
    return labels.where((F.col("quality") == 1) & ~held_out()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(True).alias("in_target")).distinct()


def cross_entropy_difference(docs: DataFrame, target: DataFrame, n_histories: int | None = None, **knobs) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row of ``docs``.

    ``target`` has the distinct ``doc_id`` of the target documents and ``in_target``.
    Every word is a history of its own; ``n_histories`` keeps only so many frequent ones apart.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.join(bounded_broadcast(saved(target, "target-ids"), MAX_TARGET_IDS), "doc_id", "left").select("row", "doc_id", "text", F.coalesce("in_target", F.lit(False)).alias("in_target"))
    known = None if n_histories is None else frequent_words(word_counts(docs), n_histories)
    spark = docs.sparkSession
    with scratch(spark) as kept:
        with scratch(spark) as read:  # the counts go before the model is joined
            counts = saved(pair_counts(marked, known, ["in_target"]), "pair-counts")
            settled(spark)
            rows, totals = pair_model(counts, **knobs)
            read(rows)
        settled(spark)
        model = kept(saved(rows, "pair-model"))
    settled(spark)
    size = F.greatest(F.col("n_tokens"), F.lit(1))
    return text_log_probs(marked, model, totals, known, ["in_target"], **knobs).select("doc_id", "n_tokens", (-F.col("p1") / size).alias("target_loss"), (-F.col("p0") / size).alias("background_loss"), ((F.col("p0") - F.col("p1")) / size).alias("score"))
