"""Near-duplicate documents: fast similarity sketches, banding, exact links.

Sketch.  Each document's set of word shingles is thrown into ``COORDS`` bins in
rounds; a later round fills only bins that are still empty, and from round
``COORDS`` on every element goes to one prescribed bin, so each coordinate is
filled after at most ``2 * COORDS`` rounds.  (This is the published "fast
similarity sketching"; the share of equal coordinates estimates Jaccard
similarity with Chernoff-type bounds.)

Candidates.  Documents of the same sequence of words (known by 128 bits of BLAKE2
over the words themselves, not over hashes of them) are one class, which
takes part in links once.  Bands of coordinates are hashed, with as many rows as
keep the probability that a pair at the threshold shares no band below ``MISS``
(``band_rows``: 25 bands of 5 at 0.85, 32 of 4 at 0.8, 64 of 2 at 0.5).

Links.  Nothing emits all pairs of a bucket:

1. each bucket's least class is compared with every other one on full shingle
   sets (64 bits a shingle, under a key that is drawn for each call), and the links found are merged into components;
2. pairs of one bucket that are still in different components are compared
   inside tasks, in blocks of bounded rows and bytes: on sketches first (six
   standard deviations of slack), then on full shingle sets; only links that
   full sets confirm are passed on or merged.

Pairs that are in one component already need no test, which is what makes
groups of thousands of copies cheap without any cap.

Rows, not ids, are judged: a repeated ``doc_id`` whose texts differ takes part with
each of them.

Defined results for odd input: a null, empty or blank text has no shingles and
is linked with nothing; a text of fewer words than a shingle is one shingle;
rows with a null ``doc_id`` take part, and a component's id is its least ``doc_id``
that is not null; rows that repeat a ``doc_id`` have a result row each; an empty
table gives no rows; extra columns are ignored, or pass through ``one_of_each``
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.spill import bounded_broadcast, checkpointed, saved
from tessera.llm.textvec import Words, mix, secret_key, signed, slices
from tessera.llm.worker import forget

COORDS = 128
#: A pair at exactly the threshold shares no band with at most this probability.
MISS = 1e-6
#: Rows and bytes of shingle sets of one side of a block (about; one set alone may be larger).
BLOCK = 1024
BLOCK_BYTES = 32 << 20
#: Texts that are fetched for comparison, whose keys (some 65 bytes each as Spark hashes them) are broadcast; more are joined by a shuffle.
MAX_WANTED = 300_000
#: Rows that go, whose numbers are broadcast to cut them out (8 MB); more are joined by a shuffle.
MAX_DROPPED = 1_000_000

_EMPTY = np.uint64(2**64 - 1)
_SHIFT = np.uint64(64 - COORDS.bit_length() + 1)
_FOLD = np.uint64(COORDS.bit_length() - 1)


def similarity_sketch(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sketches (n, COORDS) of the n sets of 64-bit hashes that ``offsets`` cut from ``x``.

    Repeated elements change nothing; an empty set's coordinates stay unset.
    """
    n = len(offsets) - 1
    cells = np.full(n * COORDS, _EMPTY)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for i in range(2 * COORDS):
        if not len(x):
            break
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = owner * COORDS + ((h >> _SHIFT).astype(np.int64) if i < COORDS else i - COORDS)
        free = cells[at] == _EMPTY
        np.minimum.at(cells, at[free], ((h << _FOLD) | (h >> _SHIFT))[free])
        open_ = (cells.reshape(n, COORDS) == _EMPTY).any(axis=1)[owner]
        if not open_.all():
            x, owner = x[open_], owner[open_]
    return cells.reshape(n, COORDS)


def band_rows(num: int, den: int) -> int:
    """The most coordinates a band may have; fewer find more pairs and more that are none."""
    return next((r for r in range(8, 1, -1) if (1 - (num / den) ** r) ** (COORDS // r) <= MISS), 1)


def band_keys(cells: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys (n, COORDS // rows) of the bands of each sketch."""
    bands = COORDS // rows
    with np.errstate(over="ignore"):
        used = mix(cells[:, : bands * rows]).reshape(-1, bands, rows)
        weight = np.array([2 * (k * 0x9E3779B97F4A7C15 % 2**63) + 1 for k in range(1, rows + 1)], np.uint64)
        return mix((used * weight).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _sets(data, offsets, shingle, lower, key):
    """Sorted distinct shingle hashes of each text, and 128 bits of its sequence of words in two columns."""
    words = Words(data, offsets, lower, key)
    found, off = words.shingles(shingle, short=True)
    sets = [np.unique(found[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    line, at = words.joined()
    digests = b"".join(hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    return sets, np.frombuffer(digests, "<i8").reshape(-1, 2)


SKETCH_SCHEMA = "row bigint, doc_id bigint, th bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"


def _sketcher(shingle: int, lower: bool, rows_of_band: int, key: int):
    def sketch(batches):
        forget()
        for batch in batches:
            for rows, data, offsets in slices(batch):
                sets, digest = _sets(data, offsets, shingle, lower, key)
                size = np.array([len(s) for s in sets], np.int64)
                cells = similarity_sketch(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
                keys = band_keys(cells, rows_of_band)
                bits = (mix(cells) & np.uint64(0xFFFF)).astype("<u2")
                full = size > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * keys.shape[1])]), pa.int32()), pa.array(signed(keys[full].ravel())))
                yield pa.record_batch(
                    [*rows.columns[:3], pa.array(size), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), lists, pa.array([b.tobytes() for b in bits], pa.binary())],
                    names=["row", "doc_id", "th", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return sketch


def _full_sets(shingle: int, lower: bool, key: int):
    def build(batches):
        for batch in batches:
            for _, data, offsets in slices(batch):
                sets, digest = _sets(data, offsets, shingle, lower, key)
                yield pa.record_batch([pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["d1", "d2", "members"])

    return build


def _confirm(num: int, den: int):
    def confirm(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if den * min(len(s), len(t)) < num * max(len(s), len(t)):
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = den * both >= num * (len(s) + len(t) - both)
            yield pa.record_batch([a, b], names=["a", "b"]).filter(pa.array(keep))

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets reach the similarity num / den."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("members").alias("mb")), "b")
    return left.join(sets.select(F.col("doc").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb").mapInArrow(_confirm(num, den), "a bigint, b bigint")


def _joining_links(num: int, den: int):
    """Links that join the components of a block; rows arrive sorted by block."""
    least = num / den - 6 * (num / den * (1 - num / den) / COORDS) ** 0.5

    def links_of(block: pa.Table):
        doc, root, size, side = (block.column(c).to_numpy().copy() for c in ("doc", "label", "n_shingles", "side"))
        cells = np.frombuffer(b"".join(block.column("sketch").to_pylist()), "<u2").reshape(len(doc), COORDS)
        kind, i, j, band = (block.column(c)[0].as_py() for c in ("kind", "i", "j", "band"))
        earlier = np.array(block.column("bands").combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(len(doc), -1)[:, :band]
        members = [np.frombuffer(m, np.uint64) for m in block.column("members").to_pylist()]
        inner = kind == 1 and i == j
        ones = np.flatnonzero(side == 1)
        zeros = np.flatnonzero(side == 0)
        few, many = (zeros, ones) if len(zeros) <= len(ones) else (ones, zeros)
        for r in range(len(doc)) if inner else few:
            other = np.arange(r + 1, len(doc)) if inner else many
            other = other[(root[other] != root[r]) & (den * np.minimum(size[other], size[r]) >= num * np.maximum(size[other], size[r]))]
            if not len(other):
                continue
            alike = (cells[other] == cells[r]).mean(axis=1)
            # a pair is compared in the first bucket that it shares
            keep = (alike >= least) & ~(earlier[other] == earlier[r]).any(axis=1)
            other = other[keep][np.argsort(-alike[keep], kind="stable")]
            own, at, step = members[r], 0, 8
            while at < len(other):
                part = other[at : at + step]
                at, step = at + step, 256
                part = part[root[part] != root[r]]
                if not len(part):
                    continue
                length = np.array([len(members[k]) for k in part])
                flat = np.concatenate([members[k] for k in part])
                found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(found.astype(np.int64), np.cumsum(length) - length)
                for k, n in zip(part.tolist(), both.tolist(), strict=True):
                    total = int(size[k]) + int(size[r])
                    if den * n >= num * (total - n) and root[k] != root[r]:
                        yield min(doc[k], doc[r]), max(doc[k], doc[r])
                        root[root == root[k]] = root[r]

    def out(block):
        found = list(links_of(block))
        if found:
            yield pa.record_batch([pa.array([int(f[k]) for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def find(batches):
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            table = pa.Table.from_batches(rest)
            name = [table.column(c).to_numpy() for c in ("key", "kind", "i", "j")]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in name])) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield from out(table.slice(a, b - a))
            rest = table.slice(edges[-1]).combine_chunks().to_batches()
        if rest:
            yield from out(pa.Table.from_batches(rest))

    return find


def _crossing_links(buckets: DataFrame, heads: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) that join one bucket's different components.

    In each bucket the classes outside its largest component are compared with
    that component and with each other, in blocks of at most about ``BLOCK`` rows
    and ``BLOCK_BYTES`` bytes a side.
    """
    rows = buckets.where("n > 2").select("key", "band", "doc", "n_shingles").join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("key", "band", "doc", "n_shingles", F.coalesce("component", "doc").alias("label"))
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    shape = parts.groupBy("key").agg(F.max(F.struct("c", "label", "s")).alias("top"), F.sum("c").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k")).where("k > 1")
    sides = lambda n, s: F.ceil(F.greatest(n / BLOCK, 8 * s / BLOCK_BYTES)).cast("int")
    shape = saved(shape.select("key", F.col("top.label").alias("bulk"), sides(F.col("top.c"), F.col("top.s")).alias("gb"), sides(F.col("n") - F.col("top.c"), F.col("s") - F.col("top.s")).alias("gm")), "bucket-shapes")
    mixed = rows.drop("n_shingles").join(shape, "key").join(heads.select("doc", "n_shingles", "sketch", "bands"), "doc").join(sets, "doc")
    core = F.col("label") == F.col("bulk")
    own = F.pmod(F.xxhash64("doc"), F.when(core, F.col("gb")).otherwise(F.col("gm"))).cast("int")

    def blocks(n, make):
        return F.transform(F.sequence(F.lit(0), n - 1), make)

    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    places = F.when(core, blocks(F.col("gm"), lambda j: cell(0, own, j, zero))).otherwise(
        F.concat(blocks(F.col("gb"), lambda i: cell(0, i, own, one)), blocks(F.col("gm"), lambda k: cell(1, F.least(own, k), F.greatest(own, k), (own > k).cast("int"))))
    )
    carried = ["doc", "label", "n_shingles", "sketch", "bands", "members"]
    dealt = mixed.select("key", "band", F.explode(places).alias("p"), *carried).select("key", "band", "p.kind", "p.i", "p.j", "p.side", *carried)
    dealt = dealt.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "doc")
    return dealt.mapInArrow(_joining_links(num, den), "a bigint, b bigint").distinct()


def _numbered(docs: DataFrame, row) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _components(docs: DataFrame, shingle: int, num: int, den: int, lower: bool) -> tuple[DataFrame, DataFrame]:
    """The sketches of the rows of ``docs``, and (d1, d2, doc, component) of each class; ``doc`` numbers classes."""
    key = secret_key()
    base = saved(docs.mapInArrow(_sketcher(shingle, lower, band_rows(num, den), key), SKETCH_SCHEMA), "sketches")
    classes = base.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "th")).alias("pick"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    heads = saved(classes.select(F.monotonically_increasing_id().alias("doc"), "*"), "class-heads")

    banded = heads.select("doc", "n_shingles", F.posexplode("bands").alias("band", "key"))
    pivots = saved(banded.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "pivots")
    buckets = saved(banded.join(pivots, "key"), "buckets")

    stars = checkpointed(buckets.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())
    ids = stars.select(F.col("a").alias("doc")).union(stars.select("b")).distinct()
    wanted = saved(heads.select("doc", "d1", "d2", F.col("pick.doc_id").alias("_id"), F.col("pick.th").alias("_th")).join(ids, "doc", "left_semi"), "compared")
    found = docs.join(bounded_broadcast(wanted.select("_id", "_th"), MAX_WANTED), docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["th"] == F.col("_th")), "left_semi").select("th", "text").mapInArrow(_full_sets(shingle, lower, key), "d1 bigint, d2 bigint, members binary")
    sets = saved(found.join(wanted.select("doc", "d1", "d2"), ["d1", "d2"]).groupBy("doc").agg(F.first("members").alias("members")), "shingle-sets")
    links = checkpointed(confirmed(stars, sets, num, den))
    labels = connected_components(links)
    more = checkpointed(_crossing_links(buckets, heads, sets, labels, num, den))
    # the first round's stars stand for its links
    labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    return base, heads.select("doc", "d1", "d2").join(labels.withColumnRenamed("id", "doc"), "doc", "left").select("d1", "d2", "doc", F.coalesce("component", "doc").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if den * intersection >= num * union of their shingle
    sets; a component's least doc_id is kept.
    """
    base, classes = _components(_numbered(docs, F.monotonically_increasing_id()), shingle, num, den, lower)
    light = base.select("doc_id", "n_shingles", "d1", "d2")
    least = light.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = saved(least.join(classes, ["d1", "d2"]), "named-classes")
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = named.join(ids, "component").select("d1", "d2", "component_id")
    out = light.where("n_shingles > 0").join(found, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """One row of each component (of least doc_id, null last), and all rows without shingles; columns as they were.

    Rows are numbered in a saved copy and judged by number, so of equal rows one
    stays, and texts are not shuffled unless more than ``MAX_DROPPED`` rows go.
    """
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[c] for c in docs.columns)).alias("r")), "numbered-documents")
    base, classes = _components(_numbered(rows.select("row", "r.doc_id", "r.text"), F.col("row")), shingle, num, den, lower)
    placed = saved(base.where("n_shingles > 0").select("row", "doc_id", "d1", "d2").join(classes.select("d1", "d2", "component"), ["d1", "d2"]).select("row", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("rank")), "placed-rows")
    best = saved(placed.groupBy("component").agg(F.min("rank").alias("best")), "kept-rows")
    dropped = saved(placed.select("row").join(best.select(F.col("best.row").alias("row")), "row", "left_anti"), "dropped-rows")
    return rows.join(bounded_broadcast(dropped, MAX_DROPPED), "row", "left_anti").select("r.*")
