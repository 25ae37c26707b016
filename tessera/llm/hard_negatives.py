"""Hard negatives by inner product: STR-packed R-trees searched best first.

Index.  Sort-tile-recursive cuts (label first, then the coordinates of largest
spread) are fitted to a sample of about ``SAMPLE`` rows; every row goes to a tile,
and a tile of more than ``SHARD`` rows is dealt into several shards, so equal
vectors fill no task.  One task packs a shard at a time into an R-tree: again
sort-tile-recursive, leaves of ``LEAF`` rows, inner nodes of ``FANOUT`` children, and
of each node the least and largest label and coordinate.

Search.  Between a vector and a box each coordinate's product lies in an
interval; their sums bound all inner products below a node.  A queue opens the
node of the highest bound first.  A node is left out if its bounds miss the
score window, if its labels cannot fit, or if its upper bound is strictly below the
k-th best score so far (an equal score may still win by a smaller id).  A search
that ran in one shard gives the others that k-th score to begin with, so they
return little.  Queries meet shards by the shard's number, one row for each
pair; trees are never broadcast.

Everything is exact in integers.  Defined results for odd input: rows with a null
id, label or vector, or with a null component, take no part, nor do rows with a
component beyond ``LARGEST``, whose products no 64-bit sum can hold; a shorter
vector counts as filled with zeros, an empty one as the zero vector; rows that
repeat an id are rows of their own, each an anchor if the id is one, and two of
the same score and id are in no set order, which their columns do not show; an
anchor without positives, or a positive without negatives, has no row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.spill import saved
from tessera.llm.worker import forget

#: Rows to which the tiles' cuts are fitted, about.
SAMPLE = 16_384
#: Rows of a shard, about; its R-tree is built and searched by one task at a time.
SHARD = 2048
LEAF = 128
FANOUT = 8
#: Sizes of components that take part: 64 coordinates of it still fit a 64-bit sum of products.
LARGEST = 2**27

_FAR = 2**62


def str_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order of the rows in which each run of ``leaf`` rows is one tile.

    Slabs of equal size along the first column, each cut along the next one.
    """

    def cut(rows: np.ndarray, column: int) -> list[np.ndarray]:
        tiles = -(-len(rows) // leaf)
        if tiles <= 1 or column == points.shape[1]:
            return [rows]
        rows = rows[np.argsort(points[rows, column], kind="stable")]
        slabs = int(np.ceil(tiles ** (1 / (points.shape[1] - column)) - 1e-9))
        size = leaf * -(-tiles // max(slabs, 2))
        return [part for a in range(0, len(rows), size) for part in cut(rows[a : a + size], column + 1)]

    return np.concatenate(cut(np.arange(len(points)), 0)) if len(points) else np.zeros(0, np.int64)


def sort_columns(labels: np.ndarray, vectors: np.ndarray, tiles: int) -> np.ndarray:
    """Label, then as many coordinates of largest spread as ``tiles`` tiles can be cut along."""
    wide = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[: max(1, int(tiles).bit_length())] if len(vectors) else []
    return np.column_stack([labels, *(vectors[:, k] for k in wide)])


class RTree:
    """An R-tree over integer vectors with labels, packed once."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = str_order(sort_columns(labels, vectors, -(-len(ids) // LEAF)), LEAF)
        self.row, self.ids, self.labels, vectors = row[order], ids[order], labels[order], vectors[order]
        # exact in doubles up to 2**53, whose products numpy has the fastest code for
        peak = int(np.abs(vectors).max(initial=0))
        self.exact_to = (2**53) // max(1, peak * max(1, vectors.shape[1]))
        self.vectors = vectors
        self.floats = vectors.astype(np.float64)
        self.levels = []  # leaves first: (low, high, least label, largest label)
        edges = np.arange(0, len(order), LEAF)
        box = tuple(f.reduceat(x, edges) for f, x in ((np.minimum, self.floats), (np.maximum, self.floats), (np.minimum, self.labels), (np.maximum, self.labels)))
        self.levels.append(box)
        while len(self.levels[-1][0]) > FANOUT:
            edges = np.arange(0, len(self.levels[-1][0]), FANOUT)
            self.levels.append(tuple(f.reduceat(x, edges) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum), self.levels[-1], strict=True)))

    def to_bytes(self) -> bytes:
        kind = next(t for t in ("<i2", "<i4", "<i8") if len(self.vectors) == 0 or np.abs(self.vectors).max(initial=0) <= np.iinfo(t).max)
        out = io.BytesIO()
        np.savez(out, row=self.row, ids=self.ids, labels=self.labels, vectors=self.vectors.astype(kind))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> RTree:
        """The packing is a rule, so a tree that is built again from its own order is the same one."""
        held = np.load(io.BytesIO(data))
        return cls(held["row"], held["ids"], held["labels"], held["vectors"].astype(np.int64))

    def _bounds(self, level: int, some: slice, over: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.levels[level][0][some], self.levels[level][1][some]
        return low @ over + high @ under, high @ over + low @ under

    def search(self, vector: np.ndarray, label: int, own: int, windows: list[tuple]) -> list[list[tuple[int, int, int]]]:
        """For each window (k, low, high, same label?, floor) its first k (score, id, row): score from high to low, id from low to high.

        ``floor`` is a score that k rows of other shards reach: lower ones are no use.
        """
        k = [w[0] for w in windows]
        low = np.array([max(w[1], w[4]) for w in windows], np.int64)
        high = np.array([w[2] for w in windows], np.int64)
        same = np.array([w[3] for w in windows])
        found: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        peak = int(np.abs(vector).max(initial=0))
        fast = peak <= self.exact_to
        point = vector.astype(np.float64)
        slack = 0.0 if fast else 2.0**-40  # bounds are rounded then, so they are widened
        over, under = np.maximum(point, 0), np.minimum(point, 0)
        top, count = len(self.levels) - 1, 0
        queue: list[tuple] = []

        def offer(level: int, some: slice) -> None:
            nonlocal count
            least, most = self._bounds(level, some, over, under)
            if slack:
                low_box, high_box = (np.abs(x[some]) for x in self.levels[level][:2])
                width = slack * (np.maximum(low_box, high_box) @ np.abs(point))
                least, most = least - width, most + width
            _, _, first, last = (x[some] for x in self.levels[level])
            fits = np.where(same, ((first <= label) & (label <= last))[:, None], ~((first == label) & (last == label))[:, None])
            open_ = fits & (most[:, None] >= low) & (least[:, None] <= high)
            for j in np.flatnonzero(open_.any(axis=1)):
                count += 1
                heapq.heappush(queue, (-most[j], count, level, some.start + int(j), open_[j]))

        offer(top, slice(0, len(self.levels[top][0])))
        while queue:
            bound, _, level, node, wanted = heapq.heappop(queue)
            wanted = wanted & (-bound >= low)
            if not wanted.any():
                if (-bound < low).all():
                    break  # all that are left have lower bounds
                continue
            if level:
                offer(level - 1, slice(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))))
                continue
            some = slice(node * LEAF, min((node + 1) * LEAF, len(self.ids)))
            score = self.floats[some] @ point if fast else self.vectors[some] @ vector
            mate = self.labels[some] == label
            other = self.row[some] != own
            for w in np.flatnonzero(wanted):
                hit = np.flatnonzero((mate if same[w] else ~mate) & other & (score >= low[w]) & (score <= high[w]))
                if not len(hit):
                    continue
                if len(hit) > k[w]:  # all that reach the k-th score of this leaf
                    hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k[w])[len(hit) - k[w]]]
                at = hit + some.start
                merged = sorted([*found[w], *zip((-score[hit]).astype(np.int64).tolist(), self.ids[at].tolist(), self.row[at].tolist(), strict=True)])
                found[w] = merged[: k[w]]
                if len(found[w]) == k[w]:
                    low[w] = max(low[w], -found[w][-1][0])
        return [[(-s, i, r) for s, i, r in f] for f in found]


def fitted_cuts(points: np.ndarray, tiles: int) -> tuple:
    """Nested cuts (column, values, children) for about ``tiles`` tiles; a leaf is its number.

    The first column is the label: where there are not too many, each is a slab.
    """
    names = iter(range(1 << 30))

    def cut(rows: np.ndarray, column: int, tiles: int):
        if tiles <= 1 or column == points.shape[1] or not len(rows):
            return next(names)
        values = np.sort(points[rows, column])
        if column == 0 and len(set(values.tolist())) <= tiles:
            at = np.unique(values)[1:]
        else:
            slabs = max(2, int(np.ceil(tiles ** (1 / (points.shape[1] - column)) - 1e-9)))
            at = np.unique(values[[len(values) * i // slabs for i in range(1, slabs)]])
        side = np.searchsorted(at, points[rows, column], "right")
        return column, at, [cut(rows[side == s], column + 1, round(tiles * float((side == s).mean()))) for s in range(len(at) + 1)]

    return cut(np.arange(len(points)), 0, tiles)


def tile_of(points: np.ndarray, cuts) -> np.ndarray:
    """The tile of each row."""
    out = np.zeros(len(points), np.int64)

    def place(rows: np.ndarray, node) -> None:
        if not isinstance(node, tuple):
            out[rows] = node
            return
        column, at, children = node
        side = np.searchsorted(at, points[rows, column], "right")
        for s, child in enumerate(children):
            place(rows[side == s], child)

    place(np.arange(len(points)), cuts)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as one matrix, shorter ones filled with zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _tiler(dim: int, wide: list[int], cuts):
    def tile(batches):
        forget()
        for batch in batches:
            vectors = _matrix(batch.column(3), dim)
            points = np.column_stack([batch.column(2).to_numpy(), *(vectors[:, k] for k in wide)])
            yield pa.record_batch([*batch.columns, pa.array(tile_of(points, cuts))], names=["row", "id", "label", "vector", "tile"])

    return tile


def _packer(dim: int):
    """(shard, tree) of each shard; rows arrive sorted by shard."""

    def packed(shard: int, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        row, ids, label = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "id", "label"))
        tree = RTree(row, ids, label, _matrix(t.column("vector").combine_chunks(), dim))
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([tree.to_bytes()], pa.binary())], names=["shard", "tree"])

    def pack(batches):
        shard, parts = None, []
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if parts and key[a] != shard:
                    yield packed(shard, parts)
                    parts = []
                shard = int(key[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield packed(shard, parts)

    return pack


class Index:
    """Shards of R-trees over all rows: ``trees`` (shard, tree) and ``rows`` (row, id, label, vector, shard)."""

    def __init__(self, table: DataFrame, id: str, label: str, vector: str, sample: int = SAMPLE, shard: int = SHARD):
        spark = table.sparkSession
        usable = table.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<bigint>").alias("vector")).where("id is not null and label is not null and vector is not null")
        usable = usable.where(F.forall("vector", lambda x: x.isNotNull() & x.between(-LARGEST, LARGEST)))
        numbered = saved(usable.select(F.monotonically_increasing_id().alias("row"), "*"), "numbered-vectors")
        size = numbered.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
        n, self.dim = size["n"], max(1, size["dim"] or 0)
        drawn = numbered.sample(min(1.0, sample / max(n, 1)), seed=11).select("row", "label", "vector").toArrow().sort_by("row")
        labels = drawn.column("label").to_numpy().astype(np.int64)
        vectors = _matrix(drawn.column("vector").combine_chunks(), self.dim) if len(labels) else np.zeros((0, self.dim), np.int64)
        # no finer than the sample can tell
        tiles = min(-(-n // shard), max(1, len(labels) // 8))
        wide = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[: max(1, int(tiles).bit_length())].tolist() if len(labels) else []
        cuts = fitted_cuts(np.column_stack([labels, *(vectors[:, k] for k in wide)]), tiles)
        tiled = saved(numbered.mapInArrow(_tiler(self.dim, wide, cuts), "row bigint, id bigint, label bigint, vector array<bigint>, tile bigint"), "tiled-vectors")
        # one row a tile, of which there are not more than an eighth of the sample and its labels
        counts = sorted((r["tile"], r["count"]) for r in tiled.groupBy("tile").count().collect())
        spread, self.shards = [], 0
        for name, count in counts:
            parts = -(-count // shard)
            spread.append((name, self.shards, parts))
            self.shards += parts
        places = spark.createDataFrame(spread, "tile bigint, first int, parts int")
        dealt = tiled.join(F.broadcast(places), "tile").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
        self.rows = dealt.select("row", "id", "label", "vector", "shard")
        sorted_rows = dealt.select("shard", "row", "id", "label", "vector").repartition("shard").sortWithinPartitions("shard", "row")
        self.trees = saved(sorted_rows.mapInArrow(_packer(self.dim), "shard int, tree binary"), "shard-trees")

    def _visit(self, queries: DataFrame) -> DataFrame:
        """Results (q, w, score, id, row) of queries (shard, q, label, vector, windows) in their shards."""
        tree = self.trees.select("shard", F.lit(0).alias("kind"), "tree", F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("bigint").alias("label"), F.lit(None).cast("array<bigint>").alias("vector"), F.lit(None).cast(WINDOWS).alias("windows"))
        asked = queries.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "q", "label", "vector", F.col("windows").cast(WINDOWS).alias("windows"))
        met = tree.union(asked).repartition("shard").sortWithinPartitions("shard", "kind", "q")
        return met.mapInArrow(_searcher(self.dim), "q bigint, w bigint, score bigint, id bigint, row bigint")

    def search(self, queries: DataFrame, start: Column) -> DataFrame:
        """The first k rows (q, w, score, id, row, rank) of each window of ``queries`` (q, label, vector, windows).

        ``windows`` are structs (w, k, low, high, same); ``start`` is the shard that a query visits first.
        """
        queries = saved(queries.withColumn("start", start), "asked")
        spec = lambda x, floor: F.struct(x["w"].alias("w"), x["k"].alias("k"), x["low"].alias("low"), x["high"].alias("high"), x["same"].alias("same"), floor.alias("floor"))
        bare = F.transform("windows", lambda x: spec(x, F.lit(-_FAR)))
        first = saved(self._visit(queries.select(F.col("start").alias("shard"), "q", "label", "vector", bare.alias("windows"))), "first-visit")
        # a window whose k rows were all found has a k-th score; at most as many structs as a query has windows
        least = first.groupBy("q", "w").agg(F.count("*").alias("n"), F.min("score").alias("score")).groupBy("q").agg(F.collect_list(F.struct("w", "n", "score")).alias("got"))
        reached = lambda x: F.filter("got", lambda g: (g["w"] == x["w"]) & (g["n"] >= x["k"]))
        known = queries.join(least, "q", "left").withColumn("windows", F.transform("windows", lambda x: spec(x, F.coalesce(F.try_element_at(reached(x), F.lit(1))["score"], F.lit(-_FAR)))))
        others = F.filter(F.sequence(F.lit(0), F.lit(max(self.shards - 1, 0))), lambda s: s != F.col("start"))
        rest = self._visit(known.select(F.explode(others).alias("shard"), "q", "label", "vector", "windows"))
        limits = queries.select("q", F.explode("windows").alias("x")).select("q", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
        order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id", "row")
        most = queries.select(F.explode("windows.k").alias("k")).agg(F.max("k")).first()[0] or 0
        ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        return ranked.join(limits, ["q", "w"]).where("rank <= k").drop("k")


WINDOWS = "array<struct<w:bigint,k:int,low:bigint,high:bigint,same:boolean,floor:bigint>>"


def _searcher(dim: int):
    def visit(batches):
        forget()
        tree = None
        for batch in batches:
            kind = batch.column(1).to_pylist()
            out: list[list[int]] = [[], [], [], [], []]
            asked = [i for i, k in enumerate(kind) if k]
            part = batch.take(pa.array(asked, pa.int32()))
            vectors = _matrix(part.column(5), dim)
            q, label, windows = (part.column(c).to_pylist() for c in (3, 4, 6))
            at = 0
            for i, k in enumerate(kind):
                if not k:
                    tree = RTree.from_bytes(batch.column(2)[i].as_py())
                    continue
                if tree is not None:
                    spec = [(x["k"], x["low"], x["high"], x["same"], x["floor"]) for x in windows[at]]
                    for x, found in zip(windows[at], tree.search(vectors[at], label[at], q[at], spec), strict=True):
                        for score, ident, row in found:
                            for column, value in zip(out, (q[at], x["w"], score, ident, row), strict=True):
                                column.append(value)
                at += 1
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["q", "w", "score", "id", "row"])

    return visit


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id: str = "id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``table`` has whole-number vectors; ``anchor`` is a condition on the column
    ``id``.  An anchor's positives are its first other rows of its label; a
    positive's negatives the first rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's.
    """
    index = Index(table, id, label, vector)
    anchors = index.rows.where(anchor).select(F.col("row").alias("q"), F.col("id").alias("anchor_id"), "label", "vector", "shard")
    window = lambda w, k, lo, hi, same: F.struct(w.cast("bigint").alias("w"), F.lit(k).alias("k"), lo.cast("bigint").alias("low"), hi.cast("bigint").alias("high"), F.lit(same).alias("same"))
    anchors = saved(anchors, "anchors")
    near = index.search(anchors.withColumn("windows", F.array(window(F.lit(0), positives, F.lit(-_FAR), F.lit(_FAR), True))), F.col("shard"))
    near = saved(near.select("q", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    floor_div = lambda c: F.expr(f"(({c}) - pmod({c}, 100)) div 100")
    spans = near.groupBy("q").agg(F.collect_list(window(F.col("w"), negatives, -floor_div(f"-{low} * positive_score"), floor_div(f"{high} * positive_score"), False)).alias("windows"))
    asked = anchors.join(spans, "q")
    far = index.search(asked.select("q", "label", "vector", "windows", "shard"), F.pmod(F.col("shard") + F.lit(index.shards // 2), F.lit(max(1, index.shards))).cast("int"))
    named = anchors.select("q", "anchor_id")
    return (
        far.select("q", F.col("w").cast("int").alias("w"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near.withColumn("w", F.col("w").cast("int")), ["q", "w"])
        .join(named, "q")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
