"""Hard negatives: the nearest rows of other labels whose scores lie in a window below a positive's, by ball trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skirmish.llm.common import stored

#: Cells that the rows are dealt to, at most, and numbers in their pivots together, at most: what is sent to every task.
CELLS, PIVOT_NUMBERS = 1024, 1 << 19
#: Rows of a block, which one tree holds: at least and at most, and how many blocks there should be between these.
LEAST_ROWS, MOST_ROWS, BLOCKS = 512, 65_536, 4096
#: Anchors that visit a block together, at most on average.
MOST_ANCHORS = 16_384
#: Rows of a leaf.
LEAF = 48


def quantized(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and ``vec``, with each component x as floor(scale * x), of the rows that can take part.

    Rows with a null id, label or vector, or with a null or non-finite component, are left out. Components are cut at
    2^62 / their number, to the root, so that no product of two vectors leaves 64 bits.
    """
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(v), F.lit(1))))
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), most), -most))
    known = embeddings.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull()).where(~odd)
    return known.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), scaled.cast("array<long>").alias("vec"))


def _matrix(rows: pa.Table, name: str) -> np.ndarray:
    column = rows.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.empty((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the narrowest kind in which their products are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


class BallTree:
    """Rows in a tree of balls, its leaves of LEAF rows or fewer; rows are in the order of the leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.nodes: list[tuple[int, int, np.ndarray, float, int]] = []  # start, end, center, radius, least id
        self.below: dict[int, tuple[int, int]] = {}
        self.order, self.ids, self.vectors = np.arange(len(ids)), ids, vectors.astype(np.float64)
        self._add(0, len(ids))
        self.vectors = None

    def _add(self, a: int, b: int) -> int:
        own = self.vectors[self.order[a:b]]
        center = own.mean(axis=0)
        far = ((own - center) ** 2).sum(axis=1)
        radius, place = math.sqrt(far.max()), len(self.nodes)
        self.nodes.append((a, b, center, radius, int(self.ids[self.order[a:b]].min())))
        if b - a > LEAF:
            # along the line from the row farthest from the center to the one farthest from that; equal rows by their ids
            one = own[far.argmax()]
            axis = own[((own - one) ** 2).sum(axis=1).argmax()] - one
            self.order[a:b] = self.order[a:b][np.lexsort((self.ids[self.order[a:b]], own @ axis))]
            half = (a + b) // 2
            self.below[place] = (self._add(a, half), self._add(half, b))
        return place


_LOW, _HIGH = -(2**63), 2**63 - 1


def _visit(rows: pa.Table, queries: pa.Table, k: int, same: bool) -> pa.Table:
    """Query, id and score of the first k rows of each query, by score, the highest first, and id.

    Only rows of its own label but the anchor, or of other labels, with scores from low to high. kth and kth_id are a score
    and an id that k rows elsewhere reach, or null: what is behind them is left out. Nodes of the tree are visited with
    all queries at once that they may hold something for, and a query leaves a node that is beyond its window, strictly
    under its k-th row so far, or at that row's score with larger ids only.
    """
    queries = queries.sort_by("row")
    vectors, asked = _matrix(rows, "vec"), _matrix(queries, "vec")
    ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
    number, row, anchor, own, low, high = (queries.column(c).to_numpy() for c in ("query", "row", "anchor_id", "label", "low", "high"))
    bar, bar_id = (queries.column(c).fill_null(x).to_numpy().copy() for c, x in (("kth", _LOW), ("kth_id", _HIGH)))
    new = np.concatenate([[True], row[1:] != row[:-1]])
    of, points = np.cumsum(new) - 1, asked[new]  # queries of one anchor share its products
    tree = BallTree(vectors, ids)
    left, right = _exact(points, vectors[tree.order])
    ids, labels, points = ids[tree.order], labels[tree.order], points.astype(np.float64)
    lengths = np.sqrt((points**2).sum(axis=1))
    best, best_id = np.full((len(number), k), _LOW), np.full((len(number), k), _HIGH)
    stack = [(0, np.arange(len(number)))]
    while stack:
        node, alive = stack.pop()
        a, b, center, radius, least = tree.nodes[node]
        middle, reach = (points @ center)[of[alive]], lengths[of[alive]] * radius
        slack = 1e-9 * (lengths[of[alive]] * math.sqrt((center**2).sum()) + reach) + 1e-6
        top, bottom = middle + reach + slack, middle - reach - slack
        ahead = (top > bar[alive]) & ((np.floor(top) != bar[alive]) | (least <= bar_id[alive]))
        alive = alive[(bottom <= high[alive]) & (top >= low[alive]) & ahead]
        if not len(alive):
            continue
        if node in tree.below:
            near, far = tree.below[node]
            if points[of[alive]].sum(axis=0) @ (tree.nodes[near][2] - tree.nodes[far][2]) < 0:
                near, far = far, near
            stack += [(far, alive), (near, alive)]
            continue
        who, back = np.unique(of[alive], return_inverse=True)
        scores = (left[who] @ right[a:b].T).astype(np.int64)[back]
        bars = bar[alive, None]
        fits = ((labels[a:b] == own[alive, None]) == same) & (ids[a:b] != anchor[alive, None])
        fits &= (scores >= low[alive, None]) & (scores <= high[alive, None]) & ((scores > bars) | (scores == bars) & (ids[a:b] <= bar_id[alive, None]))
        some = fits.any(axis=1)
        alive, fits, scores = alive[some], fits[some], scores[some]
        if not len(alive):
            continue
        scores = np.concatenate([best[alive], np.where(fits, scores, _LOW)], axis=1)
        found = np.concatenate([best_id[alive], np.where(fits, ids[a:b], _HIGH)], axis=1)
        first = np.lexsort((found, ~scores), axis=1)[:, :k]
        best[alive], best_id[alive] = (np.take_along_axis(x, first, 1) for x in (scores, found))
        last, last_id = best[alive, k - 1], best_id[alive, k - 1]
        better = (last > bar[alive]) | (last == bar[alive]) & (last_id < bar_id[alive])
        bar[alive], bar_id[alive] = np.where(better, last, bar[alive]), np.where(better, last_id, bar_id[alive])
    q, r = np.nonzero(best != _LOW)
    return pa.table({"query": number[q], "vec_id": best_id[q, r], "score": best[q, r]})


_BLOCK, _QUERY = ["cell", "sub", "lot"], ["query", "row", "anchor_id", "label", "vec", "low", "high", "kth", "kth_id"]
_FOUND = "query long, vec_id long, score long"


class Index:
    """Rows in blocks of bounded size: near ones in one cell, a large cell in several blocks, dealt by a hash.

    vectors: vec_id, label, vec, of one length. The pivots are rows in the order of a hash of their ids, CELLS at most; every
    row goes to the cell of the nearest. What the driver and all tasks hold are the pivots, and each cell's size and radius.
    """

    def __init__(self, vectors: DataFrame):
        self.n = vectors.count()
        self.rows_per_block = min(max(self.n // BLOCKS, LEAST_ROWS), MOST_ROWS)
        length = len((vectors.select("vec").first() or [[]])[0])
        most = max(1, min(CELLS, PIVOT_NUMBERS // max(length, 1), math.ceil(self.n / self.rows_per_block)))
        pivots = [r["vec"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()]
        self.pivots = np.array(pivots, np.float64).reshape(len(pivots), length)
        dealt = vectors.mapInArrow(_nearest(self.pivots), "vec_id long, label long, vec array<long>, cell int, far double")
        dealt = stored(dealt)
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        self.cells = [r["cell"] for r in sizes]
        self.radius = np.array([math.sqrt(r["far"]) for r in sizes])
        self.subs = [math.ceil(r["n"] / self.rows_per_block) for r in sizes]
        subs = F.create_map(*[F.lit(x) for pair in zip(self.cells, self.subs, strict=True) for x in pair]) if sizes else F.create_map(F.lit(0), F.lit(1))
        self.blocks = stored(dealt.select("vec_id", "label", "vec", "cell", F.pmod(F.xxhash64("vec_id"), subs[F.col("cell")]).cast("int").alias("sub")))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """query, vec_id, score and rank of each query's first k rows; see _visit(). queries: the columns of _QUERY but kth and
        kth_id, and cell and sub, the anchor's own block, which is visited first. The others are visited by the queries for
        which the ball of their cell may hold something, with the k-th row of the first visit known."""
        lots = max(1, math.ceil(queries.select("row").distinct().count() / MOST_ANCHORS))
        queries = queries.withColumns({"lot": F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int"), "kth": F.lit(None).cast("long"), "kth_id": F.lit(None).cast("long")})
        rows = self.blocks.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).select("vec_id", "label", "vec", *_BLOCK)

        def visited(asked: DataFrame) -> DataFrame:
            visit = lambda own, these: _visit(own, these, k, same) if own.num_rows and these.num_rows else _NOTHING
            return stored(rows.groupBy(*_BLOCK).cogroup(asked.select(*_QUERY, *_BLOCK).groupBy(*_BLOCK)).applyInArrow(visit, _FOUND))

        best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        home = visited(queries)
        kth = ranked(home).where(F.col("rank") == k).select("query", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
        known = queries.drop("kth", "kth_id").join(kth, "query", "left").select(*_QUERY, "cell", "sub", "lot")
        others = known.mapInArrow(_reach(self.pivots, self.cells, self.radius, self.subs), ", ".join(f"{c} {_TYPES[c]}" for c in (*_QUERY, "lot")) + ", at array<struct<cell:int,sub:int>>")
        others = others.select(*_QUERY, "lot", F.explode("at").alias("at")).select(*_QUERY, "lot", "at.cell", "at.sub")
        return ranked(home.union(visited(others)))


_TYPES = dict.fromkeys(_QUERY, "long") | {"vec": "array<long>", "lot": "int"}
_NOTHING = pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})


def _nearest(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.Table.from_batches([batch]), "vec").astype(np.float64)
            cell = (x @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)
            far = ((x - pivots[cell]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], names=["vec_id", "label", "vec", "cell", "far"])

    return run


def _reach(pivots: np.ndarray, cells: list[int], radius: np.ndarray, subs: list[int]):
    """The blocks, but the one visited already, that may hold a row for a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(pa.Table.from_batches([batch]), "vec").astype(np.float64)
            lengths = np.sqrt((x**2).sum(axis=1))[:, None]
            middle, reach = x @ pivots[cells].T, lengths * radius
            slack = 1e-6 * (lengths * np.sqrt((pivots[cells] ** 2).sum(axis=1)) + reach + 1)
            low, high, kth = (batch.column(c).fill_null(_LOW).to_numpy()[:, None] for c in ("low", "high", "kth"))
            fits = (middle - reach - slack <= high) & (middle + reach + slack >= np.maximum(low, kth))
            home = list(zip(batch.column("cell").to_pylist(), batch.column("sub").to_pylist(), strict=True))
            at = [[{"cell": cells[c], "sub": s} for c in np.flatnonzero(own).tolist() for s in range(subs[c]) if (cells[c], s) != here] for own, here in zip(fits, home, strict=True)]
            kind = pa.list_(pa.struct([("cell", pa.int32()), ("sub", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*_QUERY, "lot")], pa.array(at, kind)], names=[*_QUERY, "lot", "at"])

    return run


def hard_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    vectors: vec_id, label and vec, as of quantized(). anchors: an SQL condition for the rows that are anchors. A row's score
    is its inner product with the anchor; higher scores come first, ties by the smaller vec_id. The positives of an anchor are
    its first rows of the same label, itself left out; of each, the negatives are the first rows of other labels whose score is
    from low to high hundredths of the positive's. Fewer where there are no more: an anchor or positive without any has no rows.

    The search is exact: anchors visit the blocks of an Index, each by its ball tree, and all blocks but those that the bounds
    rule out. A row that others repeat, id and all, is a row of its own; rows of the anchor's id are never its positives or
    negatives. Vectors of another length than the most common one (the least of such) are left out. Equal vectors may be any
    share of the rows: they are dealt over blocks, and those of larger ids are ruled out by a k-th row of their score. Further
    columns are ignored. An empty table, or one without anchors, gives an empty table.
    """
    sizes = vectors.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    index = Index(vectors.where(F.size("vec") == (sizes["n"] if sizes else 0)).select("vec_id", "label", "vec"))
    of = index.blocks.where(F.expr(anchors)).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("anchor_id"), "label", "vec", "cell", "sub")
    of = stored(of)
    every = of.select(F.col("row").alias("query"), "*", F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))
    found = index.search(every, positives, True).select(F.col("query").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # the hundredth part, and the rest, so that nothing leaves 64 bits
    whole, rest = F.floor((F.col("positive_score") - F.pmod("positive_score", F.lit(100))).cast("decimal(20,0)") / 100).cast("long"), F.pmod("positive_score", F.lit(100))
    window = found.withColumns({"low": whole * low + F.ceil(rest * low / 100).cast("long"), "high": whole * high + F.floor(rest * high / 100).cast("long"), "query": F.monotonically_increasing_id()})
    window = stored(window.where("low <= high"))
    asked = window.select("query", "row", "low", "high").join(of, "row")
    hits = index.search(asked, negatives, False).select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return window.join(hits, "query").join(of.select("row", "anchor_id"), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
