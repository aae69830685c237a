"""Exact top-k inner products by best-first search of an M-tree.

With one more coordinate all rows are equally long, so that the larger product is the smaller
distance. The tree's top is a table: every row goes to the nearest of a bounded number of pivots, a
cell knows its covering radius, and a large cell is cut into blocks. A block is a tree of pages of
its own. A query is searched in a block of its nearest cell first; the k-th distance found there
then decides which cells can still hold a nearer row, and only their blocks are searched.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import scratch
from .common import store

#: Vectors of one block and queries of one task; vectors of a leaf page; children of an inner page;
#: cells: the bound on what the workers get of the top of the tree.
BLOCK, QUERIES, LEAF, FAN, PIVOTS = 16384, 8192, 512, 8, 64
#: Of the length of the vectors: far above the rounding errors of a distance.
_SLACK = 1e-6


class MTree:
    """A tree of pages over the rows of x under the Euclidean metric.

    A page keeps its routing object, its covering radius and its distance to the parent's routing
    object; a leaf keeps the distances of its rows to its own routing object too. `order` lists the
    rows leaf by leaf, so that a leaf is a slice of them.
    """

    def __init__(self, x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        self.x, self.leaf, self.fan = x, leaf, fan
        self.center: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[int | None] = []
        self.order: list[np.ndarray] = []
        self.row_to_center: list[np.ndarray | None] = []
        if len(x):
            rows = np.arange(len(x))
            middle = rows[int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))]
            self.root = self._page(rows, int(middle), 0.0)
            self.order = np.concatenate(self.order)

    def _page(self, rows: np.ndarray, center: int, to_parent: float) -> int:
        away = np.sqrt(((self.x[rows] - self.x[center]) ** 2).sum(1))
        me = len(self.center)
        for a, v in ((self.center, center), (self.radius, float(away.max())), (self.to_parent, to_parent), (self.children, []), (self.rows, None), (self.row_to_center, None)):
            a.append(v)
        if len(rows) <= self.leaf or self.radius[me] == 0:
            order = np.argsort(away, kind="stable")
            self.rows[me], self.row_to_center[me] = sum(map(len, self.order)), away[order]
            self.order.append(rows[order])
            return me
        # routing objects: each the farthest from those before it; rows go to the nearest
        part = self.x[rows]
        picked = [int(np.argmax(away))]
        near = np.sqrt(((part - part[picked[0]]) ** 2).sum(1))
        owner = np.zeros(len(rows), np.int64)
        for i in range(1, self.fan):
            far = int(np.argmax(near))
            if near[far] == 0:
                break
            picked.append(far)
            d = np.sqrt(((part - part[far]) ** 2).sum(1))
            closer = d < near
            owner[closer], near = i, np.minimum(near, d)
        for i, p in enumerate(picked):
            mine = rows[owner == i]
            self.children[me].append(self._page(mine, int(rows[p]), float(away[p])))
        return me

    def search(self, q: np.ndarray, start: float, take, slack: float = _SLACK) -> int:
        """Visit rows in best-first order while they may be nearer than the bound, which starts at
        `start`; take(lo, hi) evaluates these places of `order` exactly and returns the bound to go on
        with. Returns the number of distances computed."""
        if not len(self.x):
            return 0
        away = lambda i: float(np.sqrt(((self.x[i] - q) ** 2).sum()))
        bound, computed = start, 1
        d = away(self.center[self.root])
        queue = [(max(0.0, d - self.radius[self.root]), self.root, d)]
        while queue:
            least, page, d = heapq.heappop(queue)
            if least > bound + slack:
                break
            if self.rows[page] is not None:
                # |d - distance to the routing object| bounds from below without a new distance
                stored = self.row_to_center[page]
                lo, hi = np.searchsorted(stored, (d - bound - slack, d + bound + slack))
                if hi > lo:
                    bound = take(self.rows[page] + int(lo), self.rows[page] + int(hi))
                    computed += int(hi - lo)
                continue
            kids = [c for c in self.children[page] if abs(d - self.to_parent[c]) - self.radius[c] <= bound + slack]
            if kids:
                dist = np.sqrt(((self.x[[self.center[c] for c in kids]] - q) ** 2).sum(1))
                computed += len(kids)
                for c, e in zip(kids, dist.tolist()):
                    low = max(0.0, e - self.radius[c])
                    if low <= bound + slack:
                        heapq.heappush(queue, (low, c, e))
        return computed


def _exact(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as the fastest type in which all products of the two are exact."""
    most = max((float(np.abs(v).max(initial=0)) for v in (x, y)), default=0.0)
    bits = 2 * np.log2(max(1.0, most)) + np.log2(max(1, x.shape[1]))
    if bits < 52:
        return x, y
    if bits < 62:
        return x.astype(np.int64), y.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(y)


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    """The rows over `longest`, at least the length of each, with the coordinate that makes them 1 long."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]], 1)


def _block_top(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, longest: float, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query_id, vec_id, score) of each query's k best rows (ties to smaller ids) that may be nearer
    than its bound, all whole numbers held in doubles; and the number of distances computed."""
    if not len(rows):
        return [], 0
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    tree = MTree(_augmented(rows, longest))
    rows, ids = rows[tree.order], ids[tree.order]
    near = np.concatenate([queries / longest, np.zeros((len(queries), 1))], 1)
    exact, asked = _exact(rows, queries)
    out, computed = [], 0
    for q, at, qid, start in zip(asked, near, query_ids.tolist(), bounds.tolist()):
        own = float((at * at).sum()) + 1.0
        slack = _SLACK * (1 + own)
        best: list[tuple[int, int]] = []

        def take(lo, hi, q=q, qid=qid, own=own, best=best, start=start):
            scores = exact[lo:hi] @ q
            places = np.flatnonzero(scores >= best[0][0]) if len(best) == k else range(hi - lo)
            for j in places:
                item = (int(scores[j]), -int(ids[lo + j]))
                if -item[1] == qid:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            # rows that tie with the worst are visited too: the bound is not strict
            return min(start, np.sqrt(max(0.0, own - 2 * (best[0][0] / longest / longest)))) if len(best) == k else start

        computed += tree.search(at, start, take, slack)
        out += [(qid, -i, s) for s, i in best]
    return out, computed


_LONG = (1 << 63) - 1


def exact_top_k(
    vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES, pivots: int = PIVOTS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query vector
    (ids divisible by query_every) with every row but its own; ties to the smaller id.

    Components become floor(scale * x), as double. Vectors that are null, empty or hold a null or
    non-finite component, or one that is then beyond 1e150 (no double holds its products), and rows
    without an id, take no part; a pair of
    vectors of different lengths is no candidate pair. However large the components, products are
    exact and ranked exactly; one beyond 64 bits is shown as the nearest long. A repeated row is a
    candidate for each time it stands there, except for its own id; a repeated id among the queries
    is asked once, with its smallest vector. Extra columns are ignored; an empty table gives an empty one.

    A task holds about `block` rows and `queries` queries; the workers get `pivots` vectors a length.
    """
    with scratch(vectors.sparkSession) as kept:
        out = store(_top_k(vectors, k, query_every, scale, id_col, vector, block, queries, pivots))
        kept.append(out)
    return out


def _top_k(vectors: DataFrame, k: int, query_every: int, scale: int, id_col: str, vector: str, block: int, queries: int, pivots: int) -> DataFrame:
    y = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = F.transform(F.col(vector), lambda x: F.when(F.abs(y(x)) < float(1 << 53), F.floor(y(x)).cast("double")).otherwise(y(x)))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).where(~bad)
    # the length by way of the largest component, which never overflows
    most = F.array_max(F.transform("v", F.abs))
    long = F.when(most > 0, most * F.sqrt(F.aggregate(F.transform("v", lambda x: x / most), F.lit(0.0), lambda a, x: a + x * x))).otherwise(0.0)
    rows = store(rows.select("id", "v", F.size("v").alias("dim"), long.alias("length")))

    asked = rows.where(f"id % {query_every} = 0")
    lengths = rows.join(asked.select("dim").distinct(), "dim", "left_semi").groupBy("dim").agg(F.max("length").alias("l")).collect()
    longest = {r["dim"]: float(r["l"]) * (1 + 1e-9) or 1.0 for r in lengths}
    first = rows.where(F.col("dim").isin([*longest])).withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("id"), "id", "v"))).where(F.col("nth") <= pivots)
    top: dict[int, list] = {}
    for r in first.select("dim", "v").collect():
        top.setdefault(r["dim"], []).append(r["v"])
    tops = {d: _augmented(np.array(v, np.float64), longest[d]) for d, v in top.items()}

    placed = store(_placed(rows.where(F.col("dim").isin([*longest])), tops, longest))
    cells = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()
    radius = {d: np.full(len(t), -np.inf) for d, t in tops.items()}  # an empty cell is never searched
    blocks = {d: np.zeros(len(t), np.int64) for d, t in tops.items()}
    for c in cells:
        radius[c["dim"]][c["cell"]], blocks[c["dim"]][c["cell"]] = c["radius"], -(-c["n"] // block)
    size = F.broadcast(rows.sparkSession.createDataFrame([(c["dim"], c["cell"], -(-c["n"] // block)) for c in cells], "dim int, cell int, blocks long"))
    held = placed.join(size, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("id", "v", "dim", "cell", "block")

    asked = store(asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    near = store(_searched(held, _home(asked, tops, radius, blocks, longest), longest, queries, k))
    known = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("near").alias("near"), F.first("cell").alias("cell"), F.first("block").alias("block"))
    known = known.select(F.col("query_id").alias("id"), F.when(F.col("n") == k, F.col("near")).alias("near"), F.col("cell").alias("had_cell"), F.col("block").alias("had_block"))
    more = _searched(held, _elsewhere(asked.join(known, "id", "left"), tops, radius, blocks, longest), longest, queries, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order"), "vec_id"))
    best = near.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def _matrix(lists: pa.Array, dim: np.ndarray, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of one length, and these."""
    at = np.flatnonzero(dim == of)
    return at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), of)


def _away(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Distances of the rows to the pivots, a piece of the rows at a time."""
    out = np.empty((len(x), len(top)))
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        squares = (part * part).sum(1)[:, None] + (top * top).sum(1)[None, :] - 2 * (part @ top.T)
        out[lo : lo + 1024] = np.sqrt(np.maximum(0.0, squares))
    return out


def _placed(rows: DataFrame, tops: dict, longest: dict) -> DataFrame:
    """The rows with the cell of their nearest pivot and the distance to it."""

    def place(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            cell, away = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                at, x = _matrix(batch.column(1), dim, d)
                dist = _away(_augmented(x, longest[d]), tops[d])
                cell[at] = dist.argmin(1)
                away[at] = dist.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(away)], ["id", "v", "dim", "cell", "away"])

    return rows.select("id", "v", "dim").mapInArrow(place, "id long, v array<double>, dim int, cell int, away double")


#: A distance from the product form is right to about the square root of a double's precision.
_ROUGH = 1e-6
_ASKED = "id long, v array<double>, dim int, cell int, block int, bound double"


def _queried(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x / longest, np.zeros((len(x), 1))], 1)


def _home(asked: DataFrame, tops: dict, radius: dict, blocks: dict, longest: dict) -> DataFrame:
    """Each query with one block of the cell of its nearest pivot."""

    def route(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            ids = batch.column(0).to_numpy()
            cell, block = np.zeros(len(dim), np.int32), np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                at, x = _matrix(batch.column(1), dim, d)
                dist = np.where(blocks[d] > 0, _away(_queried(x, longest[d]), tops[d]), np.inf)
                cell[at] = dist.argmin(1)
                block[at] = ids[at] % blocks[d][cell[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(block), pa.array(np.full(len(dim), np.inf))], ["id", "v", "dim", "cell", "block", "bound"])

    return asked.select("id", "v", "dim").mapInArrow(route, _ASKED)


def _elsewhere(asked: DataFrame, tops: dict, radius: dict, blocks: dict, longest: dict) -> DataFrame:
    """Each query with every other block that may hold a row as near as the k-th it has found."""

    def route(batches):
        for batch in batches:
            dim = batch.column(2).to_numpy()
            near = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            had = [batch.column(i).fill_null(-1).to_numpy() for i in (4, 5)]
            for d in np.unique(dim).tolist():
                at, x = _matrix(batch.column(1), dim, d)
                q = _queried(x, longest[d])
                own = (q * q).sum(1) + 1.0
                bound = np.where(np.isnan(near[at]), np.inf, np.sqrt(np.maximum(0.0, own - 2 * near[at])))
                open_ = _away(q, tops[d]) - radius[d][None, :] <= (bound + _ROUGH * (1 + own))[:, None]
                which, cell = np.nonzero(open_ & (blocks[d] > 0)[None, :])
                n = blocks[d][cell]
                block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                which, cell = np.repeat(which, n), np.repeat(cell, n)
                keep = (cell != had[0][at][which]) | (block != had[1][at][which])
                which, cell, block = which[keep], cell[keep], block[keep]
                for lo in range(0, len(which), 20_000):
                    w = which[lo : lo + 20_000]
                    picked = batch.take(pa.array(at[w]))
                    yield pa.RecordBatch.from_arrays([*picked.columns[:3], *map(pa.array, (cell[lo : lo + 20_000].astype(np.int32), block[lo : lo + 20_000].astype(np.int32), bound[w]))], ["id", "v", "dim", "cell", "block", "bound"])

    return asked.select("id", "v", "dim", "near", "had_cell", "had_block").mapInArrow(route, _ASKED)


_FOUND = "query_id long, vec_id long, score long, order string, near double, cell int, block int"


def _order(n: int) -> str:
    """A text that sorts as the whole numbers do, of any size."""
    digits = str(abs(n))
    if n >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}{digits.translate(_NINES)}"


_NINES = str.maketrans("0123456789", "9876543210")


def _searched(held: DataFrame, asked: DataFrame, longest: dict, queries: int, k: int) -> DataFrame:
    """The best rows of each query in each block that it is sent to."""
    asked = store(asked)
    by = ["dim", "cell", "block"]
    parts = asked.groupBy(*by).agg(F.ceil(F.count("*") / queries).cast("long").alias("parts"))
    left = held.join(parts, by).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # other names, as the two sides of a cogroup may share none
    right = asked.join(parts, by).select(*[F.col(c).alias(f"q_{c}") for c in ("id", "v", "bound", *by)], F.pmod(F.xxhash64("id"), F.col("parts")).alias("q_part"))

    def search(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            l = longest[int(key[0])]
            stack = lambda v: np.array(v.tolist(), np.float64)
            found, _ = _block_top(stack(rows["v"]), rows["id"].to_numpy(np.int64), stack(wanted["q_v"]), wanted["q_id"].to_numpy(np.int64), wanted["q_bound"].to_numpy(), l, k)
        out = [(q, i, max(-_LONG - 1, min(_LONG, score)), _order(score), score / l / l, int(key[1]), int(key[2])) for q, i, score in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "order", "near", "cell", "block"])

    return left.groupBy(*by, "part").cogroup(right.groupBy(*[f"q_{c}" for c in by], "q_part")).applyInPandas(search, _FOUND)
