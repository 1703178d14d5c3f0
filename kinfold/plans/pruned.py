"""Exact top-k and range search that read only the cells and rows a query can need.

For a metric, an object x in a cell with pivot p and ring [lo, hi] is within r of
q only if d(q, p) - r <= hi and d(q, p) + r >= lo, and only if d(q, p) and the
stored d(x, p) differ by r at most.  The first test leaves out cells, the second
rows before any distance is computed.  The cells that end nearest to a query and hold
k objects between them give a radius that the k-th neighbour can't exceed.  Many cells
are grouped into a tree of nodes with rings of their own, down which queries go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.metrics import Metric, l2, l2_of, metric_of, usable
from kinfold.operators.knn import knn_exact, top_k
from kinfold.operators.nearest import TOGETHER, matrix, search_tiles
from kinfold.operators.pivots import _farthest, build_index, spread
from kinfold.plans.pairs import against_all
from kinfold.plans.staging import stage

#: Guards comparisons of bounds against rounding, relative to the numbers compared.
EPS = 1e-9


#: Nodes at the top of a tree of cells, which every query meets, and children of a node.
TOP, FAN = 256, 32
#: Most numbers in the pivots of the cells that go to every task at once (8 MiB).
SURVEY = 1 << 20
#: Cells beyond which a query meets groups of them.
GROUPED = 512
#: Wanted cells that are named to the scan.
FEW_CELLS = 200
#: Objects and queries of a cell that one tile takes.
LANE_ROWS, BLOCK_QUERIES = 1 << 16, 1 << 13
#: Euclidean distances of vectors up to this width are written out, number by number.
NARROW = 16
#: Pairs of rows and queries up to which a search without an index meets all, and objects of a cell of the index beyond that.
ALL_PAIRS, CELL_ROWS = 1 << 28, 250


def _compiled(cells: DataFrame, metric: str | Metric) -> Metric:
    """The metric; for short vectors the form of l2() that Spark compiles."""
    if metric in ("l2", l2):
        width = cells.agg(F.max(F.size("pobj"))).first()[0]
        if width and width <= NARROW:
            return l2_of(width)
    return metric_of(metric)


def query_cells(cells: DataFrame, queries: DataFrame, metric: str | Metric = "l2", *kept: str) -> DataFrame:
    """(qid, qobj, *kept, cell, dq, lo, hi, cnt): every query with every cell; ``kept`` are columns of the queries."""
    asked = usable(queries, "qid", "qobj").select("qid", "qobj", *kept)
    pairs = against_all(cells.withColumnRenamed("cell", "id"), asked)
    return pairs.select(
        "qid", "qobj", *kept, F.col("id").alias("cell"), metric_of(metric)(F.col("pobj"), F.col("qobj")).alias("dq"), "lo", "hi", "cnt"
    )


def _boundless(radius: Column) -> Column:
    """Whether a radius excludes nothing: infinite or NaN."""
    return F.isnan(radius) | (radius == float("inf"))


def ring_holds(radius: Column) -> Column:
    """Whether the ring of a query's cell can hold objects within ``radius``, borders included.

    A distance that is NaN or infinite proves nothing, so such a query reads the cell.
    """
    dq, lo, hi = F.col("dq"), F.col("lo"), F.col("hi")
    room = EPS * (1 + dq)
    return _boundless(radius) | _boundless(dq) | ((dq - radius <= hi + room) & (dq + radius >= lo - room))


def _in_cells(
    assigned: DataFrame, wanted: DataFrame, metric: str | Metric, exclude_self: bool, radius: str | None = None
) -> DataFrame:
    """(qid, id, dist, radius) of the objects of the cells in ``wanted`` (qid, qobj, cell, dq) that the radius may reach."""
    columns = ["cell", "id", "obj", *([] if radius is None else ["pdist"])]
    found = assigned.select(*columns).join(wanted, "cell")
    if exclude_self:
        found = found.where(F.col("id") != F.col("qid"))
    if radius is not None:
        r = F.col(radius)
        gap, room = F.abs(F.col("dq") - F.col("pdist")), EPS * (1 + F.col("dq"))
        found = found.where(_boundless(r) | _boundless(F.col("dq")) | (gap <= r + room))
    kept = ["qid", "id", *([] if radius is None else [radius])]
    return found.select(*kept, metric_of(metric)(F.col("obj"), F.col("qobj")).alias("dist")).where("dist IS NOT NULL")


def cell_tree(cells: DataFrame, metric: str | Metric = "l2", top: int = TOP, fan: int = FAN) -> list[DataFrame]:
    """Levels of nodes (cell, pobj, lo, hi, cnt, up) from the cells to at most about ``top`` nodes.

    The cells of a level are objects themselves: an index of their pivots groups about
    ``fan`` of them under a node, ``up``.  By the triangle inequality all that lies in
    ring [lo, hi] of a cell whose pivot is d from the node's lies within d - hi and
    d + hi of that, so no object is read.
    """
    levels, now = [], cells.select("cell", "pobj", "lo", "hi", "cnt")
    while (n := now.count()) > top:
        _, placed, nodes = build_index(now.select(F.col("cell").alias("id"), F.col("pobj").alias("obj")), fan, metric)
        under = stage(now.join(placed.select(F.col("id").alias("cell"), F.col("cell").alias("up"), F.col("pdist").alias("d")), "cell"), "level")
        least = F.when(F.isnan(F.col("d") - F.col("hi")), F.lit(0.0)).otherwise(F.greatest(F.col("d") - F.col("hi"), F.lit(0.0)))
        ring = under.groupBy("up").agg(F.min(least).alias("lo"), F.max(F.col("d") + F.col("hi")).alias("hi"), F.sum("cnt").alias("cnt"))
        above = stage(
            ring.join(nodes.select(F.col("cell").alias("up"), "pobj"), "up").select(F.col("up").alias("cell"), "pobj", "lo", "hi", "cnt"), "nodes"
        )
        levels.append(under.drop("d"))
        if above.count() >= n:
            break
        now = above
    return [*levels, now.withColumn("up", F.lit(None).cast("long"))]


def _shrunk(front: DataFrame, need: int) -> DataFrame:
    """The frontier (qid, .., dq, hi, cnt, radius) with a radius that the ``need``-th neighbour can't exceed.

    All objects of a node lie within dq + hi of the query, so where those nodes that
    end first hold ``need`` objects between them, the search ends, too.
    """
    far = F.when(_boundless(F.col("dq") + F.col("hi")), F.lit(float("inf"))).otherwise((F.col("dq") + F.col("hi")) * (1 + EPS) + EPS)
    met = front.withColumn("far", far)
    order = W.partitionBy("qid").orderBy("far", "cell")
    seen = F.sum("cnt").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    met = met.withColumn("seen", seen).withColumn("end", F.min(F.when(F.col("seen") >= need, F.col("far"))).over(W.partitionBy("qid")))
    return met.withColumn("radius", F.least("radius", "end")).drop("far", "seen", "end")


def descend(
    cells: DataFrame, queries: DataFrame, metric: str | Metric = "l2", need: int | None = None, top: int = TOP, fan: int = FAN
) -> DataFrame:
    """(qid, qobj, cell, dq, radius): the cells that a query's radius may reach, level by level from the tree's top.

    ``queries`` are usable and may bring a ``radius`` each; with ``need`` it shrinks to
    what the need-th neighbour can't exceed.  A query meets the top nodes and from then
    on only children of nodes that its radius touches.  Query ids have to be unique
    where ``need`` is given.
    """
    metric = _compiled(cells, metric)
    dist = metric_of(metric)(F.col("pobj"), F.col("qobj")).alias("dq")
    asked = queries if "radius" in queries.columns else queries.withColumn("radius", F.lit(float("inf")))
    levels = cell_tree(cells, metric, top, fan)
    met = against_all(levels[-1].withColumnRenamed("cell", "id"), asked.select("qid", "qobj", "radius")).withColumnRenamed("id", "cell")
    for k in range(len(levels) - 1, -1, -1):
        front = met.select("qid", "qobj", "cell", dist, "lo", "hi", "cnt", "radius")
        if need is not None:
            front = _shrunk(front, need)
        front = front.where(ring_holds(F.col("radius")))
        if k:
            met = front.select("qid", "qobj", F.col("cell").alias("up"), "radius").join(levels[k - 1], "up")
    return front.select("qid", "qobj", "cell", "dq", "radius")


def _span(table: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, far, plain): what each row's distance of ``table`` from each of ``q`` can't be below and above, and where that tells anything."""
    with np.errstate(over="ignore", invalid="ignore"):
        nx, nq = (table * table).sum(1), (q * q).sum(1)
        plain = np.isfinite(nx)[None, :] & np.isfinite(nq)[:, None]
        d = nx[None, :] - 2 * (q @ table.T) + nq[:, None]
        slack = 1e-9 * (nx[None, :] + nq[:, None])
        return np.sqrt(np.maximum(d - slack, 0)), np.sqrt(np.maximum(d + slack, 0)), plain


class _Survey:
    """Cells as arrays, many of them in groups by their pivots; a query looks into the groups that its radius touches."""

    def __init__(self, table: np.ndarray, numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray, cnt: np.ndarray, need: int | None) -> None:
        plain = np.isfinite((table * table).sum(1))
        group, self.centres = np.zeros(len(table), int), None
        if len(table) > GROUPED and plain.any():
            own = table[plain]
            self.centres = own[_farthest(own, int(len(table) ** 0.5))]
            for at in range(0, len(table), TOGETHER):
                part = table[at : at + TOGETHER]
                group[at : at + TOGETHER] = np.where(plain[at : at + TOGETHER], _span(self.centres, part)[1].argmin(1), len(self.centres))
            # cells that have no distance are a group that every query looks into
            self.centres = np.vstack([self.centres, np.zeros(table.shape[1])])
        order = np.argsort(group, kind="stable")
        self.table, self.numbers, self.lo, self.hi, self.cnt, self.need = table[order], numbers[order], lo[order], hi[order], cnt[order], need
        if self.centres is not None:
            self.ends = np.searchsorted(group[order], np.arange(len(self.centres) + 1))
            # all of a group's objects lie within this of its centre
            self.reach = np.full(len(self.centres), -np.inf)
            for g in range(len(self.centres)):
                own = slice(self.ends[g], self.ends[g + 1])
                if own.start < own.stop:
                    out = (_span(self.centres[g : g + 1], self.table[own])[1][:, 0] + self.hi[own]).max()
                    self.reach[g] = np.inf if np.isnan(out) or np.isnan(self.lo[own]).any() or g == len(self.centres) - 1 else out

    def shrunk(self, q: np.ndarray, radius: np.ndarray, own: slice) -> np.ndarray:
        """The radius that the ``need``-th neighbour can't exceed, from some of the cells."""
        _, far, plain = _span(self.table[own], q)
        end = np.where(plain, far + self.hi[own], np.inf)
        end[np.isnan(end)] = np.inf
        first = min(self.need, end.shape[1])  # every cell holds an object at least
        at = np.argpartition(end, first - 1, 1)[:, :first]
        ends, counts = np.take_along_axis(end, at, 1), self.cnt[own][at]
        order = np.argsort(ends, 1)
        ends, counts = np.take_along_axis(ends, order, 1), np.take_along_axis(counts, order, 1).cumsum(1)
        enough = counts >= self.need
        bound = np.where(enough.any(1), ends[np.arange(len(q)), enough.argmax(1)], np.inf)
        return np.fmin(radius, bound * (1 + EPS) + EPS)

    def within(self, q: np.ndarray, radius: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, cell, no object of it is farther) of those of the cells that each row's radius touches."""
        near, far, plain = _span(self.table[own], q)
        lo, hi, r = self.lo[own], self.hi[own], radius[:, None]
        room = EPS * (1 + far)
        use = ~plain | ~np.isfinite(r) | ((near - r <= hi + room) & (far + r >= lo - room)) | np.isnan(hi) | np.isnan(lo)
        row, col = np.nonzero(use)
        end = np.where(plain[row, col], far[row, col] + hi[col], np.inf)
        return row, col + own.start, np.where(np.isnan(end), np.inf, end)

    def touched(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, cell, radius) of the cells that each row's radius touches."""
        with np.errstate(over="ignore", invalid="ignore"):
            if self.centres is None:
                every = slice(0, len(self.table))
                if self.need is not None:
                    radius = self.shrunk(q, radius, every)
                row, col, _ = self.within(q, radius, every)
                return row, col, radius[row]
            near, far, plain = _span(self.centres, q)
            if self.need is not None:
                radius, first = radius.copy(), np.where(plain & np.isfinite(self.reach), far, np.inf).argmin(1)
                for rows, own in self._looks(first[:, None] == np.arange(len(self.centres))):
                    radius[rows] = self.shrunk(q[rows], radius[rows], own)
            r = radius[:, None]
            use = ~plain | ~np.isfinite(r) | (near - r <= self.reach + EPS * (1 + far))
            row, col, end = self._in_groups(q, radius, use)
            if self.need is not None and len(row):
                # whatever ends within the radius is among them, so they tell as much as all cells
                order = np.lexsort((end, row))
                row, col, end = row[order], col[order], end[order]
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                seen = np.cumsum(self.cnt[col])
                seen -= np.repeat((seen - self.cnt[col])[starts], np.diff(np.append(starts, len(row))))
                bound = np.full(len(q), np.inf)
                np.minimum.at(bound, row[seen >= self.need], end[seen >= self.need])
                radius = np.fmin(radius, bound * (1 + EPS) + EPS)
                keep = self._still(q[row], radius[row], col)
                row, col = row[keep], col[keep]
            return row, col, radius[row]

    def _looks(self, use: np.ndarray) -> Iterator[tuple[np.ndarray, slice]]:
        """(rows, cells) of each group that rows look into, a bounded number of pairs at a time."""
        for g in np.flatnonzero(use.any(0)):
            own, rows = slice(self.ends[g], self.ends[g + 1]), np.flatnonzero(use[:, g])
            if own.start < own.stop:
                step = max(1, (1 << 20) // (own.stop - own.start))
                for at in range(0, len(rows), step):
                    yield rows[at : at + step], own

    def _in_groups(self, q: np.ndarray, radius: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for rows, own in self._looks(use):
            row, col, end = self.within(q[rows], radius[rows], own)
            found.append((rows[row], col, end))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _still(self, q: np.ndarray, radius: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whether the radius touches the cell, pair by pair."""
        table, lo, hi = self.table[col], self.lo[col], self.hi[col]
        nx, nq = (table * table).sum(1), (q * q).sum(1)
        d, slack = nx - 2 * (q * table).sum(1) + nq, 1e-9 * (nx + nq)
        near, far = np.sqrt(np.maximum(d - slack, 0)), np.sqrt(np.maximum(d + slack, 0))
        room = EPS * (1 + far)
        plain = np.isfinite(nx) & np.isfinite(nq)
        return ~plain | ~np.isfinite(radius) | ((near - radius <= hi + room) & (far + radius >= lo - room)) | np.isnan(hi) | np.isnan(lo)


def _survey(cells: DataFrame, queries: DataFrame, need: int | None, most: int = SURVEY) -> DataFrame | None:
    """The rows of descend() without dq, by matrix products with the cells; None if their pivots are more than ``most`` numbers.

    Products give a lower and an upper bound of each distance, and the tests take the
    one that keeps more.  Beyond GROUPED cells a query meets about their square root of
    groups, and the cells of those that its radius touches.
    """
    n, width = cells.agg(F.count("*"), F.max(F.size("pobj"))).first()
    if not n or n * width > most:
        return None
    held = cells.select("cell", "pobj", "lo", "hi", "cnt").toArrow()
    table = matrix(held.column("pobj").combine_chunks(), width)
    found = _Survey(table, *(held.column(c).to_numpy() for c in ("cell", "lo", "hi", "cnt")), need)
    shared = cells.sparkSession.sparkContext.broadcast(found)
    asked = queries if "radius" in queries.columns else queries.withColumn("radius", F.lit(float("inf")))
    asked = asked.select("qid", "qobj", "radius")
    if found.centres is not None:
        asked = spread(asked, "qid")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        together = TOGETHER if own.centres is None else 8 * TOGETHER
        for batch in batches:
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                row, col, radius = own.touched(matrix(part.column("qobj"), width), part.column("radius").to_numpy())
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("qid").take(rows), part.column("qobj").take(rows), pa.array(own.numbers[col]), pa.array(radius)],
                    names=["qid", "qobj", "cell", "radius"],
                )

    kinds = [asked.schema[c].dataType.simpleString() for c in ("qid", "qobj")]
    return asked.mapInArrow(survey, f"qid {kinds[0]}, qobj {kinds[1]}, cell long, radius double")


def wanted_cells(cells: DataFrame, queries: DataFrame, metric: str | Metric, need: int | None = None) -> DataFrame:
    """The cells that each query has to read: by products where all pivots fit into a task, else down the tree of cells."""
    found = _survey(cells, queries, need) if metric in ("l2", l2) else None
    return descend(cells, queries, metric, need) if found is None else found


def _tiled(assigned: DataFrame, cells: DataFrame, wanted: DataFrame, k: int | None, exclude_self: bool) -> DataFrame:
    """(qid, id, dist) of the objects of the wanted cells, each cell a tile of matrix products.

    A cell with more objects than a lane or more queries than a block is dealt in
    several tiles; cells that nobody wants aren't shuffled.
    """
    wanted = stage(wanted, "wanted")
    uses = wanted.groupBy("cell").agg(F.count("*").alias("uses"))
    few = [r[0] for r in uses.select("cell").limit(FEW_CELLS + 1).collect()]
    rows = assigned.select("cell", "id", "obj")
    if len(few) <= FEW_CELLS:  # the scan then leaves out row groups of other cells
        rows = rows.where(F.col("cell").isin(few))
    else:
        rows = rows.join(uses.select("cell"), "cell", "left_semi")
    sized = cells.select("cell", "cnt").join(uses, "cell").select(
        "cell", F.ceil(F.col("cnt") / LANE_ROWS).cast("int").alias("lanes"), F.ceil(F.col("uses") / BLOCK_QUERIES).cast("int").alias("blocks")
    )
    hot = stage(sized.where("lanes > 1 OR blocks > 1"), "hot")
    if hot.isEmpty():
        return search_tiles(rows.withColumnRenamed("cell", "tile"), wanted.withColumnRenamed("cell", "tile"), k, exclude_self)
    # tiles of hot cells have numbers below 0, no cell's
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    tiles = hot.withColumn("lane", each("lanes")).withColumn("block", each("blocks"))
    tiles = stage(tiles.select("cell", "lanes", "blocks", "lane", "block", (-1 - F.monotonically_increasing_id()).alias("number")), "tiles")
    lane, block = F.pmod(F.xxhash64("id"), F.col("lanes")), F.pmod(F.xxhash64("qid"), F.col("blocks"))
    whole = lambda t: t.join(hot.select("cell"), "cell", "left_anti").withColumnRenamed("cell", "tile")
    parted = lambda t, own: t.join(tiles, "cell").where(own).drop("cell").withColumnRenamed("number", "tile")
    return search_tiles(
        whole(rows).select("tile", "id", "obj").unionByName(parted(rows, lane == F.col("lane")).select("tile", "id", "obj")),
        whole(wanted).select("tile", "qid", "qobj", "radius").unionByName(parted(wanted, block == F.col("block")).select("tile", "qid", "qobj", "radius")),
        k, exclude_self,
    )


def _found(assigned: DataFrame, cells: DataFrame, wanted: DataFrame, k: int | None, metric: str | Metric, exclude_self: bool) -> DataFrame:
    """(qid, id, dist) of what is within the radius in the wanted cells; with ``k`` only what can be among the k nearest."""
    if metric in ("l2", l2):
        return _tiled(assigned, cells, wanted, k, exclude_self)
    return _within(_in_cells(assigned, wanted, metric, exclude_self, "radius"))


def _within(found: DataFrame) -> DataFrame:
    """Pairs whose distance is within their radius, and all of those whose radius excludes nothing."""
    return found.where(_boundless(F.col("radius")) | (F.col("dist") <= F.col("radius")))


def _asked(queries: DataFrame) -> DataFrame:
    return usable(queries, "qid", "qobj").select("qid", "qobj")


def knn_pruned(assigned: DataFrame, cells: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """The same result as knn_exact() for a metric, from the cells that can hold neighbours.

    Works with split cells, as it uses rings alone; the cells' counts have to be right
    or too low (recount()).  Rings only ever too wide do no harm.
    """
    wanted = wanted_cells(cells, _asked(queries).select("qid", "qobj"), metric, k + int(exclude_self))
    return top_k(_found(assigned, cells, wanted, k, metric, exclude_self), k)


def range_pruned(assigned: DataFrame, cells: DataFrame, queries: DataFrame, radius: float, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """The same result as range_search() for a metric, from the cells that can hold it."""
    wanted = wanted_cells(cells, _asked(queries).withColumn("radius", F.lit(float(radius))), metric)
    found = _found(assigned, cells, wanted, None, metric, exclude_self)
    return found.where((F.col("dist") <= radius) & ~F.isnan("dist")).select("qid", "id", "dist")


def knn_approx(assigned: DataFrame, cells: DataFrame, queries: DataFrame, radii: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """Top-k within a predicted radius (qid, radius), with ``exact`` false: neighbours beyond it are missed."""
    wanted = wanted_cells(cells, _asked(queries).join(radii.select("qid", "radius"), "qid"), metric)
    return top_k(_found(assigned, cells, wanted, k, metric, exclude_self), k, exact=False)


def knn_indexed(data: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False) -> DataFrame:
    """The result of knn_exact(), over an index of its own whatever the size; other metrics than Euclidean go by brute force.

    The index leaves out what the rings prove to be too far, and nothing that a model tells.
    """
    if metric not in ("l2", l2):
        return knn_exact(data, queries, k, metric, exclude_self)
    return knn_pruned(*build_index(data, CELL_ROWS, metric)[1:], queries, k, metric, exclude_self)


def knn_searched(data: DataFrame, queries: DataFrame, k: int, metric: str | Metric = "l2", exclude_self: bool = False, brute=None) -> DataFrame:
    """The result of knn_exact(), for rows and queries that grow together: by brute force up to ALL_PAIRS pairs, else as knn_indexed().

    ``brute`` is knn_exact() or what the caller has for it.  Not for audits of this
    search, which have to be by brute force at any size.
    """
    if metric not in ("l2", l2) or data.count() * queries.count() <= ALL_PAIRS:
        return (brute or knn_exact)(data, queries, k, metric, exclude_self)
    return knn_indexed(data, queries, k, metric, exclude_self)
