"""Euclidean distances of queries and rows by matrix products over batches.

Products only choose pairs, with room for their rounding; the distances of those are
summed in the order of the components, as l2() does.  A NaN or an infinity is an
ordinary number: such vectors go past the products, and distances that are NaN come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that meet a batch of rows at once.
TOGETHER = 256
#: Rows of a tile that are looked at at once.
TILE_ROWS = 8192


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows in double precision; other lengths than ``width`` raise."""
    if pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("vectors of unequal length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def chosen(x: np.ndarray, q: np.ndarray, take: int | None, limit: np.ndarray, out: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance) of the pairs that can be among the ``take`` nearest of a row of q.

    ``limit`` (squared) bounds each row's distance, the pairs ``out`` don't count.
    Vectors whose squares aren't finite go through no product.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        nx, nq = (x * x).sum(1), (q * q).sum(1)
        plain = np.isfinite(nx)[None, :] & np.isfinite(nq)[:, None]
        d = nx[None, :] - 2 * (q @ x.T) + nq[:, None]
        slack = 1e-9 * (nx[None, :] + nq[:, None])
        least = np.where(plain, d - slack, -np.inf)
        most = np.where(plain, d + slack, np.inf)
    bound = np.nextafter(limit, np.inf)
    if out is not None:
        least[out], most[out] = np.inf, np.inf
    if take is not None and take < x.shape[0]:
        bound = np.minimum(bound, np.partition(most, take - 1, 1)[:, take - 1])
    use = least <= bound[:, None]
    if out is not None:
        use[out] = False
    row, col = np.nonzero(use)
    total = np.zeros(len(row))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            total += (x[col, j] - q[row, j]) ** 2
    return row, col, np.sqrt(total)


def bit_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The bits of a list column of 64-bit words as rows of zeros and ones; other lengths than ``width`` raise."""
    if pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError("fingerprints of unequal length")
    words = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.float32)


def chosen_bits(x: np.ndarray, q: np.ndarray, take: int | None, limit: np.ndarray, out: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of chosen() under Tanimoto distance of rows of zeros and ones; products of those are whole numbers, so distances are exact."""
    both = (q @ x.T).astype(float)
    either = q.sum(1, dtype=float)[:, None] + x.sum(1, dtype=float)[None, :] - both
    dist = np.where(either == 0, 0.0, 1 - both / np.where(either == 0, 1.0, either))
    if out is not None:
        dist[out] = np.inf
    most = np.nextafter(np.sqrt(np.maximum(limit, 0)), np.inf) * (1 + 1e-12)
    most[limit < 0] = -1.0
    if take is not None and take < x.shape[0]:
        most = np.minimum(most, np.partition(dist, take - 1, 1)[:, take - 1])
    use = dist <= most[:, None]
    if out is not None:
        use[out] = False
    row, col = np.nonzero(use)
    return row, col, dist[row, col]


def first_copies(x: np.ndarray, ids: pa.Array, most: int) -> np.ndarray | None:
    """Positions of the ``most`` smallest ids of each group of equal rows of ``x``; None if no group has more."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()
    _, group, size = np.unique(whole, return_inverse=True, return_counts=True)
    if size.max() <= most:
        return None
    order = pc.sort_indices(pa.table({"g": group, "id": ids}), sort_keys=[("g", "ascending"), ("id", "ascending")]).to_numpy()
    own = group[order]
    return np.sort(order[np.arange(len(own)) - np.searchsorted(own, own) < most])


class Nearest:
    """The k nearest rows so far of some queries within their radii (or all of those, without k), fed by batches of rows.

    A radius that is infinite or NaN excludes nothing; any other excludes distances that are NaN.
    ``choose`` is chosen() or another of its kind.
    """

    def __init__(self, qids: pa.Array, table: np.ndarray, radius: np.ndarray, k: int | None, exclude_self: bool, choose=chosen) -> None:
        self.qids, self.table, self.k, self.choose = qids, table, k, choose
        self.radius = np.where(np.isnan(radius), np.inf, radius)
        with np.errstate(over="ignore"):
            self.limit = np.where(radius < 0, -np.inf, self.radius * self.radius * (1 + 1e-12))
        self.names = pc.unique(qids) if exclude_self else None
        self.code = pc.index_in(qids, self.names).to_numpy(zero_copy_only=False) if exclude_self else None
        self.held: list[pa.Table] = []
        self.kept = 0

    def add(self, x: np.ndarray, ids: pa.Array) -> None:
        """Takes a batch of rows.  Of equal ones only those with the smallest ids can be among k, and are held."""
        own = None
        if self.k is not None and len(x) > self.k + 1:
            kept = first_copies(x, ids, self.k + (self.names is not None))
            if kept is not None:
                x, ids = x[kept], ids.take(pa.array(kept))
        if self.names is not None:
            own = pc.index_in(ids.cast(self.names.type), self.names).fill_null(-1).to_numpy(zero_copy_only=False)
        for lo in range(0, len(self.table), TOGETHER):
            part, out = slice(lo, lo + TOGETHER), None
            if own is not None and (hit := np.flatnonzero(own >= 0)).size:
                row, at = np.nonzero(self.code[part][:, None] == own[hit][None, :])
                out = (row, hit[at])
            row, col, dist = self.choose(x, self.table[part], self.k, self.limit[part], out)
            most = self.radius[part][row]
            near = (dist <= most) | np.isinf(most)
            row, col, dist = row[near], col[near], dist[near]
            if len(row):
                self.held.append(pa.table({"q": row + lo, "id": ids.take(pa.array(col)), "dist": dist}))
                self.kept += len(row)
            if self.k is not None and self.kept > 2 * self.k * len(self.table) + 4096:
                self.held[:] = [self._best()]
                self.kept = self.held[0].num_rows

    def _best(self) -> pa.Table:
        """The first k per query in order of (dist, id), which then bound what comes later; NaN is the largest distance."""
        table = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("dist", "ascending"), ("id", "ascending")])
        q = table.column("q").to_numpy()
        t = table.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k))
        q, dist = t.column("q").to_numpy(), t.column("dist").to_numpy()
        last = np.flatnonzero(np.append(q[1:] != q[:-1], True)) if len(q) else np.zeros(0, int)
        full = last - np.searchsorted(q, q[last]) == self.k - 1
        worst = dist[last[full]] ** 2
        own = q[last[full]]
        self.limit[own] = np.minimum(self.limit[own], np.where(np.isnan(worst), np.inf, worst * (1 + 1e-12)))
        return t

    def results(self) -> Iterator[pa.RecordBatch]:
        """(qid, id, dist) of what is held, which then is forgotten."""
        if self.held:
            t = (self._best() if self.k is not None else pa.concat_tables(self.held)).combine_chunks()
            cols = [self.qids.take(t.column("q").combine_chunks()), *[t.column(c).combine_chunks() for c in ("id", "dist")]]
            yield pa.RecordBatch.from_arrays(cols, names=["qid", "id", "dist"])
        self.held, self.kept = [], 0


def search_tiles(rows: DataFrame, queries: DataFrame, k: int | None, exclude_self: bool = False) -> DataFrame:
    """(qid, id, dist): of each tile, every query's k nearest rows, or without ``k`` all within its limit.

    ``rows`` are (tile, id, obj), ``queries`` (tile, qid, qobj, radius), both usable.  A
    tile's queries are held by one task, so keep them few; its rows pass by in
    batches behind them, with the k-th distance of earlier ones as the bound of later
    ones, so there may be any number.  All vectors have to be of one length.
    """
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema["id"].dataType}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    vector = F.col("obj").cast("array<double>").alias("obj")
    both = queries.select(
        "tile", F.lit(0).alias("part"), "qid", none("id"), F.col("qobj").cast("array<double>").alias("obj"), F.col("radius").cast("double").alias("radius")
    ).unionByName(rows.select("tile", F.lit(1).alias("part"), none("qid"), "id", vector, F.lit(0.0).alias("radius")))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "tile").sortWithinPartitions("tile", "part")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "part"))
            cuts = np.flatnonzero((tile[1:] != tile[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                yield int(tile[lo]), int(part[lo]), batch.slice(lo, hi - lo)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, search = None, [], None
        for tile, part, batch in runs(batches):
            if tile != now:
                if search:
                    yield from search.results()
                now, asked, search = tile, [], None
            if part == 0:
                asked.append(batch)
                continue
            if not asked and search is None:
                continue  # nobody asks for this tile
            if search is None:
                held = pa.Table.from_batches(asked).combine_chunks()
                own, radius = held.column("obj").combine_chunks(), held.column("radius").to_numpy(zero_copy_only=False)
                search = Nearest(held.column("qid").combine_chunks(), matrix(own, len(own[0])), radius, k, exclude_self)
                asked = []
            for lo in range(0, batch.num_rows, TILE_ROWS):
                piece = batch.slice(lo, TILE_ROWS)
                search.add(matrix(piece.column("obj"), search.table.shape[1]), piece.column("id"))
                if k is None:
                    yield from search.results()
        if search:
            yield from search.results()

    return dealt.mapInArrow(near, f"qid {kinds['qid'].simpleString()}, id {kinds['id'].simpleString()}, dist double")
