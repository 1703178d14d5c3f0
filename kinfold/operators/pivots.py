"""Pivots, the distances to them, and cells of objects around them.

Pivots are (pivot, id, obj), numbered from 0; their number is bounded by what the
caller asks for.  Assigned objects are (id, obj, cell, pdist); cells are (cell,
pobj, lo, hi, cnt) with the ring [lo, hi] of the distances of their objects.

Cells form a tree: those of the pivots have their numbers, and the parts of cell c
are numbered from (c + 1) * MOST_PIVOTS on, so no two cells of any level share a
number and root_cell() leads back to the pivot.  A cell's own pivot is ``pobj``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.metrics import Metric, l2, metric_of, usable
from kinfold.operators.nearest import TOGETHER, chosen, matrix
from kinfold.plans.staging import stage, unstage

#: Pivots are held by the driver and by expressions; no more than this (2^10).
MOST_PIVOTS = 1024
#: Objects that a sampled traversal holds in one row.
MOST_SAMPLE = 16_384
#: Pairs of objects and pivots beyond which the objects are dealt over all tasks first.
SPREAD_PAIRS = 1 << 26
#: Parts that a cell is split into at once.
MOST_PARTS = 64


def _literal(obj) -> Column:
    if isinstance(obj, (list, tuple)):
        return F.array(*[F.lit(x) for x in obj])
    return F.lit(obj)


def pivots_fft(df: DataFrame, m: int, metric: str | Metric = "l2", every: int = 8) -> DataFrame:
    """Farthest-first traversal from the smallest id: m rounds, each a distributed maximum.

    Ties go to the smaller id; it stops early when all objects are pivots or equal
    to one.  The distance to the nearest pivot is written every few rounds, so the
    expression of a round stays short.
    """
    if m > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    dist = metric_of(metric)
    rest = usable(df, "id", "obj").select("id", "obj")
    rest = rest.withColumn("__near", F.lit(float("inf")))
    found: list = []
    fresh: list[Column] = []
    while len(found) < m:
        near = F.least("__near", *[dist(F.col("obj"), p) for p in fresh]) if fresh else F.col("__near")
        row = rest.agg(
            F.max_by(F.struct("id", "obj", near.alias("near")), F.struct(near.alias("near"), (-F.col("id")).alias("low"))).alias("far")
        ).first()["far"]
        if row is None or (found and row["near"] <= 0):
            break
        found.append((len(found), row["id"], row["obj"]))
        fresh.append(_literal(row["obj"]).cast(df.schema["obj"].dataType))
        if len(fresh) == every and len(found) < m:
            rest = stage(rest.withColumn("__near", F.least("__near", *[dist(F.col("obj"), p) for p in fresh])), "near")
            fresh = []
    kind = df.schema["obj"].dataType.simpleString()
    return df.sparkSession.createDataFrame(found, f"pivot int, id long, obj {kind}")


def _fold(objs: Column, near: Column, picked: Column, last: Column, rounds: Column, dist: Metric) -> Column:
    """Places (from 0) of farthest-first picks in an array of structs with ``obj``, after those in ``picked``.

    ``near`` holds each one's distance to what was picked before; ``last`` is the
    place of a pick that isn't in ``near`` yet, or -1.
    """

    def step(state, _):
        seen = F.when(state["last"] < 0, state["near"]).otherwise(
            F.zip_with(state["near"], objs, lambda d, o: F.least(d, dist(o["obj"], F.element_at(objs, F.greatest(state["last"], F.lit(0)) + 1)["obj"])))
        )
        # equal distances go to the smaller id, as the array is in order of ids
        far = (F.array_position(seen, F.array_max(seen)) - 1).cast("int")
        more = F.array_max(seen) > 0
        return F.struct(
            F.when(more, F.concat(state["picked"], F.array(far))).otherwise(state["picked"]).alias("picked"),
            seen.alias("near"), far.alias("last"),
        )

    start = F.struct(picked.alias("picked"), near.alias("near"), last.alias("last"))
    return F.aggregate(F.when(rounds > 0, F.sequence(F.lit(1), rounds)).otherwise(F.array().cast("array<int>")), start, step)["picked"]


def _from_row(x: np.ndarray, at: int) -> np.ndarray:
    """Distances of all rows from one, summed as in l2()."""
    with np.errstate(invalid="ignore", over="ignore"):
        total = np.zeros(len(x))
        for j in range(x.shape[1]):
            total += (x[:, j] - x[at, j]) ** 2
        return np.sqrt(total)


def _farthest(x: np.ndarray, m: int) -> list[int]:
    """The same picks as _fold() from the first row on, for Euclidean distances."""
    picked, near = [0], np.full(len(x), np.inf)
    while len(picked) < m:
        near = np.fmin(near, _from_row(x, picked[-1]))
        far = int(near.argmax())
        if not near[far] > 0:
            break
        picked.append(far)
    return picked


def _farther(x: np.ndarray, near: np.ndarray, rounds: int) -> list[int]:
    """The same ``rounds`` picks as _fold() after those that ``near`` holds, for Euclidean distances; NaN is the farthest there."""
    picked = []
    for _ in range(rounds):
        far = int(near.argmax())
        if not (near[far] > 0 or np.isnan(near[far])):
            break
        picked.append(far)
        near = np.fmin(near, _from_row(x, far))
    return picked


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows over all shuffle partitions: a table of a few small files gives few tasks, however long its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pivots_sampled(df: DataFrame, m: int, metric: str | Metric = "l2", sample: int = 2048) -> DataFrame:
    """Farthest-first traversal of the ``sample`` objects with the smallest id hashes, in one job.

    The rounds run over the sample alone, whose size is bounded by the caller: in
    numpy for Euclidean distances, else as a fold over an array.  Cells are assigned
    to all objects afterwards, so searches stay exact; the pivots are only as spread
    as the sample.
    """
    hashed = F.sha2(F.col("id").cast("string"), 256)
    rows = usable(df, "id", "obj").select("id", "obj").orderBy(hashed, "id").limit(min(sample, MOST_SAMPLE))
    if metric in ("l2", l2):
        found = sorted((r["id"], r["obj"]) for r in rows.collect())
        picks = _farthest(np.array([o for _, o in found], float), m) if found else []
        kinds = [df.schema[c].dataType.simpleString() for c in ("id", "obj")]
        return df.sparkSession.createDataFrame([(k, *found[at]) for k, at in enumerate(picks)], f"pivot int, id {kinds[0]}, obj {kinds[1]}")
    held = rows.agg(F.array_sort(F.collect_list(F.struct("id", "obj"))).alias("objs")).where(F.size("objs") > 0)
    objs = F.col("objs")
    picks = _fold(objs, F.transform(objs, lambda o: F.lit(float("inf"))), F.array(F.lit(0)), F.lit(0), F.lit(m - 1), metric_of(metric))
    picked = held.select("objs", picks.alias("picked")).select("objs", F.posexplode("picked").alias("pivot", "at"))
    one = F.element_at(objs, F.col("at") + 1)
    return picked.select("pivot", one["id"].alias("id"), one["obj"].alias("obj"))


def pivots_coreset(df: DataFrame, m: int, chunk: int = 4096) -> DataFrame:
    """m pivots for Euclidean distances by composable core-sets: every object is seen, in as many jobs whatever m is.

    Tasks pick m objects of each ``chunk`` of rows by farthest-first traversal; the
    picks are a table that is picked from again until MOST_SAMPLE rows hold it, and a
    last traversal of those, from the smallest id, gives the pivots.  The picks of a chunk
    are within twice the best radius of all of it, and so are the last ones of the
    picks: the covering radius is at most four times the best one, and so at most four
    times the exact traversal's, plus two for each further round.
    """
    if m > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    kinds = [df.schema[c].dataType.simpleString() for c in ("id", "obj")]
    size = max(chunk, 2 * m)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def picked() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            own = part.column("obj").combine_chunks()
            return part.take(pa.array(_farthest(matrix(own, len(own[0])), m))).combine_chunks().to_batches()[0]

        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                held.append(batch.slice(lo, size))
                n += held[-1].num_rows
                if n >= size:
                    yield picked()
                    held, n = [], 0
        if n:
            yield picked()

    core = usable(df, "id", "obj").select("id", "obj")
    before = None
    while True:
        after = stage(core.mapInArrow(pick, f"id {kinds[0]}, obj {kinds[1]}"), "core")
        if before is not None:
            unstage(before)
        n = after.count()
        if n <= MOST_SAMPLE:
            break
        before, core = after, after.repartition(max(1, -(-n // (8 * size))))
    found = sorted((r["id"], r["obj"]) for r in after.collect())  # MOST_SAMPLE rows at most
    picks = _farthest(np.array([o for _, o in found], float), m) if found else []
    return df.sparkSession.createDataFrame([(k, *found[at]) for k, at in enumerate(picks)], f"pivot int, id {kinds[0]}, obj {kinds[1]}")


def pivots_hash(df: DataFrame, m: int, seed: str = "0") -> DataFrame:
    """m pivots in the order of a hash of their ids: the baseline to compare with."""
    order = F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{seed}")), 256)
    first = usable(df, "id", "obj").select("id", "obj", order.alias("__h")).orderBy("__h").limit(m)
    return first.select(
        (F.row_number().over(W.orderBy("__h")) - 1).alias("pivot"), "id", "obj"
    )


def _rows(pivots: DataFrame) -> list:
    rows = pivots.orderBy("pivot").limit(MOST_PIVOTS + 1).collect()
    if len(rows) > MOST_PIVOTS:
        raise ValueError(f"at most {MOST_PIVOTS} pivots")
    return rows


def _objects(pivots: DataFrame) -> list[Column]:
    kind = pivots.schema["obj"].dataType
    return [_literal(r["obj"]).cast(kind) for r in _rows(pivots)]


def pivot_table(df: DataFrame, pivots: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """``df`` with ``pdists``: the distances to all pivots, in their order.  No shuffle, no join."""
    dist = metric_of(metric)
    return df.withColumn("pdists", F.array(*[dist(F.col("obj"), p) for p in _objects(pivots)]))


def assign_cells(df: DataFrame, pivots: DataFrame, metric: str | Metric = "l2") -> DataFrame:
    """(id, obj, cell, pdist): every object in the cell of its nearest pivot, ties to the lower number.

    Euclidean distances go by matrix products over batches of rows, others by one
    expression over all pivots.  No shuffle, no join.
    """
    df = usable(df, "id", "obj").select("id", "obj")
    if metric in ("l2", l2) and (rows := _rows(pivots)):
        return _assign_l2(df, rows)
    table = pivot_table(df, pivots, metric)
    low = F.array_min("pdists")
    return table.select("id", "obj", (F.array_position("pdists", low) - 1).cast("long").alias("cell"), low.alias("pdist"))


def _assign_l2(df: DataFrame, rows: list) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(np.array([r["obj"] for r in rows], float))
    numbers = np.array([r["pivot"] for r in rows], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(lo, TOGETHER)
                x = matrix(part.column("obj"), table.shape[1])
                row, at, dist = chosen(table, x, 1, np.full(len(x), np.inf))
                order = np.lexsort((at, dist, row))
                first = order[np.searchsorted(row[order], np.arange(len(x)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("obj"), pa.array(numbers[at[first]]), pa.array(dist[first])],
                    names=["id", "obj", "cell", "pdist"],
                )

    kinds = [df.schema[c].dataType.simpleString() for c in ("id", "obj")]
    return df.mapInArrow(place, f"id {kinds[0]}, obj {kinds[1]}, cell long, pdist double")


def rings(assigned: DataFrame, pivots: DataFrame) -> DataFrame:
    """(cell, pobj, lo, hi, cnt): cells that hold objects."""
    ring = assigned.groupBy("cell").agg(
        F.min("pdist").alias("lo"), F.max("pdist").alias("hi"), F.count("*").alias("cnt")
    )
    at = pivots.select(F.col("pivot").cast("long").alias("cell"), F.col("obj").alias("pobj"))
    return ring.join(F.broadcast(at), "cell").select("cell", "pobj", "lo", "hi", "cnt")  # MOST_PIVOTS rows


def choose_m(n: int, target_rows: int) -> int:
    """Cells for about ``target_rows`` objects each, as many as pivots may be; build_index() splits on from there."""
    return max(1, min(MOST_PIVOTS, -(-n // target_rows)))


def root_cell(cell: Column, depth: int = 6) -> Column:
    """The pivot's number of a cell at any level down to ``depth``."""
    up = lambda c, _: F.when(c >= MOST_PIVOTS, F.shiftright(c, 10) - 1).otherwise(c)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), cell.cast("long"), up)


def _parts_sampled(assigned: DataFrame, large: DataFrame, metric: str | Metric, sample: int) -> DataFrame:
    """(cell, subs) of the large cells, from the ``sample`` of a cell's objects with the smallest id hashes."""
    order = W.partitionBy("cell").orderBy(F.sha2(F.col("id").cast("string"), 256), "id")
    few = (
        assigned.join(large.select("cell"), "cell", "left_semi").withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= min(sample, MOST_SAMPLE))
    )
    held = few.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("id", "obj", "pdist"))).alias("objs")).join(large, "cell")
    objs = F.col("objs")
    if metric in ("l2", l2):
        held, picks = _picked_l2(held), F.col("picks")
    else:
        picks = _fold(objs, objs["pdist"], F.array().cast("array<int>"), F.lit(-1), F.col("parts") - 1, metric_of(metric))
    others = F.transform(picks, lambda at, i: F.struct((i + 1).alias("sub"), F.element_at(objs, at + 1)["obj"].alias("obj")))
    own = F.array(F.struct(F.lit(0).alias("sub"), F.col("pobj").alias("obj")))
    return held.select("cell", F.concat(own, others).alias("subs"))


def _picked_l2(held: DataFrame) -> DataFrame:
    """``held`` (cell, objs, parts, pobj) with ``picks``, cell by cell in numpy."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a cell is MOST_SAMPLE rows at most
                own = batch.slice(at, 1)
                objs = own.column("objs").flatten()
                obj = objs.field("obj")
                x, near = matrix(obj, len(obj[0])), objs.field("pdist").to_numpy(zero_copy_only=False)
                picks = pa.array([_farther(x, near, own.column("parts")[0].as_py() - 1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own.columns, picks], names=[*own.schema.names, "picks"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(pick, f"{kinds}, picks array<int>")


def _parts_of_all(assigned: DataFrame, large: DataFrame, dist: Metric, every: int = 4) -> DataFrame:
    """(cell, subs) of the large cells, from all of their objects: a round a part, each a distributed maximum by cell.

    The distances to the nearest pivot so far are written every few rounds.
    """
    large = stage(large, "large")
    rounds = (large.agg(F.max("parts")).first()[0] or 1) - 1
    rest = assigned.join(large.select("cell", "parts"), "cell").select("id", "obj", "cell", "parts", F.col("pdist").alias("__near"))
    found = [large.select("cell", F.lit(0).alias("sub"), F.col("pobj").alias("obj"))]
    for k in range(1, rounds + 1):
        order = F.struct(F.col("__near").alias("near"), (-F.col("id")).alias("low"))
        far = rest.where((F.col("parts") > k) & (F.col("__near") > 0)).groupBy("cell").agg(F.max_by("obj", order).alias("obj"))
        far = stage(far, "far")
        if far.isEmpty():
            break
        found.append(far.select("cell", F.lit(k).alias("sub"), "obj"))
        met = rest.join(far.withColumnRenamed("obj", "__far"), "cell", "left")
        near = F.when(F.col("__far").isNull(), F.col("__near")).otherwise(F.least("__near", dist(F.col("obj"), F.col("__far"))))
        rest = met.select("id", "obj", "cell", "parts", near.alias("__near"))
        if k % every == 0 and k < rounds:
            rest = stage(rest, "near")
    picked = found[0]
    for part in found[1:]:
        picked = picked.unionByName(part)
    return picked.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("sub", "obj"))).alias("subs"))


def split_cells(
    assigned: DataFrame, cells: DataFrame, target_rows: int, metric: str | Metric = "l2", most: int = MOST_PARTS, sample: int | None = 2048,
    over: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(assigned, cells) with cells over ``target_rows`` split into up to ``most`` parts, all in one pass; with ``over`` only those over that many.

    A large cell's parts have pivots of their own: the cell's, and others by
    farthest-first traversal of the ``sample`` of its objects with the smallest id
    hashes, or of all of its objects where ``sample`` is None.  Objects go to the nearest pivot of their own cell only, so afterwards
    only the ring test is sound, not the half-distance bound.  Cells that are small
    keep their number and pivot; a cell of equal objects stays whole.
    """
    dist = metric_of(metric)
    parts = F.least(F.ceil(F.col("cnt") / target_rows), F.lit(min(most, MOST_PIVOTS))).cast("int")
    # objects all at distance 0 are equal to the pivot and can't be parted
    large = cells.where((F.col("cnt") > (target_rows if over is None else over)) & (F.col("hi") > 0)).select("cell", "pobj", parts.alias("parts"))
    subs = _parts_of_all(assigned, large, dist) if sample is None else _parts_sampled(assigned, large, metric, sample)
    subs = stage(subs.where(F.size("subs") > 1), "parts")
    near = F.array_min(F.transform("subs", lambda s: F.struct(dist(F.col("obj"), s["obj"]).alias("d"), s["sub"].alias("sub"))))
    number = lambda sub: (F.col("cell") + 1) * MOST_PIVOTS + sub
    moved = (
        assigned.join(subs, "cell", "left")
        .withColumn("__near", F.when(F.col("subs").isNotNull(), near))
        .select(
            "id", "obj",
            F.when(F.col("__near").isNull(), F.col("cell")).otherwise(number(F.col("__near.sub"))).cast("long").alias("cell"),
            F.coalesce("__near.d", "pdist").alias("pdist"),
        )
    )
    moved = stage(moved, "split")
    spots = subs.select("cell", F.inline("subs").alias("sub", "pobj")).select(number(F.col("sub")).cast("long").alias("cell"), "pobj")
    ring = moved.groupBy("cell").agg(F.min("pdist").alias("lo"), F.max("pdist").alias("hi"), F.count("*").alias("cnt"))
    new = ring.join(cells.select("cell", "pobj").unionByName(spots), "cell").select("cell", "pobj", "lo", "hi", "cnt")
    return moved, new


def build_index(
    df: DataFrame, target_rows: int, metric: str | Metric = "l2", sample: int = 2048
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pivots, assigned, cells), staged, with cells of about ``target_rows`` objects whatever the size of ``df``.

    Cells with over four times as many are split, level by level, until none is left
    but cells of equal objects; a level multiplies the cells by up to MOST_PARTS.
    """
    m = choose_m(n := df.count(), target_rows)
    pivots = stage(pivots_sampled(df, m, metric, sample), "pivots")
    df = spread(df.select("id", "obj"), "id") if n * m > SPREAD_PAIRS else df
    assigned = stage(assign_cells(df, pivots, metric), "assigned")
    cells = stage(rings(assigned, pivots), "cells")
    return pivots, *split_on(assigned, cells, target_rows, metric, sample)


def split_on(
    assigned: DataFrame, cells: DataFrame, target_rows: int, metric: str | Metric = "l2", sample: int = 2048
) -> tuple[DataFrame, DataFrame]:
    """(assigned, cells), both staged, split level by level until no cell has over four times ``target_rows`` objects but cells of equal ones."""
    while True:
        n, most = cells.agg(F.count("*"), F.max(F.when(F.col("hi") > 0, F.col("cnt")))).first()
        if (most or 0) <= 4 * target_rows:
            return assigned, cells
        finer, new = split_cells(assigned, cells, target_rows, metric, sample=sample, over=4 * target_rows)
        new = stage(new, "cells")
        if new.count() == n:
            return assigned, cells
        unstage(assigned, cells)
        assigned, cells = finer, new


def _in_box(table: DataFrame, asked: DataFrame, m: int, eps: float) -> DataFrame:
    """(qid, candidates): rows (id, pdists) that differ from (qid, qdists, radius) by the radius at most in each of ``m`` distances.

    Such rows lie in a ball around the query in the space of these distances, so an
    index of that space finds their cells.  A cell whose box of distances lies inside the
    query's counts as a whole, and only those that its border crosses are read.
    """
    from kinfold.plans.pruned import wanted_cells

    _, assigned, cells = build_index(table.withColumnRenamed("pdists", "obj"), 250)
    column = lambda c: [F.col(c)[j].alias(f"{c}{j}") for j in range(m)]
    assigned = assigned.select("cell", *column("obj"))
    ends = [f(f"obj{j}").alias(f"{side}{j}") for j in range(m) for f, side in ((F.min, "least"), (F.max, "most"))]
    boxes = stage(assigned.groupBy("cell").agg(F.count("*").alias("cnt"), *ends), "boxes")
    around = asked.select("qid", F.col("qdists").alias("qobj"), ((F.col("radius") + eps) * m**0.5 * (1 + 1e-9)).alias("radius"))
    wanted = wanted_cells(cells, around, "l2").select("qid", "cell")
    asked = asked.select("qid", (F.col("radius") + eps).alias("reach"), *column("qdists"))

    def every(test) -> Column:
        out = F.lit(True)
        for j in range(m):
            out = out & test(j)
        return out

    apart = lambda c, j: F.abs(F.col(f"{c}{j}") - F.col(f"qdists{j}")) <= F.col("reach")
    inside = every(lambda j: apart("least", j) & apart("most", j))
    crosses = every(lambda j: (apart("least", j) | (F.col(f"least{j}") <= F.col(f"qdists{j}"))) & (apart("most", j) | (F.col(f"most{j}") >= F.col(f"qdists{j}"))))
    met = stage(wanted.join(asked, "qid").join(boxes, "cell").where(crosses).withColumn("inside", inside), "boxed")
    whole = met.where("inside").select("qid", F.col("cnt").alias("n"))
    read = assigned.join(met.where("NOT inside").select("cell", "qid", "reach", *[f"qdists{j}" for j in range(m)]), "cell")
    some = read.where(every(lambda j: apart("obj", j))).groupBy("qid").agg(F.count("*").alias("n"))
    counts = whole.unionByName(some).groupBy("qid").agg(F.sum("n").alias("n"))
    return asked.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0).cast("long")).alias("candidates"))


def pivot_ablation(df: DataFrame, queries: DataFrame, radii: DataFrame, choices: dict[str, DataFrame], metric: str | Metric = "l2", eps: float = 1e-9) -> DataFrame:
    """(choice, queries, mean_candidates, max_candidates): objects that the pivot filter leaves per query.

    ``radii``: (qid, radius).  An object stays if for every pivot its distance and the
    query's differ by the radius at most.
    """
    from kinfold.plans.pairs import against_all
    from kinfold.plans.pruned import ALL_PAIRS

    few, out = df.count() * queries.count() <= ALL_PAIRS, None
    for name, pivots in choices.items():
        table = pivot_table(df.select("id", "obj"), pivots, metric).select("id", "pdists")
        asked = pivot_table(queries.select("qid", F.col("qobj").alias("obj")), pivots, metric).select("qid", F.col("pdists").alias("qdists"))
        asked = asked.join(radii, "qid")
        if few:
            stays = F.forall(F.zip_with("pdists", "qdists", lambda x, y: F.abs(x - y)), lambda d: d <= F.col("radius") + eps)
            counts = against_all(table, asked).groupBy("qid").agg(F.count_if(stays).alias("candidates"))
        else:
            counts = _in_box(table, stage(asked, "asked"), pivots.count(), eps)
        part = counts.agg(
            F.lit(name).alias("choice"), F.count("*").alias("queries"),
            F.avg("candidates").alias("mean_candidates"), F.max("candidates").alias("max_candidates"),
        ).select("choice", "queries", "mean_candidates", "max_candidates")
        out = part if out is None else out.union(part)
    return out
