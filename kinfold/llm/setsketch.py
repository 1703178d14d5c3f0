"""Near-duplicates by SetSketch registers.

Each document's distinct word shingles are sketched in registers: minima of
exponential values, spaced exponentially and truncated to 16 bits, so that
sketches of parts merge by maximum and equal registers are as frequent as shared
shingles.  Bands of registers propose documents; a joint likelihood over the
counts of larger, smaller and equal registers estimates the similarity; pairs
that may reach the threshold are verified on their full shingle sets.

Large groups are not expanded into all pairs:

1. documents with the same set are one class, of which one document goes on;
2. each band's bucket is compared with its most central member only (the one
   with the most company over all bands), and the links are joined to components;
3. what is left are bucket mates in different components.  In small buckets these
   are pairs like others; in large ones blocks of members outside the bucket's
   largest component meet blocks of all members, with full sets, and give back
   only what joins components.

No bucket, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinfold.llm.components import connected_components
from kinfold.llm.words import distinct_by_doc, grams, mix64, small_batches, text_words
from kinfold.plans.staging import stage, unstage

WIDTH = 5
REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
LIMIT = 65535
#: An estimate this far below the threshold is over five standard errors away.
MARGIN = 0.2
#: Buckets with more members than this are compared block by block.
FEW = 32
#: Members of a block, and shingles in it (but 8 members at least).
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 18

_MULTIPLY = np.random.default_rng(41).integers(1, 2**63, REGISTERS, dtype=np.uint64) | np.uint64(1)


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of REGISTERS 16-bit registers per set; ``starts`` are the sets' first hashes, none empty."""
    low = np.empty((len(starts), REGISTERS), np.uint64)
    for i, m in enumerate(_MULTIPLY):  # an odd multiple is a new order of well mixed hashes
        np.minimum.reduceat(hashes * m, starts, out=low[:, i])
    least = -np.log1p(-((low.astype(np.float64) + 0.5) / 2.0**64)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LIMIT).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs of sketches, by the counts of larger, smaller and equal registers."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)

    def larger(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = larger(u - v * grid), larger(v - u * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    fit = more * np.log(up) + less * np.log(down) + (REGISTERS - more - less) * np.log(same)
    return np.take_along_axis(grid, fit.argmax(1)[:, None], 1)[:, 0]


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, starts = text_words(batch.column("__text"))
    return distinct_by_doc(*grams(words, starts, WIDTH, whole=True), batch.num_rows)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "__text", 4 << 20):
        hashes, bounds = _shingles(batch)
        full = np.flatnonzero(np.diff(bounds))
        first, second = (np.zeros(batch.num_rows, np.uint64) for _ in range(2))
        regs = [None] * batch.num_rows
        if full.size:
            starts = bounds[full]
            first[full] = np.add.reduceat(hashes, starts)
            second[full] = np.add.reduceat(mix64(hashes ^ np.uint64(0x5E75)), starts)
            # a few thousand hashes at a time stay in the cache through all registers
            parts = np.unique(np.searchsorted(bounds[full], np.arange(0, len(hashes), 1 << 15)))
            for lo, hi in zip(parts, [*parts[1:], len(full)]):
                if lo < hi:
                    own = bounds[full[lo] : full[hi - 1] + 2]
                    part = registers(hashes[own[0] : own[-1]], starts[lo:hi] - own[0])
                    for k, row in zip(full[lo:hi], part):
                        regs[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("__id"),
                pa.array(np.diff(bounds).astype(np.int64)),
                pa.array(first.view(np.int64)),
                pa.array(second.view(np.int64)),
                pa.array(regs, pa.binary()),
            ],
            names=["__id", "__n", "__d1", "__d2", "__regs"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "__text", 4 << 20):
        hashes, bounds = _shingles(batch)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), lists, batch.column("__regs")], names=["__id", "__set", "__regs"]
        )


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    left, right = (np.frombuffer(b"".join(x), "<u2").reshape(len(x), REGISTERS) for x in (a, b))
    return pd.Series(estimate(left, right, na.to_numpy(float), nb.to_numpy(float)))


def _band_keys() -> list[Column]:
    return [
        F.xxhash64(F.lit(k), F.substring("__regs", 2 * ROWS * k + 1, 2 * ROWS))
        for k in range(REGISTERS // ROWS)
    ]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids that reach the threshold, by estimate first and then on full sets."""
    side = lambda k: sets.select(
        F.col("__id").alias(k), *[F.col(f"__{x}").alias(f"{k}_{x}") for x in ("set", "regs")]
    )
    both = F.size(F.array_intersect("a_set", "b_set"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .withColumn("__na", F.size("a_set"))
        .withColumn("__nb", F.size("b_set"))
        .where(_estimate("a_regs", "b_regs", "__na", "__nb") >= percent / 100 - MARGIN)
        .withColumn("__both", both)
        .where(100 * F.col("__both") >= percent * (F.col("__na") + F.col("__nb") - F.col("__both")))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 times their common shingles are at least
    ``percent`` (80 or more) times all their shingles; component_id is the smallest id
    reachable over links, kept tells whether that is the row's own id.

    Defined cases: texts with fewer than five words are one shingle, the whole
    sequence; null texts and texts without words have an empty set and link with
    nothing; a row with a null id links with nothing, has a null component and is
    kept; rows that repeat an id are one document, and a ValueError tells of an id
    with several sets of shingles; empty tables give empty tables.  The ids must be of an ordered type.

    Bands of 4 out of 128 registers miss a pair at 0.85 with probability
    (1 - 0.85^4)^32 < 1e-10.
    """
    if percent < 80:
        raise ValueError("near-duplicates start at a similarity of 0.8")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = texts.schema["__id"].dataType.simpleString()
    sketches = stage(
        texts.mapInArrow(_sketch, f"__id {id_type}, __n long, __d1 long, __d2 long, __regs binary"), "sketches"
    )
    own = ["__n", "__d1", "__d2"]
    kinds = sketches.where("__id IS NOT NULL").groupBy("__id").agg(F.min(F.struct(*own)).alias("lo"), F.max(F.struct(*own)).alias("hi"))
    if (odd := kinds.where("lo <> hi").first()) is not None:
        raise ValueError(f"several texts have the id {odd['__id']}")
    reps = stage(
        sketches.where("__n > 0 AND __id IS NOT NULL")
        .groupBy(*own)
        .agg(F.min("__id").alias("__id"), F.first("__regs").alias("__regs")),
        "classes",
    )
    members = _bucket_members(reps)
    sets = stage(
        texts.join(reps.join(members.select("__id").distinct(), "__id").select("__id", "__regs"), "__id")
        .dropDuplicates(["__id"])
        .mapInArrow(_sets, f"__id {id_type}, __set array<long>, __regs binary"),
        "sets",
    )
    pivots = members.groupBy("__key").agg(
        F.max_by(F.struct(F.col("__id").alias("b"), F.col("__n").alias("__bn")), F.struct("__company", F.xxhash64("__id"))).alias("__pivot")
    ).select("__key", "__pivot.*")
    stars = (
        members.join(pivots, "__key").where(F.col("__id") != F.col("b")).where(_sizes_allow("__n", "__bn", percent))
        .select(F.col("__id").alias("a"), "b").distinct()
    )
    links = stage(_verified(stars, sets, percent), "links")
    first = connected_components(links)
    mixed = _mixed(members, first)
    unstage(members, links)
    more = stage(_verified(_few(mixed, percent), sets, percent).union(_many(mixed, sets, percent)), "links")
    if more.isEmpty():
        final = first
    else:
        final = connected_components(
            more.union(first.select(F.col("node").alias("a"), F.col("component").alias("b")))
        )
    unstage(mixed, sets, more)
    classes = reps.select(*own, F.col("__id").alias("__rep"))
    joined = sketches.join(classes, own, "left").join(
        final, F.col("__rep") == F.col("node"), "left"
    )
    component = F.when(F.col("__n") > 0, F.coalesce("component", "__rep")).otherwise(F.col("__id"))
    component = F.when(F.col("__id").isNotNull(), component)
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("__id"), F.lit(True)).alias("kept"),
    )


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _bucket_members(reps: DataFrame) -> DataFrame:
    """(__id, __n, __key, __company) for members of buckets of two or more; a key tells its band, too."""
    banded = reps.select("__id", "__n", F.explode(F.array(*_band_keys())).alias("__key"))
    shared = stage(
        banded.groupBy("__key").agg(F.count("*").alias("__mates")).where("__mates > 1"), "buckets"
    )
    members = stage(banded.join(shared, "__key"), "members")
    company = members.groupBy("__id").agg(F.sum("__mates").alias("__company"))
    full = stage(members.join(company, "__id"), "members")
    unstage(shared, members)
    return full


def _mixed(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members of buckets with several components: (__id, __n, __key, __mates, __comp, __main, __asks, __blocks).

    ``__main`` is the bucket's largest component, which needs no comparison inside.
    ``__blocks`` counts the blocks of all members, ``__asks`` those of the members outside it.
    """
    labelled = stage(
        members.join(components, F.col("__id") == F.col("node"), "left").select(
            "__id", "__n", "__key", "__mates", F.coalesce("component", "__id").alias("__comp")
        ),
        "labelled",
    )
    shares = labelled.groupBy("__key", "__comp").agg(F.count("*").alias("__k"), F.max("__n").alias("__most"))
    mixed = shares.groupBy("__key").agg(
        F.count("*").alias("__comps"),
        F.max_by("__comp", F.struct("__k", "__comp")).alias("__main"),
        (F.sum("__k") - F.max("__k")).alias("__outside"),
        F.max("__most").alias("__most"),
    ).where("__comps > 1")
    rows = F.greatest(F.lit(8), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_SHINGLES / F.col("__most"))))
    out = stage(
        labelled.join(mixed, "__key")
        .withColumn("__blocks", F.ceil(F.col("__mates") / rows).cast("int"))
        .withColumn("__asks", F.ceil(F.col("__outside") / rows).cast("int"))
        .drop("__comps", "__most", "__outside"),
        "mixed",
    )
    unstage(labelled)
    return out


def _few(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) in different components of buckets with few members."""
    few = mixed.where(F.col("__mates") <= FEW)
    side = lambda k: few.select("__key", *[F.col(f"__{x}").alias(f"{k}_{x}") for x in ("id", "n", "comp")])
    return (
        side("a").join(side("b"), "__key")
        .where((F.col("a_comp") != F.col("b_comp")) & (F.col("a_id") < F.col("b_id")))
        .where(_sizes_allow("a_n", "b_n", percent))
        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
        .distinct()
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct arrays, by blocks of common values."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    common = np.intersect1d(a, b)
    at_a, at_b = (np.searchsorted(common, x) for x in (a, b))
    in_a, in_b = (np.append(common, 0)[at] == x if len(common) else np.zeros(len(x), bool) for at, x in ((at_a, a), (at_b, b)))
    in_a &= at_a < len(common)
    in_b &= at_b < len(common)
    row_a, at_a, row_b, at_b = row_a[in_a], at_a[in_a], row_b[in_b], at_b[in_b]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(common), width):
        dense = []
        for rows, at, n in ((row_a, at_a, len(left)), (row_b, at_b, len(right))):
            own = (at >= lo) & (at < lo + width)
            m = np.zeros((n, width), np.float32)
            m[rows[own], at[own] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _many(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in buckets with many members, compared block by block on full sets.

    Members outside the bucket's largest component meet all others, so the copies of
    sets are as many as members times blocks outside, not times all blocks.  A block
    holds BLOCK_ROWS members or BLOCK_SHINGLES shingles; a pair of blocks gives what
    its links join, no more rows than it has members.
    """
    many = mixed.where(F.col("__mates") > FEW).join(sets.select("__id", "__set"), "__id")
    own = lambda blocks: F.pmod(F.xxhash64("__id"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    asks = many.where(F.col("__comp") != F.col("__main"))
    key = ["__key", "__i", "__j"]
    left = asks.withColumn("__i", own("__asks")).withColumn("__j", each("__blocks"))
    right = many.withColumn("__i", each("__asks")).withColumn("__j", own("__blocks"))
    pick = ["__id", "__comp", "__set"]
    id_type = mixed.schema["__id"].dataType.simpleString()

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []})
        if not len(a) or not len(b):
            return none
        a = a.rename(columns=lambda c: c[1:])
        sets_a, sets_b = list(a["__set"]), list(b["__set"])
        n_a, n_b = (np.array([len(s) for s in x]) for x in (sets_a, sets_b))
        both = overlaps(sets_a, sets_b)
        linked = 100 * both >= percent * (n_a[:, None] + n_b[None, :] - both)
        linked &= a["__comp"].to_numpy()[:, None] != b["__comp"].to_numpy()[None, :]
        if not linked.any():
            return none
        # smallest labels over the links of this pair of blocks: a tree in place of all links
        id_a, id_b = a["__id"].to_numpy(), b["__id"].to_numpy()
        rank = {x: k for k, x in enumerate(sorted({*id_a.tolist(), *id_b.tolist()}))}
        names = list(rank)
        lab_a, lab_b = (np.array([rank[x] for x in y.tolist()]) for y in (id_a, id_b))
        own_a, own_b = lab_a.copy(), lab_b.copy()
        while True:
            low = np.minimum(lab_a, np.where(linked, lab_b[None, :], len(names)).min(1))
            low_b = np.minimum(lab_b, np.where(linked, low[:, None], len(names)).min(0))
            if (low == lab_a).all() and (low_b == lab_b).all():
                break
            lab_a, lab_b = low, low_b
        out = {(names[x], names[y]) for o, l in ((own_a, lab_a), (own_b, lab_b)) for x, y in zip(o, l) if x != y}
        return pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]})

    # the two sides come from one table, so the left one gets columns of its own
    left = left.select(*[F.col(c).alias(f"l{c}") for c in key], *[F.col(c).alias(f"l{c}") for c in pick])
    return (
        left.groupBy(*[f"l{c}" for c in key]).cogroup(right.select(*key, *pick).groupBy(*key))
        .applyInPandas(compare, f"a {id_type}, b {id_type}")
    )
