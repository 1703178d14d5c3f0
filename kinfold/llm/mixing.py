"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight at the start and at the end of training; between them
the weight runs in a straight line, so its integral over training time is the
mean of both and its cumulative demand a quadratic.  Sources share the budget by
integrated weight, no source beyond ``max_repeat`` times its size.  Documents of
a source lie in a fixed hashed order; the words before a document, put into the
inverse of the source's cumulative demand, give its training position, and a
range sort by position yields the training order.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.plans.names import spare_names
from kinfold.plans.staging import stage

#: Rows that any bucket may hold, however few a source has.
ROOM = 1000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, ramps: DataFrame, max_repeat: int) -> DataFrame:
    """Words to take per source: the budget by integrated weight, capped, the rest reshared.

    ``sizes``: (__src, __ssize, __sdocs), one row per source; ``ramps``: (__src,
    __w0, __w1).  Capped sources are a prefix in the order of size over weight,
    so one running sum finds the level at which all is given out: that of the first
    source which stays under its cap, the largest such level.  A source of weight 0
    gets nothing, whatever the others can't take.  All sources meet in one task, as a
    few names do; a table of millions of sources would have to be grouped first.
    """
    every = W.partitionBy()
    order = every.orderBy((F.col("__ssize") / F.nullif(F.col("__w"), F.lit(0.0))).asc_nulls_last(), "__w", F.col("__src").asc_nulls_last())
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = (
        sizes.join(ramps, sizes["__src"].eqNullSafe(ramps["__rsrc"]))
        .drop("__rsrc")
        .withColumn("__w", (F.col("__w0") + F.col("__w1")) / 2)
        .withColumn("__total", F.sum("__ssize").over(every))
        # the level if all sources before this one are capped and none from here on
        .withColumn(
            "__level",
            (F.col("__total") - max_repeat * F.coalesce(F.sum("__ssize").over(before), F.lit(0)))
            / F.nullif(F.sum("__w").over(after), F.lit(0.0)),
        )
        .withColumn("__free", (F.col("__w") > 0) & (max_repeat * F.col("__ssize") >= F.col("__level") * F.col("__w")))
        .withColumn("__at", F.max(F.when(F.col("__free"), F.col("__level"))).over(every))
    )
    return level.withColumn(
        "__target",
        F.when(F.col("__w") == 0, F.lit(0.0))
        .when(F.col("__at").isNull(), (max_repeat * F.col("__ssize")).cast("double")).otherwise(
            F.least((max_repeat * F.col("__ssize")).cast("double"), F.col("__at") * F.col("__w"))
        ),
    )


def cycled_ramps(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point order of the source, null last.

    The n-th source runs from half its weight to one and a half times it, or the
    other way round for even n, so that the mixture shifts over time while every
    integral is the plain weight.
    """
    rank = F.row_number().over(W.orderBy(F.col("__src").asc_nulls_last())) - 1
    weight = (rank % 3 + 1).cast("double")
    rising = rank % 2 == 0
    return sources.select(
        F.col("__src").alias("__rsrc"),
        (weight * F.when(rising, 0.5).otherwise(1.5)).alias("__w0"),
        (weight * F.when(rising, 1.5).otherwise(0.5)).alias("__w1"),
    )


def _position(before: Column) -> Column:
    """When a source's demand reaches ``before`` words.

    It grows as w0 t + (w1 - w0) t^2 / 2, up to the target at t = 1; solved for t.
    """
    filled = F.least(before / F.nullif(F.col("__target"), F.lit(0.0)), F.lit(1.0)) * (F.col("__w0") + F.col("__w1")) / 2
    slope = F.col("__w1") - F.col("__w0")
    root = F.sqrt(F.greatest(F.col("__w0") * F.col("__w0") + 2 * slope * filled, F.lit(0.0)))
    level = filled / F.nullif(F.col("__w0"), F.lit(0.0))
    return F.round(F.when(slope == 0, level).otherwise((root - F.col("__w0")) / F.nullif(slope, F.lit(0.0))), 9) + F.lit(0.0)


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__group``, which follows the order of (__order, __id, __size) within a source.

    A bucket is a group, unless ids repeat or are null so often that it holds many times
    the rows it should.  Such a bucket is parted by id and size, and rows of the same id
    and size, which are alike, by a hash.
    """
    due = F.ceil(F.sqrt("__sdocs")) + ROOM
    hot = stage(
        rows.groupBy("__tsrc", "__bucket", "__sdocs").agg(F.count("*").alias("__n")).where(F.col("__n") > 4 * due)
        .select(F.col("__tsrc").alias("__hsrc"), F.col("__bucket").alias("__hbucket")),
        "hot",
    )
    kinds = rows.schema["__id"].dataType.simpleString()
    group = lambda order, id_, size, part: F.struct(
        "__bucket", order.alias("order"), id_.cast(kinds).alias("id"), size.cast("long").alias("size"), part.cast("int").alias("part")
    )
    whole = group(F.lit(""), F.lit(None), F.lit(0), F.lit(0))
    if hot.isEmpty():
        return rows.withColumn("__group", whole)
    flagged = rows.join(hot, rows["__tsrc"].eqNullSafe(F.col("__hsrc")) & (F.col("__bucket") == F.col("__hbucket")), "left")
    alike = ["__tsrc", "__bucket", "__order", "__id", "__size"]
    parts = stage(
        flagged.where("__hbucket IS NOT NULL").groupBy(*alike, "__sdocs").agg(F.count("*").alias("__n"))
        .select(*[F.col(c).alias(f"{c}_h") for c in alike], F.ceil(F.col("__n") / due).alias("__parts")),
        "alike",
    )
    same = F.lit(True)
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_h"))
    part = F.pmod(F.xxhash64("__row"), F.col("__parts"))
    met = flagged.join(parts, same, "left")
    split = group(F.col("__order"), F.col("__id"), F.col("__size"), part)
    return met.withColumn("__group", F.when(F.col("__hbucket").isNull(), whole).otherwise(split)).select(*rows.columns, "__group")


def mix_sources(
    docs: DataFrame,
    ramps=cycled_ramps,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_repeat: int = 3,
    prefix: str = "mix_",
    row_col: str | None = None,
) -> DataFrame:
    """One row per document with what the mixture takes of it, and its place in training.

    ``ramps`` maps a DataFrame (__src) of the distinct sources to (__rsrc, __w0,
    __w1).  Adds to ``id_col`` and ``source_col``: ``{prefix}size`` words,
    ``{prefix}source_size``, ``{prefix}target``, ``{prefix}taken`` words (whole
    passes over the source, then its hashed prefix up to the target; the last
    document is taken in part), ``{prefix}position`` in [0, 1] of the first copy
    (null when none is taken), ``{prefix}copies``, the words taken rounded to whole
    documents, and ``{prefix}positions``, one for each copy.  Reruns agree: the
    order is by md5 of the id.  ``row_col``, a unique key of the rows if there is
    one, comes back and settles ties.

    Defined cases: null text has size 0; a null source is a source of its own,
    the last; documents of size 0 are taken 0 words; rows that repeat an id count
    each; an empty table gives an empty table.

    Documents are summed in about sqrt(n) hash buckets of about sqrt(n) rows per
    source, so neither the bucket totals nor a bucket of the largest source grows
    in proportion to the data; a bucket full of null or repeated ids is parted further.  The per-source table is broadcast only if Spark
    finds its files under the broadcast threshold.
    """
    # md5 of the id: the same order in any engine; its first 32 bits pick the bucket
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    slim = stage(
        docs.select(
            F.col(id_col).alias("__id"),
            F.col(source_col).cast("string").alias("__src"),
            word_count(F.col(text_col)).alias("__size"),
            digest.alias("__order"),
            # rows of one id and size are alike, so any number that tells them apart will do
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("__row"),
        ),
        "sizes",
    )
    sizes = stage(
        slim.groupBy("__src").agg(F.sum("__size").alias("__ssize"), F.count("*").alias("__sdocs")),
        "sources",
    )
    targets = stage(
        source_targets(sizes, ramps(sizes.select("__src")), max_repeat)
        .select("__src", "__ssize", "__sdocs", "__target", "__w0", "__w1")
        .withColumnRenamed("__src", "__tsrc"),
        "targets",
    )
    n_buckets = F.ceil(F.sqrt(F.col("__sdocs")))
    share = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") / F.lit(float(2**32))
    rows = slim.join(targets, slim["__src"].eqNullSafe(targets["__tsrc"])).withColumn(
        "__bucket", F.floor(share * n_buckets).cast("long")
    )
    rows = _grouped(rows)
    totals = rows.groupBy("__tsrc", "__group").agg(F.sum("__size").alias("__bsize"))
    by_source = W.partitionBy("__tsrc").orderBy("__group")
    starts = totals.select(
        F.col("__tsrc").alias("__bsrc"),
        F.col("__group").alias("__bno"),
        (F.sum("__bsize").over(by_source) - F.col("__bsize")).alias("__bstart"),
    )
    within = W.partitionBy("__tsrc", "__group").orderBy("__order", "__id", "__size", "__row")
    before = F.col("__bstart") + F.col("__run") - F.col("__size")
    passes = F.least(F.floor(F.col("__target") / F.col("__ssize")), F.lit(max_repeat)).cast("long")
    rest = F.round(F.col("__target") - F.col("__passes") * F.col("__ssize")).cast("long")
    extra = F.greatest(F.least(F.col("__rest") - F.col("__before"), F.col("__size")), F.lit(0).cast("long"))
    copies = F.when(
        F.col("__size") > 0, F.col("__passes") + (2 * extra >= F.col("__size")).cast("long")
    ).otherwise(F.lit(0).cast("long"))
    return (
        rows.withColumn("__run", F.sum("__size").over(within.rowsBetween(W.unboundedPreceding, 0)))
        .join(starts, F.col("__tsrc").eqNullSafe(F.col("__bsrc")) & F.col("__group").eqNullSafe(F.col("__bno")))
        .withColumn("__before", before)
        .withColumn("__passes", F.when(F.col("__ssize") > 0, passes).otherwise(F.lit(0).cast("long")))
        .withColumn("__rest", F.when(F.col("__ssize") > 0, rest).otherwise(F.lit(0).cast("long")))
        .withColumn("__taken", F.col("__passes") * F.col("__size") + extra)
        .select(
            F.col("__id").alias(id_col),
            F.col("__src").alias(source_col),
            F.col("__size").alias(f"{prefix}size"),
            F.col("__ssize").alias(f"{prefix}source_size"),
            F.col("__target").alias(f"{prefix}target"),
            F.col("__taken").alias(f"{prefix}taken"),
            F.when(F.col("__taken") > 0, _position(F.col("__before"))).alias(f"{prefix}position"),
            copies.alias(f"{prefix}copies"),
            F.when(
                copies > 0,
                F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda c: _position(F.col("__before") + c * F.col("__ssize"))),
            ).otherwise(F.array().cast("array<double>")).alias(f"{prefix}positions"),
            *([F.col("__row").alias(row_col)] if row_col else []),
        )
    )


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a unique key of the rows, staged because the key differs when it is computed again, and its name."""
    (row_col,) = spare_names(docs, "row_key")
    return stage(docs.withColumn(row_col, F.monotonically_increasing_id()), "rows"), row_col


def training_order(
    docs: DataFrame, mixed: DataFrame, prefix: str = "mix_", id_col: str = "doc_id", row_col: str | None = None
) -> DataFrame:
    """The rows of ``docs``, as many copies as the mixture takes, range-sorted by training position.

    The copies are joined to the documents by ``row_col``, a unique key in both,
    which stays out of the result.  Without it they are joined by id, and ids have to
    be unique and not null.  Columns of ``docs`` may have any names.
    """
    key = row_col or id_col
    which, at = spare_names(docs, "taken", "at")
    taken = mixed.where(F.col(f"{prefix}copies") > 0).select(F.col(key).alias(which), F.explode(f"{prefix}positions").alias(at))
    own = [f"`{c}`" for c in docs.columns if c != row_col]
    order = [at, f"`{id_col}`", which] if row_col else [at, which]
    return docs.join(taken, docs[key] == F.col(which)).orderBy(*order).select(*own)
