"""Distances between objects, as Column functions.

A metric is any function of two Columns that gives a double Column: those below, or
one of a user's own, such as a pandas UDF.  l2, edit and tanimoto_bits obey the
triangle inequality, which pruning needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

Metric = Callable[[Column, Column], Column]


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance of two number arrays in double precision; unequal lengths raise."""
    d = lambda x, y: x.cast("double") - y.cast("double")
    total = F.aggregate(F.zip_with(a, b, lambda x, y: d(x, y) * d(x, y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total)).otherwise(
        F.raise_error(F.lit("vectors of unequal length")).cast("double")
    )


def l2_of(width: int) -> Metric:
    """l2() for vectors of ``width`` numbers, as one sum that Spark compiles; other lengths raise."""

    def dist(a: Column, b: Column) -> Column:
        total = F.lit(0.0)
        for j in range(width):
            d = a[j].cast("double") - b[j].cast("double")
            total = total + d * d
        return F.when((F.size(a) == width) & (F.size(b) == width), F.sqrt(total)).otherwise(
            F.raise_error(F.lit("vectors of unequal length")).cast("double")
        )

    return dist


def edit(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance in characters; with ``most``, null beyond it."""
    if most is None:
        return F.levenshtein(a, b).cast("double")
    d = F.levenshtein(a, b, most)
    return F.when(d >= 0, d.cast("double"))


def tanimoto_bits(a: Column, b: Column) -> Column:
    """1 - |x and y| / |x or y| of two arrays of bit words; two all-zero fingerprints are at 0."""
    count = lambda op: F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(op(x, y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    both, either = count(lambda x, y: x.bitwiseAND(y)), count(lambda x, y: x.bitwiseOR(y))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / either)


def tanimoto_set(a: Column, b: Column) -> Column:
    """The same formula on two arrays taken as sets; two empty sets are at 0."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / either)


METRICS: dict[str, Metric] = {"l2": l2, "edit": edit, "tanimoto_bits": tanimoto_bits, "tanimoto_set": tanimoto_set}


def metric_of(metric: str | Metric) -> Metric:
    return METRICS[metric] if isinstance(metric, str) else metric


def usable(df: DataFrame, id_col: str, obj_col: str) -> DataFrame:
    """The rows that take part in searches: neither id nor object is null, nor anything in an array."""
    df = df.where(F.col(id_col).isNotNull() & F.col(obj_col).isNotNull())
    if isinstance(df.schema[obj_col].dataType, ArrayType):
        df = df.where(F.forall(obj_col, lambda x: x.isNotNull()))
    return df


def within_capacity(df: DataFrame, col: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose string fits, one row with the numbers kept and dropped); nulls are dropped."""
    fits = F.coalesce(F.length(col) <= capacity, F.lit(False))
    report = df.agg(
        F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"), F.max(F.length(col)).alias("longest")
    )
    return df.where(fits), report


def sign_bits(vector: Column, words: int, bits: int = 32) -> Column:
    """Fingerprint of a vector: the signs of its components as ``words`` words of ``bits`` bits, lowest first."""
    word = lambda w: F.aggregate(
        F.transform(
            F.slice(vector, w * bits + 1, bits),
            lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")),
        ),
        F.lit(0).cast("long"), lambda s, x: s + x,
    )
    return F.array(*[word(w) for w in range(words)])


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case [a-z0-9]+ tokens."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))))
