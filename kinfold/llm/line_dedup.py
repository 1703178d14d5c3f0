"""Line dedup: drop long lines that many documents share.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; the places of lines over the threshold go, except in the largest doc_id that
holds them; what stands between them is put together by position.  DataFrame
functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.names import spare_names
from kinfold.plans.staging import stage

#: ASCII white space, stripped at both ends of a line.
WHITE = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (other letters kept)."""
    bare = F.btrim(line, F.lit(WHITE))
    # lower() is the cheap way, and the same thing, where the line is plain ASCII
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    )


def _digest(key: Column) -> Column:
    """128 bits in two longs: 64 alone would collide at a trillion lines."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    prefix: str = "line_",
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus counts.

    A key of at least ``min_chars`` code points that occurs in at least
    ``min_docs`` distinct ids loses all its lines except in the largest id.
    Adds ``{prefix}total`` and ``{prefix}dropped``; an input column of such a
    name is replaced.  All other columns stay, whatever their names.

    Defined cases: null text counts as one empty line and comes back as it is;
    rows with a null id keep every line and count for no key; repeated rows count
    once per id, and each copy gets the same result; an empty table gives an empty
    table; there is no limit on a text's length or its lines, whose number the work
    grows with.

    Shuffles: 16-byte digests by (digest, id) and by digest with partial sums, so
    a line that a third of all documents share is never gathered in one task; the
    places of dropped lines by text; the texts once, by id and digest of the text.
    """
    total, dropped = f"{prefix}total", f"{prefix}dropped"
    docs = docs.drop(total, dropped)
    text, there = F.col(text_col), F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    # which text of an id a place is in: ids may repeat with other texts
    mark = F.xxhash64(text)
    # read twice, so the digests are kept and the texts split for them once
    lines = stage(
        docs.where(there)
        .select(F.col(id_col).alias("id"), mark.alias("mark"), F.split(text, "\n", -1).alias("all"))
        .select("id", "mark", F.posexplode("all").alias("at", "line"))  # a step of its own, so that lines don't carry the text
        .select("id", "mark", "at", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "mark", "at", _digest(F.col("key")).alias("d")).select("id", "mark", "at", "d.a", "d.b"),
        "digests",
    )
    common = stage(
        lines.groupBy("a", "b")
        .agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("a", "b", "keeper"),
        "lines",
    )
    own_id, own_mark, gone, parts, left = spare_names(docs, "drop_id", "drop_mark", "drop_at", "parts", "left")
    # for each place up to the last dropped one whether its line goes, looked up in one step
    gap = lambda k: F.get("at", k) - F.when(k == 0, F.lit(0)).otherwise(F.get("at", k - 1) + 1)
    flags = F.flatten(
        F.transform(F.sequence(F.lit(0), F.size("at") - 1), lambda k: F.concat(F.array_repeat(F.lit(False), gap(k)), F.array(F.lit(True))))
    )
    places = (
        lines.join(common, ["a", "b"]).where(F.col("id") != F.col("keeper"))
        .groupBy("id", "mark").agg(F.array_sort(F.collect_set("at")).alias("at"))
        .select(F.col("id").alias(own_id), F.col("mark").alias(own_mark), flags.alias(gone))
    )
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    kept = F.filter(parts, lambda _, at: ~F.coalesce(F.get(gone, at), F.lit(False)))
    met = (
        docs.withColumn(parts, split).join(places, (docs[id_col] == F.col(own_id)) & (mark == F.col(own_mark)), "left")
        .withColumn(left, F.when(F.col(gone).isNotNull(), kept))
    )
    new = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(left, "\n"))
    return met.select(
        *[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(parts).cast("long").alias(total),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(parts) - F.size(left)).cast("long").alias(dropped),
    )
