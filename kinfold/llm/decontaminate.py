"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

A benchmark item is cut into windows of consecutive words, a window into shingles
of a few words.  Shingles are ordered by rarity in the documents; as all shingles
of a window have to occur, its necessary prefix is the rarest one alone, and only
that is joined.  A match proposes a place, length and position bounds drop what
would stick out of the text, and a proposal counts when every shingle of the
window stands at its place.  DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.plans.staging import stage

#: Words are runs of 0-9, a-z and all characters beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of a benchmark that are sent to every task (some 80 MB); more of them are joined by a shuffle.
BROADCAST_SHINGLES = 1 << 20

TEXT, GRAM, PLACE = ["ta", "tb"], ["a", "b"], ["wa", "wb"]


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all other letters kept; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the cheap way, and the same thing, where the text is plain ASCII
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def _digest(salt: str, *parts: Column) -> list[Column]:
    """128 bits in two longs."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(salt), *parts)]


def _text_key(text: Column) -> list[Column]:
    found = _digest("text", F.coalesce(text, F.lit("")))
    return [found[0].alias("ta"), found[1].alias("tb")]


def _grams(rows: DataFrame, keep: list[str], sizes: list[int]) -> DataFrame:
    """(keep, pos, a, b): the shingles of ``sizes`` words at every place of the array ``w``."""
    longest = max(sizes)
    shifted = [F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in range(longest)]
    at = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    of = lambda n: [F.col(f"z.w{k}") for k in range(n)]
    if len(sizes) == 1:
        a, b = _digest("gram", *of(longest))
        return at.where(F.col(f"z.w{longest - 1}").isNotNull()).select(*keep, "pos", a.alias("a"), b.alias("b"))
    each = [
        F.when(F.col(f"z.w{n - 1}").isNotNull(), F.struct(*[c.alias(x) for c, x in zip(_digest("gram", *of(n)), GRAM)]))
        for n in sizes
    ]
    return at.select(*keep, "pos", F.explode(F.array(*each)).alias("g")).where("g IS NOT NULL").select(*keep, "pos", "g.a", "g.b")


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, n, w): the windows of every item; one of fewer words is a window by itself, one without any has none."""
    own = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    cut = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("w"))
    return cut.select("item", F.size("w").alias("n"), "w")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 4,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(ta, tb, spans, n_hit, items): one row for each distinct text that holds a window of an item.

    ``ta`` and ``tb`` are text_key() of the text, ``spans`` its hit stretches as
    (start, words) in order of start, which may overlap, ``n_hit`` the words inside
    any of them and ``items`` the sorted ids, as text, of the items found.

    Equal texts are looked at once each and found by their digest, so ids play no
    part: they may be null or repeat.  Words, shingles and windows are compared by
    128-bit digests.  Null and empty texts hold nothing, an item without words is
    never found, items that repeat are one, an item with a null id hits words but is
    in no list, and empty tables give no rows.

    Shuffles: the shingles that the benchmark has, out of all of the documents', and
    what follows from them.  A passage that many texts share is counted in the tasks
    first; joins on its shingles are equi-joins that Spark can split.
    """
    cut = stage(
        benchmark_windows(items, window, item_col, item_text_col).select(
            "item", "n", "w", *[c.alias(x) for c, x in zip(_digest("window", F.col("w")), PLACE)]
        ),
        "windows",
    )
    short = F.least(F.col("n"), F.lit(shingle))
    sizes = sorted(r[0] for r in cut.select(short.alias("s")).distinct().collect())  # 1 to ``shingle``
    spark = docs.sparkSession
    if not sizes:
        return spark.createDataFrame([], "ta long, tb long, spans array<struct<start:int,n:int>>, n_hit long, items array<string>")
    once = cut.dropDuplicates(PLACE).select(*PLACE, "n", "w")
    parts = None
    for s in sizes:
        own = _grams(once.where(F.least(F.col("n"), F.lit(shingle)) == s), [*PLACE, "n"], [s])
        parts = own if parts is None else parts.unionByName(own)
    parts = stage(parts.withColumnRenamed("pos", "off"), "parts")
    known = stage(parts.select(*GRAM).distinct(), "shingles")
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)

    # all places in documents where a shingle of the benchmark stands
    texts = docs.where(F.length(text_col) > 0).select(*_text_key(F.col(text_col)), words(F.col(text_col)).alias("w"))
    hits = stage(
        _grams(texts.select(*TEXT, F.size("w").alias("total"), "w"), [*TEXT, "total"], sizes)
        .join(known, GRAM).groupBy(*TEXT, "pos", *GRAM).agg(F.first("total").alias("total")),
        "hits",
    )

    # the rarest shingle of each window of which none is missing
    rarity = hits.groupBy(*GRAM).agg(F.count("*").alias("uses"))
    prefix = stage(
        parts.join(rarity, GRAM, "left").groupBy(*PLACE, "n")
        .agg(
            F.count("*").alias("m"), F.count("uses").alias("there"),
            F.min_by(F.struct("off", *GRAM), F.struct(F.coalesce("uses", F.lit(0)), *GRAM, "off")).alias("rare"),
        )
        .where("m = there").select(*PLACE, "n", "m", "rare.off", "rare.a", "rare.b"),
        "prefix",
    )
    start = F.col("pos") - F.col("off")
    proposed = (
        hits.join(prefix, GRAM).where((start >= 0) & (start + F.col("n") <= F.col("total")))
        .select(*TEXT, start.alias("start"), *PLACE, "n", "m")
    )

    # every shingle has to stand at its place
    due = proposed.join(parts.select(*PLACE, "off", *GRAM), PLACE).select(*TEXT, "start", *PLACE, "n", "m", (F.col("start") + F.col("off")).alias("pos"), *GRAM)
    found = stage(
        due.join(hits.select(*TEXT, "pos", *GRAM), [*TEXT, "pos", *GRAM], "left_semi")
        .groupBy(*TEXT, "start", *PLACE, "n", "m").count().where(F.col("count") == F.col("m")).select(*TEXT, "start", *PLACE, "n"),
        "found",
    )

    # a text has no more spans than words
    spans = found.groupBy(*TEXT).agg(F.array_sort(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), "n"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(s["start"] + s["n"] - F.greatest(s["start"], acc["end"]), F.lit(0))).cast("long").alias("hit"),
            F.greatest(acc["end"], s["start"] + s["n"]).alias("end"),
        ),
    )["hit"]
    named = (
        found.select(*TEXT, *PLACE).distinct().join(cut.select(*PLACE, "item").distinct(), PLACE)
        .groupBy(*TEXT).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    return spans.withColumn("n_hit", covered).join(named, TEXT).select(*TEXT, "spans", "n_hit", "items")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) for every row of ``docs``; see contamination() for the columns and the defined cases.

    A row without a hit has 0 and empty arrays.  Columns of ``docs`` beside these stay
    out, so that none can clash.
    """
    found = stage(contamination(docs, items, window, shingle, text_col, item_col, item_text_col), "contaminated")
    rows = docs.select(
        F.col(id_col).alias("id"), *_text_key(F.col(text_col)),
        F.coalesce(F.regexp_count(lowered(F.col(text_col)), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
    )
    return rows.join(found, TEXT, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
