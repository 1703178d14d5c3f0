"""Content identity: hashes, aliases, drift, manifests and what is left out.

Rows are equal in content when their hashes match.  Null parts of a context count
as empty texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.plans.names import spare_names
from kinfold.plans.staging import stage

#: Stands between the parts of a context.
UNIT = "\u001f"


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts' texts, in order."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(texts[0] if len(texts) == 1 else F.concat_ws(UNIT, *texts), 256)


def identity(df: DataFrame, source_cols: list[str], context_cols: list[str]) -> DataFrame:
    """``df`` with source_sha256, of the content alone, and payload_sha256, of content and context."""
    source = [F.col(c) for c in source_cols]
    return df.withColumn("source_sha256", digest(*source)).withColumn(
        "payload_sha256", digest(*source, *[F.col(c) for c in context_cols])
    )


def aliases(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(hash, n, first_id, last_id) of the hashes that several rows share; members stay in their rows."""
    return (
        df.groupBy(hash_col)
        .agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
        .where(F.col("n") > 1)
    )


def alias_members(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """(id, hash, first_id): every row of a shared hash with the smallest id that shares it."""
    groups = aliases(df, hash_col, id_col).select(hash_col, "first_id")
    return df.select(id_col, hash_col).join(groups, hash_col)


def identity_counts(df: DataFrame, source: str = "source_sha256", payload: str = "payload_sha256") -> DataFrame:
    """One row (items, sources, payloads)."""
    return df.agg(
        F.count("*").alias("items"), F.count_distinct(source).alias("sources"), F.count_distinct(payload).alias("payloads")
    )


def context_drift(df: DataFrame, source: str = "source_sha256", payload: str = "payload_sha256") -> DataFrame:
    """(source, payloads) of contents met in several contexts."""
    return df.groupBy(source).agg(F.count_distinct(payload).alias("payloads")).where(F.col("payloads") > 1)


def canonical(df: DataFrame, hash_col: str, id_col: str) -> DataFrame:
    """Of each hash the row with the smallest id; ranks are limited in every task before the shuffle."""
    order = W.partitionBy(hash_col).orderBy(id_col)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def reconcile(full: DataFrame, listing: DataFrame, key: str, hash_col: str, prefix_col: str) -> DataFrame:
    """(key, status): match, mismatch, unlisted (only in full) or unknown (only in the listing)."""
    a = full.select(F.col(key), F.col(hash_col).alias("__hash"))
    b = listing.select(F.col(key), F.col(prefix_col).alias("__prefix"))
    status = (
        F.when(F.col("__prefix").isNull(), "unlisted").when(F.col("__hash").isNull(), "unknown")
        .when(F.col("__hash").startswith(F.col("__prefix")), "match").otherwise("mismatch")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


#: Bits of a key's hash that number the ranges of the first comparison, and those that each later one adds.
FIRST_BITS, MORE_BITS = 8, 6
#: Rows that a range should hold at the last.
RANGE_ROWS = 64


def _range(key: str, bits: int) -> Column:
    """The number of a key's range: the first bits of its hash, so that longer numbers part a range."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("range"), F.col(key)), 64 - bits)


def _marks(t: DataFrame, key: str, value: Column, width: int, side: str) -> DataFrame:
    """(key, one, two): two hashes of a row's key and first ``width`` characters; a null, or too few, equals nothing of the other side."""
    whole = F.col(key).isNotNull() & value.isNotNull() & (F.length(value) >= width)
    part = F.when(whole, F.substring(value, 1, width))
    other = F.when(~F.coalesce(whole, F.lit(False)), F.lit(side))
    return t.select(F.col(key), *[F.xxhash64(F.lit(n), F.col(key), F.coalesce(part, F.lit("")), F.coalesce(other, F.lit(""))).alias(n) for n in ("one", "two")])


def range_digests(marks: DataFrame, key: str, bits: int) -> DataFrame:
    """(range, n, x, lo, hi): a digest of each range's rows, of which those of tasks, files or days add up.

    ``x`` is the exclusive or of one hash, ``lo`` and ``hi`` are sums of the halves of the other.
    """
    return marks.groupBy(_range(key, bits).alias("range")).agg(
        F.count("*").alias("n"), F.bit_xor("one").alias("x"),
        F.sum(F.col("two").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned("two", 32)).alias("hi"),
    )


def differing_ranges(full: DataFrame, listing: DataFrame, key: str, hash_col: str, prefix_col: str, width: int, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """(table of the ranges whose digests differ, the bits of their numbers).

    All ranges are compared first; those that differ are parted and compared again,
    until ranges hold about ``rows`` rows on average.  Rows of equal ranges are read, but only
    their digests are shuffled.
    """
    marks = [_marks(full, key, F.col(hash_col), width, "full"), _marks(listing.where(F.length(prefix_col) <= width), key, F.col(prefix_col), width, "listing")]
    longer = _marks(listing.where((F.length(prefix_col) > width) | F.col(prefix_col).isNull()), key, F.lit(None).cast("string"), width, "listing")
    marks[1] = marks[1].unionByName(longer)
    bits, found = FIRST_BITS, None
    while True:
        if found is not None:
            within = _range(key, bits - MORE_BITS)
            marks = [m.withColumn("range", within).join(found, "range", "left_semi").drop("range") for m in marks]
        a, b = (range_digests(m, key, bits) for m in marks)
        pairs = stage(a.unionByName(b).groupBy("range", "n", "x", "lo", "hi").agg(F.count("*").alias("sides")), "digests")
        found = stage(pairs.where("sides = 1").select("range").distinct(), "differing")
        held = pairs.agg(F.avg("n")).first()[0]
        if found.isEmpty() or (held or 0) <= rows or bits + MORE_BITS > 62:
            return found, bits
        bits += MORE_BITS


def reconcile_ranges(full: DataFrame, listing: DataFrame, key: str, hash_col: str, prefix_col: str, width: int, rows: int = RANGE_ROWS) -> DataFrame:
    """reconcile() for tables that differ in few rows: of ranges with equal digests no row is shuffled.

    A listing's prefixes have ``width`` characters; others are compared row by row,
    as nulls are.  Keys that are not null are unique in each table.  Equal digests, of
    128 bits and a count, are taken for equal rows: a chance, and no proof against forgery.
    """
    found, bits = differing_ranges(full, listing, key, hash_col, prefix_col, width, rows)
    number = spare_names([*full.columns, *listing.columns], "__range")[0]
    ranges = found.withColumnRenamed("range", number)
    a, b = (t.withColumn(number, _range(key, bits)) for t in (full, listing))
    settled = a.join(ranges, number, "left_anti").select(key, F.lit("match").alias("status"))
    open_ = reconcile(a.join(ranges, number, "left_semi"), b.join(ranges, number, "left_semi"), key, hash_col, prefix_col)
    return settled.unionByName(open_)


def exclusions(every: DataFrame, captured: DataFrame, reasons: DataFrame, key: str) -> DataFrame:
    """(key, reason) of the items that were not captured; without a stated reason it is 'unstated'."""
    left = every.select(key).join(captured.select(key), key, "left_anti")
    return left.join(reasons.select(key, "reason"), key, "left").select(key, F.coalesce("reason", F.lit("unstated")).alias("reason"))


def provenance(entries: DataFrame, hash_col: str, payload_col: str) -> DataFrame:
    """(hash, payloads, uses): over how many payloads each hash is spread; null hashes are left out."""
    return entries.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.count_distinct(payload_col).alias("payloads"), F.count("*").alias("uses")
    )


def classify(df: DataFrame, rules: DataFrame, name_col: str) -> DataFrame:
    """``df`` with ``family``: that of the longest matching LIKE pattern, ties by pattern; null if none.

    ``rules`` (pattern, family) is a table of rules, not of data: it is read by the
    driver, 1,000 rows at most, and becomes one expression over each name.
    """
    found = rules.select("pattern", "family").distinct().limit(1001).collect()
    if len(found) > 1000:
        raise ValueError("at most 1000 rules")
    family = F.lit(None).cast("string")
    for r in sorted(found, key=lambda r: (-len(r["pattern"]), r["pattern"], r["family"]), reverse=True):
        family = F.when(F.col(name_col).like(r["pattern"]), F.lit(r["family"])).otherwise(family)
    return df.withColumn("family", family)


def coverage(items: DataFrame, checks: DataFrame, key: str, result_col: str) -> DataFrame:
    """(result, n): items by the result of their check, 'untested' without one."""
    got = items.select(key).join(checks.select(key, result_col), key, "left")
    return got.groupBy(F.coalesce(F.col(result_col).cast("string"), F.lit("untested")).alias("result")).agg(F.count("*").alias("n"))


def redact(df: DataFrame, col: str, pattern: str, replacement: str) -> DataFrame:
    """``df`` with ``col`` replaced where the pattern matches, both hashes and ``changed``."""
    new = F.regexp_replace(col, pattern, replacement)
    return (
        df.withColumn("original_sha256", digest(F.col(col))).withColumn("published_sha256", digest(new))
        .withColumn("changed", F.col("original_sha256") != F.col("published_sha256")).withColumn(col, new)
    )


def matched_rules(df: DataFrame, col: str, rules: dict[str, str]) -> DataFrame:
    """``df`` with ``matched``: the names of the rules, regular expressions, that match; null matches none.

    Every rule is tried once a row; keep and count from this one column.
    """
    names = F.array(*[F.when(F.col(col).rlike(p), F.lit(name)) for name, p in rules.items()])
    return df.withColumn("matched", F.array_compact(names))


def publishable(df: DataFrame, col: str, rules: dict[str, str]) -> DataFrame:
    """The rows that no rule matches."""
    return matched_rules(df, col, rules).where(F.size("matched") == 0).drop("matched")


def rule_report(df: DataFrame, col: str, rules: dict[str, str]) -> DataFrame:
    """(rule, n): rows that each rule matches, and as rule 'publishable' those that none does; one pass over ``df``."""
    counts = {name: F.count_if(F.array_contains("matched", name)) for name in rules}
    counts["publishable"] = F.count_if(F.size("matched") == 0)
    row = matched_rules(df.select(col), col, rules).agg(*[c.alias(n) for n, c in counts.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in counts])))


def by_collection(df: DataFrame, collection: Column, *measures: Column) -> DataFrame:
    """Measures per collection and, with a null collection, over all."""
    return df.withColumn("collection", collection).rollup("collection").agg(*measures)
