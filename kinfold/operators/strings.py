"""Edit-distance search through an index of grams, without all pairs.

Of t + 1 grams of a query that don't overlap, t edits leave one whole, and move it by
t places at most.  So strings within t share one of those grams at nearly its place: an
equi-join on gram and block of places finds them.  The rarest grams are taken.  A gram's
row holds its string and three words of bits that tell the numbers of its characters
up to three, so what is found is bounded and verified where it is found: only pairs
within t leave the join.  Strings too long to stand beside each of their grams are
verified by their ids after it.

Data is (id, obj), queries are (qid, qobj), both with unique ids.  Rows with a null id
or object take no part; an empty string is a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.metrics import edit, usable
from kinfold.operators.knn import distances, knn_exact, top_k
from kinfold.operators.pivots import spread
from kinfold.plans.staging import stage

#: Classes by which the characters of a string are counted, each up to three.
CLASSES = 64
LEVELS = ("once", "twice", "thrice")
#: Characters of the longest string that stands beside each of its grams.
CARRIED = 256
#: The distances up to which a top-k search looks, one after the other.
STEPS = (2, 3, 4, 6)
#: Pairs of strings up to which a search without an index compares all.
ALL_PAIRS = 1 << 24


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(0))


def _described(t: DataFrame, i: str, o: str) -> DataFrame:
    """(own, text, n, levels, chars): the string's length, its characters, and for each of LEVELS a bit for each class that has as many."""
    t = t.select(F.col(i).alias("own"), F.col(o).alias("text"), _characters(F.col(o)).alias("chars"))
    no = F.lit(0).cast("long")

    def count(seen: Column, c: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(CLASSES)).cast("int"))
        full, below = [], bit  # a class rises to a level if it stood at the one below
        for level in LEVELS:
            full.append(seen[level].bitwiseOR(below).alias(level))
            below = seen[level].bitwiseAND(bit)
        return F.struct(*full)

    levels = F.aggregate("chars", F.struct(*[no.alias(level) for level in LEVELS]), count)
    return t.select("own", "text", F.size("chars").alias("n"), levels.alias("levels"), "chars")


def _grams(described: DataFrame, gram: int, *kept: str) -> DataFrame:
    """(own, *kept, at, gram): every run of ``gram`` characters with its place."""
    starts = F.when(F.col("n") >= gram, F.sequence(F.lit(1), F.col("n") - (gram - 1)))
    at = described.select("own", *kept, F.explode(F.transform(starts, lambda p: F.struct(p.alias("at"), F.array_join(F.slice("chars", p, gram), "").alias("gram")))).alias("g"))
    return at.select("own", *kept, "g.at", "g.gram")


def _lacks(a: str, b: str) -> Column:
    """Characters that one string has and the other lacks, as far as their levels tell; an edit takes away or adds one at most."""
    gone = [F.bit_count(F.col(f"{a}.{level}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{level}")))) for level in LEVELS]
    return gone[0] + gone[1] + gone[2]


class Strings:
    """Strings indexed by their grams of ``gram`` characters, as staged tables."""

    def __init__(self, data: DataFrame, gram: int = 2, carried: int = CARRIED) -> None:
        self.gram, self.carried = gram, carried
        self.data = usable(data, "id", "obj").select("id", "obj")
        # strings of few files, and so their grams, would be few tasks' in every search
        described = _described(spread(self.data, "id"), "id", "obj").withColumn("obj", F.when(F.col("n") <= carried, F.col("text")))
        self.grams = stage(_grams(described, gram, "obj", "n", "levels").withColumnRenamed("own", "id"), "grams")
        self.uses = stage(self.grams.groupBy("gram").agg(F.count("*").alias("uses")), "uses")

    def asked(self, queries: DataFrame) -> DataFrame:
        """(qid, qobj, m, asks, grams): the queries with their grams in order of how few strings hold them; staged."""
        described = _described(usable(queries, "qid", "qobj"), "qid", "qobj")
        met = _grams(described, self.gram).join(self.uses, "gram", "left")
        ranked = met.groupBy("own").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "at", "gram"))).alias("grams"))
        own = described.drop("chars").join(ranked, "own", "left")
        return stage(own.select(F.col("own").alias("qid"), F.col("text").alias("qobj"), F.col("n").alias("m"), F.col("levels").alias("asks"), "grams"), "asked")

    def _probes(self, asked: DataFrame, most: int) -> DataFrame:
        """(qid, qobj, m, asks, place, gram, before): of each query most + 1 rare grams that don't overlap, and those before each.

        Queries that are too short have none.
        """
        apart = lambda taken, g: ~F.exists(taken, lambda t: F.abs(t["at"] - g["at"]) < self.gram)
        pick = lambda taken, g: F.when((F.size(taken) <= most) & apart(taken, g), F.array_append(taken, g)).otherwise(taken)
        taken = F.aggregate("grams", F.filter("grams", lambda g: F.lit(False)), pick)
        own = ["qid", "qobj", "m", "asks"]
        found = asked.select(*own, taken.alias("taken")).where(F.size("taken") == most + 1)
        found = found.withColumn("qobj", F.when(F.col("m") <= self.carried + most, F.col("qobj")))  # longer ones meet no carried string
        found = found.select(*own, "taken", F.posexplode("taken").alias("nth", "g"))
        return found.select(*own, F.col("g.at").alias("place"), "g.gram", F.slice("taken", F.lit(1), F.col("nth")).alias("before"))

    def candidates(self, asked: DataFrame, most: int) -> DataFrame:
        """(qid, id, obj, qobj): pairs that share one of the chosen grams within ``most`` places and fit in length and characters.

        A pair is found at the first of its grams and places, and so once, where the
        string is carried; else obj is null and it may be found again.

        Places go by blocks of 2 * most + 1, of which a gram's reach touches two, so that
        a gram most strings have meets those alone that have it there.  All is asked in
        the join; nothing else moves.
        """
        width = 2 * most + 1
        block = lambda place: F.floor(place / width).cast("int")
        place = F.col("place")
        reach = F.array_distinct(F.array(block(place - most), block(place + most)))
        left = self._probes(asked, most).withColumn("block", F.explode(reach))
        right = self.grams.withColumn("block", block(F.col("at")))
        met = right.join(left, ["gram", "block"]).where((F.abs(F.col("at") - place) <= most) & (F.abs(F.col("n") - F.col("m")) <= most))
        met = met.where((_lacks("levels", "asks") <= most) & (_lacks("asks", "levels") <= most))
        stands = lambda gram, at: F.call_function("locate", gram, F.col("obj"), F.greatest(F.lit(1), at - most))
        again = F.exists("before", lambda g: stands(g["gram"], g["at"]).between(1, g["at"] + most))
        first = F.col("obj").isNull() | ((stands(F.col("gram"), place) == F.col("at")) & ~again)
        return met.where(first).select("qid", "id", "obj", "qobj")

    def verified(self, asked: DataFrame, most: int, exclude_self: bool = False, seen: Observation | None = None) -> DataFrame:
        """(qid, id, dist), staged: all pairs within ``most`` edits of the queries that have most + 1 grams apart.

        ``seen`` observes, in the same pass, the number of candidates as ``tried``.
        """
        pairs = self.candidates(asked, most)
        pairs = pairs if seen is None else pairs.observe(seen, F.count("*").alias("tried"))
        pairs = pairs.where("id <> qid") if exclude_self else pairs
        near = F.levenshtein("obj", "qobj", most) >= 0  # null of those not carried
        met = stage(pairs.where(F.coalesce(near, F.lit(True))).select("qid", "id", edit(F.col("obj"), F.col("qobj"), most).alias("dist")), "met")
        found = met.where("dist IS NOT NULL")
        long = met.where("dist IS NULL").select("qid", "id").distinct()
        if long.isEmpty():
            return met
        texts = long.join(asked.select("qid", "qobj"), "qid").join(self.data, "id")
        found = found.unionByName(texts.select("qid", "id", edit(F.col("obj"), F.col("qobj"), most).alias("dist")).where("dist IS NOT NULL"))
        return stage(found, "verified")

    def _uncovered(self, asked: DataFrame, most: int) -> DataFrame:
        """(qid, qobj) of the queries without most + 1 grams apart."""
        return asked.join(self._probes(asked, most).select("qid").distinct(), "qid", "left_anti").select("qid", "qobj")

    def range_search(self, queries: DataFrame, most: int, exclude_self: bool = False) -> DataFrame:
        """(qid, id, dist) within ``most`` edits.  Queries too short for most + 1 grams apart meet every string."""
        asked = self.asked(queries)
        found = self.verified(asked, most, exclude_self)
        short = self._uncovered(asked, most)
        if short.isEmpty():
            return found
        rest = distances(self.data, short, lambda a, b: edit(a, b, most), exclude_self)
        return found.unionByName(rest)

    def nearest(self, queries: DataFrame, copies: DataFrame, k: int, steps: tuple[int, ...] = STEPS) -> DataFrame:
        """(qid, id, dist) that holds the k nearest of each query, where ``copies`` (id, copies) says how many each string stands for.

        A query is done at the first step within which k strings lie, copies counted;
        whoever is left after the last step, and is thus far from all but a few, is
        compared with every string.
        """
        left, parts = self.asked(queries), []
        for most in steps:
            if left.isEmpty():
                break
            near = self.verified(left, most)
            met = near.join(copies, "id").groupBy("qid").agg(F.sum("copies").alias("n"))
            done = stage(met.where(F.col("n") >= k).select("qid"), "done")
            parts.append(near.join(done, "qid", "left_semi"))
            left = stage(left.join(done, "qid", "left_anti"), "left")
        if not parts or not left.isEmpty():
            parts.append(distances(self.data, left.select("qid", "qobj"), "edit"))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found


def knn_edit_searched(data: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The result of knn_edit(): by brute force up to ALL_PAIRS pairs, else over an index of the grams."""
    if data.count() * queries.count() <= ALL_PAIRS:
        return knn_exact(data, queries, k, "edit", exclude_self)
    return knn_edit(data, queries, k, exclude_self=exclude_self)


def knn_edit(data: DataFrame, queries: DataFrame, k: int, steps: tuple[int, ...] = STEPS, gram: int = 2, exclude_self: bool = False) -> DataFrame:
    """(qid, rank, id, dist, exact): the k nearest of each query by edit distance, ties to the smaller id.

    Equal strings are searched once, as data and as queries: of a string's copies only
    the k + 1 smallest ids can be among k neighbours, so those alone stand beside it.
    """
    data, queries = usable(data, "id", "obj"), usable(queries, "qid", "qobj")
    order = W.partitionBy("obj").orderBy("id")
    first = data.select("id", "obj", F.row_number().over(order).alias("at")).where(F.col("at") <= k + 1)
    first = stage(first.withColumn("rep", F.min("id").over(W.partitionBy("obj"))), "copies")
    texts = stage(queries.groupBy("qobj").agg(F.min("qid").alias("rep")), "texts")
    copies = stage(first.groupBy("rep").agg(F.count("*").alias("copies")).withColumnRenamed("rep", "id"), "counts")
    index = Strings(first.where("at = 1").select("id", "obj"), gram)
    near = index.nearest(texts.select(F.col("rep").alias("qid"), "qobj"), copies, k + 1, steps)
    each = near.select("qid", F.col("id").alias("rep"), "dist").join(first.select("rep", "id"), "rep")
    lists = top_k(each.select("qid", "id", "dist"), k + 1).select(F.col("qid").alias("rep"), "id", "dist")
    members = queries.select("qid", "qobj").join(texts, "qobj").select("qid", "rep")
    found = members.join(lists, "rep").select("qid", "id", "dist")
    return top_k(found.where("id <> qid") if exclude_self else found, k)
