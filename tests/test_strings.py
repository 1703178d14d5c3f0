"""Edit-distance search through an index of grams against all pairs."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from kinfold.operators import strings


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(seed, n=150, letters="abcé😀"):
    """Strings with near copies, hot beginnings, short ones, an empty one, repeats and a null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i > 40 and rng.random() < 0.6:
            s = list(rows[rng.randrange(i)][1])
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(s) + 1)
                s[at : at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
            rows.append((i, "".join(s)))
        else:
            rows.append((i, "http://" * (rng.random() < 0.5) + "".join(rng.choice(letters) for _ in range(rng.randrange(25)))))
    return rows + [(n, ""), (n + 1, ""), (n + 2, "a\nb\nc\nd"), (n + 3, "a\nb\nc\nd")] + [(200, None)]


def both(spark, rows):
    data = spark.createDataFrame(rows, "id long, obj string").repartition(3)
    return data, data.where("id % 4 = 0").select(F.col("id").alias("qid"), F.col("obj").alias("qobj"))


def pairs(rows, self_out):
    own = [(i, s) for i, s in rows if s is not None]
    return [(q, i, float(lev(a, b))) for q, a in own if q % 4 == 0 for i, b in own if not self_out or i != q]


@pytest.mark.parametrize("most,gram", [(0, 2), (1, 3), (3, 2), (6, 1)])
def test_range(spark, most, gram):
    rows = words(most)
    data, asked = both(spark, rows)
    index = strings.Strings(data, gram)
    got = index.range_search(asked, most)
    assert sorted(tuple(r) for r in got.select("qid", "id", "dist").collect()) == sorted(p for p in pairs(rows, False) if p[2] <= most)
    assert index.range_search(asked, most, exclude_self=True).where("id = qid").count() == 0
    plan = index.candidates(index.asked(asked), most)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("CartesianProduct", "NestedLoop", "Python", "Arrow"))


@pytest.mark.parametrize("k,steps", [(1, (1, 2)), (4, (2, 4, 8)), (300, (2,)), (3, ())])
def test_knn(spark, k, steps):
    rows = words(k + 20)
    data, asked = both(spark, rows)
    want = []
    per = {}
    for q, i, d in pairs(rows, True):
        per.setdefault(q, []).append((d, i))
    for q, found in per.items():
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(sorted(found)[:k])]
    got = strings.knn_edit(data, asked, k, steps, exclude_self=True)
    assert sorted((r["qid"], r["rank"], r["id"], r["dist"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("carried", [0, 9])
def test_long_strings_are_verified_by_id(spark, carried):
    rows = words(9)
    data, asked = both(spark, rows)
    got = strings.Strings(data, carried=carried).range_search(asked, 3)
    assert sorted(tuple(r) for r in got.select("qid", "id", "dist").collect()) == sorted(p for p in pairs(rows, False) if p[2] <= 3)


def test_few_pairs_are_verified(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "https://" + "".join(rng.choice(letters) for _ in range(24)) + ".example.com") for i in range(400)]
    rows += [(1000 + 4 * i, rows[i][1].replace("e", "x", 1)) for i in range(100)]
    data, asked = both(spark, rows)
    index = strings.Strings(data)
    own = index.asked(asked)
    assert index.candidates(own, 3).count() < own.count() * len(rows) / 50
    assert index.verified(own, 3).count() < own.count() * len(rows) / 100


def test_copies_are_searched_once(spark):
    rows = [(i, "the same string of many rows") for i in range(400)] + [(1000 + i, f"another string {i}") for i in range(20)]
    data, asked = both(spark, rows)
    got = {}
    for r in strings.knn_edit(data, asked, 3, exclude_self=True).collect():
        got.setdefault(r["qid"], []).append((r["id"], r["dist"]))
    for q in range(0, 400, 4):
        assert got[q] == [(i, 0.0) for i in range(4) if i != q][:3]
    index = strings.Strings(data.where("id < 1 OR id >= 1000"))
    assert index.verified(index.asked(asked.where("qid = 0")), 2).count() == 1


def test_edges(spark):
    data, asked = both(spark, words(1))
    none = strings.Strings(data.limit(0))
    assert strings.knn_edit(data.limit(0), asked, 3).count() == 0 and none.range_search(asked, 3).count() == 0
    index = strings.Strings(data)
    assert strings.knn_edit(data, asked.limit(0), 3).count() == 0 and index.range_search(asked.limit(0), 3).count() == 0
    long = [(0, "ab" * 4000 + "x"), (4, "ab" * 4000 + "y"), (5, "cd" * 4000)]
    data, asked = both(spark, long)
    assert sorted(tuple(r) for r in strings.Strings(data).range_search(asked, 2, exclude_self=True).select("qid", "id", "dist").collect()) == [(0, 4, 1.0), (4, 0, 1.0)]


def test_candidates_are_counted_where_they_are_verified(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abc") for _ in range(14))) for i in range(80)]
    index = strings.Strings(spark.createDataFrame(rows, "id long, obj string"))
    asked = index.asked(spark.createDataFrame(rows[::4], "qid long, qobj string"))
    seen = Observation()
    within = index.verified(asked, 3, seen=seen).count()
    assert 0 < within <= seen.get["tried"] == index.candidates(asked, 3).count()


def test_few_files_of_strings_give_many_of_grams(spark):
    index = strings.Strings(spark.range(200).select("id", F.concat(F.lit("string "), F.col("id")).alias("obj")).coalesce(1))
    assert len(index.grams.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_near_queries_end_at_three_edits(spark, monkeypatch):
    """Four edits meet twice the strings that three do."""
    looked = []
    monkeypatch.setattr(strings.Strings, "verified", lambda self, left, most, *a, f=strings.Strings.verified: looked.append(most) or f(self, left, most, *a))
    rows = [(i, "abcdefghijklmnopqrstuvwxyz" + x * 3) for i, x in enumerate("01234567")]
    data, asked = both(spark, rows)
    got = strings.knn_edit(data, asked, 5, exclude_self=True).collect()
    assert looked == [2, 3] and len(got) == 10 and {r["dist"] for r in got} == {3.0}
