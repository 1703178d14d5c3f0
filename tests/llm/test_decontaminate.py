"""Benchmark decontamination against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    """Row by row: (id, words, hit words, items)."""
    cuts = []
    for i, t in items:
        w = split(t)
        cuts += [(i, w[k : k + window]) for k in range(max(1, len(w) - window + 1))] if w else []
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, cut in cuts:
            for k in range(len(w) - len(cut) + 1):
                if w[k : k + len(cut)] == cut:
                    hit |= set(range(k, k + len(cut)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    few = ["the", "of", "a", "été", "Ünder", "42", "x"]
    line = lambda n, pool: " ".join(rng.choice(pool) for _ in range(n))
    many = [f"w{k}" for k in range(300)]
    items = [(k, line(rng.choice([1, 2, 3, 4, 9, 10, 11, 40]), few if k % 3 == 0 else many)) for k in range(30)]
    items += [(7, items[1][1]), (40, items[5][1].upper()), (None, line(12, many)), (41, None), (42, ""), (43, "?!-"), (44, "the the the the the the the the the the the the")]
    docs = []
    for i in range(120):
        t = line(rng.choice([0, 1, 3, 30, 200]), few + many)
        if i % 3 == 0:
            planted = rng.choice(items)[1] or ""
            t = f"{t} {planted if i % 2 else planted.replace(' ', ', ')}. {line(5, many)}"
        docs.append((i, t))
    docs += [(0, docs[5][1]), (None, items[4][1]), (None, None), (300, None), (301, ""), (302, " \n\0.?"), (303, "É" * 50000), (304, " ".join(items[4][1] for _ in range(3000)))]
    docs += [(400 + k, f"{items[10][1]} {items[13][1]}") for k in range(40)]
    return docs, items


def rows(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()], key=repr)


@pytest.mark.parametrize("window,shingle,broadcast", [(10, 4, 1 << 20), (10, 4, 0), (10, 1, 1 << 20), (5, 3, 1 << 20), (3, 4, 0)])
def test_against_brute_force(spark, cases, monkeypatch, window, shingle, broadcast):
    docs, items = cases
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", broadcast)
    df, bench = spark.createDataFrame(docs, COLUMNS).repartition(5), spark.createDataFrame(items, ITEMS)
    got = decontaminate.decontaminate(df, bench, window, shingle)
    want = brute(docs, items, window)
    assert rows(got) == want and sum(r[2] > 0 for r in want) > 40


def test_spans(spark):
    item = "a b c d e f g h i j k l"
    df = spark.createDataFrame([(1, f"x y {item}, z, {item.upper()}"), (2, "b c d e f g h i j")], COLUMNS)
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, spark.createDataFrame([(9, item)], ITEMS)).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(k, 10) for k in (2, 3, 4, 15, 16, 17)] and got[1]["n_hit"] == 24
    assert got[2]["spans"] == [] and got[2]["items"] == []


def test_clashing_names_and_empty_tables(spark, cases):
    docs, items = cases
    df, bench = spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(items, ITEMS)
    odd = lambda t: t.withColumns({c: F.lit("x") for c in ("ta", "tb", "a", "b", "w", "pos", "n", "item", "id", "spans", "n_words", "z", "total")})
    want = brute(docs, items, 10)
    assert rows(decontaminate.decontaminate(odd(df), odd(bench))) == want
    assert rows(decontaminate.decontaminate(df, bench.limit(0))) == brute(docs, [], 10)
    assert rows(decontaminate.decontaminate(df, bench.where("item_id = 43"))) == brute(docs, [], 10)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_only_dataframe_functions(spark, cases, tmp_path):
    docs, items = cases
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    df = queries.op11_decontaminate(spark, str(tmp_path))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", df._jdf.queryExecution().toString())
    assert df.where("contaminated").count() == sum(r[2] > 0 for r in brute(docs, items, 10))
