"""The pipeline, stage by stage, against brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from kinfold.llm import mixing
from kinfold.plans.staging import stage


def test_stages(spark, docs, sf):
    """Each stage keeps what it should of what came before, and says so in its rows."""
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = stage(f(spark, now, sf), "t")
        assert after.columns == now.columns
        seen.append(({r["doc_id"]: r["text"] for r in now.collect()}, after.collect(), now))
        now = after
    (before, rows, _), (lined, cut, _), (whole, kept, _), (mixed, taken, mix_in) = seen
    none = {i for i, t in before.items() if not any(c.isalpha() for c in t or "")}
    gone = set(before) - {r["doc_id"] for r in rows}
    assert none <= gone and len(gone - none) <= 0.02 * len(before) + 1
    assert {r["doc_id"] for r in cut} == set(lined) and sum(r["text"] != lined[r["doc_id"]] for r in cut) > 5
    assert all(r["n_chars"] == len(r["text"]) for r in cut)
    assert {r["doc_id"] for r in kept} == {i for i, (_, _, k) in brute_components(whole, corpus_pipeline.PERCENT).items() if k}
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mix_sources(mix_in).collect()}
    assert sorted(r["doc_id"] for r in taken) == sorted(i for i, n in copies.items() for _ in range(n))
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i in {r["doc_id"] for r in taken}:
        want[i] = np.array(tokenizer.encode(mixed[i], add_special_tokens=False).ids + [0], "<u4")
    assert sum(r["length"] for r in packed) == sum(len(want[r["doc_id"]]) for r in taken)
    for r in packed:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_run(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_near_copies_from_80_percent(spark):
    """Copies with 0.80 <= similarity < 0.85 go, those below 0.80 stay."""
    rows, gone = [], set()
    for k, edits in enumerate([1] * 6 + [2] * 6 + [3] * 6):
        own = [f"d{k}w{i}" for i in range({1: 50, 2: 100, 3: 100}[edits])]
        other = list(own)
        for e in range(edits):
            other[20 * e + 20] = "edit"
        for i, words in ((2 * k, own), (2 * k + 1, other)):
            rows.append((i, " ".join(words)))
        n = len(own) - 4
        if (n - 5 * edits) / (n + 5 * edits) >= 0.8:
            gone.add(2 * k + 1)
    assert len(gone) == 12
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted({i for i, _ in rows} - gone)


def test_null_and_repeated_ids(spark, docs, tmp_path):
    """Rows with null ids pass all stages, rows that repeat an id are one document after the third."""
    # texts that are like no other
    rows = [(i, " ".join(f"wort{i}x{k} gegen" for k in range(40)), "en", "hot" if i % 2 else None, 0) for i in range(1000, 1040)]
    many = [*rows, *rows[:3] * 6, *[(None, t.replace("wort", "noid"), g, s, n) for _, t, g, s, n in rows[:12]], (None, None, None, None, None)]
    spark.createDataFrame(many, docs.schema).unionByName(docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES[:-1]:
        seen.append(now)
        now = stage(f(spark, now, str(tmp_path)), "t")
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    first, lined, whole, single = map(ids, seen)
    assert first[None] == 13 and lined[None] == whole[None] == single[None] == 12
    assert lined[1000] == whole[1000] == 7 and set(single) <= set(whole) and {1000, 1001, 1002} <= set(single)
    assert all(n == 1 for i, n in single.items() if i is not None)
    row = lambda r: (r["doc_id"], r["text"])
    mixed = mixing.mix_sources(seen[3]).collect()
    assert ids(now) == +Counter({i: sum(r["mix_copies"] for r in mixed if r["doc_id"] == i) for i in single})
    assert {row(r) for r in now.collect()} <= {row(r) for r in seen[3].collect()}
    assert ids(now)[None] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r["doc_id"] for r in packed} == set(ids(now))


def test_mixing_of_repeated_rows(spark, docs):
    """Repeated rows are taken as often as the mixture says, not each with each."""
    twice = docs.where("doc_id < 20").unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id < 3"))
    copies = Counter()
    for r in mixing.mix_sources(twice).collect():
        copies[r["doc_id"]] += r["mix_copies"]
    got = Counter(r["doc_id"] for r in corpus_pipeline.mix(spark, twice, "").collect())
    assert got == +copies and sum(got.values()) > 0


def test_no_language_learned(spark, docs):
    """Without a labelled row the first stage keeps all texts with a letter."""
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, bare, "").collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_columns_of_any_name_and_empty_tables(spark, docs, tmp_path):
    """Extra columns pass every stage but the last, whatever their names; an empty table stays empty."""
    names = ("row_key", "taken", "at", "parts", "left", "drop_at", "count", "one", "__one", "__id", "__text", "n", "size", "kept")
    own = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    now, none = own, own.limit(0)
    for _, f in corpus_pipeline.STAGES[:-1]:
        now, none = stage(f(spark, now, ""), "t"), stage(f(spark, none, ""), "t")
        assert now.columns == none.columns == own.columns and none.count() == 0
    rows = now.collect()
    assert len(rows) > 50 and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0


def test_run_leaves_only_what_its_result_reads(spark, sf, monkeypatch):
    import os
    import urllib.parse

    from kinfold.plans.staging import shared_dir

    folder = urllib.parse.urlparse(shared_dir(spark)).path
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, sf)
    left = set(os.listdir(folder)) - before
    assert out.count() > 50 and sum("mixing" in x for x in left) == 1
    assert not any(x.startswith(("kinfold-rows", "kinfold-digests", "kinfold-language-id", "kinfold-sizes")) for x in left)
