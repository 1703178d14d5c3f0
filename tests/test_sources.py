"""Sources, sinks and identity on fixtures of our own."""

import hashlib
import json
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinfold.operators import identity
from kinfold.sources import manifest, objects


def test_vectors_text(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 1 2.5\n\n1 0 -1\n2  4   5\n")
    got = objects.read_vectors_text(spark, f"file://{tmp_path}/v.txt")
    assert sorted((r["id"], r["obj"]) for r in got.collect()) == [(1, [0.0, -1.0]), (2, [4.0, 5.0]), (3, [1.0, 2.5])]
    (tmp_path / "w.txt").write_text("7|1|2\n")
    assert objects.read_vectors_text(spark, f"file://{tmp_path}/w.txt", "|", "double").first()["obj"] == [1.0, 2.0]


def test_objects_and_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "k int, v array<double>")
    assert objects.load_objects(df, "k", "v", "float").count() == 1
    assert tuple(objects.dropped_objects(df, "v").first()) == (2, 1)
    cells = spark.createDataFrame([(1, [1.0], 0, 0.0), (2, [2.0], 1, 0.5)], "id long, obj array<double>, cell int, pdist double")
    objects.write_cells(cells, f"file://{tmp_path}/c")
    back = objects.read_cells(spark, f"file://{tmp_path}/c")
    assert sorted((r["id"], r["cell"]) for r in back.collect()) == [(1, 0), (2, 1)]
    assert [r["id"] for r in objects.read_cells(spark, f"file://{tmp_path}/c", [1]).collect()] == [2]


def test_few_cells_read_few_row_groups(spark, tmp_path):
    """Ranges of cells, one large cell among them: files are few, and a cell lies in few row groups."""
    table = spark.range(40_000).selectExpr("id", "array(rand(1), rand(2)) obj", "if(id % 4 = 0, 77, id % 500) cell", "0.5D pdist").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        objects.write_cells(table, f"file://{tmp_path}/c")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = sorted(tmp_path.glob("c/*.parquet"))
    assert len(files) == 4
    spans = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("cell")
        spans += [(meta.row_group(g).column(at).statistics.min, meta.row_group(g).column(at).statistics.max) for g in range(meta.num_row_groups)]
    assert max(sum(lo <= c <= hi for lo, hi in spans) for c in range(500) if c != 77) <= 2
    some = objects.read_cells(spark, f"file://{tmp_path}/c", [3, 400])
    assert "PushedFilters: [In(cell" in some._jdf.queryExecution().toString() and some.count() == table.where("cell IN (3, 400)").count()


def test_manifest(spark, tmp_path):
    text = {
        "snapshot_date": "2024-03-01",
        "items": [
            {"item_id": "a/x", "source_sha256": "s1", "payload_sha256": "p1", "binaries": {"one": "b1", "two": "b2"}},
            {"item_id": "a/y", "source_sha256": "s1", "payload_sha256": "p2", "binaries": {}},
            {"item_id": "b/z", "source_sha256": "s2", "payload_sha256": "p3", "binaries": {"one": "b1"}},
        ],
        "excluded": [{"item_id": "c/w", "reason": "no access"}],
    }
    (tmp_path / "m.json").write_text(json.dumps(text))
    path = f"file://{tmp_path}/m.json"
    items = manifest.read_manifest(spark, path)
    assert items.count() == 3 and str(items.first()["snapshot_date"]) == "2024-03-01"
    entries = manifest.binaries(items)
    assert entries.count() == 4 and entries.where("binary_sha256 IS NULL").count() == 1
    spread = {r["binary_sha256"]: (r["payloads"], r["uses"]) for r in identity.provenance(entries, "binary_sha256", "payload_sha256").collect()}
    assert spread == {"b1": (2, 2), "b2": (1, 1)}
    drift = identity.context_drift(items).collect()
    assert [(r["source_sha256"], r["payloads"]) for r in drift] == [("s1", 2)]
    assert manifest.read_exclusions(spark, path).first()["reason"] == "no access"


def test_hash_files(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc\0")
    row = manifest.hash_files(spark, f"file://{tmp_path}/*.bin").first()
    assert row["bytes"] == 4 and row["sha256"] == hashlib.sha256(b"abc\0").hexdigest()


def test_reconcile(spark):
    full = spark.createDataFrame([("a", "abcd"), ("b", "bbbb"), ("c", "cccc")], "item string, h string")
    listing = spark.createDataFrame([("a", "ab"), ("b", "xx"), ("d", "dd")], "item string, p string")
    got = {r["item"]: r["status"] for r in identity.reconcile(full, listing, "item", "h", "p").collect()}
    assert got == {"a": "match", "b": "mismatch", "c": "unlisted", "d": "unknown"}


@pytest.mark.parametrize("rows", [1, 64])
def test_reconcile_by_ranges(spark, rows):
    rng = random.Random(rows)
    full = [(i, hashlib.sha256(b"%d" % i).hexdigest()) for i in range(3000)] + [(None, "a" * 64), (None, None), (4000, None), (4001, "abc")]
    listing = [(i, h and h[:12]) for i, h in full]
    for i in rng.sample(range(3000), 12):
        listing[i] = rng.choice([(i, "0" * 12), (-i - 1, listing[i][1]), (i, listing[i][1][:5]), (i, None), (i, full[i][1][:20]), (i, full[i][1][:12] + "zz")])
    kinds = "key long, h string", "key long, __range string"
    a, b = spark.createDataFrame(full, kinds[0]), spark.createDataFrame(listing, kinds[1])
    found, bits = identity.differing_ranges(a, b, "key", "h", "__range", 12, rows)
    open_ = a.withColumn("range", identity._range("key", bits)).join(found, "range", "left_semi").count()
    assert found.count() <= 2 * 12 + 4 and open_ < (100 if rows == 1 else 500)
    got = identity.reconcile_ranges(a, b, "key", "h", "__range", 12, rows)
    want = identity.reconcile(a, b, "key", "h", "__range")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    # tables that agree: nothing is left to compare
    same = a.where("key < 3000")
    found, _ = identity.differing_ranges(same, same.select("key", F.substring("h", 1, 12).alias("p")), "key", "h", "p", 12, rows)
    assert found.isEmpty()
    none = a.limit(0), b.limit(0)
    assert identity.reconcile_ranges(*none, "key", "h", "__range", 12).count() == 0
    assert {r["status"] for r in identity.reconcile_ranges(a, none[1], "key", "h", "__range", 12).collect()} == {"unlisted"}


def test_digests_of_parts_add_up(spark):
    rows = spark.range(500).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    whole = identity.range_digests(identity._marks(rows, "key", F.col("h"), 12, "full"), "key", 4)
    parts = [identity.range_digests(identity._marks(rows.where(w), "key", F.col("h"), 12, "full"), "key", 4) for w in ("key % 3 = 0", "key % 3 > 0")]
    added = parts[0].unionByName(parts[1]).groupBy("range").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, added.collect()))


def test_classify_longest_pattern(spark):
    rules = spark.createDataFrame([("x%", "short"), ("xy%", "long"), ("_y%", "other")], "pattern string, family string")
    df = spark.createDataFrame([("xyz",), ("xa",), ("q",), (None,)], "name string")
    assert [r["family"] for r in identity.classify(df, rules, "name").collect()] == ["other", "short", None, None]


def test_redact_and_publish(spark):
    df = spark.createDataFrame([(1, "at /home/me/x"), (2, "fine"), (3, None)], "id long, t string")
    got = identity.redact(df, "t", r"/home/\w+", "~").orderBy("id").collect()
    assert [(r["t"], r["changed"]) for r in got] == [("at ~/x", True), ("fine", False), (None, False)]
    rules = {"path": "/home/", "word": "fine"}
    assert [r["id"] for r in identity.publishable(df, "t", rules).collect()] == [3]
    report = identity.rule_report(df, "t", rules)
    assert {(r["rule"], r["n"]) for r in report.collect()} == {("path", 1), ("word", 1), ("publishable", 1)}


def test_aliases(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, h string")
    assert identity.aliases(df, "h", "id").collect() == [("a", 2, 1, 3)]
    assert sorted(r["id"] for r in identity.alias_members(df, "h", "id").collect()) == [1, 3]
    rolled = identity.by_collection(df, F.col("h"), F.count("*").alias("n")).collect()
    assert {(r["collection"], r["n"]) for r in rolled} == {("a", 2), ("b", 1), (None, 3)}
