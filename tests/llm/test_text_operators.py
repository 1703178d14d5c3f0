"""Operators on documents against brute force on the fixture."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from unittest import mock

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import (
    langid, line_dedup, lm, media, mixing, oracles, packing, quality, queries, setsketch, sharding, words,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def duck(sql, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def clashing(docs):
    """Columns with names that operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("line_total", "size", "score", "digest", "__n", "component_id", "position", "a", "b")})


# --- words ---------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 64, 1 << 18])
def test_word_hashes(monkeypatch, texts, block):
    monkeypatch.setattr(words, "BLOCK", block)
    rows = list(texts.values())
    hashes, starts = words.text_words(pa.array(rows))
    known, at = {}, 0
    for i, t in enumerate(rows):
        own = split(t)
        assert starts[i + 1] - starts[i] == len(own)
        for w in own:
            assert known.setdefault(w, hashes[at]) == hashes[at]
            at += 1
    assert len(set(known.values())) == len(known)
    got, bounds = words.distinct_by_doc(*words.grams(hashes, starts, 5, whole=True), len(rows))
    for i, t in enumerate(rows):
        w = split(t)
        assert bounds[i + 1] - bounds[i] == len({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else ())


def test_words_of_a_slice():
    column = pa.array(["a b", None, "c d e", "f"]).slice(1, 3)
    hashes, starts = words.text_words(column)
    assert starts.tolist() == [0, 0, 3, 4]


# --- line dedup ------------------------------------------------------------------------


def test_line_dedup_query(spark, sf):
    cols, want = duck(oracles.LINE_DEDUP, sf)
    got = queries.op10_line_dedup(spark, sf)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(want)
    assert got.agg(F.sum("n_dropped")).first()[0] > 10


def test_line_dedup_texts(docs, texts, empty):
    got = line_dedup.dedup_lines(clashing(docs))
    assert "a" in got.columns and got.count() == len(texts)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[200]["text"] is None and rows[200]["line_total"] == 1 and rows[206]["text"] == "\n\n"
    assert all(rows[i]["text"] == t for i, t in texts.items() if rows[i]["line_dropped"] == 0)
    twice = line_dedup.dedup_lines(docs.union(docs))
    assert twice.count() == 2 * len(texts)
    assert {(r["doc_id"], r["text"]) for r in twice.collect()} == {(i, r["text"]) for i, r in rows.items()}
    assert line_dedup.dedup_lines(empty).count() == 0


OWN = ("id", "mark", "at", "line", "all", "key", "d", "a", "b", "n", "keeper", "drop_id", "drop_mark", "drop_at", "parts", "left",
       "__id", "__drop", "__lines", "__kept", "__key", "__d", "taken", "row_key", "__at", "__taken", "__row_key", "__row", "__group")


def test_line_dedup_keeps_columns_of_any_name(docs):
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in OWN})
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "line_total", "line_dropped"]
    plain = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    for r in got.collect():
        assert r["text"] == plain[r["doc_id"]] and all(r[c] == f"{c} of {r['doc_id']}" for c in OWN)


def test_line_dedup_of_many_lines(spark):
    """Documents of 50,000 lines, of which many go: a square of that would not end."""
    line = lambda i: F.concat(F.when(i % 3 == 0, F.lit("own line of document ")).otherwise("a line of more than forty code points, the "), i.cast("string"))
    own = F.transform(F.sequence(F.lit(1), F.lit(50_000)), line)
    df = spark.range(5).select(F.col("id").alias("doc_id"), F.array_join(own, "\n").alias("text"))
    got = {r["doc_id"]: (r["line_total"], r["line_dropped"], r["n"]) for r in line_dedup.dedup_lines(df).withColumn("n", F.size(F.split("text", "\n"))).collect()}
    assert got == {i: (50_000, 33_334, 16_666) for i in range(4)} | {4: (50_000, 0, 50_000)}


def test_line_dedup_of_ids_that_repeat(spark):
    """Places are those of a text, not of an id."""
    a, b = "first shared line of more than forty characters", "second shared line of more than forty characters"
    df = spark.createDataFrame([*[(i, f"{a}\n{b}") for i in range(6)], (0, f"x\n{b}\ny"), (0, f"x\n{b}\ny"), (0, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["line_dropped"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == sorted([*[(i, "", 2) for i in range(5)], (5, f"{a}\n{b}", 0), (0, "x\ny", 1), (0, "x\ny", 1), (0, "x", 0)])


def test_line_dedup_null_id(spark):
    long = "x" * 50
    df = spark.createDataFrame([(None, long), *[(i, long) for i in range(5)]], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {None: long, 0: "", 1: "", 2: "", 3: "", 4: long}


# --- mixing ---------------------------------------------------------------------------


def test_mix_parts_hot_ids(spark, monkeypatch):
    """A bucket full of null or repeated ids is parted, and the result is that of one bucket."""
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(["w"] * rng.randrange(4)), f"s{i % 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    run = lambda: sorted([(r["doc_id"] is None, r["doc_id"], r["source"], r["mix_size"], r["mix_taken"], r["mix_position"], r["mix_copies"]) for r in mixing.mix_sources(df).collect()], key=repr)
    whole = run()
    monkeypatch.setattr(mixing, "ROOM", 1)
    parted = run()
    assert parted == whole and len(parted) == 3000
    grouped = mixing._grouped(
        df.select(F.col("doc_id").alias("__id"), F.lit("").alias("__order"), F.lit("s").alias("__tsrc"), F.lit(0).cast("long").alias("__bucket"),
                  F.length("text").cast("long").alias("__size"), F.lit(3000).alias("__sdocs"), F.monotonically_increasing_id().alias("__row"))
    )
    assert grouped.groupBy("__group").count().agg(F.max("count")).first()[0] < 200


def test_training_order_keeps_columns_of_any_name(docs):
    odd = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in OWN})
    keyed, key = mixing.with_row_key(odd)
    got = mixing.training_order(keyed, mixing.mix_sources(keyed, row_col=key), row_col=key)
    assert key == "_row_key" and got.columns == odd.columns
    rows = got.collect()
    assert len(rows) > 100 and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in OWN)


def test_mix_query(spark, sf):
    cols, want = duck(oracles.MIX, sf)
    key = lambda rows: sorted(tuple(None if v is None else round(v, 7) for v in r) for r in rows)
    got = [tuple(r[c] for c in cols) for r in queries.op4_mix_sources(spark, sf).collect()]
    none_last = lambda rows: sorted(rows, key=repr)
    assert none_last([tuple(None if v is None else round(float(v), 7) for v in r) for r in got]) == none_last(
        [tuple(None if v is None else round(float(v), 7) for v in r) for r in want]
    )
    assert key([]) == []


def test_mix_laws(docs, texts, empty):
    rows = mixing.mix_sources(clashing(docs)).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert len(rows) == len(texts)
    by = defaultdict(list)
    for r in rows:
        assert r["mix_size"] == size[r["doc_id"]] and 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        assert len(r["mix_positions"]) == r["mix_copies"]
        by[r["source"]].append(r)
    assert abs(sum(own[0]["mix_target"] for own in by.values()) - sum(size.values())) < 1e-6
    for own in by.values():
        assert abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= 1
        assert own[0]["mix_target"] <= 3 * own[0]["mix_source_size"]
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    free = [by[s][0]["mix_target"] / (k % 3 + 1) for k, s in enumerate(names) if by[s][0]["mix_target"] < 3 * by[s][0]["mix_source_size"]]
    assert max(free) - min(free) < 1e-6
    assert mixing.mix_sources(empty).count() == 0
    copies = mixing.training_order(docs, mixing.mix_sources(docs))
    assert copies.columns == docs.columns and copies.count() == sum(r["mix_copies"] for r in rows)


def test_mix_weights_of_zero(spark, docs, texts):
    """A source without weight is left out; with no weight at all nothing is taken."""
    some = lambda d: d.select(F.col("__src").alias("__rsrc"), F.when(F.col("__src") == "hot", 0.0).otherwise(1.0).alias("__w0"), F.when(F.col("__src") == "hot", 0.0).otherwise(2.0).alias("__w1"))
    rows = mixing.mix_sources(docs, some).collect()
    assert len(rows) == len(texts) and all(r["mix_taken"] == 0 for r in rows if r["source"] == "hot")
    assert sum(r["mix_taken"] for r in rows) > 0 and all(r["mix_taken"] <= 3 * r["mix_size"] for r in rows)
    none = lambda d: d.select(F.col("__src").alias("__rsrc"), F.lit(0.0).alias("__w0"), F.lit(0.0).alias("__w1"))
    assert all(r["mix_taken"] == 0 and r["mix_positions"] == [] for r in mixing.mix_sources(docs, none).collect())


def test_mix_null_and_repeated_ids(docs):
    many = docs.unionByName(docs.where("doc_id < 30")).unionByName(docs.where("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix_sources(many).collect()
    assert len(rows) == many.count() and sum(r["doc_id"] is None for r in rows) == 9
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert abs(sum(r["mix_taken"] for r in own) - own[0]["mix_target"]) <= 1


# --- sharding ---------------------------------------------------------------------------


def test_shards(spark, sf, texts, docs, empty):
    rows = queries.op6_shard_by_bytes(spark, sf).collect()
    cols, want = duck(oracles.SHARD, sf)
    assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(want)
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_by_bytes(empty).count() == 0
    one = sharding.shard_by_bytes(docs.where("doc_id = 1")).collect()
    assert [(r["slot"]) for r in one] == [0]


def test_equal_texts_share_a_shard(spark):
    df = spark.createDataFrame([(i, f"text {i // 4} " * 9) for i in range(4000)], "doc_id long, text string")
    got = sharding.shard_by_bytes(df)
    assert got.groupBy("text_crc32").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    sizes = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.02 * min(sizes)
    hot = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(900)], "doc_id long, text string")
    sizes = [r[1] for r in sharding.shard_by_bytes(hot).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 25


# --- near-duplicates -------------------------------------------------------------------------


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = split(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("few", [32, 1])
def test_near_duplicates(monkeypatch, docs, texts, few):
    monkeypatch.setattr(setsketch, "FEW", few)
    got = setsketch.near_duplicates(clashing(docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_components(texts)


def test_large_buckets_by_blocks(monkeypatch, spark):
    """Versions of one text, near and far: a large component and others share buckets of many blocks."""
    import random

    rng = random.Random(11)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(140):
        words = list(base)
        for at in rng.sample(range(200), rng.randint(0, 3) if i % 2 else rng.randint(5, 9)):
            words[at] = f"x{rng.randint(0, 3)}"
        texts[i] = " ".join(words)
    seen, many = [], setsketch._many

    def watched(mixed, sets, percent):
        seen.append(mixed.where("__asks < __blocks").agg(F.max("__asks"), F.max("__blocks")).first())
        return many(mixed, sets, percent)

    monkeypatch.setattr(setsketch, "FEW", 1)
    monkeypatch.setattr(setsketch, "BLOCK_ROWS", 8)
    monkeypatch.setattr(setsketch, "_many", watched)
    got = setsketch.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == brute_components(texts)
    assert seen[0][0] > 1 and seen[0][1] > seen[0][0]


def test_near_duplicate_cases(spark, docs, texts, empty):
    assert setsketch.near_duplicates(empty).count() == 0
    twice = setsketch.near_duplicates(docs.union(docs).union(docs.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long"))))
    want = brute_components(texts)
    for r in twice.collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    with pytest.raises(ValueError):
        setsketch.near_duplicates(docs, percent=70)
    two = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError, match="several texts"):
        setsketch.near_duplicates(two)


def test_sketch_estimate():
    rng = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.9):
        n, common = 2000, round(2 * 2000 * j / (1 + j))
        x = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
        a, b = x[:n], x[n - common :]
        regs = setsketch.registers(np.concatenate([a, b]), np.array([0, n]))
        got = setsketch.estimate(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.15
        # merging sketches by maximum is sketching the union
        union = setsketch.registers(np.unique(x), np.array([0]))
        assert (np.maximum(regs[0], regs[1]) == union[0]).all()


def test_overlaps():
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 60, 25)) for _ in range(6)] for _ in range(2))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert setsketch.overlaps(left, right, width=7).tolist() == want


# --- packing -----------------------------------------------------------------------------


def test_encoder_equals_tokenizer(monkeypatch, texts):
    import random

    rng = random.Random(3)
    signs = ["a", "B", "é", " ", "\n", "x", "1", ".", "!", "'s", "'", "²", "̈", "ß", "\t", "日", "_", " ", "\x1c", "<|endoftext|>"]
    rows = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [t or "" for t in texts.values()]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows += ["a<|endoftext|>b", "x <|endoftext|> y", "<|endoftext|>", "word <|endoftext|><|endoftext|>\n"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in rows]
    e = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.encode(rows) == want
    monkeypatch.setattr(packing, "CACHE", 50)
    e = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x for i in range(0, len(rows), 256) for x in e.encode(rows[i : i + 256])] == want


def test_encoder_looks_up_a_chunk_once_a_batch():
    class Counting(dict):
        looked = 0

        def __getitem__(self, key):
            Counting.looked += 1
            return super().__getitem__(key)

    e = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    e.known = Counting(e.known)
    rows = ["the cat and the cat\nand the cat"] * 500 + ["a  b", None, ""]
    assert e.encode(pa.array(rows)) == e.whole([x or "" for x in rows])
    assert Counting.looked < 20
    for few in ([], [""], [None], ["a  b"]):
        assert e.encode(pa.array(few, pa.string())) == e.whole([x or "" for x in few])


@pytest.mark.parametrize("capacity,most", [(2048, 100_000), (64, 40)])
def test_packing(docs, texts, capacity, most):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(clashing(docs), capacity=capacity, most_bins=most, fan_in=2).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert 4 * at == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(by_seq) <= 1.1 * sum(r["length"] for r in rows) / capacity + 1


def test_packing_cases(docs, empty):
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(docs.where("doc_id IN (200, 201)").union(docs.where("doc_id = 200"))).select("length").collect() == [(1,)] * 3
    assert packing.best_fit([5, 4, 3, 3, 1], 8) == [[0, 2], [1, 3, 4]]


# --- media -------------------------------------------------------------------------------


def test_media(docs, texts, empty):
    rows = {r["doc_id"]: r for r in media.media_columns(clashing(docs)).collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["height"] * 64) == (len(raw), len(payload), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        image = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert media.decode_png(image) == payload and r["feature"] == media.sample_features(payload)
    assert rows[203]["feature"] == rows[8]["feature"]
    assert media.media_columns(empty).count() == 0


def test_media_shards_hold_each_payload_once(docs, tmp_path):
    import tarfile

    index, base = media.store_texts(docs.coalesce(1).unionAll(docs.coalesce(1)).coalesce(1))
    rows = index.collect()
    folder = base.split(":", 1)[1].lstrip("/")
    for shard in {r["shard"] for r in rows}:
        with tarfile.open(f"/{folder}/{shard}") as tar:
            names = tar.getnames()
            assert len(set(names)) == len(names)
            for r in rows[:20]:
                member = tar.getmember(f"{r['digest'].hex()}.png")
                assert (member.offset_data, member.size) == (r["offset"], r["length"])
    damaged = bytearray(media.encode_png(b"x" * 64))
    damaged[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(damaged))


# --- language id -----------------------------------------------------------------------------


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    params = langid.new_params(3, 5, dtype=np.float64)
    data, labels = rng.integers(60, 130, (7, 4)).astype(np.uint8), np.array([0, 2, 1, 1])
    _, grad = langid.gradients(params, data, labels)
    for k, value in params.items():
        i = tuple(int(rng.integers(n)) for n in value.shape)
        i = (int(data[3, 1]), *i[1:]) if k[0] == "W" else i
        value[i] += 1e-6
        up = langid.gradients(params, data, labels)[0]
        value[i] -= 2e-6
        down = langid.gradients(params, data, labels)[0]
        value[i] += 1e-6
        assert abs((up - down) / 2e-6 - grad[k][i]) < 1e-7


def test_forward_pass_by_loops(texts):
    """Every position's probabilities and the pooled ones, step by step in plain Python."""
    params = {k: v.astype(float) for k, v in langid.new_params(3, 4, seed=5).items()}
    params["nf"], params["c"] = np.arange(4) / 5, np.array([0.1, -0.2, 0.3])
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def states(window, side):
        w, u, bias, h, out = params[f"W{side}"], params[f"U{side}"], params[f"n{side}"], [0.0] * 4, {}
        for t in range(len(window)) if side == "f" else reversed(range(len(window))):
            hu = [sum(h[i] * u[i][j] for i in range(4)) for j in range(12)]
            x = w[window[t]]
            new = []
            for j in range(4):
                z, r = sigmoid(x[j] + hu[j]), sigmoid(x[4 + j] + hu[4 + j])
                n = math.tanh(x[8 + j] + r * (hu[8 + j] + bias[j]))
                new.append(z * h[j] + (1 - z) * n)
            h = new
            out[t] = h
        return [out[t] for t in range(len(window))]

    some = [t for i, t in texts.items() if i in (0, 1, 5, 200, 201, 207, 208)]
    got = langid.pooled(params, pa.array(some))
    for text, row in zip(some, got):
        raw, sums, n = (text or "").encode(), np.zeros(3), 0
        for lo in range(0, len(raw), langid.WINDOW):
            window = raw[lo : lo + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            for t, (f, b) in enumerate(zip(states(window, "f"), states(window, "b"))):
                if not (window[t] >= 128 or chr(window[t]).isalpha()):
                    continue
                e = [math.exp(sum(s * params["V"][i][k] for i, s in enumerate([*f, *b])) + params["c"][k]) for k in range(3)]
                sums, n = sums + np.array(e) / sum(e), n + 1
        assert np.allclose(row, sums / max(n, 1), atol=1e-6)


def test_language_repeated_rows_and_null_ids(spark, docs):
    many = docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = langid.language_labels(many).collect()
    assert len(rows) == 3 * docs.count() and sum(r["doc_id"] is None for r in rows) == docs.count()
    by = defaultdict(set)
    for r in rows:
        if r["doc_id"] is not None:
            by[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert all(len(x) == 1 for x in by.values())


def test_windows_hold_every_byte(texts):
    rows = list(texts.values())
    windows, owner = langid.text_windows(pa.array(rows).slice(3, 100))
    for k, t in enumerate(rows[3:103]):
        raw = (t or "").encode()
        assert windows[owner == k].tobytes().rstrip(b"\0") == raw.rstrip(b"\0")


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_labels(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count() > 100
    assert held.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).count() == 0


def test_language_of_long_texts_only(spark):
    """Languages whose every document is long, or longer than the budget, are learned too."""
    rng = random.Random(3)
    pools = {"en": ["the", "and", "with", "which", "house"], "de": ["der", "und", "nicht", "auch", "schön"], "xx": ["ñandú", "año", "qué", "más", "él"]}
    rows = [(k * 100 + i, " ".join(rng.choice(pools[x]) for _ in range(14_000)), x) for k, x in enumerate(pools) for i in range(12 if x != "xx" else 2)]
    df = spark.createDataFrame(rows, "__id long, __text string, __lang string")
    names, params = langid.train_languages(df, budget=1 << 18)
    assert names == ["de", "en", "xx"]
    got = langid.identify_languages(df, names, params, id_col="__id", text_col="__text").collect()
    want = {i: x for i, _, x in rows}
    assert all(r["lang_pred"] == want[r["__id"]] for r in got) and len(got) == 26


def test_language_cases(docs, empty):
    names, params = ["de", "en"], langid.new_params(2)
    rows = {r["doc_id"]: r for r in langid.identify_languages(clashing(docs), names, params).collect()}
    assert len(rows) == docs.count()
    for i in (200, 201, 202, 206, 207):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"de", "en", "und"} for r in rows.values())
    assert langid.train_languages(langid.not_held_out(empty)) == ([], {})
    assert langid.language_labels(empty).count() == 0
    kept = langid.keep_identified(docs, names, params, 0.0)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    before = {r["doc_id"]: r for r in docs.collect()}
    for r in kept.collect():
        old = before[r["doc_id"]]
        assert r["lang"] == (old["lang"] or rows[r["doc_id"]]["lang_pred"]) and r["text"] == old["text"]
    # a text near chance goes unless it is short
    flat = {k: v * 0 for k, v in params.items()}
    left = {r["doc_id"] for r in langid.keep_identified(docs, names, flat).collect()}
    letters = {i: sum(c.isalpha() for c in r["text"] or "") for i, r in before.items()}
    assert left == {i for i, n in letters.items() if 0 < n < langid.FEW_LETTERS}
    assert langid.least_score(1) < 1 and abs(langid.least_score(4) - 0.356) < 1e-3


# --- quality ---------------------------------------------------------------------------------


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (got.predicted == got.quality).mean() > 0.97


def test_quality_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(clashing(docs), labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()


def _brute_features(text, slots):
    """Slot to value by loops: words, pairs, and pairs of one word, to unit length."""
    hashes, _ = words.text_words(pa.array([text]))
    count = Counter(int(h) % slots for h in hashes)
    pairs, _ = words.grams(*words.text_words(pa.array([text])), 2)
    count.update(int(h) % slots for h in words.mix64(pairs.copy()))
    own = split(text)
    count.update(0 for a, b in zip(own, own[1:]) if a == b)
    norm = math.sqrt(sum(count.values()))
    return {k: math.sqrt(n) / norm for k, n in count.items()}


def test_features_by_loops(texts):
    rows = [t for i, t in texts.items() if i < 12 or 199 < i < 209] + ["a a a b a a", "one"]
    slot, value, bounds = quality.features(pa.record_batch([pa.array(rows)], names=["t"]), "t")
    for k, t in enumerate(rows):
        got = dict(zip(slot[bounds[k] : bounds[k + 1]].tolist(), value[bounds[k] : bounds[k + 1]]))
        want = _brute_features(t, quality.SLOTS)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-12 for s in want)


def test_ftrl_by_loops():
    """Weights after many updates as the published per-coordinate rule gives them, one number at a time."""
    rng = np.random.default_rng(3)
    model = quality.Ftrl(alpha=0.7, beta=0.9, l1=0.03, l2=0.2, slots=12)
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        l1, l2 = (0.03, 0.2) if i < 12 else (0.0, 0.0)
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((0.9 + math.sqrt(n[i])) / 0.7 + l2)

    for _ in range(300):
        at = np.append(np.sort(rng.choice(12, 4, replace=False)), 12)
        values, label, importance = np.append(rng.random(4), 1.0), int(rng.integers(2)), float(rng.random() + 0.5)
        model.update(at, values, label, importance)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, values))))
        steps = [(i, (p - label) * importance * v, weight(i)) for i, v in zip(at, values)]
        for i, g, w in steps:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w
            n[i] += g * g
    assert np.allclose(model.weights(np.arange(13)), [weight(i) for i in range(13)], atol=1e-12)


def test_scores_by_loops(spark, docs, texts):
    w = np.random.default_rng(4).normal(size=quality.SLOTS + 1).astype("<f4")
    many = docs.unionByName(docs.where("doc_id < 5")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    rows = quality.score_quality(many, w).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([*texts, *range(5), None])
    for r in rows:
        t = texts[8 if r["doc_id"] is None else r["doc_id"]] or ""
        dot = float(w[-1]) + sum(float(w[s]) * v for s, v in (_brute_features(t, quality.SLOTS) if split(t) else {}).items())
        assert abs(r["score"] - 1 / (1 + math.exp(-dot))) < 1e-9


# --- language model ----------------------------------------------------------------------------


def brute_backoff(texts, least=2, order=2):
    """(id, words, score) of every row, word by word through the chain of shorter contexts."""
    docs = [(i, split(t)) for i, t in texts]
    n, ctx = Counter(), Counter()
    for _, d in docs:
        for k in range(1, order + 1):
            for j in range(len(d) - k + 1):
                n[tuple(d[j : j + k])] += 1
                if j + k < len(d):
                    ctx[tuple(d[j : j + k])] += 1
    total = sum(len(d) for _, d in docs)
    out = []
    for i, d in docs:
        s = 0.0
        for j in range(len(d)):
            for k in range(min(order, j + 1), 0, -1):
                gram = tuple(d[j - k + 1 : j + 1])
                if k == 1:
                    s += math.log(n[gram] / total)
                elif n[gram] >= least:
                    s += math.log(n[gram] / ctx[gram[:-1]])
                    break
                else:
                    s += math.log(0.4)
        out.append((i, len(d), s))
    return out


def _same_scores(rows, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted([(r["doc_id"], r["n_words"], r["log_score"]) for r in rows], key=key)
    want = sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want))
    for r in rows:
        assert r["mean_log_score"] is None if r["n_words"] == 0 else abs(r["mean_log_score"] - r["log_score"] / r["n_words"]) < 1e-9


@pytest.mark.parametrize("order,least,passes", [(1, 2, 1), (2, 2, 2), (2, 1, 1), (3, 2, 3), (4, 3, 1)])
def test_backoff(docs, texts, order, least, passes):
    rows = lm.backoff_scores(clashing(docs), order=order, least=least, passes=passes).collect()
    _same_scores(rows, brute_backoff(list(texts.items()), least, order))


def test_backoff_of_hot_pairs_and_repeated_rows(spark):
    """One pair at a twentieth of all places, a word after many others, rows that repeat, null ids."""
    texts = [(i, f"hot pair x{i} token y{i} z w " + " ".join(f"q{i * j % 50}" for j in range(13))) for i in range(150)]
    texts += texts[:20] * 3 + [(5, "another text of five"), (None, "hot pair of none"), (None, "hot pair of none"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    _same_scores(lm.backoff_scores(df, order=3).collect(), brute_backoff(texts, order=3))


def test_backoff_empty(empty):
    assert lm.backoff_scores(empty).count() == 0


def test_backoff_ships_a_gram_once_a_batch(spark):
    df = spark.range(40).select(F.col("id").alias("__key"), F.lit("a b c a b").alias("__text")).coalesce(1)
    rows = lm.document_grams(df, 2).collect()
    assert len(rows) == 3  # not 120
    held = [np.frombuffer(r["docs"], lm.ENTRY) for r in rows]
    assert all(sorted(x["key"]) == list(range(40)) for x in held) and sorted(x["times"].sum() for x in held) == [40, 40, 80]
    both = [x for part in range(2) for x in lm.document_grams(df, 2, part, 2).collect()]
    assert sorted(map(tuple, both)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("made", [lambda df: lm.document_grams(df, 2), lambda df: lm.gram_counts(df, "__text", 2)])
def test_backoff_hands_on_its_ngrams_in_bounded_batches(made, monkeypatch):
    """The JVM holds an Arrow batch whole outside its heap, whatever its text was."""
    seen = []

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            texts = pa.array([" ".join(f"{i}w{k}" for k in range(101)) for i in range(20)])
            seen.extend(work(iter([pa.RecordBatch.from_arrays([pa.array(range(20)), texts], names=["__key", "__text"])])))
            return self

        def groupBy(self, *columns):  # noqa: N802
            return self

        agg = select

    monkeypatch.setattr(lm, "SHIPPED", 300, raising=False)
    monkeypatch.setattr(lm, "F", mock.MagicMock())
    made(Table())
    assert sum(b.num_rows for b in seen) == 2000 and max(b.num_rows for b in seen) <= 300
