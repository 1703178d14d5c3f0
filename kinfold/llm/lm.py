"""Stupid-backoff scores of whole documents under counts of the whole corpus.

A word's score after its context is count(n-gram) / count(context) where the n-gram
occurs ``least`` times or more, else ``backoff`` times its score after a shorter
context, and in the end its share of all words.

It is computed by joins.  For every order there is a count table, one row per
n-gram, made by a grouped sum that is combined in the tasks first; joined to the
table of the order below it gives what the n-gram adds to the score that its last
word would have without it.  The documents' exploded n-grams, one row per batch of
documents and distinct n-gram with the documents that hold it, are joined to that
table by hash and summed per document, which a 64-bit hash of its row stands for.  As
scores are logarithms, the sum over orders is the backed-off score: an n-gram that
is not frequent enough has no row and adds nothing.

All joins are equi-joins of a table of distinct n-grams with rows of documents, so a
hot n-gram is one row on one side and rows that adaptive execution can split on the
other.  Orders above 1 go through in ``passes`` ranges of hashes, so that only a
part of the n-grams lies in shuffle files at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.words import grams, small_batches, text_words
from kinfold.plans.staging import stage, unstage

#: Bytes of text whose n-grams are combined before they leave a task's Python worker.
BATCH = 8 << 20
#: Rows of a batch's n-grams that leave it at once; the JVM holds an Arrow batch whole, outside its heap.
SHIPPED = 1 << 16
#: A row of documents that holds an n-gram: the row's key, and how often.
ENTRY = np.dtype([("key", "<i8"), ("times", "<i4")])
#: Entries whose sums are combined before they leave a task's Python worker.
COMBINED = 1 << 20


def _hashes(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams, the text of each); those of single words are the words' own."""
    if n > 1:
        return grams(words, starts, n)
    return words, np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def _chosen(hashes: np.ndarray, part: int, passes: int) -> np.ndarray:
    """Places of the hashes in one of ``passes`` ranges, told by bits that no partition is chosen by."""
    if passes == 1:
        return np.arange(len(hashes))
    return np.flatnonzero((hashes >> np.uint64(40)) % np.uint64(passes) == np.uint64(part))


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, SHIPPED):
        yield batch.slice(lo, SHIPPED)


def gram_counts(docs: DataFrame, text: str, n: int, part: int = 0, passes: int = 1) -> DataFrame:
    """(gram, prefix, suffix, n, ctx): occurrences of every n-gram, and those with a word after them.

    ``prefix`` and ``suffix`` are the hashes of its first and last n - 1 words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, BATCH):
            words, starts = text_words(batch.column(text))
            hashes, owner = _hashes(words, starts, n)
            follows = np.ones(len(hashes), bool)
            follows[np.flatnonzero(owner[1:] != owner[:-1])] = False
            follows[-1:] = False
            own = _chosen(hashes, part, passes)
            hashes, follows = hashes[own], follows[own]
            found, first, at, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            ctx = np.bincount(at, follows, len(found)).astype(np.int64)
            first, owner = own[first], owner[own[first]]
            del hashes, follows, own, at  # a worker's memory is the executor's
            if n > 1:
                # of the shorter n-grams each text has one more
                shorter, _ = _hashes(words, starts, n - 1)
                at = first + np.searchsorted(np.flatnonzero(np.diff(starts) >= n - 1), owner)
                prefix, suffix = shorter[at], shorter[at + 1]
            else:
                prefix = suffix = np.zeros(len(found), np.uint64)
            yield from _in_parts(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)), pa.array(prefix.view(np.int64)),
                        pa.array(suffix.view(np.int64)), pa.array(times.astype(np.int64)), pa.array(ctx),
                    ],
                    names=["gram", "prefix", "suffix", "n", "ctx"],
                )
            )

    counted = docs.select(text).mapInArrow(count, "gram long, prefix long, suffix long, n long, ctx long")
    return counted.groupBy("gram").agg(
        F.first("prefix").alias("prefix"), F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("ctx").alias("ctx")
    )


def document_grams(docs: DataFrame, n: int, part: int = 0, passes: int = 1) -> DataFrame:
    """(gram, docs): the distinct n-grams of each batch of rows of ``docs`` (__key, __text), with ENTRY of each row that holds it."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", BATCH):
            words, starts = text_words(batch.column("__text"))
            hashes, owner = _hashes(words, starts, n)
            own = _chosen(hashes, part, passes)
            own = own[np.argsort(hashes[own], kind="stable")]  # rows stay in order
            hashes, owner = hashes[own], owner[own]
            del words, own
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            entries = np.empty(len(at), ENTRY)
            entries["key"] = batch.column("__key").to_numpy()[owner[at]]
            entries["times"] = np.diff(np.append(at, len(hashes)))
            hashes = hashes[at]
            first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)])
            ends = np.append(first, len(at)).astype(np.int32) * ENTRY.itemsize
            held = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(entries)])
            yield from _in_parts(pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), held], names=["gram", "docs"]))

    return docs.select("__key", "__text").mapInArrow(explode, "gram long, docs binary")


def _document_rows(docs: DataFrame, order: int, backoff: float) -> DataFrame:
    """(__id, __key, n_words, base): every row, with what its words have at least for their contexts."""
    id_type = docs.schema["__id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "__text", BATCH):
            words, starts = text_words(batch.column("__text"))
            size = np.diff(starts)
            steps = sum(np.maximum(size - k, 0) for k in range(1, order)) if order > 1 else np.zeros(len(size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__key"), pa.array(size), pa.array(steps * math.log(backoff))],
                names=["__id", "__key", "n_words", "base"],
            )

    return docs.mapInArrow(rows, f"__id {id_type}, __key long, n_words long, base double")


def backoff_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, backoff: float = 0.4, order: int = 2, passes: int = 2
) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) for every row of ``docs``.

    log_score: sum of the natural logarithms of the words' scores with contexts of up
    to ``order`` - 1 words before them in their text; a text's first word has its share
    of all words.  Words are runs without ASCII white space, A-Z lower-cased.  The
    counts hold the scored documents themselves, so an n-gram that occurs once is
    known from that place alone; ``least`` = 2 takes it as unseen, and with 1 no word
    would ever back off.

    Defined cases: texts that are null or have no word have 0 words, log_score 0 and
    a null mean; repeated rows count each and are scored each; null ids are scored;
    an empty table gives an empty table.  ``docs`` is read once per order, pass and
    side of a join, and has to give the same rows each time.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    each = ("__id", "__text")
    texts = texts.withColumn("__key", F.xxhash64(*each, *[F.col(c).isNull() for c in each]))  # rows that are equal share it
    rows = stage(_document_rows(texts, order, backoff), "rows")
    table = stage(gram_counts(texts, "__text", 1), "grams-1")
    total = table.agg(F.sum("n")).first()[0] or 0
    # (gram, ctx, score, adds): adds is what a row of documents gets for the n-gram
    known = table.select("gram", "ctx", F.log(F.col("n") / F.lit(float(max(total, 1)))).alias("score")).withColumn("adds", F.col("score"))
    sums = [_summed(document_grams(texts, 1), known)]
    for n in range(2, order + 1):
        parts = []
        before = known.select(F.col("gram").alias("prefix"), F.col("ctx").alias("before"))
        lower = known.select(F.col("gram").alias("suffix"), F.col("score").alias("lower"))
        for part in range(passes):
            counts = stage(gram_counts(texts, "__text", n, part, passes).where(F.col("n") >= least), f"grams-{n}")
            score = F.log(F.col("n") / F.col("before"))
            known = stage(
                counts.join(before.hint("shuffle_hash"), "prefix").join(lower.hint("shuffle_hash"), "suffix")
                .select("gram", "ctx", score.alias("score"), (score - F.lit(math.log(backoff)) - F.col("lower")).alias("adds")),
                f"scores-{n}",
            )
            unstage(counts)
            sums.append(_summed(document_grams(texts, n, part, passes), known))
            parts.append(known)
        known = parts[0]
        for other in parts[1:]:
            known = known.unionByName(other)
    zero = F.lit(0.0)
    every = rows.select("__key", zero.alias("sum"), F.lit(1).cast("long").alias("copies"))
    for part in sums:
        every = every.unionByName(part.withColumn("copies", F.lit(0).cast("long")))
    # equal rows share their n-grams' sum
    joined = rows.join(every.groupBy("__key").agg((F.sum("sum") / F.sum("copies")).alias("sum")), "__key")
    return joined.select(F.col("__id").alias(id_col), "n_words", (F.col("base") + F.col("sum")).alias("log_score")).withColumn(
        "mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    )


def _summed(exploded: DataFrame, known: DataFrame) -> DataFrame:
    """(__key, sum) of what the n-grams of each row add."""

    def combined(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, adds = (np.concatenate(x) for x in zip(*held))
        found, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, adds, len(found)))], names=["__key", "sum"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            docs = batch.column("docs")
            if not len(docs):
                continue
            ends = np.frombuffer(docs.buffers()[1], np.int32, len(docs) + 1, docs.offset * 4)
            entries = np.frombuffer(docs.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(ENTRY)
            adds = np.repeat(batch.column("adds").to_numpy(), np.diff(ends) // ENTRY.itemsize)
            held.append((entries["key"].copy(), entries["times"] * adds))
            n += len(entries)
            if n >= COMBINED:
                yield combined(held)
                held, n = [], 0
        if held:
            yield combined(held)

    met = exploded.join(known.select("gram", "adds").hint("shuffle_hash"), "gram").select("docs", "adds")
    return stage(met.mapInArrow(add_up, "__key long, sum double").groupBy("__key").agg(F.sum("sum").alias("sum")), "sums")
