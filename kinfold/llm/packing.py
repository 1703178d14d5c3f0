"""Best-fit packing of documents into token sequences of a fixed length.

Tasks tokenise their documents and pack the pieces best-fit, longest first.  Bins
that are nearly full are done; the others go up a tree as items of their fill,
several tasks' into one, where they are packed best-fit again.  The tree ends where
a task holds ``most_bins`` open bins, or all of them: so many pieces pack as well as
any number, and a task's memory stays bounded.  No bin is passed over at any level.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm.words import small_batches
from kinfold.plans.staging import stage

#: Chunks that a worker remembers.
CACHE = 700_000

#: Bytes of text that are read together.
BATCH = 8 << 20
#: White space next to white space, or signs that only Python takes for it, as RE2 writes it.
_TOUCHING = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]{2}|[\x1c-\x1f]"
#: Parts chunks; no text that is parted holds it.
_MARK = "\x1c"


class ByteEncoder:
    """Token ids of texts as little-endian 32-bit bytes, by a byte-level BPE file.

    The byte-level pattern starts a new piece at every space before anything else
    and keeps a lone line break apart, so a text is the sum of such chunks, and a
    run of letters with a space before it or none is one piece whatever follows; the
    encoder remembers their ids, as most words come again.  Chunks are cut and numbered
    by Arrow, so each distinct one of a batch is looked up once, and ids are copied by
    number.  Texts in which white space touches white space, or which hold one of the
    file's special tokens, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [rf"\Q{x['content']}\E" for x in json.load(f).get("added_tokens", [])]
        self.apart = "|".join([_TOUCHING, *special])
        vocabulary = self.tokenizer.get_vocab()
        #: Which tokens begin with a space, in the byte alphabet of such files.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _run(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that begin with a space, read as one text: the only tokens with a space begin them."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(chunks):
            return self.whole(chunks)
        raw, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
        return [raw[lo:hi] for lo, hi in zip((4 * at).tolist(), ends)]

    def _learn(self, chunks: list[str]) -> list[str]:
        """Ids of new chunks: letters, and the signs after them, apart; anything else as it is.  Returns what is new."""
        known, parts, new = self.known, [], set()
        for chunk in chunks:
            if not chunk[-1].isalnum() and len(chunk) > 1:
                end = len(chunk) - 1
                while end and not chunk[end - 1].isalnum():
                    end -= 1
                word, rest = chunk[:end], chunk[end:]
                if (word[1:] if word[:1] == " " else word).isalpha():
                    parts.append((chunk, word, rest))
                    new.update(x for x in (word, rest) if x not in known)
                    continue
            new.add(chunk)
        # no other white space in or after it
        spaced = [x for x in new if x[0] == " " and (x[1:].isalpha() or len(x) > 1 and x[1:] == x.strip() and len(x.split()) == 1)]
        for lo in range(0, len(spaced), 4096):
            own = spaced[lo : lo + 4096]
            known.update(zip(own, self._run(own)))
        other = list(new.difference(spaced))
        known.update(zip(other, self.whole(other)))
        for chunk, word, rest in parts:
            known[chunk] = known[word] + known[rest]
        return [*new, *(chunk for chunk, _, _ in parts)]

    def _by_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids before each text and in all) of texts that are sums of chunks."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{_MARK} "), "\n", f"{_MARK}\n{_MARK}")
        cut = pc.split_pattern(marked, _MARK)
        dealt = cut.flatten().dictionary_encode()
        chunks, at = dealt.dictionary.to_pylist(), dealt.indices.to_numpy()
        room, known = len(self.known) < CACHE, self.known
        new = self._learn([x for x in chunks if x not in known])
        found = [known[x] for x in chunks]
        if not room:
            for chunk in new:
                del known[chunk]
        held = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = (np.cumsum(sizes) - sizes)[at]
        many = sizes[at]
        ends = np.append(0, np.cumsum(many))
        ids = held[np.arange(ends[-1]) + np.repeat(first - ends[:-1], many)]
        return ids, ends[np.append(0, np.cumsum(cut.value_lengths().to_numpy()))]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.cast(pa.large_string()).fill_null("")
        apart = pc.match_substring_regex(texts, self.apart)
        whole = iter(self.whole(texts.filter(apart).to_pylist()))
        ids, ends = self._by_chunks(texts.filter(pc.invert(apart)))
        raw = ids.tobytes()
        own = (raw[4 * lo : 4 * hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()))
        return [next(whole) if x else next(own) for x in apart.to_pylist()]


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``sizes``: longest first, each into the fullest bin that takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what still fits
    some = 0  # bit r is set where room[r] has bins
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[i]
        fits = some >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = r - n
        if left:
            room[left].append(b)
            some |= 1 << left
    return bins


MEMBERS = ["__ids", "__pieces", "__starts", "__lengths", "__crcs"]


def _emit(members: list[list[tuple]], fills: list[int], level: int, capacity: int, nearly: float,
          id_type: pa.DataType, first: int = 0) -> pa.RecordBatch:
    """Bins with numbers of their own; those that aren't nearly full stay open."""
    part = TaskContext.get().partitionId()
    still = np.array(fills) < nearly * capacity
    kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(len(fills), dtype=np.int64) + first + (part << 32) + (level << 56)),
            pa.array(np.full(len(fills), part, np.int32)),
            pa.array(still),
            pa.array(fills, pa.int64()),
            *[pa.array([[m[k] for m in x] for x in members], pa.list_(t)) for k, t in enumerate(kinds)],
        ],
        names=["__seq", "__part", "__open", "__fill", *MEMBERS],
    )


def _schema(id_type: str) -> str:
    return (
        f"__seq long, __part int, __open boolean, __fill long, __ids array<{id_type}>, __pieces array<int>, "
        "__starts array<long>, __lengths array<long>, __crcs array<long>"
    )


def cut_pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids): only the first may be shorter than the capacity."""
    n, at, piece = len(ids) // 4, 0, 0
    step = n % capacity or capacity
    while at < n:
        yield piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])
        at, piece, step = at + step, piece + 1, capacity


def _local(path: str, capacity: int, nearly: float, chunk: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, items, made, id_type = encoder(path), [], 0, None

        def packed():
            bins = best_fit([x[3] for x in items], capacity)
            return [[items[i] for i in b] for b in bins]

        for part in small_batches(batches, "__text", BATCH):
            id_type = part.column("__id").type
            for doc, ids in zip(part.column("__id").to_pylist(), tokens.encode(part.column("__text"))):
                items += [(doc, *x) for x in cut_pieces(ids + b"\0\0\0\0", capacity)]
            if len(items) >= chunk:
                bins = packed()
                yield _emit(bins, [sum(x[3] for x in b) for b in bins], 0, capacity, nearly, id_type, made)
                made, items = made + len(bins), []
        if items:
            bins = packed()
            yield _emit(bins, [sum(x[3] for x in b) for b in bins], 0, capacity, nearly, id_type, made)

    return pack


def _merge(level: int, capacity: int, nearly: float) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, fills, id_type = [], [], None
        for batch in batches:
            id_type = batch.column("__ids").type.value_type
            fills += batch.column("__fill").to_pylist()
            members += [list(zip(*x)) for x in zip(*(batch.column(c).to_pylist() for c in MEMBERS))]
        if fills:
            bins = best_fit(fills, capacity)
            yield _emit(
                [[m for i in b for m in members[i]] for b in bins], [sum(fills[i] for i in b) for b in bins],
                level, capacity, nearly, id_type,
            )

    return pack


def pack_documents(
    docs: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    nearly: float = 0.998,
    most_bins: int = 100_000,
    fan_in: int = 8,
    chunk: int = 200_000,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 0; documents longer than ``capacity``
    are cut into pieces of it, of which the first may be shorter.  Offsets are
    gapless in each sequence.

    Defined cases: null and empty texts are the single id 0; null and repeated ids
    are packed row by row; texts of any length are cut whole; an empty table gives
    an empty table.

    Ids are those of ``tokenizer``, a file for the tokenizers library (by default the
    installed 50k byte-level BPE), without added special tokens.  Every level is a
    table in the shared folder, so a lost executor costs its level's tasks only and
    numbers given to sequences stay.  A task holds about ``chunk`` pieces, or as many
    open bins as ``fan_in`` tasks leave, or ``most_bins`` once that is less.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = slim.schema["__id"].dataType.simpleString()
    level = stage(slim.mapInArrow(_local(path, capacity, nearly, chunk), _schema(id_type)), "pack")
    done = [level.where("NOT __open")]
    groups = (level.agg(F.max("__part")).first()[0] or 0) + 1
    number = 0
    while True:
        least = max(1, -(-level.where("__open").count() // most_bins))
        groups, number = max(-(-groups // fan_in), least), number + 1
        merged = level.where("__open").repartition(groups).mapInArrow(_merge(number, capacity, nearly), _schema(id_type))
        level = stage(merged, "pack")
        if groups <= least:
            done.append(level)
            break
        done.append(level.where("NOT __open"))
    every = done[0]
    for other in done[1:]:
        every = every.union(other)
    # the place in the sequence is the sum of the lengths before
    places = F.transform(
        "__lengths", lambda x, i: F.aggregate(F.slice("__lengths", 1, i), F.lit(0).cast("long"), lambda a, b: a + b)
    )
    return every.select(
        "__seq", F.inline(F.arrays_zip(*MEMBERS, places.alias("__places"))).alias(*MEMBERS, "__places")
    ).select(
        F.col("__ids").alias(id_col),
        F.col("__pieces").alias("piece"),
        F.col("__starts").alias("start"),
        F.col("__lengths").alias("length"),
        F.col("__crcs").alias("ids_crc32"),
        F.col("__seq").alias("sequence_id"),
        F.col("__places").alias("offset"),
    )
