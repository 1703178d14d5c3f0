"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read whole, in windows of bytes.  Two gated recurrent layers pass over
each window, one in either direction; every position gets language
probabilities, and a document's are their mean over the positions of letters.
Training is backpropagation through time in numpy, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.llm.words import small_batches
from kinfold.plans.staging import stage

WINDOW = 64
HIDDEN = 8
#: Windows that pass through the network together.
TOGETHER = 2048

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

Params = dict[str, np.ndarray]


def new_params(languages: int, hidden: int = HIDDEN, seed: int = 1, dtype=np.float32) -> Params:
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(hidden)
    params = {}
    for side in "fb":
        params[f"W{side}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        params[f"U{side}"] = rng.normal(0, scale, (hidden, 3 * hidden))
        params[f"n{side}"] = np.zeros(hidden)
    params["V"] = rng.normal(0, scale, (2 * hidden, languages))
    params["c"] = np.zeros(languages)
    return {k: v.astype(dtype) for k, v in params.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _run(params: Params, side: str, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, hidden, windows) of one direction over ``data`` (steps, windows).

    Windows are the last axis throughout, so that gates are contiguous blocks.
    """
    w, u, bias = np.ascontiguousarray(params[f"W{side}"].T), params[f"U{side}"].T, params[f"n{side}"][:, None]
    hidden = u.shape[1]
    steps, n = data.shape
    states = np.empty((steps, hidden, n), w.dtype)
    h = np.zeros((hidden, n), w.dtype)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x = w.take(data[t], 1)
        hu = u @ h
        gates = x[: 2 * hidden]
        gates += hu[: 2 * hidden]
        _sigmoid(gates)
        z, r = gates[:hidden], gates[hidden:]
        m = hu[2 * hidden :]
        m += bias
        new = r * m
        new += x[2 * hidden :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((t, h, z, r, m, new))
        h = np.subtract(h, new, out=states[t])
        h *= z
        h += new
    return states


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the axis before the last."""
    x -= x.max(-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(-2, keepdims=True)
    return x


def position_probabilities(params: Params, data: np.ndarray) -> np.ndarray:
    """Language probabilities (steps, languages, windows) at every byte of ``data`` (steps, windows)."""
    hidden = params["Uf"].shape[0]
    scores = params["V"][:hidden].T @ _run(params, "f", data)
    scores += params["V"][hidden:].T @ _run(params, "b", data)
    scores += params["c"][:, None]
    return _softmax(scores)


def gradients(params: Params, data: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over the letters' positions, and its gradient by backpropagation through time.

    ``data``: bytes (steps, windows); ``labels``: the language of each window.
    """
    hidden = params["Uf"].shape[0]
    kept: dict[str, list] = {"f": [], "b": []}
    states = {s: _run(params, s, data, kept[s]) for s in "fb"}
    both = np.concatenate([states["f"], states["b"]], 1)
    p = _softmax(params["V"].T @ both + params["c"][:, None])
    mask = _LETTER[data]
    total = max(1, mask.sum())
    at = np.broadcast_to(labels, data.shape)[:, None, :]
    picked = np.take_along_axis(p, at, 1)
    loss = float(-(np.log(picked[:, 0] + 1e-12) * mask).sum() / total)
    np.put_along_axis(p, at, picked - 1, 1)
    p *= (mask / total).astype(p.dtype)[:, None, :]
    grad = {"V": np.matmul(both, p.transpose(0, 2, 1)).sum(0), "c": p.sum((0, 2))}
    into = params["V"] @ p
    codes = data.reshape(-1)
    for s, part in (("f", into[:, :hidden]), ("b", into[:, hidden:])):
        u = params[f"U{s}"]
        grad[f"U{s}"], grad[f"n{s}"] = np.zeros_like(u), np.zeros(hidden, u.dtype)
        inputs = np.empty((3 * hidden, *data.shape), u.dtype)
        dh = np.zeros((hidden, data.shape[1]), u.dtype)
        for t, h, z, r, m, new in reversed(kept[s]):
            dh = dh + part[t]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            inputs[:, t] = np.concatenate([dz, dr, dn])
            dn *= r
            du = np.concatenate([dz, dr, dn])
            grad[f"U{s}"] += h @ du.T
            grad[f"n{s}"] += dn.sum(1)
            dh = dh * z + u @ du
        grad[f"W{s}"] = np.stack(
            [np.bincount(codes, inputs[k].reshape(-1), 256) for k in range(3 * hidden)], 1
        ).astype(u.dtype)
    return loss, grad


def fit(
    windows: np.ndarray, labels: np.ndarray, languages: int, epochs: int = 6, batch: int = 128, rate: float = 0.01,
    seed: int = 1,
) -> Params:
    """Parameters trained by Adam on ``windows`` (number, WINDOW) and their languages."""
    params = new_params(languages, seed=seed)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    rng, step = np.random.default_rng(seed), 0
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            _, grad = gradients(params, windows[own].T, labels[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            now = rate * min(1.0, 2 * (1 - (step - 1) / total))
            for k, g in grad.items():
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-12)))
                first[k] += np.float32(0.1) * (g - first[k])
                second[k] += np.float32(0.01) * (g * g - second[k])
                up, down = first[k] / np.float32(1 - 0.9**step), second[k] / np.float32(1 - 0.99**step)
                params[k] -= np.float32(now) * up / (np.sqrt(down) + np.float32(1e-8))
    return params


def text_windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): all bytes of every text, the last window filled up with zeros."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * WINDOW - (offsets[:-1] - offsets[0]), sizes)] = data
    return out.reshape(-1, WINDOW), np.repeat(np.arange(n), count)


def pooled(params: Params, column: pa.Array) -> np.ndarray:
    """Mean language probabilities of every text over the positions of its letters (rows of zeros: none)."""
    windows, owner = text_windows(column)
    languages = len(params["c"])
    sums = np.zeros((len(column), languages))
    letters = np.zeros(len(column))
    for lo in range(0, len(windows), TOGETHER):
        own = windows[lo : lo + TOGETHER].T
        mask = _LETTER[own]
        p = position_probabilities(params, np.ascontiguousarray(own))
        at = owner[lo : lo + TOGETHER]
        part = np.einsum("tln,tn->nl", p, mask.astype(p.dtype))
        for k in range(languages):
            sums[:, k] += np.bincount(at, part[:, k], len(column))
        letters += np.bincount(at, mask.sum(0), len(column))
    return sums / np.maximum(letters, 1)[:, None]


def train_languages(
    docs: DataFrame, per_language: int = 150, budget: int = 4 << 20, epochs: int = 4, seed: int = 1
) -> tuple[list[str], Params]:
    """(languages, parameters) from rows (__id, __text, __lang).

    The bound is on rows and on bytes: of each language the ``per_language`` documents
    with the smallest id hashes, as long as they have ``budget`` bytes between them, and
    the first in any case, however long it is.  They are learned from whole; of a text
    beyond the budget that many bytes' windows are taken, evenly from beginning to end.
    The ids are chosen from a table without texts.
    """
    hashed = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 31))
    order = W.partitionBy("__lang").orderBy("__hash", "__id")
    known = docs.where(F.col("__lang").isNotNull() & F.col("__id").isNotNull() & (F.octet_length("__text") > 0))
    # a count first tells below which hash a language's smallest lie, so few rows reach its ranks
    counts = stage(known.groupBy("__lang").agg(F.count("*").alias("__count")), "languages")
    below = F.when(F.col("__count") > 4 * per_language + 1200, (2 * per_language + 300) / F.col("__count")).otherwise(1.0)
    chosen = (
        known.select("__id", "__lang", hashed.alias("__hash"), F.octet_length("__text").cast("long").alias("__bytes")).join(counts, "__lang")
        .where(F.col("__hash") < below * float(1 << 31))
        .withColumn("__rank", F.row_number().over(order)).withColumn("__sum", F.sum("__bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .where((F.col("__rank") == 1) | (F.col("__rank") <= per_language) & (F.col("__sum") <= budget)).select("__id").distinct()
    )
    rows = known.join(stage(chosen, "chosen"), "__id", "left_semi").select(
        F.xxhash64(F.col("__id").cast("string")).alias("__key"), "__text", "__lang"
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, langs, keys = [], [], []
        for batch in small_batches(batches, "__text"):
            windows, owner = text_windows(batch.column("__text"))
            key, lang = batch.column("__key").to_pylist(), batch.column("__lang").to_pylist()
            for i in range(batch.num_rows):
                own = windows[owner == i]
                if len(own) > (most := budget // WINDOW):
                    own = own[np.linspace(0, len(own) - 1, most).astype(int)]
                found.append(own)
                langs += [lang[i]] * len(own)
                keys += [(key[i], k) for k in range(len(own))]
        names = sorted(set(langs))
        if names:
            order = sorted(range(len(keys)), key=keys.__getitem__)  # whatever the order of arrival
            at = np.array([names.index(x) for x in langs])[order]
            params = fit(np.concatenate(found)[order], at, len(names), epochs, seed=seed)
        else:
            params = {}
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names], pa.list_(pa.string())),
                pa.array([list(params)], pa.list_(pa.string())),
                pa.array([[x.astype("<f4").tobytes() for x in params.values()]], pa.list_(pa.binary())),
                pa.array([[list(x.shape) for x in params.values()]], pa.list_(pa.list_(pa.int32()))),
            ],
            names=["names", "keys", "data", "shapes"],
        )

    kinds = "names array<string>, keys array<string>, data array<binary>, shapes array<array<int>>"
    # the chosen rows are shuffled to the task that trains, so that all tasks scan for them
    out = rows.repartition(1).mapInArrow(train, kinds).collect()
    if not out or not out[0]["names"]:
        return [], {}
    r = out[0]
    return r["names"], {
        k: np.frombuffer(x, "<f4").reshape(s) for k, x, s in zip(r["keys"], r["data"], r["shapes"])
    }


def identify_languages(
    docs: DataFrame, names: list[str], params: Params, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, lang_pred, score) for every row; all columns that ``docs`` has beside these stay out.

    ``und`` with score 0: null texts, texts without a letter, and all texts when
    nothing was learned.  Repeated rows and null ids are labelled one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, params))
    slim = docs.select(
        F.col(id_col).alias("__id"),
        F.col(text_col).alias("__text"),
        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
    )
    id_type = slim.schema["__id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, params = shared.value
        for batch in small_batches(batches, "__text", 4 << 20):
            ok = np.array(batch.column("__letters").to_pylist(), bool) & bool(names)
            p = pooled(params, batch.column("__text")) if names else np.zeros((batch.num_rows, 1))
            best = p.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    pa.array([names[k] if o else "und" for k, o in zip(best, ok)], pa.string()),
                    pa.array(np.where(ok, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)),
                ],
                names=["__id", "lang_pred", "score"],
            )

    return slim.mapInArrow(label, f"__id {id_type}, lang_pred string, score double").withColumnRenamed("__id", id_col)


#: Letters under which a text is too short to be told from chance.
FEW_LETTERS = 20


def least_score(languages: int) -> float:
    """The mean probability of the best language that tells a text from chance: a seventh of the way from 1/n to 1."""
    return 1 / languages + (1 - 1 / languages) / 7 - 1e-3


def keep_identified(
    docs: DataFrame, names: list[str], params: Params, least: float | None = None, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose text has a letter and is in one of the languages, with ``lang_col`` filled where it is null.

    A text goes if it has FEW_LETTERS or more letters and its best language
    stays under ``least`` (least_score() by default).  All else stays as it is; when
    nothing was learned, all texts with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((names, params))
    fills = lang_col in docs.columns and docs.schema[lang_col].dataType.simpleString() == "string"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, params = shared.value
        for batch in small_batches(batches, text_col, 4 << 20):
            if names:
                p = pooled(params, batch.column(text_col))
                letters = pc.count_substring_regex(batch.column(text_col).cast(pa.large_string()), r"\pL")
                short = pc.less(letters, FEW_LETTERS).to_numpy(zero_copy_only=False)
                if fills:
                    told = pa.array([names[k] for k in p.argmax(1)], pa.string())
                    at = batch.schema.get_field_index(lang_col)
                    known = pc.coalesce(batch.column(lang_col), told.cast(batch.schema.field(at).type))
                    batch = batch.set_column(at, batch.schema.field(at), known)
                bound = least_score(len(names)) if least is None else least
                batch = batch.filter(pa.array(short | (p.max(1) >= bound)))
            yield batch

    return docs.where(F.col(text_col).rlike(r"\p{L}")).mapInArrow(keep, docs.schema)


def not_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(__id, __text, __lang) of the documents to learn from: crc32 of the id, modulo the folds, not 0."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    return docs.where(fold != 0).select(
        F.col("doc_id").alias("__id"), F.col("text").alias("__text"), F.col("lang").alias("__lang")
    )


def language_labels(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that aren't held out."""
    names, params = train_languages(not_held_out(docs, folds))
    return identify_languages(docs, names, params).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )
