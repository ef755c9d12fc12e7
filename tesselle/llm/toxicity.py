"""Toxicity by class-conditional Kneser-Ney models.

Two models spell words byte by byte, each byte given the five before it (word starts are padded): one has
the counts of toxic texts, one those of ordinary texts. Both back off to the same lower orders, whose
continuation counts are those of the two classes together; a rare expression thus draws on what its
beginnings and parts show. Where neither class has seen a byte after its context, the shared backoff cancels
and only the classes' backoff weights differ, so the log ratio of a word needs two table look-ups a byte.
Every word is spelt to its end; one of more than LONGEST bytes is scored in pieces, each given the bytes before it.

A text's score compares its likelihoods under the two models, normalised by its length. One word can make a text toxic, and a long text has
few of them, so three readings of that comparison enter a logistic function: the mean log ratio, the largest of a word, and the mean evidence
that a share of its words is toxic (in whole and by the word). The function is fitted on a fold that the counts have not seen; nothing but log
ratios enters it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import FOLDED, LOWER, U, between, passes, prefix, text_bytes, trimmed, words
from .labelled import fold
from .scratch import drop, saved

#: Bytes a model sees, with the one it predicts.
ORDER = 6
DISCOUNT = 0.75
_BITS, _END = 9, 257
_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
#: Longer words are scored in pieces of so many bytes, so that what one says is not lost in a text without spaces.
LONGEST = 48
#: Pieces spelt at once.
PIECES = 1 << 14
SHARE = 0.02
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, log_ratio double, n_words long"


@cache
def _breaks() -> np.ndarray:
    """Which characters of the basic plane are spaces, controls or punctuation."""
    return np.array([c > 127 and (unicodedata.category(chr(c))[0] in "ZP" or unicodedata.category(chr(c)) == "Cc") for c in range(1 << 16)])


def spaced(data: np.ndarray) -> np.ndarray:
    """The bytes with spaces for those of non-ASCII spaces and punctuation."""
    out = data
    for lead, beyond, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3)):
        leads = data[: max(0, len(data) - size + 1)]
        at = np.flatnonzero((leads >= lead) & (leads < beyond))
        if len(at):
            code = data[at].astype(np.int64) & (0xFF >> (size + 1))
            for k in range(1, size):
                code = code << 6 | data[at + k] & 0x3F
            at = at[_breaks()[code]]
            if len(at):
                out = data.copy() if out is data else out
                for k in range(size):
                    out[at + k] = 32
    return out


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word in pieces of LONGEST bytes: the word, start and end of each piece."""
    counts = -(-(ends - starts) // LONGEST)
    word = np.repeat(np.arange(len(starts)), counts)
    start = starts[word] + LONGEST * (np.arange(len(word)) - (np.cumsum(counts) - counts)[word])
    return word, start, np.minimum(start + LONGEST, ends[word])


def spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of the ORDER bytes up to each byte of each piece, and up to the end of its word, and whose piece each is.

    The words begin at ``heads`` and end at ``tails``; without these each piece is a word.
    """
    heads, tails = starts if heads is None else heads, ends if tails is None else tails
    sizes = ends - starts + (ends == tails) + ORDER - 1
    firsts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(int(sizes.sum())) - firsts[owner] - (ORDER - 1)
    at = starts[owner] + place
    codes = np.zeros(len(owner), np.int64)
    inside = (at >= heads[owner]) & (at < ends[owner])
    codes[inside] = LOWER[data[at[inside]]].astype(np.int64) + 1
    codes[at == ends[owner]] = _END
    packed = codes.copy()
    for k in range(1, ORDER):
        packed[k:] |= codes[:-k] << (_BITS * k)
    keep = place >= 0
    return packed[keep], owner[keep]


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, *(np.bincount(at, w, len(unique)) for w in weights)


def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def fit(vocabulary: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> dict[str, np.ndarray]:
    """The log ratios of seen codes and of contexts, from the words' counts in each class."""
    data = np.frombuffer(b"".join(vocabulary), np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary]) if vocabulary else np.zeros(0, np.int64)
    codes, owner = spelt(data, np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends, ends)
    return fitted(*_sums(codes, toxic[owner], ordinary[owner]))


def fitted(seen: np.ndarray, c_tox: np.ndarray, c_ord: np.ndarray) -> dict[str, np.ndarray]:
    """As :func:`fit`, from the counts of each code, in order of the codes."""
    # shared lower orders: how many different longer codes end in each
    cut = lambda keys, n: keys & ((1 << _BITS * n) - 1)
    orders = [(seen, None)]
    for n in range(ORDER - 1, 0, -1):
        orders.append(_sums(cut(orders[-1][0], n), np.ones(len(orders[-1][0]))))
    p_table = None
    for n, (tails, continued) in enumerate(reversed(orders[1:]), 1):
        context, total, kinds = _sums(tails >> _BITS, continued, np.ones(len(tails)))
        at = np.searchsorted(context, tails >> _BITS)
        below = np.full(len(tails), 1 / 258) if p_table is None else _get(*p_table, cut(tails, n - 1))
        p_table = (tails, (np.maximum(continued - DISCOUNT, 0) + DISCOUNT * kinds[at] * below) / total[at])
    shared = np.maximum(_get(*p_table, cut(seen, ORDER - 1)), 1e-12)
    context, t_tox, t_ord, k_tox, k_ord = _sums(seen >> _BITS, c_tox, c_ord, (c_tox > 0) * 1.0, (c_ord > 0) * 1.0)
    weight = lambda total, kinds: np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
    w_tox, w_ord = weight(t_tox, k_tox), weight(t_ord, k_ord)
    at = np.searchsorted(context, seen >> _BITS)
    chance = lambda c, total, w: np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1e-9) + w * shared
    ratio = np.log(chance(c_tox, t_tox[at], w_tox[at])) - np.log(chance(c_ord, t_ord[at], w_ord[at]))
    return {"seen": seen, "ratio": ratio, "context": context, "open": np.log(w_tox / w_ord)}


def word_ratios(model: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray | None = None, tails: np.ndarray | None = None) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word, or of each piece of the words from ``heads`` to ``tails``."""
    out = np.zeros(len(starts))
    if not len(model["seen"]):
        return out
    for first in range(0, len(starts), PIECES):
        own = slice(first, first + PIECES)
        codes, owner = spelt(data, starts[own], ends[own], *(x if x is None else x[own] for x in (heads, tails)))
        at = np.minimum(np.searchsorted(model["seen"], codes), len(model["seen"]) - 1)
        hit = model["seen"][at] == codes
        value = np.where(hit, model["ratio"][at], 0.0)
        if not hit.all():
            value[~hit] = _get(model["context"], model["open"], codes[~hit] >> _BITS)
        out[own] = np.bincount(owner, value, len(out[own]))
    return out


def features(model: dict[str, np.ndarray], batch: pa.RecordBatch) -> np.ndarray:
    """Per row: mean log ratio, largest of a piece (0 if none), evidence for a share of toxic pieces in all and a piece, words."""
    data, bounds = text_bytes(batch.column("text"))
    data = spaced(data)
    starts, ends, rows = words(data, bounds, _WORD)
    out = np.zeros((batch.num_rows, 5))
    if len(starts):
        n = np.bincount(rows, minlength=batch.num_rows)
        word, start, end = pieces(starts, ends)
        head, tail, rows = starts[word], ends[word], rows[word]
        # a piece is known by its bytes, those it is given, and whether its word begins before it or goes on
        hashes = between(prefix(data, FOLDED), np.maximum(start - (ORDER - 1), head), end)
        hashes += (start > head) * U(0x9E3779B97F4A7C15) + (end < tail) * U(0xD1B54A32D192ED03)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        ratio = word_ratios(model, data, start[first], end[first], head[first], tail[first])[which]
        some = np.maximum(np.bincount(rows, minlength=batch.num_rows), 1)
        out[:, 0] = np.bincount(rows, ratio, batch.num_rows) / some
        np.maximum.at(out[:, 1], rows, ratio)
        evidence = np.bincount(rows, np.log1p(SHARE * np.expm1(np.minimum(ratio, 30.0))), batch.num_rows)
        out[:, 2], out[:, 3], out[:, 4] = np.sign(evidence) * np.log1p(np.abs(evidence)), evidence / some, n
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], np.log1p(np.maximum(x[:, 1], 0)), x[:, 2], x[:, 3] * 10])


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scores(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _chance(_design(x) @ weights)


def _slopes(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of a partition's rows: how many there are, how many are toxic, and the gradient and the curvature of their likelihood."""
    n, slope, bend = np.zeros(2), np.zeros(len(w)), np.zeros((len(w), len(w)))
    for batch in batches:
        x, y = _design(np.column_stack([batch.column(c).to_numpy() for c in "abcde"])), batch.column("toxic").to_numpy().astype(float)
        p = _chance(x @ w)
        n += len(y), y.sum()
        slope += x.T @ (y - p)
        bend += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([n, slope, bend.ravel()])], pa.list_(pa.float64()))], names=["sums"])


def _logistic(x: DataFrame, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression by damped Newton steps, of which each sums over all rows where they are; without both labels, a constant."""
    w = np.zeros(5)
    penalty = np.diag([1e-6] + [ridge] * (len(w) - 1))
    for _ in range(60):
        sums = sum(np.array(r.sums) for r in x.mapInArrow(partial(_slopes, w=w), "sums array<double>").collect())
        n, toxic, slope, bend = sums[0], sums[1], sums[2 : 2 + len(w)], sums[2 + len(w) :].reshape(len(w), len(w))
        if toxic in (0, n):
            w[0] = -3.0 if toxic == 0 else 3.0
            return w
        step = np.linalg.solve(bend + penalty, slope - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


@trimmed
def _code_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            toxic = batch.column("toxic").to_numpy() == 1
            data, bounds = text_bytes(batch.column("text"))
            data = spaced(data)
            starts, ends, rows = words(data, bounds, _WORD)
            if not len(starts):
                continue
            hashes = between(prefix(data, FOLDED), starts, ends)
            _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            bad, good = (np.bincount(which, x[rows], len(first)) for x in (toxic, ~toxic))
            word, start, end = pieces(starts[first], ends[first])
            parts = []
            for at in range(0, len(word), PIECES):
                own = slice(at, at + PIECES)
                codes, owner = spelt(data, start[own], end[own], starts[first][word[own]], ends[first][word[own]])
                parts.append(_sums(codes, *(x[word[own]][owner] for x in (bad, good))))
            sums = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in sums], names=["code", "toxic", "ordinary"])


@trimmed
def _features(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            x = features(model.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(x[:, i]) for i in range(5))], names=["doc_id", "toxic", "a", "b", "c", "d", "e"])


@trimmed
def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for whole in batches:
        for batch in passes(whole):
            x = features(model.value, batch)
            s = scores(model.value["weights"], x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 0]), pa.array(x[:, 4].astype(np.int64))], names=names)


@trimmed
def _harmless(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in passes(whole):
            yield batch.filter(pa.array(scores(model.value["weights"], features(model.value, batch)) < 0.5))


def _known(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of documents outside the held-out fold; one with both labels counts as toxic, a null label is no label."""
    return labels.where("toxic in (0, 1) and doc_id is not null").where(fold() != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def label_shares(labels: DataFrame) -> dict[int, int]:
    """How many documents outside the held-out fold carry each label; one with both counts as toxic."""
    return {r[0]: r[1] for r in _known(labels).groupBy("toxic").count().collect()}


def train(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """Models and weights from all labelled rows whose fold is not 0.

    Rows of fold 1 fit the weights, the others the counts; a null label is no label, and of a document with
    both labels the toxic one counts. Without toxic rows every score is low. The driver gets the counts of codes and sums alone, no row.
    """
    spark = docs.sparkSession
    # labels can be as many as documents, so neither side is sent to all machines
    rows = saved(docs.select("doc_id", "text").join(_known(labels).hint("merge"), "doc_id").withColumn("fold", fold()), "labelled")
    counts = rows.where("fold != 1").select("text", "toxic").mapInArrow(_code_counts, "code long, toxic long, ordinary long")
    table = counts.groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).orderBy("code").toArrow()
    model = fitted(table.column("code").to_numpy(), table.column("toxic").to_numpy().astype(float), table.column("ordinary").to_numpy().astype(float))
    sent = spark.sparkContext.broadcast(model)
    x = rows.where("fold = 1").select("doc_id", "text", "toxic").mapInArrow(partial(_features, model=sent), "doc_id long, toxic int, a double, b double, c double, d double, e double")
    # in one order, so that the sums are the same each time
    x = x.repartition(spark.sparkContext.defaultParallelism, "doc_id").sortWithinPartitions("doc_id", *"abcde").persist()
    try:
        weights = _logistic(x)
    finally:
        x.unpersist()
    sent.destroy()
    drop(rows)
    return model | {"weights": weights}


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted, log_ratio, n_words for each row of ``docs``; nulls count as empty texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(partial(_score, model=sent), SCHEMA)


def without_toxic(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_harmless, model=sent), docs.schema)
