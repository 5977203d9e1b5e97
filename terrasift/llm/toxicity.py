"""Toxicity scores from a counterfactually regularised sparse linear classifier.

Features are the words of a text and their first bytes, A-Z as a-z, each once. The
classifier is logistic regression with an L1 penalty (follow-the-regularised-leader
steps), so that most words weigh nothing and a long text is judged by the words that matter. For every training text that names a group, a copy is made in which
each group term is swapped for another of its list; the squared difference of both
scores is part of the loss, so that naming a group does not move the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import map_arrow, slices, utf8

#: Terms that name groups; a term is swapped for others of its list.
IDENTITY = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "foreigners", "refugees", "natives", "citizens", "migrants"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "young"),
)
#: The most training rows of each label, taken in the order of a hash of their id.
MOST_ROWS = 3000
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, ALPHA, BETA, L1, L2, SWAP = 6, 32, 0.3, 1.0, 20.0, 0.1, 1.0

_BREAKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Model:
    """Weights by feature hash (sorted), without the features that weigh nothing."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(key: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of feature hashes per word, and each text's first word."""
    data, offsets = utf8(column)
    begin, end, first = tokens.words(data, offsets, _BREAKS)
    return tokens.prefix_hashes(data, begin, end, PREFIXES, fold=True), first


def _set(features: np.ndarray) -> np.ndarray:
    found = np.unique(features)
    return found[found != 0].view(np.int64)


def _swaps() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(word hashes sorted, list number * 100 + place) of all terms, and each list's feature rows."""
    rows = [_features(pa.array([" ".join(g)]))[0] for g in IDENTITY]
    keys = np.concatenate([r[:, 0] for r in rows])
    at = np.concatenate([i * 100 + np.arange(len(r)) for i, r in enumerate(rows)])
    order = np.argsort(keys)
    return keys[order], at[order], rows


def examples(rows: DataFrame) -> DataFrame:
    """(toxic, features, swapped) of (id, text, toxic); swapped is empty where no group is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places, groups = _swaps()
        for batch in batches:
            column = batch.column(1).fill_null("")
            for begin, stop in slices(column):
                found, first = _features(column.slice(begin, stop - begin))
                own, other = [], []
                for i in range(stop - begin):
                    f = found[first[i] : first[i + 1]]
                    own.append(_set(f))
                    at = np.minimum(np.searchsorted(keys, f[:, 0]), len(keys) - 1)
                    named = np.flatnonzero(keys[at] == f[:, 0])
                    if len(named):
                        f = f.copy()
                        for n, j in enumerate(named):
                            group, place = divmod(int(places[at[j]]), 100)
                            size = len(groups[group])
                            f[j] = groups[group][(place + 1 + (i + n) % (size - 1)) % size]
                    other.append(_set(f) if len(named) else np.zeros(0, np.int64))
                lists = (pa.array(x, pa.list_(pa.int64())) for x in (own, other))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(begin, stop - begin), *lists], names=["toxic", "features", "swapped"])

    return map_arrow(rows.select("id", "text", F.col("toxic").cast("int").alias("toxic")), run, "toxic int, features array<long>, swapped array<long>")


def train(label: np.ndarray, features: list[np.ndarray], swapped: list[np.ndarray], swap: float = SWAP, seed: int = 11) -> Model:
    """Fits the classifier; features that only one row has are left out.

    Without rows of both labels the score is the smoothed share of label 1."""
    n, positive = len(label), int(label.sum())
    if not 0 < positive < n:
        share = (positive + 1) / (n + 2)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    keys, count = np.unique(np.concatenate([*features, *swapped]), return_counts=True)
    keys = keys[count > 1]

    def index(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
        return at[keys[at] == x] if len(keys) else at[:0]

    own, other = [index(x) for x in features], [index(x) for x in swapped]
    size = len(keys) + 1  # the last is the bias, without penalty
    z, squares, w = np.zeros(size), np.zeros(size), np.zeros(size)
    # Both labels weigh alike in the loss.
    weight = np.where(label == 1, n / (2 * positive), n / (2 * (n - positive)))
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(EPOCHS):
        for rows in np.array_split(order.permutation(n), max(1, n // BATCH)):
            lengths = [len(own[i]) for i in rows]
            flat = np.concatenate([own[i] for i in rows])
            by = np.repeat(np.arange(len(rows)), lengths)
            score = np.bincount(by, w[flat], len(rows)) + w[-1]
            slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[rows]) * weight[rows]
            gradient = np.bincount(flat, slope[by], size)
            gradient[-1] = slope.sum()
            for j, i in enumerate(rows):
                if len(swapped[i]) and swap:
                    apart = np.clip(score[j] - (w[other[i]].sum() + w[-1]), -5, 5)
                    np.add.at(gradient, own[i], 2 * swap * apart)
                    np.add.at(gradient, other[i], -2 * swap * apart)
            more = squares + gradient**2
            z += gradient - (np.sqrt(more) - np.sqrt(squares)) / ALPHA * w
            squares = more
            l1 = np.full(size, L1)
            l1[-1] = 0
            w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(squares)) / ALPHA + L2))
    used = np.flatnonzero(w[:-1])
    found = keys[used].view(np.uint64) if keys.dtype == np.int64 else keys[used]
    order_ = np.argsort(found)
    return Model(found[order_], w[:-1][used][order_], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_ROWS) -> Model:
    """Learns from at most `most` rows of each label, none of them held out.

    The rows are the first in the order of a hash of their id, so the same rows
    give the same model. Ids are integers. Labels or ids that are null, and labels without a
    document, are left out; of several labels of a document the highest counts, of several
    texts the smallest, so no more than 2 * most texts reach the driver, as sets of hashes.
    A null text counts as empty; texts may be of any length; either table may be empty."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    taken = [r for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(most).collect()]
    if not taken:
        return train(np.zeros(0), [], [])
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["id"], r["toxic"]) for r in taken], "id long, toxic int")  # at most 2 * most rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    found = examples(rows).toArrow().combine_chunks()
    lists = [[x.values.to_numpy() for x in found.column(c)] for c in ("features", "swapped")]
    order = sorted(range(len(found)), key=lambda i: (len(lists[0][i]), lists[0][i].tobytes()))
    return train(found.column("toxic").to_numpy()[order].astype(float), *([x[i] for i in order] for x in lists))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", predicted: str = "predicted") -> DataFrame:
    """docs with the columns score (0 to 1) and predicted (1 from 0.5 on), replaced if
    they exist. Null and repeated ids are kept. A null or empty text gets the score of no words; every row is
    scored by its text alone, so repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = [f for f in docs.drop("score", predicted).schema.fields]
    names = [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        mask = np.uint64((1 << 20) - 1)
        sieve = np.zeros(1 << 20, bool)
        sieve[m.keys & mask] = True
        where = names.index(text_col)
        for batch in batches:
            column = batch.column(where).fill_null("")
            for begin, stop in slices(column):
                found, first = _features(column.slice(begin, stop - begin))
                doc = np.repeat(np.arange(stop - begin), np.diff(first))
                total = np.full(stop - begin, m.bias)
                if len(m.keys):
                    row, col = np.nonzero(sieve[found & mask])
                    key = found[row, col]
                    at = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
                    hit = m.keys[at] == key
                    pair = np.unique(np.stack([doc[row[hit]], at[hit]]), axis=1)
                    total += np.bincount(pair[0], m.weights[pair[1]], stop - begin)
                p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                own = [c.slice(begin, stop - begin) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", predicted])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return map_arrow(docs.select(*(F.col(f"`{n}`") for n in names)), run, f"{schema}, score double, `{predicted}` int")
