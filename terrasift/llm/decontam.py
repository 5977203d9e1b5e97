"""Benchmark decontamination by greedy string tiling.

Words are compared with A-Z as a-z. A document and a benchmark item are compared
if they share a run of `seed` words (a shorter item: all its words). Tiling then
repeatedly marks the longest match of unmarked words on both sides, found by
Karp-Rabin hashes of runs that get shorter, until no match of `seed` words is
left. The share of the item's words under tiles counts, wherever the tiles lie,
so passages in another order are found as well.

Tiles consist of shared seeds. So a pair of which a share of the words is wanted is
tiled only if shared seeds can cover as many of the item's words: most pairs that share only a
very common passage go by counting. This bound is exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import keep, map_arrow, settled, slices, utf8, workspace

SEED = 5
COVERAGE = 0.5
#: The most bytes of benchmark text that are broadcast; a larger benchmark takes the shuffled join.
MOST_BYTES = 32_000_000


def tile(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(document start, item start, length) of the tiles between two sequences of word hashes.

    Every round looks for the longest matches there are, in document order, then
    item order, and marks those that do not overlap what is marked."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    least = max(1, min(least, len(item)))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= least:
        low, high, found = least, most, None
        # The longest common run of unmarked words, by bisection over its length.
        while low <= high:
            k = (low + high) // 2
            now = _matches(doc, item, free_doc, free_item, k)
            if len(now[0]):
                low, found = k + 1, (k, now)
            else:
                high = k - 1
        if found is None:
            break
        most, (p, q) = found
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            if free_doc[a : a + most].all() and free_item[b : b + most].all():
                tiles.append((a, b, most))
                free_doc[a : a + most] = False
                free_item[b : b + most] = False
    return tiles


def _free(free: np.ndarray, k: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(total[k:] - total[:-k] == k)


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of equal unmarked runs of k words: at most one item start for each
    occurrence that still can be marked, in order."""
    p, q = _free(free_doc, k), _free(free_item, k)
    if not len(p) or not len(q):
        return p[:0], q[:0]
    hd, hi = tokens.window_hashes(doc, k)[p], tokens.window_hashes(item, k)[q]
    order = np.argsort(hi, kind="stable")
    first, last = np.searchsorted(hi[order], hd), np.searchsorted(hi[order], hd, side="right")
    hit = np.flatnonzero(last > first)
    # The n-th document run of a content meets its n-th item run.
    _, group = np.unique(hd[hit], return_inverse=True)
    by = np.argsort(group, kind="stable")
    nth = np.empty(len(hit), np.int64)
    start = np.searchsorted(group[by], group[by])
    nth[by] = np.arange(len(hit)) - start
    use = nth < (last - first)[hit]
    hit, nth = hit[use], nth[use]
    p, q = p[hit], q[order[first[hit] + nth]]
    same = np.array([np.array_equal(doc[a : a + k], item[b : b + k]) for a, b in zip(p, q, strict=True)], bool)
    return p[same], q[same]


def _items(texts: list[str], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word hashes, seed hashes) of each item."""
    out = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        begin, end, _ = tokens.words(data, np.array([0, len(data)]))
        w = tokens.word_hashes(data, begin, end, fold=True)
        out.append((w, np.unique(tokens.window_hashes(w, min(seed, len(w)))) if len(w) else np.zeros(0, np.uint64)))
    return out


def _needed(n_words: int, coverage: float) -> int:
    """How many words of an item must be covered; any one where coverage is 0."""
    return max(1, math.ceil(coverage * n_words - 1e-9))


def _covered(doc: np.ndarray, item: np.ndarray, seed: int, coverage: float) -> int | None:
    """The item's words under tiles, or None where its shared seeds cannot cover enough."""
    k = min(seed, len(item))
    shared = np.flatnonzero(np.isin(tokens.window_hashes(item, k), tokens.window_hashes(doc, k)))
    under = np.zeros(len(item) + 1, np.int64)
    np.add.at(under, shared, 1)
    np.add.at(under, shared + k, -1)
    if int((np.cumsum(under)[:-1] > 0).sum()) < _needed(len(item), coverage):
        return None
    return sum(n for *_, n in tile(doc, item, seed))


SCHEMA = "id long, item_id long, n_covered long, n_words long"


def tiled(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", seed: int = SEED, coverage: float = 0.0) -> DataFrame:
    """(id, item_id, n_covered, n_words) of every document and item that share a seed, but for
    those of which less than coverage can be covered: where that is sure, they are left out.

    Ids are integers, texts of any length. Rows without id or item id have no identity and go; null texts and texts
    without words share no seed; repeated rows give equal results once each;
    either table may be empty; other columns are ignored. The benchmark is
    broadcast if its texts have at most MOST_BYTES bytes; beyond that seeds meet in
    a shuffled join, with equal results.
    """
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    return _broadcast(source, items, seed, coverage) if size <= MOST_BYTES else _shuffled(source, items, seed, coverage)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    begin, end, first = tokens.words(data, offsets)
    return tokens.word_hashes(data, begin, end, fold=True), first


class _Index:
    """The seeds of all items, sorted, by length (items shorter than a seed have their own)."""

    def __init__(self, rows: list[tuple[int, str]], seed: int, coverage: float):
        self.parts = _items([t for _, t in rows], seed)
        self.numbers = np.array([i for i, _ in rows], np.int64)
        self.least = np.array([_needed(len(w), coverage) for w, _ in self.parts], np.int64)
        self.tables = {}
        for k in sorted({min(seed, len(w)) for w, _ in self.parts if len(w)}):
            own = [(s, i) for i, (w, s) in enumerate(self.parts) if len(w) and min(seed, len(w)) == k]
            keys = np.concatenate([s for s, _ in own])
            owner = np.concatenate([np.full(len(s), i) for s, i in own])
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << 22, bool)
            sieve[keys & np.uint64((1 << 22) - 1)] = True
            self.tables[k] = keys[order], owner[order], sieve

    def met(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) whose shared seeds, each with its k words, can cover enough."""
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for k, (keys, owner, sieve) in self.tables.items():
            h = tokens.window_hashes(word, k)
            at = np.flatnonzero(sieve[h & np.uint64((1 << 22) - 1)])
            at = at[doc[at] == doc[at + k - 1]]
            low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
            at, low, high = (x[high > low] for x in (at, low, high))
            # A document's own seeds, each once; low names the seed.
            for a, b in zip(*(np.searchsorted(doc[at], np.unique(doc[at]), side=s) for s in ("left", "right")), strict=True):
                start, pick = np.unique(low[a:b], return_index=True)
                size = high[a:b][pick] - start
                entry = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                items, count = np.unique(owner[entry], return_counts=True)
                yield from ((int(doc[at[a]]), int(i)) for i in items[count * k >= self.least[items]])


_BUILT: dict[str, _Index] = {}


def _broadcast(source: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    rows = items.collect()  # at most MOST_BYTES, see tiled()
    sent = source.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:  # once for each worker, which holds the last one
            _BUILT.clear()
            _BUILT[name] = _Index(sent.value, seed, coverage)
        index = _BUILT[name]
        for batch in batches:
            column = batch.column(1).fill_null("")
            ids = batch.column(0).to_numpy()
            for begin, stop in slices(column):
                word, first = _words(column.slice(begin, stop - begin))
                out = []
                for d, i in index.met(word, first):
                    item = index.parts[i][0]
                    n = _covered(word[first[d] : first[d + 1]], item, seed, coverage)
                    if n is not None:
                        out.append((ids[begin + d], index.numbers[i], n, len(item)))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["id", "item_id", "n_covered", "n_words"])

    return map_arrow(source, run, SCHEMA)


def _grams(rows: DataFrame, lengths: list[int] | None, seed: int) -> DataFrame:
    """(id, seed, k, n): the distinct runs of k words of each text (id, text) of n words, for each
    of lengths, or for its own length where that is under seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            for begin, stop in slices(column):
                word, first = _words(column.slice(begin, stop - begin))
                out = []
                for i in range(stop - begin):
                    own = word[first[i] : first[i + 1]]
                    for k in lengths or ([min(seed, len(own))] if len(own) else []):
                        h = np.unique(tokens.window_hashes(own, k)).view(np.int64)
                        out.append((np.full(len(h), batch.column(0)[begin + i].as_py()), h, np.full(len(h), k), np.full(len(h), len(own))))
                columns = [np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:])], names=["id", "seed", "k", "n"])

    return map_arrow(rows, run, "id long, seed long, k int, n int")


def _shuffled(source: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """Seeds of both sides meet in a join; the pairs found take their texts from two more.

    Of an item with s seeds of which m must be shared, any s - m + 1 hold a shared one: the
    rarest among documents are taken, so very common seeds make no pairs."""
    own = keep(_grams(items.select(F.col("item_id").alias("id"), "text"), None, seed).withColumnRenamed("id", "item_id"))
    lengths = sorted(r["k"] for r in own.select("k").distinct().collect())  # at most `seed` rows
    theirs = _grams(source, lengths, seed).select("id", "seed", "k").join(own.select("seed", "k").distinct(), ["seed", "k"], "left_semi")
    theirs = keep(theirs)
    often = theirs.groupBy("seed", "k").agg(F.count("*").alias("often"))
    needed = F.ceil(F.greatest(F.lit(1), F.ceil(coverage * F.col("n") - 1e-9)) / F.col("k"))
    of = Window.partitionBy("item_id")
    ranked = own.join(often, ["seed", "k"], "left").withColumn("at", F.row_number().over(of.orderBy(F.coalesce("often", F.lit(0)), "seed"))).withColumn("all", F.count("*").over(of))
    rare = keep(ranked.where(F.col("at") <= F.col("all") - needed + 1).select("item_id", "seed", "k"))
    pairs = keep(theirs.join(rare, ["seed", "k"]).select("id", "item_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, i, text, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (doc, _), (own, _) = _items([text, item], seed)
                n = _covered(doc, own, seed, coverage)
                if n is not None:
                    out.append((d, i, n, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["id", "item_id", "n_covered", "n_words"])

    rows = pairs.join(items.withColumnRenamed("text", "item"), "item_id").join(source, "id").select("id", "item_id", "text", "item")
    return map_arrow(rows, run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """(id, item_id, n_covered, n_words, coverage) of the documents whose tiles cover
    at least `coverage` of an item's words; see tiled() for nulls, ties and repeated rows."""
    with workspace(docs.sparkSession):
        rows = settled(tiled(docs, benchmark, coverage=coverage, **options).distinct())
    return rows.withColumn("coverage", F.col("n_covered") / F.col("n_words")).where(F.col("coverage") >= coverage)
