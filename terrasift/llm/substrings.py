"""Repeated long passages, by compaction of a de Bruijn graph of token k-mers.

A k-mer is a window of 20 words; it is an edge between the nodes of its first and
last 19 words. Only edges that can repeat are ever shuffled: each window names a
seed, the 6-word run of least hash in it, and equal windows have equal seeds, so
windows whose seed occurs once are left out at their document. Of the repeated
edges, each with the coordinates (document, start) of its first occurrence,
consecutive ones are joined into a path where the node between them has one
edge in and one out. A later occurrence is a stretch of a path in another place: it has
one coordinate there and one in the path's source document. The words at both are
compared before any is removed; what hashes took for equal and is not, is grouped anew by the
words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import drop, keep, map_arrow, only_ids, slices, utf8, without_ids

#: Words of a window (k-mer), and of the seed that stands for it.
WINDOW, SEED = 20, 6
#: Edges of a document that are linked in one group; groups are then joined.
STRETCH = 1024


def window_seeds(word: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, seed hash, seed start) of every window inside one document."""
    n = len(word) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    runs = tokens.window_hashes(word, seed)
    least, place = runs[:n].copy(), np.arange(n)
    for i in range(1, window - seed + 1):
        less = runs[i : i + n] < least
        np.copyto(least, runs[i : i + n], where=less)
        np.copyto(place, np.arange(i, n + i), where=less)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return doc[start], start, least[start], place[start]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(column)
    begin, end, first = tokens.words(data, offsets)
    return data, begin, end, first, tokens.word_hashes(data, begin, end)


def seeds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(id, n_words, whole, seeds): whole is the SHA-256 of the words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            for begin, stop in slices(column):
                part = column.slice(begin, stop - begin)
                *_, first, word = _words(part)
                doc, _, least, place = window_seeds(word, first, window, seed)
                # Neighbouring windows mostly share their seed: it counts once for each place.
                new = np.append(True, place[1:] != place[:-1])[: len(doc)]
                doc, least = doc[new], least[new]
                at = np.searchsorted(doc, np.arange(stop - begin + 1))
                whole = [hashlib.sha256(tokens.joined(t)).hexdigest() for t in part.to_pylist()]
                found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(least.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, stop - begin), pa.array(np.diff(first), pa.int64()), pa.array(whole), found], names=["id", "n_words", "whole", "seeds"])

    return map_arrow(docs, run, "id long, n_words long, whole string, seeds array<long>")


def edges(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(h, id, part, at, nodes, again) of the windows of (id, text, seeds, part, whole) whose
    seed is one of seeds, where the text is that of `whole` or whole is null. at: the start;
    nodes: 32 bits of the hashes of both nodes; again: its hash occurred earlier in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(0xFFFFFFFF)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for begin, stop in slices(column):
                texts = column.slice(begin, stop - begin)
                *_, first, word = _words(texts)
                doc, start, least, _ = window_seeds(word, first, window, seed)
                wanted, wholes = (batch.column(c).slice(begin, stop - begin) for c in (2, 4))
                own = np.zeros(len(doc), bool)
                at = np.searchsorted(doc, np.arange(stop - begin + 1))
                for i in range(stop - begin):
                    whole = wholes[i].as_py()
                    if whole is None or whole == hashlib.sha256(tokens.joined(texts[i].as_py())).hexdigest():
                        own[at[i] : at[i + 1]] = np.isin(least[at[i] : at[i + 1]].view(np.int64), wanted[i].values.to_numpy())
                doc, start = doc[own], start[own]
                h = tokens.window_hashes(word, window)[start]
                node = tokens.window_hashes(word, window - 1)
                nodes = (node[start] & low) << np.uint64(32) | node[start + 1] & low
                order = np.lexsort((h, doc))
                again = np.zeros(len(h), bool)
                again[order[1:]] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                ids, parts = (batch.column(c).slice(begin, stop - begin).take(pa.array(doc)) for c in (0, 3))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, parts, pa.array((start - first[doc]).astype(np.int32)), pa.array(nodes.view(np.int64)), pa.array(again)], names=["h", "id", "part", "at", "nodes", "again"])

    return map_arrow(texts.select("id", "text", "seeds", "part", "whole"), run, "h long, id long, part long, at int, nodes long, again boolean")


def compacted(repeated: DataFrame) -> DataFrame:
    """(h, source, part, at, n, path) for the repeated edges (h, source, part, at, nodes, n):
    path is the start of the edge's nonbranching path in its source document.

    An edge goes on from the one before it in its source if they share a node with one
    edge in and one out. Starts are handed on within stretches of STRETCH places, then
    from stretch to stretch in joins, each of which doubles the way."""
    tail, head = F.shiftrightunsigned("nodes", 32), F.col("nodes").bitwiseAND(F.lit(0xFFFFFFFF))
    place = F.struct("source", "part", "at")
    into = repeated.groupBy(head.alias("node")).agg(F.count("*").alias("n"), F.min(place).alias("a")).where("n = 1").select("node", "a")
    out = repeated.groupBy(tail.alias("node")).agg(F.count("*").alias("n"), F.min(place).alias("b")).where("n = 1").select("node", "b")
    here = F.struct(F.col("a.source"), F.col("a.part"), F.col("a.at") + 1)
    links = into.join(out, "node").where(here == F.col("b")).select("b.*", F.lit(True).alias("link"))
    # A link comes before the edge at its place.
    rows = links.select("source", "part", "at", "link", F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("n"))
    rows = rows.union(repeated.select("source", "part", "at", F.lit(False), "h", "n")).withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("int"))
    w = Window.partitionBy("source", "part", "stretch").orderBy("at", F.desc("link"))
    goes_on = F.coalesce(F.lag("link").over(w) & (F.lag("at").over(w) == F.col("at")), F.lit(False))
    first = F.max(F.when(~F.col("link") & ~F.col("goes_on"), F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    near = rows.withColumn("goes_on", goes_on).withColumn("path", first).where(~F.col("link"))
    near = keep(near.select("h", "source", "part", "at", "n", "stretch", "path"))
    # The path at the end of each stretch; null: that of the stretch before.
    ends = near.where(F.col("at") == (F.col("stretch") + 1) * STRETCH - 1).select("source", "part", "stretch", "path", (F.col("stretch") - 1).alias("hop"))
    while True:
        ends = keep(ends)
        if ends.where("path is null").isEmpty():
            break
        far = ends.select("source", "part", F.col("stretch").alias("hop"), F.col("path").alias("far"), F.col("hop").alias("next"))
        ends = ends.join(far, ["source", "part", "hop"], "left").select("source", "part", "stretch", F.coalesce("path", "far").alias("path"), F.coalesce("next", "hop").alias("hop"))
    ends = ends.select("source", "part", (F.col("stretch") + 1).alias("stretch"), F.col("path").alias("far"))
    return near.join(ends, ["source", "part", "stretch"], "left").select("h", "source", "part", "at", "n", F.coalesce("path", "far").alias("path"))


def _runs(starts: Column) -> Column:
    """(at, n) of the runs of consecutive numbers in a sorted array."""
    begins = F.filter(starts, lambda x, i: (i == 0) | (F.get(starts, i - 1) != x - 1))
    ends = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) != x + 1))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))


#: The stretch of a text that starts at a word, in words.
_SPAN = "array<struct<at:int,n:int>>"


def digests(asked: DataFrame) -> DataFrame:
    """(id, part, at, n, sha): the SHA-256 of the n words from at, for (id, part, whole, text,
    spans) with spans an array of (at, n); texts are told apart as in edges()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                w, spans = _own(batch, i), batch.column(4)[i].values
                if w is None or not len(spans):
                    continue
                at, n = spans.field("at").to_numpy(), spans.field("n").to_numpy()
                sha = [hashlib.sha256(b" ".join(w[a : a + b])).digest() for a, b in zip(at.tolist(), n.tolist(), strict=True)]
                ids = (pa.array([batch.column(c)[i].as_py()] * len(sha), pa.int64()) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(sha, pa.binary())], names=["id", "part", "at", "n", "sha"])

    return map_arrow(asked.select("id", "part", "whole", "text", "spans"), run, "id long, part long, at int, n int, sha binary")


def without(asked: DataFrame) -> DataFrame:
    """(id, part, whole, spans, n_removed, kept, wrong) of (id, part, whole, text, spans), spans an
    array of (at, n, sha): those whose words have another SHA-256 than sha (null: any) are
    wrong, the words of all others go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            out: list[tuple] = []
            for i in range(len(batch)):
                w, asked = _own(batch, i), batch.column(4)[i].values
                if w is None:
                    continue
                same, wrong = [], []
                change = np.zeros(len(w) + 1, np.int64)
                for s in asked.to_pylist():
                    a, b = s["at"], s["at"] + s["n"]
                    if s["sha"] is None or s["sha"] == hashlib.sha256(b" ".join(w[a:b])).digest():
                        same.append({"at": a, "n": s["n"]})
                        change[a] += 1
                        change[b] -= 1
                    else:
                        wrong.append({"at": a, "n": s["n"]})
                stay = np.cumsum(change)[: len(w)] == 0
                kept = b" ".join(x for x, s in zip(w, stay.tolist(), strict=True) if s).decode()
                out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), same, len(w) - int(stay.sum()), kept, wrong))
            kinds = (pa.int64(), pa.int64(), pa.string(), span, pa.int64(), pa.string(), span)
            names = ["id", "part", "whole", "spans", "n_removed", "kept", "wrong"]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=names)

    return map_arrow(asked.select("id", "part", "whole", "text", "spans"), run, f"id long, part long, whole string, spans {_SPAN}, n_removed long, kept string, wrong {_SPAN}")


def _own(batch: pa.RecordBatch, i: int) -> list[bytes] | None:
    """The words of row i of (id, part, whole, text, ...), or none where whole names another text."""
    whole, w = batch.column(2)[i].as_py(), (batch.column(3)[i].as_py() or "").encode().split()
    return w if whole is None or whole == hashlib.sha256(b" ".join(w)).hexdigest() else None


class Repeats:
    """The repeated passages of documents (id_col, text_col); use it inside a workspace().

    whole: (id, n_words, whole) of every row with an id; a null text has no words. whole is
    the SHA-256 of the words, which tells rows of one id apart.
    copies: (id, whole, part) whose word sequence a smaller id has (of at least `window` words).
    paths: (source, part, start, words, n): compacted repeated passages at their first occurrence.
    removed: (id, part, whole, spans, n_removed, kept) of the documents that lose words but are
    no copies: spans are the stretches that occur earlier, as an array of (at, n) in words,
    confirmed on the words; kept has the words outside them, joined by one space. whole is
    null and part 0 where the id has one text only.

    Ids are integers. Rows without id have no place in the order and go. Rows with equal
    ids but other texts are documents of their own, none of which comes before the other;
    repeated rows get equal results. Empty tables give empty results, other columns
    are ignored. Texts may have any length.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED):
        self.window = window
        self.texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        found = self._edges(seed)
        least = found.groupBy("h").agg(F.min(F.struct("id", "part", "at", "nodes")).alias("least"), F.count("*").alias("n")).where("n > 1")
        repeated = keep(least.select("h", F.col("least.id").alias("source"), F.col("least.part").alias("part"), F.col("least.at").alias("at"), F.col("least.nodes").alias("nodes"), "n"))
        self.edges = keep(compacted(repeated))
        drop(repeated)
        self.removed = self._removed(found)
        drop(found)

    def _edges(self, seed: int) -> DataFrame:
        """The edges that can repeat, kept; sets whole, copies and parts."""
        kept = keep(seeds(self.texts, self.window, seed))
        # Ids with several texts: (id, whole, part), part a number of the text.
        again = keep(kept.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
        rows = only_ids(kept, again, "id").select("id", "whole").distinct()
        several = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        self.parts = keep(rows.join(several, "id").select("id", "whole", F.conv(F.substring("whole", 1, 15), 16, 10).cast("long").alias("part")))
        if not again.isEmpty():
            self.texts = without_ids(self.texts, again, "id").union(only_ids(self.texts, again, "id").dropDuplicates(["id", "text"]))
        part = F.coalesce("part", F.lit(0)).alias("part")
        named = kept.join(self.parts, ["id", "whole"], "left")
        self.whole = keep(named.select("id", "n_words", "whole", part))
        first = keep(self.whole.where(F.col("n_words") >= self.window).groupBy("whole").agg(F.min("id").alias("first")))
        self.copies = keep(self.whole.join(first, "whole").where("id <> first").select("id", "whole", "part"))
        # What a copy repeats, its original has as well.
        left = without_ids(named.where(F.size("seeds") > 0).select("id", part, "seeds"), self.copies.select("id", "part"), ["id", "part"])
        each = left.select("id", "part", F.explode("seeds").alias("s"))
        # Written first: a join with a plain table is one whose large partitions Spark can split.
        often = keep(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select("s"))
        own = each.join(often, "s").groupBy("id", "part").agg(F.collect_set("s").alias("seeds"))
        own = own.join(self.parts, ["id", "part"], "left").select("id", "part", "whole", "seeds")
        own = keep(own)
        drop(kept, often)
        wanted = only_ids(self.texts, own.select("id").distinct(), "id").join(own, "id")
        return keep(edges(wanted, self.window, seed))

    def _occurrences(self, found: DataFrame) -> DataFrame:
        """(id, part, at, n, source, source_part, source_at), kept: stretches of n words of paths
        that occur after their source, by hash."""
        edge = self.edges.select("h", "source", F.col("part").alias("source_part"), F.col("at").alias("source_at"), "path")
        met = found.select("h", "id", "part", "at", "again").join(edge, "h").where((F.col("id") > F.col("source")) | F.col("again"))
        # A path and the distance between both coordinates, in one number.
        shift = F.col("at") - F.col("source_at")
        lane = F.shiftleft(F.col("path").cast("long"), 32) + shift
        by = met.groupBy("id", "part", "source", "source_part", lane.alias("lane")).agg(F.array_sort(F.collect_set("at")).alias("starts"))
        spans = by.withColumn("path", F.shiftright(F.col("lane") + F.lit(1 << 31), 32)).withColumn("shift", (F.col("lane") - F.shiftleft("path", 32)).cast("int"))
        spans = spans.select("id", "part", "source", "source_part", "shift", F.explode(_runs(F.col("starts"))).alias("r"))
        return keep(spans.select("id", "part", F.col("r.at").alias("at"), (F.col("r.n") + self.window - 1).alias("n"), "source", "source_part", (F.col("r.at") - F.col("shift")).alias("source_at")))

    def _asked(self, spans: DataFrame, *columns: str) -> DataFrame:
        """(id, part, whole, text, spans): the texts that spans (id, part, *columns) lie in."""
        by = spans.groupBy("id", "part").agg(F.collect_set(F.struct(*columns)).alias("spans"))
        by = by.join(self.parts, ["id", "part"], "left").select("id", "part", "whole", "spans")
        return only_ids(self.texts, by.select("id").distinct(), "id").join(by, "id").select("id", "part", "whole", "text", "spans")

    def _removed(self, found: DataFrame) -> DataFrame:
        """removed, kept: spans count where the words at both coordinates are the same."""
        spans = self._occurrences(found)
        source = spans.select(F.col("source").alias("id"), F.col("source_part").alias("part"), F.col("source_at").alias("at"), "n").distinct()
        there = keep(digests(self._asked(source, "at", "n")), rows_at_once=256)
        named = there.select(F.col("id").alias("source"), F.col("part").alias("source_part"), F.col("at").alias("source_at"), "n", "sha")
        wanted = spans.join(named, ["source", "source_part", "source_at", "n"]).select("id", "part", "at", "n", "sha")
        once = keep(without(self._asked(wanted, "at", "n", "sha")), rows_at_once=256)
        drop(spans, there)
        bad = once.where(F.size("wrong") > 0)
        if bad.isEmpty():
            return once.drop("wrong")
        each = lambda df, c: df.select("id", "part", F.explode(c).alias("s")).select("id", "part", "s.at", "s.n")
        exact = keep(self._regrouped(each(bad, "wrong"), found))
        others = keep(bad.select("id", "part").union(exact.select("id", "part")).distinct())
        good = each(once.join(others, ["id", "part"], "left_semi"), "spans").union(exact).withColumn("sha", F.lit(None).cast("binary"))
        anew = without(self._asked(good, "at", "n", "sha"))
        return keep(once.join(others, ["id", "part"], "left_anti").union(anew).drop("wrong"), rows_at_once=256)

    def _regrouped(self, bad: DataFrame, found: DataFrame) -> DataFrame:
        """(id, part, at, n): the windows of spans that are not what their hashes say, with all others
        of those hashes, grouped by their words: each but the first."""
        places = bad.select("id", "part", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - self.window)).alias("at"))
        hashes = found.join(places, ["id", "part", "at"], "left_semi").select("h").distinct()
        windows = found.join(hashes, "h", "left_semi").select("id", "part", "at", F.lit(self.window).alias("n")).distinct()
        exact = keep(digests(self._asked(windows, "at", "n")), rows_at_once=256)
        first = exact.groupBy("sha").agg(F.min("id").alias("least"))
        own = exact.groupBy("sha", "id", "part").agg(F.min("at").alias("own"))
        later = exact.join(first, "sha").join(own, ["sha", "id", "part"]).where((F.col("id") > F.col("least")) | (F.col("at") > F.col("own")))
        return later.select("id", "part", "at", "n")

    @property
    def paths(self) -> DataFrame:
        return self.edges.groupBy("source", "part", F.col("path").alias("start")).agg((F.count("*") + self.window - 1).cast("long").alias("words"), F.max("n").alias("n"))
