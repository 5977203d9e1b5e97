"""Near-duplicate documents by b-bit MinHash.

Copies (equal word sequences) are first folded into one. Each text left gets
128 minima over its shingles; 24 bands of 5 minima make candidates, and the low
4 bits of every minimum are packed into 8 longs, from which the similarity is
estimated by counting bits and correcting for chance agreement. The exact
similarity of the full shingle sets decides.

Two texts of similarity 0.85 share no band with probability 8e-7, of 0.8 with
6e-5. Within a bucket no pair is emitted: each text is first compared with the
smallest of its bucket. Of what is not yet connected then, the members outside the
bucket's most frequent component meet all others, block by block; a block estimates
each pair first, compares shingle sets where the estimate allows a link, and returns a
spanning forest of its links. Components so are those of all links between texts
that share a band; every link they rest on is confirmed on the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import drop, keep, map_arrow, only_ids, settled, ship, slices, utf8, workspace
from .components import components

BANDS, ROWS, MINIMA, BITS = 24, 5, 128, 4
#: Six standard deviations of the estimate: below the threshold by more than this, a pair is no link.
MARGIN = 0.2
#: Texts and shingles of a part of a bucket, of which two are compared at a time.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Texts that are compared with one bucket's smallest in a group.
GROUP = 64
_LOW = 0x1111111111111111


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(77))
    return r.integers(1, 2**63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, MINIMA, np.uint64)


def minima(hashes: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over a set of shingle hashes."""
    a, b = (x[:, None] for x in seeds)
    with np.errstate(over="ignore"):
        return np.minimum.reduce([(hashes[None, i : i + 2048] * a + b).min(axis=1) for i in range(0, len(hashes), 2048)])


def shingle_hashes(word: np.ndarray, window: np.ndarray, first: int, last: int, k: int) -> np.ndarray:
    """Distinct shingle hashes of the words first:last; the whole sequence where it is shorter than k."""
    n = last - first
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < k:
        return tokens.window_hashes(word[first:last], n)
    return np.unique(window[first : last - k + 1])


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, n_shingles, seq, bands, sig) for each row (id, text); seq is the SHA-256 of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        place = np.arange(MINIMA // 16 * 16, dtype=np.uint64).reshape(-1, 16) % np.uint64(16) * np.uint64(BITS)
        turn = tokens.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for start, stop in slices(column):
                data, offsets = utf8(column.slice(start, stop - start))
                begin, end, first = tokens.words(data, offsets)
                word = tokens.word_hashes(data, begin, end, fold=True)
                window = tokens.window_hashes(word, k)
                size, seq, bands, sig = [], [], [], []
                texts = column.slice(start, stop - start).to_pylist()
                for i in range(stop - start):
                    own = shingle_hashes(word, window, first[i], first[i + 1], k)
                    size.append(len(own))
                    seq.append(hashlib.sha256(tokens.joined(texts[i], fold=True)).digest())
                    if not len(own):
                        bands.append(np.zeros(0, np.int64))
                        sig.append(np.zeros(0, np.int64))
                        continue
                    least = tokens.mix(minima(own, seeds))
                    with np.errstate(over="ignore"):
                        band = tokens.mix((least[: BANDS * ROWS].reshape(BANDS, ROWS) * turn).sum(axis=1) + np.arange(BANDS, dtype=np.uint64))
                    bands.append(band.view(np.int64))
                    low = (least & np.uint64(15)).reshape(-1, 16) << place
                    sig.append(np.bitwise_or.reduce(low, axis=1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(size, pa.int64()), pa.array(seq, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, sig))],
                    names=["id", "n_shingles", "seq", "bands", "sig"],
                )

    return map_arrow(docs, run, "id long, n_shingles long, seq binary, bands array<long>, sig array<long>")


def estimate(one: Column, two: Column) -> Column:
    """Similarity from packed signatures: the share of agreeing minima, corrected
    for the 1 in 2**BITS that agree by chance."""
    differ: Column = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = one[i].bitwiseXOR(two[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    chance = 1 / 2**BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _shingles(text: str, k: int) -> set:
    w = text.encode().lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)}


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the distinct pairs whose full shingle sets are similar enough.

    The pairs of one a are dealt to groups of about GROUP; a's text goes to each once."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts = table.column("id").to_pylist(), table.column("text").to_pylist()
        at = table.column("own").to_pylist().index(True)
        own, found = _shingles(texts[at], k), []
        for i, t in zip(ids, texts, strict=True):
            if i != ids[at]:
                other = _shingles(t, k)
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append(i)
        return pa.table({"a": pa.array([ids[at]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    ship(pairs.sparkSession)
    texts = texts.dropDuplicates(["id"])
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    theirs = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts").cast("long")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(False).alias("own"))
    mine = theirs.select("a", "part", F.col("a").alias("id"), F.lit(True).alias("own")).distinct()
    return theirs.union(mine).join(texts, "id").groupBy("a", "part").applyInArrow(run, "a long, b long")


def sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, set): the shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).fill_null("")
            for start, stop in slices(column):
                data, offsets = utf8(column.slice(start, stop - start))
                begin, end, first = tokens.words(data, offsets)
                word = tokens.word_hashes(data, begin, end, fold=True)
                window = tokens.window_hashes(word, k)
                own = [shingle_hashes(word, window, first[i], first[i + 1], k).view(np.int64) for i in range(stop - start)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(own, pa.list_(pa.int64()))], names=["id", "set"])

    return map_arrow(texts.dropDuplicates(["id"]), run, "id long, set array<long>")


def _estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """estimate() of every left signature with every right one (rows of longs)."""
    out = np.empty((len(left), len(right)), np.float32)
    chance, low = 1 / 2**BITS, np.uint64(_LOW)
    for i, one in enumerate(left):
        x = right ^ one
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        differ = np.bitwise_count(x & low).sum(1, dtype=np.int64)
        out[i] = (1 - differ / MINIMA - chance) / (1 - chance)
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each left set shares with each right one."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(flat, kind="stable")
    column = np.cumsum(np.append(0, flat[order][1:] != flat[order][:-1]))
    row, wide = owner[order], int(column[-1]) + 1 if len(flat) else 0
    out = np.zeros((len(left), len(right)), np.float32)
    step = max(1, 4_000_000 // max(1, len(left) + len(right)))
    for start in range(0, wide, step):
        a, b = np.searchsorted(column, [start, start + step])
        m = np.zeros((len(left) + len(right), min(step, wide - start)), np.float32)
        m[row[a:b], column[a:b] - start] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _forest(ids: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right members of a block,
    over what their labels connect already."""
    size = np.array([len(s) for s in sets], np.float64)
    apart = label[left][:, None] != label[right][None, :]
    n, m = size[left][:, None], size[right][None, :]
    apart &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    apart &= _estimates(sig[left], sig[right]) >= percent / 100 - MARGIN
    rows, cols = np.flatnonzero(apart.any(1)), np.flatnonzero(apart.any(0))
    if not len(rows):
        return []
    left, right, apart = left[rows], right[cols], apart[np.ix_(rows, cols)]
    common = _common([sets[i] for i in left], [sets[j] for j in right])
    linked = apart & (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common))
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = int(label[left[i]]), int(label[right[j]])
        if top(x) != top(y):
            parent[top(x)] = top(y)
            found.append((int(ids[left[i]]), int(ids[right[j]])))
    return found


def _blocks(rows: DataFrame, k: int, percent: int, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links that connect labels within the buckets (key, id, label).

    Members of a bucket's most frequent label are linked already: only the others ask, and
    every member is asked. Both are cut into parts of about BLOCK members and BLOCK_SHINGLES
    shingles; two parts meet in one group of the shuffle."""
    per = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).select("key", F.col("main.label").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("few"))
    shingles = rows.join(reps.select("id", F.col("n").alias("size")), "id").groupBy("key").agg(F.sum("size").alias("size"))
    main = keep(main.join(shingles, "key"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col("size") * F.col(c) / F.col("n") / BLOCK_SHINGLES)).cast("int")
    dealt = rows.join(main.select("key", "main", parts("few").alias("ask_parts"), parts("n").alias("give_parts")), "key")
    of = lambda c: F.pmod(F.xxhash64("id"), F.col(c).cast("long")).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ask = dealt.where("label <> main").select("key", "id", "label", of("ask_parts").alias("one"), upto("give_parts").alias("two"), F.lit(True).alias("asks"))
    give = dealt.select("key", "id", "label", of("give_parts").alias("two"), upto("ask_parts").alias("one"), F.lit(False).alias("asks")).select(ask.columns)

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
        lists = lambda c: [x.values.to_numpy().view(np.uint64) for x in table.column(c)]
        found = _forest(ids, label, np.flatnonzero(asks), np.flatnonzero(~asks), np.stack(lists("sig")), lists("set"), percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    ship(rows.sparkSession)
    # Hashes of shingles are made once, then sent to each group that needs them.
    held = keep(sets(only_ids(texts, rows.select("id").distinct(), "id"), k).join(reps.select("id", "sig"), "id"), rows_at_once=256)
    return ask.union(give).join(held, "id").groupBy("key", "one", "two").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row for each row of docs
    with an id: texts link where the distinct shingles of k words (A-Z as a-z;
    shorter texts: their whole sequence) satisfy
    100 * common >= percent * all of either. component_id is the smallest id
    reachable by links, kept marks that document.

    Ids are integers. Rows without id have no identity and go. Null texts and texts without
    words have no shingles and link with nothing, each other included. Repeated rows get
    equal results; rows that share an id but not the text are documents of their own. An
    empty table gives an empty one; other columns are ignored. Texts may have any length.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with workspace(spark):
        sig = keep(signatures(docs, k))
        one = F.xxhash64("seq")
        if sig.groupBy("id").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low <> high").isEmpty():
            found = _near_duplicates(docs, sig, k, percent)
        else:
            drop(sig)
            known = numbered(docs)
            names = known.select(F.col("_row").alias("id"), F.col("id").alias("named"), F.sha2("text", 256).alias("sha"))
            rows = known.select(F.col("_row").alias("id"), "text")
            found = keep(_near_duplicates(rows, keep(signatures(rows, k)), k, percent))
            found = found.join(names, "id").join(names.select(F.col("id").alias("component"), F.col("named").alias("up")), "component")
            found = found.select(F.col("named").alias("id"), "sha", "n_shingles", F.col("up").alias("component"))
            found = docs.select("id", F.sha2("text", 256).alias("sha")).alias("d").join(found.alias("f"), (F.col("d.id") == F.col("f.id")) & F.col("d.sha").eqNullSafe(F.col("f.sha")))
            found = found.select("d.id", "n_shingles", "component")
        return settled(found.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept")))


def numbered(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The distinct rows by (id, text) with the column _row: numbers in that order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges ascend, and so do the rows in them.
    ordered = docs.dropDuplicates([id_col, text_col]).repartitionByRange(n, id_col, text_col).sortWithinPartitions(id_col, text_col)
    return keep(ordered.withColumn("_row", F.monotonically_increasing_id()))


def _near_duplicates(source: DataFrame, sig: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n_shingles, component) of rows (id, text) of which each id has one text."""
    # Written first: a join with a plain table is one whose large partitions Spark can split.
    classes = keep(sig.where("n_shingles > 0").groupBy("seq").agg(F.min("id").alias("rep")))
    reps = keep(sig.where("n_shingles > 0").groupBy("seq").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    member = reps.select("id", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = keep(member.join(bucket, "key").where("id <> hub"))

    slim = reps.select("id", F.col("n"), "sig")
    side = lambda x: slim.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    pairs = shared.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(side("b"), "b").join(side("a"), "a")
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    pairs = keep(pairs.where(estimate(F.col("sig_a"), F.col("sig_b")) >= percent / 100 - MARGIN).select("a", "b"))

    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    links = keep(verified(pairs, only_ids(source, named, "id"), k, percent), rows_at_once=256)
    labels = components(links)

    # Members that their bucket's smallest did not connect may still link with each other.
    marked = shared.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    apart = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("two"))
    # Bands whose buckets hold the same members (equal in 128 bits of hash) are compared once.
    apart = apart.where("low <> high").groupBy("one", "two", "n").agg(F.min("key").alias("key"))
    left = keep(marked.join(apart.select("key"), "key"))
    more = keep(_blocks(left, k, percent, source, reps))
    named = more.select(F.col("a").alias("id")).union(more.select(F.col("b").alias("id"))).distinct()
    more = keep(verified(more.distinct(), only_ids(source, named, "id"), k, percent), rows_at_once=256)
    # The second time, labels stand for the components so far.
    over = more.join(labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    top = components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))

    final = labels.join(top.select(F.col("id").alias("component"), F.col("component").alias("up")), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
    final = keep(final.union(top.join(labels, "id", "left_anti")))
    named = sig.select("id", "n_shingles", "seq").join(classes, "seq", "left").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component"))
