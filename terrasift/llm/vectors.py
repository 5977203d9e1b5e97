"""Near-duplicate vectors by product quantisation with inverted lists.

Equal vectors are first folded into one. A coarse quantiser deals unit vectors to
lists by their nearest centroid; what is left of a vector, its residual, is coded
in subspaces. A vector visits its own list and every list whose border is within
half the radius; there, table look-ups give its distance to each code, and a pair stays a
candidate unless that distance, less the exactly known coding error, is beyond
the radius, so coding loses no pair. Candidates get their exact cosine in double
precision.

Lists are cut into parts, and two parts meet in one group of the shuffle, which
returns counts and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, map_arrow, settled, ship, workspace
from .components import components

#: Vectors that a quantiser is fitted on, the first in the order of a hash: so many, or PER_LIST for each list.
SAMPLE, PER_LIST = 20_000, 4
#: A list has so many vectors at least, and there are at most LISTS * sqrt(vectors) of them: the vectors
#: of a list and the lists that a vector visits then both grow far slower than the table.
LIST_SIZE, LISTS = 512, 0.25
SUBSPACES, CODES = 8, 256
#: Vectors of a part of a list.
PART = 2048
#: Rounding allowed for where a border lies.
SLACK = 1e-9


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dim
    books: np.ndarray  # subspaces x codes x width


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows; an empty cluster keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.searchsorted(near[order], full), axis=0)
        c[full] = sums / count[full, None]
    return c


def lists_of(rows: int) -> int:
    """How many lists an index of so many vectors has."""
    return max(1, min(rows // LIST_SIZE, round(LISTS * rows**0.5)))


def single(dim: int) -> Quantiser:
    """One list and one code: an index of few vectors, in which all are compared."""
    return Quantiser(np.zeros((1, dim)), np.zeros((SUBSPACES, 1, -(-dim // SUBSPACES))))


def fit(sample: np.ndarray, rows: int) -> Quantiser:
    """From unit vectors; rows: how many vectors will be indexed."""
    c = _kmeans(sample, min(lists_of(rows), max(1, len(sample) // PER_LIST)))
    rest = sample - c[_nearest(sample, c)]
    width = -(-sample.shape[1] // SUBSPACES)
    rest = np.pad(rest, ((0, 0), (0, width * SUBSPACES - rest.shape[1])))
    codes = min(CODES, len(sample))
    return Quantiser(c, np.stack([_kmeans(np.ascontiguousarray(rest[:, m * width : (m + 1) * width]), codes, 5) for m in range(SUBSPACES)]))


def encode(x: np.ndarray, home: np.ndarray, q: Quantiser) -> tuple[np.ndarray, np.ndarray]:
    """(codes, coding error) of unit vectors in their home lists."""
    width = q.books.shape[2]
    rest = x - q.centroids[home]
    rest = np.pad(rest, ((0, 0), (0, width * SUBSPACES - rest.shape[1])))
    codes = np.stack([_nearest(rest[:, m * width : (m + 1) * width], q.books[m]) for m in range(SUBSPACES)], axis=1)
    near = np.concatenate([q.books[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)
    return codes.astype(np.uint8), np.sqrt(((rest - near) ** 2).sum(1))


def probes(x: np.ndarray, home: np.ndarray, q: Quantiser, radius: float) -> list[np.ndarray]:
    """The lists whose border with the home list is within half the radius, home first.

    The two of a linked pair lie on both sides of the border of their lists, at most the
    radius apart; so one of them is within half of it and asks in the other's list."""
    c = q.centroids
    square = (c * c).sum(1)[None, :] - 2 * x @ c.T
    own = c[home]
    gap = np.sqrt(np.maximum(0, ((own * own).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * own @ c.T)))
    beyond = square - square[np.arange(len(x)), home][:, None]
    near = beyond <= radius * gap + SLACK
    near[np.arange(len(x)), home] = False
    return [np.append(h, np.flatnonzero(row)) for h, row in zip(home, near, strict=True)]


def _unit(values: np.ndarray, dim: int) -> np.ndarray:
    x = np.array(values, np.float64).reshape(-1, dim)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy()


def _met(table: pa.Table, q: Quantiser, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, target rows, linked matrix, table's ids) of one group."""
    role = table.column("target").to_numpy()
    ids = table.column("id").to_numpy()
    ask, give = np.flatnonzero(~role), np.flatnonzero(role)
    linked = np.zeros((len(ask), len(give)), bool)
    if not len(ask) or not len(give):
        return ask, give, linked, ids
    x = _unit(_flat(table.column("v")), q.centroids.shape[1])
    home = int(table.column("list")[0].as_py())
    width = q.books.shape[2]
    # Single precision halves the look-ups' traffic; the slack below is far above its error.
    rest = np.pad(x[ask] - q.centroids[home], ((0, 0), (0, width * SUBSPACES - x.shape[1]))).astype(np.float32)
    codes = np.stack([np.frombuffer(table.column("codes")[int(i)].as_py(), np.uint8) for i in give])
    error = table.column("error").to_numpy()[give]
    radius = np.sqrt(2 - 2 * cosine)
    most = ((radius + error + 1e-3) ** 2).astype(np.float32)[None, :]
    maybe = np.zeros((len(ask), len(give)), bool)
    books = q.books.astype(np.float32)
    for start in range(0, len(ask), 128):  # small enough for the processor's cache
        far = np.zeros((min(128, len(ask) - start), len(give)), np.float32)
        for m in range(SUBSPACES):
            part, book = rest[start : start + 128, m * width : (m + 1) * width], books[m]
            look = (part * part).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * part @ book.T
            far += look.take(codes[:, m], axis=1)
        maybe[start : start + 128] = far <= most
    maybe &= ids[ask][:, None] != ids[give][None, :]
    rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
    if len(rows):
        linked[np.ix_(rows, cols)] = (x[ask[rows]] @ x[give[cols]].T >= cosine) & maybe[np.ix_(rows, cols)]
    return ask, give, linked, ids


def _labels(linked: np.ndarray, low_ask: np.ndarray, low_give: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that the links of a block reach, of its rows and columns."""
    most, step = np.iinfo(np.int64).max, 256
    while True:
        to_give = low_give.copy()
        for i in range(0, len(low_ask), step):
            np.minimum(to_give, np.where(linked[i : i + step], low_ask[i : i + step, None], most).min(0), out=to_give)
        to_ask = low_ask.copy()
        for i in range(0, len(low_ask), step):
            np.minimum(to_ask[i : i + step], np.where(linked[i : i + step], to_give[None, :], most).min(1), out=to_ask[i : i + step])
        if (to_give == low_give).all() and (to_ask == low_ask).all():
            return to_ask, to_give
        low_ask, low_give = to_ask, to_give


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of df with an id:
    n_links counts the other vectors whose cosine, in double precision, is at
    least `cosine`; component_id is the smallest id that links reach.

    Ids are integers. Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing; vectors link with those of their own length, each
    length has an index of its own. Equal vectors link. Rows without id go; a repeated row
    is one vector, and both rows get its result; rows that share an id but not the vector are
    vectors of their own. An empty table gives an empty one; other columns are ignored.
    """
    with workspace(df.sparkSession):
        return settled(_near_duplicates(df, id_col, vector_col, cosine))


def _near_duplicates(df: DataFrame, id_col: str, vector_col: str, cosine: float) -> DataFrame:
    spark = df.sparkSession
    # Components of single precision stay so on their way; all computing is in double.
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    source = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    source = source.withColumn("v", F.when(good, F.transform("v", lambda x: (x + F.lit(0.0)).cast(kind))))  # no negative zeros
    # A vector's class: equal components. Vectors that link with nothing have none.
    source = source.withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary"), 256))
    rows = keep(source)
    everyone = rows.select("id", "key")
    once = rows.where("key is not null").groupBy("id", "key").agg(F.first("v").alias("v"))
    classes = once.groupBy("key").agg(F.min("id").alias("named"), F.count("*").alias("copies"), F.first("v").alias("v"))
    classes = keep(classes.withColumn("dim", F.size("v")))
    if classes.groupBy("named").count().where("count > 1").isEmpty():
        classes = classes.withColumn("id", F.col("named"))
    else:  # numbers of the classes in the order of their smallest id
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = classes.repartitionByRange(parts, "named", "key").sortWithinPartitions("named", "key")
        classes = keep(ordered.withColumn("id", F.monotonically_increasing_id()))
    quantisers = {}
    for r in classes.groupBy("dim").count().collect():  # a row for each length that occurs
        few = lists_of(r["count"]) == 1
        quantisers[r["dim"]] = single(r["dim"]) if few else fit(_unit(_sample(classes.where(F.col("dim") == r["dim"]), r["count"]), r["dim"]), r["count"])
    sent = spark.sparkContext.broadcast(quantisers)
    radius = float(np.sqrt(2 - 2 * cosine))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for dim in whole.column("dim").unique().to_pylist():
                q = sent.value[dim]
                batch = whole.filter(pa.array(whole.column("dim").to_numpy() == dim))
                for i in range(0, len(batch), 1024):
                    part = batch.slice(i, 1024)
                    x = _unit(part.column("v").flatten().to_numpy(), dim)
                    home = _nearest(x, q.centroids)
                    codes, error = encode(x, home, q)
                    asked = pa.array([p.astype(np.int32) for p in probes(x, home, q, radius)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in ("id", "copies", "v", "dim")), pa.array(home, pa.int32()), asked, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                        names=["id", "copies", "v", "dim", "home", "probes", "codes", "error"],
                    )

    dealt = keep(map_arrow(classes.select("id", "copies", "v", "dim"), assign, f"id long, copies long, v array<{kind}>, dim int, home int, probes array<int>, codes binary, error double"))

    parts = lambda n: F.ceil(n / PART).cast("int")
    asking = dealt.withColumn("list", F.explode("probes"))
    at = ["dim", "list"]
    sizes = asking.groupBy(*at).agg(parts(F.count("*")).alias("ask_parts"), parts(F.greatest(F.lit(1), F.count_if(F.col("home") == F.col("list")))).alias("give_parts"))
    part_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # One row for each list; codes, errors and probes are those of targets only.
    sizes = F.broadcast(sizes)
    ask = asking.join(sizes, at).withColumn("i", part_of("ask_parts")).withColumn("j", upto("give_parts")).withColumn("target", F.lit(False))
    ask = ask.withColumn("probes", F.lit(None).cast("array<int>")).withColumn("codes", F.lit(None).cast("binary")).withColumn("error", F.lit(None).cast("double"))
    give = dealt.withColumn("list", F.col("home")).join(sizes, at).withColumn("j", part_of("give_parts")).withColumn("i", upto("ask_parts")).withColumn("target", F.lit(True))
    columns = ["dim", "list", "i", "j", "target", "id", "copies", "v", "home", "probes", "codes", "error"]
    groups = ask.select(columns).union(give.select(columns))

    def meet(table: pa.Table) -> pa.Table:
        ask, give, linked, ids = _met(table, sent.value[table.column("dim")[0].as_py()], cosine)
        copies, home = table.column("copies").to_numpy(), table.column("home").to_numpy()
        out: dict[int, int] = {}
        label, rows = {}, []
        if linked.any():
            probing = table.column("probes").combine_chunks()
            probing = pa.concat_arrays(probing.chunks) if isinstance(probing, pa.ChunkedArray) else probing
            # A target counts the pair here unless it asks in the other's list itself.
            itself = np.zeros(linked.shape, bool)
            for t in np.flatnonzero(linked.any(0)):
                itself[:, t] = np.isin(home[ask], probing[int(give[t])].values.to_numpy())
            for side, matrix, of in ((ask, linked, copies[give]), (give, (linked & ~itself).T, copies[ask])):
                for k, n in zip(side, matrix @ of, strict=True):
                    if n:
                        out[int(k)] = int(n)
            low_ask, low_give = _labels(linked, ids[ask], ids[give])
            label = dict(zip(ask.tolist(), low_ask.tolist(), strict=True)) | dict(zip(give.tolist(), low_give.tolist(), strict=True))
            rows = sorted({int(k) for k in ask[linked.any(1)]} | {int(k) for k in give[linked.any(0)]})
        return pa.table({"id": pa.array([int(ids[k]) for k in rows], pa.int64()), "n": pa.array([out.get(k, 0) for k in rows], pa.int64()), "root": pa.array([label[k] for k in rows], pa.int64())})

    ship(spark)
    found = keep(groups.groupBy("dim", "list", "i", "j").applyInArrow(meet, "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = classes.select("key", "id", "named", "copies").join(counts, "id", "left").join(labels, "id", "left")
    result = result.select("key", "named", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("top"))
    result = result.join(classes.select(F.col("id").alias("top"), F.col("named").alias("component")), "top").select("key", "n", "component")
    of = F.coalesce("component", "id")
    return everyone.join(result, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), (F.col("id") == of).alias("kept"))


def _sample(classes: DataFrame, rows: int) -> np.ndarray:
    """The components of at most max(SAMPLE, PER_LIST * lists) vectors, one after the other."""
    most = max(SAMPLE, PER_LIST * lists_of(rows))
    return _flat(classes.orderBy(F.xxhash64("key"), "key").limit(most).select("v").toArrow().column("v"))
