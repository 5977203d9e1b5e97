"""Small tables with the cases that every operator must take."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.01"
DOC_SCHEMA = "doc_id long, text string, lang string, id string, label int, spans string, n long, key string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(2, 7))) for _ in range(n))


def texts() -> list[tuple[int, str | None]]:
    """Null, empty, blank, short and very long texts, copies, near copies and shared passages."""
    base = prose(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    far = base[:70] + prose(2, 60).split()
    line = prose(3, 25)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "two words"),
        (6, "ONE"),
        (10, " ".join(base)),
        (11, " ".join(base)),
        (12, "  ".join(base).upper()),
        (13, " ".join(near)),
        (14, " ".join(far)),
        (15, prose(4, 40) + " " + line + " " + prose(5, 40)),
        (16, prose(6, 40) + "\n" + line + "\n" + prose(7, 40)),
        (17, " ".join([line] * 4)),
        (18, prose(8, 20000)),
        (19, prose(8, 20000) + " end"),
        (20, "é😀 ünï " * 30),
        (21, "a" * 30000),
    ]


def documents(spark, rows=None):
    """The texts as a table, some rows repeated, with columns whose names operators use themselves."""
    rows = texts() if rows is None else rows
    rows = [*rows, *[x for x in rows if x[0] in (10, 13)]]
    return spark.createDataFrame([(i, t, "en", "x", 7, "y", 3, "z") for i, t in rows], DOC_SCHEMA)


def sample(n: int) -> list[tuple[int, str]]:
    """The first documents of the small test table."""
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).slice(0, n).to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))
