"""Secret scans (native): three patterns, and sliding-window entropy of other long strings.

A candidate string is a run of one character class outside what the patterns found and
what the allow list names. A window slides over it; the counts of the class's
characters, packed into a few numbers, change by the one that enters and the one that
leaves, and with them the sum of c * log2(c), from which the window's Shannon
entropy follows. Windows that reach the class's threshold and touch make one span.

Everything is Column expressions. Positions come from the lengths of what a
pattern splits off, in code points. Hits, spans and texts of any number and length take
running sums over blocks and pieces cut from chunks, never a copy of the whole for each.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (kind, pattern, group whose length counts, least length).
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same, where a run below the least length need not be looked at: no shorter
#: match hides a longer one.
_LOOK = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}


@dataclass(frozen=True)
class CharClass:
    """Characters of one kind of string, the window that slides over it, its least
    entropy in bits, and patterns that the candidate must contain."""

    kind: str
    alphabet: str
    window: int
    bits: float
    needs: tuple[str, ...] = ()

    @property
    def pattern(self) -> str:
        return f"[{self.alphabet.replace('-', chr(92) + '-')}]{{{self.window},}}"


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("entropy_hex", _DIGITS + "abcdef", 24, 3.0, ("[0-9]", "[a-f]")),
    CharClass("entropy_base32", _UPPER + "234567", 24, 3.6, ("[2-7]", "[A-Z]")),
    CharClass("entropy_base64", _UPPER + _LOWER + _DIGITS + "+/_-", 24, 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
)
#: What is no secret: UUIDs, marks of documentation, plain sequences, integrity hashes, image
#: data, the example key of a cloud provider's manuals.
ALLOW = (
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    r"EXAMPLE|example",
    r"abcdefghij|ABCDEFGHIJ|0123456789|1234567890",
    r"sha(?:256|384|512)-[A-Za-z0-9+/]{43,86}",
    r"(?:iVBORw0KGgo|/9j/4AAQ)[A-Za-z0-9+/]*",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCY",
)
#: Code points of a chunk that a long text or candidate is cut into.
CHUNK = 4096
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _span(start: Column, rank: int, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(values: Column, op) -> Column:
    """Running op (associative, of longs from 0 on) over an array: within blocks as long as
    there are blocks, then over the blocks."""

    def over(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        none = F.array().cast("array<bigint>")
        start = F.struct(F.lit(0).cast("long").alias("last"), none.alias("all"))
        add = lambda acc, x: _let(op(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["all"], F.array(y)).alias("all")))
        inner = lambda k: F.aggregate(F.slice(v, k * width + 1, width), start, add, lambda acc: acc["all"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), inner)
        # Before each block: what all earlier ones come to.
        before = lambda acc, b: F.struct(op(acc["last"], F.element_at(b, -1)).alias("last"), F.concat(acc["all"], F.array(acc["last"])).alias("all"))
        whole = lambda b: F.flatten(F.zip_with(b, F.aggregate(b, start, before, lambda acc: acc["all"]), lambda x, t: F.transform(x, lambda y: op(y, t))))
        return F.when(F.size(v) == 0, none).otherwise(_let(blocks, whole))

    return _let(values, over)


def _hits(text: Column, pattern: str, group: int) -> Column:
    """(start, size, hit, counted): every match with its place, in order."""
    p = F.lit(pattern)
    hits, counted = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    pairs = F.zip_with(hits, counted, lambda h, c: F.struct(h.alias("hit"), c.alias("counted")))
    measured = F.zip_with(F.split(text, pattern, -1), pairs, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m["hit"]).alias("size"), m["hit"].alias("hit"), m["counted"].alias("counted")))
    measured = F.slice(measured, 1, F.size(measured) - 1)  # nothing follows the last gap

    def placed(all_: Column) -> Column:
        ends = _running(F.transform(all_, lambda m: (m["gap"] + m["size"]).cast("long")), lambda a, b: a + b)
        return F.zip_with(all_, ends, lambda m, e: F.struct((e - m["size"]).cast("int").alias("start"), m["size"].alias("size"), m["hit"].alias("hit"), m["counted"].alias("counted")))

    return _let(measured, placed)


def merged(spans: Column) -> Column:
    """(start, end) of spans sorted by start, with those that touch or overlap as one."""

    def over(s: Column) -> Column:
        ends = _running(F.transform(s, lambda x: x["end"].cast("long")), F.greatest)

        def cut(e: Column) -> Column:
            fresh = lambda i: F.coalesce(F.get(s, i)["start"] > F.get(e, i - 1), F.lit(True))
            starts = F.filter(s, lambda x, i: (i == 0) | fresh(i))
            last = F.filter(e, lambda x, i: (i == F.size(s) - 1) | fresh(i + 1))
            return F.zip_with(starts, last, lambda a, b: F.struct(a["start"].cast("int").alias("start"), b.cast("int").alias("end")))

        return _let(ends, cut)

    return _let(spans, over)


def replaced(text: Column, ranges: Column, by) -> Column:
    """The text with each of its ranges (start, end; sorted, apart) replaced by by(range)."""

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        one, two = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        head = F.substring(F.get(chunks, one), a % CHUNK + 1, F.least(b - a, F.lit(CHUNK)))
        tail = F.concat(F.array_join(F.slice(chunks, one + 2, F.greatest(two - one - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(chunks, two), F.lit("")), F.lit(1), b % CHUNK))
        return F.when(b <= a, F.lit("")).when(one == two, head).otherwise(F.concat(head, tail))

    def over(r: Column, chunks: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(r, i - 1)["end"])
        parts = F.transform(r, lambda x, i: F.concat(piece(chunks, before(i), x["start"]), by(x)))
        return F.concat(F.array_join(parts, ""), piece(chunks, F.element_at(r, -1)["end"], F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(ranges, lambda r: _let(chunks, lambda c: over(r, c)))


def _masked(text: Column, ranges: Column) -> Column:
    return replaced(text, ranges, lambda r: F.repeat(F.lit(" "), r["end"] - r["start"]))


def _base(text: Column, rank: int) -> Column:
    kind, pattern, group, least = PATTERNS[rank]
    look = _LOOK.get(kind, pattern)
    good = F.filter(_hits(text, look, group), lambda m: F.length(m["counted"]) >= least)
    return F.when(text.rlike(look), F.transform(good, lambda m: _span(m["start"], rank, kind, m["start"] + m["size"]))).otherwise(_none())


def hot_runs(string: Column, c: CharClass) -> Column:
    """(start, end) of the runs of touching windows of at least c.bits, by start."""
    w, bits = c.window, c.window.bit_length()
    per = 60 // bits  # counts of so many characters lie in one number
    words = -(-len(c.alphabet) // per)
    #: k * log2(k) for every count that a window can have.
    term = F.array(*(F.lit(k * math.log2(k) if k else 0.0) for k in range(w + 2)))
    most = w * (math.log2(w) - c.bits) + 1e-9
    one = F.lit(1).cast("long")
    kind = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        # First the leaving character, then the entering one.
        count = lambda at: F.when(at["word"] < 0, 0).otherwise(F.call_function("shiftright", F.get(acc["counts"], at["word"]), at["shift"]).bitwiseAND(F.lit((1 << bits) - 1))).cast("int")
        same = (s["enter"]["word"] == s["leave"]["word"]) & (s["enter"]["shift"] == s["leave"]["shift"])

        def counted(k: Column) -> Column:
            total = acc["total"] + F.get(term, F.greatest(k["gone"] - 1, F.lit(0))) - F.get(term, k["gone"]) + F.get(term, k["now"] + 1) - F.get(term, k["now"])
            change = lambda x, i: x + F.when(i == s["enter"]["word"], F.call_function("shiftleft", one, s["enter"]["shift"])).otherwise(0) - F.when(i == s["leave"]["word"], F.call_function("shiftleft", one, s["leave"]["shift"])).otherwise(0)
            return F.struct(total.alias("total"), F.transform(acc["counts"], change).alias("counts"))

        def moved(now: Column) -> Column:
            at = acc["i"] - (w - 1)
            hot = (at >= 0) & (now["total"] <= most)
            new = hot & F.coalesce(at > acc["last"] + w, F.lit(False))
            return F.struct(
                (acc["i"] + 1).alias("i"),
                now["counts"].alias("counts"),
                now["total"].alias("total"),
                F.when(hot & (new | acc["first"].isNull()), at).otherwise(acc["first"]).alias("first"),
                F.when(hot, at).otherwise(acc["last"]).alias("last"),
                F.when(new, F.concat(acc["runs"], F.array(F.struct(acc["first"].alias("start"), (acc["last"] + w).alias("end"))))).otherwise(acc["runs"]).alias("runs"),
            )

        k = F.struct(count(s["leave"]).alias("gone"), (count(s["enter"]) - same.cast("int")).alias("now"))
        return _let(k, lambda k: _let(counted(k), moved))

    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("total"), none.alias("first"), none.alias("last"), F.array().cast(kind).alias("runs"))
    done = lambda acc: F.when(acc["first"].isNull(), F.array().cast(kind)).otherwise(F.concat(acc["runs"], F.array(F.struct(acc["first"].alias("start"), (acc["last"] + w).alias("end")))))

    def of(chunk: Column) -> Column:
        spot = lambda x: _let(F.instr(F.lit(c.alphabet), x) - 1, lambda n: F.struct(F.floor(n / per).cast("int").alias("word"), (n % per * bits).cast("int").alias("shift")))
        nowhere = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"))
        steps = lambda p: F.slice(F.zip_with(p, F.concat(F.array_repeat(nowhere, w), p), lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))), 1, F.size(p))
        return F.aggregate(_let(F.transform(F.split(chunk, ""), spot), steps), start, step, done)

    # Chunks overlap by a window less one, so that each window lies in one.
    chunks = F.regexp_extract_all(string, F.lit(f"(?s)(?=(.{{1,{CHUNK + w - 1}}})).{{1,{CHUNK}}}"), F.lit(1))
    chunks = F.when(F.length(string) <= CHUNK, F.array(string)).otherwise(chunks)
    long = F.filter(F.transform(chunks, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda k: F.length(k["x"]) >= w)
    runs = F.flatten(F.transform(long, lambda k: F.transform(of(k["x"]), lambda r: F.struct((r["start"] + k["i"] * CHUNK).alias("start"), (r["end"] + k["i"] * CHUNK).alias("end")))))
    return merged(runs)


def _entropy(text: Column, rank: int, c: CharClass) -> Column:
    """Spans of one class in a text in which all that is no candidate has been masked."""
    candidates = F.filter(_hits(text, c.pattern, 0), lambda m: _all([m["hit"].rlike(p) for p in c.needs]))
    spans = F.flatten(F.transform(candidates, lambda m: F.transform(hot_runs(m["hit"], c), lambda r: _span(m["start"] + r["start"], rank, c.kind, m["start"] + r["end"]))))
    return F.when(text.rlike(c.pattern), spans).otherwise(_none())


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def scan(df: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """df with the column spans (replaced if it exists): an array of
    (start, rank, kind, end) by start, then rank; base spans have rank 0 to 2.
    Places are code points, ends exclusive.

    Base spans first. Then the text outside them and outside matches of the allow list is
    searched for candidates; a window never covers a part of either, so a secret beside a
    base span or a harmless mark is found, in its own bounds.

    A null or empty text has no spans. Rows are scanned one by one: repeated rows
    get equal spans, the other columns stay, an empty table stays empty. Of two
    entropy classes, each reports its own span. Texts, candidates and hits may be of any
    length and number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(*(_base(text, i) for i in range(len(PATTERNS))))
    held, rest, free = (f"{x}_{uuid.uuid4().hex}" for x in ("base", "rest", "free"))  # no other column has these names
    df = df.withColumn(held, F.array_sort(base))
    # Few texts hold any candidate; only these are masked.
    any_ = text.rlike("|".join(c.pattern for c in classes)) if classes else F.lit(False)
    df = df.withColumn(rest, F.when(any_, F.when(F.size(held) > 0, _masked(text, merged(F.col(held)))).otherwise(text)).otherwise(F.lit("")))
    harmless = "|".join(f"(?:{p})" for p in allow)
    named = F.transform(_hits(F.col(rest), harmless, 0), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("end"))) if allow else None
    df = df.withColumn(free, F.when(F.col(rest).rlike(harmless), _masked(F.col(rest), named)).otherwise(F.col(rest)) if allow else F.col(rest))
    added = [_entropy(F.col(free), len(PATTERNS) + i, c) for i, c in enumerate(classes)]
    return df.withColumn("spans", F.array_sort(F.concat(held, *added))).drop(held, rest, free)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (those that touch or overlap together) replaced by a mark."""
    return F.when(F.size(spans) > 0, replaced(text, merged(spans), lambda r: F.lit(mark))).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
