"""Near-duplicates, repeated passages, BPE and decontamination against brute force."""

import hashlib
import random
import time

import numpy as np
import pytest

from terrasift.llm import bpe, components, decontam, neardup, queries, substrings, tokens
from terrasift.llm.common import workspace

from .fixtures import documents, prose, sample, texts


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(spark, k, percent):
    rows = texts() + [(1000 + i, t) for i, t in sample(150)]
    found = neardup.near_duplicates(documents(spark, rows), k=k, percent=percent).collect()
    want = groups(rows, k, percent)
    assert len(found) == len(rows) + 2  # repeated rows stay repeated
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_of_a_family_in_blocks(spark, monkeypatch):
    """Many near copies of which few are close to the smallest: chains must not break."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base, rows = prose(9, 60).split(), []
    for i in range(60):
        w = base.copy()
        w[(i * 7) % 60] = f"w{i}"
        w[(i * 11 + 3) % 60] = f"v{i}"
        rows.append((i, " ".join(w)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows, 3, 80)


def test_similarity_estimate_is_near(spark):
    base = prose(5, 400).split()
    rows = [(1, " ".join(base)), (2, " ".join(base[:360] + prose(6, 40).split()))]
    sig = {r.id: r.sig for r in neardup.signatures(spark.createDataFrame(rows, "id long, text string"), 3).collect()}
    pair = spark.createDataFrame([(sig[1], sig[2])], "a array<long>, b array<long>")
    true = len(shingles(rows[0][1], 3) & shingles(rows[1][1], 3)) / len(shingles(rows[0][1], 3) | shingles(rows[1][1], 3))
    assert abs(pair.select(neardup.estimate(pair.a, pair.b)).first()[0] - true) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (103, 101), (7, 7)] + [(200, i) for i in range(201, 240)]
    found = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100} | {i: 200 for i in range(200, 240)}


def repeats(rows, n=20):
    """One result per distinct row (id, text); rows of one id do not come before each other."""
    seen, out = {}, {}
    split = [(d, t, (t or "").encode().split()) for d, t in dict.fromkeys(rows)]
    for d, _, w in split:
        for p in range(len(w) - n + 1):
            x = tuple(w[p : p + n])
            seen[x] = min(seen.get(x, d), d)
    for d, t, w in split:
        gone, own = set(), set()
        for p in range(len(w) - n + 1):
            x = tuple(w[p : p + n])
            if x in own or seen[x] < d:
                gone.update(range(p, p + n))
            own.add(x)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, t] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def removed(spark, rows, folder):
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    return queries.op8_substring_dedup(spark, str(folder)).collect()


def test_repeated_passages_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 64)
    rows = texts() + [(1000 + i, t) for i, t in sample(200)]
    found = removed(spark, rows, tmp_path)
    assert len(found) == len(rows) + 2
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == {d: v for (d, _), v in repeats(rows).items()}


def thue_morse(n):
    """Two words that no polynomial modulo 2**64 of an odd base tells apart."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_with_equal_hashes_are_told_apart(spark, tmp_path):
    """Each window of the second half repeats one of equal hash, but not one of equal words."""
    one, two = thue_morse(2048)
    tail = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{one} {tail}"), (2, f"zz {two} {tail}"), (3, f"y {two} {tail}"), (4, one), (5, two)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed(spark, rows, tmp_path) if r.doc_id < 10}
    assert found == {d: v for (d, _), v in repeats(rows).items()}
    assert found[2][1] == 30 and found[3][1] == 31
    classes = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, rows), k=3, percent=85).collect()}
    assert classes[4] != classes[5] and {d: c for d, c in classes.items()} == {d: c for d, (_, c) in groups(rows, 3, 85).items()}


def test_colliding_windows_are_grouped_by_their_words(spark, tmp_path):
    """What hashes take for equal is compared at both coordinates, then grouped by the words themselves."""
    line = prose(3, 25)
    rows = [(1, f"a0 {line}"), (2, f"a1 {line}"), (3, f"b a1 {line}"), (4, f"c a0 {line} a0 {line}")]
    docs = documents(spark, rows).where("doc_id < 10")
    with workspace(spark):
        found = substrings.Repeats(docs)
        occurrences = [(d, p) for d, t in rows for p in range(len(t.split()) - 19)]
        # As if the windows that start with a0 and a1 had one hash: all but the first are wrong.
        starts = [(d, p) for d, p in occurrences if dict(rows)[d].split()[p] in ("a0", "a1")]
        edges = spark.createDataFrame([(7, d, 0, p) for d, p in starts], "h long, id long, part long, at int")
        bad = spark.createDataFrame([(d, 0, p, 20) for d, p in starts[1:]], "id long, part long, at int, n int")
        got = {(r.id, r.at) for r in found._regrouped(bad, edges).collect()}
    assert got == {(3, 1), (4, 1), (4, 27)}


def test_a_false_occurrence_removes_nothing(spark, tmp_path, monkeypatch):
    """A stretch that only hashes could take for repeated fails the comparison of words."""
    rows = [(1, prose(4, 60)), (2, prose(5, 30) + " " + " ".join(prose(4, 60).split()[:30])), (3, prose(6, 50))]
    true = substrings.Repeats._occurrences

    def lying(self, found):
        false = spark.createDataFrame([(2, 0, 20, 30, 1, 0, 3), (3, 0, 5, 25, 1, 0, 5)], "id long, part long, at int, n int, source long, source_part long, source_at int")
        return substrings.keep(true(self, found).union(false))

    monkeypatch.setattr(substrings.Repeats, "_occurrences", lying)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in removed(spark, rows, tmp_path)}
    want = {d: v for (d, _), v in repeats(rows).items()}
    assert found == {d: want[d] for d in (1, 2)} | {3: want[3]} and found[2][1] == 30


def test_rows_that_share_an_id_lose_their_own_words(spark, tmp_path):
    q = " ".join(f"q{i}" for i in range(40))
    rows = [(4, q), (5, q), (5, f"x {q}"), (6, f"{q} y"), (6, f"z {prose(5, 30)} {q}"), (7, prose(5, 30)), (8, None), (8, ""), (8, prose(5, 30)), (9, prose(6, 30)), (9, f"{prose(6, 30)} more")]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in removed(spark, rows, tmp_path)]
    want = sorted((d, *v) for (d, _), v in repeats(rows).items())
    assert sorted(found) == want and (5, 41, 40, hashlib.sha256(b"x").hexdigest()) in found


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(1, a), (2, b), (2, f"{a} more"), (2, c), (3, c), (3, b), (3, b), (4, None), (4, "x")]
    found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect())
    want = [(1, 38, 1, True), (2, 38, 2, True), (2, 39, 1, False), (2, 38, 2, True), (3, 38, 2, False), (3, 38, 2, False), (3, 38, 2, False), (4, 0, 4, True), (4, 1, 4, True)]
    assert found == sorted(want)


def test_paths_are_the_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 4)
    line = prose(3, 25)
    rows = [(1, prose(4, 40) + " " + line + " " + prose(5, 40)), (2, prose(6, 30) + " " + line + " " + prose(7, 30)), (3, prose(8, 200)), (4, prose(8, 200) + " x")]
    with workspace(spark):
        found = substrings.Repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(tuple(r) for r in found.paths.select("source", "start", "words", "n").collect()) == [(1, 40, 25, 2), (3, 0, 200, 2)]
        assert {r.id: [(s.at, s.n) for s in r.spans] for r in found.removed.collect()} == {2: [(30, 25)], 4: [(0, 200)]}


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    own, ref = bpe.Codec(path), Tokenizer.from_file(path)
    odd = ["<|endoftext|>", "a<|endoftext|>b ", "  \n\t x\x1c\x85y", "it's WE'LL 12½ ___", "ab" * 3000, " ​漢字 é́"]
    all_texts = [t or "" for _, t in texts()] + [t for _, t in sample(100)] + odd
    ids, at = own.encode(all_texts)
    for i, t in enumerate(all_texts):
        want = ref.encode(t, add_special_tokens=False).ids
        assert ids[at[i] : at[i + 1]].tolist() == want
    assert own.decode(ids, at).to_pylist() == [ref.decode(ref.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in all_texts]
    found = bpe.encode_decode(documents(spark)).collect()
    assert len(found) == len(texts()) + 2
    assert {r.doc_id: r.decoded for r in found} == {i: t or "" for i, t in texts()}


def test_bpe_of_long_words_matches_the_library(monkeypatch):
    """Words without a break: equal to the library, in time that grows with their length, and not remembered."""
    from tokenizers import Tokenizer

    path = bpe.default_path()
    own, ref = bpe.Codec(path), Tokenizer.from_file(path)
    r = random.Random(5)
    words = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "theinandofé漢") for n in (65, 66, 500, 5000)]
    monkeypatch.setattr(bpe, "PIECE", 3000)
    for texts_ in (words, [" ".join(words), "", "x"], [f"a {w} <|endoftext|>{w} b" for w in words]):
        ids, at = own.encode(texts_)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [ref.encode(t, add_special_tokens=False).ids for t in texts_]
    assert max(map(len, own.known)) <= bpe.LONGEST
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    ids, _ = own.encode([long])
    assert time.time() - began < 60
    assert ids.tolist() == ref.encode(long, add_special_tokens=False).ids


def test_bpe_forgets_and_goes_on(monkeypatch):
    path = bpe.default_path()
    whole = bpe.Codec(path).encode([t for _, t in sample(40)])[0]
    monkeypatch.setattr(bpe, "REMEMBER", 50)
    own = bpe.Codec(path)
    assert np.concatenate([own.encode([t])[0] for _, t in sample(40)]).tolist() == whole.tolist()


def tiling(a, b, least):
    marked_a, marked_b, covered = [False] * len(a), [False] * len(b), 0
    least = max(1, min(least, len(b)))
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not marked_a[i + k] and not marked_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k >= least:
                    found.append((i, j))
        if not found:
            return covered
        for i, j in found:
            if not any(marked_a[i : i + best]) and not any(marked_b[j : j + best]):
                marked_a[i : i + best] = marked_b[j : j + best] = [True] * best
                covered += best


@pytest.mark.parametrize("most_bytes", [decontam.MOST_BYTES, 0])
def test_decontamination_matches_brute_force(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(decontam, "MOST_BYTES", most_bytes)
    item = prose(20, 30).split()
    rows = [
        (1, None), (2, ""), (3, prose(21, 50)),
        (4, prose(22, 30) + " " + " ".join(item).upper() + " " + prose(23, 10)),
        (5, " ".join(item[15:] + prose(24, 20).split() + item[:15])),  # in another order
        (6, " ".join(item[:12]) + " " + prose(25, 40)),
        (7, " ".join(item[:6] * 5)),
        (8, "x three words y"),
    ]
    bench = [(1, " ".join(item)), (2, None), (3, ""), (4, "three words"), (5, " ".join(item[:6]))]
    docs = documents(spark, rows)
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in bench], "item_id long, text string, id string, n_words int")
    found = {(r.id, r.item_id): (r.n_covered, r.n_words) for r in decontam.tiled(docs, items).collect()}
    want = {}
    for d, t in rows:
        for i, b in bench:
            a, w = (t or "").lower().split(), (b or "").lower().split()
            if w and (c := tiling(a, w, 5)):
                want[d, i] = (c, len(w))
    assert found == want
    caught = {(r.id, r.item_id): (r.n_covered, r.n_words) for r in decontam.contaminated(docs, items).collect()}
    assert caught == {x: (c, n) for x, (c, n) in want.items() if c >= 0.5 * n}
    assert {(4, 1), (5, 1), (8, 4)} <= set(caught) and not {d for d, _ in caught} & {1, 2, 3}


@pytest.mark.parametrize("most_bytes", [decontam.MOST_BYTES, 0])
def test_a_very_common_passage_makes_few_pairs(spark, monkeypatch, most_bytes):
    """A line that all items and documents share is no reason to tile; the result stays whole."""
    monkeypatch.setattr(decontam, "MOST_BYTES", most_bytes)
    line = prose(30, 12)
    bench = [(i, f"{line} {prose(100 + i, 20)}") for i in range(30)]
    rows = [(i, f"{prose(200 + i, 15)} {line}") for i in range(40)] + [(50, bench[3][1]), (51, f"{line} {prose(104, 20)} x")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.id, r.item_id) for r in decontam.contaminated(documents(spark, rows), items).collect()}
    assert found == {(50, 3), (51, 4)}
    index = decontam._Index(bench, 5, 0.5)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    begin, end, first = tokens.words(data, np.array([0, len(data)]))
    assert len(list(decontam._Index(bench, 5, 0.0).met(tokens.word_hashes(data, begin, end, fold=True), first))) == 30
    assert all(decontam._covered(tokens.word_hashes(data, begin, end, fold=True), w, 5, 0.5) is None for w, _ in index.parts)


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert neardup.near_duplicates(empty).collect() == []
    with workspace(spark):
        found = substrings.Repeats(empty)
        assert found.whole.collect() == [] and found.removed.collect() == [] and found.paths.collect() == []
    assert bpe.encode_decode(empty).collect() == []
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(empty, items).collect() == [] == decontam.contaminated(documents(spark), items).collect()


def test_rows_without_id_go(spark):
    rows = spark.createDataFrame([(None, prose(1, 30)), (1, prose(1, 30))], "doc_id long, text string")
    assert [(r.doc_id, r.kept) for r in neardup.near_duplicates(rows).collect()] == [(1, True)]
    with workspace(spark):
        assert [r.id for r in substrings.Repeats(rows).whole.collect()] == [1]
