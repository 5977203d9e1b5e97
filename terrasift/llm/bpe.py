"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a batch that are not yet known lie in one flat array of symbols.
Each round finds, by binary search over the sorted keys of all mergeable pairs,
every pair's rank, takes the lowest of each word, and merges its occurrences in
all words at once; words without a mergeable pair leave the array. Long words would
need as many rounds as they have different pairs, over their whole length: their rounds go
through the ranks in order instead, in all of them at once, and touch only one pair's places.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, slices

#: The word pattern of byte-level BPE (fixed value); white space is Unicode's White_Space.
_WS = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Words that a worker remembers; beyond that it starts afresh.
REMEMBER = 200_000
#: The longest word that is remembered, and the longest that is merged in rounds over all words, in bytes.
LONGEST = 64
#: Characters of a text that are split into words at a time.
PIECE = 1 << 20


def _alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        of = _alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(of[c] for c in token)
        for token, i in added.items():
            pieces[i] = token.encode()
        self.size, self.added = size, added
        self.first = np.zeros(256, np.int64)
        for c, b in of.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(lengths)])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.word = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many words."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        none = len(self.ranks)
        while len(sym):
            key = sym[:-1] * self.size + sym[1:]
            where = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[where] == key) & (word[:-1] == word[1:]), self.ranks[where], none)
            rank = np.append(rank, none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(word)))
            active = np.repeat(best < none, length)
            if not active.all():
                done_sym.append(sym[~active])
                done_word.append(word[~active])
                sym, word, rank = sym[active], word[active], rank[active]
                if not len(sym):
                    break
                length, best = length[best < none], best[best < none]
            hit = rank == np.repeat(best, length)
            # In a run of hits (the pair x x in x x x ...) every other one merges.
            place = np.flatnonzero(hit)
            fresh = np.append(True, place[1:] != place[:-1] + 1)
            run_start = place[fresh][np.cumsum(fresh) - 1]
            place = place[(place - run_start) % 2 == 0]
            sym[place] = self.merged[rank[place]]
            stay = np.ones(len(sym), bool)
            stay[place + 1] = False
            sym, word = sym[stay], word[stay]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def merge_long(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of long words. Places are kept by the rank of the pair that starts
        there; the lowest rank's are merged in all words, from left to right, and
        only pairs beside them get new ranks."""
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        n, none = len(sym), len(self.ranks)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, none)
        own = np.flatnonzero(word[:-1] == word[1:])
        rank[own] = self._rank(sym[own], sym[own + 1])
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] < none]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cut) if len(at) else ():
                r = int(rank[part[0]])
                if r not in places:
                    places[r] = []
                    heapq.heappush(waiting, r)
                places[r].append(part)

        enter(np.arange(n))
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # In a run of pairs (x x in x x x ...) every other one merges.
            fresh = np.append(True, after[at[:-1]] != at[1:])
            number = np.arange(len(at))
            at = at[(number - number[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            sym[at] = self.merged[r]
            rank[gone] = none
            sym[gone] = -1
            after[at] = after[gone]
            inside = at[after[at] < n]
            before[after[inside]] = inside
            at = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
            rank[at] = none
            inside = at[after[at] < n]
            inside = inside[word[inside] == word[after[inside]]]
            rank[inside] = self._rank(sym[inside], sym[after[inside]])
            enter(at)
        left = sym >= 0
        return sym[left].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(word[left], minlength=len(words)))])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search; as many as there are for no pair."""
        key = left * self.size + right
        where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[where] == key, self.ranks[where], len(self.ranks))

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words of any length."""
        data = [w.encode() for w in words]
        long = [i for i, w in enumerate(data) if len(w) > LONGEST]
        ids, at = self.merge([b"" if len(w) > LONGEST else w for w in data])
        if not long:
            return ids, at
        own, own_at = self.merge_long([data[i] for i in long])
        size = np.diff(at)
        size[long] = np.diff(own_at)
        return np.insert(ids, np.repeat(at[long], size[long]), own), np.concatenate([[0], np.cumsum(size)])

    def _learn(self, words: list[str]) -> None:
        ids, at = self._merged(words)
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.at = np.concatenate([self.at, self.at[-1] + at[1:]])

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """The words of a text, special tokens among them, some at a time."""
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        for i, piece in enumerate(parts):
            if i % 2:
                yield [piece]
            elif len(piece) <= PIECE:
                yield self.word.findall(piece)
            else:
                words, size = [], 0
                for m in self.word.finditer(piece):
                    words.append(m.group())
                    size += len(words[-1])
                    if size > PIECE:
                        yield words
                        words, size = [], 0
                yield words

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many texts. Special tokens' strings become their ids."""
        ids, count, waiting, size = [], np.zeros(len(texts), np.int64), [], 0
        for i, text in enumerate(texts):
            for words in self._pieces(text):
                waiting.append((i, words))
                size += sum(map(len, words)) if len(text) > PIECE else len(text)
                if size > PIECE:
                    ids.append(self._encode(waiting, count))
                    waiting, size = [], 0
        ids.append(self._encode(waiting, count))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])

    def _encode(self, found: list[tuple[int, list[str]]], count: np.ndarray) -> np.ndarray:
        """The ids of all words found; count gets how many of them each text has."""
        if len(self.known) > REMEMBER:
            self._forget()
        if not self.known:
            for s, i in self.added.items():
                self.known[s] = len(self.known)
                self.flat, self.at = np.append(self.flat, np.int32(i)), np.append(self.at, len(self.flat) + 1)
        new = set().union(*(w for _, w in found)).difference(self.known)
        short = [w for w in new if len(w) <= LONGEST]
        if short:
            self._learn(short)
        # Longer words serve this call only.
        flat, at, known = self.flat, self.at, self.known
        if len(short) < len(new):
            long = [w for w in new if len(w) > LONGEST]
            more, ends = self._merged(long)
            known = dict(zip(long, range(len(at) - 1, len(at) - 1 + len(long)), strict=True))
            flat, at = np.concatenate([flat, more]), np.concatenate([at, at[-1] + ends[1:]])
            index = [known[w] if w in known else self.known[w] for _, x in found for w in x]
        else:
            index = [known[w] for _, x in found for w in x]
        ids, size = gather(flat, at, np.array(index, np.int64))
        owner = np.repeat([i for i, _ in found], [len(x) for _, x in found]).astype(np.int64)
        np.add.at(count, owner, size)
        return ids

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of many id sequences, special tokens included; bytes that are
        no UTF-8 become U+FFFD."""
        data, size = gather(self.piece_bytes, self.piece_at, ids)
        ends = np.concatenate([[0], np.cumsum(size)])[at]
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def gather(flat: np.ndarray, at: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at[i]:at[i + 1]] for every i of index in a row, and their lengths."""
    size = at[index + 1] - at[index]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    place = np.arange(total) + np.repeat(at[index] - (end - size), size)
    return flat[place], size


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One per worker process, with what it has learned."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>, decoded string), a row for each row of docs: the
    whole text encoded, and the ids decoded again. A null text counts as empty:
    no ids, decoded empty. Repeated rows stay repeated, other columns are dropped,
    an empty table gives an empty one. Texts and words may be of any length. The vocabulary file must be readable at the
    same path on every executor (it is part of an installed package)."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for start, stop in slices(column):
                ids, at = c.encode(column.slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), c.decode(ids, at)],
                    names=[id_col, "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"{id_col} {kind}, ids array<int>, decoded string")
