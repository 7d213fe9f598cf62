"""Byte-level BPE by merge replay: an inverted index from token pair to word positions.

A block's distinct words lie in one chain of tokens. The index holds, for every
adjacent pair that has a rank, the positions where it stands. Merges are
applied in rank order over the whole block, all positions of a pair at once
(numpy); each touches only the listed positions and their two neighbours, whose
new pairs enter the index. A word in which a merge gives rise to a pair of lower
rank (an order that only the word itself can settle) is done again on its own.

A block is a batch of texts of bounded size in one task. Words never interact,
so any grouping of words into blocks gives the ids of a replay over the whole
corpus, and no text or word has to be shuffled. Words already solved in a task
are looked up (a bounded table).

Defined cases: a null text is empty (no ids); rows are independent, so
repeated rows, null ids and extra columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from checkwise.llm.common import ship
from checkwise.llm.words import slices, text_buffer

#: Entries of the table of solved pieces; a full table becomes the old generation.
CACHE_PIECES = 250_000
#: Pieces longer than this are not kept in the table.
CACHE_PIECE_CHARS = 64
#: Characters of a block whose pieces are kept between the two passes over it.
KEPT_CHARS = 6 << 20
#: Text of one block.
BLOCK_BYTES = 16 << 20

_DOUBLE_SPACE = re.compile(r"\s\s")
_PIECE_SPLIT = re.compile(r"(?<!\s) (?!\s)")


def pieces(text: str) -> list[str]:
    """Cut a text before each single space between other characters.

    The public pattern never matches across such a place (a match takes at most
    one space, at its front), so pieces can be encoded one by one. All pieces
    but the first begin with the space, which is left out here.
    """
    if _DOUBLE_SPACE.search(text):
        return _PIECE_SPLIT.split(text)
    return text.split(" ")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 token, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def replay_words(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of each word, merge by merge: the plain form of ``Replay``, for the words it sets aside."""
    out = []
    for w in words:
        if w in ranks:
            out.append([ranks[w]])
            continue
        token = [bytes((c,)) for c in w]
        after, before = list(range(1, len(w) + 1)), list(range(-1, len(w) - 1))
        todo = [(ranks[w[i:i + 2]], i, 2) for i in range(len(w) - 1) if w[i:i + 2] in ranks]
        heapq.heapify(todo)
        while todo:
            r, i, size = heapq.heappop(todo)
            j = after[i] if token[i] else len(w)
            if j >= len(w) or len(token[i]) + len(token[j]) != size or ranks.get(token[i] + token[j]) != r:
                continue  # one side has changed since
            token[i], token[j] = token[i] + token[j], b""
            right = after[i] = after[j]
            if right < len(w):
                before[right] = i
                if (x := ranks.get(token[i] + token[right])) is not None:
                    heapq.heappush(todo, (x, i, len(token[i]) + len(token[right])))
            left = before[i]
            if left >= 0 and (x := ranks.get(token[left] + token[i])) is not None:
                heapq.heappush(todo, (x, left, len(token[left]) + len(token[i])))
        out.append([ranks[t] for t in token if t])
    return out


class Replay:
    """All merges of a block of words in rank order, through an index from pair to positions."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes((c,))] for c in range(256)], np.int64)
        left, right, merged = [], [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None:
                    left.append(x)
                    right.append(y)
                    merged.append(r)
        # open-addressed table of all pairs whose bytes together are a token
        self.bits = max(4, int(np.ceil(np.log2(4 * len(merged) + 16))))
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, self.NONE, np.int32)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        merged = np.array(merged, np.int32)
        slot, rest = self._slot(key), np.arange(len(key))
        while len(rest):
            free = rest[self.key[slot[rest]] < 0]
            self.key[slot[free]] = key[free]  # of several keys for one slot, one stays
            done = self.key[slot[rest]] == key[rest]
            self.value[slot[rest[done]]] = merged[rest[done]]
            rest = rest[~done]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where their bytes are no token (or a side is -1)."""
        key = left << 32 | right
        out = np.full(len(key), self.NONE, np.int32)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[ask])
        while len(ask):
            found = self.key[slot]
            hit = found == key[ask]
            out[ask[hit]] = self.value[slot[hit]]
            more = ~hit & (found >= 0)
            ask, slot = ask[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        counts = np.ones(len(words), np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        some = np.flatnonzero(whole < 0)
        data = np.frombuffer(b"".join([words[i] for i in some.tolist()]), np.uint8)
        size = np.fromiter((len(words[i]) for i in some.tolist()), np.int64, len(some))
        if len(some):
            tokens, word_of, odd = self._merge(data, size)
            counts[some] = np.bincount(word_of, minlength=len(some))
            plain = {int(i): x for i, x in zip(
                some[odd], replay_words([words[i] for i in some[odd].tolist()], self.ranks), strict=True)}
            for i, x in plain.items():
                counts[i] = len(x)
            tokens = tokens[~np.isin(word_of, odd)] if plain else tokens
        else:
            tokens, plain = np.zeros(0, np.int64), {}
        ids = np.empty(int(counts.sum()), np.uint32)
        first = np.cumsum(counts) - counts
        ids[first[whole >= 0]] = whole[whole >= 0]
        spread = np.zeros(len(words), bool)
        spread[some] = True
        spread[list(plain)] = False
        ids[np.repeat(spread, counts)] = tokens
        for i, x in plain.items():
            ids[first[i]:first[i] + len(x)] = x
        return ids, counts

    def _merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, their word, words to be done again one by one) of words given as bytes and sizes."""
        words = len(size)
        n = len(data) + words  # a gap (-1) after each word
        word = np.repeat(np.arange(words), size + 1)
        gap = np.cumsum(size + 1) - 1
        token = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[gap] = False
        token[inside] = self.byte[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        current = np.full(n, self.NONE, np.int32)
        current[:-1] = self.rank(token[:-1], token[1:])
        # the index: positions of every pair, by rank
        at = np.flatnonzero(current != self.NONE)
        at = at[np.argsort(current[at], kind="stable")]
        r = current[at]
        edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
        index: dict[int, list[np.ndarray]] = {
            int(r[lo]): [at[lo:hi]] for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(r)], strict=True)}
        todo = list(index)
        heapq.heapify(todo)
        odd = np.zeros(words, bool)
        while todo:
            rank = heapq.heappop(todo)
            lists = index.pop(rank, None)
            if lists is None:
                continue
            at = np.concatenate(lists)
            at = at[current[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                # overlapping pairs: the leftmost goes first, so every second one of a chain
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    start = np.concatenate(([True], ~chained))
                    place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
                    at = at[place % 2 == 0]
            second = after[at]
            right = after[second]
            beside = np.flatnonzero(right[:-1] == at[1:])
            if len(beside):  # a merge whose right neighbour merges too: would it have gone first?
                x = self.rank(np.full(len(beside), rank), token[right[beside]])
                odd[word[at[beside[x < rank]]]] = True
            token[at] = rank
            token[second] = -2
            current[second] = self.NONE
            after[at] = right
            before[right] = at
            left = before[at]
            touched = np.concatenate((at, left[left >= 0]))
            fresh = self.rank(token[touched], token[after[touched]])
            current[touched] = fresh
            new = fresh != self.NONE
            if new.any():
                touched, fresh = touched[new], fresh[new]
                early = fresh < rank
                if early.any():  # must come before other merges of this rank in the word
                    odd[word[touched[early]]] = True
                order = np.argsort(fresh, kind="stable")
                touched, fresh = touched[order], fresh[order]
                edge = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
                for part, x in zip(np.split(touched, edge), fresh[np.concatenate(([0], edge))].tolist(), strict=True):
                    if x in index:
                        index[x].append(part)
                    else:
                        index[x] = [part]
                        heapq.heappush(todo, x)
        left = token >= 0
        return token[left], word[left], np.flatnonzero(odd)


class Pieces:
    """Ids of texts as little-endian 32-bit bytes, through a bounded table of solved pieces.

    solve: (ids in a row, number of ids of each) for strings of a block. The
    table has two generations, so pieces in use survive when it fills up.
    """

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = CACHE_PIECES):
        self.solve = solve
        self.most = most
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _solved(self, strings: list[str]) -> list[bytes]:
        ids, counts = self.solve(strings)
        ids = ids.astype("<u4").tobytes()
        end = (4 * np.cumsum(counts)).tolist()
        return [ids[a:b] for a, b in zip([0, *end[:-1]], end, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One byte string of ids per text of a block."""
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        fresh: set[str] = set()
        first = []
        again = sum(map(len, texts)) > KEPT_CHARS  # a large block is cut twice rather than kept in pieces
        cuts = []
        for t in texts:
            cut = pieces(t)
            first.append(cut[0])
            cut[0] = ""
            fresh |= set(cut).difference(known)
            if not again:
                cuts.append(cut)
        fresh.add("")
        solve = []
        for p in fresh:
            if p in old:
                known[p] = old[p]
            else:
                solve.append(p)
        long = [p for p in solve if len(p) > CACHE_PIECE_CHARS]
        if solve:
            known.update(zip(solve, self._solved([" " + p for p in solve]), strict=True))
        starts = dict.fromkeys(first)
        starts = dict(zip(starts, self._solved(list(starts)), strict=True)) if starts else {}
        known[""], space = b"", known[""]  # stands for the first piece of every text from here on
        for i, f in enumerate(first):
            cut = pieces(texts[i]) if again else cuts[i]
            if again:
                cut[0] = ""
            if "" in cut[1:]:
                yield starts[f] + b"".join([known[p] or space for p in cut[1:]])
            else:
                yield starts[f] + b"".join(map(known.__getitem__, cut))
        del known[""]
        for p in long:
            known.pop(p, None)


def rank_solver(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Ids of strings: the matches of the pattern, each replayed on its own."""
    import regex

    find = regex.compile(pattern).findall
    replay = Replay(ranks)

    def solve(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        parts: list[int] = []
        per_string = np.zeros(len(strings), np.int64)
        for i, s in enumerate(strings):
            found = find(s)
            per_string[i] = len(found)
            parts.extend([number.setdefault(p, len(number)) for p in found])
        ids, counts = replay.solve([p.encode() for p in number])
        first = np.cumsum(counts) - counts
        which = np.array(parts, np.int64)
        size = counts[which]
        at = np.repeat(first[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        string = np.repeat(np.arange(len(strings)), per_string)
        return ids[at], np.bincount(string, weights=size, minlength=len(strings)).astype(np.int64)

    return solve


#: Tables that a Python worker keeps from task to task, by vocabulary.
_TABLES: dict[str, Pieces] = {}


def kept_table(name: str, make: Callable[[], Callable]) -> Pieces:
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Pieces(make())
    return _TABLES[name]


def decode(ids: bytes, token_of: list[bytes]) -> bytes:
    return b"".join(map(token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def slice_texts(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[str]]]:
    """(first, end, texts) for slices of a text column of at most ``most`` bytes (or one longer text)."""
    at, _ = text_buffer(column)
    for lo, hi in slices(at, most):
        yield lo, hi, [x or "" for x in column.slice(lo, hi - lo).to_pylist()]


def shared_file(df: DataFrame, path: str) -> str:
    """Send a vocabulary file to the executors; the name to open there with SparkFiles."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, decoded binary): ids of every text, and the bytes they decode to."""
    def columns(rows):
        ids, back = zip(*rows, strict=True)
        return [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(back, pa.binary())]

    return _run(docs, ranks_path, pattern, id_col, text_col, "ids array<int>, decoded binary", columns)


def digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every text, from the same encoder."""
    def columns(rows):
        n, ids, back = zip(*((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest())
                             for x, y in rows), strict=True)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _run(docs, ranks_path, pattern, id_col, text_col,
                "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs, ranks_path, pattern, id_col, text_col, schema, columns) -> DataFrame:
    ship(docs.sparkSession)
    name = shared_file(docs, ranks_path)
    names = [id_col, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(SparkFiles.get(name))
        token_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            token_of[r] = t
        table = kept_table(f"{name} {pattern}", lambda: rank_solver(ranks, pattern))
        for batch in batches:
            for lo, hi, texts in slice_texts(batch.column(1), BLOCK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns(
                    ((ids, decode(ids, token_of)) for ids in table.encode(texts)))], names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema}")
