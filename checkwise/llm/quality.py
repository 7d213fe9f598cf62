"""Quality rules: suffix arrays over the words of each text find what it repeats.

All texts of a slice are sorted as one suffix array by prefix doubling (each
text ends in a word of its own, so nothing matches across texts). Ranks of
every doubling step give the longest common prefix of neighbours. Each suffix's
longest repeat is its longer common prefix with a neighbour; those of at least
MIN_REPEAT words are the longest-common-prefix intervals' maximal repeats. The
union of their spans is the covered part; the verdict limits the covered
fraction and the longest repeat. Covered words also lie in 3-word windows found
twice, so MAX_COVERED acts only below the base rule's MAX_REPEAT_WORDS_PCT.

Defined cases: a null, empty or blank text has no words, fails the base rules
and is not kept. Rows are judged one by one, so repeated rows, null ids and
extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from checkwise.llm.common import ship
from checkwise.llm.words import Words, each_slice, grams

MIN_WORDS = 50
MAX_REPEAT_WORDS_PCT = 50
#: Words a repeat must have to count as covered, the largest covered share, the longest allowed repeat.
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered_words long, longest_repeat long, base_failed boolean, kept boolean")


def longest_repeats(w: Words) -> np.ndarray:
    """For each word, the length in words of the longest repeat (inside its text) that starts there."""
    n_words, texts = len(w.hash), len(w.at) - 1
    if not n_words:
        return np.zeros(0, np.int64)
    # symbols: equal words of one text get equal numbers; each text ends in a symbol of its own
    owner = w.owner()
    place = np.arange(n_words) + owner
    n = n_words + texts
    order = np.lexsort((w.hash, owner))
    fresh = np.concatenate(([True], (w.hash[order][1:] != w.hash[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    group = np.maximum.accumulate(np.where(fresh, np.arange(n_words), 0))
    rank = np.empty(n, np.int64)
    rank[place[order]] = group
    ends = np.setdiff1d(np.arange(n), place, assume_unique=True)
    rank[ends] = n_words + np.arange(len(ends))
    array = np.concatenate((place[order], ends))  # suffixes in order of their first symbol
    levels = [rank.copy()]
    k = 1
    while True:
        sizes = np.bincount(rank, minlength=n)
        open_at = np.flatnonzero(sizes[rank[array]] > 1)
        if not len(open_at):
            break
        act = array[open_at]
        base = rank[act]
        follow = rank[act + k]  # equal so far without an end symbol, so act + k is inside the text
        order = np.lexsort((follow, base))
        act, base, follow = act[order], base[order], follow[order]
        array[open_at] = act
        new = np.concatenate(([True], (base[1:] != base[:-1]) | (follow[1:] != follow[:-1])))
        rank = rank.copy()
        rank[act] = open_at[np.maximum.accumulate(np.where(new, np.arange(len(act)), 0))]
        levels.append(rank)
        k *= 2
    # common prefix of neighbours: take the largest steps at which the ranks agree
    a, b = array[:-1].copy(), array[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for step in range(len(levels) - 1, -1, -1):
        level = levels[step]
        same = level[np.minimum(a, n - 1)] == level[np.minimum(b, n - 1)]
        same &= (a < n) & (b < n)
        grow = same.astype(np.int64) << step
        lcp += grow
        a += grow
        b += grow
    longest = np.zeros(n, np.int64)
    longest[array[1:]] = lcp
    longest[array[:-1]] = np.maximum(longest[array[:-1]], lcp)
    return longest[place]


def _repeat_words(w: Words, n: int = 3) -> np.ndarray:
    """Words of each text inside n-word windows found twice or more in it."""
    texts = len(w.at) - 1
    h = grams(w.hash, n)
    if not len(h):
        return np.zeros(texts, np.int64)
    owner = w.owner()
    at = np.flatnonzero(owner[:len(h)] == owner[n - 1:])
    order = at[np.lexsort((h[at], owner[at]))]
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
    covered = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + n, -1)
    return np.bincount(owner[np.cumsum(covered[:-1]) > 0], minlength=texts)


def _dup_lines(w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line, per text."""
    texts = len(w.at) - 1
    out = np.zeros(texts, np.int64)
    breaks = np.flatnonzero(w.data == 10)
    per_text = np.searchsorted(breaks, w.text_at)
    for i in np.flatnonzero(np.diff(per_text)):
        seen, n = set(), 0
        for line in w.text(i).split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
        out[i] = n
    return out


def measure(w: Words, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
            max_longest: int = MAX_LONGEST) -> list[np.ndarray]:
    """The columns of SCHEMA for the texts of a slice."""
    texts = len(w.at) - 1
    n_words = np.diff(w.at)
    owner = w.owner()

    def per_text(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mark)))
        return total[w.text_at[1:]] - total[w.text_at[:-1]]

    lead = (w.data & 0xC0) != 0x80
    space = np.isin(w.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    repeat_words = _repeat_words(w)
    longest = longest_repeats(w)
    at = np.arange(len(longest))
    reach = np.maximum.accumulate(np.where(longest >= min_repeat, at + longest, 0)) if len(at) else at
    covered = np.bincount(owner[reach > at], minlength=texts)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, owner, longest)
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_WORDS_PCT * n_words)
    kept = ~failed & (covered <= max_covered * n_words) & (most <= max_longest)
    return [n_words, per_text(lead & ~space), per_text(_SYMBOL[w.data]), _dup_lines(w), repeat_words,
            covered, most, failed, kept]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(id_col, columns of SCHEMA): figures and verdict of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_slice(batch.column(1)):
                columns = [pa.array(c) for c in measure(w, **limits)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names)

    names = [id_col, *(c.split()[0] for c in SCHEMA.split(", "))]
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; no shuffle."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_slice(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(measure(w, **limits)[-1]))

    return docs.mapInArrow(run, docs.schema)
