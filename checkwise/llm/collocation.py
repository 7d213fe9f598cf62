"""Phrase collocations by dynamic itemset counting.

The documents are dealt over SHARDS shards, written once. Step t scans shard
t mod SHARDS and counts, at the same time, phrases of every length that are
active: words from step 0, a longer phrase from the step after both its
subphrases (without its last, without its first word) reached the threshold in
the counts so far. A phrase is counted for one full cycle from its activation,
then left alone; the scan ends when the phrases activated last have completed
theirs. Lengths so overlap in time, and phrases of rare words are never counted.

The scan counts in hashed slots, one byte a slot: each task adds up its own,
equal blocks of slots are added in a shuffle, the driver keeps the running
counts, and the slots' activation steps go back to the tasks. All this is
bounded by MOST_SLOTS whatever the corpus. Phrases that share a slot can only be
counted too early or too high, never missed: a last pass counts, exactly and
each under its own words, all phrases whose slots reached the threshold. So the
number of slots changes the work, not the result.

The last pass counts under the 64-bit keys of the words (hashes of language and
word) and keeps every word of a reached slot; should two words share a key, all
is run again with other hashes. Its counts are added up within each task before
they are shuffled. Texts are cut into slices at piece borders, so memory does
not grow with the length of a text that has any. Joins that look up the parts of
a phrase read stored tables, so adaptive execution can split the side of a very
common word.

Defined cases: a null text is empty, a null language is ``und``; null ids,
repeated rows and equal texts count as they stand; an empty table gives no rows;
other columns of the input are not read. Arithmetic is exact (38 digits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkwise.llm import words
from checkwise.llm.common import give_back, shared_dir, ship, stored

LEAST = 10
LONGEST = 3
TOP = 2000
#: A longer phrase absorbs a part of it that occurs outside it in less than this share (per cent).
ABSORBED = 50
SHARDS = 4
#: Slots (a byte each, by phrase length): one per 16 bytes of text, within these bounds.
FEWEST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 25
#: Slots whose counts travel together.
BLOCK = 1 << 16
SLICE_BYTES = 1 << 20
#: Slots of one length, and in the last pass words, and phrases of one length, that a task adds up before it passes them on.
HELD_SLOTS = 1 << 21
HELD_WORDS = 1 << 19
HELD_ROWS = 1 << 20
#: Text that a task of the last pass reads: the more of it, the more equal phrases meet before they are shuffled.
TASK_BYTES = 32 << 20
NEVER = 255

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[ord(c) for c in ".,;:!?"]] = ord("\n")
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in "\n\x0b\x0c\r.,;:!?"]] = True

class Active:
    """Activation steps by slot, for phrases of 1 .. longest - 1 words, and the slots that reached the threshold, as of one step."""

    def __init__(self, step: int, shards: int, started: list[np.ndarray], reached: list[np.ndarray], slots: int, salt: int):
        self.step, self.shards, self.started, self.reached, self.slots, self.salt = step, shards, started, reached, slots, salt

    def counted(self, start: np.ndarray) -> np.ndarray:
        """Which phrases, by activation step, this step counts: those within their full cycle."""
        return (start <= self.step) & (self.step < start + self.shards)

    def slot(self, n: int, key: np.ndarray) -> np.ndarray:
        return _slot(self.slots, n, key)

    def begin(self, n: int, slot: np.ndarray) -> np.ndarray:
        """From which step a phrase of n words lets longer ones be counted."""
        return self.started[n - 1][slot].astype(np.int16)

    def wanting(self, n: int, slot: np.ndarray) -> np.ndarray:
        """The slots among these whose count is still below the threshold: no others need counting."""
        return slot[_bit(self.reached[n - 1], slot) == 0]


def _slots(slots: int, n: int) -> int:
    """Slots for phrases of n words: there are fewer distinct words than phrases."""
    return max(1, slots // 4) if n == 1 else slots


def _slot(slots: int, n: int, key: np.ndarray) -> np.ndarray:
    return (key & np.uint64(_slots(slots, n) - 1)).astype(np.int64)


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1


class Reached:
    """The slots that reached the threshold, as bits by phrase length: no phrase outside them can have."""

    def __init__(self, bits: list[np.ndarray], slots: int, salt: int):
        self.bits, self.slots, self.salt = bits, slots, salt

    def counted(self, start: np.ndarray) -> np.ndarray:
        return start < NEVER

    def slot(self, n: int, key: np.ndarray) -> np.ndarray:
        return _slot(self.slots, n, key)

    def begin(self, n: int, slot: np.ndarray) -> np.ndarray:
        return np.where(_bit(self.bits[n - 1], slot), 0, NEVER).astype(np.int16)


def _phrases(w: words.Words, one: np.ndarray, longest: int, active) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, keys, first words, slots) of the phrases of a slice that ``active`` counts; ``one``: the words' keys."""
    breaks = np.concatenate(([0], np.cumsum(_BREAK[w.data])))
    piece, owner = breaks[w.start], w.owner()
    follows = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
    key, first, start = one, np.arange(len(one)), np.zeros(len(one), np.int16)
    for n in range(1, longest + 1):
        slot = active.slot(n, key)
        now = active.counted(start)
        if now.any():
            yield n, key[now], first[now], slot[now]
        if n < longest:
            # a phrase of n+1 words: the n from its first word, and the n from its second
            place = np.full(len(one) + 1, -1)
            place[first] = np.arange(len(first))
            after = place[np.minimum(first + 1, len(one))]
            ok = after >= 0
            ok[ok] = follows[first[ok]]
            begin = active.begin(n, slot)
            start = np.maximum(begin, begin[after])
            head = np.flatnonzero(ok & (start < NEVER))
            first, start = first[head], start[head]
            key = words.mix(key[head] * words._MULT + one[first + n], 11 + n)


def _word_slices(batch: pa.RecordBatch, salt: int) -> Iterator[tuple[words.Words, np.ndarray, pa.Array, np.ndarray]]:
    """(words, their keys, languages, each word's language) for slices of (lang, text) rows."""
    lang = batch.column(0).fill_null("und").dictionary_encode()
    names, code = lang.dictionary, np.asarray(lang.indices)
    hashed = np.array([int.from_bytes(hashlib.blake2b(f"{salt} {x}".encode(), digest_size=8).digest(), "little")
                       for x in names.to_pylist()], np.uint64)
    at, data = words.text_buffer(batch.column(1))
    word_hash = words.seeded_hash(salt)
    for lo, hi in words.slices_at(at, data, _BREAK, SLICE_BYTES):
        a, b = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        w = words.split(_FOLD[data[lo:hi]], np.clip(at[a:b + 1], lo, hi) - lo, word_hash)
        if len(w.hash):
            of_word = code[a + w.owner()]
            yield w, words.mix(w.hash ^ hashed[of_word], 1 + salt), names, of_word


class Tally:
    """Counts by slot of one phrase length, as sorted slots and counts (saturating at 255)."""

    def __init__(self):
        self.slots: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, slot: np.ndarray) -> None:
        slot, count = np.unique(slot, return_counts=True)
        self.slots.append(slot.astype(np.uint32))
        self.counts.append(np.minimum(count, 255).astype(np.uint8))
        self.size += len(slot)

    def merge(self) -> None:
        # slot and count in one number, sorted in place: no order beside them
        both = np.concatenate(self.slots, dtype=np.uint64)
        both <<= np.uint64(8)
        both |= np.concatenate(self.counts)
        self.slots, self.counts = [], []
        both.sort()
        slot, count = (both >> np.uint64(8)).astype(np.uint32), both.astype(np.uint8)
        del both
        at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        self.slots, self.counts = [slot[at]], [np.minimum(np.add.reduceat(count, at, dtype=np.int64), 255).astype(np.uint8)]
        self.size = len(at)

    def blocks(self, n: int) -> Iterator[pa.RecordBatch]:
        """One row per block of slots: the slots' places in it (two bytes each), then their counts."""
        self.merge()
        slot, count = self.slots[0], self.counts[0]
        edges = np.flatnonzero(np.diff(slot // BLOCK)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(slot)], strict=True):
            body = (slot[lo:hi] % BLOCK).astype("<u2").tobytes() + count[lo:hi].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([int(slot[lo]) // BLOCK], pa.int32()),
                                              pa.array([body], pa.binary())], ["n", "block", "counts"])


def _counter(longest: int, sent):
    """Arrow function: (lang, text) -> the slots' counts of one task, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = sent.value
        held: dict[int, Tally] = {}
        for batch in batches:
            for w, one, _, _ in _word_slices(batch, active.salt):
                for n, _, _, slot in _phrases(w, one, longest, active):
                    slot = active.wanting(n, slot)
                    if not len(slot):
                        continue
                    tally = held.setdefault(n, Tally())
                    tally.add(slot)
                    if tally.size > HELD_SLOTS:
                        tally.merge()
                        if tally.size > HELD_SLOTS // 2:
                            yield from held.pop(n).blocks(n)
        for n in list(held):
            yield from held.pop(n).blocks(n)
        give_back()

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: sums of equal blocks that met in one task, one byte a slot."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for n, block, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            size = len(body) // 3
            place, new = np.frombuffer(body, "<u2", size), np.frombuffer(body, np.uint8, size, 2 * size)
            total = held.setdefault((n, block), np.zeros(BLOCK, np.uint8))
            total[place] = np.minimum(total[place].astype(np.int16) + new, 255)
    for (n, block), counts in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([block], pa.int32()),
                                          pa.array([counts.tobytes()], pa.binary())], ["n", "block", "counts"])
    held.clear()
    give_back()


def _scan(corpus: DataFrame, least: int, longest: int, shards: int, slots: int, salt: int) -> Reached:
    """The cyclic scan: which slots reached ``least``, each phrase counted for one cycle from its activation."""
    spark = corpus.sparkSession
    started = [np.full(_slots(slots, n), NEVER, np.uint8) for n in range(1, longest)]
    running = [np.zeros(_slots(slots, n), np.uint8) for n in range(1, longest + 1)]
    step, until = 0, shards
    while step < until:
        reached = [np.packbits(t >= least, bitorder="little") for t in running]
        sent = spark.sparkContext.broadcast(Active(step, shards, started, reached, slots, salt))
        found = corpus.filter(F.col("shard") == step % shards).select("lang", "text").mapInArrow(
            _counter(longest, sent), "n int, block int, counts binary")
        total = stored(found.repartition("n", "block").mapInArrow(_added, found.schema), "slots")
        for r in total.toLocalIterator():
            block = slice(r.block * BLOCK, (r.block + 1) * BLOCK)
            now = running[r.n - 1][block]
            now[:] = np.minimum(now.astype(np.int16) + np.frombuffer(r.counts, np.uint8)[:len(now)], 255)
            if r.n < longest:
                start = started[r.n - 1][block]
                new = (now >= least) & (start == NEVER)
                start[new] = step + 1
                if new.any():
                    until = max(until, step + 1 + shards)
        sent.destroy()
        step += 1
    return Reached([np.packbits(t >= least, bitorder="little") for t in running], slots, salt)


def _schema(longest: int) -> str:
    keys = ", ".join(f"k{i} long" for i in range(1, longest + 1))
    return f"n int, {keys}, lang string, word string, c long"


class Phrases:
    """Counts of the phrases of n words that a task holds, as arrays: their keys, their words' keys, their counts."""

    def __init__(self, n: int):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, of_word: np.ndarray) -> None:
        """Phrases by key and (n, phrases) words' keys, each counted once, as a part of its own."""
        self._join([(key, of_word, np.ones(len(key), np.int64))])

    def merge(self) -> None:
        """All parts as one."""
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            self._join(parts)

    def _join(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adds up where neighbours by key are equal in all words: equal phrase keys of unequal words stay apart (then in more than
        one row each, perhaps). One column at a time, so that no second copy of all of them is held."""
        column = lambda i: np.concatenate([of_word[i] for _, of_word, _ in parts])
        key = np.concatenate([k for k, _, _ in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        for i in range(self.n):
            word = column(i)[order]
            new[1:] |= word[1:] != word[:-1]
        at = np.flatnonzero(new)
        count = np.add.reduceat(np.concatenate([c for _, _, c in parts])[order], at)
        key, first = key[at], order[at]
        del order, new, at
        of_word = np.empty((self.n, len(key)), np.uint64)
        for i in range(self.n):
            of_word[i] = column(i)[first]
        self.parts.append((key, of_word, count))
        self.size += len(key)


class Vocabulary:
    """Counts of the words that a task holds, as arrays: their keys, languages, bytes, counts."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, lang: pa.Array, word: pa.Array, count: np.ndarray) -> None:
        self.parts.append((key, lang, word, count))
        self.size += len(key) + word.nbytes // 64  # long words count for more

    def merge(self) -> None:
        """All parts as one, added up where neighbours by key are the same word of the same language."""
        parts, self.parts, self.size = self.parts, [], 0
        if not parts:
            return
        key, count = (np.concatenate([p[i] for p in parts]) for i in (0, 3))
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        lang, word = (pa.concat_arrays([p[i] for p in parts]).take(pa.array(order)) for i in (1, 2))
        parts.clear()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        for text in (lang, word):
            new[1:] |= pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(new)
        self.add(key[at], lang.take(pa.array(at)), word.take(pa.array(at)), np.add.reduceat(count, at))


def _exact(longest: int, sent):
    """Arrow function: (lang, text) -> counts of the phrases in reached slots (keys of their words; the word itself for
    n = 1) and of all words of a language (n = 0), added up within the task."""
    columns = ["n", *[f"k{i}" for i in range(1, longest + 1)], "lang", "word"]

    def rows(n, keys, lang, word, count):
        size = len(count)
        blank = [pa.array(np.zeros(size, np.int64))] * (longest - len(keys))
        none = pa.nulls(size, pa.string())
        return pa.Table.from_arrays([pa.array(np.full(size, n, np.int32)), *map(pa.array, keys), *blank,
                                     none if lang is None else lang, none if word is None else word, pa.array(count)], [*columns, "c"])

    def counted_words(w, names, of_word, key, first):
        order = np.argsort(key, kind="stable")
        key, first = key[order], first[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of_word[first[1:]] != of_word[first[:-1]])
        at = np.flatnonzero(new)
        count, first = np.diff(np.append(at, len(key))), first[at]
        word = pa.array([w.data[a:b].tobytes() for a, b in zip(w.start[first], w.end[first], strict=True)], pa.binary())
        return key[at], names.take(pa.array(of_word[first])), word.cast(pa.string()), count

    def passed_words(vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
        parts, vocabulary.parts, vocabulary.size = vocabulary.parts, [], 0
        for key, lang, word, count in parts:
            for lo in range(0, len(key), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield from rows(1, [key[some].view(np.int64)], lang[some], word[some], count[some]).to_batches()

    def passed_totals(totals: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if totals:
            yield from rows(0, [], pa.array(list(totals), pa.string()), None, np.array(list(totals.values()), np.int64)).to_batches()
        totals.clear()

    def passed(phrases: Phrases) -> Iterator[pa.RecordBatch]:
        """The held phrases by their words: equal words of neighbours make the rows smaller on disk."""
        parts, phrases.parts, phrases.size = phrases.parts, [], 0
        for _, of_word, count in parts:
            order = np.lexsort(of_word[::-1])
            for lo in range(0, len(order), 1 << 16):
                some = order[lo:lo + (1 << 16)]
                yield from rows(phrases.n, [np.ascontiguousarray(k[some]).view(np.int64) for k in of_word], None, None, count[some]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, vocabulary, totals = sent.value, Vocabulary(), {}
        phrases = {n: Phrases(n) for n in range(2, longest + 1)}
        for batch in batches:
            for w, one, names, of_word in _word_slices(batch, reached.salt):
                for lang, count in zip(names.to_pylist(), np.bincount(of_word, minlength=len(names)).tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + count
                for n, key, first, slot in _phrases(w, one, longest, reached):
                    kept = reached.begin(n, slot) < NEVER
                    key, first = key[kept], first[kept]
                    if not len(key):
                        continue
                    if n == 1:
                        vocabulary.add(*counted_words(w, names, of_word, key, first))
                    else:
                        phrases[n].add(key, np.stack([one[first + i] for i in range(n)]))
                if len(totals) > HELD_WORDS:
                    yield from passed_totals(totals)
                if vocabulary.size > HELD_WORDS:
                    vocabulary.merge()
                    if vocabulary.size > HELD_WORDS // 2:
                        yield from passed_words(vocabulary)
                for p in phrases.values():
                    if p.size > HELD_ROWS:
                        give_back()
                        p.merge()
                        if p.size > HELD_ROWS // 2:
                            yield from passed(p)
        yield from passed_totals(totals)
        vocabulary.merge()
        yield from passed_words(vocabulary)
        for p in phrases.values():
            p.merge()
            yield from passed(p)
        give_back()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang",
                  text_col: str = "text", shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, vocabulary, totals). counts(n, k1 .. k<longest>, c): all phrases of 1 .. longest words with c >= least, as
    the keys of their words (0 behind the last); vocabulary(key, lang, word): the words among them; totals(lang, words)."""
    if shards * longest >= NEVER or not 0 < least < 256:
        raise ValueError("shards * longest must stay below 255 and the threshold between 1 and 255")
    spark = docs.sparkSession
    ship(spark)
    dealt = shared_dir(spark, "shards")
    (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                 (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
     .write.partitionBy("shard").parquet(dealt))
    corpus = spark.read.schema("lang string, text string, shard int").parquet(dealt)
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (size // 16).bit_length()))
    keys = [f"k{i}" for i in range(1, longest + 1)]
    for salt in range(9):
        reached = spark.sparkContext.broadcast(_scan(corpus, least, longest, shards, slots, salt))
        tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
        exact = corpus.select("lang", "text").coalesce(tasks).mapInArrow(_exact(longest, reached), _schema(longest))
        exact = stored(exact.groupBy("n", *keys, "lang", "word").agg(F.sum("c").alias("c")).filter(f"n <= 1 or c >= {least}"), "counts")
        # rarer words in the same slots too: one that shared a frequent word's key would add to its phrases
        if not exact.filter("n = 1").groupBy("k1").count().filter("count > 1").head(1):
            break
    else:
        raise RuntimeError("words share a key under every salt")
    totals = exact.filter("n = 0").select("lang", F.col("c").alias("words"))
    vocabulary = exact.filter(f"n = 1 and c >= {least}").select(F.col("k1").alias("key"), "lang", "word")
    return exact.filter(f"n > 0 and c >= {least}").select("n", *keys, "c"), vocabulary, totals


def _phrase(first: int, last: int, longest: int) -> list[Column]:
    """The keys of the words first .. last of a phrase as a phrase of its own."""
    return [(F.col(f"k{first + i}") if first + i <= last else F.lit(0).cast("long")).alias(f"k{i + 1}") for i in range(longest)]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED,
                 lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 .. longest words.

    a, l, r: occurrences of the phrase and of the two parts of its lowest-scoring cut;
    score: floor(10^6 * a * a / (l * r)); n: words of the language.
    """
    counts, word, totals = phrase_counts(docs, least, longest, lang_col, text_col, shards)
    keys = [f"k{i}" for i in range(1, longest + 1)]
    cuts, parts = [], []
    for n in range(2, longest + 1):
        of = counts.filter(F.col("n") == n)
        for k in range(1, n):
            cuts.append(of.select("n", F.lit(k).alias("k"), *keys, F.col("c").alias("a"),
                                  F.struct(*_phrase(1, k, longest)).alias("head"), F.struct(*_phrase(k + 1, n, longest)).alias("tail")))
        for m in range(2, n):
            parts += [of.select(*_phrase(i, i + m - 1, longest), "c") for i in range(1, n - m + 2)]
    cut = _all(cuts)
    if cut is None:
        raise ValueError("phrases have two words at least")
    for side, name in (("head", "l"), ("tail", "r")):
        found = counts.select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.col("c").alias(name))
        cut = cut.select("*", *[F.col(side)[k].alias(f"{side}_{k}") for k in keys]).drop(side)
        cut = cut.join(found, [f"{side}_{k}" for k in keys]).drop(*[f"{side}_{k}" for k in keys])
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cut = cut.withColumns({"up": F.lit(1_000_000).cast("decimal(38,0)") * whole("a") * whole("a"), "down": whole("l") * whole("r")})
    best = (cut.withColumn("score", F.expr("cast(up div down as long)")).groupBy("n", *keys, "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("best")))
    if parts:
        longer = _all(parts).groupBy(*keys).agg(F.max("c").alias("longer"))
        best = best.join(longer, keys, "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")

    # the language first; only phrases that can be in the report get their words
    ranked = best.join(word.select(F.col("key").alias("k1"), "lang", F.col("word").alias("w1")), "k1")
    by_lang = W.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"))
    ranked = ranked.withColumn("rank", F.rank().over(by_lang)).filter(F.col("rank") <= top).drop("rank")
    for i in range(2, longest + 1):
        ranked = ranked.join(word.select(F.col("key").alias(f"k{i}"), F.col("word").alias(f"w{i}")), f"k{i}", "left")
    named = ranked.withColumn("phrase", F.concat_ws(" ", *[F.col(f"w{i}") for i in range(1, longest + 1)]))
    ranked = named.withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("best.score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"),
        F.col("words").alias("n"), F.col("best.score").alias("score"))


def _all(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out
