"""Phrase collocations against a plain count of all phrases."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from checkwise.llm import collocation, words


def _pieces(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0a-\x0d]", lower)]


def _brute(rows, least, longest=3, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in _pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        kept = []
        for p, a in cand.items():
            if 100 * longer[p] >= 50 * a:
                continue
            score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def _found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def _table(spark, rows, parts=5):
    return spark.createDataFrame([(i, lang, text, "x", 1) for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, phrase string, n int").repartition(parts)


def _random_rows(seed, n=120):
    g = random.Random(seed)
    vocabulary = ["The", "of", "a", "data", "New", "york", "é", "ÉA", "x_y", "it's", "日本", "zz" * 50]
    rows = []
    for _ in range(n):
        text = "".join(g.choice(vocabulary) + g.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "\x0b", "!?", " "])
                       for _ in range(g.randrange(0, 60)))
        rows.append((g.choice(["en", "de", None]), text))
    return rows + [(None, None), ("en", None), ("en", ""), ("fr", " \n. "), ("en", "new york city " * 500), ("es", "solo")]


@pytest.mark.parametrize("seed, least, shards", [(1, 10, 4), (2, 3, 1), (3, 5, 3)])
def test_phrases_brute(spark, seed, least, shards):
    rows = _random_rows(seed)
    assert _found(collocation.collocations(_table(spark, rows), least=least, shards=shards)) == _brute(rows, least)


def test_phrases_longer_and_top(spark, monkeypatch):
    """Other lengths, a short report, slices cut inside texts, and slots that all phrases share."""
    monkeypatch.setattr(collocation, "SLICE_BYTES", 50)
    monkeypatch.setattr(collocation, "HELD_SLOTS", 20)
    monkeypatch.setattr(collocation, "HELD_ROWS", 30)
    rows = _random_rows(7, 60)
    assert _found(collocation.collocations(_table(spark, rows, 2), least=4, longest=5, top=7)) == _brute(rows, 4, 5, 7)
    monkeypatch.setattr(collocation, "FEWEST_SLOTS", 8)
    monkeypatch.setattr(collocation, "MOST_SLOTS", 8)
    assert _found(collocation.collocations(_table(spark, rows, 3), least=4)) == _brute(rows, 4)


def test_phrases_hot_pair_and_empty(spark):
    rows = [("en", "very common pair")] * 400 + [("en", f"very common{i} pair") for i in range(50)]
    assert _found(collocation.collocations(_table(spark, rows))) == _brute(rows, 10)
    assert collocation.collocations(_table(spark, rows).limit(0)).collect() == []


def test_exact_beyond_64_bits(spark, monkeypatch):
    """The score's products: 10^6 * a * a and l * r need more than 64 bits."""
    a, l, r = 3_000_000_019, 5_000_000_029, 7_000_000_001
    counts = spark.createDataFrame([(2, 8, 9, 0, a), (1, 8, 0, 0, l), (1, 9, 0, 0, r)], "n int, k1 long, k2 long, k3 long, c long")
    vocabulary = spark.createDataFrame([(8, "en", "p"), (9, "en", "q")], "key long, lang string, word string")
    totals = spark.createDataFrame([("en", l + r)], "lang string, words long")
    monkeypatch.setattr(collocation, "phrase_counts", lambda *_: (counts, vocabulary, totals))
    assert _found(collocation.collocations(counts)) == [("en", 1, "p q", a, l, r, l + r, 10**6 * a * a // (l * r))]


def test_words_that_share_a_key(spark, monkeypatch):
    """Equal hashes of unlike words are found, and all is run again with others."""
    exact, salts = collocation._exact, []

    def clashing(longest, sent):
        salts.append(sent.value.salt)
        run = exact(longest, sent)
        if sent.value.salt:
            return run
        return lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([5] * len(b)), *b.columns[2:]], b.schema.names)
                                for b in run(batches))

    monkeypatch.setattr(collocation, "_exact", clashing)
    rows = _random_rows(9, 40)
    assert _found(collocation.collocations(_table(spark, rows), least=3)) == _brute(rows, 3)
    assert salts == [0, 1]


def test_thue_morse_words(spark):
    """Words whose polynomial hashes are equal, whatever the base: one frequent and one rare, and two frequent ones."""
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    rows = [("en", f"p {x} q")] * 12 + [("en", f"p {y} q")] * 5 + [("de", f"p {x} q")] * 12 + [("de", f"p {y} q")] * 15
    assert _found(collocation.collocations(_table(spark, rows))) == _brute(rows, 10)


def test_rare_word_that_shares_a_key(spark, monkeypatch):
    """A word below the threshold under a frequent word's key is found as well."""
    exact, seen = collocation._exact, []

    def rare_clash(longest, sent):
        seen.append(sent.value.salt)
        run = exact(longest, sent)
        if sent.value.salt:
            return run

        def clash(batches):
            for b in run(batches):
                rare = np.array([w in ("rare", "common") for w in b.column(b.schema.get_field_index("word")).to_pylist()])
                k1 = np.where(rare, 5, b.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1), *b.columns[2:]], b.schema.names)
        return clash

    monkeypatch.setattr(collocation, "FEWEST_SLOTS", 1)
    monkeypatch.setattr(collocation, "MOST_SLOTS", 1)
    monkeypatch.setattr(collocation, "_exact", rare_clash)
    rows = [("en", "common word")] * 12 + [("en", "rare word")] * 3
    assert _found(collocation.collocations(_table(spark, rows))) == _brute(rows, 10)
    assert seen == [0, 1]


def test_slices_end_at_pieces():
    g = random.Random(2)
    for _ in range(200):
        texts = ["".join(g.choice("ab .\n") for _ in range(g.randrange(0, 40))) for _ in range(g.randrange(1, 8))]
        at = np.cumsum([0] + [len(t) for t in texts])
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        cuts = list(words.slices_at(at, data, collocation._BREAK, g.randrange(1, 20)))
        assert [lo for lo, _ in cuts][1:] == [hi for _, hi in cuts][:-1]
        assert not len(data) or (cuts[0][0] == 0 and cuts[-1][1] == len(data))
        assert all(hi in at or chr(data[hi - 1]) in ".\n" for _, hi in cuts)


def test_registered(spark, sf_small, registered):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert _found(registered["op11_phrases"](spark, sf_small)) == _brute(rows, 10)


def test_last_pass_adds_up_and_passes_on_by_words():
    """Phrases met in several slices leave a task as one row each, equal first words side by side; equal keys of unequal words stay apart."""
    held = collocation.Phrases(2)
    held.add(np.array([9, 7, 9], np.uint64), np.array([[2, 1, 2], [5, 5, 5]], np.uint64))
    held.add(np.array([9, 7, 7], np.uint64), np.array([[2, 1, 3], [5, 5, 5]], np.uint64))
    held.merge()
    (_, of_word, count), = held.parts
    assert sorted(zip(*of_word.tolist(), count.tolist(), strict=True)) == [(1, 5, 2), (2, 5, 3), (3, 5, 1)]


def test_last_pass_reads_larger_tasks(spark, monkeypatch):
    """The last pass reads the shards in fewer tasks than the scan, so that more equal phrases meet before the shuffle."""
    seen, frame = [], type(spark.range(0))
    coalesce = frame.coalesce
    monkeypatch.setattr(frame, "coalesce", lambda self, n: seen.append(n) or coalesce(self, n))
    rows = [("en", "very common pair")] * 40
    assert _found(collocation.collocations(_table(spark, rows))) == _brute(rows, 10)
    assert seen == [2 * spark.sparkContext.defaultParallelism]


def test_last_pass_adds_up_without_a_second_copy():
    """Adding up what a task holds takes less than twice its size beside it (a worker shares its executor's memory)."""
    g, held = np.random.default_rng(3), collocation.Phrases(3)
    for _ in range(20):
        held.add(g.integers(0, 2**63, 20_000, np.uint64), g.integers(0, 2**63, (3, 20_000), np.uint64))
    size = sum(x.nbytes for part in held.parts for x in part)
    tracemalloc.start()
    held.merge()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held.size == 400_000 and peak < 2 * size


def test_vocabulary_adds_up():
    """Words met in several slices leave a task as one row each; unlike words or languages under one key stay apart."""
    held = collocation.Vocabulary()
    for key, lang, word, count in [([7, 9], ["en", "en"], ["a", "b"], [2, 3]), ([9, 7], ["en", "en"], ["b", "c"], [4, 5]), ([9], ["de"], ["b"], [6])]:
        held.add(np.array(key, np.uint64), pa.array(lang), pa.array(word), np.array(count, np.int64))
    held.merge()
    (key, lang, word, count), = held.parts
    assert sorted(zip(key.tolist(), lang.to_pylist(), word.to_pylist(), count.tolist(), strict=True)) == [
        (7, "en", "a", 2), (7, "en", "c", 5), (9, "de", "b", 6), (9, "en", "b", 7)]


def test_tasks_give_memory_back(monkeypatch):
    """Every task hands its freed memory back at its end, and the words it passes on early, for want of room, are still whole."""
    given = []
    monkeypatch.setattr(collocation, "give_back", lambda: given.append(1))
    monkeypatch.setattr(collocation, "HELD_WORDS", 1)
    monkeypatch.setattr(collocation, "SLICE_BYTES", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None, "de", "en"]), pa.array(["a b. a", "a", "b,b", "b"])], ["lang", "text"])
    full = lambda size: [np.full(size, 255, np.uint8)] * 2
    sent = type("Sent", (), {"value": collocation.Reached(full(8), 64, 0)})
    seen = Counter()
    for b in collocation._exact(2, sent)(iter([batch])):
        for r in b.to_pylist():
            seen[r["n"], r["lang"], r["word"]] += r["c"]
    assert given and seen == {(0, "en", None): 4, (0, "und", None): 1, (0, "de", None): 2, (1, "en", "a"): 2, (1, "en", "b"): 2,
                              (1, "und", "a"): 1, (1, "de", "b"): 2, (2, None, None): 1}
    given.clear()
    sent.value = collocation.Active(0, 1, [np.zeros(16, np.uint8)], full(8), 64, 0)
    assert list(collocation._counter(2, sent)(iter([batch]))) == [] and given == [1]
    assert list(collocation._added(iter([]))) == [] and given == [1, 1]
