"""Toxicity scores by weak supervision.

1. Terms. A term is a word, or a beginning or end of a word (so that a stem is
   found in all its forms), or a pattern (exclamations, shouted, masked,
   stretched and digit-spelled words). From a bounded sample of labelled rows
   (SAMPLE_ROWS) the TERMS terms that differ most between the labels are taken,
   besides a short general lexicon.
2. Voters. A term votes where it occurs, or where it is dense (DENSE
   occurrences in a word): up to VOTERS of these, without near duplicates.
3. Label model. All documents outside the held-out fold vote. The joint
   distribution of the votes given the hidden label is a tree (Chow-Liu: each
   voter depends on the label and on one other voter), so accuracies and
   correlations are both estimated, by expectation-maximisation over the table
   of distinct vote patterns: every round is a Spark aggregation of expected
   pair counts, VOTERS squared numbers. A known label is one more voter that errs
   in the share LABEL_ERROR. All unlabelled rows together weigh as much as the
   labelled ones, so the hidden label keeps their meaning.
4. Classifier. A logistic regression is trained on the sample's rows with the
   model's posterior labels (each row counts as toxic with the posterior's
   weight, as clean with the rest), over presence and density of every term.
   It scores every whole text.

Labels are read only where crc32(doc_id as text) mod FOLDS is not 0. Language,
source, id and labels are no inputs of a score.

Defined cases: a null text is empty; empty texts get the score of a text without
terms; rows with a null id are scored, are not held out and have no label; a
repeated id has the largest of its labels, and each of its rows its own score;
without labels, or with labels of one kind only, the lexicon alone starts the
label model; an empty table gives no rows. Texts are cut into slices between
words, so memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.llm import words
from checkwise.llm.common import ship, stored

FOLDS = 5
#: Labelled rows from which terms, voters and the classifier are fitted (about; chosen by hash).
SAMPLE_ROWS = 20_000
TERMS = 400
VOTERS = 96
#: Rows of the sample a term must occur in.
SUPPORT = 3
#: Occurrences in a word from which a term is dense.
DENSE = 0.01
#: Voters that agree on this share of the rows either fires on are the same voter.
SAME = 0.9
LABEL_ERROR = 0.02
ROUNDS = 8
#: Pseudo-counts of the label model, and the classifier's ridge.
SMOOTH = 0.5
RIDGE = 1e-4
_PRIOR = 0.05

#: General insults, the voters that need no label.
LEXICON = (
    "idiot stupid moron dumb fool loser trash scum pathetic worthless disgusting clown jerk garbage imbecile bastard "
    "bitch asshole hate ugly filthy vermin pig freak shit crap fuck fucking damn retard "
    "idiote imbecile connard salope merde ordure abruti debile "
    "dumm dummkopf trottel arschloch abschaum scheisse schwein verlierer "
    "idiota estupido imbecil basura escoria cabron mierda asqueroso").split()

_HEADS, _TAILS = (3, 4, 5, 6, 8), (4, 6)
_PATTERNS = ("exclamations", "shouted", "masked", "stretched", "digits")

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
for _a in (*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)):
    _FOLD[_a] = _a
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER, _DIGIT, _MASK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_DIGIT[ord("0"):ord("9") + 1] = True
_MASK[[ord(c) for c in "*#$@%&"]] = True
_LETTER = (_FOLD != 0x20) & ~_DIGIT
_WORD, _HEAD, _TAIL = 1, 100, 200


def _keys(w: words.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word indices, 64-bit term keys): each word, its beginnings and its ends (in bytes)."""
    length = w.end - w.start
    yield np.arange(len(length)), words.mix(w.hash, _WORD)
    byte = words._BYTE[w.data]
    for k, tail in [(k, False) for k in _HEADS] + [(k, True) for k in _TAILS]:
        long = np.flatnonzero(length > k)
        at = w.end[long] - k if tail else w.start[long]
        h = np.zeros(len(long), np.uint64)
        for i in range(k):
            h = h * words._MULT + byte[at + i]
        yield long, words.mix(h, (_TAIL if tail else _HEAD) + k)


def key_of(term: str) -> int:
    """The key of a word, of a beginning ``abc~`` or of an end ``~abc``."""
    body = term.strip("~").encode()
    data = np.frombuffer(body + b"~" * (term != term.strip("~")), np.uint8)
    if term.endswith("~"):
        return int(words.mix(_power(data[:-1]), _HEAD + len(body))[0])
    if term.startswith("~"):
        return int(words.mix(_power(data[:-1]), _TAIL + len(body))[0])
    return int(words.mix(words.split(data, np.array([0, len(data)])).hash, _WORD)[0])


def _power(data: np.ndarray) -> np.ndarray:
    h = np.zeros(1, np.uint64)
    for b in words._BYTE[data]:
        h = h * words._MULT + b
    return h


def _patterns(data: np.ndarray, w: words.Words) -> list[np.ndarray]:
    """Positions in bytes at which each pattern counts once."""
    upper, letter = _UPPER[data], _LETTER[data]
    inside = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    up = inside(upper)
    shouted = (up[w.end] - up[w.start] == w.end - w.start) & (w.end - w.start >= 3)
    beside = np.zeros(len(data), bool)
    beside[1:] |= letter[:-1]
    same = letter[1:] & (data[1:] == data[:-1])
    run = same.copy()
    for k in (1, 2):
        run[k:] &= same[:-k]
        run[:k] = False
    first = run.copy()
    first[1:] &= ~run[:-1]
    near = np.zeros(len(data), bool)
    near[1:-1] = _DIGIT[data[1:-1]] & letter[:-2] & letter[2:]
    return [np.flatnonzero(data == ord("!")), w.start[shouted], np.flatnonzero(_MASK[data] & beside),
            np.flatnonzero(first) + 1, np.flatnonzero(near)]


def _slices(at: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, words.Words]]:
    """(raw bytes, text index of each word, folded words) for slices of a text column, cut between words."""
    for lo, hi in words.slices_at(at, data, _SPACE):
        a, b = int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi, "left"))
        raw, text_at = data[lo:hi], np.clip(at[a:b + 1], lo, hi) - lo
        w = words.split(_FOLD[raw], text_at)
        yield raw, a + w.owner(), w


def _counted(texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, terms, counts, words of each text): term occurrences; terms are numbered by sorted key, patterns after them."""
    at, data = words.text_buffer(texts)
    n_words = np.zeros(len(texts), np.int64)
    found = []
    for raw, owner, w in _slices(at, data):
        np.add.at(n_words, owner, 1)
        pairs = []
        for word, key in _keys(w):
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            pairs.append(owner[word[hit]] * (len(keys) + len(_PATTERNS)) + place[hit])
        if len(owner):
            for j, where in enumerate(_patterns(raw, w)):
                word = np.minimum(np.searchsorted(w.start, where, "right"), len(owner)) - 1
                pairs.append(owner[np.maximum(word, 0)] * (len(keys) + len(_PATTERNS)) + len(keys) + j)
        found.append(np.unique(np.concatenate(pairs), return_counts=True))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (n_words,)
    pair, count = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
    unique, where = np.unique(pair, return_inverse=True)
    total = np.bincount(where, count, len(unique)).astype(np.int64)
    return unique // (len(keys) + len(_PATTERNS)), unique % (len(keys) + len(_PATTERNS)), total, n_words


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic rows, clean rows) of all terms of labelled texts, added up per batch."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        at, data = words.text_buffer(batch.column(0))
        held = []
        for _, owner, w in _slices(at, data):
            for word, key in _keys(w):
                order = np.lexsort((key, owner[word]))
                o, k = owner[word][order], key[order]
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
                held.append((k[new], toxic[o[new]]))
        if held:
            key, which = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            flag = np.concatenate([t for _, t in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.bincount(which, flag, len(key)).astype(np.int64)),
                 pa.array(np.bincount(which, ~flag, len(key)).astype(np.int64))], ["key", "toxic", "clean"])


def terms(sample: DataFrame, most: int = TERMS, support: int = SUPPORT) -> np.ndarray:
    """Sorted keys of the terms that differ most between toxic and clean rows (text, toxic), and of the lexicon."""
    size = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, c = size["t"] or 0, size["n"] - (size["t"] or 0)
    chosen = [key_of(w) for w in LEXICON]
    if t and c:
        found = (sample.select("text", "toxic").mapInArrow(_mine, "key long, toxic long, clean long").groupBy("key")
                 .agg(F.least(F.sum("toxic"), F.lit(t)).alias("a"), F.least(F.sum("clean"), F.lit(c)).alias("b"))
                 .filter(F.col("a") + F.col("b") >= support))
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        gap = a / t - b / c
        share = (a + b + 1) / (t + c + 2)
        z = gap / F.sqrt(share * (1 - share) * (1 / t + 1 / c))
        found = found.withColumn("z", z)
        chosen += [r.key % 2**64 for r in found.orderBy(F.desc("z"), "key").limit(most).collect()]
    return np.unique(np.array(chosen, np.uint64))


def _described(keys: np.ndarray):
    """Arrow function: (id, h, text) -> (id, h, terms, counts, n_words), one row per text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, term, count, n = _counted(batch.column(2), keys)
            ends = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(n)],
                                             ["id", "h", "terms", "counts", "n_words"])

    return run


def _flat(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences in a word) from the columns terms, counts, n_words that start at ``first``."""
    at = np.asarray(batch.column(first).offsets)
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    n = batch.column(first + 2).to_numpy()
    return row, np.asarray(batch.column(first).flatten()), np.asarray(batch.column(first + 1).flatten()) / np.maximum(n[row], 1)


def _dense_bits(row: np.ndarray, term: np.ndarray, rate: np.ndarray, rows: int, width: int) -> np.ndarray:
    """(rows, 2 * width) flags: the term occurs; the term is dense."""
    flags = np.zeros((rows, 2 * width), bool)
    flags[row, term] = True
    dense = rate >= DENSE
    flags[row[dense], width + term[dense]] = True
    return flags


def choose_voters(flags: np.ndarray, toxic: np.ndarray, always: np.ndarray, most: int = VOTERS) -> np.ndarray:
    """Columns of ``flags`` that vote: those in ``always`` and the most telling others, without near duplicates."""
    t, c = toxic.sum(), (~toxic).sum()
    a, b = flags[toxic].sum(0), flags[~toxic].sum(0)
    share = (a + b + 1) / (t + c + 2)
    z = (a / max(t, 1) - b / max(c, 1)) / np.sqrt(share * (1 - share) * (1 / max(t, 1) + 1 / max(c, 1)))
    z[a + b == 0] = 0
    chosen: list[int] = []
    size = flags.sum(0)
    for j in np.argsort(-np.abs(z), kind="stable"):
        if len(chosen) == most or z[j] == 0:
            break
        both = flags[:, chosen][flags[:, j]].sum(0)
        if not len(chosen) or (both < SAME * (size[chosen] + size[j] - both)).all():
            chosen.append(int(j))
    room = [int(j) for j in always if int(j) not in chosen][:max(0, most - len(chosen))]
    return np.array(sorted(chosen + room), np.int64)


@dataclass
class LabelModel:
    """Tree-shaped distribution of votes given the hidden label: class shares, tree and conditional tables."""

    prior: np.ndarray  # P(clean), P(toxic)
    parent: np.ndarray  # -1 for the root
    table: np.ndarray  # [label, voter, parent's vote, vote] log probabilities

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        """Evidence of the votes (rows, voters) for toxic, with the prior."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0).astype(np.int64)
        j = np.arange(votes.shape[1])
        gain = self.table[1] - self.table[0]
        return np.log(self.prior[1] / self.prior[0]) + gain[j, above, votes.astype(np.int64)].sum(1)

    def posterior(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """P(toxic | votes, known label). known: 1, 0, or -1 for none."""
        certain = np.log((1 - LABEL_ERROR) / LABEL_ERROR)
        odds = self.log_odds(votes) + np.where(known < 0, 0, certain * (2 * known - 1))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_tree(pairs: np.ndarray) -> LabelModel:
    """The label model from expected pair counts [label, i, j]; index 0 counts rows, the others votes."""
    k = pairs.shape[1] - 1
    rows = pairs[:, 0, 0] + 2 * SMOOTH
    ones = pairs[:, 0, 1:] + SMOOTH * np.array([0.2, 1.0])[:, None]  # without evidence a vote means toxic
    prior = rows / rows.sum()
    p1 = ones / (rows[:, None] + SMOOTH)
    both = np.clip(pairs[:, 1:, 1:] + SMOOTH * p1[:, :, None] * p1[:, None, :], 0, None) / (rows[:, None, None] + SMOOTH)
    p11 = np.clip(both, 1e-12, np.minimum(p1[:, :, None], p1[:, None, :]) - 1e-12)
    p10, p01 = p1[:, :, None] - p11, p1[:, None, :] - p11
    p00 = np.clip(1 - p11 - p10 - p01, 1e-12, 1)
    information = np.zeros((k, k))
    for y in (0, 1):
        for p, u, v in ((p11, p1, p1), (p10, p1, 1 - p1), (p01, 1 - p1, p1), (p00, 1 - p1, 1 - p1)):
            information += prior[y] * p[y] * np.log(p[y] / np.maximum(u[y][:, None] * v[y][None, :], 1e-300))
    parent = np.full(k, -1)
    if k:
        near, link = information[0].copy(), np.zeros(k, np.int64)
        left = np.ones(k, bool)
        left[0] = False
        for _ in range(k - 1):
            j = int(np.where(left, near, -np.inf).argmax())
            parent[j], left[j] = link[j], False
            closer = information[j] > near
            near, link = np.where(closer, information[j], near), np.where(closer, j, link)
    table = np.zeros((2, k, 2, 2))
    for j in range(k):
        i = parent[j]
        for y in (0, 1):
            given = (p1[y, j], p1[y, j]) if i < 0 else (p01[y, i, j] / (1 - p1[y, i]), p11[y, i, j] / p1[y, i])
            for u in (0, 1):
                p = min(max(given[u], 1e-9), 1 - 1e-9)
                table[y, j, u] = np.log([1 - p, p])
    return LabelModel(prior, parent, table)


def _unpacked(column: pa.Array, k: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(flat, axis=1, count=k).astype(bool)


def _expected(patterns: DataFrame, k: int, share) -> np.ndarray:
    """Expected pair counts [label, i, j] of a table (votes, known, weight); share(votes, known) gives P(toxic)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k + 1, k + 1))
        for batch in batches:
            votes, known = _unpacked(batch.column(0), k), batch.column(1).to_numpy()
            weight, p = batch.column(2).to_numpy(), share(votes, known)
            ones = np.concatenate((np.ones((len(votes), 1)), votes), axis=1)
            for y, w in enumerate((weight * (1 - p), weight * p)):
                total[y] += ones.T @ (ones * w[:, None])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * (k + 1)), pa.int32()),
                                              pa.array(list(total.reshape(-1, k + 1)), pa.list_(pa.float64()))], ["i", "row"])

    cells = (patterns.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
             .groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow())
    out = np.zeros((2 * (k + 1), k + 1))
    out[np.asarray(cells.column("i")), np.asarray(cells.column("j"))] = np.asarray(cells.column("v"))
    return out.reshape(2, k + 1, k + 1)


def fit_label_model(patterns: DataFrame, k: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over (votes, known, weight): votes packed into bytes, known 1, 0 or -1."""
    if k == 0:
        return LabelModel(np.array([1 - _PRIOR, _PRIOR]), np.zeros(0, np.int64), np.zeros((2, 0, 2, 2)))
    kinds = {r.known for r in patterns.select("known").distinct().collect()}
    if {0, 1} <= kinds:
        labelled = patterns.filter("known >= 0")
        model = fit_tree(_expected(labelled, k, lambda votes, known: known.astype(float)))
    else:
        model = fit_tree(_expected(patterns, k, lambda votes, known: np.where(
            known >= 0, known, np.where(votes.any(1), 0.9, _PRIOR / 5)).astype(float)))
    for _ in range(rounds):
        model = fit_tree(_expected(patterns, k, model.posterior))
    return model


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted): one row per row of ``docs``."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    known = stored(labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
                   .groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")), "known")

    # the sample: distinct labelled (id, text) rows, by hash; its bound makes the broadcast bounded
    rows = stored(docs.select("id", "h").join(known, "id").distinct(), "labelled")
    n = rows.count()
    chance = F.pmod(F.xxhash64("id", "h"), F.lit(1 << 20)) < int(min(1.0, sample_rows / max(n, 1)) * (1 << 20))
    chosen = F.broadcast(rows.filter(chance))
    texts = stored(docs.join(chosen, ["id", "h"]).dropDuplicates(["id", "h"]).select("text", "toxic"), "sample")
    keys = terms(texts)
    width = len(keys) + len(_PATTERNS)

    described = stored(docs.mapInArrow(_described(keys), f"id {kind}, h long, terms array<int>, counts array<int>, n_words long"), "described")
    sample = stored(described.join(chosen, ["id", "h"]).dropDuplicates(["id", "h"])
                    .select("terms", "counts", "n_words", "toxic"), "sample-terms")

    voters = _voters(sample, keys)
    k = len(voters)
    votes = (described.filter(~held_out(F.col("id"))).select("id", "terms", "counts", "n_words")
             .mapInArrow(_voting(voters, width), f"id {kind}, votes binary").groupBy("id", "votes").agg(F.count("*").alias("c")))
    patterns = (votes.join(known, "id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("known"))
                .agg(F.sum("c").cast("double").alias("weight")))
    patterns = stored(patterns, "patterns")
    mass = {r.known: r.w for r in patterns.groupBy("known").agg(F.sum("weight").alias("w")).collect()}
    labelled, free = mass.get(0, 0) + mass.get(1, 0), mass.get(-1, 0)
    if labelled and free:
        scale = min(1.0, labelled / free)
        patterns = patterns.withColumn("weight", F.when(F.col("known") < 0, F.col("weight") * scale).otherwise(F.col("weight")))
    model = fit_label_model(patterns, k)

    weights, bias = _classifier(sample, model, voters, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, rate = _flat(batch, 1)
            z = bias + np.bincount(row, weights[term] + weights[width + term] * _density(rate), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["id", "score"])

    scored = described.select("id", "terms", "counts", "n_words").mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _density(rate: np.ndarray) -> np.ndarray:
    return np.log1p(1000 * rate) / np.log(1001)


def _voters(sample: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Voters chosen on the (bounded) sample, of which one bit per term and row goes to the driver."""
    width = len(keys) + len(_PATTERNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, rate = _flat(batch, 0)
            packed = np.packbits(_dense_bits(row, term, rate, batch.num_rows, width), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in packed], pa.binary()), batch.column(3)], ["f", "toxic"])

    got = sample.mapInArrow(run, "f binary, toxic int").toArrow()
    flags = _unpacked(got.column("f").combine_chunks(), 2 * width) if got.num_rows else np.zeros((0, 2 * width), bool)
    lexicon = np.searchsorted(keys, np.unique(np.array([key_of(w) for w in LEXICON], np.uint64)))
    return choose_voters(flags, np.asarray(got.column("toxic")).astype(bool), lexicon)


def _voting(voters: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, rate = _flat(batch, 1)
            packed = np.packbits(_dense_bits(row, term, rate, batch.num_rows, width)[:, voters], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tobytes() for p in packed], pa.binary())], ["id", "votes"])

    return run


def _classifier(sample: DataFrame, model: LabelModel, voters: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the sample's posterior labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, term, rate = _flat(batch, 0)
            x = np.zeros((batch.num_rows, 2 * width))
            x[row, term] = 1
            x[row, width + term] = _density(rate)
            votes = _dense_bits(row, term, rate, batch.num_rows, width)[:, voters]
            p = model.posterior(votes, batch.column(3).to_numpy())
            for y, w in ((1.0, p), (0.0, 1 - p)):
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(np.full(len(w), y)), pa.array(w)],
                                                 ["x", "label", "weight"])

    rows = sample.mapInArrow(run, "x array<double>, label double, weight double").filter("weight > 1e-6")
    rows = stored(rows, "posterior")
    mass = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if min(mass.get(0.0, 0), mass.get(1.0, 0)) < 1e-3:  # nothing to tell apart: the lexicon's terms speak for themselves
        weights = np.zeros(2 * width)
        weights[voters] = model.table[1, :, 0, 1] - model.table[0, :, 0, 1] if len(voters) else 0
        return weights, float(np.log(model.prior[1] / model.prior[0]))
    fitted = LogisticRegression(regParam=RIDGE, maxIter=60, featuresCol="f", labelCol="label", weightCol="weight",
                                standardization=False).fit(rows.select(array_to_vector("x").alias("f"), "label", "weight"))
    return np.array(fitted.coefficients.toArray()), float(fitted.intercept)
