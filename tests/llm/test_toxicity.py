"""Toxicity: counting against a plain reader, the label model against enumeration, held-out accuracy."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from checkwise.llm import toxicity, words
from pyspark.sql import functions as F


def _terms(text):
    """Occurrences of every word, beginning and end of words, as the module counts them."""
    out = {}
    body = re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    tokens = body.split()
    for w in tokens:
        keys = [w.decode(errors="replace")]
        keys += [w[:k] + b"~" for k in (3, 4, 5, 6, 8) if len(w) > k] + [b"~" + w[-k:] for k in (4, 6) if len(w) > k]
        for k in keys:
            k = k if isinstance(k, str) else k.decode(errors="replace")
            out[k] = out.get(k, 0) + 1
    return out, len(tokens)


def test_terms_counted(monkeypatch):
    g = random.Random(1)
    vocabulary = ["Idiot", "idiots", "stupidly", "loser!", "sch***e", "WORTHLESS", "a", "noooo", "l0ser", "été", "x" * 30, "it's"]
    texts = [" ".join(g.choice(vocabulary) for _ in range(g.randrange(0, 40))) for _ in range(40)] + [None, "", " \n", "no"]
    asked = ["idiot", "idio~", "~upid", "wor~", "loser", "été", "worthl~", "~pidly", "xxx~", "it", "s", "stu~"]
    keys = np.array([toxicity.key_of(t) for t in asked], np.uint64)
    assert len(set(keys.tolist())) == len(keys)
    order = np.argsort(keys)
    for size in (words.SLICE_BYTES, 37):
        monkeypatch.setattr(words.slices_at, "__defaults__", (size,))
        row, term, count, n = toxicity._counted(pa.array(texts, pa.string()), keys[order])
        found = {(int(r), int(t)): int(c) for r, t, c in zip(row, term, count, strict=True)}
        for i, text in enumerate(texts):
            want, size_words = _terms(text or "")
            assert n[i] == size_words
            for j, at in enumerate(order):
                assert found.get((i, j), 0) == want.get(asked[at], 0), (text, asked[at])
    patterns = toxicity._counted(pa.array(["WOW you!!! f**k nooooo l0ser A BBB"], pa.string()), keys[order])
    assert {int(t) - len(keys): int(c) for t, c in zip(patterns[1], patterns[2], strict=True) if t >= len(keys)} == {
        0: 3, 1: 2, 2: 1, 3: 1, 4: 1}


def test_label_model_is_a_tree_distribution():
    """Posteriors equal Bayes' rule over the model's own joint distribution, which sums to one."""
    g = np.random.default_rng(4)
    votes = g.random((400, 5)) < 0.3
    p = g.random(400)
    ones = np.concatenate((np.ones((400, 1)), votes), axis=1)
    model = toxicity.fit_tree(np.stack([ones.T @ (ones * w[:, None]) for w in (1 - p, p)]))
    assert sorted(model.parent)[0] == -1 and (model.parent[1:] >= 0).all()
    joint = {}
    for v in itertools.product((0, 1), repeat=5):
        for y in (0, 1):
            joint[v, y] = model.prior[y] * math.exp(sum(
                model.table[y, j, v[model.parent[j]] if model.parent[j] >= 0 else 0, v[j]] for j in range(5)))
    assert abs(sum(joint.values()) - 1) < 1e-9
    for v in itertools.product((0, 1), repeat=5):
        got = model.posterior(np.array([v], bool), np.array([-1]))[0]
        assert abs(got - joint[v, 1] / (joint[v, 0] + joint[v, 1])) < 1e-9


def test_label_model_finds_accuracies_and_correlation(spark):
    """Votes drawn from a known model, labels on a tenth: accuracies come back, and copies of a voter are its children."""
    g = np.random.default_rng(5)
    y = g.random(6000) < 0.2
    hit, noise = [0.7, 0.5, 0.6, 0.4], [0.05, 0.02, 0.1, 0.01]
    votes = np.stack([g.random(6000) < np.where(y, a, b) for a, b in zip(hit, noise, strict=True)], axis=1)
    votes = np.concatenate((votes, votes[:, :1] ^ (g.random((6000, 1)) < 0.02)), axis=1)  # nearly a copy of the first
    known = np.where(g.random(6000) < 0.1, y.astype(int), -1)
    rows = [(bytearray(np.packbits(v).tobytes()), int(k), 1.0) for v, k in zip(votes, known, strict=True)]
    model = toxicity.fit_label_model(spark.createDataFrame(rows, "votes binary, known int, weight double").repartition(4), 5)
    assert abs(model.prior[1] - 0.2) < 0.05
    assert model.parent[4] == 0 or model.parent[0] == 4
    got = model.posterior(votes, np.full(6000, -1)) > 0.5
    bayes = np.log(0.2 / 0.8) + sum(np.where(votes[:, j], math.log(a / b), math.log((1 - a) / (1 - b)))
                                    for j, (a, b) in enumerate(zip(hit, noise, strict=True))) > 0
    assert (got == bayes).mean() > 0.95


def _rows(g, n=700):
    """Toxic texts hold words of two hidden stems in one language, lexicon words in another."""
    plain = ["".join(g.choice("aeiou") + g.choice("lmnrst") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(n):
        toxic, other = g.random() < 0.25, g.random() < 0.5
        text = [g.choice(plain) for _ in range(g.randrange(20, 120))]
        if toxic:
            for _ in range(g.randrange(2, 6)):
                text.insert(g.randrange(len(text)), (g.choice(["zork", "vrekt"]) + g.choice(plain)) if other else g.choice(["idiot", "scum"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def _held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    g = random.Random(6)
    rows = _rows(g)
    table = [(i, t, "s") for i, t, _ in rows] + [(None, "idiot scum idiot", "s"), (9000, None, "s"), (9001, "", "s"), (5, rows[5][1], "s"),
                                                 (9002, "word " * 60_000, "s")]
    docs = spark.createDataFrame(table, "doc_id long, text string, score string").repartition(6)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (3, None, 1), (5, rows[5][2], 1)],
                                   "doc_id long, toxic int, score int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(table)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == _held_out(r.doc_id) for r in got)
    by = {r.doc_id: r for r in got}
    truth = {i: y for i, _, y in rows}
    for fold in (True, False):
        of = [i for i in truth if _held_out(i) == fold]
        assert np.mean([by[i].predicted == truth[i] for i in of]) > 0.97
    assert by[None].predicted == 1 and by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 0
    # labels of held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


@pytest.mark.parametrize("kind", ["none", "one", "empty"])
def test_without_labels(spark, kind):
    """The lexicon alone still tells; an empty table gives no rows."""
    texts = ["a plain text of words", "you idiot and scum", "stupid worthless moron", ""] * 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(0, 40, 4)] if kind == "one" else [], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs.limit(0) if kind == "empty" else docs, labels).collect()}
    assert len(got) == (0 if kind == "empty" else 40)
    if got:
        assert got[2].score > got[0].score and got[1].score > got[3].score


def test_registered(spark, sf_small, registered):
    out = registered["op12_toxicity"](spark, sf_small)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{sf_small}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    assert np.mean([rows[i].predicted == y for i, y in labels.items()]) > 0.85
