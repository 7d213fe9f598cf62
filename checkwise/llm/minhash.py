"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of hashed five-word shingles (a fixed number of
   counters, summed over all documents) give the weights tf * idf.
2. Improved consistent weighted sampling draws BANDS * ROWS samples per
   document; equal samples of a band put documents into one bucket. Texts with
   the same words share one representative first.
3. In each bucket the smallest representative is the hub, and every other one
   is checked against it by the exact weighted Jaccard similarity. Then a few
   members of a bucket's largest class and, after them, all members outside it
   become hubs in growing rounds, until every two members of a bucket are in
   one class or have been compared: no link is lost, and copies are never
   expanded into their pairs.
4. Classes are the connected components of the links.

Defined cases: a text of fewer than five words is one shingle; a text without
words (null, empty, blank) and a row with a null id is alone, its class is its
own id; rows that repeat an id are one document (the text of the smallest hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkwise.llm import graph
from checkwise.llm.common import ship, stored
from checkwise.llm.words import Words, each_slice, grams, mix, slices, text_buffer

WORDS = 5
THRESHOLD = 0.8
BANDS = 12
ROWS = 4
#: Counters for document frequencies. Shingles share a counter by hash, which only
#: shifts the weights of rare shingles alike; frequent ones stand out.
COUNTERS = 1 << 18
#: How much more a shingle of one document weighs than one that all documents hold.
IDF_GAIN = 0.2
#: Longs of the bit set that stands for a text's shingles when it is bounded which texts can be alike.
LONGS = 16
#: Further hubs of a bucket in the first round after the smallest member's; each round takes as many times more.
HUBS = 32
_TABLE = 1 << 16


def shingles(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, term frequency) of the distinct shingles of each text, in text order."""
    count = np.diff(w.at)
    long_enough = count >= n
    h = grams(w.hash, n)
    owner = w.owner()
    room = np.minimum(np.arange(len(w.hash)) + n, len(w.hash)) <= np.repeat(w.at[1:], count)
    room[max(0, len(w.hash) - n + 1):] = False
    at = np.flatnonzero(room)
    owners, hashes = owner[at], h[at]
    short = np.flatnonzero(~long_enough & (count > 0))
    if len(short):
        whole = np.array([int(mix(np.bitwise_xor.accumulate(mix(w.hash[w.at[i]:w.at[i + 1]]
                                  + np.arange(count[i], dtype=np.uint64)))[-1:], 77)[0]) for i in short], np.uint64)
        owners, hashes = np.concatenate((owners, short)), np.concatenate((hashes, whole))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    if not len(hashes):
        return owners, hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1]))))
    return owners[first], hashes[first], np.diff(np.append(first, len(hashes)))


def document_frequency(docs: DataFrame, text_col: str, n: int = WORDS) -> tuple[np.ndarray, int]:
    """Counts of documents per hashed shingle, over all documents, and the number of documents with words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for _, _, w in each_slice(batch.column(0)):
                _, h, _ = shingles(w, n)
                df += np.bincount((h % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                total += int((np.diff(w.at) > 0).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))],
                                         ["slot", "n"])

    rows = (docs.select(text_col).mapInArrow(count, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")))
    df = np.zeros(COUNTERS, np.int64)
    total = 0
    for part in rows.toLocalIterator():  # at most COUNTERS + 1 rows
        if part.slot < 0:
            total = part.n
        else:
            df[part.slot] = part.n
    return df, total


def idf(df: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequency per counter, damped to 1 .. 1 + IDF_GAIN.

    Undamped, the few words in which a copy differs (rare shingles) would outweigh
    the text that a large group shares (frequent shingles), and break the group up.
    """
    return (1.0 + IDF_GAIN * np.log((1.0 + total) / (1.0 + df)) / np.log(2.0 + total)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with tabulated random variables.

    For sample k and feature x: r, c ~ Gamma(2, 1), b ~ Uniform(0, 1), all
    picked from fixed tables by a hash of (k, x). With t = floor(ln S / r + b)
    the sample is the feature with the least ln c - r * (t - b + 1), and its t.
    """

    def __init__(self, samples: int):
        g = np.random.Generator(np.random.PCG64(7))
        self.samples = samples
        self.r = g.gamma(2.0, 1.0, _TABLE).astype(np.float32) + np.float32(1e-6)
        self.inverse = 1 / self.r
        self.log_c = np.log(g.gamma(2.0, 1.0, _TABLE) + 1e-12).astype(np.float32)
        self.b = g.random(_TABLE, np.float32)
        self.odd = g.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, owner: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """(texts, samples) 64-bit samples; rows of texts without features are zero."""
        out = np.zeros((texts, self.samples), np.uint64)
        if not len(h):
            return out
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(first, len(h)))
        log_w = np.log(weight).astype(np.float32)
        for k in range(self.samples):
            x = h * self.odd[k]  # multiply-shift: the high bits are the hash
            i = (x >> np.uint64(48)).astype(np.int64)
            j = ((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
            b = self.b[((x >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.int64)]
            t = np.floor(log_w * self.inverse[i] + b)
            value = self.log_c[j] - self.r[i] * (t - b + 1)
            least = np.minimum.reduceat(value, first)
            at = np.flatnonzero(value == np.repeat(least, size))
            _, pick = np.unique(owner[at], return_index=True)  # ties: the smallest feature
            at = at[pick]
            out[owner[at], k] = mix(h[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def bands_of(samples: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` samples."""
    out = np.zeros((len(samples), samples.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        for k in range(rows):
            out[:, b] = mix(out[:, b] * np.uint64(31) + samples[:, b * rows + k])
    return out


_BITS = [f"b{i}" for i in range(LONGS)]
SKETCH = f"struct<total:double,{','.join(f'{b}:bigint' for b in _BITS)}>"


def _sketch(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, some: np.ndarray, texts: int) -> pa.Array:
    """Sum of weights of each text, and a set of 64 * LONGS bits with the bit of each of its shingles."""
    total = np.bincount(owner, weight, texts)[some]
    bits = np.zeros((texts, LONGS), np.uint64)
    place = mix(h, 5)
    np.bitwise_or.at(bits, (owner, (place % np.uint64(LONGS)).astype(np.int64)), np.uint64(1) << (place >> np.uint64(58)))
    words = np.ascontiguousarray(bits[some].T).view(np.int64)
    return pa.StructArray.from_arrays([pa.array(total), *(pa.array(x) for x in words)], ["total", *_BITS])


def signatures(docs: DataFrame, id_col: str, text_col: str, weights, n: int = WORDS, bands: int = BANDS,
               rows: int = ROWS) -> DataFrame:
    """(id, x, k1, k2, w, bands): hash of the text, 128-bit hash of its words, sketch, band hashes.

    Texts without words are left out.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, idf_of = Sampler(bands * rows), weights.value
        for batch in batches:
            for lo, hi, w in each_slice(batch.column(1)):
                owner, h, tf = shingles(w, n)
                if not len(owner):
                    continue
                s = np.zeros((hi - lo, bands), np.uint64)
                slot = (h % np.uint64(COUNTERS)).astype(np.int64)
                weight = tf * idf_of[slot]
                some = np.flatnonzero(np.diff(w.at))
                s = bands_of(sampler.draw(owner, h, weight, hi - lo), rows)[some]
                place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.at[:-1], np.diff(w.at)).astype(np.uint64)
                k = [np.add.reduceat(mix(w.hash + mix(place, salt), salt), w.at[:-1][some]) for salt in (11, 12)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo).take(pa.array(some)) for i in (0, 2)),
                     *(pa.array(x.view(np.int64)) for x in k),
                     _sketch(owner, h, weight, some, hi - lo),
                     pa.FixedSizeListArray.from_arrays(pa.array(s.reshape(-1).view(np.int64)), bands)
                     .cast(pa.list_(pa.int64()))], ["id", "x", "k1", "k2", "w", "bands"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(text_col).alias("x"))
            .mapInArrow(sign, f"id long, x long, k1 long, k2 long, w {SKETCH}, bands array<long>"))


def similarities(texts: list[str], pairs: np.ndarray, idf_of: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the TF-IDF shingles of each pair (two columns of text indices)."""
    hashes, weights = [], []
    for lo, hi, w in each_slice(pa.array(texts, pa.string())):
        owner, h, tf = shingles(w, n)
        weight = tf * idf_of[(h % np.uint64(COUNTERS)).astype(np.int64)].astype(np.float64)
        at = np.searchsorted(owner, np.arange(hi - lo + 1))
        hashes += [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        weights += [weight[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    total = np.array([x.sum() for x in weights])
    out = np.zeros(len(pairs))
    for i, (a, b) in enumerate(pairs.tolist()):
        if len(hashes[a]) and len(hashes[b]):
            at = np.minimum(np.searchsorted(hashes[b], hashes[a]), len(hashes[b]) - 1)
            same = hashes[b][at] == hashes[a]
            common = np.minimum(weights[a][same], weights[b][at[same]]).sum()
            out[i] = common / (total[a] + total[b] - common)
    return out


#: Text that is compared in one go.
_VERIFY_BYTES = 4 << 20


def verify(pairs: DataFrame, texts: DataFrame, weights, threshold: float, n: int = WORDS) -> DataFrame:
    """Those of the pairs (a, b) whose texts' similarity reaches the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(text_buffer(batch.column(i))[0] for i in (2, 3))
            for lo, hi in slices(size, _VERIFY_BYTES):
                part = batch.slice(lo, hi - lo)
                number: dict[int, int] = {}
                texts = []
                for ids, column in ((part.column(0), part.column(2)), (part.column(1), part.column(3))):
                    for i, x in enumerate(ids.to_pylist()):
                        if x not in number:
                            number[x] = len(texts)
                            texts.append(column[i].as_py() or "")
                at = np.array([[number[x] for x in part.column(k).to_pylist()] for k in (0, 1)], np.int64).T
                mask = pa.array(similarities(texts, at, weights.value, n) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(check, "a long, b long"))


def _alike(a, b, threshold: float, least: float):
    """Whether two texts can reach the similarity at all, by an exact bound.

    A bit that one text has and the other lacks stands for a shingle, of the weight
    ``least`` or more, that they don't share. So what they share is at most each
    one's sum of weights without its own such bits; alike texts share at least
    threshold / (1 + threshold) of both sums together.
    """
    needed = (a["total"] + b["total"]) * (threshold / (1 + threshold) - 1e-6)

    def enough(x, y):
        alone = sum((F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))) for k in _BITS), F.lit(0))
        return x["total"] - alone * F.lit(least) >= needed

    return (F.least(a["total"], b["total"]) >= needed) & enough(a, b) & enough(b, a)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS,
                 threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, rep, class_id): for each id its copies' representative and its near-duplicate class.

    Both are smallest ids: of the rows with the same words, and of the class.
    """
    spark = docs.sparkSession
    ship(spark)
    df, total = document_frequency(docs, text_col, n)
    idf_of = idf(df, total)
    weights, least = spark.sparkContext.broadcast(idf_of), float(idf_of.min())
    signed = stored(signatures(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, weights, n, bands, rows),
                    "signatures")
    one = signed.groupBy("id").agg(F.min(F.struct("x", "k1", "k2", "bands")).alias("s")).select("id", "s.*")
    reps = one.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    member = stored(one.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep"), "members")
    in_bucket = stored(reps.select("rep", F.posexplode("bands").alias("band", "h")), "buckets")
    # buckets of one member settle nothing
    shared = (in_bucket.groupBy("band", "h").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"))
              .filter("hub != top").select("band", "h", "hub"))
    open_ = stored(in_bucket.join(shared, ["band", "h"]), "open")
    wanted = stored(open_.select(F.col("rep").alias("id")).distinct(), "wanted")
    # sketches of texts in shared buckets, joined only to the few rows that need them; merged, as at any large size
    sketch = stored(signed.select("id", "x", "w").join(wanted.hint("merge"), "id", "left_semi")
                    .groupBy(F.col("id").alias("rep")).agg(F.min(F.struct("x", "w")).alias("s"))
                    .select("rep", "s.w"), "sketches")
    hub_sketch = sketch.select(F.col("rep").alias("hub"), F.col("w").alias("hub_w"))
    pairs = (open_.filter("rep != hub").select("rep", "hub").distinct().join(sketch, "rep").join(hub_sketch, "hub")
             .filter(_alike(F.col("w"), F.col("hub_w"), threshold, least))
             .select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    texts = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
                   .join(wanted.hint("merge"), "id", "left_semi")
                   .groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("s")).select("id", "s.text"),
                   "texts")
    links = stored(verify(pairs, texts, weights, threshold, n), "verified")
    tried = stored(open_.select("band", "h", F.col("hub").alias("rep")).distinct(), "tried")
    open_ = open_.select("band", "h", "rep")
    turns, hubs_at_once = 0, HUBS
    label = graph.components(links)
    while True:
        fresh = (open_.join(tried, ["band", "h", "rep"], "left_anti")
                 .join(label, F.col("rep") == label.node, "left")
                 .select("band", "h", "rep", F.coalesce("component", "rep").alias("c")))
        # first a few members of the largest class meet the others, most of which find their class; then all
        # members outside it become hubs, some at a time, so that in the end every two have met
        largest = (fresh.groupBy("band", "h", "c").agg(F.count("*").alias("n")).groupBy("band", "h")
                   .agg(F.max(F.struct("n", "c")).alias("x"), F.count("*").alias("classes"))
                   .filter("classes > 1").select("band", "h", F.col("x.c").alias("largest")))
        fresh = stored(fresh.join(largest, ["band", "h"]).join(sketch, "rep"), "fresh")
        turn = W.partitionBy("band", "h").orderBy("rep")
        hubs = stored(fresh.filter("c != largest" if turns else "c = largest")
                      .withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= hubs_at_once)
                      .select("band", "h", F.col("rep").alias("hub"), F.col("w").alias("hub_w"),
                              F.col("c").alias("hub_c")), "hubs")
        if hubs.isEmpty():
            break
        more = (fresh.join(hubs, ["band", "h"]).filter("c != hub_c")
                .filter(_alike(F.col("w"), F.col("hub_w"), threshold, least))
                .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct())
        found = stored(verify(more, texts, weights, threshold, n), "verified")
        tried = tried.unionByName(hubs.select("band", "h", F.col("hub").alias("rep")))
        turns, hubs_at_once = turns + 1, hubs_at_once * HUBS
        if not found.isEmpty():
            links = links.unionByName(found)
            label = graph.components(links)
    return (member.join(label, member.rep == label.node, "left")
            .select("id", "rep", F.coalesce("component", "rep").alias("class_id")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per distinct id of ``docs``: (id_col, rep, class_id); ids without words stand alone."""
    found = near_classes(docs, id_col, text_col, **how)
    ids = docs.select(F.col(id_col).cast("long").alias("id")).distinct()
    # a null id matches nothing and keeps null columns
    return (ids.join(found, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("rep"),
                    F.coalesce("class_id", "id").alias("class_id")))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document (the smallest id) of each class; rows with a null id stay."""
    found = near_classes(docs, id_col, text_col, **how)
    gone = found.filter("id != class_id").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
