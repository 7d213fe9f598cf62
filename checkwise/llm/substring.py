"""Substring dedup: words covered by a long window that an earlier document also holds.

A window is ``size`` consecutive words. Each window picks its least-hashed
ANCHOR-word gram (its anchor); consecutive windows with one anchor form a run,
so a document yields about one run per five windows, cut by content alone.

1. Anchors are counted (map-side combined): only those found in two documents
   can belong to a shared window.
2. An anchor whose runs are all equal settles them at once: every run but the
   smallest document's is covered.
3. Runs of the other shared anchors are opened into their windows; each window
   (128-bit hash) goes to the smallest document that holds it.

Rows are hashes, so no text is compared pairwise, and a passage that a third of
all documents share is combined before it is shuffled. Joins back to the
documents are plain joins that adaptive execution can split. The text itself is
shuffled once.

Defined cases: null, empty and shorter texts lose nothing; rows with a null id
neither lose words nor count as earlier; rows that repeat an id are one
document to each other, and each is cut on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checkwise.llm.common import ship, stored
from checkwise.llm.words import Words, each_slice, grams

SIZE = 13
ANCHOR = 5


def _windows(w: Words, size: int) -> np.ndarray:
    """Index of the first word of every window (inside one text)."""
    owner = w.owner()
    n = max(0, len(owner) - size + 1)
    return np.flatnonzero(owner[:n] == owner[size - 1:]) if n else np.zeros(0, np.int64)


def runs(w: Words, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, anchor hash, hash of all the run's words) of every run."""
    at = _windows(w, size)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    h = grams(w.hash, anchor, 21)
    choices = size - anchor + 1
    # least hash among the window's grams, and where it is (the first of equals)
    best, place = h[at], at.copy()
    for i in range(1, choices):
        other = h[at + i]
        less = other < best
        best = np.where(less, other, best)
        place = np.where(less, at + i, place)
    fresh = np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(at)))
    # content of the run: a rolling hash over its windows
    each = grams(w.hash, size, 22)[at]
    whole = np.add.reduceat(each * (2 * (np.arange(len(at)) - np.repeat(first, count)).astype(np.uint64)
                                    + np.uint64(0x9E3779B97F4A7C15)), first)
    return at[first], count, best[first], whole


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, size: int, anchor: int, placed: bool) -> DataFrame:
    """(h, id, s) of every run, or (h, id, t, at, n): where it stands in its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, w in each_slice(batch.column(1)):
                at, count, h, s = runs(w, size, anchor)
                if not len(at):
                    continue
                text = np.searchsorted(w.at, at, "right") - 1
                ids = batch.column(0).take(pa.array(lo + text))
                if placed:
                    t = batch.column(2).take(pa.array(lo + text))
                    spot = (at - w.at[text]) << 8 | count
                    yield pa.RecordBatch.from_arrays([_signed(h), ids, t, pa.array(spot)], ["h", "id", "t", "spot"])
                else:
                    yield pa.RecordBatch.from_arrays([_signed(h), ids, _signed(s)], ["h", "id", "s"])

    return docs.mapInArrow(run, "h long, id long, t int, spot long" if placed else "h long, id long, s long")


def _opened(found: DataFrame, size: int) -> DataFrame:
    """(w1, w2, id, t, at): the windows of the contested runs of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_slice(batch.column(2)):
                spots = [x.as_py() for x in batch.column(3).slice(lo, hi - lo)]
                at = [w.at[i] + (s >> 8) + k for i, ss in enumerate(spots) for s in ss for k in range(s & 255)]
                if not at:
                    continue
                at = np.array(at, np.int64)
                text = np.searchsorted(w.at, at, "right") - 1
                rows = pa.array(lo + text)
                yield pa.RecordBatch.from_arrays(
                    [_signed(grams(w.hash, size, 23)[at]), _signed(grams(w.hash, size, 24)[at]),
                     batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - w.at[text])],
                    ["w1", "w2", "id", "t", "at"])

    return found.mapInArrow(run, "w1 long, w2 long, id long, t int, at long")


def cover(docs: DataFrame, id_col: str, text_col: str, size: int = SIZE, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): (id, t, text) and (id, t, spots), a spot being first window << 8 | windows.

    t tells apart the texts of one id.
    """
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.hash(text_col).alias("t"))
    # written first: a join side of its own is what adaptive execution can split when an anchor is hot
    counted = stored(anchors(texts.select("id", "text"), size, anchor, False).groupBy("h")
               .agg(F.min("id").alias("owner"), F.max("id").alias("last"),
                    F.min("s").alias("low"), F.max("s").alias("high"))
               .filter("owner != last")
               .select("h", "owner", F.col("low").eqNullSafe(F.col("high")).alias("equal")), "anchors")
    placed = anchors(texts.select("id", "text", "t"), size, anchor, True)
    hits = stored(placed.join(counted, "h").filter("not equal or id != owner")
                  .groupBy("id", "t").agg(F.collect_list(F.when(F.col("equal"), F.col("spot"))).alias("sure"),
                                          F.collect_list(F.when(~F.col("equal"), F.col("spot"))).alias("open")), "hits")
    return texts, hits


def _texts_with(texts: DataFrame, spans: DataFrame) -> DataFrame:
    return texts.join(spans, ["id", "t"])


def dedup_substrings(docs: DataFrame, make, schema: str, id_col: str = "doc_id", text_col: str = "text",
                     size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """Rows (id_col, *schema) made by ``make(words: Words, keep: mask of words)`` -> Arrow arrays, one row per text."""
    ship(docs.sparkSession)
    texts, hits = cover(docs, id_col, text_col, size, anchor)
    contested = _texts_with(texts, hits.filter(F.size("open") > 0).select("id", "t", "open"))
    windows = _opened(contested.select("id", "t", "text", "open"), size)
    windows = stored(windows, "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("owner"), F.max("id").alias("last")).filter("owner != last")
    extra = (windows.join(least.select("w1", "w2", "owner"), ["w1", "w2"]).filter("id != owner")
             .groupBy("id", "t").agg(F.collect_list(F.shiftleft("at", 8) + 1).alias("more")))
    spans = (hits.select("id", "t", "sure").join(extra, ["id", "t"], "left")
             .select("id", "t", F.concat("sure", F.coalesce("more", F.array().cast("array<bigint>"))).alias("spots")))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text_col).alias("t"), F.col(text_col).alias("text"))
    joined = source.join(spans, ["id", "t"], "left").select("id", "text", "spots")
    names = [id_col, *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in each_slice(batch.column(1)):
                spots = batch.column(2).slice(lo, hi - lo)
                flat = spots.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                each = np.nan_to_num(np.asarray(spots.value_lengths().fill_null(0))).astype(np.int64)
                first = np.repeat(w.at[:-1], each) + (flat >> 8)
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + (flat & 255) - 1 + size, -1)
                keep = np.cumsum(edge[:-1]) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *make(w, keep)], names)

    return joined.mapInArrow(run, f"`{id_col}` long, {schema}")


def kept_texts(w: Words, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    out = []
    for i in range(len(w.at) - 1):
        a, b = int(w.at[i]), int(w.at[i + 1])
        mask = keep[a:b]
        start, end = w.start[a:b][mask], w.end[a:b][mask]
        if not len(start):
            out.append(b"")
            continue
        # bytes of the kept words and one space after each but the last
        body = np.repeat(start - np.concatenate(([0], np.cumsum(end - start + 1)[:-1])), end - start + 1) \
            + np.arange(int((end - start + 1).sum()))
        data = w.data[np.minimum(body, len(w.data) - 1)].copy()
        data[np.cumsum(end - start + 1) - 1] = 32
        out.append(data[:-1].tobytes())
    return out


def _digest(w: Words, keep: np.ndarray) -> list[pa.Array]:
    n = np.diff(w.at)
    kept = np.bincount(w.owner()[keep], minlength=len(n))
    return [pa.array(n), pa.array(n - kept),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept_texts(w, keep)], pa.string())]


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) of every text."""
    return dedup_substrings(docs, _digest, "n_words long, n_removed long, kept_sha256 string", id_col, text_col, **how)


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, kept_text): every text without its covered words."""
    return dedup_substrings(docs, lambda w, keep: [pa.array([x.decode() for x in kept_texts(w, keep)], pa.string())],
                            "kept_text string", id_col, text_col, **how)
