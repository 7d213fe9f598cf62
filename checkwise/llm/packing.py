"""Best-fit packing of tokenised documents by a configuration linear program.

1. Documents become pieces of at most SIZE tokens; their length histogram (at
   most SIZE counts) is all that the driver sees.
2. Filling largest-first gives a first plan. Unless it needs no more sequences
   than the tokens themselves (so that no plan can be shorter), the configuration
   LP (fewest sequences whose pieces cover the histogram) is solved by column
   generation, starting from that plan's patterns: the simplex duals price the
   lengths, a knapsack dynamic program finds the best fillings of one sequence,
   and the same duals give a lower bound. It ends when the LP is within TOLERANCE
   of its bound, or after MOST_WORK.
3. Fractional uses are rounded down, then up while pieces last; what is left is
   filled largest-first. The shorter plan counts, a bounded list of patterns.
4. Pieces are numbered within their length (salted, so a hot length is split)
   and looked up in the plan: sequence and offset are arithmetic on the number.

Defined cases: a null text is empty and still yields the end token; rows are
packed one by one, repeated ids and rows too; null ids stay null.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checkwise.llm.bpe import Pieces, shared_file, slice_texts
from checkwise.llm.common import ship, stored

SIZE = 2048
END_ID = 0
#: Relative gap between the sequences and their lower bound at which a plan counts as solved.
TOLERANCE = 0.001
#: Fillings taken from one knapsack table; pivots between two inversions of the basis.
FILLINGS = 64
PIVOTS = 500
#: Entries of the basis that all pivots together may touch: the driver's work is bounded, and any state is a cover.
MOST_WORK = 16 << 30
SALTS = 128
#: Text of one block.
BLOCK_BYTES = 4 << 20
#: Pieces encoded as one string.
JOINED = 2000


def json_solver(path: str):
    """Ids of strings by the tokenizers library, special strings as ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    width = np.zeros(tokenizer.get_vocab_size(), np.int64)  # bytes of each token
    for token, i in tokenizer.get_vocab().items():
        width[i] = len(token)  # byte-level: one character stands for one byte

    def solve(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # strings between single spaces need no encoding of their own: they are joined, and cut by bytes
        counts = np.zeros(len(strings), np.int64)
        spaced = np.array([s[:1] == " " and s[1:2].strip() != "" and s[-1:].strip() != "" for s in strings], bool)
        alone = [s for s, x in zip(strings, spaced.tolist(), strict=True) if not x]
        chain = [s for s, x in zip(strings, spaced.tolist(), strict=True) if x]
        own = [e.ids for e in tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        counts[~spaced] = [len(x) for x in own]
        joined, cuts = [], []
        for lo in range(0, len(chain), JOINED):
            some = chain[lo:lo + JOINED]
            ids = np.array(tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            end = np.cumsum([len(s.encode()) for s in some])
            cuts.append(np.diff(np.searchsorted(np.cumsum(width[ids]), end, "left") + 1, prepend=0))
            joined.append(ids)
        counts[spaced] = np.concatenate(cuts) if cuts else 0
        out = np.empty(int(counts.sum()), np.int64)
        place = np.repeat(spaced, counts)
        out[place] = np.concatenate(joined) if joined else 0
        out[~place] = [i for x in own for i in x]
        return out, counts

    return solve


#: Texts of these characters only (and not longer) are encoded from the ranks alone: there, both libraries cut words alike.
_PLAIN = re.compile("[\n\t -~\u00c0-\u00ff]*")
PLAIN_CHARS = 200_000


def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE in a tokenizers file (ids rise with the merges' order), without special tokens."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in content.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}


class Encoder:
    """Ids of texts (little-endian 32-bit bytes): plain texts from the ranks, all others by the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.plain = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_level_ranks(path),
                                       special_tokens={})
        self.other = Pieces(json_solver(path))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if len(t) <= PLAIN_CHARS and _PLAIN.fullmatch(t):
                yield np.array(self.plain.encode_ordinary(t), "<u4").tobytes()
            else:
                yield next(iter(self.other.encode([t])))


_ENCODERS: dict[str, Encoder] = {}


def kept_encoder(name: str, path: str) -> Encoder:
    """The worker's encoder of a vocabulary, kept from task to task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(path)
    return _ENCODERS[name]


def pieces_of(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each document's ids and END_ID, cut to at most ``size``.

    A longer document's first piece takes the remainder, the others are full.
    """
    ship(docs.sparkSession)
    name = shared_file(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept_encoder(name, SparkFiles.get(name))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo, hi, texts in slice_texts(batch.column(1), BLOCK_BYTES):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(table.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                    for p in range(len(cuts) - 1):
                        row.append(lo + i)
                        piece.append(p)
                        start.append(cuts[p])
                        length.append(cuts[p + 1] - cuts[p])
                        crc.append(zlib.crc32(ids[4 * cuts[p]:4 * cuts[p + 1]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    [id_col, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def _knapsack(lengths: np.ndarray, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(highest price, length taken last or -1) for each room up to ``size``; lengths ascend."""
    value = np.zeros(size + 1)
    last = np.full(size + 1, -1)
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        n = fits[c]
        value[c] = value[c - 1]
        if n:
            got = value[c - lengths[:n]] + price[:n]
            best = int(got.argmax())
            if got[best] > value[c] + 1e-15:
                value[c], last[c] = got[best], lengths[best]
    return value, last


def _filling(last: np.ndarray, room: int) -> dict[int, int]:
    filling: dict[int, int] = {}
    while room > 0:
        length = int(last[room])
        if length < 0:
            room -= 1
            continue
        filling[length] = filling.get(length, 0) + 1
        room -= length
    return filling


def best_filling(lengths: np.ndarray, price: np.ndarray, size: int) -> dict[int, int]:
    """Knapsack dynamic program: the multiset of lengths within ``size`` of the highest price."""
    order = np.argsort(lengths)
    return _filling(_knapsack(lengths[order], price[order], size)[1], size)


def solve_lp(counts: dict[int, int], size: int, start: list[dict[int, int]],
             tolerance: float = TOLERANCE) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(uses of configurations that together cover every length, lower bound of any plan's sequences)."""
    lengths = np.array(sorted(counts), np.int64)
    m = len(lengths)
    if not m:
        return [], 0.0
    need = np.array([counts[x] for x in lengths.tolist()], float)
    # slightly unequal needs keep the simplex method from pivoting in place
    aim = need * (1 + 1e-7 * np.random.Generator(np.random.PCG64(8)).random(m))
    at = {int(x): i for i, x in enumerate(lengths)}
    fillings = [{x: size // x} for x in lengths.tolist()]
    columns = [(np.array([i]), np.array([float(size // x)])) for i, x in enumerate(lengths.tolist())]
    rows, per, first = [np.arange(m)], [np.array([k[0] for _, k in columns])], list(range(m))
    entries = m

    def add(filling: dict[int, int]) -> None:
        nonlocal entries
        column = np.array([at[x] for x in filling]), np.array(list(filling.values()), float)
        fillings.append(filling)
        columns.append(column)
        first.append(entries)
        rows.append(column[0])
        per.append(column[1])
        entries += len(column[0])

    for filling in start:
        add(filling)
    basis = np.arange(m)  # columns in use; -1 - i is the surplus of length i
    inverse = np.diag(1 / per[0])
    uses = inverse @ aim
    bound, pivots, pool = float((lengths * need).sum()) / size, 0, None
    dual = inverse.sum(axis=0)
    while True:
        if pool is None:
            dual = (basis >= 0).astype(float) @ inverse
            pool = np.concatenate(rows), np.concatenate(per), np.array(first)
        worth = np.add.reduceat(dual[pool[0]] * pool[1], pool[2])
        enter, low = int(worth.argmax()), int(dual.argmin())
        if max(worth[enter] - 1, -dual[low]) <= 1e-9:
            price = np.maximum(dual, 0)
            value, last = _knapsack(lengths, price, size)
            bound = max(bound, float(need @ price) / max(value[size], 1.0))
            if uses[basis >= 0].sum() <= bound * (1 + tolerance) or value[size] <= 1 + 1e-7:
                break
            # the best filling with each length, the most valuable first
            best = price + value[size - lengths]
            found = {}
            for i in np.argsort(-best, kind="stable")[:FILLINGS].tolist():
                if best[i] > 1 + 1e-7:
                    filling = _filling(last, size - int(lengths[i]))
                    filling[int(lengths[i])] = filling.get(int(lengths[i]), 0) + 1
                    found[tuple(sorted(filling.items()))] = filling
            for filling in found.values():
                add(filling)
            pool = None
            continue
        gain = max(worth[enter] - 1, -dual[low])
        if worth[enter] - 1 == gain:
            step = inverse[:, columns[enter][0]] @ columns[enter][1]
        else:
            enter, step = -1 - low, -inverse[:, low]
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[out] = enter
        pivots += 1
        if pivots * m * m > MOST_WORK:
            amount = ratio[out]
            uses -= amount * step
            uses[out] = amount
            np.maximum(uses, 0, out=uses)
            break
        if pivots % PIVOTS:
            amount = ratio[out]
            uses -= amount * step
            uses[out] = amount
            inverse[out] /= step[out]
            step[out] = 0
            moved = np.flatnonzero(np.abs(step) > 1e-13)
            if 2 * len(moved) < m:
                inverse[moved] -= step[moved, None] * inverse[out]
            else:
                inverse -= step[:, None] * inverse[out]
            dual -= gain * inverse[out]
        else:
            matrix = np.zeros((m, m))
            for j, k in enumerate(basis.tolist()):
                if k >= 0:
                    matrix[columns[k][0], j] = columns[k][1]
                else:
                    matrix[-1 - k, j] = -1
            inverse = np.linalg.inv(matrix)
            uses, dual = inverse @ aim, (basis >= 0).astype(float) @ inverse
        np.maximum(uses, 0, out=uses)
    return [(fillings[k], float(x)) for k, x in zip(basis.tolist(), uses.tolist(), strict=True) if k >= 0], bound


def fill(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that use up ``left`` largest-first."""
    left = {x: n for x, n in left.items() if n > 0}
    out = []
    order = sorted(left, reverse=True)
    while order:
        room, pattern = size, {}
        for x in order:
            k = min(room // x, left[x])
            if k:
                pattern[x] = k
                room -= k * x
                if not room:
                    break
        times = min(left[x] // k for x, k in pattern.items())
        out.append((pattern, times))
        for x, k in pattern.items():
            left[x] -= k * times
        order = [x for x in order if left[x] > 0]
    return out


def sequences(patterns: list[tuple[dict[int, int], int]]) -> int:
    return sum(times for _, times in patterns)


def plan(counts: dict[int, int], size: int = SIZE, tolerance: float = TOLERANCE) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): patterns of lengths with multiplicities that use up the histogram exactly."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    plain = fill(left, size)
    if sequences(plain) == math.ceil(sum(x * n for x, n in left.items()) / size):
        return plain  # no plan can be shorter
    uses, _ = solve_lp(left, size, [p for p, _ in plain], tolerance)
    out = []
    for up in (False, True):
        for filling, use in sorted(uses, key=lambda x: -(x[1] % 1 if up else x[1])):
            times = min([1 if up and use % 1 > 0.5 else 0 if up else int(use), *(left[x] // k for x, k in filling.items())])
            if times > 0:
                out.append((filling, times))
                for x, k in filling.items():
                    left[x] -= k * times
    out += fill(left, size)
    return min(out, plain, key=sequences)


def layout(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows (first number, first sequence, pieces a sequence, first offset), by first number."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x, k in sorted(pattern.items(), reverse=True):
            rows.setdefault(x, []).append((used.get(x, 0), sequence, k, offset))
            used[x] = used.get(x, 0) + k * times
            offset += x * k
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def numbered(items: DataFrame, id_col: str) -> DataFrame:
    """``items`` with ``number``: 0.. within each length, by salted row numbers and a sum over salts."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(SALTS)))
    sums = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
            .select("length", "salt", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("base")))
    inside = W.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    return (salted.withColumn("place", F.row_number().over(inside) - 1).join(base, ["length", "salt"])
            .withColumn("number", F.col("base") + F.col("place")).drop("salt", "place", "base"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SIZE) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    items = stored(pieces_of(docs, vocabulary, id_col, text_col, size), "pieces")
    counts = {r.length: r.n for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= size rows
    table = spark.sparkContext.broadcast(layout(plan(counts, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            number = batch.column(names.index("number")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                own = np.flatnonzero(length == x)
                rows = table.value[x]
                row = rows[np.searchsorted(rows[:, 0], number[own], "right") - 1]
                k = number[own] - row[:, 0]
                sequence[own] = row[:, 1] + k // row[:, 2]
                offset[own] = row[:, 3] + k % row[:, 2] * x
            kept = [batch.column(i) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)],
                                             [*names[:-1], "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    ordered = numbered(items, id_col).select(id_col, "piece", "start", "length", "ids_crc32", "number")
    names = ordered.columns
    return ordered.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")
