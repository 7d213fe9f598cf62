"""Records of text files whose separators also occur inside records, read by many tasks.

A CSV record ends at a line feed outside quotes; an element of a JSON array ends
at a comma outside strings at the array's own depth. Spark's text reader cuts a
file at every separator byte into *pieces* and deals them out by byte ranges
(splits). Whether a separator ends a record depends on all that stands before
it, so each piece is described as a map over the two states it can start in (0
outside quotes, 1 inside): the state at its end, and how much deeper it nests.
Maps compose, whatever comes before:

1. each split's maps are computed on the bytes in its task and composed in order
   into one row (a task sees its pieces in file order),
2. the rows of a file, one per split, are composed by a window (a prefix scan of
   maps), which gives every split's true starting state, depth and record number,
3. the pieces are read again with that start and joined into records. Only
   records that reach over a split's edge, at most two fragments per split, are
   put together in a shuffle.

No text is shuffled otherwise and no task reads more than its splits, so one
large file is as parallel as many small ones. A record itself must fit in memory.

A JSON array is dealt out by opening braces instead of commas, a record or so
to a piece, and its elements are cut out of the bytes of many pieces at once.
Splits then start inside elements, so each one's first and last text is a
fragment. An array without objects has no braces: its file is read by one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checkwise.operators.sizing import MAX_BYTES, byte_size
from checkwise.session import work_dir


@dataclass(frozen=True)
class Format:
    """How a file is cut: the separator of its pieces, the depth at which records stand, the map columns of a piece
    (e0, e1: state at the end when starting outside / inside; d0, d1: change of depth), and the function that tasks compute
    the same maps with: (file, block, value) rows -> (file, block, e0, e1, d0, d1) rows, one per piece or stretch of pieces."""

    separator: str
    level: int
    maps: tuple[Column, Column, Column, Column]
    mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _csv_map(start: int) -> Column:
    """The state after a line of CSV that starts at a field's start (0) or inside quotes (2): 1 inside quotes, else 0.

    Runs over the text between quotes. States: 0 at a field's start, 1 in an unquoted field, 2 inside quotes,
    3 behind a quote inside quotes (a second one is a literal quote, anything else ends the quoting)."""
    def text(state: Column, t: Column) -> Column:
        return F.when((t == "") | (state == 2), state).when(t.endswith(","), 0).otherwise(1)

    def quote(state: Column) -> Column:
        return F.when((state == 0) | (state == 3), 2).when(state == 2, 3).otherwise(1)

    parts = F.split("value", '"')
    state = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), text(F.lit(start), parts[0]),
                        lambda s, t: text(quote(s), t))
    return F.when(F.instr("value", '"') == 0, int(start == 2)).otherwise((state == 2).cast("int")).cast("int")


def csv_format() -> Format:
    zero = F.lit(0).cast("int")
    return Format("\n", 0, (_csv_map(0), _csv_map(2), zero, zero), _csv_mapped)


# --- in-task scans --------------------------------------------------------------


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, UTF-8 bytes) of a string column without nulls."""
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return at - at[0], data[at[0]:at[-1]]


def _csv_end(line: bytes, state: int) -> int:
    """``_csv_map`` of one line: whether it ends inside quotes."""
    first, *parts = line.split(b'"')

    def text(state: int, t: bytes) -> int:
        return state if not t or state == 2 else 0 if t.endswith(b",") else 1

    state = text(state, first)
    for t in parts:
        state = text(2 if state in (0, 3) else 3 if state == 2 else 1, t)
    return int(state == 2)


def csv_ends(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The maps (e0, e1) of lines of CSV, on their bytes.

    Quotes take turns opening and closing, as long as each one that opens stands at the line's start, behind a comma or
    right behind the one before. Only lines with another quote (text in a field without quotes) are walked one by one."""
    at, data = _bytes(values)
    quote = np.flatnonzero(data == ord('"'))
    before = np.searchsorted(quote, at)
    odd = (np.diff(before) & 1).astype(np.int32)
    ends = odd, 1 - odd
    if len(quote):
        line = np.searchsorted(at, quote, "right") - 1
        place = np.arange(len(quote)) - before[line]
        behind = data[quote - 1]
        literal = (quote != at[line]) & (behind != ord(",")) & (behind != ord('"'))
        for s in (0, 1):
            for i in np.unique(line[literal & ((place + s) % 2 == 0)]).tolist():
                ends[s][i] = _csv_end(data[at[i]:at[i + 1]].tobytes(), 2 * s)
    return ends


def _csv_mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e0, e1 = csv_ends(batch.column(2))
        zero = pa.array(np.zeros(len(e0), np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(e0), pa.array(e1), zero, zero], _MAPPED)


_MAPPED = ["file_path", "block_start", "e0", "e1", "d0", "d1"]
_QUOTE, _OPEN, _CLOSE, _COMMA, _SPACE = range(1, 6)
_MARK = np.zeros(256, np.uint8)
for _kind, _chars in ((_QUOTE, b'"'), (_OPEN, b"[{"), (_CLOSE, b"]}"), (_COMMA, b","), (_SPACE, b" \t\n\x0b\f\r")):
    _MARK[list(_chars)] = _kind
_STEP = np.array([0, 0, 1, -1, 0, 0], np.int64)
#: What stands before and behind a JSON array's elements.
_ARRAY_LEVEL = 1


def _json_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, kinds) of the quotes, brackets, commas and white space of JSON text, escaped ones left out."""
    kind = _MARK[data]
    place = np.flatnonzero(kind)
    back = np.flatnonzero(data == ord("\\"))
    if len(back):
        edge = np.flatnonzero(np.diff(back) != 1)
        first, last = back[np.concatenate(([0], edge + 1))], back[np.concatenate((edge, [len(back) - 1]))]
        escaped = np.zeros(len(data) + 1, bool)
        escaped[last[(last - first) % 2 == 0] + 1] = True
        place = place[~escaped[place]]
    return place, kind[place]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, pa.RecordBatch]]:
    """(file, block, bytes, rows) for stretches of pieces of one split, each piece with the brace that stands before it."""
    key = None
    for batch in batches:
        for file, block, rows in _runs(batch):
            data = _bytes(rows.column(2))[1]
            if key != (file, block) and block == 0:
                data = data[1:]  # no brace stands before a file's first piece
            key = file, block
            yield file, block, data, rows


def _json_mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, block, data, _ in _stretches(batches):
        _, kind = _json_marks(data)
        inside, step = np.cumsum(kind == _QUOTE) & 1, _STEP[kind]
        odd = int(inside[-1]) if len(inside) else 0
        row = [file, block, odd, 1 - odd, int(step[inside == 0].sum()), int(step[inside == 1].sum())]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], _MAPPED)


def _json_elements(fragments: bool):
    """Arrow function: pieces with their split's start -> the elements that lie in one split (without white space outside
    strings), or the fragments at the splits' edges."""
    def text(parts: list[np.ndarray]) -> pa.Array:
        return pa.array([np.concatenate(parts).tobytes()], pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, seq = None, True, 0
        state, depth = 0, 0
        held: list[np.ndarray] = []  # the element that is not finished yet

        def fragment(end: bool) -> pa.RecordBatch:
            row = [pa.array([x], t) for x, t in zip([*key, seq, 0], [pa.string(), *[pa.int64()] * 3], strict=True)]
            return pa.RecordBatch.from_arrays([*row, text(held), pa.array([start]), pa.array([end])], schema=_RECORD)

        for file, block, data, rows in _stretches(batches):
            if key != (file, block):
                if key is not None and fragments:
                    yield fragment(True)
                key, start, seq, held = (file, block), True, 0, []
                state, depth = (rows.column(i)[0].as_py() for i in (3, 4))
            place, kind = _json_marks(data)
            inside = (state + np.cumsum(kind == _QUOTE)) & 1
            deep = depth + np.cumsum(np.where(inside == 0, _STEP[kind], 0))
            if len(place):
                state, depth = int(inside[-1]), int(deep[-1])
            ends = (kind == _COMMA) & (inside == 0) & (deep == _ARRAY_LEVEL)
            gone = place[ends | ((kind == _SPACE) & (inside == 0))]
            left = np.ones(len(data), bool)
            left[gone] = False
            data, ends = data[left], place[ends] - np.searchsorted(gone, place[ends])
            if not len(ends):
                held.append(data)
                continue
            held.append(data[:ends[0]])
            if fragments and start:
                yield fragment(False)
            elif not fragments:
                if not start:
                    yield pa.RecordBatch.from_arrays([text(held)], ["value"])
                if len(ends) > 1:
                    offsets, body = (ends - ends[0]).astype(np.int32), np.ascontiguousarray(data[ends[0]:ends[-1]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(offsets), pa.py_buffer(body))], ["value"])
            start, seq, held = False, seq + len(ends), [data[ends[-1]:]]
        if key is not None and fragments:
            yield fragment(True)

    return run


def starts(e0: np.ndarray, e1: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """The state before each piece, and after the last, from the pieces' maps and the state before the first."""
    constant, swap = e0 == e1, (e0 == 1) & (e1 == 0)
    flips = np.concatenate(([0], np.cumsum(swap)))
    at = np.concatenate(([-1], np.where(constant, np.arange(len(e0)), -1)))
    last = np.maximum.accumulate(at)  # the last piece with a constant map before each place
    base = np.where(last < 0, state, e0[np.maximum(last, 0)] if len(e0) else state)
    states = base ^ ((flips - flips[last + 1]) & 1)
    return states[:-1], int(states[-1])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(file, block, rows) for stretches of rows of one split (columns 0 and 1)."""
    blocks = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode()
    codes = np.asarray(files.indices)
    edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (codes[1:] != codes[:-1])) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)], strict=True):
        if hi > lo:
            yield files.dictionary[int(codes[lo])].as_py(), int(blocks[lo]), batch.slice(lo, hi - lo)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its composed map, depth changes and, for both starting states, the pieces that start outside."""
    key, total = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(["file_path", "block_start", *_SPLIT], [*key, *total], strict=True))], _SUMMARY)

    for batch in batches:
        for file, block, rows in _runs(batch):
            if key != (file, block):
                if key is not None:
                    yield row()
                key, total = (file, block), [0, 1, 0, 0, 0, 0]
            e0, e1, d0, d1 = (rows.column(i).to_numpy() for i in range(2, 6))
            for s in (0, 1):
                states, total[s] = starts(e0, e1, total[s])
                total[2 + s] += int(np.where(states == 0, d0, d1).sum())
                total[4 + s] += int((states == 0).sum())
    if key is not None:
        yield row()


_SPLIT = ["e0", "e1", "d0", "d1", "n0", "n1"]
_SUMMARY = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("e0", pa.int32()), ("e1", pa.int32()),
                      ("d0", pa.int64()), ("d1", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
_RECORD = pa.schema([("file_path", pa.string()), ("block_start", pa.int64()), ("seq", pa.int64()), ("record_no", pa.int64()),
                     ("value", pa.string()), ("open_start", pa.bool_()), ("open_end", pa.bool_())])


class _Split:
    """Joins the pieces of one split into records."""

    def __init__(self, file: str, block: int, state: int, depth: int, number: int, fmt_level: int, separator: str,
                 fragments: bool):
        self.fragments = fragments  # whole records are only counted
        self.file, self.block, self.state, self.depth, self.number = file, block, state, depth, number
        self.level, self.separator = fmt_level, separator
        self.open: list[pa.Array] = []  # pieces of the record that is not finished yet
        self.open_start = not self._record_here()
        self.seq = 0

    def _record_here(self) -> bool:
        return self.state == 0 and self.depth == self.level

    def _joined(self, pieces: list[pa.Array], first: list[int]) -> pa.Array:
        values = pa.concat_arrays(pieces)
        lists = pa.ListArray.from_arrays(pa.array([*first, len(values)], pa.int32()), values)
        return pc.binary_join(lists, self.separator)

    def _rows(self, texts: pa.Array, open_start: bool, open_end: bool) -> pa.RecordBatch:
        n = len(texts)
        began = not open_start  # a record begins here: it takes the next number
        numbers = self.number + np.arange(n) + (1 if began else 0)
        flags = np.zeros(n, bool)
        flags[0] = open_start
        ends = np.zeros(n, bool)
        ends[-1] = open_end
        out = pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(self.file, pa.string()), n), pa.array(np.full(n, self.block)), pa.array(self.seq + np.arange(n)),
             pa.array(numbers), texts.cast(pa.string()), pa.array(flags), pa.array(ends)], schema=_RECORD)
        self.seq += n
        self.number += n - (0 if began else 1)
        return out

    def add(self, values: pa.Array, e0, e1, d0, d1) -> Iterator[pa.RecordBatch]:
        states, self.state = starts(e0, e1, self.state)
        depths = self.depth + np.concatenate(([0], np.cumsum(np.where(states == 0, d0, d1))))
        self.depth = int(depths[-1])
        first = np.flatnonzero((states == 0) & (depths[:-1] == self.level))
        if not len(first):
            self.open.append(values)
            return
        if first[0] > 0:
            self.open.append(values.slice(0, first[0]))
        if self.open:
            yield self._rows(self._joined(self.open, [0]), self.open_start, False)
        self.open_start = False
        if len(first) > 1 and self.fragments:
            self.seq += len(first) - 1
            self.number += len(first) - 1
        elif len(first) > 1:
            whole = values.slice(first[0], first[-1] - first[0])
            yield self._rows(self._joined([whole], (first[:-1] - first[0]).tolist()), False, False)
        self.open = [values.slice(first[-1])]

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            yield self._rows(self._joined(self.open, [0]), self.open_start, not self._record_here())


def _records(level: int, separator: str, fragments: bool):
    """Arrow function: pieces with their split's start -> records that lie in one split, or the fragments of others."""
    def chosen(rows: pa.RecordBatch) -> pa.RecordBatch:
        cut = pc.or_(rows.column(5), rows.column(6))
        if not fragments and not cut.true_count:
            return rows
        return rows.filter(cut if fragments else pc.invert(cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            for file, block, rows in _runs(batch):
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        yield from map(chosen, split.finish())
                    split = _Split(file, block, *(rows.column(i)[0].as_py() for i in (7, 8, 9)), level, separator, fragments)
                yield from map(chosen, split.add(rows.column(2).cast(pa.string()), *(rows.column(i).to_numpy() for i in range(3, 7))))
        if split is not None:
            yield from map(chosen, split.finish())

    return run


# --- plans ------------------------------------------------------------------------


def read_pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def split_starts(pieces: DataFrame, mapped) -> DataFrame:
    """(file_path, block_start, state, depth, number): what holds at the start of every split; number counts the pieces
    that began outside before it. ``mapped``: see ``Format``."""
    summary = pieces.mapInArrow(lambda batches: _summary(mapped(batches)),
                                "file_path string, block_start long, e0 int, e1 int, d0 long, d1 long, n0 long, n1 long")
    work_dir(pieces.sparkSession)  # makes sure a checkpoint folder is set
    summary = summary.checkpoint(eager=True)  # one row per split
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = ((F.col("e0") == 1) & (F.col("e1") == 0)).cast("int")
    scan = summary.withColumn("_flips", F.sum(swap).over(upto))
    fixed = F.col("e0") == F.col("e1")
    state = (F.coalesce(F.last(F.when(fixed, F.col("e0")), ignorenulls=True).over(before), F.lit(0))
             + F.coalesce(F.last("_flips").over(before), F.lit(0))
             - F.coalesce(F.last(F.when(fixed, F.col("_flips")), ignorenulls=True).over(before), F.lit(0))) % 2
    scan = scan.withColumn("state", state.cast("int"))
    total = lambda a, b: F.coalesce(F.sum(F.when(F.col("state") == 0, F.col(a)).otherwise(F.col(b))).over(before), F.lit(0))
    return scan.select("file_path", "block_start", "state", total("d0", "d1").alias("depth"), total("n0", "n1").alias("number"))


def _placed(pieces: DataFrame, mapped) -> DataFrame:
    """The pieces in order, with what holds at the start of their split: (file_path, block_start, value, state, depth, number)."""
    known = split_starts(pieces, mapped)
    small = byte_size(known) <= MAX_BYTES
    placed = pieces.withColumn("_pos", F.monotonically_increasing_id())
    placed = placed.join(F.broadcast(known) if small else known, ["file_path", "block_start"])
    if not small:  # a broadcast join keeps each split's rows together and in order, a shuffle join does not
        placed = placed.sortWithinPartitions("file_path", "block_start", "_pos")
    return placed.select("file_path", "block_start", "value", "state", "depth", "number")


def _joined(cut: DataFrame, between: str) -> DataFrame:
    """(file_path, record_no, value, first, last): the records that fragments are joined to, ``between`` between them."""
    order = Window.partitionBy("file_path").orderBy("block_start", "seq")
    cut = cut.withColumn("_record", F.sum((~F.col("open_start")).cast("int")).over(order))
    cut = cut.withColumn("_last", F.max("_record").over(Window.partitionBy("file_path")) == F.col("_record"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_start", "seq", "value"))), lambda x: x["value"]),
                        between)
    joined = cut.groupBy("file_path", "_record").agg(F.min("record_no").alias("record_no"), text.alias("value"),
                                                    F.max("_last").alias("last"))
    return joined.select("file_path", "record_no", "value", (F.col("_record") == 0).alias("first"), "last")


_RECORD_DDL = "file_path string, block_start long, seq long, record_no long, value string, open_start boolean, open_end boolean"


def read_records(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """(file_path, record_no, value): the records of all files below ``path``, counted from 1 in each file."""
    separator, level, mapped = fmt.separator, fmt.level, fmt.mapped
    placed = _placed(read_pieces(spark, path, separator), mapped)

    def records(fragments: bool):
        def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for maps in mapped(iter([batch])):
                    columns = [*batch.columns[:3], *maps.columns[2:], *batch.columns[3:]]
                    yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

        return lambda batches: _records(level, separator, fragments)(wide(batches))

    whole = placed.mapInArrow(records(False), _RECORD_DDL).select("file_path", "record_no", "value")
    return whole.unionByName(_joined(placed.mapInArrow(records(True), _RECORD_DDL), separator).select(*whole.columns))


def read_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The elements of the JSON arrays in the files below ``path``, one array a file: (value) of those that lie in one split,
    without white space outside strings; (value, first, last) of all others, as they stand: first and last mark the text that
    holds what comes before and behind all elements."""
    pieces = read_pieces(spark, path, "{").withColumn("value", F.concat(F.lit("{"), "value"))
    placed = _placed(pieces, _json_mapped)
    whole = placed.mapInArrow(_json_elements(False), "value string")
    return whole, _joined(placed.mapInArrow(_json_elements(True), _RECORD_DDL), "").select("value", "first", "last")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, open): the first line of every file below ``path``, and whether it ends inside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            for file, block, rows in _runs(batch):
                if key != (file, block):
                    key, value = (file, block), rows.column(2).slice(0, 1)
                    yield pa.RecordBatch.from_arrays([value, pa.array(csv_ends(value)[0] == 1)], ["value", "open"])

    pieces = read_pieces(spark, path, "\n").where(F.col("block_start") == 0)
    return pieces.mapInArrow(run, "value string, open boolean")
